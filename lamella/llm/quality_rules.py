"""Quality rules of documents with host-level verdicts, in Spark expressions only.

Rule failures are summed by host; each host's failure rate is shrunk towards a
beta prior fitted to all hosts by moments; a host whose posterior is clearly above
the rate of all documents is bad, and that verdict is joined back to its
documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as C

SYMBOLS = "#*$%&|<>"
#: A document fails a soft rule if more than this percentage of its word characters are symbols, or of its lines repeat an earlier line.
MAX_SYMBOL_PCT, MAX_DUP_LINE_PCT = 10, 30
#: A host is bad if mean - BOUND * standard deviation of its posterior failure rate is above the rate of all documents (one-sided 95 %).
BOUND = 1.645


def repeat_words(w: Column) -> Column:
    """Words in three-word windows that the text has twice or more, first ones included; windows are compared by 64-bit hash.

    The hashes are sorted with their positions, so a text costs n log n; texts without a repeat end before that.
    """
    hashes = F.transform(F.sequence(F.lit(1), F.size(w) - 2), lambda i: F.xxhash64(F.element_at(w, i), F.element_at(w, i + 1), F.element_at(w, i + 2)))

    def covered(at: Column) -> Column:
        """Words covered by the windows that start at these ascending positions."""
        return F.aggregate(at, F.struct(F.lit(0).alias("n"), F.lit(-3).alias("last")), lambda a, p: F.struct((a.n + F.least(F.lit(3), p - a["last"])).alias("n"), p.alias("last")), lambda a: a.n)

    def repeated(h: Column) -> Column:
        def starts(s: Column) -> Column:
            same = lambda x, j: ((j > 0) & (F.get(s, j - 1).h == x.h)) | ((j + 1 < F.size(s)) & (F.get(s, j + 1).h == x.h))
            return F.sort_array(F.transform(F.filter(s, same), lambda x: x.i))

        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(
            C.let(F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i")))), lambda s: C.let(starts(s), covered))
        )

    return F.when(F.size(w) < 3, F.lit(0)).otherwise(C.let(hashes, repeated)).cast("long")


def statistics(text: Column) -> Column:
    """Struct of n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words of a non-null text."""
    removed = lambda t, chars: F.length(t) - F.length(F.translate(t, chars, ""))
    lines = F.filter(F.split(text, "\n", -1), lambda x: F.length(F.translate(x, C.BLANKS, "")) > 0)
    return C.let(
        C.words(text),
        lambda w: C.let(
            lines,
            lambda x: F.struct(
                F.size(w).cast("long").alias("n_words"),
                F.length(F.translate(text, C.BLANKS, "")).cast("long").alias("word_chars"),
                removed(text, SYMBOLS).cast("long").alias("n_symbols"),
                F.size(x).cast("long").alias("n_lines"),
                (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
                repeat_words(w).alias("n_repeat_words"),
            ),
        ),
    )


def host_rates(failures: DataFrame) -> DataFrame:
    """host, n_docs, n_failed, rate, bad: the failure rate shrunk towards a beta prior fitted by moments to the rates of all hosts, weighted by documents.

    failures: host, failed (boolean). With one host, or no spread beyond chance, the prior is as strong as MAX_PRIOR documents; a single host is not bad.
    """
    hosts = failures.groupBy("host").agg(F.count("*").alias("n_docs"), F.sum(F.col("failed").cast("long")).alias("n_failed"))
    totals = hosts.agg(F.count("*").alias("k"), F.sum("n_docs").alias("n"), F.sum("n_failed").alias("f"), F.sum(F.col("n_docs") * F.col("n_docs")).alias("nn"), F.sum(F.col("n_failed") * F.col("n_failed") / F.col("n_docs")).alias("ff"))
    mean = F.col("f") / F.col("n")
    # Between-host variance by the method of moments for binomial rates of unequal size.
    spread = F.col("ff") - F.col("n") * mean * mean
    size = F.col("n") - F.col("nn") / F.col("n")
    var = (spread - (F.col("k") - 1) * mean * (1 - mean)) / (size - (F.col("k") - 1))
    strength = F.when((size > F.col("k") - 1) & (var > 0), F.least(F.lit(float(MAX_PRIOR)), mean * (1 - mean) / var)).otherwise(F.lit(float(MAX_PRIOR)))
    prior = totals.select(mean.alias("mean"), F.greatest(F.lit(1.0), F.coalesce(strength, F.lit(float(MAX_PRIOR)))).alias("strength"))
    # The prior is one row.
    total = F.col("n_docs") + F.col("strength")
    rated = hosts.crossJoin(F.broadcast(prior)).withColumn("rate", (F.col("n_failed") + F.col("strength") * F.col("mean")) / total)
    bound = F.col("rate") - BOUND * F.sqrt(F.col("rate") * (1 - F.col("rate")) / (total + 1))
    return rated.select("host", "n_docs", "n_failed", "rate", (bound > F.col("mean")).alias("bad"))


MAX_PRIOR = 1000


#: Host tables up to this many rows are broadcast; larger ones are joined by a shuffle.
BROADCAST_HOSTS = 100_000


def failures() -> dict[str, Column]:
    """base_failed: under 50 words, or more than half of the words in repeated three-word windows. soft_failed: too many symbols or repeated lines."""
    s = F.col("stats")
    base = (s["n_words"] < 50) | (100 * s["n_repeat_words"] > 50 * s["n_words"])
    soft = (100 * s["n_symbols"] > MAX_SYMBOL_PCT * s["word_chars"]) | (100 * s["n_dup_lines"] > MAX_DUP_LINE_PCT * s["n_lines"])
    return {"base_failed": base, "soft_failed": soft}


def rates_of(given: DataFrame) -> DataFrame:
    """host, host_rate, bad_host of stored rows with host, base_failed, soft_failed."""
    rates = host_rates(given.select("host", (F.col("base_failed") | F.col("soft_failed")).alias("failed")))
    return C.checkpointed(rates.select("host", F.col("rate").alias("host_rate"), F.col("bad").alias("bad_host")))


@C.tidy
def judge(docs: DataFrame, *, text: str = "text", host: str = "source", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """A row for each row of docs: row (a struct of the columns keep), stats (see statistics()), base_failed, soft_failed, host_rate, bad_host, kept.

    A document is kept unless base_failed, or its host is bad and it is soft_failed itself: a clean document of a bad host stays.
    Results: a null or empty text has zeros and is base_failed; null hosts form one host; repeated rows count each; an empty table gives no rows;
    columns of docs may have any names.
    """
    given = docs.select(F.struct(*[F.col(c) for c in keep]).alias("row"), F.col(host).alias("host"), C.once(stats=statistics(C.whole(text))))
    given = C.stored(given.withColumns(failures()), "quality")
    rates = C.small(rates_of(given), BROADCAST_HOSTS).alias("r")
    kept = ~F.col("base_failed") & ~(F.col("bad_host") & F.col("soft_failed"))
    out = given.alias("g").join(rates, F.col("g.host").eqNullSafe(F.col("r.host")))
    return out.select("row", "stats", "base_failed", "soft_failed", "host_rate", "bad_host", kept.alias("kept"))


@C.tidy
def kept(docs: DataFrame, *, text: str = "text", host: str = "source") -> DataFrame:
    """The rows of docs that judge() keeps, with all columns. The rows that are not base_failed are stored with their flags, so the statistics are computed once."""
    given = docs.select(F.struct(*[F.col(c) for c in docs.columns]).alias("row"), F.col(host).alias("host"), C.once(stats=statistics(C.whole(text)))).withColumns(failures())
    given = C.stored(given.select(F.when(~F.col("base_failed"), F.col("row")).alias("row"), "host", "base_failed", "soft_failed"), "quality")
    bad = C.small(rates_of(given).where("bad_host"), BROADCAST_HOSTS).alias("r")
    good = given.where(~F.col("base_failed"))
    return good.alias("g").join(bad, F.col("g.host").eqNullSafe(F.col("r.host")) & F.col("g.soft_failed"), "left_anti").select("row.*")
