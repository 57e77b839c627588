"""Secret scans: spans of secrets in texts, and multipart credentials linked across a text, in Spark expressions only.

Strong spans are found by pattern alone. Weak candidates (identifiers, short
secrets, endpoints) mean little alone: they are reported only if the parts that
complete them occur near them in the same scope, by an interval join.
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as C

# The patterns of the base kinds, in the order in which kinds are listed.
ASSIGN = r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"  # AKIA and all of [A-Z0-9] behind it, 20 or more in all
HEX = r"[0-9a-f]{24,}"
ASSIGN_MIN = 6

# Weak parts. Words must not be part of a longer word.
WEAK = {
    "weak_id": r"(?<![A-Za-z0-9_])(?:[Uu]ser(?:name)?|[Ll]ogin|[Aa]ccount|[Cc]lient_?[Ii]d|[Aa]ccess_?[Kk]ey(?:_?[Ii]d)?)\x20*[:=]\x20*[\"']?[A-Za-z0-9@._-]{3,}",
    "weak_secret": r"(?<![A-Za-z0-9_])(?:[Pp]wd|[Pp]ass|[Pp]assphrase|[Cc]redential|[Aa]uth|[Pp]rivate_?[Kk]ey)\x20*[:=]\x20*[\"']?[A-Za-z0-9+/_.=-]{4,}",
    "email": r"(?<![A-Za-z0-9_])[A-Za-z0-9][A-Za-z0-9._%+-]{0,63}@[A-Za-z0-9][A-Za-z0-9.-]{0,252}\.[A-Za-z]{2,24}",
    "endpoint": r"(?<![A-Za-z0-9_])(?:[a-z][a-z0-9+.-]{1,15}://[A-Za-z0-9._@-]+(?::[0-9]{1,5})?|(?:[Hh]ost|[Ee]ndpoint|[Ss]erver)\x20*[:=]\x20*[\"']?[A-Za-z0-9._-]{3,})",
}
KINDS = ["assign", "access", "hex", *WEAK]
#: The role of each kind in a credential.
ROLE = {"assign": "secret", "access": "id", "hex": "secret", "weak_id": "id", "weak_secret": "secret", "email": "id", "endpoint": "endpoint"}
#: The roles that must all occur near a weak part.
NEEDS = {"weak_id": ["secret"], "weak_secret": ["id"], "email": ["secret"], "endpoint": ["id", "secret"]}
#: Parts complete each other if at most so many code points are between them and no blank line is.
REACH = 200
#: A text without any of its strings has no match of a kind, so the pattern is not tried.
HINTS = {"assign": ":=", "access": ["AKIA"], "weak_id": ":=", "weak_secret": ":=", "email": "@", "endpoint": ":="}
#: Completed parts of at most so many spans in all are broadcast to the texts.
BROADCAST_SPANS = 500_000
SPANS = "array<struct<start:int,kind:int,end:int>>"


def found(text: Column, pattern: str, kind: str, keep=None) -> Column:
    """Array of struct(start, kind index, end) of the leftmost non-overlapping matches, in code points; keep(match) drops failing ones."""
    index = F.lit(KINDS.index(kind) if kind in KINDS else len(KINDS))

    def placed(hits: Column) -> Column:
        def place(gaps: Column) -> Column:
            # A match ends behind the gaps up to it and the matches up to it.
            sizes = F.transform(hits, lambda h, i: F.length(F.get(gaps, i)) + F.length(h))
            spans = lambda ends: F.transform(
                hits, lambda h, i: F.struct((F.get(ends, i) - F.length(h)).alias("start"), index.alias("kind"), F.get(ends, i).alias("end"))
            )
            return C.let(sizes, lambda z: C.let(C.running(z, lambda x, y: x + y), spans))

        some = C.let(F.split(text, pattern, -1), place)
        if keep is not None:
            some = F.filter(some, lambda _, i: keep(F.get(hits, i)))
        return F.when(F.size(hits) > 0, some).otherwise(F.array()).cast(SPANS)

    spans = C.let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), placed)
    if kind not in HINTS:
        return spans
    return F.when(hinted(text, HINTS[kind]), spans).otherwise(F.array().cast(SPANS))


def hinted(text: Column, hints: Iterable[str]) -> Column:
    return reduce(lambda x, y: x | y, (F.contains(text, F.lit(h)) for h in hints))


def base_spans(text: Column) -> list[Column]:
    return [
        found(text, ASSIGN, "assign", lambda m: F.length(F.regexp_extract(m, ASSIGN, 2)) >= ASSIGN_MIN),
        found(text, ACCESS, "access"),
        found(text, HEX, "hex"),
    ]


def joined(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined; spans are sorted by start, then kind as listed."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["end"])), ",")


def linked(parts: DataFrame) -> DataFrame:
    """The weak parts that are complete. parts: doc, scope, kind (index), start, end.

    An interval semi-join for each role that a kind needs: a part is in all bins of REACH code points that it covers, a weak part probes the
    bins of itself and of REACH code points around it, on document, scope and bin, and leaves one row at most. Matches of a kind do not
    overlap, so a text has at most a row for each REACH of its code points and kind, and a few for each part.
    """
    role = F.element_at(F.array(*[F.lit(ROLE[k]) for k in KINDS]), F.col("kind") + 1)
    b = lambda at: F.floor(at / REACH)
    at = parts.select("doc", "scope", role.alias("role"), "start", "end").distinct()
    at = at.withColumn("bin", F.explode(F.sequence(b(F.col("start")), b(F.col("end")))))
    out = []
    for kind, needs in NEEDS.items():
        weak = parts.where(F.col("kind") == KINDS.index(kind)).distinct()
        for need in needs:
            probes = weak.select("*", F.explode(F.sequence(b(F.col("start") - REACH), b(F.col("end") + REACH))).alias("bin")).alias("w")
            other = at.where(F.col("role") == need).alias("o")
            same = [F.col(f"w.{c}") == F.col(f"o.{c}") for c in ("doc", "scope", "bin")]
            near = (F.col("w.start") - F.col("o.end") <= REACH) & (F.col("o.start") - F.col("w.end") <= REACH)
            weak = probes.join(other, [*same, near], "left_semi").drop("bin").distinct()
        out.append(weak)
    return reduce(DataFrame.unionByName, out)


def marked(docs: DataFrame, text: str, **more: Column) -> DataFrame:
    """base, weak, breaks and doc for each row of docs, and more: strong spans, weak parts, blank lines, and the MD5 of the text. The last two are null without weak parts."""
    t = C.whole(text)
    weak = F.concat(*[found(t, pattern, kind) for kind, pattern in WEAK.items()])
    rows = docs.select(*[c.alias(n) for n, c in more.items()], C.once(base=F.sort_array(F.concat(*base_spans(t))), weak=weak, t=t))
    some = F.size("weak") > 0
    return rows.select(*more, "base", "weak", F.when(some, found(F.col("t"), r"\n[ \t\r\x0B\f]*\n", "break")).alias("breaks"), F.when(some, F.md5("t")).alias("doc"))


def completed(rows: DataFrame) -> DataFrame:
    """doc, more: the complete weak parts of the texts of marked(), stored."""
    parts = rows.where(F.col("doc").isNotNull()).select("doc", "breaks", F.explode(F.concat("base", "weak")).alias("p"))
    scope = F.size(F.filter("breaks", lambda b: b["start"] < F.col("p.start")))
    complete = linked(parts.select("doc", scope.alias("scope"), "p.kind", "p.start", "p.end"))
    return C.stored(complete.groupBy("doc").agg(F.collect_list(F.struct("start", "kind", "end")).alias("more")), "complete")


def attached(rows: DataFrame, complete: DataFrame) -> DataFrame:
    """row, base, spans of rows (row, base, doc): by broadcast if complete has few spans; if not, the rows with a doc, and only they, meet it in a shuffle."""
    spans = F.sort_array(F.concat("base", F.coalesce("more", F.array().cast(SPANS)))).alias("spans")
    if (complete.agg(F.sum(F.size("more"))).first()[0] or 0) <= BROADCAST_SPANS:
        return rows.join(F.broadcast(complete), "doc", "left").select("row", "base", spans)
    with_weak = rows.where(F.col("doc").isNotNull()).join(complete, "doc", "left").select("row", "base", spans)
    return with_weak.unionByName(rows.where(F.col("doc").isNull()).select("row", "base", F.col("base").alias("spans")))


@C.tidy
def scan(docs: DataFrame, *, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """A row for each row of docs: row (a struct of the columns keep), then base and spans, each an array of struct(start, kind, end) sorted by start, then kind.

    kind is the place in KINDS. base has the strong spans, spans those and the complete weak parts. What is linked depends on the text alone,
    so parts are joined by the text's MD5 and copies of a text are linked once.
    Results: a null or empty text has empty arrays; repeated rows are reported each; an empty table gives no rows. Columns of docs may have any
    names.
    """
    rows = C.stored(marked(docs, text, row=F.struct(*[F.col(c) for c in keep])), "secrets")
    return attached(rows, completed(rows))


def merged(spans: Column) -> Column:
    """Sorted spans as disjoint struct(start, end), overlapping or touching ones united."""

    def united(far: Column) -> Column:
        """far: the furthest end so far, at each span. A span behind it begins a new one."""
        places = F.sequence(F.lit(0), F.size(spans) - 1)
        firsts = F.filter(places, lambda i: (i == 0) | (F.get(far, i - 1) < F.get(spans, i)["start"]))
        last = lambda b, j: F.coalesce(F.get(b, j + 1), F.size(spans)) - 1
        return C.let(firsts, lambda b: F.transform(b, lambda i, j: F.struct(F.get(spans, i)["start"].alias("start"), F.get(far, last(b, j)).alias("end"))))

    return C.let(F.transform(spans, lambda s: s["end"]), lambda e: C.let(C.running(e, F.greatest), united))


def redacted(text: Column, spans: Column, mark: str = "[SECRET]") -> Column:
    """text with each united span replaced by mark."""

    def rebuilt(m: Column) -> Column:
        end = lambda i: F.when(i == 0, F.lit(0)).otherwise(F.get(m, i - 1)["end"])
        pieces = F.transform(m, lambda s, i: F.concat(F.substring(text, end(i) + 1, s["start"] - end(i)), F.lit(mark)))
        return F.concat(F.array_join(pieces, ""), F.substring(text, F.element_at(m, F.size(m))["end"] + 1, F.length(text)))

    return F.when(F.size(spans) == 0, text).otherwise(C.let(merged(spans), rebuilt))


@C.tidy
def redact(docs: DataFrame, *, text: str = "text") -> DataFrame:
    """docs with the spans of scan() replaced in the text; null texts stay null. Columns and rows stay as they are.

    The strong spans are found once more beside the texts, so no text is stored, and texts are shuffled only if the complete parts are too many to be
    broadcast.
    """
    complete = completed(C.stored(marked(docs, text).where(F.size("weak") > 0), "secrets"))
    t = C.whole(text)
    own = C.once(base=F.sort_array(F.concat(*base_spans(t))), doc=F.when(hinted(t, "".join(h for k in WEAK for h in HINTS[k])), F.md5(t)))
    out = attached(docs.select(F.struct(*[F.col(c) for c in docs.columns]).alias("row"), own), complete)
    new = F.when(F.col("row")[text].isNotNull(), redacted(F.col("row")[text], F.col("spans")))
    return out.select(F.col("row").withField(text, new).alias("row")).select("row.*")
