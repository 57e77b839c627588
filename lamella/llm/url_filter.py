"""URL filters: fixed rules by host and path, and host reputation by empirical Bayes, in Spark expressions only.

Labelled page outcomes are counted by host, registered domain and suffix. At each
level the rate of bad pages is shrunk towards the level above by a beta-binomial
prior: all pages, then suffix, then registered domain, then host. A url is
blocked if the lower bound of its host's posterior rate is high.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as C

#: Suffixes of several labels, unless the caller has a longer list; all others are the last label.
TWO_LABEL_SUFFIXES = ("co.uk", "org.uk", "ac.uk", "com.au", "com.br", "co.jp", "co.in", "co.nz")
#: A url is blocked if mean - BOUND * standard deviation of the posterior rate of bad pages is above MAX_BAD.
BOUND, MAX_BAD = 1.645, 0.5
#: Least and most pages that a prior counts for.
STRENGTH = (1.0, 1000.0)
#: Rule and reputation tables up to so many rows are broadcast; larger ones are joined by a shuffle.
BROADCAST_ROWS = 100_000


def parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url; both empty for null or without ://."""
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://(.*)$", 1)
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def suffixes(host: Column) -> Column:
    """The host and each of its parent domains."""
    labels = F.split(host, r"\.", -1)
    return F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))


def domain_of(host: Column, known: Sequence[str] = TWO_LABEL_SUFFIXES) -> tuple[Column, Column]:
    """Registered domain and suffix, the longest of known or the last label; a bare suffix is its own registered domain."""
    labels = F.split(host, r"\.", -1)
    last = lambda n: F.array_join(F.slice(labels, F.greatest(F.lit(1), F.size(labels) - n + 1), n), ".")
    domain, suffix = last(2), last(1)
    by_size: dict[int, list[str]] = {}
    for x in known:
        by_size.setdefault(x.count(".") + 1, []).append(x)
    for n, some in sorted(by_size.items()):
        fits = last(n).isin(*some)
        domain, suffix = F.when(fits, last(n + 1)).otherwise(domain), F.when(fits, last(n)).otherwise(suffix)
    return domain, suffix


def level(counts: DataFrame, by: str, above: Column) -> DataFrame:
    """by, mean and strength of the posterior of each row of counts, stored. counts: by, n, bad and what above, the mean of the level above, reads.

    The prior's strength is fitted by moments: how much the rates of rows of two pages or more differ from the level above beyond chance.
    """
    rate = F.col("bad") / F.col("n")
    v = above * (1 - above)
    some = counts.where("n >= 2")
    fit = some.agg(F.sum(F.pow(rate - above, 2) * F.col("n")).alias("spread"), F.sum(v).alias("chance"), F.sum(v * (F.col("n") - 1)).alias("size"))
    # E[n (rate - above)^2] = v + v (n - 1) / (strength + 1)
    rho = (F.col("spread") - F.col("chance")) / F.col("size")
    fit = fit.select(F.when(rho > 0, F.greatest(F.lit(STRENGTH[0]), F.least(F.lit(STRENGTH[1]), 1 / rho - 1))).otherwise(F.lit(STRENGTH[1])).alias("prior"))
    total = F.col("n") + F.col("prior")
    # fit is one row
    return C.stored(counts.crossJoin(F.broadcast(fit)).select(F.col(by), ((F.col("bad") + F.col("prior") * above) / total).alias("mean"), total.alias("strength")), f"rates-{by}")


def reputation(labelled: DataFrame, known: Sequence[str] = TWO_LABEL_SUFFIXES) -> dict[str, DataFrame]:
    """host, domain, suffix, all: tables of (name, mean, strength). labelled: host, bad (boolean). Counts and levels are stored, so none is computed again for the next."""
    domain, suffix = domain_of(F.col("host"), known)
    hosts = labelled.groupBy("host").agg(F.count("*").alias("n"), F.sum(F.col("bad").cast("long")).alias("bad")).select("*", domain.alias("domain"), suffix.alias("suffix"))
    hosts = C.stored(hosts, "hosts")
    counts = lambda by: hosts.groupBy(*by).agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    everything = hosts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad"))
    # Before any page is seen, half a bad page in one.
    everything = C.stored(everything.select(((F.col("bad") + 0.5) / (F.col("n") + 1)).alias("mean"), (F.col("n") + 1.0).alias("strength")), "rates-all")
    top = everything.select(F.col("mean").alias("above"))
    under = lambda rows, level, by: rows.join(C.small(level.select(by, F.col("mean").alias("above")), BROADCAST_ROWS), by)
    s = level(counts(["suffix"]).crossJoin(F.broadcast(top)), "suffix", F.col("above"))  # top is one row
    d = level(under(counts(["domain", "suffix"]), s, "suffix"), "domain", F.col("above"))
    h = level(under(hosts, d, "domain"), "host", F.col("above"))
    return {"all": everything, "suffix": s, "domain": d, "host": h}


def matched(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """host, path, rule, action of the longest rule that fits each distinct host and path. rules: host, path, action."""
    rules = C.small(rules.select(F.col("host").alias("_h"), F.col("path").alias("_p"), "action"), BROADCAST_ROWS)
    probes = pages.select("host", "path").distinct().select("host", "path", F.explode(suffixes(F.col("host"))).alias("_h"))
    hits = probes.join(rules, "_h").where(F.col("path").startswith(F.col("_p")))
    rule = F.concat("_h", "_p")
    # Longest first; rules of equal length fit the same url only if they are the same rule, and then block counts.
    best = F.max_by(F.struct(rule.alias("rule"), "action"), F.struct(F.length(rule), F.col("action")))
    return hits.groupBy("host", "path").agg(best.alias("b")).select("host", "path", "b.rule", "b.action")


@C.tidy
def judge(pages: DataFrame, rules: Sequence[tuple[str, str, str]] | DataFrame, labelled: DataFrame, *, key: str = "page_id", url: str = "url", labelled_url: str = "url", bad: str = "bad", known_suffixes: Sequence[str] = TWO_LABEL_SUFFIXES) -> DataFrame:
    """key, host, path, rule, verdict, bad_rate (posterior mean), bad_bound for each row of pages.

    rules: (host, path, action) with action allow or block; a rule fits its host and all subdomains if the url's path starts with its path.
    labelled: urls of labelled pages with their outcome. known_suffixes: suffixes of several labels, as a public list has them. A host without labelled pages has the posterior of its domain, else of its suffix, else of all.
    Results: a null url, or one without ://, has empty host and path; repeated rows are judged each; labelled rows with a null outcome are ignored;
    without labelled pages nothing is blocked but by rule; an empty table gives no rows. Other columns are ignored, whatever their names.
    """
    spark = pages.sparkSession
    if not isinstance(rules, DataFrame):
        rules = spark.createDataFrame(list(rules), "host string, path string, action string")
    host, path = parts(F.col(url))
    domain, suffix = domain_of(F.col("host"), known_suffixes)
    given = C.stored(pages.select(F.col(key).alias("key"), host.alias("host"), path.alias("path")), "urls")
    known = reputation(labelled.where(F.col(bad).isNotNull()).select(parts(F.col(labelled_url))[0].alias("host"), F.col(bad).cast("boolean").alias("bad")), known_suffixes)
    # One row for each distinct host is looked up at every level, not one for each page.
    hosts = given.select("host").distinct().select("host", domain.alias("domain"), suffix.alias("suffix"))
    for name in ("host", "domain", "suffix"):
        hosts = hosts.join(C.small(known[name].select(name, F.struct("mean", "strength").alias(f"_{name}")), BROADCAST_ROWS), name, "left")
    hosts = hosts.crossJoin(F.broadcast(known["all"].select(F.struct("mean", "strength").alias("_all"))))  # one row
    p = F.coalesce("_host", "_domain", "_suffix", "_all")
    hosts = hosts.select("host", p["mean"].alias("bad_rate"), (p["mean"] - BOUND * F.sqrt(p["mean"] * (1 - p["mean"]) / (p["strength"] + 1))).alias("bad_bound"))
    hits = C.stored(matched(given, rules), "matched")
    out = given.join(C.small(hits, BROADCAST_ROWS), ["host", "path"], "left").join(C.small(C.stored(hosts, "verdicts"), BROADCAST_ROWS), "host")
    by_rate = F.when(F.col("bad_bound") > MAX_BAD, "block").otherwise("allow")
    return out.select(F.col("key").alias(key), "host", "path", "rule", F.coalesce("action", by_rate).alias("verdict"), "bad_rate", "bad_bound")
