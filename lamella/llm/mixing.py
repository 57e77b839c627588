"""Mixing sources to target weights by hash-threshold histograms.

Each source gets a target number of tokens. A document's copies are decided by
comparing a hash of its key with its source's threshold, so the selections for
growing budgets are nested and nothing is sorted. The threshold comes from sums
of sizes by source and hash bucket: the bucket in which the budget runs out is
found from those sums, then only that bucket is split into finer ones, until
one hash is left in it. Sources, targets and thresholds are tables; what goes to
the driver are single numbers.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from lamella.session import ranked
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common as C

#: Bits of the document hash, and bits resolved by one histogram pass.
HASH_BITS, PASS_BITS = 60, 12
#: Further ranges of a source, which fill what one large document at the end of its range leaves open.
ROUNDS = 3
#: Tables of sources with up to so many rows are broadcast; larger ones are joined by a shuffle.
BROADCAST_SOURCES = 100_000


def key_hash(key: Column, ties: Column | None = None) -> Column:
    """The first 60 bits of the MD5 of the key as text (null: of the empty text), a non-negative long. ties: text that parts rows with the same key."""
    name = F.coalesce(key.cast("string"), F.lit(""))
    if ties is not None:
        name = F.concat(name, F.lit(":"), F.coalesce(ties.cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(name), 1, 15), 16, 10).cast("long")


@C.tidy
def targets(sizes: DataFrame, weights: Sequence[float], share: float, most: float) -> DataFrame:
    """sizes (source, size) with source_id and target: share * (sum of sizes) dealt by weight; one above most * its size stops there and its excess is dealt to the rest again.

    Sources are taken by code point with null last; weights repeat. Each round sums what the sources that stop take and the weights of the rest.
    """
    name = F.when(F.col("source").isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), F.col("source")))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("source_id") % len(weights) + 1).cast("int"))
    rows = ranked(sizes.withColumn("name", name), "name", "source_id").select("source", "size", "source_id", weight.alias("weight"))
    rows = C.stored(rows, "sources")
    total, of_weights = rows.agg(F.coalesce(F.sum("size"), F.lit(0)), F.coalesce(F.sum("weight"), F.lit(0.0))).first()
    left, rest, stopped = share * total, of_weights, -1
    while True:
        dealt = F.lit(float(left)) * F.col("weight") / F.lit(float(rest)) if rest else F.lit(float("inf"))
        cap = F.lit(float(most)) * F.col("size")
        full = dealt > cap
        n, taken, active = rows.agg(F.count(F.when(full, 1)), F.coalesce(F.sum(F.when(full, cap)), F.lit(0.0)), F.coalesce(F.sum(F.when(~full, F.col("weight"))), F.lit(0.0))).first()
        if n == stopped or not rest:
            return rows.select("source", "size", "source_id", F.when(full, cap).otherwise(dealt).alias("target"))
        stopped, left, rest = n, share * total - taken, active


@C.tidy
def bounds(sized: DataFrame, budget: DataFrame, n_sources: int) -> DataFrame:
    """Rows (source_id, low, high, largest): a source takes the documents with low <= hash < high and size <= largest, for each of its rows.

    sized: source_id, hash, size; budget: source_id, room. The first row of a source is the longest prefix of hashes whose sizes fit its budget. The
    document after it is too large for what is left; ROUNDS more rows go on behind it with the documents that are not, so that what is left becomes
    small. A pass sums sizes by source and PASS_BITS bits inside the one bucket that is still open: partial sums before the shuffle, at most
    2 ** PASS_BITS rows for each source after it. A bucket with one hash in it ends the search.
    """
    hint = F.broadcast if n_sources <= BROADCAST_SOURCES else (lambda df: df)
    upto = F.sum("size").over(Window.partitionBy("source_id").orderBy("bucket"))
    end = 2**HASH_BITS
    state = budget.select("source_id", F.lit(0).cast("long").alias("start"), F.col("room").cast("long").alias("room"))
    found = []
    for _ in range(ROUNDS + 1):
        live = state.where((F.col("room") > 0) & (F.col("start") < end))
        state = C.stored(live.select("source_id", "start", "room", F.col("room").alias("largest"), F.col("start").alias("low"), F.lit(None).cast("long").alias("edge")), "bounds")
        # Buckets count from the start of the round, which need not be aligned; a first pass over all bits, then ever finer ones.
        for shift in range(HASH_BITS - PASS_BITS, -1, -PASS_BITS):
            open_ = state.where("edge is null")
            if not open_.limit(1).count():
                break
            bucket = F.shiftright(F.col("hash") - F.col("low"), shift)
            sums = (
                sized.join(hint(open_.select("source_id", "low", "room", "largest")), "source_id")
                .where((F.col("hash") >= F.col("low")) & (bucket < 2**PASS_BITS) & (F.col("size") <= F.col("largest")))
                .groupBy("source_id", "room", bucket.alias("bucket"))
                .agg(F.sum("size").alias("size"), F.min("hash").alias("first"), F.max("hash").alias("last"))
                .withColumn("upto", upto)
            )
            over = F.when(F.col("upto") > F.col("room"), F.struct("bucket", "first", "last"))
            fits = sums.groupBy("source_id").agg(F.max(F.when(F.col("upto") <= F.col("room"), F.col("upto"))).alias("used"), F.min(over).alias("at"))
            low = F.col("low") + F.call_function("shiftleft", F.col("at.bucket"), F.lit(shift))
            # All of the bucket fits: only in a round's first pass, where the source ends.
            edge = F.when(F.col("at").isNull(), F.lit(end)).when(F.col("at.first") == F.col("at.last"), F.col("at.first"))
            new = [(F.col("room") - F.coalesce("used", F.lit(0))).alias("room"), "largest", F.coalesce(low, "low").alias("low"), F.coalesce("edge", edge).alias("edge")]
            closed = state.where("edge is not null")
            state = C.stored(closed.unionByName(open_.join(hint(fits), "source_id", "left").select("source_id", "start", *new)), "bounds")
        high = F.least(F.lit(end), F.coalesce("edge", "low"))
        found.append(state.select("source_id", F.col("start").alias("low"), high.alias("high"), "largest"))
        state = state.select("source_id", (high + 1).alias("start"), "room")
    return reduce(DataFrame.unionByName, found)


def plan(sized: DataFrame, weights: Sequence[float], share: float, most: float) -> tuple[DataFrame, int]:
    """A row for each source, and their number: source, source_size, target, base (copies that each of its documents gets), ranges (of one more copy).

    sized: source, size, hash.
    """
    goal = C.stored(targets(sized.groupBy("source").agg(F.sum("size").alias("size")), weights, share, most), "targets")
    n = goal.count()
    hint = F.broadcast if n <= BROADCAST_SOURCES else (lambda df: df)
    base = F.when(F.col("size") > 0, F.floor(F.col("target") / F.col("size"))).otherwise(F.lit(0)).cast("long")
    goal = goal.withColumn("base", base)
    names = hint(goal.select(F.col("source").alias("name"), "source_id"))
    named = sized.join(names, F.col("source").eqNullSafe(F.col("name"))).select("hash", "size", "source_id")
    ranges = bounds(named, goal.select("source_id", (F.col("target") - F.col("base") * F.col("size")).cast("long").alias("room")), n)
    ranges = ranges.groupBy("source_id").agg(F.sort_array(F.collect_list(F.struct("low", "high", "largest"))).alias("ranges"))
    return C.stored(goal.join(ranges, "source_id", "left").select("source", F.col("size").alias("source_size"), "target", "base", "ranges"), "plan"), n


@C.tidy
def mix(
    docs: DataFrame, size: Column, *, key: str = "doc_id", source: str = "source", ties: Column | None = None, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, most: float = 2
) -> DataFrame:
    """A row for each row of docs: row (a struct of all its columns), size, source_size, target, copies: how often the mix takes the document.

    A source with target t and size s takes every document t // s times and, by the hash thresholds, some of them once more. The hash is that of the
    key and of ties, for which a digest of the text serves: rows that share a key are then taken one by one.
    Results: a null size counts as 0; null keys and ties hash like the empty text; rows equal in both are taken alike; a null source is a source of
    its own, ordered last; a source whose size is 0 has target 0 and no copies; an empty table gives no rows.
    """
    row = F.struct(*[F.col(c) for c in docs.columns]).alias("row")
    own = C.once(source=F.col(source).cast("string"), size=F.coalesce(size, F.lit(0)).cast("long"), hash=key_hash(F.col(key), ties))
    by_source, n = plan(C.stored(docs.select(own), "sizes"), weights, share, most)
    if n <= BROADCAST_SOURCES:
        by_source = F.broadcast(by_source)
    sized = docs.select(row, own).alias("d")
    once_more = F.exists(F.coalesce("ranges", F.array().cast("array<struct<low:long,high:long,largest:long>>")), lambda r: (F.col("hash") >= r["low"]) & (F.col("hash") < r["high"]) & (F.col("size") <= r["largest"]))
    copies = F.when(F.col("source_size") > 0, F.col("base") + once_more.cast("long")).otherwise(F.lit(0)).cast("long")
    return sized.join(by_source.alias("s"), F.col("d.source").eqNullSafe(F.col("s.source"))).select("row", "size", "source_size", "target", copies.alias("copies"))


@C.tidy
def take(docs: DataFrame, size: Column, **options) -> DataFrame:
    """The mix itself: each row of docs as often as mix() takes it."""
    out = mix(docs, size, **options).where(F.col("copies") > 0)
    return out.select("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select("row.*")
