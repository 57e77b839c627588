"""Packing by optimal length buckets.

The global histogram of lengths goes to the driver; dynamic programming over it
chooses the bucket boundaries with the least padding; inside each bucket the
documents form batches of a token budget.

The histogram has a row for each distinct length. k distinct lengths take
k * (k + 1) / 2 tokens at least, so a corpus of T tokens has at most sqrt(2 * T)
of them: 6.4 million rows of 16 bytes for 2e13 tokens.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common as C

#: Rows ranked by one task.
CHUNK_ROWS = 100_000


def cheapest(best: np.ndarray, c: np.ndarray, top: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each j from 1: the least best[i] + (c[j] - c[i]) * top[j - 1] over i < j, and its i.

    The i that is best never falls as j grows (top and c ascend), so the middle j of a range bounds the search of both halves; all ranges of a
    depth are searched together, n steps for each of the log n depths.
    """
    n = len(top)
    cost, at = np.full(n + 1, np.inf), np.zeros(n + 1, np.int64)
    # Ranges first..last of j with the bounds of their i.
    ranges = np.array([[1, n, 0, n - 1]])
    while len(ranges):
        first, last, low, high = ranges.T
        j = (first + last) // 2
        upto = np.minimum(high, j - 1)
        sizes = upto - low + 1
        heads = np.cumsum(sizes) - sizes
        which = np.repeat(np.arange(len(j)), sizes)
        i = np.arange(sizes.sum()) - heads[which] + low[which]
        value = best[i] + (c[j[which]] - c[i]) * top[j[which] - 1]
        least = np.minimum.reduceat(value, heads)
        hits = np.flatnonzero(value == least[which])
        _, first_hit = np.unique(which[hits], return_index=True)
        cost[j], at[j] = least, i[hits[first_hit]]
        halves = np.concatenate([np.stack([first, j - 1, low, at[j]], 1), np.stack([j + 1, last, at[j], high], 1)])
        ranges = halves[halves[:, 0] <= halves[:, 1]]
    return cost, at


def boundaries(lengths: np.ndarray, count: np.ndarray, n_buckets: int) -> list[int]:
    """Ascending bucket lengths, at most n_buckets of them, each one of the ascending lengths, the last the largest: padding to them is least."""
    top = np.asarray(lengths, dtype=np.float64)
    c = np.concatenate([[0.0], np.cumsum(count, dtype=np.float64)])
    n = len(top)
    # best[j]: least padded total of the first j lengths with so many buckets; padding differs from it by a constant.
    best = np.concatenate([[0.0], np.full(n, np.inf)])
    cuts = []
    for k in range(min(n_buckets, n)):
        cost, at = cheapest(best, c, top) if k else (np.concatenate([[0.0], c[1:] * top]), np.zeros(n + 1, np.int64))
        better = cost < best
        better[0] = False
        cuts.append(np.where(better, at, np.arange(n + 1)))
        best = np.where(better, cost, best)
    out, j = [], n
    for cut in reversed(cuts):
        if j and cut[j] != j:
            out.append(int(lengths[j - 1]))
            j = int(cut[j])
    return out[::-1]


@C.tidy
def pack(docs: DataFrame, length: Column, *, n_buckets: int = 16, budget: int = 16_384, key: str = "doc_id", ties: Column | None = None) -> DataFrame:
    """docs with n_tokens, bucket (from 0), bucket_len, batch (from 0 in its bucket), slot (from 0 in its batch).

    A batch of a bucket holds budget // bucket_len documents, one at least; all but a bucket's last batch are full. bucket_len - n_tokens is a document's padding.
    Inside a bucket, documents are ranked by the hash of their key and of ties (a digest of the text parts rows that share a key) in chunks of about
    CHUNK_ROWS rows: ranks in a chunk, plus the sizes of the chunks before it.
    Results: a null length counts as 0, lengths of 0 share the shortest bucket; longer texts than the budget form batches of their own; equal keys
    (repeated rows) get slots of their own; rows equal in key and ties share a chunk; an empty table gives no rows. Columns of docs stay; those named
    like an added one are replaced.
    """
    added = ["n_tokens", "bucket", "bucket_len", "batch", "slot"]
    own = [c for c in docs.columns if c not in added]
    tie = F.lit(0).cast("long") if ties is None else F.xxhash64(ties)
    sized = docs.select(F.struct(*[F.col(c) for c in own]).alias("row"), F.col(key).alias("key"), C.once(n_tokens=F.coalesce(length, F.lit(0)).cast("long"), tie=tie))
    histogram = sized.groupBy("n_tokens").agg(F.count("*").alias("n")).toArrow().sort_by("n_tokens")
    if not histogram.num_rows:
        return sized.select("row.*", "n_tokens", *[F.lit(0).cast(t).alias(c) for c, t in zip(added[1:], ("int", "long", "long", "long"), strict=True)])
    lengths, n = histogram["n_tokens"].to_numpy(), histogram["n"].to_numpy()
    ends = boundaries(lengths, n, n_buckets)
    in_order = F.array(*[F.lit(x).cast("long") for x in ends])
    chunks = max(1, -(-int(n.sum()) // CHUNK_ROWS))
    placed = sized.withColumns({"bucket": F.size(F.filter(in_order, lambda e: e < F.col("n_tokens"))), "hash": F.xxhash64("key", "tie")}).withColumn("chunk", F.pmod("hash", F.lit(chunks)))
    counts = placed.groupBy("bucket", "chunk").agg(F.count("*").alias("n"))
    before = counts.select("bucket", "chunk", (F.sum("n").over(Window.partitionBy("bucket").orderBy("chunk")) - F.col("n")).alias("before"))
    ranked = placed.withColumn("rank", F.row_number().over(Window.partitionBy("bucket", "chunk").orderBy("hash", "key", "tie", "n_tokens")) - 1)
    rank = F.col("before") + F.col("rank")
    bucket_len = F.element_at(in_order, F.col("bucket") + 1)
    per = F.greatest(F.lit(1), F.floor(F.lit(budget) / F.greatest(F.lit(1), bucket_len))).cast("long")
    return ranked.join(before, ["bucket", "chunk"]).select(
        "row.*", "n_tokens", "bucket", bucket_len.alias("bucket_len"), F.floor(rank / per).alias("batch"), (rank % per).alias("slot")
    )
