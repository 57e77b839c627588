"""Connected components of equal labels, in slices and in three dimensions.

Rows are cut into runs of one label. Inside a slice, runs that touch are united
in NumPy, slice by slice. Across slices, the components of neighbouring slices
that touch are the edges of a much smaller graph, whose components are found by
alternating star steps on tables.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ranked, stored
from ..volume import LabelVolume, from_runs
from .aggregates import runs


def united(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest member of the component of each of n nodes with edges a-b."""
    root = np.arange(n)
    while len(a):
        low = np.minimum(root[a], root[b])
        before = root.copy()
        for side in (a, b):
            np.minimum.at(root, root[side], low)
        while True:  # pointer jumping
            up = root[root]
            if (up == root).all():
                break
            root = up
        if (root == before).all():
            break
        keep = root[a] != root[b]
        a, b = a[keep], b[keep]
    return root


def touching(row: np.ndarray, x0: np.ndarray, x1: np.ndarray, reach: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of runs in neighbouring rows whose columns overlap, or are at most reach apart. Runs are sorted by row and x0."""
    if not len(row):
        return row, row
    wide = int(x1.max()) + 2 * reach + 3
    starts, ends = row * wide + x0, row * wide + x1
    first = np.searchsorted(ends, (row - 1) * wide + x0 - reach, "left")
    last = np.searchsorted(starts, (row - 1) * wide + x1 + reach, "right")
    n = np.maximum(0, last - first)
    mine = np.repeat(np.arange(len(row)), n)
    other = np.repeat(first - (np.cumsum(n) - n), n) + np.arange(n.sum())
    ok = row[other] == row[mine] - 1
    return mine[ok], other[ok]


def numbered(pdf: pd.DataFrame, reach: int) -> pd.DataFrame:
    """Runs of one slice with ccid: components numbered from 0 in the order of their first voxel in a raster."""
    pdf = pdf.sort_values(["y", "x0"], kind="stable")
    a, b = touching(pdf.y.to_numpy(), pdf.x0.to_numpy(), pdf.x1.to_numpy(), reach)
    label = pdf.label.to_numpy()
    same = label[a] == label[b]
    root = united(len(pdf), a[same], b[same])
    return pdf.assign(ccid=np.unique(root, return_inverse=True)[1].astype(np.int64))  # the first run of a component is its root


RUN = "z long, y long, x0 long, x1 long, label long, ccid long"


def slice_runs(v: LabelVolume, reach: int = 0) -> DataFrame:
    """Runs with ccid, the number of their component in the slice: 4-connected, or 8-connected with reach 1. Label 0 is a label like others."""
    return runs(v).groupBy("z").applyInPandas(lambda pdf: numbered(pdf, reach), RUN)


def voxels_of(r: DataFrame, *columns: str) -> DataFrame:
    return r.select(F.explode(F.sequence("x0", "x1")).alias("x"), "y", "z", *columns)


def slice_components(v: LabelVolume) -> DataFrame:
    """x, y, z, ccid."""
    return voxels_of(slice_runs(v), "ccid")


def component_table(v: LabelVolume) -> DataFrame:
    """z, ccid, label, voxel_count, first_idx (the smallest y * sx + x)."""
    r = slice_runs(v)
    return r.groupBy("z", "ccid").agg(F.first("label").alias("label"), F.sum(F.col("x1") - F.col("x0") + 1).alias("voxel_count"), F.min(F.col("y") * v.shape[0] + F.col("x0")).alias("first_idx"))


def component_counts(v: LabelVolume) -> DataFrame:
    """z, components."""
    return slice_runs(v).groupBy("z").agg((F.max("ccid") + 1).alias("components"))


def layer_components(v: LabelVolume) -> DataFrame:
    """x, y, z, cc: components of slices numbered on from slice to slice."""
    r = stored(slice_runs(v), "runs")
    counts = sorted(r.groupBy("z").agg((F.max("ccid") + 1).alias("n")).collect())  # one row for each slice
    starts, at = [], 0
    for z, n in counts:
        starts.append((z, at))
        at += n
    starts = v.spark.createDataFrame(starts, "z long, start long")
    return voxels_of(r.join(F.broadcast(starts), "z").withColumn("cc", F.col("ccid") + F.col("start")), "cc")


def graph_components(graph: DataFrame) -> DataFrame:
    """x, y, z, ccid of a connectivity graph (x, y, z, vcg): bits +x 1 and +y 4 say which voxels are joined in their slice."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["y", "x"], kind="stable")
        wide = int(pdf.x.max()) + 1
        at = (pdf.y * wide + pdf.x).to_numpy()
        bits, x = pdf.vcg.to_numpy(), pdf.x.to_numpy()
        right = np.flatnonzero((bits & 1 > 0) & (x < wide - 1))
        down = np.flatnonzero((bits & 4 > 0) & (at + wide <= at.max()))
        a, b = np.concatenate([right, down]), np.searchsorted(at, np.concatenate([at[right] + 1, at[down] + wide]))
        return pdf[["x", "y", "z"]].assign(ccid=np.unique(united(len(pdf), a, b), return_inverse=True)[1].astype(np.int64))

    return graph.groupBy("z").applyInPandas(one, "x long, y long, z long, ccid long")


#: Edges up to so many (16 bytes each) are united in one task; more by steps on tables.
ONE_TASK_EDGES = 2_000_000


def united_table(edges: DataFrame) -> DataFrame:
    def one(batches):
        found = [b for b in batches if len(b)]
        if found:
            u, v = (np.concatenate([b[c].to_numpy() for b in found]) for c in ("u", "v"))
            ids, at = np.unique(np.concatenate([u, v]), return_inverse=True)
            root = united(len(ids), at[: len(u)], at[len(u) :])
            other = root != np.arange(len(ids))
            yield pd.DataFrame({"id": ids[other], "root": ids[root[other]]})

    return edges.repartition(1).mapInPandas(one, "id long, root long")


def star_components(edges: DataFrame, one_task: int = ONE_TASK_EDGES) -> DataFrame:
    """id, root: the smallest id connected by edges (a, b), for all ids but the roots.

    Up to one_task edges are united in one task; more by alternating large-star and small-star steps, each round of which is stored; their number
    grows with the logarithm of the longest path.
    """
    edges = stored(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges")
    if edges.limit(one_task + 1).count() <= one_task:
        return united_table(edges)
    last = None
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        new = large.join(low, "u").select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        edges = stored(new, "edges")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == last:
            return edges.select(F.col("u").alias("id"), F.col("v").alias("root"))
        last = now


#: Columns of a cell in which runs of neighbouring slices meet.
CELL = 256


def connected_components(v: LabelVolume, connectivity: int = 26, binary_image: bool = False) -> tuple[LabelVolume, DataFrame]:
    """Components of equal labels other than 0, numbered from 1 in the order of their first voxel (z, y, x), and a table cc, label.

    binary_image: all labels other than 0 count as one.
    """
    if connectivity not in (6, 26):
        raise ValueError("connectivity is 6 or 26")
    reach = int(connectivity == 26)
    given = v.relabelled(lambda rows: rows.withColumn("label", F.when(F.col("label") != 0, F.lit(1)).otherwise(F.lit(0)).cast("long"))) if binary_image else v
    sx, sy, _ = v.shape
    found = stored(slice_runs(given, reach), "runs")
    r = found.where("label <> 0")
    # A component of a slice is named by its first voxel; its runs are few beside its voxels.
    idx = (F.col("z") * sy + F.col("y")) * sx + F.col("x0")
    first = r.groupBy("z", "ccid").agg(F.min(idx).alias("id"))
    r = stored(r.join(first, ["z", "ccid"]).select("z", "y", "x0", "x1", "label", "id"), "runs")
    # Runs of a slice against those of the slice before: same label, same row or the rows beside it, overlapping columns. They meet in the cells of
    # CELL columns that they cover, so a row of many short runs is not paired with itself as a whole.
    cells = lambda wider: F.explode(F.sequence(F.floor((F.col("x0") - wider) / CELL), F.floor((F.col("x1") + wider) / CELL))).alias("cell")
    here = r.select("z", "y", "label", "x0", "x1", F.col("id").alias("b"), cells(0))
    below = r.select((F.col("z") + 1).alias("z"), "y", "label", F.col("x0").alias("p0"), F.col("x1").alias("p1"), F.col("id").alias("a"), cells(reach))
    below = below.withColumn("y", F.explode(F.array(*[F.col("y") + d for d in range(-reach, reach + 1)])))
    edges = here.join(below, ["z", "y", "label", "cell"]).where((F.col("x0") <= F.col("p1") + reach) & (F.col("p0") <= F.col("x1") + reach)).select("a", "b").distinct()
    roots = star_components(edges)
    whole = r.join(roots, "id", "left").withColumn("root", F.coalesce("root", "id"))
    ids = ranked(whole.groupBy("root").agg(F.first("label").alias("l")), "root", "cc").select("root", (F.col("cc") + 1).alias("cc"), "l")
    # Runs of components and those of label 0 are all there is: nothing goes back to the voxels.
    numbered_ = whole.join(ids, "root").select("z", "y", "x0", "x1", F.col("cc").alias("label"))
    rest = found.where("label = 0").select("z", "y", "x0", "x1", F.lit(0).cast("long").alias("label"))
    return from_runs(numbered_.unionByName(rest), v.shape, 8, v.order), ids.select("cc", F.col("l").alias("label"))
