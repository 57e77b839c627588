"""Aggregates by label. All are partial aggregates before one shuffle on the label, over runs where the volume has them."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import stored
from ..volume import LabelVolume, from_runs
from .selection import require


def length() -> Column:
    """Voxels of a run."""
    return F.col("x1") - F.col("x0") + 1


def of(v: LabelVolume, label: int | None) -> DataFrame:
    if label is None:
        return v.lines
    require(v, label)
    return v.lines.where(F.col("label") == label)


def voxel_counts(v: LabelVolume, label: int | None = None) -> DataFrame:
    """label, voxel_count. A single label that is not there is an error."""
    return of(v, label).groupBy("label").agg(F.sum(length()).alias("voxel_count"))


def centroids(v: LabelVolume, label: int | None = None) -> DataFrame:
    """label, cx, cy, cz: mean coordinates; sums are integers up to the one division."""
    return centroids_of(of(v, label)).drop("voxel_count")


def centroids_of(lines: DataFrame) -> DataFrame:
    mean = lambda c: (F.sum(F.col(c) * length()).cast("double") / F.sum(length())).alias(f"c{c}")
    return lines.groupBy("label").agg(F.sum(length()).alias("voxel_count"), (F.sum((F.col("x0") + F.col("x1")) * length()).cast("double") / 2 / F.sum(length())).alias("cx"), mean("y"), mean("z"))


def ends(axes: str, above: int = 0) -> list[Column]:
    low = [F.min("x0" if c == "x" else c).alias(f"min_{c}") for c in axes]
    return low + [(F.max("x1" if c == "x" else c) + above).alias(f"max_{c}") for c in axes]


def bounding_boxes(v: LabelVolume, label: int | None = None, half_open: bool = False) -> DataFrame:
    """label, min_x .. max_z: inclusive boxes; half_open: one more at the upper ends, as for slices."""
    return of(v, label).groupBy("label").agg(*ends("xyz", int(half_open)))


def label_stats(v: LabelVolume) -> DataFrame:
    """The sidecar table: voxel_count and inclusive box of each label; z columns only for more than one slice."""
    return v.lines.groupBy("label").agg(F.sum(length()).alias("voxel_count"), *ends("xyz" if v.shape[2] > 1 else "xy"))


def smallest_width(value: Column) -> Column:
    return F.when(value < 2**8, 1).when(value < 2**16, 2).when(value < 2**32, 4).otherwise(8)


def stored_width(v: LabelVolume) -> DataFrame:
    """max_label and the fewest bytes that hold it."""
    return v.rows.agg(F.max("label").alias("max_label")).select("max_label", smallest_width(F.col("max_label")).alias("width"))


def pixel_pairs(v: LabelVolume) -> DataFrame:
    """Voxels equal to the one before them in linear order (x fastest, then y, z).

    Neighbours in a row meet in a window over the row; the first voxel of a row meets the last of the row before by its row number, so no
    window is over the whole volume.
    """
    sx, sy = v.shape[0], v.shape[1]
    row = F.col("z") * sy + F.col("y")
    if v.stored_runs is not None:
        v = as_runs(v)
        inside = v.stored_runs.agg(F.coalesce(F.sum(F.col("x1") - F.col("x0")), F.lit(0)).alias("n"))
    else:
        line = Window.partitionBy("z", "y").orderBy("x")
        inside = v.voxels.select((F.col("label") == F.lag("label").over(line)).cast("long").alias("same")).agg(F.coalesce(F.sum("same"), F.lit(0)).alias("n"))
    last = v.lines.where(F.col("x1") == sx - 1).select((row + 1).alias("row"), "label")
    first = v.lines.where(F.col("x0") == 0).select(row.alias("row"), "label")
    across = first.join(last, ["row", "label"]).agg(F.count("*").alias("n"))
    return inside.union(across).agg(F.sum("n").cast("long").alias("pairs"))


def runs(v: LabelVolume) -> DataFrame:
    """z, y, x0, x1 (inclusive), label: maximal runs of one label in the rows. Stored runs are only joined where relabelling made neighbours equal."""
    line = Window.partitionBy("z", "y").orderBy("x0")
    starts = v.lines.withColumn("s", F.coalesce((F.lag("label").over(line) != F.col("label")).cast("int"), F.lit(1)))
    grouped = starts.withColumn("g", F.sum("s").over(line.rowsBetween(Window.unboundedPreceding, 0)))
    return grouped.groupBy("z", "y", "g").agg(F.min("x0").alias("x0"), F.max("x1").alias("x1"), F.first("label").alias("label")).select("z", "y", "x0", "x1", "label")


def as_runs(v: LabelVolume) -> LabelVolume:
    """v with its maximal runs written to the shared folder: what follows reads these."""
    made = from_runs(stored(runs(v), "runs"), v.shape)
    return replace(v, voxels=made.voxels, stored_runs=made.stored_runs)


def counts_of_runs(r: DataFrame) -> DataFrame:
    """label, voxel_count, cx, cy, cz of a table of runs."""
    return centroids_of(r)


def z_columns(v: LabelVolume) -> DataFrame:
    """x, y, z0, depth, label: maximal vertical runs of one label, the candidates for pins."""
    line = Window.partitionBy("x", "y").orderBy("z")
    starts = v.voxels.withColumn("s", F.coalesce((F.lag("label").over(line) != F.col("label")).cast("int"), F.lit(1)))
    grouped = starts.withColumn("g", F.sum("s").over(line.rowsBetween(Window.unboundedPreceding, 0)))
    return grouped.groupBy("x", "y", "g").agg(F.min("z").alias("z0"), (F.max("z") - F.min("z")).alias("depth"), F.first("label").alias("label")).select("x", "y", "z0", "depth", "label")
