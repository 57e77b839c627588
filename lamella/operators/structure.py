"""Operators on whole volumes: stacking, splitting, comparing."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..volume import FormatError, LabelVolume
from .neighbourhood import voxel_connectivity_graph
from .selection import z_slab


def zstack(volumes: Sequence[LabelVolume | None]) -> LabelVolume:
    """Volumes one above another along z; None is skipped. They have equal sx, sy; the widest type and the first order are taken."""
    given = [v for v in volumes if v is not None]
    if not given:
        raise ValueError("nothing to stack")
    if len({v.shape[:2] for v in given}) > 1:
        raise FormatError("sizes in x and y differ")
    at, voxels = 0, None
    for v in given:
        moved = v.voxels.withColumn("z", F.col("z") + at)
        voxels = moved if voxels is None else voxels.unionByName(moved)
        at += v.shape[2]
    return given[0].with_voxels(voxels, shape=(*given[0].shape[:2], at), width=max(v.width for v in given))


def zsplit(v: LabelVolume, z: int) -> tuple[LabelVolume, LabelVolume, LabelVolume]:
    """What is before slice z, the slice, and what is behind it; parts may be empty."""
    z += v.shape[2] if z < 0 else 0
    if not 0 <= z < v.shape[2]:
        raise IndexError(f"no slice {z}")
    return z_slab(v, 0, z), z_slab(v, z, z + 1), z_slab(v, z + 1, v.shape[2])


def zshatter(v: LabelVolume) -> DataFrame:
    """slice, x, y, z (0), label: every slice as a volume of its own, told apart by slice; one table, nothing is run for each of them."""
    return v.voxels.select(F.col("z").alias("slice"), "x", "y", F.lit(0).cast("long").alias("z"), "label")


def slices(v: LabelVolume) -> list[LabelVolume]:
    return [z_slab(v, z, z + 1) for z in range(v.shape[2])]


def slice_hashes(v: LabelVolume) -> DataFrame:
    """z, n, h1, h2: sums of hashes of the voxels, by slice."""
    h = lambda s: F.sum(F.xxhash64("x", "y", "label", F.lit(s)).cast("decimal(38,0)"))
    return v.voxels.groupBy("z").agg(F.count("*").alias("n"), h(0).alias("h1"), h(1).alias("h2"))


def differences(a: LabelVolume, b: LabelVolume) -> DataFrame:
    """x, y, z, label_a, label_b where the labels differ. Only slices whose hashes differ are joined voxel by voxel."""
    ha, hb = slice_hashes(a), slice_hashes(b)
    unequal = ha.join(hb.select("z", *[F.col(c).alias(f"_{c}") for c in ("n", "h1", "h2")]), "z", "full")
    same = F.col("n").eqNullSafe(F.col("_n")) & F.col("h1").eqNullSafe(F.col("_h1")) & F.col("h2").eqNullSafe(F.col("_h2"))
    unequal = unequal.where(~same).select("z")
    left = a.voxels.join(unequal, "z", "left_semi").withColumnRenamed("label", "label_a")
    right = b.voxels.join(unequal, "z", "left_semi").withColumnRenamed("label", "label_b")
    both = left.join(right, ["x", "y", "z"], "full")
    return both.where(~F.col("label_a").eqNullSafe(F.col("label_b"))).select("x", "y", "z", "label_a", "label_b")


def array_equal(a: LabelVolume, b: LabelVolume | int) -> bool:
    """Same shape and the same label at every voxel, whatever the type; of a number, whether all labels are that."""
    if not isinstance(b, LabelVolume):
        return a.voxels.where(F.col("label") != b).limit(1).count() == 0
    return a.shape == b.shape and differences(a, b).limit(1).count() == 0


def structure_equal(a: LabelVolume, b: LabelVolume) -> bool:
    """Same shape and the same boundaries inside of slices, whatever the labels."""
    if a.shape != b.shape:
        return False
    left, right = voxel_connectivity_graph(a, 4), voxel_connectivity_graph(b, 4).withColumnRenamed("vcg", "other")
    return left.join(right, ["x", "y", "z"], "full").where(~F.col("vcg").eqNullSafe(F.col("other"))).limit(1).count() == 0
