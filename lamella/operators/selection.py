"""Questions answered from the dictionary of labels, and selection of parts of a volume."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ranked
from ..volume import LabelError, LabelVolume, from_runs


def labels(v: LabelVolume) -> DataFrame:
    """label: each distinct label."""
    return v.rows.select("label").distinct()


def labels_for_z_range(v: LabelVolume, z0: int, z1: int) -> DataFrame:
    """Distinct labels in z0 <= z < z1."""
    return v.rows.where((F.col("z") >= z0) & (F.col("z") < z1)).select("label").distinct()


def num_labels(v: LabelVolume) -> DataFrame:
    return v.rows.agg(F.countDistinct("label").alias("num_labels"))


def contains(v: LabelVolume, wanted: Iterable[int]) -> DataFrame:
    """label, found for each of a list of labels."""
    asked = v.spark.createDataFrame([(int(x),) for x in wanted], "label long").distinct()
    there = v.rows.select("label").join(F.broadcast(asked), "label", "left_semi").distinct().withColumn("found", F.lit(True))  # asked is the caller's list
    return asked.join(there, "label", "left").select("label", F.coalesce("found", F.lit(False)).alias("found"))


def contains_range(v: LabelVolume, low: int, high: int) -> DataFrame:
    """Labels in low <= label < high."""
    return v.rows.where((F.col("label") >= low) & (F.col("label") < high)).select("label").distinct()


def min_max(v: LabelVolume) -> DataFrame:
    return v.rows.agg(F.min("label").alias("min_label"), F.max("label").alias("max_label"))


def z_range_for_label(v: LabelVolume, label: int) -> DataFrame:
    """z0, z1 with z0 <= z < z1 wherever the label is; -1, -1 if it is nowhere."""
    r = v.rows.where(F.col("label") == label).agg(F.min("z").alias("z0"), F.max("z").alias("z1"))
    return r.select(F.coalesce("z0", F.lit(-1).cast("long")).alias("z0"), F.coalesce(F.col("z1") + 1, F.lit(-1).cast("long")).alias("z1"))


def index_range(df: DataFrame, value: int, at: str = "idx", column: str = "value") -> DataFrame:
    """First and last index of a table at which value stands; -1 if nowhere."""
    r = df.where(F.col(column) == value).agg(F.min(at).alias("first"), F.max(at).alias("last"))
    return r.select(*[F.coalesce(c, F.lit(-1).cast("long")).alias(c) for c in ("first", "last")])


def binary_image(v: LabelVolume, label: int, crop: bool = False) -> DataFrame:
    """x, y, z, mask: where the label is. crop: only the slices from its first to its last."""
    out = v.voxels.select("x", "y", "z", (F.col("label") == label).alias("mask"))
    if crop:
        out = out.join(F.broadcast(z_range_for_label(v, label)), (F.col("z") >= F.col("z0")) & (F.col("z") < F.col("z1"))).drop("z0", "z1")  # one row
    return out


def z_slab(v: LabelVolume, z0: int, z1: int) -> LabelVolume:
    """Slices z0 <= z < z1 with z from 0; the filter reaches the scan."""
    z0, z1 = max(0, z0), min(v.shape[2], z1)
    slab = v.rows.where((F.col("z") >= z0) & (F.col("z") < z1)).withColumn("z", F.col("z") - z0)
    shape = (*v.shape[:2], max(0, z1 - z0))
    return v.with_voxels(slab, shape=shape) if v.stored_runs is None else from_runs(slab, shape, v.width, v.order)


def normalized(key, shape: tuple[int, int, int]) -> tuple[slice, ...]:
    """Index expression as one slice with non-negative ends and a positive step for each axis; integers become slices of one."""
    key = list(key) if isinstance(key, tuple) else [key]
    if Ellipsis in key:
        i = key.index(Ellipsis)
        key[i : i + 1] = [slice(None)] * (3 - len(key) + 1)
    key += [slice(None)] * (3 - len(key))
    if len(key) != 3:
        raise IndexError("too many indices")
    out = []
    for k, n in zip(key, shape, strict=True):
        if isinstance(k, slice):
            if k.step is not None and k.step <= 0:
                raise IndexError("steps are positive")
            out.append(slice(*k.indices(n)))
        else:
            i = int(k) + (n if k < 0 else 0)
            if not 0 <= i < n:
                raise IndexError(f"index {k} outside of {n}")
            out.append(slice(i, i + 1, 1))
    return tuple(out)


def cutout(v: LabelVolume, key) -> LabelVolume:
    """v[xs, ys, zs] with integers, slices, Ellipsis and negative indices; coordinates of the result start at 0."""
    voxels, shape = v.voxels, []
    for axis, s in zip("xyz", normalized(key, v.shape), strict=True):
        c = F.col(axis)
        voxels = voxels.where((c >= s.start) & (c < s.stop) & ((c - s.start) % s.step == 0))
        shape.append(len(range(s.start, s.stop, s.step)))
    for axis, s in zip("xyz", normalized(key, v.shape), strict=True):
        voxels = voxels.withColumn(axis, F.expr(f"({axis} - {s.start}) div {s.step}"))
    return v.with_voxels(voxels, shape=tuple(shape))


def assign(v: LabelVolume, key, data: LabelVolume | int) -> LabelVolume:
    """v with v[xs, ys, zs] = data."""
    slices = normalized(key, v.shape)
    if not isinstance(data, LabelVolume):
        inside = F.lit(True)
        for axis, s in zip("xyz", slices, strict=True):
            c = F.col(axis)
            inside = inside & (c >= s.start) & (c < s.stop) & ((c - s.start) % s.step == 0)
        return v.with_label(F.when(inside, F.lit(int(data))).otherwise(F.col("label")))
    shape = tuple(len(range(s.start, s.stop, s.step)) for s in slices)
    if shape != data.shape:
        raise ValueError(f"{data.shape} does not fit {shape}")
    moved = data.voxels
    for axis, s in zip("xyz", slices, strict=True):
        moved = moved.withColumn(axis, F.col(axis) * s.step + s.start)
    patched = v.voxels.join(moved.withColumnRenamed("label", "new"), ["x", "y", "z"], "left").withColumn("label", F.coalesce("new", "label"))
    return v.with_voxels(patched, width=max(v.width, data.width))


def each(v: LabelVolume, wanted: Iterable[int] | None = None, crop: bool = True) -> DataFrame:
    """segment, x, y, z: the voxels of each label, from the corner of its bounding box if crop. Labels that are not there are left out."""
    voxels = v.voxels
    if wanted is not None:
        asked = v.spark.createDataFrame([(int(x),) for x in wanted], "label long")
        voxels = voxels.join(F.broadcast(asked), "label", "left_semi")  # the caller's list
    if not crop:
        return voxels.select(F.col("label").alias("segment"), "x", "y", "z")
    corner = voxels.groupBy("label").agg(*[F.min(c).alias(f"_{c}") for c in "xyz"])
    return voxels.join(corner, "label").select(F.col("label").alias("segment"), *[(F.col(c) - F.col(f"_{c}")).alias(c) for c in "xyz"])


def each_multi(v: LabelVolume, batch: int = 255) -> DataFrame:
    """batch, temp, label: labels in ascending order in batches, renumbered from 1 in each. Joined to the voxels it gives one image for each batch."""
    out = ranked(labels(v), "label")
    return out.select(F.expr(f"rank div {batch}").alias("batch"), (F.col("rank") % batch + 1).alias("temp"), "label")


def require(v: LabelVolume, label: int) -> None:
    if v.rows.where(F.col("label") == label).limit(1).count() == 0:
        raise LabelError(f"label {label} is not in the volume")

