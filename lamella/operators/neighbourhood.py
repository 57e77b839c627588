"""Operators on neighbouring voxels.

Voxels are dealt out in cubes of TILE voxels; those at a face are also sent to
the cube beyond it. Each cube then sees all neighbours of its own voxels, so one
shuffle serves the windows along all axes, and its copies are a few per cent.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..volume import LabelError, LabelVolume

TILE = 64


def tiled(v: LabelVolume, axes: str, back: bool = True, ahead: bool = True) -> DataFrame:
    """Voxels with tile coordinates tx, ty, tz and own: whether the voxel belongs to the tile or is a copy for its neighbours along axes."""
    out = v.voxels
    own = F.lit(True)
    for a in "xyz":
        tile = F.expr(f"{a} div {TILE}")
        if a in axes:
            near = [tile]
            if back:
                near.append(F.when(F.col(a) % TILE == TILE - 1, tile + 1))  # seen from the next tile
            if ahead:
                near.append(F.when((F.col(a) % TILE == 0) & (F.col(a) > 0), tile - 1))
            out = out.withColumn(f"t{a}", F.explode(F.array_compact(F.array(*near))))
        else:
            out = out.withColumn(f"t{a}", tile)
        own = own & (F.col(f"t{a}") == tile)
    return out.withColumn("own", own).repartition("tx", "ty", "tz")


def line(a: str):
    return Window.partitionBy("tx", "ty", "tz", *[c for c in "xyz" if c != a]).orderBy(a)


def beside(column: str, a: str, by: int):
    """The value of column in the voxel by steps away along a, or null outside of the volume or the tile's surroundings."""
    w = line(a)
    value, at = (F.lead(column, by).over(w), F.lead(a, by).over(w)) if by > 0 else (F.lag(column, -by).over(w), F.lag(a, -by).over(w))
    return F.when(at == F.col(a) + by, value)


def contacts(v: LabelVolume, anisotropy: tuple[float, float, float] = (1.0, 1.0, 1.0)) -> DataFrame:
    """label_a < label_b with faces along each axis (fx, fy, fz) and area: shared faces of the 6-neighbourhood; label 0 has no contacts."""
    wx, wy, wz = map(float, anisotropy)
    near = tiled(v, "xyz", back=False).withColumns({f"n{a}": beside("label", a, 1) for a in "xyz"}).where("own and label <> 0")
    pairs = near.select("label", F.explode(F.array(*[F.struct(F.lit(i).alias("axis"), F.col(f"n{a}").alias("other")) for i, a in enumerate("xyz")])).alias("n"))
    pairs = pairs.where("n.other <> 0 and n.other <> label").select(F.least("label", "n.other").alias("label_a"), F.greatest("label", "n.other").alias("label_b"), "n.axis")
    faces = pairs.groupBy("label_a", "label_b").agg(*[F.sum((F.col("axis") == i).cast("long")).alias(f"f{a}") for i, a in enumerate("xyz")])
    return faces.withColumn("area", F.col("fx") * (wy * wz) + F.col("fy") * (wx * wz) + F.col("fz") * (wx * wy))


def voxel_connectivity_graph(v: LabelVolume, connectivity: int = 6) -> DataFrame:
    """x, y, z, vcg: bits +x 1, -x 2, +y 4, -y 8, +z 16, -z 32 where the neighbour has the same label or is outside. 4: x and y only."""
    if connectivity not in (4, 6):
        raise ValueError("connectivity is 4 or 6")
    axes = "xyz" if connectivity == 6 else "xy"
    bits = F.lit(0).cast("long")
    for i, a in enumerate(axes):
        for j, by in enumerate((1, -1)):
            same = F.coalesce(beside("label", a, by) == F.col("label"), F.lit(True))
            bits = bits.bitwiseOR(F.when(same, F.lit(1 << (2 * i + j))).otherwise(F.lit(0)).cast("long"))
    return tiled(v, axes).withColumn("vcg", bits).where("own").select("x", "y", "z", "vcg")


def mode_pooling(v: LabelVolume) -> LabelVolume:
    """Half the size in x and y. Of a tile a b / c d: a if a = b or a = c, b if b = c, else d; at odd ends the even voxel itself."""
    half = lambda c: F.expr(f"{c} div 2")
    pick = lambda i, j: F.max(F.when((F.col("x") % 2 == i) & (F.col("y") % 2 == j), F.col("label")))
    tiles = v.voxels.groupBy(half("x").alias("x2"), half("y").alias("y2"), "z").agg(pick(0, 0).alias("a"), pick(1, 0).alias("b"), pick(0, 1).alias("c"), pick(1, 1).alias("d"))
    label = F.expr("case when b is null or c is null then a when a = b or a = c then a when b = c then b else d end")
    sx, sy, sz = v.shape
    return v.with_voxels(tiles.select(F.col("x2").alias("x"), F.col("y2").alias("y"), "z", label.alias("label")), shape=((sx + 1) // 2, (sy + 1) // 2, sz))


def point_cloud(v: LabelVolume, label: int | Sequence[int] | None = None, z_start: int = 0, z_end: int | None = None, skip_background: bool = True) -> DataFrame:
    """label, x, y, z: voxels with a neighbour in the same slice (8 of them) that is outside of the volume or has another label.

    Of the slices z_start <= z < z_end, and of one label or a list of labels, each of which must be there.
    """
    wanted = None if label is None else [label] if isinstance(label, int) else list(label)
    if z_start or z_end is not None:
        slab = v.voxels.where((F.col("z") >= z_start) & (F.col("z") < (v.shape[2] if z_end is None else z_end)))
        v = v.with_voxels(slab)
    # A voxel whose row neighbours have its label is flat; it is inner if it and the voxels above and below it are flat, of one label.
    flat = (beside("label", "x", 1) == F.col("label")) & (beside("label", "x", -1) == F.col("label"))
    t = tiled(v, "xy").withColumn("flat", F.when(F.coalesce(flat, F.lit(False)), F.col("label")))
    inner = (F.col("flat") == F.col("label")) & (beside("flat", "y", 1) == F.col("label")) & (beside("flat", "y", -1) == F.col("label"))
    out = t.withColumn("inner", F.coalesce(inner, F.lit(False))).where("own and not inner")
    if wanted is not None:
        there = {r[0] for r in v.rows.where(F.col("label").isin(*wanted)).select("label").distinct().collect()} if wanted else set()  # of the caller's list
        for x in wanted:
            if x not in there:
                raise LabelError(f"label {x} is not in the volume")
        out = out.where(F.col("label").isin(*wanted))
    elif skip_background:
        out = out.where("label <> 0")
    return out.select("label", "x", "y", "z")
