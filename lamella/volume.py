"""Label volumes: dense 3D integer images in which each voxel has a segment id."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

VOXEL = T.StructType([T.StructField(c, T.LongType(), False) for c in ("x", "y", "z", "label")])
WIDTHS = (1, 2, 4, 8)


class LabelError(ValueError):
    """A label that is asked for is not there."""


class FormatError(ValueError):
    """Input that is no label volume."""


@dataclass(frozen=True, eq=False)
class LabelVolume:
    """A lazy table of voxels (x, y, z, label) with the volume's shape. Every (x, y, z) inside the shape has exactly one row.

    width: bytes of the rendered label type. order: element order of exported arrays, F or C; no operator depends on it.
    stored_runs: the same content as runs (z, y, x0, x1, label), if the volume is made of them: not overlapping, and all of each row. Questions about
    labels, relabelling, aggregates and components read these instead of voxels.
    """

    voxels: DataFrame
    shape: tuple[int, int, int]
    width: int = 8
    order: str = "F"
    stored_runs: DataFrame | None = None

    @property
    def rows(self) -> DataFrame:
        """Runs if there are some, else voxels: each with columns y, z, label."""
        return self.voxels if self.stored_runs is None else self.stored_runs

    @property
    def lines(self) -> DataFrame:
        """z, y, x0, x1, label: the runs, or each voxel as a run of one."""
        return self.voxels.select("z", "y", F.col("x").alias("x0"), F.col("x").alias("x1"), "label") if self.stored_runs is None else self.stored_runs

    @property
    def spark(self) -> SparkSession:
        return self.voxels.sparkSession

    @property
    def size(self) -> int:
        return self.shape[0] * self.shape[1] * self.shape[2]

    @property
    def nbytes(self) -> int:
        return self.size * self.width

    ndim = 3

    @property
    def dtype(self) -> np.dtype:
        return np.dtype(f"u{self.width}")

    def __len__(self) -> int:
        return self.shape[0]

    def with_voxels(self, voxels: DataFrame, **changes) -> LabelVolume:
        return replace(self, voxels=voxels.select("x", "y", "z", "label"), stored_runs=None, **changes)

    def relabelled(self, change: Callable[[DataFrame], DataFrame], **changes) -> LabelVolume:
        """The volume with change applied to its rows: something that replaces the column label and reads no coordinates."""
        if self.stored_runs is None:
            return self.with_voxels(change(self.voxels), **changes)
        new = from_runs(change(self.stored_runs), self.shape)
        return replace(self, voxels=new.voxels, stored_runs=new.stored_runs, **changes)

    def with_label(self, label: Column, **changes) -> LabelVolume:
        return self.with_voxels(self.voxels.withColumn("label", label.cast("long")), **changes)

    def meta(self) -> DataFrame:
        """One row of metadata."""
        row = (*self.shape, self.width, self.size, self.nbytes, self.order == "F")
        return self.spark.createDataFrame([row], "sx int, sy int, sz int, data_width int, size long, nbytes long, fortran_order boolean")

    # ---- operators of the module relabel, selection and structure in their short form

    def __getitem__(self, key) -> LabelVolume:
        return selection.cutout(self, key)

    def __contains__(self, label: int) -> bool:
        return selection.contains(self, [label]).first()["found"]

    def __eq__(self, other) -> bool:
        return structure.array_equal(self, other)

    __hash__ = object.__hash__

    def __add__(self, k: int) -> LabelVolume:
        return relabel.add_scalar(self, k)

    __radd__ = __add__

    def __mul__(self, k: int) -> LabelVolume:
        return relabel.multiply_scalar(self, k)

    __rmul__ = __mul__

    def __sub__(self, k: int) -> LabelVolume:
        return relabel.subtract_scalar(self, k)

    def __rsub__(self, k: int) -> LabelVolume:
        return relabel.operator(self, lambda c: F.lit(k) - c)

    def __floordiv__(self, k: int) -> LabelVolume:
        return relabel.floordiv_scalar(self, k)

    def __rfloordiv__(self, k: int) -> LabelVolume:
        return relabel.operator(self, lambda c: F.call_function("div", F.lit(k), c))

    def copy(self) -> LabelVolume:
        return replace(self)

    # ---- arrays

    @staticmethod
    def from_numpy(spark: SparkSession, array: np.ndarray, order: str | None = None) -> LabelVolume:
        """A volume of a 1D to 3D array of unsigned integers; signed, float and larger values than 2 ** 63 - 1 are rejected."""
        if array.dtype == bool:
            array = array.astype(np.uint8)
        if array.dtype.kind != "u":
            raise TypeError(f"labels are unsigned integers, not {array.dtype}")
        while array.ndim < 3:
            array = array[..., None]
        if array.ndim != 3:
            raise FormatError(f"{array.ndim} dimensions")
        if array.size and int(array.max()) >= 2**63:
            raise FormatError("a label is 2 ** 63 or more")
        x, y, z = np.indices(array.shape).reshape(3, -1)
        import pandas as pd

        frame = pd.DataFrame({"x": x, "y": y, "z": z, "label": array.reshape(-1).astype(np.int64)})
        voxels = spark.createDataFrame(frame, VOXEL) if len(frame) else spark.createDataFrame([], VOXEL)
        return LabelVolume(voxels, tuple(array.shape), array.dtype.itemsize, order or ("F" if np.isfortran(array) else "C"))

    def to_numpy(self) -> np.ndarray:
        """The whole volume on the driver."""
        out = np.zeros(self.shape, self.dtype, order=self.order)
        rows = self.voxels.toPandas()
        out[rows.x, rows.y, rows.z] = rows.label.to_numpy().astype(self.dtype)
        return out


def from_table(df: DataFrame, shape: tuple[int, int, int] | None = None, width: int = 8) -> LabelVolume:
    """A volume of a table with columns x, y, z, label; without a shape, it is the largest coordinates plus one."""
    voxels = df.select(*[F.col(c).cast("long").alias(c) for c in ("x", "y", "z", "label")])
    if shape is None:
        top = voxels.agg(F.max("x"), F.max("y"), F.max("z")).first()
        shape = tuple((v if v is not None else -1) + 1 for v in top)
    return LabelVolume(voxels, shape, width)


RUN = ("z", "y", "x0", "x1", "label")


def from_runs(df: DataFrame, shape: tuple[int, int, int], width: int = 8, order: str = "F") -> LabelVolume:
    """A volume of a table of runs z, y, x0, x1 (inclusive), label that do not overlap and cover all of the shape."""
    r = df.select(*[F.col(c).cast("long").alias(c) for c in RUN])
    voxels = r.select(F.explode(F.sequence("x0", "x1")).alias("x"), "y", "z", "label")
    return LabelVolume(voxels, tuple(shape), width, order, r)


def full(spark: SparkSession, shape: tuple[int, int, int], value: int = 0, width: int = 8, order: str = "C") -> LabelVolume:
    """A volume of one label, made on the executors."""
    sx, sy, sz = shape
    i = F.col("id")
    voxels = spark.range(sx * sy * sz).select((i % max(1, sx)).alias("x"), F.expr(f"id div {max(1, sx)} % {max(1, sy)}").alias("y"), F.expr(f"id div {max(1, sx * sy)}").alias("z"), F.lit(value).cast("long").alias("label"))
    return LabelVolume(voxels, tuple(shape), width, order)


def zeros(spark: SparkSession, shape: tuple[int, int, int], width: int = 8, order: str = "C") -> LabelVolume:
    return full(spark, shape, 0, width, order)


def ones(spark: SparkSession, shape: tuple[int, int, int], width: int = 8, order: str = "C") -> LabelVolume:
    return full(spark, shape, 1, width, order)


from .operators import relabel, selection, structure  # noqa: E402  they need LabelVolume
