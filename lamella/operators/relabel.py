"""Operators on labels. They act on the dictionary of labels where that is smaller than the voxels, and never on positions."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping
from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import ranked
from ..volume import WIDTHS, LabelError, LabelVolume
from .selection import labels

#: Mappings given as tables are broadcast up to so many rows.
BROADCAST_ROWS = 1_000_000


def table_of(v: LabelVolume, mapping: Mapping[int, int] | DataFrame) -> DataFrame:
    if isinstance(mapping, DataFrame):
        return mapping.select(F.col(mapping.columns[0]).cast("long").alias("label"), F.col(mapping.columns[1]).cast("long").alias("new_label"))
    return v.spark.createDataFrame([(int(a), int(b)) for a, b in mapping.items()], "label long, new_label long")


def small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def width_for(largest: int) -> int:
    return next(w for w in WIDTHS if largest < 1 << (8 * w))


def remap(v: LabelVolume, mapping: Mapping[int, int] | DataFrame, preserve_missing_labels: bool = False) -> LabelVolume:
    """Each label replaced by its new one. Labels without one stay if preserve_missing_labels, else they are an error. The type grows if it must."""
    new = table_of(v, mapping)
    if not preserve_missing_labels:
        missing = labels(v).join(new, "label", "left_anti").limit(1).collect()
        if missing:
            raise LabelError(f"label {missing[0][0]} has no new label")
    top = new.agg(F.max("new_label"), F.min("new_label")).first()
    if top[1] is not None and top[1] < 0:
        raise ValueError("labels are not negative")
    new = small(new)
    return v.relabelled(lambda rows: rows.join(new, "label", "left").withColumn("label", F.coalesce("new_label", "label")), width=max(v.width, width_for(top[0] or 0)))


def mask(v: LabelVolume, wanted: Iterable[int], value: int = 0) -> LabelVolume:
    """The listed labels replaced by value."""
    return replace_if(v, wanted, value, listed=True)


def mask_except(v: LabelVolume, wanted: Iterable[int], value: int = 0) -> LabelVolume:
    """All labels but the listed ones replaced by value."""
    return replace_if(v, wanted, value, listed=False)


def replace_if(v: LabelVolume, wanted: Iterable[int], value: int, listed: bool) -> LabelVolume:
    asked = v.spark.createDataFrame([(int(x), True) for x in set(wanted)], "label long, listed boolean")
    there = F.coalesce("listed", F.lit(False))
    hit = there if listed else ~there
    asked = small(asked)
    return v.relabelled(lambda rows: rows.join(asked, "label", "left").withColumn("label", F.when(hit, F.lit(int(value))).otherwise(F.col("label"))), width=max(v.width, width_for(value)))


def renumbering(v: LabelVolume, start: int = 0) -> DataFrame:
    """label, new_label: the labels in ascending order numbered from start."""
    return ranked(labels(v), "label", "new_label").withColumn("new_label", F.col("new_label") + start)


def renumber(v: LabelVolume, start: int = 0) -> tuple[LabelVolume, DataFrame]:
    """Labels renumbered in ascending order from start, in the smallest type that holds them, and the mapping."""
    mapping = renumbering(v, start)
    out = v.relabelled(lambda rows: rows.join(mapping, "label").withColumn("label", F.col("new_label")))
    return replace(out, width=width_for(start + max(0, mapping.count() - 1))), mapping


def refit(v: LabelVolume) -> LabelVolume:
    """The same labels in the smallest type that holds them."""
    return replace(v, width=width_for(v.rows.agg(F.max("label")).first()[0] or 0))


def astype(v: LabelVolume, width: int, casting: str = "unsafe", signed: bool = False) -> LabelVolume:
    """Labels in another type; narrowing wraps and needs casting unsafe or same_kind. Signed types are rejected."""
    if signed:
        raise TypeError("labels are unsigned integers")
    if width not in WIDTHS:
        raise TypeError(f"no type of {width} bytes")
    if casting in ("no", "equiv") and width != v.width or casting == "safe" and width < v.width:
        raise TypeError(f"{casting} does not allow {v.width} bytes to become {width}")
    if casting not in ("no", "equiv", "safe", "same_kind", "unsafe"):
        raise ValueError(f"unknown casting {casting}")
    if width < v.width and width < 8:
        v = v.relabelled(lambda rows: rows.withColumn("label", F.col("label").bitwiseAND(F.lit((1 << (8 * width)) - 1))))
    return replace(v, width=width)


def asfortranarray(v: LabelVolume) -> LabelVolume:
    return replace(v, order="F")


def ascontiguousarray(v: LabelVolume) -> LabelVolume:
    return replace(v, order="C")


def operator(v: LabelVolume, function: Callable[[Column], Column]) -> LabelVolume:
    """Any expression of the label, evaluated by the engine; a negative result is an error when it is met."""
    new = function(F.col("label")).cast("long")
    checked = F.when(new < 0, F.raise_error(F.lit("labels are not negative")).cast("long")).otherwise(new)
    return v.relabelled(lambda rows: rows.withColumn("label", checked), width=8)


def add_scalar(v: LabelVolume, k: int) -> LabelVolume:
    return operator(v, lambda c: c + F.lit(k))


def subtract_scalar(v: LabelVolume, k: int) -> LabelVolume:
    return operator(v, lambda c: c - F.lit(k))


def multiply_scalar(v: LabelVolume, k: int) -> LabelVolume:
    return operator(v, lambda c: c * F.lit(k))


def floordiv_scalar(v: LabelVolume, k: int) -> LabelVolume:
    return operator(v, lambda c: F.call_function("div", c, F.lit(k)))


def truediv_scalar(v: LabelVolume, k: float) -> LabelVolume:
    """Division, cut to an integer; labels are exact as doubles below 2 ** 53."""
    return operator(v, lambda c: F.floor(c / F.lit(k)))
