"""Files of volumes: streams, NumPy arrays and, where their libraries are installed, other image formats; and tables of streams and sidecars."""

from __future__ import annotations

import gzip
import io
import lzma
import os
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.aggregates import label_stats, runs
from ..session import stored
from ..volume import FormatError, LabelVolume, from_runs
from . import stream as S

STREAM, ARRAY = ".ckl", ".npy"
SECOND = {".gz": gzip.open, ".xz": lzma.open, ".lzma": lambda p, m: lzma.open(p, m, format=lzma.FORMAT_ALONE if "w" in m else lzma.FORMAT_AUTO)}


def kind_of(path: str | os.PathLike) -> tuple[str, str]:
    """Format and second-stage compression, by extension."""
    suffixes = Path(path).suffixes
    second = suffixes.pop() if suffixes and suffixes[-1] in SECOND else ""
    return (suffixes[-1] if suffixes else ""), second


def open_file(path: str | os.PathLike, mode: str):
    second = kind_of(path)[1]
    return SECOND[second](path, mode) if second else open(path, mode)


def bload(source) -> bytes:
    """The bytes of a path or file object, with the second stage undone."""
    if hasattr(source, "read"):
        return source.read()
    with open_file(source, "rb") as f:
        return f.read()


def load(spark: SparkSession, source) -> LabelVolume:
    """A stream as a volume."""
    return S.decompress(spark, bload(source))


def aload(spark: SparkSession, source) -> np.ndarray:
    return load(spark, source).to_numpy()


def head(source, n: int) -> bytes:
    """The first n bytes of a path; a file object is left where it was."""
    if hasattr(source, "read"):
        at = source.tell()
        raw = source.read(n)
        source.seek(at)
        return raw
    with open_file(source, "rb") as f:
        return f.read(n)


def load_header(source) -> S.Header:
    return S.Header.parse(head(source, 32))


def load_num_labels(source) -> int:
    """Number of labels, from a small part of the file."""
    h = load_header(source)
    if not h.sx * h.sy * h.sz:
        return 0
    at = h.n_bytes + 4 * (h.sz + h.version) + (h.stored_width if h.label_format == S.PINS else 0)
    raw = head(source, at + 8)
    return int.from_bytes(raw[at : at + 8], "little") + (h.label_format == S.PINS)


def load_numpy(spark: SparkSession, source) -> LabelVolume:
    return LabelVolume.from_numpy(spark, np.load(io.BytesIO(bload(source))))


def other_formats(extension: str):
    """Reader and writer of an image format whose library is not required."""
    try:
        if extension == ".nrrd":
            import nrrd

            return lambda p: nrrd.read(p)[0], lambda p, a: nrrd.write(p, a)
        if extension in (".tif", ".tiff"):
            import tifffile

            return lambda p: tifffile.imread(p).T, lambda p, a: tifffile.imwrite(p, a.T)
        if extension == ".nii":
            import nibabel

            return lambda p: np.asarray(nibabel.load(p).dataobj), lambda p, a: nibabel.save(nibabel.Nifti1Image(a, np.eye(4)), p)
    except ImportError as e:
        raise FormatError(f"{extension} files need the library {e.name}") from e
    raise FormatError(f"files of kind {extension!r} are not known")


def load_any(spark: SparkSession, path: str | os.PathLike) -> LabelVolume:
    kind, _ = kind_of(path)
    if kind == STREAM:
        return load(spark, path)
    if kind == ARRAY:
        return load_numpy(spark, path)
    return LabelVolume.from_numpy(spark, other_formats(kind)[0](str(path)))


def slice_bytes(v: LabelVolume) -> DataFrame:
    """z, raw: the labels of each slice in Fortran order."""
    sx, sy, _ = v.shape
    dtype = v.dtype

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        a = np.zeros((sx, sy), dtype, order="F")
        a[pdf.x, pdf.y] = pdf.label.to_numpy().astype(dtype)
        return pd.DataFrame([{"z": pdf.z.iloc[0], "raw": a.tobytes(order="F")}])

    return v.voxels.groupBy("z").applyInPandas(one, "z long, raw binary")


def save_numpy(v: LabelVolume, target) -> None:
    """A .npy file in Fortran order. Slices are laid out on the executors, in one job, and come to the driver one after another."""
    head = io.BytesIO()
    np.lib.format.write_array_header_1_0(head, {"descr": np.lib.format.dtype_to_descr(v.dtype), "fortran_order": True, "shape": v.shape})
    f = target if hasattr(target, "write") else open_file(target, "wb")
    try:
        f.write(head.getvalue())
        for r in stored(slice_bytes(v), "slices").orderBy("z").toLocalIterator() if v.size else ():
            f.write(r["raw"])
    finally:
        if f is not target:
            f.close()


def save(v: LabelVolume, target, *, form: str | None = None, **options) -> None:
    """Write a volume by extension: streams (.ckl), arrays (.npy), each with .gz, .xz or .lzma, or a format whose library is installed."""
    kind = form or kind_of(target)[0]
    if kind == STREAM:
        raw = S.compress(v, **options)
        if hasattr(target, "write"):
            target.write(raw)
            return
        with open_file(target, "wb") as f:
            f.write(raw)
    elif kind == ARRAY:
        save_numpy(v, target)
    else:
        other_formats(kind)[1](str(target), v.to_numpy())


# ---- tables

VOXELS = "path string, x long, y long, z long, label long"


def read_streams(spark: SparkSession, path: str) -> DataFrame:
    """path, x, y, z, label of all streams under a path of any file system: each is taken apart by one task, and its slices are decoded by many. All checksums are verified."""

    def parts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for name, raw in zip(b.path, b.content, strict=True):
                s = S.Stream.parse(bytes(raw))
                if s.labels_crc is not None and S.crc32c(s.labels) != s.labels_crc:
                    raise FormatError(f"the labels of {name} are damaged")
                header = s.header.to_bytes()
                for z, labels in enumerate(s.slice_labels(0, s.header.sz) if s.header.sx * s.header.sy else []):
                    yield pd.DataFrame([{"path": name, "z": z, "head": header, "model": s.model, "code": s.codes[z], "labels": labels, "crc": None if s.slice_crcs is None else int(s.slice_crcs[z])}])

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return S.decoded(files.mapInPandas(parts, f"path string, {S.BLOCK}").repartition("path", "z"), "path")


def check_streams(spark: SparkSession, path: str) -> DataFrame:
    """path, section, z, sound of all streams under a path: a row for header, crack_index and labels each, as far as they can be told, and one for each slice."""

    def report(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for name, raw in zip(b.path, b.content, strict=True):
                found = S.check(bytes(raw))
                rows = [(name, k, None, found[k]) for k in ("header", "crack_index", "labels") if found[k] is not None]
                if found["labels"] is not None:
                    h = S.Header.parse(bytes(raw))
                    rows += [(name, "slice", z, z not in found["bad_z"]) for z in range(h.sz)]
                yield pd.DataFrame(rows, columns=["path", "section", "z", "sound"]).astype({"z": "Int64"})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(report, "path string, section string, z long, sound boolean")


def write_blocks(v: LabelVolume, path: str, **options) -> None:
    """A volume of any size as a table of blocks: slices coded as in a stream, one row for each, sorted by z so that a reader of some slices skips the others."""
    S.block_table(v, **options).repartitionByRange("z").sortWithinPartitions("z").write.option("compression", "none").parquet(path)


def read_blocks(spark: SparkSession, path: str, z_start: int = 0, z_end: int | None = None) -> LabelVolume:
    """The slices z_start <= z < z_end of a table of blocks; no other rows are decoded."""
    blocks = spark.read.schema(S.BLOCK).parquet(path)
    whole = S.from_blocks(blocks)
    z_end = whole.shape[2] if z_end is None else min(z_end, whole.shape[2])
    if (z_start, z_end) == (0, whole.shape[2]):
        return whole
    some = blocks.where((F.col("z") >= z_start) & (F.col("z") < z_end)).withColumn("z", F.col("z") - z_start)
    return whole.with_voxels(S.decoded(some), shape=(*whole.shape[:2], max(0, z_end - z_start)))


def write_runs(v: LabelVolume, path: str) -> None:
    """Runs as Parquet, sorted by z and y: the smallest form of a volume that operators read as it is."""
    runs(v).repartitionByRange("z").sortWithinPartitions("z", "y", "x0").write.option("compression", "zstd").parquet(path)


def read_runs(spark: SparkSession, path: str, shape: tuple[int, int, int] | None = None, width: int = 8) -> LabelVolume:
    """A volume of a table of runs. Without a shape, it is the largest coordinates plus one."""
    df = spark.read.schema("z long, y long, x0 long, x1 long, label long").parquet(path)
    if shape is None:
        shape = tuple((n if n is not None else -1) + 1 for n in df.agg(F.max("x1"), F.max("y"), F.max("z")).first())
    return from_runs(df, shape, width)


def write_table(v: LabelVolume, path: str) -> None:
    """Voxels as Parquet, a folder for each slice: a reader of some slices prunes the others."""
    v.voxels.repartition("z").write.partitionBy("z").option("compression", "zstd").parquet(path)


def read_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("x long, y long, label long, z long").parquet(path).select("x", "y", "z", "label")


def write_sidecar(v: LabelVolume, path: str) -> None:
    """Counts and boxes of all labels as Parquet, for questions about labels that should not read voxels."""
    label_stats(v).write.option("compression", "zstd").parquet(path)


def read_sidecar(spark: SparkSession, path: str) -> DataFrame:
    """A sidecar with labels as long, also of one whose labels are unsigned 64-bit."""
    return spark.read.parquet(path).withColumn("label", F.col("label").cast("long"))
