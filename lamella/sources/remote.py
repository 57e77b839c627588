"""Streams read by byte ranges: header, labels and single slices of a stored stream, without the rest of it."""

from __future__ import annotations

import os
import struct
from collections.abc import Callable

import numpy as np
from pyspark.sql import SparkSession

from ..functions.crc import crc32c
from ..volume import VOXEL, FormatError, LabelVolume
from . import contexts as M
from . import cracks as K
from . import stream as S


def ranges_of(spark: SparkSession, source: str | os.PathLike | bytes) -> Callable[[int, int], bytes]:
    """read(start, n) of a path of any file system that Spark knows, of a local path, or of bytes."""
    if isinstance(source, bytes):
        return lambda start, n: source[start : start + n]
    path = os.fspath(source)
    if "://" not in path and not path.startswith("file:"):

        def read_local(start: int, n: int) -> bytes:
            with open(path, "rb") as f:
                f.seek(start)
                return f.read(n)

        return read_local
    jvm = spark._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    system = where.getFileSystem(spark._jsc.hadoopConfiguration())
    size = system.getFileStatus(where).getLen()

    def read(start: int, n: int) -> bytes:
        n = max(0, min(n, size - start))
        if not n:
            return b""
        stream = system.open(where)
        try:
            stream.seek(start)
            return bytes(jvm.org.apache.commons.io.IOUtils.toByteArray(stream, n))
        finally:
            stream.close()

    return read


class RemoteStream:
    """A stored stream. The header and the sizes of slices are read at once, labels and slices when they are asked for; n_read counts bytes."""

    def __init__(self, spark: SparkSession, source: str | os.PathLike | bytes):
        self.spark, self.ranges, self.n_read = spark, ranges_of(spark, source), 0
        self.header = h = S.Header.parse(self.read(0, 32, exact=False))
        raw = self.read(h.n_bytes, 4 * (h.sz + h.version))
        if h.version and crc32c(raw[: 4 * h.sz]) != struct.unpack_from("<I", raw, 4 * h.sz)[0]:
            raise FormatError("the sizes of slices are damaged")
        self.sizes = np.frombuffer(raw, "<u4", h.sz).astype(np.int64)
        self.labels_at = h.n_bytes + len(raw)
        self.model_at = self.labels_at + h.n_label_bytes
        self.codes_at = self.model_at + M.model_bytes(h.context_order)
        self.crcs_at = self.codes_at + int(self.sizes.sum()) + 4

    def read(self, start: int, n: int, exact: bool = True) -> bytes:
        raw = self.ranges(start, n)
        self.n_read += len(raw)
        if exact and len(raw) < n:
            raise FormatError("the stream is cut off")
        return raw

    @property
    def shape(self) -> tuple[int, int, int]:
        return self.header.sx, self.header.sy, self.header.sz

    def dictionary_at(self) -> tuple[int, int]:
        """Number of labels of the dictionary, and where they begin."""
        at = self.labels_at + self.header.stored_width * (self.header.label_format == S.PINS)
        return struct.unpack("<Q", self.read(at, 8))[0], at + 8

    def num_labels(self) -> int:
        return self.dictionary_at()[0] + (self.header.label_format == S.PINS) if all(self.shape) else 0

    def labels(self) -> np.ndarray:
        """All labels, ascending."""
        if not all(self.shape):
            return np.empty(0, np.uint64)
        n, at = self.dictionary_at()
        found = np.frombuffer(self.read(at, n * self.header.stored_width), f"<u{self.header.stored_width}").astype(np.uint64)
        if self.header.label_format == S.PINS:
            found = np.append(found, np.uint64(int.from_bytes(self.read(self.labels_at, self.header.stored_width), "little")))
        return np.unique(found)

    def __contains__(self, label: int) -> bool:
        return label in self.labels()

    def flat_labels(self, z_start: int, z_end: int) -> list[bytes]:
        """Labels of the components of the slices: the dictionary, the numbers of components, and the keys of these slices are read."""
        h = self.header
        n, at = self.dictionary_at()
        names = np.frombuffer(self.read(at, n * h.stored_width), f"<u{h.stored_width}")
        at += n * h.stored_width
        w, key = K.width_of(h.sx * h.sy), K.width_of(n)
        upto = np.concatenate([[0], np.cumsum(np.frombuffer(self.read(at, w * h.sz), f"<u{w}").astype(np.int64))])
        at += w * h.sz
        keys = np.frombuffer(self.read(at + key * int(upto[z_start]), key * int(upto[z_end] - upto[z_start])), f"<u{key}")
        if len(keys) and keys.max() >= n:
            raise FormatError("a component has no label")
        found = names[keys].astype("<u8")
        return [found[upto[z] - upto[z_start] : upto[z + 1] - upto[z_start]].tobytes() for z in range(z_start, z_end)]

    def slab(self, z_start: int = 0, z_end: int | None = None) -> LabelVolume:
        """The slices z_start <= z < z_end as a volume; they are decoded on the executors and checked against their checksums. Pins are read as a whole."""
        h = self.header
        z_end = h.sz if z_end is None else min(z_end, h.sz)
        z_start = max(0, z_start)
        depth = max(0, z_end - z_start)
        shape, order = (h.sx, h.sy, depth), "F" if h.fortran_order else "C"
        if h.signed:
            raise FormatError("signed labels are not read")
        if not h.sx * h.sy * depth:
            return LabelVolume(self.spark.createDataFrame([], VOXEL), shape, h.data_width, order)
        if h.label_format == S.FLAT:
            labels = self.flat_labels(z_start, z_end)
        else:
            section = self.read(self.labels_at, h.n_label_bytes)
            labels = S.Stream(h, self.sizes, None, section, b"", [], None, None).slice_labels(z_start, z_end)
        model = bytearray(self.read(self.model_at, self.codes_at - self.model_at))
        ends = np.concatenate([[0], np.cumsum(self.sizes)])
        codes = self.read(self.codes_at + int(ends[z_start]), int(ends[z_end] - ends[z_start]))
        crcs = np.frombuffer(self.read(self.crcs_at + 4 * z_start, 4 * depth), "<u4").tolist() if h.version else [None] * depth
        head = bytearray(h.to_bytes())
        cut = lambda z: bytearray(codes[ends[z] - ends[z_start] : ends[z + 1] - ends[z_start]])
        rows = [(z - z_start, head, model, cut(z), bytearray(x), crcs[z - z_start]) for z, x in zip(range(z_start, z_end), labels, strict=True)]
        return LabelVolume(S.decoded(S.spread(self.spark, rows, S.BLOCK)).select(*VOXEL.fieldNames()), shape, h.data_width, order)

    def __getitem__(self, key) -> LabelVolume:
        """A cut-out; of z only the slices from the first to the last that is asked for are read."""
        from ..operators.selection import cutout, normalized

        x, y, z = normalized(key, self.shape)
        return cutout(self.slab(z.start, z.stop), (x, y, slice(None, None, z.step)))


def rload(spark: SparkSession, source: str | os.PathLike | bytes) -> RemoteStream:
    """A stream to be read by byte ranges."""
    return RemoteStream(spark, source)
