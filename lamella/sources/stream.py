"""The compressed stream of a volume: header, sizes of slices, labels, boundaries, checksums.

Slices are traced, coded, decoded and checked on the executors. A stream itself is
one byte string and is put together and taken apart by its caller; a table of
blocks, one self-contained row for each slice, has the same content and no such
limit.
"""

from __future__ import annotations

import struct
import warnings
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.crc import crc8, crc32c
from ..operators import pins as P
from ..session import drop, scratch, stored
from ..volume import VOXEL, FormatError, LabelVolume
from . import contexts as M
from . import cracks as K

# Fixed values of the format.
MAGIC, FLAT, PINS = b"crkl", 0, 2
LAYOUT = {0: "<4sBHIIIBI", 1: "<4sBHIIIBQ"}
GRID_LOG2 = 31


@dataclass(frozen=True)
class Header:
    """Fields of the format bits, lowest first: data_width, stored_width (2 bits each, as log2), equal (1: drawn cracks are boundaries), label_format (2),
    fortran_order, signed, order of the context model (4), unsorted."""

    sx: int
    sy: int
    sz: int
    data_width: int
    stored_width: int
    boundaries: bool = True
    label_format: int = FLAT
    fortran_order: bool = True
    signed: bool = False
    context_order: int = 0
    unsorted: bool = False
    n_label_bytes: int = 0
    version: int = 1

    @property
    def n_bytes(self) -> int:
        return struct.calcsize(LAYOUT[self.version]) + self.version

    def to_bytes(self) -> bytes:
        log2 = lambda w: w.bit_length() - 1
        bits = 0
        fields = ((log2(self.data_width), 2), (log2(self.stored_width), 2), (self.boundaries, 1), (self.label_format, 2), (self.fortran_order, 1), (self.signed, 1), (self.context_order, 4), (self.unsorted, 1))
        at = 0
        for value, size in fields:
            bits |= int(value) << at
            at += size
        raw = struct.pack(LAYOUT[self.version], MAGIC, self.version, bits, self.sx, self.sy, self.sz, GRID_LOG2, self.n_label_bytes)
        return raw + bytes([crc8(raw[5:])]) * self.version

    @staticmethod
    def parse(raw: bytes, verify: bool = True) -> Header:
        if raw[:4] != MAGIC or len(raw) < 5 or raw[4] not in LAYOUT:
            raise FormatError("not a stream of this format")
        version = raw[4]
        size = struct.calcsize(LAYOUT[version])
        if len(raw) < size + version:
            raise FormatError("the header is cut off")
        _, _, bits, sx, sy, sz, _, n = struct.unpack(LAYOUT[version], raw[:size])
        if verify and version and crc8(raw[5:size]) != raw[size]:
            raise FormatError("the header is damaged")
        take = lambda at, n: bits >> at & ((1 << n) - 1)
        return Header(sx, sy, sz, 1 << take(0, 2), 1 << take(2, 2), bool(take(4, 1)), take(5, 2), bool(take(7, 1)), bool(take(8, 1)), take(9, 4), bool(take(13, 1)), n, version)


@dataclass(frozen=True)
class Stream:
    """A stream taken apart."""

    header: Header
    sizes: np.ndarray
    index_crc: int | None
    labels: bytes
    model: bytes
    codes: list[bytes]
    labels_crc: int | None
    slice_crcs: np.ndarray | None

    @staticmethod
    def parse(raw: bytes, verify: bool = True) -> Stream:
        h = Header.parse(raw, verify)
        at = h.n_bytes
        sizes = np.frombuffer(raw, "<u4", h.sz, at).astype(np.int64)
        index = raw[at : at + 4 * h.sz]
        at += 4 * h.sz
        crc = None
        if h.version:
            (crc,) = struct.unpack_from("<I", raw, at)
            at += 4
            if verify and crc32c(index) != crc:
                raise FormatError("the sizes of slices are damaged")
        labels = raw[at : at + h.n_label_bytes]
        at += h.n_label_bytes
        n = M.model_bytes(h.context_order)
        model, at = raw[at : at + n], at + n
        ends = at + np.cumsum(sizes)
        codes = [raw[a:b] for a, b in zip([at, *ends[:-1].tolist()], ends.tolist(), strict=True)] if h.sz else []
        at = int(ends[-1]) if h.sz else at
        labels_crc = slice_crcs = None
        if h.version:
            if len(raw) < at + 4 + 4 * h.sz:
                raise FormatError("the stream is cut off")
            (labels_crc,) = struct.unpack_from("<I", raw, at)
            slice_crcs = np.frombuffer(raw, "<u4", h.sz, at + 4)
        return Stream(h, sizes, crc, labels, model, codes, labels_crc, slice_crcs)

    def to_bytes(self) -> bytes:
        index = np.array([len(c) for c in self.codes], "<u4").tobytes()
        head = replace(self.header, n_label_bytes=len(self.labels), version=1).to_bytes()
        body = [head, index, struct.pack("<I", crc32c(index)), self.labels, self.model, *self.codes, struct.pack("<I", crc32c(self.labels)), np.asarray(self.slice_crcs, "<u4").tobytes()]
        return b"".join(body)

    # ---- the labels section

    def dictionary(self) -> np.ndarray:
        """Labels as stored; of pins, without the background."""
        w = self.header.stored_width
        at = w if self.header.label_format == PINS else 0
        (n,) = struct.unpack_from("<Q", self.labels, at)
        return np.frombuffer(self.labels, f"<u{w}", n, at + 8)

    def background(self) -> int | None:
        return int.from_bytes(self.labels[: self.header.stored_width], "little") if self.header.label_format == PINS else None

    def unique(self) -> np.ndarray:
        """All labels, ascending and distinct."""
        if not self.header.sz * self.header.sx * self.header.sy:
            return np.empty(0, np.uint64)
        b = self.background()
        return np.unique(np.concatenate([self.dictionary().astype(np.uint64), np.array([b] * (b is not None), np.uint64)]))

    def per_slice(self) -> tuple[np.ndarray, int]:
        """Components of each slice, and the offset behind them."""
        h = self.header
        w = K.width_of(h.sx * h.sy)
        at = 8 + h.stored_width * (len(self.dictionary()) + (h.label_format == PINS))
        return np.frombuffer(self.labels, f"<u{w}", h.sz, at).astype(np.int64), at + w * h.sz

    def flat_labels(self) -> list[np.ndarray]:
        """The labels of each slice's components."""
        counts, at = self.per_slice()
        d = self.dictionary()
        keys = np.frombuffer(self.labels, f"<u{K.width_of(len(d))}", int(counts.sum()), at)
        if len(keys) and keys.max() >= len(d):
            raise FormatError("a component has no label")
        return np.split(d[keys].astype(np.uint64), np.cumsum(counts)[:-1])

    def pins(self) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """label, linear indices and depths of its pins, and ids of single components counted on through all slices."""
        h = self.header
        _, at = self.per_slice()
        form = self.labels[at]
        at += 1
        wn, wd, wc = (1 << (form >> k & 3) for k in (0, 2, 4))
        wi = K.width_of(h.sx * h.sy * h.sz)

        def take(w: int, n: int) -> np.ndarray:
            nonlocal at
            at += w * n
            if at > len(self.labels):
                raise FormatError("the pins are cut off")
            return np.frombuffer(self.labels, f"<u{w}", n, at - w * n).astype(np.int64)

        for label in self.dictionary().tolist():
            n = int(take(wn, 1)[0])
            index, depth = np.cumsum(take(wi, n)), take(wd, n)
            yield label, index, depth, np.cumsum(take(wc, int(take(wn, 1)[0])))

    # ---- slices

    def ranks(self) -> np.ndarray | None:
        return M.read_model(self.model, self.header.context_order) if self.header.context_order else None

    def slice_labels(self, z0: int, z1: int) -> list[bytes]:
        """For each slice what decode_slice needs of the labels: labels of components, and for pins the places where a label is known as well."""
        h = self.header
        if h.label_format == FLAT:
            return [x.astype("<u8").tobytes() for x in self.flat_labels()[z0:z1]]
        if h.label_format != PINS:
            raise FormatError("fixed width pins are not read")
        counts, _ = self.per_slice()
        ends = np.cumsum(counts)
        known = np.full(int(counts.sum()), self.background(), "<u8")
        plane = h.sx * h.sy
        slices, places = [np.empty(0, np.int64)], [np.empty((0, 2), "<u8")]
        for label, index, depth, single in self.pins():
            known[single] = label
            top = np.maximum(index // plane, z0)
            n = np.maximum(0, np.minimum(index // plane + depth + 1, min(h.sz, z1)) - top)
            slices.append(np.repeat(top - (np.cumsum(n) - n), n) + np.arange(n.sum()))
            places.append(np.column_stack([np.repeat(index % plane, n).astype("<u8"), np.full(n.sum(), label, "<u8")]))
        z = np.concatenate(slices)
        order = np.argsort(z, kind="stable")
        at, pairs = np.searchsorted(z[order], np.arange(z0, z1 + 1)), np.concatenate(places)[order]
        return [known[ends[i] - counts[i] : ends[i]].tobytes() + pairs[at[i - z0] : at[i - z0 + 1]].tobytes() for i in range(z0, z1)]


def symbols_of(labels: np.ndarray, boundaries: bool) -> tuple[list[int], np.ndarray]:
    """Start nodes and codes of a slice (x, y)."""
    chains = K.walks(*K.cracks_of(labels, equal=not boundaries), labels.shape)
    return [n for n, _ in chains], np.array([c for _, s in chains for c in K.to_codes(s)], np.int64)


def read_code(code: bytes, shape: tuple[int, int], ranks: np.ndarray | None, order: int) -> tuple[list[int], list[int]]:
    """Start nodes and codes of the bytes of a slice; codes may go on behind the last chain."""
    if not code:
        return [], []
    nodes, at = K.read_index(code, shape)
    return nodes, M.decode(code[at:], ranks, order) if order else K.unpack(code[at:]).tolist()


def slice_regions(code: bytes, shape: tuple[int, int], boundaries: bool, ranks: np.ndarray | None, order: int) -> np.ndarray:
    return K.regions(*K.draw(*read_code(code, shape, ranks, order), shape), shape, equal=not boundaries)


def region_crc(regions: np.ndarray) -> int:
    return crc32c(np.ascontiguousarray(regions.T).astype("<u4"))


def decode_slice(code: bytes, labels: bytes, h: Header, ranks: np.ndarray | None, crc: int | None = None) -> np.ndarray:
    """Labels (x, y) of a slice."""
    regions = slice_regions(code, (h.sx, h.sy), h.boundaries, ranks, h.context_order)
    if crc is not None and region_crc(regions) != crc:
        raise FormatError("a slice is damaged")
    n = int(regions.max()) + 1 if regions.size else 0
    raw = np.frombuffer(labels, "<u8")
    known, places = raw[:n].copy(), raw[n:].reshape(-1, 2).astype(np.int64)
    if len(known) < n:
        raise FormatError("a slice has more components than labels")
    if len(places):
        known[regions[places[:, 0] % h.sx, places[:, 0] // h.sx]] = raw[n:].reshape(-1, 2)[:, 1]
    return known[regions]


# ---- volumes


def linear(v: LabelVolume) -> int:
    """Consecutive equal voxels, which decide how boundaries are drawn."""
    from ..operators.aggregates import pixel_pairs

    return pixel_pairs(v).first()[0]


WALK = "z long, nodes array<long>, codes binary, labels array<long>, crc long"


def walks(v: LabelVolume, boundaries: bool) -> DataFrame:
    """For each slice: start nodes and codes of its walks, labels of its components, and the checksum of its component ids."""
    sx, sy, _ = v.shape

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        a = np.zeros((sx, sy), np.int64)
        a[pdf.x, pdf.y] = pdf.label
        nodes, codes = symbols_of(a, boundaries)
        r = K.regions(*K.cracks_of(a, equal=False), (sx, sy), equal=False)
        first = np.unique(np.ascontiguousarray(r.T).reshape(-1), return_index=True)[1]
        return pd.DataFrame([{"z": pdf.z.iloc[0], "nodes": nodes, "codes": codes.astype(np.uint8).tobytes(), "labels": a.T.reshape(-1)[first], "crc": region_crc(r)}])

    return v.voxels.groupBy("z").applyInPandas(one, WALK)


def context_counts(w: DataFrame, order: int) -> DataFrame:
    """context, code, n of a table of walks: how often each difference of codes follows the last few. Counted by slice, then summed."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for raw in b.codes:
                met, n = np.unique(M.keys(K.differences(np.frombuffer(raw, np.uint8).astype(np.int64)), order), return_counts=True)
                yield pd.DataFrame({"context": met // 4, "code": met % 4, "n": n})

    return w.select("codes").mapInPandas(count, "context long, code long, n long").groupBy("context", "code").agg(F.sum("n").alias("n"))


def model_of(w: DataFrame, order: int) -> np.ndarray | None:
    """The ranks of a context model for a table of walks: at most 4 ** (order + 1) counts come to the driver."""
    if not order:
        return None
    counts = np.zeros((4**order, 4), np.int64)
    for r in context_counts(w, order).collect():
        counts[r["context"], r["code"]] = r["n"]
    return M.ranking(counts)


def coded_slices(w: DataFrame, h: Header, ranks: np.ndarray | None) -> DataFrame:
    """z, code, labels (8 bytes each), crc of a table of walks: the bytes of each slice, and what it had besides."""
    keep = [c for c in ("labels", "crc") if c in w.columns]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for nodes, raw in zip(b.nodes, b.codes, strict=True):
                c = np.frombuffer(raw, np.uint8).astype(np.int64)
                body = K.pack(c) if ranks is None else M.encode(K.differences(c), ranks, h.context_order)
                out.append(K.write_index(np.asarray(nodes).tolist(), (h.sx, h.sy)) + body)
            b = b.assign(code=out)
            if "labels" in keep:
                b = b.assign(labels=[np.asarray(x, "<u8").tobytes() for x in b.labels])
            yield b[["z", "code", *keep]]

    return w.mapInPandas(run, "z long, code binary" + ", labels binary" * ("labels" in keep) + ", crc long" * ("crc" in keep))


def planned(v: LabelVolume, context_order: int) -> tuple[Header, DataFrame, np.ndarray | None]:
    """The header (of flat labels), the stored walks and the context model of a volume that is not empty."""
    if context_order and not 0 < context_order < 16:
        raise ValueError("the order of the context model is 0 to 15")
    boundaries = linear(v) >= v.size // 2
    w = stored(walks(v, boundaries), "walks")
    largest, drawn = w.agg(F.max(F.array_max("labels")), F.max(F.size("nodes"))).first()
    h = Header(*v.shape, v.width, K.width_of(int(largest)), boundaries, FLAT, v.order == "F", context_order=context_order if drawn else 0)
    return h, w, model_of(w, h.context_order)


def compress(v: LabelVolume, *, pins: bool = False, context_order: int = 0, background: int | None = None) -> bytes:
    """The volume as one stream. Slices and pins are coded on the executors; their bytes and checksums meet on the driver, as the stream does.

    As many equal as unequal neighbours in a row, or fewer, let cracks between equal pixels be drawn; pins are used only if they are asked for, there
    are several slices and most neighbours are equal.
    """
    sx, sy, sz = v.shape
    if not v.size:
        h = Header(sx, sy, sz, v.width, 1, fortran_order=v.order == "F")
        return Stream(h, None, None, struct.pack("<Q", 0) + bytes(K.width_of(sx * sy) * sz), b"", [K.write_index([], (sx, sy))] * sz, None, np.array([crc32c(b"")] * sz, np.uint32)).to_bytes()
    with scratch() as mine:
        h, w, ranks = planned(v, context_order)
        rows = sorted(coded_slices(w, h, ranks).collect(), key=lambda r: r["z"])
        counts = np.array([len(r["labels"]) // 8 for r in rows])
        if pins and sz > 1 and h.boundaries:
            h = replace(h, label_format=PINS)
            labels = pin_section(v, h, counts, background)
        else:
            d, keys = np.unique(np.frombuffer(b"".join(r["labels"] for r in rows), "<u8"), return_inverse=True)
            labels = struct.pack("<Q", len(d)) + d.astype(f"<u{h.stored_width}").tobytes() + counts.astype(f"<u{K.width_of(sx * sy)}").tobytes() + keys.astype(f"<u{K.width_of(len(d))}").tobytes()
        drop(v.spark, mine)
        mine.clear()
    model = b"" if ranks is None else M.write_model(ranks)
    return Stream(h, None, None, labels, model, [bytes(r["code"]) for r in rows], None, np.array([r["crc"] for r in rows], np.uint32)).to_bytes()


BLOCK = "z long, head binary, model binary, code binary, labels binary, crc long"


def block_table(v: LabelVolume, *, context_order: int = 0) -> DataFrame:
    """z, head, model, code, labels, crc: a row for each slice with all that it takes to decode it, as the stream would hold it.

    Nothing but the context model meets on the driver, so a volume may be larger than any machine. Results: a volume without voxels has no rows.
    """
    if not v.size:
        return v.spark.createDataFrame([], BLOCK)
    h, w, ranks = planned(v, context_order)
    head, model = bytearray(h.to_bytes()), bytearray(b"" if ranks is None else M.write_model(ranks))
    coded = coded_slices(w, h, ranks)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"z": b.z, "head": [bytes(head)] * len(b), "model": [bytes(model)] * len(b), "code": b.code, "labels": b.labels, "crc": b.crc})

    return coded.mapInPandas(run, BLOCK)


def decoded(blocks: DataFrame, *keep: str) -> DataFrame:
    """The columns keep, then x, y, z, label of a table of blocks; each slice is checked against its checksum, if it has one."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for r in b.itertuples():
                h = Header.parse(bytes(r.head), verify=False)
                ranks = M.read_model(bytes(r.model), h.context_order) if h.context_order else None
                a = decode_slice(bytes(r.code), bytes(r.labels), h, ranks, None if pd.isna(r.crc) else int(r.crc))
                if a.size and a.max() >= 2**63:
                    raise FormatError("a label is 2 ** 63 or more")
                x, y = np.indices(a.shape).reshape(2, -1)
                yield pd.DataFrame({**{k: getattr(r, k) for k in keep}, "x": x, "y": y, "z": r.z, "label": a.reshape(-1).astype(np.int64)})

    named = ", ".join(f"{c} {t}" for c, t in blocks.dtypes if c in keep)
    return blocks.mapInPandas(run, f"{named}{', ' * bool(named)}x long, y long, z long, label long")


def from_blocks(blocks: DataFrame) -> LabelVolume:
    """The volume of a table of blocks. The shape is that of the first header, whose rows must all be there."""
    first = blocks.select("head").first()
    if first is None:
        raise FormatError("no blocks")
    h = Header.parse(bytes(first["head"]))
    return LabelVolume(decoded(blocks).select(*VOXEL.fieldNames()), (h.sx, h.sy, h.sz), h.data_width, "F" if h.fortran_order else "C")


def pin_pieces(found: DataFrame, h: Header, first: np.ndarray, wi: int, wd: int, wc: int) -> DataFrame:
    """label, slab, n, last, index, depth, m, last_single, single: the coded pins and single components of each label in each slab.

    The indices of a piece start at 0; those of a label ascend from slab to slab. first: the number of the first component of each slice.
    """
    few = (wi + wd) // wc
    step = lambda a, w: np.diff(a, prepend=0).astype(f"<u{w}").tobytes()
    last = lambda a: int(a[-1]) if len(a) else 0

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        index, depth = (pdf.x + h.sx * (pdf.y + h.sy * pdf.z0)).to_numpy(), pdf.depth.to_numpy()
        long = depth >= few
        short = pdf[~long]
        single = np.sort(np.concatenate([np.empty(0, np.int64), *[first[z : z + len(c)] + c for z, c in zip(short.z0, short.cells, strict=True)]]))
        order = np.argsort(index[long])
        index, depth = index[long][order], depth[long][order]
        row = (pdf.label.iloc[0], pdf.slab.iloc[0], len(index), last(index), step(index, wi), depth.astype(f"<u{wd}").tobytes(), len(single), last(single), step(single, wc))
        return pd.DataFrame([row], columns=["label", "slab", "n", "last", "index", "depth", "m", "last_single", "single"])

    return found.groupBy("label", "slab").applyInPandas(one, "label long, slab long, n long, last long, index binary, depth binary, m long, last_single long, single binary")


def joined(pieces: list[bytes], lasts: list[int], w: int) -> bytes:
    """Pieces of ascending numbers, stored as steps from 0, as steps from the end of the piece before."""
    out, before = [], 0
    for piece, end in zip(pieces, lasts, strict=True):
        if piece:
            out += [(int.from_bytes(piece[:w], "little") - before).to_bytes(w, "little"), piece[w:]]
            before = end
    return b"".join(out)


def pin_section(v: LabelVolume, h: Header, counts: np.ndarray, background: int | None) -> bytes:
    """Pins of all labels but the one with most. Pins so short that their components cost less are listed as components.

    Pins are coded by label and slab, and joined by ranges of labels, on the executors; the driver gets the bytes of each range.
    """
    found = stored(P.covers(v), "pins")
    if background is None:
        background = int(P.background(found).first()["label"])
    found = found.where(F.col("label") != background)
    wi, wc = K.width_of(h.sx * h.sy * h.sz), K.width_of(int(counts.sum()))
    wd = K.width_of(found.agg(F.max("depth")).first()[0] or 0)
    pieces = stored(pin_pieces(found, h, np.cumsum(counts) - counts, wi, wd, wc), "pieces")
    n = pieces.groupBy("label").agg(F.sum("n").alias("n"), F.sum("m").alias("m"))
    most = n.agg(F.max(F.greatest("n", "m"))).first()[0] or 0
    wn = K.width_of(most)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        given = [b for b in batches if len(b)]
        if not given:
            return
        labels, out = [], []
        for label, p in pd.concat(given).groupby("label", sort=True):
            labels.append(label)
            out += [int(p.n.sum()).to_bytes(wn, "little"), joined([*p["index"]], [*p["last"]], wi), *p.depth, int(p.m.sum()).to_bytes(wn, "little"), joined([*p.single], [*p.last_single], wc)]
        yield pd.DataFrame({"first": [labels[0]], "labels": [np.array(labels, f"<u{h.stored_width}").tobytes()], "body": [b"".join(out)]})

    ranges = pieces.repartitionByRange(int(v.spark.conf.get("spark.sql.shuffle.partitions")), "label").sortWithinPartitions("label", "slab")
    rows = sorted(ranges.mapInPandas(run, "first long, labels binary, body binary").collect(), key=lambda r: r["first"])
    labels = b"".join(r["labels"] for r in rows)
    log2 = lambda w: w.bit_length() - 1
    form = bytes([log2(wn) | log2(wd) << 2 | log2(wc) << 4])
    head = [background.to_bytes(h.stored_width, "little"), struct.pack("<Q", len(labels) // h.stored_width), labels, counts.astype(f"<u{K.width_of(h.sx * h.sy)}").tobytes(), form]
    return b"".join([*head, *[r["body"] for r in rows]])


def decompress(spark: SparkSession, raw: bytes, z_start: int = 0, z_end: int | None = None) -> LabelVolume:
    """The slices z_start <= z < z_end of a stream as a volume; slices are decoded on the executors and checked against their checksums."""
    s = Stream.parse(raw)
    h = s.header
    z_end = h.sz if z_end is None else min(z_end, h.sz)
    z_start = max(0, z_start)
    depth = max(0, z_end - z_start)
    shape, order = (h.sx, h.sy, depth), "F" if h.fortran_order else "C"
    if h.signed:
        raise FormatError("signed labels are not read")
    if s.labels_crc is not None and crc32c(s.labels) != s.labels_crc:
        raise FormatError("the labels are damaged")
    if not h.sx * h.sy * depth:
        return LabelVolume(spark.createDataFrame([], VOXEL), shape, h.data_width, order)
    return LabelVolume(decoded(stream_blocks(spark, s, z_start, z_end)).select(*VOXEL.fieldNames()), shape, h.data_width, order)


def spread(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """Rows of slices that the driver has, dealt out to the executors."""
    return spark.createDataFrame(rows, schema).repartition(max(1, min(len(rows), 4 * spark.sparkContext.defaultParallelism)))


def stream_blocks(spark: SparkSession, s: Stream, z_start: int, z_end: int) -> DataFrame:
    """The slices z_start <= z < z_end of a stream as a table of blocks, z from 0."""
    head, model = bytearray(s.header.to_bytes()), bytearray(s.model)
    crcs = [None] * s.header.sz if s.slice_crcs is None else s.slice_crcs.tolist()
    rows = [(z - z_start, head, model, bytearray(s.codes[z]), bytearray(x), crcs[z]) for z, x in zip(range(z_start, z_end), s.slice_labels(z_start, z_end), strict=True)]
    return spread(spark, rows, BLOCK)


def read_walks(spark: SparkSession, s: Stream) -> DataFrame:
    """z, nodes, codes of a stream, decoded on the executors."""
    h, ranks = s.header, s.ranks()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = [read_code(bytes(c), (h.sx, h.sy), ranks, h.context_order) for c in b.code]
            yield pd.DataFrame({"z": b.z, "nodes": [n for n, _ in found], "codes": [np.array(c[: used(n, c)], np.uint8).tobytes() for n, c in found]})

    return spread(spark, [(z, bytearray(c)) for z, c in enumerate(s.codes)], "z long, code binary").mapInPandas(run, "z long, nodes array<long>, codes binary")


def reencode(spark: SparkSession, raw: bytes, context_order: int) -> bytes:
    """The same stream with another order of the context model; labels are untouched. Slices are decoded and coded on the executors."""
    s = Stream.parse(raw)
    if not s.header.sx * s.header.sy * s.header.sz:
        return raw
    w = stored(read_walks(spark, s), "walks")
    drawn = w.agg(F.max(F.size("nodes"))).first()[0]
    h = replace(s.header, context_order=context_order if drawn else 0)
    ranks = model_of(w, h.context_order)
    codes = [bytes(r["code"]) for r in sorted(coded_slices(w, h, ranks).collect(), key=lambda r: r["z"])]
    return replace(s, header=h, model=b"" if ranks is None else M.write_model(ranks), codes=codes).to_bytes()


def recompress(spark: SparkSession, raw: bytes, *, memory_target: int = 4_000_000_000, pins: bool = False, context_order: int | None = None) -> bytes:
    """A stream coded anew: boundaries that relabelling has made meaningless are gone, and labels are flat or, if pins, in pins.

    memory_target: bytes that the driver and a task may use; a warning tells if two streams and a slice with its components take more.
    """
    h = Header.parse(raw)
    need = 2 * len(raw) + h.sx * h.sy * (h.data_width + 5)
    if need > memory_target:
        warnings.warn(f"about {need} bytes are needed, above the target of {memory_target}", stacklevel=2)
    from ..operators.aggregates import as_runs

    v = decompress(spark, raw)
    with scratch() as mine:
        v = as_runs(v) if v.size else v  # slices are decoded once
        out = compress(v, pins=pins, context_order=h.context_order if context_order is None else context_order)
        drop(spark, mine)
        mine.clear()
    return out


def used(nodes: list[int], codes: list[int]) -> int:
    """How many codes the chains have; what is behind them fills the last byte."""
    at = 0
    for _ in nodes:
        todo, waiting = 1, None
        while todo:
            move = codes[at]
            at += 1
            if waiting is not None and move ^ waiting == 2:
                todo += -1 if move in (K.UP, K.LEFT) else 1
                waiting = None
            else:
                waiting = move
    return at


def sound(code: bytes, h: Header, ranks: np.ndarray | None, crc: int | None) -> bool:
    try:
        r = slice_regions(code, (h.sx, h.sy), h.boundaries, ranks, h.context_order)
    except (ValueError, IndexError):
        return False
    return crc is None or region_crc(r) == crc


def damaged_slices(spark: SparkSession, s: Stream) -> list[int]:
    """Slices that are not sound, found on the executors."""
    h, ranks = s.header, s.ranks()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            bad = [not sound(bytes(c), h, ranks, None if pd.isna(k) else int(k)) for c, k in zip(b.code, b.crc, strict=True)]
            yield b[["z"]][np.array(bad, bool)]

    crcs = [None] * h.sz if s.slice_crcs is None else s.slice_crcs.tolist()
    rows = [(z, bytearray(c), k) for z, (c, k) in enumerate(zip(s.codes, crcs, strict=True))]
    return sorted(r["z"] for r in spread(spark, rows, "z long, code binary, crc long").mapInPandas(run, "z long").collect())


def check(raw: bytes, spark: SparkSession | None = None) -> dict:
    """Which sections are sound: header, crack_index, labels, and bad_z, the slices that are not. None: cannot be told. With a session, slices are checked on the executors."""
    out: dict = {"header": True, "crack_index": None, "labels": None, "bad_z": []}
    try:
        Header.parse(raw)
    except FormatError:
        out["header"] = False
        return out
    try:
        s = Stream.parse(raw, verify=False)
    except (FormatError, ValueError, struct.error):
        out["crack_index"] = False
        return out
    h = s.header
    out["crack_index"] = s.index_crc is None or crc32c(raw[h.n_bytes : h.n_bytes + 4 * h.sz]) == s.index_crc
    out["labels"] = s.labels_crc is None or crc32c(s.labels) == s.labels_crc
    if h.sx * h.sy * h.sz:
        ranks = s.ranks()
        crc = lambda z: None if s.slice_crcs is None else int(s.slice_crcs[z])
        out["bad_z"] = damaged_slices(spark, s) if spark else [z for z, c in enumerate(s.codes) if not sound(c, h, ranks, crc(z))]
    return out


def ok(raw: bytes, spark: SparkSession | None = None) -> bool:
    c = check(raw, spark)
    return bool(c["header"] and c["crack_index"] and c["labels"] and not c["bad_z"])


def section_table(spark: SparkSession, raw: bytes) -> DataFrame:
    """section, bytes: what the stream is made of."""
    s = Stream.parse(raw)
    rows = [("header", s.header.n_bytes), ("crack_index", 4 * (s.header.sz + s.header.version)), ("labels", len(s.labels)), ("context_model", len(s.model)), ("crack_codes", sum(map(len, s.codes))), ("checksums", 4 * (s.header.sz + 1) * s.header.version)]
    return spark.createDataFrame(rows, "section string, bytes long")
