"""The stream format: round trips, sections, checksums and damage."""

import numpy as np
import pytest
from lamella.functions.crc import crc8, crc32c
from lamella.operators import pins as P
from lamella.sources import contexts, cracks, files, stream
from lamella.sources.remote import rload
from lamella.volume import FormatError, LabelVolume, full

R = np.random.default_rng(11)


def volumes():
    blob = np.repeat(np.repeat(R.integers(0, 4, (4, 5, 3)), 6, axis=0), 5, axis=1).astype(np.uint32)
    yield "noise", R.integers(0, 5, (9, 7, 3)).astype(np.uint8)
    yield "blobs", blob
    yield "wide", R.integers(0, 2**60, (4, 4, 2)).astype(np.uint64)
    yield "one label", np.full((6, 5, 2), 2**32 - 1, np.uint32)
    yield "flat", np.array([[0, 0, 1, 1], [0, 1, 1, 0], [2, 2, 2, 0]], np.uint8)[..., None]
    yield "each its own", np.arange(8 * 8 * 2).reshape(8, 8, 2).astype(np.uint16)
    yield "line", R.integers(0, 3, (17, 1, 1)).astype(np.uint8)
    yield "empty", np.zeros((0, 0, 0), np.uint32)
    yield "no height", np.zeros((3, 0, 2), np.uint32)


def test_checksums():
    assert crc32c(b"123456789") == 0xE3069283
    assert crc32c(b"") == 0

    def plain(data):
        c = 0xFFFFFFFF
        for b in data:
            c ^= b
            for _ in range(8):
                c = (c >> 1) ^ (0x82F63B78 if c & 1 else 0)
        return c ^ 0xFFFFFFFF

    for n in (1, 2, 3, 63, 64, 65, 1000, 4097):
        data = R.integers(0, 256, n).astype(np.uint8).tobytes()
        assert crc32c(data) == plain(data)
    assert crc8(b"") == 0xFF


@pytest.mark.parametrize("kind", ["plain", "context", "pins"])
def test_round_trip(spark, kind):
    for name, a in volumes():
        if kind != "plain" and name in ("wide", "each its own", "line"):
            continue
        v = LabelVolume.from_numpy(spark, a)
        raw = stream.compress(v, pins=kind == "pins", context_order=2 if kind == "context" else 0)
        s = stream.Stream.parse(raw)
        back = stream.decompress(spark, raw)
        assert back.shape == v.shape and back.width == a.itemsize
        assert (back.to_numpy() == a.reshape(v.shape)).all(), name
        assert s.unique().tolist() == np.unique(a).tolist()
        assert stream.ok(raw), stream.check(raw)
        if kind == "pins" and name == "blobs":
            assert s.header.label_format == stream.PINS
        if kind == "context":
            plain = stream.reencode(spark, raw, 0)
            assert (stream.decompress(spark, plain).to_numpy() == a.reshape(v.shape)).all()
            assert stream.reencode(spark, plain, s.header.context_order) == raw


def test_slices_of_a_stream(spark):
    a = R.integers(0, 3, (8, 6, 5)).astype(np.uint8)
    raw = stream.compress(LabelVolume.from_numpy(spark, a))
    assert (stream.decompress(spark, raw, 1, 4).to_numpy() == a[:, :, 1:4]).all()


def test_blocks(spark, tmp_path):
    for name, a in volumes():
        if not a.size:
            assert stream.block_table(LabelVolume.from_numpy(spark, a)).count() == 0
            continue
        v = LabelVolume.from_numpy(spark, a)
        for order in (0, 2):
            where = f"file://{tmp_path}/{name}-{order}"
            files.write_blocks(v, where, context_order=order)
            back = files.read_blocks(spark, where)
            assert (back.to_numpy() == a.reshape(v.shape)).all() and back.width == a.itemsize, name
            part = files.read_blocks(spark, where, 1, 2)
            assert (part.to_numpy() == a.reshape(v.shape)[:, :, 1:2]).all()


def test_byte_ranges(spark, tmp_path):
    """Labels and slices of a stored stream, from fewer bytes than it has."""
    a = R.integers(0, 40, (30, 20, 12)).astype(np.uint16)
    for pins, volume in ((False, a), (True, np.repeat(a[:, :, :3], 4, axis=2))):
        raw = stream.compress(LabelVolume.from_numpy(spark, volume), pins=pins, context_order=2)
        path = tmp_path / f"a{pins}.ckl"
        path.write_bytes(raw)
        for source in (path, f"file://{path}", raw):
            r = rload(spark, source)
            assert r.shape == volume.shape and r.labels().tolist() == np.unique(volume).tolist() and r.num_labels() == len(np.unique(volume))
            assert 7 in r and 77 not in r
            before = r.n_read
            assert (r[3:9, ::2, 5].to_numpy() == volume[3:9, ::2, 5:6]).all()
            assert (r[..., 4:7].to_numpy() == volume[..., 4:7]).all()
            assert before < len(raw) / 10 and r.n_read < len(raw)
        with pytest.raises(FormatError):
            rload(spark, raw[:200]).slab().voxels.collect()
    empty = stream.compress(LabelVolume.from_numpy(spark, np.zeros((0, 0, 0), np.uint32)))
    assert rload(spark, empty).labels().tolist() == [] and rload(spark, empty).num_labels() == 0


def test_recompress(spark):
    a = np.kron(R.integers(0, 4, (3, 3, 4)), np.ones((4, 4, 1), int)).astype(np.uint8)
    raw = stream.compress(LabelVolume.from_numpy(spark, a))
    pins = stream.recompress(spark, raw, pins=True)
    assert stream.Stream.parse(pins).header.label_format == stream.PINS and stream.recompress(spark, pins) == raw
    with pytest.warns(UserWarning, match="target"):
        stream.recompress(spark, raw, memory_target=10)


def test_driver_gets_bytes_of_pins(spark, monkeypatch):
    """Pins of several slabs, few and many for a label: the driver gets a row for each slice or range of labels, without lists in it."""
    a = np.kron(R.integers(0, 5, (6, 10, 30)), np.ones((2, 1, 10), int)).astype(np.uint8)
    a[4:8, 3, 5:290] = 7
    a[0, 0, ::3] = 8
    v = LabelVolume.from_numpy(spark, a)
    raw = stream.compress(v)
    frame, got = type(v.voxels), []

    def watched(f):
        def run(self, *args):
            out = f(self, *args)
            rows = out if isinstance(out, list) else list(out.itertuples(index=False))
            got.append((len(rows), any(isinstance(x, (list, tuple, np.ndarray)) for r in rows for x in r)))
            return out

        return run

    for name in ("collect", "toPandas"):
        monkeypatch.setattr(frame, name, watched(getattr(frame, name)))
    pins = stream.recompress(spark, raw, pins=True)
    monkeypatch.undo()
    assert stream.Stream.parse(pins).header.label_format == stream.PINS and P.pins(v).count() > 3 * a.shape[2]
    assert max(n for n, _ in got) <= a.shape[2] and not any(lists for _, lists in got)
    assert (stream.decompress(spark, pins).to_numpy() == a).all()
    assert (stream.decompress(spark, pins, 120, 140).to_numpy() == a[:, :, 120:140]).all()
    assert stream.recompress(spark, pins) == raw


def test_context_counts(spark):
    a = R.integers(0, 3, (9, 7, 4)).astype(np.uint8)
    v = LabelVolume.from_numpy(spark, a)
    found = [cracks.differences(stream.symbols_of(a[:, :, z], stream.linear(v) >= v.size // 2)[1]) for z in range(4)]
    want = contexts.histogram(found, 2)
    got = {(r["context"], r["code"]): r["n"] for r in stream.context_counts(stream.planned(v, 0)[1], 2).collect()}
    assert got == {(i, j): want[i, j] for i in range(16) for j in range(4) if want[i, j]}


def test_slices_without_spark():
    for shape in ((1, 1), (2, 2), (30, 20), (1, 40), (64, 64)):
        for top in (1, 2, 50):
            for a in (R.integers(0, top, shape), np.kron(R.integers(0, top, (shape[0] // 4 + 1, shape[1] // 4 + 1)), np.ones((4, 4), int))[: shape[0], : shape[1]]):
                want = cracks.regions(*cracks.cracks_of(a, False), shape, equal=False)
                for boundaries in (True, False):
                    nodes, codes = stream.symbols_of(a, boundaries)
                    index = cracks.write_index(nodes, shape)
                    assert cracks.read_index(index + b"xyz", shape) == (nodes, len(index))
                    for order in (0, 1, 3):
                        if order and len(codes):
                            d = cracks.differences(codes)
                            ranks = contexts.ranking(contexts.histogram([d], order))
                            assert (contexts.read_model(contexts.write_model(ranks), order) == ranks).all()
                            assert len(contexts.write_model(ranks)) == contexts.model_bytes(order)
                            code = index + contexts.encode(d, ranks, order)
                        else:
                            ranks, order, code = None, 0, index + cracks.pack(codes)
                        assert (stream.slice_regions(code, shape, boundaries, ranks, order) == want).all()


def test_header_faults():
    raw = stream.Header(11, 23, 37, 4, 2, False, 0, True, False, 3, False, 12345).to_bytes()
    assert len(raw) == 29
    h = stream.Header.parse(raw)
    assert (h.sx, h.sy, h.sz, h.data_width, h.stored_width, h.context_order, h.n_label_bytes, h.boundaries) == (11, 23, 37, 4, 2, 3, 12345, False)
    bits = 8 * 23
    for i in range(bits):
        for j in range(i, bits):
            bad = bytearray(raw)
            for k in {i, j}:
                bad[5 + k // 8] ^= 1 << k % 8
            with pytest.raises(FormatError):
                stream.Header.parse(bytes(bad))


def test_damage(spark):
    a = np.kron(R.integers(0, 4, (3, 3, 4)), np.ones((4, 4, 1), int)).astype(np.uint8)
    raw = stream.compress(LabelVolume.from_numpy(spark, a))
    s = stream.Stream.parse(raw)
    at = s.header.n_bytes
    flip = lambda i: raw[:i] + bytes([raw[i] ^ 4]) + raw[i + 1 :]
    assert not stream.check(flip(8))["header"]
    assert not stream.check(flip(at))["crack_index"]
    labels = at + 4 * 5
    assert not stream.check(flip(labels + 8))["labels"]
    code = labels + len(s.labels) + len(s.codes[0]) + len(s.codes[1]) - 1
    for where in (None, spark):
        assert stream.check(flip(code), where) == {"header": True, "crack_index": True, "labels": True, "bad_z": [1]}
        assert stream.ok(raw, where) and not stream.ok(flip(code), where)
    with pytest.raises(Exception, match="damaged|chain"):
        stream.decompress(spark, flip(code)).voxels.collect()


def test_published_sizes(spark):
    """Volumes of 256 x 256 x 64 with one label take 1262 bytes, as the format's benchmarks say."""
    for label in (0, 1):
        assert len(stream.compress(full(spark, (256, 256, 64), label, width=4))) == 1262


def test_junctions_without_spark():
    """Four squares that meet in a point, with walls of their own: branches that must not be taken for ends."""
    a = np.zeros((10, 9), int)
    a[2:4, 2:4], a[4:6, 2:4], a[4:6, 4:6], a[2:4, 4:6] = 1, 2, 3, 4
    for b in (a, a.T, np.kron(a, np.ones((2, 3), int)), a[::-1], a[2:6, 2:6]):
        want = cracks.regions(*cracks.cracks_of(b, False), b.shape, equal=False)
        for boundaries in (True, False):
            nodes, codes = stream.symbols_of(b, boundaries)
            assert (stream.slice_regions(cracks.write_index(nodes, b.shape) + cracks.pack(codes), b.shape, boundaries, None, 0) == want).all()
