"""Operators on small arrays against plain NumPy."""

from collections import Counter, defaultdict, deque

import duckdb
import numpy as np
import pytest
from lamella.operators import aggregates as A
from lamella.operators import components as C
from lamella.operators import neighbourhood as N
from lamella.operators import pins as P
from lamella.operators import relabel as R
from lamella.operators import selection as S
from lamella.operators import structure as U
from lamella.plans.queries import ORACLES, QUERIES
from lamella.volume import LabelError, LabelVolume, full, ones, zeros
from pyspark.sql import functions as F

RNG = np.random.default_rng(5)
BLOBS = np.kron(RNG.integers(0, 4, (3, 4, 2)), np.ones((3, 2, 2), int))[:7, :7, :3].astype(np.uint16)
NOISE = RNG.integers(0, 3, (7, 5, 3)).astype(np.uint8)
ARRAYS = {"blobs": BLOBS, "noise": NOISE, "one slice": NOISE[:, :, :1], "point": np.ones((1, 1, 1), np.uint8)}


@pytest.fixture(scope="module", params=list(ARRAYS))
def both(request, spark):
    a = ARRAYS[request.param]
    return a, LabelVolume.from_numpy(spark, a)


@pytest.fixture(autouse=True)
def small_tiles(monkeypatch):
    monkeypatch.setattr(N, "TILE", 3)


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_arrays(both, spark):
    a, v = both
    assert (v.to_numpy() == a).all() and v.nbytes == a.nbytes and v.dtype == a.dtype
    for bad in (a.astype(np.int32), a.astype(float)):
        with pytest.raises(TypeError):
            LabelVolume.from_numpy(spark, bad)
    assert (full(spark, (3, 4, 2), 6).to_numpy() == 6).all()
    assert zeros(spark, (0, 4, 2)).voxels.count() == 0 and ones(spark, (2, 1, 1)).voxels.count() == 2


def test_dictionary(both):
    a, v = both
    assert rows(S.labels(v)) == [(int(x),) for x in np.unique(a)]
    assert S.num_labels(v).first()[0] == len(np.unique(a))
    assert dict(rows(S.contains(v, [0, 1, 99]))) == {x: x in a for x in (0, 1, 99)}
    assert rows(S.contains_range(v, -3, 2)) == [(int(x),) for x in np.unique(a) if x < 2]
    assert tuple(S.min_max(v).first()) == (a.min(), a.max())
    for x in (1, 99):
        z = np.flatnonzero((a == x).any(axis=(0, 1)))
        assert tuple(S.z_range_for_label(v, x).first()) == ((z[0], z[-1] + 1) if len(z) else (-1, -1))


@pytest.mark.parametrize("key", [(slice(None), 2, ...), (..., 0), (slice(1, -1, 2), slice(None), -1), (slice(2, 2), ...), -1, (slice(0, 99), slice(-3, None), slice(None))])
def test_cutout_and_assign(spark, key):
    a, v = BLOBS, LabelVolume.from_numpy(spark, BLOBS)
    want = a[key]
    got = S.cutout(v, key)
    assert (got.to_numpy().reshape(want.shape) == want).all()
    b = a.copy()
    b[key] = 9
    assert (S.assign(v, key, 9).to_numpy() == b).all()
    if want.size:
        b[key] = want + 1
        assert (S.assign(v, key, got.with_label(F.col("label") + 1)).to_numpy() == b).all()


def test_bad_keys(spark):
    v = LabelVolume.from_numpy(spark, NOISE)
    for key in ((7,), (0, 0, 0, 0), (slice(None, None, -1),), (-8,)):
        with pytest.raises(IndexError):
            S.cutout(v, key)
    with pytest.raises(LabelError):
        A.voxel_counts(v, 77)


def test_aggregates(both):
    a, v = both
    values, counts = np.unique(a, return_counts=True)
    assert rows(A.voxel_counts(v)) == list(zip(values.tolist(), counts.tolist()))
    at = {int(x): np.argwhere(a == x) for x in values}
    for label, *c in A.centroids(v).collect():
        assert np.allclose(c, at[label].mean(0))
    for label, *box in A.bounding_boxes(v).collect():
        assert box == [*at[label].min(0), *at[label].max(0)]
    assert len(A.label_stats(v).columns) == (8 if a.shape[2] > 1 else 6)
    flat = a.reshape(-1, order="F")
    assert A.pixel_pairs(v).first()[0] == (flat[1:] == flat[:-1]).sum()
    r = A.runs(v)
    assert rows(A.counts_of_runs(r).select("label", "voxel_count")) == rows(A.voxel_counts(v))


def test_neighbourhoods(both):
    a, v = both
    faces = defaultdict(lambda: [0, 0, 0])
    for axis in range(3):
        lo, hi = np.moveaxis(a, axis, 0)[:-1], np.moveaxis(a, axis, 0)[1:]
        for x, y in zip(lo.ravel().tolist(), hi.ravel().tolist()):
            if x != y and x and y:
                faces[min(x, y), max(x, y)][axis] += 1
    want = sorted((*k, *f, f[0] * 6.0 + f[1] * 3.0 + f[2] * 2.0) for k, f in faces.items())
    assert rows(N.contacts(v, (1, 2, 3))) == want
    for connectivity in (4, 6):
        graph = np.zeros(a.shape, int)
        for i, axis in enumerate(range(connectivity // 2)):
            for j, by in enumerate((1, -1)):
                near = np.roll(a, -by, axis) == a
                edge = np.indices(a.shape)[axis] == (a.shape[axis] - 1 if by > 0 else 0)
                graph |= (near | edge).astype(int) << (2 * i + j)
        assert rows(N.voxel_connectivity_graph(v, connectivity)) == sorted((*p, int(graph[p])) for p in np.ndindex(a.shape))
    pooled = N.mode_pooling(v)
    for (x, y, z), got in np.ndenumerate(pooled.to_numpy()):
        t = a[2 * x : 2 * x + 2, 2 * y : 2 * y + 2, z]
        p, q, r, s = t[0, 0], *((t[1, 0], t[0, 1], t[1, 1]) if t.shape == (2, 2) else (t[0, 0],) * 3)
        assert got == (p if p in (q, r) else q if q == r else s)
    outline = [(int(a[x, y, z]), x, y, z) for x, y, z in np.ndindex(a.shape) if not (0 < x < a.shape[0] - 1 and 0 < y < a.shape[1] - 1 and (a[x - 1 : x + 2, y - 1 : y + 2, z] == a[x, y, z]).all())]
    assert rows(N.point_cloud(v)) == sorted(p for p in outline if p[0])
    assert rows(N.point_cloud(v, skip_background=False)) == sorted(outline)


def test_point_cloud_of_an_empty_slice(spark):
    v = LabelVolume.from_numpy(spark, np.zeros((8, 13, 1), np.uint32))
    assert N.point_cloud(v, 0).count() == 38 and N.point_cloud(v).count() == 0


def flood(a, reach, same_slice=False, background=True):
    """Component numbers by flood fill, in the order of first voxels (z, y, x)."""
    out, n = np.full(a.shape, -1), 0
    steps = [(dx, dy, dz) for dx in (-1, 0, 1) for dy in (-1, 0, 1) for dz in (-1, 0, 1) if 0 < abs(dx) + abs(dy) + abs(dz) <= (3 if reach else 1) and not (same_slice and dz)]
    for z, y, x in np.ndindex(a.shape[::-1]):
        if out[x, y, z] >= 0 or not background and a[x, y, z] == 0:
            continue
        todo = deque([(x, y, z)])
        out[x, y, z] = n
        while todo:
            p = todo.popleft()
            for s in steps:
                q = tuple(i + d for i, d in zip(p, s))
                if all(0 <= i < k for i, k in zip(q, a.shape)) and out[q] < 0 and a[q] == a[p]:
                    out[q] = n
                    todo.append(q)
        n += 1
    return out


@pytest.mark.parametrize("in_one", [0, 1_000])
def test_components(both, in_one, monkeypatch):
    a, v = both
    monkeypatch.setattr(C, "ONE_TASK_EDGES", in_one)
    want = flood(a, 0, same_slice=True)
    assert rows(C.layer_components(v)) == sorted((*p, int(want[p])) for p in np.ndindex(a.shape))
    first = want.min(axis=(0, 1))
    assert rows(C.slice_components(v)) == sorted((*p, int(want[p] - first[p[2]])) for p in np.ndindex(a.shape))
    assert rows(C.graph_components(N.voxel_connectivity_graph(v, 4))) == rows(C.slice_components(v))
    for connectivity in (6, 26):
        got, mapping = C.connected_components(v, connectivity)
        want = flood(a, connectivity == 26, background=False) + 1
        assert (got.to_numpy() == want).all()
        assert dict(rows(mapping)) == {int(want[p]): int(a[p]) for p in np.ndindex(a.shape) if a[p]}
    got, _ = C.connected_components(v, 6, binary_image=True)
    assert (got.to_numpy() == flood((a > 0).astype(int), 0, background=False) + 1).all()


def test_pins_meet_all_components(both):
    a, v = both
    regions = flood(a, 0, same_slice=True)
    met = set()
    for label, x, y, z0, depth in P.pins(v).collect():
        assert (a[x, y, z0 : z0 + depth + 1] == label).all()
        met |= set(regions[x, y, z0 : z0 + depth + 1].tolist())
    assert met == set(regions.ravel().tolist())
    assert P.background(P.pins(v)).count() == 1


def test_relabelling(both):
    a, v = both
    some = [int(a.max()), 99]
    assert (R.mask(v, some, 7).to_numpy() == np.where(np.isin(a, some), 7, a)).all()
    assert (R.mask_except(v, some).to_numpy() == np.where(np.isin(a, some), a, 0)).all()
    grown = R.remap(v, {int(x): int(x) + 70_000 for x in np.unique(a)})
    assert grown.width == 4 and (grown.to_numpy() == a.astype(np.uint32) + 70_000).all()
    with pytest.raises(LabelError):
        R.remap(v, {99: 1})
    back, mapping = R.renumber(grown, 3)
    values = np.unique(a)
    assert back.width == 1 and (back.to_numpy() == np.searchsorted(values, a) + 3).all()
    assert rows(mapping) == [(int(x) + 70_000, i + 3) for i, x in enumerate(values)]
    assert (R.astype(R.add_scalar(v, 300), 1).to_numpy() == (a.astype(int) + 300) % 256).all()
    with pytest.raises(TypeError):
        R.astype(R.refit(grown), 1, casting="safe")
    with pytest.raises(TypeError):
        R.astype(v, 4, signed=True)
    assert R.refit(R.astype(v, 8)).width == 1
    wide = a.astype(int)
    for f, k, want in ((R.add_scalar, 5, wide + 5), (R.multiply_scalar, 3, wide * 3), (R.floordiv_scalar, 2, wide // 2), (R.truediv_scalar, 1.5, np.floor(wide / 1.5))):
        assert (f(v, k).to_numpy() == want).all()
    with pytest.raises(Exception, match="negative"):
        R.subtract_scalar(v, 100).voxels.collect()


def test_structure(both):
    a, v = both
    two = U.zstack([v, None, R.add_scalar(v, 1)])
    assert (two.to_numpy() == np.concatenate([a, a.astype(int) + 1], axis=2)).all()
    for z in {0, a.shape[2] // 2, a.shape[2] - 1, -1}:
        parts = U.zsplit(v, z)
        assert [p.shape[2] for p in parts] == [z % a.shape[2], 1, a.shape[2] - 1 - z % a.shape[2]]
        assert U.array_equal(U.zstack(parts), v)
    assert U.array_equal(U.zstack(U.slices(v)), v)
    assert U.array_equal(v, int(a.flat[0])) == (len(np.unique(a)) == 1)
    other = S.assign(v, (0, 0, 0), int(a[0, 0, 0]) + 1)
    assert not U.array_equal(v, other) and rows(U.differences(v, other)) == [(0, 0, 0, int(a[0, 0, 0]), int(a[0, 0, 0]) + 1)]
    assert U.structure_equal(v, R.add_scalar(v, 4))
    if a.size > 1:
        swapped = R.remap(v, {0: 1, 1: 0}, preserve_missing_labels=True)
        assert U.array_equal(v, swapped) == (not np.isin(a, [0, 1]).any()) and U.structure_equal(v, swapped)
        assert U.structure_equal(v, R.multiply_scalar(v, 0)) == all((a[..., z] == a[0, 0, z]).all() for z in range(a.shape[2]))


def test_split_of_a_table_with_a_last_slice_in_part(spark, tmp_path):
    """zsplit against its SQL: 313 vectors are six slices and 13 rows of a seventh; values on a threshold, and vectors too short or missing."""
    values = RNG.normal(0, 0.12, (313, 64)).astype(np.float32)
    values[:, 5], values[:, 6] = -0.1, 0.1
    vectors = [r.tolist() for r in values]
    vectors[7], vectors[70], vectors[312] = None, vectors[70][:9], []
    spark.createDataFrame(list(enumerate(vectors)), "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    want = duckdb.connect().sql(ORACLES["zsplit"].replace("from embeddings", f"from '{tmp_path}/embeddings.parquet/*.parquet'")).fetchall()
    assert len(want) == 313 * 64 and rows(QUERIES["zsplit"](spark, f"file://{tmp_path}")) == sorted(want)


def test_each(both):
    a, v = both
    got = defaultdict(set)
    for label, *p in S.each(v, [1, 2, 99]).collect():
        got[label].add(tuple(p))
    for x in (1, 2):
        at = np.argwhere(a == x)
        assert got.get(x, set()) == ({tuple(p) for p in at - at.min(0)} if len(at) else set())
    values = np.unique(a).tolist()
    assert rows(S.each_multi(v, 2)) == [(i // 2, i % 2 + 1, x) for i, x in enumerate(values)]
    assert Counter(r["mask"] for r in S.binary_image(v, 1).collect())[True] == (a == 1).sum()


def test_short_forms(spark):
    v = LabelVolume.from_numpy(spark, NOISE)
    wide = NOISE.astype(int)
    for got, want in ((v + 2, wide + 2), (2 + v, wide + 2), (3 * v, wide * 3), ((v + 5) - 5, wide), (9 - v, 9 - wide), (v // 2, wide // 2), (7 // (v + 1), 7 // (wide + 1)), (v[1:4, ..., -1], NOISE[1:4, :, -1:])):
        assert (got.to_numpy() == want).all()
    assert 2 in v and 9 not in v and v == v.copy() and v != v + 1 and v * 0 == 0
    assert R.ascontiguousarray(v).to_numpy().flags.c_contiguous and R.asfortranarray(v).to_numpy().flags.f_contiguous


def test_runs_as_storage(spark):
    """All that reads runs gives what it gives on voxels."""
    from lamella import as_runs, from_runs, label_stats, pixel_pairs

    a = np.kron(RNG.integers(0, 4, (5, 4, 3)), np.ones((3, 2, 2), int)).astype(np.uint16)
    v = LabelVolume.from_numpy(spark, a)
    w = as_runs(v)
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert (w.to_numpy() == a).all() and w.shape == v.shape and w.width == 2
    for f in (lambda v: A.voxel_counts(v), lambda v: A.voxel_counts(v, 2), A.centroids, A.bounding_boxes, label_stats, pixel_pairs, A.runs, A.stored_width, S.labels, S.min_max, lambda v: S.labels_for_z_range(v, 1, 3), lambda v: S.z_range_for_label(v, 3), lambda v: S.contains(v, [1, 9])):
        assert rows(f(v)) == rows(f(w))
    for f in (lambda v: R.remap(v, {0: 1, 1: 1, 2: 70000, 3: 3}), lambda v: R.mask(v, [1, 2], 3), lambda v: R.mask_except(v, [1]), lambda v: R.renumber(v, 7)[0], lambda v: R.add_scalar(v, 5), lambda v: S.z_slab(v, 2, 5), lambda v: R.astype(R.multiply_scalar(v, 200), 1)):
        x, y = f(v), f(w)
        assert y.stored_runs is not None and (x.to_numpy() == y.to_numpy()).all() and x.width == y.width
        assert rows(A.runs(x)) == rows(A.runs(y)) and rows(pixel_pairs(x)) == rows(pixel_pairs(y))
    assert S.cutout(w, (slice(1, 4),)).stored_runs is None
    one = C.connected_components(w, 6)[0]
    assert (one.to_numpy() == C.connected_components(v, 6)[0].to_numpy()).all()
    wide = from_runs(spark.createDataFrame([(0, 0, 0, 999, 5), (0, 1, 0, 499, 5), (0, 1, 500, 999, 0), (1, 0, 0, 999, 5), (1, 1, 0, 999, 6)], "z long, y long, x0 long, x1 long, label long"), (1000, 2, 2))
    assert rows(A.voxel_counts(C.connected_components(wide, 6)[0])) == [(0, 500), (1, 2500), (2, 1000)]


def test_pins_in_slabs(spark):
    a = np.kron(RNG.integers(0, 3, (4, 4, 5)), np.ones((2, 2, 2), int)).astype(np.uint8)
    v = LabelVolume.from_numpy(spark, a)
    want = sorted((r["z"], r["ccid"]) for r in C.component_table(v).collect())
    for slab in (1, 3, 128):
        p = P.pins(v, slab)
        assert sorted((r["z"], r["ccid"]) for r in P.met_components(v, p).collect()) == want
        assert all(r["z0"] // slab == (r["z0"] + r["depth"]) // slab for r in p.collect())


def test_point_cloud_of_some(spark):
    v = LabelVolume.from_numpy(spark, np.kron(RNG.integers(0, 4, (4, 4, 4)), np.ones((4, 4, 1), int)).astype(np.uint8))
    every = sorted(map(tuple, N.point_cloud(v, skip_background=False).collect()))
    assert sorted(map(tuple, N.point_cloud(v, [1, 3], 1, 3).collect())) == [r for r in every if r[0] in (1, 3) and 1 <= r[3] < 3]
    with pytest.raises(LabelError):
        N.point_cloud(v, [1, 99])


def test_contours(spark):
    from lamella.operators import contours as K

    ring = np.zeros((7, 6), int)
    ring[1:6, 1:5] = 1
    ring[2:5, 2:4] = 2
    ring[3, 2] = 3
    found = {(c, outer): p.tolist() for c, outer, p in K.walked(K_regions(ring))}
    at = lambda *xy: [x + 7 * y for x, y in xy]
    # Component 3 is the pixel (3, 2); 2 goes around it on three sides.
    assert found[3, True] == at((3, 2))
    assert found[1, True] == at(*[(x, 1) for x in range(1, 6)], (5, 2), (5, 3), *[(x, 4) for x in range(5, 0, -1)], (1, 3), (1, 2))
    assert found[1, False] == at((1, 1), (1, 2), (1, 3), (1, 4), (2, 4), (3, 4), (4, 4), (5, 4), (5, 3), (5, 2), (5, 1), (4, 1), (3, 1), (2, 1))
    assert (0, False) in found and (0, True) in found and len(found) == 6
    for a in (NOISE, BLOBS):
        v = LabelVolume.from_numpy(spark, a)
        rows = K.contours(v).collect()
        sx = a.shape[0]
        got = {(r["z"], p % sx, p // sx) for r in rows for p in r["pixels"]}
        assert got == {(r["z"], r["x"], r["y"]) for r in N.point_cloud(v, skip_background=False).collect()}
        assert Counter(r["z"] for r in rows if r["outer"]) == {r["z"]: r["components"] for r in C.component_counts(v).collect()}
        for r in rows:
            p = np.array(r["pixels"])
            assert p[0] == p.min() and (a[p % sx, p // sx, r["z"]] == r["label"]).all()
            steps = np.abs(np.diff(np.append(p, p[0]) % sx)) + np.abs(np.diff(np.append(p, p[0]) // sx))
            assert (steps == 1).all() or len(p) == 1


def K_regions(a):
    from lamella.sources import cracks

    return cracks.regions(*cracks.cracks_of(a, False), a.shape, equal=False)
