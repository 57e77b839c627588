"""The n-gram Jaccard join against all pairs."""

import random

import numpy as np
from lamella.llm import jaccard_join, kernel

from . import data


FOUR = {"words": 4, "num": 85, "den": 100}


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def shingles(text, k=4):
    w = lower(text).encode().split()
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def brute(rows, k=4, num=85):
    sets = [(i, shingles(t, k)) for i, t in rows]
    root = {i: i for i, _ in sets if i is not None}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for x, (i, a) in enumerate(sets):
        for j, b in sets[:x]:
            if i is not None and j is not None and a and b and 100 * len(a & b) >= num * len(a | b):
                p, q = sorted((find(i), find(j)))
                root[q] = p
    return sorted(((i, len(s), find(i) if i is not None else None) for i, s in sets), key=str)


def near(seed=1):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(4))
    out = []
    for n in (6, 9, 14, 30, 31, 60, 200, 201, 500, 1500):
        source = [word() for _ in range(n)]
        for edits in (0, 1, 1, 2, 3, 4, 6, 9, 14, 20):
            w = list(source)
            for _ in range(min(edits, n)):
                w[r.randrange(len(w))] = word()
            out.append(" ".join(w))
        out.append(" ".join(source[: int(n * 0.87)]))
        # Chains: each links with the one before it and not with the first, whose buckets they share.
        for _ in range(6):
            source = [word() for _ in range(max(1, n // 60))] + source[: n - max(1, n // 60)]
            out.append(" ".join(source))
    r.shuffle(out)
    return out


def test_link(spark):
    rows = [(r[0], r[1]) for r in data.rows()]
    rows += [(1000 + i, t) for i, t in enumerate(near())]
    frame = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, word string, n int").repartition(5)
    got = sorted((tuple(r) for r in jaccard_join.link(frame, **FOUR).collect()), key=str)
    assert got == brute(rows)
    assert len({r[2] for r in got}) < len(got) - 40
    assert jaccard_join.link(frame.limit(0)).count() == 0
    stay = sorted(r["doc_id"] for r in jaccard_join.representatives(frame, **FOUR).collect() if r["doc_id"] is not None)
    assert stay == sorted(r[0] for r in got if r[0] is not None and r[2] == r[0])


def test_a_link_behind_the_first_member(spark, monkeypatch):
    """Members that link with each other but not with the smallest member of any bucket are found by the second pass."""
    rows = [(i, t) for i, t in enumerate(near(5))]
    monkeypatch.setattr(jaccard_join, "slack", lambda d: 0)
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted((tuple(r) for r in jaccard_join.link(frame, **FOUR).collect()), key=str) == brute(rows)


def test_frequent_words_and_chunks(spark, monkeypatch):
    """Buckets of their own for nearly every shared word, and hubs with many chunks, find the same components and all links."""
    monkeypatch.setattr(jaccard_join, "FREQUENT", 2)
    monkeypatch.setattr(jaccard_join, "CHUNK", 2)
    texts = [*near(9), *near(9)[:7], "", None]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    assert sorted((tuple(r) for r in jaccard_join.link(frame, **FOUR).collect()), key=str) == brute(list(enumerate(texts)))
    pairs, member = jaccard_join.links(frame, **FOUR)
    rep = {r["id"]: r["rep"] for r in member.collect()}
    sets = {i: shingles(t) for i, t in enumerate(texts) if shingles(t)}
    assert rep == {i: min(j for j in sets if sets[j] == x) for i, x in sets.items()}
    reps = sorted(set(rep.values()))
    want = {(i, j) for i in reps for j in reps if i < j and 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j])}
    assert sorted(tuple(r) for r in pairs.collect()) == sorted(want)


def test_sharing(spark):
    """Texts with too many shingles of their own leave the second pass; those that may link stay."""
    texts = {i: t for i, t in enumerate(near(3)) if t}
    sets = {i: shingles(t) for i, t in texts.items()}
    rows = spark.createDataFrame(list(texts.items()), "id long, text string")
    known = spark.createDataFrame([(i, len(x)) for i, x in sets.items()], "id long, n long")
    shared = {i: sum(any(s in y for j, y in sets.items() if j != i) for s in x) for i, x in sets.items()}
    got = sorted(r["id"] for r in jaccard_join.sharing(rows, known, 4, 85, 100).collect())
    assert got == sorted(i for i, x in sets.items() if 100 * shared[i] >= 85 * len(x)) and len(got) < len(texts)


def test_components(spark):
    r = random.Random(2)
    edges = [(i, i + 1) for i in range(100, 160)] + [(r.randrange(400, 600), r.randrange(400, 600)) for _ in range(120)] + [(0, i) for i in range(10, 60)]
    root = {}
    for a, b in edges:
        ra, rb = root.setdefault(a, {a}), root.setdefault(b, {b})
        if ra is not rb:
            ra |= rb
            for x in rb:
                root[x] = ra
    got = {r["id"]: r["component"] for r in jaccard_join.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: min(s) for x, s in root.items() if x != min(s)}


def test_sketches_bound_the_difference():
    r = np.random.default_rng(4)
    for _ in range(50):
        x = r.integers(0, 2**63, 120).astype(np.uint64)
        y = np.concatenate([x[r.integers(0, 40) :], r.integers(0, 2**63, r.integers(0, 30)).astype(np.uint64)])
        d = len(np.setxor1d(x, y))
        assert (jaccard_join.sketch_words(x, 37, 2) != jaccard_join.sketch_words(y, 37, 2)).sum() <= d
        bits = np.unpackbits((jaccard_join.prune_bits(x) ^ jaccard_join.prune_bits(y)).view(np.uint8)).sum()
        assert bits <= d
    for a in range(1, 400):
        for b in range(a, a * 100 // 85 + 1):
            assert any(low <= a and b <= most and (a + b) * 15 // 185 <= d for low, most, d in jaccard_join.bands(85, 100, 900))


def test_words_stand_alone():
    import pyarrow as pa

    texts = ["a bé  c", None, "", "\x0bx\n", "a", "bé c a"]
    (_, _, d, offsets), = kernel.groups(pa.array(texts))
    s, e, at = kernel.words(d, offsets)
    got = [[bytes(d[i:j]) for i, j in zip(s[a:b], e[a:b])] for a, b in zip(at[:-1], at[1:])]
    assert got == [(t or "").encode().split() for t in texts]
    h = kernel.span_hashes(d, s, e)
    assert h[0] == h[4] == h[-1] and len(set(h.tolist())) == 4


def test_growing_sketches_bound_the_difference():
    r = np.random.default_rng(5)
    for n in (1, 3, 40, 900, 5000):
        x = r.integers(0, 2**63, n).astype(np.uint64)
        for keep in (n, n * 4 // 5, n // 2, 0):
            y = np.concatenate([x[:keep], r.integers(0, 2**63, n // 4).astype(np.uint64)])
            if len(y):
                a, b = (np.frombuffer(jaccard_join.fine_bits(z, 80, 100), np.uint64) for z in (x, y))
                d = len(np.setxor1d(x, y))
                found = jaccard_join.fine_differing(a, b)
                assert found == jaccard_join.fine_differing(b, a) <= d
                limit = (len(x) + len(y)) * 20 / 180
                assert n < 900 or found > limit or d < 1.5 * limit


def test_long_texts_are_hashed_in_pieces(monkeypatch):
    import pyarrow as pa

    long = " ".join(["w" * (i % 50) + str(i % 977) for i in range(80_000)])
    texts = pa.array([long, "x" * (3 * kernel.GROUP_BYTES) + " tail", "short one", long + " more"])
    assert len(long) > kernel.GROUP_BYTES
    whole = list(jaccard_join.sets(texts, 4))
    assert len(kernel._powers[0]) <= kernel.GROUP_BYTES + 1
    monkeypatch.setattr(kernel, "GROUP_BYTES", 1 << 24)
    monkeypatch.setattr(kernel, "_powers", [])
    again = list(jaccard_join.sets(texts, 4))
    assert all((a == b).all() for a, b in zip(whole, again, strict=True))
    w = long.split()
    assert len(whole[0]) == len(set(zip(w, w[1:], w[2:], w[3:]))) and len(np.intersect1d(whole[0], whole[3])) == len(whole[0])


def test_least_shared_words():
    """Texts that link share at least so many words in each band that both are in."""
    r = np.random.default_rng(8)
    table = list(jaccard_join.bands(80, 100, 3000))
    for n in (3, 8, 20, 60, 300, 1200):
        for _ in range(12):
            x = r.integers(0, 2**63, n).astype(np.uint64)
            d = int(r.integers(0, 2 * n * 20 // 180 + 1))
            y = np.concatenate([x[d // 2 :], r.integers(0, 2**63, d - d // 2).astype(np.uint64)])
            if 100 * len(np.intersect1d(x, y)) < 80 * len(np.union1d(x, y)):
                continue
            shared = []
            for j, (low, most, k) in enumerate(table):
                if low <= min(len(x), len(y)) and max(len(x), len(y)) <= most and k > 0:
                    a, b = (jaccard_join.sketch_words(z, k + 1 + jaccard_join.slack(k), j) for z in (x, y))
                    both_whole = all((z == 0).sum() > jaccard_join.slack(k) for z in (a, b))
                    shared.append(int(((a == b) & ((a != 0) | both_whole)).sum()))
            assert not shared or max(shared) >= max(jaccard_join.least_shared(z, table) for z in (x, y))
