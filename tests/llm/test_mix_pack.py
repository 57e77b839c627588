"""Mixing and packing against brute force and their definitions."""

import itertools
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from lamella.llm import mixing, packing
from pyspark.sql import functions as F

from . import data


def size(text):
    return len((text or "").split())


def water(sizes, weights=(5, 2, 1), share=1.5, most=2):
    """Targets one source at a time: what a source may not take is dealt to the rest again."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    left, out, active = share * sum(sizes.values()), {}, order
    while active:
        s = min(active, key=lambda s: most * sizes[s] / weight[s])
        if left * weight[s] / sum(weight[a] for a in active) <= most * sizes[s]:
            return out | {a: left * weight[a] / sum(weight[b] for b in active) for a in active}
        out[s] = most * sizes[s]
        left -= out[s]
        active.remove(s)
    return out


def targets(spark, sizes):
    frame = spark.createDataFrame(list(sizes.items()), "source string, size long")
    return {r["source"]: r["target"] for r in mixing.targets(frame, (5, 2, 1), 1.5, 2).collect()}


def test_targets(spark):
    sizes = {"a": 100, "b": 100, "c": 100, None: 50, "d": 0}
    got = targets(spark, sizes)
    assert sum(got.values()) == pytest.approx(1.5 * 350)
    assert got["d"] == 0 and got["a"] == 200
    assert got == pytest.approx(water(sizes))
    r = random.Random(1)
    many = {f"s{i}": r.choice([0, 1, 7, 50, 1000, 10**6]) for i in range(400)} | {"é": 3, None: 9, "": 4}
    assert targets(spark, many) == pytest.approx(water(many))
    assert targets(spark, {}) == {}


def test_many_sources(spark, monkeypatch):
    """Far more sources than are broadcast."""
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 10)
    r = random.Random(2)
    rows = [(i, f"s{r.randrange(500)}", r.randrange(1, 60)) for i in range(4000)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, n long")
    got = mixing.mix(docs, F.col("n")).collect()
    sizes, taken, largest, target = Counter(), Counter(), Counter(), {}
    for x in got:
        s = x["row"]["source"]
        sizes[s] += x["size"]
        taken[s] += x["size"] * x["copies"]
        largest[s] = max(largest[s], x["size"])
        target[s] = x["target"]
    assert len(got) == len(rows) and target == pytest.approx(water(dict(sizes)))
    assert all(target[s] - largest[s] < taken[s] <= target[s] + 1e-6 for s in sizes)


def test_one_key_is_parted_by_its_texts(spark):
    docs = spark.createDataFrame([(7, "hot" if i % 3 else None, f"text {i}", 5) for i in range(900)], "doc_id long, source string, text string, n long")
    taken, target = Counter(), {}
    for r in mixing.mix(docs, F.col("n"), ties=F.md5("text")).collect():
        taken[r["row"]["source"]] += r["size"] * r["copies"]
        target[r["row"]["source"]] = r["target"]
    assert all(abs(taken[s] - target[s]) <= 5 for s in target)


def test_mix(spark):
    docs = data.documents(spark).withColumn("n", F.length("text"))
    got = mixing.mix(docs, F.col("n")).collect()
    assert len(got) == len(data.rows())
    total, taken, target, largest = Counter(), Counter(), {}, Counter()
    for r in got:
        s, n = r["row"]["source"], r["row"]["n"] or 0
        assert r["size"] == n and r["copies"] in (0, 1, 2)
        total[s] += n
        taken[s] += n * r["copies"]
        largest[s] = max(largest[s], n)
        target[s] = r["target"]
    want = water(dict(total))
    for s in total:
        assert target[s] == pytest.approx(want[s])
        assert taken[s] <= want[s] + 1e-6
    again = mixing.mix(docs.repartition(3), F.col("n")).collect()
    key = lambda r: (r["row"]["doc_id"], r["copies"])
    assert sorted(map(key, got)) == sorted(map(key, again))
    assert mixing.mix(docs.limit(0), F.col("n")).count() == 0
    assert mixing.take(docs, F.col("n")).count() == sum(r["copies"] for r in got)


def test_ranges_against_a_sort(spark):
    r = random.Random(3)
    rows = [(s, r.randrange(2**60), r.choice([1, 5, 30, 400])) for s in (0, 1) for _ in range(500)]
    budget = {0: 20_123, 1: 9}
    given = spark.createDataFrame(list(budget.items()), "source_id long, room long")
    got = mixing.bounds(spark.createDataFrame(rows, "source_id long, hash long, size long"), given, 2).collect()
    for s, room in budget.items():
        start = 0
        for low, high, largest in sorted(tuple(x)[1:] for x in got if x[0] == s):
            assert (low, largest) == (start, room)
            left = sorted((h, n) for i, h, n in rows if i == s and h >= start and n <= room)
            for h, n in left:
                if n > room:
                    assert high == h
                    break
                room -= n
                assert h < high
            start = high + 1
        assert room <= 400


def plain_boundaries(lengths, count, k):
    """Least padded total by dynamic programming, one step at a time."""
    best = [0] + [float("inf")] * len(lengths)
    for _ in range(k):
        best = [0] + [min([best[j], *(best[i] + sum(count[i:j]) * lengths[j - 1] for i in range(j))]) for j in range(1, len(lengths) + 1)]
    return best[-1]


def padded(ends, lengths, count):
    return sum(n * min(e for e in ends if e >= x) for n, x in zip(count, lengths, strict=True))


def test_boundaries_are_optimal():
    r = random.Random(5)
    for _ in range(30):
        lengths = sorted(r.sample(range(1, 60), 8))
        count = [r.randint(1, 9) for _ in lengths]
        for k in (1, 2, 3, 20):
            ends = packing.boundaries(lengths, count, k)
            assert len(ends) <= k and ends[-1] == lengths[-1] and ends == sorted(ends)
            best = min(padded([*c, lengths[-1]], lengths, count) for m in range(min(k, 8)) for c in itertools.combinations(lengths[:-1], m))
            assert padded(ends, lengths, count) == best
    for n, most in ((1, 9), (2, 900), (90, 5000), (130, 200), (120, 10**6)):
        lengths = sorted(r.sample(range(0, most), n))
        count = [r.choice([1, 1, 2, 40, 3000]) for _ in lengths]
        for k in (1, 2, 5, 16):
            assert padded(packing.boundaries(lengths, count, k), lengths, count) == plain_boundaries(lengths, count, k)


def test_boundaries_of_many_lengths():
    lengths = np.arange(1, 200_001)
    ends = packing.boundaries(lengths, np.ones(200_000, np.int64), 16)
    assert len(ends) == 16 and max(np.diff([0, *ends])) - min(np.diff([0, *ends])) <= 2  # of equal counts, equal steps are best


def test_pack(spark, monkeypatch):
    monkeypatch.setattr(packing, "CHUNK_ROWS", 20)
    docs = data.documents(spark)
    got = packing.pack(docs, F.size(F.split("text", " ")), n_buckets=5, budget=600).collect()
    assert len(got) == len(data.rows())
    batches = defaultdict(list)
    for r in got:
        assert r["n_tokens"] <= r["bucket_len"]
        batches[r["bucket"], r["batch"]].append(r)
    assert len({r["bucket"] for r in got}) == 5
    for (b, i), rows in batches.items():
        per = max(1, 600 // max(1, rows[0]["bucket_len"]))
        assert sorted(r["slot"] for r in rows) == list(range(len(rows)))
        assert len(rows) == per if (b, i + 1) in batches else len(rows) <= per
    assert packing.pack(docs.limit(0), F.length("text")).count() == 0
    assert set(docs.columns) - {"bucket"} <= set(packing.pack(docs, F.length("text")).columns)
