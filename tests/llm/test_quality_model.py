"""The factorisation machine: the identity against all pairs, and accuracy on rows it has not seen."""

import itertools
import zlib

import numpy as np
import pyarrow as pa
from lamella.llm import quality_model as Q
from lamella.llm import queries
from pyspark.sql import functions as F

from . import data


def test_pairs():
    r = np.random.default_rng(3)
    m = Q.Machine(0.3, r.normal(size=50), r.normal(size=(50, 4)))
    index, value = r.integers(0, 50, 12), r.normal(size=12)
    at = np.array([0, 5, 12])
    for z, (a, b) in zip(m.parts(index, value, at)[0], ((0, 5), (5, 12)), strict=True):
        i, x = index[a:b], value[a:b]
        pairs = sum(m.v[i[p]] @ m.v[i[q]] * x[p] * x[q] for p, q in itertools.combinations(range(b - a), 2))
        assert np.isclose(z, 0.3 + m.w[i] @ x + pairs)


def test_features_do_not_depend_on_neighbours():
    texts = data.texts()
    whole = [(i[p:q].tolist(), v[p:q].tolist()) for i, v, at in Q.features(pa.array(texts), np.ones((len(texts), 1))) for p, q in zip(at[:-1], at[1:])]
    for t, want in zip(texts, whole, strict=True):
        ((i, v, _),) = Q.features(pa.array([t]), np.ones((1, 1)))
        assert (i.tolist(), v.tolist()) == want


def test_held_out(spark):
    got = queries.op7_quality_model(spark, "/root/testdata/sf0.01")
    again = queries.op7_quality_model(spark, "/root/testdata/sf0.01")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    rows = got.join(labels, "doc_id").where("held_out").collect()
    assert len(rows) > 50
    good = [r["score"] for r in rows if r["quality"] == 1]
    bad = [r["score"] for r in rows if r["quality"] == 0]
    auc = np.mean([(g > b) + 0.5 * (g == b) for g in good for b in bad])
    right = np.mean([r["predicted"] == r["quality"] for r in rows])
    assert auc > 0.9 and right > 0.9, (auc, right)
    assert got.where("score < 0 or score > 1 or score is null").count() == 0
    assert sorted(got.collect()) == sorted(again.collect())
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)


def test_odd_rows(spark):
    docs = data.documents(spark)
    labels = spark.createDataFrame([(1, 1, 5), (2, 0, 5), (2, None, 5), (None, 1, 5), (10**9, 1, 5)], "doc_id long, quality int, text int")
    m = Q.fit(docs, labels, metadata={"n": F.col("n_chars")})
    assert Q.score(docs, m, metadata={"n": F.col("n_chars")}).count() == len(data.rows())
    none = Q.fit(docs.limit(0), labels)
    assert {r["score"] for r in Q.score(docs, none).collect()} != {None}
    assert Q.score(docs.limit(0), none).count() == 0
