"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

score = sigmoid(b + sum w_i x_i + sum_{i<j} <v_i, v_j> x_i x_j). The pairwise
sum is half of sum_f ((sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2), so a document
costs its number of features times the rank.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as C
from . import kernel

U = np.uint64
#: Buckets of hashed words, and the rank of the interactions.
BUCKETS, RANK = 1 << 14, 8
#: About so many labelled rows are fitted, chosen by hash; all if there are fewer.
MAX_TRAIN = 6000
UPDATES, BATCH, RATE, DECAY = 1500, 128, 0.08, 1e-4

STATS = ("log_words", "word_length", "upper", "digit", "symbol", "mark", "bang", "pipe", "high", "dup_lines", "distinct", "short", "line_length", "marked_words")
CLASSES = np.zeros((256, 7), bool)
for _i, _chars in enumerate((b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b"#*$%&<>", b".,;:?()'\"-", b"!", b"|")):
    CLASSES[list(_chars), _i] = True
CLASSES[128:, 6] = True


def spans_of(flag: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sum of flag between consecutive offsets."""
    return np.diff(np.concatenate([[0], np.cumsum(flag, dtype=np.int64)])[offsets])


def features(texts: pa.Array, metadata: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Index, value and row offsets of the features of runs of texts. metadata: a row of numbers for each text, 0 or more each."""
    for first, last, data, offsets in kernel.groups(texts):
        n = last - first
        start, end, at = kernel.words(data, offsets)
        h = kernel.span_hashes(data, start, end, kernel.LOWER)
        n_words = np.diff(at)
        doc = np.repeat(np.arange(n), n_words)
        key, count = np.unique((doc << 32) | (h % U(BUCKETS)).astype(np.int64), return_counts=True)
        row, bucket, value = key >> 32, key & 0xFFFFFFFF, np.log1p(count)
        value = value / np.sqrt(np.bincount(row, value**2, n))[row]

        size = np.maximum(1, np.diff(offsets))
        share = [spans_of(CLASSES[data, i], offsets) / size for i in range(7)]
        upper, digit, symbol, mark, bang, pipe, high = share
        new = np.zeros(len(data) + 1, bool)
        new[offsets] = True
        new[1:] |= np.append(data[:-1] == 10, False) if len(data) else False
        line = np.flatnonzero(new[: len(data)])
        line_hash = kernel.span_hashes(data, line, np.append(line[1:], len(data))) if len(line) else np.empty(0, U)
        line_doc = np.searchsorted(offsets, line, "right") - 1
        lines = np.bincount(line_doc, minlength=n)
        pairs = np.unique(np.stack([line_doc.astype(U), line_hash]), axis=1)[0].astype(np.int64) if len(line) else np.empty(0, np.int64)
        dup = 1 - np.bincount(pairs, minlength=n) / np.maximum(1, lines)
        words = np.maximum(1, n_words)
        marked = np.bincount(doc, (CLASSES[data[end - 1], 2] | CLASSES[data[end - 1], 4]) if len(end) else None, n) / words if len(end) else np.zeros(n)
        stats = np.stack([
            np.log1p(n_words) / 10, np.bincount(doc, end - start, n) / words / 10, upper * 2, digit * 5, symbol * 5, mark * 5, bang * 10, pipe * 10, high,
            dup, np.bincount(row, minlength=n) / words, n_words < 20, size / np.maximum(1, lines) / 1000, marked,
        ], axis=1)
        dense = np.minimum(2, np.concatenate([stats, np.log1p(metadata[first:last]) / 12], axis=1))
        m = dense.shape[1]
        index = np.concatenate([bucket, np.tile(np.arange(BUCKETS, BUCKETS + m), n)])
        value = np.concatenate([value, dense.ravel()])
        owner = np.concatenate([row, np.repeat(np.arange(n), m)])
        order = np.argsort(owner, kind="stable")
        yield index[order], value[order].astype(np.float32), np.searchsorted(owner[order], np.arange(n + 1))


@dataclass
class Machine:
    bias: float
    w: np.ndarray
    v: np.ndarray

    def parts(self, index: np.ndarray, value: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Logits of the rows, and the sums of v x that the gradient needs. Every row has features."""
        vx = self.v[index] * value[:, None]
        s = np.add.reduceat(vx, at[:-1], axis=0)
        q = np.add.reduceat((vx * vx).sum(1), at[:-1])
        return self.bias + np.add.reduceat(self.w[index] * value, at[:-1]) + 0.5 * ((s * s).sum(1) - q), s

    def scores(self, index: np.ndarray, value: np.ndarray, at: np.ndarray) -> np.ndarray:
        z = self.parts(index, value, at)[0].astype(np.float64)
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def train(rows: Sequence[tuple[int, np.ndarray, np.ndarray]], n_features: int) -> Machine:
    """Fit to (label, index, value) by AdaGrad on the logistic loss; the same rows in the same order give the same machine."""
    r = np.random.default_rng(0)
    m = Machine(0.0, np.zeros(n_features, np.float32), r.normal(0, 0.02, (n_features, RANK)).astype(np.float32))
    if not rows:
        return m
    y = np.array([x[0] for x in rows], np.float32)
    mean = np.clip(y.mean(), 0.02, 0.98)
    m.bias = float(np.log(mean / (1 - mean)))
    gw, gv, gb = np.full(n_features, 1e-2, np.float32), np.full((n_features, RANK), 1e-2, np.float32), 1e-2
    order = np.empty(0, np.int64)
    for _ in range(UPDATES):
        if not len(order):
            order = r.permutation(len(rows))
        some, order = order[:BATCH], order[BATCH:]
        index, value = np.concatenate([rows[j][1] for j in some]), np.concatenate([rows[j][2] for j in some])
        at = np.concatenate([[0], np.cumsum([len(rows[j][1]) for j in some])])
        z, s = m.parts(index, value, at)
        e = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[some]) / len(some)
        ex = np.repeat(e, np.diff(at)) * value
        there, back = np.unique(index, return_inverse=True)
        dw = np.bincount(back, ex, len(there)) + DECAY * m.w[there]
        sx = np.repeat(s, np.diff(at), axis=0)
        g = ex[:, None] * (sx - m.v[index] * value[:, None])
        dv = np.stack([np.bincount(back, g[:, f], len(there)) for f in range(RANK)], axis=1) + DECAY * m.v[there]
        gw[there] += dw**2
        gv[there] += dv**2
        gb += float(e.sum()) ** 2
        m.w[there] -= RATE * dw / np.sqrt(gw[there])
        m.v[there] -= RATE * 0.5 * dv / np.sqrt(gv[there])
        m.bias -= RATE * float(e.sum()) / gb**0.5
    return m


def numbers(b: pa.RecordBatch, metadata: Sequence[str]) -> np.ndarray:
    return np.stack([np.maximum(0, b.column(c).cast(pa.float64()).fill_null(0).to_numpy(zero_copy_only=False)) for c in metadata], axis=1) if metadata else np.zeros((b.num_rows, 0))


def fit(docs: DataFrame, labels: DataFrame, *, key: str = "doc_id", text: str = "text", label: str = "quality", learn_from: Column | None = None, metadata: dict[str, Column] | None = None) -> Machine:
    """A machine fitted to the labelled rows of docs that learn_from allows (a condition on labels), about MAX_TRAIN of them at most, by hash of the key.

    Features are computed on the executors; MAX_TRAIN rows of them go to the driver. Null labels, keys without a document and documents without a label are ignored.
    Without rows the machine scores 0.5.
    """
    C.short_batches(docs.sparkSession)
    metadata = metadata or {}
    known = labels.where(F.col(label).isNotNull() & F.col(key).isNotNull() & (F.lit(True) if learn_from is None else learn_from))
    known = known.select(F.col(key).alias("key"), F.col(label).cast("int").alias("y")).groupBy("key").agg(F.max("y").alias("y"))
    n = known.count()
    chosen = known.where(F.pmod(F.xxhash64("key", F.lit(1)), F.lit(1 << 20)) < int((1 << 20) * min(1.0, MAX_TRAIN / max(1, n))))
    given = docs.select(F.col(key).alias("key"), F.col(text).alias("text"), *[c.cast("double").alias(f"m_{k}") for k, c in metadata.items()])
    given = given.join(F.broadcast(chosen), "key")  # about MAX_TRAIN rows
    names = [f"m_{k}" for k in metadata]

    def run(batches):
        for b in batches:
            out = {"key": b.column("key"), "y": b.column("y")}
            index, value = [], []
            for i, x, at in features(b.column("text"), numbers(b, names)):
                index += [i[p:q].astype(np.int32).tobytes() for p, q in zip(at[:-1], at[1:], strict=True)]
                value += [x[p:q].tobytes() for p, q in zip(at[:-1], at[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([*out.values(), pa.array(index, pa.binary()), pa.array(value, pa.binary())], ["key", "y", "index", "value"])

    rows = given.select("key", "y", "text", *names).mapInArrow(run, f"key {dict(given.dtypes)['key']}, y int, index binary, value binary").collect()
    rows = sorted((r["key"], r["y"], bytes(r["index"]), bytes(r["value"])) for r in rows)
    return train([(y, np.frombuffer(i, np.int32), np.frombuffer(x, np.float32)) for _, y, i, x in rows], BUCKETS + len(STATS) + len(names))


def score(docs: DataFrame, machine: Machine, *, text: str = "text", keep: tuple[str, ...] = ("doc_id",), metadata: dict[str, Column] | None = None) -> DataFrame:
    """row (a struct of the columns keep) and score, 0 to 1, for each row of docs.

    Results: null texts score like empty ones; null metadata count as 0; repeated rows score alike; an empty table gives no rows; columns may have any names.
    """
    C.short_batches(docs.sparkSession)
    metadata = metadata or {}
    names = [f"m_{k}" for k in metadata]
    given = docs.select(F.struct(*[F.col(c) for c in keep]).alias("row"), F.col(text).alias("text"), *[c.cast("double").alias(f"m_{k}") for k, c in metadata.items()])

    def run(batches):
        for b in batches:
            scores = [machine.scores(*x) for x in features(b.column("text"), numbers(b, names))]
            yield pa.RecordBatch.from_arrays([b.column("row"), pa.array(np.concatenate(scores) if scores else np.empty(0), pa.float64())], ["row", "score"])

    return given.mapInArrow(run, f"row {given.schema['row'].dataType.simpleString()}, score double")
