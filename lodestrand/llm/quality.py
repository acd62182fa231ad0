"""Quality classifier: random-indexing word vectors pooled per document, then a two-layer numpy network.

Words are runs of letters and digits and runs of other signs.  Each word bucket has a sparse ternary index
vector, fixed by its number; its context vector is the sum of the index vectors of its neighbours over the
training texts, scaled to unit length.  A word's vector is the sum of both, and a pair of neighbours is bound by the
product of their vectors, which keeps what stands beside what.  A document's features are the direction of the mean
of its words' vectors and the mean of its pairs' vectors; there are no others.
The network has one hidden layer and a logistic output, is trained by mini-batch gradient descent with momentum
on a bounded sample of labelled rows (at most ``max_rows``), and its logit is divided by a temperature fitted on a
held-back fifth.  The sample's texts stay on the executors: contexts are summed and texts pooled there, and what
reaches the driver are the word buckets' sums and one feature row for each sampled row.

Defined cases: a null or empty text has zero features and a score like any; without labelled rows, or with one
class only, the score is that class's share (0.5 without rows); null labels and labels without doc_id are not
learned; several labels of one doc_id count as their maximum, and of several texts under it one is learned, chosen
by hash; texts are read whole; repeated rows get equal scores; other columns are carried along, those named like an
added one are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestrand.llm.scratch import table, without
from lodestrand.llm.textkit import RUNS, U, Words, mix, slices

LOG_BUCKETS, DIM, HIDDEN, REACH = 15, 64, 32, 2
_FEATURES = 2 * DIM
_WORDS = 1 << 13


@dataclass
class Model:
    vectors: np.ndarray
    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float


def index_vectors() -> np.ndarray:
    """Four entries of +1 or -1 for each bucket, drawn from a hash of its number."""
    n = 1 << LOG_BUCKETS
    out = np.zeros((n, DIM), np.float32)
    for j in range(4):
        h = mix(np.arange(n, dtype=U), 97 + j)
        out[np.arange(n), (h % U(DIM)).astype(np.int64)] += np.where(h >> U(63), 1, -1)
    return out


def _buckets(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    w = Words(texts, kinds=RUNS)
    return (w.values >> U(64 - LOG_BUCKETS)).astype(np.int64), w.first


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of neighbours' index vectors over a task's texts, a row for each bucket that occurs."""
    index = index_vectors()
    total = np.zeros(index.shape)
    for whole in batches:
        for batch in slices(whole, "text"):
            bucket, first = _buckets(batch["text"])
            row = np.repeat(np.arange(len(first) - 1), np.diff(first))
            for step in range(1, REACH + 1):
                same = row[step:] == row[:-step]
                a, b = bucket[:-step][same], bucket[step:][same]
                np.add.at(total, a, index[b])
                np.add.at(total, b, index[a])
    used = np.flatnonzero(total.any(1))
    yield pa.record_batch([pa.array(used), pa.array([x.tobytes() for x in total[used]], pa.binary())], names=["bucket", "total"])


def _add_up(group: pa.Table) -> pa.Table:
    bucket = group["bucket"].to_numpy()
    each, at = np.unique(bucket, return_inverse=True)
    total = np.zeros((len(each), DIM))
    np.add.at(total, at, np.frombuffer(b"".join(group["total"].to_pylist())).reshape(-1, DIM))
    return pa.table({"bucket": pa.array(each), "total": pa.array([x.tobytes() for x in total], pa.binary())})


def word_vectors(texts: DataFrame) -> np.ndarray:
    """Index and context vectors of all buckets; the contexts (whole numbers) add up alike in any order."""
    sums = texts.select("text").mapInArrow(_contexts, "bucket long, total binary")
    found = sums.groupBy(F.expr("bucket div 1024")).applyInArrow(_add_up, "bucket long, total binary").toArrow()
    index = index_vectors()
    context = np.zeros(index.shape)
    if found.num_rows:
        context[found["bucket"].to_numpy()] = np.frombuffer(b"".join(found["total"].to_pylist())).reshape(-1, DIM)
    return (index + context / np.maximum(np.linalg.norm(context, axis=1, keepdims=True), 1e-6)).astype(np.float32)


def pool(bucket: np.ndarray, first: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Features of each row; a long row is summed a few thousand words at a time."""
    n = np.diff(first)
    mean, pairs = np.zeros((len(n), DIM)), np.zeros((len(n), DIM))
    for i, (start, end) in enumerate(zip(first[:-1].tolist(), first[1:].tolist(), strict=True)):
        for a in range(start, end, _WORDS):
            b = min(a + _WORDS, end)
            v = vectors[bucket[a : min(b + 1, end)]]
            mean[i] += v[: b - a].sum(0)
            pairs[i] += np.einsum("ij,ij->j", v[:-1], v[1:])
    pairs /= np.maximum(n[:, None] - 1, 1)
    return np.column_stack([mean / np.maximum(np.linalg.norm(mean, axis=1, keepdims=True), 1e-6), pairs])


def _pooled(vectors):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                x = pool(*_buckets(batch["text"]), vectors.value)
                yield pa.record_batch([batch["doc_id"], batch["quality"], pa.array([r.tobytes() for r in x], pa.binary())], names=["doc_id", "quality", "x"])

    return run


def fit(docs: DataFrame, labels: DataFrame, train: Column, max_rows: int = 4000, epochs: int = 60, seed: int = 9) -> Model:
    """Learn label ``quality`` of at most ``max_rows`` labelled rows (by a hash of doc_id) where ``train`` holds."""
    known = labels.where(train & F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    # At most max_rows rows, so it may be sent to every executor.
    picked = known.orderBy(F.xxhash64(F.col("doc_id"), F.lit(3)), "doc_id").limit(max_rows)
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(picked), "doc_id")
    rows = table(rows.groupBy("doc_id", F.col("quality").cast("double").alias("quality")).agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text")), "labelled")
    vectors = word_vectors(rows)
    held_vectors = docs.sparkSession.sparkContext.broadcast(vectors)
    found = rows.mapInArrow(_pooled(held_vectors), "doc_id long, quality double, x binary").toArrow().sort_by("doc_id")
    y = found["quality"].to_numpy()
    x = np.frombuffer(b"".join(found["x"].to_pylist())).reshape(-1, _FEATURES)
    if len(set(y.tolist())) < 2:
        p = float(np.clip(y.mean() if len(y) else 0.5, 1e-3, 1 - 1e-3))
        return Model(vectors, np.zeros(_FEATURES), np.ones(_FEATURES), np.zeros((_FEATURES, HIDDEN)), np.zeros(HIDDEN), np.zeros(HIDDEN), float(np.log(p / (1 - p))), 1.0)
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(y))
    x, y = x[order], y[order]
    held = len(y) // 5
    mean, scale = x[held:].mean(0), x[held:].std(0) + 1e-6
    x = (x - mean) / scale
    w1, b1 = rng.normal(size=(_FEATURES, HIDDEN)) / np.sqrt(_FEATURES), np.zeros(HIDDEN)
    w2, b2 = rng.normal(size=HIDDEN) / np.sqrt(HIDDEN), np.zeros(1)
    params, speed = [w1, b1, w2, b2], [np.zeros_like(p) for p in (w1, b1, w2, b2)]
    for epoch in range(epochs):
        step = 0.1 * (1 - epoch / epochs)
        order = held + rng.permutation(len(y) - held)
        for a in range(0, len(order), 32):
            i = order[a : a + 32]
            h = np.tanh(x[i] @ w1 + b1)
            g = (1 / (1 + np.exp(-np.clip(h @ w2 + b2, -500, 500))) - y[i]) / len(i)
            back = np.outer(g, w2) * (1 - h * h)
            for p, s, d in zip(params, speed, (x[i].T @ back + 1e-4 * w1, back.sum(0), h.T @ g + 1e-4 * w2, np.array([g.sum()])), strict=True):
                s *= 0.9
                s -= step * d
                p += s
    check = slice(0, held) if held else slice(None)
    z = np.tanh(x[check] @ w1 + b1) @ w2 + b2
    # Smoothed targets, so that held-back rows without an error don't ask for a temperature of zero.
    grid, soft = np.geomspace(0.05, 20, 60), 1 / (2 * len(z))
    loss = [np.mean((1 - soft) * np.logaddexp(0, np.where(y[check] > 0, -z, z) / t) + soft * np.logaddexp(0, np.where(y[check] > 0, z, -z) / t)) for t in grid]
    return Model(vectors, mean, scale, w1, b1, w2, float(b2[0]), float(grid[int(np.argmin(loss))]))


def _score(model, text_at: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        for whole in batches:
            for batch in slices(whole, whole.schema.names[text_at]):
                x = (pool(*_buckets(batch.column(text_at)), m.vectors) - m.mean) / m.scale
                z = (np.tanh(x @ m.w1 + m.b1) @ m.w2 + m.b2) / m.temperature
                yield pa.record_batch([*batch.columns, pa.array(1 / (1 + np.exp(-np.clip(z, -500, 500))))], names=[*batch.schema.names, "score"])

    return run


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with ``score``, the probability of label 1."""
    docs = without(docs, "score")
    # The model's size is fixed by its constants.
    held = docs.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType([*docs.schema.fields, T.StructField("score", T.DoubleType())])
    return docs.mapInArrow(_score(held, [c.lower() for c in docs.columns].index("text")), schema)
