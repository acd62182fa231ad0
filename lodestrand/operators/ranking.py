"""Ranked retrieval: exact top-k, collapse to shots, rank fusion, roll-up, normalisation and sampling.

Every ranking has a total order: score descending, then key ascending.
"""

from __future__ import annotations

import time
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Default weights of the sources.
DEFAULT_WEIGHTS = {"siglip": 1.0, "jina": 1.0, "asr": 0.8, "ocr": 0.5}


def effective_weights(weights: dict[str, float] | None, only: set[str] | None = None) -> dict[str, float]:
    """Weights of the sources that take part: defaults if none are given, others than ``only`` off, none at 0."""
    chosen = weights or DEFAULT_WEIGHTS
    return {s: float(w) for s, w in chosen.items() if w and w > 0 and (only is None or s in only)}


def _best(ids: np.ndarray, matrix: np.ndarray, k: int, least: float | None):
    """mapInArrow function: the best k points of a partition for each query; matrix has a column for each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = [np.zeros(0, np.int64)] * len(ids)
        scores = [np.zeros(0)] * len(ids)
        for batch in batches:
            if not batch.num_rows:
                continue
            vec = batch.column(1)
            x = vec.values.to_numpy(zero_copy_only=False)[vec.offsets[0].as_py() : vec.offsets[-1].as_py()].reshape(batch.num_rows, -1).astype(np.float64)
            s = x[:, : matrix.shape[0]] @ matrix
            key = batch.column(0).to_numpy(zero_copy_only=False)
            for q in range(len(ids)):
                ok = np.arange(len(key)) if least is None else np.flatnonzero(s[:, q] >= least)
                if len(ok) > 4 * k:
                    cut = np.partition(s[ok, q], len(ok) - k)[len(ok) - k]
                    ok = ok[s[ok, q] >= cut]
                a, b = np.concatenate([keys[q], key[ok]]), np.concatenate([scores[q], s[ok, q]])
                top = np.lexsort((a, -b))[:k]
                keys[q], scores[q] = a[top], b[top]
        n = [len(x) for x in keys]
        yield pa.record_batch([pa.array(np.repeat(ids, n)), pa.array(np.concatenate(keys)), pa.array(np.concatenate(scores))], names=["query_id", "key", "score"])

    return run


def vector_topk(points: DataFrame, queries: DataFrame, key: str, vector: str, k: int, least: float | None = 0.0, dims: int | None = None) -> DataFrame:
    """query_id, key, score, rank: the k points of greatest dot product for each query, scores under ``least`` off.

    ``queries`` (query_id, vector) is a stated set that fits in memory; each partition of points is one matrix
    product and hands on k rows for each query at most, so the shuffle doesn't grow with the points.
    """
    rows = queries.select("query_id", vector).orderBy("query_id").collect()
    ids = np.array([r[0] for r in rows], np.int64)
    matrix = np.array([r[1] for r in rows], np.float64).reshape(len(rows), -1)[:, :dims].T if rows else np.zeros((dims or 1, 0))
    scored = points.where(F.col(vector).isNotNull()).select(F.col(key).cast("long").alias("key"), vector).mapInArrow(_best(ids, matrix, k, least), "query_id long, key long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "key")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).withColumnRenamed("key", key)


class CachedSearch:
    """Top-k by a single vector over one table of points, with answers kept for ``seconds``.

    An answer is kept under everything that it depends on: the whole vector, k, the least score and the filter.
    """

    def __init__(self, points: DataFrame, key: str, vector: str, seconds: float = 300.0, clock=time.monotonic):
        self.points, self.key, self.vector, self.seconds, self.clock = points, key, vector, seconds, clock
        self.kept: dict[tuple, tuple[float, list]] = {}

    def search(self, wanted: list[float], k: int, least: float | None = 0.0, where: str | None = None) -> list[tuple]:
        """(key, score) of the k best points that meet ``where``, a condition in SQL."""
        now = self.clock()
        self.kept = {q: a for q, a in self.kept.items() if now - a[0] < self.seconds}
        asked = (tuple(wanted), k, least, where)
        if asked not in self.kept:
            points = self.points.where(where) if where else self.points
            query = points.sparkSession.createDataFrame([(0, [float(x) for x in wanted])], f"query_id long, {self.vector} array<double>")
            rows = vector_topk(points, query, self.key, self.vector, k, least).orderBy("rank").collect()
            self.kept[asked] = (now, [(r[self.key], r["score"]) for r in rows])
        return self.kept[asked][1]


def collapse(hits: DataFrame, by: list[str], ties: list[str | Column], score: str = "score") -> DataFrame:
    """The best hit of each group; hits with a null in ``by`` go first."""
    order = Window.partitionBy(*by).orderBy(F.desc(score), *ties)
    kept = hits
    for c in by:
        kept = kept.where(F.col(c).isNotNull())
    return kept.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def ranked(hits: DataFrame, ties: list[str], by: tuple[str, ...] = ("query_id", "source")) -> DataFrame:
    """rank 1..n by score within a source; a hit without path takes up a rank as well."""
    return hits.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("score"), *ties)))


def _weight(weights: dict[str, float]) -> Column:
    if not weights:
        return F.lit(1.0)
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in weights.items() for x in kv]), F.col("source")), F.lit(1.0)).cast("double")


def rrf(hits: DataFrame, weights: dict[str, float], k: int = 60, top: int | None = None, key: str = "file_path", ties: tuple[str, ...] = ("file_path",)) -> DataFrame:
    """query_id, key, score, rrf_components: weighted reciprocal rank fusion of the sources' hits."""
    scored = ranked(hits, list(ties)).where(F.col(key).isNotNull()).withColumn("_s", _weight(weights) / (F.lit(float(k)) + F.col("rank")))
    fused = scored.groupBy("query_id", key).agg(F.sum("_s").alias("score"), F.array_sort(F.collect_set("source")).alias("rrf_components"))
    return limit_each(fused, top, [key]) if top else fused


def srrf(hits: DataFrame, weights: dict[str, float], k: int = 60, beta: float = 0.5, top: int | None = None, key: str = "file_path", ties: tuple[str, ...] = ("file_path",)) -> DataFrame:
    """As rrf(), each term mixed with the score's place between its source's least and greatest."""
    span = Window.partitionBy("query_id", "source")
    low, high = F.min("score").over(span), F.max("score").over(span)
    place = (F.col("score") - low) / F.greatest(high - low, F.lit(1e-9))
    scored = ranked(hits.withColumn("_p", place), list(ties)).where(F.col(key).isNotNull())
    scored = scored.withColumn("_s", _weight(weights) * (F.lit(1.0 - beta) / (F.lit(float(k)) + F.col("rank")) + F.lit(beta) * F.col("_p")))
    fused = scored.groupBy("query_id", key).agg(F.sum("_s").alias("score"), F.array_sort(F.collect_set("source")).alias("rrf_components"))
    return limit_each(fused, top, [key]) if top else fused


def limit_each(rows: DataFrame, top: int, ties: list[str], score: str = "score", by: tuple[str, ...] = ("query_id",)) -> DataFrame:
    order = Window.partitionBy(*by).orderBy(F.desc(score), *ties)
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)


def roll_up(fused: DataFrame, shot: list[str], top: int, ties: list[str]) -> DataFrame:
    """The best entry of each shot (not the sum), by score and then number of sources; rank 1..top."""
    many = F.size("rrf_components")
    best = Window.partitionBy("query_id", *shot).orderBy(F.desc("score"), many.desc(), *ties)
    kept = fused
    for c in shot:
        kept = kept.where(F.col(c).isNotNull())
    kept = kept.withColumn("_n", F.row_number().over(best)).where("_n = 1").drop("_n")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), many.desc(), *ties)
    return kept.drop("rank").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)


def in_time_order(shots: DataFrame, ties: list[str], timestamp: str = "timestamp", by: tuple[str, ...] = ("query_id",)) -> DataFrame:
    """position 1..n by time, shots without a time last."""
    return shots.withColumn("position", F.row_number().over(Window.partitionBy(*by).orderBy(F.asc_nulls_last(timestamp), *ties)))


def minmax(score: Column, by: list[str], flat: float, eps: float = 1e-9) -> Column:
    """Place between least and greatest of the group; ``flat`` where the range is under eps."""
    w = Window.partitionBy(*by)
    low, high = F.min(score).over(w), F.max(score).over(w)
    return F.when(high - low < eps, F.lit(flat)).otherwise((score - low) / (high - low))


def share(weights: list[Column]) -> list[Column]:
    """Weights clamped at 0 and divided by their sum; (1, 0, ...) if that is 0."""
    held = [F.greatest(w, F.lit(0.0)) for w in weights]
    total = sum(held[1:], held[0])
    return [F.when(total > 0, w / total).otherwise(F.lit(1.0 if i == 0 else 0.0)) for i, w in enumerate(held)]


def even_sample(rows: DataFrame, k: int, by: list[str], order: list[str]) -> DataFrame:
    """At most k rows of each group, evenly spread: places floor(i n / k)."""
    w = Window.partitionBy(*by)
    numbered = rows.withColumn("_n", F.count("*").over(w)).withColumn("_r", F.row_number().over(w.orderBy(*order)) - 1)
    picks = F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.floor(i * F.col("_n") / F.lit(k)))
    return numbered.where((F.col("_n") <= k) | F.array_contains(picks, F.col("_r").cast("long"))).drop("_n", "_r")


def stride_sample(rows: DataFrame, step: int, by: list[str], order: list[str]) -> DataFrame:
    """Every step-th row of each group, from the first."""
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy(*by).orderBy(*order)) - 1).where(F.col("_r") % step == 0).drop("_r")


def first_middle_last(rows: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """Places 0, n // 2 and n - 1 of each ordered group, once each; ``pick`` numbers them."""
    w = Window.partitionBy(*by)
    numbered = rows.withColumn("_n", F.count("*").over(w)).withColumn("_r", F.row_number().over(w.orderBy(*order)) - 1)
    kept = numbered.where((F.col("_r") == 0) | (F.col("_r") == F.expr("_n div 2")) | (F.col("_r") == F.col("_n") - 1))
    return kept.withColumn("pick", F.row_number().over(w.orderBy("_r"))).drop("_n", "_r")
