"""Top-k by dot product for large sets of queries: a product of blocks, and an inverted-file index whose pruning is exact.

``block_topk`` deals points into strips and queries into blocks; each pair of them is one matrix product of bounded
size and hands on at most k rows for each query.  Neither side is collected or broadcast.

``build_index`` puts every point into the cell of its nearest centroid, one folder a cell, sorted by the distance r
from it.  A query's product with a point is q.c + q.(x - c), so at most q.c + |q| r.  ``search`` first reads the cells
nearest to a query until they hold k points; the k-th best score there is a threshold, and then only cells whose
greatest r lets a point past it are read, and in them only the points that are far enough out.  The result is that of a
scan, with or without a condition on the points.

Points without a vector take no part; all vectors have one length; ties go to the smaller key, a long that is unique.
Centroids are fitted on a bounded sample, chosen by hash of the key; what is known of them (at most ``MOST_CELLS`` rows)
goes through the driver.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestrand.sources.sinks import new_folder, staged

MOST_CELLS, SAMPLE, ROUNDS = 4096, 20_000, 8
#: Points of a strip and queries of a block, at most about; rows whose products are made together.
STRIP, BLOCK, LOOKED = 1 << 16, 1 << 11, 1 << 21
_SLACK = 1e-9
_FOUND = "query_id long, key long, score double"


def matrix(vectors: pa.Array | pa.ChunkedArray, dims: int | None = None) -> np.ndarray:
    """A list array of vectors of one length, a line for each."""
    if isinstance(vectors, pa.ChunkedArray):
        vectors = vectors.combine_chunks()
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(vectors), -1)[:, :dims] if len(flat) else np.zeros((len(vectors), 0))


def best(keys: np.ndarray, points: np.ndarray, queries: np.ndarray, k: int, least: float | None) -> tuple[np.ndarray, ...]:
    """(query's index, key, score): the k points of greatest product for each query, greater first, then smaller keys."""
    step = max(k, LOOKED // max(len(queries), 1))
    q, key, score = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    for a in range(0, len(keys), step):
        s = points[a : a + step] @ queries.T
        ok = np.ones(s.shape, bool) if least is None else s >= least
        if len(s) > k:
            ok &= s >= np.partition(s, len(s) - k, axis=0)[len(s) - k]
        x, y = np.nonzero(ok)
        q, key, score = np.append(q, y), np.append(key, keys[a + x]), np.append(score, s[x, y])
        order = np.lexsort((key, -score, q))
        first = np.flatnonzero(np.diff(q[order], prepend=-1))
        keep = order[np.arange(len(order)) - np.repeat(first, np.diff(np.append(first, len(order)))) < k]
        q, key, score = q[keep], key[keep], score[keep]
    return q, key, score


def _group(k: int, least: float | None, dims: int | None):
    def run(queries: pa.Table, points: pa.Table) -> pa.Table:
        found = (np.zeros(0, np.int64),) * 2 + (np.zeros(0),)
        if queries.num_rows and points.num_rows:
            q, key, score = best(points["key"].to_numpy(), matrix(points["vec"], dims), matrix(queries["vec"], dims), k, least)
            found = (queries["query_id"].to_numpy()[q], key, score)
        return pa.table({"query_id": pa.array(found[0], pa.int64()), "key": pa.array(found[1], pa.int64()), "score": pa.array(found[2], pa.float64())})

    return run


def _top(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "key")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _dealt(key: str, n: Column) -> Column:
    return F.pmod(F.xxhash64(key), n).cast("int")


def _every(n: Column) -> Column:
    return F.explode(F.sequence(F.lit(0), n.cast("int") - 1))


def _met(queries: DataFrame, points: DataFrame, run) -> DataFrame:
    """``run`` on each block of a cell's queries with each strip of its points; both have cell, strips and blocks."""
    q = queries.withColumn("block", _dealt("query_id", F.col("blocks"))).withColumn("strip", _every(F.col("strips")))
    p = points.withColumn("strip", _dealt("key", F.col("strips"))).withColumn("block", _every(F.col("blocks")))
    by = ["cell", "strip", "block"]
    return q.select(*by, "query_id", "vec").groupBy(*by).cogroup(p.select(*by, "key", "vec").groupBy(*by)).applyInArrow(run, _FOUND)


def block_topk(points: DataFrame, queries: DataFrame, key: str, vector: str, k: int, least: float | None = 0.0, dims: int | None = None, strip: int = STRIP, block: int = BLOCK) -> DataFrame:
    """query_id, key, score, rank: the k points of greatest product for each query, scores under ``least`` off."""
    spark = points.sparkSession
    p = points.where(F.col(vector).isNotNull()).select(F.lit(0).alias("cell"), F.col(key).cast("long").alias("key"), F.col(vector).alias("vec"))
    q = queries.where(F.col(vector).isNotNull()).select(F.lit(0).alias("cell"), F.col("query_id").cast("long").alias("query_id"), F.col(vector).alias("vec"))
    strips = max(-(-p.count() // strip), int(spark.conf.get("spark.sql.shuffle.partitions")))
    size = {"strips": F.lit(strips), "blocks": F.lit(max(1, -(-q.count() // block)))}
    return _top(_met(q.withColumns(size), p.withColumns(size), _group(k, least, dims)), k).withColumnRenamed("key", key)


@dataclass(frozen=True)
class VectorIndex:
    """Points (with cell and r) in folders by cell, and each cell's centroid, number of points and greatest r."""

    rows: DataFrame
    key: str
    vector: str
    centroids: np.ndarray
    counts: np.ndarray
    radius: np.ndarray


def centroids(sample: np.ndarray, cells: int) -> np.ndarray:
    """Means of a sample's nearest-mean groups, after a fixed number of rounds from its first vectors."""
    c = sample[:cells].copy()
    for _ in range(ROUNDS if len(c) else 0):
        near = _nearest(sample, c)[0]
        n = np.bincount(near, minlength=len(c))
        sums = np.zeros_like(c)
        np.add.at(sums, near, sample)
        c[n > 0] = sums[n > 0] / n[n > 0, None]
    return c


def _nearest(x: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centroid of each line, and the distance from it."""
    near = np.argmin((c * c).sum(1) - 2 * (x @ c.T), axis=1)
    return near, np.sqrt(((x - c[near]) ** 2).sum(1))


def _assign(at: int, c: np.ndarray, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                near, r = _nearest(matrix(batch.column(at)), c)
                yield pa.record_batch([*batch.columns, pa.array(near, pa.int32()), pa.array(r)], names=[*names, "cell", "r"])

    return run


def build_index(points: DataFrame, key: str, vector: str, cells: int | None = None, sample: int = SAMPLE) -> VectorIndex:
    """The index of all points that have a vector, with all their columns."""
    spark = points.sparkSession
    points = points.drop("cell", "r").where(F.col(vector).isNotNull())
    n = points.count()
    cells = min(cells or max(1, int(n**0.5)), MOST_CELLS, sample)
    chosen = points.select(vector).orderBy(F.xxhash64(key), key).limit(sample).toArrow()
    c = centroids(matrix(chosen[vector]), cells)
    schema = T.StructType([*points.schema.fields, T.StructField("cell", T.IntegerType()), T.StructField("r", T.DoubleType())])
    placed = points.mapInArrow(_assign(points.columns.index(vector), c, points.columns), schema)
    folder, tasks = new_folder(spark, "vector_index"), max(len(c), -(-n // STRIP), 1)
    part = F.pmod(F.xxhash64(key), F.lit(-(-tasks // max(len(c), 1))))
    placed.repartition(tasks, "cell", part).sortWithinPartitions("cell", "r").write.partitionBy("cell").parquet(folder)
    rows = spark.read.schema(schema).parquet(folder)
    counts, radius = np.zeros(len(c), np.int64), np.zeros(len(c))
    # A row for each cell.
    for r in rows.groupBy("cell").agg(F.count("*").alias("n"), F.max("r").alias("r")).collect():
        counts[r["cell"]], radius[r["cell"]] = r["n"], r["r"]
    return VectorIndex(rows, key, vector, c, counts, radius)


def _first_cells(products: np.ndarray, counts: np.ndarray, k: int) -> np.ndarray:
    """For each query (line) the cells of greatest product with it that together hold k points."""
    order = np.argsort(-products, axis=1, kind="stable")
    before = np.cumsum(counts[order], axis=1) - counts[order]
    out = np.zeros(products.shape, bool)
    np.put_along_axis(out, order, (before < k) & (counts[order] > 0), axis=1)
    return out


def _probes(index: VectorIndex, k: int, later: bool):
    """(query_id, vec, cell, out) of the cells to read for each query at first, or later: those that may hold points past its threshold, from r = out on."""
    c, counts, radius = index.centroids, index.counts, index.radius

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows or not len(c):
                continue
            q = matrix(batch["vec"])
            products, norm = q @ c.T, np.sqrt((q * q).sum(1))[:, None]
            wanted, out = _first_cells(products, counts, k), np.zeros(products.shape)
            if later:
                least = batch["least"].to_numpy(zero_copy_only=False)[:, None]
                slack = _SLACK * (1 + np.abs(products) + norm * radius)
                wanted = ~wanted & (counts > 0) & (products + norm * radius + slack >= least)
                with np.errstate(invalid="ignore", divide="ignore"):
                    out = np.where(norm > 0, np.maximum((least - products - slack) / norm, 0), 0)
            x, cell = np.nonzero(wanted)
            yield pa.record_batch([batch["query_id"].take(pa.array(x)), batch["vec"].take(pa.array(x)), pa.array(cell, pa.int32()), pa.array(out[x, cell])], names=["query_id", "vec", "cell", "out"])

    return run


def _read(index: VectorIndex, probes: DataFrame, where: str | None, k: int, least: float | None) -> DataFrame:
    """The best points of each query in the cells that it probes; only the probed cells' folders are read."""
    # A row for each cell.
    asked = {r["cell"]: (r["n"], r["out"]) for r in probes.groupBy("cell").agg(F.count("*").alias("n"), F.min("out").alias("out")).collect()}
    sizes = [(c, max(1, -(-int(index.counts[c]) // STRIP)), -(-n // BLOCK), float(out)) for c, (n, out) in asked.items()]
    sizes = probes.sparkSession.createDataFrame(sizes, "cell int, strips long, blocks long, far double")
    rows = index.rows.where(F.col("cell").isin(sorted(asked)))
    rows = (rows.where(where) if where else rows).select("cell", "r", F.col(index.key).cast("long").alias("key"), F.col(index.vector).alias("vec"))
    rows = rows.join(F.broadcast(sizes.select("cell", "far")), "cell").where("r >= far").select("cell", "key", "vec")
    sizes = F.broadcast(sizes.drop("far"))
    return _met(probes.join(sizes, "cell"), rows.join(sizes, "cell"), _group(k, least, None))


def search(index: VectorIndex, queries: DataFrame, k: int, least: float | None = 0.0, where: str | None = None, log: dict | None = None) -> DataFrame:
    """query_id, key, score, rank: what a scan of the points that meet ``where`` (SQL on their columns) gives.

    queries: query_id and the index's vector column.  ``log`` gets the numbers of (query, cell) pairs read.
    """
    kind = index.rows.schema[index.vector].dataType
    schema = T.StructType([T.StructField("query_id", T.LongType()), T.StructField("vec", kind), T.StructField("cell", T.IntegerType()), T.StructField("out", T.DoubleType())])
    asked = queries.where(F.col(index.vector).isNotNull()).select(F.col("query_id").cast("long").alias("query_id"), F.col(index.vector).cast(kind).alias("vec"))
    probes = staged(asked.mapInArrow(_probes(index, k, False), schema))
    first = staged(_read(index, probes, where, k, least))
    floor = F.lit(float("-inf") if least is None else float(least))
    worst = _top(first, k).where(F.col("rank") == k).select("query_id", F.col("score").alias("worst"))
    known = asked.join(worst, "query_id", "left").select("query_id", "vec", F.greatest(F.coalesce("worst", floor), floor).alias("least"))
    more = staged(known.mapInArrow(_probes(index, k, True), schema))
    if log is not None:
        log |= {"first": probes.count(), "later": more.count(), "cells": int((index.counts > 0).sum())}
    return _top(first.unionByName(_read(index, more, where, k, least)), k).withColumnRenamed("key", index.key)
