"""Top-k by blocks and by the inverted-file index against every product, with ties, hot cells and conditions."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestrand.operators import vectorindex as V

SCHEMA = "id long, embedding array<double>, tag string"


def clustered(n=1500, dims=12, groups=20, seed=3):
    rng = np.random.default_rng(seed)
    centre = rng.normal(size=(groups, dims))
    x = centre[rng.integers(0, groups, n)] + rng.normal(size=(n, dims)) * 0.08
    return x / np.linalg.norm(x, axis=1)[:, None]


def rows_of(x):
    # Whole eighths, so that products are exact and ties are ties.
    return [(i, [float(v) for v in np.rint(v * 64) / 64], "even" if i % 2 == 0 else "odd") for i, v in enumerate(x)]


def plain(points, queries, k, least=None, ok=lambda tag: True):
    out = []
    for q, v in queries:
        scored = sorted((-float(np.dot(v, p)), i) for i, p, tag in points if p is not None and ok(tag))
        out += [(q, i, -s, r + 1) for r, (s, i) in enumerate([x for x in scored if least is None or -x[0] >= least][:k])]
    return sorted(out)


def got(df):
    return sorted((r["query_id"], r["id"], r["score"], r["rank"]) for r in df.collect())


@pytest.fixture(scope="module")
def points(spark):
    rows = rows_of(clustered())
    hot = rows[7][1]
    # A third of the points are one vector, some have none.
    rows = [(i, hot if i % 3 == 0 else v, tag) for i, v, tag in rows] + [(9000, None, "even"), (9001, [0.0] * 12, "odd")]
    return rows, spark.createDataFrame(rows, SCHEMA).repartition(4).cache()


@pytest.fixture(scope="module")
def queries(spark, points):
    asked = [(i, v) for i, v, _ in points[0] if i % 50 == 0 and v] + [(77777, [0.0] * 12), (77778, [5.0] + [0.0] * 11), (77779, [-x for x in points[0][7][1]])]
    return asked, spark.createDataFrame(asked + [(5, None)], "query_id long, embedding array<double>")


@pytest.mark.parametrize("strip, block", [(1 << 16, 1 << 11), (100, 5)])
def test_block_topk(points, queries, strip, block):
    for k, least in ((10, 0.0), (3, None)):
        assert got(V.block_topk(points[1], queries[1], "id", "embedding", k, least, strip=strip, block=block)) == plain(points[0], queries[0], k, least)


@pytest.mark.parametrize("strip, block", [(1 << 16, 1 << 11), (60, 4)])
def test_search_equals_a_scan(points, queries, monkeypatch, strip, block):
    monkeypatch.setattr(V, "STRIP", strip)
    monkeypatch.setattr(V, "BLOCK", block)
    index = V.build_index(points[1], "id", "embedding", sample=400)
    assert index.rows.count() == 1501 and set(index.rows.columns) == {"id", "embedding", "tag", "cell", "r"}
    for k, least in ((10, 0.0), (10, None), (1, 0.9), (2000, None)):
        assert got(V.search(index, queries[1], k, least)) == plain(points[0], queries[0], k, least)
    assert got(V.search(index, queries[1], 10, 0.0, "tag = 'odd'")) == plain(points[0], queries[0], 10, 0.0, lambda tag: tag == "odd")


def test_cells_are_passed_over(spark):
    rows = rows_of(clustered(3000, 12, 60, 9))
    index = V.build_index(spark.createDataFrame(rows, SCHEMA), "id", "embedding", cells=60)
    asked = [(i, v) for i, v, _ in rows[:40]]
    log: dict = {}
    out = V.search(index, spark.createDataFrame(asked, "query_id long, embedding array<double>"), 5, None, log=log)
    assert got(out) == plain(rows, asked, 5)
    assert log["first"] + log["later"] < 40 * log["cells"] / 2
    # One query's cells are folders by name.
    few = V._read(index, spark.createDataFrame([(1, rows[0][1], int(c), 0.0) for c in np.flatnonzero(index.counts)[:2]], "query_id long, vec array<double>, cell int, out double"), None, 5, None)
    assert "PartitionFilters: [cell#" in few._jdf.queryExecution().executedPlan().toString()


def test_small_cases(spark):
    q = spark.createDataFrame([(1, [1.0, 0.0])], "query_id long, embedding array<double>")
    none = spark.createDataFrame([], SCHEMA)
    one = spark.createDataFrame([(4, [0.5, 0.5], "x"), (3, [0.5, 0.1], "x"), (5, None, "x")], SCHEMA)
    for points, want in ((none, []), (one.where("id = 5"), []), (one, [(1, 3, 0.5, 1), (1, 4, 0.5, 2)])):
        assert got(V.block_topk(points, q, "id", "embedding", 5)) == want
        assert got(V.search(V.build_index(points, "id", "embedding"), q, 5)) == want
        assert got(V.search(V.build_index(points, "id", "embedding"), q.where(F.lit(False)), 5)) == []
