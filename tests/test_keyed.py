"""The stored table that changes: upserts, deletes, failed and conflicting commits, compaction of touched buckets."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestrand.sources.keyed import Conflict, KeyedTable

SCHEMA = T.StructType([T.StructField("id", T.StringType()), T.StructField("v", T.LongType()), T.StructField("x", T.StringType())])


@pytest.fixture
def kept(spark, tmp_path):
    return KeyedTable(spark, f"file://{tmp_path}/t", SCHEMA, ["id"], "v", 8)


def rows(spark, *values):
    return spark.createDataFrame(list(values), SCHEMA)


def held(table):
    return sorted(((r["id"], r["v"], r["x"]) for r in table.read().collect()), key=repr)


def test_changes(spark, kept):
    assert held(kept) == [] and kept.snapshot() == (0, {}) and kept.compact() == []
    assert kept.upsert(rows(spark, ("a", 1, "old"), ("b", 1, "keep"), (None, 1, "null"), ("a", 2, "newer"), ("a", 2, "mewer"))) == 1
    assert held(kept) == [("a", 2, "mewer"), ("b", 1, "keep"), (None, 1, "null")]
    kept.upsert(rows(spark, ("a", 1, "late"), ("b", 1, "same order, newer"), ("c", 5, "add")))
    assert held(kept) == [("a", 2, "mewer"), ("b", 1, "same order, newer"), ("c", 5, "add"), (None, 1, "null")]
    kept.delete(rows(spark, ("a", None, None), ("zz", None, None), (None, None, None)))
    assert held(kept) == [("b", 1, "same order, newer"), ("c", 5, "add")]
    kept.upsert(rows(spark, ("a", 0, "back")))
    want = [("a", 0, "back"), ("b", 1, "same order, newer"), ("c", 5, "add")]
    assert held(kept) == want
    assert sorted(r["x"] for r in kept.lookup([("a",), ("c",), ("q",)]).collect()) == ["add", "back"]
    before = kept.snapshot()[1]
    many = kept.compact()
    after = kept.snapshot()[1]
    assert held(kept) == want and set(many) == {b for b, f in before.items() if len(f) > 1}
    assert all(after[b] == before[b] for b in before if b not in many) and all(len(after.get(b, [0])) == 1 for b in many)
    assert kept.compact() == []


def test_failed_and_conflicting_commits(spark, kept, monkeypatch):
    kept.upsert(rows(spark, ("a", 1, "first")))
    with pytest.raises(Exception, match="boom"):
        kept.upsert(rows(spark, ("a", 2, "x")).withColumn("x", F.when(F.col("v") == 2, F.raise_error(F.lit("boom"))).otherwise(F.col("x"))))
    assert held(kept) == [("a", 1, "first")]
    # Data that was written without a commit isn't seen.
    monkeypatch.setattr(kept, "_commit", lambda *a: (_ for _ in ()).throw(OSError("lost")))
    with pytest.raises(OSError, match="lost"):
        kept.upsert(rows(spark, ("a", 3, "unseen")))
    monkeypatch.undo()
    assert held(kept) == [("a", 1, "first")]
    number, state = kept.snapshot()
    kept.upsert(rows(spark, ("b", 1, "other")))
    with pytest.raises(Conflict):
        kept._commit(number + 1, state)
    assert held(kept) == [("a", 1, "first"), ("b", 1, "other")]


def test_a_lookup_reads_its_bucket(spark, kept):
    kept.upsert(spark.range(400).select(F.col("id").cast("string").alias("id"), F.col("id").alias("v"), F.lit("x").alias("x")))
    found = kept.lookup([("17",)])
    assert [r["v"] for r in found.collect()] == [17] and len({f.split("_bucket=")[1].split("/")[0] for f in found.inputFiles()}) == 1
    assert len({f.split("_bucket=")[1].split("/")[0] for f in kept.read().inputFiles()}) == 8
