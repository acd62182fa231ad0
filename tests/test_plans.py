"""What the plans must look like: pruned and filtered scans, no products of whole tables, bounded top-k."""

from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

from lodestrand import config
from lodestrand.functions import vectors
from lodestrand.operators import state
from lodestrand.plans import evaluate, registry
from lodestrand.schemas import SCHEMAS
from tests.oracle import assert_same

#: Queries with a stated set of vectors, one row of totals or one constant key on one side of a nested loop.
NESTED = {"answer_questions", "best_match"}
STREAMS = {n for n in registry.QUERIES if n.startswith("stream_")}


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - STREAMS))
def test_no_products(spark, sf, name):
    plan = plan_of(registry.QUERIES[name](spark, sf))
    assert "CartesianProduct" not in plan
    assert name in NESTED or "BroadcastNestedLoopJoin" not in plan
    assert "BatchEvalPython" not in plan


def test_pushdown_and_pruning(spark, sf, tmp_path):
    plan = plan_of(registry.QUERIES["semi_questions"](spark, sf))
    assert "EqualTo(c_mktsegment,MACHINERY)" in plan and re.search(r"ReadSchema: struct<o_orderkey:bigint,o_custkey:bigint>", plan)
    rows = spark.createDataFrame([], SCHEMAS["points"])
    rows.write.parquet(str(tmp_path / "points"))
    one = spark.read.schema(SCHEMAS["points"]).parquet(str(tmp_path / "points")).where("payload.video.name = '001'").select("id")
    plan = plan_of(one)
    assert "EqualTo(payload.video.name,001)" in plan and "siglip" not in plan
    assert "WindowGroupLimit" in plan_of(state.latest(spark.range(9).withColumn("k", F.col("id") % 2), ["k"], ["id"]))


def test_topk_is_bounded_before_the_shuffle(spark, sf):
    plan = plan_of(registry.QUERIES["vec_topk"](spark, sf))
    assert plan.index("WindowGroupLimit") < plan.index("Exchange") < plan.rindex("MapInArrow") and "partial" not in plan


def test_settings(tmp_path):
    (tmp_path / ".env").write_text("# c\nTOP_K=7\nDATA_ROOT='x'\n")
    s = config.Settings.load(str(tmp_path / ".env"), {"TOP_K": "9", "RRF_K": "30"})
    assert (s.top_k, s.rrf_k, s.data_root, s.candidate_depth) == (7, 30, "x", 50)
    with pytest.raises(ValueError):
        config.Settings(top_k=0)
    assert config.weights({"RRF_WEIGHT_ASR": "0"})["asr"] == 0.0 and config.flag("X", env={"X": "Yes"}) and not config.flag("X", env={})


def test_evaluate(spark, tmp_path, capsys):
    q = [(f"{v:03d}", f"{v:03d}-{i}", "?", ["A. x"], "A", str(i % 3 + 1), "relevance", "h", "t") for v in (1, 51) for i in range(4)]
    questions = spark.createDataFrame(q, SCHEMAS["questions"])
    preds = spark.createDataFrame([("001-0", "full", "A", "A", None), ("001-1", "full", "A", "A", None), ("001-2", "full", None, "?", None), ("051-0", "full", "B", "B", None)], SCHEMAS["predictions"])
    questions.write.parquet(str(tmp_path / "q"))
    preds.write.parquet(str(tmp_path / "p"))
    assert evaluate.main(["--questions", str(tmp_path / "q"), "--predictions", str(tmp_path / "p"), "--config", "full", "--out", str(tmp_path / "o")], spark) == 0
    said = capsys.readouterr()
    assert "| full | dev | 0.500 | 0.500 |" in said.out and "warning" in said.err
    got = {r["metric"]: (r["value"], r["n"]) for r in evaluate.summarise(evaluate.judge(questions, preds)).collect()}
    assert got["accuracy"] == (0.25, 8) and got["group_score"] == (0.125, 2) and got["level=1"] == (0.25, 4)
    assert evaluate.lookup_question(questions, "051-3").first()["video_id"] == "051"
    with pytest.raises(Exception, match="no question"):
        evaluate.lookup_question(questions, "x").collect()


def test_token_windows(spark):
    w = spark.range(1).select(vectors.token_windows(F.transform(F.sequence(F.lit(1), F.lit(130)), lambda i: i)).alias("w"), vectors.mean_unit_vector(F.array(F.array(F.lit(3.0), F.lit(0.0)), F.array(F.lit(0.0), F.lit(3.0))), 2).alias("m")).first()
    assert [(x[0], x[-1]) for x in w["w"]] == [(1, 64), (49, 112), (97, 130)] and w["m"] == pytest.approx([0.5**0.5, 0.5**0.5])


@pytest.mark.parametrize("name", ["stream_windows", "gap_segments"])
def test_any_session_zone(spark, sf, name):
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        assert assert_same(registry.QUERIES[name](spark, sf), registry.ORACLES[name], sf) > 0
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
