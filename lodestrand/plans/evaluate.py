"""Evaluation of stored predictions: one long table of metrics, a Markdown table, a command line."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrand.operators import evaluation as E
from lodestrand.plans.retrieve import CONFIGS


def judge(questions: DataFrame, predictions: DataFrame) -> DataFrame:
    """Each question with its prediction, of several the least letter; none counts as wrong and unparsed."""
    pred = predictions.groupBy("question_id").agg(F.min("pred").alias("pred"))
    return questions.join(pred, "question_id", "left").withColumn("gold", F.col("answer"))


def split_of(questions: DataFrame, split: str) -> DataFrame:
    """dev is videos 001 to 050, test the others."""
    dev = F.col("video_id").between("001", "050")
    return {"dev": questions.where(dev), "test": questions.where(~dev), "all": questions}[split]


def summarise(judged: DataFrame) -> DataFrame:
    """metric, value, n: accuracy, unparsed rate, by level and second head, mean group score."""
    all_ = E.accuracy(judged)
    parts = [all_.select(F.lit(m).alias("metric"), F.col(m).alias("value"), "n") for m in ("accuracy", "unparsed_rate")]
    by = E.breakdowns(judged, ["level", "second_head"]).where("dimension <> 'all'")
    parts.append(by.select(F.concat_ws("=", "dimension", "value").alias("metric"), F.col("accuracy").alias("value"), "n"))
    groups = E.mean_group_score(E.group_scores(judged, ["video_id", "group_type"], "group_type", ["question_id"]))
    parts.append(groups.select(F.lit("group_score").alias("metric"), F.col("group_score").alias("value"), F.col("n_groups").alias("n")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def lookup_question(questions: DataFrame, question_id: str) -> DataFrame:
    """The question of that id, of several the first in the order of their columns; running it is an error where there is none."""
    got = questions.where(F.col("question_id") == question_id).agg(F.min(F.struct(*questions.columns)).alias("q"))
    there = F.when(F.col("q").isNull(), F.raise_error(F.lit(f"no question {question_id}"))).otherwise(F.col("q.question_id"))
    return got.select(*[(there if c == "question_id" else F.col(f"q.`{c}`")).alias(c) for c in questions.columns])


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    p = argparse.ArgumentParser(description="Score stored predictions.")
    p.add_argument("--questions", required=True)
    p.add_argument("--predictions", required=True)
    p.add_argument("--config", choices=sorted(CONFIGS), required=True)
    p.add_argument("--split", choices=("dev", "test", "all"), default="dev")
    p.add_argument("--limit", type=int)
    p.add_argument("--out")
    a = p.parse_args(argv)
    if spark is None:
        from lodestrand.session import session

        spark = session()
    questions = split_of(spark.read.parquet(a.questions), a.split).orderBy("question_id")
    questions = questions.limit(a.limit) if a.limit else questions
    judged = judge(questions, spark.read.parquet(a.predictions).where(F.col("config") == a.config))
    rows = {r["metric"]: r["value"] for r in summarise(judged).collect()}
    print(E.render_table(a.config, a.split, rows))
    if rows.get("unparsed_rate", 0.0) > 0.05:
        print("warning: more than 5 % of the answers have no letter", file=sys.stderr)
    if a.out:
        summarise(judged).coalesce(1).write.mode("overwrite").json(a.out)
    return 0


if __name__ == "__main__":
    sys.exit(main())
