"""Scores of predictions: accuracy, breakdowns, group scores, paired tests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def correct() -> Column:
    """A missing prediction is wrong."""
    return F.coalesce(F.col("pred") == F.col("gold"), F.lit(False))


def accuracy(judged: DataFrame, by: list[str] | None = None) -> DataFrame:
    """n, accuracy, unparsed_rate, for each group or for all (0 rows: n 0 and 0.0)."""
    aggs = [F.count("*").alias("n"), F.coalesce(F.avg(correct().cast("double")), F.lit(0.0)).alias("accuracy"), F.coalesce(F.avg(F.col("pred").isNull().cast("double")), F.lit(0.0)).alias("unparsed_rate")]
    return judged.groupBy(*by).agg(*aggs) if by else judged.agg(*aggs)


def breakdowns(judged: DataFrame, columns: list[str]) -> DataFrame:
    """dimension, value, n, accuracy: all breakdowns and the total in one pass over the rows."""
    sets = F.array(F.struct(F.lit("all").alias("dimension"), F.lit("").alias("value")), *[F.struct(F.lit(c).alias("dimension"), F.coalesce(F.col(c).cast("string"), F.lit("")).alias("value")) for c in columns])
    return judged.withColumn("_b", F.explode(sets)).groupBy("_b.dimension", "_b.value").agg(F.count("*").alias("n"), F.avg(correct().cast("double")).alias("accuracy"))


def group_scores(judged: DataFrame, by: list[str], kind: str, order: list[str]) -> DataFrame:
    """by, score: relevance (and any other kind) squares the share of four; logic counts the leading run of four."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    ok = correct().cast("int")
    rows = judged.withColumn("_ok", ok).withColumn("_wrong", F.sum(1 - ok).over(w))
    right, run = F.sum("_ok"), F.sum(F.when(F.col("_wrong") == 0, 1).otherwise(0))
    return rows.groupBy(*by).agg(F.when(F.first(kind) == "logic", run / 4).otherwise(F.pow(right / 4, F.lit(2.0))).alias("score"))


def mean_group_score(scores: DataFrame) -> DataFrame:
    return scores.agg(F.coalesce(F.avg("score"), F.lit(0.0)).alias("group_score"), F.count("*").alias("n_groups"))


def mcnemar(pairs: DataFrame, a: Column, b: Column) -> DataFrame:
    """b (a wrong, b right), c (a right, b wrong) and the exact two-sided binomial p."""
    n = pairs.agg(F.count_if(~a & b).alias("b"), F.count_if(a & ~b).alias("c")).withColumn("n", F.col("b") + F.col("c"))
    # Terms of the tail as exp of log choose(n, i) - n log 2, the logarithms as running sums.
    low = F.least("b", "c")
    zero = F.struct(F.lit(0.0).alias("log"), F.lit(0.0).alias("tail"))

    def step(acc: Column, i: Column) -> Column:
        log = acc["log"] + F.when(i == 0, 0.0).otherwise(F.log((F.col("n") - i + 1) / F.greatest(i, F.lit(1))))
        return F.struct(log.alias("log"), (acc["tail"] + F.exp(log - F.col("n") * F.log(F.lit(2.0)))).alias("tail"))

    tail = F.aggregate(F.sequence(F.lit(0).cast("long"), low), zero, step, lambda acc: acc["tail"])
    return n.select("b", "c", F.when(F.col("n") == 0, 1.0).otherwise(F.least(F.lit(1.0), 2 * tail)).alias("p_value"))


def summary_pivot(judged: DataFrame, by: list[str], level: str, levels: list) -> DataFrame:
    """by and the accuracy of each level as a column, with n and the accuracy over all."""
    value = correct().cast("double")
    aggs = [F.count("*").alias("n"), F.avg(value).alias("accuracy"), *[F.avg(F.when(F.col(level) == x, value)).alias(f"level_{x}") for x in levels]]
    return judged.groupBy(*by).agg(*aggs)


def render_table(config: str, split: str, row: dict) -> str:
    """A summary row as a Markdown table."""
    head = ["config", "split", *row]
    cells = [config, split, *[f"{v:.3f}" if isinstance(v, float) else str(v) for v in row.values()]]
    return "\n".join(["| " + " | ".join(head) + " |", "|" + " --- |" * len(head), "| " + " | ".join(cells) + " |"])
