"""Queries of evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrand.operators import evaluation as E
from lodestrand.plans import domain as D
from lodestrand.plans.registry import query

r9 = lambda c: F.round(c, 9).alias(c)


@query(f"WITH {D.JUDGED} SELECT count(*) AS n, round(avg(good::INT), 9) AS accuracy, round(avg((pred IS NULL)::INT), 9) AS unparsed_rate FROM ok")
def accuracy(t) -> DataFrame:
    return E.accuracy(D.judged(t)).select("n", r9("accuracy"), r9("unparsed_rate"))


@query(f"""WITH {D.JUDGED} SELECT 'all' AS dimension, '' AS value, count(*) AS n, round(avg(good::INT), 9) AS accuracy FROM ok
UNION ALL SELECT 'level', level::VARCHAR, count(*), round(avg(good::INT), 9) FROM ok GROUP BY level UNION ALL SELECT 'head', head, count(*), round(avg(good::INT), 9) FROM ok GROUP BY head""")
def accuracy_by_level(t) -> DataFrame:
    return E.breakdowns(D.judged(t), ["level", "head"]).select("dimension", "value", "n", r9("accuracy"))


GROUPS = D.JUDGED + """, run AS (SELECT *, sum((NOT good)::INT) OVER (PARTITION BY grp, kind ORDER BY seq ROWS UNBOUNDED PRECEDING) AS wrong FROM ok WHERE seq <= 4),
gs AS (SELECT grp, kind, CASE WHEN kind = 'logic' THEN sum((wrong = 0)::INT) / 4.0::DOUBLE ELSE pow(sum(good::INT) / 4.0::DOUBLE, 2) END AS score FROM run GROUP BY grp, kind)"""


@query(f"WITH {GROUPS} SELECT grp, kind, round(score, 9) AS score FROM gs")
def group_score(t) -> DataFrame:
    return E.group_scores(D.judged(t).where("seq <= 4"), ["grp", "kind"], "kind", ["seq"]).select("grp", "kind", r9("score"))


@query(f"WITH {GROUPS} SELECT round(avg(score), 9) AS group_score, count(*) AS n_groups FROM gs")
def mean_group_score(t) -> DataFrame:
    return E.mean_group_score(E.group_scores(D.judged(t).where("seq <= 4"), ["grp", "kind"], "kind", ["seq"])).select(r9("group_score"), "n_groups")


@query("""WITH p AS (SELECT quality = 1 AS a, quality = 1 - toxic AS b FROM labels), c AS (SELECT count(*) FILTER (WHERE NOT a AND b) AS b, count(*) FILTER (WHERE a AND NOT b) AS c FROM p)
SELECT b, c FROM c""")
def mcnemar_counts(t) -> DataFrame:
    return E.mcnemar(t.labels, F.col("quality") == 1, F.col("quality") == 1 - F.col("toxic")).select("b", "c")


@query("""WITH RECURSIVE p AS (SELECT quality = 1 AS a, (doc_id % 7 = 0) <> (quality = 1) AS b FROM labels),
c AS (SELECT count(*) FILTER (WHERE NOT a AND b) AS b, count(*) FILTER (WHERE a AND NOT b) AS c FROM p),
s AS (SELECT 0::BIGINT AS i, b + c AS n, least(b, c) AS low, 0.0::DOUBLE AS lg FROM c UNION ALL SELECT i + 1, n, low, lg + ln((n - i)::DOUBLE / (i + 1)) FROM s WHERE i < low)
SELECT (SELECT b FROM c) AS b, (SELECT c FROM c) AS c, round(least(1.0, 2 * sum(exp(lg - n * ln(2.0::DOUBLE)))), 9) AS p_value FROM s""")
def mcnemar_test(t) -> DataFrame:
    a = F.col("quality") == 1
    return E.mcnemar(t.labels, a, (F.col("doc_id") % 7 == 0) != a).select("b", "c", r9("p_value"))


@query(f"""WITH {D.JUDGED} SELECT head AS config, kind AS split, count(*) AS n, round(avg(good::INT), 9) AS accuracy, round(avg(good::INT) FILTER (WHERE level = 1), 9) AS level_1,
round(avg(good::INT) FILTER (WHERE level = 2), 9) AS level_2, round(avg(good::INT) FILTER (WHERE level = 3), 9) AS level_3 FROM ok GROUP BY head, kind""")
def summary_pivot(t) -> DataFrame:
    out = E.summary_pivot(D.judged(t).withColumnRenamed("head", "config").withColumnRenamed("kind", "split"), ["config", "split"], "level", [1, 2, 3])
    return out.select("config", "split", "n", *[r9(c) for c in ("accuracy", "level_1", "level_2", "level_3")])
