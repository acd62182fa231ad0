"""The domain's objects as projections of the given tables, in Spark and as SQL for the checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestrand.operators import ranking

#: Query vectors: the embeddings with vec_id under this.
QUERY_VECTORS = 20


def points(t) -> DataFrame:
    """vec_id, video, shot, ts, path, embedding: five points a shot, one a second."""
    r = F.row_number().over(Window.partitionBy("label").orderBy("vec_id")) - 1
    rows = t.embeddings.withColumn("_r", r)
    return rows.select("vec_id", F.col("label").alias("video"), F.expr("cast(_r div 5 as int)").alias("shot"), F.col("_r").cast("double").alias("ts"), F.col("vec_id").cast("string").alias("path"), "embedding")


def query_vectors(t) -> DataFrame:
    return t.embeddings.where(F.col("vec_id") < QUERY_VECTORS).select(F.col("vec_id").alias("query_id"), "embedding")


def channel_hits(t, depth: int = 50) -> DataFrame:
    """Hits of both channels, collapsed to the best of each shot: the inputs of fusion."""
    where = points(t).drop("embedding")
    out = None
    for source, dims in (("siglip", None), ("jina", 32)):
        hits = ranking.vector_topk(t.embeddings, query_vectors(t), "vec_id", "embedding", depth, 0.0, dims).drop("rank").withColumn("source", F.lit(source))
        out = hits if out is None else out.unionByName(hits)
    best = ranking.collapse(out.join(where, "vec_id"), ["query_id", "source", "video", "shot"], ["vec_id"])
    return best.withColumnRenamed("path", "file_path")


POINTS = """pts AS (SELECT vec_id, label::BIGINT AS video, (rn // 5)::BIGINT AS shot, rn::DOUBLE AS ts, vec_id::VARCHAR AS path, embedding::DOUBLE[] AS v
  FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS rn FROM embeddings))"""
SCORED = POINTS + """,
ch(source, dims) AS (VALUES ('siglip', 64), ('jina', 32)),
sc AS (SELECT q.vec_id AS query_id, source, p.vec_id, p.video, p.shot, p.ts, p.path, list_dot_product(q.v[1:dims], p.v[1:dims]) AS score
  FROM pts q, pts p, ch WHERE q.vec_id < 20),
top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, source ORDER BY score DESC, vec_id) AS rank FROM sc WHERE score >= 0) WHERE rank <= 50)"""
COLLAPSED = SCORED + """,
best AS (SELECT * EXCLUDE (n) FROM (SELECT * EXCLUDE (rank), row_number() OVER (PARTITION BY query_id, source, video, shot ORDER BY score DESC, vec_id) AS n FROM top) WHERE n = 1),
rk AS (SELECT *, row_number() OVER (PARTITION BY query_id, source ORDER BY score DESC, path) AS rank FROM best)"""
FUSED = COLLAPSED + """,
fu AS (SELECT query_id, path, any_value(video) AS video, any_value(shot) AS shot, any_value(ts) AS ts, sum(1.0::DOUBLE / (60 + rank)) AS score,
  string_agg(DISTINCT source, ',' ORDER BY source) AS parts, count(DISTINCT source) AS n_parts FROM rk GROUP BY query_id, path),
fused AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, path) AS rank FROM fu) WHERE rank <= 100)"""
ROLLED = FUSED + """,
r1 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, video, shot ORDER BY score DESC, n_parts DESC, path) AS n FROM fused) WHERE n = 1),
rolled AS (SELECT * FROM (SELECT * EXCLUDE (rank, n), row_number() OVER (PARTITION BY query_id ORDER BY score DESC, n_parts DESC, path) AS rank FROM r1) WHERE rank <= 20)"""


def fused(t) -> DataFrame:
    hits = channel_hits(t)
    places = points(t).select(F.col("path").alias("file_path"), "video", "shot", "ts")
    return ranking.rrf(hits, {"siglip": 1.0, "jina": 1.0}, top=100).join(places, "file_path")


def rolled(t, top: int = 20) -> DataFrame:
    return ranking.roll_up(fused(t), ["video", "shot"], top, ["file_path"])


def events(t) -> DataFrame:
    """event_id, user, kind, value, at: seconds since 2024."""
    micros = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ '2024-01-01 00:00:00', ts)")
    return t.events.select("event_id", F.col("user_id").alias("user"), F.col("event_type").alias("kind"), "value", (micros / 1e6).alias("at"))


EVENTS = """ev AS (SELECT event_id, user_id AS "user", event_type AS kind, value, (epoch_us(ts) - 1704067200000000) / 1e6::DOUBLE AS sec FROM events)"""


def judged(t) -> DataFrame:
    """Questions from line items: group, seq in it, gold, pred (null for N), kind, level; a scored group has the first four."""
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    li = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_returnflag").withColumn("seq", F.row_number().over(order))
    kind = t.orders.select(F.col("o_orderkey").alias("l_orderkey"), F.when(F.col("o_orderstatus") == "F", "logic").otherwise("relevance").alias("kind"), F.col("o_orderpriority").alias("head"))
    return li.join(kind, "l_orderkey").select(F.col("l_orderkey").alias("grp"), "seq", F.lit("R").alias("gold"), F.when(F.col("l_returnflag") != "N", F.col("l_returnflag")).alias("pred"), "kind", "head", (F.col("l_linenumber") % 3 + 1).alias("level"))


JUDGED = """jd AS (SELECT l_orderkey AS grp, seq, 'R' AS gold, CASE WHEN l_returnflag <> 'N' THEN l_returnflag END AS pred,
  CASE WHEN o_orderstatus = 'F' THEN 'logic' ELSE 'relevance' END AS kind, o_orderpriority AS head, l_linenumber % 3 + 1 AS level
  FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS seq FROM lineitem) l
  JOIN orders ON o_orderkey = l_orderkey),
ok AS (SELECT *, coalesce(pred = gold, false) AS good FROM jd)"""
