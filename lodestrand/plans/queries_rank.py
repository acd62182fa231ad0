"""Queries of ranked retrieval and vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestrand.functions import vectors
from lodestrand.operators import bands, ranking, sequences, vectorindex
from lodestrand.plans import domain as D
from lodestrand.plans.registry import query

r9 = lambda c: F.round(c, 9)
r6 = lambda c: F.round(c, 6)


@query(f"WITH {D.SCORED} SELECT query_id, vec_id, rank, round(score, 6) AS score FROM top WHERE source = 'siglip'")
def vec_topk(t) -> DataFrame:
    out = ranking.vector_topk(t.embeddings, D.query_vectors(t), "vec_id", "embedding", 50)
    return out.select("query_id", "vec_id", "rank", r6("score").alias("score"))


@query(f"""WITH {D.SCORED} SELECT query_id, vec_id, rank, round(score, 6) AS score FROM (SELECT query_id, vec_id, score,
row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM sc WHERE source = 'siglip' AND video IN (1, 3) AND score >= 0.1) WHERE rank <= 10""")
def vec_topk_filtered(t) -> DataFrame:
    out = ranking.vector_topk(t.embeddings.where(F.col("label").isin(1, 3)), D.query_vectors(t), "vec_id", "embedding", 10, 0.1)
    return out.select("query_id", "vec_id", "rank", r6("score").alias("score"))


@query(f"WITH {D.COLLAPSED} SELECT query_id, source, video, shot, path, round(score, 6) AS score FROM best")
def collapse_shots(t) -> DataFrame:
    return D.channel_hits(t).select("query_id", "source", "video", "shot", F.col("file_path").alias("path"), r6("score").alias("score"))


@query(f"WITH {D.FUSED} SELECT query_id, path, rank, round(score, 9) AS score, parts FROM fused")
def rrf_fuse(t) -> DataFrame:
    out = ranking.rrf(D.channel_hits(t), {"siglip": 1.0, "jina": 1.0}, top=100)
    return out.select("query_id", F.col("file_path").alias("path"), "rank", r9("score").alias("score"), F.array_join("rrf_components", ",").alias("parts"))


@query(f"WITH {D.ROLLED} SELECT query_id, video, shot, path, rank, round(score, 9) AS score, n_parts FROM rolled")
def rrf_shots(t) -> DataFrame:
    return D.rolled(t).select("query_id", "video", "shot", F.col("file_path").alias("path"), "rank", r9("score").alias("score"), F.size("rrf_components").cast("long").alias("n_parts"))


@query(f"""WITH {D.COLLAPSED}, mm AS (SELECT *, (score - min(score) OVER w) / greatest(max(score) OVER w - min(score) OVER w, 1e-9) AS p FROM rk WINDOW w AS (PARTITION BY query_id, source)),
s AS (SELECT query_id, path, sum(0.5::DOUBLE / (60 + rank) + 0.5::DOUBLE * p) AS score FROM mm GROUP BY 1, 2)
SELECT query_id, path, round(score, 9) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, path) AS rank FROM s) WHERE rank <= 50""")
def srrf_fuse(t) -> DataFrame:
    out = ranking.srrf(D.channel_hits(t), {"siglip": 1.0, "jina": 1.0}, top=50)
    return out.select("query_id", F.col("file_path").alias("path"), r9("score").alias("score"), "rank")


@query(f"""WITH {D.ROLLED} SELECT query_id, video, shot, ts, row_number() OVER (PARTITION BY query_id ORDER BY ts NULLS LAST, path) AS position FROM rolled WHERE rank <= 10""")
def time_order_topk(t) -> DataFrame:
    out = ranking.in_time_order(D.rolled(t, 10), ["file_path"], "ts")
    return out.select("query_id", "video", "shot", "ts", "position")


@query(f"""WITH RECURSIVE {D.ROLLED},
s0 AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS i FROM rolled),
step AS (
  SELECT query_id, 0::BIGINT AS i, []::STRUCT(video VARCHAR, centre BIGINT, "time" DOUBLE)[] AS ws FROM (SELECT DISTINCT query_id FROM s0)
  UNION ALL
  SELECT step.query_id, s0.i, CASE WHEN len(list_filter(ws, lambda w: w.video = s0.video::VARCHAR AND abs(w."time" - s0.ts) < 8)) > 0 OR len(ws) >= 3 THEN ws
    ELSE list_append(ws, {{'video': s0.video::VARCHAR, 'centre': s0.shot, 'time': s0.ts}}) END
  FROM step JOIN s0 ON s0.query_id = step.query_id AND s0.i = step.i + 1),
fin AS (SELECT query_id, ws FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY i DESC) AS n FROM step) WHERE n = 1)
SELECT query_id, (i - 1)::BIGINT AS "window", ws[i].video AS video, ws[i].centre AS centre_shot, ws[i]."time" AS centre_time FROM (SELECT query_id, ws, unnest(range(1, len(ws) + 1)) AS i FROM fin)""")
def temporal_window_centres(t) -> DataFrame:
    return _windows(t).select("query_id", "window", "video", "centre_shot", "centre_time")


def _windows(t) -> DataFrame:
    shots = D.rolled(t).withColumnRenamed("shot", "shot_no")
    return sequences.temporal_windows(shots.withColumn("video", F.col("video").cast("string")), ["query_id"], n_windows=3)


@query()
def temporal_windows(t) -> DataFrame:
    """Windows with their shots, components and first, middle and last frame of each shot, by centre time."""
    w = _windows(t)
    frames = D.points(t).select(F.col("video").cast("string").alias("video"), F.col("shot").alias("n"), "ts", "path")
    inside = w.withColumn("n", F.explode("shot_numbers")).join(frames, ["video", "n"])
    picks = ranking.first_middle_last(inside, ["query_id", "window"], ["ts", "path"])
    got = picks.groupBy("query_id", "window").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("ts", "path"))), lambda x: x["path"]), ",").alias("frames"), F.min("ts").alias("start_time"), F.max("ts").alias("end_time"))
    out = w.join(got, ["query_id", "window"])
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("centre_time", "window"))
    return out.select("query_id", place.alias("position"), "video", "centre_shot", "centre_time", F.array_join(F.transform("shot_numbers", lambda n: n.cast("string")), ",").alias("shots"), F.array_join("components", ",").alias("parts"), "frames", "start_time", "end_time")


@query(f"""WITH {D.POINTS} SELECT vec_id, round(sqrt(list_dot_product(v, v)), 6) AS norm, round(v[1] / (sqrt(list_dot_product(v, v)) + 1e-12), 6) AS x0,
round(list_sum(list_transform(v, lambda x: x / (sqrt(list_dot_product(v, v)) + 1e-12))), 5) AS total FROM pts""")
def l2_normalise(t) -> DataFrame:
    n = vectors.l2_normalise("embedding")
    return t.embeddings.select("vec_id", r6(vectors.norm("embedding")).alias("norm"), r6(F.get(n, F.lit(0))).alias("x0"), F.round(vectors.total(n), 5).alias("total"))


BITS = "list_sum(list_transform(range(1, 64), lambda i: CASE WHEN v[i] > 0 THEN (1::BIGINT << (63 - i)) ELSE 0 END))::BIGINT"


@query(f"""WITH {D.POINTS}, h AS (SELECT vec_id, video, ts, {BITS} AS h FROM pts)
SELECT a.vec_id AS a, b.vec_id AS b, bit_count(xor(a.h, b.h))::BIGINT AS distance FROM h a JOIN h b ON a.video = b.video AND b.ts > a.ts AND b.ts <= a.ts + 5""")
def hamming_pairs(t) -> DataFrame:
    h = D.points(t).select("vec_id", "video", "ts", vectors.sign_bits("embedding").alias("h"))
    a = h.select(F.col("vec_id").alias("a"), "video", F.col("h").alias("ha"), F.explode(F.sequence(F.col("ts").cast("long") + 1, F.col("ts").cast("long") + 5)).alias("n"))
    b = h.select(F.col("vec_id").alias("b"), "video", F.col("h").alias("hb"), F.col("ts").cast("long").alias("n"))
    return a.join(b, ["video", "n"]).select("a", "b", vectors.hamming("ha", "hb").alias("distance"))


@query(f"""WITH RECURSIVE {D.POINTS}, h AS (SELECT vec_id, video, shot, {BITS} AS h, row_number() OVER (PARTITION BY video, shot ORDER BY ts) AS i FROM pts),
step AS (SELECT video, shot, 0::BIGINT AS i, []::BIGINT[] AS kept, NULL::BIGINT AS vec_id FROM (SELECT DISTINCT video, shot FROM h)
  UNION ALL SELECT h.video, h.shot, h.i, CASE WHEN len(list_filter(kept, lambda k: bit_count(xor(k, h.h)) <= 24)) > 0 THEN kept ELSE list_append(kept, h.h) END,
    CASE WHEN len(list_filter(kept, lambda k: bit_count(xor(k, h.h)) <= 24)) > 0 THEN NULL ELSE h.vec_id END
  FROM step JOIN h ON h.video = step.video AND h.shot = step.shot AND h.i = step.i + 1)
SELECT video, shot, vec_id FROM step WHERE vec_id IS NOT NULL""")
def phash_greedy(t) -> DataFrame:
    h = D.points(t).select("vec_id", "video", "shot", "ts", vectors.sign_bits("embedding").alias("h"))
    return sequences.greedy_reject(h, ["video", "shot"], "ts", "h", 24, ["vec_id"]).select("video", "shot", "vec_id")


@query(f"""WITH {D.POINTS} SELECT a.vec_id AS a, b.vec_id AS b, round(list_dot_product(a.v, b.v), 6) AS similarity
FROM pts a JOIN pts b ON a.video = b.video AND abs(a.ts - b.ts) <= 10""")
def self_similarity_band(t) -> DataFrame:
    p = D.points(t).select("video", F.col("ts").cast("long").alias("n"), "vec_id", "embedding")
    band = sequences.self_similarity(p, ["video"], "n", "embedding", 10)
    named = lambda at, c: p.select("video", F.col("n").alias(at), F.col("vec_id").alias(c))
    return band.join(named("n", "a"), ["video", "n"]).join(named("other", "b"), ["video", "other"]).select("a", "b", r6("similarity").alias("similarity"))


@query(f"""WITH {D.SCORED} SELECT query_id, vec_id, round(score, 6) AS score, round(CASE WHEN hi - lo < 1e-9 THEN 1.0 ELSE (score - lo) / (hi - lo) END, 6) AS place
FROM (SELECT *, min(score) OVER (PARTITION BY query_id) AS lo, max(score) OVER (PARTITION BY query_id) AS hi FROM top WHERE source = 'siglip')""")
def minmax_norm(t) -> DataFrame:
    top = ranking.vector_topk(t.embeddings, D.query_vectors(t), "vec_id", "embedding", 50)
    return top.select("query_id", "vec_id", r6("score").alias("score"), r6(ranking.minmax(F.col("score"), ["query_id"], 1.0)).alias("place"))


@query("""SELECT p_partkey, round(CASE WHEN s > 0 THEN a / s ELSE 1 END, 9) AS wa, round(CASE WHEN s > 0 THEN b / s ELSE 0 END, 9) AS wb, round(CASE WHEN s > 0 THEN c / s ELSE 0 END, 9) AS wc
FROM (SELECT *, a + b + c AS s FROM (SELECT p_partkey, greatest(p_size - 25, 0)::DOUBLE AS a, greatest(10.0 - p_size, 0)::DOUBLE AS b, greatest((p_retailprice - 950) / 100, 0)::DOUBLE AS c FROM part))""")
def weight_norm(t) -> DataFrame:
    size, price = F.col("p_size").cast("double"), F.col("p_retailprice")
    a, b, c = ranking.share([size - 25, 10 - size, (price - 950) / 100])
    return t.part.select("p_partkey", r9(a).alias("wa"), r9(b).alias("wb"), r9(c).alias("wc"))


@query("""SELECT vec_id, label::BIGINT AS label FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS r, count(*) OVER (PARTITION BY label) AS n FROM embeddings)
WHERE n <= 12 OR list_contains(list_transform(range(0, 12), lambda i: (i * n) // 12), r)""")
def even_sample(t) -> DataFrame:
    return ranking.even_sample(t.embeddings.select("vec_id", "label"), 12, ["label"], ["vec_id"])


@query("SELECT event_id, user_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS r FROM events) WHERE r % 7 = 0")
def stride_sample(t) -> DataFrame:
    return ranking.stride_sample(t.events.select("event_id", "user_id", "ts"), 7, ["user_id"], ["ts", "event_id"]).select("event_id", "user_id")


@query(f"""WITH {D.POINTS}, n AS (SELECT *, row_number() OVER (PARTITION BY video, shot ORDER BY ts, path) - 1 AS r, count(*) OVER (PARTITION BY video, shot) AS n FROM pts)
SELECT video, shot, path, row_number() OVER (PARTITION BY video, shot ORDER BY r) AS pick FROM n WHERE r IN (0, n // 2, n - 1)""")
def window_frames_fml(t) -> DataFrame:
    return ranking.first_middle_last(D.points(t).drop("embedding"), ["video", "shot"], ["ts", "path"]).select("video", "shot", "path", "pick")


@query(f"""WITH {D.ROLLED} SELECT query_id, video, shot, n AS neighbour FROM (SELECT query_id, video, shot, unnest(range(shot - 1, shot + 2)) AS n FROM rolled WHERE rank <= 5) r
JOIN (SELECT DISTINCT video AS v2, shot AS s2 FROM pts) p ON r.video = v2 AND n = s2""")
def neighbour_shots(t) -> DataFrame:
    from lodestrand.operators import intervals

    hits = D.rolled(t, 5).select("query_id", "video", "shot")
    return intervals.neighbours(hits, D.points(t).select("video", "shot"), ["video"], "shot").select("query_id", "video", "shot", F.col("neighbour").cast("long").alias("neighbour"))


@query(f"""WITH {D.SCORED}, s AS (SELECT vec_id, query_id, 1 / (1 + exp(-score)) AS p FROM sc WHERE source = 'siglip')
SELECT vec_id, query_id AS best, round(p, 6) AS p FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY p DESC, query_id) AS n FROM s) WHERE n = 1""")
def best_match(t) -> DataFrame:
    """The query that fits each vector best, by the logistic function of their product."""
    q = D.query_vectors(t).select("query_id", F.col("embedding").alias("q"))
    s = t.embeddings.select("vec_id", "embedding").crossJoin(F.broadcast(q)).withColumn("p", vectors.sigmoid(vectors.dot("embedding", "q")))
    return s.groupBy("vec_id").agg(F.min(F.struct((-F.col("p")).alias("neg"), "query_id")).alias("m")).select("vec_id", F.col("m.query_id").alias("best"), r6(-F.col("m.neg")).alias("p"))


@query("""SELECT label::BIGINT AS label, count(*) AS n, round(avg(embedding[1]::DOUBLE), 6) AS x0, round(avg(embedding[64]::DOUBLE), 6) AS x63 FROM embeddings GROUP BY label""")
def chunk_mean_vectors(t) -> DataFrame:
    """The mean vector of each group, place by place, from partial sums."""
    parts = t.embeddings.select("label", F.posexplode("embedding")).groupBy("label", "pos").agg(F.avg(F.col("col").cast("double")).alias("m"), F.count("*").alias("n"))
    one = parts.groupBy("label").agg(F.max("n").alias("n"), F.map_from_entries(F.collect_list(F.struct("pos", "m"))).alias("m"))
    return one.select("label", "n", r6(F.element_at("m", F.lit(0))).alias("x0"), r6(F.element_at("m", F.lit(63))).alias("x63"))


@query("""WITH b AS (SELECT vec_id, floor((x + 1) * 4)::BIGINT AS bin, count(*) AS n FROM (SELECT vec_id, unnest(embedding)::DOUBLE AS x FROM embeddings) GROUP BY ALL)
SELECT vec_id, bin, round(n / sqrt(sum(n * n) OVER (PARTITION BY vec_id)), 6) AS share FROM b""")
def histogram_bins(t) -> DataFrame:
    """Histograms of each vector's entries, scaled to unit length, as of colours per frame."""
    b = t.embeddings.select("vec_id", F.explode("embedding").alias("x")).groupBy("vec_id", F.floor((F.col("x").cast("double") + 1) * 4).cast("int").alias("bin")).agg(F.count("*").alias("n"))
    return b.select("vec_id", "bin", r6(F.col("n") / F.sqrt(F.sum(F.col("n") * F.col("n")).over(Window.partitionBy("vec_id")))).alias("share"))


_MANY = f"""WITH {D.POINTS}, sc AS (SELECT q.vec_id AS query_id, p.vec_id, p.video, list_dot_product(q.v, p.v) AS score FROM pts q, pts p WHERE q.vec_id % 20 = 0)
SELECT query_id, vec_id, rank, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM sc WHERE score >= {{least}}) WHERE rank <= {{k}}"""


def many_queries(t) -> DataFrame:
    """Every twentieth embedding asks."""
    return t.embeddings.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding")


@query(_MANY.format(least="0", k=50))
def block_topk(t) -> DataFrame:
    """Top-k of a large set of queries by a product of blocks."""
    out = vectorindex.block_topk(t.embeddings, many_queries(t), "vec_id", "embedding", 50)
    return out.select("query_id", "vec_id", "rank", r6("score").alias("score"))


@query(_MANY.format(least="0", k=10))
def indexed_topk(t) -> DataFrame:
    """The same from an inverted-file index, which reads the cells that can matter to a query."""
    index = vectorindex.build_index(t.embeddings, "vec_id", "embedding")
    return vectorindex.search(index, many_queries(t), 10).select("query_id", "vec_id", "rank", r6("score").alias("score"))


@query(_MANY.format(least="0.1 AND video IN (1, 3)", k=10))
def indexed_topk_filtered(t) -> DataFrame:
    """The same over the points of two videos."""
    index = vectorindex.build_index(t.embeddings, "vec_id", "embedding")
    return vectorindex.search(index, many_queries(t), 10, 0.1, "label in (1, 3)").select("query_id", "vec_id", "rank", r6("score").alias("score"))


@query(f"""WITH {D.POINTS}, n AS (SELECT vec_id, video, ts::BIGINT AS ts, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) AS v FROM pts)
SELECT a.vec_id, o AS place, round(coalesce(list_dot_product(a.v, b.v), 0), 6) AS similarity
FROM n a CROSS JOIN (SELECT unnest(range(101)) AS o) LEFT JOIN n b ON a.video = b.video AND b.ts = a.ts + o - 50""")
def similarity_bands(t) -> DataFrame:
    """Each point's 101 similarities to the points around it in its video, zeros beyond its ends."""
    p = D.points(t).select("video", F.col("ts").cast("long").alias("n"), "vec_id", "embedding")
    out = bands.self_similarity_bands(p, ["video"], "n", "embedding").join(p.select("video", "n", "vec_id"), ["video", "n"])
    return out.select("vec_id", F.posexplode("band").alias("place", "similarity")).select("vec_id", "place", r6("similarity").alias("similarity"))
