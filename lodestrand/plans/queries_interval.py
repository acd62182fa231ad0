"""Queries of intervals, ordered groups and keyed state."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestrand.operators import intervals, ranking, sequences, state
from lodestrand.plans import domain as D
from lodestrand.plans.registry import query

r6 = lambda c: F.round(c, 6)
SEG = D.EVENTS + """,
seg AS (SELECT event_id AS seg_id, "user", sec AS lo, sec + value * 1000 AS hi FROM ev WHERE kind = 'view'),
frm AS (SELECT event_id AS frame_id, "user", sec AS ts FROM ev WHERE kind = 'click')"""


def segments(t) -> DataFrame:
    return D.events(t).where("kind = 'view'").select(F.col("event_id").alias("seg_id"), "user", F.col("at").alias("lo"), (F.col("at") + F.col("value") * 1000).alias("hi"))


def frames(t) -> DataFrame:
    return D.events(t).where("kind = 'click'").select(F.col("event_id").alias("frame_id"), "user", F.col("at").alias("ts"))


@query(f'WITH {SEG} SELECT seg_id, frame_id FROM seg JOIN frm ON seg."user" = frm."user" AND ts BETWEEN lo AND hi')
def asr_range_join(t) -> DataFrame:
    return intervals.points_in_intervals(segments(t), frames(t), ["user"], "lo", "hi", "ts", 86400.0).select("seg_id", "frame_id")


SPEECH = SEG + """,
said AS (SELECT event_id AS said_id, "user", sec AS s, sec + value * 200 AS e FROM ev WHERE kind = 'error')"""


@query(f"""WITH {SPEECH} SELECT seg_id, coalesce(string_agg(said_id::VARCHAR, ' ' ORDER BY s, said_id) FILTER (WHERE said_id IS NOT NULL), '') AS speech
FROM seg LEFT JOIN said ON seg."user" = said."user" AND e >= lo - 1.5 AND s <= hi + 1.5 GROUP BY seg_id""")
def overlap_text(t) -> DataFrame:
    said = D.events(t).where("kind = 'error'").select(F.col("event_id").cast("string").alias("said"), "event_id", "user", F.col("at").alias("s"), (F.col("at") + F.col("value") * 200).alias("e"))
    out = intervals.overlap_text(segments(t), said, ["user"], ["seg_id"], ["s", "event_id"], "said", 1.5, 86400.0, span=("lo", "hi"), seg=("s", "e"))
    return out.select("seg_id", "speech")


@query("""WITH o AS (SELECT o_custkey, o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN upper(trim(o_orderpriority)) ELSE lower(trim(o_orderpriority)) END AS txt FROM orders),
f AS (SELECT o_custkey, min(o_orderkey) AS k, arg_min(txt, o_orderkey) AS txt FROM o GROUP BY o_custkey, lower(txt))
SELECT o_custkey, string_agg(txt, ' | ' ORDER BY k) AS ocr FROM f GROUP BY o_custkey""")
def ocr_by_shot(t) -> DataFrame:
    return _ocr(t)


def _ocr(t) -> DataFrame:
    txt = F.when(F.col("o_orderkey") % 2 == 0, F.upper(F.trim("o_orderpriority"))).otherwise(F.lower(F.trim("o_orderpriority")))
    o = t.orders.select("o_custkey", "o_orderkey", txt.alias("txt"))
    first = o.groupBy("o_custkey", F.lower("txt").alias("low")).agg(F.min(F.struct("o_orderkey", "txt")).alias("m"))
    return first.groupBy("o_custkey").agg(F.array_join(F.transform(F.sort_array(F.collect_list("m")), lambda m: m["txt"]), " | ").alias("ocr"))


@query("""WITH o AS (SELECT o_custkey, o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN upper(trim(o_orderpriority)) ELSE lower(trim(o_orderpriority)) END AS txt FROM orders),
f AS (SELECT o_custkey, min(o_orderkey) AS k, arg_min(txt, o_orderkey) AS txt FROM o GROUP BY o_custkey, lower(txt)),
g AS (SELECT o_custkey, string_agg(txt, ' | ' ORDER BY k) AS ocr FROM f GROUP BY o_custkey)
SELECT c_custkey, coalesce(ocr, '') AS ocr FROM customer LEFT JOIN g ON c_custkey = o_custkey""")
def attach_text(t) -> DataFrame:
    return t.customer.select("c_custkey").join(_ocr(t).withColumnRenamed("o_custkey", "c_custkey"), "c_custkey", "left").select("c_custkey", F.coalesce("ocr", F.lit("")).alias("ocr"))


@query(f"""WITH {SEG}, m AS (SELECT seg_id, frame_id, abs(ts - lo) AS gap, row_number() OVER (PARTITION BY seg_id ORDER BY abs(ts - lo), frame_id) AS n
FROM seg JOIN frm ON seg."user" = frm."user" AND abs(ts - lo) <= 20000)
SELECT seg.seg_id, m.frame_id, round(gap, 3) AS gap FROM seg LEFT JOIN m ON seg.seg_id = m.seg_id AND n = 1""")
def nearest_frame(t) -> DataFrame:
    out = intervals.nearest(segments(t), frames(t), ["user"], "lo", "ts", 20000.0, ["seg_id"], ["frame_id"])
    return out.select("seg_id", "frame_id", F.round(F.abs(F.col("ts") - F.col("lo")), 3).alias("gap"))


@query(f"""WITH {SEG} SELECT seg_id, frame_id FROM (SELECT seg_id, frame_id, row_number() OVER (PARTITION BY seg_id ORDER BY abs(ts - (lo + hi) / 2), frame_id) AS n
FROM seg JOIN frm ON seg."user" = frm."user" AND ts BETWEEN lo AND hi) WHERE n = 1""")
def midpoint_frame(t) -> DataFrame:
    pairs = intervals.points_in_intervals(segments(t), frames(t), ["user"], "lo", "hi", "ts", 86400.0)
    return intervals.midpoint_pick(pairs, ["seg_id"], "lo", "hi", "ts", ["frame_id"]).select("seg_id", "frame_id")


@query(f"""WITH {SEG}, f AS (SELECT *, CASE WHEN lo <= max(hi) OVER (PARTITION BY "user" ORDER BY lo, seg_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 3600 THEN 0 ELSE 1 END AS f FROM seg),
g AS (SELECT *, sum(f) OVER (PARTITION BY "user" ORDER BY lo, seg_id ROWS UNBOUNDED PRECEDING) AS island FROM f)
SELECT "user", island::BIGINT AS island, count(*) AS n, round(min(lo), 3) AS lo, round(max(hi), 3) AS hi, string_agg(seg_id::VARCHAR, ',' ORDER BY lo, seg_id) AS members FROM g GROUP BY ALL""")
def interval_merge(t) -> DataFrame:
    return islands(t)


def islands(t, spread: bool = False) -> DataFrame:
    m = intervals.merge_intervals(segments(t), ["user"], "lo", "hi", 3600.0, ["seg_id"], spread)
    ids = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("lo", "seg_id"))), lambda x: x["seg_id"].cast("string")), ",")
    return m.groupBy("user", "island").agg(F.count("*").alias("n"), F.round(F.min("lo"), 3).alias("lo"), F.round(F.max("hi"), 3).alias("hi"), ids.alias("members"))


@query(f"""WITH {SEG}, c AS (SELECT seg_id, lo, hi, unnest(range(0, greatest(ceil((hi - lo - 30000) / 25000), 0)::BIGINT + 1)) AS chunk FROM seg WHERE hi > lo)
SELECT seg_id, chunk, round(lo + chunk * 25000, 3) AS chunk_start, round(least(lo + chunk * 25000 + 30000, hi), 3) AS chunk_end FROM c""")
def chunk_windows(t) -> DataFrame:
    out = intervals.chunks(segments(t), "lo", "hi", 30000.0, 5000.0)
    return out.select("seg_id", "chunk", F.round("chunk_start", 3).alias("chunk_start"), F.round("chunk_end", 3).alias("chunk_end"))


@query(f"""WITH {SPEECH}, near AS (SELECT frame_id, said_id, true AS in_window FROM frm JOIN said ON frm."user" = said."user" AND e >= ts - 7200 AND s <= ts + 7200)
SELECT * FROM near UNION ALL SELECT frame_id, said_id, false FROM frm JOIN said ON frm."user" = said."user" WHERE frame_id NOT IN (SELECT frame_id FROM near)""")
def docs_around(t) -> DataFrame:
    said = D.events(t).where("kind = 'error'").select(F.col("event_id").alias("said_id"), "user", F.col("at").alias("s"), (F.col("at") + F.col("value") * 200).alias("e"))
    return intervals.around_or_all(frames(t), said, ["user"], ["frame_id"], "ts", 7200.0, 86400.0, seg=("s", "e")).select("frame_id", "said_id", "in_window")


@query(f"""WITH {SEG}, p AS (SELECT seg_id, frame_id, ts, row_number() OVER (PARTITION BY seg_id ORDER BY ts, frame_id) - 1 AS r, count(*) OVER (PARTITION BY seg_id) AS n
FROM seg JOIN frm ON seg."user" = frm."user" AND ts BETWEEN lo - 8000 AND hi + 8000)
SELECT seg_id, frame_id FROM p WHERE n <= 4 OR list_contains(list_transform(range(0, 4), lambda i: (i * n) // 4), r)""")
def enrich_frames(t) -> DataFrame:
    """Each segment with up to four frames, evenly spread over it and 8000 s around."""
    wide = segments(t).withColumn("lo", F.col("lo") - 8000).withColumn("hi", F.col("hi") + 8000)
    pairs = intervals.points_in_intervals(wide, frames(t), ["user"], "lo", "hi", "ts", 86400.0)
    return ranking.even_sample(pairs, 4, ["seg_id"], ["ts", "frame_id"]).select("seg_id", "frame_id")


SERIES = """e AS (SELECT user_id AS "user", event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i, value / max(value) OVER (PARTITION BY user_id) AS p,
  count(*) OVER (PARTITION BY user_id) AS n FROM events)"""


def series(t) -> DataFrame:
    w = Window.partitionBy("user_id")
    return t.events.select(F.col("user_id").alias("user"), (F.row_number().over(w.orderBy("ts", "event_id")) - 1).alias("i"), (F.col("value") / F.max("value").over(w)).alias("p"))


@query(f"""WITH {SERIES}, c AS (SELECT *, i = 0 OR (p > 0.3 AND NOT lag(p > 0.3) OVER (PARTITION BY "user" ORDER BY i)) AS cut FROM e),
s AS (SELECT "user", row_number() OVER w AS number, i AS start_frame, coalesce(lead(i) OVER w, n) - 1 AS end_frame FROM c WHERE cut WINDOW w AS (PARTITION BY "user" ORDER BY i))
SELECT *, round_even(start_frame / 25.0::DOUBLE, 3) AS start, round_even((end_frame + 1) / 25.0::DOUBLE, 3) AS "end" FROM s""")
def shots_from_transitions(t) -> DataFrame:
    return sequences.shots_from_scores(series(t), ["user"], "i", "p", F.lit(25.0), 0.3)


@query(f"""WITH {SERIES}, c AS (SELECT * FROM e WHERE i = 0 OR p > 0.3),
s AS (SELECT "user", row_number() OVER w AS number, i AS start_frame, coalesce(lead(i) OVER w, n) AS end_frame FROM c WINDOW w AS (PARTITION BY "user" ORDER BY i))
SELECT *, start_frame + 1 AS first_key, (start_frame + end_frame) // 2 AS middle_key, end_frame - 1 AS last_key FROM s WHERE end_frame - start_frame >= 3""")
def legacy_shots(t) -> DataFrame:
    return sequences.legacy_shots(series(t), ["user"], "i", "p", 0.3)


@query("""WITH s AS (SELECT event_id, value AS d, floor(value * 25)::BIGINT AS span FROM events),
c AS (SELECT *, CASE WHEN d < 1 THEN [0.5::DOUBLE] WHEN d > 10 THEN list_transform(range(0, greatest(1, least(40, floor(d / greatest(3.0, d / 40))::BIGINT))), lambda i: least(0.98::DOUBLE, i * greatest(3.0::DOUBLE, d / 40) / d))
  ELSE [0.1::DOUBLE, 0.5, 0.9] END AS fr FROM s)
SELECT event_id, array_to_string(list_sort(list_distinct(list_transform(fr, lambda f: least(greatest(round_even(f * span, 0)::BIGINT + 100, 100), 100 + span)))), ',') AS positions FROM c""")
def keyframe_positions(t) -> DataFrame:
    pos = sequences.keyframe_positions(F.lit(0.0), F.col("value"), F.lit(100).cast("long"), F.floor(F.col("value") * 25))
    return t.events.select("event_id", F.array_join(F.transform(pos, lambda x: x.cast("string")), ",").alias("positions"))


@query(f"""WITH {D.EVENTS}, g AS (SELECT *, CASE WHEN sec - lag(sec + value) OVER w <= 20000 THEN 0 ELSE 1 END AS f FROM ev WINDOW w AS (PARTITION BY "user" ORDER BY sec, event_id)),
s AS (SELECT *, sum(f) OVER (PARTITION BY "user" ORDER BY sec, event_id ROWS UNBOUNDED PRECEDING) AS session FROM g)
SELECT "user", session::BIGINT AS session, count(*) AS n, round(min(sec), 3) AS first_at, round(max(sec), 3) AS last_at FROM s GROUP BY ALL""")
def gap_segments(t) -> DataFrame:
    return sessions(t)


def sessions(t, spread: bool = False) -> DataFrame:
    e = D.events(t).withColumn("till", F.col("at") + F.col("value"))
    s = sequences.gap_sessions(e, ["user"], ["at", "event_id"], "at", "till", 20000.0, spread)
    return s.groupBy("user", "session").agg(F.count("*").alias("n"), F.round(F.min("at"), 3).alias("first_at"), F.round(F.max("at"), 3).alias("last_at"))


def words(t) -> DataFrame:
    """Words of each conversation, 0.4 s apart, with a pause of 1 s more between turns."""
    ws = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    rows = t.conversations.select("conv_id", "turn", F.posexplode(ws).alias("k", "text"))
    n = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "k")) - 1
    rows = rows.withColumn("ord", n).withColumn("start_time", F.round(F.col("ord") * 0.4 + F.col("turn") * 1.0, 3))
    return rows.withColumn("end_time", F.round(F.col("start_time") + 0.35, 3))


@query("""WITH RECURSIVE w AS (SELECT conv_id, turn, unnest(l) AS text, generate_subscripts(l, 1) AS k FROM (SELECT conv_id, turn,
    list_filter(regexp_split_to_array(text, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS l FROM conversations)),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, k) - 1 AS ord FROM w),
x AS (SELECT conv_id, ord, text, round(ord * 0.4::DOUBLE + turn, 3) AS s, round(round(ord * 0.4::DOUBLE + turn, 3) + 0.35::DOUBLE, 3) AS e FROM o),
f AS (SELECT conv_id, ord, text, s, e, 1::BIGINT AS seg, s AS first FROM x WHERE ord = 0
  UNION ALL SELECT x.conv_id, x.ord, x.text, x.s, x.e, seg + CASE WHEN x.s - f.e > 0.6 OR x.e - first > 15 THEN 1 ELSE 0 END,
    CASE WHEN x.s - f.e > 0.6 OR x.e - first > 15 THEN x.s ELSE first END FROM f JOIN x ON x.conv_id = f.conv_id AND x.ord = f.ord + 1)
SELECT conv_id, seg AS seg_no, string_agg(text, ' ' ORDER BY ord) AS text, min(s) AS start, max(e) AS "end" FROM f GROUP BY ALL""")
def word_segments(t) -> DataFrame:
    return sequences.word_segments(words(t), ["conv_id"])


@query("""WITH l AS (SELECT user_id, '[' || lpad((r // 60)::VARCHAR, 2, '0') || ':' || lpad((r % 60)::VARCHAR, 2, '0') || '] ' || event_type AS line, r FROM
  (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS r FROM events)),
g AS (SELECT user_id, list(line ORDER BY r) AS l, string_agg(line, ' ' ORDER BY r) AS whole FROM l GROUP BY user_id),
s AS (SELECT *, greatest(1, len(l) // greatest(1, 300 // greatest(1, length(whole) // len(l) + 1))) AS step FROM g)
SELECT user_id, CASE WHEN length(whole) <= 300 THEN whole ELSE substring(array_to_string(list_filter(l, lambda x, i: (i - 1) % step = 0), ' '), 1, 300) END AS digest FROM s""")
def digest(t) -> DataFrame:
    from lodestrand.functions.strings import mmss

    r = (F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1).alias("r")
    lines = t.events.select("user_id", "event_type", r).select("user_id", "r", F.concat_ws(" ", mmss(F.col("r").cast("double")), "event_type").alias("line"))
    return sequences.digest(lines, ["user_id"], ["r"], "line", 300)


@query(f"WITH {SERIES} SELECT event_id, p FROM (SELECT event_id, i, round(p, 9) AS p FROM e) WHERE i % 5 = 0")
def modulo_sample(t) -> DataFrame:
    w = Window.partitionBy("user_id")
    rows = t.events.select("event_id", (F.row_number().over(w.orderBy("ts", "event_id")) - 1).alias("i"), F.round(F.col("value") / F.max("value").over(w), 9).alias("p"))
    return rows.where("i % 5 = 0").select("event_id", "p")


@query(f"""WITH {SERIES} SELECT "user", i, round(avg(p) OVER (PARTITION BY "user" ORDER BY i ROWS BETWEEN 25 PRECEDING AND 74 FOLLOWING), 9) AS mean, i // 50 AS block FROM e""")
def sliding_windows(t) -> DataFrame:
    w = Window.partitionBy("user").orderBy("i").rowsBetween(-25, 74)
    return series(t).select("user", "i", F.round(F.avg("p").over(w), 9).alias("mean"), F.expr("i div 50").alias("block"))


@query("""SELECT p_partkey, list_transform(range(0, 10), lambda i: least(p_size * 30 - 1, floor((i + 0.5) * (p_size * 30) / 10)::BIGINT))[k] AS frame, k - 1 AS k FROM part, (SELECT unnest(range(1, 11)) AS k)""")
def uniform_frames(t) -> DataFrame:
    frames_ = sequences.uniform_frames(F.col("p_size").cast("long") * 30, 10)
    return t.part.select("p_partkey", F.posexplode(frames_).alias("k", "frame"))


@query(f"""WITH {D.EVENTS} SELECT event_id, "user" FROM (SELECT *, row_number() OVER (PARTITION BY "user" ORDER BY sec, event_id) - 1 AS r FROM ev WHERE sec BETWEEN 100000 AND 900000) WHERE r % 2 = 0 AND r < 20""")
def time_range_fetch(t) -> DataFrame:
    """Up to ten events of each user in a span of time, every other one."""
    rows = D.events(t).where("at between 100000 and 900000")
    return rows.withColumn("r", F.row_number().over(Window.partitionBy("user").orderBy("at", "event_id")) - 1).where("r % 2 = 0 and r < 20").select("event_id", "user")


MANIFEST = """m AS (SELECT o_custkey AS id, o_orderpriority AS stage, CASE o_orderstatus WHEN 'F' THEN 'failed' WHEN 'O' THEN 'done' ELSE 'running' END AS status, o_orderkey AS seq, o_orderdate AS day,
  CASE WHEN o_orderstatus = 'F' THEN 'boom ' || o_orderkey END AS error FROM orders),
l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id, stage ORDER BY day DESC, seq DESC) AS n FROM m) WHERE n = 1)"""


def stage_events(t) -> DataFrame:
    status = F.when(F.col("o_orderstatus") == "F", "failed").when(F.col("o_orderstatus") == "O", "done").otherwise("running")
    return t.orders.select(F.col("o_custkey").alias("id"), F.col("o_orderpriority").alias("stage"), status.alias("status"), F.col("o_orderkey").alias("seq"), F.col("o_orderdate").alias("at"), F.when(F.col("o_orderstatus") == "F", F.concat(F.lit("boom "), "o_orderkey")).alias("error"))


def stage_state(t) -> DataFrame:
    return state.latest(stage_events(t), ["id", "stage"], ["at", "seq"])


@query(f"WITH {MANIFEST} SELECT id, stage, status, error FROM l")
def manifest_latest(t) -> DataFrame:
    return stage_state(t).select("id", "stage", "status", "error")


@query(f"WITH {MANIFEST} SELECT c_custkey AS id FROM customer WHERE c_custkey NOT IN (SELECT id FROM l WHERE stage = '1-URGENT' AND status = 'done')")
def manifest_pending(t) -> DataFrame:
    return state.pending(t.customer.select(F.col("c_custkey").alias("id")), stage_state(t), "id", "1-URGENT")


@query(f"WITH {MANIFEST} SELECT stage, count(*) FILTER (WHERE status = 'done') AS done, count(*) FILTER (WHERE status = 'failed') AS failed, count(DISTINCT id) AS ids FROM l GROUP BY stage")
def stage_done_counts(t) -> DataFrame:
    return stage_state(t).groupBy("stage").agg(F.count_if(F.col("status") == "done").alias("done"), F.count_if(F.col("status") == "failed").alias("failed"), F.count_distinct("id").alias("ids"))


@query("""WITH b AS (SELECT md5(p_name || '/' || p_brand) AS id, p_name || '/' || p_brand AS path, p_partkey AS v, p_type AS content FROM part)
SELECT id, path, v, content FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY v DESC) AS n FROM b) WHERE n = 1""")
def upsert_md5(t) -> DataFrame:
    path = F.concat_ws("/", "p_name", "p_brand")
    rows = t.part.select(state.document_id(F.lit(None).cast("string"), path).alias("id"), path.alias("path"), F.col("p_partkey").alias("v"), F.col("p_type").alias("content"))
    return state.upsert(rows.where("v % 3 <> 0"), rows.where("v % 3 = 0"), ["id"], "v")


@query("SELECT event_id FROM events WHERE event_id NOT IN (SELECT event_id FROM events WHERE value > 100) AND event_type IS DISTINCT FROM 'error'")
def delete_points(t) -> DataFrame:
    e = t.events.select("event_id", "event_type", "value")
    return state.delete_where(state.delete_ids(e, e.where("value > 100"), "event_id"), "event_type", "error").select("event_id")


SHOT_TIMES = """st AS (SELECT user_id, coalesce(max(value) FILTER (WHERE event_type = 'view'), min(value)) AS start_time, coalesce(max(value) FILTER (WHERE event_type = 'click'), max(value)) AS end_time FROM events GROUP BY user_id)"""


def _shot_times(t) -> DataFrame:
    pos = F.when(F.col("event_type") == "view", "start").when(F.col("event_type") == "click", "end").otherwise("middle")
    return state.shot_times(t.events.select("user_id", pos.alias("position"), "value"), ["user_id"], "position", "value")


@query(f"WITH {SHOT_TIMES} SELECT * FROM st")
def shot_time_fields(t) -> DataFrame:
    return _shot_times(t)


@query(f"WITH {SHOT_TIMES} SELECT count(*) AS checked, count(*) FILTER (WHERE start_time IS NOT NULL AND end_time IS NOT NULL) AS present, count(*) FILTER (WHERE start_time IS NULL OR end_time IS NULL) AS missing, count(*) FILTER (WHERE start_time > end_time) AS bad_range FROM st")
def verify_shot_times(t) -> DataFrame:
    return state.verify_shot_times(_shot_times(t))


@query("SELECT user_id, string_agg(event_type || '=' || v, ',' ORDER BY event_type) AS positions FROM (SELECT user_id, event_type, max(event_id) AS v FROM events GROUP BY ALL) GROUP BY user_id")
def positions_map(t) -> DataFrame:
    p = state.positions_by_shot(t.events, ["user_id"], "event_type", "event_id")
    return p.select("user_id", F.array_join(F.transform(F.map_entries("positions"), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string"))), ",").alias("positions"))


@query("""SELECT user_id, event_type, string_agg(event_id::VARCHAR, ',' ORDER BY ts NULLS LAST, event_id) AS ids FROM events GROUP BY ALL""")
def candidates_by_video(t) -> DataFrame:
    ids = F.transform(F.array_sort(F.collect_list(F.struct("ts", "event_id"))), lambda x: x["event_id"].cast("string"))
    return t.events.groupBy("user_id", "event_type").agg(F.array_join(ids, ",").alias("ids"))


@query("""SELECT p.p_partkey, CASE WHEN p.p_size < 10 THEN coalesce(s_name, p_name) ELSE p_name END AS name, CASE WHEN p.p_size < 10 THEN coalesce(s_acctbal, p_retailprice) ELSE p_retailprice END AS price
FROM part p LEFT JOIN supplier ON s_suppkey = p_partkey % 150""")
def repair_metadata(t) -> DataFrame:
    results = t.part.select("p_partkey", (F.col("p_partkey") % 150).alias("k"), F.col("p_name").alias("name"), F.col("p_retailprice").alias("price"), "p_size")
    canon = t.supplier.select(F.col("s_suppkey").alias("k"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("price"))
    return state.repair(results, canon, "k", ["name", "price"], F.col("p_size") < 10).select("p_partkey", "name", "price")


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'MACHINERY')")
def semi_questions(t) -> DataFrame:
    there = t.customer.where("c_mktsegment = 'MACHINERY'").select(F.col("c_custkey").alias("o_custkey"))
    return t.orders.select("o_orderkey", "o_custkey").join(there, "o_custkey", "left_semi")


@query("SELECT lpad((c_custkey % 200)::VARCHAR, 3, '0') AS video_id, c_custkey, lpad((c_custkey % 200)::VARCHAR, 3, '0') BETWEEN '001' AND '050' AS dev FROM customer")
def dev_test_split(t) -> DataFrame:
    vid = F.lpad((F.col("c_custkey") % 200).cast("string"), 3, "0")
    return t.customer.select(vid.alias("video_id"), "c_custkey", vid.between("001", "050").alias("dev"))


@query("SELECT 'events' AS name, count(*) AS n, count(DISTINCT user_id) AS ids FROM events UNION ALL SELECT 'orders', count(*), count(DISTINCT o_custkey) FROM orders UNION ALL SELECT 'documents', count(*), count(DISTINCT source) FROM documents")
def store_stats(t) -> DataFrame:
    one = lambda df, name, c: df.agg(F.lit(name).alias("name"), F.count("*").alias("n"), F.count_distinct(c).alias("ids"))
    return one(t.events, "events", "user_id").unionByName(one(t.orders, "orders", "o_custkey")).unionByName(one(t.documents, "documents", "source"))


@query("SELECT event_id, user_id, value FROM events WHERE event_id IN (SELECT event_id FROM events WHERE user_id = 7)")
def point_lookup(t) -> DataFrame:
    rows = t.events.select("event_id", "user_id", "value")
    return state.unique_lookup(rows.withColumn("path", F.col("event_id")), rows.where("user_id = 7").select(F.col("event_id").alias("path")), "path", "event_id").select("event_id", "user_id", "value")


@query("SELECT event_type, count(*) AS n, round(avg(value), 9) AS mean, max(value) AS top FROM events GROUP BY event_type")
def detection_stats(t) -> DataFrame:
    return t.events.groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.avg("value"), 9).alias("mean"), F.max("value").alias("top"))


@query("""WITH r AS (SELECT o_orderkey, 'dir' || o_custkey % 3 || '/' || (o_orderkey % 500) || '.jpg' AS path FROM orders),
k AS (SELECT min(p_partkey) AS p_partkey, p_partkey % 500 || '.jpg' AS name FROM part GROUP BY name)
SELECT o_orderkey, p_partkey FROM r JOIN k ON regexp_replace(path, '.*/', '') = name""")
def ocr_join_basename(t) -> DataFrame:
    """Results matched to records on the file's name, the first record of equals."""
    from lodestrand.functions.strings import basename

    path = F.concat(F.lit("dir"), F.col("o_custkey") % 3, F.lit("/"), F.col("o_orderkey") % 500, F.lit(".jpg"))
    r = t.orders.select("o_orderkey", basename(path).alias("name"))
    k = t.part.select("p_partkey", F.concat(F.col("p_partkey") % 500, F.lit(".jpg")).alias("name")).groupBy("name").agg(F.min("p_partkey").alias("p_partkey"))
    return r.join(k, "name").select("o_orderkey", "p_partkey")


@query("SELECT o_orderpriority AS batch, count(*) AS n_results, count(*) FILTER (WHERE o_orderstatus = 'O') AS n_ok, count(*) > 0 AND count(*) FILTER (WHERE o_orderstatus = 'O') = 0 AS failed FROM orders GROUP BY 1")
def ocr_status(t) -> DataFrame:
    ok = F.count_if(F.col("o_orderstatus") == "O")
    return t.orders.groupBy(F.col("o_orderpriority").alias("batch")).agg(F.count("*").alias("n_results"), ok.alias("n_ok"), ((F.count("*") > 0) & (ok == 0)).alias("failed"))


#: Spans of a second to ten years, which an interval join has to take in one table.
LONG = """iv AS (SELECT o_orderkey AS k, o_custkey AS c, (o_orderkey * 37 % 100000)::DOUBLE * 1000 AS lo, (o_orderkey * 37 % 100000)::DOUBLE * 1000 + 10.0 ** (o_orderkey % 9) AS hi FROM orders),
pt AS (SELECT l_orderkey AS k, l_linenumber AS n, o_custkey AS c, (l_partkey * 7919 % 100000)::DOUBLE * 1000 + l_linenumber * 0.25::DOUBLE AS pos FROM lineitem JOIN orders ON o_orderkey = l_orderkey)"""


def _long_spans(t) -> DataFrame:
    lo = (F.col("o_orderkey") * 37 % 100000).cast("double") * 1000
    return t.orders.select(F.col("o_orderkey").alias("k"), F.col("o_custkey").alias("c"), lo.alias("lo"), (lo + F.pow(F.lit(10.0), F.col("o_orderkey") % 9)).alias("hi"))


@query(f"WITH {LONG} SELECT iv.k AS span, pt.k AS line, n FROM iv JOIN pt ON iv.c = pt.c AND pos BETWEEN lo AND hi", longs="n")
def points_in_long_spans(t) -> DataFrame:
    """Points in intervals whose lengths differ by eight powers of ten."""
    at = (F.col("l_partkey") * 7919 % 100000).cast("double") * 1000 + F.col("l_linenumber") * 0.25
    points = t.lineitem.join(t.orders.select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("c")), "l_orderkey").select(F.col("l_orderkey").alias("line"), F.col("l_linenumber").alias("n"), "c", at.alias("at"))
    return intervals.points_in_intervals(_long_spans(t), points, ["c"], "lo", "hi", "at", 1.0).select(F.col("k").alias("span"), "line", "n")


@query(f"WITH {LONG} SELECT a.k AS a, b.k AS b FROM iv a JOIN iv b ON a.c = b.c AND b.hi >= a.lo - 1.5 AND b.lo <= a.hi + 1.5")
def overlapping_long_spans(t) -> DataFrame:
    """Pairs of such intervals that touch."""
    a = _long_spans(t).withColumnRenamed("k", "a")
    return intervals.overlaps(a, _long_spans(t).select(F.col("k").alias("b"), "c", F.col("lo").alias("s"), F.col("hi").alias("e")), ["c"], 1.5, 1.0, seg=("s", "e")).select("a", "b")
