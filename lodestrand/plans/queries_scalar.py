"""Queries of scalar functions: identifiers, times, options, prompts, weights."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrand.functions import strings as S
from lodestrand.operators import prompts
from lodestrand.plans.registry import query

r9 = lambda c: F.round(c, 9)


@query("""WITH k AS (SELECT o_orderkey, sha1(unhex('6f3a1e840d2b4c7e9f158b2d4a6c1e90') || encode(lpad((o_custkey % 900)::VARCHAR, 3, '0') || ':' || (o_orderkey % 50) || ':' || o_orderkey)) AS h FROM orders)
SELECT o_orderkey, h[1:8] || '-' || h[9:12] || '-5' || h[14:16] || '-' || substr('89ab', (('0x' || h[17])::INT & 3) + 1, 1) || h[18:20] || '-' || h[21:32] AS id FROM k""")
def uuid5_ids(t) -> DataFrame:
    video = F.lpad((F.col("o_custkey") % 900).cast("string"), 3, "0")
    return t.orders.select("o_orderkey", S.point_id(video, F.col("o_orderkey") % 50, F.col("o_orderkey")).alias("id"))


@query("""SELECT event_id, lpad(user_id::VARCHAR, 3, '0') || '_shot_' || lpad((event_id % 120)::VARCHAR, 3, '0') AS shot_id, lpad(user_id::VARCHAR, 3, '0') || '.mp4' AS filename,
lpad((floor(value / 60))::INT::VARCHAR, 2, '0') || ':' || lpad(printf('%.2f', value - floor(value / 60) * 60), 5, '0') AS stamp FROM events""")
def payload_struct(t) -> DataFrame:
    """The nested payload, flattened for comparison."""
    video = F.lpad(F.col("user_id").cast("string"), 3, "0")
    payload = F.struct(
        S.shot_id(video, (F.col("event_id") % 120).cast("int")).alias("shot_id"),
        F.struct(video.alias("name"), F.concat(video, F.lit(".mp4")).alias("filename")).alias("video"),
        F.struct(F.col("value").alias("timestamp_seconds"), S.minutes_seconds("value").alias("timestamp_formatted")).alias("frame"),
    )
    p = t.events.select("event_id", payload.alias("p"))
    return p.select("event_id", F.col("p.shot_id").alias("shot_id"), F.col("p.video.filename").alias("filename"), F.col("p.frame.timestamp_formatted").alias("stamp"))


@query(r"""WITH c AS (SELECT o_orderkey, CASE o_orderkey % 7 WHEN 0 THEN NULL WHEN 1 THEN '  ' WHEN 2 THEN 'unknown' WHEN 3 THEN 'talk' || o_custkey || '.wav' WHEN 4 THEN 'c/clip' || o_custkey || '__SHOT_1.GIF' ELSE 'a/b/' || o_custkey || '__shot_' || o_orderkey || '.jpg' END AS a,
  CASE o_orderkey % 3 WHEN 0 THEN 'UNKNOWN' ELSE 'x\' || lpad((o_custkey % 300)::VARCHAR, 3, '0') || '.MP4.json' END AS b, 'v' || o_orderkey AS c FROM orders),
s AS (SELECT o_orderkey, i, trim(regexp_replace(regexp_replace(regexp_replace(replace(trim(x), '\', '/'), '^.*/', ''), '(?i)(?:\.(?:mp4|mkv|avi|webm|mov|flv|wmv|jpg|jpeg|png|webp|gif|json))+$', ''), '(?i)__(?:shot|pos|frame|ts)_.*$', '')) AS x
  FROM (SELECT o_orderkey, unnest([a, b, c]) AS x, unnest([1, 2, 3]) AS i FROM c))
SELECT o_orderkey, arg_min(x, i) FILTER (WHERE x IS NOT NULL AND x <> '' AND lower(x) <> 'unknown') AS video_id FROM s GROUP BY o_orderkey""")
def canonical_id(t) -> DataFrame:
    k, cust = F.col("o_orderkey"), F.col("o_custkey")
    a = F.when(k % 7 == 1, "  ").when(k % 7 == 2, "unknown").when(k % 7 == 3, F.concat(F.lit("talk"), cust, F.lit(".wav"))).when(k % 7 == 4, F.concat(F.lit("c/clip"), cust, F.lit("__SHOT_1.GIF")))
    a = a.when(k % 7 > 4, F.concat(F.lit("a/b/"), cust, F.lit("__shot_"), k, F.lit(".jpg")))
    b = F.when(k % 3 == 0, "UNKNOWN").otherwise(F.concat(F.lit("x\\"), F.lpad((cust % 300).cast("string"), 3, "0"), F.lit(".MP4.json")))
    return t.orders.select("o_orderkey", S.canonical_video_id(a, b, F.concat(F.lit("v"), k)).alias("video_id"))


@query("""WITH x AS (SELECT event_id, CASE event_id % 4 WHEN 0 THEN '01:' || lpad((event_id % 60)::VARCHAR, 2, '0') || ':07.5' WHEN 1 THEN (event_id % 90) || ':30' WHEN 2 THEN 'bad:x' ELSE '12' END AS s FROM events),
p AS (SELECT event_id, s, string_split(trim(s), ':') AS p FROM x)
SELECT event_id, s, CASE WHEN len(p) = 3 THEN TRY_CAST(p[1] AS DOUBLE) * 3600 + TRY_CAST(p[2] AS DOUBLE) * 60 + TRY_CAST(p[3] AS DOUBLE) WHEN len(p) = 2 THEN TRY_CAST(p[1] AS DOUBLE) * 60 + TRY_CAST(p[2] AS DOUBLE) END AS seconds FROM p""")
def parse_hms(t) -> DataFrame:
    k = F.col("event_id")
    s = F.when(k % 4 == 0, F.concat(F.lit("01:"), F.lpad((k % 60).cast("string"), 2, "0"), F.lit(":07.5"))).when(k % 4 == 1, F.concat(k % 90, F.lit(":30"))).when(k % 4 == 2, "bad:x").otherwise("12")
    return t.events.select("event_id", s.alias("s"), S.parse_hms(s).alias("seconds"))


@query("""SELECT event_id, '[' || lpad((s // 60)::VARCHAR, 2, '0') || ':' || lpad((s % 60)::VARCHAR, 2, '0') || ']' AS mmss,
lpad((z // 3600)::VARCHAR, 2, '0') || ':' || lpad((z // 60 % 60)::VARCHAR, 2, '0') || ':' || lpad((z % 60)::VARCHAR, 2, '0') AS hms,
lpad((z // 3600)::VARCHAR, 2, '0') || ':' || lpad((z // 60 % 60)::VARCHAR, 2, '0') || ':' || lpad((z % 60)::VARCHAR, 2, '0') || ',000' AS srt
FROM (SELECT event_id, floor(value)::BIGINT AS s, event_id % 9000 AS z FROM events)""")
def mmss(t) -> DataFrame:
    z = (F.col("event_id") % 9000).cast("double")
    return t.events.select("event_id", S.mmss("value").alias("mmss"), S.hours_minutes_seconds(z).alias("hms"), S.srt_time(z).alias("srt"))


@query(r"""WITH q AS (SELECT p_partkey, 'intro A. ' || p_name || '  B. ' || p_brand || ' C. ' || p_type || CASE WHEN p_size > 25 THEN ' D. ' || p_size ELSE '' END AS txt FROM part),
o AS (SELECT p_partkey, list_filter(list_transform(string_split_regex(regexp_replace(txt, '(^|\s)([A-H]\.\s*)', chr(1) || '\2', 'g'), chr(1)), lambda x: trim(x)), lambda x: regexp_matches(x, '^[A-H]\.')) AS o FROM q)
SELECT p_partkey, len(o) AS n, array_to_string(o, '|') AS options FROM o""")
def parse_options(t) -> DataFrame:
    txt = F.concat(F.lit("intro A. "), "p_name", F.lit("  B. "), "p_brand", F.lit(" C. "), "p_type", F.when(F.col("p_size") > 25, F.concat(F.lit(" D. "), "p_size")).otherwise(""))
    o = S.parse_options(txt)
    return t.part.select("p_partkey", F.size(o).alias("n"), F.array_join(o, "|").alias("options"))


@query(r"""WITH r AS (SELECT o_orderkey, o_orderkey % 10 AS n, CASE o_orderkey % 6 WHEN 0 THEN 'Answer: d' WHEN 1 THEN 'Alice is the mother' WHEN 2 THEN 'A or B? I pick B' WHEN 3 THEN 'H' WHEN 4 THEN '' ELSE '(' || chr(65 + (o_orderkey % 9)::INT) || ').' END AS raw FROM orders)
SELECT o_orderkey, raw, list_filter(regexp_extract_all(upper(raw), '\b([A-H])\b', 1), lambda c: ascii(c) < 65 + greatest(1, least(8, CASE WHEN n = 0 THEN 8 ELSE n END)))[1] AS pred FROM r""")
def parse_letter(t) -> DataFrame:
    k = F.col("o_orderkey")
    raw = F.when(k % 6 == 0, "Answer: d").when(k % 6 == 1, "Alice is the mother").when(k % 6 == 2, "A or B? I pick B").when(k % 6 == 3, "H").when(k % 6 == 4, "").otherwise(F.concat(F.lit("("), F.char(65 + k % 9), F.lit(").")))
    return t.orders.select("o_orderkey", raw.alias("raw"), S.parse_letter(raw, (k % 10).cast("int")).alias("pred"))


@query("""SELECT o_orderkey, 'The first ' || (o_orderkey % 4) || ' images are spread over the whole video.' AS head,
CASE WHEN o_orderkey % 4 > 0 THEN 'The first ' || (o_orderkey % 4) || ' images are spread over the whole video.' || chr(10) || chr(10) ELSE '' END ||
CASE WHEN o_orderkey % 3 > 0 THEN 'Transcript: ' || o_orderpriority || chr(10) || chr(10) ELSE '' END ||
'Span 1: [' || lpad(((o_orderkey % 600) // 60)::VARCHAR, 2, '0') || ':' || lpad((o_orderkey % 60)::VARCHAR, 2, '0') || '] - [99:00]' || chr(10) || 'Speech: ' || o_orderpriority ||
chr(10) || chr(10) || 'Question: ' || o_custkey || '?' || chr(10) || chr(10) || 'A. x' || chr(10) || 'B. y' || chr(10) || chr(10) || 'Answer with the letter of the best option only.' AS prompt FROM orders""")
def prompt(t) -> DataFrame:
    k = F.col("o_orderkey")
    span = prompts.span_line(F.lit("Span 1"), (k % 600).cast("double"), F.lit(5940.0), F.col("o_orderpriority"), F.lit(""))
    text = prompts.mcq_prompt(F.concat("o_custkey", F.lit("?")), F.array(F.lit("A. x"), F.lit("B. y")), F.array(span), F.when(k % 3 > 0, F.col("o_orderpriority")).otherwise(""), (k % 4).cast("int"))
    return t.orders.select("o_orderkey", F.format_string("The first %d images are spread over the whole video.", (k % 4).cast("int")).alias("head"), text.alias("prompt"))


@query("SELECT event_id, round(CASE WHEN value - 5 <= 0 THEN 1.0 ELSE greatest(exp(-0.05::DOUBLE * (value - 5)), 0.001) END, 9) AS weight FROM events")
def decay(t) -> DataFrame:
    return t.events.select("event_id", r9(S.decay(F.col("value") - 5, 0.05)).alias("weight"))


@query("""SELECT event_id, coalesce(CASE WHEN event_id % 4 = 0 THEN value END, CASE WHEN event_id % 4 = 1 THEN value * 2 END, CASE WHEN event_id % 4 = 2 THEN 90.0 END, CASE WHEN event_id % 8 = 3 THEN (event_id % 100) / 25.0 END)::DOUBLE AS seconds FROM events""")
def coalesce_timestamps(t) -> DataFrame:
    k = F.col("event_id")
    when = lambda m, v: F.when(m, v)
    s = S.timestamp_seconds(when(k % 4 == 0, F.col("value")), when(k % 4 == 1, F.col("value") * 2), F.lit(None).cast("string"), when(k % 4 == 2, F.lit("01:30")), k % 100, when(k % 8 == 3, F.lit(25.0)))
    return t.events.select("event_id", s.alias("seconds"))


@query(r"""WITH n AS (SELECT o_orderkey, 'kf/' || lpad((o_custkey % 999)::VARCHAR, 3, '0') || '/' || lpad((o_custkey % 999)::VARCHAR, 3, '0') || '__shot_' || (o_orderkey % 40) || '__pos_middle__frame_' || o_orderkey || '__ts_' || (o_orderkey % 60) || '.5.jpg' AS p FROM orders)
SELECT o_orderkey, lpad(regexp_extract(p, '^kf/([0-9]{3})/', 1), 3, '0') AS video, regexp_extract(p, '__shot_([0-9]+)', 1)::BIGINT AS shot, 'middle' AS pos, o_orderkey AS frame, (o_orderkey % 60) + 0.5::DOUBLE AS ts, regexp_extract(p, '^kf/([0-9]{3})/', 1) AS inferred, o_orderkey AS frame_id FROM n""")
def parse_names(t) -> DataFrame:
    v = F.lpad((F.col("o_custkey") % 999).cast("string"), 3, "0")
    p = F.concat(F.lit("kf/"), v, F.lit("/"), v, F.lit("__shot_"), F.col("o_orderkey") % 40, F.lit("__pos_middle__frame_"), "o_orderkey", F.lit("__ts_"), F.col("o_orderkey") % 60, F.lit(".5.jpg"))
    n = S.parse_keyframe_name(p)
    return t.orders.select("o_orderkey", n["video"].alias("video"), n["shot"].alias("shot"), n["pos"].alias("pos"), n["frame"].alias("frame"), n["ts"].alias("ts"), S.infer_video(p).alias("inferred"), S.frame_id(F.lit(None), S.basename(p), p).alias("frame_id"))


@query(r"""WITH n AS (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'L01_V001' WHEN 1 THEN lpad((p_partkey % 1000)::VARCHAR, 3, '0') WHEN 2 THEN p_name ELSE 'l2_v7x' END AS name, p_size % 2 = 0 AS has FROM part)
SELECT p_partkey, regexp_matches(name, '(?i)^(?:[A-Z][0-9]+_V[0-9]+|[0-9]{3})$') AS known, NOT (regexp_matches(name, '(?i)^(?:[A-Z][0-9]+_V[0-9]+|[0-9]{3})$') AND has) AS repair FROM n""")
def needs_repair(t) -> DataFrame:
    k = F.col("p_partkey")
    name = F.when(k % 4 == 0, "L01_V001").when(k % 4 == 1, F.lpad((k % 1000).cast("string"), 3, "0")).when(k % 4 == 2, F.col("p_name")).otherwise("l2_v7x")
    known = S.is_video_name(name)
    return t.part.select("p_partkey", known.alias("known"), (~(known & (F.col("p_size") % 2 == 0))).alias("repair"))


@query("""SELECT p_partkey, CASE WHEN p_size % 3 = 2 THEN NULL ELSE p_name END AS text0, CASE WHEN p_size % 3 = 1 THEN p_brand END AS text1, len(list_filter(string_split_regex(p_name || '  x ', '\\s+'), lambda w: w <> '')) AS words FROM part""")
def parse_replies(t) -> DataFrame:
    """Fenced and malformed replies of a model, padded to two pairs."""
    one = lambda c: F.concat(F.lit('{"text": "'), c, F.lit('", "caption": "c"}'))
    reply = F.when(F.col("p_size") % 3 == 0, one(F.col("p_name"))).when(F.col("p_size") % 3 == 1, F.concat(F.lit("```json\n["), one(F.col("p_name")), F.lit(","), one(F.col("p_brand")), F.lit("]\n```"))).otherwise("oops {")
    pairs = S.parse_pairs(reply, 2)
    return t.part.select("p_partkey", F.get(pairs, F.lit(0))["text"].alias("text0"), F.get(pairs, F.lit(1))["text"].alias("text1"), S.word_count(F.concat("p_name", F.lit("  x "))).alias("words"))


@query("SELECT p_partkey, least(p_size * 40, trunc(p_size * 40 * least(1.0::DOUBLE, 448.0::DOUBLE / greatest(p_size * 40, 300))))::BIGINT AS w, trunc(300 * least(1.0::DOUBLE, 448.0::DOUBLE / greatest(p_size * 40, 300)))::BIGINT AS h FROM part")
def resize(t) -> DataFrame:
    s = S.shrink(F.col("p_size") * 40, F.lit(300), 448)
    return t.part.select("p_partkey", s["width"].alias("w"), s["height"].alias("h"))


@query("SELECT event_id, coalesce(CASE WHEN event_id % 3 = 0 THEN value END, CASE WHEN event_id % 3 = 1 THEN value / 2 END, 0.0)::DOUBLE AS score FROM events")
def hit_score(t) -> DataFrame:
    k = F.col("event_id")
    return t.events.select("event_id", S.score_of(F.when(k % 3 == 0, F.col("value")), F.when(k % 3 == 1, F.col("value") / 2)).alias("score"))
