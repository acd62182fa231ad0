"""Queries of the operators around models and stages: evaluation joins, transcripts, table functions, resumed runs, checks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrand.functions import images, seams
from lodestrand.operators import intervals, sequences, state
from lodestrand.operators import textsearch as X
from lodestrand.plans import evaluate, pipeline, queries_interval, queries_stream
from lodestrand.plans.queries_text import index_of
from lodestrand.plans.registry import ORACLES, query
from lodestrand.sources import frames
from lodestrand.sources.sinks import new_folder
from lodestrand.streaming import flows

_ASKED = """q AS (SELECT lpad((p_partkey % 90)::VARCHAR, 3, '0') AS video_id, p_partkey AS k, chr(65 + (p_size % 4)::INT) AS answer, (p_size % 3 + 1)::VARCHAR AS level,
  CASE WHEN p_partkey % 2 = 0 THEN 'logic' ELSE 'relevance' END AS group_type FROM part),
p AS (SELECT o_orderkey AS k, CASE WHEN o_custkey % 5 < 4 THEN chr(65 + (o_custkey % 5)::INT) END AS pred FROM orders),
j AS (SELECT q.*, pred, coalesce(pred = answer, false) AS good FROM q LEFT JOIN p USING (k))"""


def _questions(t) -> DataFrame:
    k = F.col("p_partkey")
    kind = F.when(k % 2 == 0, "logic").otherwise("relevance").alias("group_type")
    return t.part.select(F.lpad((k % 90).cast("string"), 3, "0").alias("video_id"), k.cast("string").alias("question_id"), F.char(65 + F.col("p_size") % 4).alias("answer"), (F.col("p_size") % 3 + 1).cast("string").alias("level"), kind, F.lit("h").alias("second_head"))


def _predictions(t) -> DataFrame:
    letter = F.col("o_custkey") % 5
    return t.orders.select(F.col("o_orderkey").cast("string").alias("question_id"), F.when(letter < 4, F.char(65 + letter)).alias("pred"))


@query(f"""WITH {_ASKED} SELECT 'accuracy' AS metric, round(avg(good::INT), 9) AS value, count(*) AS n FROM j UNION ALL SELECT 'unparsed_rate', round(avg((pred IS NULL)::INT), 9), count(*) FROM j
UNION ALL SELECT 'level=' || level, round(avg(good::INT), 9), count(*) FROM j GROUP BY level UNION ALL SELECT 'second_head=h', round(avg(good::INT), 9), count(*) FROM j
UNION ALL SELECT 'dev', count(*) FILTER (WHERE video_id BETWEEN '001' AND '050'), count(*) FROM j""")
def judge_questions(t) -> DataFrame:
    """Questions with predictions, missing ones wrong and unparsed, summarised; and how many are of the dev split."""
    judged = evaluate.judge(_questions(t), _predictions(t))
    dev = evaluate.split_of(judged, "dev").agg(F.count("*").cast("double").alias("value")).select(F.lit("dev").alias("metric"), "value", F.lit(t.part.count()).alias("n"))
    return evaluate.summarise(judged).where("metric <> 'group_score'").unionByName(dev).select("metric", F.round("value", 9).alias("value"), "n")


@query(f"WITH {_ASKED} SELECT video_id, k::VARCHAR AS question_id, answer FROM q WHERE k = 42")
def question_lookup(t) -> DataFrame:
    return evaluate.lookup_question(_questions(t), "42").select("video_id", "question_id", "answer")


@query("""WITH s AS (SELECT conv_id, turn * 70.25::DOUBLE AS s, turn * 70.25::DOUBLE + 7.5 AS e, coalesce(text, '') AS x FROM conversations),
f AS (SELECT *, floor(s)::BIGINT AS a, floor(e)::BIGINT AS b, floor(s * 1000)::BIGINT AS ma, floor(e * 1000)::BIGINT AS mb, row_number() OVER (PARTITION BY conv_id ORDER BY s, e, x) AS n FROM s)
SELECT conv_id, string_agg(printf('[%02d:%02d:%02d - %02d:%02d:%02d] %s', a // 3600, a // 60 % 60, a % 60, b // 3600, b // 60 % 60, b % 60, x), chr(10) ORDER BY n) AS plain,
string_agg(n || chr(10) || printf('%02d:%02d:%02d,%03d --> %02d:%02d:%02d,%03d', ma // 3600000, ma // 60000 % 60, ma // 1000 % 60, ma % 1000, mb // 3600000, mb // 60000 % 60, mb // 1000 % 60, mb % 1000) || chr(10) || x,
  chr(10) || chr(10) ORDER BY n) AS srt FROM f GROUP BY conv_id""")
def transcripts(t) -> DataFrame:
    """Each conversation's texts as a transcript with times, and as numbered subtitle blocks."""
    at = F.col("turn") * 70.25
    rows = t.conversations.select("conv_id", at.alias("start"), (at + 7.5).alias("end"), F.coalesce("text", F.lit("")).alias("text"))
    plain = sequences.transcript_text(rows, ["conv_id"]).withColumnRenamed("transcript", "plain")
    return plain.join(sequences.transcript_text(rows, ["conv_id"], srt=True).withColumnRenamed("transcript", "srt"), "conv_id")


@query("""SELECT o_orderkey::VARCHAR AS video_id, CASE WHEN o_orderkey % 7 > 0 THEN upper(o_orderpriority) END AS said, CASE WHEN o_orderkey % 7 > 0 THEN 'done' ELSE 'failed' END AS status,
CASE WHEN o_orderkey % 7 = 0 THEN 'ValueError: no speech' END AS error FROM orders""")
def mapped_rows(t) -> DataFrame:
    """A table function over rows that fails for some and, for others, at its first try only."""

    def transcribe(row: dict) -> list[dict]:
        tries = []

        def once() -> str:
            tries.append(1)
            if row["n"] % 7 == 0:
                raise ValueError("no speech")
            if row["n"] % 3 == 0 and len(tries) < 2:
                raise TimeoutError("busy")
            return row["x"].upper()

        return [{"said": seams.retried(once, pauses=(0.0,))()}]

    rows = t.orders.select(F.col("o_orderkey").cast("string").alias("video_id"), F.col("o_orderkey").alias("n"), F.col("o_orderpriority").alias("x"))
    return seams.mapped(rows, transcribe, "said string").select("video_id", "said", "status", "error")


@query("""WITH v AS (SELECT lpad(p_partkey::VARCHAR, 7, '0') AS video_id, p_partkey AS k, row_number() OVER (ORDER BY lpad(p_partkey::VARCHAR, 7, '0')) AS n FROM part),
e AS (SELECT *, count(*) FILTER (WHERE NOT (n <= 50 AND k % 5 > 0)) OVER (ORDER BY n) AS open FROM v)
SELECT video_id, 'shots' AS stage, CASE WHEN k % 5 > 0 THEN 'done' ELSE 'failed' END AS status, 1 + (k % 5 = 0)::BIGINT AS tries FROM v
UNION ALL SELECT video_id, 'asr', 'done', 1 FROM v WHERE n <= 50""", longs="tries")
def resumed_run(t) -> DataFrame:
    """Two runs over one log: one stage twice, its failures again, a later stage for the first fifty videos only."""
    log = new_folder(t.spark, "log")
    videos = t.part.select(F.lpad(F.col("p_partkey").cast("string"), 7, "0").alias("video_id"))
    bad = F.col("video_id").cast("long") % 5 == 0
    shots = lambda todo: todo.select("video_id", F.when(bad, "failed").otherwise("done").alias("status"), F.when(bad, "no frames").alias("error"))
    asr = lambda todo: todo.select("video_id", F.lit("done").alias("status"), F.lit(None).cast("string").alias("error"))
    pipeline.run(t.spark, log, videos, {"shots": shots})
    pipeline.run(t.spark, log, videos, {"shots": shots})
    pipeline.run(t.spark, log, videos, {"asr": asr}, limit=50)
    events = pipeline.read_log(t.spark, log)
    tries = events.groupBy("video_id", "stage").agg(F.count("*").alias("tries"))
    return state.latest(events, ["video_id", "stage"], ["seq"]).join(tries, ["video_id", "stage"]).select("video_id", "stage", "status", "tries")


@query("""WITH s AS (SELECT event_id, value AS a, value + (event_id % 12) / 10.0::DOUBLE AS b FROM events)
SELECT event_id, round(b - a, 6) >= 0.5 AS window_ok, round(b - a, 6) >= 1.0 AS fixed_ok FROM s WHERE round(b - a, 6) > 0.2""")
def speech_spans(t) -> DataFrame:
    """Spans of speech that are long enough, with those long enough for a window and for one of fixed length."""
    spans = t.events.select("event_id", F.col("value").alias("start"), (F.col("value") + F.col("event_id") % 12 / 10).alias("end"))
    kept = sequences.at_least(spans, sequences.SPEECH, strictly=True)
    flag = lambda seconds, name: sequences.at_least(kept, seconds).select("event_id", F.lit(True).alias(name))
    out = kept.select("event_id").join(flag(sequences.WINDOW, "window_ok"), "event_id", "left").join(flag(sequences.FIXED_WINDOW, "fixed_ok"), "event_id", "left")
    return out.na.fill(False)


def _above_mean():
    """A scorer that depends on the whole window and on the place in it; a closure, so that it is sent to workers by value."""
    return lambda window: window - window.mean() + [i / 1000 for i in range(len(window))]


_SCORES = f"""WITH {queries_interval.SERIES}, l AS (SELECT "user", list(p ORDER BY i) AS v, count(*) AS n FROM e GROUP BY "user"),
w AS (SELECT "user", n, v, 50 * unnest(range(0, (n + 49) // 50)) AS b FROM l),
m AS (SELECT *, list_avg(list_transform(range(b - 25, b + 75), lambda j: v[greatest(0, least(n - 1, j)) + 1])) AS mean FROM w)
SELECT "user", i, round(v[i + 1] - mean + (25 + i - b) / 1000.0::DOUBLE, 9) AS p FROM (SELECT *, unnest(range(b, least(n, b + 50))) AS i FROM m)"""


@query(_SCORES)
def window_scores(t) -> DataFrame:
    """A scorer over overlapping windows of each user's series: stride, context and padded edges show in the result."""
    s = queries_interval.series(t)
    return sequences.sliding_scores(s, "user", "i", "p", _above_mean()).select("user", "i", F.round("p", 9).alias("p"))


@query(ORACLES["window_scores"])
def stream_window_scores(t) -> DataFrame:
    """The same from a stream of frames, window by window as they are complete."""
    folder = new_folder(t.spark, "frames")
    s = queries_interval.series(t).select(F.col("user").cast("string").alias("vid"), F.col("i").cast("long").alias("frame"), F.col("p").alias("value"))
    ends = s.groupBy("vid").agg((F.max("frame") + 1).alias("frame")).withColumn("value", F.lit(None).cast("double"))
    every = s.unionByName(ends)
    for low, high in ((0, 60), (60, 130), (130, 2**62)):
        every.where((F.col("frame") >= low) & (F.col("frame") < high)).repartition("vid").write.mode("append").parquet(folder)
    out = queries_stream._drained(t, flows.window_scores(flows.arrivals(t.spark, folder, every.schema, 3), _above_mean()), "append")
    return out.select(F.col("vid").cast("long").alias("user"), F.col("frame").alias("i"), F.round("p", 9).alias("p"))


@query("""WITH a AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS place FROM orders),
b AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS place FROM orders WHERE o_orderkey % 9 > 0)
SELECT o_custkey, place, a.o_orderkey AS "left", b.o_orderkey AS "right" FROM a FULL JOIN b USING (o_custkey, place) WHERE a.o_orderkey IS DISTINCT FROM b.o_orderkey""")
def order_check(t) -> DataFrame:
    """Where stored rows don't stand in the order of their records."""
    stored = t.orders.where("o_orderkey % 9 > 0")
    return state.order_mismatches(t.orders, stored, ["o_custkey"], "o_orderkey", ["o_orderkey"], ["o_orderdate", "o_orderkey"])


@query("""WITH s AS (SELECT o_custkey AS v, o_orderkey % 4 AS number, min(o_orderkey) AS a, max(o_orderkey) AS b FROM orders WHERE o_orderkey % 3 > 0 GROUP BY ALL)
SELECT o_orderkey, a AS shot_start, b AS shot_end FROM orders LEFT JOIN s ON v = o_custkey AND number = o_orderkey % 4""")
def shot_bounds(t) -> DataFrame:
    shots = t.orders.where("o_orderkey % 3 > 0").groupBy(F.col("o_custkey").alias("video"), (F.col("o_orderkey") % 4).alias("number")).agg(F.min("o_orderkey").alias("shot_start"), F.max("o_orderkey").alias("shot_end"))
    seen = t.orders.select("o_orderkey", F.col("o_custkey").alias("video"), (F.col("o_orderkey") % 4).alias("number"))
    return intervals.shot_bounds(seen, shots, ["video", "number"], ["shot_start", "shot_end"]).select("o_orderkey", "shot_start", "shot_end")


@query("""SELECT p_partkey, (SELECT min(event_id) FROM events WHERE user_id = p_partkey % 60 AND event_id % 25 = p_size % 25) AS event_id FROM part""")
def frame_lookup(t) -> DataFrame:
    """The first event of exactly the wanted user and index."""
    wanted = t.part.select("p_partkey", (F.col("p_partkey") % 60).alias("video"), (F.col("p_size") % 25).cast("long").alias("idx"))
    seen = t.events.select(F.col("user_id").alias("video"), (F.col("event_id") % 25).alias("idx"), "event_id")
    return intervals.frame_at(wanted, seen, ["video", "idx"], ["event_id"]).select("p_partkey", "event_id")


@query("""WITH p(query_id, q) AS (VALUES (1, 'license'), (2, 'tok'), (3, 'xqzt'))
SELECT query_id, doc_id FROM documents, p WHERE list_bool_and(list_transform(range(1, length(q) - 1), lambda i: contains(lower(coalesce(text, '')), q[i:i + 2])))""", longs="query_id")
def ngram_search(t) -> DataFrame:
    """Documents that hold all trigrams of a phrase, from the index's n-grams."""
    phrases = t.spark.createDataFrame([(1, " License "), (2, "tok"), (3, "xqzt")], "query_id long, query string")
    return X.ngram_hits(index_of(t, words=False, grams=True), phrases)


@query("SELECT doc_id, sha256(coalesce(text, '')) AS digest FROM documents")
def decoded_images(t) -> DataFrame:
    """Bytes decoded from base64, half of it with a data header."""
    plain = F.base64(F.encode(F.coalesce("text", F.lit("")), "utf-8"))
    coded = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("data:image/png;base64,"), plain)).otherwise(plain)
    return t.documents.select("doc_id", F.sha2(images.decode_base64(coded), 256).alias("digest"))


@query("""SELECT v.label::BIGINT AS video, i AS frame_index, 32 AS width, 18 AS height, (i + 3 + 5 + v.label) % 256 AS first_byte
FROM (SELECT DISTINCT label FROM embeddings) v, (SELECT unnest(range(0, 90, 9)) AS i)""", longs="width height first_byte")
def frame_scan(t) -> DataFrame:
    """Wanted frames of stand-in videos, scaled down; their first byte tells video and frame."""
    label = t.embeddings.select("label").distinct()
    videos = label.select(F.col("label").cast("string").alias("video_id"), F.repeat(F.lit("x"), F.col("label")).alias("path"))
    wanted = videos.select("video_id", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(89).cast("long"), F.lit(9).cast("long"))).alias("frame_index"))
    got = frames.wanted_frames(videos, wanted, frames.stand_in(), max_side=32)
    first = F.conv(F.hex(F.substring("data", 1, 1)), 16, 10).cast("long").alias("first_byte")
    return got.select(F.col("video_id").cast("long").alias("video"), "frame_index", "width", "height", first)


@query("""WITH e AS (SELECT vec_id, generate_subscripts(embedding, 1) - 1 AS i, unnest(embedding)::DOUBLE AS x FROM embeddings),
px AS (SELECT vec_id, i // 3 AS k, sum((floor((x + 1) * 127)::BIGINT // 32) * CASE i % 3 WHEN 0 THEN 64 WHEN 1 THEN 8 ELSE 1 END)::BIGINT AS bin FROM e WHERE i < 63 GROUP BY ALL),
n AS (SELECT vec_id, bin, count(*) AS n FROM px GROUP BY ALL)
SELECT vec_id, bin, round(n / sqrt(sum(n * n) OVER (PARTITION BY vec_id)), 6) AS share FROM n""", longs="bin")
def colour_histograms(t) -> DataFrame:
    """512-bin histograms of images of 7 x 3 pixels made from vectors."""
    pixel = F.transform(F.slice("embedding", 1, 63), lambda x: F.lpad(F.hex(F.floor((x.cast("double") + 1) * 127).cast("long")), 2, "0"))
    data = t.embeddings.select("vec_id", F.unhex(F.array_join(pixel, "")).alias("d"))
    bins = data.select("vec_id", F.posexplode(images.histogram("d", F.lit(7), F.lit(3))).alias("bin", "share"))
    return bins.where("share > 0").select("vec_id", "bin", F.round("share", 6).alias("share"))
