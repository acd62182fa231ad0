"""Set-oriented retrieval and answering: a table of queries in, ranked rows with their query_id out."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestrand.functions import seams, strings
from lodestrand.operators import intervals, prompts, ranking, sequences

#: The named configurations, as weights of (siglip, jina, asr, ocr) and the transcript used.
CONFIGS = {
    "baseline-uniform": ({}, None),
    "visual-only": ({"siglip": 1.0, "jina": 1.0}, None),
    "+asr-gt": ({"siglip": 1.0, "jina": 1.0, "asr": 0.8}, "subtitle"),
    "+asr-whisper": ({"siglip": 1.0, "jina": 1.0, "asr": 0.8}, "whisper"),
    "+ocr": ({"siglip": 1.0, "jina": 1.0, "asr": 0.8, "ocr": 0.5}, "subtitle"),
    "full": ({"siglip": 1.0, "jina": 1.0, "asr": 0.8, "ocr": 0.5}, "subtitle"),
}

#: Fixed value: the configurations that search with an expanded query.
EXPANDED = {"full"}

HIT = ["query_id", "source", "video_id", "shot_id", "file_path", "timestamp", "score"]
#: Sources whose hits are keyframes already.
FRAME_SOURCES = ("siglip", "jina")


def text_hits_to_frames(hits: DataFrame, keyframes: DataFrame, width: float = 60.0, depth: int = 50) -> DataFrame:
    """The best ``depth`` text hits of a query and source as hits on keyframes: with times, all frames in them; without, the frame of the same path."""
    hits = ranking.limit_each(hits, depth, ["video_id", "file_path", "start", "end"], by=("query_id", "source")).drop("rank")
    frames = keyframes.select("video_id", "shot_id", F.col("file_path").alias("frame_path"), "timestamp")
    timed = intervals.points_in_intervals(hits.where("start is not null").drop("shot_id", "timestamp"), frames, ["video_id"], "start", "end", "timestamp", width)
    timed = timed.drop("file_path").withColumnRenamed("frame_path", "file_path")
    one = frames.groupBy("video_id", F.col("frame_path").alias("file_path")).agg(F.min(F.struct("shot_id", "timestamp")).alias("f")).select("video_id", "file_path", "f.*")
    pathed = hits.where("start is null").drop("shot_id", "timestamp").join(one, ["video_id", "file_path"])
    return timed.select(*HIT).unionByName(pathed.select(*HIT))


def search_texts(queries: DataFrame, config: str, expand=None, column: str = "query") -> DataFrame:
    """``queries`` with search_text, what a configuration searches with: an expander's text for those that expand, else the query."""
    if config not in EXPANDED or expand is None:
        return queries.withColumn("search_text", F.col(column))
    return queries.withColumn("search_text", seams.query_expander(expand)(F.col(column)))


def retrieve(hits: DataFrame, weights: dict[str, float] | None = None, only: set[str] | None = None, k: int = 60, depth: int = 50, top_k: int = 10, n_windows: int = 0, fuse_key: str = "file_path") -> DataFrame:
    """query_id, video_id, shot_id, file_path, timestamp, score, rrf_components, rank of the best shots.

    ``hits`` are all sources' hits on keyframes, of which a frame source gives its best ``depth`` (text sources were
    cut before they were spread over frames); sources of no weight are left out of the plan, each source is collapsed
    to its best hit a shot, fused by weighted reciprocal ranks and rolled up to shots.
    """
    active = ranking.effective_weights(weights, only)
    used = hits.where(F.col("source").isin(list(active))) if active else hits.where(F.lit(False))
    seen = F.col("source").isin(*FRAME_SOURCES)
    cut = ranking.limit_each(used.where(seen), depth, ["video_id", "file_path", "timestamp"], by=("query_id", "source")).drop("rank")
    best = ranking.collapse(cut.unionByName(used.where(~seen)), ["query_id", "source", "video_id", "shot_id"], ["timestamp", "file_path"])
    fused = ranking.rrf(best, active, k, top=max(2 * depth, top_k), key=fuse_key)
    if fuse_key == "file_path":
        place = F.min(F.struct("video_id", "shot_id", "timestamp")).alias("p")
    else:
        place = F.min(F.struct("video_id", "file_path", "timestamp")).alias("p")
    fused = fused.join(best.where(F.col(fuse_key).isNotNull()).groupBy(fuse_key).agg(place).select(fuse_key, "p.*"), fuse_key)
    return ranking.roll_up(fused, ["video_id", "shot_id"], max(top_k, 3 * n_windows), ["file_path"])


def search(hits: DataFrame, top_k: int = 10, **how) -> DataFrame:
    """The best shots of each query in order of time, shots without a time last."""
    return ranking.in_time_order(retrieve(hits, top_k=top_k, **how).where(F.col("rank") <= top_k), ["file_path"])


def windows(shots: DataFrame, keyframes: DataFrame, n_windows: int = 3) -> DataFrame:
    """Greedy temporal windows with the first, middle and last frame; windows without frames go after they counted."""
    number = F.regexp_extract("shot_id", r"_shot_([0-9]+)$", 1).try_cast("int")
    rows = shots.withColumn("video", F.col("video_id")).withColumn("shot_no", number).withColumn("ts", F.col("timestamp"))
    w = sequences.temporal_windows(rows, ["query_id"], n_windows)
    inside = w.withColumn("n", F.explode("shot_numbers")).join(keyframes.select(F.col("video_id").alias("video"), F.col("shot_number").alias("n"), "file_path", F.col("timestamp").alias("at")), ["video", "n"])
    picks = ranking.first_middle_last(inside, ["query_id", "window"], ["at", "file_path"])
    frames = F.transform(F.sort_array(F.collect_list(F.struct("at", "file_path"))), lambda x: x["file_path"])
    got = picks.groupBy("query_id", "window").agg(frames.alias("frames"), F.min("at").alias("start_time"), F.max("at").alias("end_time"))
    return w.join(got, ["query_id", "window"])


def answer(questions: DataFrame, spans: DataFrame, transcript: DataFrame, model=seams.stub_answer, n_frames: int = 8) -> DataFrame:
    """questions with prompt, raw, pred and unparsed: prompts from windows (with speech and screen) and a transcript digest."""
    line = prompts.span_line(F.concat(F.lit("Span "), (F.col("window") + 1).cast("string")), F.col("start_time"), F.col("end_time"), F.col("speech"), F.col("screen"))
    told = F.transform(F.sort_array(F.collect_list(F.struct("start_time", "window", line.alias("line"), "frames"))), lambda x: x["line"])
    images = F.slice(F.flatten(F.collect_list("frames")), 1, 20)
    each = spans.groupBy("query_id").agg(told.alias("lines"), images.alias("images"))
    rows = questions.join(each, "query_id", "left").join(transcript, "video_id", "left")
    none: Column = F.array().cast("array<string>")
    text = prompts.mcq_prompt(F.col("question"), F.col("options"), F.coalesce("lines", none), F.coalesce("digest", F.lit("")), F.lit(n_frames))
    rows = rows.withColumn("prompt", text).withColumn("raw", model(F.coalesce("images", none), F.col("prompt")))
    pred = strings.parse_letter(F.col("raw"), F.size("options"))
    return rows.select(*questions.columns, "prompt", "raw", pred.alias("pred"), pred.isNull().alias("unparsed"))


def union_sources(parts: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), [p.select(*HIT) for p in parts])
