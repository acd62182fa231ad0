"""Operators on ordered groups: sessions, shots, keyframes, windows, digests.

Where the next step depends on what was kept so far, the group is an ordered array under ``aggregate``; groups
are one video's, one shot's or one query's rows, bounded by what the operator returns for them.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestrand.operators import scans
from lodestrand.sources.sinks import staged


def gap_sessions(rows: DataFrame, by: list[str], order: list[str], start: str, end: str, gap: float, spread: bool = False) -> DataFrame:
    """``rows`` with session (1..): a new one when start is more than gap after the last row's end.

    ``spread`` deals a key's rows over many tasks, for keys that hold a large share of all rows.
    """
    if spread:
        found = scans.previous(scans.ranged(rows, by, order), by, order, "_e", end)
        flagged = staged(found.withColumn("_f", F.when(F.col(start) - F.col("_e") <= gap, 0).otherwise(1)).drop("_e"))
        out = scans.running_before(flagged, by, order, "_n", F.col("_f"), "sum")
        return out.withColumn("session", F.coalesce("_n", F.lit(0)) + F.col("_f")).drop("_f", "_n", "_part")
    w = Window.partitionBy(*by).orderBy(*order)
    fresh = F.when(F.col(start) - F.lag(end).over(w) <= gap, 0).otherwise(1)
    return rows.withColumn("_f", fresh).withColumn("session", F.sum("_f").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_f")


def word_segments(words: DataFrame, by: list[str], ord_: str = "ord", gap: float = 0.6, longest: float = 15.0, spread: bool = False) -> DataFrame:
    """by, seg_no, text, start, end: words in file order, cut at gaps and where a segment would grow too long.

    The last end is the last word's (not the greatest); a null end is the start, a null start 0; blank words go.
    Gaps cut a file into runs that don't depend on each other; each is streamed on its own, and a segment's number is
    the sum of the runs' before it.  ``spread`` is for files that hold a large share of all words.
    """
    clean = words.where(F.length(F.trim(F.coalesce("text", F.lit("")))) > 0)
    begin = F.coalesce("start_time", F.lit(0.0)).cast("double")
    order = ["_o", "text", "start", "end"]
    clean = clean.select(*by, F.col(ord_).alias("_o"), F.trim("text").alias("text"), begin.alias("start"), F.coalesce(F.col("end_time").cast("double"), begin).alias("end"))
    runs = gap_sessions(clean, by, order, "start", "end", gap, spread).withColumnRenamed("session", "_run")
    fresh = F.row_number().over(Window.partitionBy(*by, "_run").orderBy(*order)) == 1
    segs = staged(scans.cut_runs(runs.withColumn("fresh", fresh), by, order, longest))
    many = segs.groupBy(*by, "_run").agg(F.count("*").alias("_many"))
    before = F.coalesce(F.sum("_many").over(Window.partitionBy(*by).orderBy("_run").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    if spread:
        counted = scans.running_before(scans.ranged(many, by, ["_run"]), by, ["_run"], "_before", F.col("_many"), "sum").withColumn("_before", F.coalesce("_before", F.lit(0)))
    else:
        counted = many.withColumn("_before", before)
    on = F.col("_run") == F.col("_r")
    for i, c in enumerate(by):
        on = on & F.col(c).eqNullSafe(F.col(f"_k{i}"))
    counted = counted.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(by)], F.col("_run").alias("_r"), "_before")
    return segs.join(counted, on).select(*by, (F.col("_before") + F.col("_number") + 1).cast("int").alias("seg_no"), "text", "start", "end")


def shots_from_scores(scores: DataFrame, by: list[str], frame: str, p: str, fps: Column, threshold: float = 0.5) -> DataFrame:
    """by, number, start_frame, end_frame, start, end: shots cut where a run above the threshold begins.

    A run that begins with the first frame is no cut; spans are contiguous, ends included.
    """
    w = Window.partitionBy(*by).orderBy(frame)
    above = F.col(p) > threshold
    marked = scores.withColumn("_rank", F.row_number().over(w) - 1).withColumn("_n", F.count("*").over(Window.partitionBy(*by))).withColumn("_fps", fps)
    marked = marked.withColumn("_cut", (F.col("_rank") == 0) | (above & ~F.lag(above, 1, True).over(w)))
    cuts = marked.where("_cut")
    out = cuts.select(*by, F.row_number().over(w).alias("number"), F.col("_rank").alias("start_frame"), (F.lead("_rank", 1).over(w)).alias("_next"), "_n", "_fps")
    out = out.withColumn("end_frame", F.coalesce("_next", "_n") - 1)
    return out.select(*by, "number", "start_frame", "end_frame", F.bround(F.col("start_frame") / F.col("_fps"), 3).alias("start"), F.bround((F.col("end_frame") + 1) / F.col("_fps"), 3).alias("end"))


def legacy_shots(scores: DataFrame, by: list[str], frame: str, p: str, threshold: float = 0.5) -> DataFrame:
    """Every frame above the threshold cuts; spans under 3 frames are left out but keep their number.

    Keyframes are the second, the middle and the last but one frame.
    """
    w = Window.partitionBy(*by).orderBy(frame)
    rows = scores.withColumn("_r", F.row_number().over(w) - 1).withColumn("_n", F.count("*").over(Window.partitionBy(*by)))
    cuts = rows.where((F.col("_r") == 0) | (F.col(p) > threshold))
    spans = cuts.withColumn("number", F.row_number().over(w)).withColumn("start_frame", F.col("_r")).withColumn("end_frame", F.coalesce(F.lead("_r", 1).over(w), F.col("_n")))
    spans = spans.where(F.col("end_frame") - F.col("start_frame") >= 3)
    return spans.select(*by, "number", "start_frame", "end_frame", (F.col("start_frame") + 1).alias("first_key"), F.expr("(start_frame + end_frame) div 2").alias("middle_key"), (F.col("end_frame") - 1).alias("last_key"))


def keyframe_positions(start: Column, end: Column, start_frame: Column, span: Column) -> Column:
    """Sorted distinct frames of a shot: its middle if under 1 s, three places up to 10 s, then every few seconds."""
    d = end - start
    step = F.greatest(F.lit(3.0), d / 40)
    count = F.greatest(F.lit(1), F.least(F.lit(40), F.floor(d / step).cast("int")))
    long_ = F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.least(F.lit(0.98), i * step / d))
    places = F.when(d < 1, F.array(F.lit(0.5))).when(d > 10, long_).otherwise(F.array(F.lit(0.1), F.lit(0.5), F.lit(0.9)))
    frames = F.transform(places, lambda f: F.least(F.greatest(start_frame + F.bround(f * span).cast("long"), start_frame), start_frame + span))
    return F.array_sort(F.array_distinct(frames))


def greedy_reject(rows: DataFrame, by: list[str], position: str, hash_: str, most: int = 4, keep: list[str] | None = None) -> DataFrame:
    """by and the kept rows' position and hash: a row goes if its hash is within ``most`` bits of any kept one."""
    extra = keep or []
    groups = rows.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct(F.col(position).alias(position), F.col(hash_).alias(hash_), *extra))).alias("_r"))

    def step(kept: Column, r: Column) -> Column:
        near = F.exists(kept, lambda k: F.bit_count(k[hash_].bitwiseXOR(r[hash_])) <= most)
        return F.when(near, kept).otherwise(F.array_append(kept, r))

    return groups.select(*by, F.inline(F.aggregate("_r", F.slice("_r", 1, 0), step)))


def temporal_windows(shots: DataFrame, by: list[str], n_windows: int, neighbours: int = 1, min_gap: float = 8.0, max_shots: int = 5) -> DataFrame:
    """by, window, centre_shot, centre_time, shot_numbers, components, score: greedy windows around the best shots.

    ``shots`` has rank, video, shot_no, ts, score, rrf_components.  A shot within the gap of an existing window's centre
    (the first such, in the same video) joins it: its components always, its neighbourhood while the window has
    fewer than ``max_shots`` shots, in number order and not farther from the centre than twice the neighbourhood.
    Otherwise it opens a window while there are fewer than ``n_windows``.
    """
    row = F.struct("rank", "video", "shot_no", "ts", "score", F.col("rrf_components").alias("parts"))
    ordered = shots.where(F.col("shot_no").isNotNull() & F.col("ts").isNotNull()).groupBy(*by).agg(F.sort_array(F.collect_list(row)).alias("_s"))
    win = "array<struct<video:string,centre:int,time:double,score:double,numbers:array<int>,parts:array<string>>>"

    def around(n: Column) -> Column:
        return F.sequence(n - neighbours, n + neighbours)

    def step(ws: Column, s: Column) -> Column:
        close = F.transform(ws, lambda w: (w["video"] == s["video"]) & (F.abs(w["time"] - s["ts"]) < min_gap))
        at = F.array_position(close, F.lit(True)).cast("int")

        def grow(w: Column, i: Column) -> Column:
            fits = F.filter(around(s["shot_no"]), lambda n: (F.abs(n - w["centre"]) <= 2 * neighbours) & ~F.array_contains(w["numbers"], n))
            room = F.greatest(F.lit(max_shots) - F.size(w["numbers"]), F.lit(0))
            numbers = F.array_sort(F.concat(w["numbers"], F.slice(fits, 1, room)))
            grown = F.struct(w["video"].alias("video"), w["centre"].alias("centre"), w["time"].alias("time"), w["score"].alias("score"), numbers.alias("numbers"), F.array_sort(F.array_union(w["parts"], s["parts"])).alias("parts"))
            return F.when(i == at - 1, grown).otherwise(w)

        fresh = F.struct(s["video"].cast("string").alias("video"), s["shot_no"].cast("int").alias("centre"), s["ts"].alias("time"), s["score"].alias("score"), around(s["shot_no"].cast("int")).alias("numbers"), s["parts"].alias("parts"))
        return F.when(at > 0, F.transform(ws, grow)).when(F.size(ws) < n_windows, F.array_append(ws, fresh)).otherwise(ws)

    out = ordered.select(*by, F.posexplode(F.aggregate("_s", F.array().cast(win), step)).alias("window", "w"))
    return out.select(*by, "window", F.col("w.video").alias("video"), F.col("w.centre").alias("centre_shot"), F.col("w.time").alias("centre_time"), F.col("w.score").alias("score"), F.col("w.numbers").alias("shot_numbers"), F.col("w.parts").alias("components"))


def digest(lines: DataFrame, by: list[str], order: list[str], line: str, most: int = 1800) -> DataFrame:
    """by, digest: the lines joined by blanks; beyond ``most`` characters every few lines, then cut.

    Lines are numbered over many tasks, and a key's row is made of the lines that it takes alone: some twice ``most``
    of them, each cut at ``most`` characters.
    """
    # Of a line no more than its first characters can show; lines that begin with the same ones are in one part.
    rows = lines.select(*by, *order, F.substring(line, 1, most).alias("_line"), F.substring(line, 1, 16).alias("_head"), F.length(line).alias("_n"))
    rows = scans.ranged(rows, by, [*order, "_head"])
    placed = scans.running_before(rows, by, [*order, "_line"], "_i", F.lit(1), "sum")
    size = rows.groupBy(*by).agg(F.count("*").alias("_rows"), (F.sum("_n") + F.count("_n") - 1).alias("_chars"))
    keep = F.greatest(F.lit(1), F.floor(F.lit(most) / F.greatest(F.lit(1), F.floor(F.coalesce("_chars", F.lit(0)) / F.col("_rows")) + 1)))
    size = size.withColumn("_step", F.when(F.col("_chars") > most, F.greatest(F.lit(1), F.floor(F.col("_rows") / keep))).otherwise(1))
    keys = [F.col(c).alias(f"_k{i}") for i, c in enumerate(by)]
    on = reduce(lambda x, y: x & y, [F.col(c).eqNullSafe(F.col(f"_k{i}")) for i, c in enumerate(by)])
    taken = placed.join(size.select(*keys, "_step"), on).where((F.coalesce("_i", F.lit(0)) % F.col("_step") == 0) & F.col("_line").isNotNull())
    texts = taken.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct(F.coalesce("_i", F.lit(0)).alias("i"), "_line"))).alias("_l"))
    texts = texts.select(*keys, F.substring(F.array_join(F.transform("_l", lambda x: x["_line"]), " "), 1, most).alias("digest"))
    # A key of null lines alone has an empty digest.
    return size.join(texts, on, "left").select(*by, F.coalesce("digest", F.lit("")).alias("digest"))


def self_similarity(rows: DataFrame, by: list[str], at: str, vector: str, reach: int) -> DataFrame:
    """by, at, other, similarity: each row with those up to ``reach`` places away (a band join on the place)."""
    from lodestrand.functions.vectors import dot

    a = rows.select(*by, F.col(at).alias(at), F.col(vector).alias("_va"), F.explode(F.sequence(F.col(at) - reach, F.col(at) + reach)).alias("other"))
    b = rows.select(*by, F.col(at).alias("other"), F.col(vector).alias("_vb"))
    return a.join(b, [*by, "other"]).select(*by, at, "other", dot("_va", "_vb").alias("similarity"))


def uniform_frames(total: Column, n: int) -> Column:
    """n frames at the middles of equal parts."""
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.least(total - 1, F.floor((i + 0.5) * total / n)))


def semantic_chunks(segments: DataFrame, by: str, target: int = 200, similarity: float = 0.6, longest: float = 120.0, shortest: float = 30.0) -> DataFrame:
    """by, chunk, text, start, end, words, segments, embedding (the mean of its segments'): cut where the chunk is long or the next segment is about something else.

    Input rows have by, start, end, text, embedding; blank ones go.  A chunk ends before a segment that would bring it
    over 1.5 times the target words or the longest time (of its segments together), or whose product with the chunk's
    mean embedding is under the similarity; but not before it has half the target words or the shortest time.  A file's
    segments are streamed in order, with running sums of the open chunk; a missing embedding is one of zeros.
    """
    order = ["start", "end", "text"]
    clean = segments.where(F.length(F.trim(F.coalesce("text", F.lit("")))) > 0)
    words = F.size(F.filter(F.split("text", r"\s+"), lambda w: w != ""))
    rows = clean.select(by, F.col("start").cast("double").alias("start"), F.col("end").cast("double").alias("end"), F.trim("text").alias("text"), F.col("embedding").cast("array<double>").alias("embedding"))
    fresh = F.row_number().over(Window.partitionBy(by).orderBy(*order)) == 1
    rows = rows.select(by, "start", "end", "text", words.cast("long").alias("words"), "embedding", fresh.alias("fresh")).sortWithinPartitions(by, *order)
    schema = T.StructType([rows.schema[by], *[T.StructField(c, t) for c, t in (("chunk", T.LongType()), ("text", T.StringType()), ("start", T.DoubleType()), ("end", T.DoubleType()), ("words", T.LongType()), ("segments", T.LongType()), ("embedding", T.ArrayType(T.DoubleType())))]])
    return rows.mapInArrow(_chunked(target, similarity, longest, shortest), schema)


class _Chunk:
    """The open chunk: its file (an array of one row), number, texts, times and running sums."""

    def __init__(self, key: pa.Array, number: int):
        self.key, self.number, self.texts, self.words, self.spoken, self.sum = key, number, [], 0, 0.0, None

    def add(self, text: str, start: float, end: float, words: int, vector: np.ndarray) -> None:
        if not self.texts:
            self.start, self.sum = start, vector.copy()
        else:
            self.sum += vector
        self.texts.append(text)
        self.end, self.words, self.spoken = end, self.words + words, self.spoken + (end - start)


def _chunked(target: int, similarity: float, longest: float, shortest: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, names = None, []

        def out(done: list[_Chunk]) -> pa.RecordBatch:
            of = lambda f, kind: pa.array([f(c) for c in done], kind)
            columns = [of(lambda c: c.number, pa.int64()), of(lambda c: " ".join(c.texts), pa.string()), of(lambda c: c.start, pa.float64()), of(lambda c: c.end, pa.float64())]
            columns += [of(lambda c: c.words, pa.int64()), of(lambda c: len(c.texts), pa.int64()), of(lambda c: (c.sum / len(c.texts)).tolist(), pa.list_(pa.float64()))]
            return pa.record_batch([pa.concat_arrays([c.key for c in done]), *columns], names=[names[0], "chunk", "text", "start", "end", "words", "segments", "embedding"])

        for batch in batches:
            names, done = batch.schema.names, []
            start, end, words, fresh = (batch[c].to_numpy(zero_copy_only=False) for c in ("start", "end", "words", "fresh"))
            text, lists = batch["text"].to_pylist(), batch["embedding"]
            values, at = lists.values.to_numpy(zero_copy_only=False), np.asarray(lists.offsets)
            known = np.asarray(lists.is_valid())
            dims = int(np.max(np.diff(at), initial=0)) or (0 if held is None else len(held.sum))
            for i in range(batch.num_rows):
                vector = values[at[i] : at[i + 1]] if known[i] else np.zeros(dims)
                if held is not None and not fresh[i]:
                    over = held.words + words[i] > 1.5 * target or held.spoken + (end[i] - start[i]) > longest or float(held.sum @ vector) / len(held.texts) < similarity
                    if over and (held.words >= target / 2 or held.spoken >= shortest):
                        done.append(held)
                        held = _Chunk(batch.column(0).slice(i, 1), held.number + 1)
                else:
                    done += [held] if held is not None else []
                    held = _Chunk(batch.column(0).slice(i, 1), 0)
                held.add(text[i], float(start[i]), float(end[i]), int(words[i]), vector)
            if done:
                yield out(done)
        if held is not None:
            yield out([held])

    return run


def sliding_scores(frames: DataFrame, by: str, frame: str, value: str, score, length: int = 100, stride: int = 50, context: int = 25) -> DataFrame:
    """by, frame, p: a scorer over overlapping windows of a series, its edges padded by repetition.

    ``score`` takes a window's values and gives one number for each; the middle ``stride`` of them count.
    """
    import numpy as np
    import pandas as pd

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(frame)
        v = rows[value].to_numpy(float)
        n = len(v)
        after = context + (-n) % stride + (length - stride - context)
        padded = np.concatenate([np.repeat(v[:1], context), v, np.repeat(v[-1:], after)])
        p = np.concatenate([np.asarray(score(padded[i : i + length]))[context : context + stride] for i in range(0, n, stride)])[:n]
        return pd.DataFrame({by: rows[by].to_numpy(), frame: rows[frame].to_numpy(), "p": p})

    kinds = dict(frames.dtypes)
    return frames.select(by, frame, value).groupBy(by).applyInPandas(run, f"{by} {kinds[by]}, {frame} {kinds[frame]}, p double")


def at_least(spans: DataFrame, seconds: float, strictly: bool = False, start: str = "start", end: str = "end") -> DataFrame:
    """Spans of at least (or strictly more than) so many seconds, told to the microsecond; a span without a bound goes."""
    long = F.round(F.col(end) - F.col(start), 6)
    return spans.where(long > seconds if strictly else long >= seconds)


#: The least seconds of speech, which must be exceeded, of a window and of a window of fixed length.
SPEECH, WINDOW, FIXED_WINDOW = 0.2, 0.5, 1.0


def transcript_text(lines: DataFrame, by: list[str], srt: bool = False) -> DataFrame:
    """by, transcript: segments as ``[start - end] text`` lines, or as numbered SRT blocks."""
    from lodestrand.functions.strings import hours_minutes_seconds, srt_time

    rows = lines.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("start", "end", "text"))).alias("_l"))
    if srt:
        block = lambda s, i: F.concat_ws("\n", (i + 1).cast("string"), F.concat(srt_time(s["start"]), F.lit(" --> "), srt_time(s["end"])), s["text"])
        return rows.select(*by, F.array_join(F.transform("_l", block), "\n\n").alias("transcript"))
    line = lambda s: F.concat(F.lit("["), hours_minutes_seconds(s["start"]), F.lit(" - "), hours_minutes_seconds(s["end"]), F.lit("] "), s["text"])
    return rows.select(*by, F.array_join(F.transform("_l", line), "\n").alias("transcript"))
