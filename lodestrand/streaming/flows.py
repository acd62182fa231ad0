"""Structured Streaming: incremental arrival, event-time windows, sessions with a cap."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def read_stream(spark: SparkSession, folder: str, schema, files_per_batch: int = 1) -> DataFrame:
    """The Parquet files of a folder, as they arrive, a bounded number in each batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).option("pathGlobFilter", "*.parquet").parquet(folder)


def arrivals(spark: SparkSession, folder: str, schema, batches: int) -> DataFrame:
    """The files that are in a folder, as a stream of so many batches, or fewer: a batch costs time whatever it holds, and files grow with the table."""
    files = len(spark.read.schema(schema).option("pathGlobFilter", "*.parquet").parquet(folder).inputFiles())
    return read_stream(spark, folder, schema, max(1, -(-files // batches)))


def instant(events: DataFrame, ts: str) -> Column:
    """The column as an instant; a time without zone is read as UTC, whatever the session's zone."""
    if dict(events.dtypes)[ts] == "timestamp_ntz":
        return F.expr(f"timestamp_micros(timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', `{ts}`))")
    return F.col(ts).cast("timestamp")


def wall_clock(ts: str) -> Column:
    """An instant as a time without zone, in UTC."""
    return F.expr(f"timestampadd(MICROSECOND, unix_micros(`{ts}`), TIMESTAMP_NTZ '1970-01-01 00:00:00')")


def windowed_counts(events: DataFrame, ts: str, by: list[str], size: str, slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """by, window_start, n, total: tumbling or sliding windows; rows later than ``late`` are dropped in a stream."""
    stamped = events.withColumn("_ts", instant(events, ts))
    if events.isStreaming:
        stamped = stamped.withWatermark("_ts", late)
    w = F.window("_ts", size, slide) if slide else F.window("_ts", size)
    return stamped.groupBy(w, *by).agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(*by, F.col("window.start").alias("window_start"), "n", "total")


def sessions(events: DataFrame, ts: str, by: list[str], gap: str, late: str = "10 minutes") -> DataFrame:
    """by, session_start, session_end, n: a session ends when nothing comes for the gap."""
    stamped = events.withColumn("_ts", instant(events, ts))
    if events.isStreaming:
        stamped = stamped.withWatermark("_ts", late)
    s = F.session_window("_ts", gap)
    return stamped.groupBy(s, *by).agg(F.count("*").alias("n")).select(*by, F.col("session_window.start").alias("session_start"), F.col("session_window.end").alias("session_end"), "n")


def latest_by_key(batch: DataFrame, keys: list[str], order: str) -> DataFrame:
    from lodestrand.operators.state import latest

    return latest(batch, keys, [order])


def ingest(source: DataFrame, target: str, checkpoint: str, keys: list[str], order: str) -> None:
    """Append each micro-batch, one row a key, under its batch number: a replayed batch overwrites itself."""

    def write(batch: DataFrame, number: int) -> None:
        latest_by_key(batch, keys, order).write.mode("overwrite").parquet(f"{target}/batch={number}")

    q = source.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()


def window_scores(frames: DataFrame, score, length: int = 100, stride: int = 50, context: int = 25) -> DataFrame:
    """vid, frame, p from a stream of (vid, frame, value), each video's frames in order: as ``sequences.sliding_scores``.

    A video's state is the values that windows to come may still ask for; a window is scored when all its values are
    there, and those at the end when the video's end marker, a frame with a null value, arrives.
    """
    import numpy as np

    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        done, base, held = state.get if state.exists else (0, 0, "[]")
        rows = pd.concat(list(parts)).sort_values("frame")
        ended = bool(rows["value"].isna().any())
        v = json.loads(held) + rows["value"].dropna().tolist()
        n, out = base + len(v), []
        while done < n and (ended or done - context + length <= n):
            at = np.clip(np.arange(done - context, done - context + length), 0, n - 1) - base
            p = np.asarray(score(np.asarray(v)[at]))[context : context + stride]
            out += [(key[0], done + i, float(x)) for i, x in enumerate(p[: n - done])]
            done += stride
        keep = min(max(0, done - context), n)
        state.update((done, keep, json.dumps(v[keep - base :])))
        yield pd.DataFrame(out, columns=["vid", "frame", "p"])

    return frames.groupBy("vid").applyInPandasWithState(run, "vid string, frame long, p double", "done long, base long, held string", "append", GroupStateTimeout.NoTimeout)


def capped_segments(words: DataFrame, gap: float = 0.6, longest: float = 15.0) -> DataFrame:
    """vid, seg_no, text, start, end from a stream of (vid, ord, text, start, end), each key's words in order.

    The open segment of each key is its state; a segment is given out when the next one opens, and the last one
    when the key's end marker, a word with a null text, arrives.
    """

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seg, texts, first, last = (state.get if state.exists else (1, "[]", 0.0, 0.0))
        texts = json.loads(texts)
        out = []
        rows = pd.concat(list(frames)).sort_values("ord")
        for w in rows.itertuples():
            over = pd.isna(w.text)
            if texts and (over or w.start - last > gap or w.end - first > longest):
                out.append((key[0], seg, " ".join(texts), first, last))
                seg, texts = seg + 1, []
            if not over and w.text.strip():
                if not texts:
                    first = w.start
                texts.append(w.text.strip())
                last = w.end
        state.update((seg, json.dumps(texts), float(first), float(last)))
        yield pd.DataFrame(out, columns=["vid", "seg_no", "text", "start", "end"])

    return words.groupBy("vid").applyInPandasWithState(run, "vid string, seg_no long, text string, start double, end double", "seg long, texts string, first double, last double", "append", GroupStateTimeout.NoTimeout)
