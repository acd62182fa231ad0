"""The resumable stage runner: for each stage, the pending videos; outcomes are appended to the event log."""

from __future__ import annotations

import argparse
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrand.operators import state
from lodestrand.schemas import SCHEMAS

#: The stages in their order.
STAGES = ("shots", "keyframes", "embed", "asr", "ocr", "index")


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """The event log; an empty one where nothing was written yet."""
    try:
        return spark.read.schema(SCHEMAS["stage_events"]).parquet(path).select("*")
    except Exception as x:
        if "PATH_NOT_FOUND" in str(x):
            return spark.createDataFrame([], SCHEMAS["stage_events"])
        raise


def run(spark: SparkSession, log: str, videos: DataFrame, stages: dict[str, Callable[[DataFrame], DataFrame]], only: list[str] | None = None, force: bool = False, limit: int | None = None) -> int:
    """Run the stages over their pending videos; returns how many failed.

    A stage takes (video_id) and returns (video_id, status, error), one row a video; it writes its artifacts itself.
    """
    unknown = set(only or []) - set(stages)
    if unknown:
        raise ValueError(f"unknown stages: {sorted(unknown)}")
    failed = 0
    for i, name in enumerate(n for n in stages if not only or n in only):
        events = read_log(spark, log)
        now = state.latest(events, ["video_id", "stage"], ["seq"])
        todo = videos if force else state.pending(videos, now, "video_id", name)
        todo = todo.orderBy("video_id").limit(limit) if limit else todo
        seq = (events.agg(F.coalesce(F.max("seq"), F.lit(0))).first()[0]) + 1
        out = stages[name](todo).select("video_id", F.lit(name).alias("stage"), "status", "error", F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss").alias("updated_at"), F.lit(seq + i).cast("long").alias("seq"))
        out.write.mode("append").parquet(log)
        failed += read_log(spark, log).where((F.col("stage") == name) & (F.col("seq") == seq + i) & (F.col("status") == "failed")).count()
    return failed


def arguments(argv: list[str] | None = None) -> argparse.Namespace:
    p = argparse.ArgumentParser(description="Run stages over pending videos.")
    p.add_argument("--stages", default="all")
    p.add_argument("--videos", nargs="*")
    p.add_argument("--limit", type=int)
    p.add_argument("--dev-only", action="store_true")
    p.add_argument("--force", action="store_true")
    return p.parse_args(argv)
