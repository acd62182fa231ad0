"""Queries that run a stream to its end over the given tables and return what it gave."""

from __future__ import annotations


from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrand.plans.registry import query
from lodestrand.sources.sinks import new_folder
from lodestrand.streaming import flows


def _drained(t, df: DataFrame, mode: str) -> DataFrame:
    """All rows of a stream that is run until nothing is left, kept in a shared table."""
    base = new_folder(t.spark, "stream")
    if mode == "append":
        q = df.writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/log").outputMode("append").trigger(availableNow=True).start()
    else:
        q = df.writeStream.foreachBatch(lambda b, i: b.write.mode("overwrite").parquet(f"{base}/out")).option("checkpointLocation", f"{base}/log").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    return t.spark.read.schema(df.schema).parquet(f"{base}/out")


def _events(t) -> DataFrame:
    """The events as a folder of files that arrive one after the other."""
    folder = new_folder(t.spark, "arrivals")
    day = F.coalesce(F.dayofmonth("ts"), F.lit(0))
    for low, high in ((0, 8), (8, 15), (15, 22), (22, 32)):
        t.events.where((day >= low) & (day < high)).write.mode("append").parquet(folder)
    return flows.read_stream(t.spark, folder, t.events.schema)


@query("""SELECT event_type, strftime(time_bucket(INTERVAL 1 DAY, ts), '%Y-%m-%d %H:%M:%S') AS window_start, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY ALL""")
def stream_windows(t) -> DataFrame:
    out = _drained(t, flows.windowed_counts(_events(t), "ts", ["event_type"], "1 day"), "complete")
    return out.select("event_type", F.date_format(flows.wall_clock("window_start"), "yyyy-MM-dd HH:mm:ss").alias("window_start"), "n", F.round("total", 6).alias("total"))


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 4 HOUR THEN 0 ELSE 1 END AS f FROM events),
s AS (SELECT *, sum(f) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S.%f') AS session_start, count(*) AS n FROM s GROUP BY user_id, k""")
def stream_sessions(t) -> DataFrame:
    # A table of many files arrives out of order within each of its parts: nothing is late that lies within its whole span.
    span = t.events.agg(F.max("ts").alias("b"), F.min("ts").alias("a")).select(F.coalesce(F.expr("timestampdiff(SECOND, a, b)"), F.lit(0))).first()[0]
    out = _drained(t, flows.sessions(_events(t), "ts", ["user_id"], "4 hours", f"{span + 1} seconds"), "complete")
    return out.select("user_id", F.date_format(flows.wall_clock("session_start"), "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("session_start"), "n")


@query("SELECT user_id, event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id DESC) AS n FROM events) WHERE n = 1")
def stream_ingest(t) -> DataFrame:
    """Arrivals appended batch by batch with one row a key, then the latest over all batches."""
    base = new_folder(t.spark, "ingest")
    flows.ingest(_events(t).select("user_id", "event_type", "event_id"), f"{base}/out", f"{base}/log", ["user_id", "event_type"], "event_id")
    got = t.spark.read.parquet(f"{base}/out").select("user_id", "event_type", "event_id")
    return flows.latest_by_key(got, ["user_id", "event_type"], "event_id")
