"""Writers that can be run again: a video's artifact replaces its former one."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``, else the context's; a local one only with a local master, as in tests."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    return (found or f"file://{tempfile.gettempdir()}/checkpoints").rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    """A new folder of this application under the shared one; ``purge`` removes them all."""
    return f"{shared_folder(spark)}/lodestrand/{spark.sparkContext.applicationId}/{uuid.uuid4().hex}/{name}"


def purge(spark: SparkSession) -> None:
    """Delete what this application has written for itself; call it when all results have been read or written."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_folder(spark)}/lodestrand/{spark.sparkContext.applicationId}")
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def staged(df: DataFrame) -> DataFrame:
    """``df`` written once and read back, for results that several later steps read."""
    path = new_folder(df.sparkSession, "staged")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def write_artifact(df: DataFrame, path: str, key: str = "video_id", fmt: str = "parquet") -> None:
    """Partitions of the keys that are there are replaced, others stay; a key's rows are in one file."""
    spark = df.sparkSession
    before = spark.conf.get("spark.sql.sources.partitionOverwriteMode")
    spark.conf.set("spark.sql.sources.partitionOverwriteMode", "dynamic")
    try:
        df.repartition(key).write.partitionBy(key).mode("overwrite").format(fmt).save(path)
    finally:
        spark.conf.set("spark.sql.sources.partitionOverwriteMode", before)


def write_vectors(vectors: DataFrame, records: DataFrame, path: str, key: str = "video_id") -> None:
    """Vectors by video; an error if a video has not as many of them as keyframes."""
    n = vectors.groupBy(key).agg(F.count("*").alias("_v")).join(records.groupBy(key).agg(F.count("*").alias("_r")), key, "full")
    bad = n.where(~F.col("_v").eqNullSafe(F.col("_r"))).select(key).limit(1).collect()
    if bad:
        raise ValueError(f"vectors and keyframes differ in number for {bad[0][0]}")
    write_artifact(vectors, path, key)


def write_summary(summary: DataFrame, path: str) -> None:
    summary.coalesce(1).write.mode("overwrite").json(path)
