"""Tables written in the cluster's shared folder, which cut lineage and survive lost executors."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from lodestrand.shipping import ship

#: Stands for a null doc_id inside the operators, so that joins need no null-safe comparison.
NO_ID = -(2**63)


def area(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    Where that is unset, a folder of this machine serves a local master, as in tests; on a cluster it raises.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = f"file://{tempfile.gettempdir()}/checkpoints"
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def purge(spark: SparkSession) -> None:
    """Delete the tables that this application has written; call it when all results have been read or written."""
    root = f"{area(spark)}/lodestrand/{spark.sparkContext.applicationId}"
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def table(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once under the shared folder and read it back; every consumer sees the same rows."""
    spark = ship(df.sparkSession)
    path = f"{area(spark)}/lodestrand/{spark.sparkContext.applicationId}/{uuid.uuid4().hex}/{name}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def without(df: DataFrame, *names: str) -> DataFrame:
    """``df`` without columns whose name (any case) an operator is about to add."""
    ship(df.sparkSession)
    low = {n.lower() for n in names}
    return df.select([df[f"`{c}`"] for c in df.columns if c.lower() not in low])
