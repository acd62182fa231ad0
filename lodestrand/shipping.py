"""Sends the package's modules to the executors, which share no local folder with the driver."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_sent: set[str] = set()


def ship(spark: SparkSession) -> SparkSession:
    """Add the package to the session's Python files, once for each application; returns the session.

    Also turns off partition-aware unions: in Spark 4.1.2 such a union under a reused exchange can give its rows
    twice (a self-join of a result that holds a union shows it).  And batches sent to Python are cut by bytes, so
    that many long texts don't meet in one.
    """
    spark.conf.set("spark.sql.unionOutputPartitioning", "false")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))
    app = spark.sparkContext.applicationId
    if app not in _sent:
        top = Path(__file__).resolve().parent
        fd, path = tempfile.mkstemp(prefix="lodestrand_", suffix=".zip")
        os.close(fd)
        with zipfile.ZipFile(path, "w") as z:
            for p in sorted(top.rglob("*.py")):
                z.write(p, p.relative_to(top.parent).as_posix())
        spark.sparkContext.addPyFile(path)
        _sent.add(app)
    return spark
