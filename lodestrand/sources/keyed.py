"""A stored table of keyed rows that can be changed: rows that replace others, deletes, and reads as of a commit.

A change is written beside what is there, in folders by hash bucket of the key, and then made known by a snapshot: a
small file that names each bucket's folders, put in place by one rename.  Until then readers see the former snapshot,
so that a change that failed midway is as if it had never been.  ``compact`` rewrites the buckets that hold several
folders, and no others; a bucket is read and rewritten by its own tasks.
"""

from __future__ import annotations

import json
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


class Conflict(RuntimeError):
    """Another change was committed since this one began."""


class KeyedTable:
    """One row for each key under ``path``: the one of greatest ``order``, of equals the newest, unless it was deleted later."""

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType, keys: list[str], order: str, buckets: int = 64):
        self.spark, self.path, self.schema, self.keys, self.order, self.buckets = spark, path.rstrip("/"), schema, keys, order, buckets
        self.stored = T.StructType([*schema.fields, T.StructField("_seq", T.LongType()), T.StructField("_gone", T.BooleanType())])

    def _file(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")

    @property
    def _fs(self):
        return self._file("x").getFileSystem(self.spark._jsc.hadoopConfiguration())

    def snapshot(self) -> tuple[int, dict[str, list[str]]]:
        """The number of the last commit, and the folders of each bucket."""
        there = self._file("snapshots")
        names = [s.getPath().getName() for s in self._fs.listStatus(there)] if self._fs.exists(there) else []
        last = max([int(n[:-5]) for n in names if n.endswith(".json")], default=0)
        if not last:
            return 0, {}
        return last, json.loads(self.spark.read.text(f"{self.path}/snapshots/{last:012d}.json", wholetext=True).first()[0])

    def _commit(self, number: int, state: dict[str, list[str]]) -> None:
        """Put snapshot ``number`` in place, if no other has that number."""
        draft, final = self._file(f"snapshots/_{uuid.uuid4().hex}"), self._file(f"snapshots/{number:012d}.json")
        out = self._fs.create(draft, False)
        out.write(bytearray(json.dumps(state).encode()))
        out.close()
        if self._fs.exists(final) or not self._fs.rename(draft, final):
            self._fs.delete(draft, False)
            raise Conflict(f"commit {number} of {self.path} is taken")

    def _write(self, rows: DataFrame) -> dict[str, str]:
        """The folder of each bucket that the rows (as stored) fall into."""
        folder = f"data/{uuid.uuid4().hex}"
        bucket = F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")
        rows.withColumn("_bucket", bucket).repartition("_bucket").write.partitionBy("_bucket").parquet(f"{self.path}/{folder}")
        found = [s.getPath().getName() for s in self._fs.listStatus(self._file(folder))]
        return {n.split("=")[1]: f"{folder}/{n}" for n in found if n.startswith("_bucket=")}

    def _append(self, rows: DataFrame, gone: bool) -> int:
        number, state = self.snapshot()
        cast = [F.col(f.name).cast(f.dataType).alias(f.name) if f.name in rows.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in self.schema.fields]
        stored = rows.select(*cast, F.lit(number + 1).cast("long").alias("_seq"), F.lit(gone).alias("_gone"))
        w = Window.partitionBy(*self.keys).orderBy(F.desc(self.order), *[F.col(f.name) for f in self.schema.fields if f.name != self.order and f.name not in self.keys])
        one = stored.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
        for bucket, folder in self._write(one).items():
            state.setdefault(bucket, []).append(folder)
        self._commit(number + 1, state)
        return number + 1

    def upsert(self, rows: DataFrame) -> int:
        """Add or replace rows by key; of rows with one key the one of greatest order counts.  Returns the commit's number."""
        return self._append(rows, False)

    def delete(self, keys: DataFrame) -> int:
        """Delete what has one of the keys now; later rows of such a key are there again."""
        return self._append(keys.select(*self.keys).distinct(), True)

    def _rows(self, folders: list[str]) -> DataFrame:
        """What the folders' rows come to, with the commit that each is from."""
        if not folders:
            return self.spark.createDataFrame([], self.stored)
        read = self.spark.read.schema(self.stored).parquet(*[f"{self.path}/{f}" for f in folders])
        by = Window.partitionBy(*self.keys)
        live = read.withColumn("_last", F.max(F.when(F.col("_gone"), F.col("_seq"))).over(by)).where("not _gone and (_last is null or _seq > _last)")
        return live.withColumn("_n", F.row_number().over(by.orderBy(F.desc(self.order), F.desc("_seq")))).where("_n = 1").drop("_n", "_last")

    def read(self) -> DataFrame:
        """The table as of the last commit."""
        return self._rows([f for folders in self.snapshot()[1].values() for f in folders]).drop("_seq", "_gone")

    def lookup(self, keys: list[tuple]) -> DataFrame:
        """The rows of some keys; only their buckets are read."""
        types = T.StructType([self.schema[k] for k in self.keys])
        wanted = self.spark.createDataFrame([tuple(k) for k in keys], types)
        asked = {str(r[0]) for r in wanted.select(F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")).collect()}
        rows = self._rows([f for b, folders in self.snapshot()[1].items() if b in asked for f in folders]).drop("_seq", "_gone")
        same = reduce(lambda a, b: a & b, [rows[k].eqNullSafe(wanted[k]) for k in self.keys])
        return rows.join(wanted, same, "left_semi")

    def compact(self) -> list[str]:
        """Rewrite the buckets with several folders; returns them."""
        number, state = self.snapshot()
        many = sorted(b for b, folders in state.items() if len(folders) > 1)
        if many:
            fresh = self._write(self._rows([f for b in many for f in state[b]]))
            self._commit(number + 1, {b: folders for b, folders in state.items() if b not in many} | {b: [f] for b, f in fresh.items()})
        return many
