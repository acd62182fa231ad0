"""Running aggregates over keys of any size: two passes over ranges of (key, order), so that no key is one task's.

Rows are ranged by (key, order) and written once.  Within a part a window function runs over that part's rows of a key;
a part's total for a key is one row, and what comes before a part is a window over these totals, of which a key has as
many as there are parts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestrand.sources.sinks import staged

_FIRST, _LAST = Window.unboundedPreceding, -1


def ranged(rows: DataFrame, by: list[str], order: list[str], parts: int | None = None) -> DataFrame:
    """``rows`` written with _part: parts rise with (key, order), and a key may be in many."""
    parts = parts or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return staged(rows.repartitionByRange(parts, *by, *order).withColumn("_part", F.spark_partition_id()))


def running_before(rows: DataFrame, by: list[str], order: list[str], name: str, value: Column, how: str = "max") -> DataFrame:
    """Ranged ``rows`` with ``name``: the max or sum of ``value`` over the rows of the key that come before; null for none."""
    agg = {"max": F.max, "sum": F.sum}[how]
    valued = rows.withColumn("_x", value)
    here = valued.withColumn("_h", agg("_x").over(Window.partitionBy(*by, "_part").orderBy(*order).rowsBetween(_FIRST, _LAST)))
    totals = valued.groupBy(*by, "_part").agg(agg("_x").alias("_t"))
    earlier = totals.withColumn("_e", agg("_t").over(Window.partitionBy(*by).orderBy("_part").rowsBetween(_FIRST, _LAST)))
    earlier = earlier.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(by)], F.col("_part").alias("_p"), "_e")
    on = F.col("_part") == F.col("_p")
    for i, c in enumerate(by):
        on = on & F.col(c).eqNullSafe(F.col(f"_k{i}"))
    both = here.join(earlier, on, "left")
    met = F.greatest("_h", "_e") if how == "max" else F.coalesce(F.col("_h") + F.col("_e"), "_h", "_e")
    return both.select(*rows.columns, met.alias(name))


def previous(rows: DataFrame, by: list[str], order: list[str], name: str, column: str) -> DataFrame:
    """Ranged ``rows`` with ``name``: the column's value in the row before, of any part; null for none."""
    last = F.struct(*[F.col(c).alias(f"o{i}") for i, c in enumerate(order)], F.col(column).alias("v"))
    return running_before(rows, by, order, "_last", last).withColumn(name, F.col("_last.v")).drop("_last")


def _cut(keys: int, longest: float, step: int = 64):
    """Segments of rows (keys.., text, start, end, fresh) in order: a new one at a fresh row and where it would last too long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # of the open segment: its keys as arrays of one row, number in its run, texts, start and end

        def out(done: list, batch: pa.RecordBatch | None) -> pa.RecordBatch:
            """done: (row of the batch, or the open segment's keys; number, texts, start, end)."""
            columns = []
            for c in range(keys):
                parts = [d[0][c] if isinstance(d[0], list) else batch.column(c).slice(d[0], 1) for d in done]
                columns.append(pa.concat_arrays(parts))
            rest = [pa.array([d[1] for d in done], pa.int64()), pa.array([" ".join(d[2]) for d in done], pa.string()), *[pa.array([d[i] for d in done], pa.float64()) for i in (3, 4)]]
            return pa.record_batch([*columns, *rest], names=[*names, "_number", "text", "start", "end"])

        names: list[str] = []
        for batch in batches:
            names = batch.schema.names[:keys]
            if not batch.num_rows:
                continue
            text = batch.column(keys).to_pylist()
            s, e, fresh = (batch.column(keys + i).to_numpy(zero_copy_only=False) for i in (1, 2, 3))
            n, i, done = len(text), 0, []
            while i < n:
                if held is None or fresh[i] or e[i] - held[3] > longest:
                    number = 0 if held is None or fresh[i] else held[1] + 1
                    if held is not None:
                        done.append(held)
                    held, i = (i, number, [text[i]], s[i], e[i]), i + 1
                # The rows up to the next cut belong to the open segment.
                j = i
                while j < n:
                    stop = (e[j : j + step] - held[3] > longest) | fresh[j : j + step]
                    if stop.any():
                        j += int(stop.argmax())
                        break
                    j = min(j + step, n)
                if j > i:
                    held = (held[0], held[1], held[2] + text[i:j], held[3], e[j - 1])
                i = j
            if done:
                yield out(done, batch)
            if not isinstance(held[0], list):
                held = ([batch.column(c).slice(held[0], 1) for c in range(keys)], *held[1:])
        if held is not None:
            yield out([held], None)

    return run


def cut_runs(rows: DataFrame, by: list[str], order: list[str], longest: float) -> DataFrame:
    """by, _run, _number, text, start, end: the runs of rows (by, _run, order.., text, start, end, fresh) cut so that none lasts too long.

    A run is dealt to one task and streamed there: what is held is the open segment.
    """
    keys = [*by, "_run"]
    dealt = rows.repartition(*keys).sortWithinPartitions(*keys, *order).select(*keys, "text", "start", "end", "fresh")
    schema = T.StructType([*[dealt.schema[c] for c in keys], T.StructField("_number", T.LongType()), T.StructField("text", T.StringType()), T.StructField("start", T.DoubleType()), T.StructField("end", T.DoubleType())])
    return dealt.mapInArrow(_cut(len(keys), longest), schema)
