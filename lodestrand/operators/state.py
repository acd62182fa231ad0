"""Keyed state on append-only tables: latest wins, pending work, upserts, deletes, derived updates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest(events: DataFrame, keys: list[str], order: list[str | Column]) -> DataFrame:
    """The last event of each key; its error replaces the former one, null included."""
    w = Window.partitionBy(*keys).orderBy(*[F.desc(c) if isinstance(c, str) else c for c in order])
    return events.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def pending(ids: DataFrame, state: DataFrame, key: str, stage: str, done: str = "done") -> DataFrame:
    """Ids whose latest status of the stage isn't done; failed ones are pending again."""
    finished = state.where((F.col("stage") == stage) & (F.col("status") == done)).select(key)
    return ids.join(finished, key, "left_anti")


def upsert(base: DataFrame, more: DataFrame, keys: list[str], order: str) -> DataFrame:
    """base and more with one row a key: the one of greatest ``order``, of equals the one in ``more``."""
    both = base.withColumn("_new", F.lit(0)).unionByName(more.withColumn("_new", F.lit(1)), allowMissingColumns=True)
    return latest(both, keys, [order, "_new"]).drop("_new")


def delete_ids(base: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    return base.join(ids.select(key), key, "left_anti")


def delete_where(base: DataFrame, column: str, value) -> DataFrame:
    return base.where(~F.col(column).eqNullSafe(F.lit(value)))


def unique_lookup(points: DataFrame, paths: DataFrame, path: str, key: str) -> DataFrame:
    """Points of the given paths; an error where one path has two ids."""
    got = points.join(paths.select(path).distinct(), path, "left_semi")
    many = F.size(F.collect_set(key).over(Window.partitionBy(path)))
    return got.withColumn("_k", many).withColumn(path, F.when(F.col("_k") > 1, F.raise_error(F.concat(F.lit("several ids for "), F.col(path)))).otherwise(F.col(path))).drop("_k")


def document_id(id_: Column, path: Column) -> Column:
    """The given id, else the path's MD5, else a random one."""
    return F.coalesce(F.nullif(id_, F.lit("")), F.md5(F.nullif(path, F.lit(""))), F.uuid())


def shot_times(points: DataFrame, by: list[str], position: str, at: str) -> DataFrame:
    """by, start_time, end_time: of the positions named start and end, else the least and greatest time."""
    named = lambda p: F.max(F.when(F.col(position) == p, F.col(at)))
    return points.groupBy(*by).agg(F.coalesce(named("start"), F.min(at)).alias("start_time"), F.coalesce(named("end"), F.max(at)).alias("end_time"))


def verify_shot_times(points: DataFrame, start: str = "start_time", end: str = "end_time") -> DataFrame:
    there = F.col(start).isNotNull() & F.col(end).isNotNull()
    return points.agg(F.count("*").alias("checked"), F.count_if(there).alias("present"), F.count_if(~there).alias("missing"), F.count_if(there & (F.col(start) > F.col(end))).alias("bad_range"))


def positions_by_shot(points: DataFrame, by: list[str], position: str, frame: str) -> DataFrame:
    """by, positions: map of position to frame; of repeats the last in frame order."""
    last = points.groupBy(*by, position).agg(F.max(frame).alias("_f"))
    return last.groupBy(*by).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(position, "_f")))).alias("positions"))


def repair(results: DataFrame, canonical: DataFrame, key: str, fields: list[str], bad: Column) -> DataFrame:
    """Rows that need it take the canonical row's fields where those are there; the others stay as they are.

    Of several canonical rows the least in the order of the fields counts.
    """
    known = canonical.groupBy(key).agg(F.min(F.struct(*[F.col(f).alias(f"_c_{f}") for f in fields])).alias("_c")).select(key, "_c.*")
    rows = results.withColumn("_bad", bad).join(known, key, "left")
    fixed = {f: F.when(F.col("_bad"), F.coalesce(F.col(f"_c_{f}"), F.col(f))).otherwise(F.col(f)) for f in fields}
    return rows.withColumns(fixed).select(*results.columns)


def order_mismatches(a: DataFrame, b: DataFrame, by: list[str], value: str, order_a: list[str], order_b: list[str]) -> DataFrame:
    """by, place, left, right: where the values of a group differ at a place, or one side has no such place."""
    placed = lambda df, order, name: df.select(*by, F.row_number().over(Window.partitionBy(*by).orderBy(*order)).alias("place"), F.col(value).alias(name))
    both = placed(a, order_a, "left").join(placed(b, order_b, "right"), [*by, "place"], "full")
    return both.where(~F.col("left").eqNullSafe(F.col("right")))


def same_rows(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of one table and not the other, with their side; none if they are the same, repeats counted."""
    return a.exceptAll(b).withColumn("side", F.lit("left")).unionByName(b.exceptAll(a).withColumn("side", F.lit("right")))
