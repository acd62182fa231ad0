"""Joins on time: points in intervals, overlaps, nearest neighbours, merges, chunks.

Interval joins bin time on levels: the bins of a level are twice as long as those of the level below, and an interval is
on the level whose bins are as long as itself, where it touches two at most.  Points fall into one bin of every level
that has intervals, and a pair of intervals meets on the longer one's level.  The join is an equi-join on (key, level,
bin) with the exact condition as a residual; pairs met in two bins are counted in one.  Keys with few intervals need no
bins: their rows are on one level, LEVEL_OF_FEW, with one bin, so that each is shuffled once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestrand.operators import scans
from lodestrand.sources.sinks import staged


#: Most intervals of a key whose rows are all compared, and the level these are on.  So many comparisons cost a row less
#: than its copies for all levels (up to a dozen where lengths differ by eight powers of ten).
FEW, LEVEL_OF_FEW = 1024, -1


def _bins(low: Column, high: Column, width: float | Column) -> Column:
    return F.sequence(F.floor(low / width), F.floor(high / width))


def _level(low: Column, high: Column, width: float) -> Column:
    """The level of an interval: bins of level 0 have the given width."""
    return F.greatest(F.lit(0), F.coalesce(F.ceil(F.log2(F.nullif(high - low, F.lit(0.0)) / width)), F.lit(0))).cast("int")


def _size(level: str, width: float) -> Column:
    return F.lit(float(width)) * F.pow(F.lit(2.0), F.col(level))


def _bin(at: Column, width: float) -> Column:
    """The bin of a time on the row's ``_level``."""
    return F.when(F.col("_level") == LEVEL_OF_FEW, F.lit(0).cast("long")).otherwise(F.floor(at / _size("_level", width)))


def _levels(*intervals: DataFrame) -> Column:
    """The levels of intervals that have one, as an array: as many as doublings between the shortest and the longest."""
    found = {r[0] for rows in intervals for r in rows.where("_many").select("_own").distinct().collect()}
    return F.array(*[F.lit(x) for x in sorted(found) or [0]])


def _crowded(intervals: DataFrame, on: list[str]) -> DataFrame | None:
    """The keys of more than FEW intervals, with ``_many``; None if no key has."""
    found = staged(intervals.groupBy(*on).agg(F.count("*").alias("_n")).where(F.col("_n") > FEW).select(*on))
    return None if found.isEmpty() else found.withColumn("_many", F.lit(True))


def _marked(rows: DataFrame, crowded: DataFrame | None, on: list[str]) -> DataFrame:
    return rows.withColumn("_many", F.lit(False)) if crowded is None else rows.join(crowded, on, "left").withColumn("_many", F.coalesce("_many", F.lit(False)))


def points_in_intervals(intervals: DataFrame, points: DataFrame, on: list[str], start: str, end: str, at: str, width: float) -> DataFrame:
    """Every interval with every point of the same key in it, both ends included; ``width`` is that of the shortest bins."""
    low, high = F.col(start), F.col(end)
    a, b, within = intervals.where(low <= high), points.where(F.col(at).isNotNull()), (F.col(at) >= low) & (F.col(at) <= high)
    crowded = _crowded(a, on)
    if crowded is None:
        return a.join(b, on).where(within)
    a = _marked(a, crowded, on).withColumn("_own", F.when(F.col("_many"), _level(low, high, width)).otherwise(LEVEL_OF_FEW))
    levels = F.when(F.col("_many"), _levels(a)).otherwise(F.array(F.lit(LEVEL_OF_FEW)))
    a = a.withColumnRenamed("_own", "_level").withColumn("_bin", F.explode(F.sequence(_bin(low, width), _bin(high, width)))).drop("_many")
    b = _marked(b, crowded, on).withColumn("_level", F.explode(levels)).withColumn("_bin", _bin(F.col(at), width)).drop("_many")
    return a.join(b, [*on, "_level", "_bin"]).where(within).drop("_level", "_bin")


def overlaps(spans: DataFrame, segments: DataFrame, on: list[str], pad: float, width: float, span: tuple[str, str] = ("lo", "hi"), seg: tuple[str, str] = ("start", "end")) -> DataFrame:
    """Spans, widened by pad, with the segments they touch; one null bound borrows the other, two match nothing."""
    lo = F.coalesce(span[0], span[1]) - pad
    hi = F.coalesce(span[1], span[0]) + pad
    a = spans.withColumn("_lo", lo).withColumn("_hi", hi).where("_lo <= _hi")
    b = segments.where(F.col(seg[0]) <= F.col(seg[1]))
    touch = (F.col(seg[1]) >= F.col("_lo")) & (F.col(seg[0]) <= F.col("_hi"))
    crowded = _crowded(b, on)
    if crowded is None:
        return a.join(b, on).where(touch).drop("_lo", "_hi")

    def own(rows: DataFrame, start: Column, end: Column) -> DataFrame:
        return _marked(rows, crowded, on).withColumn("_own", F.when(F.col("_many"), _level(start, end, width)).otherwise(LEVEL_OF_FEW))

    a, b = own(a, F.col("_lo"), F.col("_hi")), own(b, F.col(seg[0]), F.col(seg[1]))
    levels = _levels(a, b)

    def placed(rows: DataFrame, name: str, start: Column, end: Column) -> DataFrame:
        """On its own level and those above it."""
        mine = F.when(F.col("_many"), F.filter(levels, lambda x: x >= F.col(name))).otherwise(F.array(F.lit(LEVEL_OF_FEW)))
        rows = rows.withColumnRenamed("_own", name).withColumn("_level", F.explode(mine)).drop("_many")
        return rows.withColumn("_bin", F.explode(F.sequence(_bin(start, width), _bin(end, width))))

    a, b = placed(a, "_la", F.col("_lo"), F.col("_hi")), placed(b, "_lb", F.col(seg[0]), F.col(seg[1]))
    first = (F.col("_level") == F.greatest("_la", "_lb")) & (F.col("_bin") == F.greatest(_bin(F.col("_lo"), width), _bin(F.col(seg[0]), width)))
    return a.join(b, [*on, "_level", "_bin"]).where(touch & first).drop("_level", "_bin", "_lo", "_hi", "_la", "_lb")


def overlap_text(spans: DataFrame, segments: DataFrame, on: list[str], keys: list[str], order: list[str], text: str, pad: float = 1.5, width: float = 60.0, **names) -> DataFrame:
    """``spans`` with ``speech``: texts of the touched segments in their order, joined by blanks, '' for none."""
    said = overlaps(spans, segments, on, pad, width, **names).groupBy(*keys).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(*order, text))), lambda s: s[text]), " ").alias("speech"))
    return spans.join(said, keys, "left").withColumn("speech", F.coalesce("speech", F.lit("")))


def nearest(left: DataFrame, right: DataFrame, on: list[str], at: str, other: str, radius: float, keys: list[str], ties: list[str]) -> DataFrame:
    """``left`` with the columns of its nearest row of ``right`` within radius (ties: least), null if none is."""
    a = left.where(F.col(at).isNotNull()).withColumn("_bin", F.explode(_bins(F.col(at) - radius, F.col(at) + radius, radius)))
    b = right.where(F.col(other).isNotNull()).withColumn("_bin", F.floor(F.col(other) / radius))
    gap = F.abs(F.col(other) - F.col(at))
    mine = [c for c in right.columns if c not in on]
    met = a.join(b, [*on, "_bin"]).where(gap <= radius).groupBy(*keys).agg(F.min(F.struct(gap.alias("_gap"), *ties, *[c for c in mine if c not in ties])).alias("_m"))
    return left.join(met, keys, "left").select(*left.columns, *[F.col(f"_m.{c}").alias(c) for c in mine])


def shot_bounds(frames: DataFrame, shots: DataFrame, on: list[str], bounds: list[str]) -> DataFrame:
    """``frames`` with the bounds of their shot; null where the shot isn't known."""
    known = shots.groupBy(*on).agg(F.min(F.struct(*bounds)).alias("_b"))
    return frames.join(known, on, "left").select(*frames.columns, *[F.col(f"_b.{b}").alias(b) for b in bounds])


def frame_at(wanted: DataFrame, frames: DataFrame, on: list[str], ties: list[str]) -> DataFrame:
    """``wanted`` (on: video and frame index) with the first frame of exactly that index; null where there is none."""
    mine = [c for c in frames.columns if c not in on]
    first = frames.groupBy(*on).agg(F.min(F.struct(*ties, *[c for c in mine if c not in ties])).alias("_f"))
    return wanted.join(first, on, "left").select(*wanted.columns, *[F.col(f"_f.{c}").alias(c) for c in mine])


def midpoint_pick(pairs: DataFrame, keys: list[str], start: str, end: str, at: str, ties: list[str]) -> DataFrame:
    """For each interval the row nearest to its middle."""
    gap = F.abs(F.col(at) - (F.col(start) + F.col(end)) / 2)
    order = Window.partitionBy(*keys).orderBy(gap, *ties)
    return pairs.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def merge_intervals(intervals: DataFrame, by: list[str], start: str, end: str, slack: float, ties: list[str], spread: bool = False) -> DataFrame:
    """``intervals`` with island (1..), merged where a start is within slack of the greatest end so far.

    ``spread`` deals a key's intervals over many tasks, for keys that hold a large share of all rows.
    """
    if spread:
        order = [start, *ties]
        found = scans.running_before(scans.ranged(intervals, by, order), by, order, "_far", F.col(end))
        flagged = staged(found.withColumn("_f", F.when(F.col(start) <= F.col("_far") + slack, 0).otherwise(1)).drop("_far"))
        out = scans.running_before(flagged, by, order, "_n", F.col("_f"), "sum")
        return out.withColumn("island", F.coalesce("_n", F.lit(0)) + F.col("_f")).drop("_f", "_n", "_part")
    w = Window.partitionBy(*by).orderBy(start, *ties)
    so_far = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.when(F.col(start) <= so_far + slack, 0).otherwise(1)
    return intervals.withColumn("_f", fresh).withColumn("island", F.sum("_f").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_f")


def chunks(intervals: DataFrame, start: str, end: str, length: float, overlap: float) -> DataFrame:
    """Overlapping chunks of [start, end): chunk, chunk_start, chunk_end; the last ends with the interval."""
    step = max(length - overlap, 0.001)
    span = F.col(end) - F.col(start)
    last = F.greatest(F.ceil((span - length) / step), F.lit(0)).cast("long")
    out = intervals.where(span > 0).withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), last)))
    return out.withColumn("chunk_start", F.col(start) + F.col("chunk") * step).withColumn("chunk_end", F.least(F.col(start) + F.col("chunk") * step + length, F.col(end)))


def neighbours(hits: DataFrame, shots: DataFrame, on: list[str], number: str, reach: int = 1) -> DataFrame:
    """Each hit with the shots numbered within reach of its own that exist, as ``neighbour``."""
    around = hits.withColumn("neighbour", F.explode(F.sequence(F.col(number) - reach, F.col(number) + reach)))
    there = shots.select(*on, F.col(number).alias("neighbour")).distinct()
    return around.join(there, [*on, "neighbour"])


def around_or_all(probes: DataFrame, docs: DataFrame, on: list[str], keys: list[str], at: str, window: float, width: float, seg: tuple[str, str] = ("start", "end")) -> DataFrame:
    """Documents that touch at +- window; a probe that touches none gets all of its key."""
    spans = probes.withColumn("_a", F.col(at)).withColumn("_b", F.col(at))
    near = overlaps(spans, docs, on, window, width, span=("_a", "_b"), seg=seg).drop("_a", "_b").withColumn("in_window", F.lit(True))
    rest = probes.join(near.select(*keys).distinct(), keys, "left_anti").join(docs, on).withColumn("in_window", F.lit(False))
    return near.unionByName(rest)
