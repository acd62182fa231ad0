"""Bands by tiles, interval joins on levels and scans over hot keys, against plain Python and by what their plans deal out."""

from __future__ import annotations

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestrand.operators import bands, intervals, scans, sequences


# bands


def plain_bands(rows, window, unit):
    h = window // 2
    at = {(v, n): np.array(x, float) for v, n, x in rows if x is not None}
    if unit:
        at = {k: x / np.linalg.norm(x) if np.linalg.norm(x) else x for k, x in at.items()}
    zero = [0.0] * window
    return {(v, n): zero if (v, n) not in at else [float(at[v, n] @ at[v, n + o]) if (v, n + o) in at else 0.0 for o in range(-h, h + 1)] for v, n, _ in rows}


@pytest.mark.parametrize("window, tile, unit", [(101, 2048, True), (7, 8, True), (7, 1, False), (1, 5, True)])
def test_bands(spark, window, tile, unit):
    rng = np.random.default_rng(1)
    rows = [(v, n, [float(x) for x in rng.normal(size=5)]) for v in ("a", "b", None) for n in range(-30, 170) if (n * 7 + len(v or "")) % 11]
    rows = [(v, n, None if n == 20 else [0.0] * 5 if n == 25 else x) for v, n, x in rows] + [("one", 5, [1.0, 2.0, 0.0, 0.0, 0.0]), ("bare", 1, None)]
    df = spark.createDataFrame(rows, "v string, n long, x array<double>").repartition(5)
    got = {(r["v"], r["n"]): r["band"] for r in bands.self_similarity_bands(df, ["v"], "n", "x", window, tile, unit).collect()}
    want = plain_bands(rows, window, unit)
    assert got.keys() == want.keys()
    assert all(np.allclose(got[k], want[k], atol=1e-12) for k in want)


def test_bands_deal_a_vector_once_and_its_halo(spark):
    df = spark.range(0, 40_000).select(F.lit("a").alias("v"), F.col("id").alias("n"), F.array(F.lit(1.0), F.lit(0.0)).alias("x")).where("n <> 7")
    out = bands.self_similarity_bands(df, ["v"], "n", "x", 101, 2048)
    assert out.count() == 39_999
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("Exchange hashpartitioning") == 1
    # Nineteen inner edges, each with fifty places of halo on either side, and the halo beyond both ends of the series.
    tiles = df.select(F.explode(F.sequence(F.floor((F.col("n") - 50) / 2048), F.floor((F.col("n") + 50) / 2048)))).count()
    assert tiles <= 40_000 * (1 + 100 / 2048) + 100
    with pytest.raises(Exception, match="one place"):
        bands.self_similarity_bands(df.unionByName(df), ["v"], "n", "x").collect()
    with pytest.raises(ValueError, match="odd"):
        bands.self_similarity_bands(df, ["v"], "n", "x", 100)


# interval joins


def spans(seed, n=250):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        lo = rng.choice([rng.uniform(-1e6, 1e6), float(rng.randint(-50, 50)), rng.uniform(-5e7, 5e7)])
        out.append((i, rng.choice(["u", "v"]), lo, lo + rng.choice([0.0, 1.0, 60.0, 64.0, rng.uniform(0, 10) ** rng.randint(0, 8), 1e8])))
    return out + [(n, "u", 5.0, 4.0), (n + 1, "u", None, 3.0), (n + 2, "v", -1e8, 1e8)]


@pytest.mark.parametrize("width", [1.0, 60.0, 1e5])
def test_joins_of_spans_of_any_length(spark, width):
    a, b = spans(1), spans(2)
    one = spark.createDataFrame(a, "a long, u string, lo double, hi double")
    two = spark.createDataFrame(b, "b long, u string, s double, e double")
    got = {(r["a"], r["b"]) for r in intervals.overlaps(one, two, ["u"], 1.5, width, seg=("s", "e")).select("a", "b").collect()}
    want = set()
    for i, u, lo, hi in a:
        low, high = (lo if lo is not None else hi) - 1.5, (hi if hi is not None else lo) + 1.5
        want |= {(i, j) for j, v, s, e in b if u == v and low <= high and s is not None and s <= e and e >= low and s <= high}
    assert got == want and intervals.overlaps(one, two, ["u"], 1.5, width, seg=("s", "e")).count() == len(want)
    points = spark.createDataFrame([(j, v, s) for j, v, s, _ in b], "b long, u string, at double")
    inside = intervals.points_in_intervals(one.where("lo is not null"), points, ["u"], "lo", "hi", "at", width)
    assert sorted(tuple(r) for r in inside.select("a", "b").collect()) == sorted((i, j) for i, u, lo, hi in a for j, v, s, _ in b if u == v and lo is not None and s is not None and lo <= s <= hi)


def test_keys_of_few_spans_are_shuffled_once(spark):
    """Rows of a key with few spans aren't dealt to the levels, also beside a key that has many."""
    rows = [r for r in spans(3) if r[2] is not None and r[1] == "u"] + [(1000 + i, f"k{i % 40}", i * 10.0, i * 10.0 + 10.0 ** (i % 9)) for i in range(200)] + [(2000, None, 0.0, 9.0)]
    few = [r for r in rows if r[1] != "u"]
    at = [(i, u, x) for i, (u, x) in enumerate([(u, lo + d) for _, u, lo, _ in rows for d in (0.0, 3.0)] + [("none", 1.0), ("u", None)])]
    points = spark.createDataFrame(at, "b long, u string, at double")
    for given in (rows, few):
        one, two = (spark.createDataFrame(given, f"{n} long, u string, {lo} double, {hi} double") for n, lo, hi in (("a", "lo", "hi"), ("c", "s", "e")))
        inside = intervals.points_in_intervals(one, points, ["u"], "lo", "hi", "at", 1.0)
        assert inside.columns == ["u", "a", "lo", "hi", "b", "at"]
        assert sorted((r["a"], r["b"]) for r in inside.collect()) == sorted((i, j) for i, u, lo, hi in given for j, v, x in at if u == v and u is not None and x is not None and lo <= x <= hi)
        touching = intervals.overlaps(one, two, ["u"], 1.5, 1.0, seg=("s", "e"))
        assert touching.columns == ["u", "a", "lo", "hi", "c", "s", "e"]
        assert sorted((r["a"], r["c"]) for r in touching.collect()) == sorted((i, j) for i, u, lo, hi in given for j, v, s, e in given if u == v and u is not None and lo - 1.5 <= hi + 1.5 and s <= e and e >= lo - 1.5 and s <= hi + 1.5)
    plans = [df._jdf.queryExecution().executedPlan().toString() for df in (inside, touching)]
    assert not any("Generate" in p for p in plans)


def crowd(n, key="u"):
    """Spans of one key, of nine lengths between 1 and 1e8."""
    return [(i, key, i * 37 % 1000 * 1e5, i * 37 % 1000 * 1e5 + 10.0 ** (i % 9)) for i in range(n)]


def touched(spark, given):
    """The frame of touching pairs of spans, and what plain Python finds."""
    one, two = (spark.createDataFrame(given, f"{n} long, u string, {lo} double, {hi} double") for n, lo, hi in (("a", "lo", "hi"), ("c", "s", "e")))
    out = intervals.overlaps(one, two, ["u"], 1.5, 1.0, seg=("s", "e")).select("a", "c")
    return out, sorted((i, j) for i, u, lo, hi in given for j, v, s, e in given if u == v and e >= lo - 1.5 and s <= hi + 1.5)


def test_keys_of_hundreds_of_spans_are_shuffled_once(spark):
    out, want = touched(spark, crowd(600) + [(5000 + i, *r) for i, *r in crowd(300, "v")])
    assert sorted(map(tuple, out.collect())) == want
    assert "Generate" not in out._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("few, n", [(1024, 1025), (16, 200), (0, 40)])
def test_spans_of_crowded_keys_meet_on_levels(spark, monkeypatch, few, n):
    """One key beyond the bound beside one within it: each pair once, whichever way it met."""
    monkeypatch.setattr(intervals, "FEW", few)
    out, want = touched(spark, crowd(n) + [(5000 + i, *r) for i, *r in crowd(few, "v")] + [r for r in spans(4) if few == 16 and r[2] is not None and r[2] <= r[3]])
    assert sorted(map(tuple, out.collect())) == want
    assert "Generate" in out._jdf.queryExecution().executedPlan().toString()
    points = spark.createDataFrame([(i, u, lo) for i, u, lo, _ in crowd(n)], "b long, u string, at double")
    one = spark.createDataFrame(crowd(n), "a long, u string, lo double, hi double")
    inside = intervals.points_in_intervals(one, points, ["u"], "lo", "hi", "at", 1.0).select("a", "b")
    assert sorted(map(tuple, inside.collect())) == sorted((i, j) for i, _, lo, hi in crowd(n) for j, _, x, _ in crowd(n) if lo <= x <= hi)


def test_long_spans_touch_few_bins(spark):
    """Spans of a second and of three years: two bins each at most, where bins of a minute would be a million and a half."""
    rows = spark.createDataFrame([(i, "u", i * 1000.0, i * 1000.0 + (1.0 if i % 2 else 1e8)) for i in range(1000)], "k long, u string, lo double, hi double")
    levels = rows.withColumn("_level", intervals._level(F.col("lo"), F.col("hi"), 60.0))
    assert levels.select(F.explode(intervals._bins(F.col("lo"), F.col("hi"), intervals._size("_level", 60.0)))).count() <= 2000
    assert levels.select("_level").distinct().count() == 2


# scans


def plain_islands(rows, slack):
    out, far, number, last = [], None, 0, object()
    for v, lo, hi, k in sorted(rows, key=lambda r: (r[0] is not None, r[0] or "", r[1], r[3])):
        if v != last:
            far, number, last = None, 0, v
        if far is None or lo > far + slack:
            number += 1
        far = hi if far is None else max(far, hi)
        out.append((k, number))
    return sorted(out)


def test_islands_of_a_hot_key(spark):
    rng = random.Random(3)
    rows = [("hot" if i % 10 else rng.choice(["a", "b", None]), (lo := rng.uniform(0, 9e4)), lo + rng.choice([0.5, 1.0, 40.0 if i % 50 == 0 else 2.0]), i) for i in range(6000)]
    df = spark.createDataFrame(rows, "v string, lo double, hi double, k long").repartition(4)
    want = plain_islands(rows, 1.0)
    assert max(n for _, n in want) > 500
    for spread in (False, True):
        got = intervals.merge_intervals(df, ["v"], "lo", "hi", 1.0, ["k"], spread)
        assert set(got.columns) == {"v", "lo", "hi", "k", "island"} and sorted((r["k"], r["island"]) for r in got.collect()) == want
    # The hot key's rows lie in many parts, and no window over rows is by the key alone.
    dealt = scans.ranged(df, ["v"], ["lo", "k"], 64)
    assert dealt.where("v = 'hot'").select("_part").distinct().count() > 40
    plan = scans.running_before(dealt, ["v"], ["lo", "k"], "far", F.col("hi"))._jdf.queryExecution().executedPlan().toString()
    over = [line for line in plan.splitlines() if re.search(r"\+- Window \[", line)]
    assert len(over) == 2 and sum("_part" in line.split("windowspecdefinition(")[1].split(" ASC")[0] for line in over) >= 1


def test_running_sums_and_the_row_before(spark):
    rng = random.Random(5)
    rows = [(rng.choice(["x", "y", None]), i, rng.choice([None, rng.randint(-9, 9)])) for i in range(800)]
    df = scans.ranged(spark.createDataFrame(rows, "v string, n long, x long"), ["v"], ["n"], 16)
    sums = {r["n"]: r["s"] for r in scans.running_before(df, ["v"], ["n"], "s", F.col("x"), "sum").collect()}
    last = {r["n"]: r["p"] for r in scans.previous(df, ["v"], ["n"], "p", "x").collect()}
    for v, n, _ in rows:
        mine = [x for w, m, x in rows if w == v and m < n]
        known = [x for x in mine if x is not None]
        assert sums[n] == (sum(known) if known else None) and last[n] == (mine[-1] if mine else None)


def plain_segments(words, gap, longest):
    out = {}
    for v in {w[0] for w in words}:
        number, open_ = 0, None
        clean = [(o, t.strip(), s or 0.0, e if e is not None else s or 0.0) for x, o, t, s, e in words if x == v and t and t.strip()]
        for _, t, s, e in sorted(clean):
            if open_ is None or s - open_[2] > gap or e - open_[1] > longest:
                number += 1
                open_ = [[t], s, e]
                out[v, number] = open_
            else:
                open_[0].append(t)
                open_[2] = e
    return sorted((v or "", n, " ".join(t), s, e) for (v, n), (t, s, e) in out.items())


@pytest.mark.parametrize("batch", [3, 10_000])
def test_word_segments_of_a_long_file(spark, batch):
    rng = random.Random(8)
    words, at = [], 0.0
    for i in range(5000):
        at += rng.choice([0.1, 0.3, 0.5]) + (2.0 if rng.random() < 0.002 else 0.0)
        words.append(("long" if i % 20 else rng.choice(["s", None]), i, rng.choice(["a", " b ", "", None, "cc"]), round(at, 3) if rng.random() > 0.001 else None, round(at + rng.choice([0.05, 0.2, 0.9]), 3) if rng.random() > 0.02 else None))
    df = spark.createDataFrame(words, "v string, ord long, text string, start_time double, end_time double").repartition(6)
    want = plain_segments(words, 0.6, 15.0)
    assert len(want) > 80
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(batch))
    try:
        for spread in (False, True):
            got = sorted((r["v"] or "", r["seg_no"], r["text"], r["start"], r["end"]) for r in sequences.word_segments(df, ["v"], spread=spread).collect())
            assert got == want
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    plan = sequences.word_segments(df, ["v"])._jdf.queryExecution().executedPlan().toString()
    assert "collect_list" not in plan


# digests


@pytest.mark.parametrize("most", [300, 1800])
def test_digest_of_many_lines(spark, most):
    """A key with tens of thousands of lines: each is looked at once, and the key's row is made of a few of them."""
    rng = random.Random(4)
    rows = [("hot", i // 3, rng.choice([None, "", "x" * 30, f"line {i}", f"longer line {i}"])) for i in range(40_000)] + [("hot", -1, "y" * 4000)] * 2
    rows += [(None, i, "n") for i in range(5)] + [("blank", i, None) for i in range(3)] + [("short", i, None if i % 2 else "s") for i in range(9)]
    got = {r["v"]: r["digest"] for r in sequences.digest(spark.createDataFrame(rows, "v string, i long, line string").repartition(7), ["v"], ["i"], "line", most).collect()}
    want = {}
    for v in {r[0] for r in rows}:
        lines = [x for _, _, x in sorted((i, x is not None, x or "") if x is not None else (i, False, None) for w, i, x in rows if w == v)]
        whole = " ".join(x for x in lines if x is not None)
        step = max(1, len(lines) // max(1, most // max(1, len(whole) // len(lines) + 1)))
        want[v] = whole if len(whole) <= most else " ".join(x for x in lines[::step] if x is not None)[:most]
    assert got == want and len(got["hot"]) == most and got["short"] == "s s s s s"


# shot numbers of four digits


def test_long_shot_numbers(spark, sf, tmp_path):
    """Shots beyond the thousandth of a video are told apart, and shown as the SQL shows them."""
    from lodestrand.plans import registry
    from tests.oracle import assert_same

    rng = np.random.default_rng(5)
    rows = [(i, [float(x) for x in rng.normal(size=64).astype(np.float32)], 3) for i in range(7000)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    spark.read.parquet(f"{sf}/orders.parquet").coalesce(1).write.parquet(f"{tmp_path}/orders.parquet")
    for name in ("config_sweep", "four_source_fusion"):
        assert assert_same(registry.QUERIES[name](spark, str(tmp_path)), registry.ORACLES[name], str(tmp_path)) > 0


# sessions of a table of many files


def test_sessions_of_unordered_files(spark, sf, tmp_path):
    """No event is late because the files of a part of the table are read one after the other."""
    from lodestrand.plans import registry
    from tests.oracle import assert_same

    spark.read.parquet(f"{sf}/events.parquet").repartition(5).write.option("compression", "none").parquet(f"{tmp_path}/events.parquet")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "32k")
    spark.conf.set("spark.sql.files.openCostInBytes", "32k")
    try:
        assert assert_same(registry.QUERIES["stream_sessions"](spark, str(tmp_path)), registry.ORACLES["stream_sessions"], str(tmp_path)) > 0
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before[0])
        spark.conf.set("spark.sql.files.openCostInBytes", before[1])


# rows and batches that don't multiply


def test_arrivals_in_few_batches(spark, tmp_path):
    """However many files a table has, it is read in a few batches, every row once."""
    from lodestrand.streaming import flows

    rows = spark.range(100).repartition(10)
    rows.write.parquet(f"{tmp_path}/in")
    q = flows.arrivals(spark, f"{tmp_path}/in", rows.schema, 3).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/log").trigger(availableNow=True).start()
    q.awaitTermination()
    assert len([p for p in q.recentProgress if p["numInputRows"]]) == 3 and sorted(r[0] for r in spark.read.schema(rows.schema).parquet(f"{tmp_path}/out").collect()) == list(range(100))


def test_histograms_are_arrays():
    import pandas as pd

    from lodestrand.functions import images

    got = images.histogram.func(pd.Series([bytes(range(63)), None]), pd.Series([7, 7]), pd.Series([3, 3]))
    assert isinstance(got[0], np.ndarray) and got[0].shape == (512,) and got[1] is None
