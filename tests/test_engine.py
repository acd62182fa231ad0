"""The engine's operators on small literal inputs, with their boundary cases."""

from __future__ import annotations

import json
import random
import re
import uuid
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestrand.functions import images, seams, strings, vectors
from lodestrand.operators import evaluation, intervals, ranking, sequences, state, textsearch
from lodestrand.plans import pipeline, retrieve
from lodestrand.schemas import SCHEMAS
from lodestrand.sources import readers, sinks
from lodestrand.streaming import flows


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first()[0]


@pytest.mark.parametrize(("raw", "n", "want"), [("C", 8, "C"), ("G", 4, None), ("A or B? I pick B", 8, "A"), ("Alice is the mother", 8, None), ("Answer: D", 8, "D"), ("A", 0, "A"), ("H", 99, "H"), ("", 4, None), ("(b)", 2, "B")])
def test_parse_letter(spark, raw, n, want):
    assert value(spark, strings.parse_letter(F.lit(raw), F.lit(n))) == want


def test_parse_options(spark):
    text = "A. one B. two  C. three\nD. four E. five F. six G. seven H. eight"
    assert value(spark, strings.parse_options(F.lit(text))) == ["A. one", "B. two", "C. three", "D. four", "E. five", "F. six", "G. seven", "H. eight"]
    assert value(spark, strings.parse_options(F.lit("no labels"))) == [] and value(spark, strings.parse_options(F.lit("x A. a"))) == ["A. a"]


def test_times(spark):
    assert value(spark, strings.mmss(F.lit(6000.9))) == "[100:00]" and value(spark, strings.mmss(F.lit(None).cast("double"))) == "[00:00]"
    assert value(spark, strings.minutes_seconds(F.lit(65.5))) == "01:05.50" and value(spark, strings.srt_time(F.lit(3661.25))) == "01:01:01,250"
    assert value(spark, strings.parse_hms(F.lit("1:02:03.5"))) == 3723.5 and value(spark, strings.parse_hms(F.lit("2:30"))) == 150 and value(spark, strings.parse_hms(F.lit("x:1"))) is None


def test_ids(spark):
    ns = uuid.UUID("6f3a1e84-0d2b-4c7e-9f15-8b2d4a6c1e90")
    for raw, clean in (("x__SHOT_1", "x"), ("a/clip.gif", "clip"), ("talk.wav", "talk.wav"), ("b.MP4.json", "b"), ("b.flv", "b"), ("c.mp3", "c.mp3")):
        assert value(spark, strings.canonical_video_id(F.lit(raw))) == clean
    assert value(spark, strings.point_id(F.lit("001"), F.lit(3), F.lit(120))) == str(uuid.uuid5(ns, "001:3:120"))
    canon = strings.canonical_video_id(F.lit(" "), F.lit("UNKNOWN"), F.lit("a\\b/007__shot_3.jpg.json"))
    assert value(spark, canon) == "007"
    assert value(spark, strings.is_video_name(F.lit("L01_V001"))) and not value(spark, strings.is_video_name(F.lit("0012")))
    assert value(spark, strings.uuid_stem(F.lit(f"x/{str(ns).upper()}.jpg"))) == str(ns)
    assert value(spark, strings.frame_id(F.lit(None), F.lit("a__frame_12.jpg"), F.lit(None))) == 12


def test_replies(spark):
    pairs = strings.parse_pairs(F.lit('```json\n[{"text":"a","caption":"b"}]\n```'), 3)
    assert [p and p["text"] for p in value(spark, pairs)] == ["a", None, None]
    assert [p and p["text"] for p in value(spark, strings.parse_pairs(F.lit("broken"), 2))] == [None, None]


def shots(spark, p, fps=25.0):
    df = spark.createDataFrame([("v", i, float(x)) for i, x in enumerate(p)], "v string, i int, p double")
    return [(r["number"], r["start_frame"], r["end_frame"]) for r in sequences.shots_from_scores(df, ["v"], "i", "p", F.lit(fps)).orderBy("number").collect()]


def test_shots(spark):
    z = [0.0] * 100
    assert shots(spark, z) == [(1, 0, 99)]
    one = list(z)
    one[50] = 0.9
    assert shots(spark, one) == [(1, 0, 49), (2, 50, 99)]
    run = list(z)
    run[50:55] = [0.9] * 5
    assert shots(spark, run) == [(1, 0, 49), (2, 50, 99)]
    first = list(z)
    first[0], first[40] = 0.9, 0.5
    assert shots(spark, first) == [(1, 0, 99)]
    assert shots(spark, []) == []


def test_keyframe_positions(spark):
    of = lambda a, b: value(spark, sequences.keyframe_positions(F.lit(a), F.lit(b), F.lit(0).cast("long"), F.lit(int((b - a) * 25)).cast("long")))
    assert len(of(0.0, 0.5)) == 1 and len(of(0.0, 5.0)) == 3 and len(of(0.0, 60.0)) == 20 and len(of(0.0, 4000.0)) == 40


def segs(spark, words):
    df = spark.createDataFrame([("v", i, t, s, e) for i, (t, s, e) in enumerate(words)], "v string, ord long, text string, start_time double, end_time double")
    return [(r["text"], r["start"], r["end"]) for r in sequences.word_segments(df, ["v"]).orderBy("seg_no").collect()]


def test_word_segments(spark):
    assert segs(spark, []) == [] and segs(spark, [("a", 1.0, 1.2)]) == [("a", 1.0, 1.2)]
    assert segs(spark, [("a", 0.0, 0.5), ("b", 0.55, 0.9), ("c", 4.7, 5.0)]) == [("a b", 0.0, 0.9), ("c", 4.7, 5.0)]
    assert segs(spark, [("a", 0.0, 0.5), (" ", 0.6, 0.7), ("b", 1.0, None)]) == [("a b", 0.0, 1.0)]
    many = segs(spark, [("w", i * 0.5, i * 0.5 + 0.5) for i in range(60)])
    assert all(e - s <= 15 for _, s, e in many) and len(many) == 2
    assert len(segs(spark, [("a", 0.0, 0.5), ("b", 1.0, 1.5), ("c", 2.0, 2.5)])) == 1


def test_greedy_reject(spark):
    df = spark.createDataFrame([("s", i, h) for i, h in enumerate([0b0, 0b1111, 0b11111, 0b111111111, 0b0])], "s string, position int, h long")
    kept = sequences.greedy_reject(df, ["s"], "position", "h", 4).orderBy("position").collect()
    assert [r["position"] for r in kept] == [0, 2]


def test_temporal_windows(spark):
    rows = [(1, i + 1, "v", n, ts, 1.0 - i / 10, ["siglip"]) for i, (n, ts) in enumerate([(5, 50.0), (6, 55.0), (7, 57.9), (20, 200.0), (30, 300.0), (40, 400.0)])]
    df = spark.createDataFrame(rows, "query_id long, rank int, video string, shot_no int, ts double, score double, rrf_components array<string>")
    out = sequences.temporal_windows(df, ["query_id"], 3).orderBy("window").collect()
    assert [r["centre_shot"] for r in out] == [5, 20, 30] and out[0]["shot_numbers"] == [4, 5, 6, 7]
    edge = df.where("shot_no in (5, 20)").withColumn("ts", F.when(F.col("shot_no") == 20, 58.0).otherwise(F.col("ts")))
    assert sequences.temporal_windows(edge, ["query_id"], 3).count() == 2


def test_digest(spark):
    df = spark.createDataFrame([("v", i, f"[00:{i:02d}] line number {i}") for i in range(100)], "v string, i int, line string")
    text = sequences.digest(df, ["v"], ["i"], "line", 300).first()["digest"]
    assert len(text) <= 300 and text.startswith("[00:00]") and "line number 77" in text
    assert sequences.digest(df.where("i < 3"), ["v"], ["i"], "line", 300).first()["digest"].count("line") == 3


HITS = [("a", "s1", "p1", 5.0, 0.9), ("a", "s1", "p2", 6.0, 0.9), ("a", "s2", "p3", 9.0, 0.8), ("b", "s2", "p3", 9.0, 7.0), ("b", "s3", "p4", None, 3.0), ("b", None, "p9", 1.0, 9.0)]


@pytest.fixture(scope="module")
def hits(spark):
    return spark.createDataFrame([(1, s, "v", shot, p, ts, x) for s, shot, p, ts, x in HITS], "query_id long, source string, video_id string, shot_id string, file_path string, timestamp double, score double")


def test_rrf(spark, hits):
    best = ranking.collapse(hits, ["query_id", "source", "shot_id"], ["timestamp", "file_path"])
    assert best.count() == 4
    fused = {r["file_path"]: r for r in ranking.rrf(best, {"a": 1.0, "b": 0.5}).collect()}
    assert fused["p3"]["score"] == pytest.approx(1 / 62 + 0.5 / 61) and fused["p3"]["rrf_components"] == ["a", "b"]
    assert fused["p1"]["score"] == pytest.approx(1 / 61)
    s = {r["file_path"]: r["score"] for r in ranking.srrf(best, {"a": 1.0, "b": 0.5}).collect()}
    assert s["p1"] == pytest.approx(0.5 / 61 + 0.5) and s["p3"] == pytest.approx(0.5 / 62 + 0.5 * (0.5 / 61 + 0.5))


def test_retrieve(spark, hits):
    out = retrieve.search(hits, weights={"a": 1.0, "b": 0.5}).collect()
    assert [r["shot_id"] for r in sorted(out, key=lambda r: r["position"])] == ["s1", "s2", "s3"]
    assert [r["shot_id"] for r in sorted(out, key=lambda r: r["rank"])] == ["s2", "s1", "s3"]
    assert {r["shot_id"] for r in retrieve.search(hits, weights={"a": 1.0, "b": 0.0}).collect()} == {"s1", "s2"}
    assert retrieve.search(hits, weights={"a": 1.0}, only={"b"}).count() == 0
    assert ranking.effective_weights(None)["asr"] == 0.8 and ranking.effective_weights({"a": 0, "b": -1}) == {}


def test_text_hits(spark):
    kf = spark.createDataFrame([("v", "v_shot_001", "f1", 5.0), ("v", "v_shot_002", "f2", 50.0)], "video_id string, shot_id string, file_path string, timestamp double")
    rows = [(1, "asr", "v", None, None, None, 1.0, 4.0, 6.0), (1, "asr", "v", None, None, None, 2.0, 900.0, 910.0), (1, "asr", "v", None, None, None, 3.0, 0.0, 100.0), (1, "asr", "w", None, None, None, 4.0, 0.0, 9.0), (1, "ocr", "v", None, "f2", None, 5.0, None, None)]
    h = spark.createDataFrame(rows, "query_id long, source string, video_id string, shot_id string, file_path string, timestamp double, score double, start double, end double")
    got = sorted((r["score"], r["file_path"]) for r in retrieve.text_hits_to_frames(h, kf).collect())
    assert got == [(1.0, "f1"), (3.0, "f1"), (3.0, "f2"), (5.0, "f2")]


def test_windows_and_answer(spark):
    kf = spark.createDataFrame([("v", n, f"f{n}_{j}", n * 10.0 + j) for n in range(1, 12) for j in (0, 2, 4)], "video_id string, shot_number int, file_path string, timestamp double")
    shots_ = spark.createDataFrame([(1, 1, "v", "v_shot_005", 50.0, 0.5, ["siglip"]), (1, 2, "v", "v_shot_009", 90.0, 0.4, ["jina"])], "query_id long, rank int, video_id string, shot_id string, timestamp double, score double, rrf_components array<string>")
    w = retrieve.windows(shots_, kf).withColumn("speech", F.lit("said")).withColumn("screen", F.lit(""))
    rows = w.orderBy("window").collect()
    assert [r["frames"] for r in rows] == [["f4_0", "f5_2", "f6_4"], ["f8_0", "f9_2", "f10_4"]]
    q = spark.createDataFrame([(1, "v", "What?", ["A. x", "B. y"]), (2, "v", "No spans?", ["A. x"])], "query_id long, video_id string, question string, options array<string>")
    t = spark.createDataFrame([("v", "[00:00] hello")], "video_id string, digest string")
    got = {r["query_id"]: r for r in retrieve.answer(q, w, t).collect()}
    assert "Speech: said" in got[1]["prompt"] and got[1]["prompt"].index("Transcript") < got[1]["prompt"].index("Span 1") < got[1]["prompt"].index("Question") and "Span" not in got[2]["prompt"]
    assert all(r["pred"] in ("A", "B", None) and r["unparsed"] == (r["pred"] is None) for r in got.values())
    assert set(retrieve.CONFIGS) >= {"baseline-uniform", "full"} and len(retrieve.CONFIGS) == 6


def test_vector_topk(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(300, 8))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(999, None)], "k long, v array<double>").repartition(5)
    q = spark.createDataFrame([(7, x[7].tolist()), (8, x[8].tolist())], "query_id long, v array<double>")
    got = sorted((r["query_id"], r["rank"], r["k"]) for r in ranking.vector_topk(df, q, "k", "v", 5).collect())
    want = [(qi, r + 1, int(k)) for qi in (7, 8) for r, k in enumerate(np.argsort(-(x @ x[qi]), kind="stable")[:5])]
    assert got == want
    n = value(spark, vectors.l2_normalise(F.array(F.lit(3.0), F.lit(4.0))))
    assert n == pytest.approx([0.6, 0.8])


def judged(spark, rows):
    return spark.createDataFrame(rows, "video string, kind string, question_id string, gold string, pred string")


def test_group_scores(spark):
    rows = [("v", "relevance", f"q{i}", "A", "A" if i < 2 else "B") for i in range(4)] + [("w", "logic", f"q{i}", "A", "A" if i != 2 else None) for i in range(4)] + [("x", "logic", "q0", "A", "B"), ("x", "logic", "q1", "A", "A"), ("y", "odd", "q0", "A", "A")]
    got = {r["video"]: r["score"] for r in evaluation.group_scores(judged(spark, rows), ["video", "kind"], "kind", ["question_id"]).collect()}
    assert got == {"v": 0.25, "w": 0.5, "x": 0.0, "y": 0.0625}
    none = evaluation.accuracy(judged(spark, [])).first()
    assert (none["n"], none["accuracy"]) == (0, 0.0)


@pytest.mark.parametrize(("b", "c", "p"), [(26, 30, 0.689), (25, 31, 0.504), (24, 35, 0.193), (23, 32, 0.281), (0, 0, 1.0)])
def test_mcnemar(spark, b, c, p):
    rows = spark.createDataFrame([(False, True)] * b + [(True, False)] * c + [(True, True)], "a boolean, b boolean")
    got = evaluation.mcnemar(rows, F.col("a"), F.col("b")).first()
    assert (got["b"], got["c"]) == (b, c) and got["p_value"] == pytest.approx(p, abs=5e-4)


def test_intervals(spark):
    seg = spark.createDataFrame([("v", 1, 10.0, 12.0, "a"), ("v", 2, 14.0, 16.0, "b"), ("v", 3, 90.0, 92.0, "c"), ("v", 4, 18.5, 19.0, "d")], "v string, n int, start double, end double, text string")
    span = spark.createDataFrame([(1, "v", 10.0, 17.0), (2, "v", None, 91.0), (3, "v", None, None), (4, "w", 0.0, 9.0)], "k int, v string, lo double, hi double")
    got = {r["k"]: r["speech"] for r in intervals.overlap_text(span, seg, ["v"], ["k"], ["start", "n"], "text").collect()}
    assert got == {1: "a b d", 2: "c", 3: "", 4: ""}
    merged = intervals.merge_intervals(seg, ["v"], "start", "end", 2.0, ["n"])
    assert sorted((r["n"], r["island"]) for r in merged.collect()) == [(1, 1), (2, 1), (3, 3), (4, 2)]
    assert intervals.chunks(seg.where("n = 3"), "start", "end", 1.0, 0.5).orderBy("chunk").select("chunk_start", "chunk_end").collect() == [(90.0, 91.0), (90.5, 91.5), (91.0, 92.0)]


def test_manifest(spark, tmp_path):
    ev = spark.createDataFrame([("001", "shots", "failed", "boom", None, 1), ("001", "shots", "done", None, None, 2), ("002", "shots", "done", None, None, 1), ("003", "shots", "failed", "x", None, 3)], SCHEMAS["stage_events"])
    now = state.latest(ev, ["video_id", "stage"], ["seq"])
    got = {r["video_id"]: (r["status"], r["error"]) for r in now.collect()}
    assert got == {"001": ("done", None), "002": ("done", None), "003": ("failed", "x")}
    ids = spark.createDataFrame([("003",), ("002",), ("001",), ("004",)], "video_id string")
    assert sorted(r[0] for r in state.pending(ids, now, "video_id", "shots").collect()) == ["003", "004"]
    calls = []

    def stage(todo):
        calls.append(sorted(r[0] for r in todo.collect()))
        bad = F.col("video_id") == "003"
        return todo.select("video_id", F.when(bad, "failed").otherwise("done").alias("status"), F.when(bad, "boom").alias("error"))

    log = str(tmp_path / "log")
    assert pipeline.run(spark, log, ids, {"shots": stage}) == 1
    assert pipeline.run(spark, log, ids, {"shots": stage}) == 1
    assert calls == [["001", "002", "003", "004"], ["003"]]
    with pytest.raises(ValueError):
        pipeline.run(spark, log, ids, {"shots": stage}, only=["nope"])


def test_state_changes(spark):
    a = spark.createDataFrame([("1", 1, "old"), ("2", 1, "keep")], "id string, v int, x string")
    b = spark.createDataFrame([("1", 1, "new"), ("3", 1, "add")], "id string, v int, x string")
    assert {r["id"]: r["x"] for r in state.upsert(a, b, ["id"], "v").collect()} == {"1": "new", "2": "keep", "3": "add"}
    assert state.same_rows(a, a).count() == 0 and state.same_rows(a, b).count() == 4
    twice = spark.createDataFrame([("p", "1"), ("p", "2"), ("q", "3")], "path string, id string")
    with pytest.raises(Exception, match="several ids"):
        state.unique_lookup(twice, twice.select("path"), "path", "id").collect()
    assert state.unique_lookup(twice.where("path = 'q'"), twice.select("path"), "path", "id").count() == 1


def test_bm25(spark):
    docs = spark.createDataFrame([(1, "the red fox"), (2, "red red fox jumps"), (3, "blue whale"), (4, ""), (5, None)], "doc_id long, text string")
    q = spark.createDataFrame([(1, "Red fox"), (2, "  "), (3, "fix")], "query_id long, query string")
    got = {(r["query_id"], r["doc_id"]): r for r in textsearch.bm25(docs, q).collect()}
    assert set(got) == {(1, 1), (1, 2)} and got[(1, 2)]["matched"] == 2
    near = {(r["wanted"], r["term"]) for r in textsearch.near_terms(docs.select(F.explode(textsearch.tokens(F.col("text"))).alias("term")), q.select(F.explode(textsearch.tokens(F.col("query"))).alias("term"))).collect()}
    assert ("fix", "fox") in near and ("red", "red") in near
    rel = {(r["query_id"], r["doc_id"]) for r in textsearch.relevance(docs, q).collect()}
    assert {(1, 1), (1, 2), (3, 1)} <= rel and not any(k[0] == 2 for k in rel)


def boxes(image, images):
    """The luma of each of 32 x 32 boxes, pixel by pixel: box i holds the pixels from floor(i n / 32) up to the next one's first."""
    boxes.last = image
    luma = image @ [0.299, 0.587, 0.114]
    spans = [[range(i * n // 32, max((i + 1) * n // 32, i * n // 32 + 1)) for i in range(32)] for n in luma.shape]
    return [[[luma[y, x] for y in ys for x in xs] for xs in spans[1]] for ys in spans[0]]


def test_phash(spark):
    rng = np.random.default_rng(7)
    a = rng.integers(0, 256, (64, 64, 3), dtype=np.uint8)
    near = np.clip(a.astype(int) + rng.integers(-2, 3, a.shape), 0, 255).astype(np.uint8)
    other = rng.integers(0, 256, (64, 64, 3), dtype=np.uint8)
    rows = [(i, bytearray(x.tobytes()), 64, 64) for i, x in enumerate((a, near, other))] + [(3, None, 1, 1)]
    df = spark.createDataFrame(rows, "i int, d binary, w int, h int")
    got = {r["i"]: r["x"] for r in df.select("i", images.phash("d", "w", "h").alias("x")).collect()}
    bits = lambda x, y: bin(x ^ y).count("1")
    assert bits(got[0], got[1]) <= 4 < bits(got[0], got[2]) and got[3] is None and 0 <= got[0] < 2**63
    for h, w in ((100, 100), (90, 160), (20, 33), (64, 64)):
        grey = np.array([[np.mean(luma_box) for luma_box in row] for row in boxes(rng.integers(0, 256, (h, w, 3)), images)])
        assert np.allclose(grey, images.grey_square(boxes.last)), (h, w)
    flat = np.full((40, 30, 3), 9, np.uint8)
    assert images.perceptual_hash(flat) == images.perceptual_hash(flat) and images.colour_histogram(flat).max() == 1


def test_semantic_chunks(spark):
    rows = [("f", float(i * 10), float(i * 10 + 10), "w " * 40, [1.0, 0.0] if i < 6 else [0.0, 1.0]) for i in range(12)]
    df = spark.createDataFrame(rows, "f string, start double, end double, text string, embedding array<double>")
    out = sequences.semantic_chunks(df, "f").orderBy("chunk").collect()
    assert sum(r["segments"] for r in out) == 12 and [r["start"] for r in out][:2] == [0.0, 60.0]
    s = spark.createDataFrame([("v", i, float(i)) for i in range(130)], "v string, i int, x double")
    assert [r["p"] for r in sequences.sliding_scores(s, "v", "i", "x", lambda w: w).orderBy("i").collect()] == [float(i) for i in range(130)]


def test_transcripts_and_probes(spark):
    seg = spark.createDataFrame([("v", 61.5, 62.0, "b"), ("v", 0.0, 1.25, "a")], "v string, start double, end double, text string")
    assert sequences.transcript_text(seg, ["v"]).first()["transcript"] == "[00:00:00 - 00:00:01] a\n[00:01:01 - 00:01:02] b"
    assert sequences.transcript_text(seg, ["v"], srt=True).first()["transcript"].startswith("1\n00:00:00,000 --> 00:00:01,250\na\n\n2\n00:01:01,500")
    probes = spark.createDataFrame([(None, None, 2.0), (30.0, 7, 1.0)], "fps double, frames int, duration double")
    assert [(r["fps"], r["frames"]) for r in readers.with_probe_defaults(probes).collect()] == [(25.0, 50), (30.0, 7)]
    sizes = value(spark, F.array(strings.shrink(F.lit(1000), F.lit(500), 448), strings.grow(F.lit(100), F.lit(200))))
    assert [tuple(s) for s in sizes] == [(448, 224), (512, 1024)]


def test_seams(spark):
    df = spark.createDataFrame([("1", "Hello there"), ("2", "hello THERE"), ("3", "bad")], "video_id string, text string")
    v = df.select("video_id", seams.text_embedder()("text").alias("v")).collect()
    assert v[0]["v"] == v[1]["v"] and len(v[0]["v"]) == 64
    out = {r["video_id"]: r for r in seams.mapped(df, lambda r: [{"n": len(r["text"])}] if r["text"] != "bad" else 1 / 0, "n long").collect()}
    assert out["1"]["status"] == "done" and out["3"]["status"] == "failed" and "ZeroDivision" in out["3"]["error"]
    m = seams.Models(embedders={"siglip": None}, expand=lambda q: 1 / 0)
    assert m.available({"siglip": 1.0, "asr": 0.8}) == {"asr": 0.8} and m.expanded("q") == "q"
    tries = []
    assert seams.retried(lambda: tries.append(1) or (1 / 0 if len(tries) < 2 else "ok"), pauses=(0.0,))() == "ok"


def test_sources_and_sinks(spark, tmp_path):
    (tmp_path / "zips").mkdir()
    with zipfile.ZipFile(tmp_path / "zips" / "s.zip", "w") as z:
        z.writestr("subtitle/001.jsonl", json.dumps({"text": "hi", "start_time": 0.0, "end_time": 0.3}) + "\n\n" + json.dumps({"text": "you", "start_time": 0.4, "end_time": 0.6}) + "\n")
        z.writestr("subtitle/002.jsonl", b"\xff{}\n")
    words = readers.read_zipped_words(spark, str(tmp_path / "zips"), spark.createDataFrame([("001",), ("404",)], "video_id string"))
    assert [(r["ord"], r["text"]) for r in words.orderBy("ord").collect()] == [(0, "hi"), (1, "you")]
    for n in ("b.mp4", "a.mp4", "c.txt"):
        (tmp_path / n).write_bytes(b"x")
    assert [r[0] for r in readers.discover_videos(spark, str(tmp_path)).collect()] == ["a", "b"]
    (tmp_path / "art").mkdir()
    (tmp_path / "art" / "007.json").write_text(json.dumps([{"number": 1, "start_frame": 0, "end_frame": 9, "start": 0.0, "end": 0.4}]))
    (tmp_path / "art" / "008.json").write_text("{ broken")
    assert [(r["video_id"], r["number"]) for r in readers.read_artifacts(spark, str(tmp_path / "art"), "shots").collect()] == [("007", 1)]
    df = spark.createDataFrame([("1", 1), ("2", 2)], "video_id string, x int")
    sinks.write_artifact(df, str(tmp_path / "out"))
    sinks.write_artifact(df.where("video_id = '1'").withColumn("x", F.lit(9)), str(tmp_path / "out"))
    assert sorted(r["x"] for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [2, 9]
    with pytest.raises(ValueError):
        sinks.write_vectors(df, df.where("video_id = '1'"), str(tmp_path / "vec"))
    raw = spark.createDataFrame([("001", "001-1", "?", "A. x B. y", " a ", 1)], "video_id string, question_id string, question string, options string, answer string, level int")
    q = readers.load_questions(raw).first()
    assert q["answer"] == "A" and q["options"] == ["A. x", "B. y"] and q["level"] == "1"


def test_capped_stream(spark, tmp_path):
    """The stateful stream gives the segments of the batch operator."""
    rng = random.Random(4)
    rows = []
    for v in ("a", "b"):
        at = 0.0
        for i in range(120):
            at += rng.choice([0.4, 0.4, 0.5, 1.3])
            rows.append((v, i, f"w{i}", round(at, 3), round(at + 0.3, 3)))
        rows.append((v, 120, None, at, at))
    kind = "vid string, ord long, text string, start double, end double"
    df = spark.createDataFrame(rows, kind)
    for low in range(0, 121, 50):
        df.where((F.col("ord") >= low) & (F.col("ord") < low + 50)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = flows.capped_segments(flows.read_stream(spark, str(tmp_path / "in"), df.schema))
    q = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "log")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = sorted((r["vid"], r["seg_no"], r["text"], r["start"], r["end"]) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    batch = df.where("text is not null").select(F.col("vid").alias("v"), "ord", "text", F.col("start").alias("start_time"), F.col("end").alias("end_time"))
    want = sorted((r["v"], r["seg_no"], r["text"], r["start"], r["end"]) for r in sequences.word_segments(batch, ["v"]).collect())
    assert got == want and len(got) > 10


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_highlight_at_every_offset(spark):
    """A term is found and marked whole wherever it stands; a part of a longer word is none."""
    terms = ["license", "password", "token"]
    rows = [(i, "x" * (i - 1) + " PassWord " + "y" * 200) for i in range(1, 320)]
    rows += [(1000 + i, "x" * i + " tokens " + "y" * 200) for i in range(320)]
    rows += [(2000, "token " * 200), (2001, None), (2002, "token" + " z" * 300 + " password," + " z" * 300 + " License"), (2003, "z " * 60 + "tokens token")]
    df = spark.createDataFrame(rows, "i int, text string")
    got = {r["i"]: r["h"] for r in df.select("i", textsearch.highlight(F.col("text"), terms).alias("h")).collect()}
    plain = {i: [f.replace("<mark>", "").replace("</mark>", "") for f in h] for i, h in got.items()}
    text = dict(rows)
    assert all(len(f) <= 150 and f in text[i] for i, h in plain.items() for f in h)
    assert all(len(got[i]) == 1 and got[i][0].count("<mark>PassWord</mark>") == 1 for i in range(1, 320))
    assert not any(got[1000 + i] for i in range(320)) and got[2001] == []
    assert len(got[2000]) == 3 and "".join(plain[2000]) == ("token " * 200)[: len("".join(plain[2000]))] and all(h.count("<mark>") == 25 for h in got[2000])
    assert [re.findall("<mark>(.*?)</mark>", f) for f in got[2002]] == [["token"], ["password"], ["License"]]
    assert [re.findall("<mark>(.*?)</mark>", f) for f in got[2003]] == [["token"]]


def test_answers_read_whole_conversations(spark, sf, tmp_path):
    """Every conversation reaches the digest of a question, whole."""
    from lodestrand.plans import registry

    chars = []
    for n, text in enumerate(("a" * 10, "b" * 70)):
        (tmp_path / str(n)).mkdir()
        (tmp_path / str(n) / "embeddings.parquet").symlink_to(f"{sf}/embeddings.parquet")
        spark.createDataFrame([(0, 0, "user", "c"), (25, 0, "user", text)], "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/{n}/conversations.parquet")
        chars.append({r["query_id"]: r["prompt_chars"] for r in registry.QUERIES["answer_questions"](spark, f"{tmp_path}/{n}").collect()})
    assert {q: chars[1][q] - chars[0][q] for q in chars[0]} == {q: 60 * (q == 5) for q in range(20)}


def test_frames(spark):
    """A full scan of small frames; wanted ones in one pass that stops after the last."""
    from lodestrand.sources import frames

    videos = spark.createDataFrame([("a", "xx"), ("b", "xxx")], "video_id string, path string")
    small = {(r["video_id"], r["frame_index"]): r for r in frames.small_frames(videos, frames.stand_in(70)).collect()}
    assert len(small) == 140 and all((r["width"], r["height"], len(r["data"])) == (48, 27, 48 * 27 * 3) for r in small.values())
    image = next(frames.stand_in()("xx"))
    assert small[("a", 0)]["data"] == frames.resized(image, 48, 27).tobytes() and frames.resized(image, 64, 36).tobytes() == image.tobytes()

    def short(path):
        for i, f in enumerate(frames.stand_in()(path)):
            if i > 9:
                raise EOFError("decoded past the last wanted frame")
            yield f

    wanted = spark.createDataFrame([("a", 9), ("a", 2), ("a", 2), ("c", 1)], "video_id string, frame_index long")
    got = frames.wanted_frames(videos, wanted, short, max_side=16).collect()
    assert sorted((r["video_id"], r["frame_index"], r["width"], r["height"]) for r in got) == [("a", 2, 16, 9), ("a", 9, 16, 9)]


def test_cached_search(spark):
    """Kept answers end with their time and are told apart by the whole vector, the limit and the filter."""
    now = [0.0]
    points = spark.createDataFrame([(i, [float(i), 1.0], "v" if i % 2 else "w") for i in range(6)], "id long, e array<double>, name string")
    c = ranking.CachedSearch(points, "id", "e", 300.0, lambda: now[0])
    assert [k for k, _ in c.search([1.0, 0.0], 2)] == [5, 4] and [k for k, _ in c.search([1.0, 0.0], 2, where="name = 'w'")] == [4, 2]
    assert [k for k, _ in c.search([-1.0, 9.0], 1)] == [0] and len(c.kept) == 3
    c.points = points.where("id < 3")
    assert [k for k, _ in c.search([1.0, 0.0], 2)] == [5, 4]
    now[0] = 301.0
    assert [k for k, _ in c.search([1.0, 0.0], 2)] == [2, 1] and len(c.kept) == 1
