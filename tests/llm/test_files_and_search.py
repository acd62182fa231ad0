"""Token files, fill-in-middle and hard negatives against plain Python, and on nulls, ties, repeats and clashing names."""

from __future__ import annotations

import functools
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodestrand.llm import fim, negatives, queries, token_files
from tests.llm.test_operators import SCHEMA, docs_of, edge_rows, random_docs

public_tokenizers = pytest.importorskip("public_tokenizers")
WORD_BPE = str(public_tokenizers.path("word_bpe_49k.json"))
BYTE_BPE = str(public_tokenizers.path("byte_bpe_50k.json"))
ODD = ["", None, " \n\t ", "don't İstanbul ΣΑΣ ΟΔΟΣ", "a\x1cb c d é ́x", "<|startoftext|> x<|endoftext|>y < |endoftext|>", "日本語 の テスト🙂🙂 ‍", "word " * 3000, "z" * 50_000, "a\r\nb\x0bc\x0cd"]


@functools.cache
def tokenizer(path):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@functools.cache
def encoder():
    with open(WORD_BPE) as f:
        return token_files.Encoder(f.read(), 2, True)


@pytest.fixture
def parts_stay(spark):
    """Small parts aren't put together."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def plain_ids(texts, path=WORD_BPE, end=2):
    t = tokenizer(path)
    return [t.encode(x or "", add_special_tokens=False).ids + [end] for x in texts]


# token files


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.sampled_from(" \n\t\r\x0b\x0c\x1c\x85  'Ss.tΣİ<|>9é́"), st.characters(exclude_categories=["Cs"])), max_size=30), max_size=5))
def test_runs_are_encoded_as_in_their_text(texts):
    ids, begin = encoder().encode(pa.array(texts, pa.string()))
    assert [ids[a:b].tolist() for a, b in zip(begin[:-1], begin[1:], strict=True)] == plain_ids(texts)


@pytest.mark.parametrize("path, runs", [(WORD_BPE, True), (WORD_BPE, False), (BYTE_BPE, False)])
def test_token_files(spark, tmp_path, parts_stay, path, runs):
    texts = ODD + [t for _, t, _ in random_docs(3, 40)]
    docs = spark.createDataFrame([(i * 7 - 20, t, "extra") for i, t in enumerate(texts)], "doc_id long, text string, ids string").repartition(5, F.rand(1))
    token_files.write_tokens(docs, f"file://{tmp_path}/t", path, 2, runs)
    want, start = {}, 0
    for i, ids in enumerate(plain_ids(texts, path)):
        want[i * 7 - 20] = (start, len(ids), ids)
        start += len(ids)
    got = {r["doc_id"]: (r["start"], r["n_tokens"], r["ids"]) for r in token_files.read_tokens(spark, f"file://{tmp_path}/t").collect()}
    assert got == want
    crc = {r["doc_id"]: r["ids_crc32"] for r in token_files.token_digests(spark, f"file://{tmp_path}/t").collect()}
    assert crc == {i: zlib.crc32(np.array(ids, "<u4").tobytes()) for i, (_, _, ids) in want.items()}
    few = token_files.lookup(spark, f"file://{tmp_path}/t", [-20, 1, 8, 9999])
    assert {r["doc_id"]: r["start"] for r in few.collect()} == {-20: 0, 1: want[1][0], 8: want[8][0]}
    # The files' order is that of the ids.
    rows = token_files.token_rows(spark, f"file://{tmp_path}/t").select("part", "at", "doc_id", F.input_file_name().alias("f")).collect()
    assert [r["doc_id"] for r in sorted(rows, key=lambda r: (r["f"], r["at"]))] == sorted(want)
    assert len({r["f"] for r in rows}) == len({r["part"] for r in rows}) > 1


def test_token_files_have_indexes(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    docs = spark.range(0, 20_000, 2).select(F.col("id").alias("doc_id"), F.lit("some words").alias("text"))
    token_files.write_tokens(docs.coalesce(1), path, WORD_BPE)
    orc = spark._jvm.org.apache.orc
    conf = spark._jsc.hadoopConfiguration()
    files = sorted(token_files.token_rows(spark, path).inputFiles())
    for f in files:
        reader = orc.OrcFile.createReader(spark._jvm.org.apache.hadoop.fs.Path(f), orc.OrcFile.readerOptions(conf))
        assert reader.getRowIndexStride() == token_files.STRIDE
        kinds = {s.getKind().toString() for stripe in reader.getStripes() for s in reader.rows().readStripeFooter(stripe).getStreamsList()}
        assert {"ROW_INDEX", "BLOOM_FILTER_UTF8"} <= kinds
        assert {c.getKind().toString() for c in reader.rows().readStripeFooter(reader.getStripes()[0]).getColumnsList()} <= {"DIRECT", "DIRECT_V2"}

    def read(*ids):
        found = token_files.token_rows(spark, path).where(F.col("doc_id").isin(*ids))
        rows = found.collect()
        plan = found._jdf.queryExecution().executedPlan()
        assert "PushedFilters: [" in plan.treeString() and "In(doc_id" in plan.treeString() or "EqualTo(doc_id" in plan.treeString()
        leaves = plan.collectLeaves()
        return len(rows), leaves.apply(0).metrics().apply("numOutputRows").value()

    # One stride of each file that may hold the id; an odd id is in every file's range of numbers, and in no Bloom filter.
    assert read(5000) == (1, token_files.STRIDE)
    absent = [read(i)[1] for i in range(1001, 1021, 2)]
    assert sum(x == 0 for x in absent) >= 8


def test_token_files_edges(spark, tmp_path):
    docs = docs_of(spark, [(i, t if t is None or len(t) < 1000 else t[:400_000], s) for i, t, s in edge_rows()])
    token_files.write_tokens(docs, f"file://{tmp_path}/t", WORD_BPE)
    rows = token_files.read_tokens(spark, f"file://{tmp_path}/t").collect()
    assert len(rows) == len(edge_rows()) and [r["doc_id"] for r in sorted(rows, key=lambda r: r["start"])][:2] == [None, None]
    ends = sorted((r["start"], r["start"] + r["n_tokens"]) for r in rows)
    assert ends[0][0] == 0 and all(a[1] == b[0] for a, b in zip(ends, ends[1:], strict=False))
    token_files.write_tokens(docs_of(spark, []), f"file://{tmp_path}/e", WORD_BPE)
    assert token_files.read_tokens(spark, f"file://{tmp_path}/e").count() == 0 and token_files.lookup(spark, f"file://{tmp_path}/e", [1]).count() == 0


def test_token_files_query(spark, sf):
    rows = {r["doc_id"]: r for r in queries.op11_token_files(spark, sf).collect()}
    docs = sorted((r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect())
    start = 0
    for (i, _), ids in zip(docs, plain_ids([t for _, t in docs]), strict=True):
        r = rows[i]
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert len(rows) == len(docs)


# fill-in-middle


def plain_fim(doc_id, text, seed=7, rate=100, spm_rate=50):
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    n = len(units)
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    if h[3] % 100 < spm_rate:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


LINES = st.lists(st.sampled_from(["\n", "\n\n", "a", "é", "🙂", "<P", "S>", "<S>", "<M>", "<", ">", "P", "\r", "longer line of words", " "]), max_size=12).map("".join)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.integers(-(2**40), 2**40), st.one_of(st.none(), LINES)), max_size=8), st.sampled_from([0, 37, 100]), st.sampled_from([0, 50, 100]))
def test_fim_kernel(rows, rate, spm_rate):
    texts = pa.array([t for _, t in rows], pa.string()).fill_null("")
    digests = [hashlib.sha256(f"7:{i}".encode()).hexdigest() for i, _ in rows]
    draws = np.array([[int(d[8 * k : 8 * k + 8], 16) for k in range(4)] for d in digests], np.int64).reshape(-1, 4)
    out = fim.transform(texts, draws, rate, spm_rate)
    assert list(zip(*[out[c].to_pylist() for c in fim.ADDED], strict=True)) == [plain_fim(i, t, 7, rate, spm_rate) for i, t in rows]
    assert fim.rebuild(out["fim_text"], np.array(out["form"].to_pylist(), object)).to_pylist() == texts.to_pylist()
    # A row's result is that of the row alone.
    for k in range(len(rows)):
        one = fim.transform(texts.slice(k, 1), draws[k : k + 1], rate, spm_rate)
        assert all(one[c].to_pylist() == out[c].slice(k, 1).to_pylist() for c in fim.ADDED)


def test_fim_operator(spark):
    rows = edge_rows() + [(20, "a <P> b\nc", "x"), (21, "\n" * 500, "x"), (22, "é\n" * 3000 + "end", "x"), (23, "one", "x")]
    docs = docs_of(spark, rows).withColumn("form", F.lit("clash")).withColumn("N_LINES", F.lit("clash"))
    out = fim.restore(fim.fim(docs)).collect()
    key = lambda x: repr(x)
    assert sorted([(r["doc_id"], *[r[c] for c in fim.ADDED]) for r in out], key=key) == sorted([(i, *plain_fim(i, t)) for i, t, _ in rows], key=key)
    assert all(r["restored_text"] == (r["text"] or "") and r["d"] == "d" and r["row"] == "r" for r in out)
    assert fim.restore(fim.fim(docs_of(spark, []))).count() == 0
    forms = {r["form"] for r in out}
    assert forms == {"plain", "psm", "spm"}


def test_fim_query_text_by_text(spark, sf):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in queries.op12_fim(spark, sf).collect():
        n, form, p, m, text = plain_fim(r["doc_id"], texts[r["doc_id"]])
        assert (r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output_sha256"], r["restored_sha256"]) == (n, form, p, m, hashlib.sha256(text.encode()).hexdigest(), hashlib.sha256((texts[r["doc_id"]] or "").encode()).hexdigest())


# hard negatives


def plain_negatives(rows, is_anchor, positives=5, negs=10, window=(30, 90), scale=256):
    """Every pair scored with whole numbers of any size."""
    use = []
    for i, lab, vec in rows:
        if i is None or lab is None or vec is None or any(x is None or not math.isfinite(x) for x in vec):
            continue
        use.append((i, lab, [min(max(math.floor(x * scale), -(2**62)), 2**62) for x in vec]))
    dot = lambda a, b: sum(x * y for x, y in zip(a, b, strict=False))
    anchors = {}
    width = max((len(v) for _, _, v in use), default=0)
    for i, lab, q in use:
        full = q + [0] * (width - len(q))
        if is_anchor(i):
            anchors[i] = min(anchors.get(i, (lab, full)), (lab, full), key=lambda x: (x[0], b"".join(int(v).to_bytes(8, "little", signed=True) for v in x[1])))
    out = []
    for a, (lab, q) in anchors.items():
        scored = sorted((-dot(q, v), i, x) for i, x, v in use if i != a)
        for s, p, _ in [x for x in scored if x[2] == lab][:positives]:
            inside = [(n, -t) for t, n, x in scored if x != lab and window[0] * -s <= 100 * -t <= window[1] * -s][:negs]
            out += [(a, p, k + 1, n, -s, t) for k, (n, t) in enumerate(inside)]
    return sorted(out)


def vectors_of(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")


def test_negatives_against_brute_force(spark):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(6, 24))
    rows = []
    for i in range(700):
        v = centres[i % 6] * 0.5 + rng.normal(size=24) * 0.6
        v = v / np.linalg.norm(v)
        rows.append((i, int(rng.integers(0, 4)), [float(x) for x in v]))
    clump = rows[100][2]
    # A third of all rows have one vector; others are missing something.
    rows = [(i, lab, clump if i % 3 == 0 and i > 90 else v) for i, lab, v in rows]
    rows += [(700, None, clump), (None, 1, clump), (702, 1, None), (703, 1, clump[:-1] + [None]), (704, 2, clump[:-1] + [float("nan")]), (705, 2, clump[:-1] + [float("inf")]), (707, 1, []), (708, 3, clump[:7]), (709, 9, [3.0e5] + clump[1:]), (720, 2, clump)]
    want = plain_negatives(rows, lambda i: i % 20 == 0)
    for strip, block in ((1 << 17, 1 << 12), (100, 7)):
        out = negatives.mine(vectors_of(spark, rows).repartition(5), F.col("vec_id") % 20 == 0, strip=strip, block=block)
        assert sorted(tuple(r) for r in out.collect()) == want
    assert len(want) > 500


def test_negatives_small_cases(spark):
    two = [(0, 1, [1.0, 0.0]), (1, 1, [0.9, 0.1]), (2, 2, [0.5, 0.0]), (3, 2, [0.5, 0.9]), (4, 2, [2.0, 0.0]), (5, 2, [-1.0, 0.0]), (6, 1, [-1.0, 0.0])]
    got = negatives.mine(vectors_of(spark, two), F.col("vec_id") == 0, negatives=1)
    assert sorted(tuple(r) for r in got.collect()) == plain_negatives(two, lambda i: i == 0, negs=1)
    # Rows that repeat an id: rows of their own, none of them a partner of an anchor with that id.
    again = two + [(2, 2, [0.5, 0.0]), (2, 3, [0.25, 0.5]), (0, 2, [0.5, 0.5]), (1, 1, [0.9, 0.1])]
    got = negatives.mine(vectors_of(spark, again), F.col("vec_id") == 0)
    assert sorted(tuple(r) for r in got.collect()) == plain_negatives(again, lambda i: i == 0)
    for rows in ([], [(0, None, [1.0])], [(0, 1, [])], [(0, 1, [1.0])], [(0, 1, [1.0]), (1, 1, [1.0])], [(0, 1, []), (1, 1, []), (2, 2, [])]):
        got = negatives.mine(vectors_of(spark, rows), F.col("vec_id") == 0)
        assert sorted(tuple(r) for r in got.collect()) == plain_negatives(rows, lambda i: i == 0)


@given(st.lists(st.one_of(st.integers(-1100, 1100), st.integers(-(2**62), 2**62)), min_size=1, max_size=50))
def test_classes_hold_their_numbers(values):
    v = np.array(sorted(values), np.int64)
    c = negatives._classes(v)
    low, high = negatives._bounds(c)
    assert (low <= v).all() and (v <= high).all() and (np.diff(c) >= 0).all()
    distinct = np.unique(c)
    low, high = negatives._bounds(distinct)
    assert (high[:-1] < low[1:]).all()


@settings(max_examples=50, deadline=None)
@given(st.integers(0, 2**32), st.sampled_from([3, 40, 400]))
def test_bounds_hold_all_scores_and_prune(seed, spread):
    rng = np.random.default_rng(seed)
    q = np.rint(rng.normal(size=(900, 32)) * spread).astype(np.int64)
    counts = [(d, int(c), int(n)) for d in range(32) for c, n in zip(*np.unique(negatives._classes(q[:, d]), return_counts=True), strict=True)] + [(-1, 32, len(q))]
    low, high = negatives.cells(counts, 32)
    codes = np.column_stack([np.searchsorted(high[d], q[:, d]) for d in range(32)]).astype(np.uint8)
    block = negatives.Block(q[:20], low, high)
    lo, hi = block.bounds(codes, np.arange(20))
    score = q @ q[:20].T
    assert (lo <= score).all() and (score <= hi).all()
    ids = np.arange(900)
    found = negatives.best_of_label(block, ids[:20], np.zeros(20, np.int64), (ids, np.zeros(900, np.int64), codes, q), 5)
    assert len(found[0]) == 100 and block.scored < block.pairs / 4
