"""The kept text index against plain Python: positions, containment, n-grams; and what its queries read."""

from __future__ import annotations

import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lodestrand.operators import textsearch as X

WORDS = ["general", "public", "license", "licensed", "the", "that", "bathe", "of", "a", "x", "públic", "no", "snow", "lic"]
ODD = [None, "", "  ", "--", "a--b", "the that", "bathe thatch", "General PUBLIC License", "general-public license", "generalpublic license", "public public public", "İ 漢字 🙂 漢字", "license " * 500]


def texts(n=120, seed=2):
    rng = random.Random(seed)
    return ODD + [rng.choice(["", "-"]).join(rng.choice([w, w.upper(), w.title()]) + rng.choice([" ", " ", ", ", "-", "\n"]) for w in rng.choices(WORDS, k=rng.randint(0, 40))) for _ in range(n)]


def plain_tokens(text):
    low = (text or "").lower().translate(str.maketrans(X.ACCENTED, X.PLAIN)).replace("ß", "ss")
    return re.findall(r"[^\W_]+", low)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i * 3, t) for i, t in enumerate(texts())], "doc_id long, text string").repartition(3)


@pytest.fixture(scope="module")
def index(spark, docs):
    return X.build_index(docs, grams=True)


def asked(spark, phrases):
    return spark.createDataFrame(list(enumerate(phrases)), "query_id long, query string")


def test_postings(docs, index):
    got = {(r["doc_id"], r["term"]): (r["tf"], r["dl"], r["positions"]) for r in index.words.rows.collect()}
    want = {}
    for i, t in enumerate(texts()):
        found = plain_tokens(t)
        for w in set(found):
            at = [p for p, x in enumerate(found) if x == w]
            want[i * 3, w] = (len(at), sum(x not in X.STOP_WORDS for x in found), at)
    assert got == want
    assert index.documents == len(texts()) and abs(index.mean_length - sum(d for _, d, _ in {(k[0], v[1], 0) for k, v in want.items()}) / len(texts())) < 1e-9
    grams = {(r["doc_id"], r["term"]): r["tf"] for r in index.grams.rows.collect()}
    assert grams == {(i * 3, g): n for i, t in enumerate(texts()) for g, n in Counter((t or "").lower()[k : k + 3] for k in range(len((t or "").lower()) - 2)).items()}


def test_match_phrase(spark, index):
    phrases = ["general public license", "PUBLIC-license", "license of the general", "no that x", "public public", "license", "the that", "", "missing license", "x a x"]
    got = {(r["query_id"], r["doc_id"]): r["freq"] for r in X.match_phrase(index, asked(spark, phrases)).collect()}
    want = Counter()
    for q, phrase in enumerate(phrases):
        wanted = [(i, w) for i, w in enumerate(plain_tokens(phrase)) if w not in X.STOP_WORDS]
        for d, t in enumerate(texts()):
            words = plain_tokens(t)
            for s in range(-len(phrases), len(words)) if wanted else ():
                want[q, d * 3] += all(0 <= s + i < len(words) and words[s + i] == w for i, w in wanted)
    assert got == {k: n for k, n in want.items() if n}


CONTAINED = ["general public license", " License ", "licen", "l-pub", "the that", "ense gen", "the", "--", "-", "a--b", "  ", "漢字", "🙂", "public public", "x, x", "zzz", "no\nx", "bathe that"]


@pytest.mark.parametrize("named", [X.NAMED, 1])
def test_contained_phrases(spark, docs, index, monkeypatch, named):
    monkeypatch.setattr(X, "NAMED", named)
    got = {(r["query_id"], r["doc_id"]) for r in X.phrase_hits(docs, asked(spark, CONTAINED), index=index).collect()}
    assert got == {(q, d * 3) for q, p in enumerate(CONTAINED) for d, t in enumerate(texts()) if p.strip() and p.strip().lower() in (t or "").lower()}


def test_ngram_hits(spark, index):
    phrases = [" License ", "licen", "zzz", "the that", "no", "lic lic", "x a"]
    got = {(r["query_id"], r["doc_id"]) for r in X.ngram_hits(index, asked(spark, phrases)).collect()}
    runs = lambda s: {s[i : i + 3] for i in range(len(s) - 2)}
    assert got == {(q, d * 3) for q, p in enumerate(phrases) for d, t in enumerate(texts()) if runs(p.strip().lower()) and runs(p.strip().lower()) <= runs((t or "").lower())}


def test_relevance_with_and_without_ngrams(spark, docs, index):
    q = asked(spark, ["general public license", "licen", "  "])
    with_, without = ({(r["query_id"], r["doc_id"]): r["score"] for r in X.relevance(docs, q, index=i).collect()} for i in (index, X.TextIndex(index.words)))
    assert X.has_ngram_field(index) and not X.has_ngram_field(X.TextIndex(index.words))
    hits = {(r["query_id"], r["doc_id"]) for r in X.ngram_hits(index, q).collect()}
    boxed = {(r["query_id"], r["doc_id"]) for r in X.phrase_hits(docs, q, index=index).collect()}
    grams = {(r["query_id"], r["doc_id"]): r["score"] for r in X._scored(index.grams, X.ngram_terms(q), "doc_id").collect()}
    for k in with_.keys() | without.keys():
        base = without.get(k, 0) - (X.BOOSTS["wildcard"] if k in boxed else 0)
        assert abs(with_.get(k, 0) - base - (X.BOOSTS["ngram"] * grams[k] if k in hits else 0)) < 1e-6
    assert not any(q == 2 for q, _ in with_)


def leaves(df):
    """The scans of a plan, as text."""
    return [line for line in df._jdf.queryExecution().executedPlan().toString().splitlines() if "FileScan" in line or "Scan ExistingRDD" in line]


def test_phrases_read_their_terms_alone(spark, docs, index, tmp_path):
    kept = f"{tmp_path}/documents"
    docs.orderBy("doc_id").coalesce(1).write.option("parquet.block.size", 4096).parquet(kept)
    stored = spark.read.parquet(kept)
    scans = leaves(X.match_phrase(index, asked(spark, ["general public license"])))
    assert scans and not any("text:string" in s for s in scans)
    posts = [s for s in scans if "positions:array<int>" in s]
    assert posts and all(re.search(r"PartitionFilters: \[folder#\d+ (IN|=) ", s) and "In(term" in s for s in posts)
    near = X.phrase_hits(stored, asked(spark, ["general public license"]), index=index)
    assert near.count() > 0 and any("text:string" in s and "In(doc_id" in s for s in leaves(near))


def test_empty_corpus(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    index = X.build_index(none, grams=True)
    q = asked(spark, ["license"])
    assert X.match_phrase(index, q).count() == X.phrase_hits(none, q, index=index).count() == X.ngram_hits(index, q).count() == X.relevance(none, q, index=index).count() == 0
    assert X.match_phrase(index, q.where("false")).count() == X.phrase_hits(none, q.where(F.lit(False)), index=index).count() == 0


def test_a_task_hands_on_a_term_once(spark, docs, index, monkeypatch):
    tasks = spark.sparkContext.defaultParallelism
    for posts in (index.words, index.grams):
        terms = posts.vocabulary.count()
        assert terms <= posts.stored.count() <= tasks * terms < posts.rows.count()
    # Groups cut short: the same postings in more rows.
    monkeypatch.setattr(X, "GROUP_TERMS", 40)
    one = docs.coalesce(1).sortWithinPartitions("doc_id")
    monkeypatch.setattr(X, "_spread", lambda d, key, text: (one.repartition(16, "doc_id"), len(texts()), 0))
    cut = X.build_index(docs, grams=True)
    assert cut.words.stored.count() > index.words.stored.count()
    for a, b in ((cut.words, index.words), (cut.grams, index.grams)):
        assert sorted(map(repr, a.rows.collect())) == sorted(map(repr, b.rows.collect())) and a.mean_length == b.mean_length
        assert sorted(a.vocabulary.collect()) == sorted(b.vocabulary.collect())


def test_candidates_of_phrases_are_known_to_be_few(spark, docs, index):
    near = X.phrase_hits(docs, asked(spark, ["general public license"]), index=index)
    assert near.count() > 0 and not any("query_id" in s for s in leaves(near) if "ExistingRDD" in s)


def test_ngrams_need_no_words(spark, sf):
    from lodestrand.plans import registry
    from lodestrand.plans import queries_text  # noqa: I001

    queries_text._indexes.clear()
    assert registry.QUERIES["ngram_search"](spark, sf).count() > 0
    assert [k[-1] for k in queries_text._indexes] == ["build_grams"]
    both = queries_text.index_of(registry.Tables(spark, sf), grams=True)
    assert both.grams is queries_text.index_of(registry.Tables(spark, sf), words=False, grams=True).grams and both.words is not None


def test_postings_are_shuffled_as_batches_of_a_folder(spark, docs):
    rows = docs.select("doc_id", F.lit(1).alias("dl"), X.tokens(F.col("text"), stop=False).alias("terms"))
    plan = X._word_postings(rows, "doc_id", 8, 4)._jdf.queryExecution().executedPlan().toString()
    sent = [line for line in plan.splitlines() if "Exchange hashpartitioning(folder" in line]
    assert len(sent) == 1 and "xxhash64(data" in sent[0] and "keys" not in sent[0]
