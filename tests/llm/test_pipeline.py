"""The pipeline's stages, each against SQL or brute force on its own input, and the whole."""

from __future__ import annotations

from pyspark.sql import functions as F

import corpus_pipeline as cp
from lodestrand.llm import queries
from tests.llm.test_operators import brute_components
from tests.oracle import duck, tidy


def test_stages(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, seen = docs.columns, {}
    for name, stage in cp.STAGES:
        out = stage(spark, docs, sf)
        out.write.parquet(f"{tmp_path}/{name}")
        nxt = spark.read.parquet(f"{tmp_path}/{name}")
        seen[name] = (docs, nxt)
        docs = nxt
        assert nxt.columns[: len(columns)] == columns and (nxt.columns == columns or name == cp.STAGES[-1][0])
    before, after = seen["language_id"]
    assert after.count() == before.count()  # every document here has letters in a known language
    before, after = seen["line_dedup"]
    sql = f"WITH {queries.LINES_CTE.format(docs='docs')} SELECT doc_id, coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE stays), '') AS text FROM judged GROUP BY doc_id"
    _, want = duck(sql, docs=before.toArrow())
    assert tidy([(r["doc_id"], r["text"]) for r in after.collect()], ["doc_id", "text"], ["doc_id", "text"]) == tidy(want, ["doc_id", "text"], ["doc_id", "text"])
    assert after.where("n_chars <> length(text)").count() == 0
    before, after = seen["near_dedup"]
    comp = brute_components([(r["doc_id"], r["text"]) for r in before.collect()], 5, 80)
    assert sorted(r["doc_id"] for r in after.collect()) == sorted(i for i, c in comp.items() if i == c)
    before, after = seen["decontaminate"]
    bench = spark.read.parquet(f"{sf}/benchmark.parquet")
    _, rows = duck(queries.OP4_SQL, documents=before.toArrow(), benchmark=bench.toArrow())
    assert sorted(r["doc_id"] for r in after.collect()) == sorted(r[0] for r in rows if not r[1])
    before, after = seen["mix_sources"]
    names, rows = duck(queries.OP7_SQL, documents=before.toArrow())
    got = [tuple(r) for r in after.select(*names).collect()]
    assert tidy(got, names, names) == tidy(rows, names, names)
    final = cp.run(spark, sf)
    assert tidy([tuple(r) for r in final.select(*names).collect()], names, names) == tidy(rows, names, names)


def test_registered():
    import __spark_entry__ as entry

    assert {"pipeline", *queries.QUERIES} <= set(entry.queries()) and [n for n, _ in cp.STAGES] and 4 <= len(cp.STAGES) <= 5


def test_rejects(spark, sf):
    rows = [(1, "12345 678 --- 99", "en", "a", 16), (2, None, "en", "a", 0)]
    docs = spark.read.parquet(f"{sf}/documents.parquet").unionByName(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"))
    kept = cp.identify_language(spark, docs.where("doc_id > 100 or text is null or n_chars = 16"), sf)
    assert kept.where("doc_id in (1, 2)").count() == 0 and kept.count() > 50


CLASH = "score double, rejected boolean, n_lines int, n_dropped int, items string, secrets int, d string, f string, row string, id int"


def edge_documents(spark, sf, more):
    """Documents that language ID learns from, some with the given rows' nulls, repeats and clashing columns."""
    plain = spark.read.parquet(f"{sf}/documents.parquet").where("doc_id between 100 and 160")
    odd = spark.createDataFrame(more, plain.schema)
    names = [c.split()[0] for c in CLASH.split(", ")]
    values = [F.lit(str(i)).cast(c.split()[1]).alias(c.split()[0]) for i, c in enumerate(CLASH.split(", "))]
    return plain.unionByName(odd).select("*", *values), names


def test_edges(spark, sf, tmp_path):
    body = spark.read.parquet(f"{sf}/documents.parquet").where("doc_id = 130").first()["text"]
    long_text = (body + " ") * 60
    more = [(None, body + " one", "en", "a", 1), (None, None, None, None, None), (7, "", "en", "a", 0), (8, long_text, "en", None, 1), (9, long_text, "en", None, 1), (8, long_text, "en", None, 1)]
    docs, names = edge_documents(spark, sf, more)
    columns, before = docs.columns, docs.select(*names).first()
    for name, stage in cp.STAGES:
        out = stage(spark, docs, sf)
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        assert docs.columns[: len(columns)] == columns
        assert docs.select(*names).distinct().collect() == [before]
        if name == "language_id":
            assert docs.where("text is null or text = ''").count() == 0 and docs.where("doc_id in (8, 9)").count() == 3
        if name == "near_dedup":
            assert docs.where(F.length("text") > 10 * len(body)).count() <= 1
    assert docs.count() > 20 and docs.where("mix_slot is null").count() == 0


def test_empty(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(0)
    for name, stage in cp.STAGES:
        docs = stage(spark, docs, sf)
        assert docs.count() == 0, name


def test_near_dedup_repeats(spark, sf):
    """Copies under null and repeated ids: one row of the group stays."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").where("length(text) > 600").limit(1)
    text = docs.first()["text"]
    rows = [(i, f"{text} tail{n}", "en", "a", 1) for n, i in enumerate([None, None, 3, 3, 3, 5])] + [(3, f"{text} tail4", "en", "a", 1)] * 2
    out = cp.drop_near_duplicates(spark, spark.createDataFrame(rows, docs.schema), sf)
    assert out.count() == 1 and out.first()["doc_id"] is None
