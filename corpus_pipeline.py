"""The corpus pipeline: language ID, line dedup, near-duplicate removal, decontamination, mixing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes each stage's rows as Parquet in
the cluster's shared folder and reads them again as the next stage's documents.  All stages but the last return
the columns of documents; the last adds each document's place in the mix.

Defined cases: a document whose text is null or has no letter is rejected by language ID, as is every document when
none has a language to learn from; an empty table passes all stages and stays empty.  A null doc_id counts as the
smallest in line dedup and near dedup.  Rows that repeat a doc_id are one document in line dedup, are judged each by
their text in language ID, near dedup (where one row of each group stays) and decontamination, and have adjacent
places in the mix.  Other columns, whatever their names, keep their values through all stages; the last one replaces
columns named like the four that it adds.  Texts are read whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrand.llm import decontaminate, langid, lines, mixing, neardup
from lodestrand.llm.scratch import table
from lodestrand.shipping import ship


def _packed(docs: DataFrame) -> DataFrame:
    """doc_id and text beside all columns but text in a struct, so that no added column can replace one of them."""
    return docs.select("doc_id", "text", F.struct(*[docs[f"`{c}`"] for c in docs.columns if c != "text"]).alias("_doc"))


def _unpacked(out: DataFrame, docs: DataFrame, **new: Column) -> DataFrame:
    """The columns of ``docs`` again, some of them with new values."""
    fields = {f.name: new.get(f.name, F.col("text") if f.name == "text" else F.col(f"_doc.`{f.name}`")).cast(f.dataType) for f in docs.schema.fields}
    return out.select(*[c.alias(name) for name, c in fields.items()])


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learns from the labelled documents and drops those that it rejects."""
    ship(spark)
    model = langid.fit(docs, F.lit(True))
    return _unpacked(langid.identify(_packed(docs), model).where("not rejected"), docs)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps a repeated line in the first document that has it; n_chars follows the text."""
    ship(spark)
    return _unpacked(lines.dedup_lines(_packed(docs)), docs, n_chars=F.length("text"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group: five-word shingles, similarity of 0.8 or more."""
    return neardup.dedup_near(docs, k=5, percent=80)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents in which a benchmark item is found."""
    return decontaminate.decontaminate(_packed(docs), ship(spark).read.parquet(f"{sf_dir}/benchmark.parquet")).transform(_unpacked, docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Gives every document its place in a sequence that follows the sources' target weights."""
    return mixing.mix(docs)


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", drop_repeated_lines),
    ("near_dedup", drop_near_duplicates),
    ("decontaminate", drop_contaminated),
    ("mix_sources", mix_sources),
]

#: Language ID has no SQL form; the other stages are tested against SQL from its output on.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole of documents."""
    docs = ship(spark).read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = table(docs, name)
    return docs
