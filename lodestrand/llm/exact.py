"""Exact dedup by deterministic block naming, with DataFrame operations only.

Every text is cut into blocks of a fixed number of code points.  The distinct blocks are sorted and numbered; then
adjacent pairs of numbers are sorted and numbered in turn, and so on until one number is left for each document.  A
name stands for one content: names are given by comparing texts (or pairs of names), never by a hash value.  So two
documents have the same last name, after equally many rounds, exactly if their texts are equal.

The order in which blocks are numbered is (group, content), with a block's group a hash of it: all groups are sorted
side by side, and a name is the group's number and the rank in it, which depend on the contents alone, not on how
rows are dealt.  Names come from distinct values only (aggregated before they are shuffled), so copies of one block,
however many, never meet in one task.

Blocks find their names by place and SHA-256, so that texts are shuffled for the sort only.  Whether two different
blocks share a digest is known once they are named, and such blocks find their names by their text.

Defined cases: a null text equals an empty one, which is one empty block; a null doc_id counts as the smallest; rows
that repeat doc_id and text are copies of each other, which stay or go together; other columns are carried along by
``dedup_exact`` and replaced where named like an added one; texts of any length are cut whole; an empty table gives
no rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestrand.llm.scratch import NO_ID, table, without

BLOCK = 4096
#: Groups that are sorted side by side, and the room for ranks within one.
GROUPS, RANKS = 1 << 16, 1 << 40
ADDED = ("keep_id", "group_size", "kept", "text_sha256")


def _text() -> Column:
    return F.coalesce(F.col("text"), F.lit(""))


def _id() -> Column:
    return F.coalesce(F.col("doc_id"), F.lit(NO_ID)).cast("long")


def _digest(value: Column) -> Column:
    return F.unhex(F.sha2(value, 256))


def _names(values: DataFrame, *content: str) -> DataFrame:
    """Distinct rows, each with a name: the hash group of ``content`` and the rank in the group's sorted order."""
    groups = values.distinct().withColumn("g", F.pmod(F.xxhash64(*content), F.lit(GROUPS)))
    rank = F.row_number().over(Window.partitionBy("g").orderBy(*content))
    return groups.withColumn("name", F.col("g") * F.lit(RANKS) + rank).drop("g")


def blocks(docs: DataFrame, block: int) -> DataFrame:
    """(d, s, need, i, h, b): block i of each text with its digest; s is the text's SHA-256, need the rounds of pairs to one name."""
    rows = docs.select(_id().alias("d"), _text().alias("t"))
    many = F.greatest(F.ceil(F.length("t") / F.lit(block)), F.lit(1)).cast("int")
    # Halvings until one name is left: the bits of (blocks - 1).
    need = F.when(many <= 1, 0).otherwise(F.length(F.bin(many.cast("long") - 1)))
    cut = F.when(many <= 1, F.array("t")).otherwise(F.regexp_extract_all(F.col("t"), F.lit(f"(?s).{{1,{block}}}"), F.lit(0)))
    parts = rows.select("d", _digest(F.col("t")).alias("s"), need.alias("need"), F.posexplode(cut).alias("i", "b"))
    return parts.select("d", "s", "need", "i", F.when(F.col("need") == 0, F.col("s")).otherwise(_digest(F.col("b"))).alias("h"), "b")


def identities(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """(d, s, copies, need, name): each distinct document with its number of rows; need and name are its identity.

    d is the doc_id and s the text's SHA-256, which only tells apart texts under one doc_id.
    """
    parts = blocks(docs, block)
    places = table(parts.groupBy("d", "s", "need", "i", "h").agg(F.count("*").alias("copies")), "places")
    named = _names(parts.select("h", "b"), "b")
    names = table(named.select("h", "name"), "block_names")
    twins = table(names.groupBy("h").agg(F.count("*").alias("k")).where("k > 1").select("h"), "twins")
    if twins.isEmpty():
        level = places.join(names, "h")
    else:
        by_text = parts.join(twins, "h").distinct().join(named, ["h", "b"]).select("d", "s", "need", "i", "name")
        copies = places.select("d", "s", "need", "i", "copies")
        level = places.join(names.join(twins, "h", "left_anti"), "h").drop("h").unionByName(by_text.join(copies, ["d", "s", "need", "i"]))
    level = table(level.select("d", "s", "copies", "need", "i", "name"), "level")
    done = [level.where("need = 0").drop("i")]
    for r in range(1, (level.agg(F.max("need")).first()[0] or 0) + 1):
        half = F.expr("i div 2").cast("int").alias("i")
        sides = [F.max(F.expr("if(i % 2 = 0, name, null)")).alias("a"), F.coalesce(F.max(F.expr("if(i % 2 = 1, name, null)")), F.lit(-1)).alias("z")]
        pairs = table(level.where(F.col("need") >= r).groupBy("d", "s", "copies", "need", half).agg(*sides), "pairs")
        # Written, so that the join has exchanges on both sides and a frequent pair's rows can be split.
        names = table(_names(pairs.select("a", "z"), "a", "z"), "pair_names")
        level = table(pairs.join(names, ["a", "z"]).select("d", "s", "copies", "need", "i", "name"), "level")
        done.append(level.where(F.col("need") == r).drop("i"))
    return reduce(DataFrame.unionByName, done)


def group_copies(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """For each row: doc_id, keep_id (the largest doc_id of equal texts), group_size, kept, text_sha256."""
    found = identities(docs, block)
    groups = table(found.groupBy("need", "name").agg(F.max("d").alias("keep"), F.sum("copies").alias("size")), "groups")
    out = found.join(groups, ["need", "name"]).withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    return out.select(
        F.nullif("d", F.lit(NO_ID)).alias("doc_id"),
        F.nullif("keep", F.lit(NO_ID)).alias("keep_id"),
        F.col("size").alias("group_size"),
        (F.col("d") == F.col("keep")).alias("kept"),
        F.lower(F.hex("s")).alias("text_sha256"),
    )


def dedup_exact(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns."""
    docs = without(docs, *ADDED)
    gone = group_copies(docs, block).where("not kept").select(_id().alias("_d"), F.col("text_sha256").alias("_s")).distinct()
    mine = F.coalesce(docs["doc_id"], F.lit(NO_ID)).cast("long")
    return docs.join(gone, (mine == gone["_d"]) & (F.sha2(F.coalesce(docs["text"], F.lit("")), 256) == gone["_s"]), "left_anti")
