"""Substring dedup: a relative Lempel-Ziv parse of every document against the blocks of all documents.

A word w is removed if some window of ``length`` consecutive words that covers it also starts anywhere else.

The reference.  Every window contains ``length - block + 1`` blocks of ``block`` words; the one of least hash (the
leftmost of equals) is its reference block, so that equal windows have equal reference blocks at equal places,
whatever surrounds them.  All documents' reference blocks are the index: they are counted, those that occur once
can't belong to a repeat and go no further, and for each other one the text around one of its occurrences is the
reference.  A bit filter (sized by the number of recurring blocks, 128 MB at most) keeps the others out of the
shuffle; where it is too small for a corpus more pass, and the result is the same.

The parse.  Each document is read from left to right; at each indexed block its text is followed to both sides as
far as the windows that name the block go, which is a stretch; equal stretches are counted as one content.  A
content is factored against the reference of its block greedily: the longest run of windows around the block that
equal the reference's is a factor, and a factor of at least ``length`` words is a duplicate span, in the content and
in the reference.  Beyond the factor's boundaries, where a greedy parse would miss repeats of other texts, the
windows that straddle them are checked one by one: they are counted by (block, window) over all contents.  Factors
of neighbouring blocks follow each other and add up to longer spans.  A content that occurs twice is a duplicate span
as a whole.  A block, content or window, however frequent, is counted before it is shuffled, and what a hot one
marks is handed back by joins that the engine may split.

Contents and windows are compared by 128 hash bits (of the block and of the content or window, from independent
bases).

Defined cases: a null text has no words; a text shorter than the window keeps all its words; rows that repeat
a doc_id are judged each by its text, and equal rows repeat each other; a null doc_id is a document like any;
texts are read whole; other columns are carried along, those named like an added one are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestrand.llm import bitfilter
from lodestrand.llm.scratch import NO_ID, table, without
from lodestrand.llm.textkit import U, Words, gram, mix, signed, slices

_TOP = U(2**64 - 1)


def stretches(words: Words, length: int, block: int) -> dict[str, np.ndarray]:
    """The stretches of all rows: row, start (word of the row), size (windows), block, place (in the first window), content, first (word)."""
    n = words.n
    row = words.row_of()
    end = words.first[1:][row] if n else np.zeros(0, np.int64)
    at = np.arange(n)
    value = np.full(n, _TOP)
    inside = np.flatnonzero(at + block <= end)
    value[inside] = gram(words.prefix(0), inside, block, 0)
    place, width, span = at.copy(), 1, length - block + 1
    while width < span:
        step = min(width, span - width)
        ahead = value[step:] < value[:-step]
        value = np.concatenate([np.where(ahead, value[step:], value[:-step]), value[-step:]]) if n > step else value
        place = np.concatenate([np.where(ahead, place[step:], place[:-step]), place[-step:]]) if n > step else place
        width += step
    window = np.flatnonzero(at + length <= end)
    fresh = np.ones(len(window), bool)
    fresh[1:] = (place[window[1:]] != place[window[:-1]]) | (np.diff(window) != 1)
    heads = np.flatnonzero(fresh)
    first, size = window[heads], np.diff(np.append(heads, len(window)))
    second = words.prefix(1)
    content = gram(second, first, size - 1 + length, 1)
    content = mix(content ^ (size.astype(U) << U(32) | (place[first] - first).astype(U)))
    return {"row": row[first], "start": first - words.first[row[first]], "size": size, "block": value[first], "place": place[first] - first, "content": content, "first": first, "second": second}


def _blocks(length: int, block: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                a, count = np.unique(stretches(Words(batch["text"]), length, block)["block"], return_counts=True)
                yield pa.record_batch([signed(a), pa.array(count)], names=["a", "count"])

    return run


def _recurring(length: int, block: int, bits):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                f = stretches(Words(batch["text"]), length, block)
                ok = bitfilter.holds(bits.value, f["block"])
                row, start, size, first = (f[c][ok] for c in ("row", "start", "size", "first"))
                # Window hashes go with the first of equal stretches in the slice; the others' lists are empty.
                shown = np.zeros(len(size), np.int64)
                shown[np.unique(mix(f["block"][ok], 7) ^ f["content"][ok], return_index=True)[1]] = 1
                shown *= size
                ends = np.cumsum(shown)
                each = np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - shown, shown) + np.repeat(first, shown)
                windows = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), signed(gram(f["second"], each, length, 1)))
                take = pa.array(row)
                yield pa.record_batch([signed(f["block"][ok]), signed(f["content"][ok]), batch["d"].take(take), batch["f"].take(take), pa.array(start, pa.int32()), pa.array(size, pa.int32()), pa.array(f["place"][ok], pa.int32()), windows], names=["a", "c", "d", "f", "s", "n", "o", "windows"])

    return run


def _parsed(shown: DataFrame) -> DataFrame:
    """Contents (a, c, m, windows) factored against the reference of their block: mask of the windows in the factor.

    Also rc, the content that is the reference, and shift, what takes a window's place in the content to the reference.
    """
    first = table(shown.groupBy("a").agg(F.min("c").alias("c")), "first")
    # Written, so that the join has exchanges on both sides and a frequent block's contents can be split.
    reference = table(first.join(shown, ["a", "c"]).select("a", F.col("c").alias("rc"), F.col("o").alias("ro"), F.col("windows").alias("rw")), "references")
    both = shown.join(reference, "a").withColumn("shift", F.col("ro") - F.col("o"))
    same = lambda w, t: F.when(t + F.col("shift") >= 0, F.get("rw", t + F.col("shift"))) == w
    bit = lambda w, t: F.when(same(w, t), F.call_function("shiftleft", F.lit(1).cast("long"), t)).otherwise(F.lit(0).cast("long"))
    mask = F.aggregate(F.transform("windows", bit), F.lit(0).cast("long"), lambda x, y: x.bitwiseOR(y))
    return both.select("a", "c", "m", "windows", "rc", "shift", mask.alias("mask"))


def duplicate_spans(docs: DataFrame, length: int = 35, block: int = 16) -> DataFrame:
    """(d, f, spans): for each text with repeats, array<struct<s, mask>>: window s + t recurs for each bit t of mask."""
    # A mask has a bit for each window that can name one block.
    block = max(block, length - 61)
    spark = docs.sparkSession
    texts = docs.select(F.coalesce(F.col("doc_id"), F.lit(NO_ID)).cast("long").alias("d"), F.xxhash64("text").alias("f"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    blocks = texts.select("text").mapInArrow(_blocks(length, block), "a long, count long")
    blocks = table(blocks.groupBy("a").agg(F.sum("count").alias("count")).where("count > 1").select("a"), "blocks")
    bits = spark.sparkContext.broadcast(bitfilter.build(blocks, "a"))
    schema = "a long, c long, d long, f long, s int, n int, o int, windows array<long>"
    found = table(texts.mapInArrow(_recurring(length, block, bits), schema), "stretches")
    contents = table(found.groupBy("a", "c", "n").agg(F.count("*").alias("m")), "contents")
    several = table(contents.groupBy("a").agg(F.count("*").alias("k")).where("k > 1").select("a"), "several")
    split = contents.join(several, "a").select("a", "c", "m")
    shown = table(found.where(F.size("windows") > 0).select("a", "c", "o", "windows").join(split, ["a", "c"]).dropDuplicates(["a", "c"]), "representatives")
    parsed = table(_parsed(shown), "parsed")
    others = parsed.where("c <> rc")
    moved = F.expr("if(shift >= 0, shiftleft(mask, shift), shiftrightunsigned(mask, -shift))")
    own = others.where("mask <> 0").groupBy("a", F.col("rc").alias("c")).agg(F.bit_or(moved).alias("mask"))
    beyond = others.select("a", "c", "m", "mask", F.posexplode("windows").alias("t", "w")).where("shiftrightunsigned(mask, t) & 1 = 0")
    again = table(beyond.groupBy("a", "w").agg(F.sum("m").alias("m")).where("m > 1").select("a", "w"), "again")
    marks = beyond.where("m = 1").join(again, ["a", "w"]).groupBy("a", "c").agg(F.bit_or(F.expr("shiftleft(1L, t)")).alias("mask"))
    whole = contents.where("m > 1").select("a", "c", F.expr("shiftleft(1L, n) - 1").alias("mask"))
    masks = whole.unionByName(others.where("mask <> 0").select("a", "c", "mask")).unionByName(own).unionByName(marks)
    # Written, so that both sides of the join have exchanges and a frequent content's rows can be split.
    masks = table(masks.groupBy("a", "c").agg(F.bit_or("mask").alias("mask")), "masks")
    hit = found.select("a", "c", "d", "f", "s").join(masks, ["a", "c"])
    # A set: rows that repeat a doc_id and a text mark the same spans, which are merged before the shuffle.
    return hit.groupBy("d", "f").agg(F.collect_set(F.struct("s", "mask")).alias("spans"))


def _remove(text_at: int, width: int, length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, counts, gone = [], [], []
            spans = batch.column(width)
            for i, text in enumerate(batch.column(text_at)):
                words = text.as_buffer().to_pybytes().split() if text.is_valid else []
                kept = words
                if spans[i].is_valid:
                    found = spans[i].values
                    s, mask = found.field("s").to_numpy(zero_copy_only=False), found.field("mask").to_numpy(zero_copy_only=False)
                    edge = np.zeros(len(words) + 1, np.int32)
                    for t in range(int(mask.max()).bit_length()):
                        w = s[(mask >> t & 1) > 0] + t
                        np.add.at(edge, w, 1)
                        np.add.at(edge, w + length, -1)
                    covered = np.cumsum(edge[:-1]) > 0
                    kept = [x for x, c in zip(words, covered.tolist(), strict=True) if not c]
                texts.append(b" ".join(kept))
                counts.append(len(words))
                gone.append(len(words) - len(kept))
            columns = list(batch.columns[:width])
            columns[text_at] = pa.array(texts, pa.binary()).cast(pa.string())
            yield pa.record_batch([*columns, pa.array(counts, pa.int64()), pa.array(gone, pa.int64())], names=[*batch.schema.names[:width], "n_words", "n_removed"])

    return run


def dedup_substrings(docs: DataFrame, length: int = 35, block: int = 16) -> DataFrame:
    """``docs`` with ``text`` replaced by the words that stay, one space between, and n_words (before), n_removed."""
    docs = without(docs, "n_words", "n_removed")
    names = docs.columns
    spans = duplicate_spans(docs, length, block)
    rows = docs.select(F.struct(*[docs[f"`{c}`"] for c in names]).alias("row"), F.coalesce(F.col("doc_id"), F.lit(NO_ID)).cast("long").alias("d"), F.xxhash64("text").alias("f"))
    joined = rows.join(spans, ["d", "f"], "left").select("row.*", F.col("spans").alias("_spans"))
    schema = T.StructType([*docs.schema.fields, T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType())])
    return joined.mapInArrow(_remove([c.lower() for c in names].index("text"), len(names), length), schema)
