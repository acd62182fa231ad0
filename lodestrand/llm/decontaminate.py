"""Benchmark decontamination by spaced-seed hashing.

Tokens are runs of ASCII letters, digits and all characters beyond ASCII; ASCII letters are lower-cased.  Each
mask is a fixed pattern of positions that count and positions that are ignored.  The hashes of the documents'
tokens under every mask are joined with those of the benchmark's; each hit proposes an alignment of an item with
the document, which is then verified token by token.

An item is found in a document if, in some alignment, some window of min(13, item length) item tokens agrees with
the document's tokens at the same places but for a fifth of them, rounded down; windows under ten tokens must agree
wholly.  The masks are complete for this rule: whatever two tokens of ten or more are substituted, some mask of
four tokens that agree is left.

  1. Items of one text are one item.  Their seeds are a table, and a bit filter of the seeds' hashes (bounded size)
     is sent to the executors.
  2. Each document hands on its passages: the tokens around seeds that pass the filter, with these seeds' hashes.
     Passages overlap, so that the windows around a seed lie in its passage, and verification needs no text again;
     their length is bounded, whatever a text repeats.
  3. Passages' seeds are joined with the items' by hash; the join has exchanges on both sides, so a frequent seed's
     rows can be split.  Each alignment is kept once and verified in Arrow batches, without a loop over rows.

Benchmark and documents may have any size; no part of either is collected.

Defined cases: null or empty texts have no tokens and match nothing; an item under four tokens is never found; an
item without an id is searched like any and gives a null among the ids, which come first; rows that repeat a doc_id
are judged each by its text; repeated items are each reported, equal ids once; a null doc_id is a document like any;
texts are read whole; other columns are carried along, those named like an added one are replaced; an empty benchmark
finds nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrand.llm import bitfilter
from lodestrand.llm.scratch import NO_ID, table, without
from lodestrand.llm.textkit import ALNUM, U, Words, mix, powers, signed, slices

#: 1 counts, 0 is ignored.
MASKS = ("1111", "11011", "101101", "110011", "1101001")
WINDOW = 13
#: Tokens before a seed's first one, and from it on, that windows around the seed may hold.
BEFORE, AFTER = WINDOW - min(map(len, MASKS)), WINDOW
#: Seeds in one passage begin within so many tokens; and so many tokens are compared at once.
REACH, AT_ONCE = 256, 1 << 20


def seeds(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """The hashes under all masks of all rows, and the word where each begins."""
    row = words.row_of()
    hashes, places = [np.zeros(0, U)], [np.zeros(0, np.int64)]
    for m, mask in enumerate(MASKS):
        spots = [i for i, c in enumerate(mask) if c == "1"]
        n = words.n - len(mask) + 1
        if n <= 0:
            continue
        h = np.full(n, m, U)
        for p, s in zip(powers(0xD1342543DE82EF95, len(spots) + 1)[1:], spots, strict=True):
            h += words.values[s : s + n] * p
        at = np.flatnonzero(row[:n] == row[len(mask) - 1 :])
        hashes.append(mix(h[at], 31))
        places.append(at)
    return np.concatenate(hashes), np.concatenate(places)


def allowed(size):
    """Substitutions that a window of this many tokens may hold."""
    return np.where(size >= 10, size // 5, 0)


def _words(texts: pa.Array) -> Words:
    return Words(texts, fold=True, kinds=ALNUM)


def _binary(values: np.ndarray, first: np.ndarray, last: np.ndarray) -> pa.Array:
    return pa.array([values[a:b].tobytes() for a, b in zip(first.tolist(), last.tolist(), strict=True)], pa.binary())


def _item_tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in slices(whole, "text"):
            words = _words(batch["text"])
            yield pa.record_batch([batch["k"], _binary(words.values, words.first[:-1], words.first[1:])], names=["k", "item"])


def _item_seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in slices(whole, "text"):
            words = _words(batch["text"])
            h, at = seeds(words)
            row = words.row_of()[at]
            yield pa.record_batch([signed(h), batch["k"].take(pa.array(row)), pa.array(at - words.first[row], pa.int32())], names=["h", "k", "place"])


def _passages(bits):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                words = _words(batch["text"])
                h, at = seeds(words)
                ok = np.flatnonzero(bitfilter.holds(bits.value, h))
                ok = ok[np.argsort(at[ok], kind="stable")]
                h, at = h[ok], at[ok]
                row = words.row_of()[at]
                fresh = np.ones(len(at), bool)
                part = (at - words.first[row]) // REACH
                fresh[1:] = (row[1:] != row[:-1]) | (part[1:] != part[:-1]) | (at[1:] - BEFORE > at[:-1] + AFTER)
                head = np.flatnonzero(fresh)
                ends = np.append(head[1:], len(at))
                first = np.maximum(words.first[row[head]], at[head] - BEFORE)
                last = np.minimum(words.first[row[head] + 1], at[ends - 1] + AFTER) if len(head) else first
                cuts = pa.array(np.append(head, len(at)), pa.int32())
                take = pa.array(row[head])
                offsets = pa.array(at - np.repeat(first, ends - head), pa.int32())
                columns = [batch["d"].take(take), batch["f"].take(take), pa.array(first - words.first[row[head]], pa.int32()), _binary(words.values, first, last)]
                yield pa.record_batch([*columns, pa.ListArray.from_arrays(cuts, signed(h)), pa.ListArray.from_arrays(cuts, offsets)], names=["d", "f", "b", "passage", "hashes", "offsets"])

    return run


def _ends(parts: list[np.ndarray]) -> np.ndarray:
    return np.concatenate([[0], np.cumsum([len(x) for x in parts], dtype=np.int64)])


def agree(items: list[np.ndarray], passages: list[np.ndarray], pair: np.ndarray, shift: np.ndarray) -> np.ndarray:
    """Whether token j of item ``pair`` and token j + shift of passage ``pair`` agree in some window of the item."""
    item, passage = np.concatenate([np.zeros(0, U), *items]), np.concatenate([np.zeros(1, U), *passages])
    item_at, passage_at = _ends(items), _ends(passages) + 1
    size, width = np.diff(item_at)[pair], np.diff(passage_at)[pair]
    window = np.minimum(WINDOW, size)
    spare = allowed(window)
    # Item tokens beside the passage disagree; no window can hold more of them than are allowed.
    low, high = np.maximum(0, -shift - spare), np.minimum(size, width - shift + spare)
    n = np.maximum(high - low, 0)
    good = np.zeros(len(pair), bool)
    done = np.cumsum(n)
    at = 0
    while at < len(pair):
        to = max(at + 1, int(np.searchsorted(done, (done[at - 1] if at else 0) + AT_ONCE, "right")))
        begin = np.concatenate([[0], np.cumsum(n[at:to])])
        row = np.repeat(np.arange(at, to), n[at:to])
        j = np.arange(begin[-1]) - begin[row - at] + low[row]
        k = j + shift[row]
        inside = (k >= 0) & (k < width[row])
        same = inside & (item[j + item_at[pair[row]]] == passage[np.where(inside, k + passage_at[pair[row]], 0)])
        total = np.concatenate([[0], np.cumsum(same)])
        spot = np.arange(begin[-1])
        full = spot + window[row] <= begin[row - at + 1]
        many = total[np.minimum(spot + window[row], begin[-1])] - total[spot]
        good[row[full & (many >= window[row] - spare[row])]] = True
        at = to
    return good


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            items, passages = ([np.frombuffer(x.as_buffer(), U) for x in batch[c]] for c in ("item", "passage"))
            shifts = [x.values.to_numpy() for x in batch["shifts"]]
            pair = np.repeat(np.arange(batch.num_rows), [len(x) for x in shifts])
            good = agree(items, passages, pair, np.concatenate(shifts).astype(np.int64))
            yield batch.select(["d", "f", "k"]).filter(pa.array(np.bincount(pair[good], minlength=batch.num_rows) > 0))


def found_items(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(d, f, items): the sorted ids of the items found in each text (by doc_id and hash) that holds some."""
    texts = docs.select(F.coalesce(F.col("doc_id"), F.lit(NO_ID)).cast("long").alias("d"), F.xxhash64("text").alias("f"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    bench = benchmark.where(F.col("text").isNotNull()).groupBy("text").agg(F.collect_set(F.struct(F.col("item_id").cast("long").alias("id"))).alias("ids"))
    bench = table(bench.withColumn("k", F.monotonically_increasing_id()), "items")
    tokens = table(bench.select("k", "text").mapInArrow(_item_tokens, "k long, item binary"), "item_tokens")
    index = table(bench.select("k", "text").mapInArrow(_item_seeds, "h long, k long, place int"), "item_seeds")
    bits = docs.sparkSession.sparkContext.broadcast(bitfilter.build(index, "h"))
    passages = texts.mapInArrow(_passages(bits), "d long, f long, b int, passage binary, hashes array<long>, offsets array<int>")
    passages = table(passages, "passages")
    hits = passages.select("d", "f", "b", F.inline(F.arrays_zip(F.col("hashes").alias("h"), F.col("offsets").alias("o"))))
    shift = (F.col("o") - F.col("place")).alias("shift")
    # Each alignment once; a passage and an item have no more of them than tokens.  Written, so that the next join
    # has exchanges on both sides.
    alignments = hits.join(index, "h").select("d", "f", "b", "k", shift).distinct()
    alignments = table(alignments.groupBy("d", "f", "b", "k").agg(F.collect_list("shift").alias("shifts")), "alignments")
    pairs = alignments.join(passages.select("d", "f", "b", "passage"), ["d", "f", "b"]).join(tokens, "k")
    found = pairs.select("d", "f", "k", "item", "passage", "shifts").mapInArrow(_verify, "d long, f long, k long").distinct()
    found = found.join(bench.select("k", "ids"), "k").select("d", "f", F.explode("ids").alias("i"))
    return table(found.groupBy("d", "f").agg(F.transform(F.sort_array(F.collect_set("i")), lambda x: x["id"]).alias("items")), "found")


def find_items(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` with ``items``: the sorted ids of the benchmark items found in each text."""
    docs = without(docs, "items")
    found = found_items(docs, benchmark)
    rows = docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("_row"), F.coalesce(F.col("doc_id"), F.lit(NO_ID)).cast("long").alias("d"), F.xxhash64("text").alias("f"))
    return rows.join(found, ["d", "f"], "left").select("_row.*", F.coalesce("items", F.array().cast("array<bigint>")).alias("items"))


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` in which no item is found, with their columns but one named ``items``."""
    docs = without(docs, "items")
    found = found_items(docs, benchmark).select("d", "f")
    mine = (F.coalesce(docs["doc_id"], F.lit(NO_ID)).cast("long") == found["d"]) & (F.xxhash64(docs["text"]) == found["f"])
    return docs.join(found, mine, "left_anti")
