"""Line dedup: hashes in range partitions, sorted by document and position, and keep bitmaps.

Each line's 128-bit key hash goes to the range partition of (hash, document, position); partitions are
streamed in that order and each line after the first document that holds its key is marked.  The sort key
goes down to the position, so a key of any frequency is spread over as many partitions as its rows need; a
key that crosses a partition's edge is settled afterwards from one summary row per partition.

Defined cases: a null or empty text is one empty line; a null doc_id counts as the smallest document; rows
that repeat a doc_id are one document, and each distinct text of it has its own bitmap; lines repeated inside
the smallest document stay; columns of the input named like an added column are replaced; no rows, no result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestrand.llm.scratch import NO_ID, table, without

_KEYED = "h1 long, h2 long, doc long, fp long, pos int"
_MARKED = _KEYED + ", kind int"
DROP, EDGE, TAIL = 0, 1, 2


def _keys(min_points: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digests, docs, fps, places = [], [], [], []
            for doc, fp, text in zip(batch["doc"].to_pylist(), batch["fp"].to_pylist(), batch["text"], strict=True):
                lines = text.as_buffer().to_pybytes().lower().split(b"\n")
                for pos, line in enumerate(lines):
                    key = line.strip()
                    if len(key) >= min_points and (len(key) >= 4 * min_points or len(key.decode()) >= min_points):
                        digests.append(xxhash.xxh3_128_digest(key))
                        docs.append(doc)
                        fps.append(fp)
                        places.append(pos)
            pair = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
            yield pa.record_batch([pa.array(np.ascontiguousarray(pair[:, 0])), pa.array(np.ascontiguousarray(pair[:, 1])), pa.array(docs, pa.int64()), pa.array(fps, pa.int64()), pa.array(places, pa.int32())], names=["h1", "h2", "doc", "fp", "pos"])

    return run


def _first_seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Stream a sorted partition: mark lines whose key an earlier document holds; flag the edge keys."""
    names = ["h1", "h2", "doc", "fp", "pos", "kind"]
    head = last = None
    owner = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        h1, h2, doc = (batch[c].to_numpy(zero_copy_only=False) for c in ("h1", "h2", "doc"))
        if head is None:
            head = (h1[0], h2[0])
        fresh = np.ones(len(h1), bool)
        fresh[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
        fresh[0] = last != (h1[0], h2[0])
        at = np.maximum.accumulate(np.where(fresh, np.arange(len(h1)), -1))
        own = np.where(at < 0, owner, doc[np.maximum(at, 0)])
        edge = (h1 == head[0]) & (h2 == head[1])
        told = edge | (doc != own)
        last, owner = (h1[-1], h2[-1]), own[-1]
        if told.any():
            out = batch.filter(pa.array(told))
            yield pa.record_batch([*out.columns, pa.array(np.where(edge[told], EDGE, DROP).astype(np.int32))], names=names)
    if last is not None:
        yield pa.record_batch([pa.array([x], pa.int64()) for x in (last[0], last[1], owner, 0)] + [pa.array([0], pa.int32()), pa.array([TAIL], pa.int32())], names=names)


def keep_bitmaps(docs: DataFrame, min_points: int = 10) -> DataFrame:
    """doc, fp (fingerprint of the text), words: the 64-line words with dropped lines, bits set where dropped.

    A word without dropped lines is left out, and a document without any has no row: that is the compression.
    """
    source = docs.select(F.coalesce(F.col("doc_id"), F.lit(NO_ID)).cast("long").alias("doc"), F.xxhash64("text").alias("fp"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    order = ["h1", "h2", "doc", "fp", "pos"]
    keyed = source.mapInArrow(_keys(min_points), _KEYED)
    marked = table(keyed.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_first_seen, _MARKED), "line_marks")
    edges = marked.where(F.col("kind") != DROP)
    # At most two keys for each partition of the sort are edges: that is the bound of what is broadcast.
    owners = edges.groupBy("h1", "h2").agg(F.min("doc").alias("owner"))
    settled = edges.where(F.col("kind") == EDGE).join(F.broadcast(owners), ["h1", "h2"]).where(F.col("doc") != F.col("owner"))
    drops = marked.where(F.col("kind") == DROP).select("doc", "fp", "pos").unionByName(settled.select("doc", "fp", "pos"))
    words = drops.groupBy("doc", "fp", F.expr("pos div 64").alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(pos % 64 as int))")).alias("bits"))
    return words.groupBy("doc", "fp").agg(F.sort_array(F.collect_list(F.struct("w", "bits"))).alias("words"))


def _apply(text_at: int, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, lines, drops = [], [], []
            for text, words in zip(batch.column(text_at).to_pylist(), batch.column(width).to_pylist(), strict=True):
                parts = (text or "").split("\n")
                lines.append(len(parts))
                if not words:
                    texts.append(text)
                    drops.append(0)
                    continue
                bits = {x["w"]: x["bits"] for x in words}
                kept = [x for i, x in enumerate(parts) if not bits.get(i >> 6, 0) >> (i & 63) & 1]
                texts.append("\n".join(kept))
                drops.append(len(parts) - len(kept))
            columns = list(batch.columns[:width])
            columns[text_at] = pa.array(texts, pa.string())
            yield pa.record_batch([*columns, pa.array(lines, pa.int64()), pa.array(drops, pa.int64())], names=[*batch.schema.names[:width], "n_lines", "n_dropped"])

    return run


def dedup_lines(docs: DataFrame, min_points: int = 10, bitmaps: DataFrame | None = None) -> DataFrame:
    """``docs`` with the repeated lines gone from ``text``, and n_lines (before), n_dropped."""
    docs = without(docs, "n_lines", "n_dropped")
    if bitmaps is None:
        bitmaps = keep_bitmaps(docs, min_points)
    names = docs.columns
    left = docs.select(F.struct(*[docs[f"`{c}`"] for c in names]).alias("row"), F.coalesce(F.col("doc_id"), F.lit(NO_ID)).cast("long").alias("doc"), F.xxhash64("text").alias("fp"))
    joined = left.join(bitmaps, ["doc", "fp"], "left").select("row.*", F.col("words").alias("_drop_words"))
    schema = T.StructType([*docs.schema.fields, T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType())])
    return joined.mapInArrow(_apply([c.lower() for c in names].index("text"), len(names)), schema)
