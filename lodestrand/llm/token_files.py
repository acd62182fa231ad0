"""Token-ID output in ORC files: ids of every document in order of doc_id, with what a reader needs to skip.

Writing.  Documents are ranged by (doc_id, hash of the text) and each range is sorted, encoded and written as a part:
rows (doc_id, part, at, n_tokens, ids), where ``at`` is the number of ids before the document in its part.  ORC
stores whole numbers by run-length encoding (a part's number and the rising ``at`` cost next to nothing), cuts a
file into stripes that are read in parallel, and keeps for each stripe and each ``stride`` rows the least and
greatest doc_id and a Bloom filter of the doc_ids, by which a reader passes over what it doesn't look for.  Beside
the parts is a manifest with a row for each: its documents, ids, and first and last doc_id.

Reading.  A part's place among all ids is the sum over the parts before it, from the manifest (a row for each part);
a document's is its part's and ``at``.  So no document is counted twice and none is gathered in one task.

Encoding.  The tokenizer's file is read by the driver and sent to the workers, which need not have it.  A tokenizer
that drops white space and cuts letters, digits and other characters apart gives a run of them the same ids wherever
it stands, so a worker encodes the distinct runs of a slice once and lays their ids out by one gather (``runs=True``,
see ``runs_of``); other tokenizers encode whole texts (``runs=False``).

Defined cases: a null or empty text has the end id alone; null doc_ids come first; rows that repeat a doc_id are
ordered by their text's hash, equal rows follow each other and may fall in neighbouring parts; a text of any length is
encoded whole; other columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

import functools
import os
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestrand.llm.scratch import area
from lodestrand.llm.fim import buffers
from lodestrand.llm.textkit import SPACE, slices
from lodestrand.shipping import ship

#: Bytes of text whose ids are laid out at once.
PIECE = 4 << 20
#: Runs that a worker remembers; beyond that it begins anew.
KEPT = 1 << 19
#: Runs that are encoded as one text.
JOINED = 300
STRIDE, FALSE_POSITIVES, STRIPE = 1000, 0.01, 64 << 20
SCHEMA = "doc_id long, part int, at long, n_tokens long, ids array<int>"


#: Class of a byte: 0 white space, 1 digit, 2 letter, 3 any other.
_CLASS = np.array([0 if SPACE[b] else 1 if 48 <= b < 58 else 2 if 65 <= b < 91 or 97 <= b < 123 else 3 for b in range(256)], np.uint8)


def runs_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Runs that a word tokenizer encodes on their own, row by row, and how many each row has.

    They are runs of letters (in lower case), single digits and runs of other characters.  A word between white space
    stays whole, as it is, where that may not hold: with characters beyond ASCII (marks that combine, other letters
    and spaces), an apostrophe (clitics) or ``<|`` (special tokens).
    """
    d, off = buffers(texts)
    kind = _CLASS[d]
    head = np.zeros(len(d), bool)
    head[off[:-1][off[:-1] < off[1:]]] = True
    word = head.copy()
    word[1:] |= (kind[1:] == 0) != (kind[:-1] == 0)
    odd = (d > 127) | (d == ord("'"))
    odd[:-1] |= (d[:-1] == ord("<")) & (d[1:] == ord("|"))
    first = np.flatnonzero(word)
    whole = np.repeat(np.logical_or.reduceat(odd, first), np.diff(np.append(first, len(d)))) if len(d) else odd
    cut = kind == 1
    cut[1:] |= kind[1:] != kind[:-1]
    begin = np.flatnonzero(word | cut & ~whole)
    low = d + np.where(~whole & (d >= 65) & (d < 91), 32, 0).astype(np.uint8)
    all_ = pa.StringArray.from_buffers(len(begin), pa.py_buffer(np.append(begin, len(d)).astype(np.int32)), pa.py_buffer(low))
    said = kind[begin] > 0
    return all_.filter(pa.array(said)), np.diff(np.concatenate([[0], np.cumsum(said)])[np.searchsorted(begin, off)])


class Encoder:
    """Ids of texts by a tokenizer given as JSON.  What it knows is kept as ids end to end; number 0 is the end id alone."""

    def __init__(self, json: str, end: int, runs: bool):
        from tokenizers import Tokenizer

        self.tokenizer, self.end, self.runs = Tokenizer.from_str(json), end, runs
        self._forget()

    def _forget(self) -> None:
        self.number: dict[str, int] = {}
        self.flat, self.size = np.array([self.end], np.int32), np.ones(1, np.int64)

    def _plain(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids end to end and how many each text has."""
        found = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        return np.array([i for x in found for i in x], np.int32), np.array([len(x) for x in found], np.int64)

    def _joined(self, runs: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The same for runs that the tokenizer never cuts: many make one text, whose words they are."""
        groups = [runs[p : p + JOINED] for p in range(0, len(runs), JOINED)]
        found = self.tokenizer.encode_batch([" ".join(g) for g in groups], add_special_tokens=False)
        size = [np.bincount(np.array(e.word_ids, np.int64), minlength=len(g)) for e, g in zip(found, groups, strict=True)]
        if any(len(n) != len(g) or not n.all() for n, g in zip(size, groups, strict=True)):
            return self._plain(runs)
        return np.array([i for e in found for i in e.ids], np.int32), np.concatenate([np.zeros(0, np.int64), *size])

    def _learn(self, runs: list[str]) -> np.ndarray:
        """The numbers of distinct runs, encoded if they are new."""
        if len(self.number) > KEPT:
            self._forget()
        new = [r for r in runs if r not in self.number]
        alone = [r for r in new if r.isascii() and "'" not in r and "<|" not in r]
        rest = [r for r in new if not r.isascii() or "'" in r or "<|" in r]
        for known, (ids, size) in ((alone, self._joined(alone)), (rest, self._plain(rest))):
            self.number.update(zip(known, range(len(self.size), len(self.size) + len(known)), strict=True))
            self.flat, self.size = np.concatenate([self.flat, ids]), np.concatenate([self.size, size])
        return np.fromiter(map(self.number.__getitem__, runs), np.int64, len(runs))

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of a string array without nulls, end to end, each text's closed by the end id; and where each begins."""
        if self.runs:
            runs, many = runs_of(texts)
            coded = pc.dictionary_encode(runs)
            code = self._learn(coded.dictionary.to_pylist())[coded.indices.to_numpy(zero_copy_only=False)]
            flat, size = self.flat, self.size
        else:
            ids, n = self._plain(texts.to_pylist())
            flat, size = np.append(np.int32(self.end), ids).astype(np.int32), np.append(1, n)
            code, many = np.arange(1, len(texts) + 1), np.ones(len(texts), np.int64)
        close = np.cumsum(many)
        code = np.insert(code, close, 0)
        n = size[code]
        ends = np.cumsum(n)
        out = flat[np.repeat((np.cumsum(size) - size)[code] - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)]
        return out, np.concatenate([[0], ends])[np.concatenate([[0], close + 1 + np.arange(len(close))])]


@functools.lru_cache(2)
def _encoder(json: str, end: int, runs: bool) -> Encoder:
    """A worker's own, which it keeps from task to task."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return Encoder(json, end, runs)


def _encode(json, end: int, runs: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, at = _encoder(json.value, end, runs), TaskContext.get().partitionId(), 0
        for whole in batches:
            for batch in slices(whole, "text", PIECE):
                ids, begin = encoder.encode(batch["text"])
                lists = pa.ListArray.from_arrays(pa.array(begin, pa.int32()), pa.array(ids, pa.int32()))
                yield pa.record_batch([batch["doc_id"], pa.array(np.full(len(lists), part), pa.int32()), pa.array(at + begin[:-1], pa.int64()), pa.array(np.diff(begin), pa.int64()), lists], names=["doc_id", "part", "at", "n_tokens", "ids"])
                at += int(begin[-1])

    return run


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end: int = 2, runs: bool = True) -> None:
    """Write the ids of ``docs`` and the manifest under ``path``, a folder that driver and executors share."""
    spark = ship(docs.sparkSession)
    with open(tokenizer, encoding="utf-8") as f:
        json = spark.sparkContext.broadcast(f.read())
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("tie"), F.monotonically_increasing_id().alias("row"))
    # Rows that are equal but for their number may part, so that copies of one row don't meet in one range.
    ranged = rows.repartitionByRange("doc_id", "tie", "row").sortWithinPartitions("doc_id", "tie", "row")
    ids = ranged.select("doc_id", "text").mapInArrow(_encode(json, end, runs), SCHEMA)
    options = {"orc.compress": "zstd", "orc.stripe.size": STRIPE, "orc.row.index.stride": STRIDE, "orc.bloom.filter.columns": "doc_id", "orc.bloom.filter.fpp": FALSE_POSITIVES}
    ids.write.options(**options).orc(f"{path}/data")
    # Four columns of the files are read; a row for each part comes out.
    parts = token_rows(spark, path).groupBy("part").agg(F.count("*").alias("documents"), F.sum("n_tokens").alias("tokens"), F.min("doc_id").alias("first_id"), F.max("doc_id").alias("last_id"))
    parts.coalesce(1).write.orc(f"{path}/manifest")


def token_rows(spark: SparkSession, path: str) -> DataFrame:
    """The rows as written; conditions on doc_id and part reach the files' indexes."""
    return spark.read.schema(SCHEMA).orc(f"{path}/data")


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """part, documents, tokens, first_id, last_id, and before: the ids of all parts before it.  A row for each part."""
    parts = spark.read.schema("part int, documents long, tokens long, first_id long, last_id long").orc(f"{path}/manifest")
    return parts.withColumn("before", F.coalesce(F.sum("tokens").over(Window.partitionBy(F.lit(0)).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))


def placed(rows: DataFrame, path: str) -> DataFrame:
    """``rows`` (with part and at) with ``start``, the number of ids before each document, in place of them."""
    parts = manifest(rows.sparkSession, path).select("part", "before")
    return rows.join(parts, "part").withColumn("start", F.col("before") + F.col("at")).drop("part", "at", "before")


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, n_tokens, ids, start of every document."""
    return placed(token_rows(spark, path), path)


def lookup(spark: SparkSession, path: str, ids: list[int]) -> DataFrame:
    """The documents of some doc_ids: stripes and strides that can't hold them are passed over."""
    return placed(token_rows(spark, path).where(F.col("doc_id").isin(ids)), path)


def _crc(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch["ids"]
        begin = np.asarray(ids.offsets).astype(np.int64)
        data = memoryview(np.ascontiguousarray(ids.values.to_numpy(zero_copy_only=False)).astype("<u4", copy=False)).cast("B")
        crc = [zlib.crc32(data[4 * a : 4 * b]) for a, b in zip(begin[:-1].tolist(), begin[1:].tolist(), strict=True)]
        yield pa.record_batch([batch["doc_id"], batch["part"], batch["at"], batch["n_tokens"], pa.array(crc, pa.int64())], names=["doc_id", "part", "at", "n_tokens", "ids_crc32"])


def token_digests(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_crc32 (of the ids as little-endian unsigned 32-bit numbers), start; ids don't leave their scan."""
    rows = token_rows(spark, path).mapInArrow(_crc, "doc_id long, part int, at long, n_tokens long, ids_crc32 long")
    return placed(rows, path)


def new_folder(spark: SparkSession) -> str:
    """A folder of this application under the shared one."""
    return f"{area(spark)}/lodestrand/{spark.sparkContext.applicationId}/{uuid.uuid4().hex}/tokens"
