"""MinHash near-dedup with HyperMinHash registers.

A document's set holds the hashes of its distinct word shingles.  Each hash goes to one of 128 buckets; a bucket
keeps its least hash as a 16-bit register of leading-zero count and mantissa bits; an empty bucket takes the
register of the first full one in a random order of all buckets that is its own, so that in sets with few
shingles, too, one differing shingle spoils registers here and there and not a run of neighbours.  Four
registers, 32 apart, make a band, and every register is in one band, so that with similarity s a pair shares
some of the 32 bands with probability of about 1 - (1 - s**4)**32 (0.85: 1 - 6e-11; 0.8: 1 - 5e-8); README has
misses measured by size of set.

Documents with equal sets become one class, so copies are never paired; a class whose set is so small that no other
set can be similar enough is paired with none.  Then
  1. in each band's bucket every class is paired with the bucket's first class,
  2. pairs whose collision-corrected estimate of similarity is too low by five standard deviations go,
  3. the others are verified on their full sets, and the links' components are found,
  4. in buckets that still hold several components, all pairs across components are verified on their full sets:
     the bucket is cut into blocks of bounded size, each pair of blocks is one product of 0/1 matrices, and only
     one link for each merger of two components leaves it; the components of all links are the result.
So all pairs that share a band are judged, except those whose two classes are connected already.

Defined cases: fewer words than a shingle make one shingle of all words; a text without words (or null) has an
empty set and is linked with nothing; rows that repeat a doc_id are judged each by its text; a null doc_id
counts as the smallest; text of any length is read whole; other columns are carried along by ``dedup_near``, which
keeps one row of each component, whatever ids repeat or are null, and every row with an empty set.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrand.llm.components import components
from lodestrand.llm.scratch import NO_ID, table
from lodestrand.llm.textkit import U, Words, gram, mix, powers, signed, slices

REGISTERS, ROWS, STRIDE, BANDS = 128, 4, 32, 32
_MANTISSA = 10
#: For each register a fixed random order of the buckets, its own first.
_keys = np.random.default_rng(20240611).random((REGISTERS, REGISTERS))
np.fill_diagonal(_keys, -1)
_ORDER = np.argsort(_keys, 1)
#: Most members, and about the most elements of their sets, in a block of a bucket.
BLOCK, BLOCK_ELEMENTS = 2048, 1 << 20
_COLUMNS, _LINES = 512, 128


def shingle_sets(words: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of all rows, end to end, and where each row's begin."""
    n = np.diff(words.first)
    count = np.where(n >= k, n - k + 1, np.minimum(n, 1))
    begin = np.concatenate([[0], np.cumsum(count)])
    row = np.repeat(np.arange(words.rows), count)
    start = np.arange(begin[-1]) - begin[row] + words.first[row]
    h = gram(words.prefix(), start, np.minimum(n, k)[row])
    for a, b in zip(begin[:-1], begin[1:], strict=True):
        if b - a > 1:
            h[a:b].sort()
    fresh = np.ones(len(h), bool)
    fresh[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    return h[fresh], np.concatenate([[0], np.cumsum(np.bincount(row[fresh], minlength=words.rows))]).astype(np.int64)


def registers(h: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """uint16 registers, a line for each row; 0 only in rows without shingles."""
    rows = len(begin) - 1
    row = np.repeat(np.arange(rows), np.diff(begin))
    bucket = (h >> U(57)).astype(np.int64)
    slot = row * REGISTERS + bucket
    least = np.ones(len(h), bool)
    least[1:] = slot[1:] != slot[:-1]
    rest = h[least] << U(7)
    zeros = np.clip(64 - np.frexp(rest.astype(np.float64))[1], 0, 57)
    mantissa = ((rest << zeros.astype(U)) >> U(63 - _MANTISSA)) & U(2**_MANTISSA - 1)
    out = np.zeros(rows * REGISTERS, np.uint16)
    out[slot[least]] = (zeros.astype(U) << U(_MANTISSA) | mantissa).astype(np.uint16) + np.uint16(1)
    own, open_ = out.copy(), np.flatnonzero((out == 0) & np.repeat(np.diff(begin) > 0, REGISTERS))
    for turn in range(1, REGISTERS):
        found = own[open_ // REGISTERS * REGISTERS + _ORDER[open_ % REGISTERS, turn]]
        out[open_] = found
        open_ = open_[found == 0]
        if not len(open_):
            break
    return out.reshape(rows, REGISTERS)


def _sketch(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                h, begin = shingle_sets(Words(batch["text"], fold=True), k)
                sums = []
                for salt in (11, 12):
                    s = np.concatenate([np.zeros(1, U), np.cumsum(mix(h, salt))])
                    sums.append(signed(s[begin[1:]] - s[begin[:-1]]))
                regs = pa.FixedSizeBinaryArray.from_buffers(pa.binary(2 * REGISTERS), batch.num_rows, [None, pa.py_buffer(registers(h, begin).tobytes())]).cast(pa.binary())
                yield pa.record_batch([batch["d"], batch["f"], pa.array(np.diff(begin)), *sums, regs], names=["d", "f", "n", "s1", "s2", "regs"])

    return run


def _unpack(regs: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(regs.to_pylist()), np.uint16).reshape(-1, REGISTERS)


def _bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        r = _unpack(batch["regs"]).astype(U)
        key = np.zeros((len(r), BANDS), U)
        for j in range(ROWS):
            key = key << U(16) | r[:, j * STRIDE : j * STRIDE + BANDS]
        key = mix(key ^ powers(0xD1342543DE82EF95, BANDS)[None, :] * U(0x9E3779B97F4A7C15))
        ids = np.repeat(batch["id"].to_numpy(zero_copy_only=False), BANDS)
        yield pa.record_batch([signed(key.ravel()), pa.array(ids)], names=["band", "id"])


def _plausible(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray, percent: int) -> np.ndarray:
    """Whether the corrected estimate is within five deviations of the threshold, and sizes allow a link."""
    chance = 2.0**-_MANTISSA
    j = ((a == b).sum(-1) / REGISTERS - chance) / (1 - chance)
    t = percent / 100
    low, high = np.minimum(na, nb), np.maximum(na, nb)
    return (j >= t - 0.02 - 5 * np.sqrt(t * (1 - t) / np.clip(low, 1, REGISTERS))) & (100 * low >= percent * high)


def _estimate(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                ok = _plausible(_unpack(batch["ra"]), _unpack(batch["rb"]), *(batch[c].to_numpy(zero_copy_only=False) for c in ("na", "nb")), percent)
                yield batch.select(["a", "b"]).filter(pa.array(ok))

    return run


def _shared(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all left with all right sets, from products of 0/1 matrices."""
    both = left + right
    element, code, many = np.unique(np.concatenate(both), return_inverse=True, return_counts=True)
    rank = np.cumsum(many > 1) - 1
    owner = np.repeat(np.arange(len(both)), [len(x) for x in both])
    keep = many[code] > 1
    column, owner = rank[code[keep]], owner[keep]
    out = np.zeros((len(left), len(right)), np.float32)
    order = np.argsort(column, kind="stable")
    column, owner = column[order], owner[order]
    for low in range(0, int(column[-1]) + 1 if len(column) else 0, _COLUMNS):
        part = slice(*np.searchsorted(column, [low, low + _COLUMNS]))
        m = np.zeros((len(both), _COLUMNS), np.float32)
        m[owner[part], column[part] - low] = 1
        out += m[: len(left)] @ m[len(left) :].T
    return out


def _across(percent: int):
    """Links between the components of one bucket, for the blocks i and j of its members: one for each merger."""

    def run(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        ids, comp, blk = (group[c].to_numpy() for c in ("id", "comp", "blk"))
        sets = [np.frombuffer(e.as_buffer(), U) for e in group["elements"]]
        left, right = np.flatnonzero(blk == group["i"][0].as_py()), np.flatnonzero(blk == group["j"][0].as_py())
        out: list[tuple[int, int]] = []
        if len(left) and len(right):
            n = np.array([len(x) for x in sets], np.float64)
            same = _shared([sets[x] for x in left], [sets[x] for x in right])
            x, y = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            # A few lines of the product at a time, so that no further matrix of its size is made.
            for low in range(0, len(left), _LINES):
                a, s = left[low : low + _LINES], same[low : low + _LINES].astype(np.float64)
                i, j = np.nonzero((100 * s >= percent * (n[a][:, None] + n[right][None, :] - s)) & (comp[a][:, None] != comp[right][None, :]))
                x.append(a[i])
                y.append(right[j])
            x, y = np.concatenate(x), np.concatenate(y)
            pairs, at = np.unique(np.sort(np.column_stack([comp[x], comp[y]]), axis=1), axis=0, return_index=True)
            root: dict[int, int] = {}

            def top(c: int) -> int:
                while c in root:
                    c = root[c]
                return c

            for (p, q), k in zip(pairs.tolist(), at.tolist(), strict=True):
                p, q = top(p), top(q)
                if p != q:
                    root[max(p, q)] = min(p, q)
                    out.append((int(ids[x[k]]), int(ids[y[k]])))
        a, b = zip(*out, strict=True) if out else ((), ())
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return run


def _full_sets(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                h, begin = shingle_sets(Words(batch["text"], fold=True), k)
                yield pa.record_batch([batch["id"], pa.array([h[a:b].tobytes() for a, b in zip(begin[:-1], begin[1:], strict=True)], pa.binary())], names=["id", "elements"])

    return run


def _verify(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = []
            for x, y in zip(batch["ea"], batch["eb"], strict=True):
                a, b = (np.frombuffer(e.as_buffer(), U) for e in (x, y))
                both = np.concatenate([a, b])
                both.sort()
                same = int((both[1:] == both[:-1]).sum())
                ok.append(100 * same >= percent * (len(both) - same))
            yield batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return run


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce(F.col("doc_id"), F.lit(NO_ID)).cast("long").alias("d"), F.xxhash64("text").alias("f"), F.coalesce(F.col("text"), F.lit("")).alias("text"))


def _links(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    named = lambda c, e: sets.select(F.col("id").alias(c), F.col("elements").alias(e))
    return pairs.join(named("a", "ea"), "a").join(named("b", "eb"), "b").mapInArrow(_verify(percent), "a long, b long")


def near_groups(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """For each row: d, f (hash of the text), n_shingles, component_id (the least doc_id that links lead to), component_f (of its text)."""
    texts = _keyed(docs)
    sketches = table(texts.mapInArrow(_sketch(k), "d long, f long, n long, s1 long, s2 long, regs binary"), "sketches")
    classes = sketches.where("n > 0").groupBy("n", "s1", "s2").agg(F.min(F.struct("d", "f")).alias("r"), F.max("regs").alias("regs"))
    classes = table(classes.select(F.monotonically_increasing_id().alias("id"), "n", "s1", "s2", F.col("r.d").alias("rd"), F.col("r.f").alias("rf"), "regs"), "classes")
    # A set of n shingles shares n with another at most, of n + 1 in both: too few, if n is small, to be linked.
    bands = classes.where(100 * F.col("n") >= percent * (F.col("n") + 1)).select("id", "regs").mapInArrow(_bands, "band long, id long")
    # Written (as are other aggregates below), so that both sides of the join have exchanges that can be split.
    buckets = table(bands.groupBy("band").agg(F.min("id").alias("a"), F.count("*").alias("size")).where("size > 1"), "buckets")
    members = table(bands.join(buckets, "band"), "members")
    near = members.where("id <> a").select("a", F.col("id").alias("b")).distinct()
    sketch = lambda c, r, n: classes.select(F.col("id").alias(c), F.col("regs").alias(r), F.col("n").alias(n))
    pairs = table(near.join(sketch("a", "ra", "na"), "a").join(sketch("b", "rb", "nb"), "b").mapInArrow(_estimate(percent), "a long, b long"), "pairs")
    wanted = members.select("id").distinct().join(classes.select("id", "rd", "rf"), "id")
    sets = texts.join(wanted, (F.col("d") == F.col("rd")) & (F.col("f") == F.col("rf"))).dropDuplicates(["id"]).select("id", "text").mapInArrow(_full_sets(k), "id long, elements binary")
    sets = table(sets, "sets")
    links = table(_links(pairs, sets, percent), "links")
    found = components(links)

    comp = lambda c: found.select(F.col("u").alias(c), F.col("v").alias("comp"))
    placed = members.where("size > 2").join(comp("id"), "id", "left").select("band", "id", "size", F.coalesce("comp", "id").alias("comp"))
    mixed = table(placed.groupBy("band").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("band"), "mixed")
    blocks = F.greatest(F.ceil(F.col("size") / F.lit(BLOCK)), F.ceil(F.col("total") / F.lit(BLOCK_ELEMENTS))).cast("int")
    placed = placed.join(mixed, "band")
    weights = table(placed.join(classes.select("id", "n"), "id").groupBy("band").agg(F.sum("n").alias("total")), "weights")
    placed = placed.join(weights, "band").withColumn("blk", F.pmod(F.xxhash64("id"), blocks).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    placed = placed.select("band", "id", "comp", "blk", F.least("blk", "other").alias("i"), F.greatest("blk", "other").alias("j"))
    more = table(placed.join(sets, "id").groupBy("band", "i", "j").applyInArrow(_across(percent), "a long, b long").distinct(), "links")
    if not more.isEmpty():
        found = components(links.unionByName(more))
    top = classes.join(comp("id"), "id", "left").select("n", "s1", "s2", "rd", "rf", F.coalesce("comp", "id").alias("comp"))
    least = top.groupBy("comp").agg(F.min(F.struct("rd", "rf")).alias("r")).select("comp", F.col("r.rd").alias("component_id"), F.col("r.rf").alias("component_f"))
    top = top.join(least, "comp").select("n", "s1", "s2", "component_id", "component_f")
    out = sketches.select("d", "f", "n", "s1", "s2").join(top, ["n", "s1", "s2"], "left")
    return out.select("d", "f", F.col("n").alias("n_shingles"), F.coalesce("component_id", "d").alias("component_id"), F.coalesce("component_f", "f").alias("component_f"))


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_shingles, component_id, kept."""
    out = near_groups(docs, k, percent)
    return out.select(F.nullif("d", F.lit(NO_ID)).alias("doc_id"), "n_shingles", F.nullif("component_id", F.lit(NO_ID)).alias("component_id"), (F.col("d") == F.col("component_id")).alias("kept"))


def dedup_near(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """One row of ``docs`` for each component, with all its columns: one of its least doc_id and text hash."""
    groups = near_groups(docs, k, percent)
    least = (F.col("d") == F.col("component_id")) & (F.col("f") == F.col("component_f"))
    # Each (d, f) that goes, and those kept whose rows repeat, of which one stays.
    marked = table(groups.groupBy("d", "f").agg(F.max(~least).alias("gone"), ((F.max("n_shingles") > 0) & (F.count("*") > 1)).alias("repeated")).where("gone or repeated"), "marked")
    is_ = lambda m: (F.coalesce(docs["doc_id"], F.lit(NO_ID)) == m["d"]) & (F.xxhash64(docs["text"]) == m["f"])
    out = docs.join(marked, is_(marked), "left_anti")
    again = marked.where("not gone").select("d", "f")
    if again.isEmpty():
        return out
    rows = docs.join(again, is_(again))
    one = rows.groupBy(again["d"], again["f"]).agg(F.first(F.struct(*[docs[f"`{c}`"] for c in docs.columns])).alias("row"))
    return out.unionByName(one.select("row.*"))
