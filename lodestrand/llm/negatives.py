"""Hard-negative mining over a vector-approximation file.

Vectors are made of whole numbers, floor(scale * component), and a score is their inner product.  The approximation
file holds a one-byte cell for every component: each dimension is cut into ``CELLS`` cells of about equal numbers of
rows, from counts over all rows, and a table gives each cell's least and greatest number.  For a block of anchors, a
row's codes are looked up in that table, and the products with the cells' middles and half widths give a lower and an
upper bound of each score.  Only pairs whose bounds let them into a result are scored exactly:

  1. positives: an anchor's best rows of its label; a row whose upper bound is under the anchor's k-th best score so
     far (or under the k-th greatest lower bound of the rows looked at) can't be one;
  2. negatives: each positive's score opens a window [low %, high %] of it; a row of another label enters if its
     bounds meet a window and its upper bound isn't under the window's k-th best score so far.

All rows are dealt by hash into strips, all anchors into blocks, and each (strip, block) is one task's group of
bounded size, which hands on at most k rows for each anchor and window; the best of these are the result.  Neither
anchors nor rows pass through the driver or are broadcast, and rows with equal vectors, however many, are scored where
they are.  What grows with anchors x rows is the products alone.

Defined cases: rows with a null id, label or vector, or a null or non-finite component, take no part; shorter vectors
count as filled up with zeros; whole numbers are held within 2**62 (scores must fit a long); rows that repeat an id
are rows of their own but no positives or negatives of anchors with that id, and an anchor's id that repeats is one
anchor, the row of least label, then vector; fewer rows than asked for give what there is; ties go to the smaller id;
other columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestrand.llm.scratch import table
from lodestrand.shipping import ship

CELLS = 64
#: Rows of a strip and anchors of a block, at most about; pairs that are bounded together, and scored together.
STRIP, BLOCK, LOOKED, PAIRS = 1 << 17, 1 << 12, 1 << 21, 1 << 15
#: Classes of whole numbers that are counted: one each up to 2**9, then 2**8 for each doubling.
_FINE = 9
_HELD = 2.0**62


def _classes(v: np.ndarray) -> np.ndarray:
    """The class of each number; classes rise with the numbers."""
    m = np.abs(v)
    octave = np.maximum(np.frexp(m.astype(np.float64))[1] - _FINE, 0)
    c = (octave << (_FINE - 1)) + (m >> octave)
    return np.where(v < 0, -c, c)


def _bounds(c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The least and greatest number of each class."""
    a = np.abs(c).astype(np.int64)
    octave = np.maximum((a >> (_FINE - 1)) - 1, 0)
    low = (a - (octave << (_FINE - 1))) << octave
    high = low + (np.int64(1) << octave) - 1
    return np.where(c < 0, -high, low), np.where(c < 0, -low, high)


def whole_numbers(vectors: pa.Array, scale: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a list array: which rows take part, their numbers end to end, and how many each has."""
    size = np.asarray(vectors.value_lengths().fill_null(0)).astype(np.int64)
    flat = vectors.flatten()
    x = flat.to_numpy(zero_copy_only=False).astype(np.float64)
    bad = ~np.isfinite(x)
    row = np.repeat(np.arange(len(size)), size)
    ok = np.asarray(vectors.is_valid()) & (np.bincount(row[bad], minlength=len(size)) == 0)
    return ok, np.clip(np.floor(x[ok[row]] * scale), -_HELD, _HELD).astype(np.int64), size[ok]


def _square(values: np.ndarray, size: np.ndarray, dims: int) -> np.ndarray:
    out = np.zeros((len(size), dims), np.int64)
    row = np.repeat(np.arange(len(size)), size)
    out[row, np.arange(len(values)) - np.repeat(np.cumsum(size) - size, size)] = values
    return out


def _statistics(scale: float):
    """Counts of (dimension, class) of a partition; dimension -1 has the number of rows of each width."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[tuple[int, int], int] = {}
        for batch in batches:
            ok, values, size = whole_numbers(batch.column(0), scale)
            at = np.arange(len(values)) - np.repeat(np.cumsum(size) - size, size)
            keys = np.concatenate([np.column_stack([at, _classes(values)]), np.column_stack([np.full(len(size), -1), size])])
            for (d, c), n in zip(*[x.tolist() for x in np.unique(keys, axis=0, return_counts=True)], strict=True):
                seen[d, c] = seen.get((d, c), 0) + n
        d, c = zip(*seen, strict=True) if seen else ((), ())
        yield pa.record_batch([pa.array(d, pa.int32()), pa.array(c, pa.int64()), pa.array(list(seen.values()), pa.int64())], names=["dim", "class", "n"])

    return run


def cells(counts: list[tuple[int, int, int]], dims: int) -> tuple[np.ndarray, np.ndarray]:
    """The least and greatest number of each cell, a line for each dimension; cells hold about equally many rows."""
    rows = sum(n for d, _, n in counts if d < 0)
    low, high = np.zeros((dims, CELLS), np.int64), np.full((dims, CELLS), -1, np.int64)
    for d in range(dims):
        own = sorted((c, n) for x, c, n in counts if x == d)
        filled = sum(n for _, n in own)
        own = sorted({**dict(own), 0: dict(own).get(0, 0) + rows - filled}.items()) if filled < rows else own
        c, n = (np.array(x, np.int64) for x in zip(*own, strict=True))
        # A class belongs to the cell in which its first row falls.
        cell = np.unique((np.cumsum(n) - n) * CELLS // max(rows, 1), return_inverse=True)[1]
        lo, hi = _bounds(c)
        first = np.flatnonzero(np.diff(cell, prepend=-1))
        low[d, : len(first)], high[d, : len(first)] = lo[first], hi[np.append(first[1:], len(c)) - 1]
        low[d, len(first) :], high[d, len(first) :] = low[d, len(first) - 1], high[d, len(first) - 1]
    return low, high


def _approximate(scale: float, low: np.ndarray, high: np.ndarray):
    """(vec_id, label, codes, q): the approximation and the numbers of each row that takes part."""
    dims, kind = len(high), _kind(low, high)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok, values, size = whole_numbers(batch.column(2), scale)
            q = _square(values, size, dims)
            codes = np.empty(q.shape, np.uint8)
            for d in range(dims):
                codes[:, d] = np.minimum(np.searchsorted(high[d], q[:, d]), CELLS - 1)
            keep = pa.array(ok)
            yield pa.record_batch([batch.column(0).filter(keep), batch.column(1).filter(keep), _packed(codes), _packed(q.astype(kind))], names=["vec_id", "label", "codes", "q"])

    return run


def _kind(low: np.ndarray, high: np.ndarray):
    """The narrowest kind of whole number that holds all."""
    return np.promote_types(np.promote_types(np.min_scalar_type(int(low.min(initial=0))), np.min_scalar_type(int(high.max(initial=0)))), np.int16)


def _packed(x: np.ndarray) -> pa.Array:
    width = x.shape[1] * x.itemsize
    offsets = np.arange(len(x) + 1, dtype=np.int32) * np.int32(width)
    return pa.BinaryArray.from_buffers(pa.binary(), len(x), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(x).tobytes())])


def _matrix(a: pa.ChunkedArray, kind, dims: int) -> np.ndarray:
    return np.frombuffer(b"".join(x.as_buffer() for x in a), kind).reshape(len(a), dims)


class Block:
    """A block of anchors against the rows of a strip, looked at through their approximations."""

    def __init__(self, anchors: np.ndarray, low: np.ndarray, high: np.ndarray):
        self.a, self.middle, self.width = anchors, (low + high).astype(np.float64), (high - low).astype(np.float64)
        self.x, self.dims = anchors.astype(np.float64), np.arange(anchors.shape[1])
        size = np.abs(self.x).sum(1).max(initial=0) * max(np.abs(low).max(initial=0), np.abs(high).max(initial=0)).astype(np.float64)
        #: What rounding can take from a bound.
        self.slack = anchors.shape[1] * size * 2.0**-50
        self.pairs = self.scored = 0

    def bounds(self, codes: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Lower and upper bounds of the scores of rows (lines) and some anchors (columns), by table lookup."""
        middle, width = self.middle[self.dims, codes], self.width[self.dims, codes]
        x = self.x[which].T
        centre, reach = middle @ x, width @ np.abs(x)
        self.pairs += centre.size
        return (centre - reach) / 2 - self.slack, (centre + reach) / 2 + self.slack

    def score(self, q: np.ndarray, r: np.ndarray, c: np.ndarray) -> np.ndarray:
        """Exact scores of pairs (row r, anchor c)."""
        self.scored += len(r)
        out = np.empty(len(r), np.int64)
        for p in range(0, len(r), PAIRS):
            s = slice(p, p + PAIRS)
            out[s] = (q[r[s]] * self.a[c[s]]).sum(1)
        return out


def _merge(best: tuple[np.ndarray, ...], slot: np.ndarray, ids: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    """The k best (slot, id, score) of each slot: greater scores first, then smaller ids."""
    slot, ids, score = (np.concatenate(x) for x in zip(best, (slot, ids, score), strict=True))
    order = np.lexsort((ids, -score, slot))
    slot, ids, score = slot[order], ids[order], score[order]
    first = np.flatnonzero(np.diff(slot, prepend=-1))
    rank = np.arange(len(slot)) - np.repeat(first, np.diff(np.append(first, len(slot))))
    keep = rank < k
    return slot[keep], ids[keep], score[keep]


def _worst(best: tuple[np.ndarray, ...], slots: int, k: int) -> np.ndarray:
    """The k-th best score of each slot that has k, else the least number."""
    slot, _, score = best
    out = np.full(slots, np.iinfo(np.int64).min)
    last = np.flatnonzero(np.diff(slot, append=-1))
    full = np.bincount(slot, minlength=slots)[slot[last]] >= k
    out[slot[last][full]] = score[last][full]
    return out


_NONE = (np.zeros(0, np.int64),) * 3


def _steps(n: int, anchors: int) -> Iterator[tuple[int, int]]:
    """Few rows first, so that thresholds are known when most are looked at."""
    most = max(64, LOOKED // max(anchors, 1))
    at, step = 0, max(64, most // 8)
    while at < n:
        yield at, min(at + step, n)
        at, step = at + step, most


def best_of_label(block: Block, ids: np.ndarray, labels: np.ndarray, rows: tuple[np.ndarray, ...], k: int) -> tuple[np.ndarray, ...]:
    """(anchor's index, id, score): the k best rows with the anchor's label and another id."""
    vec_id, label, codes, q = rows
    best = _NONE
    for lab in np.unique(labels).tolist():
        mine, own = np.flatnonzero(labels == lab), np.flatnonzero(label == lab)
        for a, b in _steps(len(own), len(mine)):
            r = own[a:b]
            low, high = block.bounds(codes[r], mine)
            same = vec_id[r][:, None] == ids[mine][None, :]
            low[same], high[same] = -np.inf, -np.inf
            least = _worst(best, len(ids), k)[mine].astype(np.float64)
            if a == 0 and len(r) >= k:
                least = np.maximum(least, np.partition(low, len(r) - k, axis=0)[len(r) - k])
            x, c = np.nonzero((high >= least) & (high > -np.inf))
            best = _merge(best, mine[c], vec_id[r[x]], block.score(q, r[x], mine[c]), k)
    return best


def best_in_windows(block: Block, ids: np.ndarray, labels: np.ndarray, windows: np.ndarray, rows: tuple[np.ndarray, ...], k: int) -> tuple[np.ndarray, ...]:
    """(anchor's index, id, score) of rows with another label that are among the k best of some window [low, high] of the anchor."""
    vec_id, label, codes, q = rows
    m, many = windows.shape[:2]
    best, which = _NONE, np.arange(m)
    for a, b in _steps(len(vec_id), m):
        low, high = block.bounds(codes[a:b], which)
        least = np.maximum(windows[:, :, 0], _worst(best, m * many, k).reshape(m, many)).astype(np.float64)
        enters = np.zeros(low.shape, bool)
        for w in range(many):
            enters |= (high >= least[:, w]) & (low <= windows[:, w, 1])
        enters &= (label[a:b][:, None] != labels) & (vec_id[a:b][:, None] != ids)
        x, c = np.nonzero(enters)
        x += a
        score = block.score(q, x, c)
        inside = (score[:, None] >= windows[c, :, 0]) & (score[:, None] <= windows[c, :, 1])
        p, w = np.nonzero(inside)
        # Rows are in order of their ids, so that their numbers settle ties.
        best = _merge(best, c[p] * many + w, x[p], score[p], k)
    found = np.unique(np.column_stack([best[0] // many, best[1], best[2]]), axis=0)
    return found[:, 0], vec_id[found[:, 1]], found[:, 2]


def _rows(group: pa.Table, dims: int, kind) -> tuple[np.ndarray, ...]:
    group = group.sort_by("vec_id")
    return (*(group[c].to_numpy().astype(np.int64) for c in ("vec_id", "label")), _matrix(group["codes"], np.uint8, dims), _matrix(group["q"], kind, dims).astype(np.int64))


def _group(low: np.ndarray, high: np.ndarray, k: int, windows: bool):
    kind = _kind(low, high)

    def run(anchors: pa.Table, rows: pa.Table) -> pa.Table:
        found = _NONE
        if anchors.num_rows and rows.num_rows:
            dims = len(low)
            ids, labels = (anchors[c].to_numpy().astype(np.int64) for c in ("vec_id", "label"))
            block = Block(_matrix(anchors["q"], kind, dims).astype(np.int64), low, high)
            if windows:
                spans = np.array(anchors["windows"].to_pylist(), np.int64).reshape(len(ids), -1, 2)
                found = best_in_windows(block, ids, labels, spans, _rows(rows, dims, kind), k)
            else:
                found = best_of_label(block, ids, labels, _rows(rows, dims, kind), k)
            found = (ids[found[0]], found[1], found[2])
        return pa.table({c: pa.array(x, pa.int64()) for c, x in zip(("anchor_id", "vec_id", "score"), found, strict=True)})

    return run


def _met(anchors: DataFrame, rows: DataFrame, strips: int, blocks: int, run) -> DataFrame:
    """``run`` on each block of anchors with each strip of rows."""
    deal = lambda of: F.pmod(F.xxhash64("vec_id", F.lit(of)), F.lit(strips if of == "strip" else blocks)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    a = anchors.withColumn("block", deal("block")).withColumn("strip", every(strips))
    r = rows.withColumn("strip", deal("strip")).withColumn("block", every(blocks))
    return a.groupBy("block", "strip").cogroup(r.groupBy("block", "strip")).applyInArrow(run, "anchor_id long, vec_id long, score long")


def approximation(vectors: DataFrame, scale: float = 256.0, id: str = "vec_id", label: str = "label", vector: str = "embedding") -> tuple[DataFrame, np.ndarray, np.ndarray]:
    """The written approximation file (vec_id, label, codes, q) and its cells' least and greatest numbers."""
    ship(vectors.sparkSession)
    rows = vectors.select(F.col(id).cast("long").alias("vec_id"), F.col(label).cast("long").alias("label"), F.col(vector).cast("array<double>").alias("vector")).where("vec_id is not null and label is not null and vector is not null")
    # A row for each dimension and class of numbers, whatever the input.
    counts = rows.select("vector").mapInArrow(_statistics(scale), "dim int, class long, n long").groupBy("dim", "class").agg(F.sum("n").alias("n")).collect()
    dims = max([int(r["class"]) for r in counts if r["dim"] < 0], default=0)
    low, high = cells([tuple(r) for r in counts], dims)
    return table(rows.mapInArrow(_approximate(scale, low, high), "vec_id long, label long, codes binary, q binary"), "approximation"), low, high


def mine(
    vectors: DataFrame,
    anchors: Column,
    positives: int = 5,
    negatives: int = 10,
    window: tuple[int, int] = (30, 90),
    scale: float = 256.0,
    strip: int = STRIP,
    block: int = BLOCK,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    ``vectors``: vec_id, label, embedding; ``anchors``: a condition on vec_id.
    """
    rows, low, high = approximation(vectors, scale)
    spark = rows.sparkSession
    one = F.row_number().over(Window.partitionBy("vec_id").orderBy("label", "q"))
    asked = table(rows.where(anchors).withColumn("_n", one).where("_n = 1").select("vec_id", "label", "q"), "anchors")
    # At least two strips for each partition, so that they are dealt evenly.
    strips = max(-(-rows.count() // strip), 2 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    blocks = max(1, -(-asked.count() // block))
    order = lambda *by: F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("score"), "vec_id"))

    found = _met(asked, rows, strips, blocks, _group(low, high, positives, False))
    found = found.withColumn("rank", order("anchor_id")).where(F.col("rank") <= positives)
    found = table(found.select("anchor_id", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"), "rank"), "positives")
    # Whole numbers: the least score with low * positive <= 100 * score, and the greatest with 100 * score <= high * positive.
    part = lambda percent: F.col("positive_score").cast("decimal(20,0)") * percent / 100
    found = found.withColumn("lo", F.ceil(part(window[0])).cast("long")).withColumn("hi", F.floor(part(window[1])).cast("long"))
    spans = found.groupBy("anchor_id").agg(F.sort_array(F.collect_list(F.struct("rank", F.array("lo", "hi").alias("w")))).alias("s"))
    # An anchor with fewer positives repeats its last window.
    pad = lambda s: F.transform(F.sequence(F.lit(1), F.lit(positives)), lambda i: F.element_at(s, F.least(i, F.size(s)))["w"])
    spans = spans.select(F.col("anchor_id").alias("vec_id"), pad(F.col("s")).alias("windows"))
    asked = table(asked.join(spans, "vec_id"), "windows")
    near = _met(asked, rows, strips, blocks, _group(low, high, negatives, True))
    out = near.join(found, "anchor_id").where("score between lo and hi").withColumn("place", order("anchor_id", "positive_id", "rank"))
    return out.where(F.col("place") <= negatives).select(
        "anchor_id", "positive_id", F.col("place").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")
    )
