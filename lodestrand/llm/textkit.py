"""Vectorised word hashing over Arrow string buffers.

Words are the runs ``[^\\x20\\x09-\\x0D]+``.  A word's 64-bit value is a sum of random byte codes times
powers of an odd base, finished by a bit mixer; word sequences are hashed by a second such polynomial
over word values, so that every window of L words costs one subtraction and one product.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
#: Bytes of text that are hashed at once: a worker holds some forty times that in arrays, which is little and fits its cache.
PIECE = 1 << 18

_rng = np.random.default_rng(20240607)
_CODES = _rng.integers(1, 2**63, 256, dtype=U) * U(2) + U(1)
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
WORD = (~SPACE).astype(np.uint8)
#: Letters and digits, with all bytes beyond ASCII; everything else separates.
ALNUM = np.array([bytes([b]).isalnum() or b > 127 for b in range(256)]).astype(np.uint8)
#: The same with runs of other printing characters as words of their own.
RUNS = np.where(ALNUM > 0, 1, np.where(SPACE, 0, 2)).astype(np.uint8)
_FOLD = np.arange(256)
_FOLD[65:91] += 32
_FOLDED = _CODES[_FOLD]
_BYTE_BASE = 0x9E3779B97F4A7C15 | 1
BASES = (0xD1342543DE82EF95 | 1, 0xA24BAED4963EE407 | 1)
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64; kept and grown per worker."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(1 << 16, 1 << (max(n, 1) - 1).bit_length())
        steps = np.full(size, base, U)
        steps[0] = 1
        have = _powers[base] = np.multiply.accumulate(steps)
    return have[:n]


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x ^ U(salt) if salt else x.copy()
    x ^= x >> U(30)
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def slices(batch: pa.RecordBatch, column: str, limit: int = PIECE) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that each part holds about ``limit`` bytes of text, or one row."""
    ends = np.asarray(pc.cumulative_sum(pc.fill_null(pc.binary_length(batch[column]), 0)).cast(pa.int64()))
    at = 0
    while at < batch.num_rows:
        done = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, done + limit, "right")))
        yield batch.slice(at, to - at)
        at = to


class Words:
    """The words of a string array's rows: byte spans, 64-bit values and the first word of each row."""

    def __init__(self, texts: pa.Array, fold: bool = False, kinds: np.ndarray | None = None):
        """kinds: a class for each byte; 0 separates words, and a word ends where the class changes."""
        if texts.null_count:
            texts = pc.fill_null(texts, "")
        if isinstance(texts, pa.ChunkedArray):
            texts = texts.combine_chunks()
        wide = pa.types.is_large_string(texts.type)
        _, offsets, data = texts.buffers()
        n = len(texts)
        off = np.frombuffer(offsets, np.int64 if wide else np.int32)[texts.offset : texts.offset + n + 1].astype(np.int64) if n else np.zeros(1, np.int64)
        self.bytes = d = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None else np.zeros(0, np.uint8)
        self.rows, self.off = n, off - off[0]
        kind = WORD[d] if kinds is None else kinds[d]
        edge = np.zeros(len(d) + 1, bool)
        edge[self.off] = True
        edge[1:-1] |= kind[1:] != kind[:-1]
        first, last = kind > 0, kind > 0
        first &= edge[:-1] if len(d) else first
        last &= edge[1:] if len(d) else last
        self.starts, self.ends = np.flatnonzero(first), np.flatnonzero(last) + 1
        self.first = np.searchsorted(self.starts, self.off)
        self.n = len(self.starts)
        codes = (_FOLDED if fold else _CODES).copy()
        codes[(WORD if kinds is None else kinds) == 0] = 0
        self.values = self._values(codes)

    def _values(self, codes: np.ndarray) -> np.ndarray:
        d, starts, out = self.bytes, self.starts, np.zeros(self.n, U)
        for p in range(0, len(d) if self.n else 0, PIECE):
            q = min(p + PIECE, len(d))
            a, b = np.searchsorted(starts, [p, q])
            ids = np.arange(a - (a > 0), b)
            if not len(ids):
                continue
            at = np.maximum(starts[ids], p)
            ahead = np.arange(at[0], q)
            offs = ahead - np.repeat(starts[ids], np.diff(np.append(at, q)))
            out[ids] += np.add.reduceat(codes[d[at[0] : q]] * powers(_BYTE_BASE, int(offs.max()) + 1)[offs], at - at[0])
        return mix(out + (self.ends - starts).astype(U) * U(0xC2B2AE3D27D4EB4F))

    def row_of(self) -> np.ndarray:
        return np.repeat(np.arange(self.rows), np.diff(self.first))

    def prefix(self, which: int = 0) -> np.ndarray:
        """Prefix sums from which gram() takes the hash of any span of words."""
        v = mix(self.values, 0x51ED270B * (which + 1))
        out = np.zeros(self.n + 1, U)
        np.cumsum(v * powers(BASES[which], self.n), out=out[1:])
        return out


def inverse(base: int) -> int:
    return pow(base, -1, 2**64)


def gram(prefix: np.ndarray, start: np.ndarray, length, which: int = 0) -> np.ndarray:
    """Hashes of the word spans [start, start + length)."""
    if not len(start):
        return np.zeros(0, U)
    low = prefix[start + length] - prefix[start]
    return mix(low * powers(inverse(BASES[which]), int(start.max()) + 1)[start], 0xA5A5A5A5 + which)


def signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))
