"""A bit filter of hashes, built by a distributed OR: a test for membership that lets a few others through."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrand.llm.textkit import U

#: log2 of the least and the most bits: 8 KB to 128 MB.
LEAST, MOST = 16, 30


def build(hashes: DataFrame, column: str) -> np.ndarray:
    """The filter of a written table's hashes, in 64-bit words, with about 16 bits for each row up to ``MOST``.

    What reaches the driver is at most the filter itself.
    """
    log = min(max((16 * hashes.count()).bit_length(), LEAST), MOST)
    first, second = F.expr(f"shiftrightunsigned({column}, {64 - log})"), F.expr(f"shiftrightunsigned({column}, 8) & {2**log - 1}L")
    spots = hashes.select(F.explode(F.array(first, second)).alias("p")).groupBy(F.expr("shiftright(p, 6)").alias("w"))
    found = spots.agg(F.bit_or(F.expr("shiftleft(1L, cast(p & 63 as int))")).alias("bits")).toArrow()
    out = np.zeros(2 ** (log - 6), U)
    out[found["w"].to_numpy()] = found["bits"].to_numpy().view(U)
    return out


def holds(words: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Whether both bits of each hash are set."""
    log = len(words).bit_length() + 5
    ok = np.ones(len(h), bool)
    for p in (h >> U(64 - log), (h >> U(8)) & U(2**log - 1)):
        ok &= (words[p >> U(6)] >> (p & U(63)) & U(1)).astype(bool)
    return ok
