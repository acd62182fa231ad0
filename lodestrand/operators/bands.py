"""Banded self-similarity: each row of a series against those around it, by tiles.

A series is cut into tiles of places; each tile gets its own rows and a halo of ``window // 2`` places on either side, so
that a vector is shuffled once, and once more if it is in a neighbour's halo.  A tile is a few matrix products whose
diagonals are the band.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestrand.operators.vectorindex import matrix

#: Places whose products are made together.
ROWS = 256


def band(x: np.ndarray, reach: int) -> np.ndarray:
    """For each line but the first and last ``reach``: its products with the 2 * reach + 1 lines around it."""
    n = len(x) - 2 * reach
    out = np.empty((n, 2 * reach + 1))
    for a in range(0, n, ROWS):
        b = min(a + ROWS, n)
        s = x[a + reach : b + reach] @ x[a : b + 2 * reach].T
        step = s.strides
        out[a:b] = np.lib.stride_tricks.as_strided(s, (b - a, 2 * reach + 1), (step[0] + step[1], step[1]))
    return out


def self_similarity_bands(rows: DataFrame, by: list[str], at: str, vector: str, window: int = 101, tile: int = 2048, unit: bool = True) -> DataFrame:
    """by, at, band: for each row the products with the ``window`` (odd) places around its own, 0 where there is no row.

    Places are whole numbers, unique in a series; ``unit`` brings vectors to length 1 first.  A row without a vector
    is like a place without a row, but has a band of zeros itself.
    """
    if window % 2 == 0:
        raise ValueError("the window must be odd")
    reach = window // 2
    tile = max(tile, window)

    def run(key: tuple, group: pa.Table) -> pa.Table:
        base = key[-1].as_py() * tile - reach
        place = group["_at"].to_numpy() - base
        if len(np.unique(place)) < len(place):
            raise ValueError("two rows of a series have one place")
        there = np.flatnonzero(np.asarray(group["_v"].combine_chunks().is_valid()))
        own = np.flatnonzero((place >= reach) & (place < reach + tile))
        if not len(there):
            bands = np.zeros((len(own), window))
        else:
            low, high = place[own].min() if len(own) else reach, place[own].max() + 1 if len(own) else reach
            v = matrix(group["_v"].combine_chunks().take(pa.array(there)))
            if unit:
                norm = np.sqrt((v * v).sum(1))[:, None]
                v = np.divide(v, norm, out=np.zeros_like(v), where=norm > 0)
            x = np.zeros((tile + 2 * reach, v.shape[1]))
            x[place[there]] = v
            bands = band(x[low - reach : high + reach], reach)[place[own] - low]
        take = pa.array(own)
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(own) + 1) * window, pa.int32()), pa.array(bands.ravel()))
        return pa.table([*[group[c].combine_chunks().take(take) for c in (*by, at)], lists], names=[*by, at, "band"])

    place = F.col(at).cast("long")
    tiles = F.explode(F.sequence(F.floor((place - reach) / F.lit(tile)), F.floor((place + reach) / F.lit(tile))))
    dealt = rows.where(place.isNotNull()).select(*by, at, place.alias("_at"), F.col(vector).alias("_v"), tiles.alias("_tile"))
    schema = T.StructType([*[rows.schema[c] for c in (*by, at)], T.StructField("band", T.ArrayType(T.DoubleType()))])
    return dealt.groupBy(*by, "_tile").applyInArrow(run, schema)
