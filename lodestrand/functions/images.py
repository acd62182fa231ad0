"""Perceptual hashes and colour histograms of images, vectorised over Arrow batches."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_SIDE, _LOW = 32, 8


def cosine_basis(n: int = _SIDE) -> np.ndarray:
    """Rows of the orthonormal DCT-II."""
    k, x = np.arange(n)[:, None], np.arange(n)[None, :]
    basis = np.sqrt(2.0 / n) * np.cos(np.pi * (2 * x + 1) * k / (2 * n))
    basis[0] = np.sqrt(1.0 / n)
    return basis


def grey_square(image: np.ndarray) -> np.ndarray:
    """Luma of a (height, width, 3) image as means of 32 x 32 boxes."""
    luma = image[..., :3].astype(np.float64) @ np.array([0.299, 0.587, 0.114])
    for axis in (0, 1):
        # Boxes begin and end at whole pixels, so they don't overlap; in a small image one has a pixel at least.
        edges = np.arange(_SIDE + 1) * luma.shape[axis] // _SIDE
        low, high = edges[:-1], np.maximum(edges[1:], edges[:-1] + 1)
        sums = np.concatenate([np.zeros_like(luma.take([0], axis)), np.cumsum(luma, axis)], axis)
        luma = (sums.take(high, axis) - sums.take(low, axis)) / (high - low).reshape([-1 if a == axis else 1 for a in (0, 1)])
    return luma


def perceptual_hash(image: np.ndarray) -> int:
    """63 bits: which of the 8 x 8 lowest coefficients but the first exceed their median, first one highest."""
    b = cosine_basis()
    low = (b @ grey_square(image) @ b.T)[:_LOW, :_LOW].ravel()[1:]
    out = 0
    for bit in low > np.median(low):
        out = out << 1 | int(bit)
    return out


def decode_base64(text: Column | str) -> Column:
    """The bytes of a base64 string, with or without a ``data:`` header; null if it isn't one."""
    body = F.regexp_replace(F.col(text) if isinstance(text, str) else text, r"(?s)^data:[^,]*,", "")
    return F.try_to_binary(body, F.lit("base64"))


@F.pandas_udf(T.LongType())
def phash(data: pd.Series, width: pd.Series, height: pd.Series) -> pd.Series:
    """Hash of raw RGB bytes; null if they don't fill the size."""
    out = []
    for d, w, h in zip(data, width, height, strict=True):
        ok = d is not None and w and h and len(d) == w * h * 3
        out.append(perceptual_hash(np.frombuffer(d, np.uint8).reshape(int(h), int(w), 3)) if ok else None)
    return pd.Series(out, dtype="Int64")


def colour_histogram(image: np.ndarray) -> np.ndarray:
    """512 bins of the three highest bits of each colour, scaled to unit length."""
    top = (image[..., :3] >> 5).astype(np.int64)
    bins = np.bincount((top[..., 0] << 6 | top[..., 1] << 3 | top[..., 2]).ravel(), minlength=512).astype(np.float64)
    return bins / max(np.linalg.norm(bins), 1e-12)


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def histogram(data: pd.Series, width: pd.Series, height: pd.Series) -> pd.Series:
    # Arrays, not lists: a number of a list is an object of its own.
    return pd.Series([None if d is None else colour_histogram(np.frombuffer(d, np.uint8).reshape(int(h), int(w), 3)) for d, w, h in zip(data, width, height, strict=True)])
