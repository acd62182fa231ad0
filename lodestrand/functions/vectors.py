"""Vector expressions over array columns, evaluated in doubles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_column(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda acc, x: acc + x)


def dot(a: Column | str, b: Column | str) -> Column:
    return total(F.zip_with(as_column(a), as_column(b), lambda x, y: x.cast("double") * y.cast("double")))


def norm(a: Column | str) -> Column:
    return F.sqrt(dot(a, a))


def l2_normalise(a: Column | str, added: float = 1e-12, floor: float | None = None) -> Column:
    """Divide by the length; ``added`` is added to it, or ``floor`` is its least value."""
    size = F.greatest(norm(a), F.lit(floor)) if floor is not None else norm(a) + F.lit(added)
    return F.transform(as_column(a), lambda x: x.cast("double") / size)


def cosine(a: Column | str, b: Column | str) -> Column:
    return dot(a, b) / (norm(a) * norm(b))


def sigmoid(x: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-x))


def sign_bits(a: Column | str, n: int = 63) -> Column:
    """A non-negative long whose bits, first one highest, tell which of the first n entries are positive."""
    return F.aggregate(F.slice(as_column(a), 1, n), F.lit(0).cast("long"), lambda acc, x: acc * 2 + F.when(x > 0, 1).otherwise(0).cast("long"))


def hamming(a: Column | str, b: Column | str) -> Column:
    return F.bit_count(as_column(a).bitwiseXOR(as_column(b)))


def mean_vector(vectors: Column | str, size: int) -> Column:
    """Element-wise mean of an array of vectors."""
    v = as_column(vectors)
    return F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: total(F.transform(v, lambda x: F.get(x, i).cast("double"))) / F.size(v))


def token_windows(tokens: Column | str, length: int = 64, stride: int = 48) -> Column:
    """Overlapping windows of an array of tokens, the last one ending with it; a short array is one window."""
    t = as_column(tokens)
    last = F.greatest(F.ceil((F.size(t) - length) / stride), F.lit(0)).cast("int")
    return F.transform(F.sequence(F.lit(0), last), lambda i: F.slice(t, i * stride + 1, length))


def mean_unit_vector(vectors: Column | str, size: int) -> Column:
    """The mean of window vectors, brought to unit length again."""
    return l2_normalise(mean_vector(vectors, size), floor=1e-8, added=0.0)
