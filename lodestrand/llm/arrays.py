"""Array expressions whose cost is in proportion to the array's length."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

_CHUNK, _PIECE = 256, 4096


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body (or a lambda in it) refers to it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def running_before(values: Column, plus: Callable[[Column, Column], Column]) -> Column:
    """array<bigint>: for each element what ``plus`` makes of 0 and the elements before it.

    Elements are appended in chunks and chunks to the whole, since appending copies what is there.
    """
    none = F.array().cast("array<bigint>")

    def of(v: Column) -> Column:
        def step(acc: Column, x: Column) -> Column:
            return F.struct(plus(acc["at"], x).alias("at"), F.array_append(acc["out"], acc["at"]).alias("out"))

        def chunk(acc: Column, c: Column) -> Column:
            done = F.aggregate(F.slice(v, c * _CHUNK + 1, F.lit(_CHUNK)), F.struct(acc["at"].alias("at"), none.alias("out")), step)
            return let(done, lambda d: F.struct(d["at"].alias("at"), F.array_append(acc["out"], d["out"]).alias("out")))

        start = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast("array<array<bigint>>").alias("out"))
        chunks = F.sequence(F.lit(0), F.call_function("div", F.size(v) - 1, F.lit(_CHUNK)).cast("int"))
        return F.when(F.size(v) > 0, F.flatten(F.aggregate(chunks, start, chunk, lambda acc: acc["out"]))).otherwise(none)

    return let(F.transform(values, lambda x: x.cast("bigint")), of)


def sums_before(values: Column) -> Column:
    """array<bigint>: for each element the sum of those before it."""
    return running_before(values, lambda a, x: a + x)


def cuts(text: Column, spans: Column, body: Callable[[Column, Column], Column]) -> Column:
    """``body`` of each span (with start and end, in code points) and the text in it, which is looked for in its piece of the text only."""

    def of(x: Column) -> Column:
        def cut(s: Column) -> Column:
            first = F.call_function("div", s["start"], F.lit(_PIECE)).cast("int")
            last = F.call_function("div", F.greatest(s["end"] - 1, s["start"]), F.lit(_PIECE)).cast("int")
            near = F.array_join(F.slice(x["pieces"], first + 1, last - first + 1), "")
            return body(s, F.substring(near, (s["start"] - first * _PIECE + 1).cast("int"), (s["end"] - s["start"]).cast("int")))

        return F.transform(x["spans"], cut)

    return let(F.struct(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{_PIECE}}}"), F.lit(0)).alias("pieces"), spans.alias("spans")), of)
