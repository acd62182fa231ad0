"""Where models plug in.  A seam is a function from a DataFrame to a DataFrame; the defaults need no model.

An absent model only turns its source off: ``available`` drops it from the weights before a plan is built.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def hashed_embedding(text: str, dims: int = 64) -> list[float]:
    """A deterministic stand-in: signed counts of hashed words, unit length; lower-cased."""
    import zlib

    v = np.zeros(dims)
    for w in (text or "").lower().split():
        h = zlib.crc32(w.encode())
        v[h % dims] += 1 if h >> 31 else -1
    return (v / (np.linalg.norm(v) + 1e-12)).tolist()


def text_embedder(encode: Callable[[list[str]], list[list[float]]] | None = None) -> Callable[[Column], Column]:
    """An iterator pandas UDF around a batch encoder; what it closes over is loaded once for each worker."""

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def embed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(encode(texts.tolist()) if encode else [hashed_embedding(t) for t in texts])

    return embed


def mapped(rows: DataFrame, f: Callable[[dict], list[dict]], schema: str, key: str = "video_id") -> DataFrame:
    """A table function over rows (a transcriber, a reader of screens): each row's outcome and its errors as rows.

    ``schema`` lists the fields that f returns; key, status and error are added, and a row that fails is one row.
    """
    names = [c.strip().split(" ")[0] for c in schema.split(",")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for row in batch.to_dict("records"):
                try:
                    got = f(row)
                    out += [{key: row[key], **r, "status": "done", "error": None} for r in got]
                except Exception as x:  # a failed row is recorded, the others go on
                    out.append({key: row[key], "status": "failed", "error": f"{type(x).__name__}: {x}"})
            yield pd.DataFrame(out, columns=[key, *names, "status", "error"])

    return rows.mapInPandas(run, f"{key} string, {schema}, status string, error string")


def retried(f: Callable, tries: int = 3, pauses: tuple[float, ...] = (0.5, 1.0, 2.0)) -> Callable:
    """f again after a pause when it fails, the last error raised."""

    def run(*args):
        import time

        for i in range(tries):
            try:
                return f(*args)
            except Exception:
                if i + 1 == tries:
                    raise
                time.sleep(pauses[min(i, len(pauses) - 1)])

    return run


@dataclass
class Models:
    """The models of a deployment; None is absent."""

    embedders: dict[str, Callable[[Column], Column] | None] = field(default_factory=lambda: {"siglip": text_embedder(), "jina": text_embedder()})
    expand: Callable[[str], str | None] | None = None
    answer: Callable[[Column, Column], Column] | None = None

    def available(self, weights: dict[str, float]) -> dict[str, float]:
        return {s: w for s, w in weights.items() if s not in self.embedders or self.embedders[s] is not None}

    def expanded(self, query: str) -> str:
        """The expanded query, or the query itself when there is no expander or it fails."""
        try:
            return (self.expand and self.expand(query)) or query
        except Exception:
            return query


def query_expander(expand: Callable[[str], str | None] | None) -> Callable[[Column], Column]:
    """Queries as an expander rewrites them; a blank one, one that it has nothing for or fails on stays as it is."""
    models = Models(embedders={}, expand=expand)

    @F.pandas_udf(T.StringType())
    def rewritten(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield texts.map(lambda q: models.expanded(q) if isinstance(q, str) and q.strip() else q).astype(object)

    return rewritten


def stub_expand(query: str) -> str | None:
    """A stand-in for an expander, which fails for some queries and has nothing for others."""
    if query.startswith("a"):
        raise ValueError("no expansion")
    return f"{query} scene" if len(query) % 2 == 0 else None


def stub_answer(images: Column, prompt: Column) -> Column:
    """The letter of the option chosen by the prompt's hash: a deterministic stand-in for a model."""
    return F.concat(F.lit("Answer: "), F.char(F.pmod(F.xxhash64(prompt), F.lit(4)) + 65))
