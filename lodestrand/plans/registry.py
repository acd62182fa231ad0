"""All registered queries of the analytics engine, with the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lodestrand.shipping import ship

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


class Tables:
    """The tables of a folder, by name."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = ship(spark), sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")


def _wide(df: DataFrame) -> DataFrame:
    """Whole numbers as longs, whatever function made them."""
    return df.withColumns({c: df[c].cast("long") for c, kind in df.dtypes if kind in ("int", "smallint", "tinyint")})


def query(sql: str | None = None, longs: str = "") -> Callable:
    """Register a function of Tables under its own name; ``sql`` is the equivalent DuckDB query, if there is one.

    ``longs`` names the columns that SQL gives as shorter integers or huge ones.
    """

    def add(f: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        QUERIES[f.__name__] = lambda spark, sf_dir: _wide(f(Tables(spark, sf_dir)))
        if sql is not None:
            cast = ", ".join(f'"{c}"::BIGINT AS "{c}"' for c in longs.split())
            ORACLES[f.__name__] = f"SELECT * REPLACE ({cast}) FROM ({sql})" if cast else sql
        return f

    return add


from lodestrand.plans import queries_eval, queries_interval, queries_rank, queries_scalar, queries_stream, queries_text  # noqa: E402, F401, I001
from lodestrand.plans import queries_flow, queries_seams  # noqa: E402, F401
