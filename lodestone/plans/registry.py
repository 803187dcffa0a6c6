"""Where the registered queries and their SQL are gathered."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    """Registers a function of (spark, sf_dir) by its name, with its SQL."""

    def add(f: Callable[[SparkSession, str], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            """Sums are exact decimals up to here; the result carries them as doubles, which all engines print alike."""
            out = f(spark, sf_dir)
            return out.withColumns({n: out[n].cast("double") for n, kind in out.dtypes if kind.startswith("decimal")})

        QUERIES[name or f.__name__] = run
        if sql:
            ORACLES[name or f.__name__] = sql
        return f

    return add
