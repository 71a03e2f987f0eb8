"""Registry of named queries and their DuckDB oracle texts.

A query is ``fn(spark, sf_dir) -> DataFrame``.  Its oracle (when the operator
is SQL-expressible) is an ANSI SQL string over the driver tables, with the
fixture views inlined as CTEs.  Output columns carry the same names and types
in both; doubles are rounded so value hashes do not depend on summation order.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
ORACLES: dict[str, str] = {}
HEADLINE: list[str] = []


def query(key: str, sql: str | None = None, headline: bool = False):
    def deco(fn: QueryFn) -> QueryFn:
        if key in QUERIES:
            raise ValueError(f"duplicate query key {key}")

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            from ..session import configure
            return fn(configure(spark), sf_dir)

        run.__name__ = fn.__name__
        run.__doc__ = fn.__doc__
        QUERIES[key] = run
        if sql is not None:
            ORACLES[key] = sql
        if headline:
            HEADLINE.append(key)
        return fn
    return deco


def oracle(body: str, fixtures=(), doubles=(), others=(), ctes=(), digits: int = 6, recursive: bool = False) -> str:
    """Oracle text: fixture CTEs + extra CTEs, body wrapped in a rounding projection.

    ``others`` are output columns passed through, ``doubles`` are rounded.
    """
    from ..sources.fixtures import SQL
    parts = [f"{n} AS (\n{SQL[n]}\n)" for n in fixtures] + [f"{n} AS (\n{s}\n)" for n, s in ctes]
    kw = "WITH RECURSIVE " if recursive else "WITH "
    head = (kw + ",\n".join(parts) + "\n") if parts else ""
    sel = [f'"{c}"' for c in others] + [f'round(cast("{c}" AS double), {digits}) + 0.0 AS "{c}"' for c in doubles]
    return f"{head}SELECT {', '.join(sel)} FROM (\n{body}\n) AS q"


def load_all() -> None:
    # importing the modules fills the registry
    from . import analysis, extract, scans, training, truth  # noqa: F401
