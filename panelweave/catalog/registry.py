"""Registered queries with their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..fixtures import FXE_SQL, FXS_SQL, event_panel, supplier_panel

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
S = f"WITH s AS ({FXS_SQL})"
E = f"WITH e AS ({FXE_SQL})"


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def put(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql:
            SQL[name] = sql
        return fn

    return put


def _nudge(digits: int) -> float:
    """Far above the noise of double sums and far below the last digit kept: it moves exact halves off the edge where rounding turns."""
    return 1.7320508075 * 10.0 ** -(digits + 3)


def r(sql: str, digits: int = 8) -> str:
    return f"ROUND(({sql}) + {_nudge(digits)!r}, {digits})"


def rounded(df: DataFrame, digits: int = 8) -> DataFrame:
    """Doubles rounded, so that two engines' sums in different orders agree; adding 0 takes the sign from a zero."""
    return df.select(*((F.round(F.col(c) + _nudge(digits), digits) + 0.0).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


def rounded_sql(sql: str, doubles: str, rest: str = "", digits: int = 8) -> str:
    """The query ``sql`` with its columns ``doubles`` rounded alike and ``rest`` as they are."""
    cols = [*rest.split(), *(f"{r(c, digits)} AS {c}" for c in doubles.split())]
    head, _, tail = sql.rpartition("\nFINALLY ")
    return f"{head} SELECT {', '.join(cols)} FROM ({tail})" if head else f"SELECT {', '.join(cols)} FROM ({sql})"


def column(name: str, value: Callable[[], Column], sql: str, windows: str = "", source: str = "", panel: str = "s", digits: int = 8) -> None:
    """A query that adds one column ``v`` to a panel."""
    load, prefix = (supplier_panel, S) if panel == "s" else (event_panel, E)

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return rounded(load(spark, sf_dir).select("sym", "date", value().cast("double").alias("v")), digits)

    QUERIES[name] = run
    SQL[name] = f"{prefix} SELECT sym, date, {r(sql, digits)} AS v FROM {source or panel} {windows}"
