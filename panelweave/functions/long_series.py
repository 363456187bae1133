"""Running values along symbols of any length, by a two-level scan.

A window by symbol gives each symbol to one task. Here a symbol of more than ``block_rows`` rows is cut at
approximate quantiles of its dates into blocks. Blocks are summed up apart, each gets what came before it
from a prefix over the few summaries of its symbol, and finishes on its own. The rows are shuffled once, by symbol and block;
symbols that are short stay whole and meet no summary.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Most blocks of a symbol; beyond, blocks grow.
MOST_BLOCKS = 2000
#: Summaries that are broadcast; beyond, they are joined by a shuffle.
BROADCAST_ROWS = 200_000
BLOCK, CUTS = "__block", "__cuts"


def long_symbols(df: DataFrame, sym: str, date: str, block_rows: int) -> tuple[DataFrame, int] | None:
    """(sym, cuts) of the symbols with more than ``block_rows`` rows, and how many cuts; None if there is no such symbol.

    Both passes add up in each task first, so a long symbol does not meet in one of them.
    """
    sizes = df.where(F.col(sym).isNotNull()).groupBy(sym).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") > block_rows)
    n, most = sizes.agg(F.count(F.lit(1)), F.max("__n")).first()
    if not n:
        return None
    pieces = min(MOST_BLOCKS, -(-most // block_rows))
    rows = df.select(sym, date)
    rows = rows.join(F.broadcast(sizes.select(sym)), sym, "left_semi") if n <= BROADCAST_ROWS else rows.join(sizes.select(sym), sym, "left_semi")
    at = [i / pieces for i in range(1, pieces)]
    return rows.groupBy(sym).agg(F.array_sort(F.array_distinct(F.percentile_approx(date, at, max(10_000, 20 * pieces)))).alias(CUTS)), n


def _block(date: str, pieces: int = MOST_BLOCKS) -> Column:
    """How many cuts are not later than the date, by two short looks: at every m-th cut, then at the m cuts from there on."""
    m = max(1, int(pieces**0.5))
    t, cuts = F.col(date), F.col(CUTS)
    heads = F.filter(cuts, lambda c, i: i % m == 0)
    reached = F.size(F.filter(heads, lambda c: c <= t))
    rest = F.slice(cuts, F.greatest((reached - 1) * m + 1, F.lit(1)), m)
    return F.when(cuts.isNull() | t.isNull() | (reached == 0), 0).otherwise((reached - 1) * m + F.size(F.filter(rest, lambda c: c <= t))).cast("int")


def blocked(df: DataFrame, sym: str, date: str, block_rows: int | None) -> tuple[DataFrame, bool]:
    """``df`` with its block, and whether any symbol has several."""
    found = long_symbols(df, sym, date, block_rows) if block_rows else None
    if found is None:
        return df.withColumn(BLOCK, F.lit(0)), False
    cuts, n = found
    rows = df.join(F.broadcast(cuts) if n <= BROADCAST_ROWS // 100 else cuts, sym, "left")
    return rows.withColumn(BLOCK, _block(date)).withColumn("__long", F.col(CUTS).isNotNull()).drop(CUTS), True


def with_running(df: DataFrame, sums: Mapping[str, Column] = {}, lasts: Mapping[str, Column] = {}, sym: str = "sym", date: str = "date", tie: Sequence[str] = (), block_rows: int | None = None) -> DataFrame:
    """``df`` with running sums and last non-null values from the symbol's first row to each row, in the order of date and ``tie``.

    Null adds nothing to a sum; before the first value both are null. Without ``block_rows`` this is the plain
    window, with it symbols of more rows than that are spread over tasks. Rows of one date and symbol stay together.
    """
    values = {f"__v_{n}": c for n, c in [*sums.items(), *lasts.items()]}
    rows, several = blocked(df.withColumns(values), sym, date, block_rows)
    w = Window.partitionBy(sym, BLOCK) if several else Window.partitionBy(sym)
    so_far = w.orderBy(date, *tie).rowsBetween(Window.unboundedPreceding, 0)
    here = {n: F.sum(f"__v_{n}").over(so_far) for n in sums} | {n: F.last(f"__v_{n}", ignorenulls=True).over(so_far) for n in lasts}
    if not several:
        return rows.withColumns(here).drop(BLOCK, *values)
    last = lambda v: F.max_by(F.col(v), F.when(F.col(v).isNotNull(), F.struct(F.col(date), *tie)))
    ends = rows.where("__long").groupBy(sym, BLOCK).agg(*(F.sum(f"__v_{n}").alias(f"__c_{n}") for n in sums), *(last(f"__v_{n}").alias(f"__c_{n}") for n in lasts))
    before = Window.partitionBy(sym).orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, -1)  # at most MOST_BLOCKS rows
    carry = ends.select(sym, BLOCK, *(F.sum(f"__c_{n}").over(before).alias(f"__c_{n}") for n in sums), *(F.last(f"__c_{n}", ignorenulls=True).over(before).alias(f"__c_{n}") for n in lasts))
    out = rows.withColumns(here).join(_small(carry), [sym, BLOCK], "left")
    whole = {n: F.coalesce(F.col(n) + F.col(f"__c_{n}"), F.col(n), F.col(f"__c_{n}")) for n in sums} | {n: F.coalesce(F.col(n), F.col(f"__c_{n}")) for n in lasts}
    return out.withColumns(whole).select(*df.columns, *sums, *lasts)


def _small(table: DataFrame) -> DataFrame:
    """Broadcast if it is counted to have few rows."""
    return F.broadcast(table) if table.count() <= BROADCAST_ROWS else table


def with_ahead(df: DataFrame, number: str, columns: Sequence[str], steps: Sequence[int], sym: str = "sym") -> DataFrame:
    """``df`` with ``{column}_{n}``, the columns' values n rows later, matched by the rows' running ``number``.

    Symbol and number together are dealt evenly, however long a symbol is: each row sends its values back to the rows that look at it.
    """
    back = df.select(F.col(sym), F.explode(F.array(*(F.struct((F.col(number) - n).alias(number), F.lit(n).alias("__n"), *columns) for n in steps))).alias("__b")).select(sym, "__b.*")
    ahead = back.groupBy(sym, number).agg(*(F.max(F.when(F.col("__n") == n, F.col(c))).alias(f"{c}_{n}") for n in steps for c in columns))
    ahead = ahead.withColumnsRenamed({sym: "__s", number: "__k"})
    return df.join(ahead, F.col(sym).eqNullSafe(F.col("__s")) & (F.col(number) == F.col("__k")), "left").drop("__s", "__k")
