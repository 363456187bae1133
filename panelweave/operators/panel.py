"""Joins that make panels: left, as-of and semi joins on (symbol, date)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.long_series import with_running


def left_panel(index: DataFrame, members: Sequence[DataFrame], keys: Sequence[str] = ("sym", "date")) -> DataFrame:
    """The index with the columns of each member; members must be unique on ``keys``, so no row is added."""
    out = index
    for m in members:
        out = out.join(m, list(keys), "left")
    return out


def asof_panel(index: DataFrame, member: DataFrame, by: str = "sym", on: str = "date", block_rows: int | None = None) -> DataFrame:
    """At each index row, the member's latest row of the same ``by`` with ``on`` not later.

    Both sides are stacked and the last member row is carried along, which takes one shuffle by ``by``
    and one sort, whatever the distance. Null keys match nothing: member rows with one are left out,
    index rows with one stay without a member. Of member rows that share their keys one is taken, the greatest. With
    ``block_rows``, symbols of more rows are spread over tasks. A filter on ``on`` belongs on the index side only.
    """
    values = [c for c in member.columns if c not in (by, on)]
    own = [c for c in index.columns if c not in (by, on)]
    left = index.select(F.col(by), F.col(on), F.lit(1).alias("__side"), F.struct(F.lit(1).alias("__"), *own).alias("__row"), F.lit(None).alias("__m"))
    keyed = member.where(F.col(by).isNotNull() & F.col(on).isNotNull())
    packed = keyed.select(F.col(by), F.col(on), F.lit(0).alias("__side"), F.lit(None).alias("__row"), F.struct(F.lit(1).alias("__"), *values).alias("__m"))
    stacked = left.unionByName(packed)
    tie = ["__side", "__m"] if _sortable(member, values) else ["__side"]
    carried = with_running(stacked, {}, {"__last": F.col("__m")}, by, on, tie, block_rows).where("__side = 1")
    known = F.col(by).isNotNull() & F.col(on).isNotNull()
    cols = {c: F.col(f"__row.{c}").alias(c) for c in own} | {by: F.col(by), on: F.col(on)}
    return carried.select(*(cols[c] for c in index.columns), *(F.when(known, F.col(f"__last.{c}")).alias(c) for c in values))


def _sortable(df: DataFrame, columns: Sequence[str]) -> bool:
    return not any("map<" in t or "variant" in t for c, t in df.dtypes if c in columns)


def panel(index: DataFrame, members: Mapping[str, tuple[DataFrame, str]], keys: Sequence[str] = ("sym", "date"), block_rows: int | None = None) -> DataFrame:
    """The index joined to named members, each "left" or "asof". Columns: the index's, then each member's in order.

    A name that two members share is an error; a member's column that the index has is left out.
    """
    taken: dict[str, str] = {}
    out = index
    for name, (m, how) in members.items():
        if missing := [k for k in keys if k not in m.columns]:
            raise ValueError(f"{name} has no {', '.join(missing)}")
        values = [c for c in m.columns if c not in keys and c not in index.columns]
        if clash := [c for c in values if c in taken]:
            raise ValueError(f"{', '.join(clash)} of {name} also in {taken[clash[0]]}")
        taken |= dict.fromkeys(values, name)
        m = m.select(*keys, *values)
        if how == "left":
            out = left_panel(out, [m], keys)
        elif how == "asof":
            out = asof_panel(out, m, keys[0], keys[1], block_rows)
        else:
            raise ValueError(f"{how} is no kind of join here")
    return out.select(*index.columns, *taken)


def join_spec(index: DataFrame, members: Mapping[str, DataFrame], keys: Sequence[str] | None = None, tool: Sequence[str] = ("optime",)) -> DataFrame:
    """Left joins where clashing names become column__table; keys default to the index's columns but for tool columns."""
    keys = list(keys or (c for c in index.columns if c not in tool))
    out = index.drop(*tool)
    for name, m in members.items():
        if missing := [k for k in keys if k not in m.columns]:
            raise ValueError(f"{name} has no {', '.join(missing)}")
        m = m.drop(*tool)
        m = m.withColumnsRenamed({c: f"{c}__{name}" for c in m.columns if c not in keys and c in out.columns})
        out = out.join(m, keys, "left")
    return out


def align_keys(df: DataFrame, *keys: str) -> DataFrame:
    """Timestamps with and without zone as plain timestamps, so that they can be compared."""
    return df.withColumns({k: F.col(k).cast("timestamp_ntz") for k in keys})


def sample(view: DataFrame, index: DataFrame, key_map: Mapping[str, str]) -> DataFrame:
    """The rows of ``view`` whose keys occur in ``index``; ``key_map`` names the index's column for each key."""
    keys = index.select(*(F.col(theirs).alias(ours) for ours, theirs in key_map.items())).distinct()
    return view.join(keys, list(key_map), "left_semi")


def in_scope(old: DataFrame, lo, hi, symbols: Sequence[str] | DataFrame | None, sym: str = "sym", date: str = "date") -> DataFrame:
    """Rows of the dates lo..hi and the symbols: a short list, a table of one column, or all (None)."""
    rows = old.where(F.col(date).between(F.lit(lo), F.lit(hi)))
    if isinstance(symbols, DataFrame):
        return rows.join(symbols.toDF(sym).distinct(), sym, "left_semi")
    return rows if symbols is None else rows.where(F.col(sym).isin(list(symbols)))


def outside_scope(old: DataFrame, lo, hi, symbols: Sequence[str] | DataFrame | None, sym: str = "sym", date: str = "date") -> DataFrame:
    """The rows that in_scope() leaves: a change of that scope does not touch them; null keys are outside."""
    inside = F.coalesce(F.col(date).between(F.lit(lo), F.lit(hi)), F.lit(False))
    if isinstance(symbols, DataFrame):
        return old.where(~inside).unionByName(old.where(inside).join(symbols.toDF(sym).distinct(), sym, "left_anti"))
    return old.where(~inside if symbols is None else ~F.coalesce(inside & F.col(sym).isin(list(symbols)), F.lit(False)))


def with_fields(base: DataFrame, fieldsets: Sequence[DataFrame], keys: Sequence[str] = ("sym", "date")) -> DataFrame:
    """Stored derived columns joined to their base, one fieldset after the other."""
    return left_panel(base, fieldsets, keys)


def attach_factor(view: DataFrame, factor: DataFrame, names: Mapping[str, str], keys: Sequence[str] = ("sym", "date"), predicate: str | None = None) -> DataFrame:
    """The base of a test: columns renamed (to returns, group, marketcap), the factor joined, sample = 1 or the predicate."""
    flag = F.lit(1) if predicate is None else F.coalesce(F.expr(predicate), F.lit(False)).cast("int")
    base = view.withColumn("sample", flag)
    base = base.select(*keys, "sample", *(F.col(c).alias(n) for c, n in names.items()))
    return base.join(factor, list(keys), "left")


def align_by_date(parts: Sequence[DataFrame], date: str = "date") -> DataFrame:
    """Result series side by side, matched by date."""
    out = parts[0]
    for p in parts[1:]:
        out = out.join(p, date, "full")
    return out
