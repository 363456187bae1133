"""Filters, projections, formulas."""

from __future__ import annotations

import datetime as dt
import re
from collections.abc import Callable, Mapping, Sequence
from functools import reduce
from operator import and_

from pyspark.errors import AnalysisException, ParseException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_WORD = re.compile(r"[^\W\d]\w*")


def range_filter(df: DataFrame, condition: str) -> DataFrame:
    """Rows for which a SQL condition such as ``DATE'1995-01-01' <= d AND d < DATE'1996-01-01'`` holds."""
    return df.where(F.expr(condition))


def filter_all(df: DataFrame, conditions: Sequence[Mapping]) -> DataFrame:
    """All of {field, op, value}; an empty or null value sets no condition."""
    compare: dict[str, Callable[[Column, object], Column]] = {
        "eq": lambda c, v: c == v, "neq": lambda c, v: c != v, "gt": lambda c, v: c > v, "gte": lambda c, v: c >= v, "lt": lambda c, v: c < v, "lte": lambda c, v: c <= v,
    }
    tests = [compare[x["op"]](F.col(x["field"]), F.lit(x["value"])) for x in conditions if x["value"] not in (None, "")]
    return df.where(reduce(and_, tests)) if tests else df


def exclude_tool(df: DataFrame, tool: Sequence[str] = ("optime",)) -> DataFrame:
    return df.drop(*tool)


def derive(df: DataFrame, keys: Sequence[str], formulas: Mapping[str, str], validated: Sequence[str] | None = None) -> DataFrame:
    """Keys and one column for each formula; with ``validated``, only of the fields named there."""
    return df.select(*keys, *(F.expr(f).alias(n) for n, f in formulas.items() if validated is None or n in validated))


def preview_formula(df: DataFrame, formula: str) -> DataFrame:
    return df.select(F.expr(formula).alias("field"))


def check_formula(df: DataFrame, formula: str) -> bool:
    """Whether the formula gives one value for each row: aggregates and generators do not, unknown names neither.

    Beside all columns an aggregate is no valid selection, nor is a generator inside another expression.
    """
    try:
        return bool(df.select("*", F.struct(F.expr(formula).alias("field")).alias("__field")).columns)
    except (AnalysisException, ParseException):
        return False


def formula_refs(formula: str, columns: Sequence[str]) -> list[str]:
    """The columns that a formula names, in the order of their first use."""
    return [w for w in dict.fromkeys(_WORD.findall(formula)) if w in set(columns)]


def batch_formulas(df: DataFrame, keys: Sequence[str], formulas: Mapping[str, str]) -> DataFrame:
    """Many formulas in one projection over one scan of the columns they use."""
    used = dict.fromkeys(c for f in formulas.values() for c in formula_refs(f, df.columns))
    return derive(df.select(*dict.fromkeys([*keys, *used])), keys, formulas)


def sample_by_formula(df: DataFrame, condition: str | None) -> DataFrame:
    return df.where(F.expr(condition)) if condition else df


def scope_filter(df: DataFrame, lo: dt.date, hi: dt.date, symbols: Sequence[str] | DataFrame | None, sym: str = "sym", date: str = "date") -> DataFrame:
    """Dates lo..hi and the given symbols; a DataFrame of symbols (one column) is semi-joined."""
    out = df.where(F.col(date).between(F.lit(lo), F.lit(hi)))
    if isinstance(symbols, DataFrame):
        return out.join(symbols.toDF(sym).distinct(), sym, "left_semi")
    return out if symbols is None else out.where(F.col(sym).isin(list(symbols)))


def drop_any_null(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.dropna("any", subset=list(cols))


def drop_all_null(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.dropna("all", subset=list(cols))


def user_transform(df: DataFrame, field: str, fn: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """A user's function over the data set; its result must have the field and at least one row."""
    out = df.transform(fn)
    if field not in out.columns:
        raise ValueError(f"the result has no column {field}")
    if not out.take(1):
        raise ValueError("the result has no rows")
    return out


def require_fields(df: DataFrame, fields: Sequence[str]) -> DataFrame:
    if missing := [f for f in fields if f not in df.columns]:
        raise ValueError(f"missing: {', '.join(missing)}")
    return df


def sort_by(df: DataFrame, order: Sequence[Mapping]) -> DataFrame:
    """Sorted by {field, desc}; nulls last both ways."""
    return df.orderBy(*(F.col(x["field"]).desc_nulls_last() if x.get("desc") else F.col(x["field"]).asc_nulls_last() for x in order))


def page(df: DataFrame, order: Sequence[Mapping], limit: int, offset: int = 0, count_total: bool = False) -> DataFrame:
    """Rows offset..offset+limit of a sorted table; the order must be total for stable pages.

    With ``count_total``, a column ``total`` says how many rows the table has before paging.
    """
    if not order:
        raise ValueError("a page needs an order")
    rows = sort_by(df, order).offset(offset).limit(limit)
    return rows.withColumn("total", F.lit(df.count()).cast("long")) if count_total else rows


def union_relaxed(parts: Sequence[DataFrame]) -> DataFrame:
    """Rows of all parts by name, a column's values in the narrowest type that holds those of all parts; missing columns are null.

    Numbers widen without loss where a type for both exists (decimal and long), else to double (long and float); dates
    and timestamps meet as timestamps. What meets a string becomes one, as do kinds that have nothing in common.
    """
    kinds: dict[str, list[str]] = {}
    for p in parts:
        for c, t in p.dtypes:
            if t not in kinds.setdefault(c, []):
                kinds[c].append(t)
    wide = {c: w for c, ts in kinds.items() if (w := _common_type(ts))}
    cast = [p.select(*(F.col(f"`{c}`").cast(wide[c]).alias(c) if c in wide else F.col(f"`{c}`") for c in p.columns)) for p in parts]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), cast)


_WHOLE = ("tinyint", "smallint", "int", "bigint")
_DIGITS = {"tinyint": 3, "smallint": 5, "int": 10, "bigint": 20}


def _common_type(types: Sequence[str]) -> str | None:
    """The type that columns of several types are cast to; None where they agree, or where Spark finds it itself (nested types)."""
    kinds = [t for t in types if t != "void"]
    if len(kinds) < 2 or any("<" in t for t in kinds):
        return None
    if all(t in _WHOLE for t in kinds):
        return max(kinds, key=_WHOLE.index)
    decimals = [tuple(map(int, t[8:-1].split(","))) for t in kinds if t.startswith("decimal")]
    if decimals and all(t in _WHOLE or t.startswith("decimal") for t in kinds):
        scale = max(s for _, s in decimals)
        whole = max([p - s for p, s in decimals] + [_DIGITS[t] for t in kinds if t in _WHOLE])
        return f"decimal({whole + scale},{scale})" if whole + scale <= 38 else "double"
    if all(t in ("float", "double", *_WHOLE) or t.startswith("decimal") for t in kinds):
        return "double"
    if all(t in ("date", "timestamp", "timestamp_ntz") for t in kinds):
        return "timestamp" if "timestamp" in kinds else "timestamp_ntz"
    return "string"
