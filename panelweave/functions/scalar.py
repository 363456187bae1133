"""Row-wise functions, null filling and building blocks of formulas."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .cross_section import _col, section
from .time_series import ts_sum


def signpow(x: Column | str, a: float) -> Column:
    x = _col(x)
    return F.signum(x) * F.pow(F.abs(x), F.lit(a))


def when_then(condition: Column, x: Column, y: Column) -> Column:
    """x where the condition holds, y where it does not or is null."""
    return F.when(condition, x).otherwise(y)


def min_of(x: Column | str, y: Column | str) -> Column:
    return when_then(_col(x) < _col(y), _col(x), _col(y))


def max_of(x: Column | str, y: Column | str) -> Column:
    return when_then(_col(x) > _col(y), _col(x), _col(y))


def log_market_cap(tv: Column | str) -> Column:
    return F.log(F.greatest(_col(tv), F.lit(1e-12)))


def book_to_price(pb: Column | str) -> Column:
    return F.try_divide(F.lit(1.0), _col(pb))


def iso_date(text: Column | str) -> Column:
    """The date of a text that begins with yyyy-MM-dd; null if it does not."""
    return F.try_to_date(prefix(text, 10), "yyyy-MM-dd")


def date_text(date: Column | str) -> Column:
    return F.date_format(_col(date), "yyyy-MM-dd")


def prefix(text: Column | str, n: int) -> Column:
    return F.substring(_col(text), 1, n)


def split_part(text: Column | str, mark: str, i: int) -> Column:
    """The i-th part, from 0, between marks taken literally; null beyond the last."""
    return F.get(F.split(_col(text), re.escape(mark)), i)


def fill_const(x: Column | str, value: float) -> Column:
    return F.coalesce(_col(x), F.lit(value))


def keep_null(x: Column | str) -> Column:
    return _col(x)


def fill_cs(x: Column | str, how: str, by: Sequence[str] = ("date",)) -> Column:
    """Fill with the mean or median of the row's section; for the group form, name the group in ``by``."""
    x = _col(x)
    if how == "mean":
        return F.coalesce(x, F.avg(x).over(section(by)))
    if how == "median":
        return F.coalesce(x, F.percentile(x, F.lit(0.5)).over(section(by)))
    raise ValueError(f"cannot fill with {how}")


def fill_mode(df: DataFrame, column: str, by: Sequence[str] = ("date",)) -> DataFrame:
    """Fill with the mean of the most frequent values of the section."""
    counts = df.where(F.col(column).isNotNull()).groupBy(*by, column).agg(F.count(F.lit(1)).alias("__n"))
    most = counts.groupBy(*by).agg(F.max("__n").alias("__most"))
    modes = counts.join(most, list(by)).where("__n = __most").groupBy(*by).agg(F.avg(column).alias("__mode"))
    return df.join(modes, list(by), "left").withColumn(column, F.coalesce(column, "__mode")).drop("__mode")


def is_sample(listed: str = "i", status: str = "s", special: str = "st", ex_i: int = 22, ex_s: int = 30, ex_st: int = 252) -> Column:
    """Listed long enough, suspended on 10 of the last days at most, and without special treatment lately."""
    suspended = ts_sum((F.col(status) == "S").cast("int"), ex_s) > 10
    treated = ts_sum(F.col(special).cast("int"), ex_st) > 0
    return ~((F.col(listed) < ex_i) | F.coalesce(suspended, F.lit(False)) | F.coalesce(treated, F.lit(False)))
