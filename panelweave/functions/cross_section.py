"""Window functions over the rows of one date (or date and group)."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, WindowSpec, Window
from pyspark.sql import functions as F

DATE = ("date",)


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def section(by: Sequence[str] = DATE) -> WindowSpec:
    return Window.partitionBy(*by)


def in_sample(value: Column, sample: str = "sample") -> Column:
    """The value times the sample flag, so that rows outside the sample count as 0."""
    return value * F.col(sample)


def cs_calc(aggregate: Column, by: Sequence[str] = DATE) -> Column:
    """Any aggregate of the date, at each of its rows."""
    return aggregate.over(section(by))


def safe_corr(x: Column, y: Column, over: WindowSpec | None = None) -> Column:
    """Correlation of complete pairs as an aggregate, or over a window; null without variance."""
    both = x.isNotNull() & y.isNotNull()
    parts = F.covar_pop(x, y), F.stddev_pop(F.when(both, x)), F.stddev_pop(F.when(both, y))
    cov, sx, sy = (p.over(over) for p in parts) if over is not None else parts
    return F.try_divide(cov, sx * sy)


def cs_corr(x: Column | str, y: Column | str, by: Sequence[str] = DATE) -> Column:
    return safe_corr(_col(x), _col(y), section(by))


def cs_scale(x: Column | str, a: float = 1.0, by: Sequence[str] = DATE) -> Column:
    """Scaled so that the absolute values sum to ``a``."""
    x = _col(x)
    return F.try_divide(x * a, F.sum(F.abs(x)).over(section(by)))


def cs_zscore(x: Column | str, by: Sequence[str] = DATE) -> Column:
    x, w = _col(x), section(by)
    return F.try_divide(x - F.avg(x).over(w), F.stddev_samp(x).over(w))


def cs_minmax(x: Column | str, a: float = 0.0, b: float = 1.0, by: Sequence[str] = DATE) -> Column:
    x, w = _col(x), section(by)
    low, high = F.min(x).over(w), F.max(x).over(w)
    return a + F.try_divide((b - a) * (x - low), high - low)


def _clip(x: Column, low: Column, high: Column) -> Column:
    return F.when(x > high, high).when(x < low, low).otherwise(x)


def cs_3sigma(x: Column | str, by: Sequence[str] = DATE, width: float = 3.0) -> Column:
    x, w = _col(x), section(by)
    mean, sd = F.avg(x).over(w), F.stddev_samp(x).over(w)
    return _clip(x, mean - width * sd, mean + width * sd)


def cs_quantile(x: Column | str, q: float, by: Sequence[str] = DATE) -> Column:
    return F.percentile(_col(x), F.lit(q)).over(section(by))


def cs_winsorize(x: Column | str, low: float = 0.05, high: float = 0.95, by: Sequence[str] = DATE) -> Column:
    x = _col(x)
    return _clip(x, cs_quantile(x, low, by), cs_quantile(x, high, by))


def cs_indneutralize(x: Column | str, group: str, by: Sequence[str] = DATE) -> Column:
    """Standardised inside the group."""
    return cs_zscore(x, (group, *by))


def cs_capneutralize(x: Column | str, cap: Column | str, by: Sequence[str] = DATE) -> Column:
    """What a regression of ``x`` on ``cap`` with intercept leaves over."""
    x, cap, w = _col(x), _col(cap), section(by)
    return x - (F.regr_intercept(x, cap).over(w) + F.regr_slope(x, cap).over(w) * cap)


def cs_rank(x: Column | str, by: Sequence[str] = DATE) -> Column:
    """Dense rank scaled to 0..1; null where there is one value only."""
    x = _col(x)
    dense = F.when(x.isNotNull(), F.dense_rank().over(section(by).orderBy(x.asc_nulls_last())))
    return F.try_divide(dense - 1, F.max(dense).over(section(by)) - 1)


def rank_avg(x: Column | str, by: Sequence[str] = DATE) -> Column:
    """Rank from 1; equal values share the mean of their ranks; null ranks null."""
    x = _col(x)
    up = section(by).orderBy(x.asc_nulls_last())  # its default frame ends with the last equal value
    return F.when(x.isNotNull(), (F.rank().over(up) + F.count(x).over(up)) / 2.0)


def ds_rank(x: Column | str, by: Sequence[str] = DATE) -> Column:
    """Average rank as a share of the non-null count plus one."""
    x = _col(x)
    return rank_avg(x, by) / (F.count(x).over(section(by)) + 1)


def bucket(x: Column | str, q: int = 5, by: Sequence[str] = DATE) -> Column:
    """Quantile bucket 1..q by the share of the average rank; null stays null."""
    x = _col(x)
    share = rank_avg(x, by) / F.count(x).over(section(by))
    return F.when(x.isNotNull(), F.least(F.greatest(F.ceil(F.round(share * q, 9)), F.lit(1)), F.lit(q)).cast("int"))


def cs_qcut(x: Column | str, q: int = 5, by: Sequence[str] = DATE) -> Column:
    """Bin 1..q by cut points at the quantiles; equal cuts leave bins empty."""
    x = _col(x)
    cuts = [cs_quantile(x, i / q, by) for i in range(1, q)]
    return F.when(x.isNotNull(), reduce(lambda a, b: a + b, [(x > c).cast("int") for c in cuts], F.lit(1)))


def demean(x: Column | str, by: Sequence[str] = DATE) -> Column:
    x = _col(x)
    return x - F.avg(x).over(section(by))


# Acklam's rational approximation of the inverse normal distribution.
_TAIL_TOP = (-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00, -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00)
_TAIL_BOTTOM = (7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00, 3.754408661907416e00, 1.0)
_MID_TOP = (-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02, 1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00)
_MID_BOTTOM = (-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02, 6.680131188771972e01, -1.328068155288572e01, 1.0)
_BREAK = 0.02425


def _polynomial(coefficients: Sequence[float], z: Column) -> Column:
    return reduce(lambda value, c: value * z + c, coefficients[1:], F.lit(coefficients[0]))


def rank_to_normal(p: Column | str) -> Column:
    """The normal quantile of a share between 0 and 1; null outside."""
    p = _col(p)
    tail = lambda share: _polynomial(_TAIL_TOP, F.sqrt(-2 * F.log(share))) / _polynomial(_TAIL_BOTTOM, F.sqrt(-2 * F.log(share)))
    q = p - 0.5
    middle = _polynomial(_MID_TOP, q * q) * q / _polynomial(_MID_BOTTOM, q * q)
    return F.when((p > 0) & (p < _BREAK), tail(p)).when((p >= _BREAK) & (p <= 1 - _BREAK), middle).when((p > 1 - _BREAK) & (p < 1), -tail(1 - p))
