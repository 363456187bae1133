"""Window functions along the dates of one symbol. Rolling forms are null until the window has ``d`` non-null rows."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from .cross_section import _col, safe_corr
from .long_series import with_ahead, with_running

SYM, DATE = "sym", "date"


def series(sym: str = SYM, date: str = DATE) -> WindowSpec:
    return Window.partitionBy(sym).orderBy(date)


def rolling(aggregate: Callable[..., Column], args: Sequence[Column | str], d: int, least: int | None = None, w: WindowSpec | None = None) -> Column:
    """An aggregate of the last ``d`` rows, where at least ``least`` (all by default) have no null among ``args``."""
    frame = (w or series()).rowsBetween(-(d - 1), 0)
    cols = [_col(a) for a in args]
    whole = cols[0].isNotNull()
    for c in cols[1:]:
        whole = whole & c.isNotNull()
    return F.when(F.count(F.when(whole, 1)).over(frame) >= (d if least is None else least), aggregate(*cols, over=frame) if aggregate is safe_corr else aggregate(*cols).over(frame))


def ts_lag(x: Column | str, d: int, w: WindowSpec | None = None) -> Column:
    x, w = _col(x), w or series()
    return F.lag(x, d).over(w) if d >= 0 else F.lead(x, -d).over(w)


ts_shift = ts_lag


def ts_diff(x: Column | str, d: int, w: WindowSpec | None = None) -> Column:
    return _col(x) - ts_lag(x, d, w)


def ts_ret(c: Column | str, d: int, w: WindowSpec | None = None) -> Column:
    """Relative change over ``d`` rows; the coming one for negative ``d``."""
    return F.try_divide(_col(c), ts_lag(c, d, w)) - 1 if d > 0 else F.try_divide(ts_lag(c, d, w), _col(c)) - 1


def compound(r: Column | str, frame: WindowSpec) -> Column:
    """(1 + r) multiplied over a frame, minus 1; null adds nothing, and without any value it is null.

    A return of -1 is a total loss: the compound is -1 from there on, whatever follows. Below -1 (a loss beyond
    everything, as in long-short series) factors keep their sign.
    """
    r = _col(r)
    return _compounded(F.sum(_log_growth(r)).over(frame), F.sum((r == -1).cast("long")).over(frame), F.sum((r < -1).cast("long")).over(frame))


def _log_growth(r: Column) -> Column:
    return F.when(r > -1, F.log1p(r)).when(r < -1, F.log(-1 - r))


def _compounded(logs: Column, losses: Column, below: Column) -> Column:
    return F.when(losses > 0, -1.0).otherwise(F.exp(logs) * F.when(below % 2 == 1, -1).otherwise(1) - 1)


def ts_cret(r: Column | str, d: int, w: WindowSpec | None = None) -> Column:
    """Compound return of the last ``d`` rows, or of the next ``-d`` rows, none of which may be null."""
    r, w = _col(r), w or series()
    frame = w.rowsBetween(-(d - 1), 0) if d > 0 else w.rowsBetween(1, -d)
    return F.when(F.count(r).over(frame) == abs(d), compound(r, frame))


def settle(x: Column, digits: int) -> Column:
    """``x`` rounded so that what is equal but for noise becomes equal.

    The small offset takes exact halves, which sums and products of short decimals often are, off
    the edge where noise would decide.
    """
    return F.round(x + 1.7320508075 * 10.0 ** -(digits + 3), digits)


def fwd_returns(df: DataFrame, r: str, periods: Sequence[int], sym: str = SYM, date: str = DATE, digits: int | None = None, block_rows: int | None = None) -> DataFrame:
    """``df`` with d{n}: the compound return of the n rows after each row, from running sums.

    d{n} is null where the row's own return or that of the n-th row after it is null, and where there is no such row;
    a null between them counts as no change. It is -1 where a total loss lies among the n rows; after one, returns compound
    anew. Values are as computed; with ``digits`` they are settled. With ``block_rows``, symbols of more rows are spread over tasks.
    """
    x = F.col(r)
    parts = {"__logs": _log_growth(x), "__losses": (x == -1).cast("long"), "__below": (x < -1).cast("long")}
    names = [*parts, "__r"]
    rows = with_running(df.withColumn("__r", x.cast("double")), parts | ({"__at": F.lit(1).cast("long")} if block_rows else {}), {}, sym, date, block_rows=block_rows)
    if block_rows:
        rows = with_ahead(rows, "__at", names, periods, sym)
        later = lambda c, n: F.col(f"{c}_{n}")
    else:
        w = series(sym, date)
        later = lambda c, n: F.lead(c, n).over(w)
    change = lambda c, n: F.coalesce(later(c, n), F.lit(0)) - F.coalesce(F.col(c), F.lit(0))
    ahead = {f"d{n}": F.when(F.col("__r").isNotNull() & later("__r", n).isNotNull(), _compounded(change("__logs", n), change("__losses", n), change("__below", n))) for n in periods}
    if digits is not None:
        ahead = {n: settle(c, digits) for n, c in ahead.items()}
    return rows.withColumns(ahead).select(*(c for c in df.columns if c not in ahead), *ahead)


def ts_corr(x, y, d: int, w: WindowSpec | None = None) -> Column:
    return rolling(safe_corr, [x, y], d, w=w)


def ts_cov(x, y, d: int, w: WindowSpec | None = None) -> Column:
    return rolling(F.covar_samp, [x, y], d, w=w)


def ts_min(x, d: int, w: WindowSpec | None = None) -> Column:
    return rolling(F.min, [x], d, w=w)


def ts_max(x, d: int, w: WindowSpec | None = None) -> Column:
    return rolling(F.max, [x], d, w=w)


def ts_sum(x, d: int, w: WindowSpec | None = None) -> Column:
    return rolling(F.sum, [x], d, w=w)


def ts_avg(x, d: int, least: int | None = None, w: WindowSpec | None = None) -> Column:
    return rolling(F.avg, [x], d, least, w)


def ts_std(x, d: int, w: WindowSpec | None = None) -> Column:
    return rolling(F.stddev_samp, [x], d, w=w)


def ts_var(x, d: int, w: WindowSpec | None = None) -> Column:
    return rolling(F.var_samp, [x], d, w=w)


def ts_median(x, d: int, w: WindowSpec | None = None) -> Column:
    return ts_quantile(x, d, 0.5, w)


def ts_quantile(x, d: int, q: float, w: WindowSpec | None = None) -> Column:
    return rolling(lambda c: F.percentile(c, F.lit(q)), [x], d, w=w)


def ts_kurtosis(x, d: int, w: WindowSpec | None = None) -> Column:
    """Excess kurtosis in population form."""
    return rolling(F.kurtosis, [x], d, w=w)


def ts_skew(x, d: int, w: WindowSpec | None = None) -> Column:
    return rolling(F.skewness, [x], d, w=w)


def ts_ema(x: Column | str, span: int, w: WindowSpec | None = None) -> Column:
    """Exponential mean with weights (1 - 2/(span+1))^age, by rows; null stays null and weighs nothing.

    Rows so old that their weight is below 1e-17 are left out, so the window is bounded and the mean
    needs no recursion over the whole series.
    """
    x, keep = _col(x), 1 - 2 / (span + 1)
    reach = math.ceil(math.log(1e-17) / math.log(keep)) if keep > 0 else 1
    rows = F.collect_list(F.struct(x.cast("double").alias("x"))).over((w or series()).rowsBetween(-reach, 0))
    start = F.struct(F.lit(0.0).alias("a"), F.lit(0.0).alias("b"))
    sums = F.aggregate(rows, start, lambda s, v: F.struct((s["a"] * keep + F.coalesce(v["x"], F.lit(0.0))).alias("a"), (s["b"] * keep + v["x"].isNotNull().cast("double")).alias("b")))
    return F.when(x.isNotNull(), sums["a"] / sums["b"])


def with_ema(df: DataFrame, name: str, x: Column | str, span: int, sym: str = SYM, date: str = DATE) -> DataFrame:
    """``df`` with ts_ema() in column ``name``, by blocks, so that a row costs the same for any span.

    Inside a block one running sum of x / keep^place serves all rows; blocks are so short that these
    factors stay below 1e4. What came before enters by the sums at the ends of the few earlier blocks
    whose weight is above 1e-17. All windows go by symbol, so there is one shuffle.
    """
    x, keep = _col(x).cast("double"), 1 - 2 / (span + 1)
    if keep <= 0:
        return df.withColumn(name, x)
    decay = -math.log(keep)
    block = max(1, int(math.log(1e4) / decay))
    back = math.ceil(math.log(1e17) / (decay * block))
    at, of, place = F.col("__at"), F.col("__block"), F.col("__at") % block
    out = df.withColumn("__at", F.row_number().over(series(sym, date)) - 1).withColumn("__block", F.floor(at / block))
    inside = Window.partitionBy(sym, "__block").orderBy("__at").rowsBetween(Window.unboundedPreceding, 0)
    so_far = lambda v: F.sum(v * F.exp(place * decay)).over(inside) * F.exp(-place * decay)
    out = out.withColumns({"__a": so_far(F.coalesce(x, F.lit(0.0))), "__b": so_far(x.isNotNull().cast("double"))})
    end = F.when(place == block - 1, F.struct(at.alias("at"), F.col("__a").alias("a"), F.col("__b").alias("b")))
    earlier = Window.partitionBy(sym).orderBy("__block").rangeBetween(-back, -1)
    out = out.withColumn("__ends", F.collect_list(end).over(earlier))

    def carried(part: str) -> Column:
        return F.aggregate("__ends", F.col(f"__{part}"), lambda s, e: s + e[part] * F.exp((e["at"] - at) * decay))

    return out.withColumn(name, F.when(x.isNotNull(), carried("a") / carried("b"))).drop("__at", "__block", "__a", "__b", "__ends")


def ts_ols(y: Column | str, x: Column | str | Sequence[Column | str], d: int, w: WindowSpec | None = None) -> tuple[Column, ...]:
    """(slopes..., intercept) of y on one or more regressors over the last ``d`` rows, all of which must be whole; null where they are collinear.

    One regressor is a built-in aggregate; for more, rolling covariances are solved by elimination.
    """
    if isinstance(x, (Column, str)):
        return rolling(F.regr_slope, [y, x], d, w=w), rolling(F.regr_intercept, [y, x], d, w=w)
    cols = [_col(c).cast("double") for c in (*x, y)]
    whole, k = cols[0].isNotNull(), len(cols) - 1
    for c in cols[1:]:
        whole = whole & c.isNotNull()
    cols = [F.when(whole, c) for c in cols]
    rows = [[rolling(F.covar_pop, [cols[i], cols[j]], d, w=w) for j in range(k + 1)] for i in range(k)]
    for i in range(k):
        for j in range(i + 1, k):
            by = F.try_divide(rows[j][i], rows[i][i])
            rows[j] = [None if c <= i else rows[j][c] - by * rows[i][c] for c in range(k + 1)]
    slopes: list[Column] = []
    for i in reversed(range(k)):
        left = rows[i][k]
        for j, s in zip(range(i + 1, k), slopes, strict=True):
            left = left - rows[i][j] * s
        slopes.insert(0, F.try_divide(left, rows[i][i]))
    intercept = rolling(F.avg, [cols[k]], d, w=w)
    for s, c in zip(slopes, cols, strict=False):
        intercept = intercept - s * rolling(F.avg, [c], d, w=w)
    return *slopes, intercept


def ts_weighted_beta(y: Column | str, x: Column | str, d: int, half_life: float, w: WindowSpec | None = None) -> Column:
    """Slope of a weighted regression of y on x over ``d`` rows; weights double every ``half_life`` rows.

    Weights only matter relative to each other: sums over the window decay from row to row, so no power grows with the series.
    """
    y, x, w = _col(y), _col(x), w or series()
    rows = F.collect_list(F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))).over(w.rowsBetween(-(d - 1), 0))
    decay = 2 ** (-1 / half_life)
    whole = F.filter(rows, lambda v: v["x"].isNotNull() & v["y"].isNotNull())
    names = ("w", "wx", "wy", "wxx", "wxy")
    start = F.struct(*(F.lit(0.0).alias(n) for n in names))
    one = F.lit(1.0)
    add = lambda s, v: F.struct(*((s[n] * decay + t).alias(n) for n, t in zip(names, (one, v["x"], v["y"], v["x"] * v["x"], v["x"] * v["y"]), strict=True)))
    s = F.aggregate(whole, start, add)
    slope = F.try_divide(s["w"] * s["wxy"] - s["wx"] * s["wy"], s["w"] * s["wxx"] - s["wx"] * s["wx"])
    return F.when(F.size(whole) == d, slope)


def with_weighted_beta(df: DataFrame, name: str, y: Column | str, x: Column | str, d: int, half_life: float, sym: str = SYM, date: str = DATE) -> DataFrame:
    """``df`` with ts_weighted_beta() in column ``name``, by blocks of ``d`` rows, so that a row costs the same for any ``d``.

    A window of d rows is the end of one block and the start of the next: decayed sums run from each block's start forward and from its
    end back, and a row adds its own to that of the row where its window begins. All windows go by symbol, so there is one
    shuffle. Rows older than 64 half-lives have no weight that a double shows, so blocks are no longer than that; all d rows must be whole nonetheless, and a NaN or infinite value among them gives NaN.
    """
    y, x = _col(y).cast("double"), _col(x).cast("double")
    whole = x.isNotNull() & y.isNotNull()
    span = max(1, min(d, math.ceil(64 * half_life)))
    growth = math.log(2) / half_life
    place = F.col("__at") % span
    of = ("__w", "__wx", "__wy", "__wxx", "__wxy")
    values = [F.when(whole, v).otherwise(0.0) for v in (F.lit(1.0), x, y, x * x, x * y)]
    out = df.withColumn("__at", F.row_number().over(series(sym, date)) - 1).withColumn("__block", F.floor(F.col("__at") / span))
    out = out.withColumns(dict(zip(of, (v * F.exp(place * growth) for v in values), strict=True)))
    inside = Window.partitionBy(sym, "__block")
    forward, back = (inside.orderBy(o).rowsBetween(Window.unboundedPreceding, 0) for o in (F.asc("__at"), F.desc("__at")))
    out = out.withColumns({f"{n}{k}": F.sum(n).over(w) for n in of for k, w in (("f", forward), ("b", back))})
    by = series(sym, date)
    # the block before ends ``span`` rows before this one does: its factors are smaller by 2 ** (span / half_life)
    far = math.exp(-span * growth)
    here = F.when(place == span - 1, 0.0).otherwise(far)
    begun = {n: F.col(f"{n}f") + here * F.coalesce(F.lag(f"{n}b", span - 1).over(by), F.lit(0.0)) for n in of} if span > 1 else {n: F.col(f"{n}f") for n in of}
    counts = {"__whole": whole, "__odd": whole & F.isnan(x - x + y - y)}
    out = out.withColumns(begun | {n: F.sum(c.cast("int")).over(by.rowsBetween(Window.unboundedPreceding, 0)) for n, c in counts.items()})
    out = out.withColumns({n: F.col(n) - F.coalesce(F.lag(n, d).over(by), F.lit(0)) for n in counts})
    # every sum of this block is larger by 2 ** (place / half_life) than the row's own weights: they cancel in the slope but for size
    w, wx, wy, wxx, wxy = (F.col(n) * F.exp(-place * growth) for n in of)
    slope = F.when(F.col("__odd") > 0, F.lit(float("nan"))).otherwise(F.try_divide(w * wxy - wx * wy, w * wxx - wx * wx))
    return out.withColumn(name, F.when(F.col("__whole") == d, slope)).select(*(c for c in df.columns if c != name), name)


def ffill(x: Column | str, w: WindowSpec | None = None) -> Column:
    return F.last(_col(x), ignorenulls=True).over((w or series()).rowsBetween(Window.unboundedPreceding, 0))


def with_ffill(df: DataFrame, name: str, x: Column | str, sym: str = SYM, date: str = DATE, block_rows: int | None = None) -> DataFrame:
    """``df`` with the last non-null ``x`` up to each row; symbols of more than ``block_rows`` rows are spread over tasks."""
    return with_running(df, {}, {name: _col(x)}, sym, date, block_rows=block_rows)


def cumulative_compound(r: Column | str, w: WindowSpec | None = None) -> Column:
    """(1 + r) multiplied up to each row, minus 1, by the rules of compound()."""
    return compound(r, (w or series()).rowsBetween(Window.unboundedPreceding, 0))


def with_compound(df: DataFrame, name: str, r: Column | str, sym: str = SYM, date: str = DATE, block_rows: int | None = None) -> DataFrame:
    """``df`` with cumulative_compound(); symbols of more than ``block_rows`` rows are spread over tasks."""
    r = _col(r)
    parts = {"__logs": _log_growth(r), "__losses": (r == -1).cast("long"), "__below": (r < -1).cast("long")}
    rows = with_running(df, parts, {}, sym, date, block_rows=block_rows)
    return rows.withColumn(name, _compounded(F.col("__logs"), F.col("__losses"), F.col("__below"))).drop(*parts)
