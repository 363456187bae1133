"""Evaluation of factors: test data, and the tests on it.

Test data has sym, date, sample, returns, group, marketcap, factor, d{n} for each period and
factor_quantile. Every test keeps the rows with sample = 1 and works by date.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.cross_section import bucket, demean, rank_avg, safe_corr, section
from ..functions.time_series import compound, fwd_returns, series, settle


@dataclass(frozen=True)
class TestSpec:
    """Options of a test."""

    quantiles: int = 5
    periods: tuple[int, ...] = (1, 5, 10)
    by_group: bool = False
    date_range: tuple | None = None
    rolling_window: int = 252

    __test__ = False


def prepare(base: DataFrame, spec: TestSpec = TestSpec(), keys: Sequence[str] = ("sym", "date"), block_rows: int | None = None) -> DataFrame:
    """Test data from (sym, date, sample, returns, group, marketcap, factor); ``keys`` name the first two if they are called otherwise.

    Forward returns come before the date filter, so the last dates of the range keep theirs. A row
    in the sample without a factor gets sample -1; buckets are by date, or date and group.
    """
    base = base.withColumnsRenamed(dict(zip(keys, ("sym", "date"), strict=True)))
    out = fwd_returns(base, "returns", spec.periods, block_rows=block_rows)
    flag = F.when(F.col("sample") > 0, F.when(F.col("factor").isNull(), -1).otherwise(1)).otherwise(0)
    out = out.withColumn("sample", flag)
    out = out.withColumn("factor_quantile", bucket("factor", spec.quantiles, ("date", "group") if spec.by_group else ("date",)))
    if spec.date_range:
        out = out.where(F.col("date").between(*(F.lit(x) for x in spec.date_range)))
    return out


def _goods(data: DataFrame) -> DataFrame:
    return data.where("sample = 1")


def mean_and_error(names: Sequence[str]) -> list[Column]:
    """e_{name}: the mean; se_{name}: its standard error, null for one row."""
    return [c for n in names for c in (F.avg(n).alias(f"e_{n}"), F.try_divide(F.stddev_samp(n), F.sqrt(F.count(n))).alias(f"se_{n}"))]


def bucket_returns(data: DataFrame, spec: TestSpec = TestSpec(), level: str = "bucket") -> dict[str, DataFrame]:
    """rtn: mean and error by date and bucket; exr: excess over the date; gbr: excess inside the group.

    ``level="bucket"`` takes the excess over the mean of the bucket means, ``"row"`` over the mean of rows.
    """
    goods, names = _goods(data), [f"d{n}" for n in spec.periods]
    rtn = goods.groupBy("date", "factor_quantile").agg(*mean_and_error(names))
    if level == "row":
        over = lambda by: goods.withColumns({n: demean(n, by) for n in names})
        return {"rtn": rtn, "exr": over(("date",)).groupBy("date", "factor_quantile").agg(*mean_and_error(names)), "gbr": over(("date", "group")).groupBy("date", "group", "factor_quantile").agg(*mean_and_error(names))}
    exr = rtn.select("date", "factor_quantile", *(demean(f"e_{n}").alias(f"exr_{n}") for n in names))
    gbr = goods.groupBy("date", "group", "factor_quantile").agg(*(F.avg(n).alias(f"e_{n}") for n in names))
    gbr = gbr.select("date", "group", "factor_quantile", *(demean(f"e_{n}", ("date", "group")).alias(f"gbr_{n}") for n in names))
    return {"rtn": rtn, "exr": exr, "gbr": gbr}


def bucket_spread(rtn: DataFrame, spec: TestSpec = TestSpec(), by: Sequence[str] = ("date",)) -> DataFrame:
    """Mean return of the top bucket less that of the bottom one, and the error of the difference."""
    at = lambda k, c: F.max(F.when(F.col("factor_quantile") == k, F.col(c)))
    cols = []
    for n in (f"d{p}" for p in spec.periods):
        cols.append((at(spec.quantiles, f"e_{n}") - at(1, f"e_{n}")).alias(f"spread_{n}"))
        cols.append(F.sqrt(F.pow(at(spec.quantiles, f"se_{n}"), F.lit(2.0)) + F.pow(at(1, f"se_{n}"), F.lit(2.0))).alias(f"se_{n}"))
    return rtn.groupBy(*by).agg(*cols)


def overlapping_cumulative(returns: DataFrame, value: str, n: int, by: Sequence[str] = (), out: str = "cum") -> DataFrame:
    """Value of n portfolios started on successive dates, each rebalanced every n dates, averaged, minus 1.

    The dates of a series (of each ``by``) are numbered; number mod n is the portfolio, which
    compounds over its own dates and stands still between them. The input is one row per date, so
    the windows over a series are short; with ``by``, series are spread over tasks.
    """
    w = Window.partitionBy(*by).orderBy("date")
    numbered = returns.select(*by, "date", value).withColumn("__k", (F.row_number().over(w) - 1) % n)
    own = Window.partitionBy(*by, "__k").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    r = F.col(value)
    # log1p of all and the sign apart, so that a loss beyond everything is exact
    size = F.exp(F.sum(F.log(F.abs(F.when(r != -1, 1 + r)))).over(own))
    sign = F.when(F.sum((r < -1).cast("int")).over(own) % 2 == 1, -1).otherwise(1)
    grown = numbered.withColumn("__nv", F.when(F.max((r == -1).cast("int")).over(own) == 1, 0.0).otherwise(size * sign))
    held = [F.last(F.when(F.col("__k") == k, F.col("__nv")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)) for k in range(n)]
    total = sum((F.coalesce(h, F.lit(0.0)) for h in held), F.lit(0.0))
    started = sum((h.isNotNull().cast("int") for h in held), F.lit(0))
    return grown.select(*by, "date", (F.try_divide(total, started) - 1).alias(out))


_DAILY = ("fw_ls", "fw_raw", "fw_ind", "fw_ind_raw", "eq_raw", "eq_ind", "ls", "top_raw", "bottom_raw", "ls_ind", "hold", "mkt")


def factor_returns(data: DataFrame, spec: TestSpec = TestSpec(), period: int | None = None, digits: int | None = None) -> DataFrame:
    """Twelve daily series of portfolios for one period, and each compounded.

    Weights are centred ranks (fw_*: long-short or long only, plain or in excess of the group), equal
    (eq_*), or the outer buckets (ls, top_raw, bottom_raw); hold is the plain mean, mkt that of returns with null as 0.
    A total loss in a daily series leaves its compound at -1. With ``digits`` daily values are settled before they are compounded.
    """
    n = f"d{period or spec.periods[0]}"
    g = _goods(data).withColumn("r", F.coalesce(n, F.lit(0.0))).withColumn("__rank", rank_avg("factor"))
    g = g.withColumns({"w": demean("__rank"), "r_ind": demean("r", ("date", "group"))})
    long = F.greatest(F.col("w"), F.lit(0.0))
    ratio = lambda w, r, size: F.try_divide(F.sum(w * F.col(r)), F.sum(size))
    q = lambda k, r: F.avg(F.when(F.col("factor_quantile") == k, F.col(r)))
    top = spec.quantiles
    daily = g.groupBy("date").agg(
        ratio(F.col("w"), "r", F.abs("w")).alias("fw_ls"), ratio(long, "r", long).alias("fw_raw"), ratio(F.col("w"), "r_ind", F.abs("w")).alias("fw_ind"), ratio(long, "r_ind", long).alias("fw_ind_raw"),
        F.avg("r").alias("eq_raw"), F.avg("r_ind").alias("eq_ind"), (q(top, "r") - q(1, "r")).alias("ls"), q(top, "r").alias("top_raw"), q(1, "r").alias("bottom_raw"), (q(top, "r_ind") - q(1, "r_ind")).alias("ls_ind"), F.avg(n).alias("hold"), F.avg("r").alias("mkt"),
    )
    if digits is not None:
        daily = daily.withColumns({c: settle(F.col(c), digits) for c in _DAILY})
    w = Window.orderBy("date").rowsBetween(Window.unboundedPreceding, 0)  # one row per date
    return daily.withColumns({f"{c}_cum": F.when(F.col(c).isNotNull(), compound(c, w)) for c in _DAILY})


SCHEMES = ("demeaned", "long_short", "raw", "sign", "sign_median", "long_short_raw")


def portfolio_weights(data: DataFrame, scheme: str, group_adjust: bool = False) -> DataFrame:
    """The sample's rows with ``weight``, whose absolute values sum to 1 by date.

    Schemes: the factor less its mean; equal weights on either side of the mean; the factor; its
    sign; the sign against the median; equal weights on either side of 0. With ``group_adjust`` the
    mean, median and counts are those of the group.
    """
    by = ("date", "group") if group_adjust else ("date",)
    goods, f = _goods(data), F.col("factor")
    if scheme == "long_short":
        goods = goods.withColumn("factor", demean("factor"))
    side = F.signum(f)
    weight = {
        "demeaned": demean("factor", by), "raw": f, "sign": side, "sign_median": F.signum(f - F.percentile(f, F.lit(0.5)).over(section(by))),
        "long_short": side / F.count(f).over(Window.partitionBy(*by, side)), "long_short_raw": side / F.count(f).over(Window.partitionBy(*by, side)),
    }[scheme]
    goods = goods.withColumn("weight", weight)
    return goods.withColumn("weight", F.try_divide(F.col("weight"), F.sum(F.abs("weight")).over(section())))


def weighted_returns(data: DataFrame, scheme: str, spec: TestSpec = TestSpec(), group_adjust: bool = False) -> DataFrame:
    """date and fr_d{n}: the portfolio's return for each period."""
    rows = portfolio_weights(data, scheme, group_adjust)
    return rows.groupBy("date").agg(*(F.coalesce(F.sum(F.col("weight") * F.col(f"d{n}")), F.lit(0.0)).alias(f"fr_d{n}") for n in spec.periods))


def bucket_stay(data: DataFrame, spec: TestSpec = TestSpec()) -> DataFrame:
    """Share of the symbols of a bucket that are in it n sample rows later, for each period."""
    goods = _goods(data)
    later = {f"q_{n}": F.lead("factor_quantile", n).over(series()) for n in spec.periods}
    same = [F.avg((F.col("factor_quantile") == F.col(f"q_{n}")).cast("double")).alias(f"stay_d{n}") for n in spec.periods]
    return goods.withColumns(later).groupBy("date", "factor_quantile").agg(*same)


def bucket_turnover(data: DataFrame, spec: TestSpec = TestSpec()) -> DataFrame:
    """Share that leaves the bucket within n rows, shown n dates of the bucket later."""
    same = {f"s_{n}": (F.lead("factor_quantile", n).over(series()) == F.col("factor_quantile")).cast("double") for n in spec.periods}
    daily = data.withColumns(same).where("sample = 1").groupBy("date", "factor_quantile").agg(*(F.round(1 - F.coalesce(F.sum(f"s_{n}"), F.lit(0.0)) / F.count(F.lit(1)), 12).alias(f"tr_{n}") for n in spec.periods))
    w = Window.partitionBy("factor_quantile").orderBy("date")
    return daily.select("date", "factor_quantile", *(F.lag(f"tr_{n}", n).over(w).alias(f"turnover_d{n}") for n in spec.periods))


def correlations(data: DataFrame, pairs: dict[str, tuple[str, ...]], by: str = "date", least: int = 3) -> DataFrame:
    """Pearson and rank correlation (r_{name}, rank_{name}) of column pairs by date; null below ``least`` pairs or without variance.

    All ranks of one pair are taken among the rows where both are present. A pair (x, y, kx, ky) is ranked by its
    keys kx and ky. Each pair of a row becomes a row of its own, so that all ranks are taken by two sorts within (date, pair), after one shuffle.
    """
    both = []
    for n, names in pairs.items():
        x, y, kx, ky = (*names, *names) if len(names) == 2 else names
        there = F.col(x).isNotNull() & F.col(y).isNotNull()
        both.append(F.struct(F.lit(n).alias("pair"), *(F.when(there, F.col(c).cast("double")).alias(k) for k, c in (("x", x), ("y", y), ("kx", kx), ("ky", ky)))))
    long = data.select(F.col(by), F.explode(F.array(*both)).alias("p")).select(by, "p.*")
    ranked = long.withColumns({"rx": rank_avg("kx", (by, "pair")), "ry": rank_avg("ky", (by, "pair"))})
    usable = (F.count("x") >= least) & (F.min("x") < F.max("x")) & (F.min("y") < F.max("y"))
    found = ranked.groupBy(by, "pair").agg(F.when(usable, safe_corr(F.col("x"), F.col("y"))).alias("r"), F.when(usable, safe_corr(F.col("rx"), F.col("ry"))).alias("rank"))
    return found.groupBy(by).agg(*(F.max(F.when(F.col("pair") == n, F.col(k))).alias(f"{k}_{n}") for n in pairs for k in ("r", "rank")))


def autocorrelation(data: DataFrame, spec: TestSpec = TestSpec(), smooth: bool = False) -> DataFrame:
    """Correlation of the factor with its value n rows later: r_ac{n}, rank_ac{n}.

    ``smooth`` takes values before the sample filter, then the mean of the last n dates, shown n dates later.
    """
    later = {f"f_{n}": F.lead("factor", n).over(series()) for n in spec.periods}
    rows = data.withColumns(later).where("sample = 1") if smooth else _goods(data).withColumns(later)
    out = correlations(rows, {f"ac{n}": ("factor", f"f_{n}") for n in spec.periods})
    if not smooth:
        return out
    w = Window.orderBy("date")  # one row per date
    for n in spec.periods:
        for c in (f"r_ac{n}", f"rank_ac{n}"):
            out = out.withColumn(c, F.avg(c).over(w.rowsBetween(-(n - 1), 0))).withColumn(c, F.lag(c, n).over(w))
    return out


def _tie_key(x: str, value: Column) -> Column:
    """``value``, which is ``x`` less a mean, without the noise of that: 12 digits of the date's largest ``x``."""
    scale = F.max(F.abs(F.col(x))).over(section())
    return F.when(scale > 0, F.round(value / scale, 12)).otherwise(value)


def ic(data: DataFrame, spec: TestSpec = TestSpec(), level: str = "both", digits: int | None = None) -> DataFrame:
    """Correlation of the factor with coming returns by date: r_d{n}, rank_d{n}, and r_g{n}, rank_g{n} inside groups.

    Inside groups both are taken less the mean of (date, group); ``level="returns_only"`` does so for the returns only.
    Values that are equal but for the noise of their mean tie in ranks; with ``digits`` demeaned values are settled altogether.
    """
    g = ("date", "group")
    rows, demeaned = _goods(data), [f"d{n}" for n in spec.periods] + ["factor"] * (level == "both")
    if digits is not None:
        rows = rows.withColumns({f"__g_{c}": settle(demean(c, g), digits) for c in demeaned})
        key = "__g_"
    else:
        rows = rows.withColumns({f"__g_{c}": demean(c, g) for c in demeaned}).withColumns({f"__k_{c}": _tie_key(c, F.col(f"__g_{c}")) for c in demeaned})
        key = "__k_"
    fg, kf = ("__g_factor", f"{key}factor") if level == "both" else ("factor", "factor")
    pairs = {f"d{n}": ("factor", f"d{n}") for n in spec.periods} | {f"g{n}": (fg, f"__g_d{n}", kf, f"{key}d{n}") for n in spec.periods}
    return correlations(rows, pairs)


def ic_cumulative(ics: DataFrame, columns: Sequence[str], condition: str | None = None) -> DataFrame:
    """Running sums of correlations over the dates that meet the condition."""
    rows = ics.where(F.expr(condition)) if condition else ics
    w = Window.orderBy("date").rowsBetween(Window.unboundedPreceding, 0)  # one row per date
    return rows.select("date", *(F.when(F.col(c).isNotNull(), F.sum(c).over(w)).alias(c) for c in columns))


def monthly_mean(series_by_date: DataFrame, columns: Sequence[str]) -> DataFrame:
    return series_by_date.groupBy(F.trunc("date", "MM").alias("month")).agg(*(F.avg(c).alias(c) for c in columns))


def roll_up(rtn: DataFrame, spec: TestSpec = TestSpec(), by: Sequence[str] = ("year",), condition: str | None = None) -> DataFrame:
    """Mean of daily bucket means and its error by year, month or group, and bucket."""
    rows = rtn.where(F.expr(condition)) if condition else rtn
    rows = rows.withColumns({"year": F.year("date"), "month": F.month("date")})
    cols = []
    for n in (f"d{p}" for p in spec.periods):
        cols += [F.avg(f"e_{n}").alias(f"e_{n}"), F.try_divide(F.stddev_samp(f"e_{n}"), F.sqrt(F.count(f"se_{n}"))).alias(f"se_{n}")]
    return rows.groupBy(*by, "factor_quantile").agg(*cols)


def coverage(data: DataFrame, sample_total: str = "all") -> DataFrame:
    """Shares by date: SF2S, X2S, F2T, S2T.

    ``sample_total="all"`` counts a row without factor (sample -1) as sample, ``"valid"`` does not.
    """
    ok = lambda c: F.count_if(c)
    s, f = F.col("sample"), F.col("factor").isNotNull()
    if sample_total == "all":
        counts = [ok(s == 1).alias("sfno"), ok(f).alias("fno"), ok(s != 0).alias("sno"), ok(s == -1).alias("xno")]
    else:
        counts = [ok((s > 0) & f).alias("sfno"), ok((s > 0) & f).alias("fno"), ok(s > 0).alias("sno"), ok(s == -1).alias("xno")]
    daily = data.groupBy("date").agg(F.count(F.lit(1)).alias("tno"), *counts)
    return daily.select("date", F.try_divide("sfno", "sno").alias("sf2s"), F.try_divide("xno", "sno").alias("x2s"), F.try_divide("fno", "tno").alias("f2t"), F.try_divide("sno", "tno").alias("s2t"))


def alpha_beta(daily: DataFrame, market: DataFrame, spec: TestSpec = TestSpec(), windows: dict[str, int] | None = None) -> dict[str, DataFrame]:
    """Regression of portfolio returns (fr_d{n}) on the market's means (me_d{n}): whole sample, and rolling by date."""
    both = daily.join(market, "date")
    stats = None
    for n in spec.periods:
        y, x = f"fr_d{n}", f"me_d{n}"
        row = both.agg(F.regr_intercept(y, x).alias("alpha"), F.regr_slope(y, x).alias("beta")).select(F.lit(f"d{n}").alias("period"), "alpha", "beta", (F.pow(F.col("alpha") + 1, F.lit(252 / n)) - 1).alias("annual_alpha"))
        stats = row if stats is None else stats.union(row)
    w, cols = Window.orderBy("date"), []  # one row per date
    for n in spec.periods:
        y, x = F.col(f"fr_d{n}"), F.col(f"me_d{n}")
        for name, size in (windows or {"1y": 252, "1m": 22}).items():
            frame = w.rowsBetween(-(size - 1), 0)
            full = F.count(F.when(y.isNotNull() & x.isNotNull(), 1)).over(frame) == size
            alpha = F.when(full, F.regr_intercept(y, x).over(frame))
            cols += [alpha.alias(f"alpha_d{n}_{name}"), F.when(full, F.regr_slope(y, x).over(frame)).alias(f"beta_d{n}_{name}"), (F.pow(alpha + 1, F.lit(252 / n)) - 1).alias(f"annual_d{n}_{name}")]
    return {"stats": stats, "dates": both.select("date", *cols)}
