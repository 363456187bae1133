"""R: evaluation of factors, and the aggregations it is made of (A-06 to A-15)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..fixtures import FXS_SQL, supplier_panel
from ..functions import time_series as ts
from ..operators.panel import align_by_date
from ..plans import chain, regress, testers
from ..plans.testers import TestSpec
from .registry import query, r, rounded, rounded_sql
from .windows import GAPS_AHEAD, LONG, gaps_panel

SPEC = TestSpec(quantiles=5, periods=(1, 5, 10))


def base(spark, sf, rows=None):
    factor = F.when(F.col("sym").cast("int") % 7 != 0, F.col("x"))
    rows = supplier_panel(spark, sf) if rows is None else rows
    return rows.select("sym", "date", F.when(F.col("fv") > 20000, 1).otherwise(0).alias("sample"), F.col("r").alias("returns"), F.col("ic").alias("group"), F.col("fv").alias("marketcap"), factor.alias("factor"))


def data(spark, sf):
    """Test data whose forward returns are rounded, so that their ranks do not hang on an engine's noise."""
    rows = testers.prepare(base(spark, sf), SPEC)
    return rows.withColumns({f"d{n}": ts.settle(F.col(f"d{n}"), 10) for n in SPEC.periods})


def _avg_rank(x: str, by: str) -> str:
    return f"CASE WHEN {x} IS NOT NULL THEN RANK() OVER (PARTITION BY {by} ORDER BY {x} NULLS LAST) + (COUNT({x}) OVER (PARTITION BY {by}, {x}) - 1) / 2.0 END"


DATA = f"""WITH s AS ({FXS_SQL}), c AS (SELECT *, SUM(LN(1 + r)) OVER (PARTITION BY sym ORDER BY date) AS cum FROM s),
  b AS (SELECT sym, date, fv > 20000 AS picked, r AS returns, ic AS grp, fv AS marketcap, CASE WHEN CAST(sym AS INT) % 7 <> 0 THEN x END AS factor,
    ROUND(EXP(LEAD(cum, 1) OVER w - cum) - 1 + 1.7320508075e-13, 10) AS d1, ROUND(EXP(LEAD(cum, 5) OVER w - cum) - 1 + 1.7320508075e-13, 10) AS d5, ROUND(EXP(LEAD(cum, 10) OVER w - cum) - 1 + 1.7320508075e-13, 10) AS d10 FROM c WINDOW w AS (PARTITION BY sym ORDER BY date)),
  k AS (SELECT *, CASE WHEN NOT picked THEN 0 WHEN factor IS NULL THEN -1 ELSE 1 END AS sample, {_avg_rank('factor', 'date')} AS rk, COUNT(factor) OVER (PARTITION BY date) AS nf FROM b),
  d AS (SELECT * EXCLUDE (picked, rk, nf), CASE WHEN factor IS NOT NULL THEN CAST(LEAST(GREATEST(CEIL(ROUND(rk / nf * 5, 9)), 1), 5) AS INT) END AS q FROM k),
  g AS (SELECT * FROM d WHERE sample = 1)"""
DS = ("d1", "d5", "d10")


def _each(template: str) -> str:
    return ", ".join(template.replace("#", n) for n in DS)


E_SE = _each("AVG(#) AS e_#, STDDEV_SAMP(#) / SQRT(COUNT(#)) AS se_#")
ES = " ".join(f"e_{n} se_{n}" for n in DS)


@query("R-01_prepare", rounded_sql(f"{DATA}\nFINALLY SELECT sym, date, sample, returns, grp AS group_name, marketcap, factor, d1, d5, d10, q AS factor_quantile FROM d", "returns marketcap factor d1 d5 d10", "sym date sample group_name factor_quantile"))
def prepare(spark, sf):
    return rounded(data(spark, sf).withColumnRenamed("group", "group_name"))


RTN = f"{DATA}, t AS (SELECT date, q AS factor_quantile, {E_SE} FROM g GROUP BY 1, 2)"
query("R-02_bucket_returns_rtn", rounded_sql(f"{RTN}\nFINALLY SELECT * FROM t", ES, "date factor_quantile"))(lambda spark, sf: rounded(testers.bucket_returns(data(spark, sf), SPEC)["rtn"]))
query("R-02_bucket_returns_exr", rounded_sql(f"{RTN}\nFINALLY SELECT date, factor_quantile, {_each('e_# - AVG(e_#) OVER (PARTITION BY date) AS exr_#')} FROM t", " ".join(f"exr_{n}" for n in DS), "date factor_quantile"))(
    lambda spark, sf: rounded(testers.bucket_returns(data(spark, sf), SPEC)["exr"])
)
query(
    "R-02_bucket_returns_gbr",
    rounded_sql(f"{DATA}, t AS (SELECT date, grp AS group_name, q AS factor_quantile, {_each('AVG(#) AS e_#')} FROM g GROUP BY 1, 2, 3)\nFINALLY SELECT date, group_name, factor_quantile, {_each('e_# - AVG(e_#) OVER (PARTITION BY date, group_name) AS gbr_#')} FROM t", " ".join(f"gbr_{n}" for n in DS), "date group_name factor_quantile"),
)(lambda spark, sf: rounded(testers.bucket_returns(data(spark, sf), SPEC)["gbr"].withColumnRenamed("group", "group_name")))
ROW_EXR = f"{DATA}, x AS (SELECT date, grp, q, {_each('# - AVG(#) OVER (PARTITION BY date) AS #')} FROM g)"
ROW_GBR = f"{DATA}, x AS (SELECT date, grp, q, {_each('# - AVG(#) OVER (PARTITION BY date, grp) AS #')} FROM g)"
query("R-03_row_excess_exr", rounded_sql(f"{ROW_EXR}\nFINALLY SELECT date, q AS factor_quantile, {E_SE} FROM x GROUP BY 1, 2", ES, "date factor_quantile"))(lambda spark, sf: rounded(testers.bucket_returns(data(spark, sf), SPEC, "row")["exr"]))
query("R-03_row_excess_gbr", rounded_sql(f"{ROW_GBR}\nFINALLY SELECT date, grp AS group_name, q AS factor_quantile, {E_SE} FROM x GROUP BY 1, 2, 3", ES, "date group_name factor_quantile"))(
    lambda spark, sf: rounded(testers.bucket_returns(data(spark, sf), SPEC, "row")["gbr"].withColumnRenamed("group", "group_name"))
)
_SPREAD = _each("MAX(CASE WHEN factor_quantile = 5 THEN e_# END) - MAX(CASE WHEN factor_quantile = 1 THEN e_# END) AS spread_#, SQRT(POW(MAX(CASE WHEN factor_quantile = 5 THEN se_# END), 2) + POW(MAX(CASE WHEN factor_quantile = 1 THEN se_# END), 2)) AS se_#")
SPREADS = " ".join(f"spread_{n} se_{n}" for n in DS)
query("R-04_bucket_spread", rounded_sql(f"{RTN}\nFINALLY SELECT date, {_SPREAD} FROM t GROUP BY 1", SPREADS, "date"))(lambda spark, sf: rounded(testers.bucket_spread(testers.bucket_returns(data(spark, sf), SPEC)["rtn"], SPEC)))
query("R-04_bucket_spread_by_group", rounded_sql(f"{ROW_GBR}, t AS (SELECT date, grp AS group_name, q AS factor_quantile, {E_SE} FROM x GROUP BY 1, 2, 3)\nFINALLY SELECT date, group_name, {_SPREAD} FROM t GROUP BY 1, 2", SPREADS, "date group_name"))(
    lambda spark, sf: rounded(testers.bucket_spread(testers.bucket_returns(data(spark, sf), SPEC, "row")["gbr"], SPEC, ("date", "group")).withColumnRenamed("group", "group_name"))
)


def _overlap(source: str, value: str, n: int, by: str = "", out: str = "cum") -> str:
    """The staggered portfolios' mean value over ``source`` (by, date, value), as CTEs that end in one called o."""
    own = f"{by}, " if by else ""
    part = f"PARTITION BY {by}" if by else ""
    held = [f"LAST_VALUE(CASE WHEN kk = {k} THEN nv END IGNORE NULLS) OVER ({part} ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)" for k in range(n)]
    total, some = " + ".join(f"COALESCE({h}, 0)" for h in held), " + ".join(f"CAST({h} IS NOT NULL AS INT)" for h in held)
    return f"""o1 AS (SELECT {own}date, {value} AS v, (ROW_NUMBER() OVER ({part} ORDER BY date) - 1) % {n} AS kk FROM {source}),
      o2 AS (SELECT *, EXP(SUM(LN(1 + v)) OVER (PARTITION BY {own}kk ORDER BY date)) AS nv FROM o1), o AS (SELECT {own}date, ({total}) / NULLIF({some}, 0) - 1 AS {out} FROM o2)"""


@query("R-05_overlapping_cumulative", rounded_sql(f"{RTN}, m AS (SELECT * FROM t WHERE factor_quantile = 5), {_overlap('m', 'e_d5', 5)}\nFINALLY SELECT date, cum FROM o", "cum", "date", 6))
def overlapping(spark, sf):
    rtn = testers.bucket_returns(data(spark, sf), SPEC)["rtn"].where("factor_quantile = 5")
    return rounded(testers.overlapping_cumulative(rtn, "e_d5", 5), 6)


@query("R-05_overlapping_by_bucket", rounded_sql(f"{RTN}, {_overlap('t', 'e_d5', 5, 'factor_quantile')}\nFINALLY SELECT factor_quantile, date, cum FROM o", "cum", "factor_quantile date", 6))
def overlapping_by(spark, sf):
    return rounded(testers.overlapping_cumulative(testers.bucket_returns(data(spark, sf), SPEC)["rtn"], "e_d5", 5, ("factor_quantile",)), 6)


@query("R-05_overlapping_long_short_by_year", rounded_sql(f"{RTN}, m AS (SELECT date, YEAR(date) AS yr, MAX(CASE WHEN factor_quantile = 5 THEN e_d5 END) - MAX(CASE WHEN factor_quantile = 1 THEN e_d5 END) AS ls FROM t GROUP BY 1), {_overlap('m', 'ls', 5, 'yr')}\nFINALLY SELECT yr, date, cum FROM o", "cum", "yr date", 6))
def overlapping_year(spark, sf):
    spread = testers.bucket_spread(testers.bucket_returns(data(spark, sf), SPEC)["rtn"], SPEC).withColumn("yr", F.year("date").cast("long"))
    return rounded(testers.overlapping_cumulative(spread, "spread_d5", 5, ("yr",)), 6)


FR = " ".join(testers._DAILY) + " " + " ".join(f"{c}_cum" for c in testers._DAILY)


def _factor_returns_sql(n: str, source: str = DATA, cum: str = "EXP(SUM(LN(1 + CASE WHEN # > -1 THEN # END)) OVER (ORDER BY date)) - 1") -> str:
    q = lambda k, x: f"AVG(CASE WHEN q = {k} THEN {x} END)"
    daily = ", ".join(f"{r(x, 10)} AS {c}" for c, x in {
        "fw_ls": "SUM(w * rr) / NULLIF(SUM(ABS(w)), 0)", "fw_raw": "SUM(GREATEST(w, 0) * rr) / NULLIF(SUM(GREATEST(w, 0)), 0)", "fw_ind": "SUM(w * ri) / NULLIF(SUM(ABS(w)), 0)", "fw_ind_raw": "SUM(GREATEST(w, 0) * ri) / NULLIF(SUM(GREATEST(w, 0)), 0)",
        "eq_raw": "AVG(rr)", "eq_ind": "AVG(ri)", "ls": f"{q(5, 'rr')} - {q(1, 'rr')}", "top_raw": q(5, "rr"), "bottom_raw": q(1, "rr"), "ls_ind": f"{q(5, 'ri')} - {q(1, 'ri')}", "hold": f"AVG({n})", "mkt": "AVG(rr)",
    }.items())
    cums = ", ".join(f"CASE WHEN {c} IS NOT NULL THEN {cum.replace('#', c)} END AS {c}_cum" for c in testers._DAILY)
    return f"""{source}, a AS (SELECT *, COALESCE({n}, 0) AS rr, {_avg_rank('factor', 'date')} AS rank FROM g),
      w AS (SELECT *, rank - AVG(rank) OVER (PARTITION BY date) AS w, rr - AVG(rr) OVER (PARTITION BY date, grp) AS ri FROM a), f AS (SELECT date, {daily} FROM w GROUP BY date)\nFINALLY SELECT *, {cums} FROM f"""


for _n in SPEC.periods:
    query(f"R-06_factor_returns_d{_n}", rounded_sql(_factor_returns_sql(f"d{_n}"), FR, "date", 7))(lambda spark, sf, n=_n: rounded(testers.factor_returns(data(spark, sf), SPEC, n, digits=10), 7))

#: The same data from a panel with missing returns and total losses.
_AHEAD = ", ".join(r(f"d{n}", 10) + f" AS d{n}" for n in SPEC.periods)
GAPS_DATA = f"""{GAPS_AHEAD}, b AS (SELECT sym, date, fv > 20000 AS picked, r AS returns, ic AS grp, fv AS marketcap, CASE WHEN CAST(sym AS INT) % 7 <> 0 THEN x END AS factor, {_AHEAD} FROM ahead),
{DATA[DATA.index("  k AS (SELECT *, CASE WHEN NOT picked"):]}"""


def gaps_data(spark, sf, block_rows=None):
    rows = testers.prepare(base(spark, sf, gaps_panel(spark, sf)), SPEC, block_rows=block_rows)
    return rows.withColumns({f"d{n}": ts.settle(F.col(f"d{n}"), 10) for n in SPEC.periods})


query("R-06_factor_returns_total_loss", rounded_sql(_factor_returns_sql("d5", GAPS_DATA, "PRODUCT(1 + #) OVER (ORDER BY date) - 1"), FR, "date", 7))(lambda spark, sf: rounded(testers.factor_returns(gaps_data(spark, sf), SPEC, 5, digits=10), 7))
query("R-01_prepare_gaps", rounded_sql(f"{GAPS_DATA}\nFINALLY SELECT sym, date, sample, returns, grp AS group_name, marketcap, factor, d1, d5, d10, q AS factor_quantile FROM d", "returns marketcap factor d1 d5 d10", "sym date sample group_name factor_quantile"))(lambda spark, sf: rounded(gaps_data(spark, sf, LONG).withColumnRenamed("group", "group_name")))


def _weights_sql(scheme: str, group: bool) -> str:
    by = "date, grp" if group else "date"
    source = "(SELECT * EXCLUDE (factor), factor - AVG(factor) OVER (PARTITION BY date) AS factor FROM g)" if scheme == "long_short" else "g"
    side = f"SIGN(factor) / COUNT(factor) OVER (PARTITION BY {by}, SIGN(factor))"
    weight = {"demeaned": f"factor - AVG(factor) OVER (PARTITION BY {by})", "raw": "factor", "sign": "SIGN(factor)", "sign_median": f"SIGN(factor - QUANTILE_CONT(factor, 0.5) OVER (PARTITION BY {by}))", "long_short": side, "long_short_raw": side}[scheme]
    return f"{DATA}, a AS (SELECT *, {weight} AS w0 FROM {source}), w AS (SELECT *, w0 / NULLIF(SUM(ABS(w0)) OVER (PARTITION BY date), 0) AS weight FROM a)"


for _s in testers.SCHEMES:
    for _g in (False, True):
        _sql = f"{_weights_sql(_s, _g)}\nFINALLY SELECT date, {_each('COALESCE(SUM(weight * #), 0) AS fr_#')} FROM w GROUP BY 1"
        query(f"R-07_weighted_returns_{_s}{'_group' * _g}", rounded_sql(_sql, " ".join(f"fr_{n}" for n in DS), "date"))(lambda spark, sf, s=_s, g=_g: rounded(testers.weighted_returns(data(spark, sf), s, SPEC, g)))


@query("R-07_weighted_curve", rounded_sql(f"{_weights_sql('demeaned', False)}, m AS (SELECT date, COALESCE(SUM(weight * d5), 0) AS v FROM w GROUP BY 1), {_overlap('m', 'v', 5)}\nFINALLY SELECT date, cum FROM o", "cum", "date", 6))
def weighted_curve(spark, sf):
    return rounded(testers.overlapping_cumulative(testers.weighted_returns(data(spark, sf), "demeaned", SPEC), "fr_d5", 5), 6)


query("R-08_portfolio_weights", rounded_sql(f"{_weights_sql('sign_median', True)}\nFINALLY SELECT sym, date, weight FROM w", "weight", "sym date"))(lambda spark, sf: rounded(testers.portfolio_weights(data(spark, sf), "sign_median", True).select("sym", "date", "weight")))

query("R-09_bucket_stay", rounded_sql(f"{DATA}, l AS (SELECT date, q, {', '.join(f'LEAD(q, {n}) OVER (PARTITION BY sym ORDER BY date) AS q{n}' for n in SPEC.periods)} FROM g)\nFINALLY SELECT date, q AS factor_quantile, {', '.join(f'AVG(CAST(q = q{n} AS INT)) AS stay_d{n}' for n in SPEC.periods)} FROM l GROUP BY 1, 2", " ".join(f"stay_{n}" for n in DS), "date factor_quantile"))(
    lambda spark, sf: rounded(testers.bucket_stay(data(spark, sf), SPEC))
)
query(
    "R-10_bucket_turnover",
    rounded_sql(
        f"{DATA}, l AS (SELECT *, {', '.join(f'CAST(LEAD(q, {n}) OVER (PARTITION BY sym ORDER BY date) = q AS INT) AS s{n}' for n in SPEC.periods)} FROM d), t AS (SELECT date, q AS factor_quantile, {', '.join(f'1 - COALESCE(SUM(s{n}), 0) / COUNT(*) AS tr{n}' for n in SPEC.periods)} FROM l WHERE sample = 1 GROUP BY 1, 2)\nFINALLY SELECT date, factor_quantile, {', '.join(f'LAG(tr{n}, {n}) OVER (PARTITION BY factor_quantile ORDER BY date) AS turnover_d{n}' for n in SPEC.periods)} FROM t",
        " ".join(f"turnover_{n}" for n in DS), "date factor_quantile",
    ),
)(lambda spark, sf: rounded(testers.bucket_turnover(data(spark, sf), SPEC)))


def _corr_sql(source: str, pairs: dict[str, tuple[str, str]]) -> str:
    """CTEs ending in z: Pearson and rank correlations by date of pairs in ``source``."""
    a = ", ".join(f"CASE WHEN {y} IS NOT NULL THEN {x} END AS x_{n}, CASE WHEN {x} IS NOT NULL THEN {y} END AS y_{n}" for n, (x, y) in pairs.items())
    b = ", ".join(f"{_avg_rank(f'{k}_{n}', 'date')} AS r{k}_{n}" for n in pairs for k in "xy")
    ok = lambda n: f"COUNT(x_{n}) >= 3 AND MIN(x_{n}) < MAX(x_{n}) AND MIN(y_{n}) < MAX(y_{n})"
    c = ", ".join(f"CASE WHEN {ok(n)} THEN CORR(x_{n}, y_{n}) END AS r_{n}, CASE WHEN {ok(n)} THEN CORR(rx_{n}, ry_{n}) END AS rank_{n}" for n in pairs)
    return f"z1 AS (SELECT date, {a} FROM {source}), z2 AS (SELECT *, {b} FROM z1), z AS (SELECT date, {c} FROM z2 GROUP BY date)"


def _names(pairs) -> str:
    return " ".join(f"r_{n} rank_{n}" for n in pairs)


AC = {f"ac{n}": ("factor", f"f{n}") for n in SPEC.periods}
_LEADS = ", ".join(f"LEAD(factor, {n}) OVER (PARTITION BY sym ORDER BY date) AS f{n}" for n in SPEC.periods)
query("R-11_autocorrelation", rounded_sql(f"{DATA}, l AS (SELECT *, {_LEADS} FROM g), {_corr_sql('l', AC)}\nFINALLY SELECT * FROM z", _names(AC), "date"))(lambda spark, sf: rounded(testers.autocorrelation(data(spark, sf), SPEC)))
_SMOOTH = ", ".join(f"AVG({c}) OVER (ORDER BY date ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW) AS {c}" for n in SPEC.periods for c in (f"r_ac{n}", f"rank_ac{n}"))
_LATER = ", ".join(f"LAG({c}, {n}) OVER (ORDER BY date) AS {c}" for n in SPEC.periods for c in (f"r_ac{n}", f"rank_ac{n}"))
SMOOTHED = f"{DATA}, l AS (SELECT * FROM (SELECT *, {_LEADS} FROM d) WHERE sample = 1), {_corr_sql('l', AC)}, y AS (SELECT date, {_SMOOTH} FROM z), y2 AS (SELECT date, {_LATER} FROM y)"
query("R-12_smoothed_autocorrelation", rounded_sql(f"{SMOOTHED}\nFINALLY SELECT * FROM y2", _names(AC), "date"))(lambda spark, sf: rounded(testers.autocorrelation(data(spark, sf), SPEC, smooth=True)))

IC = {n: ("factor", n) for n in DS} | {f"g{n[1:]}": ("fg", f"g{n[1:]}") for n in DS}
ICS = f"{DATA}, h AS (SELECT *, {r('factor - AVG(factor) OVER (PARTITION BY date, grp)', 10)} AS fg, {', '.join(r(f'{n} - AVG({n}) OVER (PARTITION BY date, grp)', 10) + f' AS g{n[1:]}' for n in DS)} FROM g), {_corr_sql('h', IC)}"
query("R-13_ic", rounded_sql(f"{ICS}\nFINALLY SELECT * FROM z", _names(IC), "date"))(lambda spark, sf: rounded(testers.ic(data(spark, sf), SPEC, digits=10)))
IC1 = {n: ("factor", n) for n in DS} | {f"g{n[1:]}": ("factor", f"g{n[1:]}") for n in DS}
query("R-14_ic_returns_only", rounded_sql(f"{DATA}, h AS (SELECT *, {', '.join(r(f'{n} - AVG({n}) OVER (PARTITION BY date, grp)', 10) + f' AS g{n[1:]}' for n in DS)} FROM g), {_corr_sql('h', IC1)}\nFINALLY SELECT * FROM z", _names(IC1), "date"))(
    lambda spark, sf: rounded(testers.ic(data(spark, sf), SPEC, "returns_only", digits=10))
)
query("R-15_ic_cumulative", rounded_sql(f"{ICS}\nFINALLY SELECT date, {', '.join(f'CASE WHEN r_{n} IS NOT NULL THEN SUM(r_{n}) OVER (ORDER BY date) END AS r_{n}' for n in DS)} FROM z WHERE YEAR(date) >= 1996", " ".join(f"r_{n}" for n in DS), "date"))(
    lambda spark, sf: rounded(testers.ic_cumulative(testers.ic(data(spark, sf), SPEC, digits=10), [f"r_{n}" for n in DS], "year(date) >= 1996"))
)
query("A-12_monthly_mean", rounded_sql(f"{ICS}\nFINALLY SELECT CAST(DATE_TRUNC('month', date) AS DATE) AS month, {', '.join(f'AVG(r_{n}) AS r_{n}' for n in DS)} FROM z GROUP BY 1", " ".join(f"r_{n}" for n in DS), "month"))(
    lambda spark, sf: rounded(testers.monthly_mean(testers.ic(data(spark, sf), SPEC, digits=10), [f"r_{n}" for n in DS]))
)
_ROLL = _each("AVG(e_#) AS e_#, STDDEV_SAMP(e_#) / SQRT(NULLIF(COUNT(se_#), 0)) AS se_#")
query("A-13_roll_up_year_month", rounded_sql(f"{RTN}\nFINALLY SELECT YEAR(date) AS year, MONTH(date) AS month, factor_quantile, {_ROLL} FROM t GROUP BY 1, 2, 3", ES, "year month factor_quantile"))(
    lambda spark, sf: rounded(testers.roll_up(testers.bucket_returns(data(spark, sf), SPEC)["rtn"], SPEC, ("year", "month")))
)
query("A-13_roll_up_condition", rounded_sql(f"{RTN}\nFINALLY SELECT factor_quantile, {_ROLL} FROM t WHERE MONTH(date) = 1 GROUP BY 1", ES, "factor_quantile"))(
    lambda spark, sf: rounded(testers.roll_up(testers.bucket_returns(data(spark, sf), SPEC)["rtn"], SPEC, (), "month(date) = 1"))
)

CVG = "sf2s x2s f2t s2t"
_SHARES = "date, sfno / NULLIF(CAST(sno AS DOUBLE), 0) AS sf2s, xno / NULLIF(CAST(sno AS DOUBLE), 0) AS x2s, fno / CAST(tno AS DOUBLE) AS f2t, sno / CAST(tno AS DOUBLE) AS s2t"
query("R-17_coverage_all", rounded_sql(f"{DATA}, t AS (SELECT date, COUNT(*) AS tno, COUNT(*) FILTER (sample = 1) AS sfno, COUNT(factor) AS fno, COUNT(*) FILTER (sample <> 0) AS sno, COUNT(*) FILTER (sample = -1) AS xno FROM d GROUP BY 1)\nFINALLY SELECT {_SHARES} FROM t", CVG, "date"))(
    lambda spark, sf: rounded(testers.coverage(data(spark, sf)))
)
query("R-16_coverage", rounded_sql(f"{DATA}, t AS (SELECT date, COUNT(*) AS tno, COUNT(*) FILTER (sample = 1) AS sfno, COUNT(*) FILTER (sample = 1) AS fno, COUNT(*) FILTER (sample > 0) AS sno, COUNT(*) FILTER (sample = -1) AS xno FROM d GROUP BY 1)\nFINALLY SELECT {_SHARES} FROM t", CVG, "date"))(
    lambda spark, sf: rounded(testers.coverage(data(spark, sf), "valid"))
)

MARKET = f"{_weights_sql('demeaned', False)}, f AS (SELECT date, {_each('COALESCE(SUM(weight * #), 0) AS fr_#')} FROM w GROUP BY 1), m AS (SELECT date, {_each('AVG(#) AS me_#')} FROM d GROUP BY 1), j AS (SELECT * FROM f JOIN m USING (date))"


def _alpha(spark, sf):
    rows = data(spark, sf)
    market = rows.groupBy("date").agg(*(F.avg(n).alias(f"me_{n}") for n in DS))
    return testers.alpha_beta(testers.weighted_returns(rows, "demeaned", SPEC), market, SPEC)


_STATS = " UNION ALL ".join(f"SELECT 'd{n}' AS period, REGR_INTERCEPT(fr_d{n}, me_d{n}) AS alpha, REGR_SLOPE(fr_d{n}, me_d{n}) AS beta, POW(REGR_INTERCEPT(fr_d{n}, me_d{n}) + 1, {252 / n}) - 1 AS annual_alpha FROM j" for n in SPEC.periods)
query("A-14_whole_sample_regression", rounded_sql(f"{MARKET}\nFINALLY {_STATS}", "alpha beta annual_alpha", "period"))(lambda spark, sf: rounded(_alpha(spark, sf)["stats"]))
_ROLLING = ", ".join(
    f"CASE WHEN COUNT(me_d{n}) OVER {w} = {k} THEN REGR_INTERCEPT(fr_d{n}, me_d{n}) OVER {w} END AS alpha_d{n}_{w}, CASE WHEN COUNT(me_d{n}) OVER {w} = {k} THEN REGR_SLOPE(fr_d{n}, me_d{n}) OVER {w} END AS beta_d{n}_{w}, CASE WHEN COUNT(me_d{n}) OVER {w} = {k} THEN POW(REGR_INTERCEPT(fr_d{n}, me_d{n}) OVER {w} + 1, {252 / n}) - 1 END AS annual_d{n}_{w}"
    for n in SPEC.periods for w, k in (("y", 252), ("m", 22))
)
_AB = " ".join(f"{c}_d{n}_{w}" for n in SPEC.periods for w in ("1y", "1m") for c in ("alpha", "beta", "annual"))
query(
    "R-18_alpha_beta",
    rounded_sql(f"{MARKET}, v AS (SELECT date, {_ROLLING} FROM j WINDOW y AS (ORDER BY date ROWS BETWEEN 251 PRECEDING AND CURRENT ROW), m AS (ORDER BY date ROWS BETWEEN 21 PRECEDING AND CURRENT ROW))\nFINALLY SELECT date, {', '.join(f'{c[:-2]}{c[-1]} AS {c}' for c in _AB.split())} FROM v", _AB, "date", 6),
)(lambda spark, sf: rounded(_alpha(spark, sf)["dates"], 6))

MODELS = {"m0": ["factor"], "m1": ["factor", "beta"], "m2": ["factor", "beta", "size"]}


def model_rows(spark, sf):
    """Excess returns with a rolling beta on the market and the size."""
    rows = base(spark, sf).where("sample = 1 and factor is not null")
    market = rows.groupBy("date").agg(F.avg("returns").alias("rm"))
    both = rows.join(market, "date")  # a row for each date: small, and AQE broadcasts it by its measured size
    both = both.withColumn("beta", ts.rolling(F.regr_slope, ["returns", "rm"], 20))
    return both.select("sym", "date", (F.col("returns") - 0.0001).alias("rex"), "beta", F.log("marketcap").alias("size"), "factor")


def regression(spark, sf):
    return regress.cross_section_models(model_rows(spark, sf), "rex", MODELS)


@query("A-15_single_regression", rounded_sql(
    f"WITH s AS ({FXS_SQL}), g AS (SELECT date, r, x, COUNT(*) OVER (PARTITION BY date) AS n FROM s), a AS (SELECT date, COUNT(*) AS n, REGR_SLOPE(r, x) AS b, REGR_R2(r, x) AS r2, REGR_SXX(r, x) AS sxx, REGR_SYY(r, x) AS syy FROM g WHERE n >= 7 GROUP BY 1)\nFINALLY SELECT date, b / SQRT((1 - r2) * syy / (n - 2) / sxx) AS t_m0, r2 AS r2_m0 FROM a WHERE syy > 0 AND r2 < 1", "t_m0 r2_m0", "date", 6))
def single_regression(spark, sf):
    from ..functions.cross_section import section

    rows = supplier_panel(spark, sf).withColumn("n", F.count(F.lit(1)).over(section())).where("n >= 7")
    return rounded(regress.cross_section_models(rows, "r", {"m0": ["x"]}), 6)


# Second moments by date, then one regressor after the other taken out of the rest: size, beta, and the factor last.
_PAIRS = {"ff": ("factor", "factor"), "fc": ("factor", "beta"), "fz": ("factor", "size"), "fy": ("factor", "rex"), "cc": ("beta", "beta"), "cz": ("beta", "size"), "cy": ("beta", "rex"), "zz": ("size", "size"), "zy": ("size", "rex"), "yy": ("rex", "rex")}


def _out(p: str, rest: str) -> str:
    """The moments of ``rest`` after the regressor ``p`` is taken out."""
    at = lambda a, b: a + b if a + b in _PAIRS else b + a
    return ", ".join(f"{a}{b} - {at(a, p)} * {at(b, p)} / NULLIF({p}{p}, 0) AS {a}{b}" for i, a in enumerate(rest) for b in rest[i:])


def _stats_sql(m: str, source: str, k: int, regular: str) -> str:
    fit = f"CASE WHEN {regular} AND ff > 1e-12 * ff0 AND n > {k} AND yy0 > 0 AND yy - fy * fy / NULLIF(ff, 0) > 1e-14 * yy0 THEN "
    return f"{m} AS (SELECT date, {fit}fy / ff / SQRT((yy - fy * fy / ff) / ((n - {k}) * ff)) END AS t_{m}, {fit}1 - (yy - fy * fy / ff) / yy0 END AS r2_{m} FROM {source})"


_KEEP = "date, n, ff0, cc0, zz0, yy0"
_MODELS = f"""mb AS (SELECT sym, date, r, LN(fv) AS size, x AS factor FROM s WHERE fv > 20000 AND CAST(sym AS INT) % 7 <> 0), mm AS (SELECT *, AVG(r) OVER (PARTITION BY date) AS rm FROM mb),
  mv AS (SELECT date, r - 0.0001 AS rex, CASE WHEN COUNT(r) OVER w = 20 THEN REGR_SLOPE(r, rm) OVER w END AS beta, size, factor FROM mm WINDOW w AS (PARTITION BY sym ORDER BY date ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)),
  ma AS (SELECT *, ff AS ff0, cc AS cc0, zz AS zz0, yy AS yy0 FROM (SELECT date, COUNT(*) AS n, {', '.join(f'COVAR_POP({a}, {b}) AS {k}' for k, (a, b) in _PAIRS.items())} FROM mv WHERE rex IS NOT NULL AND factor IS NOT NULL AND beta IS NOT NULL AND size IS NOT NULL GROUP BY 1)),
  me AS (SELECT {_KEEP}, {_out('c', 'fy')} FROM ma), mz AS (SELECT {_KEEP}, zz, {_out('z', 'fcy')} FROM ma), mzb AS (SELECT {_KEEP}, zz, cc, {_out('c', 'fy')} FROM mz),
  {_stats_sql('m0', 'ma', 2, 'TRUE')}, {_stats_sql('m1', 'me', 3, 'cc0 > 0')}, {_stats_sql('m2', 'mzb', 4, 'zz > 0 AND cc > 1e-12 * cc0')}, mj AS (SELECT * FROM m0 JOIN m1 USING (date) JOIN m2 USING (date)),
  mr AS (SELECT date, {', '.join(f'CASE WHEN COUNT({c}) OVER w >= 30 THEN AVG({c}) OVER w END AS {n}' for n, c in (('gain_m1', '(r2_m1 - r2_m0)'), ('gain_m2', '(r2_m2 - r2_m0)'), ('share_t', 'CAST(ABS(t_m2) > 2 AS INT)')))} FROM mj WINDOW w AS (ORDER BY date ROWS BETWEEN 251 PRECEDING AND CURRENT ROW))"""
_FITS, _GAINS = " ".join(f"t_{m} r2_{m}" for m in MODELS), "gain_m1 gain_m2 share_t"
query("A-15_multi_regression", rounded_sql(f"WITH s AS ({FXS_SQL}), {_MODELS}\nFINALLY SELECT * FROM mj", _FITS, "date", 6))(lambda spark, sf: rounded(regression(spark, sf), 6))
query("R-19_cs_regression", rounded_sql(f"WITH s AS ({FXS_SQL}), {_MODELS}\nFINALLY SELECT * FROM mr", _GAINS, "date", 6))(lambda spark, sf: rounded(regress.model_summary(regression(spark, sf)), 6))
_COUNTS = "cn AS (SELECT date, COUNT(*) AS tno, COUNT(*) FILTER (sample = 1) AS sfno, COUNT(factor) AS fno, COUNT(*) FILTER (sample <> 0) AS sno, COUNT(*) FILTER (sample = -1) AS xno FROM d GROUP BY 1)"


@query("R-20_core_summary", rounded_sql(f"{SMOOTHED}, {_MODELS}, {_COUNTS}, cv AS (SELECT {_SHARES} FROM cn)\nFINALLY SELECT * FROM mr FULL JOIN y2 USING (date) FULL JOIN cv USING (date)", f"{_GAINS} {_names(AC)} {CVG}", "date", 6))
def core_summary(spark, sf):
    rows = data(spark, sf)
    return rounded(align_by_date([regress.model_summary(regression(spark, sf)), testers.autocorrelation(rows, SPEC, smooth=True), testers.coverage(rows)]), 6)


FACTORS = [chain.Factor("size", "ln(fv)", ["zscore"]), chain.Factor("volume", "x", ["rank"]), chain.Factor("again", "ln(fv)", [("fill_const", 0.0), "demean"], date_range=("1996-01-01", "1997-12-31"))]


@query("R-21_batch_factors", f"WITH s AS ({FXS_SQL}), d AS (SELECT *, DENSE_RANK() OVER (PARTITION BY date ORDER BY x) AS k FROM s), a AS (SELECT sym, date, 'size' AS name, (LN(fv) - AVG(LN(fv)) OVER (PARTITION BY date)) / NULLIF(STDDEV_SAMP(LN(fv)) OVER (PARTITION BY date), 0) AS factor FROM s UNION ALL SELECT sym, date, 'volume', (k - 1) / NULLIF(CAST(MAX(k) OVER (PARTITION BY date) AS DOUBLE) - 1, 0) FROM d UNION ALL SELECT * FROM (SELECT sym, date, 'again', COALESCE(LN(fv), 0) - AVG(COALESCE(LN(fv), 0)) OVER (PARTITION BY date) FROM s) WHERE date BETWEEN DATE '1996-01-01' AND DATE '1997-12-31') SELECT sym, date, name, {r('factor')} AS factor FROM a")
def batch_factors(spark, sf):
    parts = [df.withColumn("name", F.lit(n)) for n, df in chain.batch_factors(supplier_panel(spark, sf), FACTORS).items()]
    return rounded(parts[0].union(parts[1]).union(parts[2]).select("sym", "date", "name", "factor"))


@query("N-07_pipeline", f"WITH s AS ({FXS_SQL}), w AS (SELECT sym, date, LEAST(GREATEST(x, QUANTILE_CONT(x, 0.05) OVER (PARTITION BY date)), QUANTILE_CONT(x, 0.95) OVER (PARTITION BY date)) AS f FROM s) SELECT sym, date, {r('f - AVG(f) OVER (PARTITION BY date)')} AS factor FROM w")
def pipeline(spark, sf):
    return rounded(chain.pipeline(supplier_panel(spark, sf).select("sym", "date", F.col("x").alias("factor")), ["winsorize", "demean"]))


query("A-06_mean_and_error", rounded_sql(f"WITH s AS ({FXS_SQL})\nFINALLY SELECT date, ic, AVG(r) AS e_r, STDDEV_SAMP(r) / SQRT(COUNT(r)) AS se_r FROM s GROUP BY 1, 2", "e_r se_r", "date ic"))(lambda spark, sf: rounded(supplier_panel(spark, sf).groupBy("date", "ic").agg(*testers.mean_and_error(["r"]))))
_XY = {"xf": ("x", "fv")}
query("A-07_A-08_correlations", rounded_sql(f"WITH s AS ({FXS_SQL}), {_corr_sql('s', _XY)}\nFINALLY SELECT * FROM z", _names(_XY), "date"))(lambda spark, sf: rounded(testers.correlations(supplier_panel(spark, sf), _XY)))


@query("A-09_weighted_mean", rounded_sql(f"WITH s AS ({FXS_SQL}), w AS (SELECT *, x - AVG(x) OVER (PARTITION BY date) AS w FROM s)\nFINALLY SELECT date, SUM(w * r) / NULLIF(SUM(ABS(w)), 0) AS both_sides, SUM(GREATEST(w, 0) * r) / NULLIF(SUM(GREATEST(w, 0)), 0) AS long_only, AVG(CASE WHEN ic = '1' THEN r END) AS in_one FROM w GROUP BY 1", "both_sides long_only in_one", "date"))
def weighted_mean(spark, sf):
    from ..functions.cross_section import demean

    rows, w = supplier_panel(spark, sf).withColumn("w", demean("x")), F.col("w")
    long = F.greatest(w, F.lit(0.0))
    return rounded(rows.groupBy("date").agg(F.try_divide(F.sum(w * F.col("r")), F.sum(F.abs(w))).alias("both_sides"), F.try_divide(F.sum(long * F.col("r")), F.sum(long)).alias("long_only"), F.avg(F.when(F.col("ic") == "1", F.col("r"))).alias("in_one")))
