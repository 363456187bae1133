"""W and T: window functions over dates and along symbols; N: scalar functions and null filling."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..fixtures import FXS_SQL, event_panel, supplier_panel, table
from ..functions import cross_section as cs
from ..functions import order_statistics as order
from ..functions import scalar as sc
from ..functions import time_series as ts
from .registry import SQL, E, S, column, query, r, rounded

D = "OVER (PARTITION BY date)"
#: Rows of a symbol from which on it is spread over tasks: few, so that the given panels have long symbols.
LONG = 100
RANK = "(RANK() OVER (PARTITION BY date ORDER BY x) + (COUNT(*) OVER (PARTITION BY date, x) - 1) / 2.0)"

column("W-01_cs_calc", lambda: cs.cs_calc(F.max("x")), f"MAX(x) {D}")
column("W-02_cs_corr", lambda: F.when(F.count("x").over(cs.section()) >= 3, cs.cs_corr("x", "fv")), f"CASE WHEN COUNT(x) {D} >= 3 THEN CORR(x, fv) {D} END")
column("W-03_cs_scale", lambda: cs.cs_scale("x", 2.0), f"x * 2 / NULLIF(SUM(ABS(x)) {D}, 0)")
column("W-04_cs_zscore", lambda: cs.cs_zscore("x"), f"(x - AVG(x) {D}) / NULLIF(STDDEV_SAMP(x) {D}, 0)")
column("W-05_cs_minmax", lambda: cs.cs_minmax("x", -1, 1), f"-1 + 2 * (x - MIN(x) {D}) / NULLIF(MAX(x) {D} - MIN(x) {D}, 0)")
column("W-06_cs_3sigma", lambda: cs.cs_3sigma("fv"), f"CASE WHEN fv > AVG(fv) {D} + 3 * STDDEV_SAMP(fv) {D} THEN AVG(fv) {D} + 3 * STDDEV_SAMP(fv) {D} WHEN fv < AVG(fv) {D} - 3 * STDDEV_SAMP(fv) {D} THEN AVG(fv) {D} - 3 * STDDEV_SAMP(fv) {D} ELSE fv END")
column("W-07_cs_winsorize", lambda: cs.cs_winsorize("x", 0.1, 0.9), f"CASE WHEN x > QUANTILE_CONT(x, 0.9) {D} THEN QUANTILE_CONT(x, 0.9) {D} WHEN x < QUANTILE_CONT(x, 0.1) {D} THEN QUANTILE_CONT(x, 0.1) {D} ELSE x END")
column("W-08_cs_indneutralize", lambda: cs.cs_indneutralize("x", "ic"), "(x - AVG(x) OVER w) / NULLIF(STDDEV_SAMP(x) OVER w, 0)", "WINDOW w AS (PARTITION BY ic, date)")
column("W-09_cs_capneutralize", lambda: F.when(F.count("x").over(cs.section()) >= 3, cs.cs_capneutralize("x", "fv")), f"CASE WHEN COUNT(x) {D} >= 3 THEN x - (REGR_INTERCEPT(x, fv) {D} + REGR_SLOPE(x, fv) {D} * fv) END", digits=4)
column("W-10_cs_rank", lambda: cs.cs_rank("x"), "(k - 1) / NULLIF(CAST(MAX(k) OVER (PARTITION BY date) AS DOUBLE) - 1, 0)", source="(SELECT *, DENSE_RANK() OVER (PARTITION BY date ORDER BY x) AS k FROM s)")
column("W-11_rank_avg", lambda: cs.rank_avg("x"), RANK)
column("W-12_rank_to_normal", lambda: cs.rank_to_normal(cs.ds_rank("x")), """CASE
  WHEN p < 0.02425 THEN ((((((-7.784894002430293e-03 * zl - 3.223964580411365e-01) * zl - 2.400758277161838e00) * zl - 2.549732539343734e00) * zl + 4.374664141464968e00) * zl + 2.938163982698783e00) / ((((7.784695709041462e-03 * zl + 3.224671290700398e-01) * zl + 2.445134137142996e00) * zl + 3.754408661907416e00) * zl + 1.0))
  WHEN p <= 0.97575 THEN ((((((-3.969683028665376e01 * r2 + 2.209460984245205e02) * r2 - 2.759285104469687e02) * r2 + 1.383577518672690e02) * r2 - 3.066479806614716e01) * r2 + 2.506628277459239e00) * (p - 0.5) / (((((-5.447609879822406e01 * r2 + 1.615858368580409e02) * r2 - 1.556989798598866e02) * r2 + 6.680131188771972e01) * r2 - 1.328068155288572e01) * r2 + 1.0))
  ELSE -((((((-7.784894002430293e-03 * zr - 3.223964580411365e-01) * zr - 2.400758277161838e00) * zr - 2.549732539343734e00) * zr + 4.374664141464968e00) * zr + 2.938163982698783e00) / ((((7.784695709041462e-03 * zr + 3.224671290700398e-01) * zr + 2.445134137142996e00) * zr + 3.754408661907416e00) * zr + 1.0)) END""",
       source=f"(SELECT sym, date, p, (p - 0.5) * (p - 0.5) AS r2, SQRT(-2 * LN(p)) AS zl, SQRT(-2 * LN(1 - p)) AS zr FROM (SELECT sym, date, {RANK} / (COUNT(x) {D} + 1.0) AS p FROM s))", digits=6)
column("W-13_cs_quantile", lambda: cs.cs_quantile("x", 0.3), f"QUANTILE_CONT(x, 0.3) {D}")
column("W-14_cs_qcut", lambda: cs.cs_qcut("x", 5).cast("double"), "1.0 + " + " + ".join(f"CAST(x > QUANTILE_CONT(x, {i / 5}) {D} AS INT)" for i in range(1, 5)))
column("W-15_bucket", lambda: cs.bucket("x", 5).cast("double"), f"CAST(LEAST(GREATEST(CEIL(ROUND({RANK} / COUNT(x) {D} * 5, 9)), 1), 5) AS DOUBLE)")
column("W-16_ds_rank", lambda: cs.ds_rank("x"), f"{RANK} / (COUNT(x) {D} + 1.0)")


def _by_sample(spark, sf):
    """Ranks and standard scores inside (date, sample), 0 outside the sample."""
    rows = supplier_panel(spark, sf).withColumn("sample", (F.col("fv") > 20000).cast("int"))
    by = ("date", "sample")
    return rounded(rows.select("sym", "date", cs.in_sample(cs.ds_rank("x", by)).alias("rank"), cs.in_sample(cs.cs_zscore("x", by)).alias("z"), cs.in_sample(cs.demean("x", by)).alias("d")))


query("W-16_ds_rank_by_sample", f"""{S}, p AS (SELECT *, CAST(fv > 20000 AS INT) AS sample FROM s),
  k AS (SELECT *, COUNT(x) OVER w AS n, AVG(x) OVER w AS m, STDDEV_SAMP(x) OVER w AS sd, RANK() OVER (PARTITION BY date, sample ORDER BY x) + (COUNT(*) OVER (PARTITION BY date, sample, x) - 1) / 2.0 AS k FROM p WINDOW w AS (PARTITION BY date, sample))
  SELECT sym, date, {r("sample * k / (n + 1.0)")} AS rank, {r("sample * (x - m) / NULLIF(sd, 0)")} AS z, {r("sample * (x - m)")} AS d FROM k""")(_by_sample)
column("W-17_demean", lambda: cs.demean("x", ("date", "ic")), "x - AVG(x) OVER (PARTITION BY date, ic)")

O = "OVER (PARTITION BY sym ORDER BY date)"
W = "WINDOW w AS (PARTITION BY sym ORDER BY date ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)"


def rolling(name: str, value, sql: str, digits: int = 6) -> None:
    column(name, value, f"CASE WHEN COUNT(x) OVER w = 10 THEN {sql} END", W, digits=digits)


column("T-01_ts_lag", lambda: ts.ts_lag("x", 3), f"LAG(x, 3) {O}")
column("T-01_ts_shift", lambda: ts.ts_shift("x", -2), f"LEAD(x, 2) {O}")
column("T-02_ts_diff", lambda: ts.ts_diff("x", 2), f"x - LAG(x, 2) {O}")
column("T-03_ts_ret", lambda: ts.ts_ret("fv", 1), f"fv / NULLIF(LAG(fv, 1) {O}, 0) - 1")
column("T-03_ts_ret_forward", lambda: ts.ts_ret("fv", -2), f"LEAD(fv, 2) {O} / NULLIF(fv, 0) - 1")
column("T-04_ts_cret", lambda: ts.ts_cret("r", 10), "CASE WHEN COUNT(r) OVER w = 10 THEN EXP(SUM(LN(1 + r)) OVER w) - 1 END", W)
column("T-04_ts_cret_forward", lambda: ts.ts_cret("r", -5), "CASE WHEN COUNT(r) OVER f = 5 THEN EXP(SUM(LN(1 + r)) OVER f) - 1 END", "WINDOW f AS (PARTITION BY sym ORDER BY date ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING)")
rolling("T-06_ts_corr", lambda: ts.ts_corr("x", "fv", 10), "CORR(x, fv) OVER w")
rolling("T-07_ts_cov", lambda: ts.ts_cov("x", "fv", 10), "COVAR_SAMP(x, fv) OVER w", 2)
rolling("T-08_ts_min", lambda: ts.ts_min("x", 10), "MIN(x) OVER w")
rolling("T-08_ts_max", lambda: ts.ts_max("x", 10), "MAX(x) OVER w")
rolling("T-09_ts_avg", lambda: ts.ts_avg("x", 10), "AVG(x) OVER w")
rolling("T-09_ts_std", lambda: ts.ts_std("x", 10), "STDDEV_SAMP(x) OVER w")
rolling("T-09_ts_var", lambda: ts.ts_var("x", 10), "VAR_SAMP(x) OVER w")
rolling("T-10_ts_median", lambda: ts.ts_median("x", 10), "MEDIAN(x) OVER w")
rolling("T-10_ts_quantile", lambda: ts.ts_quantile("x", 10, 0.2), "QUANTILE_CONT(x, 0.2) OVER w")


@query("T-10_sliding_quantiles", f"{S} SELECT sym, date, {r('CASE WHEN COUNT(x) OVER v = 60 THEN QUANTILE_CONT(x, 0.1) OVER v END')} AS low, {r('CASE WHEN COUNT(x) OVER v = 60 THEN MEDIAN(x) OVER v END')} AS mid, {r('CASE WHEN COUNT(x) OVER v = 60 THEN QUANTILE_CONT(x, 0.95) OVER v END')} AS high FROM s WINDOW v AS (PARTITION BY sym ORDER BY date ROWS BETWEEN 59 PRECEDING AND CURRENT ROW)")
def sliding_quantiles(spark, sf):
    return rounded(order.with_quantiles(supplier_panel(spark, sf).select("sym", "date", "x"), "x", 60, {"low": 0.1, "mid": 0.5, "high": 0.95}, block_rows=1000).drop("x"))


MOMENTS = "(SELECT sym, date, x, n, m1 AS m, m2 - m1 * m1 AS v, m3 - 3 * m1 * m2 + 2 * m1 * m1 * m1 AS c3, m4 - 4 * m1 * m3 + 6 * m1 * m1 * m2 - 3 * m1 * m1 * m1 * m1 AS c4 FROM (SELECT sym, date, x, COUNT(x) OVER w AS n, AVG(x) OVER w AS m1, AVG(x * x) OVER w AS m2, AVG(x * x * x) OVER w AS m3, AVG(x * x * x * x) OVER w AS m4 FROM s " + W + "))"
column("T-11_ts_kurtosis", lambda: F.when(ts.ts_var("x", 10) > 1e-6, ts.ts_kurtosis("x", 10)), "CASE WHEN n = 10 AND v > 1e-6 THEN c4 / (v * v) - 3 END", source=MOMENTS, digits=5)
column("T-11_ts_skew", lambda: F.when(ts.ts_var("x", 10) > 1e-6, ts.ts_skew("x", 10)), "CASE WHEN n = 10 AND v > 1e-6 THEN c3 / POW(v, 1.5) END", source=MOMENTS, digits=5)
column("T-12_ts_ema", lambda: ts.ts_ema("x", 5), "y", source="""(WITH n AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY sym ORDER BY date) AS k FROM s)
  SELECT a.sym, a.date, SUM(b.x * POW(2 / 3.0, a.k - b.k)) / SUM(POW(2 / 3.0, a.k - b.k)) AS y FROM n a JOIN n b ON a.sym = b.sym AND b.k BETWEEN a.k - 97 AND a.k GROUP BY 1, 2)""")
query("T-12_ema_by_blocks", SQL["T-12_ts_ema"])(lambda spark, sf: rounded(ts.with_ema(supplier_panel(spark, sf), "v", "x", 5).select("sym", "date", "v")))
column("T-13_ts_ols_slope", lambda: ts.ts_ols("r", "x", 10)[0], "CASE WHEN COUNT(x) OVER w = 10 AND STDDEV_POP(x) OVER w > 1e-9 THEN REGR_SLOPE(r, x) OVER w END", W)
column("T-13_ts_ols_intercept", lambda: ts.ts_ols("r", "x", 10)[1], "CASE WHEN COUNT(x) OVER w = 10 AND STDDEV_POP(x) OVER w > 1e-9 THEN REGR_INTERCEPT(r, x) OVER w END", W)
_G = "COVAR_POP(#, $) OVER w"
_OLS2 = f"""(SELECT sym, date, n, (a1 * s22 - a2 * s12) / NULLIF(s11 * s22 - s12 * s12, 0) AS b1, (a2 * s11 - a1 * s12) / NULLIF(s11 * s22 - s12 * s12, 0) AS b2, m0, m1, m2, s11 * s22 - s12 * s12 AS det FROM
  (SELECT sym, date, COUNT(x) OVER w AS n, VAR_POP(x) OVER w AS s11, VAR_POP(l) OVER w AS s22, COVAR_POP(x, l) OVER w AS s12, COVAR_POP(r, x) OVER w AS a1, COVAR_POP(r, l) OVER w AS a2, AVG(r) OVER w AS m0, AVG(x) OVER w AS m1, AVG(l) OVER w AS m2
   FROM (SELECT *, LN(fv) AS l FROM s) {W}))"""


@query("T-13_ts_ols_two_regressors", f"{S} SELECT sym, date, {r('b1', 6)} AS b1, {r('b2', 6)} AS b2, {r('m0 - b1 * m1 - b2 * m2', 6)} AS a FROM {_OLS2} WHERE n = 10 AND det > 1e-6")
def ols_two(spark, sf):
    b1, b2, a = ts.ts_ols("r", ["x", F.log("fv")], 10)
    w = ts.series().rowsBetween(-9, 0)
    det = F.var_pop("x").over(w) * F.var_pop(F.log("fv")).over(w) - F.pow(F.covar_pop("x", F.log("fv")).over(w), 2)
    rows = supplier_panel(spark, sf).select("sym", "date", b1.alias("b1"), b2.alias("b2"), a.alias("a"), det.alias("det"))
    return rounded(rows.where("b1 is not null and det > 1e-6").drop("det"), 6)


column("T-14_ts_weighted_beta", lambda: ts.ts_weighted_beta("r", "x", 10, 5), "b", source="""(WITH n AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY sym ORDER BY date) AS k FROM s),
  g AS (SELECT a.sym, a.date, COUNT(*) AS m, SUM(w) AS sw, SUM(w * b.x) AS sx, SUM(w * b.r) AS sy, SUM(w * b.x * b.x) AS sxx, SUM(w * b.x * b.r) AS sxy FROM n a JOIN (SELECT *, 1 AS one FROM n) b ON a.sym = b.sym AND b.k BETWEEN a.k - 9 AND a.k, LATERAL (SELECT POW(2, (b.k - a.k) / 5.0) AS w) GROUP BY 1, 2)
  SELECT sym, date, CASE WHEN m = 10 THEN (sw * sxy - sx * sy) / NULLIF(sw * sxx - sx * sx, 0) END AS b FROM g)""")
query("T-14_weighted_beta_blocks", f"""{S}, n AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY sym ORDER BY date) AS k FROM s),
  g AS (SELECT a.sym, a.date, COUNT(*) AS m, SUM(w) AS sw, SUM(w * b.x) AS sx, SUM(w * b.r) AS sy, SUM(w * b.x * b.x) AS sxx, SUM(w * b.x * b.r) AS sxy FROM n a JOIN n b ON a.sym = b.sym AND b.k BETWEEN a.k - 59 AND a.k, LATERAL (SELECT POW(2, (b.k - a.k) / 20.0) AS w) GROUP BY 1, 2)
  SELECT sym, date, {r('CASE WHEN m = 60 THEN (sw * sxy - sx * sy) / NULLIF(sw * sxx - sx * sx, 0) END', 7)} + 0.0 AS v FROM g""")(
    lambda spark, sf: rounded(ts.with_weighted_beta(supplier_panel(spark, sf), "v", "r", "x", 60, 20).select("sym", "date", "v"), 7)
)
column("T-15_ffill", lambda: ts.ffill(F.when(F.col("x") > 30, F.col("x"))), "LAST_VALUE(CASE WHEN x > 30 THEN x END IGNORE NULLS) OVER (PARTITION BY sym ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)")
column("T-16_rolling_min_samples", lambda: ts.ts_avg("x", 10, least=3), "CASE WHEN COUNT(x) OVER w >= 3 THEN AVG(x) OVER w END", W)
column("T-17_cumulative_compound", lambda: ts.cumulative_compound(F.col("r") / 100), "EXP(SUM(LN(1 + r / 100)) OVER (PARTITION BY sym ORDER BY date)) - 1", digits=7)
rolling("T-18_ts_sum", lambda: ts.ts_sum("x", 10), "SUM(x) OVER w")


@query("T-05_fwd_returns", f"""{S}, c AS (SELECT *, SUM(LN(1 + r)) OVER (PARTITION BY sym ORDER BY date) AS cum FROM s)
  SELECT sym, date, {r('EXP(LEAD(cum, 1) OVER w - cum) - 1')} AS d1, {r('EXP(LEAD(cum, 5) OVER w - cum) - 1')} AS d5, {r('EXP(LEAD(cum, 10) OVER w - cum) - 1')} AS d10 FROM c WINDOW w AS (PARTITION BY sym ORDER BY date)""")
def fwd(spark, sf):
    return rounded(ts.fwd_returns(supplier_panel(spark, sf), "r", (1, 5, 10), digits=14).select("sym", "date", "d1", "d5", "d10"))


#: Every 7th return missing and every 31st a total loss.
GAPS_SQL = f"""{S}, numbered AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY sym ORDER BY date) AS k FROM s),
  p AS (SELECT sym, date, ic, fv, x, CASE WHEN k % 7 = 0 THEN NULL WHEN k % 31 = 5 THEN -1.0 ELSE r END AS r FROM numbered)"""
#: What lies ahead by definition: a product of the next rows, between two returns that are there.
_AHEAD = ", ".join(f"CASE WHEN r IS NOT NULL AND LEAD(r, {n}) OVER w IS NOT NULL THEN PRODUCT(1 + COALESCE(r, 0)) OVER (PARTITION BY sym ORDER BY date ROWS BETWEEN 1 FOLLOWING AND {n} FOLLOWING) - 1 END AS d{n}" for n in (1, 5, 10))
GAPS_AHEAD = f"{GAPS_SQL}, ahead AS (SELECT *, {_AHEAD} FROM p WINDOW w AS (PARTITION BY sym ORDER BY date))"
_D3 = ", ".join(f"{r(f'd{n}')} AS d{n}" for n in (1, 5, 10))


def gaps_panel(spark, sf):
    k = F.row_number().over(ts.series())
    return supplier_panel(spark, sf).withColumn("r", F.when(k % 7 == 0, None).when(k % 31 == 5, -1.0).otherwise(F.col("r")))


query("T-05_fwd_returns_gaps", f"{GAPS_AHEAD} SELECT sym, date, {_D3} FROM ahead")(lambda spark, sf: rounded(ts.fwd_returns(gaps_panel(spark, sf), "r", (1, 5, 10)).select("sym", "date", "d1", "d5", "d10")))
query("T-05_fwd_returns_long_symbols", f"{GAPS_AHEAD} SELECT sym, date, {_D3} FROM ahead")(lambda spark, sf: rounded(ts.fwd_returns(gaps_panel(spark, sf), "r", (1, 5, 10), block_rows=LONG).select("sym", "date", "d1", "d5", "d10")))
_LOSS = f"{GAPS_SQL} SELECT sym, date, {r('PRODUCT(1 + r) OVER (PARTITION BY sym ORDER BY date) - 1', 7)} AS v FROM p"
query("T-17_compound_total_loss", _LOSS)(lambda spark, sf: rounded(gaps_panel(spark, sf).select("sym", "date", ts.cumulative_compound("r").alias("v")), 7))
query("T-17_compound_long_symbols", _LOSS)(lambda spark, sf: rounded(ts.with_compound(gaps_panel(spark, sf), "v", "r", block_rows=LONG).select("sym", "date", "v"), 7))
query("T-04_ts_cret_gaps", f"{GAPS_SQL} SELECT sym, date, {r('CASE WHEN COUNT(r) OVER w = 6 THEN PRODUCT(1 + r) OVER w - 1 END')} AS v FROM p WINDOW w AS (PARTITION BY sym ORDER BY date ROWS BETWEEN 5 PRECEDING AND CURRENT ROW)")(lambda spark, sf: rounded(gaps_panel(spark, sf).select("sym", "date", ts.ts_cret("r", 6).alias("v"))))
query("T-15_ffill_long_symbols", SQL["T-15_ffill"])(lambda spark, sf: rounded(ts.with_ffill(supplier_panel(spark, sf), "v", F.when(F.col("x") > 30, F.col("x")), block_rows=LONG).select("sym", "date", "v")))

NULLED = lambda: F.when(F.col("sym").cast("int") % 7 != 0, F.col("x"))
NX = "CASE WHEN CAST(sym AS INT) % 7 <> 0 THEN x END"
column("N-01_fill_const", lambda: sc.fill_const(NULLED(), 0.5), f"COALESCE({NX}, 0.5)")
column("N-01_keep_null", lambda: sc.keep_null(NULLED()), NX)
column("N-02_fill_mean", lambda: sc.fill_cs(NULLED(), "mean"), f"COALESCE({NX}, AVG({NX}) {D})")
column("N-02_fill_median", lambda: sc.fill_cs(NULLED(), "median"), f"COALESCE({NX}, MEDIAN({NX}) {D})")
column("N-04_fill_mean_by_group", lambda: sc.fill_cs(NULLED(), "mean", ("date", "ic")), f"COALESCE({NX}, AVG({NX}) OVER (PARTITION BY date, ic))")
column("N-04_fill_median_by_group", lambda: sc.fill_cs(NULLED(), "median", ("date", "ic")), f"COALESCE({NX}, MEDIAN({NX}) OVER (PARTITION BY date, ic))")
column("N-05_signpow", lambda: sc.signpow(F.col("r") * 100, 2), "SIGN(r * 100) * POW(ABS(r * 100), 2)")
column("N-05_abs_log_cast", lambda: F.log(F.abs(F.col("fv")) + 1) + F.signum(F.col("r")) + F.col("x").cast("int"), "LN(ABS(fv) + 1) + SIGN(r) + CAST(x AS INT)")
column("N-06_min_of", lambda: sc.min_of(NULLED(), F.lit(20.0)), f"CASE WHEN {NX} < 20 THEN {NX} ELSE 20 END")
column("N-06_max_of", lambda: sc.max_of(NULLED(), F.lit(20.0)), f"CASE WHEN {NX} > 20 THEN {NX} ELSE 20 END")
column("N-08_log_market_cap", lambda: sc.log_market_cap("fv"), "LN(GREATEST(fv, 1e-12))")
column("N-09_book_to_price", lambda: sc.book_to_price("x"), "1 / NULLIF(x, 0)")
column("N-11_date_scalars", lambda: (F.year("date") * 100 + F.month("date") + F.dayofyear(F.trunc("date", "MM")) / 1000).cast("double") + F.length(F.date_format("date", "yyyy-MM")), "YEAR(date) * 100 + MONTH(date) + DAYOFYEAR(DATE_TRUNC('month', date)) / 1000.0 + LENGTH(STRFTIME(date, '%Y-%m'))")


@query("N-11_text_scalars", """SELECT o_orderkey, CAST(o_orderdate AS DATE) AS day, STRFTIME(o_orderdate, '%Y-%m') AS month, CAST(STRFTIME(o_orderdate, '%d') AS VARCHAR) AS day_text, CAST(NULL AS DATE) AS none,
    SPLIT_PART(o_orderstatus || '|' || CAST(o_custkey AS VARCHAR), '|', 2) AS customer, YEAR(o_orderdate) AS year FROM orders""")
def text_scalars(spark, sf):
    o = table(spark, sf, "orders").withColumns({"text": sc.date_text("o_orderdate"), "both": F.concat_ws("|", "o_orderstatus", F.col("o_custkey").cast("string"))})
    return o.select("o_orderkey", sc.iso_date("text").alias("day"), sc.prefix("text", 7).alias("month"), sc.split_part("text", "-", 2).alias("day_text"), sc.iso_date("both").alias("none"), sc.split_part("both", "|", 1).alias("customer"), F.year(sc.iso_date("text")).cast("long").alias("year"))


def _mode_sql(by: str, panel: str) -> str:
    on = " AND ".join(f"f.{c} = m.{c}" for c in by.split(", "))
    return f"""{panel}, f AS (SELECT sym, date, ic, CASE WHEN CAST(sym AS INT) % 7 <> 0 THEN ROUND(x) END AS y FROM e),
      k AS (SELECT {by}, y, COUNT(*) AS n FROM f WHERE y IS NOT NULL GROUP BY {by}, y), t AS (SELECT {by}, y FROM k QUALIFY n = MAX(n) OVER (PARTITION BY {by})),
      m AS (SELECT {by}, AVG(y) AS mode FROM t GROUP BY {by}) SELECT sym, f.date, {r("COALESCE(y, mode)")} AS v FROM f LEFT JOIN m ON {on}"""


def _mode(spark, sf, by):
    rows = event_panel(spark, sf).withColumn("v", F.when(F.col("sym").cast("int") % 7 != 0, F.round("x")))
    return rounded(sc.fill_mode(rows, "v", by).select("sym", "date", "v"))


query("N-03_fill_mode", _mode_sql("date", E))(lambda spark, sf: _mode(spark, sf, ("date",)))
query("N-04_fill_mode_by_group", _mode_sql("date, ic", E))(lambda spark, sf: _mode(spark, sf, ("date", "ic")))


@query("P-12_is_sample", f"""WITH s AS ({FXS_SQL}), k AS (SELECT sym, date, ROW_NUMBER() OVER (PARTITION BY sym ORDER BY date) AS i, x < 10 AS s1, x > 90 AS st FROM s),
  f AS (SELECT sym, date, i, COUNT(*) OVER w30 AS n30, SUM(CAST(s1 AS INT)) OVER w30 AS c30, COUNT(*) OVER w252 AS n252, SUM(CAST(st AS INT)) OVER w252 AS c252 FROM k
    WINDOW w30 AS (PARTITION BY sym ORDER BY date ROWS BETWEEN 29 PRECEDING AND CURRENT ROW), w252 AS (PARTITION BY sym ORDER BY date ROWS BETWEEN 251 PRECEDING AND CURRENT ROW))
  SELECT sym, date, NOT (i < 22 OR (n30 = 30 AND c30 > 10) OR (n252 = 252 AND c252 > 0)) AS keep FROM f""")
def is_sample(spark, sf):
    df = supplier_panel(spark, sf).withColumns({"i": F.row_number().over(ts.series()), "s": F.when(F.col("x") < 10, "S").otherwise("T"), "st": F.col("x") > 90})
    return df.select("sym", "date", sc.is_sample().alias("keep"))


@query("N-10_required_fields", f"{S} SELECT sym, date, {r('LN(fv)')} AS factor FROM s")
def required(spark, sf):
    from ..operators.predicates import require_fields

    df = require_fields(supplier_panel(spark, sf), ["sym", "date", "fv"])
    return rounded(require_fields(df.select("sym", "date", F.log("fv").alias("factor")), ["factor"]))

