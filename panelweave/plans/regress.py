"""Regressions by date, from sums that combine before the shuffle."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A regressor of which the others leave less than this share of its variance makes a model singular.
SINGULAR = 1e-12
#: A residual of less than this share of the variance is a perfect fit, which has no t.
PERFECT = 1e-14


def _pair(a: str, b: str) -> str:
    return f"__m_{min(a, b)}_{max(a, b)}"


def cross_section_models(df: DataFrame, y: str, models: Mapping[str, Sequence[str]], date: str = "date") -> DataFrame:
    """date, and for each model (a list of regressors besides the intercept) the first regressor's t and R².

    Rows with a null among the columns of any model are left out. Only second moments, a handful of numbers by date, are
    shuffled. The small systems are eliminated in Column arithmetic, the first regressor last: what the others leave
    of it and of ``y`` gives its t. Null where a model has no degrees of freedom, is singular or fits perfectly.
    """
    names = list(dict.fromkeys([*(u for used in models.values() for u in used), y]))
    short = {n: f"{i:03d}" for i, n in enumerate(names)}
    whole = df.dropna(subset=names)
    value = {n: F.col(n).cast("double") for n in names}
    moments = [F.covar_pop(value[a], value[b]).alias(_pair(short[a], short[b])) for i, a in enumerate(names) for b in names[i:]]
    rows = whole.groupBy(date).agg(F.count(F.lit(1)).alias("__n"), *moments)
    kept: list[str] = []
    for model, used in models.items():
        rows = _eliminated(rows, [short[u] for u in used], short[y], len(used) + 1, f"t_{model}", f"r2_{model}")
        kept += [f"t_{model}", f"r2_{model}"]
    return rows.select(date, *kept)


def _eliminated(rows: DataFrame, used: Sequence[str], y: str, unknowns: int, t: str, r2: str) -> DataFrame:
    """``rows`` with ``t`` and ``r2`` of one model; each elimination is a projection of its own, so that no expression is repeated."""
    order = [*dict.fromkeys(reversed(used)), y]
    now: dict[str, Column] = {_pair(a, b): F.col(_pair(a, b)) for a in order for b in order}
    regular = F.lit(True)
    for i, p in enumerate(order[:-1]):
        regular = regular & (now[_pair(p, p)] > SINGULAR * F.col(_pair(p, p)))
        if p == order[-2]:
            break
        step = {}
        for k, a in enumerate(order[i + 1 :], i + 1):
            for b in order[k:]:
                step[f"__{t}_{i}{_pair(a, b)}"] = now[_pair(a, b)] - F.try_divide(now[_pair(p, a)] * now[_pair(p, b)], now[_pair(p, p)])
        rows = rows.withColumns(step)
        now = {_pair(a, b): F.col(f"__{t}_{i}{_pair(a, b)}") for a in order[i + 1 :] for b in order[i + 1 :]}
    first = order[-2]
    s_xx, s_xy, s_yy, total, free = now[_pair(first, first)], now[_pair(first, y)], now[_pair(y, y)], F.col(_pair(y, y)), F.col("__n") - unknowns
    rest = s_yy - F.try_divide(s_xy * s_xy, s_xx)
    sound = regular & (free > 0) & (total > 0) & (rest > PERFECT * total)
    return rows.withColumns({t: F.when(sound, F.try_divide(s_xy, s_xx) / F.sqrt(F.try_divide(rest, free * s_xx))), r2: F.when(sound, 1 - F.try_divide(rest, total))})


def model_summary(stats: DataFrame, window: int = 252, least: int = 30) -> DataFrame:
    """Rolling means of the gain in R² of m1 and m2 over m0, and the share of dates with |t| of m2 over 2."""
    frame = Window.orderBy("date").rowsBetween(-(window - 1), 0)  # one row per date
    mean = lambda c: F.when(F.count(c).over(frame) >= least, F.avg(c).over(frame))
    big = (F.abs("t_m2") > 2).cast("double")
    return stats.select("date", mean(F.col("r2_m1") - F.col("r2_m0")).alias("gain_m1"), mean(F.col("r2_m2") - F.col("r2_m0")).alias("gain_m2"), mean(big).alias("share_t"))
