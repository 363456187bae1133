"""Named operator chains and batches of factors."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import cross_section as cs
from ..functions import scalar as sc
from ..functions import time_series as ts
from ..operators.predicates import batch_formulas

Step = Callable[..., DataFrame]


def _on_factor(fn: Callable) -> Step:
    return lambda df, *args, **options: df.withColumn("factor", fn("factor", *args, **options))


#: Operators of a chain by name; each takes and returns (sym, date, factor).
REGISTRY: dict[str, Step] = {
    "zscore": _on_factor(cs.cs_zscore), "scale": _on_factor(cs.cs_scale), "minmax": _on_factor(cs.cs_minmax), "clip3": _on_factor(cs.cs_3sigma), "winsorize": _on_factor(cs.cs_winsorize), "rank": _on_factor(cs.cs_rank),
    "normal": _on_factor(lambda c: cs.rank_to_normal(cs.ds_rank(c))), "bucket": _on_factor(cs.bucket), "demean": _on_factor(cs.demean), "ffill": _on_factor(ts.ffill), "average": _on_factor(ts.ts_avg), "ema": _on_factor(ts.ts_ema),
    "fill_const": _on_factor(sc.fill_const), "keep_null": _on_factor(sc.keep_null), "fill_mean": _on_factor(lambda c: sc.fill_cs(c, "mean")), "fill_median": _on_factor(lambda c: sc.fill_cs(c, "median")), "fill_mode": lambda df: sc.fill_mode(df, "factor"), "drop_null": lambda df: df.dropna(subset=["factor"]),
}


def register(name: str, step: Step) -> None:
    REGISTRY[name] = step


def pipeline(df: DataFrame, steps: Sequence[str | tuple | Step]) -> DataFrame:
    """Apply steps in order: a name, (name, arguments...), or a function of a DataFrame. An unknown name is an error."""

    def one(df: DataFrame, step: Any) -> DataFrame:
        if callable(step):
            return df.transform(step)
        name, *args = (step,) if isinstance(step, str) else step
        if name not in REGISTRY:
            raise KeyError(f"no operator {name}; there are {', '.join(sorted(REGISTRY))}")
        return REGISTRY[name](df, *args)

    return reduce(one, steps, df)


@dataclass(frozen=True)
class Factor:
    """A formula with its chain, the rows it looks back and the dates it is wanted for."""

    name: str
    formula: str
    steps: Sequence = ()
    window_size: int = 1
    date_range: tuple | None = None
    options: Mapping[str, Any] = field(default_factory=dict)


def compute_factor(sample: DataFrame, factor: Factor, keys: Sequence[str] = ("sym", "date")) -> DataFrame:
    return batch_factors(sample, [factor], keys)[factor.name]


def batch_factors(sample: DataFrame, factors: Sequence[Factor], keys: Sequence[str] = ("sym", "date")) -> dict[str, DataFrame]:
    """Each factor as (keys, factor). One projection evaluates all formulas, and equal formulas once; each has its own chain and range.

    The range cuts after the chain, so that rolling operators see the rows before it.
    """
    distinct = {f: f"__f{i}" for i, f in enumerate(dict.fromkeys(x.formula for x in factors))}
    shared = batch_formulas(sample, keys, {n: f for f, n in distinct.items()})
    out = {}
    for x in factors:
        df = pipeline(shared.select(*keys, F.col(distinct[x.formula]).alias("factor")), x.steps)
        out[x.name] = df.where(F.col(keys[-1]).between(*(F.lit(v) for v in x.date_range))) if x.date_range else df
    return out
