"""Column profiles and data checks."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

COLUMNS = ("group", "field", "data_type", "count", "null_count", "nunique", "min", "q25", "q50", "q75", "max", "mean", "min_date", "max_date")
_NUMBER = {"tinyint", "smallint", "int", "bigint", "float", "double"}


def _kind(dtype: str) -> str | None:
    if dtype in _NUMBER or dtype.startswith("decimal"):
        return "numeric"
    return "string" if dtype == "string" else "temporal" if dtype in ("date", "timestamp", "timestamp_ntz") else None


def _order_statistic(x: Column, n: Column, q: float) -> Column:
    """The value at index round(q * (n - 1)) of the sorted values, from a sorted array."""
    return F.get(x, F.floor(q * (n - 1) + 0.5).cast("int"))


def profile(df: DataFrame, group: str | None = None, fields: Sequence[str] | None = None, approximate: bool = False) -> DataFrame:
    """One row for each group and column, in COLUMNS: counts, distinct values (null is one), quantiles, range.

    q25 and q75 are existing values (nearest rank), q50 interpolates. The raw table is never
    unpivoted: each column is counted by (group, value), which combines before the shuffle, and
    quantiles come from running sums over the distinct values. With ``approximate``, quantiles are
    percentile_approx and distinct counts sketches, all in one aggregation without a second shuffle.
    """
    kinds = {c: k for c, t in df.dtypes if (k := _kind(t)) and c != group and (fields is None or c in fields)}
    types = dict(df.dtypes)
    g = F.lit("all") if group is None else F.col(group).cast("string")
    if approximate and kinds:
        return _approximate(df, g, kinds, types)
    if not kinds:  # nothing to describe: no row
        none = df.groupBy(g.alias("group")).agg(F.count(F.lit(1)).alias("count"), F.lit(0).cast("long").alias("null_count"), F.lit(0).cast("long").alias("nunique"))
        return _complete(none, "", "").limit(0)
    parts = []
    g = F.coalesce(g, F.lit("null"))  # a null group is a group of its own
    for c, kind in kinds.items():
        value = F.col(c).cast("double" if kind == "numeric" else "string" if kind == "string" else "timestamp")
        counted = df.groupBy(g.alias("group"), value.alias("v")).agg(F.count(F.lit(1)).alias("n"))
        whole = F.col("v").isNotNull()
        basic = [F.sum("n").alias("count"), F.sum(F.when(~whole, F.col("n")).otherwise(0)).alias("null_count"), F.count(F.lit(1)).alias("nunique")]
        if kind == "numeric":
            rows = F.when(whole, F.col("n")).otherwise(0)
            ranked = _running_counts(counted)
            at = lambda q: F.floor(q * (F.col("total") - 1) + 0.5)
            holds = lambda k: whole & (F.col("upto") > k) & (F.col("upto") - F.col("n") <= k)
            mid = lambda f: F.max(F.when(holds(f((F.col("total") - 1) / 2)), F.col("v")))
            agg = ranked.groupBy("group").agg(
                *basic, F.min("v").alias("min"), F.max(F.when(holds(at(0.25)), F.col("v"))).alias("q25"), ((mid(F.floor) + mid(F.ceil)) / 2).alias("q50"),
                F.max(F.when(holds(at(0.75)), F.col("v"))).alias("q75"), F.max("v").alias("max"), F.try_divide(F.sum(F.col("v") * F.col("n")), F.sum(rows)).alias("mean"),
            )
        elif kind == "temporal":
            agg = counted.groupBy("group").agg(*basic, F.min("v").alias("min_date"), F.max("v").alias("max_date"))
        else:
            agg = counted.groupBy("group").agg(*basic)
        parts.append(_complete(agg, c, types[c]))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _running_counts(counted: DataFrame, bins: int = 64) -> DataFrame:
    """(group, v, n) with ``upto``, the rows of the group up to v, and ``total``; null values count none.

    A group may be the whole table, so its values are not sorted by one task: approximate
    quantiles cut it into bins, of which the sums are few, and only bins are sorted.
    """
    rows = F.when(F.col("v").isNotNull(), F.col("n")).otherwise(0)
    # the count is asked for so that all three uses read the same columns, hence one shuffle of ``counted``
    cuts = counted.groupBy("group").agg(F.percentile_approx("v", [i / bins for i in range(1, bins)]).alias("cuts"), F.max("n").alias("most"))
    cuts = cuts.where("most > 0").drop("most")
    binned = counted.join(cuts, "group").withColumn("bin", F.size(F.filter(F.coalesce("cuts", F.array().cast("array<double>")), lambda c: c < F.col("v"))))
    sums = binned.groupBy("group", "bin").agg(F.sum(rows).alias("m"))
    w = Window.partitionBy("group")
    sums = sums.select("group", "bin", (F.sum("m").over(w.orderBy("bin")) - F.col("m")).alias("before"), F.sum("m").over(w).alias("total"))
    up = Window.partitionBy("group", "bin").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    return binned.drop("cuts").join(sums, ["group", "bin"]).withColumn("upto", F.col("before") + F.sum(rows).over(up))


def _complete(agg: DataFrame, field: str, dtype: str) -> DataFrame:
    have = set(agg.columns) | {"field", "data_type"}
    agg = agg.withColumns({"field": F.lit(field), "data_type": F.lit(dtype)})
    absent = {c: F.lit(None).cast("timestamp" if c.endswith("_date") else "double") for c in COLUMNS if c not in have}
    return agg.withColumns(absent).select(*COLUMNS) if absent else agg.select(*COLUMNS)


def _approximate(df: DataFrame, g: Column, kinds: Mapping[str, str], types: Mapping[str, str]) -> DataFrame:
    aggs = _described(kinds, types)
    wide = df.groupBy(g.alias("group")).agg(*aggs)
    return wide.select("group", F.explode(F.array(*(f"__{i}" for i in range(len(aggs))))).alias("s")).select("group", "s.*")


def _described(kinds: Mapping[str, str], types: Mapping[str, str], accuracy: int = 10_000) -> list[Column]:
    """For each column one struct of the profile's values, from aggregates of bounded size."""
    aggs = []
    for c, kind in kinds.items():
        x = F.col(c)
        null = F.lit(None).cast("double")
        number = kind == "numeric"
        q = F.percentile_approx(x.cast("double"), [0.25, 0.5, 0.75], accuracy) if number else F.array(null, null, null)
        when = (F.min(x).cast("timestamp"), F.max(x).cast("timestamp")) if kind == "temporal" else (F.lit(None).cast("timestamp"),) * 2
        values = [F.lit(c), F.lit(types[c]), F.count(F.lit(1)), F.count_if(x.isNull()), F.approx_count_distinct(x) + F.max(x.isNull().cast("int")), F.min(x.cast("double")) if number else null, q[0], q[1], q[2], F.max(x.cast("double")) if number else null, F.avg(x) if number else null, *when]
        aggs.append(F.struct(*(v.alias(n) for v, n in zip(values, COLUMNS[1:], strict=True))).alias(f"__{len(aggs)}"))
    return aggs


def profile_sets(df: DataFrame, groupings: Sequence[str], fields: Sequence[str] | None = None, accuracy: int = 10_000) -> DataFrame:
    """The profiles of all groupings, "all" or a column, from one scan: ``grouping`` and COLUMNS, a row for each group and column.

    Counts, nulls, ranges and means are exact. Quantiles are existing values whose rank is off by at most 1/``accuracy`` of
    the group's rows, distinct values come from a sketch (5 % relative standard deviation). Each task adds up its groups by
    grouping sets before the one shuffle. A null group is "null"; a grouping does not describe its own column. Columns
    that are neither numbers, strings nor times are left out; with nothing to describe there is no row.
    """
    _known(df, groupings)
    by = list(dict.fromkeys(g for g in groupings if g != "all"))
    kinds = {c: k for c, t in df.dtypes if (k := _kind(t)) and (fields is None or c in fields)}
    # the groups are columns of their own, so that the columns described keep their values in every set
    rows = df.select("*", *(F.coalesce(F.col(c).cast("string"), F.lit("null")).alias(f"__by_{c}") for c in by))
    which, value = F.lit("all"), F.lit("all")
    for c in by:
        here = F.grouping(f"__by_{c}") == 0
        which, value = F.when(here, c).otherwise(which), F.when(here, F.col(f"__by_{c}")).otherwise(value)
    aggs = _described(kinds, dict(df.dtypes), accuracy) or [F.struct(F.lit("").alias("field"), *(F.lit(None).alias(n) for n in COLUMNS[2:])).alias("__0")]
    whole = [[]] if "all" in groupings else []
    sets = rows.groupingSets([*whole, *([F.col(f"__by_{c}")] for c in by)], *(F.col(f"__by_{c}") for c in by))
    wide = sets.agg(which.alias("grouping"), value.alias("group"), *aggs)
    long = wide.select("grouping", "group", F.explode(F.array(*(f"__{i}" for i in range(len(aggs))))).alias("s")).select("grouping", "group", "s.*")
    # the set of the whole table has a row even where the table has none
    return long.where("grouping <> field and count > 0") if kinds else long.limit(0)


def _known(df: DataFrame, groupings: Sequence[str]) -> None:
    if unknown := [g for g in groupings if g != "all" and g not in df.columns]:
        raise ValueError(f"no such column: {', '.join(unknown)}")


def profile_many(df: DataFrame, groupings: Sequence[str], fields: Sequence[str] | None = None) -> dict[str, DataFrame]:
    """A profile for each grouping, "all" or a column; unknown names are an error."""
    _known(df, groupings)
    return {g: profile(df, None if g == "all" else g, fields) for g in groupings}


def grouping_sets_profile(df: DataFrame, by: Sequence[str], field: str) -> DataFrame:
    """count, min, max and mean of one field for several single groupings and the whole, in one pass."""
    which, value = F.lit("all"), F.lit("all")
    for c in reversed(by):
        here = F.grouping(c) == 0
        which = F.when(here, c).otherwise(which)
        value = F.when(here, F.coalesce(F.col(c).cast("string"), F.lit("null"))).otherwise(value)
    sets = df.groupingSets([[], *([F.col(c)] for c in by)], *(F.col(c) for c in by))
    named = sets.agg(which.alias("grouping_by"), value.alias("grouping_value"), F.count(field).alias("n"), F.min(field).alias("lo"), F.max(field).alias("hi"), F.avg(field).alias("mean"))
    return named.drop(*by)


def unique_keys(df: DataFrame, keys: Sequence[str], date: str = "date") -> DataFrame:
    """One row: rows, distinct keys, repeated keys, first and last date. The keys are counted in one shuffle."""
    counted = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"), F.min(date).alias("__lo"), F.max(date).alias("__hi"))
    return counted.agg(
        F.coalesce(F.sum("__n"), F.lit(0)).alias("n_rows"), F.count(F.lit(1)).alias("n_keys"), F.count_if(F.col("__n") > 1).alias("n_repeated"), F.min("__lo").alias("min_date"), F.max("__hi").alias("max_date")
    )


def validate_tables(tables: Mapping[str, DataFrame], keys: Sequence[str]) -> DataFrame:
    """For each table: missing keys, rows, and whether the keys are unique (null where a key is missing)."""
    out = None
    for name, df in tables.items():
        missing = ",".join(k for k in keys if k not in df.columns)
        if missing:
            row = df.agg(F.count(F.lit(1)).alias("n_rows")).withColumn("unique", F.lit(None).cast("boolean"))
        else:
            row = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")).agg(F.coalesce(F.sum("__n"), F.lit(0)).alias("n_rows"), (F.coalesce(F.max("__n"), F.lit(0)) <= 1).alias("unique"))
        row = row.select(F.lit(name).alias("name"), F.lit(missing).alias("missing"), "n_rows", "unique")
        out = row if out is None else out.union(row)
    return out


def check_sample(df: DataFrame, keys: Sequence[str] = ("sym", "date")) -> None:
    _require(df, keys)


def check_factor(df: DataFrame, keys: Sequence[str] = ("sym", "date")) -> str:
    """The name of the one factor column."""
    _require(df, keys)
    rest = [c for c in df.columns if c not in keys]
    if len(rest) != 1:
        raise ValueError(f"expected one factor column, found {len(rest)}")
    return rest[0]


def check_tester(df: DataFrame) -> None:
    _require(df, ("sym", "date", "sample", "returns", "group", "marketcap", "factor"))


def _require(df: DataFrame, columns: Sequence[str]) -> None:
    if missing := [c for c in columns if c not in df.columns]:
        raise ValueError(f"missing: {', '.join(missing)}")
    if not df.take(1):
        raise ValueError("no rows")
