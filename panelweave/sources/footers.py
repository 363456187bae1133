"""Counts and ranges of stored Parquet columns, answered from the files' footers by aggregate push-down."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, ByteType, DataType, DateType, DoubleType, FloatType, IntegerType, LongType, ShortType

from ..session import cut, variant

#: Types whose least and greatest values Spark takes from footers; those of texts may be cut off there, so texts are read.
PUSHED = (BooleanType, ByteType, ShortType, IntegerType, LongType, FloatType, DoubleType, DateType)


def in_footers(type_: DataType) -> bool:
    return isinstance(type_, PUSHED)


def footer_scan(spark: SparkSession, root: str, push: bool = True) -> DataFrame:
    """The table at ``root`` by the second version of the Parquet source, which pushes aggregates to the footers.

    It belongs to a session of its own on the same cluster, see variant(); the user's session keeps its settings.
    """
    own = variant(spark, **{"spark.sql.sources.useV1SourceList": "", "spark.sql.parquet.aggregatePushdown": str(push).lower()})
    return own.read.parquet(root)


def stored_row_count(spark: SparkSession, root: str) -> DataFrame:
    """One row with the number of rows, n_rows, added up from footers; no column is read."""
    return footer_scan(spark, root).agg(F.count(F.lit(1)).alias("n_rows"))


def column_bounds(spark: SparkSession, root: str, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """For each column, and each value of the partition columns ``by``: field, n_rows, lo and hi as text, null_count.

    ``by`` is empty or names all partition columns of the table; then each bucket has its own rows. Numbers, booleans and dates come
    from footers alone: the scan is as long as the list of files, whatever their sizes. Columns of other types (texts, timestamps,
    decimals) are read, in a scan of their own of these columns only. So are numbers and dates where a file's footer has no range of
    one of them, as of a block of nulls or with NaN, which is the greatest value. A column of nulls has null lo and hi; a table without
    rows has n_rows 0 and no bucket. Unknown columns are an error.
    """
    df = footer_scan(spark, root)
    types = {f.name: f.dataType for f in df.schema.fields}
    unknown = [c for c in (*columns, *by) if c not in types]
    if unknown:
        raise ValueError(f"no such column: {', '.join(unknown)}")
    found = []
    if pushed := [c for c in columns if in_footers(types[c])]:
        try:
            found.append(cut(_bounds(df, pushed, by)))
        except Exception as error:
            if "No min/max found" not in str(error):
                raise
            found.append(_bounds(footer_scan(spark, root, push=False), pushed, by))
    if read := [c for c in columns if not in_footers(types[c])]:
        found.append(_bounds(df, read, by))
    if not found:
        raise ValueError("no columns")
    return found[0] if len(found) == 1 else found[0].unionByName(found[1])


def _bounds(df: DataFrame, columns: Sequence[str], by: Sequence[str]) -> DataFrame:
    quoted = [f"`{c.replace('`', '``')}`" for c in columns]
    keys = [F.col(f"`{c.replace('`', '``')}`") for c in by]
    sums = [F.count(F.lit(1)).alias("__n")]
    for i, c in enumerate(quoted):
        sums += [F.min(c).alias(f"__lo{i}"), F.max(c).alias(f"__hi{i}"), F.count(c).alias(f"__k{i}")]
    wide = df.groupBy(*keys).agg(*sums)
    fractions = {c for c, t in df.dtypes if t in ("float", "double")}

    def text(bound: str, i: int, c: str) -> Column:  # a footer's least zero is -0.0, whatever its sign in the rows
        value = F.col(f"__{bound}{i}")
        return (F.when(value == 0, F.abs(value)).otherwise(value) if c in fractions else value).cast("string").alias(bound)

    rows = [F.struct(F.lit(c).alias("field"), F.col("__n").alias("n_rows"), text("lo", i, c), text("hi", i, c), (F.col("__n") - F.col(f"__k{i}")).alias("null_count")) for i, c in enumerate(columns)]
    return wide.select(*keys, F.explode(F.array(*rows)).alias("__row")).select(*keys, "__row.*")
