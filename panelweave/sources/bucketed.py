"""Tables stored in buckets by symbol, so that panels and windows by symbol need no shuffle."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from ..session import variant

#: Buckets by symbol serve joins on symbol and date too, and one sorted file a bucket keeps its order in the scan.
SETTINGS = {"spark.sql.requireAllClusterKeysForCoPartition": "false", "spark.sql.legacy.bucketedTableScan.outputOrdering": "true"}


def write_bucketed(df: DataFrame, name: str, buckets: int, sym: str = "sym", date: str = "date", path: str | None = None) -> None:
    """Replace the catalog's table ``name``: one file for each of ``buckets`` hash buckets of ``sym``, sorted by symbol and date.

    The rows are shuffled once, here, and by no later panel or window by symbol. All rows of a symbol are in one bucket, so this
    is for tables whose largest symbol fits a task; longer symbols are for the two-level forms (``block_rows``). Choose the
    number so that a bucket is some 100 MB to 1 GB; tables to be joined need the same one. Null symbols share a bucket.
    With ``path`` the table is external, in a folder that all machines share; else it lies in the warehouse.
    """
    rows = df.repartition(buckets, sym).sortWithinPartitions(sym, date)
    writer = rows.write.mode("overwrite").format("parquet").bucketBy(buckets, sym).sortBy(sym, date)
    (writer.option("path", path) if path else writer).saveAsTable(name)


def read_bucketed(spark: SparkSession, name: str) -> DataFrame:
    """The table ``name`` in a session that uses its buckets and their order; join only with tables read in the same way."""
    return variant(spark, **SETTINGS).table(name)


def bucketed_panel(spark: SparkSession, index: str, members: Sequence[str], sym: str = "sym", date: str = "date") -> DataFrame:
    """Rows of the bucketed table ``index`` with the columns of the bucketed ``members`` at their keys, null where they have none.

    Buckets are merged one by one: no table is shuffled, broadcast or sorted again. Null keys match nothing. A member with several
    rows of a key repeats the index's row; a column that two tables have, but for the keys, is an error.
    """
    own = variant(spark, **SETTINGS)
    out = own.table(index)
    for name in members:
        member = own.table(name)
        both = sorted(set(out.columns) & set(member.columns) - {sym, date})
        if both:
            raise ValueError(f"columns of several tables: {', '.join(both)}")
        out = out.join(member.hint("merge"), [sym, date], "left")
    return out
