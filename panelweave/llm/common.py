"""What the operators share: reading, checkpoints, text batches."""

from __future__ import annotations

import tempfile
from collections.abc import Callable, Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

BATCH_ROWS, BATCH_BYTES = 256, 8 << 20
#: Rows of one key from which on it is joined by broadcast, and rows that such a broadcast may have.
HOT_ROWS, BROADCAST_ROWS = 20_000, 500_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder named by the cluster; make one only where none is set and Spark is local (tests)."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="spark-checkpoint-"))


def cut(df: DataFrame) -> DataFrame:
    """Store ``df`` in the checkpoint folder, so that it is computed once and outlives executors."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def join_hot(rows: DataFrame, table: DataFrame, on: Sequence[str], weight: str) -> DataFrame:
    """Inner join of ``rows`` with the stored ``table``, which has one row for each key and, in ``weight``, how many of ``rows`` have it.

    Keys of more than HOT_ROWS rows would fill a task each; they are broadcast, as there are few: at most
    a HOT_ROWS-th of the rows. They are counted first; were they over BROADCAST_ROWS, the join is a plain one.
    """
    on, hot = list(on), table.where(F.col(weight) > HOT_ROWS)
    n = hot.count()
    if not 0 < n <= BROADCAST_ROWS:
        return rows.join(table, on)
    cold = rows.join(F.broadcast(hot.select(*on)), on, "left_anti").join(table.where(F.col(weight) <= HOT_ROWS), on)
    return rows.join(F.broadcast(hot), on).unionByName(cold)


def free_names(columns: Sequence[str], *names: str) -> list[str]:
    """The names with as many underscores behind them as set them apart from ``columns``, whatever their case."""
    taken, out = {c.lower() for c in columns}, []
    for n in names:
        while n.lower() in taken:
            n += "_"
        taken.add(n.lower())
        out.append(n)
    return out


def map_rows(df: DataFrame, run: Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]], more: Sequence[T.StructField] = (), drop: Sequence[str] = ()) -> DataFrame:
    """mapInArrow() over ``df`` whose columns may have any names: inside ``run``, all but ``text`` and those in ``drop`` go by their place.

    ``run`` returns the columns without those in ``drop``, in their order, then those of ``more``.
    """
    names = [c if c == "text" or c in drop else f"c{i}" for i, c in enumerate(df.columns)]
    kept = [(c, T.StructField(n, f.dataType)) for c, n, f in zip(df.columns, names, df.schema.fields, strict=True) if c not in drop]
    return df.toDF(*names).mapInArrow(run, T.StructType([f for _, f in kept] + list(more))).toDF(*(c for c, _ in kept), *(f.name for f in more))


def slices(batches: Iterable[pa.RecordBatch], rows: int = BATCH_ROWS, size: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """Arrow batches cut to at most ``rows`` rows and, beyond one row, ``size`` bytes of text, so that few texts are Python objects at a time."""
    for batch in batches:
        n = batch.num_rows
        used = np.zeros(n + 1, np.int64)
        for column in batch.columns:
            if any(kind(column.type) for kind in (pa.types.is_string, pa.types.is_large_string, pa.types.is_binary)):
                used[1:] += pc.binary_length(column).fill_null(0).to_numpy(zero_copy_only=False)
        used = np.cumsum(used)
        at = 0
        while at < n:
            end = min(max(at + 1, int(np.searchsorted(used, used[at] + size, side="right")) - 1), at + rows, n)
            yield batch.slice(at, end - at)
            at = end


def texts(batch: pa.RecordBatch, name: str = "text") -> list[str]:
    """The column's strings; a null text counts as empty."""
    return [x or "" for x in batch.column(name).to_pylist()]


def held_out(doc_id: Column) -> Column:
    """Rows that labels may not be learned from: crc32 of the id as text, modulo 5, is 0."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, label: str, limit: int) -> DataFrame:
    """Stored (doc_id, text, label): at most ``limit`` labelled rows outside the held-out fold, one for each doc_id.

    The sample is the ``limit`` smallest hashes of the ids, so it is the same on each run. It has a
    fixed bound, hence the broadcast; the documents are filtered as they are scanned. Of rows that
    share an id, the least text counts, and the greatest label.
    """
    sample = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label"))
        .where(F.col("doc_id").isNotNull() & F.col("label").isNotNull() & ~held_out(F.col("doc_id")))
        .groupBy("doc_id")
        .agg(F.max("label").alias("label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(limit)
    )
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(sample), "doc_id")
    return cut(rows.groupBy("doc_id").agg(F.min("text").alias("text"), F.max("label").alias("label")))
