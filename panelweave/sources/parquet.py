"""Parquet tables: scans, partitioned writes, manifests."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

PART = "part"
FORMATS = {"year": "yyyy", "month": "yyyy-MM", "day": "yyyy-MM-dd"}


def scan(spark: SparkSession, root: str | Sequence[str], columns: Sequence[str] | None = None, where: str | Column | None = None, partition: str | Sequence[str] | None = None, exclude: Sequence[str] = (PART,), merge: bool = False) -> DataFrame:
    """Rows of a directory, file or list of files; filter first, then columns, all pushed to the scan.

    ``partition`` keeps buckets whose ``part`` equals or begins with one of the given values, which prunes directories.
    """
    paths = [root] if isinstance(root, str) else list(root)
    reader = spark.read.option("mergeSchema", "true") if merge else spark.read
    df = reader.parquet(*paths)
    if partition is not None:
        wanted = [partition] if isinstance(partition, str) else list(partition)
        hit = F.lit(False)
        for p in wanted:
            hit = hit | F.col(PART).cast("string").startswith(p)
        df = df.where(hit)
    if where is not None:
        df = df.where(F.expr(where) if isinstance(where, str) else where)
    return df.select(*columns) if columns else df.drop(*[c for c in exclude if c in df.columns])


def row_count(df: DataFrame) -> DataFrame:
    """One row with the number of rows; of a plain scan, no column is read."""
    return df.agg(F.count(F.lit(1)).alias("n_rows"))


def with_part(df: DataFrame, granularity: str = "year", date: str = "date") -> DataFrame:
    """``df`` with its bucket, the date up to the year, month or day."""
    return df.withColumn(PART, F.date_format(date, FORMATS[granularity]))


def rebalanced(df: DataFrame, sym: str = "sym", date: str = "date", whole: bool = False) -> DataFrame:
    """``df`` (with its bucket) gathered by bucket and sorted by date and symbol, for a partitioned write.

    The rows are shuffled once. Adaptive execution then splits a bucket that is larger than the session's
    advisory partition size over several tasks and files, and lets small ones share a task: by the measured
    sizes, so nothing is counted beforehand and the input runs once. With ``whole`` a bucket is one task, whose sort spills.
    """
    gathered = df.repartition(F.col(PART)) if whole else df.hint("rebalance", F.col(PART))
    return gathered.sortWithinPartitions(PART, date, sym)


def write_all(df: DataFrame, out: str, granularity: str | None = "year", date: str = "date", sym: str = "sym", whole: bool = False) -> None:
    """Replace a table, in buckets by date (or flat for None), rows sorted by date and symbol within files.

    A large bucket becomes several files, see rebalanced(). With ``whole`` it is one file of any size, so the whole bucket is in order
    and a manifest has one line for each bucket; it is then written by one task. Old buckets go; an empty table keeps its schema.
    """
    if granularity is None:
        df.sortWithinPartitions(date, sym).write.mode("overwrite").option("partitionOverwriteMode", "static").parquet(out)
        return
    parted = rebalanced(with_part(df, granularity, date), sym, date, whole).write.mode("overwrite").option("partitionOverwriteMode", "static")
    (parted.option("maxRecordsPerFile", 0) if whole else parted).partitionBy(PART).parquet(out)


def write_file(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("partitionOverwriteMode", "static").parquet(path)


def manifest(spark: SparkSession, root: str | Sequence[str]) -> DataFrame:
    """path, size and mtime of each file, from a listing: no file is opened, as the content column is not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet")
    m = F.col("_metadata")
    return files.load([root] if isinstance(root, str) else list(root)).select(m["file_path"].alias("path"), m["file_size"].alias("size"), m["file_modification_time"].alias("mtime"))


def manifest_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """path and change (added, removed, changed) between two manifests."""
    o, n = old.toDF("path", "old_size", "old_mtime"), new.toDF("path", "new_size", "new_mtime")
    both = o.join(n, "path", "full")
    change = F.when(F.col("old_size").isNull(), "added").when(F.col("new_size").isNull(), "removed").when((F.col("old_size") != F.col("new_size")) | (F.col("old_mtime") != F.col("new_mtime")), "changed")
    return both.select("path", change.alias("change")).where("change is not null")


def file_column_stats(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """For each file of a scan and column: rows, least and greatest value as text, nulls."""
    path = F.col("_metadata.file_path").alias("path")
    aggs = [F.struct(F.lit(c).alias("field"), F.count(F.lit(1)).alias("n_rows"), F.min(c).cast("string").alias("lo"), F.max(c).cast("string").alias("hi"), F.count_if(F.col(c).isNull()).alias("null_count")).alias(f"s{i}") for i, c in enumerate(columns)]
    wide = df.groupBy(path).agg(*aggs)
    return wide.select("path", F.explode(F.array(*(f"s{i}" for i in range(len(columns))))).alias("s")).select("path", "s.*")


def set_hash(value: Column) -> Column:
    """An aggregate: SHA-256 of a multiset of strings, whatever their order, in a buffer of fixed size.

    Each string's own SHA-256 is cut into numbers of 60 bits, which are added up exactly; sums and count are hashed.
    """
    digest = F.sha2(value.cast("binary"), 256)
    sums = [F.sum(F.conv(F.substring(digest, 1 + 15 * i, 15), 16, 10).cast("decimal(38,0)")) for i in range(4)]
    return F.sha2(F.concat_ws(",", F.count(value).cast("string"), *(s.cast("string") for s in sums)), 256)


def file_line(*columns: str) -> Column:
    """A manifest's row as text: path, size and mtime, or the given ones of them, with | between."""
    texts = {"path": F.col("path"), "name": F.regexp_extract("path", "([^/]*)$", 1), "size": F.col("size").cast("string"), "mtime": F.unix_micros("mtime").cast("string")}
    return F.concat_ws("|", *(texts[c] for c in columns or ("path", "size", "mtime")))


def signature(files: DataFrame) -> DataFrame:
    """One row: a hash of a manifest's lines path|size|mtime, in any order. However many files there are, they meet as sums."""
    return files.agg(set_hash(file_line()).alias("signature"))


def columns_union(spark: SparkSession, paths: Sequence[str], tool: Sequence[str] = ("optime",)) -> DataFrame:
    """position, name, is_tool and n_values of the columns of all tables, in order of first appearance; values are counted in one pass over each."""
    counted, names = None, {}
    for p in paths:
        df = spark.read.parquet(p)
        names |= dict.fromkeys(df.columns)
        counts = df.agg(*(F.count(F.col(f"`{c}`")).alias(c) for c in df.columns)).unpivot([], df.columns, "name", "n")
        counted = counts if counted is None else counted.union(counts)
    at = F.create_map(*(F.lit(x) for i, n in enumerate(names) for x in (n, i)))
    return counted.groupBy("name").agg(F.sum("n").alias("n_values")).select(at[F.col("name")].alias("position"), "name", F.col("name").isin(list(tool)).alias("is_tool"), "n_values")


def auto_granularity(df: DataFrame, date: str = "date", flat_below: int = 1_000_000, per_bucket: int = 500_000) -> DataFrame:
    """One row: n_rows, min_date, max_date, granularity (flat, year, month, day) for buckets of about ``per_bucket`` rows.

    Also ``spans_years``: whether buckets by year would be more than one.
    """
    s = df.agg(F.count(F.lit(1)).alias("n_rows"), F.min(date).cast("date").alias("min_date"), F.max(date).cast("date").alias("max_date"))
    days = F.greatest(F.datediff("max_date", "min_date") + 1, F.lit(1))
    per_day = F.col("n_rows") / days
    pick = F.when(F.col("n_rows") < flat_below, "flat").when(per_day * 365.25 <= per_bucket, "year").when(per_day * 30.4375 <= per_bucket, "month").otherwise("day")
    return s.select("n_rows", "min_date", "max_date", pick.alias("granularity"), (F.year("max_date") > F.year("min_date")).alias("spans_years"))


def hive_keys(spark: SparkSession, root: str) -> DataFrame:
    """position and name of the partition columns of a stored table, from the folders' names; no row for a flat one."""
    folders = F.regexp_extract_all(F.regexp_replace("path", "[^/]*$", ""), F.lit("/([^/=]+)=[^/]*"), 1)
    return manifest(spark, root).select(F.posexplode(folders).alias("position", "name")).distinct()


def partition_plan(df: DataFrame, keys: Sequence[str], like: str | None = None, flat_below: int = 1_000_000, per_bucket: int = 500_000) -> DataFrame:
    """One row: how to store ``df``, as partition_by (a column or null) and granularity, with n_rows, min_date and max_date.

    ``identity`` where the table stored at ``like`` is partitioned by a date or timestamp that ``df`` has too: the new table takes the
    same column, so that refreshes touch the same buckets. Else by the first date or timestamp of ``keys``: ``flat`` below ``flat_below`` rows,
    beyond it that of year, month and day whose number of buckets is nearest to one for each ``per_bucket`` rows (a year counts 365 days, a
    month 30; of equally near ones the coarser). Without such a key, or without a date in it, ``flat``.
    """
    temporal = {f.name for f in df.schema.fields if f.dataType.typeName() in ("date", "timestamp", "timestamp_ntz")}
    mirrored = []
    if like is not None:
        found = hive_keys(df.sparkSession, like).where(F.col("name").isin(sorted(temporal))).orderBy("position").limit(1).collect()
        mirrored = [k.name for k in found]
    timed = mirrored or [k for k in keys if k in temporal]
    day = F.col(timed[0]).cast("date") if timed else F.lit(None).cast("date")
    s = df.agg(F.count(F.lit(1)).alias("n_rows"), F.min(day).alias("min_date"), F.max(day).alias("max_date"))
    if mirrored:
        pick = F.lit("identity")
    else:
        span, wanted = F.datediff("max_date", "min_date"), F.col("n_rows") / per_bucket
        off = [F.struct(F.abs(F.greatest(F.floor(span / days), F.lit(1)) - wanted).alias("off"), F.lit(i).alias("at"), F.lit(name).alias("name")) for i, (name, days) in enumerate((("year", 365), ("month", 30), ("day", 1)))]
        pick = F.when((F.col("n_rows") < flat_below) | span.isNull(), "flat").otherwise(F.least(*off)["name"])
    by = F.when(F.col("granularity") != "flat", F.lit(timed[0] if timed else None).cast("string"))
    return s.withColumn("granularity", pick).select("n_rows", "min_date", "max_date", by.alias("partition_by"), "granularity")


def storage_profile(files: DataFrame, key: str | None = None) -> DataFrame:
    """Bytes and files of a manifest, in total or for each value of a partition key."""
    if key is None:
        names = [F.lit("__all__").alias("partition_by"), F.lit("__all__").alias("partition_value")]
    else:
        names = [F.lit(key).alias("partition_by"), F.regexp_extract("path", rf"/{key}=([^/]*)/", 1).alias("partition_value")]
    return files.groupBy(*names).agg(F.sum("size").alias("storage_size"), F.count(F.lit(1)).alias("file_no"))


def keep_last(df: DataFrame, keys: Sequence[str], *order: str) -> DataFrame:
    """One row for each key, the greatest in ``order``; of equal ones the greatest in all its columns, so that the choice is the same on each run."""
    rest = [F.col(c).desc() for c, t in df.dtypes if c not in (*keys, *order) and "map<" not in t and t != "variant"]
    w = Window.partitionBy(*keys).orderBy(*(F.desc(c) for c in order), *rest)
    return df.withColumn("__rn", F.row_number().over(w)).where("__rn = 1").drop("__rn")
