"""A session with the settings that the library relies on."""

from __future__ import annotations

import os
import tempfile
import time
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "panelweave", master: str | None = None, shuffle_partitions: int | None = None, **conf: str) -> SparkSession:
    """Start or fetch a session; on a cluster, leave ``master`` to spark-submit.

    AQE coalesces, splits skewed joins and picks broadcasts by measured size;
    UTC keeps dates equal on every machine.
    """
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.sources.partitionOverwriteMode": "dynamic",
        "spark.ui.enabled": os.environ.get("PANELWEAVE_UI", "false"),
    }
    if shuffle_partitions:
        settings["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    for k, v in (settings | conf).items():
        b = b.config(k, v)
    return b.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder for intermediate data that the cluster names in spark.checkpoint.dir, or the session's checkpoint folder; a local one only where none is named and Spark is local."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
    return named or tempfile.mkdtemp(prefix="spark-checkpoint-")


def variant(spark: SparkSession, **conf: str) -> SparkSession:
    """A session on the same cluster and catalog with some settings of its own; ``spark``'s other settings are taken over and it keeps them.

    Plans of its DataFrames are made under its settings. Join them only with one another.
    """
    other = spark.newSession()
    for key, value in ({k: v for k, v in spark.conf.getAll.items() if spark.conf.isModifiable(k)} | conf).items():
        other.conf.set(key, value)
    return other


def cut(df: DataFrame) -> DataFrame:
    """``df`` stored in the checkpoint folder, so that plans stay short and survive lost executors."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_folder(spark))
    return df.checkpoint(eager=True)


class Shelf:
    """Named tables of an iteration, as compressed Parquet below the shared folder; a new one of a name takes the place of the old.

    The old one's files are deleted once the new ones are written, and the driver's heap is swept every few seconds, upon which Spark deletes the
    shuffles of plans that nothing refers to any more. So disk holds a round or two, not all. Plans made from an old table of a name are void.
    """

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.paths, self.swept = spark, {}, 0.0
        self.folder = f"{shared_folder(spark).rstrip('/')}/shelf-{uuid.uuid4().hex}"

    def put(self, name: str, df: DataFrame) -> DataFrame:
        path = f"{self.folder}/{name}-{uuid.uuid4().hex}"
        df.write.option("compression", "zstd").parquet(path)
        self.drop(name)
        self.paths[name] = path
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        for path in (self.paths.pop(n, None) for n in names):
            if path:
                at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
                at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)
        if time.monotonic() - self.swept > 5:  # small rounds leave little and are not to pay for it
            self.spark._jvm.System.gc()
            self.swept = time.monotonic()
