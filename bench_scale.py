"""Seconds at the size of the published figures: a panel of 18.5 M rows and 22 columns; prints one JSON line.

The rows are the suppliers' panel of $BENCH_SF_DIR (default /root/testdata/sf0.1), repeated under new symbols until there are
some $BENCH_ROWS (default 18,520,000) of them, with columns that vary by key. They are written in yearly buckets first, which is timed too.
"""

import datetime as dt
import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
os.environ["PYTHONPATH"] = f"{os.path.dirname(os.path.abspath(__file__))}:{os.environ.get('PYTHONPATH', '')}"

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EXTRA = 16  # six columns of the panel and these


def repeated_panel(spark: SparkSession, sf_dir: str, rows: int) -> DataFrame:
    from panelweave.fixtures import supplier_panel

    base = supplier_panel(spark, sf_dir)
    copies = max(1, round(rows / base.count()))
    out = base.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.lit(copies)))).withColumn("sym", F.concat_ws("-", "sym", "__copy"))
    noise = {f"f{i}": F.when(F.pmod(F.xxhash64("sym", "date", F.lit(i)), F.lit(50)) > 0, F.pmod(F.xxhash64("date", "sym", F.lit(i)), F.lit(10 ** (2 + i % 5))) / 7) for i in range(EXTRA)}
    return out.drop("__copy").withColumns(noise)


def main() -> None:
    from panelweave.operators import incremental, panel, profile
    from panelweave.session import build_session
    from panelweave.sources import footers, parquet

    sf_dir, rows, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), int(os.environ.get("BENCH_ROWS", "18520000")), int(os.environ.get("BENCH_CPUS", os.cpu_count() or 8))
    spark = build_session("bench", f"local[{cpus}]", 4 * cpus, **{"spark.driver.memory": os.environ.get("BENCH_MEMORY", "16g"), "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    folder = tempfile.mkdtemp(prefix="spark-bench-")
    spark.sparkContext.setCheckpointDir(folder)
    root, member, out = f"{folder}/panel", f"{folder}/member", f"{folder}/joined"
    took = {}

    def timed(name, act):
        start = time.time()
        act()
        took[name] = round(time.time() - start, 2)
        print(name, took[name], file=sys.stderr, flush=True)

    done = lambda df: df.write.format("noop").mode("overwrite").save()
    timed("write in yearly buckets", lambda: parquet.write_all(repeated_panel(spark, sf_dir, rows), root))
    df = parquet.scan(spark, root)
    rows = df.count()
    df.select("sym", "date", (F.col("x") * 2).alias("y")).where("fv > 20000").write.parquet(member)
    timed("Q-01 key check", lambda: done(profile.unique_keys(df, ["sym", "date"])))
    timed("S-08 bounds of 18 columns by bucket, footers", lambda: done(footers.column_bounds(spark, root, ["date", "x", *(f"f{i}" for i in range(EXTRA))], by=["part"])))
    timed("J-01 panel, written in yearly buckets", lambda: parquet.write_all(panel.left_panel(df, [spark.read.parquet(member)]), out))
    timed("A-04 profile of all columns in one scan: all, ic", lambda: done(profile.profile_sets(df, ["all", "ic"])))
    timed("A-01 exact profile of all columns", lambda: done(profile.profile(df)))
    timed("A-02 exact profile by ic", lambda: done(profile.profile(df, "ic")))
    new = df.where(F.col("date").between(F.lit(dt.date(1997, 3, 3)), F.lit(dt.date(1997, 3, 4)))).limit(12)
    timed("I-05 refresh by 12 rows", lambda: incremental.refresh_buckets(spark, root, new, dt.date(1997, 3, 3), dt.date(1997, 3, 4), []))
    print(json.dumps({"metric": "panel at the published size, total", "value": round(sum(took.values()), 2), "unit": "sec", "rows": rows, "columns": 6 + EXTRA, "queries": took}))


if __name__ == "__main__":
    main()
