import os
import sys
import tempfile
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"
DATA = Path(os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001"))
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def spark():
    from panelweave.session import build_session

    s = build_session("tests", "local[4]", 4, **{"spark.driver.memory": "4g", "spark.ui.showConsoleProgress": "false"})
    s.sparkContext.setLogLevel("ERROR")
    s.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-checkpoint-"))
    yield s
    s.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return str(DATA)


@pytest.fixture(scope="session")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{DATA}/{t}.parquet')")
    return con


def _value(v):
    if v is None or v != v:
        return "null"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, (int, float)):
        return f"{float(f'{float(v):.6g}') + 0.0:.6g}"  # 0 has no sign
    return str(v)


@pytest.fixture(scope="session")
def same(spark, sf_dir, duck):
    """Whether a query and its SQL give the same rows, in any order."""

    def check(query, sql):
        got = query(spark, sf_dir)
        names = sorted(got.columns)
        want = duck.execute(f"SELECT {', '.join(f'"{n}"' for n in names)} FROM ({sql})").fetchall()
        rows = [tuple(map(_value, r)) for r in got.select(*names).collect()]
        assert sorted(rows) == sorted(tuple(map(_value, r)) for r in want)

    return check
