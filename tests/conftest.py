"""One session for all tests."""

from __future__ import annotations

import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
os.environ.setdefault("TZ", "UTC")

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from loam.session import get_session

    s = get_session("tests", "local[4]", **{
        "spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "4g",
        "spark.checkpoint.dir": str(tmp_path_factory.mktemp("checkpoint")), "spark.sql.warehouse.dir": str(tmp_path_factory.mktemp("warehouse")),
    })
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def duck():
    duckdb = pytest.importorskip("duckdb")
    c = duckdb.connect()
    c.sql("set timezone = 'UTC'")
    for f in Path(DATA).glob("*.parquet"):
        c.sql(f"create view {f.stem} as select * from '{f}'")
    return c


@pytest.fixture(scope="session")
def same_rows(spark, duck):
    """Compares a query with its oracle SQL over the smallest data."""

    def check(query, sql: str) -> None:
        df = query(spark, DATA)
        got = duck.sql(sql)
        names = [x[0] for x in got.description]
        assert sorted(map(str.lower, df.columns)) == sorted(map(str.lower, names))
        at = {c.lower(): i for i, c in enumerate(names)}
        left = sorted(repr(tuple(r)) for r in df.collect())
        right = sorted(repr(tuple(r[at[c.lower()]] for c in df.columns)) for r in got.fetchall())
        assert left == right

    return check
