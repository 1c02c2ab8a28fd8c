"""The driver contract from another folder, without the package on the path of the workers."""

from __future__ import annotations

import os
import subprocess
import sys
from pathlib import Path

import pytest

REPO = Path(__file__).resolve().parents[1]
SCRIPT = """
import importlib.util, sys
from pyspark.sql import SparkSession
spec = importlib.util.spec_from_file_location("__spark_entry__", sys.argv[1])
entry = importlib.util.module_from_spec(spec)
spec.loader.exec_module(entry)
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").config("spark.sql.session.timeZone", "UTC").getOrCreate()
assert entry.entry(spark).count() > 0
assert entry.queries()["kernel_cross_sum"](spark, "/root/testdata/sf0.001").count() > 0
assert not entry.oracle_sql().keys() - entry.queries().keys()
print("fine")
"""


@pytest.mark.skipif(not Path("/root/testdata/sf0.001").exists(), reason="no test data")
def test_from_another_folder(tmp_path):
    (tmp_path / "run.py").write_text(SCRIPT)
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    got = subprocess.run([sys.executable, str(tmp_path / "run.py"), str(REPO / "__spark_entry__.py")], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert got.stdout.strip().endswith("fine"), got.stderr[-3000:]
