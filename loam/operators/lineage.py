"""Cutting lineage in iterative jobs so that it survives the loss of executors."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def cut(df: DataFrame) -> DataFrame:
    """``df`` written to the reliable checkpoint folder of the session and read back.

    The folder is the cluster's ``spark.checkpoint.dir``. Only where that is unset and the master is this
    machine (tests) a temporary folder is chosen; on a cluster it is an error, as executors do not share such a
    folder. localCheckpoint is never used: its blocks die with an executor.
    """
    shared_folder(df.sparkSession)
    return df.checkpoint()


def shared_folder(spark: SparkSession) -> str:
    """The session's checkpoint folder, set up if need be: see ``cut``."""
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and (not sc.master.startswith("local") or sc.master.startswith("local-cluster")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="loam-checkpoint-"))
    return sc.getCheckpointDir()


#: Rows of a side of a join that may be broadcast (keys and a few short columns: about 60 MB).
SMALL_ROWS = 1_000_000


def join_hint(df: DataFrame, rows: int = SMALL_ROWS) -> DataFrame:
    """A written table (see ``cut``) marked for a broadcast join if it is counted to be small, else for a join by shuffle and sort."""
    return df.hint("broadcast" if df.count() <= rows else "merge")
