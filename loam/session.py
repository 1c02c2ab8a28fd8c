"""Session builder with the settings the library is tuned for."""

from __future__ import annotations

from pyspark.sql import SparkSession


def get_session(app: str = "loam", master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution, skew-join splitting, UTC, Arrow and checkpoints that are cleaned up; ``conf`` wins over the defaults.

    Nothing cluster-specific is fixed here: partition counts and memory come from the caller or the cluster.
    """
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        # checkpoints of a query go when nothing refers to them any more
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    } | conf
    for k, v in settings.items():
        b = b.config(k, v)
    return b.getOrCreate()
