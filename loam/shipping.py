"""Makes the package importable for the Python workers of a session, wherever they run."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_DONE: set[str] = set()


def ship(spark: SparkSession) -> SparkSession:
    """The session itself; at the first call for an application, the package's source is sent to its workers through Spark's own file server."""
    sc = spark.sparkContext
    if sc.applicationId not in _DONE:
        package = Path(__file__).resolve().parent
        path = Path(tempfile.mkdtemp(prefix="loam-")) / "loam.zip"
        with zipfile.ZipFile(path, "w") as z:
            for f in sorted(package.rglob("*.py")):
                z.write(f, f.relative_to(package.parent))
        sc.addPyFile(str(path))
        _DONE.add(sc.applicationId)
    return spark
