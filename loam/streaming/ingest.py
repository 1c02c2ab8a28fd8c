"""Streaming ingest of observations: an extension beyond batch, with watermark, exact repeats dropped, counts per cell and window."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loam.functions.geo import cell_id, laea_xy


def with_cells(observations: DataFrame, lon: str, lat: str) -> DataFrame:
    """Adds the 1 km cell of each located observation; rows without coordinates are dropped."""
    x, y = laea_xy(F.col(lon), F.col(lat))
    return observations.where(F.col(lon).between(-180, 180) & F.col(lat).between(-90, 90)).withColumn("cell_id", cell_id(x, y))


def first_deliveries(observations: DataFrame, key: str, at: str, late: str = "1 hour") -> DataFrame:
    """The first delivery of each key, later ones within the watermark dropped; state is kept only as long as the watermark asks."""
    return observations.withWatermark(at, late).dropDuplicatesWithinWatermark([key])


def window_counts(observations: DataFrame, keys: list[str], at: str, window: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Rows per key and tumbling window; rows later than the watermark are not counted."""
    g = observations.withWatermark(at, late).groupBy(F.window(at, window), *keys).agg(F.count("*").alias("n"))
    return g.select(F.col("window.start").alias("start"), *keys, "n")


def append_parquet(stream: DataFrame, path: str, checkpoint: str):
    """Starts a query that appends to parquet once for all data at hand and stops; the checkpoint makes every file count once."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
