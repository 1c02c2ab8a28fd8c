"""Files: CSV, JSON maps, manifests, rasters as long tables, layers, models."""

from __future__ import annotations

import json

from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Value that marks a missing pixel.
NODATA = -9999.0


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """CSV with a header and a declared schema; a bad value fails the read."""
    return spark.read.csv(path, header=True, schema=schema, mode="FAILFAST", enforceSchema=False)


def write_csv(df: DataFrame, path: str) -> None:
    """CSV with a header, one file per task: coalesce first if one file is wanted of a small table."""
    df.write.mode("overwrite").csv(path, header=True)


def write_parquet(df: DataFrame, path: str, codec: str = "zstd", cluster_by: list[str] | None = None) -> None:
    """Parquet; with ``cluster_by`` rows are ranged and sorted so that readers skip row groups by their bounds."""
    if cluster_by:
        df = df.repartitionByRange(*cluster_by).sortWithinPartitions(*cluster_by)
    df.write.mode("overwrite").option("compression", codec).parquet(path)


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """One file of text through the Hadoop file system of its path, so that any store the cluster knows will do; replaced if there is one."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).create(hadoop, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def read_text(spark: SparkSession, path: str) -> str:
    return spark.read.text(path, wholetext=True).first()[0]


def write_manifest(path: str, content: dict | DataFrame) -> None:
    """A JSON object in one file: of a dict, or of a DataFrame of exactly one row. The path may be of any file system Spark can write."""
    if isinstance(content, DataFrame):
        rows = content.limit(2).collect()
        if len(rows) != 1:
            raise ValueError("a manifest comes from exactly one row")
        content = rows[0].asDict(recursive=True)
    write_text(SparkSession.active(), path, json.dumps(content, indent=2, ensure_ascii=False, default=str))


def read_json_maps(spark: SparkSession, path: str) -> DataFrame:
    """JSON files ``{point_id, parameter: {variable: {yyyymmdd: value}}}``, maps kept as maps."""
    return spark.read.schema("point_id bigint, parameter map<string, map<string, double>>").json(path, multiLine=True)


def read_box(spark: SparkSession, path: str, box: tuple[float, float, float, float], x: str = "x", y: str = "y") -> DataFrame:
    """Rows of a parquet layer within (x1, y1, x2, y2): the bounds are pushed down to its row groups."""
    x1, y1, x2, y2 = box
    return spark.read.parquet(path).where(F.col(x).between(x1, x2) & F.col(y).between(y1, y2))


def raster_values(raster: DataFrame, nodata: float = NODATA) -> DataFrame:
    """Long raster ``(band, row, col, value)`` with the missing mark as NULL."""
    return raster.withColumn("value", F.nullif("value", F.lit(nodata)))


def raster_cell(lon: Column, lat: Column, x0: float, y0: float, dx: float, dy: float) -> tuple[Column, Column]:
    """Row and column of the pixel that holds a position; (x0, y0) is the upper left corner."""
    return F.floor((F.lit(y0) - lat) / dy).cast("bigint"), F.floor((lon - F.lit(x0)) / dx).cast("bigint")


def sample_raster(points: DataFrame, raster: DataFrame, lon: str, lat: str, x0: float, y0: float, dx: float, dy: float, bands: list[str]) -> DataFrame:
    """``points`` with a column per band: value of the pixel each lies in, NULL outside or where it is missing. One equi-join on the pixel."""
    wide = raster_values(raster).where(F.col("band").isin(bands)).groupBy("row", "col").pivot("band", bands).agg(F.first("value"))
    row, col = raster_cell(F.col(lon), F.col(lat), x0, y0, dx, dy)
    return points.withColumn("row", row).withColumn("col", col).join(wide, ["row", "col"], "left").drop("row", "col")


def dense_rows(raster: DataFrame, columns: int) -> DataFrame:
    """``(row, values)``: arrays of ``columns`` values per row and band 0 gaps NULL: what a picture needs."""
    return raster.groupBy("row").agg(F.map_from_entries(F.collect_list(F.struct("col", "value"))).alias("m")).select("row", F.transform(F.sequence(F.lit(0), F.lit(columns - 1)), lambda c: F.try_element_at("m", c.cast("bigint"))).alias("values"))


def write_raster(raster: DataFrame, bands: DataFrame, path: str) -> None:
    """A long raster and its bands (name, description, units) as two tables; pixels clustered by band and row, so that windows skip row groups."""
    raster.repartitionByRange("band", "row").sortWithinPartitions("band", "row", "col").write.mode("overwrite").parquet(f"{path}/pixels")
    bands.write.mode("overwrite").parquet(f"{path}/bands")


def save_model(model: tuple[PipelineModel, dict[str, float]], path: str, about: dict) -> None:
    """A fitted pipeline, the values it was imputed with and what is known about it."""
    pipeline, fill = model
    pipeline.write().overwrite().save(f"{path}/pipeline")
    write_text(SparkSession.active(), f"{path}/about.json", json.dumps(about | {"fill": fill}, indent=2, default=str))


def load_model(path: str) -> tuple[tuple[PipelineModel, dict[str, float]], dict]:
    about = json.loads(read_text(SparkSession.active(), f"{path}/about.json"))
    return (PipelineModel.load(f"{path}/pipeline"), about.pop("fill")), about
