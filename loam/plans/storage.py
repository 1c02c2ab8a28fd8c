"""Queries of sinks and sources: tables written to the session's shared folder and read again."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loam.operators.lineage import shared_folder
from loam.plans.registry import query
from loam.sources import files
from loam.sources.tables import table


def _place(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


@query("select c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment from customer")
def csv_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Customers written as CSV and read with a declared schema."""
    path = _place(spark, "csv")
    files.write_csv(table(spark, d, "customer").select("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"), path)
    return files.read_csv(spark, path, "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string")


@query("select cell_id, x, y, oblast_code from grid_1km_ua where x between 5430000 and 5460000 and y between 2600000 and 2700000")
def parquet_box(spark: SparkSession, d: str) -> DataFrame:
    """The grid written as zstd parquet, clustered by position, and a box of it read with the bounds pushed down."""
    path = _place(spark, "parquet")
    files.write_parquet(table(spark, d, "grid_1km_ua").select("cell_id", "x", "y", "oblast_code"), path, cluster_by=["x", "y"])
    return files.read_box(spark, path, (5_430_000.0, 2_600_000.0, 5_460_000.0, 2_700_000.0))


@query("select count(*) n, min(o_orderkey) low, max(o_orderkey) high, round(sum(o_totalprice), 2) total from orders")
def manifest_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """A manifest of one row, written as a JSON object and read again."""
    path = _place(spark, "manifest") + ".json"
    files.write_manifest(path, table(spark, d, "orders").agg(F.count("*").alias("n"), F.min("o_orderkey").alias("low"), F.max("o_orderkey").alias("high"), F.round(F.sum("o_totalprice"), 2).alias("total")))
    return spark.read.schema("n bigint, low bigint, high bigint, total double").json(path, multiLine=True)


@query("""with g as (select distinct cell_id, "row", col, dist_river_m v from grid_1km_ua where cell_id is not null), r as (select "row", col, max(v) v from g group by 1, 2), b as (select min("row") r0, min(col) c0, max(col) c1 from r)
select cast("row" - r0 as bigint) "row", cast(max(c1 - c0) + 1 as integer) width, cast(count(v) as bigint) n_filled, round(sum(cast(v as double)), 3) total from r, b group by 1""")
def raster_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """A long raster with its dimension of bands, written and read; missing pixels are NULL again; dense rows of it, as a picture needs them."""
    g = table(spark, d, "grid_1km_ua").where("cell_id is not null").groupBy("row", "col").agg(F.max("dist_river_m").cast("double").alias("v"))
    b = g.agg(F.min("row").alias("r0"), F.min("col").alias("c0"), F.max("col").alias("c1")).first()
    if b["r0"] is None:
        return spark.createDataFrame([], "row bigint, width int, n_filled bigint, total double")
    path = _place(spark, "raster")
    long = g.select(F.lit("dist_river").alias("band"), (F.col("row") - b["r0"]).cast("bigint").alias("row"), (F.col("col") - b["c0"]).cast("bigint").alias("col"), F.coalesce("v", F.lit(files.NODATA)).alias("value"))
    files.write_raster(long, spark.createDataFrame([("dist_river", "distance to the nearest reach", "m")], "band string, description string, units string"), path)
    bands = spark.read.parquet(f"{path}/bands").select("band")
    read = files.raster_values(spark.read.parquet(f"{path}/pixels").join(bands, "band", "left_semi"))
    dense = files.dense_rows(read, b["c1"] - b["c0"] + 1)
    known = F.filter("values", lambda v: v.isNotNull())
    return dense.select("row", F.size("values").alias("width"), F.size(known).cast("bigint").alias("n_filled"), F.when(F.size(known) > 0, F.round(F.aggregate(known, F.lit(0.0), lambda a, v: a + v), 3)).alias("total"))
