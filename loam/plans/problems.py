"""Queries of the general training-data operators: mixed timestamps, points near points or in regions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loam.functions.geo import laea_xy
from loam.operators.dualtree import regions_of, within_distance
from loam.operators.timestamps import normalise_timestamps
from loam.plans import views as V
from loam.plans.registry import query
from loam.plans.sql import laea_sql
from loam.plans.timestamps_sql import CHOSEN_SQL, FOUND_SQL
from loam.sources.tables import table


@query(CHOSEN_SQL)
def p3_timestamps(spark: SparkSession, d: str) -> DataFrame:
    """Every event date with its status, instant and the format it was read in."""
    seen = table(spark, d, "heracleum_ua_clean").select("ingest_id", "datasetKey", "eventDate")
    return normalise_timestamps(seen, "ingest_id", "datasetKey", "eventDate", "Europe/Kyiv").withColumnsRenamed({"ident": "ingest_id", "source": "datasetKey", "value": "eventDate"})


@query(FOUND_SQL)
def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """Rows whose event date names exactly one instant."""
    return p3_timestamps(spark, d).where("n_instants = 1").select("ingest_id", "utc_second")


#: The country's box in degrees.
BOX = "decimalLatitude between 44.2 and 52.5 and decimalLongitude between 22 and 40.3"
_LOCATED_SQL = f"select * from heracleum_ua_clean where label_role = 'target' and {BOX}"


def located(spark: SparkSession, d: str) -> DataFrame:
    """Target records with coordinates inside the country's box."""
    seen = table(spark, d, "heracleum_ua_clean").select("ingest_id", "key", "label_role", "decimalLatitude", "decimalLongitude")
    return seen.where(f"label_role = 'target' and {BOX}").select("ingest_id", "key", F.col("decimalLatitude").alias("lat"), F.col("decimalLongitude").alias("lon"))


_NEAR_SQL = f"""with o as ({_LOCATED_SQL}), g as (select cell_id, lon, lat from grid_1km_ua where cell_id is not null),
pairs as (select ingest_id, cell_id, 2 * 6371008.8 * asin(least(1.0, sqrt(pow(sin(radians(lat - decimalLatitude) / 2), 2) + cos(radians(decimalLatitude)) * cos(radians(lat)) * pow(sin(radians(lon - decimalLongitude) / 2), 2)))) m
  from o join g on lat between decimalLatitude - 0.008 and decimalLatitude + 0.008 and lon between decimalLongitude - 0.014 and decimalLongitude + 0.014)
"""


@query(_NEAR_SQL + "select distinct ingest_id, cell_id, round(m, 3) distance_m from pairs where m <= 800")
def p7_near_cells(spark: SparkSession, d: str) -> DataFrame:
    """The grid cells whose centres are at most 800 m from each located target record, with the distance."""
    cells = table(spark, d, "grid_1km_ua").select("cell_id", "lat", "lon").where("cell_id is not null").distinct()
    near = within_distance(located(spark, d), "ingest_id", cells, "cell_id", 800.0)
    return near.select("ingest_id", "cell_id", F.round("distance_m", 3).alias("distance_m"))


@query(_NEAR_SQL + "select distinct ingest_id, cell_id from pairs where m <= 800")
def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return p7_near_cells(spark, d).select("ingest_id", "cell_id")


@query(f"with {V.EDGES_SQL}, a as (" + laea_sql("decimalLongitude", "decimalLatitude").format(f"({_LOCATED_SQL})") + """), b as (select *, m1 / (rq * cos(b0)) d, rq * sqrt(2 / (1 + sin(b0) * sin(beta) + cos(b0) * cos(beta) * cos(dl))) r from a),
spot as (select ingest_id, 4321000 + r * d * cos(beta) * sin(dl) x, 3210000 + (r / d) * (cos(b0) * sin(beta) - sin(b0) * cos(beta) * cos(dl)) y from b)
select ingest_id, oblast_code from spot, region_edges group by ingest_id, x, y, oblast_code having """ + V.INSIDE_SQL)
def p7_regions(spark: SparkSession, d: str) -> DataFrame:
    """The region of admin_units each located target record lies in."""
    seen = located(spark, d)
    x, y = laea_xy(F.col("lon"), F.col("lat"))
    return regions_of(seen.withColumn("x", x).withColumn("y", y), "ingest_id", "x", "y", table(spark, d, "admin_units"), "oblast_code", "geometry_wkt")
