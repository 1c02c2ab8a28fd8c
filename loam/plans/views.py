"""Views the queries start from, and the same in SQL for their oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loam.sources.tables import table


def obs(spark: SparkSession, d: str) -> DataFrame:
    """Observations as delivered."""
    return table(spark, d, "heracleum_ua_clean")


PTS_SQL = "pts as (select distinct key, cell_id, patch_id, year, x3035 x, y3035 y from target_points_clustered where key is not null)"


def pts(spark: SparkSession, d: str) -> DataFrame:
    """Target points, one row per key: key, cell_id, patch_id, year, x, y."""
    return table(spark, d, "target_points_clustered").where("key is not null").select("key", "cell_id", "patch_id", "year", F.col("x3035").alias("x"), F.col("y3035").alias("y")).distinct()


SER_SQL = "ser as (select c_nationkey point, cast(o_orderdate as date) d, o_totalprice v from orders join customer on o_custkey = c_custkey)"


def ser(spark: SparkSession, d: str) -> DataFrame:
    """A daily series per point: point, d, v."""
    c = table(spark, d, "customer").select("c_custkey", F.col("c_nationkey").alias("point"))
    o = table(spark, d, "orders").select("o_custkey", F.to_date("o_orderdate").alias("d"), F.col("o_totalprice").alias("v"))
    return o.join(c, o["o_custkey"] == c["c_custkey"]).select("point", "d", "v")


YEARLY_SQL = SER_SQL + ", yearly as (select point, cast(year(d) as integer) \"year\", cast(sum(cast(round(v * 100) as bigint)) as double) / count(*) / 100 v, count(*) n from ser group by 1, 2)"


def yearly(spark: SparkSession, d: str) -> DataFrame:
    """Annual means of the series."""
    s = ser(spark, d).withColumn("year", F.year("d"))
    return s.groupBy("point", "year").agg((F.sum(F.round(F.col("v") * 100).cast("bigint")).cast("double") / F.count("*") / 100).alias("v"), F.count("*").alias("n"))


WND_SQL = "wnd as (select user_id point, cast(day(ts) as integer) d, value, ((value * 7) % 360 + 360) % 360 angle, value speed from events)"


def wnd(spark: SparkSession, d: str) -> DataFrame:
    """Winds: point, day, angle they come from, speed."""
    e = table(spark, d, "events")
    return e.select(F.col("user_id").alias("point"), F.day("ts").alias("d"), "value", F.pmod(F.col("value") * 7, F.lit(360.0)).alias("angle"), F.col("value").alias("speed"))


NET_SQL = """net as (select s_suppkey node, case when s_suppkey % 7 = 1 then 0 else s_suppkey // 2 end "next", cast(1 + s_nationkey as double) km from supplier where s_suppkey > 0),
edges as (select node, "next", km from net where "next" <> 0), infected as (select node from net where node % 5 = 0)"""


def net(spark: SparkSession, d: str) -> DataFrame:
    """A river-like graph: node, next (0: outlet), km; a node is infected if it is divisible by 5."""
    s = table(spark, d, "supplier").where("s_suppkey > 0")
    return s.select(F.col("s_suppkey").alias("node"), F.expr("case when s_suppkey % 7 = 1 then 0 else s_suppkey div 2 end").cast("bigint").alias("next"), (F.col("s_nationkey") + 1).cast("double").alias("km"))


PU_SQL = """labels as (select distinct cell_id from target_points_clustered),
raw as (select cell_id, max(suitability_targetbg_raw) score, max(suitability_randombg_raw) score2 from suitability_predictions
  where run_id = 1 and suitability_targetbg_raw between 0 and 1 and suitability_randombg_raw between 0 and 1 group by 1),
feat as (select cell_id, min(coalesce(oblast_code, 'none')) grp, max(bio_01) bio_01, max(elevation_m) elevation_m, max(n_plant_effort) effort from grid_features_static group by 1),
pu as (select raw.cell_id, score, score2, grp, cast(bio_01 as double) bio_01, cast(elevation_m as double) elevation_m, effort, case when labels.cell_id is null then 0 else 1 end y
  from raw join feat using (cell_id) left join labels on labels.cell_id = raw.cell_id)"""


def pu(spark: SparkSession, d: str) -> DataFrame:
    """Scored cells: cell_id, score, score2, grp, bio_01, elevation_m, effort, y (1: a target point lies in it)."""
    s = table(spark, d, "suitability_predictions").where("run_id = 1 and suitability_targetbg_raw between 0 and 1 and suitability_randombg_raw between 0 and 1")
    s = s.groupBy("cell_id").agg(F.max("suitability_targetbg_raw").alias("score"), F.max("suitability_randombg_raw").alias("score2"))
    f = table(spark, d, "grid_features_static").groupBy("cell_id").agg(F.min(F.coalesce("oblast_code", F.lit("none"))).alias("grp"), F.max("bio_01").cast("double").alias("bio_01"), F.max("elevation_m").cast("double").alias("elevation_m"), F.max("n_plant_effort").alias("effort"))
    y = table(spark, d, "target_points_clustered").select("cell_id").distinct().withColumn("y", F.lit(1))
    return s.join(f, "cell_id").join(y, "cell_id", "left").withColumn("y", F.coalesce("y", F.lit(0)))


GRID_SQL = "grid as (select cell_id, min(\"row\") \"row\", min(col) col, min(x) x, min(y) y, min(lon) lon, min(lat) lat, min(oblast_code) oblast_code from grid_1km_ua where cell_id is not null group by 1)"


def grid(spark: SparkSession, d: str) -> DataFrame:
    """Grid cells, one row each."""
    return table(spark, d, "grid_1km_ua").where("cell_id is not null").groupBy("cell_id").agg(*[F.min(c).alias(c) for c in ("row", "col", "x", "y", "lon", "lat", "oblast_code")])


#: Edges of the regions' rings, and the even-odd rule over them with half-open edges: ``having`` of a grouping by point and region.
EDGES_SQL = r"""rings as (select oblast_code, list_transform(string_split(ring, ','), lambda v: list_transform(string_split(trim(v), ' '), lambda t: cast(t as double))) p
  from (select oblast_code, unnest(regexp_extract_all(geometry_wkt, '\(([^()]+)\)', 1)) ring from admin_units where geometry_wkt is not null)),
region_edges as (select oblast_code, e[1][1] x1, e[1][2] y1, e[2][1] x2, e[2][2] y2 from (select oblast_code, unnest(list_transform(range(1, len(p) + 1), lambda i: [p[i], p[i % len(p) + 1]])) e from rings))"""
INSIDE_SQL = "sum(case when (y1 > y) <> (y2 > y) and x < (x2 - x1) * (y - y1) / (y2 - y1) + x1 then 1 else 0 end) % 2 = 1"
