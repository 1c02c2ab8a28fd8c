"""Queries of the spatial operators."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loam.functions import expr as E
from loam.functions.geo import laea_xy
from loam.functions.geometry import hulls, region_union
from loam.operators import batch, dualtree, ml, spatial
from loam.operators.allocate import allocate_capped
from loam.operators.lineage import cut
from loam.operators.ranked import grouped_runs, running_sums
from loam.plans import views as V
from loam.plans.registry import query
from loam.plans.sql import laea_sql
from loam.sources.tables import table

@query("with a as (" + laea_sql("lon", "lat").format("(select distinct cell_id, lon, lat from grid_1km_ua where cell_id is not null)") + """), b as (select *, m1 / (rq * cos(b0)) d, rq * sqrt(2 / (1 + sin(b0) * sin(beta) + cos(b0) * cos(beta) * cos(dl))) r from a)
select cell_id, round(4321000 + r * d * cos(beta) * sin(dl), 3) x, round(3210000 + (r / d) * (cos(b0) * sin(beta) - sin(b0) * cos(beta) * cos(dl)), 3) y from b""")
def laea_projection(spark: SparkSession, d: str) -> DataFrame:
    """Centres of cells projected from degrees to EPSG:3035 metres."""
    x, y = laea_xy(F.col("lon"), F.col("lat"))
    return table(spark, d, "grid_1km_ua").where("cell_id is not null").select("cell_id", "lon", "lat").distinct().select("cell_id", F.round(x, 3).alias("x"), F.round(y, 3).alias("y"))


@query(f"with {V.PTS_SQL} select a.key, count(*) filter (where sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) <= 1000) n_1km, count(*) n_5km from pts a join pts b on b.x between a.x - 5000 and a.x + 5000 and sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) <= 5000 group by 1")
def radius_counts(spark: SparkSession, d: str) -> DataFrame:
    """Points within 1 and 5 km of each point, itself included; dense places cost buckets, not pairs."""
    p = V.pts(spark, d).select("key", "x", "y")
    return spatial.radius_counts(p, "key", p, 1000.0, "n_1km").join(spatial.radius_counts(p, "key", p, 5000.0, "n_5km"), "key")


@query(f"""with {V.PTS_SQL}, e as (select "year", x, y from pts where "year" is not null) select a.key, a."year", (select count(*) from e where e."year" = a."year" and sqrt((a.x - e.x) ** 2 + (a.y - e.y) ** 2) <= 5000) n from pts a where a."year" is not null""")
def effort_by_year(spark: SparkSession, d: str) -> DataFrame:
    """Points of the same year within 5 km of each point."""
    p = V.pts(spark, d).where("year is not null").select("key", "year", "x", "y")
    return spatial.radius_counts(p, "key", p, 5000.0, "n", by=["year"])


@query(f"""with {V.PTS_SQL}, {V.GRID_SQL}, m as (select grid.cell_id, key, sqrt((grid.x - pts.x) ** 2 + (grid.y - pts.y) ** 2) dd from grid, pts)
select cell_id, key, round(dd, 6) distance from m qualify row_number() over (partition by cell_id order by dd, key) = 1""")
def nearest_point(spark: SparkSession, d: str) -> DataFrame:
    """The nearest target point of every grid cell."""
    n = spatial.nearest(V.grid(spark, d).select("cell_id", "x", "y"), "cell_id", V.pts(spark, d).select("key", "x", "y"), "key")
    return n.select("cell_id", "key", F.round("distance", 6).alias("distance"))


@query(f"""with {V.PTS_SQL}, {V.GRID_SQL}, n as (select floor(x / 20000) bx, floor(y / 20000) by_, count(*) n from pts group by 1, 2), o as (select *, sum(n) over (order by md5(concat_ws('|', cast(cast(bx as bigint) as varchar), cast(cast(by_ as bigint) as varchar), '42')), bx, by_) - n before from n),
test as (select x, y from pts join o on floor(x / 20000) = bx and floor(y / 20000) = by_ where before < 0.2 * (select count(*) from pts))
select cell_id from grid where not exists (select 1 from test where sqrt((grid.x - test.x) ** 2 + (grid.y - test.y) ** 2) < 5000)""")
def buffered_exclusion(spark: SparkSession, d: str) -> DataFrame:
    """Cells that stay for training: none within 5 km of a test point of the 20 km block split, which holds a fifth of all points."""
    return _outside(spark, d, ml.block_split(V.pts(spark, d), "x", "y", 20000.0, 0.2, 42).where("is_test"))


def _outside(spark: SparkSession, d: str, points: DataFrame) -> DataFrame:
    """Grid cells at least 5 km away from all points: from the nearest one. Without points, all cells."""
    g = V.grid(spark, d).select("cell_id", "x", "y")
    near = spatial.nearest(g, "cell_id", points, "key").where("distance < 5000").select("cell_id")
    return g.join(near, "cell_id", "left_anti").select("cell_id")


@query(f"""with {V.PTS_SQL}, s as (select patch_id, avg(x) sx, avg(y) sy, count(*) w from pts where patch_id is not null group by 1), {V.GRID_SQL},
k as (select cell_id, sx, sy, w, grid.x - sx dx, grid.y - sy dy, greatest(sqrt((grid.x - sx) ** 2 + (grid.y - sy) ** 2), 1) dd from grid, s)
select cell_id, round(sum(exp(-dd / 20000) * (1 + 0.5 * cos(atan2(dx, dy) - radians(90)))), 6) pressure from k group by 1""")
def kernel_cross_sum(spark: SparkSession, d: str) -> DataFrame:
    """Pressure of all patches on each cell: a distance kernel stretched downwind (east)."""
    s = V.pts(spark, d).where("patch_id is not null").groupBy("patch_id").agg(F.avg("x").alias("x"), F.avg("y").alias("y"))
    k = spatial.kernel_sums(V.grid(spark, d), "cell_id", s, lambda dx, dy, m: np.exp(-np.maximum(np.hypot(dx, dy), 1.0) / 20000) * (1 + 0.5 * np.cos(np.arctan2(dx, dy) - np.pi / 2)), "pressure")
    return k.withColumn("pressure", F.round("pressure", 6))


@query(f"""with {V.PTS_SQL}, s as (select patch_id, avg(x) sx, avg(y) sy, ln(1 + count(*)) w from pts where patch_id is not null group by 1), {V.GRID_SQL}
select cell_id, round(1e9 * sum(w * exp(-((grid.x - sx) ** 2 + (grid.y - sy) ** 2) / (2 * 20000.0 ** 2))) / (2 * pi() * 20000.0 ** 2 * (select sum(w) from s)), 6) density from grid, s group by 1""")
def kde_weighted(spark: SparkSession, d: str) -> DataFrame:
    """Gaussian density of patches, weighted by the logarithm of their size."""
    s = V.pts(spark, d).where("patch_id is not null").groupBy("patch_id").agg(F.avg("x").alias("x"), F.avg("y").alias("y"), F.log1p(F.count("*")).alias("w"))
    total = s.agg(F.sum("w")).first()[0]
    k = spatial.kernel_sums(V.grid(spark, d), "cell_id", s, lambda dx, dy, m: m["w"] * np.exp(-(dx * dx + dy * dy) / (2 * 20000.0**2)), "density", extra=["w"])
    return k.withColumn("density", F.round(F.col("density") * 1e9 / (2 * np.pi * 20000.0**2 * total), 6))


_DBSCAN_SQL = f"""{V.PTS_SQL}, e as (select a.key u, b.key v from pts a join pts b on b.x between a.x - 500 and a.x + 500 and sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) <= 500),
reach as (select u, v from e union select reach.u, e.v from reach join e on e.u = reach.v),
c as (select u key, case when count(*) > 1 then min(v) end cluster from reach group by 1)"""


@query(f"with recursive {_DBSCAN_SQL} select key, cluster from c")
def dbscan_components(spark: SparkSession, d: str) -> DataFrame:
    """Clusters of points linked by at most 500 m; NULL for points alone."""
    return spatial.dbscan2(V.pts(spark, d), "key", 500.0)


@query(f"""with recursive {_DBSCAN_SQL}, f as (select cluster, count(*) n_points, avg(x) cx, avg(y) cy from c join pts using (key) where cluster is not null group by 1)
select 'P' || lpad(cast(dense_rank() over (order by f.cluster) as varchar), 4, '0') patch, n_points, round(cx, 4) cx, round(cy, 4) cy, round(r, 4) radius, n_cells, n_years
from f join (select cluster, max(sqrt((x - cx) ** 2 + (y - cy) ** 2)) r, count(distinct cell_id) n_cells, count(distinct "year") n_years from c join pts using (key) join f using (cluster) group by 1) using (cluster)""")
def patch_features(spark: SparkSession, d: str) -> DataFrame:
    """Named clusters with size, centroid, enclosing radius, cells and years. The number in a name comes from running sums, not a global window."""
    p = V.pts(spark, d)
    c = spatial.dbscan2(p, "key", 500.0).where("cluster is not null").join(p, "key")
    f = c.groupBy("cluster").agg(F.count("*").alias("n_points"), F.avg("x").alias("cx"), F.avg("y").alias("cy"), F.count_distinct("cell_id").alias("n_cells"), F.count_distinct("year").alias("n_years"))
    r = c.join(f, "cluster").groupBy("cluster").agg(F.max(F.hypot(F.col("x") - F.col("cx"), F.col("y") - F.col("cy"))).alias("radius"))
    named = running_sums(f.join(r, "cluster"), [F.asc("cluster")], {"k": F.lit(1)})
    return named.select(F.concat(F.lit("P"), F.lpad(F.col("k").cast("string"), 4, "0")).alias("patch"), "n_points", F.round("cx", 4).alias("cx"), F.round("cy", 4).alias("cy"), F.round("radius", 4).alias("radius"), "n_cells", "n_years")


# patches of every year and how they change from year to year

_YEARS_SQL = f"""{V.PTS_SQL}, p as (select key, "year", x, y, cell_id from pts where "year" is not null),
e as (select a.key u, b.key v from p a join p b on a."year" = b."year" and b.x between a.x - 500 and a.x + 500 and sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) <= 500),
reach as (select u, v from e union select reach.u, e.v from reach join e on e.u = reach.v),
c as (select u key, min(v) cluster, count(*) > 1 many from reach group by 1),
named as (select "year", cluster, "year" || case when many then '_P' else '_S' end || printf('%03d', row_number() over (partition by "year", many order by cluster) - 1) patch from (select distinct "year", cluster, many from c join p using (key))),
member as (select patch, p.* from p join c using (key) join named using ("year", cluster)),
cell as (select distinct patch, "year", cell_id from member where cell_id is not null),
g as (select m.*, coalesce(k, 0) n_cells from (select patch, "year", sum(cast(round(x * 1000) as bigint)) / count(*) / 1000 x, sum(cast(round(y * 1000) as bigint)) / count(*) / 1000 y, count(*) n from member group by 1, 2) m left join (select patch, count(*) k from cell group by 1) using (patch))"""
_MATCH_SQL = f"""{_YEARS_SQL},
near as (select a.patch f, b.patch t from g a join g b on b."year" = a."year" + 1 and sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) <= 1000 union select a.patch, b.patch from cell a join cell b on b."year" = a."year" + 1 and a.cell_id = b.cell_id),
common as (select a.patch f, b.patch t, count(*) k from cell a join cell b on b."year" = a."year" + 1 and a.cell_id = b.cell_id group by 1, 2),
pair as (select f, t, coalesce(coalesce(k, 0) / nullif(a.n_cells + b.n_cells - coalesce(k, 0), 0), 0) iou, sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) dd from near left join common using (f, t) join g a on a.patch = f join g b on b.patch = t),
o as (select *, row_number() over (order by iou desc, round(dd, 6), f, t) r from pair),
take as (select cast(0 as bigint) r, cast([] as varchar[]) used, cast(null as varchar) f, cast(null as varchar) t, false ok
  union all select o.r, case when list_contains(used, '>' || o.f) or list_contains(used, '<' || o.t) then used else list_append(list_append(used, '>' || o.f), '<' || o.t) end, o.f, o.t, not (list_contains(used, '>' || o.f) or list_contains(used, '<' || o.t)) from take join o on o.r = take.r + 1),
m as (select f, t, iou, dd from take join pair using (f, t) where ok)"""


def _centre(c: str) -> Column:
    """Mean of coordinates to the millimetre, summed as whole numbers: the same in whatever order rows come."""
    return F.sum(F.round(F.col(c) * 1000).cast("bigint")) / F.count("*") / 1000


def _year_patches(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Patches of each year (clusters linked by 500 m, and points alone), their cells, and the points with a year."""
    p = cut(V.pts(spark, d).where("year is not null").select("key", "year", "x", "y", "cell_id"))
    c = spatial.dbscan2(p, "key", 500.0, within=["year"]).select("key", F.coalesce("cluster", "key").alias("cluster"), F.col("cluster").isNotNull().alias("many"))
    c = cut(p.join(c, "key"))
    runs = grouped_runs(c.select("year", "many", "cluster").distinct(), ["year", "many"], [F.asc("cluster")], {"k": F.lit(1)})
    name = F.concat(F.col("year").cast("string"), F.when(F.col("many"), "_P").otherwise("_S"), F.format_string("%03d", F.col("k") - 1))
    member = cut(c.join(runs.select("year", "cluster", name.alias("patch")), ["year", "cluster"]))
    cells = member.where("cell_id is not null").select("patch", "year", "cell_id").distinct()
    g = member.groupBy("patch", "year").agg(_centre("x").alias("x"), _centre("y").alias("y"), F.count("*").alias("n"), F.count_distinct("cell_id").alias("n_cells"))
    return cut(g), cut(cells), p


def _year_matches(g: DataFrame, cells: DataFrame, reach: float = 1000.0) -> DataFrame:
    """One-to-one matches of patches of a year and the next: those that share cells or whose centres are near, most shared first, then nearest."""
    ahead = g.select(F.col("patch").alias("to_id"), (F.col("year") - 1).alias("year"), "x", "y")
    near = spatial.radius_pairs(g.withColumnRenamed("patch", "from_id"), "from_id", ahead, "to_id", reach, by=["year"]).select("from_id", "to_id")
    later = cells.select(F.col("patch").alias("to_id"), (F.col("year") - 1).alias("year"), "cell_id")
    common = cut(cells.withColumnRenamed("patch", "from_id").join(later, ["year", "cell_id"]).groupBy("from_id", "to_id").agg(F.count("*").alias("k")))
    a = g.select(F.col("patch").alias("from_id"), F.col("x").alias("x0"), F.col("y").alias("y0"), F.col("n_cells").alias("c0"))
    b = g.select(F.col("patch").alias("to_id"), F.col("x").alias("x1"), F.col("y").alias("y1"), F.col("n_cells").alias("c1"))
    pairs = near.union(common.select("from_id", "to_id")).distinct().join(common, ["from_id", "to_id"], "left").fillna(0, ["k"]).join(a, "from_id").join(b, "to_id")
    iou = F.coalesce(F.try_divide(F.col("k").cast("double"), F.col("c0") + F.col("c1") - F.col("k")), F.lit(0.0))
    edges = pairs.select("from_id", "to_id", iou.alias("iou"), F.hypot(F.col("x0") - F.col("x1"), F.col("y0") - F.col("y1")).alias("distance"))
    return spatial.greedy_match(edges, "from_id", "to_id", [F.desc("iou"), F.round("distance", 6).asc(), F.asc("from_id"), F.asc("to_id")])


@query(f"with recursive {_MATCH_SQL} select f from_id, t to_id, round(iou, 6) iou, round(dd, 4) distance from m")
def greedy_match(spark: SparkSession, d: str) -> DataFrame:
    """Patches of each year matched one to one with those of the next, by shared cells, then distance."""
    g, cells, _ = _year_patches(spark, d)
    return _year_matches(g, cells).select("from_id", "to_id", F.round("iou", 6).alias("iou"), F.round("distance", 4).alias("distance"))


@query(f"""with recursive {_MATCH_SQL},
effort as (select patch, (select count(*) from p where p."year" = g."year" and sqrt((p.x - g.x) ** 2 + (p.y - g.y) ** 2) <= 5000) n from g),
span as (select min("year") y0, max("year") y1 from g),
survived as (select 'matched' status, a."year" year_from, f patch_from, t patch_to, iou, dd, a.n n0, b.n n1, a.n_cells c0, b.n_cells c1, a.x x0, a.y y0, b.x x1, b.y y1, (select count(*) from cell k join cell l using (cell_id) where k.patch = f and l.patch = t) shared, ea.n e0, eb.n e1
  from m join g a on a.patch = f join g b on b.patch = t join effort ea on ea.patch = f join effort eb on eb.patch = t)
select status, year_from, patch_from, patch_to, round(iou, 6) iou, round(dd, 4) distance, round((n1 - n0) / cast(n0 as double), 6) growth, round(ln(n1 / n0), 6) log_ratio, round((degrees(atan2(x1 - x0, y1 - y0)) + 360) % 360, 4) azimuth, c1 - shared new_cells, c0 - shared lost_cells, e0 effort_from, e1 effort_to, round(ln((e1 + 1) / (e0 + 1)), 6) d_log_effort from survived
union all select 'disappeared', g."year", patch, null, null, null, null, null, null, null, n_cells, effort.n, null, null from g join effort using (patch), span where g."year" < y1 and patch not in (select f from m)
union all select 'new', g."year" - 1, null, patch, null, null, null, null, null, n_cells, null, null, effort.n, null from g join effort using (patch), span where g."year" > y0 and patch not in (select t from m)""")
def patch_dynamics(spark: SparkSession, d: str) -> DataFrame:
    """From each year to the next: matched, disappeared and new patches with growth, direction, cells gained and lost, and the change of effort nearby."""
    g, cells, p = _year_patches(spark, d)
    m = cut(_year_matches(g, cells))
    effort = spatial.radius_counts(g, "patch", p, 5000.0, "effort", by=["year"]).select("patch", "effort")
    g = cut(g.join(effort, "patch"))
    a = g.select(F.col("patch").alias("patch_from"), F.col("year").alias("year_from"), *[F.col(c).alias(c + "0") for c in ("x", "y", "n", "n_cells", "effort")])
    b = g.select(F.col("patch").alias("patch_to"), F.col("year").alias("year_to"), *[F.col(c).alias(c + "1") for c in ("x", "y", "n", "n_cells", "effort")])
    shared = m.select("from_id", "to_id").join(cells.select(F.col("patch").alias("from_id"), "cell_id"), "from_id").join(cells.select(F.col("patch").alias("to_id"), F.col("cell_id").alias("c2")), "to_id").where("cell_id = c2").groupBy("from_id", "to_id").agg(F.count("*").alias("shared"))
    both = m.join(shared, ["from_id", "to_id"], "left").fillna(0, ["shared"]).join(a, F.col("from_id") == F.col("patch_from")).join(b, F.col("to_id") == F.col("patch_to"))
    dx, dy = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    both = both.select(
        F.lit("matched").alias("status"), "year_from", "patch_from", "patch_to", F.round("iou", 6).alias("iou"), F.round("distance", 4).alias("distance"), F.round(E.growth(F.col("n1"), F.col("n0")), 6).alias("growth"), F.round(F.log(F.col("n1") / F.col("n0")), 6).alias("log_ratio"),
        F.round(E.azimuth(dx, dy), 4).alias("azimuth"), (F.col("n_cells1") - F.col("shared")).alias("new_cells"), (F.col("n_cells0") - F.col("shared")).alias("lost_cells"), F.col("effort0").alias("effort_from"), F.col("effort1").alias("effort_to"), F.round(E.log_ratio(F.col("effort1"), F.col("effort0")), 6).alias("d_log_effort"),
    )
    span = g.agg(F.min("year").alias("y0"), F.max("year").alias("y1")).first()
    gone = a.where(F.col("year_from") < F.lit(span["y1"])).join(m, F.col("patch_from") == F.col("from_id"), "left_anti").select(F.lit("disappeared").alias("status"), "year_from", "patch_from", F.col("n_cells0").alias("lost_cells"), F.col("effort0").alias("effort_from"))
    born = b.where(F.col("year_to") > F.lit(span["y0"])).join(m, F.col("patch_to") == F.col("to_id"), "left_anti").select(F.lit("new").alias("status"), (F.col("year_to") - 1).alias("year_from"), "patch_to", F.col("n_cells1").alias("new_cells"), F.col("effort1").alias("effort_to"))
    return both.unionByName(gone, allowMissingColumns=True).unionByName(born, allowMissingColumns=True)


@query(f"""with recursive {_YEARS_SQL} select patch, "year", case when patch like '%P%' then 'cluster' else 'single' end kind, n n_points, n_cells, round(x, 4) cx, round(y, 4) cy, round(r, 4) radius, round(mr, 4) mean_radius
from g join (select patch, max(sqrt((m.x - g.x) ** 2 + (m.y - g.y) ** 2)) r, avg(sqrt((m.x - g.x) ** 2 + (m.y - g.y) ** 2)) mr from member m join g using (patch) group by 1) using (patch)""")
def yearly_patches(spark: SparkSession, d: str) -> DataFrame:
    """Named patches of every year, clusters and points alone, with size, centroid and radii."""
    p = cut(V.pts(spark, d).where("year is not null").select("key", "year", "x", "y", "cell_id"))
    c = spatial.dbscan2(p, "key", 500.0, within=["year"]).select("key", F.coalesce("cluster", "key").alias("cluster"), F.col("cluster").isNotNull().alias("many"))
    c = cut(p.join(c, "key"))
    f = c.groupBy("year", "cluster", "many").agg(F.count("*").alias("n_points"), F.count_distinct("cell_id").alias("n_cells"), _centre("x").alias("cx"), _centre("y").alias("cy"))
    off = F.hypot(F.col("x") - F.col("cx"), F.col("y") - F.col("cy"))
    r = c.join(f.select("year", "cluster", "cx", "cy"), ["year", "cluster"]).groupBy("year", "cluster").agg(F.max(off).alias("radius"), F.avg(off).alias("mean_radius"))
    runs = grouped_runs(f.join(r, ["year", "cluster"]), ["year", "many"], [F.asc("cluster")], {"k": F.lit(1)})
    name = F.concat(F.col("year").cast("string"), F.when(F.col("many"), "_P").otherwise("_S"), F.format_string("%03d", F.col("k") - 1))
    return runs.select(name.alias("patch"), "year", F.when(F.col("many"), "cluster").otherwise("single").alias("kind"), "n_points", "n_cells", *[F.round(c, 4).alias(c) for c in ("cx", "cy", "radius", "mean_radius")])


@query("""with p as (select patch_id, count(*) filter (where "year" < 2015) n0, count(*) filter (where "year" >= 2015) n1, avg(x3035) filter (where "year" < 2015) x0, avg(y3035) filter (where "year" < 2015) y0, avg(x3035) filter (where "year" >= 2015) x1, avg(y3035) filter (where "year" >= 2015) y1
from (select distinct key, patch_id, "year", x3035, y3035 from target_points_clustered where key is not null) where patch_id is not null group by 1)
select patch_id, round((n1 - n0) / cast(n0 as double), 6) growth, round(ln((n1 + 1) / (n0 + 1)), 6) log_ratio, round(sqrt((x1 - x0) ** 2 + (y1 - y0) ** 2), 4) shift, round((degrees(atan2(x1 - x0, y1 - y0)) + 360) % 360, 4) azimuth from p where n0 > 0 and n1 > 0""")
def growth_azimuth(spark: SparkSession, d: str) -> DataFrame:
    """Growth, log ratio, shift and compass direction of the centroid between two periods."""
    p, early, late = V.pts(spark, d).where("patch_id is not null"), F.col("year") < 2015, F.col("year") >= 2015
    g = p.groupBy("patch_id").agg(F.count_if(early).alias("n0"), F.count_if(late).alias("n1"), *[F.avg(F.when(m, F.col(c))).alias(c + k) for c in "xy" for k, m in (("0", early), ("1", late))]).where("n0 > 0 and n1 > 0")
    dx, dy = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    return g.select("patch_id", F.round(E.growth(F.col("n1"), F.col("n0")), 6).alias("growth"), F.round(E.log_ratio(F.col("n1"), F.col("n0")), 6).alias("log_ratio"), F.round(F.hypot(dx, dy), 4).alias("shift"), F.round(E.azimuth(dx, dy), 4).alias("azimuth"))


@query("""with b as (select floor(min(x) / 1000) x0, ceil(max(x) / 1000) x1, floor(min(y) / 1000) y0, ceil(max(y) / 1000) y1 from grid_1km_ua)
select r * 100000 + c cell_id, r "row", c col, cast(c * 1000 + 500 as double) x, cast(r * 1000 + 500 as double) y from (select unnest(range(cast(y0 as bigint), cast(y1 as bigint))) r, x0, x1 from b) join (select unnest(range(cast(x0 as bigint), cast(x1 as bigint))) c from b) on true""")
def grid_generate(spark: SparkSession, d: str) -> DataFrame:
    """Every 1 km cell of the bounds of the grid: rows by columns, keyed and centred."""
    b = table(spark, d, "grid_1km_ua").agg(F.floor(F.min("x") / 1000).alias("x0"), F.ceil(F.max("x") / 1000).alias("x1"), F.floor(F.min("y") / 1000).alias("y0"), F.ceil(F.max("y") / 1000).alias("y1"))
    cells = b.select(F.explode(F.sequence("y0", F.col("y1") - 1)).alias("row"), "x0", "x1").select("row", F.explode(F.sequence("x0", F.col("x1") - 1)).alias("col"))
    return cells.select((F.col("row") * 100000 + F.col("col")).alias("cell_id"), "row", "col", (F.col("col") * 1000 + 500.0).alias("x"), (F.col("row") * 1000 + 500.0).alias("y"))


_SPACED_SQL = """spaced as (select grp, cast(0 as bigint) i, cast([] as struct(cell_id bigint, x double, y double)[]) kept from (select distinct grp from ordered)
  union all select spaced.grp, o.rn, case when len(list_filter(kept, lambda k: (k.x - o.x) ** 2 + (k.y - o.y) ** 2 < 8000.0 ** 2)) = 0 then list_append(kept, struct_pack(cell_id := o.cell_id, x := o.x, y := o.y)) else kept end from spaced join ordered o on o.grp = spaced.grp and o.rn = spaced.i + 1),
spaced_all as (select grp, unnest(kept) k, generate_subscripts(kept, 1) place from (select grp, kept from spaced qualify row_number() over (partition by grp order by i desc) = 1))"""
_HASH = "((cast('0x' || substr(md5(concat_ws('|', cast(cell_id as varchar), '7')), 1, 12) as bigint) + 0.5) / 281474976710656.0)"


@query(f"""with recursive {V.GRID_SQL}, ordered as (select cell_id, oblast_code grp, x, y, row_number() over (partition by oblast_code order by -ln{_HASH}, cell_id) rn from grid where oblast_code is not null), {_SPACED_SQL}
select k.cell_id cell_id, grp oblast_code, k.x x, k.y y from spaced_all where place <= 12""")
def spaced_sample(spark: SparkSession, d: str) -> DataFrame:
    """Cells of each region in random order, at least 8 km apart, 12 per region at most: a sampling operator."""
    g = V.grid(spark, d).where("oblast_code is not null").select("cell_id", "oblast_code", "x", "y")
    return spatial.spaced_sample(g, "cell_id", 8000.0, -F.log(E.hash_unit(7, F.col("cell_id"))), within=["oblast_code"], most=12)


_FAR_SQL = """far as (select 0 step, [struct_pack(key := key, x := x, y := y)] chosen, cast(null as double) dd from (select key, x, y from pool order by seed_order, key limit 1)
  union all select step + 1, list_append(chosen, struct_pack(key := q.key, x := q.x, y := q.y)), q.dd from far, lateral (select pool.key, pool.x, pool.y, list_min(list_transform(far.chosen, lambda s: sqrt((pool.x - s.x) ** 2 + (pool.y - s.y) ** 2))) dd from pool order by dd desc, pool.key limit 1) q where step + 1 < {k} and q.dd >= {least})"""


@query(f"""with recursive {V.PTS_SQL}, pool as (select distinct key, x, y, 0 seed_order from pts), {_FAR_SQL.format(k=20, least=1000)}
select chosen[step + 1].key key, chosen[step + 1].x x, chosen[step + 1].y y, step, round(case when step = 0 then null else dd end, 4) distance from far""")
def farthest_points(spark: SparkSession, d: str) -> DataFrame:
    """Twenty points spread as widely as greedy choice can."""
    return spatial.farthest_points(V.pts(spark, d), "key", 20, least=1000.0).withColumn("distance", F.round("distance", 4))


_ALLOC_SQL = """alloc as (select 0 step, list(struct_pack(c := c, w := 100.0 * (w / whole), g := 1) order by c) st from (select c, w, sum(w) over () whole from weights)
  union all select step + 1, list_transform(st, lambda e: struct_pack(c := e.c, w := e.w, g := e.g + cast(e.c = pick as integer))) from (select step, st, list_sort(list_transform(list_filter(st, lambda e: e.g < 12), lambda e: struct_pack(d := e.g - e.w, c := e.c)))[1].c pick from alloc where step < 100 - len(st)) where pick is not null),
places as (select e.c c, e.g n from (select unnest(st) e from (select st from alloc order by step desc limit 1)))"""


@query(f"""with recursive {V.PTS_SQL}, {V.GRID_SQL}, weights as (select oblast_code c, cast(count(*) as double) w from pts join (select cell_id, oblast_code from grid) using (cell_id) where oblast_code is not null group by 1), {_ALLOC_SQL} select c oblast_code, n from places""")
def capped_alloc(spark: SparkSession, d: str) -> DataFrame:
    """A hundred places shared among regions in proportion to their target points, 1 to 12 each."""
    g = V.grid(spark, d).select("cell_id", "oblast_code")
    w = V.pts(spark, d).join(g, "cell_id").where("oblast_code is not null").groupBy("oblast_code").count()
    got = allocate_capped({r["oblast_code"]: float(r["count"]) for r in w.collect()}, 100)
    return spark.createDataFrame(sorted(got.items()), "oblast_code string, n int")


@query(f"""with recursive {V.PU_SQL}, {V.GRID_SQL}, work as (select cell_id, p.x, p.y, oblast_code, score, abs(score - score2) gap, pu.y label, coalesce(effort, 0) effort from (select cell_id, x, y, oblast_code from grid) p join pu using (cell_id)),
lim as (select (select score from work order by score desc limit 1 offset 499) t, (select quantile_cont(gap, 0.9) from work) q),
free as (select work.* from work, lim where label = 0 and not (score >= t and gap > q)),
exploit as (select cell_id from free order by score desc, cell_id limit 250),
pool as (select cell_id key, free.x, free.y, score, abs(score - t) seed_order from free, lim where cell_id not in (select cell_id from exploit) and abs(score - t) <= 0.1), {_FAR_SQL.format(k=150, least=15000)},
unsure as (select unnest(list_transform((select chosen from far order by step desc limit 1), lambda s: s.key)) cell_id),
low as (select work.* from work where label = 0 and score < (select min(score) from pool) and cell_id not in (select cell_id from exploit) and cell_id not in (select cell_id from unsure) and oblast_code is not null),
weights as (select c, 1.0 / (m + 5.0) w from (select oblast_code c, quantile_cont(cast(effort as double), 0.5) m from work where oblast_code in (select oblast_code from low) group by 1)), {_ALLOC_SQL},
ordered as (select cell_id, oblast_code grp, x, y, row_number() over (partition by oblast_code order by -ln{_HASH} * (effort + 1), cell_id) rn from low), {_SPACED_SQL}
select cell_id, 'exploit' category from exploit union all select cell_id, 'uncertainty' from unsure union all select k.cell_id, 'exploration' from spaced_all join places on c = grp where place <= n""")
def field_batch(spark: SparkSession, d: str) -> DataFrame:
    """A batch of cells to visit: the best ones, a spread of those near the threshold, and a spaced sample of the rest, shared among regions by inverse effort."""
    g = V.grid(spark, d).select("cell_id", "x", "y", "oblast_code")
    w = V.pu(spark, d).select("cell_id", "score", F.abs(F.col("score") - F.col("score2")).alias("gap"), F.col("y").alias("label"), F.coalesce("effort", F.lit(0)).alias("effort"))
    return batch.field_batch(cut(g.join(w, "cell_id")), "cell_id", "oblast_code")


@query(f"""with {V.PTS_SQL}, {V.EDGES_SQL} select key, oblast_code from pts, region_edges group by pts.key, pts.cell_id, pts.patch_id, pts."year", pts.x, pts.y, oblast_code having {V.INSIDE_SQL}""")
def point_in_polygon(spark: SparkSession, d: str) -> DataFrame:
    """The region each target point lies in, by the even-odd rule over all units."""
    return dualtree.regions_of(V.pts(spark, d), "key", "x", "y", table(spark, d, "admin_units"), "oblast_code", "geometry_wkt")


_REGION_OF_CELL = "inside as (select cell_id, min(oblast_code) oblast_code from (select cell_id, region_edges.oblast_code from centre, region_edges group by cell_id, x, y, region_edges.oblast_code having " + V.INSIDE_SQL + ") group by 1)"


@query(f"""with {V.GRID_SQL}, {V.EDGES_SQL}, centre as (select cell_id, x, y from grid where x is not null and y is not null), {_REGION_OF_CELL},
other as (select cell_id o, oblast_code, x ox, y oy from inside join centre using (cell_id)), rest as (select * from centre where cell_id not in (select cell_id from inside)),
near as (select cell_id, oblast_code from rest, other qualify row_number() over (partition by cell_id order by (x - ox) ** 2 + (y - oy) ** 2, o) = 1)
select cell_id, oblast_code, false by_nearest from inside union all select cell_id, oblast_code, true from near""")
def region_or_nearest(spark: SparkSession, d: str) -> DataFrame:
    """The region of each grid cell; cells in none take that of the nearest cell which has one."""
    g = cut(V.grid(spark, d).select("cell_id", "x", "y"))
    got = dualtree.regions_of(g, "cell_id", "x", "y", table(spark, d, "admin_units"), "oblast_code", "geometry_wkt").groupBy("cell_id").agg(F.min("oblast_code").alias("oblast_code"))
    got = cut(got)
    rest = g.join(got, "cell_id", "left_anti")
    near = spatial.nearest(rest, "cell_id", g.join(got, "cell_id").withColumnRenamed("cell_id", "other"), "other")
    filled = near.join(got.withColumnRenamed("cell_id", "other"), "other").select("cell_id", "oblast_code", F.lit(True).alias("by_nearest"))
    return got.withColumn("by_nearest", F.lit(False)).unionByName(filled)


@query(f"""with b as (select floor(min(x) / 1000) x0, ceil(max(x) / 1000) x1, floor(min(y) / 1000) y0, ceil(max(y) / 1000) y1 from grid_1km_ua), {V.EDGES_SQL},
centre as (select r * 100000 + c cell_id, cast(c * 1000 + 500 as double) x, cast(r * 1000 + 500 as double) y from (select unnest(range(cast(y0 as bigint), cast(y1 as bigint))) r, x0, x1 from b) join (select unnest(range(cast(x0 as bigint), cast(x1 as bigint))) c from b) on true), {_REGION_OF_CELL}
select cell_id, oblast_code, x, y from inside join centre using (cell_id)""")
def grid_in_regions(spark: SparkSession, d: str) -> DataFrame:
    """The generated 1 km cells whose centre a region contains, with that region."""
    g = cut(grid_generate(spark, d).select("cell_id", "x", "y"))
    got = dualtree.regions_of(g, "cell_id", "x", "y", table(spark, d, "admin_units"), "oblast_code", "geometry_wkt").groupBy("cell_id").agg(F.min("oblast_code").alias("oblast_code"))
    return g.join(got, "cell_id").select("cell_id", "oblast_code", "x", "y")


@query(f"""with {V.PTS_SQL}, n as (select floor(x / 20000) bx, floor(y / 20000) by_, count(*) n from pts group by 1, 2), o as (select *, sum(n) over (order by md5(concat_ws('|', cast(cast(bx as bigint) as varchar), cast(cast(by_ as bigint) as varchar), '42')), bx, by_) - n before from n),
t as (select pts.*, coalesce(before < 0.2 * (select count(*) from pts), false) is_test from pts left join o on floor(x / 20000) = bx and floor(y / 20000) = by_)
select key, case when is_test then 'test' when exists (select 1 from t u where u.is_test and sqrt((t.x - u.x) ** 2 + (t.y - u.y) ** 2) < 5000) then 'buffer' else 'train' end part from t""")
def block_split_buffer(spark: SparkSession, d: str) -> DataFrame:
    """Points of the 20 km block split: test, train, and the buffer of 5 km around the test points that is in neither."""
    s = cut(ml.block_split(V.pts(spark, d), "x", "y", 20000.0, 0.2, 42))
    rest, test = s.where("not is_test"), s.where("is_test")
    near = spatial.nearest(rest, "key", test.withColumnRenamed("key", "other"), "other").where("distance < 5000").select("key", F.lit("buffer").alias("part"))
    out = rest.select("key").join(near, "key", "left").select("key", F.coalesce("part", F.lit("train")).alias("part"))
    return test.select("key", F.lit("test").alias("part")).unionByName(out)


@query(f"""with {V.GRID_SQL}, lab as (select cell_id, count(*) n_target, min("year") first_year, max("year") last_year from (select distinct key, cell_id, "year" from target_points_clustered where key is not null and cell_id is not null) group by 1),
pick as (select cell_id from grid order by md5(concat_ws('|', cast(cell_id as varchar), '42')), cell_id limit 200)
select cell_id, coalesce(n_target, 0) n_target, first_year, last_year, case when n_target > 0 then 'positive' else 'unknown' end label_state, pick.cell_id is not null ctrl_random, oblast_code from lab full join pick using (cell_id) left join (select cell_id, oblast_code from grid) using (cell_id)""")
def label_completion(spark: SparkSession, d: str) -> DataFrame:
    """Labelled cells, completed by the cells of a random control sample that have no record: counts 0, years NULL. A sampling operator, hence the limit."""
    g = V.grid(spark, d).select("cell_id", "oblast_code")
    p = table(spark, d, "target_points_clustered").where("key is not null and cell_id is not null").select("key", "cell_id", "year").distinct()
    lab = p.groupBy("cell_id").agg(F.count("*").alias("n_target"), F.min("year").alias("first_year"), F.max("year").alias("last_year"))
    pick = g.select("cell_id").orderBy(E.order_hash(42, F.col("cell_id")), "cell_id").limit(200).withColumn("ctrl_random", F.lit(True))
    out = lab.join(pick, "cell_id", "full").join(g, "cell_id", "left")
    return out.select("cell_id", F.coalesce("n_target", F.lit(0)).alias("n_target"), "first_year", "last_year", F.when(F.col("n_target") > 0, "positive").otherwise("unknown").alias("label_state"), F.coalesce("ctrl_random", F.lit(False)).alias("ctrl_random"), "oblast_code")


_LINES_SQL = 'lines as (select nearest_reach line, arg_min(x, cell_id) x1, arg_min(y, cell_id) y1, arg_max(x, cell_id) x2, arg_max(y, cell_id) y2 from grid_1km_ua where nearest_reach is not null and cell_id is not null and x is not null and y is not null group by 1)'


def _lines(spark: SparkSession, d: str) -> DataFrame:
    """A segment for each river reach, from its first to its last cell: line, x1, y1, x2, y2."""
    g = table(spark, d, "grid_1km_ua").where("nearest_reach is not null and cell_id is not null and x is not null and y is not null")
    return g.groupBy(F.col("nearest_reach").alias("line")).agg(*[f(c, "cell_id").alias(c + k) for k, f in (("1", F.min_by), ("2", F.max_by)) for c in "xy"])


@query(f"""with {V.PTS_SQL}, {_LINES_SQL},
m as (select key, line, greatest(0, least(1, coalesce(((x - x1) * (x2 - x1) + (y - y1) * (y2 - y1)) / nullif((x2 - x1) ** 2 + (y2 - y1) ** 2, 0), 0))) t, x, y, x1, y1, x2, y2 from pts, lines),
q as (select key, line, sqrt((x - x1 - t * (x2 - x1)) ** 2 + (y - y1 - t * (y2 - y1)) ** 2) dd from m)
select key, line, round(dd, 5) distance from q qualify row_number() over (partition by key order by dd, line) = 1""")
def nearest_segment(spark: SparkSession, d: str) -> DataFrame:
    """The nearest line, here one per river reach, of each target point."""
    n = spatial.nearest_segment(V.pts(spark, d), "key", _lines(spark, d), "line")
    return n.select("key", "line", F.round("distance", 5).alias("distance"))


@query("""with r as (select cast("row" as bigint) "row", cast(col as bigint) col, nullif(case when ("row" + col) % 5 = 0 then -9999.0 else "row" * 0.5 + col end, -9999.0) v from (select distinct cell_id, "row", col from grid_1km_ua where cell_id is not null)),
p as (select distinct key, cast(floor((2900000 - y3035) / 1000) as bigint) r, cast(floor((x3035 - 5300000) / 1000) as bigint) c from target_points_clustered where key is not null)
select key, cast(v as double) bio_01 from p left join r on 2899 - r."row" = p.r and r.col - 5300 = p.c""")
def raster_long_sample(spark: SparkSession, d: str) -> DataFrame:
    """Values of a long raster (one row per pixel, a mark for missing ones) at the target points."""
    from loam.sources.files import sample_raster

    cells = table(spark, d, "grid_1km_ua").where("cell_id is not null").select("cell_id", "row", "col").distinct()
    value = F.when((F.col("row") + F.col("col")) % 5 == 0, -9999.0).otherwise(F.col("row") * 0.5 + F.col("col"))
    raster = cells.select(F.lit("bio_01").alias("band"), (2899 - F.col("row")).cast("bigint").alias("row"), (F.col("col") - 5300).cast("bigint").alias("col"), value.alias("value"))
    return sample_raster(V.pts(spark, d), raster, "x", "y", 5300000.0, 2900000.0, 1000.0, 1000.0, ["bio_01"]).select("key", "bio_01")


@query(f"""with {V.PTS_SQL}, q as (select distinct patch_id, x, y from pts where patch_id is not null and x is not null and y is not null), n as (select patch_id, count(*) n_points from pts where patch_id is not null group by 1),
side as (select a.patch_id, a.x ax, a.y ay, b.x bx, b.y by_ from q a join q b on a.patch_id = b.patch_id and (a.x <> b.x or a.y <> b.y) where not exists (select 1 from q c where c.patch_id = a.patch_id and
  ((b.x - a.x) * (c.y - a.y) - (b.y - a.y) * (c.x - a.x) < 0 or (b.x - a.x) * (c.y - a.y) - (b.y - a.y) * (c.x - a.x) = 0 and ((c.x - a.x) * (b.x - a.x) + (c.y - a.y) * (b.y - a.y) < 0 or (c.x - b.x) * (a.x - b.x) + (c.y - b.y) * (a.y - b.y) < 0)))),
o as (select patch_id, min(x) ox, min(y) oy from q group by 1),
h as (select patch_id, sum((ax - ox) * (by_ - oy) - (bx - ox) * (ay - oy)) / 2 area, sum(sqrt((bx - ax) ** 2 + (by_ - ay) ** 2)) perimeter, count(*) corners from side join o using (patch_id) group by 1)
select patch_id, n_points, round(coalesce(area, 0), 2) hull_area, round(coalesce(perimeter, 0), 4) hull_perimeter, cast(coalesce(corners, 1) as integer) corners, round(case when perimeter > 0 then 4 * pi() * area / (perimeter * perimeter) end, 6) compactness, round(n_points / nullif(area / 1e6, 0), 4) density_km2 from n join o using (patch_id) left join h using (patch_id)""")
def patch_hulls(spark: SparkSession, d: str) -> DataFrame:
    """Area, perimeter, corners, compactness and density of the convex hull of each patch."""
    p = V.pts(spark, d).where("patch_id is not null")
    h = hulls(p, "patch_id", "x", "y").join(p.groupBy("patch_id").agg(F.count("*").alias("n_points")), "patch_id")
    return h.select(
        "patch_id", "n_points", F.round("hull_area", 2).alias("hull_area"), F.round("hull_perimeter", 4).alias("hull_perimeter"), "corners",
        F.round(E.compactness(F.col("hull_area"), F.nullif(F.col("hull_perimeter"), F.lit(0.0))), 6).alias("compactness"), F.round(F.try_divide(F.col("n_points"), F.nullif(F.col("hull_area") / 1e6, F.lit(0.0))), 4).alias("density_km2"),
    )


@query(f"""with {V.PTS_SQL}, a as (select radians("year" * 37.0) t from pts where "year" is not null) select count(*) n, round(sqrt(sum(cos(t)) ** 2 + sum(sin(t)) ** 2) / count(*), 8) r, round((sum(cos(t)) ** 2 + sum(sin(t)) ** 2) / count(*), 5) z from a""")
def rayleigh(spark: SparkSession, d: str) -> DataFrame:
    """Rayleigh statistic of a set of directions: resultant length and z."""
    t = F.radians(F.col("year") * 37.0)
    s = V.pts(spark, d).where("year is not null").agg(F.count("*").alias("n"), F.sum(F.cos(t)).alias("c"), F.sum(F.sin(t)).alias("s"))
    return s.select("n", F.round(F.hypot("c", "s") / F.col("n"), 8).alias("r"), F.round((F.col("c") * F.col("c") + F.col("s") * F.col("s")) / F.col("n"), 5).alias("z"))


@query(f"""with {V.GRID_SQL}, n as (select cell_id, "row", col, coalesce(cast(n_plant_effort as double), 0) v from grid join grid_features_static using (cell_id, "row", col)), m as (select avg(v) m, sum((v - (select avg(v) from n)) ** 2) s, count(*) k from n),
w as (select a.v av, b.v bv from n a join n b on (abs(a."row" - b."row") + abs(a.col - b.col)) = 1)
select count(*) pairs, round(max(k) / count(*) * sum((av - m) * (bv - m)) / max(s), 8) moran from w, m""")
def moran(spark: SparkSession, d: str) -> DataFrame:
    """Moran's I of a cell value over cells that share a side; neighbours by key, not by distance."""
    n = V.grid(spark, d).join(table(spark, d, "grid_features_static").select("cell_id", F.coalesce(F.col("n_plant_effort").cast("double"), F.lit(0.0)).alias("v")), "cell_id").select("row", "col", "v")
    b = n.agg(F.avg("v").alias("m"), F.count("*").alias("k")).first()
    s = n.agg(F.sum(F.pow(F.col("v") - b["m"], 2))).first()[0]
    steps = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in ((0, 1), (1, 0), (0, -1), (-1, 0))])
    a = n.withColumn("o", F.explode(steps)).select((F.col("row") + F.col("o.i")).alias("row"), (F.col("col") + F.col("o.j")).alias("col"), F.col("v").alias("av"))
    w = a.join(n, ["row", "col"])
    return w.agg(F.count("*").alias("pairs"), F.sum((F.col("av") - b["m"]) * (F.col("v") - b["m"])).alias("x")).select("pairs", F.round(F.col("x") / s * b["k"] / F.col("pairs"), 8).alias("moran"))


@query(r"""with box as (select oblast_code, list_transform(regexp_extract_all(geometry_wkt, '([0-9.]+) ([0-9.]+)', 1), lambda v: cast(v as double)) xs, list_transform(regexp_extract_all(geometry_wkt, '([0-9.]+) ([0-9.]+)', 2), lambda v: cast(v as double)) ys from admin_units where geometry_wkt is not null),
km as (select distinct r, c from (select unnest(range(cast(list_min(ys) as bigint) // 1000, cast(list_max(ys) as bigint) // 1000)) r, xs from box) a, lateral (select unnest(range(cast(list_min(a.xs) as bigint) // 1000, cast(list_max(a.xs) as bigint) // 1000)) c) b),
side as (select count(*) n from km, (values (0, 1), (1, 0), (0, -1), (-1, 0)) s(i, j) where (r + i, c + j) not in (select (r, c) from km))
select (select count(*) from box) n_regions, cast((select count(*) from km) as double) area_km2, cast(n as double) perimeter_km from side""")
def country_outline(spark: SparkSession, d: str) -> DataFrame:
    """Area and outline of the union of all regions, a dimension table; SQL counts the kilometre squares its rectangles are made of."""
    u = region_union(table(spark, d, "admin_units"), "geometry_wkt", dualtree.parse_polygons)
    return u.select("n_regions", F.round(F.col("area") / 1e6, 6).alias("area_km2"), F.round(F.col("perimeter") / 1e3, 6).alias("perimeter_km"))


@query(f"""with {_LINES_SQL}, {V.EDGES_SQL}, sides as (select line, oblast_code, (x2 - x1) * (e.y1 - l.y1) - (y2 - y1) * (e.x1 - l.x1) a, (x2 - x1) * (e.y2 - l.y1) - (y2 - y1) * (e.x2 - l.x1) b,
 (e.x2 - e.x1) * (l.y1 - e.y1) - (e.y2 - e.y1) * (l.x1 - e.x1) c, (e.x2 - e.x1) * (l.y2 - e.y1) - (e.y2 - e.y1) * (l.x2 - e.x1) d, l.x1 ax, l.y1 ay, l.x2 bx, l.y2 by_, e.x1 cx, e.y1 cy, e.x2 dx, e.y2 dy
 from (select line, x1, y1, x2, y2 from lines) l, region_edges e)
select line, oblast_code from sides where sign(a) * sign(b) <= 0 and sign(c) * sign(d) <= 0 and least(ax, bx) <= greatest(cx, dx) and least(cx, dx) <= greatest(ax, bx) and least(ay, by_) <= greatest(cy, dy) and least(cy, dy) <= greatest(ay, by_)
union select line, oblast_code from (select line, oblast_code, l.x1 x, l.y1 y, e.x1, e.y1, e.x2, e.y2 from lines l, region_edges e) group by line, oblast_code, x, y having {V.INSIDE_SQL}""".replace("(x2 - x1) * (e.y1", "(l.x2 - l.x1) * (e.y1").replace("- (y2 - y1) * (e.x1", "- (l.y2 - l.y1) * (e.x1").replace("(x2 - x1) * (e.y2", "(l.x2 - l.x1) * (e.y2").replace("- (y2 - y1) * (e.x2", "- (l.y2 - l.y1) * (e.x2"))
def lines_in_regions(spark: SparkSession, d: str) -> DataFrame:
    """The regions each line, here one per river reach, runs through or touches."""
    return dualtree.lines_meeting_regions(_lines(spark, d), "line", table(spark, d, "admin_units"), "oblast_code", "geometry_wkt")
