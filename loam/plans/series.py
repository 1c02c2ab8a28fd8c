"""Queries of the time-series operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loam.functions import expr as E
from loam.operators import timeseries as T
from loam.operators.ranked import grouped_median
from loam.plans import views as V
from loam.plans.registry import query
from loam.sources.tables import table


@query(f"""with {V.SER_SQL} select point, cast(year(d) as integer) "year", round(coalesce(sum(v) filter (where month(d) in (4, 5, 6, 7, 8, 9)), 0), 2) warm_sum, round(avg(v) filter (where month(d) in (12, 1, 2)), 4) winter_mean, count(*) filter (where v > 150000) n_high, round(coalesce(sum(v) filter (where month(d) = 7 and v > 200000), 0), 2) july_high from ser where point is not null group by 1, 2""")
def conditional_season_sums(spark: SparkSession, d: str) -> DataFrame:
    """Several seasonal sums and means per point and year in one pass."""
    s = V.ser(spark, d).withColumn("year", F.year("d"))
    m, v = F.month("d"), F.col("v")
    out = T.conditional_aggregates(s, ["point", "year"], {"warm_sum": (m.isin(4, 5, 6, 7, 8, 9), v, "sum"), "winter_mean": (m.isin(12, 1, 2), v, "mean"), "n_high": (v > 150000, v, "count"), "july_high": ((m == 7) & (v > 200000), v, "sum")})
    return out.select("point", "year", F.round("warm_sum", 2).alias("warm_sum"), F.round("winter_mean", 4).alias("winter_mean"), "n_high", F.round("july_high", 2).alias("july_high"))


@query(f"""with {V.SER_SQL} select point, round(avg(v), 4) v_mean, round(stddev_samp(v), 4) v_std, round(quantile_cont(v, 0.5), 4) v_median, min(case when v > 300000 then d end) first_high from ser group by 1""")
def mean_std_cols(spark: SparkSession, d: str) -> DataFrame:
    """Mean, sample deviation, median and first non-NULL value per point."""
    s = V.ser(spark, d)
    median = grouped_median(s, ["point"], "v", "m").select("point", F.round("m", 4).alias("v_median"))
    return s.groupBy("point").agg(F.round(F.avg("v"), 4).alias("v_mean"), F.round(F.stddev_samp("v"), 4).alias("v_std"), F.min(F.when(F.col("v") > 300000, F.col("d"))).alias("first_high")).join(median, "point")


@query(f'with {V.YEARLY_SQL} select point, "year", v, lag(v) over (partition by point order by "year") prev_v from yearly')
def lag_by_row(spark: SparkSession, d: str) -> DataFrame:
    return T.lag_by_row(V.yearly(spark, d).select("point", "year", "v"), ["point"], "year", ["v"])


@query(f'with {V.YEARLY_SQL} select a.point, a."year", a.v, b.v prev_v from yearly a left join yearly b on a.point = b.point and b."year" = a."year" - 1')
def lag_by_year(spark: SparkSession, d: str) -> DataFrame:
    return T.lag_by_year(V.yearly(spark, d).select("point", "year", "v"), ["point"], "year", ["v"])


@query(f'with {V.YEARLY_SQL} select point, "year", round(v - avg(v) over (partition by point), 4) anom_v, round((v - avg(v) over (partition by point)) / nullif(stddev_samp(v) over (partition by point), 0), 6) anomz_v from yearly')
def anomaly_zscore(spark: SparkSession, d: str) -> DataFrame:
    a = T.anomalies(V.yearly(spark, d).select("point", "year", "v"), ["point"], ["v"])
    return a.select("point", "year", F.round("anom_v", 4).alias("anom_v"), F.round("anomz_v", 6).alias("anomz_v"))


@query(f"""with {V.WND_SQL}, g as (select point, count(*) n, avg(speed * sin(radians(angle))) u, avg(speed * cos(radians(angle))) v, avg(speed) s from wnd group by 1)
select point, n, round(u, 6) u, round(v, 6) v, round(s, 6) speed, round(sqrt(u * u + v * v) / nullif(s, 0), 6) constancy, round(((degrees(atan2(u, v)) + 360) % 360 + 180) % 360, 3) downwind from g where sqrt(u * u + v * v) > 0""")
def wind_vectors(spark: SparkSession, d: str) -> DataFrame:
    """Mean wind vector, constancy and where it blows to, per point."""
    w = T.wind_vectors(V.wnd(spark, d), ["point"], F.col("angle"), F.col("speed")).where("direction is not null")
    return w.select("point", "n", F.round("u", 6).alias("u"), F.round("v", 6).alias("v"), F.round("speed", 6).alias("speed"), F.round("constancy", 6).alias("constancy"), F.round(E.downwind(F.col("direction")), 3).alias("downwind"))


@query(f"""with {V.WND_SQL}, day as (select point, d, min(value) lo, max(value) hi from wnd group by 1, 2)
select point, round(sum(greatest(least((lo + hi) / 2, 30) - 5, 0)), 4) gdd, cast(sum(case when lo < 1 then 1 else 0 end) as bigint) frost_days from day group by 1""")
def gdd_frost(spark: SparkSession, d: str) -> DataFrame:
    """Degree days and frost days from daily extremes."""
    day = V.wnd(spark, d).groupBy("point", "d").agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    return day.groupBy("point").agg(F.round(F.sum(E.degree_days(F.col("lo"), F.col("hi"), 5.0, 30.0)), 4).alias("gdd"), F.sum((F.col("lo") < 1).cast("int")).alias("frost_days"))


@query("select n_nationkey point, date '2020-01-01' + cast(i as integer) date, n_nationkey + i t, case when i % 2 = 0 then cast(n_nationkey * 10 + i as double) end p from nation, range(4) r(i)")
def json_map_unpivot(spark: SparkSession, d: str) -> DataFrame:
    """Daily rows from a map of maps, as climate services answer."""
    n = table(spark, d, "nation")
    days = F.sequence(F.lit(0), F.lit(3))
    name = lambda i: F.date_format(F.date_add(F.lit("2020-01-01").cast("date"), i), "yyyyMMdd")
    t = F.map_from_entries(F.transform(days, lambda i: F.struct(name(i), (F.col("n_nationkey") + i).cast("double"))))
    p = F.map_from_entries(F.transform(F.filter(days, lambda i: i % 2 == 0), lambda i: F.struct(name(i), F.col("n_nationkey") * 10.0 + i)))
    maps = n.select(F.col("n_nationkey").alias("point"), F.create_map(F.lit("t"), t, F.lit("p"), p).alias("parameter"))
    u = T.unpivot_daily(maps, "point", "parameter", "t", ["t", "p"])
    return u.select("point", "date", F.col("t").cast("bigint").alias("t"), "p")


@query(f"""with {V.WND_SQL} select event_id, round(value, 4) delta_from, round(((((value * 7) % 360 + 360) % 360 - 90 + 180) % 360 + 360) % 360 - 180, 4) off_east from (select event_id, value from events)""")
def circular_difference(spark: SparkSession, d: str) -> DataFrame:
    """Signed difference of a wind direction from east."""
    e = table(spark, d, "events")
    return e.select("event_id", F.round("value", 4).alias("delta_from"), F.round(E.angle_between(E.mod360(F.col("value") * 7), F.lit(90.0)), 4).alias("off_east"))
