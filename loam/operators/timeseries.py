"""Annual features of daily series, lags, anomalies, wind vectors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loam.functions.expr import mod360


def conditional_aggregates(df: DataFrame, keys: list[str], spec: dict[str, tuple[Column, Column, str]]) -> DataFrame:
    """One pass for many masks: name -> (mask, value, sum | mean | count). A sum without rows is 0, a mean NULL."""
    made = {"sum": lambda m, v: F.coalesce(F.sum(F.when(m, v)), F.lit(0.0)), "mean": lambda m, v: F.avg(F.when(m, v)), "count": lambda m, v: F.count(F.when(m, v))}
    return df.where(" and ".join(f"{k} is not null" for k in keys)).groupBy(*keys).agg(*[made[how](m, v).alias(name) for name, (m, v, how) in spec.items()])


def lag_by_row(df: DataFrame, keys: list[str], order: str, columns: list[str], prefix: str = "prev_") -> DataFrame:
    """Values of the row before in each series, whatever its year."""
    w = Window.partitionBy(*keys).orderBy(order)
    return df.select("*", *[F.lag(c, 1).over(w).alias(prefix + c) for c in columns])


def lag_by_year(df: DataFrame, keys: list[str], year: str, columns: list[str], prefix: str = "prev_") -> DataFrame:
    """Values of exactly the year before; NULL where that year is missing."""
    w = Window.partitionBy(*keys).orderBy(year)
    gap = F.col(year) - F.lag(year, 1).over(w)
    return df.select("*", *[F.when(gap == 1, F.lag(c, 1).over(w)).alias(prefix + c) for c in columns])


def anomalies(df: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """``anom_c`` (value - mean of the series) and ``anomz_c`` (divided by its sample deviation; NULL where that is 0 or NULL)."""
    mean = df.groupBy(*keys).agg(*[x for c in columns for x in (F.avg(c).alias(f"_m_{c}"), F.stddev_samp(c).alias(f"_s_{c}"))])
    out = df.join(mean, keys)
    for c in columns:
        out = out.withColumn(f"anom_{c}", F.col(c) - F.col(f"_m_{c}")).withColumn(f"anomz_{c}", F.try_divide(F.col(f"anom_{c}"), F.nullif(f"_s_{c}", F.lit(0.0))))
    return out.drop(*[f"_{k}_{c}" for c in columns for k in "ms"])


def wind_vectors(df: DataFrame, keys: list[str], angle: Column, speed: Column) -> DataFrame:
    """Per key: mean vector ``u``, ``v``, circular mean ``direction`` (NULL without wind), ``constancy`` (vector over scalar mean) and mean ``speed``."""
    rad = F.radians(angle)
    g = df.groupBy(*keys).agg(F.avg(speed * F.sin(rad)).alias("u"), F.avg(speed * F.cos(rad)).alias("v"), F.avg(speed).alias("speed"), F.count("*").alias("n"))
    size = F.hypot("u", "v")
    return g.withColumn("direction", F.when(size > 0, mod360(F.degrees(F.atan2("u", "v"))))).withColumn("constancy", F.try_divide(size, F.nullif("speed", F.lit(0.0))))


def unpivot_daily(df: DataFrame, ident: str, maps: str, dates: str, variables: list[str]) -> DataFrame:
    """``(ident, date, variables...)`` from a map of maps variable -> yyyymmdd -> value: one row per date of the variable ``dates``; days of the others missing there are NULL."""
    m = F.col(maps)
    days = df.select(F.col(ident), m, F.explode(F.map_keys(m[dates])).alias("_day"))
    return days.select(ident, F.to_date("_day", "yyyyMMdd").alias("date"), *[F.try_element_at(m[v], F.col("_day")).alias(v) for v in variables])
