"""Relational helpers whose order and NULL rules are fixed."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def keep_first(df: DataFrame, keys: Sequence[str | Column], order: Sequence[Column]) -> DataFrame:
    """One row per key: the first in ``order``, which must be total for a reproducible result. NULL keys are one key.

    The rank filter runs before the shuffle too, so a hot key sends one row per task.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(w)).where("_rank = 1").drop("_rank")


def union_keep_last(tables: Sequence[DataFrame], keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """Union by name (missing columns are NULL), one row per key: of the last table that has it."""
    every = None
    for i, t in enumerate(tables):
        t = t.withColumn("_source", F.lit(i))
        every = t if every is None else every.unionByName(t, allowMissingColumns=True)
    return keep_first(every, keys, [F.desc("_source"), *order]).drop("_source")


def align_counts(tables: dict[str, DataFrame], key: str) -> DataFrame:
    """Rows per key of several tables side by side, 0 where a table has none: one pass over the union instead of full joins. NULL keys are dropped."""
    every = None
    for name, t in tables.items():
        one = t.select(F.col(key).alias(key), F.lit(name).alias("_table"))
        every = one if every is None else every.unionByName(one)
    counts = [F.count_if(F.col("_table") == name).alias(name) for name in tables]
    return every.where(F.col(key).isNotNull()).groupBy(key).agg(*counts)


def at_year(panel: DataFrame, key: str, year: str, at: int, columns: Sequence[str], suffix: str = "") -> DataFrame:
    """The panel's columns for one year by key, renamed with a suffix: filtered before it is joined."""
    return panel.where(F.col(year) == at).select(key, *[F.col(c).alias(c + suffix) for c in columns])


def narrow_floats(df: DataFrame) -> DataFrame:
    """All double columns as float, other types kept."""
    return df.select(*[F.col(f.name).cast("float").alias(f.name) if f.dataType.simpleString() == "double" else F.col(f.name) for f in df.schema])


def columns_like(df: DataFrame, prefixes: Sequence[str] = (), suffixes: Sequence[str] = (), without: Sequence[str] = ()) -> list[str]:
    """Sorted names that begin or end so, without the excluded ones."""
    return sorted(c for c in df.columns if (c.startswith(tuple(prefixes)) or c.endswith(tuple(suffixes))) and c not in without)


def to_front(df: DataFrame, *first: str) -> DataFrame:
    return df.select(*first, *[c for c in df.columns if c not in first])


def fill_median(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """NULLs of the columns replaced by the exact median of the column."""
    from loam.operators.ranked import quantiles

    for c in columns:
        median = quantiles(df, c, [0.5])[0]
        if median is not None:
            df = df.withColumn(c, F.coalesce(F.col(c), F.lit(median)))
    return df


def constraint_report(df: DataFrame, unique: Sequence[str] = (), not_null: Sequence[str] = (), between: dict[str, tuple[float, float]] | None = None) -> DataFrame:
    """``(constraint, violations)``: repeated rows of the key, NULLs, values out of bounds; one pass for the row checks."""
    spark = df.sparkSession
    checks = {f"not_null({c})": F.count_if(F.col(c).isNull()) for c in not_null}
    checks |= {f"between({c})": F.count_if(~F.col(c).between(*v)) for c, v in (between or {}).items()}
    rows = []
    if checks:
        got = df.agg(*[v.alias(k) for k, v in checks.items()]).first()
        rows += [(k, int(got[k])) for k in checks]
    if unique:
        n = df.groupBy(*unique).count().agg(F.coalesce(F.sum(F.col("count") - 1), F.lit(0))).first()[0]
        rows.append((f"unique({','.join(unique)})", int(n)))
    return spark.createDataFrame(rows, "constraint string, violations bigint")


def require(df: DataFrame, **constraints) -> DataFrame:
    """``df`` itself if it keeps all constraints of ``constraint_report``; else ValueError naming those it breaks."""
    broken = {r["constraint"]: r["violations"] for r in constraint_report(df, **constraints).collect() if r["violations"]}
    if broken:
        raise ValueError(f"constraints broken: {broken}")
    return df
