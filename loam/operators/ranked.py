"""Global order statistics without a global window: running sums, ranks, quantiles over range-partitioned data."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loam.operators.lineage import cut


def running_sums(df: DataFrame, order: Sequence[Column], sums: dict[str, Column], parts: int | None = None) -> DataFrame:
    """``df`` with, for each entry of ``sums``, the sum of the expression over all rows up to and with this one in a total ``order``.

    A window without partitions would move everything into one task. Here rows are range-partitioned by the order, each partition
    is summed, and the sums of the partitions before are added: one shuffle, and one small row per partition on the driver.
    """
    spark = df.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = cut(df.select("*", *[e.alias(f"_v_{k}") for k, e in sums.items()]).repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id()))
    kinds = {k: "bigint" if placed.schema[f"_v_{k}"].dataType.simpleString() in ("tinyint", "smallint", "int", "bigint") else "double" for k in sums}
    run: dict[str, float] = dict.fromkeys(sums, 0)
    offsets = []
    for r in sorted(placed.groupBy("_part").agg(*[F.sum(F.col(f"_v_{k}").cast(kinds[k])).alias(k) for k in sums]).collect()):
        offsets.append((r["_part"], *[kind(run[k]) for k, kind in ((k, int if kinds[k] == "bigint" else float) for k in sums)]))
        for k in sums:
            run[k] += r[k] or 0
    before = spark.createDataFrame(offsets, "_part int, " + ", ".join(f"_b_{k} {kinds[k]}" for k in sums))
    w = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    # one row per partition: small whatever the data
    out = placed.join(F.broadcast(before), "_part")
    for k in sums:
        out = out.withColumn(k, F.col(f"_b_{k}") + F.coalesce(F.sum(F.col(f"_v_{k}").cast(kinds[k])).over(w), F.lit(0).cast(kinds[k])))
    return out.drop("_part", *[f"_{p}_{k}" for k in sums for p in "vb"])


def value_counts(df: DataFrame, column: str, extra: dict[str, Column] | None = None) -> DataFrame:
    """Distinct non-NULL, non-NaN values with their counts ``n`` (and further sums): what ranks with ties need."""
    c = F.col(column)
    clean = df.where(c.isNotNull() & ~F.isnan(c.cast("double")))
    return clean.groupBy(c.alias(column)).agg(F.count("*").alias("n"), *[F.sum(e).alias(k) for k, e in (extra or {}).items()])


def quantiles(df: DataFrame, column: str, probs: Sequence[float]) -> list[float | None]:
    """Exact quantiles with linear interpolation; None for an empty column. No task holds more than its range of distinct values."""
    ranked = running_sums(value_counts(df, column), [F.asc(column)], {"upto": F.col("n")})
    ranked = ranked.withColumn("v", F.col(column).cast("double"))
    total = ranked.agg(F.max("upto")).first()[0]
    if not total:
        return [None for _ in probs]
    spots = {k for p in probs for h in [p * (total - 1)] for k in (math.floor(h), math.ceil(h))}
    hit = F.lit(False)
    for k in spots:
        hit = hit | ((F.col("upto") > k) & (F.col("upto") - F.col("n") <= k))
    rows = ranked.where(hit).select("v", "n", "upto").collect()

    def at(k: int) -> float:
        return next(r["v"] for r in rows if r["upto"] - r["n"] <= k < r["upto"])

    out = []
    for p in probs:
        h = p * (total - 1)
        lo, hi = math.floor(h), math.ceil(h)
        a, b = at(lo), at(hi)
        out.append(a + (b - a) * (h - lo))
    return out


def quantile_bins(df: DataFrame, column: str, bins: int, name: str = "bin") -> tuple[DataFrame, list[float]]:
    """``df`` with the number (from 0) of the right-closed quantile bin of a value, and the edges; equal edges are one. The least value is in bin 0; NULL has none."""
    edges = quantiles(df, column, [i / bins for i in range(bins + 1)])
    cuts = sorted({e for e in edges if e is not None})
    b = F.lit(None).cast("int")
    for i in range(len(cuts) - 1, 0, -1):
        b = F.when(F.col(column) <= cuts[i], i - 1).otherwise(b)
    return df.withColumn(name, F.when(F.col(column).isNotNull() & ~F.isnan(F.col(column).cast("double")), b)), cuts


def average_ranks(df: DataFrame, column: str, rank: str) -> DataFrame:
    """``(column, n, rank)``: the mean rank from 1 of each distinct value, ties sharing it."""
    r = running_sums(value_counts(df, column), [F.asc(column)], {"upto": F.col("n")})
    return r.select(column, "n", (F.col("upto") - (F.col("n") - 1) / 2).alias(rank))


def value_at_rank(df: DataFrame, column: str, k: int) -> float | None:
    """The k-th highest value, repeats counted; None if there are fewer."""
    r = running_sums(value_counts(df, column), [F.desc(column)], {"upto": F.col("n")})
    got = r.where((F.col("upto") >= k) & (F.col("upto") - F.col("n") < k)).select(column).first()
    return got[0] if got else None


def grouped_runs(counts: DataFrame, keys: Sequence[str], order: Sequence[Column], sums: dict[str, Column]) -> DataFrame:
    """``counts`` with, for each entry of ``sums`` (never negative), its sum within the row's group up to and with the row, and ``_all_`` + its name, that of the whole group.

    One running sum over all rows, the keys leading the order; a group's sum is what it adds to where it began. So a group of any size
    is spread over many tasks. NULL keys are a group.
    """
    run = running_sums(counts, [*[F.asc(k) for k in keys], *order], {f"_run_{k}": e for k, e in sums.items()})
    own = run.withColumns({f"_own_{k}": F.coalesce(e, F.lit(0)) for k, e in sums.items()})
    ends = own.groupBy(*[F.col(k).alias(f"_g_{k}") for k in keys]).agg(*[x for k in sums for x in (F.min(F.col(f"_run_{k}") - F.col(f"_own_{k}")).alias(f"_from_{k}"), F.max(f"_run_{k}").alias(f"_to_{k}"))])
    on = F.lit(True)
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"_g_{k}"))
    out = own.join(ends, on)
    return out.select(*counts.columns, *[x for k in sums for x in ((F.col(f"_run_{k}") - F.col(f"_from_{k}")).alias(k), (F.col(f"_to_{k}") - F.col(f"_from_{k}")).alias(f"_all_{k}"))])


def grouped_median(df: DataFrame, keys: Sequence[str], column: str, name: str = "median") -> DataFrame:
    """``keys + [name]``: exact median per group. Distinct values are counted before the shuffle and numbered by a running sum with the keys in front, so a group of any size is spread over many tasks."""
    clean = df.where(F.col(column).isNotNull() & ~F.isnan(F.col(column).cast("double")))
    counts = clean.groupBy(*keys, F.col(column).cast("double").alias("_v")).agg(F.count("*").alias("_n"))
    run = grouped_runs(counts, keys, [F.asc("_v")], {"_upto": F.col("_n")})
    mid = run.where((2 * F.col("_upto") >= F.col("_all__upto")) & (2 * (F.col("_upto") - F.col("_n")) <= F.col("_all__upto")))
    # the middle row, or the mean of the two middle rows if they differ
    return mid.groupBy(*keys).agg(F.avg("_v").alias(name))
