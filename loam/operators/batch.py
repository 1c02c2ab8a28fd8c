"""A batch of places to visit: the best, a spread of the uncertain, and an exploring sample of the rest."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loam.functions.expr import hash_unit
from loam.operators.allocate import allocate_capped
from loam.operators.lineage import cut
from loam.operators.ranked import grouped_median, quantiles, value_at_rank
from loam.operators.spatial import farthest_points, spaced_sample

#: Rank of the score that is the threshold; cells of each kind; width of the band around the threshold; least distances of the spread and of the sample.
RANK, EXPLOIT, UNSURE, EXPLORE, BAND, SPREAD, SPACING = 500, 250, 150, 100, 0.1, 15_000.0, 8_000.0


def field_batch(work: DataFrame, ident: str, region: str, seed: int = 7) -> DataFrame:
    """``(ident, category)`` of a batch from ``work``: (ident, x, y, region, score, gap, label, effort), one row per cell.

    ``exploit``: the ``EXPLOIT`` best unlabelled cells, without those above the threshold (the ``RANK``-th score) whose ``gap`` is in its
    top tenth, which need a second look. ``uncertainty``: of the others within ``BAND`` of the threshold, cells spread as
    widely as greedy choice can, from the one nearest to it, at least ``SPREAD`` apart. ``exploration``: ``EXPLORE`` places shared among
    regions by the inverse of their median effort, 1 to 12 each, filled with cells below the band in random order weighted against
    effort, at least ``SPACING`` apart. Fewer rows than ``RANK``: every score counts as above the threshold. Ties go by ident. The limits
    are the batch's own size; every row takes part.
    """
    t = value_at_rank(work, "score", RANK)
    (q,) = quantiles(work, "gap", [0.9])
    if t is None or q is None:
        t = work.agg(F.min("score")).first()[0]
    if t is None:
        return work.select(ident, F.lit("exploit").alias("category")).where("false")
    free = work.where((F.col("label") == 0) & ~((F.col("score") >= t) & (F.col("gap") > q)))
    exploit = cut(free.orderBy(F.desc("score"), F.asc(ident)).limit(EXPLOIT).select(ident))
    pool = cut(free.join(exploit, ident, "left_anti").withColumn("off", F.abs(F.col("score") - t)).where(F.col("off") <= BAND))
    first = pool.agg(F.min(F.struct("off", ident))[ident].alias("seed"), F.min("score").alias("low")).first()
    unsure = farthest_points(pool, ident, UNSURE, seed_id=first["seed"], least=SPREAD).select(ident) if first["seed"] is not None else exploit.where("false")
    low = work.where((F.col("label") == 0) & (F.col("score") < F.lit(first["low"])) & F.col(region).isNotNull()).join(exploit.union(unsure), ident, "left_anti")
    effort = grouped_median(work.join(low.select(region).distinct(), region, "left_semi"), [region], "effort", "m")
    places = allocate_capped({r[region]: 1.0 / (r["m"] + 5.0) for r in effort.collect()}, EXPLORE)
    spaced = spaced_sample(low, ident, SPACING, -F.log(hash_unit(seed, F.col(ident))) * (F.col("effort") + 1), within=[region], most=max(places.values(), default=1))
    # places of a region: at most the number of regions
    share = work.sparkSession.createDataFrame(sorted(places.items()), f"{region} string, _n int")
    explore = spaced.withColumn("_o", F.struct((-F.log(hash_unit(seed, F.col(ident))) * (F.col("effort") + 1)).alias("o"), F.col(ident).alias("i"))).select(ident, region, "_o")
    packed = explore.groupBy(region).agg(F.array_sort(F.collect_list("_o")).alias("_all")).join(share, region).select(F.explode(F.slice("_all", 1, F.col("_n"))).alias("e")).select(F.col("e.i").alias(ident))
    out = exploit.withColumn("category", F.lit("exploit")).unionByName(unsure.withColumn("category", F.lit("uncertainty")))
    return out.unionByName(packed.withColumn("category", F.lit("exploration")))
