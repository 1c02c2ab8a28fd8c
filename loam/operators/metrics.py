"""Ranking and calibration metrics from distinct scores, exact with ties, without a global window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loam.functions.tails import chi2_tail, correlation_tail
from loam.operators.ranked import average_ranks, grouped_runs, quantile_bins, running_sums, value_counts


def score_curve(df: DataFrame, score: str, label: Column) -> DataFrame:
    """Per distinct score, highest first: rows ``n`` and positives ``pos`` with it, ``upto`` and ``tp`` down to it. NULL and NaN scores are left out."""
    counts = value_counts(df.withColumn("_y", label.cast("int")).where("_y is not null"), score, {"pos": F.col("_y")})
    return running_sums(counts, [F.desc(score)], {"upto": F.col("n"), "tp": F.col("pos")})


def ranking_metrics(df: DataFrame, score: str, label: Column) -> DataFrame:
    """One row ``(n, n_pos, auc, ap)``: area under the ROC curve by average ranks, average precision as the step sum over distinct scores; NULL without both classes (ap: without positives)."""
    c = score_curve(df, score, label)
    s = c.agg(
        F.sum("n").alias("n"), F.sum("pos").alias("n_pos"),
        # a positive beats the negatives below it and half of those equal to it
        F.sum((F.col("n") - F.col("pos")) * (F.col("tp") - F.col("pos") / 2)).alias("wins"),
        F.sum(F.col("pos") * F.col("tp") / F.col("upto")).alias("steps"),
    )
    neg = F.col("n") - F.col("n_pos")
    return s.select(F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("n_pos", F.lit(0)).alias("n_pos"), F.try_divide("wins", F.nullif(F.col("n_pos") * neg, F.lit(0))).alias("auc"), F.try_divide("steps", F.nullif("n_pos", F.lit(0))).alias("ap"))


def grouped_metrics(df: DataFrame, groups: list[str], score: str, label: Column, least: int = 2) -> DataFrame:
    """``groups + (n, n_pos, auc, ap)``: the same per group, over distinct scores of each, by running sums with the groups in front, so a hot group is many tasks; NULL metrics where a group has fewer than ``least`` positives or no negative."""
    c = df.withColumn("_y", label.cast("int")).where(F.col("_y").isNotNull() & F.col(score).isNotNull() & ~F.isnan(F.col(score).cast("double"))).groupBy(*groups, score).agg(F.count("*").alias("n"), F.sum("_y").alias("pos"))
    c = grouped_runs(c, groups, [F.desc(score)], {"upto": F.col("n"), "tp": F.col("pos")})
    s = c.groupBy(*groups).agg(F.sum("n").alias("n"), F.sum("pos").alias("n_pos"), F.sum((F.col("n") - F.col("pos")) * (F.col("tp") - F.col("pos") / 2)).alias("w"), F.sum(F.col("pos") * F.col("tp") / F.col("upto")).alias("s"))
    ok = (F.col("n_pos") >= least) & (F.col("n_pos") < F.col("n"))
    return s.select(*groups, "n", "n_pos", F.when(ok, F.col("w") / (F.col("n_pos") * (F.col("n") - F.col("n_pos")))).alias("auc"), F.when(ok, F.col("s") / F.col("n_pos")).alias("ap"))


def log_loss(score: Column, label: Column, eps: float = 1e-7) -> Column:
    """Aggregate: mean logistic loss of clipped probabilities."""
    p = F.greatest(F.least(score, F.lit(1 - eps)), F.lit(eps))
    return F.avg(F.when(label, -F.log(p)).otherwise(-F.log(1 - p)))


def at_k(df: DataFrame, score: str, label: Column, tie: str, ks: list[int]) -> DataFrame:
    """``(k, precision, recall, enrichment)``: the k best rows, ties by smaller ``tie``. One top-k sort for the largest k, never a full one; its labels are counted by rank."""
    y = label.cast("int")
    clean = df.where(F.col(score).isNotNull() & ~F.isnan(F.col(score).cast("double")) & y.isNotNull())
    base = clean.agg(F.count("*").alias("n"), F.sum(y).alias("pos")).first()
    best = [r[0] for r in clean.orderBy(F.desc(score), F.asc(tie)).limit(max(ks)).select(y).collect()]
    rows = []
    for k in ks:
        pos, n = sum(best[:k]), len(best[:k])
        p = pos / n if n else None
        rows.append((k, p, pos / base["pos"] if base["pos"] else None, p / (base["pos"] / base["n"]) if n and base["pos"] else None))
    return df.sparkSession.createDataFrame(rows, "k int, precision double, recall double, enrichment double")


def reliability(df: DataFrame, score: str, label: Column, bins: int = 10) -> DataFrame:
    """``(bin, n, predicted, observed, gap)`` per quantile bin of the score; a positive gap is over-confidence."""
    b, _ = quantile_bins(df, score, bins)
    return b.where("bin is not null").groupBy("bin").agg(F.count("*").alias("n"), F.avg(score).alias("predicted"), F.avg(label.cast("double")).alias("observed")).withColumn("gap", F.col("predicted") - F.col("observed"))


def spearman(df: DataFrame, a: str, b: str) -> DataFrame:
    """One row ``(n, rho, p)``: correlation of average ranks over rows with both values; ``p`` two-sided by Student's t with n - 2 degrees, NULL below 3 rows or without rho."""
    both = df.where(F.col(a).isNotNull() & F.col(b).isNotNull() & ~F.isnan(F.col(a).cast("double")) & ~F.isnan(F.col(b).cast("double"))).select(F.col(a).alias("a"), F.col(b).alias("b"))
    pairs = both.groupBy("a", "b").agg(F.count("*").alias("n"))
    ra, rb = average_ranks(both, "a", "ra").select("a", "ra"), average_ranks(both, "b", "rb").select("b", "rb")
    r = pairs.join(ra, "a").join(rb, "b")
    n, x, y = F.sum("n"), F.sum(F.col("n") * F.col("ra")), F.sum(F.col("n") * F.col("rb"))
    s = r.agg(n.alias("n"), (x / n).alias("ma"), (y / n).alias("mb")).first()
    if not s["n"]:
        return df.sparkSession.createDataFrame([(0, None, None)], "n bigint, rho double, p double")
    da, db = F.col("ra") - s["ma"], F.col("rb") - s["mb"]
    got = r.agg(F.sum("n").alias("n"), F.try_divide(F.sum(F.col("n") * da * db), F.sqrt(F.sum(F.col("n") * da * da) * F.sum(F.col("n") * db * db))).alias("rho")).first()
    return df.sparkSession.createDataFrame([(got["n"], got["rho"], correlation_tail(got["rho"], got["n"]))], "n bigint, rho double, p double")


def kruskal(df: DataFrame, value: str, group: str) -> DataFrame:
    """One row ``(k, n, h, p)``: Kruskal-Wallis with tie correction; ``p`` is the chi-square tail with k - 1 degrees, NULL without h."""
    clean = df.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")) & F.col(group).isNotNull())
    ranks = average_ranks(clean, value, "r")
    cells = clean.groupBy(value, group).agg(F.count("*").alias("m"))
    per = cells.join(ranks.select(value, "r"), value).groupBy(group).agg(F.sum("m").alias("m"), F.sum(F.col("m") * F.col("r")).alias("s"))
    one = per.agg(F.count("*").alias("k"), F.sum("m").alias("n"), F.sum(F.col("s") * F.col("s") / F.col("m")).alias("q")).first()
    ties = ranks.agg(F.sum(F.pow(F.col("n").cast("double"), 3) - F.col("n"))).first()[0] or 0.0
    n, k, h = one["n"] or 0, one["k"], None
    if k > 1 and n > 1 and n**3 - n > ties:
        h = (12 / (n * (n + 1)) * one["q"] - 3 * (n + 1)) / (1 - ties / (n**3 - n))
    return df.sparkSession.createDataFrame([(k, n, h, chi2_tail(h, k - 1) if h is not None else None)], "k bigint, n bigint, h double, p double")
