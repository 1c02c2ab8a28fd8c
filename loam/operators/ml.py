"""Positive-unlabelled learning on pyspark.ml: folds, weights, calibration constant, baselines, importance, ablation."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loam.functions.expr import hash_unit, order_hash
from loam.operators.lineage import cut
from loam.operators.metrics import ranking_metrics
from loam.operators.ranked import grouped_median


def group_folds(df: DataFrame, group: Column, folds: int, seed: int, name: str = "fold") -> DataFrame:
    """Fold by the hash of a group: rows of one group are never apart. No shuffle."""
    return df.withColumn(name, F.floor(hash_unit(seed, group) * folds).cast("int"))


def stratified_folds(df: DataFrame, label: str, key: str, folds: int, seed: int, name: str = "fold") -> DataFrame:
    """Fold by the hash of the key within each label value; shares of labels are equal up to chance. No shuffle, no rank over a class."""
    return df.withColumn(name, F.floor(hash_unit(seed, F.col(label), F.col(key)) * folds).cast("int"))


def singleton_group(group: Column, key: Column, label: Column) -> Column:
    """A group key in which rows without a group are groups of their own, named by label."""
    return F.coalesce(group.cast("string"), F.concat(F.when(label.cast("boolean"), "pos_").otherwise("bg_"), key.cast("string")))


def medians(df: DataFrame, columns: Sequence[str]) -> dict[str, float]:
    """Exact medians; 0 for a column without values. All columns in one pass: values are counted by (column, value) and numbered by one running sum."""
    each = F.explode(F.array(*[F.struct(F.lit(i).alias("f"), F.col(c).cast("double").alias("v")) for i, c in enumerate(columns)]))
    values = df.select(each.alias("s")).select("s.f", "s.v")
    got = {r["f"]: r["median"] for r in grouped_median(values, ["f"], "v").collect()}
    return {c: got.get(i, 0.0) for i, c in enumerate(columns)}


def impute(df: DataFrame, fill: dict[str, float]) -> DataFrame:
    """Missing (NULL or NaN) values of the columns replaced: fit on train with ``medians``, applied anywhere."""
    return df.withColumns({c: F.when(F.col(c).isNull() | F.isnan(F.col(c).cast("double")), F.lit(v)).otherwise(F.col(c).cast("double")) for c, v in fill.items()})


def class_weight(df: DataFrame, label: str) -> float:
    """Weight of a positive: background rows per positive row."""
    r = df.agg(F.count_if(F.col(label) == 1).alias("p"), F.count_if(F.col(label) == 0).alias("b")).first()
    return r["b"] / r["p"] if r["p"] else 1.0


def fit(train: DataFrame, features: Sequence[str], label: str = "y", model: str = "gbt", seed: int = 42, trees: int = 20, depth: int = 4) -> tuple[PipelineModel, dict[str, float]]:
    """A boosted-tree or standardised logistic model of ``label`` with positives weighted up, and the medians it was imputed with."""
    fill = medians(train, features)
    w = class_weight(train, label)
    data = impute(train, fill).withColumn("_w", F.when(F.col(label) == 1, w).otherwise(1.0)).withColumn(label, F.col(label).cast("double"))
    stages = [VectorAssembler(inputCols=list(features), outputCol="_raw")]
    if model == "gbt":
        stages.append(GBTClassifier(featuresCol="_raw", labelCol=label, weightCol="_w", maxIter=trees, maxDepth=depth, subsamplingRate=0.8, seed=seed))
    else:
        stages += [StandardScaler(inputCol="_raw", outputCol="_std", withMean=True), LogisticRegression(featuresCol="_std", labelCol=label, weightCol="_w", maxIter=60)]
    return Pipeline(stages=stages).fit(data), fill


def score(model: tuple[PipelineModel, dict[str, float]], df: DataFrame, name: str = "score") -> DataFrame:
    """``df`` with the probability of the positive class."""
    pipeline, fill = model
    filled = df.select("*", *[F.col(c).alias(f"_keep_{c}") for c in fill])
    out = pipeline.transform(impute(filled, fill)).withColumn(name, vector_to_array("probability")[1])
    return out.select(*[F.col(f"_keep_{c}").alias(c) if c in fill else F.col(c) for c in df.columns], name)


def out_of_fold(df: DataFrame, features: Sequence[str], label: str, fold: str, folds: int, **how) -> DataFrame:
    """Scores of every row by a model that did not see its fold."""
    every = None
    for k in range(folds):
        part = score(fit(df.where(F.col(fold) != k), features, label, **how), df.where(F.col(fold) == k))
        every = part if every is None else every.unionByName(part)
    return cut(every)


def elkan_noto(scored: DataFrame, label: str, name: str = "score") -> float:
    """Mean out-of-fold score of labelled positives, at least 0.001: the share of positives that are labelled (Elkan and Noto, 2008)."""
    c = scored.where(F.col(label) == 1).agg(F.avg(name)).first()[0]
    return max(c or 0.0, 1e-3)


def rescale(c: Column, constant: float) -> Column:
    return F.least(c / constant, F.lit(1.0))


def permutation_importance(model, df: DataFrame, features: Sequence[str], key: str, label: str = "y", repeats: int = 2, seed: int = 0) -> DataFrame:
    """``(feature, drop_mean, drop_std)``: loss of average precision when a feature's values are dealt out anew.

    Values are dealt by joining two hash orders on their rank, numbered by running sums, so no task sees the whole column; all repeats
    are dealt at once, and all of a feature scored at once. ``key`` must be unique; rows without a label are dealt but do not count.
    """
    from loam.operators.ranked import running_sums

    base = ranking_metrics(score(model, df), "score", F.col(label)).first()
    reps = df.select(key, *features).withColumn("_r", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))))
    order = lambda s: F.md5(F.concat_ws("|", F.col(key).cast("string"), (F.col("_r") + s).cast("string")))  # noqa: E731 as order_hash, a seed per repeat
    # every repeat has as many rows, so ranks over all of them meet within a repeat
    a = running_sums(reps.select("_r", key, order(seed).alias("_o")), [F.asc("_r"), F.asc("_o"), F.asc(key)], {"_n": F.lit(1)}).select("_r", key, "_n")
    b = running_sums(reps.select("_r", F.col(key).alias("_k"), *[F.col(f).alias(f"_new{i}") for i, f in enumerate(features)], order(seed + 1000).alias("_o")), [F.asc("_r"), F.asc("_o"), F.asc("_k")], {"_n": F.lit(1)}).drop("_r", "_k", "_o")
    dealt = cut(df.select(key, label, *features).join(a, key).join(b, "_n").drop("_n"))
    rows = []
    for i, f in enumerate(features):
        got = score(model, dealt.withColumn(f, F.col(f"_new{i}")).select("_r", label, *features)).where(F.col(label).isNotNull())
        counts = got.groupBy("_r", "score").agg(F.count("*").alias("n"), F.sum(F.col(label).cast("int")).alias("pos"))
        run = running_sums(counts, [F.asc("_r"), F.desc("score")], {"upto": F.col("n"), "tp": F.col("pos")})
        steps = F.col("pos") * (F.col("tp") - F.col("_r") * base["n_pos"]) / (F.col("upto") - F.col("_r") * base["n"])
        drops = [base["ap"] - r["s"] / base["n_pos"] for r in run.groupBy("_r").agg(F.sum(steps).alias("s")).collect()]
        rows.append((f, float(np.mean(drops)), float(np.std(drops))))
    return df.sparkSession.createDataFrame(rows, "feature string, drop_mean double, drop_std double")


def ablation(train: DataFrame, test: DataFrame, subsets: dict[str, Sequence[str]], label: str = "y", **how) -> DataFrame:
    """``(subset, n_features, n, n_pos, auc, ap)`` of a model per feature subset."""
    rows = []
    for name, features in subsets.items():
        m = ranking_metrics(score(fit(train, features, label, **how), test), "score", F.col(label)).first()
        rows.append((name, len(features), m["n"], m["n_pos"], m["auc"], m["ap"]))
    return train.sparkSession.createDataFrame(rows, "subset string, n_features int, n bigint, n_pos bigint, auc double, ap double")


def mean_covariance(df: DataFrame, columns: Sequence[str]) -> tuple[np.ndarray, np.ndarray, int]:
    """Mean vector, sample covariance matrix and number of rows without NULL: one aggregate of sums, solved on the driver."""
    clean = df.dropna(subset=list(columns))
    aggs = [F.avg(c).alias(f"m{i}") for i, c in enumerate(columns)] + [F.covar_samp(a, b).alias(f"c{i}_{j}") for i, a in enumerate(columns) for j, b in enumerate(columns) if j >= i]
    r = clean.agg(F.count("*").alias("n"), *aggs).first()
    k = len(columns)
    cov = np.array([[r[f"c{min(i, j)}_{max(i, j)}"] or 0.0 for j in range(k)] for i in range(k)])
    return np.array([r[f"m{i}"] or 0.0 for i in range(k)]), cov, r["n"]


def mahalanobis(df: DataFrame, columns: Sequence[str], reference: DataFrame | None = None, ridge: float = 1e-6, name: str = "mahalanobis") -> DataFrame:
    """``df`` with the distance of its columns from the reference's mean in its covariance, plus ``ridge`` on the diagonal: a column expression with constant coefficients. NULL inputs give NULL."""
    mean, cov, _ = mean_covariance(reference if reference is not None else df, columns)
    inv = np.linalg.inv(cov + ridge * np.eye(len(columns)))
    d = [F.col(c) - float(m) for c, m in zip(columns, mean)]
    total = F.lit(0.0)
    for i in range(len(columns)):
        for j in range(i, len(columns)):
            total = total + d[i] * d[j] * float(inv[i, j] * (1 if i == j else 2))
    return df.withColumn(name, F.sqrt(F.greatest(total, F.lit(0.0))))


def standardise(df: DataFrame, columns: Sequence[str], prefix: str = "z_") -> DataFrame:
    """Columns centred and divided by their population deviation; a constant column becomes 0."""
    r = df.agg(*[x for i, c in enumerate(columns) for x in (F.avg(c).alias(f"m{i}"), F.stddev_pop(c).alias(f"s{i}"))]).first()
    return df.withColumns({prefix + c: (F.col(c) - F.lit(r[f"m{i}"])) / F.lit(r[f"s{i}"] or 1.0) for i, c in enumerate(columns)})


def minmax(df: DataFrame, columns: Sequence[str], suffix: str = "01") -> DataFrame:
    """Columns scaled to [0, 1]; a constant column becomes 0. One aggregate, then constants of the plan."""
    r = df.agg(*[x for i, c in enumerate(columns) for x in (F.min(c).alias(f"a{i}"), F.max(c).alias(f"b{i}"))]).first()
    out = {}
    for i, c in enumerate(columns):
        lo, hi = r[f"a{i}"], r[f"b{i}"]
        out[c + suffix] = F.when(F.col(c).isNotNull(), (F.col(c) - lo) / (hi - lo) if lo is not None and hi > lo else F.lit(0.0))
    return df.withColumns(out)


def block_split(df: DataFrame, x: str, y: str, size: float, share: float, seed: int, name: str = "is_test") -> DataFrame:
    """Whole square blocks, in hash order, are test rows until they hold ``share`` of all rows. Only counts per block are ordered."""
    from loam.operators.ranked import running_sums

    blocks = df.withColumn("_bx", F.floor(F.col(x) / size)).withColumn("_by", F.floor(F.col(y) / size))
    counts = blocks.where("_bx is not null and _by is not null").groupBy("_bx", "_by").agg(F.count("*").alias("_n")).withColumn("_o", order_hash(seed, F.col("_bx"), F.col("_by")))
    run = running_sums(counts, [F.asc("_o"), F.asc("_bx"), F.asc("_by")], {"_upto": F.col("_n")})
    total = run.agg(F.max("_upto")).first()[0] or 0
    test = run.where(F.col("_upto") - F.col("_n") < share * total).select("_bx", "_by", F.lit(True).alias(name))
    return blocks.join(test, ["_bx", "_by"], "left").withColumn(name, F.coalesce(name, F.lit(False))).drop("_bx", "_by")


def folds_disjoint(df: DataFrame, group: str, fold: str) -> bool:
    return df.where(F.col(group).isNotNull()).groupBy(group).agg(F.count_distinct(fold).alias("n")).where("n > 1").isEmpty()


