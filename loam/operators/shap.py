"""Shapley values of boosted trees, exact for path-dependent expectations, vectorised over rows."""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loam.operators.ml import impute


class Leaf(NamedTuple):
    """A leaf: its weighted value, and for each feature on its path the interval (low, high] it asks for and the share of training rows that meets it."""

    value: float
    features: tuple[int, ...]
    low: tuple[float, ...]
    high: tuple[float, ...]
    share: tuple[float, ...]


def tree_leaves(model) -> list[Leaf]:
    """All leaves of a fitted boosted-tree model with continuous features; the path of a leaf is merged by feature."""
    out: list[Leaf] = []

    def count(node) -> float:
        return float(node.impurityStats().count())

    def walk(node, weight: float, path: dict[int, tuple[float, float, float]]) -> None:
        if node.subtreeDepth() == 0:
            f = tuple(path)
            out.append(Leaf(weight * node.prediction(), f, tuple(path[i][0] for i in f), tuple(path[i][1] for i in f), tuple(path[i][2] for i in f)))
            return
        split = node.split()
        i, t = split.featureIndex(), split.threshold()
        whole = count(node)
        for child, left in ((node.leftChild(), True), (node.rightChild(), False)):
            lo, hi, share = path.get(i, (-math.inf, math.inf, 1.0))
            step = (max(lo, -math.inf if left else t), min(hi, t if left else math.inf), share * count(child) / whole)
            walk(child, weight, path | {i: step})

    for tree, w in zip(model.trees, model.treeWeights):
        walk(tree._call_java("rootNode"), float(w), {})
    return out


def shap_matrix(leaves: Sequence[Leaf], x: np.ndarray) -> tuple[np.ndarray, float]:
    """Shapley values (rows x features) of the summed trees, and their expectation: values add up to the prediction.

    Of a leaf with features F, feature i gets value * (met_i - share_i) * sum over subsets S of F without i of w(|S|) * prod met over S *
    prod share over the rest; paths are short, so subsets are few.
    """
    out, base = np.zeros(x.shape), 0.0
    for leaf in leaves:
        k = len(leaf.features)
        base += leaf.value * math.prod(leaf.share)
        if not k or leaf.value == 0:
            continue
        met = np.stack([(x[:, f] > lo) & (x[:, f] <= hi) for f, lo, hi in zip(leaf.features, leaf.low, leaf.high)]).astype(float)
        for i in range(k):
            rest = [j for j in range(k) if j != i]
            total = np.zeros(len(x))
            for size in range(k):
                w = math.factorial(size) * math.factorial(k - size - 1) / math.factorial(k)
                for s in itertools.combinations(rest, size):
                    away = math.prod(leaf.share[j] for j in rest if j not in s)
                    total += w * away * (met[list(s)].prod(0) if s else 1.0)
            out[:, leaf.features[i]] += leaf.value * (met[i] - leaf.share[i]) * total
    return out, base


def shap_values(model: tuple[PipelineModel, dict[str, float]], df: DataFrame, key: str, features: Sequence[str]) -> DataFrame:
    """``(key, shap_f..., shap_base)`` of the margin of a boosted-tree pipeline of ``ml.fit``. The trees, bounded by the model, go to the tasks; rows stay where they are."""
    pipeline, fill = model
    leaves = tree_leaves(pipeline.stages[-1])
    slim = impute(df.select(key, *features), fill)
    kind = slim.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            v, base = shap_matrix(leaves, b[list(features)].to_numpy(dtype=float))
            yield pd.DataFrame({key: b[key], **{f"shap_{f}": v[:, i] for i, f in enumerate(features)}, "shap_base": base})

    return slim.mapInPandas(run, f"{key} {kind}, " + ", ".join(f"shap_{f} double" for f in features) + ", shap_base double")


def mean_absolute(shap: DataFrame, features: Sequence[str], by: str | None = None) -> DataFrame:
    """``([by], feature, mean_abs)``: mean absolute Shapley value of each feature, overall or per value of ``by``."""
    pairs = F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.abs(f"shap_{f}").alias("v")) for f in features])).alias("e")
    long = shap.select(*([by] if by else []), pairs)
    return long.groupBy(*([by] if by else []), F.col("e.feature").alias("feature")).agg(F.avg("e.v").alias("mean_abs"))
