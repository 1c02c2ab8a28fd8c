"""Connected components of an edge table."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loam.operators.lineage import cut

#: Edges that one task may finish with a union of arrays (about 100 MB); above it, rounds of stars run on the cluster.
LOCAL_EDGES = 400_000


def component_labels(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct nodes of the edges (u, v) and, for each, the smallest node of its component."""
    ids, inv = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = inv[: len(u)], inv[len(u) :]
    label = np.arange(len(ids))
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        while True:
            jump = new[new]
            if (jump == new).all():
                break
            new = jump
        if (new == label).all():
            return ids, ids[label]
        label = new


def _finish_in_one_task(edges: DataFrame) -> DataFrame:
    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts = [b for b in batches if len(b)]
        if parts:
            all_ = pd.concat(parts)
            node, component = component_labels(all_["hi"].to_numpy(), all_["lo"].to_numpy())
            yield pd.DataFrame({"node": node, "component": component})

    kind = edges.schema["hi"].dataType.simpleString()
    return edges.coalesce(1).mapInPandas(solve, f"node {kind}, component {kind}")


def _stars(edges: DataFrame, max_rounds: int) -> DataFrame:
    """Alternating large and small stars (Kiveris et al., 2014): O(log^2 n) rounds, no row holds a neighbour list."""
    before = None
    for _ in range(max_rounds):
        both = edges.select(F.col("hi").alias("u"), F.col("lo").alias("v")).union(edges.select("lo", "hi"))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).where("hi <> lo").distinct()
        low = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = large.join(low, "hi").select(F.explode(F.array(F.struct(F.col("lo").alias("hi"), F.col("m").alias("lo")), F.struct("hi", F.col("m").alias("lo")))).alias("e")).select("e.hi", "e.lo").where("hi <> lo").distinct()
        edges = cut(small)
        now = edges.agg(F.count("*"), F.sum(F.pmod(F.xxhash64("hi", "lo"), F.lit(2**40)))).first()
        if now == before:
            return edges
        before = now
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")


def connected_components(edges: DataFrame, a: str, b: str, local_edges: int = LOCAL_EDGES, max_rounds: int = 60) -> DataFrame:
    """``(node, component)`` for every node of an edge between two different nodes; component = smallest node.

    Edges with a NULL end, loops, repeats and either direction are fine; an empty table gives no rows. Nodes
    without an edge do not come out: treat them as their own component. Distinct edges beyond ``local_edges``
    are solved by rounds of stars on the cluster, fewer by one task; the result is the same.
    """
    e = edges.select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo")).where(F.col(a).isNotNull() & F.col(b).isNotNull()).where("hi <> lo").distinct()
    e = cut(e)
    if e.count() <= local_edges:
        return _finish_in_one_task(e)
    stars = _stars(e, max_rounds).select(F.col("hi").alias("node"), F.col("lo").alias("component"))
    return stars.unionByName(stars.select(F.col("component").alias("node"), "component").distinct())
