"""Clusters of near records by parallel pivot correlation clustering."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loam.functions.geo import EARTH_RADIUS, box_distance_bounds, great_circle
from loam.operators.components import connected_components
from loam.operators.dualtree import positions_within
from loam.operators.lineage import cut

#: Side of a spot as a part of the radius: records of a spot count as one item, so an item has a bounded number of neighbours.
SPOT = 1 / 10
#: Similar pairs of items one task may settle (exactly as the rounds would); above it, rounds run on the cluster.
LOCAL_PAIRS = 1_500_000


def _spot(lat: Column, lon: Column, radius: float) -> Column:
    side = float(np.degrees(radius / EARTH_RADIUS)) * SPOT
    return F.floor((lat + 90) / side) * (1 << 32) + F.floor((lon + 180) / side)


def absorbed_nodes(a: np.ndarray, b: np.ndarray, ha: np.ndarray, hb: np.ndarray) -> np.ndarray:
    """Nodes that are not pivots: in rounds, nodes whose (hash, id) is least among their active neighbours become pivots and absorb these."""
    ids, inv = np.unique(np.concatenate([a, b]), return_inverse=True)
    u, v = inv[: len(a)], inv[len(a) :]
    h = np.zeros(len(ids), dtype=np.int64)
    h[u], h[v] = ha, hb
    rank = np.empty(len(ids), dtype=np.int64)
    rank[np.lexsort((ids, h))] = np.arange(len(ids))
    gone = np.zeros(len(ids), dtype=bool)
    out = np.zeros(len(ids), dtype=bool)
    while len(u):
        low = np.full(len(ids), len(ids), dtype=np.int64)
        np.minimum.at(low, u, rank[v])
        np.minimum.at(low, v, rank[u])
        pivot = np.zeros(len(ids), dtype=bool)
        live = np.unique(np.concatenate([u, v]))
        pivot[live] = rank[live] < low[live]
        hit = np.concatenate([u[pivot[v]], v[pivot[u]]])
        out[hit] = True
        gone |= pivot
        gone[hit] = True
        keep = ~(gone[u] | gone[v])
        u, v = u[keep], v[keep]
    return ids[out]


def _absorb(pairs: DataFrame, local_pairs: int, max_rounds: int) -> DataFrame:
    """``(a)``: the nodes of similar pairs ``(a, b, ha, hb)``, each pair once, that some pivot absorbs."""

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts = [x for x in batches if len(x)]
        if parts:
            e = pd.concat(parts)
            yield pd.DataFrame({"a": absorbed_nodes(*(e[c].to_numpy() for c in ("a", "b", "ha", "hb")))})

    done = []
    for _ in range(max_rounds):
        if pairs.count() <= local_pairs:
            done.append(pairs.coalesce(1).mapInPandas(solve, "a bigint"))
            break
        both = pairs.select("a", "b", "ha", "hb").union(pairs.select("b", "a", "hb", "ha"))
        low = both.groupBy("a", "ha").agg(F.min(F.struct("hb", "b")).alias("m"))
        pivots = low.where(F.struct(F.col("ha").alias("hb"), F.col("a").alias("b")) < F.col("m")).select(F.col("a").alias("p"))
        taken = cut(both.join(pivots, both["b"] == pivots["p"], "left_semi").select("a").distinct())
        done.append(taken)
        gone = taken.union(pivots.select(F.col("p").alias("a")))
        pairs = cut(pairs.join(gone, "a", "left_anti").join(gone.select(F.col("a").alias("b")), "b", "left_anti").select("a", "b", "ha", "hb"))
    else:
        raise RuntimeError(f"pivots did not settle in {max_rounds} rounds")
    out = done[0]
    for d in done[1:]:
        out = out.union(d)
    return out


def similar_spots(records: DataFrame, radius: float, seed: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows with their spot; spots with box, representative position and weight; pairs of spots whose points may be nearer than ``radius``."""
    rows = records.withColumn("spot", _spot(F.col("lat"), F.col("lon"), radius))
    spots = cut(rows.groupBy("spot").agg(
        F.count("*").alias("n"), F.min(F.struct("lat", "lon")).alias("rep"), F.min("lat").alias("s"), F.max("lat").alias("nn"), F.min("lon").alias("w"), F.max("lon").alias("e"),
        F.sum("lat").alias("slat"), F.sum("lon").alias("slon"),
    ).withColumn("h", F.conv(F.substring(F.md5(F.concat_ws("|", F.col("spot").cast("string"), F.lit(str(seed)))), 1, 15), 16, 10).cast("bigint")))
    reps = spots.select(F.col("rep.lat").alias("lat"), F.col("rep.lon").alias("lon"))
    # representatives of spots with points nearer than the radius are at most two diagonals further apart
    near = positions_within(reps, reps, radius * (1 + 2.9 * SPOT))
    near = near.select(_spot(F.col("l_lat"), F.col("l_lon"), radius).alias("a"), _spot(F.col("r_lat"), F.col("r_lon"), radius).alias("b"), F.col("distance_m").alias("d")).where("a < b")
    return rows, spots, cut(near)


def pivot_clusters(records: DataFrame, key: str, lat: str, lon: str, radius: float, typical: int = 3, seed: int = 0, local_pairs: int = LOCAL_PAIRS, max_rounds: int = 60) -> dict[str, DataFrame]:
    """Divides records into clusters of mutually near ones.

    Method: records of one spot (a square of a tenth of ``radius``) are one item, placed at its smallest position. Items
    nearer than ``radius`` are similar. Parallel pivot correlation clustering: in rounds, items whose hash is least among their
    active similar items become pivots and absorb these; then every absorbed item moves to its nearest pivot, and the medoid of each
    cluster, the spot nearest to its centre of mass, is computed anew. Every member is similar to the pivot of its cluster.

    Returns ``members``: (key, lat, lon, spot, cluster), one row per record with possible coordinates; ``clusters``: (cluster,
    size, medoid_lat, medoid_lon, typical), where ``typical`` holds the keys of the up to ``typical`` records nearest to the medoid;
    ``spots`` and ``near``: items and pairs of items that may have points nearer than ``radius``, for checks that follow. The cluster
    is named by the number of its pivot's spot. Rows with NULL or impossible coordinates belong nowhere and do not come out; NULL keys
    are clustered too; repeated rows count repeatedly. However many records share a place, only aggregates of it are joined.
    """
    base = records.select(F.col(key).alias("key"), (F.col(lat).cast("double") + 0.0).alias("lat"), (F.col(lon).cast("double") + 0.0).alias("lon")).where("lat between -90 and 90 and lon between -180 and 180")
    rows, spots, near = similar_spots(base, radius, seed)
    h = spots.select("spot", "h")
    similar = near.where(F.col("d") < radius).join(h.withColumnsRenamed({"spot": "a", "h": "ha"}), "a").join(h.withColumnsRenamed({"spot": "b", "h": "hb"}), "b").select("a", "b", "ha", "hb", "d")
    similar = cut(similar)
    taken = cut(_absorb(similar.drop("d"), local_pairs, max_rounds))
    pivots = h.join(taken, h["spot"] == taken["a"], "left_anti").select(F.col("spot").alias("p"))
    both = similar.select("a", "b", "hb", "d").union(similar.select("b", "a", "ha", "d"))
    moved = both.join(pivots, both["b"] == pivots["p"]).join(taken.withColumnRenamed("a", "t"), both["a"] == F.col("t"), "left_semi").groupBy("a").agg(F.min(F.struct("d", "hb", "b"))["b"].alias("cluster"))
    cluster_of = cut(moved.select(F.col("a").alias("spot"), "cluster").unionByName(pivots.select(F.col("p").alias("spot"), F.col("p").alias("cluster"))))
    placed = spots.join(cluster_of, "spot")
    centre = placed.groupBy("cluster").agg(F.sum("n").alias("size"), (F.sum("slat") / F.sum("n")).alias("clat"), (F.sum("slon") / F.sum("n")).alias("clon"))
    off = great_circle(F.col("rep.lat"), F.col("rep.lon"), F.col("clat"), F.col("clon"))
    medoid = placed.join(centre, "cluster").groupBy("cluster", "size").agg(F.min(F.struct(off.alias("off"), "rep"))["rep"].alias("m")).select("cluster", "size", F.col("m.lat").alias("medoid_lat"), F.col("m.lon").alias("medoid_lon"))
    members = rows.join(cluster_of, "spot").select("key", "lat", "lon", "spot", "cluster")
    w = Window.partitionBy("cluster").orderBy("off", "key")
    best = members.join(medoid, "cluster").select("cluster", "key", great_circle(F.col("lat"), F.col("lon"), F.col("medoid_lat"), F.col("medoid_lon")).alias("off")).where("key is not null")
    best = best.groupBy("cluster", "key").agg(F.min("off").alias("off")).withColumn("r", F.row_number().over(w)).where(F.col("r") <= typical)
    best = best.groupBy("cluster").agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "key"))), lambda x: x["key"]).alias("typical"))
    return {"members": members, "clusters": medoid.join(best, "cluster", "left"), "spots": spots, "near": near}


def linked_groups(found: dict[str, DataFrame], radius: float, least: int) -> DataFrame:
    """``(key, cluster_key)``: keys joined by records nearer than ``radius``, directly or through others, in groups of at least ``least`` keys.

    An exact check after ``pivot_clusters``: clusters are joined where items of two are similar or one key has records in two;
    the pairs of items still apart whose boxes may hold nearer points are settled on the points themselves.
    """
    members, spots, near = found["members"], found["spots"], found["near"]
    owner = cut(members.where("key is not null").select("key", "spot", "cluster").distinct())
    of = cut(members.select("spot", "cluster").distinct())

    def clusters_of(pairs: DataFrame, of: DataFrame) -> DataFrame:
        return pairs.join(of.withColumnsRenamed({"spot": "a", "cluster": "x"}), "a").join(of.withColumnsRenamed({"spot": "b", "cluster": "y"}), "b").where("x <> y")

    twice = owner.groupBy("key").agg(F.min("cluster").alias("x"), F.max("cluster").alias("hi")).where("x <> hi").select("key", "x")
    edges = clusters_of(near.where(F.col("d") < radius), of).select("x", "y").union(owner.join(twice, "key").where("cluster <> x").select("x", F.col("cluster").alias("y"))).distinct()

    def renamed(of: DataFrame, edges: DataFrame) -> DataFrame:
        groups = connected_components(edges, "x", "y")
        return of.join(groups, of["cluster"] == groups["node"], "left").select("spot", F.coalesce("component", "cluster").alias("cluster"))

    of = cut(renamed(of, edges))
    box = spots.select("spot", "s", "nn", "w", "e")
    open_ = clusters_of(near.where(F.col("d") >= radius), of).join(box.select(*[F.col(c).alias("a" + c) for c in box.columns]), F.col("a") == F.col("aspot")).join(box.select(*[F.col(c).alias("b" + c) for c in box.columns]), F.col("b") == F.col("bspot"))
    least_, _ = box_distance_bounds(tuple(F.col("a" + c) for c in ("s", "nn", "w", "e")), tuple(F.col("b" + c) for c in ("s", "nn", "w", "e")))
    open_ = open_.where(least_ < radius).select("a", "b", "x", "y")
    places = members.select("spot", "lat", "lon").distinct()
    hits = open_.join(places.select(F.col("spot").alias("a"), F.col("lat").alias("la"), F.col("lon").alias("oa")), "a").join(places.select(F.col("spot").alias("b"), F.col("lat").alias("lb"), F.col("lon").alias("ob")), "b")
    hits = hits.where(great_circle(F.col("la"), F.col("oa"), F.col("lb"), F.col("ob")) < radius).select("x", "y").distinct()
    of = renamed(of, hits)
    keys = cut(owner.drop("cluster").join(of, "spot").select("key", "cluster").distinct())
    groups = keys.groupBy("cluster").agg(F.count("*").alias("n"), F.min("key").alias("cluster_key")).where(F.col("n") >= least)
    return keys.join(groups, "cluster").select("key", "cluster_key")
