"""Directed graphs in which every node has at most one next node (river reaches): roots, reach, distances."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loam.operators.lineage import cut


def functional_edges(df: DataFrame, node: str, nxt: str, km: str, outlet: int = 0) -> DataFrame:
    """``(node, next, km)``; edges to the outlet mark, to NULL or from NULL are dropped. Repeated nodes keep their smallest next node."""
    e = df.select(F.col(node).alias("node"), F.col(nxt).alias("next"), F.col(km).cast("double").alias("km"))
    return e.where(F.col("next") != outlet).where("node is not null and next is not null and km is not null").groupBy("node").agg(F.min(F.struct("next", "km")).alias("e")).select("node", "e.next", "e.km")


def jumps(edges: DataFrame, max_rounds: int = 40):
    """Jump tables ``(node, next, km)`` over 1, 2, 4, ... edges, until none is left; each is one self-join of the one before."""
    table = cut(edges)
    for _ in range(max_rounds):
        if table.isEmpty():
            return
        yield table
        ahead = table.select(F.col("node").alias("next"), F.col("next").alias("n2"), F.col("km").alias("k2"))
        table = cut(table.join(ahead, "next").select("node", F.col("n2").alias("next"), (F.col("km") + F.col("k2")).alias("km")))
    raise ValueError("the graph has a cycle")


def roots(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``(node, root, km, hops)``: the last node downstream of each node and the way there; pointer doubling, log2(depth) rounds. ValueError on a cycle."""
    at = nodes.select("node").distinct().withColumn("root", F.col("node")).withColumn("km", F.lit(0.0)).withColumn("hops", F.lit(0).cast("bigint"))
    tables = list(jumps(edges))
    for i, t in reversed(list(enumerate(tables))):
        step = t.select(F.col("node").alias("root"), F.col("next").alias("n2"), F.col("km").alias("k2"))
        at = cut(at.join(step, "root", "left").select("node", F.coalesce("n2", "root").alias("root"), (F.col("km") + F.coalesce("k2", F.lit(0.0))).alias("km"), (F.col("hops") + F.when(F.col("n2").isNotNull(), 2**i).otherwise(0)).alias("hops")))
    return at


def has_cycle(edges: DataFrame) -> bool:
    n = edges.count()
    limit = max(1, n).bit_length() + 1
    try:
        for _ in jumps(edges, limit):
            pass
    except ValueError:
        return True
    return False


def downstream(sources: DataFrame, edges: DataFrame, max_km: float | None = None) -> DataFrame:
    """``(source, node, km)``: all nodes downstream of the distinct ``source`` nodes, themselves excluded, at most ``max_km`` away.

    Paths grow by doubling: everything found so far jumps on by 1, 2, 4, ... edges, so the rounds are log2 of the longest path.
    Nodes beyond ``max_km`` are dropped as soon as they are met (weights are not negative).
    """
    found = cut(sources.select(F.col("source")).where("source is not null").distinct().withColumn("node", F.col("source")).withColumn("km", F.lit(0.0)))
    for t in jumps(edges):
        step = t.select("node", "next", F.col("km").alias("k2"))
        more = found.join(step, "node").select("source", F.col("next").alias("node"), (F.col("km") + F.col("k2")).alias("km"))
        if max_km is not None:
            more = more.where(F.col("km") <= max_km)
        found = cut(found.unionByName(more))
    return found.where("source <> node")


def upstream(targets: DataFrame, edges: DataFrame, max_km: float | None = None) -> DataFrame:
    """``(source, node, km)``: the nodes upstream of each ``source``, by the same doubling against the flow."""
    found = cut(targets.select("source").where("source is not null").distinct().withColumn("node", F.col("source")).withColumn("km", F.lit(0.0)))
    for t in jumps(edges):
        step = t.select(F.col("next").alias("node"), F.col("node").alias("up"), F.col("km").alias("k2"))
        more = found.join(step, "node").select("source", F.col("up").alias("node"), (F.col("km") + F.col("k2")).alias("km"))
        if max_km is not None:
            more = more.where(F.col("km") <= max_km)
        found = cut(found.unionByName(more))
    return found.where("source <> node")


def multi_source_distance(sources: DataFrame, edges: DataFrame) -> DataFrame:
    """``(node, km)``: least downstream distance from any source to each node it reaches, sources at 0; one row per node at all times, log2 rounds."""
    best = cut(sources.select(F.col("source").alias("node")).where("node is not null").distinct().withColumn("km", F.lit(0.0)))
    for t in jumps(edges):
        step = t.select("node", "next", F.col("km").alias("k2"))
        more = best.join(step, "node").select(F.col("next").alias("node"), (F.col("km") + F.col("k2")).alias("km"))
        best = cut(best.unionByName(more).groupBy("node").agg(F.min("km").alias("km")))
    return best


def upstream_groups(members: DataFrame, group: str, edges: DataFrame, max_km: float) -> DataFrame:
    """``(node, n)``: number of distinct groups with a member node at the node or at most ``max_km`` upstream of it. NULL groups count for nothing."""
    m = members.select(F.col(group).alias("g"), F.col("node")).where("g is not null and node is not null").distinct()
    down = downstream(m.select(F.col("node").alias("source")), edges, max_km)
    reach = m.select("g", "node").unionByName(m.withColumnRenamed("node", "source").join(down, "source").select("g", "node"))
    return reach.distinct().groupBy("node").agg(F.count("*").alias("n"))


def pair_distances(pairs: DataFrame, nodes: DataFrame, edges: DataFrame, undirected: bool = False) -> DataFrame:
    """``(a, b, km)``: distance along the graph from a to b or from b to a, whichever flows; 0 if equal, NULL if neither.

    ``undirected``: also over the node where both streams first meet. Only nodes downstream of an asked node are walked.
    """
    p = pairs.select("a", "b").distinct()
    ask = p.select(F.col("a").alias("source")).union(p.select("b")).distinct()
    down = cut(downstream(ask, edges).unionByName(ask.withColumn("node", F.col("source")).withColumn("km", F.lit(0.0))))
    da = down.select(F.col("source").alias("a"), F.col("node"), F.col("km").alias("ka"))
    db = down.select(F.col("source").alias("b"), F.col("node"), F.col("km").alias("kb"))
    meet = p.join(da, "a").join(db, ["b", "node"])
    if not undirected:
        meet = meet.where("node = a or node = b")
    best = meet.groupBy("a", "b").agg(F.min(F.col("ka") + F.col("kb")).alias("km"))
    return p.join(best, ["a", "b"], "left")


def order_at_least(nodes: DataFrame, attributes: DataFrame, order: str, least: int) -> DataFrame:
    """Nodes whose stream order is at least ``least``; nodes without one count as -1."""
    a = attributes.groupBy("node").agg(F.max(order).alias("_order"))
    return nodes.join(a, "node", "left").where(F.coalesce("_order", F.lit(-1)) >= least).drop("_order")
