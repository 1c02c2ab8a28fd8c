"""Queries of the graph operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loam.operators import graph as G
from loam.plans import views as V
from loam.plans.registry import query

_DOWN_SQL = f"""{V.NET_SQL}, down as (select node source, node, cast(0 as double) km from net union all select down.source, edges."next", down.km + edges.km from down join edges on edges.node = down.node)"""


def _edges(spark: SparkSession, d: str) -> DataFrame:
    return G.functional_edges(V.net(spark, d), "node", "next", "km")


@query(f'with recursive {_DOWN_SQL} select source node, node root, km, hops from (select source, node, km, row_number() over (partition by source order by km desc) r, count(*) over (partition by source) - 1 hops from down) where r = 1')
def graph_root(spark: SparkSession, d: str) -> DataFrame:
    """The outlet of every node with distance and number of edges, by pointer doubling."""
    return G.roots(V.net(spark, d), _edges(spark, d))


@query(f"with recursive {_DOWN_SQL} select source, node, km from down where source <> node and km <= 50 and source % 5 = 0")
def graph_downstream_50(spark: SparkSession, d: str) -> DataFrame:
    n = V.net(spark, d).where("node % 5 = 0").select(F.col("node").alias("source"))
    return G.downstream(n, _edges(spark, d), 50.0)


@query(f"with recursive {_DOWN_SQL} select node source, source node, km from down where source <> node")
def graph_upstream(spark: SparkSession, d: str) -> DataFrame:
    """The upstream set of every node with distances."""
    return G.upstream(V.net(spark, d).select(F.col("node").alias("source")), _edges(spark, d))


@query(f"with recursive {_DOWN_SQL}, p as (select node a, node + 1 b from net union select node, node // 4 from net where node >= 8) select a, b, min(case when x.node = b or y.node = a then x.km + y.km end) directed, min(x.km + y.km) undirected from p left join (down x join down y on x.node = y.node) on x.source = a and y.source = b group by 1, 2")
def graph_pair_distance(spark: SparkSession, d: str) -> DataFrame:
    """Distances of every node and the next id, and of every node and the one two levels down, with the flow and over the junction."""
    n = V.net(spark, d)
    return _pair_distances(spark, d, n.select(F.col("node").alias("a"), (F.col("node") + 1).alias("b")).union(n.where("node >= 8").select("node", F.expr("node div 4"))))


def _pair_distances(spark: SparkSession, d: str, pairs: DataFrame) -> DataFrame:
    """Distance of pairs of nodes with the flow, either way, and over the junction of their streams."""
    n, e, p = V.net(spark, d), _edges(spark, d), pairs.distinct()
    one, two = G.pair_distances(p, n, e).withColumnRenamed("km", "directed"), G.pair_distances(p, n, e, undirected=True).withColumnRenamed("km", "undirected")
    return one.join(two, ["a", "b"])


@query(f"with recursive {_DOWN_SQL} select node, min(km) km from down where source in (select node from infected) group by 1")
def graph_multi_source(spark: SparkSession, d: str) -> DataFrame:
    """Least downstream distance from any infected node."""
    return G.multi_source_distance(V.net(spark, d).where("node % 5 = 0").select(F.col("node").alias("source")), _edges(spark, d))


@query(f"with recursive {_DOWN_SQL}, m as (select node % 4 g, node from infected) select down.node, count(distinct g) n from down join m on m.node = down.source where km <= 50 group by 1")
def distinct_accumulate(spark: SparkSession, d: str) -> DataFrame:
    """Number of infected groups at or at most 50 km upstream of each node."""
    m = V.net(spark, d).where("node % 5 = 0").select((F.col("node") % 4).alias("g"), "node")
    return G.upstream_groups(m, "g", _edges(spark, d), 50.0)


@query(f"with {V.NET_SQL} select node, \"next\", km from edges where node in (select node from net where node % 9 + 1 >= 4)")
def graph_order_filter(spark: SparkSession, d: str) -> DataFrame:
    """Edges whose node has at least a stream order; nodes without one have none."""
    a = V.net(spark, d).select("node", (F.col("node") % 9 + 1).alias("order"))
    return G.order_at_least(_edges(spark, d), a, "order", 4)


@query(f"with recursive {_DOWN_SQL}, s as (select node, 2000 + node % 20 first_year from infected) select t, down.node, min(km) km, count(distinct source) n from down join s on s.node = source join (values (2005), (2010)) v(t) on first_year <= t where km <= 50 group by 1, 2")
def connectivity_asof(spark: SparkSession, d: str) -> DataFrame:
    """Connectivity at a cutoff year: only sources known by then count, for training and test rows alike."""
    e = _edges(spark, d)
    s = V.net(spark, d).where("node % 5 = 0").select("node", (F.lit(2000) + F.col("node") % 20).alias("first_year"))
    out = None
    for t in (2005, 2010):
        known = s.where(F.col("first_year") <= t).select(F.col("node").alias("source"))
        reach = G.downstream(known, e, 50.0).unionByName(known.distinct().select("source", F.col("source").alias("node"), F.lit(0.0).alias("km")))
        part = reach.groupBy("node").agg(F.min("km").alias("km"), F.count("*").alias("n")).select(F.lit(t).alias("t"), "node", "km", "n")
        out = part if out is None else out.unionByName(part)
    return out
