"""Joins and aggregates in the projected plane (metres): radius counts, nearest, kernels, clusters, matching."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loam.operators.components import connected_components
from loam.operators.lineage import cut
from loam.operators.nearest import nearest_items

#: Rows of the small side of a kernel that go to the tasks at once.
BLOCK_ROWS = 20_000


def _xy(df: DataFrame, x: str, y: str, *keep: Column) -> DataFrame:
    return df.select(*keep, F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).where("abs(x) < 1e300 and abs(y) < 1e300")  # neither NULL, NaN nor infinite


def _bucket(c: Column | str, side: float) -> Column:
    return F.floor((F.col(c) if isinstance(c, str) else c) / side)


def _offsets(n: int) -> Column:
    return F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in range(-n, n + 1) for j in range(-n, n + 1)])


def radius_pairs(left: DataFrame, left_id: str, right: DataFrame, right_id: str, radius: float, x: str = "x", y: str = "y", by: list[str] | None = None) -> DataFrame:
    """``(left_id, right_id, distance)`` of rows at most ``radius`` apart (optionally with equal ``by`` columns): buckets of that side, the left copied to its 3 x 3 neighbours.

    For pairs that are wanted as rows; to count or test for neighbours use ``radius_counts`` or ``nearest``, which make no pairs.
    """
    by = by or []
    a = _xy(left, x, y, F.col(left_id).alias("_l"), *by).withColumn("o", F.explode(_offsets(1)))
    a = a.select("_l", *by, F.col("x").alias("lx"), F.col("y").alias("ly"), (_bucket("x", radius) + F.col("o.i")).alias("bx"), (_bucket("y", radius) + F.col("o.j")).alias("by_"))
    b = _xy(right, x, y, F.col(right_id).alias("_r"), *by).select("_r", *by, "x", "y", _bucket("x", radius).alias("bx"), _bucket("y", radius).alias("by_"))
    d = F.hypot(F.col("lx") - F.col("x"), F.col("ly") - F.col("y"))
    out = a.join(b, [*by, "bx", "by_"]).withColumn("distance", d).where(F.col("distance") <= radius)
    return out.select(F.col("_l").alias(left_id), F.col("_r").alias(right_id if right_id != left_id else right_id + "_right"), "distance")


def radius_counts(left: DataFrame, left_id: str, right: DataFrame, radius: float, name: str, x: str = "x", y: str = "y", by: list[str] | None = None, fine: int = 4) -> DataFrame:
    """``(left_id, [by], name)``: number of right rows at most ``radius`` from each left row (optionally with equal ``by`` columns); left rows without any count 0.

    Buckets of a ``fine``-th of the radius: pairs of buckets that are near as a whole add the counts of the right bucket,
    aggregated before; only points of buckets on the border of the circle are compared. So dense places cost their number of
    buckets, not of pairs. ``left_id`` must be unique.
    """
    by = by or []
    side = radius / fine
    a = _xy(left, x, y, F.col(left_id).alias("_l"), *by).withColumn("bx", _bucket("x", side)).withColumn("by_", _bucket("y", side))
    b = _xy(right, x, y, *by).withColumn("cx", _bucket("x", side)).withColumn("cy", _bucket("y", side)).groupBy(*by, "x", "y", "cx", "cy").agg(F.count("*").alias("m"))
    b = cut(b)
    cells = b.groupBy(*by, "cx", "cy").agg(F.sum("m").alias("m"))
    near = a.select(*by, "bx", "by_").distinct().withColumn("o", F.explode(_offsets(fine + 1))).withColumn("cx", F.col("bx") + F.col("o.i")).withColumn("cy", F.col("by_") + F.col("o.j"))
    i, j = F.abs(F.col("o.i")), F.abs(F.col("o.j"))
    least = F.hypot(F.greatest(i - 1, F.lit(0)) * side, F.greatest(j - 1, F.lit(0)) * side)
    most = F.hypot((i + 1) * side, (j + 1) * side)
    near = near.withColumn("sure", most <= radius).where(least <= radius).drop("o").join(cells, [*by, "cx", "cy"])
    near = cut(near)
    wholly = near.where("sure").groupBy(*by, "bx", "by_").agg(F.sum("m").alias("whole"))
    edge = near.where("not sure").drop("m", "sure")
    d = F.hypot(F.col("lx") - F.col("x"), F.col("ly") - F.col("y"))
    close = a.select("_l", *by, "bx", "by_", F.col("x").alias("lx"), F.col("y").alias("ly")).join(edge, [*by, "bx", "by_"]).join(b, [*by, "cx", "cy"]).where(d <= radius).groupBy("_l", *by).agg(F.sum("m").alias("part"))
    out = a.join(wholly, [*by, "bx", "by_"], "left").join(close, ["_l", *by], "left")
    every = left.select(F.col(left_id).alias("_l"), *by).join(out.select("_l", "whole", "part"), "_l", "left")
    return every.select(F.col("_l").alias(left_id), *by, (F.coalesce("whole", F.lit(0)) + F.coalesce("part", F.lit(0))).alias(name))


def nearest(left: DataFrame, left_id: str, right: DataFrame, right_id: str, x: str = "x", y: str = "y") -> DataFrame:
    """``(left_id, right_id, distance)``: the nearest right row of each left row, ties by smaller ``right_id``; see ``nearest_items``.

    Right rows of one place are one. Rows without finite coordinates match nothing; no right rows: no rows. ``left_id`` must be unique.
    """
    b = _xy(right, x, y, F.col(right_id).alias("_r")).groupBy("x", "y").agg(F.min("_r").alias("_r"))
    found = nearest_items(_xy(left, x, y, F.col(left_id).alias("_l")), b.select("_r", F.col("x").alias("x1"), F.col("y").alias("y1"), F.col("x").alias("x2"), F.col("y").alias("y2")))
    return found.select(F.col("_l").alias(left_id), F.col("_r").alias(right_id if right_id != left_id else right_id + "_right"), "distance")


def kernel_sums(targets: DataFrame, target_id: str, sources: DataFrame, kernel, name: str, x: str = "x", y: str = "y", extra: list[str] | None = None, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``(target_id, name)``: for each target, the sum of ``kernel(dx, dy, extras)`` over all sources.

    The sources are a stated query set: they go to the tasks in blocks of at most ``block_rows``, one pass over the targets per
    block, and the sums of the blocks are added. ``kernel`` gets numpy arrays of target - source differences (targets x sources)
    and the extra source columns by name, and gives weights of that shape. No pair is ever a row.
    """
    extra = extra or []
    t = _xy(targets, x, y, F.col(target_id).alias("_t"))
    kind = t.schema["_t"].dataType.simpleString()
    out: DataFrame | None = None
    block: list = []

    def one(rows: list) -> DataFrame:
        sx, sy = np.array([r["x"] for r in rows]), np.array([r["y"] for r in rows])
        more = {c: np.array([r[c] for r in rows], dtype=float) for c in extra}

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                px, py = b["x"].to_numpy(), b["y"].to_numpy()
                sums = np.zeros(len(px))
                step = max(1, 2_000_000 // max(1, len(sx)))
                for i in range(0, len(px), step):
                    sums[i : i + step] = kernel(px[i : i + step, None] - sx, py[i : i + step, None] - sy, more).sum(1)
                yield pd.DataFrame({"_t": b["_t"], "s": sums})

        return t.mapInPandas(run, f"_t {kind}, s double")

    for r in _xy(sources, x, y, *extra).toLocalIterator():
        block.append(r)
        if len(block) == block_rows:
            part = one(block)
            out, block = (part if out is None else out.unionByName(part)), []
    if block or out is None:
        part = one(block)
        out = part if out is None else out.unionByName(part)
    return out.groupBy("_t").agg(F.sum("s").alias(name)).withColumnRenamed("_t", target_id)


def dbscan2(points: DataFrame, ident: str, eps: float, x: str = "x", y: str = "y", within: list[str] | None = None) -> DataFrame:
    """``(ident, within, cluster)``: DBSCAN with two points as a core, i.e. groups linked by distances of at most ``eps``; cluster is the smallest ident, NULL for points alone.

    Optionally separately for each value of ``within``. Cells of diagonal ``eps`` are linked as a whole; cells whose
    representatives are near are linked next; only pairs of cells still apart compare their points. ``ident`` must be unique.
    """
    within = within or []
    side = eps / 1.4142135623730951 * (1 - 1e-12)
    p = _xy(points, x, y, F.col(ident).alias("_i"), *within).withColumn("cx", _bucket("x", side)).withColumn("cy", _bucket("y", side))
    p = cut(p.withColumn("cell", F.concat_ws("|", *within, "cx", "cy")))
    cells = cut(p.groupBy("cell", *within, "cx", "cy").agg(F.min(F.struct("x", "y")).alias("rep")))
    near = cells.withColumn("o", F.explode(_offsets(2))).select(*within, F.col("cell").alias("a"), F.col("rep").alias("ra"), (F.col("cx") + F.col("o.i")).alias("cx"), (F.col("cy") + F.col("o.j")).alias("cy"))
    near = cut(near.join(cells.withColumnsRenamed({"cell": "b", "rep": "rb"}), [*within, "cx", "cy"]).where("a < b").select("a", "b", F.hypot(F.col("ra.x") - F.col("rb.x"), F.col("ra.y") - F.col("rb.y")).alias("d")))
    first = cut(connected_components(near.where(F.col("d") <= eps), "a", "b"))
    of = cut(cells.select("cell").join(first, cells["cell"] == first["node"], "left").select("cell", F.coalesce("component", "cell").alias("c")))
    open_ = near.where(F.col("d") > eps).join(of.withColumnsRenamed({"cell": "a", "c": "u"}), "a").join(of.withColumnsRenamed({"cell": "b", "c": "v"}), "b").where("u <> v")
    spots = p.select("cell", "x", "y").distinct()
    hits = open_.join(spots.withColumnsRenamed({"cell": "a", "x": "ax", "y": "ay"}), "a").join(spots.withColumnsRenamed({"cell": "b", "x": "bx", "y": "by"}), "b").where(F.hypot(F.col("ax") - F.col("bx"), F.col("ay") - F.col("by")) <= eps).select("u", "v").distinct()
    last = connected_components(hits, "u", "v")
    group = of.join(last, of["c"] == last["node"], "left").select("cell", F.coalesce("component", "c").alias("c"))
    named = p.join(group, "cell")
    size = named.groupBy("c").agg(F.count("*").alias("n"), F.min("_i").alias("low"))
    return named.join(size, "c").select(F.col("_i").alias(ident), *within, F.when(F.col("n") > 1, F.col("low")).alias("cluster"))


def greedy_match(edges: DataFrame, a: str, b: str, order: list[Column], max_rounds: int = 100) -> DataFrame:
    """Edges a greedy one-to-one matching takes in a total ``order``.

    In rounds, edges that come first at both their ends are taken and their ends removed; this takes exactly the edges a
    sequential pass would. Few rounds suffice unless long chains of edges get worse one by one.
    """
    left = cut(edges)
    taken = None
    wa, wb = Window.partitionBy(a).orderBy(*order), Window.partitionBy(b).orderBy(*order)
    for _ in range(max_rounds):
        best = cut(left.withColumn("_ra", F.row_number().over(wa)).withColumn("_rb", F.row_number().over(wb)).where("_ra = 1 and _rb = 1").drop("_ra", "_rb"))
        if best.isEmpty():
            return taken if taken is not None else best
        taken = best if taken is None else taken.unionByName(best)
        left = cut(left.join(best.select(a), a, "left_anti").join(best.select(b), b, "left_anti"))
    raise RuntimeError(f"matching did not settle in {max_rounds} rounds")


def spaced_sample(points: DataFrame, ident: str, spacing: float, order: Column, x: str = "x", y: str = "y", within: list[str] | None = None, most: int | None = None, max_rounds: int = 200) -> DataFrame:
    """The points a greedy pass in ``order`` keeps so that kept ones (of equal ``within``) are at least ``spacing`` apart; at most ``most`` per ``within``.

    Points lie in squares whose points all exclude each other, so only the first open point of a square can be kept next. In rounds, a
    square's first is kept if no open point nearby comes before it, and what it excludes is dropped: the same points a sequential pass
    keeps. Points meet only the firsts of the 25 squares around, never each other, so dense places cost their number of points.
    ``ident`` must be unique; equal orders go by ident. Points without finite coordinates are kept apart by nothing: they do not come out.
    """
    within = within or []
    side = spacing / 1.4142135623730951 * (1 - 1e-9)
    base = cut(points.withColumn("_o", F.struct(order.alias("o"), F.col(ident).alias("i"))))
    rest = base.select(*[F.col(c).alias(f"_w{i}") for i, c in enumerate(within)], "_o", F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y")).where("abs(_x) < 1e300 and abs(_y) < 1e300")
    rest = cut(rest.withColumn("_cx", _bucket("_x", side)).withColumn("_cy", _bucket("_y", side)))
    groups = [f"_w{i}" for i in range(len(within))]
    apart = F.hypot(F.col("p._x") - F.col("h._x"), F.col("p._y") - F.col("h._y")) < spacing
    kept = None
    for _ in range(max_rounds):
        if rest.isEmpty():
            break
        heads = cut(rest.groupBy(*groups, "_cx", "_cy").agg(F.min(F.struct("_o", "_x", "_y")).alias("_h")).select(*groups, "_cx", "_cy", "_h._o", "_h._x", "_h._y"))
        around = heads.withColumn("_s", F.explode(_offsets(2))).withColumn("_nx", F.col("_cx") + F.col("_s.i")).withColumn("_ny", F.col("_cy") + F.col("_s.j")).drop("_s")
        here = (F.col("p._cx") == F.col("h._nx")) & (F.col("p._cy") == F.col("h._ny"))
        for g in groups:
            here = here & F.col(f"p.{g}").eqNullSafe(F.col(f"h.{g}"))
        late = around.alias("h").join(rest.alias("p"), here & apart & (F.col("p._o") < F.col("h._o")), "left_semi").select("_o").distinct()
        taken = cut(heads.join(late, "_o", "left_anti"))
        kept = taken.select("_o") if kept is None else kept.union(taken.select("_o"))
        reach = around.join(taken.select("_o"), "_o", "left_semi")
        rest = cut(rest.alias("p").join(reach.alias("h"), here & apart, "left_anti"))
    else:
        raise RuntimeError(f"spacing did not settle in {max_rounds} rounds")
    out = base.where("false") if kept is None else base.join(kept, "_o", "left_semi")
    if most is not None:
        w = Window.partitionBy(*within).orderBy("_o")
        out = out.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= most).drop("_n")
    return out.select(*points.columns)


def farthest_points(points: DataFrame, ident: str, k: int, x: str = "x", y: str = "y", seed_id=None, least: float = 0.0) -> DataFrame:
    """``(ident, x, y, step, distance)``: k points chosen one by one, each the farthest from those before (ties: smaller ident); ends when none is at least ``least`` away.

    The first is ``seed_id`` or the smallest ident. Every step is one aggregate over all points against the few chosen ones,
    held as constants of the plan; the points themselves never leave their tasks.
    """
    p = cut(_xy(points, x, y, F.col(ident).alias("_i")))
    first = (p.where(F.col("_i") == seed_id) if seed_id is not None else p).orderBy("_i").limit(1).collect()
    if not first:
        return p.select(F.col("_i").alias(ident), "x", "y", F.lit(0).alias("step"), F.lit(0.0).alias("distance")).limit(0)
    chosen = [(first[0]["_i"], first[0]["x"], first[0]["y"], 0, None)]
    for step in range(1, k):
        d = F.array_min(F.transform(F.array(*[F.struct(F.lit(c[1]).alias("x"), F.lit(c[2]).alias("y")) for c in chosen]), lambda s: F.hypot(F.col("x") - s["x"], F.col("y") - s["y"])))
        far = p.where(~F.col("_i").isin([c[0] for c in chosen])).agg(F.max_by(F.struct("_i", "x", "y", d.alias("d")), F.struct(d.alias("d"), (-F.col("_i")).alias("i"))).alias("m")).first()["m"]
        if far is None or far["d"] < least:
            break
        chosen.append((far["_i"], far["x"], far["y"], step, far["d"]))
    kind = p.schema["_i"].dataType.simpleString()
    return points.sparkSession.createDataFrame(chosen, f"{ident} {kind}, x double, y double, step int, distance double")


def nearest_segment(points: DataFrame, ident: str, lines: DataFrame, line_id: str, x: str = "x", y: str = "y") -> DataFrame:
    """``(ident, line_id, distance)``: the nearest of line segments ``(line_id, x1, y1, x2, y2)``, ties by smaller id; see ``nearest_items``.

    Segments with a missing end match nothing; repeated segments are one, with their smallest id. ``ident`` must be unique.
    """
    ends = [F.col(c).cast("double").alias(c) for c in ("x1", "y1", "x2", "y2")]
    clean = lines.select(F.col(line_id).alias("_r"), *ends).where(" and ".join(f"abs({c}) < 1e300" for c in ("x1", "y1", "x2", "y2"))).groupBy("x1", "y1", "x2", "y2").agg(F.min("_r").alias("_r"))
    found = nearest_items(_xy(points, x, y, F.col(ident).alias("_l")), clean.select("_r", "x1", "y1", "x2", "y2"))
    return found.select(F.col("_l").alias(ident), F.col("_r").alias(line_id), "distance")
