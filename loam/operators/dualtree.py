"""Points near other points, and points in regions, by a dual-tree join."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loam.functions.geo import EARTH_RADIUS, box_distance_bounds, great_circle
from loam.operators.lineage import cut

#: A node has 4 x 4 children (two bits of each number); the tree has LEVELS levels above its leaves, whose side is a quarter of the radius.
BITS, LEVELS = 2, 3
_WIDE = 1 << 32


def _parent(node: Column, levels: int) -> Column:
    """The node some levels up of a node number, which is row * 2^32 + column."""
    return F.shiftleft(F.shiftright(node, 32 + BITS * levels), 32) + F.shiftright(node.bitwiseAND(F.lit(_WIDE - 1)), BITS * levels)


def _positions(df: DataFrame, lat: str, lon: str, leaf: float) -> DataFrame:
    """Distinct positions with the number of their leaf."""
    p = df.select(F.col(lat).cast("double").alias("lat"), F.col(lon).cast("double").alias("lon"))
    p = p.where("lat between -90 and 90 and lon between -540 and 540").distinct()
    return p.withColumn("n0", F.floor((F.col("lat") + 90) / leaf) * _WIDE + F.floor((F.col("lon") + 720) / leaf))


def _nodes(positions: DataFrame, level: int) -> DataFrame:
    """Tight boxes (s, n, w, e) of the nodes of a level and the number of their parent: one aggregate, combined before the shuffle."""
    box = positions.groupBy(_parent(F.col("n0"), level).alias(f"n{level}")).agg(F.min("lat").alias("s"), F.max("lat").alias("n"), F.min("lon").alias("w"), F.max("lon").alias("e"))
    return box.withColumn(f"n{level + 1}", _parent(F.col(f"n{level}"), 1))


def _side(df: DataFrame, prefix: str) -> DataFrame:
    return df.select(*[F.col(c).alias(prefix + c) for c in df.columns])


def _verdict(pairs: DataFrame, radius: float) -> DataFrame:
    """Drops pairs of nodes that are certainly apart and marks those that are certainly near."""
    a, b = ([F.col(p + c) for c in ("s", "n", "w", "e")] for p in ("l_", "r_"))
    least, most = box_distance_bounds(tuple(a), tuple(b))
    judged = pairs.withColumn("_least", F.when(F.col("sure"), 0.0).otherwise(least)).where(F.col("_least") <= radius * (1 + 1e-9))
    return judged.withColumn("sure", F.col("sure") | (most <= radius * (1 - 1e-9))).drop("_least")


def positions_within(left: DataFrame, right: DataFrame, radius: float) -> DataFrame:
    """``(l_lat, l_lon, r_lat, r_lon, distance_m)``: pairs of distinct positions ``(lat, lon)`` at most ``radius`` metres apart."""
    leaf = float(np.degrees(radius / EARTH_RADIUS)) / 4
    pl = cut(_positions(left, "lat", "lon", leaf))
    edge = 360.0
    reach = F.lit(min(180.0, float(np.degrees(radius / EARTH_RADIUS)) * 40))
    wrapped = right.select("lat", F.explode(F.filter(F.array(F.col("lon"), F.when(F.col("lon") > 180 - reach, F.col("lon") - edge), F.when(F.col("lon") < -180 + reach, F.col("lon") + edge)), lambda x: x.isNotNull())).alias("lon"))
    pr = cut(_positions(wrapped, "lat", "lon", leaf))
    top = leaf * 2 ** (BITS * LEVELS)
    pad = F.lit(float(np.degrees(radius / EARTH_RADIUS)) * 1.0001)
    far = F.greatest(F.abs("l_s"), F.abs("l_n")) + pad
    wide = F.when(far >= 89.0, 180.0).otherwise(pad / F.cos(F.radians(F.least(far, F.lit(89.0)))))
    rows = F.sequence(F.floor((F.col("l_s") - pad + 90) / top), F.floor((F.col("l_n") + pad + 90) / top))
    cols = F.sequence(F.floor((F.col("l_w") - wide + 720) / top), F.floor((F.col("l_e") + wide + 720) / top))
    start = _side(_nodes(pl, LEVELS), "l_").withColumn("_r", F.explode(rows)).withColumn("_c", F.explode(cols)).withColumn(f"r_n{LEVELS}", F.col("_r") * _WIDE + F.col("_c")).drop("_r", "_c")
    pairs = start.join(_side(_nodes(pr, LEVELS), "r_"), f"r_n{LEVELS}").withColumn("sure", F.lit(False))
    pairs = _verdict(pairs, radius).select(f"l_n{LEVELS}", f"r_n{LEVELS}", "sure")
    for k in range(LEVELS - 1, -1, -1):
        lk, rk = f"l_n{k + 1}", f"r_n{k + 1}"
        pairs = pairs.join(_side(_nodes(pl, k), "l_"), lk).join(_side(_nodes(pr, k), "r_"), rk)
        pairs = _verdict(pairs, radius).select(f"l_n{k}", f"r_n{k}", "sure")
    points = pairs.join(_side(pl.select("n0", "lat", "lon"), "l_"), "l_n0").join(_side(pr.select("n0", "lat", "lon"), "r_"), "r_n0")
    near = points.withColumn("distance_m", great_circle(F.col("l_lat"), F.col("l_lon"), F.col("r_lat"), F.col("r_lon"))).where(F.col("sure") | (F.col("distance_m") <= radius))
    back = F.when(F.col("r_lon") > 180, F.col("r_lon") - edge).when(F.col("r_lon") < -180, F.col("r_lon") + edge).otherwise(F.col("r_lon"))
    return near.select("l_lat", "l_lon", "r_lat", back.alias("r_lon"), "distance_m")


def within_distance(left: DataFrame, left_id: str, right: DataFrame, right_id: str, radius: float, lat: str = "lat", lon: str = "lon") -> DataFrame:
    """``(left_id, right_id, distance_m)``: every pair of rows at most ``radius`` metres apart on the sphere; both have ``lat`` and ``lon`` in degrees.

    Method: both sides become trees of nested square nodes with tight boxes. Starting from the largest nodes, a pair of nodes is
    dropped if no points of it can be near, accepted whole if all must be, and else replaced by its pairs of children: one
    equi-join per side and level, so every level is spread over the cluster. Only uncertain leaves compare points. Rows on one
    position are one point of the tree and are brought back by a join on the position, which adaptive execution splits if it is
    hot. Rows with NULL, NaN or impossible coordinates pair with nothing; repeated rows give repeated pairs; the 180th meridian
    is crossed. Empty tables: no rows. Other columns are ignored.
    """
    def rows(df: DataFrame, ident: str, to: str) -> DataFrame:
        # + 0.0: minus zero is the same place as zero
        return df.select(F.col(ident).alias(to), (F.col(lat).cast("double") + 0.0).alias("lat"), (F.col(lon).cast("double") + 0.0).alias("lon")).where("lat between -90 and 90 and lon between -180 and 180")

    a, b = rows(left, left_id, "_l"), rows(right, right_id, "_r")
    near = positions_within(a, b, radius)
    out = near.join(b.select("_r", F.col("lat").alias("r_lat"), F.col("lon").alias("r_lon")), ["r_lat", "r_lon"]).join(a.select("_l", F.col("lat").alias("l_lat"), F.col("lon").alias("l_lon")), ["l_lat", "l_lon"])
    same = left_id == right_id
    return out.select(F.col("_l").alias(left_id + "_left" if same else left_id), F.col("_r").alias(right_id + "_right" if same else right_id), "distance_m")


def parse_polygons(wkt: str | None) -> np.ndarray:
    """Edges (x1, y1, x2, y2) of all rings of a POLYGON or MULTIPOLYGON text; none if it is NULL, empty or another geometry."""
    edges = []
    if wkt and re.match(r"\s*(MULTI)?POLYGON\b", wkt, re.I):
        for ring in re.findall(r"\(([^()]+)\)", wkt):
            p = np.array([[float(v) for v in xy.split()[:2]] for xy in ring.split(",")])
            if len(p) > 2:
                edges.append(np.hstack([p, np.roll(p, -1, axis=0)]))
    return np.vstack(edges) if edges else np.zeros((0, 4))


def inside(edges: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Even-odd rule with half-open edges: a point on a shared border is in exactly one of its two regions."""
    out = np.zeros(len(x), dtype=bool)
    for x1, y1, x2, y2 in edges:
        if y1 != y2:
            hit = (y1 > y) != (y2 > y)
            out ^= hit & (x < (x2 - x1) * (y - y1) / (y2 - y1) + x1)
    return out


def region_cells(edges: np.ndarray, leaf: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Rows, first and last columns of stretches of square cells of side ``leaf`` that a region touches (an edge runs through) or holds whole, and whether they are whole.

    An edge meets the rows its box spans, and in each of them only the columns it runs through; what lies between the touched cells of a row
    is inside or outside as a whole, by the even-odd rule at one place. So the work is that of the outline, not of the area.
    """
    if not len(edges):
        return tuple(np.zeros(0, dtype=np.int64) for _ in range(3)) + (np.zeros(0, dtype=bool),)
    x1, y1, x2, y2 = edges.T
    first = np.floor(np.minimum(y1, y2) / leaf).astype(np.int64)
    count = np.floor(np.maximum(y1, y2) / leaf).astype(np.int64) - first + 1
    e = np.repeat(np.arange(len(edges)), count)
    row = np.repeat(first - np.r_[0, np.cumsum(count)[:-1]], count) + np.arange(count.sum())
    ax, ay, bx, by = x1[e], y1[e], x2[e], y2[e]
    slope = np.where(ay != by, (bx - ax) / np.where(ay != by, by - ay, 1.0), 0.0)
    low, high = np.minimum(ax, bx), np.maximum(ax, bx)
    at = [np.clip(ax + (np.clip(y, np.minimum(ay, by), np.maximum(ay, by)) - ay) * slope, low, high) for y in (row * leaf, (row + 1) * leaf)]
    flat = ay == by
    lo, hi = np.where(flat, low, np.minimum(*at)), np.where(flat, high, np.maximum(*at))
    slack = 1e-9 * (np.abs(lo) + np.abs(hi) + leaf)
    c0, c1 = np.floor((lo - slack) / leaf).astype(np.int64), np.floor((hi + slack) / leaf).astype(np.int64)
    order = np.lexsort((c0, row))
    row, c0, c1, e = row[order], c0[order], c1[order], e[order]
    out: list[tuple[int, int, int, bool]] = []
    cuts = np.r_[0, np.flatnonzero(np.diff(row)) + 1, len(row)]
    for s, t in zip(cuts[:-1], cuts[1:]):
        r, y = int(row[s]), (row[s] + 0.5) * leaf
        part = edges[e[s:t]]
        cross = (part[:, 1] > y) != (part[:, 3] > y)
        p = part[cross]
        xs = np.sort((p[:, 2] - p[:, 0]) * (y - p[:, 1]) / (p[:, 3] - p[:, 1]) + p[:, 0])
        reach = np.maximum.accumulate(c1[s:t])
        fresh = np.r_[True, c0[s + 1 : t] > reach[:-1]]
        begin, end = c0[s:t][fresh], np.r_[reach[np.flatnonzero(fresh)[1:] - 1], reach[-1]]
        out += [(r, int(a), int(b), False) for a, b in zip(begin, end)]
        gap0, gap1 = end[:-1] + 1, begin[1:] - 1
        right = len(xs) - np.searchsorted(xs, (gap0 + 0.5) * leaf, side="right")
        out += [(r, int(a), int(b), True) for a, b, k in zip(gap0, gap1, right) if a <= b and k % 2]
    rows, a, b, sure = zip(*out)
    return np.array(rows), np.array(a), np.array(b), np.array(sure)


#: Columns of a stretch of cells that are joined as one; rows whose edges meet their points in one task, and points in one task.
WIDE_COLUMNS, BAND_ROWS, POINT_BITS = 64, 16, 14


def regions_of(points: DataFrame, ident: str, x: str, y: str, regions: DataFrame, region_id: str, wkt: str, leaf: float = 1000.0) -> DataFrame:
    """``(ident, region_id)``: the regions, polygons as text in the plane of ``x`` and ``y``, that hold each point.

    Method: points become nodes, squares of side ``leaf``. Regions become stretches of the same squares, touched by their outline or
    inside as a whole (``region_cells``). Nodes and stretches meet in one equi-join on row and a few columns, so a node meets only
    regions about it, however many regions there are; points of nodes inside are taken whole, and only points of touched nodes are
    tested, against the edges of their rows, in chunks of a bounded number of points. One pass over the points, whatever the number
    of regions; nothing but the plan is on the driver. Points without coordinates and regions without a polygon match nothing;
    points outside all regions do not come out; a point in two overlapping regions comes out twice, repeated rows repeatedly. A NULL
    region id is a region; rows of one id are regions of their own.
    """
    kind = regions.schema[region_id].dataType.simpleString()
    p = points.select(F.col(ident).alias("_id"), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).where("abs(x) < 1e300 and abs(y) < 1e300")
    p = p.withColumn("row", F.floor(F.col("y") / leaf)).withColumn("col", F.floor(F.col("x") / leaf))
    shapes = cut(regions.select(F.col(region_id).alias("region"), F.col(wkt).cast("string").alias("wkt")).where("wkt is not null").withColumn("n", F.monotonically_increasing_id()))

    def stretches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for n, text in zip(b["n"], b["wkt"]):
                row, c0, c1, sure = region_cells(parse_polygons(text), leaf)
                if len(row):
                    yield pd.DataFrame({"n": n, "row": row, "c0": c0, "c1": c1, "sure": sure})

    def bands(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for n, text in zip(b["n"], b["wkt"]):
                e = parse_polygons(text)
                e = e[e[:, 1] != e[:, 3]]
                lo, hi = (np.floor(f(e[:, 1], e[:, 3]) / (leaf * BAND_ROWS)).astype(np.int64) for f in (np.minimum, np.maximum))
                k = np.repeat(np.arange(len(e)), hi - lo + 1)
                band = np.repeat(lo - np.r_[0, np.cumsum(hi - lo + 1)[:-1]][: len(lo)], hi - lo + 1) + np.arange(len(k))
                if len(k):
                    yield pd.DataFrame({"n": n, "band": band, "x1": e[k, 0], "y1": e[k, 1], "x2": e[k, 2], "y2": e[k, 3]})

    cells = shapes.select("n", "wkt").mapInPandas(stretches, "n bigint, row bigint, c0 bigint, c1 bigint, sure boolean")
    cells = cells.withColumn("wide", F.explode(F.sequence(F.floor(F.col("c0") / WIDE_COLUMNS), F.floor(F.col("c1") / WIDE_COLUMNS))))
    nodes = p.select("row", "col").distinct().withColumn("wide", F.floor(F.col("col") / WIDE_COLUMNS))
    found = nodes.join(cells, ["row", "wide"]).where("col between c0 and c1").select("row", "col", "n", "sure")
    met = cut(p.join(found, ["row", "col"]).select("_id", "x", "y", "row", "n", "sure"))
    open_ = met.where("not sure").select("_id", "x", "y", "n", F.floor(F.col("row") / BAND_ROWS).alias("band"), F.shiftright(F.monotonically_increasing_id(), POINT_BITS).alias("turn"))
    open_ = cut(open_)
    edges = shapes.select("n", "wkt").mapInPandas(bands, "n bigint, band bigint, x1 double, y1 double, x2 double, y2 double")
    asked = open_.select(F.col("n").alias("_n"), F.col("band").alias("_band"), F.col("turn").alias("_turn")).distinct()
    needed = edges.join(asked, (edges["n"] == F.col("_n")) & (edges["band"] == F.col("_band"))).select("n", "_band", "_turn", "x1", "y1", "x2", "y2")
    id_kind = p.schema["_id"].dataType.simpleString()

    def test(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        outline = dict(list(right.groupby("n")))
        for n, part in left.groupby("n"):
            keep = inside(outline[n][["x1", "y1", "x2", "y2"]].to_numpy(), part["x"].to_numpy(), part["y"].to_numpy()) if n in outline else np.zeros(len(part), dtype=bool)
            out.append(part.loc[keep, ["_id", "n"]])
        return pd.concat(out) if out else pd.DataFrame({"_id": [], "n": []})

    tested = open_.groupBy("band", "turn").cogroup(needed.groupBy("_band", "_turn")).applyInPandas(test, f"_id {id_kind}, n bigint")
    out = met.where("sure").select("_id", "n").unionByName(tested)
    return out.join(shapes.select("n", F.col("region").cast(kind).alias("region")), "n").select(F.col("_id").alias(ident), F.col("region").alias(region_id))


def lines_meeting_regions(lines: DataFrame, line_id: str, regions: DataFrame, region_id: str, wkt: str, leaf: float = 1000.0) -> DataFrame:
    """``(line_id, region_id)``: distinct pairs of a segment ``(x1, y1, x2, y2)`` and a region, polygons as text, that share a place, borders included.

    A segment meets a region if it begins inside it (``regions_of``) or crosses its outline: segments and edges of outlines meet on
    the squares of side ``leaf`` they run through and are then tested exactly, all without a pair of far ones. Segments with a missing
    end and regions without a polygon meet nothing; repeated rows come out once.
    """
    ends = ["x1", "y1", "x2", "y2"]
    segs = lines.select(F.col(line_id).alias("_id"), *[F.col(c).cast("double").alias(c) for c in ends]).where(" and ".join(f"abs({c}) < 1e300" for c in ends)).distinct()
    starts = regions_of(segs, "_id", "x1", "y1", regions, region_id, wkt, leaf).select("_id", F.col(region_id).alias("_region"))
    run = "row bigint, c0 bigint, c1 bigint, x1 double, y1 double, x2 double, y2 double"

    def touched(name: str, edges) -> object:
        def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                for ident, every in zip(b[name], edges(b)):
                    for e in every:
                        row, c0, c1, _ = region_cells(e[None, :], leaf)
                        yield pd.DataFrame({name: [ident] * len(row), "row": row, "c0": c0, "c1": c1, **dict(zip(ends, e))})

        return work

    kind, other = segs.schema["_id"].dataType.simpleString(), regions.schema[region_id].dataType.simpleString()
    a = segs.mapInPandas(touched("_id", lambda b: b[ends].to_numpy()[:, None, :]), f"_id {kind}, {run}")
    shapes = regions.select(F.col(region_id).alias("_region"), F.col(wkt).cast("string").alias("w")).where("w is not null")
    b = shapes.mapInPandas(touched("_region", lambda b: map(parse_polygons, b["w"])), f"_region {other}, {run}")
    a, b = (d.withColumn("wide", F.explode(F.sequence(F.floor(F.col("c0") / WIDE_COLUMNS), F.floor(F.col("c1") / WIDE_COLUMNS)))) for d in (a, b))
    pairs = a.join(b.withColumnsRenamed({c: "e" + c for c in ("c0", "c1", *ends)}), ["row", "wide"]).where("c0 <= ec1 and ec0 <= c1")
    side = lambda p, q, r: (F.col(q[0]) - F.col(p[0])) * (F.col(r[1]) - F.col(p[1])) - (F.col(q[1]) - F.col(p[1])) * (F.col(r[0]) - F.col(p[0]))
    p, q, r, t = ("x1", "y1"), ("x2", "y2"), ("ex1", "ey1"), ("ex2", "ey2")
    apart = (F.signum(side(p, q, r)) * F.signum(side(p, q, t)) <= 0) & (F.signum(side(r, t, p)) * F.signum(side(r, t, q)) <= 0)
    boxes = (F.least("x1", "x2") <= F.greatest("ex1", "ex2")) & (F.least("ex1", "ex2") <= F.greatest("x1", "x2")) & (F.least("y1", "y2") <= F.greatest("ey1", "ey2")) & (F.least("ey1", "ey2") <= F.greatest("y1", "y2"))
    return starts.union(pairs.where(apart & boxes).select("_id", "_region")).distinct().select(F.col("_id").alias(line_id), F.col("_region").alias(region_id))
