"""Plane geometry of point sets: hulls that merge, areas, perimeters, centroids; well-known binary."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def convex_hull(xy: np.ndarray) -> np.ndarray:
    """Corners of the convex hull, counter-clockwise from the leftmost; fewer than three if all points are on a line."""
    p = np.unique(np.asarray(xy, dtype=float).reshape(-1, 2), axis=0)
    if len(p) < 3:
        return p

    def half(points: np.ndarray) -> list[np.ndarray]:
        out: list[np.ndarray] = []
        for q in points:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (q[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (q[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(q)
        return out

    return np.array(half(p)[:-1] + half(p[::-1])[:-1])


def ring_measures(ring: np.ndarray) -> tuple[float, float, float, float]:
    """Area, perimeter and centroid of a simple polygon; a point or segment has area 0 and its mean as centroid."""
    if len(ring) < 3:
        c = ring.mean(0) if len(ring) else np.array([np.nan, np.nan])
        return 0.0, 2 * float(np.hypot(*(ring[-1] - ring[0]))) if len(ring) == 2 else 0.0, float(c[0]), float(c[1])
    o = ring[0]
    a, b = ring - o, np.roll(ring, -1, axis=0) - o
    cross = a[:, 0] * b[:, 1] - b[:, 0] * a[:, 1]
    area = cross.sum() / 2
    cx, cy = ((a + b) * cross[:, None]).sum(0) / (6 * area) + o if area else ring.mean(0)
    return float(abs(area)), float(np.hypot(*(b - a).T).sum()), float(cx), float(cy)


def wkb_points(data: bytes) -> np.ndarray:
    """Coordinates of a WKB point, line, polygon or a collection of these, rings one after another; either byte order."""
    out: list[np.ndarray] = []

    def read(at: int) -> int:
        end = "<" if data[at] == 1 else ">"
        (kind,) = struct.unpack_from(end + "I", data, at + 1)
        at += 5

        def run(at: int, n: int) -> int:
            out.append(np.frombuffer(data, dtype=end + "f8", count=2 * n, offset=at).reshape(n, 2).astype(float))
            return at + 16 * n

        if kind == 1:
            return run(at, 1)
        (n,) = struct.unpack_from(end + "I", data, at)
        at += 4
        if kind == 2:
            return run(at, n)
        if kind == 3:
            for _ in range(n):
                (m,) = struct.unpack_from(end + "I", data, at)
                at = run(at + 4, m)
            return at
        if kind in (4, 5, 6, 7):
            for _ in range(n):
                at = read(at)
            return at
        raise ValueError(f"geometry kind {kind} is not supported")

    read(0)
    return np.vstack(out) if out else np.zeros((0, 2))


def hulls(points: DataFrame, group: str, x: str, y: str, buffer: int = 50_000) -> DataFrame:
    """``(group, hull_area, hull_perimeter, hull_x, hull_y, corners)`` of the convex hull of each group's points.

    Hulls merge: every task first reduces its points to hull corners per group, at most ``buffer`` rows at a time, and only corners
    are shuffled; so a group of any size is a few corners by the time it meets. NULL groups and coordinates are left out.
    """
    slim = points.select(F.col(group).alias("g"), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).where("g is not null and x is not null and y is not null and not isnan(x) and not isnan(y)")
    kind = slim.schema["g"].dataType.simpleString()

    def corners(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        rows = 0

        def reduce() -> pd.DataFrame:
            every = pd.concat(held)
            parts = [pd.DataFrame(convex_hull(p[["x", "y"]].to_numpy()), columns=["x", "y"]).assign(g=g) for g, p in every.groupby("g")]
            return pd.concat(parts)[["g", "x", "y"]]

        for b in batches:
            if len(b):
                held.append(b)
                rows += len(b)
            if rows > buffer:
                yield reduce()
                held, rows = [], 0
        if held:
            yield reduce()

    def finish(pdf: pd.DataFrame) -> pd.DataFrame:
        ring = convex_hull(pdf[["x", "y"]].to_numpy())
        area, perimeter, cx, cy = ring_measures(ring)
        return pd.DataFrame({"g": pdf["g"].iloc[:1].tolist(), "a": [area], "p": [perimeter], "cx": [cx], "cy": [cy], "n": [len(ring)]})

    reduced = slim.mapInPandas(corners, f"g {kind}, x double, y double")
    out = reduced.groupBy("g").applyInPandas(finish, f"g {kind}, a double, p double, cx double, cy double, n int")
    return out.select(F.col("g").alias(group), F.col("a").alias("hull_area"), F.col("p").alias("hull_perimeter"), F.col("cx").alias("hull_x"), F.col("cy").alias("hull_y"), F.col("n").alias("corners"))


# ---- areas of polygons that overlap, given as edges (x1, y1, x2, y2) of all their rings


def even_odd(edges: np.ndarray, x: np.ndarray, y: np.ndarray, step: int = 2_000_000) -> np.ndarray:
    """Whether positions are inside by the even-odd rule."""
    out = np.zeros(len(x), dtype=bool)
    e = edges[edges[:, 1] != edges[:, 3]]
    rows = max(1, step // max(1, len(e)))
    for i in range(0, len(x), rows):
        px, py = x[i : i + rows, None], y[i : i + rows, None]
        hit = ((e[:, 1] > py) != (e[:, 3] > py)) & (px < (e[:, 2] - e[:, 0]) * (py - e[:, 1]) / (e[:, 3] - e[:, 1]) + e[:, 0])
        out[i : i + rows] = hit.sum(1) % 2 == 1
    return out


def _meetings(edges: np.ndarray) -> np.ndarray:
    """Pairs i < j of edges whose boxes touch, found by squares of a mean box's side."""
    low, high = np.minimum(edges[:, :2], edges[:, 2:]), np.maximum(edges[:, :2], edges[:, 2:])
    side = max(float((high - low).mean()) * 2, 1e-6)
    a, b = np.floor(low / side).astype(np.int64), np.floor(high / side).astype(np.int64)
    cells: dict[tuple[int, int], list[int]] = {}
    for i in range(len(edges)):
        for u in range(a[i, 0], b[i, 0] + 1):
            for v in range(a[i, 1], b[i, 1] + 1):
                cells.setdefault((u, v), []).append(i)
    pairs = {(i, j) for ids in cells.values() for k, i in enumerate(ids) for j in ids[k + 1 :]}
    p = np.array(sorted(pairs), dtype=np.int64).reshape(-1, 2)
    touch = ((low[p[:, 0]] <= high[p[:, 1]]) & (low[p[:, 1]] <= high[p[:, 0]])).all(1)
    return p[touch]


def _noded(edges: np.ndarray, digits: int = 6) -> np.ndarray:
    """Edges cut where they meet, each piece once, from its smaller end to its larger."""
    cuts: dict[int, list[float]] = {i: [0.0, 1.0] for i in range(len(edges))}
    for i, j in _meetings(edges):
        p, r = edges[i, :2], edges[i, 2:] - edges[i, :2]
        q, s = edges[j, :2], edges[j, 2:] - edges[j, :2]
        cross, w = r[0] * s[1] - r[1] * s[0], q - p
        if abs(cross) > 1e-12 * (np.hypot(*r) * np.hypot(*s) + 1e-300):
            t, u = (w[0] * s[1] - w[1] * s[0]) / cross, (w[0] * r[1] - w[1] * r[0]) / cross
            if -1e-12 <= t <= 1 + 1e-12 and -1e-12 <= u <= 1 + 1e-12:
                cuts[i].append(t), cuts[j].append(u)
        elif abs(w[0] * r[1] - w[1] * r[0]) <= 1e-9 * max(1.0, np.hypot(*r)):  # on one line: the ends of each cut the other
            cuts[i] += [float(((z - p) @ r) / (r @ r)) for z in (q, q + s)]
            cuts[j] += [float(((z - q) @ s) / (s @ s)) for z in (p, p + r)]
    pieces = set()
    for i, ts in cuts.items():
        t = np.unique(np.clip(ts, 0, 1))
        at = np.round(edges[i, :2] + t[:, None] * (edges[i, 2:] - edges[i, :2]), digits) + 0.0
        for a, b in zip(map(tuple, at), map(tuple, at[1:])):
            if a != b:
                pieces.add((min(a, b), max(a, b)))
    return np.array([[*a, *b] for a, b in sorted(pieces)]).reshape(-1, 4)


def overlay(shapes: list[np.ndarray], rule) -> np.ndarray:
    """Outline of where ``rule`` holds, as edges with the inside on their left. ``rule`` gets, per shape, whether positions are inside it.

    Edges are cut where they meet; a piece belongs to the outline if the rule holds on one of its sides only. Shapes may overlap, share
    borders and have holes. For outlines that fit into a task: the work grows with their edges and what meets in a neighbourhood.
    """
    shapes = [s for s in shapes if len(s)]
    if not shapes:
        return np.zeros((0, 4))
    every = np.vstack(shapes)
    e = _noded(every[(every[:, :2] != every[:, 2:]).any(1)])
    d = e[:, 2:] - e[:, :2]
    long = np.hypot(*d.T)
    off = np.c_[-d[:, 1], d[:, 0]] / long[:, None] * np.minimum(1e-4, long / 1e3)[:, None]
    mid = (e[:, :2] + e[:, 2:]) / 2
    left, right = (rule([even_odd(s, *(mid + sign * off).T) for s in shapes]) for sign in (1, -1))
    out = e[left != right]
    flip = ~left[left != right]
    out[flip] = out[flip][:, [2, 3, 0, 1]]
    return out


def union(shapes: list[np.ndarray]) -> np.ndarray:
    return overlay(shapes, lambda inside: np.any(inside, axis=0))


def intersection(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return overlay([a, b], lambda inside: np.all(inside, axis=0)) if len(a) and len(b) else np.zeros((0, 4))


def outline_measures(edges: np.ndarray) -> tuple[float, float]:
    """Area and length of an outline with the inside on its left."""
    if not len(edges):
        return 0.0, 0.0
    e = edges - np.tile(edges[0, :2], 2)
    return float((e[:, 0] * e[:, 3] - e[:, 2] * e[:, 1]).sum() / 2), float(np.hypot(edges[:, 2] - edges[:, 0], edges[:, 3] - edges[:, 1]).sum())


def shared_share(a: np.ndarray, b: np.ndarray) -> float:
    """Area of the intersection by that of the union (IoU); 0 if neither has any."""
    both, either = outline_measures(intersection(a, b))[0], outline_measures(union([a, b]))[0]
    return both / either if either > 0 else 0.0


def ring_edges(ring: np.ndarray) -> np.ndarray:
    return np.hstack([ring, np.roll(ring, -1, axis=0)]) if len(ring) > 2 else np.zeros((0, 4))


def disc(x: float, y: float, r: float, corners: int = 64) -> np.ndarray:
    """Edges of a regular polygon around a point."""
    a = 2 * np.pi * np.arange(corners) / corners
    return ring_edges(np.c_[x + r * np.cos(a), y + r * np.sin(a)])


def buffered_points(xy: np.ndarray, r: float, corners: int = 64) -> np.ndarray:
    """Outline of all places at most ``r`` from the points (circles as polygons)."""
    return union([disc(x, y, r, corners) for x, y in np.unique(np.asarray(xy, dtype=float).reshape(-1, 2), axis=0)])


def buffered_hull(xy: np.ndarray, r: float, corners: int = 64) -> np.ndarray:
    """Outline of the convex hull of points, widened by ``r`` (circles as polygons)."""
    a = 2 * np.pi * np.arange(corners) / corners
    p = np.unique(np.asarray(xy, dtype=float).reshape(-1, 2), axis=0)
    return ring_edges(convex_hull((p[:, None] + r * np.c_[np.cos(a), np.sin(a)]).reshape(-1, 2)))


def patch_outline(xy: np.ndarray, r: float = 50.0, few: float = 100.0) -> np.ndarray:
    """Outline of a patch: the hull of four points or more widened by ``r``; fewer points: what is within ``few`` of them, one: within ``r``."""
    xy = np.asarray(xy, dtype=float).reshape(-1, 2)
    return buffered_hull(xy, r) if len(xy) >= 4 else buffered_points(xy, max(r, few) if len(xy) > 1 else r)


def region_union(regions: DataFrame, wkt: str, parse) -> DataFrame:
    """One row ``(n_regions, area, perimeter, edges)`` of the union of all regions, a bounded dimension table such as a country's units; ``parse`` makes edges of a text."""

    def join(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shapes = [e for b in batches for e in map(parse, b["w"]) if len(e)]
        out = union(shapes)
        area, length = outline_measures(out)
        yield pd.DataFrame({"n_regions": [len(shapes)], "area": [area], "perimeter": [length], "edges": [len(out)]})

    return regions.select(F.col(wkt).cast("string").alias("w")).where("w is not null").repartition(1).mapInPandas(join, "n_regions bigint, area double, perimeter double, edges bigint")
