"""Nearest items in the plane: blocks along a space-filling curve with tight boxes, pruned by bounds, searched run by run."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loam.operators.lineage import cut

#: Items of a block at least (a power of two), runs a block is cut into, blocks whose boxes go to every task at most (about 2 MB; beyond it
#: blocks grow), rows of the left side that meet a block in one task, left rows whose common box rules out blocks at first.
BLOCK, RUNS, MAX_BLOCKS, CHUNK, GROUP = 1024, 64, 32_768, 8_192, 256


def _interleave(v: Column) -> Column:
    """A 20-bit number with a zero bit between its bits."""
    for shift, mask in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555)):
        v = v.bitwiseOR(F.shiftleft(v, shift)).bitwiseAND(F.lit(mask))
    return v


def curve(x: Column, y: Column, box: tuple[float, float, float, float]) -> Column:
    """Place of a position on the Z-order curve over a box (x1, y1, x2, y2)."""
    top = (1 << 20) - 1
    cell = lambda v, lo, hi: F.greatest(F.lit(0), F.least(F.lit(top), F.floor((v - lo) / (max(hi - lo, 1e-9) / top)).cast("bigint"))).cast("bigint")
    return _interleave(cell(x, box[0], box[2])).bitwiseOR(F.shiftleft(_interleave(cell(y, box[1], box[3])), 1))


def _bounds(px: np.ndarray, py: np.ndarray, w: np.ndarray, s: np.ndarray, e: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Least distance of positions to boxes (positions x boxes)."""
    dx = np.maximum(np.maximum(w - px[:, None], px[:, None] - e), 0)
    dy = np.maximum(np.maximum(s - py[:, None], py[:, None] - n), 0)
    return np.hypot(dx, dy)


def segment_distance(px: np.ndarray, py: np.ndarray, x1: np.ndarray, y1: np.ndarray, x2: np.ndarray, y2: np.ndarray) -> np.ndarray:
    """Distances of positions to segments (positions x segments); a segment of length 0 is a point."""
    vx, vy = x2 - x1, y2 - y1
    long = vx * vx + vy * vy
    t = np.clip(((px[:, None] - x1) * vx + (py[:, None] - y1) * vy) / np.where(long > 0, long, 1.0), 0, 1)
    return np.hypot(px[:, None] - x1 - t * vx, py[:, None] - y1 - t * vy)


def _search(px: np.ndarray, py: np.ndarray, items: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest item (x1, y1, x2, y2 in curve order) of each position: its distance and place in ``ids``, the smallest id of equal ones.

    Items are cut into runs with tight boxes; the run with the nearest box is searched first, then only runs whose box is no farther than what was found.
    """
    order = np.argsort(ids, kind="stable")
    rank = np.empty(len(ids), dtype=np.int64)
    rank[order] = np.arange(len(ids))
    cuts = np.unique(np.linspace(0, len(ids), min(RUNS, len(ids)) + 1).astype(int))
    low, high = np.minimum(items[:, :2], items[:, 2:]), np.maximum(items[:, :2], items[:, 2:])
    lo, hi = np.minimum.reduceat(low, cuts[:-1]), np.maximum.reduceat(high, cuts[:-1])
    near = _bounds(px, py, lo[:, 0], lo[:, 1], hi[:, 0], hi[:, 1])
    first = near.argmin(1)
    best, who = np.full(len(px), np.inf), np.full(len(px), len(ids), dtype=np.int64)

    def look(rows: np.ndarray, k: int) -> None:
        part = slice(cuts[k], cuts[k + 1])
        step = max(1, 2_000_000 // (cuts[k + 1] - cuts[k]))
        for i in range(0, len(rows), step):
            r = rows[i : i + step]
            d = segment_distance(px[r], py[r], *items[part].T)
            least = d.min(1)
            mine = np.where(d == least[:, None], rank[part], len(ids)).min(1)
            better = (least < best[r]) | (least == best[r]) & (mine < who[r])
            best[r], who[r] = np.where(better, least, best[r]), np.where(better, mine, who[r])

    for k in range(len(cuts) - 1):
        look(np.flatnonzero(first == k), k)
    for k in range(len(cuts) - 1):
        look(np.flatnonzero((near[:, k] <= best) & (first != k)), k)
    return best, order[who]


def nearest_items(left: DataFrame, right: DataFrame, block: int = BLOCK, chunk: int = CHUNK) -> DataFrame:
    """``(_l, _r, distance)``: for each row ``(_l, x, y)`` of ``left`` the nearest item ``(_r, x1, y1, x2, y2)`` of ``right``, a segment or point; ties by smaller ``_r``.

    Method: items are range-partitioned along a space-filling curve and cut into blocks of equal numbers, so dense places are many
    small blocks. The boxes of the blocks, at most ``MAX_BLOCKS`` and one item of each go to the tasks of the left side; a row keeps the
    blocks whose box is no farther than the best upper bound (the farthest corner of a box, or the item known of it). Rows meet each
    kept block in chunks of at most ``chunk``, so neither a hot block nor a far outlier brings more than chunk x block together; there
    the block is searched run by run. Three shuffles whatever the distances; no row of the left side is joined to all items.
    """
    extent = right.agg(F.count("*").alias("n"), F.min(F.least("x1", "x2")), F.min(F.least("y1", "y2")), F.max(F.greatest("x1", "x2")), F.max(F.greatest("y1", "y2"))).first()
    kinds = {c: df.schema[c].dataType.simpleString() for df, c in ((left, "_l"), (right, "_r"))}
    none = left.select("_l", F.lit(None).cast(kinds["_r"]).alias("_r"), F.lit(0.0).alias("distance")).where("false")
    if not extent["n"]:
        return none
    spark, box = right.sparkSession, tuple(extent)[1:]
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    while extent["n"] // block > MAX_BLOCKS:
        block *= 2
    placed = right.withColumn("_m", curve((F.col("x1") + F.col("x2")) / 2, (F.col("y1") + F.col("y2")) / 2, box)).repartitionByRange(max(1, min(parts, -(-extent["n"] // block))), "_m").sortWithinPartitions("_m")
    # numbers of rows begin at a multiple of 2^33 in each partition, hence of the block
    placed = cut(placed.withColumn("_i", F.monotonically_increasing_id()).withColumn("_b", F.shiftright("_i", block.bit_length() - 1)).drop("_m"))
    b = placed.groupBy("_b").agg(
        F.min(F.least("x1", "x2")).alias("w"), F.min(F.least("y1", "y2")).alias("s"), F.max(F.greatest("x1", "x2")).alias("e"), F.max(F.greatest("y1", "y2")).alias("n"), F.min(F.struct("x1", "y1")).alias("one"),
    ).select("_b", "w", "s", "e", "n", "one.x1", "one.y1").toPandas()
    names, w, s, e, n, ox, oy = (b[c].to_numpy() for c in b.columns)

    def candidates(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        turn = TaskContext.get().partitionId() << 32
        for batch in batches:
            for at in range(0, len(batch), chunk):
                part = batch.iloc[at : at + chunk]
                x, y = part["x"].to_numpy(), part["y"].to_numpy()
                rows, hits = [], []
                for i in range(0, len(part), GROUP):
                    gx, gy = x[i : i + GROUP], y[i : i + GROUP]
                    # first for the box of a group of rows: how far every row of it has at most to go
                    far = np.hypot(np.maximum(gx.max() - w, e - gx.min()), np.maximum(gy.max() - s, n - gy.min())).min()
                    gap = np.hypot(np.maximum(np.maximum(w - gx.max(), gx.min() - e), 0), np.maximum(np.maximum(s - gy.max(), gy.min() - n), 0))
                    open_ = np.flatnonzero(gap <= far * (1 + 1e-9))
                    least = _bounds(gx, gy, w[open_], s[open_], e[open_], n[open_])
                    corner = np.hypot(np.maximum(gx[:, None] - w[open_], e[open_] - gx[:, None]), np.maximum(gy[:, None] - s[open_], n[open_] - gy[:, None]))
                    known = np.hypot(gx[:, None] - ox[open_], gy[:, None] - oy[open_])
                    r, k = np.nonzero(least <= np.minimum(corner, known).min(1)[:, None] * (1 + 1e-9))
                    rows.append(r + i), hits.append(open_[k])
                r = np.concatenate(rows)
                yield pd.DataFrame({"_l": part["_l"].to_numpy()[r], "x": x[r], "y": y[r], "_b": names[np.concatenate(hits)], "_t": turn})
                turn += 1

    def meet(a: pd.DataFrame, z: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(z):
            return pd.DataFrame({"_l": [], "_r": [], "distance": []})
        z = z.sort_values("_i")
        ids = z["_r"].to_numpy()
        d, at = _search(a["x"].to_numpy(), a["y"].to_numpy(), z[["x1", "y1", "x2", "y2"]].to_numpy(), ids)
        return pd.DataFrame({"_l": a["_l"].to_numpy(), "_r": ids[at], "distance": d})

    spread = left.withColumn("_m", curve(F.col("x"), F.col("y"), box)).repartitionByRange(parts, "_m").sortWithinPartitions("_m").drop("_m")
    found = cut(spread.mapInPandas(candidates, f"_l {kinds['_l']}, x double, y double, _b bigint, _t bigint"))
    meetings = found.select(F.col("_b").alias("_mb"), F.col("_t").alias("_mt")).distinct()
    wanted = placed.join(meetings, placed["_b"] == F.col("_mb")).select("_mb", "_mt", "_i", "_r", "x1", "y1", "x2", "y2")
    met = found.groupBy("_b", "_t").cogroup(wanted.groupBy("_mb", "_mt")).applyInPandas(meet, f"_l {kinds['_l']}, _r {kinds['_r']}, distance double")
    return met.groupBy("_l").agg(F.min(F.struct("distance", "_r")).alias("best")).select("_l", "best._r", "best.distance")
