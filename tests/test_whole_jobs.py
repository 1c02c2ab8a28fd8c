"""Queries that do the whole job, on every row of their input."""

from __future__ import annotations

from pathlib import Path

import pytest

from conftest import DATA
from loam.plans import catalogue

QUERIES = catalogue.queries()
pytestmark = pytest.mark.skipif(not Path(DATA).exists(), reason="no test data")


def _net(spark):
    from loam.plans import views

    return {r["node"]: (r["next"], r["km"]) for r in views.net(spark, DATA).collect()}


def test_upstream_of_every_node(spark):
    net, want = _net(spark), set()
    for node in net:
        at, km = node, 0.0
        while net[at][0]:
            km, at = km + net[at][1], net[at][0]
            want.add((at, node, km))
    assert {tuple(r) for r in QUERIES["graph_upstream"](spark, DATA).collect()} == want


def test_pair_distances_of_every_node(spark):
    net = _net(spark)
    got = {(r["a"], r["b"]) for r in QUERIES["graph_pair_distance"](spark, DATA).collect()}
    assert got == {(n, n + 1) for n in net} | {(n, n // 4) for n in net if n >= 8}


def test_buffer_of_the_whole_block_split(spark):
    from loam.plans import views

    test = {r["key"] for r in QUERIES["block_running_share"](spark, DATA).where("is_test").collect()}
    at = [(r["x"], r["y"]) for r in views.pts(spark, DATA).collect() if r["key"] in test]
    grid = views.grid(spark, DATA).select("cell_id", "x", "y").collect()
    want = {c for c, x, y in grid if all((x - a) ** 2 + (y - b) ** 2 >= 5000**2 for a, b in at)}
    assert len(at) > 20 and 0 < len(want) < len(grid)
    assert {r["cell_id"] for r in QUERIES["buffered_exclusion"](spark, DATA).collect()} == want


def test_baselines_and_permutations(spark):
    """All rungs of the ladder over the same cells; importance of every feature column, over repeats that differ."""
    rungs = {r["model"]: r for r in QUERIES["baseline_ladder"](spark, DATA).collect()}
    assert {"constant", "nearest_positive", "climate", "infrastructure", "logistic", "trees"} <= set(rungs)
    assert rungs["nearest_positive"]["n"] == rungs["constant"]["n"] and rungs["infrastructure"]["auc"] is not None
    got = QUERIES["permutation_importance"](spark, DATA).collect()
    assert len(got) == 9 and any(r["drop_std"] > 0 for r in got)


def test_permutations_are_brute_force(spark):
    import hashlib

    import numpy as np

    from loam.operators import ml

    rows = [(i, (i * 37) % 11 / 10, (i * 53) % 17 / 10, int((i * 37) % 11 + (i * 5) % 4 > 7)) for i in range(60)]
    df = spark.createDataFrame(rows, "id long, a double, b double, y int")
    model = ml.fit(df, ["a", "b"], "y", "logistic")

    def ap(xs):
        s = {r["id"]: r["score"] for r in ml.score(model, spark.createDataFrame(xs, "id long, a double, b double, y int")).collect()}
        by = sorted(((s[x[0]], x[3]) for x in xs), reverse=True)
        at = {v: (sum(p[0] >= v for p in by), sum(p[1] for p in by if p[0] >= v)) for v, _ in by}
        return sum(y * at[v][1] / at[v][0] for v, y in by) / sum(y for _, y in by)

    o = lambda s: sorted(range(60), key=lambda i: hashlib.md5(f"{i}|{s}".encode()).hexdigest())
    drops = {"a": [], "b": []}
    for r in range(3):
        source = dict(zip(o(r), o(1000 + r)))
        for k, f in ((1, "a"), (2, "b")):
            drops[f].append(ap(rows) - ap([(*x[:k], rows[source[x[0]]][k], *x[k + 1 :]) for x in rows]))
    for r in ml.permutation_importance(model, df, ["a", "b"], "id", repeats=3).collect():
        assert abs(r["drop_mean"] - np.mean(drops[r["feature"]])) < 1e-9 and abs(r["drop_std"] - np.std(drops[r["feature"]])) < 1e-9


def test_points_in_regions_of_any_shape(spark, tmp_path):
    pts = [(i, 1, "p", 2020, x, y) for i, (x, y) in enumerate([(1.0, 1.0), (5.0, 5.0), (21.0, 1.0), (29.0, 9.0), (41.0, 1.0), (61.0, 1.0)])]
    spark.createDataFrame(pts, "key long, cell_id long, patch_id string, year int, x3035 double, y3035 double").write.parquet(str(tmp_path / "target_points_clustered.parquet"))
    shapes = [
        ("hole", "POLYGON ((0 0, 10 0, 10 10, 0 10, 0 0), (4 4, 6 4, 6 6, 4 6, 4 4))"), ("triangle", "POLYGON ((20 0, 30 0, 20 10, 20 0))"),
        ("two", "MULTIPOLYGON (((40 0, 50 0, 50 10, 40 10, 40 0)), ((60 0, 70 0, 70 10, 60 10, 60 0)))"),
    ]
    spark.createDataFrame(shapes, "oblast_code string, geometry_wkt string").write.parquet(str(tmp_path / "admin_units.parquet"))
    got = {(r["key"], r["oblast_code"]) for r in QUERIES["point_in_polygon"](spark, str(tmp_path)).collect()}
    assert got == {(0, "hole"), (2, "triangle"), (4, "two"), (5, "two")}
