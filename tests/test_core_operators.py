"""Order statistics, metrics, components, graphs and sources against plain definitions."""

from __future__ import annotations

import itertools
import json
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from loam.functions import expr as E
from loam.operators import allocate, graph, metrics, ml, ranked, relational, spatial, timeseries
from loam.operators.components import connected_components
from loam.operators.lineage import cut


def test_quantiles_match_linear_interpolation(spark):
    values = [1.0, 2.0, 4.0, 9.0, 9.0, None, float("nan")]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    assert ranked.quantiles(df, "v", [0.0, 0.25, 0.5, 1.0]) == [1.0, 2.0, 4.0, 9.0]
    assert ranked.quantiles(spark.createDataFrame([(1.0,), (2.0,), (4.0,), (9.0,)], "v double"), "v", [0.25]) == [1.75]
    assert ranked.quantiles(df.where("false"), "v", [0.5]) == [None]


def test_quantile_bins_drop_equal_edges(spark):
    df = spark.createDataFrame([(1.0,), (1.0,), (1.0,), (1.0,), (5.0,), (6.0,), (None,)], "v double")
    b, edges = ranked.quantile_bins(df, "v", 3)
    assert len(edges) == 3
    assert sorted(((r["v"], r["bin"]) for r in b.collect()), key=str) == sorted([(1.0, 0)] * 4 + [(5.0, 1), (6.0, 1), (None, None)], key=str)


def test_running_sums_over_ranges(spark):
    rows = [(i, random.Random(i).randint(0, 9)) for i in range(500)]
    got = {r["i"]: r["s"] for r in ranked.running_sums(spark.createDataFrame(rows, "i int, v int"), [F.asc("i")], {"s": F.col("v")}, 7).collect()}
    assert [got[i] for i, _ in rows] == list(itertools.accumulate(v for _, v in rows))


def test_grouped_median(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("a", 8.0), ("b", 1.0), ("b", 2.0), ("b", 2.0), ("b", 9.0), ("c", None)], "k string, v double")
    assert {r["k"]: r["median"] for r in ranked.grouped_median(df, ["k"], "v").collect()} == {"a": 3.0, "b": 2.0}


@pytest.mark.parametrize("seed", [1, 2])
def test_ranking_metrics_match_definition(spark, seed):
    r = random.Random(seed)
    rows = [(round(r.random(), 1), int(r.random() < 0.3)) for _ in range(120)]
    m = metrics.ranking_metrics(spark.createDataFrame(rows, "s double, y int"), "s", F.col("y")).first()
    pos, neg = [s for s, y in rows if y], [s for s, y in rows if not y]
    auc = sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / (len(pos) * len(neg))
    ap, before = 0.0, 0
    for t in sorted({s for s, _ in rows}, reverse=True):
        tp, n = sum(y for s, y in rows if s >= t), sum(s >= t for s, _ in rows)
        ap += (tp - before) / len(pos) * tp / n
        before = tp
    assert m["auc"] == pytest.approx(auc) and m["ap"] == pytest.approx(ap)


def test_metrics_without_classes(spark):
    df = spark.createDataFrame([(0.5, 0), (None, 1)], "s double, y int")
    m = metrics.ranking_metrics(df, "s", F.col("y")).first()
    assert (m["n"], m["n_pos"], m["auc"], m["ap"]) == (1, 0, None, None)
    assert metrics.ranking_metrics(df.where("false"), "s", F.col("y")).first()["n"] == 0
    assert metrics.spearman(df.where("false"), "s", "y").first()["rho"] is None


def test_tails():
    """Against closed forms: chi-square with 2 and 4 degrees, Student's t with 1 and 2."""
    from loam.functions.tails import beta_share, chi2_tail, correlation_tail

    assert chi2_tail(31.34015, 2) == pytest.approx(1.5652e-7, rel=1e-4)
    for x in (0.01, 0.7, 3.0, 12.0, 60.0):
        assert chi2_tail(x, 2) == pytest.approx(math.exp(-x / 2)) and chi2_tail(x, 4) == pytest.approx(math.exp(-x / 2) * (1 + x / 2))
        assert chi2_tail(x, 1) == pytest.approx(math.erfc(math.sqrt(x / 2)))
        assert beta_share(0.5, 0.5, 1 / (1 + x * x)) == pytest.approx(1 - 2 / math.pi * math.atan(x))
    assert correlation_tail(0.0, 9) == 1.0 and correlation_tail(1.0, 9) == 0.0 and correlation_tail(None, 9) is None and correlation_tail(0.5, 2) is None
    r = 0.5  # n = 4: t with 2 degrees, p = 1 - |r|
    assert correlation_tail(r, 4) == pytest.approx(1 - r)


def test_kruskal_of_four_groups(spark):
    rows = [(float((i * 7) % 13), f"g{i % 4}") for i in range(48)]
    k = metrics.kruskal(spark.createDataFrame(rows, "v double, g string"), "v", "g").first()
    assert k["k"] == 4 and 0 < k["p"] <= 1


def test_medians_of_all_columns(spark):
    df = spark.createDataFrame([(1.0, None, 5), (2.0, None, 6), (9.0, None, 7), (None, None, 8)], "a double, b double, c int")
    assert ml.medians(df, ["a", "b", "c"]) == {"a": 2.0, "b": 0.0, "c": 6.5}


def test_cluster_without_a_shared_folder(spark, monkeypatch):
    from types import SimpleNamespace

    from loam.operators import lineage

    sc = SimpleNamespace(getCheckpointDir=lambda: None, master="spark://host:7077")
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        lineage.shared_folder(SimpleNamespace(sparkContext=sc, conf={}))


@pytest.mark.parametrize("local", [0, 10_000])
def test_components_match_closure(spark, local):
    r = random.Random(4)
    edges = [(r.randint(0, 60), r.randint(0, 60)) for _ in range(45)] + [(1, None), (5, 5), (None, None)]
    parent = list(range(61))

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for a, b in edges:
        if a is not None and b is not None:
            x, y = sorted((find(a), find(b)))
            parent[y] = x
    linked = {x for a, b in edges if None not in (a, b) and a != b for x in (a, b)}
    got = connected_components(spark.createDataFrame(edges, "a int, b int"), "a", "b", local_edges=local)
    assert {r["node"]: r["component"] for r in got.collect()} == {x: min(y for y in linked if find(y) == find(x)) for x in linked}
    assert connected_components(spark.createDataFrame([], "a string, b string"), "a", "b", local_edges=local).count() == 0


def test_checkpoint_is_reliable(spark):
    df = cut(spark.range(10))
    assert "LogicalRDD" in df._jdf.queryExecution().toString() or "Scan ExistingRDD" in df._jdf.queryExecution().toString()
    assert spark.sparkContext.getCheckpointDir()


def test_scalar_rules(spark):
    r = spark.range(1).select(
        E.mod360(F.lit(-30.0)).alias("m"), E.azimuth(F.lit(1.0), F.lit(0.0)).alias("east"), E.round_even(F.lit(0.125), 2).alias("even"), E.clip(F.lit(None).cast("double"), 0.0, 1.0).alias("null"),
        E.angle_between(F.lit(10.0), F.lit(350.0)).alias("diff"), E.not_in_keep_null(F.lit(None).cast("string"), ["a"]).alias("kept"), E.growth(F.lit(1.0), F.lit(0.0)).alias("none"), E.number(F.lit("x")).alias("bad"),
        E.pair_mean_std(F.lit(0.2), F.lit(0.5))[1].alias("std"),
    ).first()
    assert (r["m"], r["east"], r["even"], r["null"], r["diff"], r["kept"], r["none"], r["bad"]) == (330.0, 90.0, 0.12, None, 20.0, True, None, None)
    assert r["std"] == pytest.approx(0.212132, abs=1e-6)


def test_circular_mean(spark):
    df = spark.createDataFrame([(1, 359.0, 1.0), (1, 1.0, 1.0)], "k int, a double, s double")
    w = timeseries.wind_vectors(df, ["k"], F.col("a"), F.col("s")).first()
    assert min(w["direction"], 360 - w["direction"]) == pytest.approx(0, abs=1e-9) and w["constancy"] == pytest.approx(0.999848, abs=1e-6)


def test_relational_rules(spark):
    df = spark.createDataFrame([(1, "a", 2), (1, "b", 1), (None, "c", 3), (None, "d", 0)], "k int, v string, o int")
    assert {r["v"] for r in relational.keep_first(df, ["k"], [F.asc("o")]).collect()} == {"b", "d"}
    a, b = spark.createDataFrame([(1,), (1,), (None,)], "k int"), spark.createDataFrame([(2,)], "k int")
    assert {(r["k"], r["a"], r["b"]) for r in relational.align_counts({"a": a, "b": b}, "k").collect()} == {(1, 2, 0), (2, 0, 1)}
    with pytest.raises(ValueError, match="unique"):
        relational.require(a, unique=["k"])
    assert relational.require(b, unique=["k"], not_null=["k"]).count() == 1
    assert relational.narrow_floats(spark.createDataFrame([(1.0, 1)], "a double, b int")).dtypes == [("a", "float"), ("b", "int")]
    assert relational.fill_median(spark.createDataFrame([(1.0,), (None,), (3.0,)], "v double"), ["v"]).where("v = 2").count() == 1


def test_lag_by_year_differs_from_row(spark):
    df = spark.createDataFrame([(1, 2000, 5.0), (1, 2002, 7.0)], "k int, year int, v double")
    assert timeseries.lag_by_row(df, ["k"], "year", ["v"]).where("year = 2002").first()["prev_v"] == 5.0
    assert timeseries.lag_by_year(df, ["k"], "year", ["v"]).where("year = 2002").first()["prev_v"] is None


@pytest.fixture(scope="module")
def points(spark):
    r = np.random.default_rng(3)
    xy = np.round(np.vstack([r.uniform(0, 5000, (150, 2)), r.normal(1000, 60, (80, 2)), np.repeat([[2500.0, 2500.0]], 10, 0)]), 2)
    return xy, spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(xy)], "i long, x double, y double")


def test_radius_counts_are_brute_force(spark, points):
    xy, df = points
    d = np.hypot(*(xy[:, None] - xy[None]).transpose(2, 0, 1))
    got = {r["i"]: r["n"] for r in spatial.radius_counts(df, "i", df, 300.0, "n").collect()}
    assert got == {i: int((d[i] <= 300).sum()) for i in range(len(xy))}
    assert spatial.radius_pairs(df, "i", df.withColumnRenamed("i", "j"), "j", 300.0).count() == int((d <= 300).sum())
    empty = spatial.radius_counts(df, "i", df.where("false"), 300.0, "n")
    assert {r["n"] for r in empty.collect()} == {0}


def test_nearest_is_brute_force(spark, points):
    xy, df = points
    right = df.where("i % 17 = 0").withColumnRenamed("i", "j")
    js = np.arange(0, len(xy), 17)
    d = np.hypot(*(xy[:, None] - xy[js][None]).transpose(2, 0, 1))
    got = {r["i"]: (r["j"], round(r["distance"], 6)) for r in spatial.nearest(df, "i", right, "j").collect()}
    assert got == {i: (int(js[d[i].argmin()]), round(float(d[i].min()), 6)) for i in range(len(xy))}
    assert spatial.nearest(df, "i", right.where("false"), "j").count() == 0 == spatial.nearest(df.where("false"), "i", right, "j").count()
    odd = df.select("i", F.when(F.col("i") > 2, F.col("x")).otherwise(float("nan")).alias("x"), "y")
    assert spatial.nearest(odd, "i", right, "j").count() == len(xy) - 3


@pytest.mark.parametrize("block", [2, 16, 1024])
def test_nearest_items_of_any_block_size(spark, block):
    """Points and segments, with ties, outliers and many items on one place, in blocks of a few items each."""
    from loam.operators import nearest as N

    r = np.random.default_rng(12)
    ends = np.round(np.vstack([np.c_[a := r.uniform(0, 900, (60, 2)), a + r.normal(0, 40, (60, 2))], np.repeat([[500.0, 500.0, 500.0, 500.0]], 30, 0), [[1e6, 1e6, 1e6, 1e6]]]), 1)
    left = np.round(np.vstack([r.uniform(-100, 1100, (80, 2)), [[500.0, 500.0], [9e5, 1.2e6], [-1e6, 0.0]]]), 1)
    d = N.segment_distance(left[:, 0], left[:, 1], *ends.T)
    a = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(left)], "_l long, x double, y double").repartition(3)
    b = spark.createDataFrame([(f"{i:03d}", *map(float, e)) for i, e in enumerate(ends)], "_r string, x1 double, y1 double, x2 double, y2 double")
    got = {x["_l"]: (x["_r"], round(x["distance"], 6)) for x in N.nearest_items(a, b, block, 7).collect()}
    assert got == {i: (f"{d[i].argmin():03d}", round(float(d[i].min()), 6)) for i in range(len(left))}


def test_candidates_of_a_far_outlier_stay_few(spark):
    """Everything crowded at one place, one row far away on either side: a row keeps a few blocks, not all."""
    from loam.operators import nearest as N

    r = np.random.default_rng(5)
    xy = np.vstack([r.normal(0, 50, (4000, 2)), [[5e6, 5e6]]])
    df = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(xy)], "i long, x double, y double")
    seen = []
    search = N._search

    def counted(px, py, items, ids):
        seen.append(len(px))
        return search(px, py, items, ids)

    far = df.where("i = 4000")
    got = spatial.nearest(far, "i", df.where("i < 4000").withColumnRenamed("i", "j"), "j").first()
    want = np.hypot(*(xy[:4000] - xy[4000]).T)
    assert got["j"] == want.argmin() and got["distance"] == pytest.approx(want.min())
    d, at = counted(xy[:, 0], xy[:, 1], np.c_[xy[:4000], xy[:4000]], np.arange(4000))
    assert seen == [4001] and (at[:4000] == np.arange(4000)).all() and d[:4000].max() == 0


def test_field_batch_of_few_rows(spark):
    from loam.operators.batch import field_batch

    rows = [(i, float(i % 40) * 9000, float(i // 40) * 9000, f"r{i % 3}" if i % 7 else None, ((i * 37) % 100) / 100, ((i * 11) % 10) / 100, int(i % 9 == 0), i % 5) for i in range(400)]
    df = spark.createDataFrame(rows, "c long, x double, y double, region string, score double, gap double, label int, effort int")
    got = field_batch(df, "c", "region").collect()
    assert len({r["c"] for r in got}) == len(got) and {r["category"] for r in got} >= {"exploit"} and not {r["c"] for r in got} & {r[0] for r in rows if r[6]}
    assert field_batch(df.where("false"), "c", "region").count() == 0


def test_dbscan_is_closure(spark, points):
    xy, df = points
    d = np.hypot(*(xy[:, None] - xy[None]).transpose(2, 0, 1)) <= 200
    label = np.arange(len(xy))
    while True:
        new = np.array([label[d[i]].min() for i in range(len(xy))])
        if (new == label).all():
            break
        label = new
    sizes = np.bincount(label, minlength=len(xy))
    got = {r["i"]: r["cluster"] for r in spatial.dbscan2(df, "i", 200.0).collect()}
    assert got == {i: int(label[i]) if sizes[label[i]] > 1 else None for i in range(len(xy))}


def test_kernel_sums_in_blocks(spark, points):
    xy, df = points
    k = lambda dx, dy, m: np.exp(-np.hypot(dx, dy) / 500)
    want = np.exp(-np.hypot(*(xy[:, None] - xy[None]).transpose(2, 0, 1)) / 500).sum(1)
    got = {r["i"]: r["s"] for r in spatial.kernel_sums(df, "i", df, k, "s", block_rows=100).collect()}
    assert all(got[i] == pytest.approx(want[i]) for i in range(len(xy)))


def test_greedy_match_is_sequential(spark):
    r = random.Random(8)
    edges = [(r.randint(0, 15), r.randint(0, 15), r.randint(0, 4), n) for n in range(80)]
    used_a, used_b, want = set(), set(), set()
    for a, b, w, n in sorted(edges, key=lambda e: (-e[2], e[3])):
        if a not in used_a and b not in used_b:
            used_a.add(a), used_b.add(b), want.add(n)
    got = spatial.greedy_match(spark.createDataFrame(edges, "a int, b int, w int, n int"), "a", "b", [F.desc("w"), F.asc("n")])
    assert {r["n"] for r in got.collect()} == want


def test_spaced_sample_is_sequential(spark, points):
    xy, df = points
    order = sorted(range(len(xy)), key=lambda i: ((i * 7919) % 241, i))
    kept = []
    for i in order:
        if all(np.hypot(*(xy[i] - xy[j])) >= 250 for j in kept):
            kept.append(i)
    got = spatial.spaced_sample(df, "i", 250.0, (F.col("i") * 7919) % 241)
    assert {r["i"] for r in got.collect()} == set(kept)
    assert spatial.spaced_sample(df.withColumn("g", F.lit(None).cast("string")), "i", 250.0, (F.col("i") * 7919) % 241, within=["g"], most=5).count() == 5


def test_farthest_points_spread(spark, points):
    xy, df = points
    got = sorted(spatial.farthest_points(df, "i", 6).collect(), key=lambda r: r["step"])
    chosen = [0]
    for _ in range(5):
        d = np.min([np.hypot(*(xy - xy[c]).T) for c in chosen], 0)
        d[chosen] = -1
        chosen.append(int(d.argmax()))
    assert [r["i"] for r in got] == chosen
    assert spatial.farthest_points(df.where("false"), "i", 3).count() == 0


def test_allocate_capped():
    got = allocate.allocate_capped({"a": 100, "b": 10, "c": 1, "d": 0}, 20)
    assert sum(got.values()) == 20 and max(got.values()) <= 12 and min(got.values()) >= 1 and got["a"] == 12
    assert sum(allocate.allocate_capped({"a": 0, "b": 0}, 6).values()) == 6


def test_graph_matches_walks(spark):
    edges = [(i, i // 2 if i % 7 != 1 else 0, float(1 + i % 5)) for i in range(1, 60)]
    nxt = {a: (b, k) for a, b, k in edges if b}
    df = spark.createDataFrame(edges, "n long, t long, k double")
    e = graph.functional_edges(df, "n", "t", "k")

    def walk(a):
        km, out = 0.0, []
        while a in nxt:
            a, k = nxt[a]
            km += k
            out.append((a, km))
        return out

    src = spark.createDataFrame([(i,) for i in range(1, 60)], "source long")
    got = {(r["source"], r["node"], r["km"]) for r in graph.downstream(src, e, 9.0).collect()}
    assert got == {(i, a, k) for i in range(1, 60) for a, k in walk(i) if k <= 9.0}
    roots = {r["node"]: r["root"] for r in graph.roots(src.withColumnRenamed("source", "node"), e).collect()}
    assert roots == {i: (walk(i) or [(i, 0)])[-1][0] for i in range(1, 60)}
    assert not graph.has_cycle(e)
    assert graph.has_cycle(e.unionByName(spark.createDataFrame([(3, 14, 1.0)], "node long, next long, km double")).where("node <> 3 or next = 14"))


def test_block_split_and_folds(spark, points):
    _, df = points
    s = ml.block_split(df, "x", "y", 500.0, 0.2, 1)
    n = s.where("is_test").count()
    assert 0.2 * 240 <= n < 0.2 * 240 + 120 and s.count() == 240
    f = ml.group_folds(df.withColumn("g", F.col("i") % 20), F.col("g"), 5, 3)
    assert ml.folds_disjoint(f, "g", "fold")


def test_mahalanobis(spark, points):
    xy, df = points
    got = {r["i"]: r["mahalanobis"] for r in ml.mahalanobis(df, ["x", "y"]).collect()}
    inv = np.linalg.inv(np.cov(xy.T) + 1e-6 * np.eye(2))
    c = xy - xy.mean(0)
    want = np.sqrt(np.einsum("ij,jk,ik->i", c, inv, c))
    assert all(got[i] == pytest.approx(want[i], rel=1e-6) for i in range(len(xy)))


def test_minmax_constant(spark):
    df = spark.createDataFrame([(2.0, 1.0), (2.0, 3.0), (None, 2.0)], "a double, b double")
    assert sorted(((r["a01"], r["b01"]) for r in ml.minmax(df, ["a", "b"]).collect()), key=str) == sorted([(0.0, 0.0), (0.0, 1.0), (None, 0.5)], key=str)


def test_rest_pages(spark, tmp_path):
    from loam.sources import rest

    rows = [{"key": i, "country": "UA" if i % 3 else "PL", "media": [{"a": 1}] if i % 2 else [], "lat": i / 2} for i in range(50)]
    (tmp_path / "pages.jsonl").write_text("\n".join(map(json.dumps, rows)))
    spark.dataSource.register(rest.RestPages)
    df = spark.read.format("rest_pages").schema("key bigint, media string, lat double").option("param.country", "UA").option("pagesize", "7").option("pagespertask", "2").load(str(tmp_path))
    got = {r["key"]: r for r in df.collect()}
    assert set(got) == {i for i in range(50) if i % 3}
    assert got[1]["media"] == '[{"a": 1}]' and got[2]["media"] is None and got[4]["lat"] == 2.0
    m = rest.manifest(spark, str(tmp_path), {"country": "UA"}, max_offset=20, size=5).first()
    assert m["count"] == len(got) and m["truncated"]


def test_fetch_retries():
    import io
    import urllib.error

    from loam.sources import rest

    calls = []

    class Answer(io.BytesIO):
        def __enter__(self):
            return self

    def opener(url, timeout):
        calls.append(url)
        if len(calls) < 3:
            raise urllib.error.HTTPError(url, 503, "busy", {}, None)
        return Answer(b'{"count": 4}')

    assert rest.fetch("http://x", wait=0, opener=opener) == {"count": 4} and len(calls) == 3

    def refuse(url, timeout):
        raise urllib.error.HTTPError(url, 404, "no", {}, None)

    with pytest.raises(urllib.error.HTTPError):
        rest.fetch("http://x", wait=0, opener=refuse)


def test_files_round_trip(spark, tmp_path):
    from loam.sources import files

    df = spark.createDataFrame([(1, 2.5, "a,b"), (2, None, None)], "i int, v double, s string")
    files.write_csv(df, str(tmp_path / "c"))
    assert sorted(files.read_csv(spark, str(tmp_path / "c"), "i int, v double, s string").collect(), key=str) == sorted(df.collect(), key=str)
    files.write_parquet(df, str(tmp_path / "p"), cluster_by=["i"])
    assert spark.read.parquet(str(tmp_path / "p")).count() == 2
    files.write_manifest(str(tmp_path / "m.json"), df.limit(1))
    assert json.loads((tmp_path / "m.json").read_text())["i"] == 1
    with pytest.raises(ValueError):
        files.write_manifest(str(tmp_path / "m.json"), df)
    (tmp_path / "j").mkdir()
    (tmp_path / "j/a.json").write_text('{"point_id": 7, "parameter": {"T": {"20200101": 1.5, "20200102": -999}, "P": {"20200101": 3}}}')
    u = timeseries.unpivot_daily(files.read_json_maps(spark, str(tmp_path / "j")), "point_id", "parameter", "T", ["T", "P"])
    assert {(str(r["date"]), r["T"], r["P"]) for r in u.collect()} == {("2020-01-01", 1.5, 3.0), ("2020-01-02", -999.0, None)}
    raster = spark.createDataFrame([("b", 0, 0, 5.0), ("b", 0, 1, -9999.0)], "band string, row bigint, col bigint, value double")
    p = spark.createDataFrame([(0.5, 9.5), (1.5, 9.5), (50.0, 9.5)], "lon double, lat double")
    assert [r["b"] for r in files.sample_raster(p, raster, "lon", "lat", 0.0, 10.0, 1.0, 1.0, ["b"]).orderBy("lon").collect()] == [5.0, None, None]
    assert files.dense_rows(files.raster_values(raster), 3).first()["values"] == [5.0, None, None]


def test_model_round_trip(spark, tmp_path):
    from loam.sources import files

    df = spark.createDataFrame([(i, float(i % 7), None if i % 5 == 0 else float(i), int(i % 7 > 4)) for i in range(80)], "i int, a double, b double, y int")
    m = ml.fit(df, ["a", "b"], model="logistic")
    s = ml.score(m, df)
    assert s.columns == ["i", "a", "b", "y", "score"] and s.where("score between 0 and 1").count() == 80 and s.where("b is null").count() == 16
    files.save_model(m, str(tmp_path / "model"), {"trained_on": "test"})
    again, about = files.load_model(str(tmp_path / "model"))
    assert about["trained_on"] == "test"
    a, b = ({r["i"]: r["score"] for r in x.collect()} for x in (s, ml.score(again, df)))
    assert a == pytest.approx(b)
    assert ml.elkan_noto(s, "y") > 0.5


def test_hulls_merge(spark):
    from loam.functions.geometry import convex_hull, hulls, ring_measures, wkb_points

    r = np.random.default_rng(3)
    xy = r.uniform(0, 100, (500, 2))
    square = [("s", x, y) for x, y in ((0.0, 0.0), (4.0, 0.0), (4.0, 3.0), (0.0, 3.0), (2.0, 1.0))]
    rows = square + [("r", float(x), float(y)) for x, y in xy] + [("one", 1.0, 1.0), ("line", 0.0, 0.0), ("line", 3.0, 4.0), (None, 1.0, 1.0), ("r", None, 1.0)]
    df = spark.createDataFrame(rows, "g string, x double, y double").repartition(5)
    got = {x["g"]: x for x in hulls(df, "g", "x", "y", buffer=40).collect()}
    assert (got["s"]["hull_area"], got["s"]["hull_perimeter"], got["s"]["hull_x"], got["s"]["hull_y"], got["s"]["corners"]) == (12.0, 14.0, 2.0, 1.5, 4)
    assert got["r"]["hull_area"] == pytest.approx(ring_measures(convex_hull(xy))[0]) and got["one"]["hull_area"] == 0 and got["line"]["hull_perimeter"] == 10.0
    assert set(got) == {"s", "r", "one", "line"} and hulls(df.where("false"), "g", "x", "y").count() == 0
    import struct

    poly = struct.pack("<BIII", 1, 3, 1, 4) + struct.pack("<8d", 0, 0, 1, 0, 1, 1, 0, 0)
    assert wkb_points(poly).tolist() == [[0, 0], [1, 0], [1, 1], [0, 0]] and wkb_points(struct.pack(">BI2d", 0, 1, 5, 6)).tolist() == [[5, 6]]


def test_streaming_ingest(spark, tmp_path):
    from loam.streaming import ingest

    rows = [(1, "2024-01-01 10:00:00", 25.0, 47.0), (1, "2024-01-01 10:05:00", 25.0, 47.0), (2, "2024-01-01 11:00:00", 25.0, 47.0), (3, "2024-01-02 09:00:00", None, 47.0)]
    spark.createDataFrame(rows, "key long, at string, lon double, lat double").withColumn("at", F.col("at").cast("timestamp")).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("key long, at timestamp, lon double, lat double").parquet(str(tmp_path / "in"))
    first = ingest.first_deliveries(ingest.with_cells(stream, "lon", "lat"), "key", "at")
    q = ingest.append_parquet(first, str(tmp_path / "out"), str(tmp_path / "state"))
    q.awaitTermination(120)
    assert sorted(r["key"] for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [1, 2]
    batch = spark.read.parquet(str(tmp_path / "in"))
    counts = ingest.window_counts(ingest.with_cells(batch, "lon", "lat"), ["cell_id"], "at").collect()
    assert [r["n"] for r in counts] == [3]
