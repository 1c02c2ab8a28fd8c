"""Mixed timestamps; points near points and in regions: small cases with defined results."""

from __future__ import annotations

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from loam.functions.geo import EARTH_RADIUS, laea_xy
from loam.operators import timestamps as T
from loam.operators.dualtree import inside, parse_polygons, region_cells, regions_of, within_distance

CASES = [
    ("2020-07-01T12:00:00", "instant", 1593594000), ("2020-07-01T12:00:00Z", "instant", 1593604800), ("2020-07-01T12:00:00.999Z", "instant", 1593604800), ("20200701T120000Z", "instant", 1593604800),
    ("2020-07-01 12:00:00 -05:00", "instant", 1593622800), ("2020-07-01T12:00+0300", "instant", 1593594000), ("2020-07-01T12:00:00+02:00[Europe/Warsaw]", "instant", 1593597600),
    ("01.07.2020 12:00", "instant", 1593594000), ("1 липня 2020 12:00", "instant", 1593594000), ("Jul 1, 2020 12:00 PM", "instant", 1593594000), ("Jul 1, 2020 12:05 AM", "instant", 1593551100), ("1 Jul 2020 12:00 CEST", "instant", 1593597600),
    ("1593604800", "instant", 1593604800), ("1593604800999", "instant", 1593604800), ("892635371", "instant", 892635371),
    ("2020-10-25T03:30:00", "chosen", 1603585800), ("2020-03-29T03:30:00", "none", None), ("2020-02-30T10:00:00Z", "none", None), ("01.06.2020 25:10", "none", None), ("2020-06-31 08:15", "none", None),
    ("2020-07-01", "day", None), ("2020/07/01", "day", None), ("20200701", "day", None), ("01.07.2020", "day", None), ("1 July 2020", "day", None), ("2020-13-01", "none", None),
    ("2020", "none", None), ("2020-07", "none", None), ("2020-07-01/2020-07-03", "none", None), ("after rain", "none", None), ("", "none", None), (None, "none", None), ("123456789012345678", "none", None), ("x" * 100_000, "none", None),
]


def test_formats(spark):
    df = spark.createDataFrame([(i, "s", v, 1, "other") for i, (v, _, _) in enumerate(CASES)], "id long, src string, v string, span int, ident string")
    got = {r["ident"]: r for r in T.normalise_timestamps(df, "id", "src", "v", "Europe/Kyiv").collect()}
    assert {i: (got[i]["status"], got[i]["utc_second"]) for i in got} == {i: (s, u) for i, (_, s, u) in enumerate(CASES)}
    assert len(got) == len(CASES)


def test_days_of_slashed_dates(spark):
    df = spark.createDataFrame([(1, "25/12/2020"), (2, "05/06/2020"), (3, "07/07/2020")], "id long, v string")
    got = {r["id"]: r["day"] for r in T.interpretations(df, "v", "UTC").collect()}
    assert str(got[1]) == "2020-12-25" and got[2] is None and str(got[3]) == "2020-07-07"


def test_path_settles_order_of_day_and_month(spark):
    """Month-first values that must be month first make their neighbours month first; time never runs back."""
    rows = [(1, "s", "12/25/2019 10:00 Z"), (2, "s", "01/02/2020 10:00 Z"), (3, "s", "02/03/2020 10:00 Z"), (4, "t", "25/12/2019 10:00 Z"), (5, "t", "01/02/2020 10:00 Z"), (6, None, "01/02/2020 10:00 Z"), (6, None, "01/02/2020 10:00 Z")]
    got = {(r["source"], r["ident"]): (r["format"], r["status"]) for r in T.normalise_timestamps(spark.createDataFrame(rows, "i long, s string, v string"), "i", "s", "v", "UTC", span=2).collect()}
    assert got["s", 2][0] == got["s", 3][0] == "slash_mdy" and got["t", 5] == ("slash_dmy", "chosen") and got[None, 6][1] == "chosen"


def _random_rows(seed, n, single=True):
    r = random.Random(seed)
    rows = []
    for i in range(n):
        k = r.choice([1, 2, 2, 3] if single else [2, 3])
        rows.append((100 + 7 * i, [r.randint(0, 2) for _ in range(k)], sorted(r.randint(0, 9) * 86400 for _ in range(k))))
    return rows


def _path_cost(rows, path):
    own = sum(T.own_cost(r[0], i) if len(r[1]) > 1 else 0 for r, i in zip(rows, path))
    return own + sum(T.step_cost(a[1][i], a[2][i], b[1][j], b[2][j]) for (a, i), (b, j) in zip(zip(rows, path), list(zip(rows, path))[1:]))


@pytest.mark.parametrize("single", [True, False])
def test_spans_give_the_exact_path(single):
    """Against all paths; whatever the spans, and whether they are chained at once or as a tree."""
    rows = _random_rows(5, 9, single)
    best = min(itertools.product(*[range(len(r[1])) for r in rows]), key=lambda p: _path_cost(rows, p))
    for size in (1, 2, 4, 9):
        parts = [rows[i : i + size] for i in range(0, len(rows), size)]
        spans = [(T.span_matrix(p), p[0], p[-1]) for p in parts]
        ends = T.chain_path(spans)
        assert [int(x) for p, (a, b) in zip(parts, ends) for x in T.span_path(p, a, b)] == list(best)
        pairs = [spans[i : i + 2] for i in range(0, len(spans), 2)]
        tops = [p[0] if len(p) == 1 else T.join_spans(*p) for p in pairs]
        down = [e for p, (a, b) in zip(pairs, T.chain_path(tops)) for e in T.chain_path(p, a, b)]
        assert down == ends


def _shortest(rows):
    """The least path over a graph of all readings, by relaxing until nothing changes: nothing of the operator is used but its costs."""
    nodes = [(i, j) for i, r in enumerate(rows) for j in range(len(r[1]))]
    own = lambda i, j: T.own_cost(rows[i][0], j) if len(rows[i][1]) > 1 else 0
    dist = {(i, j): (own(i, j), ((i, j),)) if i == 0 else (10**30, ()) for i, j in nodes}
    changed = True
    while changed:
        changed = False
        for i, j in nodes:
            for k in range(len(rows[i + 1][1])) if i + 1 < len(rows) else ():
                c = dist[i, j][0] + T.step_cost(rows[i][1][j], rows[i][2][j], rows[i + 1][1][k], rows[i + 1][2][k]) + own(i + 1, k)
                if c < dist[i + 1, k][0]:
                    dist[i + 1, k], changed = (c, (*dist[i, j][1], (i + 1, k))), True
    return [j for _, j in min(dist[n] for n in nodes if n[0] == len(rows) - 1)[1]]


@pytest.mark.parametrize("span,fan", [(10_000, 64), (3, 64), (1, 2), (5, 2)])
def test_chosen_instants_are_the_shortest_path(spark, span, fan):
    """Slashed dates of two sources, one with far-spread idents and one of ambiguous dates only; many spans, partitions and levels of the tree."""
    r = random.Random(11)
    data = []
    for s, idents in (("a", sorted(r.sample(range(10**12), 60))), ("b", range(40)), (None, range(7))):
        for i in idents:
            d, m = r.randint(1, 28), r.randint(1, 12)
            if s == "b":
                d = r.randint(1, 12)
            data.append((i, s, f"{d:02d}/{m:02d}/20{r.randint(10, 12)} 10:00 Z" if s == "b" or r.random() < 0.7 else f"20{r.randint(10, 12)}-{m:02d}-{d:02d}T10:00:00Z"))
    df = spark.createDataFrame(data, "i long, s string, v string").repartition(5)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "9")
    try:
        got = {(x["source"], x["ident"]): (x["utc_second"], x["format"]) for x in T.normalise_timestamps(df, "i", "s", "v", "UTC", span=span, fan=fan).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    read = {(x["s"], x["i"]): sorted(zip(x["instants"], x["formats"])) for x in T.interpretations(df, "v", "UTC").collect()}
    for s in ("a", "b", None):
        rows = [(i, [f for _, f in z], [u for u, _ in z]) for i, z in sorted((k[1], z) for k, z in read.items() if k[0] == s and z)]
        assert [got[s, x[0]] for x in rows] == [(x[2][p], T.READINGS[x[1][p]]) for x, p in zip(rows, _shortest(rows))]
    assert len(got) == len(data)


def test_spans_of_sparse_idents_are_bounded(spark):
    import pyarrow as pa

    rows = [("s", i * 10**9, "v", [1, 2] if i % 3 else [1], [5, 6] if i % 3 else [5]) for i in range(1000)] + [("t", 1, "v", [1], [5])]
    t = pa.table(dict(zip(("source", "ident", "value", "formats", "instants"), map(list, zip(*rows)))))
    got = list(T.cut_spans(t.to_batches(max_chunksize=170), 3, 64))
    assert [s for s, _, _ in got] == ["s"] * 16 + ["t"] and max(len(r) for _, _, r in got) <= 64 and len({n for _, n, _ in got}) == 17
    assert [r[0] for s, _, part in got for r in part if len(r[1]) > 1] == [i * 10**9 for i in range(1000) if i % 3]


def test_empty_and_null_ids(spark):
    df = spark.createDataFrame([(None, "s", "2020-10-25T03:30:00")], "i long, s string, v string")
    assert T.normalise_timestamps(df, "i", "s", "v", "Europe/Kyiv").first()["status"] == "chosen"
    assert T.normalise_timestamps(df.where("false"), "i", "s", "v", "Europe/Kyiv").count() == 0


def _great_circle(a, b):
    la, oa, lb, ob = map(np.radians, (a[0], a[1], b[0], b[1]))
    h = np.sin((lb - la) / 2) ** 2 + np.cos(la) * np.cos(lb) * np.sin((ob - oa) / 2) ** 2
    return 2 * EARTH_RADIUS * np.arcsin(min(1.0, np.sqrt(h)))


@pytest.mark.parametrize("radius", [800.0, 20_000.0])
def test_within_distance_is_brute_force(spark, radius):
    r = np.random.default_rng(2)
    left = [(i, float(a), float(o)) for i, (a, o) in enumerate(np.round(np.c_[r.uniform(46, 46.2, 120), r.uniform(25, 25.2, 120)], 5))] + [(500 + i, 46.1, 25.1) for i in range(40)] + [(900, None, 25.0), (901, float("nan"), 25.0), (902, 120.0, 25.0), (903, 46.05, 179.999), (903, 46.05, 179.999)]
    right = [(i, float(a), float(o)) for i, (a, o) in enumerate(np.round(np.c_[r.uniform(46, 46.2, 90), r.uniform(25, 25.2, 90)], 5))] + [(777, 46.05, -179.999), (778, None, None)]
    a = spark.createDataFrame([(*x, "z") for x in left], "l long, lat double, lon double, n0 string")
    b = spark.createDataFrame(right, "r long, lat double, lon double")
    got = sorted((x["l"], x["r"]) for x in within_distance(a, "l", b, "r", radius).collect())
    ok = [x for x in left if x[1] is not None and x[1] == x[1] and x[1] <= 90]
    want = sorted((x[0], y[0]) for x in ok for y in right if y[1] is not None and _great_circle(x[1:], y[1:]) <= radius)
    assert got == want
    assert within_distance(a.where("false"), "l", b, "r", radius).count() == 0 == within_distance(a, "l", b.where("false"), "r", radius).count()


def test_same_column_names(spark):
    a = spark.createDataFrame([(1, 46.0, 25.0), (2, 46.0, 25.0)], "i long, lat double, lon double")
    got = within_distance(a, "i", a, "i", 10.0)
    assert got.columns == ["i_left", "i_right", "distance_m"] and got.count() == 4


def test_regions(spark):
    wkt = {"a": "POLYGON ((0 0, 4000 0, 4000 4000, 0 4000, 0 0), (1000 1000, 3000 1000, 3000 3000, 1000 3000, 1000 1000))", "b": "MULTIPOLYGON (((4000 0, 8000 0, 8000 4000, 4000 4000, 4000 0)), ((1500 1500, 2500 1500, 2000 2500, 1500 1500)))", "c": None, "d": "POINT (1 1)", "e": ""}
    units = spark.createDataFrame(list(wkt.items()), "code string, geom string")
    r = np.random.default_rng(1)
    xy = np.vstack([r.uniform(-500, 8500, (400, 2)), [[4000, 2000], [0, 0], [8000, 10]]])
    pts = spark.createDataFrame([(i, float(x), float(y), "q") for i, (x, y) in enumerate(xy)] + [(9999, None, 1.0, "q"), (9998, float("nan"), 1.0, "q")], "i long, x double, y double, region string")
    want = sorted((i, k) for k, w in wkt.items() for i in np.flatnonzero(inside(parse_polygons(w), xy[:, 0], xy[:, 1])))
    for leaf in (1000.0, 37.0, 50_000.0):
        assert sorted((x["i"], x["code"]) for x in regions_of(pts, "i", "x", "y", units, "code", "geom", leaf=leaf).collect()) == want
    border = [k for i, k in want if i == 400]
    assert border == ["b"]
    assert regions_of(pts, "i", "x", "y", units.where("false"), "code", "geom").count() == 0
    assert regions_of(pts.where("false"), "i", "x", "y", units, "code", "geom").count() == 0


def test_region_cells_hold_what_they_say():
    """Cells of a ragged polygon with a hole: those called whole are inside at every corner, those not named are outside, work follows the outline."""
    r = np.random.default_rng(4)
    a = np.sort(r.uniform(0, 2 * np.pi, 60))
    ring = np.c_[np.cos(a), np.sin(a)] * r.uniform(300, 900, 60)[:, None]
    hole = np.c_[np.cos(a), np.sin(a)][::-1] * 120
    text = "POLYGON ((" + ", ".join(f"{x} {y}" for x, y in np.vstack([ring, ring[:1]])) + "), (" + ", ".join(f"{x} {y}" for x, y in np.vstack([hole, hole[:1]])) + "))"
    edges = parse_polygons(text)
    named = {}
    for row, c0, c1, sure in zip(*region_cells(edges, 20.0)):
        for c in range(c0, c1 + 1):
            assert (row, c) not in named
            named[int(row), c] = bool(sure)
    xy = r.uniform(-1000, 1000, (5000, 2))
    ok = inside(edges, xy[:, 0], xy[:, 1])
    for (x, y), k in zip(xy, ok):
        kind = named.get((int(y // 20), int(x // 20)))
        assert k if kind is True else True if kind is False else not k
    assert sum(named.values()) > 300 and len(region_cells(np.zeros((0, 4)), 20.0)[0]) == 0


def test_projection_origin(spark):
    x, y = laea_xy(F.lit(10.0), F.lit(52.0))
    r = spark.range(1).select(x.alias("x"), y.alias("y")).first()
    assert r["x"] == pytest.approx(4_321_000, abs=1e-6) and r["y"] == pytest.approx(3_210_000, abs=1e-6)
