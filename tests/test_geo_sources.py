"""Readers of geographic files against files made here; Shapley values against their definition."""

from __future__ import annotations

import itertools
import math
import sqlite3
import struct
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from loam.operators import ml, shap
from loam.sources import files, geo


def _shp(records):
    body = b""
    for n, (kind, points) in enumerate(records, 1):
        if kind == 0:
            c = struct.pack("<i", 0)
        elif kind == 1:
            c = struct.pack("<i2d", 1, *points[0][0])
        else:
            flat = [p for ring in points for p in ring]
            xs, ys = zip(*flat)
            starts = list(itertools.accumulate([0, *map(len, points)]))[:-1]
            c = struct.pack("<i4d2i", kind, min(xs), min(ys), max(xs), max(ys), len(points), len(flat)) + struct.pack(f"<{len(starts)}i", *starts) + b"".join(struct.pack("<2d", *p) for p in flat)
        body += struct.pack(">2i", n, len(c) // 2) + c
    return struct.pack(">7i", 9994, 0, 0, 0, 0, 0, (100 + len(body)) // 2) + struct.pack("<2i8d", 1000, 5, *[0.0] * 8) + body


def _dbf(names):
    head = struct.pack("<B3xIHH20x", 3, len(names), 32 + 32 + 1, 11)
    return head + b"NAME".ljust(11, b"\0") + b"C" + b"\0" * 4 + bytes([10, 0]) + b"\0" * 14 + b"\r" + b"".join(b" " + n.encode().ljust(10) for n in names)


def test_shapefile(spark, tmp_path):
    square = [(0.0, 0.0), (2.0, 0.0), (2.0, 2.0), (0.0, 2.0), (0.0, 0.0)]
    (tmp_path / "a.shp").write_bytes(_shp([(5, [square]), (1, [[(9.0, 9.0)]]), (0, None), (3, [[(0.0, 0.0), (1.0, 1.0)], [(5.0, 5.0), (6.0, 6.0)]])]))
    (tmp_path / "a.dbf").write_bytes(_dbf(["one", "two", "", "four"]))
    got = {r["number"]: r for r in geo.read_shapefile(spark, str(tmp_path / "a"), ["NAME"]).collect()}
    assert got[1]["wkt"].startswith("POLYGON ((0.0 0.0, 2.0 0.0") and got[2]["wkt"] == "POINT (9.0 9.0)" and got[3]["wkt"] is None and got[4]["wkt"].startswith("MULTILINESTRING")
    assert [got[i]["NAME"] for i in range(1, 5)] == ["one", "two", None, "four"] and (got[4]["x2"], got[4]["y2"]) == (6.0, 6.0)
    assert {r["number"] for r in geo.read_shapefile(spark, str(tmp_path / "a"), box=(8, 8, 10, 10)).collect()} == {2, 3}


def test_geopackage_zip_and_raster(spark, tmp_path):
    db = sqlite3.connect(tmp_path / "l.gpkg")
    db.execute("create table roads (name text, geom blob)")
    db.execute("insert into roads values ('r1', ?), ('r2', null)", (b"GP\0\1" + struct.pack("<i", 3035) + struct.pack("<BIId", 1, 2, 2, 1.0)[:9] + struct.pack("<4d", 1, 2, 3, 4),))
    db.commit()
    db.close()
    got = {r["name"]: r for r in geo.read_geopackage(spark, str(tmp_path / "l.gpkg"), "roads", ["name"]).collect()}
    assert (got["r1"]["x1"], got["r1"]["y2"]) == (1.0, 4.0) and got["r2"]["wkb"] is None
    with pytest.raises(ValueError):
        geo.read_geopackage(spark, str(tmp_path / "l.gpkg"), 'x"; drop')
    with zipfile.ZipFile(tmp_path / "z.zip", "w") as z:
        z.writestr("a/b.txt", "hello")
        z.writestr("c.bin", b"\0")
    assert [(r["member"], bytes(r["content"])) for r in geo.zip_members(spark, str(tmp_path / "z.zip"), ".txt").collect()] == [("a/b.txt", b"hello")]
    (tmp_path / "bio_01.asc").write_text("ncols 3\nnrows 2\nxllcorner 0\nyllcorner 0\ncellsize 1\nNODATA_value -1\n1 2 -1\n4 5 6\n")
    r = geo.read_ascii_rasters(spark, str(tmp_path / "bio_01.asc"))
    assert {(x["row"], x["col"], x["value"]) for x in r.collect()} == {(0, 0, 1.0), (0, 1, 2.0), (0, 2, -9999.0), (1, 0, 4.0), (1, 1, 5.0), (1, 2, 6.0)}
    assert geo.read_ascii_rasters(spark, str(tmp_path / "bio_01.asc"), (1, 5, 1, 2)).count() == 2
    files.write_raster(r, spark.createDataFrame([("bio_01", "mean", "C")], "band string, description string, units string"), str(tmp_path / "r"))
    assert spark.read.parquet(str(tmp_path / "r/pixels")).count() == 6


def test_shapley_values(spark):
    r = np.random.default_rng(0)
    x = r.normal(size=(300, 3))
    y = ((x[:, 0] + x[:, 1] * (x[:, 2] > 0)) > 0).astype(int)
    df = spark.createDataFrame([(i, *map(float, v), int(k)) for i, (v, k) in enumerate(zip(x, y))], "i long, a double, b double, c double, y int")
    model = ml.fit(df, ["a", "b", "c"], trees=3, depth=3)
    leaves = shap.tree_leaves(model[0].stages[-1])
    values, base = shap.shap_matrix(leaves, x)

    def expect(v, known):
        """Expected sum of the trees when only the known features count: unknown ones weigh leaves by shares."""
        return sum(leaf.value * math.prod((lo < v[f] <= hi) if f in known else s for f, lo, hi, s in zip(leaf.features, leaf.low, leaf.high, leaf.share)) for leaf in leaves)

    for v, got in list(zip(x, values))[:12]:
        for i in range(3):
            rest = [j for j in range(3) if j != i]
            want = sum(math.factorial(len(s)) * math.factorial(2 - len(s)) / 6 * (expect(v, {*s, i}) - expect(v, set(s))) for n in range(3) for s in itertools.combinations(rest, n))
            assert got[i] == pytest.approx(want)
        assert base + got.sum() == pytest.approx(expect(v, {0, 1, 2}))
    s = shap.shap_values(model, df, "i", ["a", "b", "c"])
    p = ml.score(model, df).join(s, "i").withColumn("margin", F.expr("shap_base + shap_a + shap_b + shap_c"))
    assert p.where("abs(1 / (1 + exp(-2 * margin)) - score) > 1e-6").count() == 0
    assert shap.mean_absolute(s, ["a", "b", "c"]).count() == 3


def _tiff(values, pack=1, predictor=1, tile=None, big=False, planar=1):
    """A TIFF file of bands x rows x columns, written by the book."""
    import zlib

    e = ">" if big else "<"
    bands, height, width = values.shape
    kind = values.dtype.newbyteorder(e)
    th, tw = tile or (3, width)
    blocks = []
    for plane in range(bands) if planar == 2 else [None]:
        for y in range(0, height, th):
            for x in range(0, width, tw):
                part = (values if plane is None else values[plane : plane + 1])[:, y : y + th, x : x + tw].transpose(1, 2, 0)
                if tile:
                    part = np.pad(part, ((0, th - part.shape[0]), (0, tw - part.shape[1]), (0, 0)))
                if predictor == 2:
                    part = np.concatenate([part[:, :1], np.diff(part, axis=1)], axis=1)
                raw = part.astype(kind).tobytes()
                blocks.append(zlib.compress(raw) if pack == 8 else _lzw_codes(raw) if pack == 5 else raw)
    sizes = [len(b) for b in blocks]
    starts = np.cumsum([8, *sizes[:-1]]).tolist()
    form = {"u": 1, "i": 2, "f": 3}[values.dtype.kind]
    tags = [(256, "I", [width]), (257, "I", [height]), (258, "H", [values.dtype.itemsize * 8] * bands), (259, "H", [pack]), (277, "H", [bands]), (284, "H", [planar]), (317, "H", [predictor]), (339, "H", [form] * bands)]
    tags += [(322, "I", [tw]), (323, "I", [th]), (324, "I", starts), (325, "I", sizes)] if tile else [(273, "I", starts), (278, "I", [th]), (279, "I", sizes)]
    tags += [(33550, "d", [0.5, 0.25, 0.0]), (33922, "d", [0.0, 0.0, 0.0, 10.0, 50.0, 0.0]), (42113, "s", b"-1\0")]
    body, extra, at = b"", b"", 8 + sum(sizes)
    tags.sort()
    after = at + 2 + 12 * len(tags) + 4
    for tag, code, v in tags:
        raw = v if code == "s" else struct.pack(f"{e}{len(v)}{code}", *v)
        n = {"s": 2, "H": 3, "I": 4, "d": 12}[code]
        if len(raw) <= 4:
            body += struct.pack(e + "HHI", tag, n, len(v)) + raw.ljust(4, b"\0")
        else:
            body += struct.pack(e + "HHII", tag, n, len(v), after + len(extra))
            extra += raw
    return (b"MM" if big else b"II") + struct.pack(e + "HI", 42, at) + b"".join(blocks) + struct.pack(e + "H", len(tags)) + body + b"\0" * 4 + extra


def _lzw_codes(raw):
    out, bits, n, table, width, word = bytearray(), 0, 0, {bytes([i]): i for i in range(256)}, 9, b""

    def put(code):
        nonlocal bits, n
        bits, n = (bits << width) | code, n + width
        while n >= 8:
            n -= 8
            out.append((bits >> n) & 255)

    put(256)
    top = 258
    for b in raw:
        c = word + bytes([b])
        if c in table:
            word = c
            continue
        put(table[word])
        table[c], top = top, top + 1
        width = 9 if top < 512 else 10 if top < 1024 else 11 if top < 2048 else 12
        word = bytes([b])
    put(table[word])
    put(257)
    if n:
        out.append((bits << (8 - n)) & 255)
    return bytes(out)


@pytest.mark.parametrize("pack", [1, 5, 8])
@pytest.mark.parametrize("shape", [dict(), dict(tile=(16, 16)), dict(big=True, planar=2), dict(predictor=2, tile=(16, 32))])
def test_tiff_windows(pack, shape):
    r = np.random.default_rng(1)
    for kind in ("u1", "i2") if shape.get("predictor") else ("u1", "i2", "f4", "f8"):
        v = r.integers(0, 90, (2, 21, 37)).astype(kind)
        got, missing, place = geo.parse_tiff(_tiff(v, pack, **shape))
        assert (got == v).all() and missing == -1.0 and place == (10.0, 50.0, 0.5, 0.25)
        assert (geo.parse_tiff(_tiff(v, pack, **shape), (5, 18, 10, 99))[0] == v[:, 5:19, 10:]).all()


def test_tiff_as_a_table(spark, tmp_path):
    v = np.arange(12, dtype="f4").reshape(1, 3, 4)
    v[0, 1, 1] = -1
    (tmp_path / "bio_01.tif").write_bytes(_tiff(v, 8))
    got = {(r["band"], r["row"], r["col"]): r["value"] for r in geo.read_tiff_rasters(spark, str(tmp_path / "*.tif"), (1, 2, 0, 2)).collect()}
    assert got == {("bio_01", r, c): files.NODATA if (r, c) == (1, 1) else float(v[0, r, c]) for r in (1, 2) for c in (0, 1, 2)}
    with pytest.raises(ValueError):
        geo.parse_tiff(_tiff(v, 7))


def test_titles_of_missing_keys(spark, tmp_path):
    from loam.sources.rest import with_titles

    (tmp_path / "k1.json").write_text('{"title": "one"}')
    (tmp_path / "k3.json").write_text("not json")
    df = spark.createDataFrame([("k1", None, 1), ("k1", " ", 2), ("k1", "own", 3), ("k2", None, 4), ("k3", None, 5), (None, None, 6)], "key string, name string, _title int")
    assert sorted((r["_title"], r["name"]) for r in with_titles(df.withColumnRenamed("_title", "i"), "key", "name", str(tmp_path)).withColumnRenamed("i", "_title").collect()) == [(1, "one"), (2, "one"), (3, "own"), (4, None), (5, None), (6, None)]


def test_overlays_against_samples():
    """Areas of unions and intersections of ragged polygons, with shared borders and holes, against many positions."""
    from loam.functions import geometry as G

    r = np.random.default_rng(6)

    def ragged(x, y):
        a = np.sort(r.uniform(0, 2 * np.pi, 11))
        return G.ring_edges(np.c_[x + np.cos(a) * r.uniform(20, 60, 11), y + np.sin(a) * r.uniform(20, 60, 11)])

    square = lambda x, y, s: G.ring_edges(np.array([[x, y], [x + s, y], [x + s, y + s], [x, y + s]], dtype=float))
    shapes = [ragged(0, 0), ragged(30, 10), np.vstack([square(-50, -50, 40), square(-40, -40, 10)[::-1]]), square(-10, -50, 40), ragged(-20, 30)]
    x, y = r.uniform(-100, 100, (2, 200_000))
    inside = [G.even_odd(s, x, y) for s in shapes]
    for got, hit in ((G.union(shapes), np.any(inside, axis=0)), (G.intersection(*shapes[:2]), inside[0] & inside[1]), (G.overlay(shapes[:2], lambda i: i[0] & ~i[1]), inside[0] & ~inside[1])):
        assert G.outline_measures(got)[0] == pytest.approx(40_000 * hit.mean(), rel=0.03)
        assert (G.even_odd(got, x[:3000], y[:3000]) == hit[:3000]).all()
    assert G.outline_measures(G.union([square(0, 0, 10), square(10, 0, 10), square(5, 5, 10)])) == pytest.approx((250, 70))
    assert G.shared_share(square(0, 0, 10), square(5, 0, 10)) == pytest.approx(1 / 3) and G.shared_share(square(0, 0, 1), square(5, 5, 1)) == 0.0 and len(G.union([])) == 0
    assert G.outline_measures(G.buffered_hull([[0, 0], [100, 0], [100, 100], [0, 100]], 50, 512))[0] == pytest.approx(1e4 + 400 * 50 + math.pi * 2500, rel=1e-3)
    assert G.outline_measures(G.patch_outline(np.array([[0.0, 0.0], [1000.0, 0.0]])))[0] == pytest.approx(2 * math.pi * 100**2, rel=2e-3)


def test_lines_meeting_regions(spark):
    from loam.operators.dualtree import lines_meeting_regions

    units = spark.createDataFrame([("a", "POLYGON ((0 0, 100 0, 100 100, 0 100, 0 0), (40 40, 60 40, 60 60, 40 60, 40 40))"), ("b", "POLYGON ((200 0, 300 0, 250 80, 200 0))"), ("c", None)], "u string, w string")
    rows = [(1, 10, 10, 20, 20), (2, 45, 45, 55, 55), (3, 45, 45, 90, 45), (4, -10, 50, 310, 50), (5, -5, -5, 0, 0), (6, 150, 0, 160, 90), (7, 240, 10, 240, 10), (8, None, 0, 1, 1), (1, 10, 10, 20, 20)]
    df = spark.createDataFrame([tuple(None if v is None else float(v) if i else v for i, v in enumerate(r)) for r in rows], "l long, x1 double, y1 double, x2 double, y2 double")
    for leaf in (1000.0, 13.0):
        got = sorted((r["l"], r["u"]) for r in lines_meeting_regions(df, "l", units, "u", "w", leaf).collect())
        assert got == [(1, "a"), (3, "a"), (4, "a"), (4, "b"), (5, "a"), (7, "b")]
    assert lines_meeting_regions(df.where("false"), "l", units, "u", "w").count() == 0
