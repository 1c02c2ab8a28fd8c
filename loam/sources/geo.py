"""Geographic files as tables: shapefiles, GeoPackage layers, ASCII and TIFF rasters, zip members. A file is read whole by the task that holds it, many files in parallel."""

from __future__ import annotations

import io
import sqlite3
import struct
import zipfile
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loam.functions.geometry import wkb_points
from loam.sources.files import NODATA

Box = tuple[float, float, float, float]


def zip_members(spark: SparkSession, path: str, suffix: str = "") -> DataFrame:
    """``(path, member, content)``: the files in zip archives, those whose name ends with ``suffix``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for p, c in zip(b["path"], b["content"]):
                with zipfile.ZipFile(io.BytesIO(c)) as z:
                    for n in z.namelist():
                        if n.endswith(suffix) and not n.endswith("/"):
                            yield pd.DataFrame({"path": [p], "member": [n], "content": [z.read(n)]})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "path string, member string, content binary")


def _rings_wkt(kind: int, rings: list[np.ndarray]) -> str:
    text = [", ".join(f"{float(x)!r} {float(y)!r}" for x, y in r) for r in rings]
    if kind == 1:
        return f"POINT ({text[0]})"
    if kind == 8:
        return f"MULTIPOINT ({text[0]})"
    return ("MULTILINESTRING" if kind == 3 else "POLYGON") + " (" + ", ".join(f"({t})" for t in text) + ")"


def parse_shapes(data: bytes, box: Box | None = None) -> list[tuple[int, str | None, float | None, float | None, float | None, float | None]]:
    """Records (number, WKT, bounds) of a .shp file (points, lines, polygons, multipoints; measures and heights left out); with ``box``, those that touch it, told by their header."""
    out = []
    at, end = 100, min(len(data), 2 * struct.unpack_from(">i", data, 24)[0])
    while at + 8 <= end:
        number, words = struct.unpack_from(">ii", data, at)
        at += 8
        start, at = at, at + 2 * words
        kind = struct.unpack_from("<i", data, start)[0] % 10
        if kind == 0:
            out.append((number, None, None, None, None, None))
            continue
        if kind == 1:
            x, y = struct.unpack_from("<2d", data, start + 4)
            bounds, rings = (x, y, x, y), [np.array([[x, y]])]
        else:
            bounds = struct.unpack_from("<4d", data, start + 4)
            rings = []
        if box and (bounds[0] > box[2] or bounds[2] < box[0] or bounds[1] > box[3] or bounds[3] < box[1]):
            continue
        if kind == 8:
            (n,) = struct.unpack_from("<i", data, start + 36)
            rings = [np.frombuffer(data, "<f8", 2 * n, start + 40).reshape(n, 2)]
        elif kind in (3, 5):
            parts, n = struct.unpack_from("<ii", data, start + 36)
            first = [*struct.unpack_from(f"<{parts}i", data, start + 44), n]
            points = np.frombuffer(data, "<f8", 2 * n, start + 44 + 4 * parts).reshape(n, 2)
            rings = [points[a:b] for a, b in zip(first, first[1:])]
        out.append((number, _rings_wkt(kind, rings), *map(float, bounds)))
    return out


def parse_dbf(data: bytes, encoding: str = "utf-8") -> pd.DataFrame:
    """Attributes of a .dbf file as text, blanks removed, empty ones NULL."""
    n, head, size = struct.unpack_from("<IHH", data, 4)
    fields, at = [], 32
    while data[at] != 0x0D:
        fields.append((data[at : at + 11].split(b"\0")[0].decode(encoding, "replace"), data[at + 16]))
        at += 32
    rows = []
    for i in range(n):
        pos, row = head + i * size + 1, []
        for _, width in fields:
            row.append(data[pos : pos + width].decode(encoding, "replace").strip() or None)
            pos += width
        rows.append(row)
    return pd.DataFrame(rows, columns=[f for f, _ in fields], dtype=object)


def read_shapefile(spark: SparkSession, path: str, attributes: list[str] | None = None, box: Box | None = None) -> DataFrame:
    """``(path, number, wkt, x1, y1, x2, y2, attributes...)`` of the .shp files at a path without ending (globs allowed); attributes, as text, of the .dbf beside them."""
    attributes = attributes or []

    def shapes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for p, c in zip(b["path"], b["content"]):
                rows = parse_shapes(c, box)
                if rows:
                    yield pd.DataFrame([(p, *r) for r in rows], columns=["path", "number", "wkt", "x1", "y1", "x2", "y2"])

    def records(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for p, c in zip(b["path"], b["content"]):
                t = parse_dbf(c)
                if len(t):
                    yield pd.DataFrame({"path": [p] * len(t), "number": range(1, len(t) + 1), **{a: t[a].tolist() for a in attributes}})

    stem = F.regexp_replace("path", r"\.[^.]+$", "").alias("path")
    load = lambda end: spark.read.format("binaryFile").load(path + end).select(stem, "content")
    geo = load(".shp").mapInPandas(shapes, "path string, number bigint, wkt string, x1 double, y1 double, x2 double, y2 double")
    if not attributes:
        return geo
    return geo.join(load(".dbf").mapInPandas(records, "path string, number bigint, " + ", ".join(f"{a} string" for a in attributes)), ["path", "number"], "left")


def read_geopackage(spark: SparkSession, path: str, layer: str, columns: list[str] | None = None, geometry: str = "geom") -> DataFrame:
    """``(columns as text..., wkb, x1, y1, x2, y2)`` of a layer of GeoPackage files, read in memory; rows without a geometry keep NULL."""
    columns = columns or []
    if not all(c.replace("_", "").isalnum() for c in [layer, geometry, *columns]):
        raise ValueError("layer and column names must be plain")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for c in b["content"]:
                db = sqlite3.connect(":memory:")
                db.deserialize(c)
                rows = []
                for r in db.execute("select " + ", ".join(f'"{x}"' for x in [*columns, geometry]) + f' from "{layer}"'):
                    blob, bounds = r[-1], (None,) * 4
                    wkb = None
                    if blob:
                        skip = (0, 32, 48, 48, 64)[(blob[3] >> 1) & 7]
                        wkb = blob[8 + skip :]
                        p = wkb_points(wkb)
                        if len(p):
                            bounds = (*p.min(0), *p.max(0))
                    rows.append((*[None if v is None else str(v) for v in r[:-1]], wkb, *bounds))
                db.close()
                if rows:
                    yield pd.DataFrame(rows, columns=[*columns, "wkb", "x1", "y1", "x2", "y2"])

    schema = "".join(f"{c} string, " for c in columns) + "wkb binary, x1 double, y1 double, x2 double, y2 double"
    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, schema)


def read_ascii_rasters(spark: SparkSession, path: str, window: tuple[int, int, int, int] | None = None) -> DataFrame:
    """Long raster ``(band, row, col, value)`` of ESRI ASCII grids, a band per file (its name), missing pixels as ``files.NODATA``; ``window``: first and last row and column wanted."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for p, c in zip(b["path"], b["content"]):
                lines = c.decode("ascii").split("\n")
                head, n = {}, 0
                while lines[n] and lines[n].split()[0][0].isalpha():
                    k, v = lines[n].split()
                    head[k.lower()], n = float(v), n + 1
                band = p.rsplit("/", 1)[-1].rsplit(".", 1)[0]
                r0, r1, c0, c1 = window or (0, int(head["nrows"]) - 1, 0, int(head["ncols"]) - 1)
                for r in range(r0, min(r1, int(head["nrows"]) - 1) + 1):
                    v = np.array(lines[n + r].split()[c0 : c1 + 1], dtype=float)
                    v[v == head.get("nodata_value", NODATA)] = NODATA
                    yield pd.DataFrame({"band": [band] * len(v), "row": r, "col": np.arange(c0, c0 + len(v)), "value": v})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "band string, row bigint, col bigint, value double")


# ---- tagged image files (TIFF 6.0; little or big endian; strips or tiles; none, LZW or deflate compression; horizontal predictor)

_SIZES = {1: "B", 2: "s", 3: "H", 4: "I", 6: "b", 8: "h", 9: "i", 11: "f", 12: "d", 16: "Q"}


def _lzw(data: bytes) -> bytes:
    """The variable-width LZW of TIFF: codes from 9 bits, high bits first, 256 clears the table, 257 ends."""
    out, table, width, acc, bits, before = bytearray(), [], 9, 0, 0, b""
    for byte in data:
        acc, bits = (acc << 8) | byte, bits + 8
        if bits < width:
            continue
        bits -= width
        code, acc = acc >> bits, acc & ((1 << bits) - 1)
        if code == 257:
            break
        if code == 256:
            table, width, before = [], 9, b""
            continue
        entry = bytes([code]) if code < 256 else table[code - 258] if code - 258 < len(table) else before + before[:1]
        out += entry
        if before:
            table.append(before + entry[:1])
        before = entry
        width = 9 if len(table) + 259 < 512 else 10 if len(table) + 259 < 1024 else 11 if len(table) + 259 < 2048 else 12
    return bytes(out)


def parse_tiff(data: bytes, window: tuple[int, int, int, int] | None = None) -> tuple[np.ndarray, float | None, tuple[float, float, float, float] | None]:
    """(bands x rows x columns of the window, the missing value, (x0, y0, dx, dy) of the upper left corner) of the first image of a TIFF file.

    ``window``: first and last row and column; only strips or tiles that touch it are unpacked.
    """
    end = {b"II": "<", b"MM": ">"}[data[:2]]
    (at,) = struct.unpack_from(end + "I", data, 4)
    tags: dict[int, tuple] = {}
    for i in range(struct.unpack_from(end + "H", data, at)[0]):
        tag, kind, n = struct.unpack_from(end + "HHI", data, at + 2 + 12 * i)
        code = _SIZES.get(kind)
        if code is None:
            continue
        size = struct.calcsize(code) * n
        pos = at + 2 + 12 * i + 8 if size <= 4 else struct.unpack_from(end + "I", data, at + 2 + 12 * i + 8)[0]
        tags[tag] = (data[pos : pos + n],) if kind == 2 else struct.unpack_from(f"{end}{n}{code}", data, pos)
    width, height, bands = tags[256][0], tags[257][0], tags.get(277, (1,))[0]
    kind = np.dtype(f"{end}{ {1: 'u', 2: 'i', 3: 'f'}[tags.get(339, (1,))[0]] }{tags.get(258, (8,))[0] // 8}")
    planes, pack, predictor = tags.get(284, (1,))[0], tags.get(259, (1,))[0], tags.get(317, (1,))[0]
    if pack not in (1, 5, 8, 32946) or predictor not in (1, 2):
        raise ValueError(f"compression {pack} with predictor {predictor} is not supported")
    tiled = 322 in tags
    tw, th = (tags[322][0], tags[323][0]) if tiled else (width, min(height, tags.get(278, (height,))[0]))
    starts, sizes = (tags[324], tags[325]) if tiled else (tags[273], tags[279])
    across, down = -(-width // tw), -(-height // th)
    r0, r1, c0, c1 = window or (0, height - 1, 0, width - 1)
    r1, c1 = min(r1, height - 1), min(c1, width - 1)
    out = np.zeros((bands, max(0, r1 - r0 + 1), max(0, c1 - c0 + 1)), dtype=kind.newbyteorder("="))
    each = bands if planes == 1 else 1
    for k, (pos, size) in enumerate(zip(starts, sizes)):
        plane, cell = divmod(k, across * down) if planes == 2 else (0, k)
        ty, tx = divmod(cell, across)
        y, x = ty * th, tx * tw
        rows = th if tiled else min(th, height - y)
        if y > r1 or y + rows <= r0 or x > c1 or x + tw <= c0:
            continue
        raw = data[pos : pos + size]
        raw = raw if pack == 1 else _lzw(raw) if pack == 5 else zlib.decompress(raw)
        block = np.frombuffer(raw, kind, rows * tw * each).reshape(rows, tw, each)
        if predictor == 2:
            block = np.cumsum(block, axis=1, dtype=kind.newbyteorder("="))
        a, b, p, q = max(r0, y), min(r1 + 1, y + rows), max(c0, x), min(c1 + 1, x + tw)
        part = block[a - y : b - y, p - x : q - x].transpose(2, 0, 1)
        out[slice(plane, plane + 1) if planes == 2 else slice(None), a - r0 : b - r0, p - c0 : q - c0] = part
    missing = float(tags[42113][0].split(b"\0")[0]) if 42113 in tags else None
    scale, tie = tags.get(33550), tags.get(33922)
    place = (tie[3] - tie[0] * scale[0], tie[4] + tie[1] * scale[1], scale[0], scale[1]) if scale and tie else None
    return out, missing, place


def read_tiff_rasters(spark: SparkSession, path: str, window: tuple[int, int, int, int] | None = None) -> DataFrame:
    """Long raster ``(band, row, col, value)`` of TIFF files, a band per file and sample (name of the file, and ``_2`` and on for further samples), missing pixels as ``files.NODATA``; ``window`` as in ``read_ascii_rasters``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for p, c in zip(b["path"], b["content"]):
                values, missing, _ = parse_tiff(c, window)
                stem = p.rsplit("/", 1)[-1].rsplit(".", 1)[0]
                r0, c0 = (window[0], window[2]) if window else (0, 0)
                for k, image in enumerate(values.astype(float)):
                    image[np.isnan(image) | (image == missing)] = NODATA
                    for r, line in enumerate(image):
                        yield pd.DataFrame({"band": [stem if k == 0 else f"{stem}_{k + 1}"] * len(line), "row": r0 + r, "col": np.arange(c0, c0 + len(line)), "value": line})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "band string, row bigint, col bigint, value double")
