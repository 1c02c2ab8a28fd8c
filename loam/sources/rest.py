"""Paged REST scan as a Python data source, with retries; a folder of recorded answers stands in for the network."""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Callable, Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from loam.operators.lineage import cut

#: Rows of a page and the largest offset a service usually accepts.
PAGE, MAX_OFFSET = 300, 100_000
_RETRY = {429, 500, 502, 503, 504}


def fetch(url: str, tries: int = 5, wait: float = 2.0, opener: Callable = urllib.request.urlopen) -> dict:
    """JSON of a URL; up to ``tries`` with linearly growing waits on overload, server and connection errors; other statuses raise at once."""
    for n in range(tries):
        try:
            with opener(url, timeout=60) as r:
                return json.loads(r.read())
        except urllib.error.HTTPError as e:
            if e.code not in _RETRY or n == tries - 1:
                raise
        except (urllib.error.URLError, TimeoutError, ConnectionError):
            if n == tries - 1:
                raise
        time.sleep(wait * (n + 1))
    raise RuntimeError("no tries")


def page(base: str, params: dict[str, str], offset: int, limit: int) -> dict:
    """One page ``{count, endOfRecords, results}``: over HTTP, or of ``pages.jsonl`` (all rows) in a local folder."""
    if base.startswith(("http://", "https://")):
        return fetch(f"{base}?{urllib.parse.urlencode(params | {'limit': limit, 'offset': offset})}")
    rows = [json.loads(x) for x in (Path(base) / "pages.jsonl").read_text().splitlines() if x]
    rows = [r for r in rows if all(str(r.get(k)) == v for k, v in params.items())]
    return {"count": len(rows), "endOfRecords": offset + limit >= len(rows), "results": rows[offset : offset + limit]}


def count(base: str, **params: str) -> int:
    """Number of records of a request, without any of them."""
    return int(page(base, params, 0, 0)["count"])


def flatten(record: dict, fields: list[str]) -> tuple:
    """Values of the fields; lists and objects as JSON text, empty ones NULL."""
    out = []
    for f in fields:
        v = record.get(f)
        out.append((json.dumps(v, ensure_ascii=False) if v else None) if isinstance(v, (list, dict)) else v)
    return tuple(out)


class _Pages(InputPartition):
    def __init__(self, start: int, stop: int):
        self.start, self.stop = start, stop


class _Reader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict[str, str]):
        self.schema = schema
        self.base, self.size = options["path"], int(options.get("pagesize", PAGE))
        self.limit, self.per = int(options.get("maxoffset", MAX_OFFSET)), int(options.get("pagespertask", 20))
        self.params = {k[6:]: v for k, v in options.items() if k.startswith("param.")}

    def partitions(self) -> list[InputPartition]:
        total = min(count(self.base, **self.params), self.limit + self.size)
        step = self.size * self.per
        return [_Pages(a, min(a + step, total)) for a in range(0, total, step)] or [_Pages(0, 0)]

    def read(self, partition: InputPartition) -> Iterator[Row]:
        for offset in range(partition.start, partition.stop, self.size):
            got = page(self.base, self.params, offset, min(self.size, partition.stop - offset))
            for r in got["results"]:
                yield Row(**dict(zip(self.schema.names, [None if v is None else self._as(f.dataType.simpleString(), v) for f, v in zip(self.schema, flatten(r, self.schema.names))])))
            if got.get("endOfRecords") or not got["results"]:
                return

    @staticmethod
    def _as(kind: str, v: object) -> object:
        if kind == "string":
            return v if isinstance(v, str) else json.dumps(v)
        return float(v) if kind == "double" else int(v) if kind in ("bigint", "int") else v


class RestPages(DataSource):
    """``spark.read.format("rest_pages").schema(...).option("param.country", "UA").load(base)``: a task per run of pages.

    Options: ``pagesize``, ``maxoffset`` (records beyond it are not offered by the service; ``manifest`` tells whether a request is
    truncated), ``pagespertask``, and ``param.NAME`` for the request.
    """

    @classmethod
    def name(cls) -> str:
        return "rest_pages"

    def schema(self) -> str:
        return "key bigint"

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(schema, dict(self.options))


def title(base: str, key: str, field: str, tries: int = 2, wait: float = 0.5) -> str | None:
    """One field of the record of a key, over HTTP or of ``KEY.json`` in a local folder; NULL if it cannot be had."""
    try:
        got = fetch(f"{base}/{urllib.parse.quote(str(key), safe='')}", tries, wait) if base.startswith(("http://", "https://")) else json.loads((Path(base) / f"{key}.json").read_text())
        return got.get(field)
    except (OSError, ValueError, AttributeError):
        return None


def with_titles(df: DataFrame, key: str, name: str, base: str, field: str = "title") -> DataFrame:
    """``df`` with ``name`` filled from the service where it is NULL or blank: one lookup per distinct missing key, spread over tasks; what cannot be had stays NULL.

    Rows with a name keep it; rows without a key stay without. However many rows share a key, it is asked for once.
    """
    blank = F.coalesce(F.trim(F.col(name)) == "", F.lit(True))
    kind = df.schema[key].dataType.simpleString()

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"_key": b["_key"], "_title": [title(base, k, field) for k in b["_key"]]})

    missing = df.where(blank & F.col(key).isNotNull()).select(F.col(key).alias("_key")).distinct()
    found = cut(missing.mapInPandas(ask, f"_key {kind}, _title string"))
    out = df.join(found, df[key] == found["_key"], "left").withColumn(name, F.when(blank, F.col("_title")).otherwise(F.col(name)))
    return out.select(*df.columns)


def manifest(spark, base: str, params: dict[str, str], max_offset: int = MAX_OFFSET, size: int = PAGE):
    """One row about a request: parameters, number of records, whether it is truncated, UTC time."""
    n = count(base, **params)
    now = time.strftime("%Y-%m-%dT%H:%M:%SZ", time.gmtime())
    return spark.createDataFrame([(json.dumps(params, sort_keys=True), n, n > max_offset + size, now)], "params string, count bigint, truncated boolean, at string")
