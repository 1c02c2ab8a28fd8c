"""Packing texts into containers of a fixed token capacity."""

from __future__ import annotations

import base64
import bisect
import itertools
import math
from collections.abc import Iterable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loam.operators.lineage import cut

#: Open windows of a task; leftover windows that one merging task holds; merged windows that may be broadcast (24 bytes each).
WINDOWS, MERGE_WINDOWS, SMALL_ROWS = 48, 20_000, 500_000
_ENCODERS: dict[tuple[str, str], object] = {}


def tokenizer_files(name: str = "byte_bpe_50k.tiktoken") -> tuple[str, str]:
    """Path of a public vocabulary file and its splitting pattern, from the installed package of tokenizers."""
    import public_tokenizers

    return public_tokenizers.path(name), public_tokenizers.PATTERN


def _encoder(path: str, pattern: str):
    if (path, pattern) not in _ENCODERS:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _ENCODERS[path, pattern] = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return _ENCODERS[path, pattern]


def token_counts(df: DataFrame, ident: str, text: str, path: str, pattern: str) -> DataFrame:
    """``(ident, n_tokens)``: tokens of the whole text by the vocabulary at ``path``; 0 for NULL and empty texts."""
    slim = df.select(F.col(ident).alias("id"), F.col(text).cast("string").alias("text"))
    kind = slim.schema["id"].dataType.simpleString()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoder(path, pattern).encode_ordinary
        for b in batches:
            n = [len(encode(t.as_py() or "")) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64())], ["id", "n_tokens"])

    return slim.mapInArrow(count, f"id {kind}, n_tokens bigint").withColumnRenamed("id", ident)


class OpenWindows:
    """At most ``limit`` open windows; an item goes to the one it fills best, or else the fullest is closed."""

    def __init__(self, capacity: int, limit: int):
        self.capacity, self.limit = capacity, limit
        self.free: list[tuple[int, int]] = []  # (room left, number of the window), ascending
        self.opened = 0

    def place(self, size: int) -> tuple[int, int]:
        """Window number and offset of an item."""
        at = bisect.bisect_left(self.free, (size, -1))
        if at < len(self.free):
            room, window = self.free.pop(at)
        else:
            if len(self.free) >= self.limit:
                self.free.pop(0)
            room, window = self.capacity, self.opened
            self.opened += 1
        if room > size:
            bisect.insort(self.free, (room - size, window))
        return window, self.capacity - room


def place_online(items: Iterable[tuple[object, int]], capacity: int, windows: int, base: int) -> Iterator[tuple[object, int, int, int, int, int, bool]]:
    """Rows (id, piece, start, n_tokens, window, offset, open) of items, each as soon as it is placed; at last a row with ``open`` for every window
    that still has room: id None, n_tokens its fill. Held are the rooms of the open windows, nothing else, whatever the items are."""
    heap = OpenWindows(capacity, windows)
    for i, n in items:
        whole = n // capacity if n > capacity else 0
        for k in range(whole):
            yield i, k, k * capacity, capacity, base + heap.opened, 0, False
            heap.opened += 1
        rest = n - whole * capacity
        if rest or not whole:
            w, at = heap.place(rest)
            yield i, whole, whole * capacity, rest, base + w, at, False
    for room, w in heap.free:
        yield None, 0, 0, capacity - room, base + w, 0, True


def pack(items: DataFrame, ident: str, size: str, capacity: int, windows: int = WINDOWS, merge_windows: int = MERGE_WINDOWS) -> DataFrame:
    """``(ident, piece, start, n_tokens, container, offset)``: one row per piece of an item and the place it was given.

    Method: bounded-space online packing. Every task keeps at most ``windows`` open windows, puts each item into the window it
    fills best, and closes the fullest when none fits and all are in use. The windows that are open when tasks end are merged at the
    last: groups of at most about ``merge_windows`` of them, largest first, best fit, in parallel. No container holds more than
    ``capacity``; an item is split only if it is larger: into full containers of its own and a rest that is packed like an item.
    A task holds the rooms of its open windows only, never their items. The few merged windows are joined to the places of the
    items: broadcast if they are at most ``SMALL_ROWS``, else by a shuffle.
    Items of size 0 or NULL take a place of size 0; a negative size is an error. Equal items are items of their own; the order of rows
    decides places, not what is packed. Place sums to every item exactly once. An empty table gives no rows.
    """
    if capacity < 1 or windows < 1:
        raise ValueError("capacity and windows must be at least 1")
    kind = items.schema[ident].dataType.simpleString()
    slim = cut(items.select(F.col(ident).alias("id"), F.coalesce(F.col(size).cast("bigint"), F.lit(0)).alias("size")))
    if slim.where("size < 0").limit(1).count():
        raise ValueError("sizes must not be negative")
    columns = ["id", "piece", "start", "n_tokens", "window", "offset", "open"]

    def online(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        rows = place_online((x for b in batches for x in zip(b["id"].tolist(), b["size"].tolist())), capacity, windows, TaskContext.get().partitionId() << 33)
        while some := list(itertools.islice(rows, 20_000)):
            yield pd.DataFrame(some, columns=columns).astype({"id": object})

    placed = cut(slim.mapInPandas(online, f"id {kind}, piece bigint, start bigint, n_tokens bigint, window bigint, offset bigint, open boolean"))
    leftovers = placed.where("open").select("window", F.col("n_tokens").alias("fill"))
    groups = max(1, math.ceil(leftovers.count() / merge_windows))

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["fill", "window"], ascending=[False, True])
        heap, names, rows = OpenWindows(capacity, len(pdf)), {}, []
        for window, n in zip(pdf["window"].tolist(), pdf["fill"].tolist()):
            w, at = heap.place(n)
            rows.append((window, names.setdefault(w, window), at))
        return pd.DataFrame(rows, columns=["window", "container", "shift"])

    moved = leftovers.withColumn("g", F.pmod(F.xxhash64("window"), F.lit(groups))).groupBy("g").applyInPandas(lambda pdf: merge(pdf), "window bigint, container bigint, shift bigint")
    moved = cut(moved.where("window <> container"))
    out = placed.where("not open").join(moved.hint("broadcast" if moved.count() <= SMALL_ROWS else "merge"), "window", "left")
    out = out.select("id", "piece", "start", "n_tokens", F.coalesce("container", "window").alias("container"), (F.col("offset") + F.coalesce("shift", F.lit(0))).alias("offset"))
    return out.withColumnRenamed("id", ident)
