"""Top N items of every group by a mergeable, bounded aggregation."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows buffered before the bounded heaps of a task are compacted, and rows of heaps a task keeps before it passes them on.
BUFFER_ROWS, STATE_ROWS = 200_000, 400_000


def _codes(t: pa.Table, names: list[str]) -> np.ndarray:
    """One number per row, equal where all the named columns are equal (NULL equals NULL)."""
    code = np.zeros(t.num_rows, dtype=np.int64)
    for name in names:
        c = t.column(name).combine_chunks()
        d = pc.dictionary_encode(c, null_encoding="encode").indices.to_numpy(zero_copy_only=False).astype(np.int64)
        code = np.unique(code * (d.max(initial=0) + 1) + d, return_inverse=True)[1]
    return code


def merge_heaps(t: pa.Table, groups: list[str], score: str, ident: str, n: int, rank: str | None = None) -> pa.Table:
    """The n best distinct items of each group: highest score, then smallest identifier; with their rank, if it is named."""
    if not t.num_rows:
        return t.append_column(rank, pa.array([], pa.int32())) if rank else t
    t = t.combine_chunks().sort_by([(score, "descending"), (ident, "ascending")])
    g, i = _codes(t, groups), _codes(t, [ident])
    first = np.sort(np.unique(g * (i.max() + 1) + i, return_index=True)[1])
    order = np.argsort(g[first], kind="stable")
    by = g[first][order]
    at = np.arange(len(by))
    place = at - np.maximum.accumulate(np.where(np.r_[True, by[1:] != by[:-1]], at, 0))
    out = t.take(pa.array(first[order[place < n]]))
    return out.append_column(rank, pa.array(place[place < n] + 1, pa.int32())) if rank else out


def merge_sorted(batches: Iterator[pa.RecordBatch], groups: list[str], score: str, ident: str, n: int, rank: str) -> Iterator[pa.RecordBatch]:
    """Heaps of rows sorted by group, merged as they come: kept are a buffer and the heap of the group that may go on."""
    state, waiting, rows = None, [], 0

    def settle(last: bool) -> Iterator[pa.RecordBatch]:
        nonlocal state, waiting, rows
        t = pa.concat_tables(([state] if state is not None else []) + waiting)
        state, waiting, rows = None, [], 0
        if not t.num_rows:
            return
        g = _codes(t, groups)
        going = np.zeros(len(g), dtype=bool) if last else g == g[-1]
        yield from merge_heaps(t.filter(pa.array(~going)), groups, score, ident, n, rank).to_batches(max_chunksize=20_000)
        if not last:
            state = merge_heaps(t.filter(pa.array(going)), groups, score, ident, n)

    for b in batches:
        waiting.append(pa.Table.from_batches([b]))
        rows += b.num_rows
        if rows >= BUFFER_ROWS:
            yield from settle(False)
    if waiting or state is not None:
        yield from settle(True)


def top_n(df: DataFrame, groups: list[str], score: str, ident: str, n: int, rank: str = "rank") -> DataFrame:
    """``groups + [ident, score, rank]``: the ``n`` distinct ``ident`` with the highest ``score`` of each group.

    Each task keeps a heap of at most ``n`` items per group over its own rows, before anything is shuffled, so a group
    of any size sends at most ``n`` rows per task; after the shuffle the heaps of a group are merged as they come, never more than
    a buffer and one heap at a time. Equal scores: smaller ``ident``
    first. An ``ident`` that comes several times counts once, with its best score. Rows with NULL or NaN ``score`` or NULL
    ``ident`` do not take part; NULL group values form a group of their own. Fewer than ``n`` items: all. Other columns of
    ``df`` are ignored, whatever their names. Exact for every input; an empty table gives none.
    """
    if n < 1:
        raise ValueError("n must be at least 1")
    cols = [*groups, ident, score]
    slim = df.select(*cols).where(F.col(score).isNotNull() & ~F.isnan(F.col(score).cast("double")) & F.col(ident).isNotNull())

    def heaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, waiting, rows = None, [], 0
        for b in batches:
            waiting.append(pa.Table.from_batches([b]))
            rows += b.num_rows
            if rows >= BUFFER_ROWS:
                state, waiting, rows = merge_heaps(pa.concat_tables(([state] if state else []) + waiting), groups, score, ident, n), [], 0
                if state.num_rows > STATE_ROWS:
                    yield from state.to_batches(max_chunksize=20_000)
                    state = None
        if state or waiting:
            yield from merge_heaps(pa.concat_tables(([state] if state else []) + waiting), groups, score, ident, n).to_batches(max_chunksize=20_000)

    partial = slim.mapInArrow(heaps, slim.schema)
    spread = partial.repartition(*groups).sortWithinPartitions(*groups) if groups else partial.repartition(1)
    schema = T.StructType([*slim.schema.fields, T.StructField(rank, T.IntegerType(), False)])
    return spread.mapInArrow(lambda batches: merge_sorted(batches, groups, score, ident, n, rank), schema).select(*groups, ident, score, rank)
