"""Timestamps written in many formats and zones, brought to one unambiguous instant in UTC."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from loam.operators.lineage import cut

#: English and Ukrainian (genitive and nominative) month names by number.
MONTHS = {
    1: ("january", "jan", "січня", "січень"), 2: ("february", "feb", "лютого", "лютий"), 3: ("march", "mar", "березня", "березень"),
    4: ("april", "apr", "квітня", "квітень"), 5: ("may", "травня", "травень"), 6: ("june", "jun", "червня", "червень"),
    7: ("july", "jul", "липня", "липень"), 8: ("august", "aug", "серпня", "серпень"), 9: ("september", "sep", "sept", "вересня", "вересень"),
    10: ("october", "oct", "жовтня", "жовтень"), 11: ("november", "nov", "листопада", "листопад"), 12: ("december", "dec", "грудня", "грудень"),
}
#: Hours east of UTC of zone abbreviations.
ZONES = {"z": 0, "utc": 0, "gmt": 0, "wet": 0, "west": 1, "bst": 1, "cet": 1, "cest": 2, "eet": 2, "eest": 3, "msk": 3, "est": -5, "edt": -4, "cst": -6, "cdt": -5, "mst": -7, "mdt": -6, "pst": -8, "pdt": -7}
#: Rows of a span at most; partitions whose spans one task combines.
SPAN, FAN = 10_000, 64
#: Penalties of the path, whole numbers so that they add up alike in any order: another format than the record before; a step back in
#: time, and more for each power of ten of its days; and for a later reading of a value, so small that it only decides between paths
#: that are equal otherwise.
SWITCH, BACK, BACK_DECADE, LATER = 10**9, 10**9, 5 * 10**8, 1000

_TIME = r"(\d{1,2}):(\d{2})(?::(\d{2})(?:[.,]\d{1,9})?)?\s*([AaPp]\.?[Mm]\.?)?"
_ZONE = r"\s*([A-Za-z]{1,5}|(?:UTC|GMT)?[+-]\d{1,2}(?::?\d{2})?)?(?:\[[A-Za-z_/+-]+\])?"
#: family: (pattern, group numbers of year, month, day, hour, minute, second, am/pm, zone)
_FAMILIES = {
    "ymd": (rf"^(\d{{4}})([-/.])(\d{{1,2}})\2(\d{{1,2}})(?:(?:[Tt]|,?\s+){_TIME}{_ZONE})?$", (1, 3, 4, 5, 6, 7, 8, 9)),
    "compact": (rf"^(\d{{4}})(\d{{2}})(\d{{2}})(?:[Tt ](\d{{2}})(\d{{2}})(\d{{2}})?(?:[.,]\d{{1,9}})?(){_ZONE})?$", (1, 2, 3, 4, 5, 6, 7, 8)),
    "dotted": (rf"^(\d{{1,2}})\.(\d{{1,2}})\.(\d{{4}})(?:(?:[Tt]|,?\s+){_TIME}{_ZONE})?$", (3, 2, 1, 4, 5, 6, 7, 8)),
    "slashed": (rf"^(\d{{1,2}})([-/])(\d{{1,2}})\2(\d{{4}})(?:(?:[Tt]|,?\s+){_TIME}{_ZONE})?$", (4, 3, 1, 5, 6, 7, 8, 9)),
    "day_name": (rf"^(\d{{1,2}})\.?\s+(\p{{L}}+)\.?,?\s+(\d{{4}})(?:,?\s+{_TIME}{_ZONE})?$", (3, 2, 1, 4, 5, 6, 7, 8)),
    "name_day": (rf"^(\p{{L}}+)\.?\s+(\d{{1,2}}),?\s+(\d{{4}})(?:,?\s+{_TIME}{_ZONE})?$", (3, 1, 2, 4, 5, 6, 7, 8)),
}
#: Readings, by position: the format of an interpretation is one of these numbers.
READINGS = ("ymd", "compact", "dmy", "mdy", "slash_dmy", "slash_mdy", "day_name", "name_day", "epoch_s", "epoch_ms")


def _months() -> Column:
    pairs = [F.lit(x) for n, names in MONTHS.items() for name in names for x in (name, n)]
    return F.create_map(*pairs)


def _seconds_of_day(f: Column) -> Column:
    """Seconds since midnight of the fields hour, minute, second and am/pm, NULL if there is no such time."""
    h, m = f[3].try_cast("int"), f[4].try_cast("int")
    s = F.coalesce(f[5].try_cast("int"), F.lit(0))
    half = F.lower(F.substring(f[6], 1, 1))
    hour = F.when(half == "a", h % 12).when(half == "p", h % 12 + 12).otherwise(h)
    fits = F.when(half.isin("a", "p"), h.between(1, 12)).otherwise(h.between(0, 23))
    return F.when(fits & m.between(0, 59) & s.between(0, 59), hour * 3600 + m * 60 + s)


def _offset(zone: Column) -> Column:
    """Seconds east of UTC a zone text names; NULL if it names none that is known."""
    z = F.lower(zone)
    pairs = [F.lit(x) for k, v in ZONES.items() for x in (k, v * 3600)]
    digits = F.regexp_replace(z, r"^(?:utc|gmt)?([+-])(\d{1,2}):?(\d{2})?$", "$1|$2|$3")
    part = F.split(digits, r"\|")
    hours, minutes = part[1].cast("int"), F.coalesce(F.nullif(part[2], F.lit("")).cast("int"), F.lit(0))
    numeric = F.when((hours <= 14) & (minutes < 60), F.when(part[0] == "-", -1).otherwise(1) * (hours * 3600 + minutes * 60))
    return F.when(z.rlike(r"^(utc|gmt)?[+-]\d{1,2}(:?\d{2})?$"), numeric).otherwise(F.create_map(*pairs)[z])


def interpretations(df: DataFrame, value: str, zone: str, dotted: tuple[str, ...] = ("dmy",), slashed: tuple[str, ...] = ("dmy", "mdy"), epoch_years: tuple[int, int] = (1998, 2024)) -> DataFrame:
    """``df`` with every valid interpretation of the text column ``value``.

    Adds ``formats`` array<int> (positions in READINGS) and ``instants`` array<long> (seconds since 1970 UTC), of equal length
    and without repeats: empty if the value names no instant, two or more if it can be read in several ways or if a local time of
    ``zone`` occurs twice. Also ``day``: the date, if the value is one day without a time. Times without a zone are legal time of
    ``zone``. Dotted and slashed dates are read in the given orders. Numbers of more than eight digits count seconds or
    milliseconds since 1970, whichever fall in ``epoch_years``. All of it runs as column expressions, without Python.
    """
    t = F.trim(F.regexp_replace(F.col(value).cast("string"), r"[\s\u00a0]+", " "))
    fields = F.lit(None).cast("array<string>")
    for name, (pattern, at) in reversed(_FAMILIES.items()):
        order = "|".join([*(f"${i}" for i in at), name])
        fields = F.when(F.col("_t").rlike(pattern), F.split(F.regexp_replace("_t", pattern, order), r"\|")).otherwise(fields)
    out = df.withColumn("_t", t).withColumn("_f", fields)
    f, family = F.col("_f"), F.col("_f")[8]

    def date(month: Column, day: Column) -> Column:
        return F.concat(f[0], F.lit("-"), month, F.lit("-"), day).try_cast("date")

    named = F.coalesce(f[1].try_cast("int"), _months()[F.lower(f[1])]).cast("string")
    choices = []
    for name, orders, prefix in (("dotted", dotted, ""), ("slashed", slashed, "slash_")):
        for o in orders:
            day = date(f[1], f[2]) if o == "dmy" else date(f[2], f[1])
            choices.append(F.struct(F.lit(READINGS.index(prefix + o)).alias("format"), F.when(family == name, day).alias("day")))
    plain = F.coalesce(*[F.when(family == n, READINGS.index(n)) for n in ("ymd", "compact", "day_name", "name_day")])
    choices.append(F.struct(plain.alias("format"), F.when(plain.isNotNull(), date(named, f[2])).alias("day")))
    out = out.withColumn("_days", F.filter(F.array(*choices), lambda x: x["day"].isNotNull()))
    out = out.withColumn("_second", _seconds_of_day(f)).withColumn("_zone", F.nullif(f[7], F.lit("")))
    out = out.withColumn("_east", _offset(F.col("_zone")))

    def local(x: Column) -> Column:
        """Instants of a local time: none in a gap, two where it occurs twice."""
        first = F.unix_seconds(F.to_utc_timestamp(F.timestamp_seconds(x), zone))
        tries = F.array(first - 3600, first - 1800, first, first + 1800, first + 3600)
        return F.filter(tries, lambda u: F.unix_seconds(F.from_utc_timestamp(F.timestamp_seconds(u), zone)) == x)

    def instants(day: Column) -> Column:
        wall = F.unix_date(day).cast("long") * 86400 + F.col("_second")
        return F.when(F.col("_zone").isNull(), local(wall)).when(F.col("_east").isNotNull(), F.array(wall - F.col("_east"))).otherwise(F.array().cast("array<bigint>"))

    pairs = F.flatten(F.transform("_days", lambda x: F.transform(instants(x["day"]), lambda u: F.struct(x["format"].alias("f"), u.alias("u")))))
    number = F.when(F.col("_t").rlike(r"^\d{9,18}$"), F.col("_t").try_cast("bigint"))
    low, high = (int(pd.Timestamp(year=y, month=1, day=1, tz="UTC").timestamp()) for y in (epoch_years[0], epoch_years[1] + 1))
    seconds = F.filter(F.array(F.struct(F.lit(READINGS.index("epoch_s")).alias("f"), number.alias("u")), F.struct(F.lit(READINGS.index("epoch_ms")).alias("f"), F.expr("_number div 1000").alias("u"))), lambda x: (x["u"] >= low) & (x["u"] < high))
    empty = F.array().cast("array<struct<f:int,u:bigint>>")
    out = out.withColumn("_number", number)
    out = out.withColumn("_all", F.coalesce(F.when(F.col("_number").isNotNull(), seconds), F.when(F.col("_second").isNotNull(), pairs), empty))
    out = out.withColumn("_all", F.array_distinct("_all"))
    dates = F.array_distinct(F.transform("_days", lambda x: x["day"]))
    whole_day = F.when(F.col("_f").isNotNull() & (f[3] == "") & (F.size(dates) == 1), dates[0])
    return out.select(*[df[c] for c in df.columns], F.col("_all.f").alias("formats"), F.col("_all.u").alias("instants"), whole_day.alias("day"))


def step_cost(f0: int, u0: int, f1: int, u1: int) -> int:
    """Penalty of reading one record as (f1, u1) after the record before it was read as (f0, u0)."""
    cost = 0 if f0 == f1 else SWITCH
    if u1 < u0:
        cost += BACK + round(BACK_DECADE * math.log10(1 + (u0 - u1) / 86400))
    return cost


def own_cost(ident: int, place: int) -> int:
    """Penalty of taking the reading at a place of a record: more for a later one, and a little by the record, so that hardly two paths are equal."""
    return LATER * place + ((ident % 997) * 331 + (ident // 997 % 991) * 101 + place * 577) % 997 if place else 0


Row = tuple  # ident, formats, instants, and what else is carried along
_FAR = 2**62


def _steps(a: Row, b: Row) -> np.ndarray:
    """Penalties from each reading of a record to each of the next, with that of taking the latter."""
    return np.array([[step_cost(a[1][i], a[2][i], b[1][j], b[2][j]) + (own_cost(b[0], j) if len(b[1]) > 1 else 0) for j in range(len(b[1]))] for i in range(len(a[1]))], dtype=np.int64)


def _forward(rows: list[Row], start: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Least costs of the last row's readings from start costs of the first row's, and the best predecessors of each row."""
    cost, back = start, []
    for a, b in zip(rows, rows[1:]):
        table = np.minimum(cost[:, None], _FAR - 2**40) + _steps(a, b)
        best = table.argmin(0)
        back.append(best)
        cost = table[best, np.arange(len(b[1]))]
    return cost, back


def _only(n: int, i: int) -> np.ndarray:
    return np.where(np.arange(n) == i, 0, _FAR)


def span_matrix(rows: list[Row]) -> np.ndarray:
    """Least cost from each reading of the first row to each of the last, up to a constant: what a span is to its neighbours."""
    n = np.array([len(r[1]) for r in rows])
    fixed = np.flatnonzero(n == 1)
    if not len(fixed):
        m = np.array([_forward(rows, _only(n[0], i))[0] for i in range(n[0])])
    else:
        head = rows[: fixed[0] + 1]
        enter = np.array([_forward(head, _only(n[0], i))[0][0] for i in range(n[0])])
        m = enter[:, None] + _forward(rows[fixed[-1] :], np.zeros(1, dtype=np.int64))[0][None, :]
    return m - m.min()


def span_path(rows: list[Row], enter: int, leave: int) -> np.ndarray:
    """The reading of every row on the least path of a span between given readings of its first and last row."""
    n = np.array([len(r[1]) for r in rows])
    path = np.zeros(len(rows), dtype=np.int64)
    many = np.flatnonzero(n > 1)
    cuts = np.flatnonzero(np.diff(many) > 1)
    for a, b in zip(many[np.r_[0, cuts + 1]], many[np.r_[cuts, len(many) - 1]]) if len(many) else ():
        lo, hi = max(a - 1, 0), min(b + 1, len(rows) - 1)
        cost, back = _forward(rows[lo : hi + 1], _only(n[0], enter) if lo == 0 else np.zeros(n[lo], dtype=np.int64))
        at = leave if hi == len(rows) - 1 else int(cost.argmin())
        for k in range(hi, lo, -1):
            path[k] = at
            at = int(back[k - lo - 1][at])
        path[lo] = at
    return path


#: A span to its neighbours: matrix, first row, last row.
Span = tuple[np.ndarray, Row, Row]


def join_spans(a: Span, b: Span) -> Span:
    """Two spans one after the other as one."""
    middle = (a[0][:, :, None] + _steps(a[2], b[1])[None]).min(1)
    m = (middle[:, :, None] + b[0][None]).min(1)
    return m - m.min(), a[1], b[2]


def chain_path(spans: list[Span], enter: int | None = None, leave: int | None = None) -> list[tuple[int, int]]:
    """Entry and exit readings of each span of a chain on its least path; the first and the last may be given."""
    first = spans[0][1]
    cost = np.array([own_cost(first[0], j) if len(first[1]) > 1 else 0 for j in range(len(first[1]))], dtype=np.int64) if enter is None else _only(len(first[1]), enter)
    back = []
    for k, (m, _, _) in enumerate(spans):
        before = np.zeros(len(cost), dtype=np.int64)
        if k:
            table = np.minimum(cost[:, None], _FAR - 2**40) + _steps(spans[k - 1][2], spans[k][1])
            before, cost = table.argmin(0), table.min(0)
        through = np.minimum(cost[:, None], _FAR - 2**50) + m
        back.append((before, through.argmin(0)))
        cost = through.min(0)
        cost = cost - cost.min()
    out, at = [], int(cost.argmin()) if leave is None else leave
    for before, entered in reversed(back):
        start = int(entered[at])
        out.append((start, at))
        at = int(before[start])
    return out[::-1]


_NODE = "source {k}, id bigint, at bigint, m array<bigint>, fi bigint, ff array<int>, fu array<bigint>, li bigint, lf array<int>, lu array<bigint>"


def _span_of(r: tuple) -> Span:
    first, last = (r.fi, list(r.ff), list(r.fu)), (r.li, list(r.lf), list(r.lu))
    return np.array(r.m, dtype=np.int64).reshape(len(first[1]), len(last[1])), first, last


def _node(source: object, ident: int, at: int, span: Span) -> tuple:
    m, first, last = span
    return source, ident, at, m.ravel().tolist(), *first[:3], *last[:3]


def cut_spans(batches: Iterator[pa.RecordBatch], part: int, size: int) -> Iterator[tuple[object, int, list[Row]]]:
    """(source, number, rows) of spans of a partition of (source, ident, value, formats, instants) sorted by source and ident.

    Rows of one reading between two such rows decide nothing: most of them are left out, without being looked at.
    """
    number, source, seen, held = part << 32, None, 0, []
    for b in batches:
        if not b.num_rows:
            continue
        names, n = b.column(0), pc.list_value_length(b.column(3)).to_numpy(zero_copy_only=False)
        code = pc.dictionary_encode(names, null_encoding="encode").indices.to_numpy(zero_copy_only=False)
        at = 0
        for end in [*(np.flatnonzero(np.diff(code)) + 1).tolist(), b.num_rows]:
            name = names[at].as_py()
            while at < end:
                if seen and (name != source or seen >= size):
                    yield source, number, held
                    number, seen, held = number + 1, 0, []
                source, stop = name, min(end, at + size - seen)
                many = n[at:stop] > 1
                near = many | np.r_[many[1:], True] | np.r_[True, many[:-1]]
                t = b.take(pa.array(np.flatnonzero(near) + at))
                held += zip(t.column(1).to_pylist(), t.column(3).to_pylist(), t.column(4).to_pylist(), t.column(2).to_pylist())
                seen += stop - at
                at = stop
    if seen:
        yield source, number, held


def normalise_timestamps(df: DataFrame, ident: str, source: str, value: str, zone: str, span: int = SPAN, fan: int = FAN, **reading) -> DataFrame:
    """``(ident, source, value, status, utc_second, format, n_instants, day)``: one row per row of ``df``.

    Method: all valid interpretations of each value as arrays (``interpretations``); per ``source``, in the order of the long
    ``ident``, the least path through them (Viterbi), where switching formats and stepping back in time cost, and of paths that
    are equal in this the one with earlier readings is taken. Rows are range-partitioned by source and ident and cut into spans of
    at most ``span`` rows, so that a source of any size is many tasks however its idents are spread. Each span gives the costs between the
    readings of its first and last row; these small matrices are multiplied in a tree of ``fan`` partitions a node, so no task
    sees all spans of a source; entries and exits come down the tree, and the spans then choose in parallel. Costs are whole
    numbers: the result is the exact least path however it is cut. Values of one reading never leave the JVM, but for neighbours.

    status: ``instant`` (one possible instant), ``chosen`` (several, settled by the path; ``n_instants`` tells how many), ``day``
    (one date without a time), ``none`` (NULL, blank, ranges, impossible or other text); ``utc_second`` and ``format`` are NULL for
    the last two. A NULL source is a source of its own. ``ident`` must be unique and not NULL; rows with NULL ident come out with
    status by their own value and, if ambiguous, their earliest reading. Other columns of ``df`` are ignored. Empty table: no rows.
    """
    slim = df.select(F.col(ident).cast("bigint").alias("ident"), F.col(source).alias("source"), F.col(value).alias("value"))
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    read = interpretations(slim, "value", zone, **reading)
    order = F.array_sort(F.arrays_zip("instants", "formats"))
    read = read.withColumn("_z", order).withColumn("instants", F.col("_z.instants")).withColumn("formats", F.col("_z.formats")).drop("_z")
    read = cut(read.repartitionByRange(parts, "source", "ident").sortWithinPartitions("source", "ident", "value"))
    chain = read.where("size(instants) > 0 and ident is not null").select("source", "ident", "value", "formats", "instants")
    kind = slim.schema["source"].dataType.simpleString()

    def spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        for name, number, rows in cut_spans(batches, part, span):
            many = [len(r[1]) > 1 for r in rows]
            open_rows = rows if any(many) else []
            one = (*_node(name, number, part, (span_matrix(rows), rows[0], rows[-1])), *([r[i] for r in open_rows] for i in range(4)))
            yield pa.RecordBatch.from_arrays([pa.array([c], t.type) for c, t in zip(one, schema)], schema=schema)

    node = _NODE.format(k=kind)
    full = node + ", ids array<bigint>, fs array<array<int>>, us array<array<bigint>>, vs array<string>"
    schema = to_arrow_schema(df.sparkSession.createDataFrame([], full).schema)
    made = cut(chain.mapInArrow(spans, full))
    columns = [c.split()[0] for c in node.split(", ")]
    levels = [made.select(*columns)]
    width = parts

    def product(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = list(pdf.sort_values("id").itertuples())
        whole = _span_of(rows[0])
        for r in rows[1:]:
            whole = join_spans(whole, _span_of(r))
        return pd.DataFrame([_node(rows[0].source, rows[0].id, rows[0].at // fan, whole)], columns=columns)

    while width > fan:
        below = levels[-1]
        levels.append(cut(below.groupBy("source", F.expr(f"at div {fan}")).applyInPandas(product, node)))
        width = -(-width // fan)
    ends = f"source {kind}, id bigint, at bigint, enter int, leave int"

    def along(pdf: pd.DataFrame, enter: int | None = None, leave: int | None = None) -> pd.DataFrame:
        rows = list(pdf.sort_values("id").itertuples())
        path = chain_path([_span_of(r) for r in rows], enter, leave)
        return pd.DataFrame({"source": [r.source for r in rows], "id": [r.id for r in rows], "at": [r.at for r in rows], "enter": [a for a, _ in path], "leave": [b for _, b in path]})

    def inside(pdf: pd.DataFrame, over: pd.DataFrame) -> pd.DataFrame:
        return along(pdf, int(over["enter"].iloc[0]), int(over["leave"].iloc[0]))

    state = levels[-1].groupBy("source").applyInPandas(lambda pdf: along(pdf), ends)
    for below in reversed(levels[:-1]):
        state = below.groupBy("source", F.expr(f"at div {fan}")).cogroup(state.groupBy("source", "at")).applyInPandas(inside, ends)

    def choose(pdf: pd.DataFrame) -> pd.DataFrame:
        got = []
        for r in pdf.itertuples():  # one row: a span
            rows = [(i, list(f), list(u), v) for i, f, u, v in zip(r.ids, r.fs, r.us, r.vs)]
            path = span_path(rows, int(r.enter), int(r.leave))
            got += [(i, r.source, v, u[p], f[p], len(set(u))) for (i, f, u, v), p in zip(rows, path) if len(f) > 1]
        return pd.DataFrame(got, columns=["ident", "source", "value", "utc_second", "format", "n_instants"])

    open_ = made.where("size(ids) > 0").select("id", "ids", "fs", "us", "vs").join(state.select("id", "source", "enter", "leave"), "id")
    chosen = open_.groupBy("id").applyInPandas(choose, f"ident bigint, source {kind}, value string, utc_second bigint, format int, n_instants int")
    readings = F.array(*map(F.lit, READINGS))
    chosen = chosen.select("ident", "source", "value", F.when(F.col("n_instants") == 1, "instant").otherwise("chosen").alias("status"), "utc_second", F.get(readings, F.col("format")).alias("format"), "n_instants", F.lit(None).cast("date").alias("day"))
    rest = read.where("size(instants) <= 1 or ident is null").select(
        "ident", "source", "value",
        F.expr("case when size(instants) > 0 then if(size(array_distinct(instants)) = 1, 'instant', 'chosen') when day is not null then 'day' else 'none' end").alias("status"),
        F.when(F.size("instants") > 0, F.get("instants", F.lit(0))).alias("utc_second"), F.when(F.size("formats") > 0, F.get(readings, F.get("formats", F.lit(0)))).alias("format"), F.size(F.array_distinct("instants")).alias("n_instants"), "day",
    )
    return chosen.unionByName(rest)
