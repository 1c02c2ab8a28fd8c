"""Best representative of each duplicate group by skyline layers."""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loam.operators.components import connected_components
from loam.operators.lineage import cut

#: Texts that only say a value or a person is unknown (letters folded to lower case, outer blanks and full stops removed).
UNKNOWN = (
    "", "-", "--", "?", "na", "n/a", "n.a", "null", "none", "nil", "nan", "unknown", "unspecified", "anonymous", "anon", "not recorded", "not stated", "not given", "not known", "no data",
    "observer not stated", "observer unknown", "collector unknown", "unknown observer", "unknown collector", "<na>", "невідомо", "невідомий", "немає даних", "не вказано", "анонім", "s.n", "nobody", "missing",
)
#: Dominance layers that are peeled one by one; groups with a field found in none of them get the layer of each entry.
LAYERS = 4


def filled(value: Column) -> Column:
    """Whether a value says something: not NULL, not blank, not a word for unknown. Numbers: not NULL and not NaN."""
    text = F.regexp_replace(F.lower(F.trim(F.regexp_replace(value.cast("string"), r"[\s ]+", " "))), r"\.+$", "")
    return F.coalesce(~text.isin(*UNKNOWN), F.lit(False))


def duplicate_groups(rows: DataFrame, ident: str, links: list[Column]) -> DataFrame:
    """``(ident, group, group_size)`` for all rows: rows that share a non-NULL link value, directly or through others, have one group.

    Links are texts; ``group`` is a text, NULL with size NULL for a row without any link. Only values that bring different first links together become edges.
    """
    first = F.coalesce(*[F.when(x.isNotNull(), F.concat(F.lit(f"{i}:"), x)) for i, x in enumerate(links)])
    tagged = rows.select(F.col(ident).alias("_id"), first.alias("_first"), *[F.when(x.isNotNull(), F.concat(F.lit(f"{i}:"), x)).alias(f"_l{i}") for i, x in enumerate(links)])
    # rows of one value of a further link meet at the smallest first link among them; values with one first link need no edge
    edges = None
    for i in range(1, len(links)):
        other = tagged.where(F.col(f"_l{i}").isNotNull()).select("_first", F.col(f"_l{i}").alias("_other"))
        shared = other.groupBy("_other").agg(F.min("_first").alias("_low"), F.max("_first").alias("_high")).where("_low <> _high").select("_other", "_low")
        e = other.join(shared, "_other").select("_first", "_low")
        edges = e if edges is None else edges.union(e)
    grouped = tagged.select("_id", F.col("_first").alias("group"))
    if edges is not None:
        found = connected_components(edges, "_first", "_low")
        grouped = tagged.join(found, tagged["_first"] == found["node"], "left").select("_id", F.coalesce("component", "_first").alias("group"))
    grouped = cut(grouped)
    sizes = grouped.where("group is not null").groupBy("group").agg(F.count("*").alias("group_size"))
    return grouped.join(sizes, "group", "left").select(F.col("_id").alias(ident), "group", "group_size")


Kind = tuple[int, int]  # completeness, trust
_NONE = -(2**40)


def _beaten_by(kinds: list[Kind]) -> list[list[int]]:
    """Of each kind, the kinds of at least its completeness and trust, itself included."""
    return [[j for j, (c2, t2) in enumerate(kinds) if c2 >= c and t2 >= t] for c, t in kinds]


def layers_from(deepest: list[int], entries: Iterable[int], beaten: list[list[int]]) -> list[int]:
    """The dominance layers, from 1, of entries given by their kinds, newest first (of equal recency the better first), after entries
    whose deepest layers by kind are ``deepest`` (0: none), which is brought up to date.

    What beats an entry comes before it, so its layer is one more than the deepest layer so far of a kind at least as good.
    """
    out = []
    for k in entries:
        deepest[k] = 1 + max(deepest[j] for j in beaten[k])
        out.append(deepest[k])
    return out


def span_gain(entries: Iterable[int], beaten: list[list[int]]) -> np.ndarray:
    """What a run of entries does to the deepest layers by kind, whatever these were: a matrix of gains, over maximum and sum. The last place stands for layer 0."""
    n = len(beaten)
    gain = np.full((n + 1, n + 1), _NONE, dtype=np.int64)
    np.fill_diagonal(gain, 0)
    for k in entries:
        gain[k] = 1 + gain[[*beaten[k], n]].max(0)
    return np.maximum(gain, _NONE)


def _fill_deep(out: DataFrame, entries: DataFrame, n: int) -> DataFrame:
    """``out`` with values it lacks from the least dominance layer that holds them, of the ``entries`` of its groups.

    Entries are range-partitioned by group and recency, so a group of any size is many tasks. Each task gives what its entries do to
    the deepest layers by kind (``span_gain``); per group these few numbers a task are put together in order, and the tasks then number
    their entries in parallel. Exact, however deep.
    """
    old, micros = F.col("_r").isNull().alias("old"), (-F.unix_micros(F.col("_r").cast("timestamp"))).alias("micros")
    order = ["_g", "old", "micros", F.desc("_c"), F.desc("_t")]
    slim = entries.select("_g", "_c", "_t", "_id", old, micros)
    parts = int(entries.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = cut(slim.repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id()))
    # kinds of entries: at most one per completeness and level of trust
    kinds = sorted((r["_c"], r["_t"]) for r in placed.select("_c", "_t").distinct().collect())
    number, beaten = {k: i for i, k in enumerate(kinds)}, _beaten_by(kinds)
    g = slim.schema["_g"].dataType.simpleString()

    def ordered(pdf: pd.DataFrame) -> tuple[pd.DataFrame, list[int]]:
        pdf = pdf.sort_values(["old", "micros", "_c", "_t"], ascending=[True, True, False, False], kind="stable")
        return pdf, [number[k] for k in zip(pdf["_c"].tolist(), pdf["_t"].tolist())]

    def gains(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"_g": pdf["_g"].iloc[:1].tolist(), "_part": pdf["_part"].iloc[:1].tolist(), "m": [span_gain(ordered(pdf)[1], beaten).ravel().tolist()]})

    def starts(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_part")
        state, before = np.append(np.full(len(kinds), _NONE, dtype=np.int64), 0), []
        for m in pdf["m"]:
            before.append(np.maximum(state[:-1], 0).tolist())
            state = (np.array(m).reshape(len(state), -1) + state).max(1)
        return pd.DataFrame({"_g": pdf["_g"].tolist(), "_part": pdf["_part"].tolist(), "deepest": before})

    def layers(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        pdf, run = ordered(left)
        return pd.DataFrame({"_g": pdf["_g"].tolist(), "_id": pdf["_id"].tolist(), "_layer": layers_from(list(right["deepest"].iloc[0]), run, beaten)})

    done = placed.groupBy("_g", "_part").applyInPandas(gains, f"_g {g}, _part int, m array<bigint>")
    state = done.groupBy("_g").applyInPandas(starts, f"_g {g}, _part int, deepest array<bigint>")
    kind = slim.schema["_id"].dataType.simpleString()
    numbered = placed.groupBy("_g", "_part").cogroup(state.groupBy("_g", "_part")).applyInPandas(layers, f"_g {g}, _id {kind}, _layer bigint")
    numbered = entries.join(numbered.withColumnsRenamed({"_g": "_h", "_id": "_j"}), (F.col("_g") == F.col("_h")) & (F.col("_id") == F.col("_j")))
    # within a layer completeness comes before recency
    rank = F.struct("_layer", (-F.col("_c")).alias("c"), old, micros, (-F.col("_t")).alias("t"), F.col("_id").alias("id"))
    found = numbered.groupBy("_g").agg(*[F.min_by(F.col(f"_v{i}"), F.when(F.col(f"_v{i}").isNotNull(), rank)).alias(f"_d{i}") for i in range(n)])
    return out.join(found, "_g", "left").withColumns({f"_v{i}": F.coalesce(f"_v{i}", f"_d{i}") for i in range(n)})


def survivors(rows: DataFrame, group: str, ident: str, fields: list[str], recency: str, trust: Column | None = None, layers: int = LAYERS, size: str | None = None) -> DataFrame:
    """``(group, first_id, n_rows, survivor_id, completeness, recency, trust, fields...)``: one row per non-NULL group.

    Method: rows of a group are compared by completeness (number of filled ``fields``), ``recency`` (NULL is oldest) and ``trust``
    (a small integer, higher is better; default 0). The skyline is the rows no other row beats or equals in all and beats in one.
    ``survivor_id`` is the skyline row first by completeness, then recency, trust and smallest ``ident``. Each field of the result is
    the survivor's, or where that is not filled, the best filled value of the next dominance layer (the skyline after the layers
    before are removed) in the same order; it is NULL only if no row of the group fills it.

    Scale: before anything is compared, rows are aggregated to one entry per (group, completeness, trust, recency), and of each
    (group, completeness, trust) only the ``layers`` most recent entries can be in the first ``layers`` layers; so a group of any
    size becomes a few bounded entries, before and in the shuffle. Only groups with a filled field in none of these layers go on:
    their entries get their layers in parallel (``_fill_deep``), and the field comes from the least layer of its holders, however deep. Where a column ``size`` tells the rows of
    the group, rows alone in theirs are taken as they are, without a shuffle. ``ident`` must be unique. Values are taken
    as they are, blanks included; unfilled ones count as missing. An empty table gives no rows.
    """
    full = [filled(F.col(c)) for c in fields]
    value = {c: F.when(f, F.col(c)) for c, f in zip(fields, full)}
    single = None
    if size is not None:
        alone = rows.where(F.col(group).isNotNull() & (F.col(size) == 1))
        level = (trust if trust is not None else F.lit(0)).cast("int")
        single = alone.select(
            F.col(group).alias("group"), F.col(ident).alias("first_id"), F.lit(1).cast("bigint").alias("n_rows"), F.col(ident).alias("survivor_id"), sum((f.cast("int") for f in full), F.lit(0)).alias("completeness"),
            F.coalesce(level, F.lit(0)).alias("trust"), F.col(recency).alias("newest"), *[v.alias(c) for c, v in value.items()],
        )
        rows = rows.where(F.col(size) > 1)
    r = rows.where(F.col(group).isNotNull()).select(
        F.col(group).alias("_g"), F.col(ident).alias("_id"), F.col(recency).alias("_r"), (trust if trust is not None else F.lit(0)).cast("int").alias("_t"),
        sum((f.cast("int") for f in full), F.lit(0)).alias("_c"), *[v.alias(f"_v{i}") for i, v in enumerate(value.values())],
    ).fillna(0, ["_t"])
    values = [F.col(f"_v{i}") for i in range(len(fields))]
    entries = r.groupBy("_g", "_c", "_t", "_r").agg(F.min("_id").alias("_id"), F.count("*").alias("_n"), *[F.min_by(v, F.when(v.isNotNull(), F.col("_id"))).alias(f"_v{i}") for i, v in enumerate(values)])
    entries = cut(entries)
    size = entries.groupBy("_g").agg(F.sum("_n").alias("n_rows"), F.min("_id").alias("first_id"))
    w = Window.partitionBy("_g", "_c", "_t").orderBy(F.desc_nulls_last("_r"))
    kept = entries.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= layers)
    # comparable, never NULL recency: (has one, value)
    entry = F.struct((-F.col("_c")).alias("c"), F.col("_r").isNull().alias("old"), (-F.unix_micros(F.col("_r").cast("timestamp"))).alias("r"), (-F.col("_t")).alias("t"), F.col("_id").alias("id"), F.struct(*[F.col(f"_v{i}").alias(f"v{i}") for i in range(len(fields))]).alias("v"))
    packed = kept.groupBy("_g").agg(F.array_sort(F.collect_list(entry)).alias("rest"))

    def beats(q: Column, p: Column) -> Column:
        """q is at least as good as p everywhere and better somewhere; entries hold negated values, so less is better."""
        newer = (~q["old"] & p["old"]) | F.coalesce(q["r"] < p["r"], F.lit(False))
        same = (q["old"] == p["old"]) & q["r"].eqNullSafe(p["r"])
        return (q["c"] <= p["c"]) & (newer | same) & (q["t"] <= p["t"]) & ((q["c"] < p["c"]) | newer | (q["t"] < p["t"]))

    for k in range(layers):
        rest = F.col("rest")
        packed = packed.withColumn(f"layer{k}", F.filter(rest, lambda p: ~F.exists(F.col("rest"), lambda q: beats(q, p))))
        packed = packed.withColumn("rest", F.filter(rest, lambda p: F.exists(F.col("rest"), lambda q: beats(q, p))))
    order = F.concat(*[F.col(f"layer{k}") for k in range(layers)])
    packed = packed.withColumn("all", order).withColumn("best", F.col("layer0")[0])
    picked = packed.select("_g", F.col("best.id").alias("survivor_id"), (-F.col("best.c")).alias("completeness"), (-F.col("best.t")).alias("trust"), *[F.get(F.filter(F.col(f"all.v.v{i}"), lambda v: v.isNotNull()), F.lit(0)).alias(f"_v{i}") for i in range(len(fields))])
    held = entries.groupBy("_g").agg(*[F.count(f"_v{i}").alias(f"_h{i}") for i in range(len(fields))], F.max("_r").alias("_newest"))
    out = cut(picked.join(held, "_g").join(size, "_g"))
    deep = out.where(F.exists(F.array(*[F.col(f"_v{i}").isNull() & (F.col(f"_h{i}") > 0) for i in range(len(fields))]), lambda x: x)) if fields else out.where("false")
    if not deep.isEmpty():
        of_deep = cut(entries.join(deep.select("_g"), "_g", "left_semi"))
        out = _fill_deep(out, of_deep, len(fields))
    out = out.select(F.col("_g").alias("group"), "first_id", "n_rows", "survivor_id", "completeness", "trust", F.col("_newest").alias("newest"), *[F.col(f"_v{i}").alias(c) for i, c in enumerate(fields)])
    return out if single is None else out.unionByName(single)
