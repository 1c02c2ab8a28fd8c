"""Train, validation and test splits that keep related records together."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loam.operators.components import connected_components
from loam.operators.lineage import cut

#: Components that one annealing task holds, chains that anneal side by side, rounds between which chains learn their new totals.
BLOCK_COMPONENTS, CHAINS, ROUNDS, STEPS = 4_000, 6, 2, 6_000
#: Wanted shares.
SPLITS = {"train": 0.8, "validation": 0.1, "test": 0.1}


def linked_records(records: DataFrame, key: str, links: list[str]) -> DataFrame:
    """``records`` with ``component``: equal for records that share a ``key`` or a non-NULL value of a link column, directly or through others.

    ``component`` is a text naming the smallest link of the component (column number and value), or the key of a record
    that has no link. Repeated rows stay rows. A NULL key links nothing. Hot values are only aggregated, never joined pairwise.
    """
    node = [F.when(F.col(c).isNotNull(), F.concat(F.lit(f"{i}:"), F.col(c).cast("string"))) for i, c in enumerate(links)]
    first = F.coalesce(*node) if node else F.lit(None).cast("string")
    own = F.concat(F.lit("k:"), F.coalesce(F.col(key).cast("string"), F.lit("")))
    r = records.withColumn("_first", first)
    edges = [r.select("_first", n.alias("_other")).where("_other is not null and _other <> _first").distinct() for n in node[1:]]
    per_key = r.where(F.col("_first").isNotNull() & F.col(key).isNotNull()).groupBy(F.col(key).alias("_k")).agg(F.min("_first").alias("_low"), F.max("_first").alias("_high")).where("_low <> _high").select("_k", "_low")
    edges.append(r.join(per_key, r[key] == per_key["_k"]).select("_first", F.col("_low").alias("_other")).where("_first <> _other").distinct())
    every = edges[0]
    for e in edges[1:]:
        every = every.union(e)
    found = connected_components(every, "_first", "_other")
    # a record without a link takes the component of the other rows of its key, if these have one
    lone = r.where("_first is null").groupBy(F.col(key).alias("_k")).agg(F.count("*").alias("_n"))
    lone = r.where("_first is not null").join(lone, r[key] == lone["_k"], "left_semi").groupBy(F.col(key).alias("_k")).agg(F.min("_first").alias("_borrowed"))
    r = r.join(lone, r[key] == lone["_k"], "left").withColumn("_first", F.coalesce("_first", "_borrowed")).drop("_k", "_borrowed")
    found = found.select(F.col("node").alias("_node"), F.col("component").alias("_component"))
    out = r.join(found, r["_first"] == found["_node"], "left")
    return out.withColumn("component", F.coalesce("_component", "_first", own)).drop("_first", "_node", "_component")


def cost_of(totals: np.ndarray, target: np.ndarray) -> float:
    """Squared relative deviation of split sizes (first column) and of the label mix (other columns, together as heavy as size)."""
    size = ((totals[:, 0] - target[:, 0]) ** 2).sum() / max(1.0, target[:, 0].sum()) ** 2
    labels = ((totals[:, 1:] - target[:, 1:]) ** 2 / np.maximum(1.0, target[:, 1:].sum(0)) ** 2).sum() / max(1, totals.shape[1] - 1)
    return float(size + labels)


def anneal(counts: np.ndarray, split: np.ndarray, target: np.ndarray, steps: int, seed: int) -> np.ndarray:
    """Moves single components to another split or exchanges two, at falling temperature; the best assignment seen.

    counts: components x (size, labels...); target: splits x (size, labels...) for these components.
    """
    rng = np.random.default_rng(seed)
    n, k = len(split), len(target)
    if n == 0 or k < 2:
        return split
    totals = np.zeros(target.shape)
    np.add.at(totals, split, counts)
    now = best = cost_of(totals, target)
    split, kept = split.copy(), split.copy()
    heat = max(now, 1e-9) / 4
    draws = rng.random((steps, 4))
    for t in range(steps):
        a = int(draws[t, 0] * n)
        if n > 1 and draws[t, 1] < 0.4:
            b = int(draws[t, 2] * n)
            if split[a] == split[b]:
                continue
            d = counts[b] - counts[a]
            trial = totals.copy()
            trial[split[a]] += d
            trial[split[b]] -= d
            change = (a, split[b], b, split[a])
        else:
            s = (split[a] + 1 + int(draws[t, 2] * (k - 1))) % k
            trial = totals.copy()
            trial[split[a]] -= counts[a]
            trial[s] += counts[a]
            change = (a, s)
        c = cost_of(trial, target)
        temperature = heat * math.exp(-8 * t / steps)
        if c <= now or draws[t, 3] < math.exp((now - c) / temperature):
            totals, now = trial, c
            for i, s in zip(change[::2], change[1::2]):
                split[i] = s
            if now < best:
                best, kept = now, split.copy()
    return kept


def hashed_start(component: Column, chain: Column, splits: dict[str, float], seed: int) -> Column:
    """Number of the split in which the hash of a component puts it in a chain, before any annealing."""
    shares = np.array(list(splits.values()), dtype=float)
    upto = np.cumsum(shares / shares.sum())
    u = F.pmod(F.xxhash64(component, chain, F.lit(seed + 1)), F.lit(2**30)) / 2**30
    start = F.lit(len(splits) - 1)
    for i in range(len(splits) - 2, -1, -1):
        start = F.when(u < float(upto[i]), i).otherwise(start)
    return start


def deviation(records: DataFrame, split: Column, label: str | None, splits: dict[str, float]) -> float:
    """``cost_of`` of an assignment of records to splits by number: how far sizes and labels are from the wanted shares."""
    value = F.coalesce(F.col(label).cast("string"), F.lit("\0")) if label else F.lit("")
    rows = records.groupBy(split.alias("s"), value.alias("v")).agg(F.count("*").alias("n")).collect()
    labels = {v: i for i, v in enumerate(sorted({r["v"] for r in rows}))}
    totals = np.zeros((len(splits), 1 + len(labels)))
    for r in rows:
        totals[r["s"], [0, 1 + labels[r["v"]]]] += r["n"]
    shares = np.array(list(splits.values()), dtype=float)
    return cost_of(totals, np.outer(shares / shares.sum(), totals.sum(0)))


def assign_splits(
    records: DataFrame, key: str, links: list[str], label: str | None = None, splits: dict[str, float] | None = None, seed: int = 0,
    chains: int = CHAINS, rounds: int = ROUNDS, steps: int = STEPS, block: int = BLOCK_COMPONENTS,
) -> DataFrame:
    """``records`` with ``component`` and ``split``; no component is in two splits.

    Method: every component starts in the split its hash falls in. ``chains`` independent annealings, each over blocks of at
    most about ``block`` components in parallel tasks, move and exchange whole components to bring the splits' sizes and the
    share of each ``label`` value towards the wanted shares; between ``rounds`` each block takes its part of what its whole
    chain still lacks. The chain with the least deviation is kept. Only totals by chain, split and label value reach the driver;
    ``label`` must be a category with few values (NULL is one). Components larger than a split make exact shares impossible:
    they stay whole all the same. Deterministic for a ``seed``. Empty table: no rows. Existing columns named ``component`` or
    ``split`` are replaced.
    """
    splits = splits or SPLITS
    names, shares = list(splits), np.array(list(splits.values()), dtype=float)
    shares /= shares.sum()
    linked = cut(linked_records(records.drop("component", "split"), key, links))
    value = F.coalesce(F.col(label).cast("string"), F.lit("\0")) if label else F.lit("")
    parts = linked.groupBy("component", value.alias("label")).agg(F.count("*").alias("n"))
    totals = parts.groupBy("label").agg(F.sum("n").alias("n")).orderBy("label").collect()
    labels = {r["label"]: i for i, r in enumerate(totals)}
    whole = np.array([r["n"] for r in totals], dtype=float)
    target = np.outer(shares, np.r_[whole.sum(), whole]) if len(whole) else np.zeros((len(names), 1))
    table = parts.groupBy("component").agg(F.map_from_entries(F.collect_list(F.struct("label", "n"))).alias("counts"))
    table = cut(table.withColumn("h", F.xxhash64("component", F.lit(seed))))
    blocks = max(1, math.ceil(table.count() / block))
    start = hashed_start(F.col("component"), F.col("chain"), splits, seed)
    state = table.withColumn("chain", F.explode(F.sequence(F.lit(0), F.lit(chains - 1)))).withColumn("split", start.cast("int"))
    schema = "component string, counts map<string,bigint>, h bigint, chain int, split int"

    def sums(df: DataFrame) -> dict[int, np.ndarray]:
        got = {c: np.zeros(target.shape) for c in range(chains)}
        rows = df.select("chain", "split", F.explode("counts").alias("label", "n")).groupBy("chain", "split", "label").agg(F.sum("n").alias("n")).collect()
        for r in rows:
            got[r["chain"]][r["split"], [0, 1 + labels[r["label"]]]] += r["n"]
        return got

    def block_task(now: dict[int, np.ndarray], turn: int):
        def run(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values("component").reset_index(drop=True)
            counts = np.zeros((len(pdf), target.shape[1]))
            for i, m in enumerate(pdf["counts"]):
                for k, n in dict(m).items():
                    counts[i, 1 + labels[k]] = n
            counts[:, 0] = counts.sum(1)
            split, chain = pdf["split"].to_numpy().copy(), int(pdf["chain"].iloc[0])
            own = np.zeros(target.shape)
            np.add.at(own, split, counts)
            seed_here = abs(hash((seed, turn, chain, int(pdf["b"].iloc[0])))) % 2**32
            pdf["split"] = anneal(counts, split, own + (target - now[chain]) / blocks, steps, seed_here).astype("int32")
            return pdf.drop(columns="b")

        return run

    for turn in range(rounds):
        now = sums(state)
        b = F.pmod(F.xxhash64("component", F.lit(turn + 7)), F.lit(blocks)).cast("int")
        state = cut(state.withColumn("b", b).groupBy("chain", "b").applyInPandas(block_task(now, turn), schema))
    final = sums(state)
    best = min(range(chains), key=lambda c: (cost_of(final[c], target), c))
    chosen = state.where(F.col("chain") == best).select("component", F.element_at(F.array(*map(F.lit, names)), F.col("split") + 1).alias("split"))
    return linked.join(chosen, "component", "left").select(*[c for c in linked.columns if c != "component"], "component", "split")
