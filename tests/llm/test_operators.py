"""Training-data operators on small cases with defined results: brute force, ties, NULLs, repeats, empty tables, clashing names."""

from __future__ import annotations

import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from loam.llm import clusters, leakage, mail, names, packing, quality, splits, survivor, topn

LONG = "word " * 60_000


# splits


def _split_rows():
    r = random.Random(1)
    return [(i, r.choice(["a", "b", "c", "d", None]) if i % 3 else f"g{i}", f"p{r.randint(0, 40)}" if r.random() < 0.7 else None, r.randint(2000, 2003)) for i in range(400)]


@pytest.mark.parametrize("local", [True, False])
def test_splits_keep_links_together(spark, monkeypatch, local):
    if not local:
        from loam.operators import components

        monkeypatch.setattr(splits, "connected_components", lambda e, a, b: components.connected_components(e, a, b, local_edges=0))
    rows = [*_split_rows(), (1, "a", "p1", 2000), (None, None, None, None), (None, None, None, None)]
    df = spark.createDataFrame([(*x, "train", 1) for x in rows], "key long, region string, patch string, year int, split string, node int")
    out = splits.assign_splits(df, "key", ["region", "patch"], label="year", chains=2, rounds=1, steps=400, block=50).collect()
    assert len(out) == len(rows) and Counter(r["node"] for r in out) == {1: len(rows)}
    by = defaultdict(set)
    for r in out:
        for k, v in (("r", r["region"]), ("p", r["patch"]), ("k", r["key"])):
            if v is not None:
                by[k, v].add((r["component"], r["split"]))
    assert all(len(v) == 1 for v in by.values())
    assert all(r["split"] in splits.SPLITS for r in out)


def test_splits_meet_shares(spark):
    rows = [(i, f"g{i // 3}", i % 2) for i in range(900)]
    df = spark.createDataFrame(rows, "key long, g string, y int")
    out = splits.assign_splits(df, "key", ["g"], label="y", chains=2, rounds=2, steps=3000)
    n = Counter((r["split"], r["y"]) for r in out.collect())
    for s, share in splits.SPLITS.items():
        assert abs(n[s, 0] + n[s, 1] - 900 * share) <= 12 and abs(n[s, 0] - 450 * share) <= 8
    again = splits.assign_splits(df, "key", ["g"], label="y", chains=2, rounds=2, steps=3000)
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, again.collect()))
    assert splits.assign_splits(df.where("false"), "key", ["g"], label="y").count() == 0


def test_annealing_improves():
    r = np.random.default_rng(0)
    counts = np.c_[np.zeros(60), r.integers(1, 20, (60, 3))]
    counts[:, 0] = counts[:, 1:].sum(1)
    start = r.integers(0, 3, 60)
    target = np.outer([0.8, 0.1, 0.1], counts.sum(0))

    def cost(s):
        t = np.zeros((3, 4))
        np.add.at(t, s, counts)
        return splits.cost_of(t, target)

    assert cost(splits.anneal(counts, start, target, 3000, 1)) < 0.1 * cost(start)


# best representative


def _layers(rows):
    """Dominance layers by definition."""
    left, out = list(rows), []
    while left:
        top = [p for p in left if not any(all(a >= b for a, b in zip(q[1:4], p[1:4])) and q[1:4] != p[1:4] for q in left)]
        out.append(top)
        left = [p for p in left if p not in top]
    return out


def test_survivor_by_layers(spark):
    r = random.Random(3)
    rows = []
    for g in range(30):
        for _ in range(r.randint(1, 9)):
            f = [r.choice(["x", "y", "z", None, "n/a", " "]) for _ in range(3)]
            rows.append((len(rows), f"g{g}", *f, r.choice([None, *range(5)]), r.randint(0, 2)))
    rows.append((len(rows), None, "x", "x", "x", 1, 1))
    df = spark.createDataFrame(rows, "id long, g string, a string, b string, c string, t int, q int").withColumn("seen", F.timestamp_seconds("t"))
    got = {x["group"]: x for x in survivor.survivors(df.withColumn("group", F.lit("clash")), "g", "id", ["a", "b", "c"], "seen", F.col("q")).collect()}
    for g in range(30):
        mine = [x for x in rows if x[1] == f"g{g}"]
        pts = [(x[0], sum(v not in (None, "n/a", " ") for v in x[2:5]), -1 if x[5] is None else x[5], x[6], x) for x in mine]
        layers = _layers(pts)
        order = lambda p: (-p[1], -p[2], -p[3], p[0])
        best = min(layers[0], key=order)
        x = got[f"g{g}"]
        assert (x["survivor_id"], x["first_id"], x["n_rows"]) == (best[0], min(p[0] for p in pts), len(pts))
        for i, c in enumerate("abc"):
            assert x[c] == next((p[4][2 + i] for layer in layers for p in sorted(layer, key=order) if p[4][2 + i] not in (None, "n/a", " ")), None)
    assert len(got) == 30


def test_survivor_deep_fallback(spark):
    """A field that only the oldest of many layers fills is still filled."""
    rows = [(i, "g", "x", None, i) for i in range(1, 12)] + [(0, "g", None, "deep", 0)]
    df = spark.createDataFrame(rows, "id long, g string, a string, b string, t int").withColumn("seen", F.timestamp_seconds("t"))
    x = survivor.survivors(df, "g", "id", ["a", "b"], "seen", layers=2).first()
    assert (x["survivor_id"], x["b"], x["n_rows"]) == (11, "deep", 12)
    assert survivor.survivors(df.where("false"), "g", "id", ["a", "b"], "seen").count() == 0


def test_survivor_deep_layers(spark):
    """Fields whose holders are all below the peeled layers come from the least layer, not from the most complete holder."""
    six, five = dict.fromkeys("abcdef", "x"), dict.fromkeys("abcde", "x")
    rows = [(i, "g", r, {**six}) for i, r in enumerate([40, 38, 36, 34, 32, 30, 28, 26, 24, 22])]
    rows += [(50, "g", 33, {**dict.fromkeys("abcd", "x"), "h": "Y"}), (51, "g", 10, {**five, "h": "X"})]
    r = random.Random(4)
    for g in range(6):
        for i in range(60):
            row = {c: "x" for c in r.sample("abcdef", r.randrange(7))}
            t = r.choice([None, *range(40)])
            if (t is None or t < 12) and len(row) < 4:
                row["h"] = f"h{g}-{i}"
            rows.append((100 * (g + 1) + i, f"r{g}", t, row))
    flat = [(i, g, t, (i * 7) % 3, *[v.get(c) for c in "abcdefh"]) for i, g, t, v in rows]
    df = spark.createDataFrame(flat, "id long, g string, t int, q int, a string, b string, c string, d string, e string, f string, h string").repartition(5).withColumn("seen", F.timestamp_seconds("t"))
    deep = 0
    for trust, level in ((None, lambda x: 0), (F.col("q"), lambda x: x[3])):
        got = {x["group"]: x for x in survivor.survivors(df, "g", "id", list("abcdefh"), "seen", trust).collect()}
        for g in got:
            layers = _layers([(x[0], sum(v is not None for v in x[4:]), -1 if x[2] is None else x[2], level(x), x) for x in flat if x[1] == g])
            held = [k for k, layer in enumerate(layers) if any(p[4][10] for p in layer)]
            deep += held[0] >= survivor.LAYERS
            assert got[g]["h"] == next(p[4][10] for p in sorted(layers[held[0]], key=lambda p: (-p[1], -p[2], -p[3], p[0])) if p[4][10])
        if trust is None:
            assert got["g"]["h"] == "Y"
    assert deep >= 5


def test_layers_of_runs_put_together():
    """Runs of entries in any cut, each numbered from what the runs before it did, against layers by definition."""
    r = random.Random(9)
    kinds = [(c, t) for c in range(4) for t in range(2)]
    beaten = survivor._beaten_by(kinds)
    run = [r.randrange(len(kinds)) for _ in range(60)]
    whole = survivor.layers_from([0] * len(kinds), run, beaten)
    entries = [(i, kinds[k][0], -i, kinds[k][1]) for i, k in enumerate(run)]
    want = {p[0]: n for n, layer in enumerate(_layers(entries), 1) for p in layer}
    assert whole == [want[i] for i in range(60)]
    for size in (1, 7, 25):
        state, got = np.append(np.full(len(kinds), survivor._NONE), 0), []
        for i in range(0, 60, size):
            part = run[i : i + size]
            got += survivor.layers_from(np.maximum(state[:-1], 0).tolist(), part, beaten)
            state = (survivor.span_gain(part, beaten) + state).max(1)
        assert got == whole


def test_duplicate_groups(spark):
    df = spark.createDataFrame([(1, "k", "p"), (2, "k", "q"), (3, "l", "q"), (4, "m", None), (5, None, None), (6, None, "p")], "id long, a string, b string")
    got = {r["id"]: r["group"] for r in survivor.duplicate_groups(df, "id", [F.col("a"), F.col("b")]).collect()}
    assert got[1] == got[2] == got[3] == got[6] and got[4] not in (got[1], None) and got[5] is None


# top n


def _top(rows, n):
    best = defaultdict(dict)
    for g, s, i in rows:
        if s is not None and s == s and i is not None:
            best[g][i] = max(best[g].get(i, -1e9), s)
    return {(g, i, k + 1) for g, m in best.items() for k, (i, _) in enumerate(sorted(m.items(), key=lambda x: (-x[1], x[0]))[:n])}


@pytest.mark.parametrize("buffer", [10, 200_000])
def test_top_n_is_brute_force(spark, monkeypatch, buffer):
    monkeypatch.setattr(topn, "BUFFER_ROWS", buffer)
    r = random.Random(2)
    rows = [(r.choice(["a", "b", None, "hot", "hot", "hot"]), r.choice([None, float("nan"), *[x / 4 for x in range(5)]]), r.choice([None, *range(25)])) for _ in range(600)]
    df = spark.createDataFrame([(*x, 9) for x in rows], "g string, s double, i long, rank int").repartition(5)
    got = topn.top_n(df, ["g"], "s", "i", 4)
    assert {(x["g"], x["i"], x["rank"]) for x in got.collect()} == _top(rows, 4)
    assert topn.top_n(df.where("false"), ["g"], "s", "i", 4).count() == 0
    assert topn.top_n(df, [], "s", "i", 3).count() == 3
    with pytest.raises(ValueError):
        topn.top_n(df, ["g"], "s", "i", 0)


def test_sorted_heaps_merge_within_a_buffer(monkeypatch):
    """Groups over many batches and buffers, one of them larger than the buffer."""
    monkeypatch.setattr(topn, "BUFFER_ROWS", 7)
    r = random.Random(3)
    rows = sorted([(g, r.randint(0, 9) / 2, r.randint(0, 30)) for g in "abcd" for _ in range(60 if g == "b" else 5)])
    t = pa.table(dict(zip(("g", "s", "i"), map(list, zip(*rows)))))
    got = pa.Table.from_batches(topn.merge_sorted(iter(t.to_batches(max_chunksize=3)), ["g"], "s", "i", 4, "rank")).to_pylist()
    assert {(x["g"], x["i"], x["rank"]) for x in got} == _top(rows, 4)


def test_heaps_merge():
    t = pa.table({"g": ["a", "a", "a", None], "s": [1.0, 2.0, 2.0, 3.0], "i": [1, 5, 2, 9]})
    assert topn.merge_heaps(t, ["g"], "s", "i", 2).sort_by("i").to_pydict()["i"] == [2, 5, 9]


# names


def test_parse_names():
    for spelled in ("Larysa Mupirerska", "Dr. Larysa Mupirerska (leg.)", "Лариса Мупірерська"):
        assert names.parse_name(spelled) == [("full", "larysa", "mupirerska", False)]
    assert names.parse_name("MUPIRERSKA, Larysa") == [("full", "larysa", "mupirerska", True)] and names.parse_name("mupirerska larysa") == [("full", "mupirerska", "larysa", False)]
    assert names.parse_name("L. Mupirerska") == names.parse_name("Mupirerska L") == [("short", "mupirerska", "~l", True)]
    assert names.parse_name("Дузевович Я.") == [("short", "duzevovych", "~y", True)] and names.given_fits("~y", "yadviga") and names.given_fits("~kat", "kateryna") and not names.given_fits("~kat", "ka")
    assert names.parse_name("Robert Li")[0] == ("full", "robert", "li", False) and ("short", "robert", "~li", True) in names.parse_name("Robert Li") and names.parse_name("R. Li") == [("short", "li", "~r", True)]
    assert names.parse_name("J. R. Smith") == [("short", "smith", "~y", True)] and names.parse_name("Ludvig van Beet")[0] == ("full", "ludvig", "beet", False)
    for org in ("Lalerava Naturalists' Society", "Society of Naturalists, Lalerava", "LALERAVA NATURALISTS SOCIETY", "Soc. Naturalists Lalerava"):
        assert names.parse_name(org) == [("org", "lalerava", "@ns", True)]
    assert names.parse_name("Deluzegrad BG")[0] == names.parse_name("Bot. Gdn Deluzegrad")[0] == ("org", "deluzegrad", "@bg", True)
    for nobody in ("unknown", "N/A", "-", "невідомо", "Anon.", "  ", "?"):
        assert names.parse_name(nobody) == []
    assert names.parse_name(LONG[:5000])


def _edits(a, b):
    d = {(i, 0): float(i) for i in range(len(a) + 1)} | {(0, j): float(j) for j in range(len(b) + 1)}
    for i, x in enumerate(a, 1):
        for j, y in enumerate(b, 1):
            d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (0 if x == y else names.SUBSTITUTION))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
    return d[len(a), len(b)]


@pytest.mark.parametrize("hot,long", [(2, 200), (200, 200), (1, 6)])
def test_segment_join_is_brute_force(spark, hot, long):
    r = random.Random(6)
    base = ["".join(r.choice("bdklmnprst") + r.choice("aeiou") for _ in range(3)) + e for _ in range(25) for e in ("chuk", "enko")]
    words = set(base)
    for w in base:
        for _ in range(2):
            x = list(w)
            for _ in range(r.randint(1, 2)):
                p = r.randrange(len(x) - 1)
                match r.randint(0, 3):
                    case 0:
                        x.insert(p, r.choice("aeklnt"))
                    case 1:
                        del x[p]
                    case 2:
                        x[p], x[p + 1] = x[p + 1], x[p]
                    case _:
                        x[p] = r.choice("aeklnt")
            words.add("".join(x))
    words = sorted(words)
    got = {(x["a"], x["b"]) for x in names.near_cores(spark.createDataFrame([(w, "c") for w in words], "core string, class string"), hot=hot, long=long).collect()}
    want = {(a, b) for i, a in enumerate(words) for b in words[i + 1 :] if abs(len(a) - len(b)) <= 2 and _edits(a, b) <= names.allowed(a, b)}
    assert got == want and len(want) > 60


def test_link_names(spark):
    rows = [("Larysa Mupirerska", "L. Mupirerska"), ("MUPIRERSKA, Larysa | Petro Hopepinko", None), ("Лариса Мупірерська", "Mupirrerska Larysa"), ("Taras Mupirerska", "unknown"), (None, ""), ("Hopnepiko Petro", " ; "), ("Petro Hopepinko", "P. Hopepinko & T. Mupirerska"), ("Lraysa Mupirerska", None)]
    df = spark.createDataFrame([(*x, 1) for x in rows], "a string, b string, name int")
    got = {r["name"]: r["entity"] for r in names.link_names(df, ["a", "b"]).collect()}
    by = defaultdict(set)
    for n, e in got.items():
        by[e].add(n)
    assert {"Larysa Mupirerska", "L. Mupirerska", "MUPIRERSKA, Larysa", "Лариса Мупірерська", "Mupirrerska Larysa", "Lraysa Mupirerska"} in by.values()
    assert {"Petro Hopepinko", "Hopnepiko Petro", "P. Hopepinko"} in by.values() and {"Taras Mupirerska", "T. Mupirerska"} in by.values() and by[None] == {"unknown"}
    assert names.link_names(df.where("false"), ["a", "b"]).count() == 0


def test_two_established_names_stay_apart(spark):
    """One edit apart, but both come with many surnames: two given names, not a typo. A rare one is a typo."""
    r = random.Random(2)
    surnames = ["".join(r.choice("bdklmnprst") + r.choice("aeiou") for _ in range(4)) for _ in range(14)]
    rows = [f"{g} {s}" for i, s in enumerate(surnames) for g in (["Marina"] if i < 5 else ["Marika"] if i < 10 else ["Marina", "Marika"])] + [f"Mairna {surnames[0]}"]
    got = {x["name"]: x["entity"] for x in names.link_names(spark.createDataFrame([(x,) for x in rows], "a string"), ["a"]).collect()}
    assert got[f"Mairna {surnames[0]}"] == got[f"Marina {surnames[0]}"] and len(set(got.values())) == len(rows) - 1


def planted(seed, people=300):
    """(spelling, entity) of names from no list: forms unlike the name, typos in either word, both orders, surnames of two letters, names above 100 letters."""
    r = random.Random(seed)
    syl = lambda n: "".join(r.choice("bdfgklmnprstvz") + r.choice("aeiou") for _ in range(n))

    def typo(w):
        p = r.randrange(1, len(w) - 1)
        return [w[:p] + w[p + 1] + w[p] + w[p + 2 :], w[:p] + w[p + 1 :], w[:p] + r.choice("aeiou") + w[p:], w[:p] + r.choice("bdklmnprst") + w[p + 1 :]][r.randint(0, 3)]

    givens = [(syl(3).capitalize(), [syl(2).capitalize() + r.choice("lnrs") for _ in range(2)]) for _ in range(30)]
    out, seen = [], set()
    for e in range(people):
        g, nick = r.choice(givens)
        s = syl(r.randint(3, 4)).capitalize() + r.choice(["nik", "sky", "ovic", "lund", ""]) if e % 10 else r.choice(["Li", "Wu", "Xu", "Ng", "Ma", "He"])
        if (g, s) in seen:
            continue
        seen.add((g, s))
        forms = [f"{g} {s}", f"{s}, {g}", f"{s} {g}", f"{g.upper()} {s.upper()}", *(f"{n} {s}" for n in nick), f"{s}, {nick[0]}", f"{typo(g)} {s}", f"{s} {typo(g)}"]
        forms += [f"{g} {typo(s)}", f"{typo(s)}, {g}"] if len(s) > 4 else []
        out += [(f, f"p{e}") for f in forms if r.random() < 0.8]
    for e in range(20):
        place = " ".join(syl(4) for _ in range(14)).title()
        name = f"{place} Society of Botany and Museum of Natural History"
        out += [(name, f"o{e}"), (name[:60] + name[61:], f"o{e}"), (name.upper(), f"o{e}")]
    owner = defaultdict(set)
    for n, e in out:
        owner[n].add(e)
    return {n: min(e) for n, e in owner.items() if len(e) == 1}


def test_planted_names_of_no_list(spark):
    truth = planted(4)
    got = {x["name"]: x["entity"] for x in names.link_names(spark.createDataFrame([(n,) for n in truth], "a string"), ["a"]).collect()}

    def linked(m, keep=lambda a: True):
        by = defaultdict(list)
        for n, e in m.items():
            by[e].append(n)
        return {(a, b) for v in by.values() for a in v for b in v if a < b and keep(a)}

    want, have = linked(truth), linked(got)
    assert len(want & have) >= 0.95 * len(want) and len(want & have) >= 0.98 * len(have)
    for keep in (lambda a: len(a) > 100, lambda a: min(map(len, a.replace(",", "").split())) == 2):
        part = linked(truth, keep)
        assert len(part) > 30 and len(part & have) >= 0.9 * len(part)


# clusters


@pytest.mark.parametrize("local", [0, 10**6])
def test_clusters_and_groups(spark, local):
    r = np.random.default_rng(7)
    lat, lon = 47 + np.r_[r.uniform(0, 0.05, 120), r.normal(0.02, 0.001, 60), np.full(30, 0.04)], 25 + np.r_[r.uniform(0, 0.07, 120), r.normal(0.03, 0.001, 60), np.full(30, 0.06)]
    rows = [(int(i), float(a), float(o)) for i, (a, o) in enumerate(zip(np.round(lat, 5), np.round(lon, 5)))] + [(3, 47.2, 25.3), (3, 47.2, 25.3), (None, 47.0, 25.0), (400, None, 25.0), (401, float("nan"), 25.0)]
    df = spark.createDataFrame([(*x, "c") for x in rows], "key long, lat double, lon double, cluster string")
    found = clusters.pivot_clusters(df, "key", "lat", "lon", 500.0, local_pairs=local)
    members = found["members"].collect()
    assert len(members) == len(rows) - 2
    place = {}
    for m in members:
        assert place.setdefault(m["spot"], m["cluster"]) == m["cluster"]
    info = {c["cluster"]: c for c in found["clusters"].collect()}
    size = Counter(m["cluster"] for m in members)
    assert {k: v["size"] for k, v in info.items()} == size and set(place.values()) == set(info)
    assert all(len(c["typical"] or []) <= 3 for c in info.values())
    pts = [x for x in rows if x[0] is not None and x[1] is not None and x[1] == x[1]]

    def d(a, b):
        la, oa, lb, ob = map(np.radians, (a[1], a[2], b[1], b[2]))
        return 2 * 6371008.8 * np.arcsin(np.sqrt(np.sin((lb - la) / 2) ** 2 + np.cos(la) * np.cos(lb) * np.sin((ob - oa) / 2) ** 2))

    root = {x[0]: x[0] for x in pts}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for i, a in enumerate(pts):
        for b in pts[i + 1 :]:
            if d(a, b) < 500:
                x, y = sorted((find(a[0]), find(b[0])))
                root[y] = x
    n = Counter(find(k) for k in root)
    assert {(x["key"], x["cluster_key"]) for x in clusters.linked_groups(found, 500.0, 3).collect()} == {(k, find(k)) for k in root if n[find(k)] >= 3}
    empty = clusters.pivot_clusters(df.where("false"), "key", "lat", "lon", 500.0)
    assert empty["members"].count() == empty["clusters"].count() == clusters.linked_groups(empty, 500.0, 3).count() == 0


def test_rounds_equal_greedy_order():
    r = random.Random(1)
    pairs = sorted({tuple(sorted(r.sample(range(40), 2))) for _ in range(90)})
    h = {i: r.randint(0, 5) for i in range(40)}
    near = defaultdict(set)
    for a, b in pairs:
        near[a].add(b), near[b].add(a)
    pivots, taken = set(), set()
    for i in sorted(near, key=lambda i: (h[i], i)):
        if i not in taken:
            pivots.add(i)
            taken |= near[i] - pivots
    a, b = map(np.array, zip(*pairs))
    got = clusters.absorbed_nodes(a, b, np.array([h[i] for i in a]), np.array([h[i] for i in b]))
    assert set(got.tolist()) == set(near) - pivots


# packing


@pytest.mark.parametrize("windows,merge", [(1, 20_000), (4, 5), (48, 20_000)])
def test_pack_round_trip(spark, windows, merge):
    r = random.Random(windows)
    sizes = [r.choice([0, 1, 5, 40, 99, 100, 101, 250, 1000, r.randint(1, 100)]) for _ in range(700)] + [None]
    df = spark.createDataFrame([(i, s, 1) for i, s in enumerate(sizes)], "id long, n long, container int").repartition(6)
    out = packing.pack(df, "id", "n", 100, windows, merge).collect()
    used, spans = defaultdict(list), defaultdict(list)
    for x in out:
        used[x["container"]].append((x["offset"], x["n_tokens"]))
        spans[x["id"]].append((x["start"], x["n_tokens"]))
    for places in used.values():
        end = 0
        for at, n in sorted(places):
            assert at >= end
            end = at + n
        assert end <= 100
    for i, s in enumerate(sizes):
        got = sorted(spans[i])
        assert sum(n for _, n in got) == (s or 0) and [a for a, _ in got] == [100 * k for k in range(len(got))] and (len(got) == 1 or s > 100)
    assert packing.pack(df.where("false"), "id", "n", 100).count() == 0
    if windows > 1:
        assert sum(s or 0 for s in sizes) / (100 * len([c for c, p in used.items() if sum(n for _, n in p)])) > 0.93
    with pytest.raises(ValueError):
        packing.pack(df.withColumn("n", F.lit(-1)), "id", "n", 100)


def test_packing_holds_no_items():
    """A million empty items, as many full ones and a mix: what a task holds does not grow with them."""
    import tracemalloc

    for sizes in (lambda i: 0, lambda i: 100, lambda i: i % 7):
        tracemalloc.start()
        n = sum(1 for _ in packing.place_online(((i, sizes(i)) for i in range(300_000 if sizes(6) == 6 else 1_000_000)), 100, 48, 0))
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert n >= 300_000 and peak < 200_000


def test_packing_merges_by_shuffle_alike(spark, monkeypatch):
    df = spark.range(0, 400, 1, 8).select("id", (F.col("id") % 37).alias("n"))
    one = packing.pack(df, "id", "n", 100, 3).collect()
    monkeypatch.setattr(packing, "SMALL_ROWS", -1)
    assert sorted(one) == sorted(packing.pack(df, "id", "n", 100, 3).collect())


def test_token_counts(spark):
    path, pattern = packing.tokenizer_files()
    df = spark.createDataFrame([(1, "hello world"), (2, ""), (3, None), (4, LONG)], "id long, text string")
    got = {r["id"]: r["n_tokens"] for r in packing.token_counts(df, "id", "text", path, pattern).collect()}
    assert got[1] == 2 and got[2] == got[3] == 0 and got[4] >= 60_000


# mails, leaks, quality

MULTI = """From a@b Mon Jan 1 10:00:00 2020
Subject: x
Content-Type: multipart/mixed; boundary="BB"

preamble that is no part
--BB
Content-Type: text/plain; charset=utf-8
Content-Transfer-Encoding: base64

0J/RgNC40LLRltGC
--BB
Content-Type: text/html; charset=utf-8
Content-Transfer-Encoding: quoted-printable

<p>one <b>tw</b>o=
 three&nbsp;four</p><blockquote>said before</blockquote>
--BB
Content-Type: text/plain; name="n.txt"
Content-Disposition: attachment; filename="n.txt"

attached words
--BB
Content-Type: application/pdf
Content-Transfer-Encoding: base64

AAAA
--BB--
"""


def test_text_parts():
    a, b, c = mail.text_parts(MULTI)
    assert a.text.strip() == "Привіт" and mail.words(b.text) == ["one", "two", "three", "four", "said", "before"] and "> said before" in b.text
    assert c.attached and c.text.strip() == "attached words"
    assert [p.text for p in mail.text_parts("no header here\nsecond line")] == ["no header here\nsecond line"]
    assert mail.text_parts("") == mail.text_parts(None) == []
    assert mail.text_parts(MULTI.replace("--BB", "--CC"))[0].text
    for cut_at in range(0, len(MULTI), 7):
        mail.text_parts(MULTI[:cut_at])


def test_parts_however_deep():
    inner = "Content-Type: text/plain\n\nthe innermost words"
    for k in range(60):
        inner = f"Content-Type: multipart/mixed; boundary=b{k}x\n\n--b{k}x\n{inner}\n--b{k}x--\n" if k % 3 else "Content-Type: message/rfc822\n\nSubject: y\n" + inner
    assert [p.text.strip() for p in mail.text_parts("Subject: x\n" + inner)] == ["the innermost words"]
    assert mail.text_parts("Subject: x\n\n" + " " * 5000 + "<html><p>one</p></html>")[0].is_html


def test_lines_after_a_long_blank_stretch():
    """A line like a disclaimer with much text below it is no disclaimer, however many blank lines are between."""
    own = [f"Line {i} of the author" for i in range(30)]
    for first in ("Disclaimer", "=" * 20):
        text = "Subject: x\n\nMine.\n" + first + "\n" + "\n" * 250 + "\n".join(own)
        got = mail.author_lines(mail.text_parts(text))
        assert [x for x in got.lines if x] == ["Mine.", first, *own] and got.boilerplate == 0
    text = "Subject: x\n\nMine.\nDisclaimer\n" + "\n" * 250 + "\n".join(own[:10])
    assert mail.author_lines(mail.text_parts(text)) == mail.Author(["Mine."], 0, 11)


def test_author_lines():
    text = "Subject: x\n\nHello all,\n\nIt works now. Thanks, it does.\n\nBest regards,\nIvan\n\nOn 2020-01-02, A B wrote:\n> old\n>> older\n-- \nIvan\nphone"
    got = mail.author_lines(mail.text_parts(text))
    assert [x for x in got.lines if x.strip()] == ["It works now. Thanks, it does."] and got.quoted == 3
    bars = mail.author_lines(mail.text_parts("Subject: x\n\nMine.\n\nAm 01.02.2020 schrieb A B:\n| quoted line\n|\n| more"))
    assert [x for x in bars.lines if x.strip()] == ["Mine."]


def _leak_words(r, n):
    return [f"w{r.randint(0, 30)}" for _ in range(n)]


@pytest.mark.parametrize("block,bits", [(400_000, 1), (20, 2**21), (20, 2)])
def test_leaks_are_brute_force(spark, block, bits):
    r = random.Random(9)
    items = [(i, " ".join(_leak_words(r, 25))) for i in range(12)] + [(90, "too short"), (91, None), (92, ""), (3, None)]
    docs = []
    for i in range(60):
        w = _leak_words(r, 40)
        if i % 2:
            it = r.choice(items[:12])[1].split()
            a, n = r.randint(0, 10), r.choice([11, 12, 13, 15])
            w[10:10] = it[a : a + n]
        docs.append((i, "  ".join(w).upper() if i % 4 == 1 else ", ".join(w)))
    docs += [(100, None), (101, ""), (102, LONG + items[0][1]), (102, LONG + items[0][1])]
    df = spark.createDataFrame([(*x, 1) for x in docs], "d long, t string, id int")
    its = spark.createDataFrame(items, "item long, words string")
    got = {(x["d"], x["item"]) for x in leakage.find_leaks(df, "d", "t", its, "item", "words", split=leakage.plain_words, block_shingles=block, filter_words=bits).collect()}
    want = set()
    for d, t in docs:
        s = " " + " ".join(mail.words(t or "")) + " "
        for i, x in items:
            w = mail.words(x or "")
            if any(" " + " ".join(w[k : k + 12]) + " " in s for k in range(len(w) - 11)):
                want.add((d, i))
    assert got == want and len(want) > 10
    assert leakage.find_leaks(df, "d", "t", its.where("false"), "item", "words").count() == 0 == leakage.find_leaks(df.where("false"), "d", "t", its, "item", "words").count()


def test_corpus_is_read_once(spark):
    """The number of times a text is split does not grow with the items, of which there are many blocks."""
    seen = spark.sparkContext.accumulator(0)

    def counted(text):
        seen.add(1)
        return leakage.plain_words(text)

    docs = spark.range(30).select("id", F.concat_ws(" ", *[F.concat(F.lit(f"w{i}x"), F.col("id") % 7) for i in range(20)]).alias("t"))
    for n in (2, 40):
        its = spark.range(n).select(F.col("id").alias("item"), F.concat_ws(" ", *[F.concat(F.lit(f"w{i}x"), F.col("id")) for i in range(15)]).alias("words"))
        before = seen.value
        assert leakage.find_leaks(docs, "id", "t", its, "item", "words", split=counted, block_shingles=3).count() > 0
        assert seen.value - before == 30


def test_filter_holds_every_hash(spark):
    h = np.random.default_rng(1).integers(-(2**62), 2**62, 5000)
    df = spark.createDataFrame([(int(x),) for x in h], "h long")
    bloom = leakage.bloom_set(df, 1200)
    assert bloom(h.view(np.uint64)).all() and bloom(np.arange(10_000, dtype=np.uint64)).mean() < 0.05


def test_leak_must_lie_within_one_part(spark):
    words = [f"w{i}" for i in range(20)]
    body = MULTI.replace("0J/RgNC40LLRltGC", "").replace("Content-Transfer-Encoding: base64\n\n\n", "\n" + " ".join(words[:8]) + "\n").replace("attached words", " ".join(words[8:20]))
    df = spark.createDataFrame([(1, body)], "d long, t string")
    its = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(words[:14]))], "i long, t string")
    assert {r["i"] for r in leakage.find_leaks(df, "d", "t", its, "i", "t").collect()} == {1}


def test_line_kinds():
    kinds = {
        "- apples": "list", "12) pears": "list", "[x] done": "list", "old fence": "short", "a\tb\tc": "table", "| a | b | c |": "table", "name            12.5            30": "table", "a;1;2;3": "cells",
        "http://x.y/abc?d=1": "junk", "[14:21:53.823] <ERR> 0x362d4eab q=976": "junk", "JkJrbZUGq2OH2RjpO6uruH+QJQ6NK5F5sdNE7yLXupaJp5TO": "junk", "#!@^=|~~=!*>&?=%*?+@|$": "junk",
        "BUY BUY BUY BUY !!! NOW NOW": "junk", "Eine StraÃŸe fÃ¼llt den Ort.": "junk", "The old fence leaves every meeting without much trouble.": "text", "Дякую, мені підходить.": "text",
        "We paid 1,000,000 euro for it": "short", "xa" * 30 + ";" + "ya" * 30 + ";" + "za" * 30: "cells", "k mx zmjfqg": "junk", "+-----+-----+": "table", "----------": "rule",
    }
    assert {k: quality.line_kind(k) for k in kinds} == kinds


def _kind(body):
    return quality.text_statistics("Subject: x\n\n" + body)["kind"]


def _wrapped(text, n=5):
    w = text.split()
    return "\n".join(" ".join(w[i : i + n]) for i in range(0, len(w), n))


STORY = "The committee met on Tuesday to discuss the new garden fence, which had fallen during the storm. After a long debate they agreed to repair it before winter. Nobody asked who would pay for the wood and the nails."


def test_short_lines_need_marks_or_siblings():
    """A poem and wrapped prose are prose; like lines without marks are a list; two of them are not; beside a mark one is."""
    assert _kind("The rose is red\nThe sky is blue\nThe grass is green\nAnd so are you") == "prose"
    assert _kind(_wrapped(STORY)) == "prose"
    assert _kind(_wrapped("Le comité sest réuni mardi afin de discuter du nouveau portail tombé pendant la tempête. Après un long débat, il fut décidé de réparer le bois avant hiver.")) == "prose"
    assert _kind("old fence\ngreen gate\nlocal barn") == "list" and _kind("old fence\ngreen gate") == "prose"
    assert _kind("- old fence\ngreen gate") == "list" and _kind("old fence\n\nThe gate is as old as our fence is.") == "prose"


def test_every_statistic_decides(monkeypatch):
    """Each rule on a text that only it decides: without the rule the kind is another."""
    lines = "\n".join(f"buy cheap watches online {i * 37} for {w}" for i, w in enumerate("home garden office school club museum village station park reserve team friend".split()))
    verses = "\n\n".join(["Stones rolled down a hill near Kyiv, loudly.", "Water ran over fields after heavy rain, slowly."] * 4)
    again = "\n".join(["Stones rolled down a hill near Kyiv."] * 6 + ["Water ran over fields after heavy rain."])
    said = "\n".join(["Short notes below", "Old gates", "Green doors", "Warm rooms"] + ["It was as we said and they had it with them."] * 1 + ["Then all of us were on our way and it was not so far."])
    noise = "\n".join(["ab12!? #cd34%% ef56&& <<gh78>> ij90!! kl11?? mn22##, (op33) qr44;"] * 1 + ["st55!! uv66## wx77%% yz88&& ==ab99 cd10?? ef21!!, (gh32) ij43;"] + ["kl54## mn65%% op76&& qr87!! ==st98 uv19?? wx20##, (yz31) ab42;"])
    csv = "name,age,town\nann,12,rome\nbob,13,oslo"
    for body, kind, rule, off in (
        (lines, "junk", "COVERED", 2.0), (verses, "junk", "REPEATED", 2.0), (again, "junk", "REPEATED", 2.0), ("old fence\ngreen gate\nlocal barn", "list", "SIBLINGS", 99), (noise, "junk", "NOISE_SYMBOLS", 2.0),
        ("The rose is red\nThe sky is blue\nThe grass is green\nAnd so are you", "prose", "COMMON_TEXT", 2.0),
    ):
        assert _kind(body) == kind, body
        with monkeypatch.context() as m:
            m.setattr(quality, rule, off)
            for also in ("COVERED", "PROSE_COMMON") if rule in ("REPEATED", "COMMON_TEXT") else ():
                m.setattr(quality, also, 2.0)
            assert _kind(body) != kind, (rule, body)
    assert _kind(csv) == "table" and _kind("name,age,town,and,so,on") == "prose" and _kind(said) == "prose"


def test_statistics(spark):
    rows = [(1, "Subject: a\n\nThe fence is old and our gate looks new.\n\nThe fence is old and our gate looks new."), (2, None), (3, ""), (4, "Subject: b\n\n- a b\n- c d\n- e f\n"), (5, "Subject: c\n\n" + LONG), (5, "Subject: c\n\n" + LONG)]
    df = spark.createDataFrame([(*x, "k") for x in rows], "d long, t string, kind string")
    got = {r["d"]: r for r in quality.quality_statistics(df, "d", "t").collect()}
    assert got[1]["kind"] == "prose" and got[1]["duplicate_paragraph_share"] == 0.5 and got[1]["ending_share"] == 1.0 and got[1]["dominant_ngram_share"] > 0.2
    assert got[2]["kind"] == got[3]["kind"] == "empty" and got[2]["n_words"] == 0
    assert got[4]["kind"] == "list" and got[4]["list_share"] == 1.0 and got[5]["kind"] == "junk" and got[5]["n_words"] == 60_000
    assert quality.quality_statistics(df.where("false"), "d", "t").count() == 0


def test_dominant_share_of_long_texts(monkeypatch):
    r = random.Random(1)
    words = [f"w{r.randint(0, 9)}" for _ in range(3000)]
    few = quality._dominant(words, sum(map(len, words)))
    monkeypatch.setattr(quality, "_MANY_WORDS", 10)
    assert quality._dominant(words, sum(map(len, words))) == pytest.approx(few)


def test_very_long_names(spark):
    df = spark.createDataFrame([(LONG,), (LONG,), ("x" * 100_000,), ("Petro Hopepinko",)], "a string")
    got = names.link_names(df, ["a"]).collect()
    assert len(got) == 3 and all(r["entity"] for r in got)
