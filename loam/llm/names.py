"""Variant spellings of names of persons and organisations, linked by a pigeonhole segment join."""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loam.llm.survivor import UNKNOWN
from loam.operators.components import connected_components
from loam.operators.lineage import cut

#: Edits allowed between two spellings of a surname or place; a substitution weighs a little more than an insertion, deletion or transposition.
EDITS, SUBSTITUTION, LIMIT = 2, 1.25, 2.25
#: Letters of the shortest word that may be misspelled: in shorter ones one edit makes another name.
LEAST_LETTERS = 5
#: Index entries of a segment above which its names are told apart by further segments; letters above which a name goes by its digest through the joins.
HOT, LONG = 200, 200
#: Other words a word comes with (partners) up to which it may be a misspelling of another one, at least, and as a share of the other's partners.
RARE, RARE_SHARE = 3, 0.02
#: Two given names are forms of one if they share at least this many rare surnames, this share of those of the rarer name, and this many
#: times as many as chance has it; a surname is rare up to this many given names.
FORMS_SHARED, FORMS_SHARE, FORMS_LIFT, RARE_SURNAME = 2, 0.6, 4.0, 8
#: Words beside a name that are no part of it.
TITLES = frozenset("dr prof professor mr mrs ms miss leg det coll col herr frau pan pani phd msc ing doc".split())
STOP = frozenset("of the for and in at a an de von der und i ta".split())
PARTICLES = frozenset("van von der den de del della di da dos la le el al bin ibn ten ter zu".split())
#: Words that organisations are made of.
ORG = (
    "society naturalists botanical botanic garden gardens institute meadow ecology museum university academy department laboratory centre center club association group team station reserve park school "
    "herbarium network volunteers watch survey foundation union council agency office service national natural history science sciences research biology botany friends federation faculty"
).split()
#: Ukrainian national romanisation (2010), at the start of a word and elsewhere; and initials that stand for several Latin letters.
_ROMAN = dict(zip("абвгґдежзиійклмнопрстуфхцчшщьюяєїыэёъ", "a b v h g d e zh z y i i k l m n o p r s t u f kh ts ch sh shch - iu ia ie i y e e -".split()))
_START = {"й": "y", "ю": "yu", "я": "ya", "є": "ye", "ї": "yi"}
_INITIAL = {"є": "ye", "х": "kch", "г": "hg", "к": "kc", "ц": "tc", "ф": "fp", "ї": "yi"}
#: Letters that stand for one sound in different languages' Latin spellings.
_SOUND = str.maketrans("wj", "vy")


def romanise(text: str) -> str:
    """Lower case; Cyrillic to Latin letters; marks of Latin letters dropped; apostrophes dropped."""
    text = re.sub(r"['’ʼ`]", "", unicodedata.normalize("NFC", text).lower())
    out = []
    for i, c in enumerate(text):
        start = i == 0 or not text[i - 1].isalpha()
        r = (_START.get(c) if start else None) or _ROMAN.get(c)
        out.append(c if r is None else "" if r == "-" else r)
    plain = unicodedata.normalize("NFD", "".join(out))
    return "".join(c for c in plain if not unicodedata.combining(c)).replace("ł", "l").replace("ß", "ss")


def _is_org_word(token: str) -> bool:
    """A word of organisations, whole or shortened (same first letter, letters in order, at least three or a shortening of one by its consonants)."""
    if token in ORG:
        return True
    if len(token) < 3:
        return False
    for w in ORG:
        if w[0] == token[0] and len(token) < len(w):
            it = iter(w)
            if all(c in it for c in token):
                return True
    return False


def parse_name(spelling: str) -> list[tuple[str, str, str, bool]]:
    """Readings of a spelling, best first: (kind, x, y, sure).

    ``full``: a person by given name x and surname y; ``sure`` if a comma says which is which, else it is only the usual order.
    ``short``: surname x, and '~' with the beginning of a given name or the letters its initial may stand for as y. ``org``: place or
    own name x, '@' and the sorted initials of its other words y; ``same``: the same with the words of x as they were written (by which a lost
    blank or a misspelled beginning does no harm), linked to the first reading. ``one``: a single word x. Of more than two words of a person the
    first and last, or else neighbours, are taken; particles go. Nothing for words that say nobody. No list of names is used.
    """
    text = re.sub(r"\(([^)]*)\)", lambda m: f" {m[1]} " if len(m[1]) > 5 else " ", spelling)
    if re.sub(r"\.+$", "", re.sub(r"\s+", " ", spelling.strip().lower())) in UNKNOWN:
        return []
    raw = re.findall(r"[^\W\d_]+(?:['’ʼ-][^\W\d_]+)*\.?", text)
    tokens = [(t.rstrip("."), romanise(t.rstrip(".")).replace("-", ""), t.endswith(".")) for t in raw]
    tokens = [t for t in tokens if t[1] and t[1] not in TITLES]
    small = [t for t in tokens if t[1] not in STOP]
    if small and any(t[1] in ORG for t in small):
        tokens = small
    if not tokens:
        return []
    words = [t for _, t, _ in tokens]
    generic = [t in ORG or _is_org_word(t) for t in words]
    sounds = [w.translate(_SOUND) for w in words]
    mixed = any(t.lower() != t.upper() and t != t.upper() for t, _, _ in tokens) or any(len(t) > 5 for t in words)
    acronym = [t == t.upper() and 2 <= len(t) <= 5 and not dot and mixed for t, _, dot in tokens]
    whole = sum(w in ORG for w in words)
    if whole or len(words) > 2 and sum(generic) >= 2:
        place = [w for w, g in zip(words, generic) if not g]
        letters = "".join(sorted(w[0] for w, g in zip(words, generic) if g))
        if not place:
            return [("org", "".join(words), "@", True)]
        own = [("org", "".join(sorted(place)), "@" + letters, True)]
        return own if place == sorted(place) else [*own, ("same", "".join(place), "@>" + letters, True)]
    out: list[tuple[str, str, str, bool]] = []
    if len(words) == 2 and sum(acronym) == 1:
        at = acronym.index(True)
        if len(words[1 - at]) > 4:
            out.append(("org", words[1 - at], "@" + "".join(sorted(words[at])), True))
    if len(words) == 2 and all(generic):
        out.append(("org", "".join(words), "@", True))
    if len(words) == 1:
        return [*out, ("one", sounds[0], "*", True)]
    initial = [len(t) == 1 or dot and len(w) <= 4 for t, w, dot in tokens]

    def mark(i: int) -> str:
        t, w = tokens[i][0], sounds[i]
        return "~" + (_INITIAL.get(t.lower(), w[0]) if len(t) == 1 else w)

    comma = re.match(r"\s*([^,]+),\s*\S", text)
    if comma:
        before = [romanise(x).replace("-", "") for x in re.findall(r"[^\W\d_]+(?:['’ʼ-][^\W\d_]+)*", comma[1])]
        at = min(max(1, sum(w not in TITLES for w in before)), len(words) - 1)
        surname = "".join(sounds[:at])
        return [*out, ("short", surname, mark(at), True) if initial[at] else ("full", sounds[at], surname, True)]
    full = [i for i in range(len(words)) if not initial[i] and words[i] not in PARTICLES] or [i for i in range(len(words)) if not initial[i]]
    if not full:  # nothing but initials: the longest is the surname
        i = max(range(len(words)), key=lambda k: (len(words[k]), k))
        return [*out, ("short", sounds[i], mark(0 if i else 1), True)]
    if len(full) == 1 or any(initial) and len(full) == len(words) - sum(initial) == 1:
        i = full[0]
        others = [k for k in range(len(words)) if k != i and initial[k]]
        return [*out, ("short", sounds[i], mark(others[0]), True)] if others else [*out, ("one", sounds[i], "*", True)]
    if any(initial) and initial[0]:  # initials first: the last word is the surname
        return [*out, ("short", sounds[full[-1]], mark(0), True)]
    pairs = [(full[0], full[-1]), *zip(full, full[1:])]
    out += [("full", sounds[i], sounds[j], False) for i, j in dict.fromkeys(pairs[:4])]
    if len(full) == 2:  # two letters may be a name or the beginning of one
        for i, j in ((full[0], full[1]), (full[1], full[0])):
            if len(tokens[i][0]) == 2 and len(words[j]) > 2:
                out.append(("short", sounds[j], "~" + sounds[i], True))
    return out


def weighted_edits(a: str, b: str, limit: float = LIMIT, sub: float = SUBSTITUTION) -> float:
    """Banded edit distance: insertion, deletion and transposition of neighbours cost 1, substitution ``sub``; above ``limit``: limit + 1."""
    band = int(limit)
    if abs(len(a) - len(b)) > band:
        return limit + 1
    big = limit + 1
    before: list[float] = []
    row = [float(j) if j <= band else big for j in range(len(b) + 1)]
    for i, x in enumerate(a, 1):
        new = [big] * (len(b) + 1)
        if i <= band:
            new[0] = float(i)
        for j in range(max(1, i - band), min(len(b), i + band) + 1):
            y = b[j - 1]
            best = min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (0 if x == y else sub))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                best = min(best, before[j - 2] + 1)
            new[j] = best
        if min(new) > limit:
            return big
        before, row = row, new
    return row[-1] if row[-1] <= limit else big


def allowed(a: str, b: str, least: int = LEAST_LETTERS) -> float:
    """Distance that two texts of their lengths may have: none below ``least`` letters, one edit below 8 on average."""
    return 0.0 if min(len(a), len(b)) < least else SUBSTITUTION if len(a) + len(b) < 15 else LIMIT


def given_fits(short: str, given: str) -> bool:
    """Whether a given name may stand behind '~' and its beginning or the letters its initial stands for."""
    letters = short[1:]
    if not letters or given.startswith("~"):
        return False
    if len(letters) > 1 and letters not in _INITIAL.values():
        return given.startswith(letters)
    return given[0] in letters


def cut_points(n: int, parts: int) -> list[tuple[int, int]]:
    """Position and length of ``parts`` segments of a text of ``n`` letters, as even as can be."""
    size, more = divmod(n, parts)
    out, at = [], 0
    for i in range(parts):
        length = size + (i >= parts - more)
        out.append((at, length))
        at += length
    return out


def index_keys(text: str, k: int) -> Iterator[tuple[str, str, str, bool]]:
    """(length and segment number, segment, rest, whether the rest can be cut again) for each of the k + 1 segments of a text and of its forms with letters swapped over a cut."""
    n, parts = len(text), cut_points(len(text), k + 1)
    forms = {text}
    for at, _ in parts[1:]:
        if 0 < at < n:
            forms.add(text[: at - 1] + text[at] + text[at - 1] + text[at + 1 :])
    for f in sorted(forms):
        for i, (p, m) in enumerate(parts):
            yield f"{n}.{i}.", f[p : p + m], f[:p] + f[p + m :], True


def probe_keys(text: str, k: int) -> Iterator[tuple[str, str, str, bool]]:
    """The same of the substrings of a text that may equal a segment of a text at most k edits away."""
    m, seen = len(text), set()
    for n in range(max(1, m - k), m + k + 1):
        for i, (p, size) in enumerate(cut_points(n, k + 1)):
            for at in range(max(0, p - k), min(m - size, p + k) + 1):
                head, segment, rest = f"{n}.{i}.", text[at : at + size], text[:at] + text[at + size :]
                if m > 64 or (head, segment, rest) not in seen:
                    seen.add((head, segment, rest) if m <= 64 else None)
                    yield head, segment, rest, True


def _key(prefix: str, segment: str) -> str:
    return prefix + (segment if len(segment) <= 24 else "#" + hashlib.blake2b(segment.encode(), digest_size=12).hexdigest())


def near_cores(cores: DataFrame, k: int = EDITS, limit: float = LIMIT, hot: int = HOT, least: int = LEAST_LETTERS, long: int = LONG) -> DataFrame:
    """``(class, a, b, d)``: pairs a < b of different ``core`` of one ``class`` at a weighted distance of at most ``limit``, whatever their length.

    Each core is cut into k + 1 segments: of two cores at most k edits apart, one segment of the one is found in the other, moved by at
    most k (a transposition over a cut is met by also indexing the form with these letters swapped). Segments and position-shifted
    substrings meet in an equi-join, the inverted index. Segments with more than ``hot`` entries, such as common endings, meet on a
    segment of the rest as well, by the same argument, and these on one of what is left then, so common parts do not pair everyone.
    Pairs are verified by a banded edit distance. Segments of many letters go by their digest, and so do cores above ``long`` letters
    until they are verified; a clash of digests only makes a pair to verify more. Cores below ``least`` letters pair with none.
    """
    label = F.when(F.length("core") > long, F.concat(F.lit("#"), F.sha2("core", 256))).otherwise(F.col("core"))
    texts = cut(cores.where(F.length("core") >= least).select("class", label.alias("label"), "core").distinct())

    def keys(make):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                rows = []
                for c, name, before, rest in zip(b["class"], b["label"], b["key"], b["rest"]):
                    rows += [(c, name, _key(before + "/" + head, seg), left if deep else "") for head, seg, left, deep in make(rest, k)]
                    if len(rows) > 20_000:
                        yield pd.DataFrame(rows, columns=["class", "label", "key", "rest"])
                        rows = []
                if rows:
                    yield pd.DataFrame(rows, columns=["class", "label", "key", "rest"])

        return run

    kind = "class string, label string, key string, rest string"
    start = texts.select("class", "label", F.concat(F.col("class"), F.lit(":")).alias("key"), F.col("core").alias("rest"))

    def meet(i: DataFrame, p: DataFrame) -> DataFrame:
        # the planner cannot know how many keys Python makes of a core, so neither side may be broadcast on its estimate
        return i.select("key", "class", F.col("label").alias("a")).join(p.select("key", F.col("label").alias("b")).hint("merge"), "key").where("a <> b").select("class", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))

    every, index, probes = None, start, start
    for level in range(k + 1):
        index, probes = cut(index.mapInPandas(keys(index_keys), kind)), probes.mapInPandas(keys(probe_keys), kind)
        often = cut(index.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > hot).select("key"))
        last = level == k or often.isEmpty()
        pairs = meet(index if last else index.join(often, "key", "left_anti"), probes)
        every = pairs if every is None else every.union(pairs)
        if last:
            break
        index, probes = index.join(often, "key"), cut(probes.join(often, "key"))
    every = every.distinct()
    longs = texts.where(F.length("core") > long).select("class", "label", "core").withColumnsRenamed({"class": "_c"})
    for side in "ab":
        every = every.join(longs.withColumnsRenamed({"label": f"_l{side}", "core": f"_t{side}", "_c": f"_c{side}"}), (F.col(side) == F.col(f"_l{side}")) & (F.col("class") == F.col(f"_c{side}")), "left")
    every = every.select("class", F.coalesce("_ta", "a").alias("a"), F.coalesce("_tb", "b").alias("b"))

    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(c, min(x, y), max(x, y), d) for c, x, y in zip(b["class"], b["a"], b["b"]) if (d := weighted_edits(x, y, limit)) <= min(limit, allowed(x, y, least))]
            if rows:
                yield pd.DataFrame(rows, columns=["class", "a", "b", "d"])

    return every.mapInPandas(verify, "class string, a string, b string, d double")


def spellings(df: DataFrame, columns: list[str]) -> DataFrame:
    """``(name, n)``: distinct values of the columns, cut at '|', ';' and '&', outer blanks removed, with the number of rows."""
    every = None
    for c in columns:
        one = df.select(F.explode(F.split(F.col(c).cast("string"), r"[|;&]")).alias("name"))
        every = one if every is None else every.union(one)
    blank = r"^[\\s\\x{a0}]+|[\\s\\x{a0}]+$".replace("\\\\", "\\")
    return every.select(F.regexp_replace("name", blank, "").alias("name")).where("name <> ''").groupBy("name").agg(F.count("*").alias("n"))


def given_forms(fulls: DataFrame, near: DataFrame, shared: int = FORMS_SHARED, share: float = FORMS_SHARE, lift: float = FORMS_LIFT, rare: int = RARE_SURNAME) -> DataFrame:
    """``(g, h)``, both ways: given names that are forms of one name, found in the data and nowhere else.

    ``fulls``: (x, y, sure) given name and surname of each distinct full name, in sure or usual order. Which word of a name is
    the given one is settled by votes: where an order is sure, and else by the number of partners, as given names come with many
    surnames and surnames with few given names. Two given names are forms of one if they meet on rare surnames far more often than
    chance would have it: people of a rare surname, spelt equally or nearly so, who differ in the given name are mostly one person. Only
    words with two partners or more can show that.
    """
    both = fulls.select(F.col("x").alias("t"), F.col("y").alias("o"), F.when(F.col("sure"), 3).otherwise(0).alias("v")).union(fulls.select("y", "x", F.when(F.col("sure"), -3).otherwise(0)))
    both = cut(both.groupBy("t", "o").agg(F.sum("v").alias("v")))
    degree = both.groupBy("t").agg(F.count("*").alias("n"))
    votes = both.join(degree, "t").join(degree.select(F.col("t").alias("o"), F.col("n").alias("m")), "o").withColumn("v", F.col("v") + F.signum(F.col("n") - F.col("m")))
    role = votes.groupBy("t").agg(F.sum("v").alias("v"), F.max("n").alias("n"))
    given = cut(role.where("v > 0 and n >= 2").select("t"))
    pairs = both.join(given, "t").join(given.select(F.col("t").alias("o")), "o", "left_anti").select(F.col("t").alias("g"), F.col("o").alias("s"))
    # a misspelled surname counts as the near one with most given names
    size = cut(pairs.groupBy("s").agg(F.count("*").alias("n")))
    near = near.where(F.col("d") <= SUBSTITUTION).select(F.col("x").alias("s"), F.col("x2").alias("s2")).union(size.select("s", "s"))
    stands = near.join(size.withColumnRenamed("s", "s2"), "s2").groupBy("s").agg(F.min(F.struct((-F.col("n")).alias("n"), "s2"))["s2"].alias("s2"))
    pairs = cut(pairs.join(stands, "s").select("g", F.col("s2").alias("s")).distinct())
    few = pairs.groupBy("s").agg(F.count("*").alias("n")).where(F.col("n") <= rare).select("s")
    pairs = cut(pairs.join(few, "s"))
    total = pairs.select("s").distinct().count()
    own = pairs.groupBy("g").agg(F.count("*").alias("n"))
    # at most ``rare`` given names a surname, so at most that many pairs a row
    meet = pairs.join(pairs.withColumnRenamed("g", "h"), "s").where("g < h").groupBy("g", "h").agg(F.count("*").alias("k"))
    meet = meet.join(own.select("g", "n"), "g").join(own.select(F.col("g").alias("h"), F.col("n").alias("m")), "h")
    found = meet.where((F.col("k") >= shared) & (F.col("k") >= share * F.least("n", "m")) & (F.col("k") * total >= lift * F.col("n") * F.col("m"))).select("g", "h")
    return cut(found.union(found.select("h", "g")))


def link_names(df: DataFrame, columns: list[str], k: int = EDITS, limit: float = LIMIT, hot: int = HOT, least: int = LEAST_LETTERS) -> DataFrame:
    """``(name, n, entity)``: every distinct spelling in the columns, its number of rows and the entity it means.

    A spelling is read as a person's two names in either order, as a surname with an initial, or as an organisation's own name and its
    kind (``parse_name``); no list of names is used. Words are near by ``near_cores`` (pigeonhole segment join, banded edit distance).
    Full names are linked, whatever their order, if one word is equal and the other near: by up to one edit, or as the nearest of
    the rarer spelling; not if both near words come with many partners, as then they are two names. Forms of a given name are found in
    the data (``given_forms``); names with forms of one given name and equal or near surnames are linked. A surname with an initial
    joins the one group of full names it fits best: nearest surname, then most spellings; if two fit alike it joins none;
    those that fit no full name join each other. Organisations are linked by near own names of one kind. Entities are what is
    linked, directly or through others; ``entity`` is the smallest unit name in it. Words that say nobody mean nobody: ``entity`` is
    NULL; blanks and NULL do not come out. Only distinct spellings are joined, so a name in a third of all rows counts once.
    """
    names = cut(spellings(df, columns))

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(x, i, *r, "|".join(every[0][1:3]) if r[0] == "same" else None) for x in b["name"] for every in (parse_name(x),) for i, r in enumerate(every)]
            if rows:
                yield pd.DataFrame(rows, columns=["name", "turn", "kind", "x", "y", "sure", "first"])

    read = names.select("name").mapInPandas(parse, "name string, turn int, kind string, x string, y string, sure boolean, first string")
    low, high = F.least("x", "y"), F.greatest("x", "y")
    read = cut(read.withColumn("unit", F.when(F.col("kind") == "full", F.concat_ws("|", low, high)).otherwise(F.concat_ws("|", "x", "y"))))
    units = cut(read.groupBy("unit", "kind", "x", "y").agg(F.max("sure").alias("sure"), F.countDistinct("name").alias("support")))
    people, orgs = units.where("kind in ('full', 'short')"), units.where("kind in ('org', 'same')")
    words = people.select("x").union(people.where("kind = 'full'").select("y")).distinct()
    cores = words.select(F.col("x").alias("core"), F.lit("p").alias("class")).union(orgs.select("x", "y").distinct())
    pairs = cut(near_cores(cores, k, limit, hot, least))
    near = pairs.select("class", F.col("a").alias("x"), F.col("b").alias("x2"), "d").union(pairs.select("class", "b", "a", "d"))
    people_near = near.where("class = 'p'").select("x", "x2", "d")

    # full names: each under both of its words
    fulls = cut(units.where("kind = 'full'").groupBy("unit").agg(F.sum("support").alias("support"), F.max("sure").alias("sure"), F.max(F.struct("sure", "support", "x", "y")).alias("as_")).select("unit", "support", "sure", "as_.x", "as_.y"))
    sides = cut(fulls.select("unit", "support", F.col("x").alias("one"), F.col("y").alias("other")).union(fulls.select("unit", "support", "y", "x")).distinct())
    partners = cut(sides.groupBy("other").agg(F.count("*").alias("n")))
    v = sides.select(F.col("unit").alias("v"), F.col("support").alias("sv"), F.col("one").alias("one2"), F.col("other").alias("other2"))
    typed = sides.join(people_near.withColumnsRenamed({"x": "other", "x2": "other2"}), "other").withColumn("one2", F.col("one")).join(v, ["one2", "other2"]).where("unit <> v")
    # every pair comes from both ends; the rarer end decides whether a far pair is its nearest, and whether the word is a name of its own
    typed = typed.where("support <= sv").join(partners, "other").join(partners.select(F.col("other").alias("other2"), F.col("n").alias("n2")), "other2")
    typed = typed.where(F.least("n", "n2") <= F.greatest(F.lit(RARE), RARE_SHARE * F.greatest("n", "n2")))
    forms = given_forms(fulls, people_near)
    reach = cut(people_near.union(words.select("x", F.col("x").alias("x2"), F.lit(0.0).alias("d"))))
    called = sides.join(forms, sides["other"] == forms["g"]).select("unit", "support", "one", F.col("h").alias("other2"))
    called = called.join(reach.withColumnsRenamed({"x": "one", "x2": "one2"}), "one").join(v, ["one2", "other2"]).where("unit <> v and support <= sv")
    written = read.where("kind = 'same'").select("unit", F.col("first").alias("v")).distinct()
    kinds = near.where("class <> 'p'").select(F.concat_ws("|", "x", "class").alias("unit"), F.concat_ws("|", "x2", "class").alias("v"))
    near_fulls = typed.select("unit", "v", "d").union(called.select("unit", "v", "d")).withColumn("nearest", F.min(F.when(F.col("d") > 0, F.col("d"))).over(Window.partitionBy("unit")))
    near_fulls = near_fulls.where((F.col("d") <= SUBSTITUTION) | (F.col("d") == F.col("nearest")))
    edges = cut(near_fulls.select("unit", "v").union(kinds).union(written))
    groups = cut(connected_components(edges, "unit", "v"))

    short = units.where("kind = 'short'").select("x", F.col("y").alias("mark"), F.col("unit").alias("u"))
    whole = v.join(groups, v["v"] == groups["node"], "left").select("v", "sv", "one2", "other2", F.coalesce("component", "v").alias("g"))
    chance = short.join(reach, "x").join(whole, F.col("x2") == F.col("one2")).select("u", "mark", "v", "g", "other2", "d", "sv").distinct()

    def fits(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            keep = [given_fits(m, g) for m, g in zip(b["mark"], b["other2"])]
            if any(keep):
                yield pd.DataFrame({c: b[c].to_numpy()[keep].tolist() for c in ("u", "g", "v", "d", "sv")})

    fit = chance.mapInPandas(fits, "u string, g string, v string, d double, sv bigint")
    # per group of full names its nearest surname and the spellings there; then the best group, if it is alone
    best = fit.groupBy("u", "g", "d").agg(F.sum("sv").alias("n"), F.min("v").alias("v")).groupBy("u", "g").agg(F.min(F.struct("d", (-F.col("n")).alias("s"), "v")).alias("b"))
    w = Window.partitionBy("u").orderBy("b.d", "b.s")
    ranked = best.withColumn("r", F.rank().over(w)).where("r = 1").withColumn("k", F.count("*").over(Window.partitionBy("u"))).where("k = 1")
    chosen = cut(ranked.select("u", F.col("b.v").alias("v")))
    fitting = cut(fit.select("u").distinct())
    # surnames with initials that fit no full name join each other
    lone = short.join(fitting, "u", "left_anti")
    again = lone.select(F.col("x").alias("x2"), F.col("mark").alias("mark2"), F.col("u").alias("v"))
    alike = "startswith(mark, mark2) or startswith(mark2, mark) or instr(substring(mark, 2), substring(mark2, 2)) > 0 or instr(substring(mark2, 2), substring(mark, 2)) > 0"
    twins = lone.join(reach, "x").join(again, "x2").where(f"u < v and ({alike})").where(F.col("d") <= SUBSTITUTION)
    found = cut(connected_components(edges.union(chosen).union(cut(twins.select("u", "v"))), "unit", "v"))
    # a spelling with several readings takes the first one that is linked or that others share, else the first
    shared = units.groupBy("unit").agg(F.sum("support").alias("support"))
    own = read.where("kind <> 'same'").join(found, read["unit"] == found["node"], "left").join(shared, "unit")
    own = own.groupBy("name").agg(F.min(F.struct((F.col("component").isNull() & (F.col("support") < 2)).alias("alone"), "turn", F.coalesce("component", "unit").alias("entity")))["entity"].alias("entity"))
    return names.join(own, "name", "left")
