"""Evaluation texts inside training texts: a prefix-filtered set join of word shingles."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loam.llm.mail import text_parts, words
from loam.operators.lineage import cut

#: Places of a window in a piece of a run.
PIECE = 128
#: Words of a shingle; words that must follow each other; hashes of item shingles that go to the tasks as they are (8 bytes each), and 64-bit
#: words of the filter that goes to them instead if there are more (16 MB, good for 8 million shingles; with more it lets more pass).
SHINGLE, LEAST, BLOCK_SHINGLES, FILTER_WORDS = 5, 12, 400_000, 2**21
_PRIME = np.uint64(0x9E3779B97F4A7C15)


class _WordHashes(dict):
    def __missing__(self, word: str) -> int:
        if len(self) > 500_000:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h


def shingle_hashes(tokens: list[str], size: int, cache: dict[str, int]) -> np.ndarray:
    """64-bit hash of each run of ``size`` words, by position."""
    if len(tokens) < size:
        return np.zeros(0, dtype=np.uint64)
    w = np.fromiter(map(cache.__getitem__, tokens), dtype=np.uint64, count=len(tokens))
    n = len(tokens) - size + 1
    h = np.zeros(n, dtype=np.uint64)
    for i in range(size):
        h = h * _PRIME + w[i : i + n]
    return h ^ (h >> np.uint64(29))


def mail_words(text: str | None) -> list[list[str]]:
    """Word lists of the text parts of a raw mail."""
    return [words(p.text) for p in text_parts(text)]


def plain_words(text: str | None) -> list[list[str]]:
    """The word list of a plain text, one part."""
    return [words(text)] if text else []


def _runs(hit: np.ndarray) -> Iterator[tuple[int, int]]:
    """Start and end of stretches of true values."""
    edges = np.flatnonzero(np.diff(np.r_[0, hit.astype(np.int8), 0]))
    yield from zip(edges[::2].tolist(), edges[1::2].tolist())


class ExactSet:
    """The hashes of all item shingles, sorted."""

    def __init__(self, hashes: np.ndarray):
        self.hashes = np.unique(hashes)

    def __call__(self, h: np.ndarray) -> np.ndarray:
        return self.hashes[np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)] == h if len(self.hashes) else np.zeros(len(h), dtype=bool)


def _bits(h: np.ndarray, words: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Word and bit of each of the four places of a hash in a filter of so many 64-bit words."""
    one, two = h ^ (h >> np.uint64(33)), (h * _PRIME) | np.uint64(1)
    for i in range(4):
        at = (one + np.uint64(i) * two) % np.uint64(64 * words)
        yield (at >> np.uint64(6)).astype(np.int64), np.uint64(1) << (at & np.uint64(63))


class BloomSet:
    """A Bloom filter of the hashes of item shingles: holds them all, and some others."""

    def __init__(self, words: np.ndarray):
        self.words = words

    def __call__(self, h: np.ndarray) -> np.ndarray:
        hit = np.ones(len(h), dtype=bool)
        for w, bit in _bits(h, len(self.words)):
            hit &= (self.words[w] & bit) != 0
        return hit


def bloom_set(hashes: DataFrame, words: int) -> BloomSet:
    """The filter of a column ``h`` of hashes: each task sets bits, the words of the tasks are joined by OR; at most ``words`` rows reach the driver."""

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.zeros(words, dtype=np.uint64)
        for b in batches:
            for w, bit in _bits(b.column(0).to_numpy().view(np.uint64), words):
                np.bitwise_or.at(own, w, bit)
        at = np.flatnonzero(own)
        for i in range(0, len(at), 20_000):
            yield pa.RecordBatch.from_arrays([pa.array(at[i : i + 20_000]), pa.array(own[at[i : i + 20_000]].view(np.int64))], ["w", "bits"])

    rows = hashes.select("h").mapInArrow(fill, "w bigint, bits bigint").groupBy("w").agg(F.bit_or("bits").alias("bits")).toPandas()
    out = np.zeros(words, dtype=np.uint64)
    out[rows["w"].to_numpy()] = rows["bits"].to_numpy().view(np.uint64)
    return BloomSet(out)


def _leaks(docs: DataFrame, items: DataFrame, known: Callable[[np.ndarray], np.ndarray], least: int, size: int, split: Callable[[str | None], list[list[str]]]) -> DataFrame:
    """Leaks of ``items`` (item, words array, hashes array) in one pass over ``docs``; ``known`` tells which hashes may be shingles of items."""
    need = least - size + 1
    kind = docs.schema["id"].dataType.simpleString()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = _WordHashes()
        for b in batches:
            ids, seen, parts, starts, hs, ws = [], [], [], [], [], []
            for row, text in enumerate(b.column(1)):
                found: set[int] = set()
                for part, tokens in enumerate(split(text.as_py())):
                    h = shingle_hashes(tokens, size, cache)
                    if not len(h):
                        continue
                    hit = known(h)
                    if not hit.any():
                        continue
                    signed = h.view(np.int64)
                    found.update(signed[hit].tolist())
                    for a, z in _runs(hit):
                        # long runs in pieces that overlap by a window less one place
                        for c in range(a, z - need + 1, PIECE):
                            e = min(z, c + PIECE + need - 1)
                            ids.append(row), seen.append([]), parts.append(part), starts.append(c)
                            hs.append(signed[c:e].tolist()), ws.append(tokens[c : e + size - 1])
                if found:
                    ids.append(row), seen.append(sorted(found)), parts.append(-1), starts.append(0), hs.append([]), ws.append([])
            longs = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(ids, pa.int64())), pa.array(seen, longs), pa.array(parts, pa.int32()), pa.array(starts, pa.int64()), pa.array(hs, longs), pa.array(ws, pa.list_(pa.string()))],
                ["id", "seen", "part", "start", "hashes", "words"],
            )

    hits = cut(docs.mapInArrow(scan, f"id {kind}, seen array<bigint>, part int, start bigint, hashes array<bigint>, words array<string>"))
    rarity = hits.where("part = -1").select(F.explode("seen").alias("h")).groupBy("h").agg(F.count("*").alias("df"))
    at = items.select("item", F.posexplode("hashes").alias("pos", "h")).join(rarity, "h")
    w = Window.partitionBy("item").orderBy("pos").rowsBetween(0, need - 1)
    # a window whose shingles are not all in the corpus cannot be held; of the others the rarest shingle is the necessary prefix
    whole = at.select("item", "pos", F.min(F.struct("df", "h", F.col("pos").alias("ppos"))).over(w).alias("rarest"), F.count("*").over(w).alias("n"), F.max("pos").over(w).alias("last"))
    prefix = whole.where((F.col("n") == need) & (F.col("last") == F.col("pos") + need - 1)).select("item", F.col("pos").alias("window"), F.col("rarest.h").alias("h"), (F.col("rarest.ppos") - F.col("pos")).alias("inside"))
    # of a run, each shingle takes along the words of the windows it may be in
    runs = hits.where("part >= 0").select("id", "part", "words", F.posexplode("hashes").alias("at", "h"))
    first = F.greatest(F.col("at") - (need - 1), F.lit(0))
    runs = runs.select("id", "part", "h", (F.col("at") - first).alias("at"), F.slice("words", first + 1, F.lit(least + need - 1)).alias("words"))
    # positional bounds: the window must lie within the run
    held = runs.join(prefix, "h").withColumn("begin", F.col("at") - F.col("inside")).where((F.col("begin") >= 0) & (F.col("begin") + least <= F.size("words")))
    texts = items.select("item", F.col("words").alias("item_words"))
    exact = held.join(texts, "item").where(F.slice("words", F.col("begin").cast("int") + 1, least) == F.slice("item_words", F.col("window").cast("int") + 1, least))
    return exact.groupBy("id", "item").agg(F.countDistinct("window").alias("n_windows"), F.min("part").alias("first_part"))


def find_leaks(
    corpus: DataFrame, ident: str, text: str, items: DataFrame, item_id: str, item_text: str, least: int = LEAST, size: int = SHINGLE,
    split: Callable[[str | None], list[list[str]]] = mail_words, block_shingles: int = BLOCK_SHINGLES, filter_words: int = FILTER_WORDS,
) -> DataFrame:
    """``(ident, item_id, n_windows, first_part)``: texts that hold at least ``least`` consecutive words of an item within one part.

    Method: prefix-filtered set join. A text holds a window of ``least`` words of an item only if it holds all its shingles of
    ``size`` words, hence also its rarest by number of texts: shingles are ordered by rarity over the whole corpus, and only the rarest
    of each window, the necessary prefix, is joined. Bounds follow: a run of consecutive item shingles long enough, and a place
    in it where the whole window fits. What is left is compared word by word, so hash collisions add nothing.

    ``n_windows`` counts the windows of the item found in the text; ``first_part`` is the part of the first. ``split`` makes word lists
    of the parts of a text. However many items there are, the corpus is read once: the scan lets pass what may be an item's shingle, by
    all their hashes if there are at most ``block_shingles``, else by a Bloom filter of at most ``filter_words`` words, and what passes
    meets the items in joins. Items and parts of fewer than ``least`` words hold and leak nothing; NULL and empty texts neither.
    Repeated ids come out once per item. Whole texts are read; only runs of possible item shingles leave the scan.
    """
    if least < size:
        raise ValueError("least must not be less than size")
    docs = corpus.select(F.col(ident).alias("id"), F.col(text).cast("string").alias("text"))
    kind = items.schema[item_id].dataType.simpleString()

    def shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = _WordHashes()
        for b in batches:
            ids, ws, hs = [], [], []
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                tokens = words(t or "")
                if len(tokens) >= least:
                    ids.append(i), ws.append(tokens), hs.append(shingle_hashes(tokens, size, cache).view(np.int64).tolist())
            yield pa.RecordBatch.from_arrays([pa.array(ids, b.column(0).type), pa.array(ws, pa.list_(pa.string())), pa.array(hs, pa.list_(pa.int64()))], ["item", "words", "hashes"])

    slim = items.select(F.col(item_id).alias("item"), F.col(item_text).cast("string").alias("t")).where("item is not null").distinct()
    asked = cut(slim.mapInArrow(shingles, f"item {kind}, words array<string>, hashes array<bigint>"))
    hashes = asked.select(F.explode("hashes").alias("h")).distinct()
    n = hashes.count()
    # either is bounded: hashes by ``block_shingles``, the filter by ``filter_words``
    known = ExactSet(hashes.toPandas()["h"].to_numpy().view(np.uint64)) if n <= block_shingles else bloom_set(hashes, min(filter_words, max(1, n // 4)))
    return _leaks(docs, asked, known, least, size, split).withColumnsRenamed({"id": ident, "item": item_id})
