"""Statistics of a mail's text that tell prose from lists, tables and junk."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loam.llm.mail import author_lines, text_parts

#: Words of a text above which n-grams are counted as numbers.
_MANY_WORDS = 20_000
#: Very common words of English, German, Polish and Ukrainian.
COMMON = frozenset(
    "the be to of and a in that have it for not on with as you do at this but by from they we or an will my one all would there their is are was our every which because so "
    "der die das und in zu den ist nicht ein eine mit sich auf für im dem von des aber wir ich sie es an bei keine unsere diese jede "
    "i w na z się nie do to że jest o jak po co ale od za przez dla nasza każda jedna pewna inna "
    "і в на з що не до це за та як по але від для він вона ми ви є у або так вже бо щоб одна наша кожна ця така їхня".split()
)
#: A line with a mark or number of a list entry before its text.
_LIST = re.compile(r"^\s*(?:[-*•·‣◦–—+▪■►→☐☑✔]\s+\S|\(?\d{1,4}[.)]\s+\S|\(?[^\W\d_][.)]\s+\S|\(?[ivxlIVXL]+[.)]\s+\S|\[[ xX✓✔-]?\]\s*\S)")
_RULE = re.compile(r"^[\s+|=:-]*[-=]{3,}[\s+|=:-]*$")
_PIPES = re.compile(r"^\s*\|.*\|.*\|\s*$|^[^|]+\|[^|]+\|[^|]+")
_COLUMNS = re.compile(r"\S(?: {2,}|\t+)\S")
_THOUSANDS = re.compile(r"(?<=\d),(?=\d{3}(?!\d))")
_URL = re.compile(r"^<?(?:https?|ftp)://\S+>?$")
_LOG = re.compile(r"^[\[<(]?\d{1,4}[:.-]\d{1,2}[:.-]\d{1,4}\S*[\])>]?\s.*(?:0x[0-9a-f]+|<\w+>|\b(?:ERR|WRN|DBG|INFO|WARN|ERROR|DEBUG|TRACE)\b|\w+=\S+)|^(?:0x)?[0-9a-fA-F]{4,16}[:\s](?:\s*[0-9a-fA-F]{2,8}\b){4,}")
_TRACE = re.compile(r"^(?:at |Traceback|Exception)\S*\(.*\)$")
_BLOB = re.compile(r"^[A-Za-z0-9+/=_-]{24,}$")
#: Signs of a text that was decoded by the wrong charset: UTF-8 of letters with marks, of Cyrillic or of typographic signs, read byte by byte.
_SUSPECT = re.compile("[ÃÂÐÑâ\ufffd]")
_MOJIBAKE = re.compile("[ÃÂÐÑ][\x80-\xbf\xa0-\xbf\ufffdŒœŠšŽžŸƒˆ˜–—‘’‚“”„†‡•…‰‹›€™?]|\ufffd")
_GARBLED = re.compile("Ã[\x80-\xbf¤¶¼Ÿ„–œ\ufffd]|[ÐÑ][\x80-\xbf\ufffd?][^\\s]*[ÐÑ][\x80-\xbf\ufffd?]|â€")
_VOICELESS = re.compile(r"(?<![^\W\d_])[^\W\d_aeiouyäöüąęóаеєиіїоуюяыэё]{2,}(?![^\W\d_])", re.I)
_WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*|\d+")
_SENTENCE = re.compile(r"[.!?…][\"'»”)\]]*\s*$")
_END = re.compile(r"[.!?…:;,][\"'»”)\]]*$")
_INSIDE = re.compile(r"[.!?…,;:][\"'»”)\]]*\s+[^\W_]")

#: Words and letters of a line that may be an entry without a mark; entries without marks that make a list; share of common words from which lines
#: are running text, and of lines with marks of sentences.
SHORT_WORDS, SHORT_LETTERS, SIBLINGS, COMMON_TEXT, MARKED_TEXT = 6, 60, 3, 0.1, 0.2
#: Repetition: share of lines or paragraphs that came before; share of the letters that one n-gram covers, of how many words on.
REPEATED, COVERED, COVERED_WORDS = 0.5, 0.4, 20
#: A text is prose whatever its short lines look like from these shares of common words and of lines that end a sentence on; its
#: undecided lines are noise if there are fewer common words and more symbols than this.
PROSE_COMMON, PROSE_ENDING, NOISE_COMMON, NOISE_SYMBOLS = 0.2, 0.5, 0.02, 0.3


def line_kind(line: str, suspect: bool = True) -> str:
    """What one non-blank line is by itself.

    list (with a mark), table (bars, tabs or columns), cells (cut by commas or semicolons, a table row if others are cut alike), junk,
    rule (a line drawn between rows or paragraphs), short (may be an entry of a list without marks) or text.
    """
    s = line.strip()
    words = _WORD.findall(s)
    solid = len(s) - s.count(" ") - s.count("\t")
    alnum = sum(map(len, words)) - s.count("'") - s.count("’")
    if alnum == 0 and _RULE.match(s) and ("+" in s or s.count("|") >= 2):
        return "table"
    letters = [w for w in words if not w[0].isdigit()]
    has_digit = len(letters) < len(words)
    marked = bool(_LIST.match(line))
    if "://" in s and _URL.match(s) or has_digit and _LOG.match(s) or s[-1] == ")" and _TRACE.match(s) or len(s) == solid >= 24 and _BLOB.match(s) and (not s.isalpha() or len(s) > 40):
        return "junk"
    if len(s) > 2 and alnum < 0.3 * solid and not marked:
        return "rule" if len(set(s)) <= 2 else "junk"
    if suspect and (_GARBLED.search(s) or len(_MOJIBAKE.findall(s)) >= max(2, 0.02 * len(s))):
        return "junk"
    if len(letters) >= 5 and 2 * len(set(letters)) <= len(letters):
        return "junk"
    if letters and not has_digit and len(s) > 5:
        long_ = sum(len(w) >= 2 for w in letters)
        if long_ and len(_VOICELESS.findall(s)) > 0.6 * long_:
            return "junk"
    if "|" in s and _PIPES.match(s) or "\t" in s or "  " in s and len(_COLUMNS.findall(s)) >= 2:
        return "table"
    if marked:
        return "list"
    if cell_delimiter(s):
        return "cells"
    if len(letters) <= SHORT_WORDS and len(s) < SHORT_LETTERS and not _END.search(s):
        return "short"
    return "text"


def cell_delimiter(s: str) -> str | None:
    """The sign that cuts a line into three or more cells with no blank after it; marks of thousands in a sentence do not count."""
    for d in ";,":
        if s.count(d) >= 2:
            t = _THOUSANDS.sub("", s) if d == "," and " " in s else s
            if t.count(d) >= 2 and d + " " not in t:
                return d
    return None


def settle_lines(lines: list[str], kinds: list[str]) -> list[str]:
    """Kinds of non-blank ``lines`` in their context: cells are table rows if another line is cut into as many, else text; short lines
    are entries beside a marked entry or in a stretch of like ones, unless the stretch reads as running text; else they are text."""
    out = list(kinds)
    shape = {i: (d, lines[i].count(d)) for i, k in enumerate(kinds) if k == "cells" and (d := cell_delimiter(lines[i].strip()))}
    often = Counter(shape.values())
    for i in shape:
        out[i] = "table" if often[shape[i]] > 1 else "text"
    i, n = 0, len(lines)
    while i < n:
        if kinds[i] != "short":
            i += 1
            continue
        j = i
        while j < n and kinds[j] == "short":
            j += 1
        stretch = lines[i:j]
        beside = i > 0 and kinds[i - 1] == "list" or j < n and kinds[j] == "list"
        # neighbours tell wrapped sentences: their last words end in other lines
        around = [lines[k] for k in (i - 1, j) if 0 <= k < n and kinds[k] == "text"]
        words = [w.lower() for x in stretch for w in _WORD.findall(x) if not w[0].isdigit()]
        common = sum(w in COMMON for w in words) / len(words) if words else 0.0
        marks = sum(bool(_INSIDE.search(x)) for x in stretch) + sum(len(x.split()) <= SHORT_WORDS for x in around)
        running = common >= COMMON_TEXT or marks >= MARKED_TEXT * (len(stretch) + len(around))
        entry = not running and (beside or len(stretch) >= SIBLINGS)
        out[i:j] = ["list" if entry else "text"] * (j - i)
        i = j
    return out


def _dominant(words: list[str], chars: int, sizes: tuple[int, ...] = (2, 3, 4)) -> float:
    """Largest share of the characters that one n-gram of words covers, over the sizes; n-grams that come once cover nothing."""
    best = 0.0
    if len(words) > _MANY_WORDS:  # the same from numbers, eight bytes an n-gram
        ids: dict[str, int] = {}
        seq = np.fromiter((ids.setdefault(w, len(ids)) for w in words), dtype=np.uint64, count=len(words))
        length = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        for n in sizes:
            code = np.zeros(len(seq) - n + 1, dtype=np.uint64)
            for i in range(n):
                code = code * np.uint64(0x9E3779B97F4A7C15) + seq[i : len(seq) - n + 1 + i]
            _, at, k = np.unique(code, return_index=True, return_counts=True)
            top = k.max()
            if top > 1:
                first = at[k == top].min()
                best = max(best, min(1.0, int(top) * int(length[first : first + n].sum()) / chars))
        return best
    for n in sizes:
        if len(words) >= 2 * n and chars:
            gram, k = Counter(zip(*(words[i:] for i in range(n)))).most_common(1)[0]
            if k > 1:
                best = max(best, min(1.0, k * sum(map(len, gram)) / chars))
    return best


def text_kind(lines: list[str], stats: dict[str, float]) -> tuple[str, dict[str, float]]:
    """Kind of a text by its author's non-blank lines and its statistics, and the shares of list entries, table rows and junk lines.

    The kinds of lines are settled by what the statistics say: in prose (many common words, or most lines end a sentence) short lines
    are no entries; in noise (hardly a common word, many symbols) lines that are nothing else are noise, as in a text of which a quarter
    was decoded wrongly. Repetition (lines or paragraphs said before, one phrase covering the text) is junk whatever the lines are.
    """
    suspect = any(map(_SUSPECT.search, lines))
    kinds = settle_lines(lines, own := [line_kind(x, suspect) for x in lines])
    prose = stats["common_share"] >= PROSE_COMMON or stats["ending_share"] >= PROSE_ENDING
    noise = stats["common_share"] < NOISE_COMMON and stats["symbol_ratio"] > NOISE_SYMBOLS
    garbled = sum(bool(_GARBLED.search(x)) for x in lines) if suspect else 0
    count = Counter("text" if prose and k == "list" and o == "short" else k for k, o in zip(kinds, own))
    n = len(lines) - count["rule"]
    if noise or garbled >= 2 and garbled > 0.25 * n:
        count["junk"] += count["text"]
    share = {k: count[k] / n if n else 0.0 for k in ("list", "table", "junk")}
    repeats = len(lines) >= 4 and max(stats["duplicate_line_share"], stats["duplicate_paragraph_share"] if stats["n_paragraphs"] >= 3 else 0.0) > REPEATED
    covered = len(lines) >= 4 and stats["n_words"] >= COVERED_WORDS and stats["dominant_ngram_share"] >= COVERED
    if not lines:
        return "empty", share
    if share["junk"] > 0.5 or repeats or covered:
        return "junk", share
    if share["table"] > 0.5:
        return "table", share
    if share["list"] > 0.5:
        return "list", share
    return "prose", share


def text_statistics(text: str | None) -> dict[str, object]:
    """Statistics of a raw mail: see ``quality_statistics``."""
    parts = text_parts(text)
    own = author_lines(parts)
    lines = [x for x in own.lines if x.strip()]
    joined = "\n".join(own.lines)
    words = [w.lower() for w in _WORD.findall(joined)]
    letters = sum(map(len, words))
    solid = sum(map(len, joined.split()))
    alnum, digits = letters - joined.count("'") - joined.count("’"), sum(len(w) for w in words if w[0].isdigit())
    alnum = max(0, min(alnum, solid))
    paragraphs = [p.strip() for p in re.split(r"\n\s*\n", joined) if p.strip()]
    same = Counter(x.strip() for x in lines)
    stats = {
        "n_chars": len(text or ""), "n_parts": len(parts), "n_lines": len(lines), "n_paragraphs": len(paragraphs), "n_words": len(words), "mean_word_length": letters / len(words) if words else 0.0,
        "symbol_ratio": (solid - alnum) / solid if solid else 0.0,
        "digit_ratio": digits / solid if solid else 0.0,
        "ending_share": sum(bool(_SENTENCE.search(x)) for x in lines) / len(lines) if lines else 0.0,
        "common_share": sum(map(COMMON.__contains__, words)) / len(words) if words else 0.0,
        "duplicate_line_share": sum(k - 1 for k in same.values()) / len(lines) if lines else 0.0, "duplicate_paragraph_share": 1 - len(set(paragraphs)) / len(paragraphs) if paragraphs else 0.0,
        "dominant_ngram_share": _dominant(words, letters),
    }
    kind, share = text_kind(lines, stats)
    whole = max(1, own.quoted + own.boilerplate + len(lines))
    return stats | {
        "list_share": share["list"], "table_share": share["table"], "junk_share": share["junk"],
        "quoted_share": own.quoted / whole, "boilerplate_share": own.boilerplate / whole, "kind": kind,
    }


_TYPES = {int: T.LongType(), float: T.DoubleType(), str: T.StringType()}
#: Name and type of every statistic.
STATISTICS = {k: _TYPES[type(v)] for k, v in text_statistics("a").items()}


def quality_statistics(df: DataFrame, ident: str, text: str) -> DataFrame:
    """``ident`` and statistics of each raw mail, one row per row of ``df``.

    Of the whole text: ``n_chars`` (code points), ``n_parts`` (text parts). Of the lines its author wrote, that is without headers,
    quoted and forwarded text, greeting, closing, signature, disclaimer and attachments: ``n_lines`` (not blank), ``n_paragraphs``,
    ``n_words``, ``mean_word_length``, ``symbol_ratio`` and ``digit_ratio`` (of characters that are no blanks), ``ending_share`` (lines that
    end a sentence), ``common_share`` (very common words of four languages), ``duplicate_line_share`` and ``duplicate_paragraph_share``
    (lines and paragraphs that came before), ``dominant_ngram_share`` (letters covered by the one most frequent 2-, 3- or 4-gram),
    ``list_share``, ``table_share``, ``junk_share`` (lines that are list entries, table rows, or machine output, noise or empty
    repetition, in their context: ``settle_lines``), ``quoted_share`` and ``boilerplate_share`` (of all lines of the mail). ``kind``
    (``text_kind``): ``junk`` by repetition or if more than half of the author's lines are that, else ``table`` or ``list`` by the same
    measure, ``empty`` without any line, else ``prose``. NULL and empty texts: zeros and ``empty``. Whole texts are read, however long.
    One pass over the texts, no shuffle.
    """
    slim = df.select(F.col(ident).alias("id"), F.col(text).cast("string").alias("text"))
    names = list(STATISTICS)
    schema = T.StructType([T.StructField("id", slim.schema["id"].dataType), *(T.StructField(k, t) for k, t in STATISTICS.items())])
    kinds = {T.LongType(): pa.int64(), T.DoubleType(): pa.float64(), T.StringType(): pa.string()}

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [text_statistics(x.as_py()) for x in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array([r[k] for r in rows], kinds[STATISTICS[k]]) for k in names)], ["id", *names])

    return slim.mapInArrow(measure, schema).withColumnRenamed("id", ident)
