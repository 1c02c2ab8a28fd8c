"""Raw mails to their text parts, and text parts to the lines their author wrote."""

from __future__ import annotations

import binascii
import html
import re
from typing import NamedTuple


class Part(NamedTuple):
    """A text part of a mail: decoded text, markup removed; lines of HTML quotes begin with '> '."""

    text: str
    is_html: bool
    attached: bool


_HEADER = re.compile(r"([A-Za-z][A-Za-z0-9-]*)[ \t]*:[ \t]*(.*)")
_PARAM = re.compile(r';\s*([\w*-]+)\s*=\s*(?:"([^"]*)"|([^\s;]+))')


def _split_head(text: str) -> tuple[dict[str, str], str, bool]:
    """Headers (lower case names; the first of a name holds), body, and whether there is a header block at all."""
    lines_end, headers, name, pos, any_ = len(text), {}, "", 0, False
    first = True
    while pos < lines_end:
        end = text.find("\n", pos)
        line = text[pos : end if end >= 0 else lines_end]
        after = end + 1 if end >= 0 else lines_end
        if not line.strip():
            return headers, text[after:], any_
        if line[0] in " \t" and name:
            headers[name] += " " + line.strip()
        elif m := _HEADER.match(line):
            name, any_ = m[1].lower(), True
            if name in headers:
                name = ""
            else:
                headers[name] = m[2].strip()
        elif line.startswith(("From ", ">From ")) and (first or re.search(r"\b\d{4}\s*$", line)):
            name = ""
        elif line[0] in " \t":
            pass
        else:
            return headers, text[pos:], any_
        pos, first = after, False
    return headers, "", any_


def _content_type(value: str) -> tuple[str, dict[str, str]]:
    return value.split(";", 1)[0].strip().lower(), {k.lower(): a or b for k, a, b in _PARAM.findall(value)}


def _quoted_printable(text: str, charset: str) -> str:
    return _to_text(binascii.a2b_qp(text.encode("utf-8", "replace")), charset)


def _to_text(data: bytes, charset: str) -> str:
    try:
        return data.decode(charset or "utf-8", "replace")
    except LookupError:
        return data.decode("utf-8", "replace")


def _base64(text: str, charset: str) -> str:
    letters = re.sub(r"[^A-Za-z0-9+/]", "", text)
    letters = letters[: len(letters) - (len(letters) % 4 == 1)]
    return _to_text(binascii.a2b_base64(letters + "=" * (-len(letters) % 4)), charset)


_DROP = re.compile(r"<!--.*?-->|<(head|style|script|title)\b.*?</\1\s*>", re.S | re.I)
_BREAK = re.compile(r"<br\b[^>]*>[ \t]*\n?|</?(?:p|div|li|ul|ol|tr|table|h[1-6]|pre|hr|body|html|section|article)\b[^>]*>", re.I)
_CELL = re.compile(r"</t[dh]\s*>\s*(?=<t[dh]\b)", re.I)
_ITEM = re.compile(r"<li\b[^>]*>", re.I)
_QUOTE = re.compile(r"(<blockquote\b[^>]*>|</blockquote\s*>)", re.I)
_TAG = re.compile(r"<[A-Za-z/!?][^<>]*>")


def html_text(source: str) -> str:
    """Text of HTML: block tags break lines, cells are set apart by tabs, list items begin with '- ', quotes with '> '."""
    depth, out = 0, []
    for piece in _QUOTE.split(_DROP.sub("", source)):
        if piece[:11].lower() == "<blockquote":
            depth += 1
            continue
        if piece[:12].lower() == "</blockquote":
            depth = max(0, depth - 1)
            continue
        piece = re.sub(r"[ \t]*\n[ \t]*", " ", piece) if "<pre" not in piece.lower() else piece
        piece = _BREAK.sub("\n", _ITEM.sub("\n- ", _CELL.sub("\t", piece)))
        piece = html.unescape(_TAG.sub("", piece)).replace(" ", " ")
        if depth:
            piece = "\n".join("> " * depth + x.lstrip(" ") for x in piece.split("\n"))
        out.append(piece)
    return "\n".join(out) if len(out) > 1 else "".join(out)


def _leaf(kind: str, params: dict[str, str], headers: dict[str, str], body: str) -> Part | None:
    attached = "attachment" in headers.get("content-disposition", "").lower() or "filename=" in headers.get("content-disposition", "").lower()
    if kind and not kind.startswith("text/"):
        return None
    coding, charset = headers.get("content-transfer-encoding", "").lower().strip(), params.get("charset", "")
    if coding == "base64":
        body = _base64(body, charset)
    elif coding == "quoted-printable":
        body = _quoted_printable(body, charset)
    body = body.replace("\r\n", "\n").replace("\r", "\n")
    is_html = kind == "text/html" or (not kind and bool(re.match(r"\s*<(!doctype|html)\b", body, re.I)))
    return Part(html_text(body) if is_html else body, is_html, attached)


def _inner(body: str, mark: str) -> list[tuple[dict[str, str], str]] | None:
    """Headers and bodies of the parts of a multipart body; None if its boundary never comes."""
    pieces = re.split(rf"(?m)^--{re.escape(mark)}(--)?[ \t]*$\n?", body)
    if len(pieces) < 2:
        return None
    out = []
    for closing, piece in zip(pieces[1::2], pieces[2::2]):
        if closing:
            break
        h, b, _ = _split_head(piece) if not piece.startswith("\n") else ({}, piece[1:], False)
        out.append((h, b))
    return out


def _head_and_body(text: str) -> tuple[dict[str, str], str]:
    text = text.lstrip("\n﻿")
    headers, body, any_ = _split_head(text)
    return headers, body if any_ else text


def text_parts(text: str | None) -> list[Part]:
    """The text parts of a raw mail, transfer encodings undone, charsets applied, markup dropped; attached text files are parts.

    Headers are left out. A text without a header block is one plain part. Broken multiparts (no boundary line) are one plain part.
    Parts within parts and mails within mails are opened however deep they lie.
    """
    if not text:
        return []
    out: list[Part] = []
    stack = [_head_and_body(text.replace("\r\n", "\n").replace("\r", "\n"))]
    while stack:
        headers, body = stack.pop()
        kind, params = _content_type(headers.get("content-type", ""))
        if kind.startswith("multipart/"):
            inner = _inner(body, params["boundary"]) if params.get("boundary") else None
            if inner is not None:
                stack.extend(reversed(inner))
                continue
            kind, params = "", {}
        if kind == "message/rfc822":
            if body:
                stack.append(_head_and_body(body))
            continue
        leaf = _leaf(kind, params, headers, body)
        if leaf:
            out.append(leaf)
    return out


_MARKS = re.compile(r"(?m)^[ \t]*(?:>[ \t]*)+")
_WORD = re.compile(r"[^\W_]+")


def words(text: str) -> list[str]:
    """Lower-case runs of letters or digits, quote marks at line starts dropped."""
    if ">" in text:
        text = _MARKS.sub("", text)
    return _WORD.findall(text.lower())


# ---- the lines the author wrote

#: How the line before a quoted mail ends or what it is, in four languages.
ATTRIBUTION = re.compile(r"(?i)^(?:on\b.{4,200}\bwrote:|am\b.{4,200}\bschrieb\b.{0,200}:|.{6,200}\bnapisał(?:\(a\)|a)?:|.{6,200}\b(?:пише|пишет|написав|написала|написав\(ла\)):)$")
ORIGINAL = re.compile(r"(?i)^-{2,}\s*(?:original|forwarded|ursprüngliche|weitergeleitete|wiadomość|oryginalna|przekazana|переслане|пересланное|початкове|оригінальне|начало|begin)\b.*-{2,}$|^begin forwarded message:?$")
#: Words a greeting or a closing begins with.
GREETING = re.compile(r"(?i)^(?:hi|hello|dear|hey|good (?:morning|afternoon|evening|day)|hallo|liebe[rs]?|guten (?:tag|morgen|abend)|sehr geehrte[rs]?|moin|cześć|witam|witaj|dzień dobry|szanown\w+|drog\w+|вітаю|привіт|добр(?:ий|ого|ої) (?:день|дня|ранку|вечір|вечора)|доброго|шановн\w+|дорог\w+)\b.{0,60}$")
CLOSING = re.compile(r"(?i)^(?:(?:best|kind|warm) (?:regards|wishes)|best(?=[,!]?$)|regards|thanks(?: (?:a lot|again|in advance))?|thank you|many thanks|cheers|see you(?: \w+)?|take care|bye|sincerely|yours(?: \w+)?|all the best|(?:viele|beste|liebe|schöne|herzliche|freundliche) grüße|mit (?:freundlichen|besten|herzlichen) grüßen|gruß|bis (?:bald|dann|später)|tschüss|lg|vg|danke|pozdrawiam|do zobaczenia|na razie|pozdrowienia|z poważaniem|dziękuję|serdecznie|з повагою|до зустрічі|бувайте|дякую|щиро|на все добре|всього найкращого|з найкращими побажаннями)\b[^.?!]{0,30}[,!]?$")
#: How a disclaimer begins.
DISCLAIMER = re.compile(r"(?i)^(?:confidential(?:ity)?\b|please consider\b|this (?:e-?mail|message|communication)\b.{0,80}|the information (?:contained )?in this|disclaimer|diese (?:e-?mail|nachricht)\b|vertraulich|ta wiadomość\b|niniejsza wiadomość|wiadomość (?:ta )?jest poufna|poufne|це повідомлення\b|цей лист\b|конфіденційно)")


_RULED = re.compile(r"([_*=~#-])\1{9,}")


class Author(NamedTuple):
    """What is left of a mail for its author: the lines, and how many lines were taken away by reason."""

    lines: list[str]
    quoted: int
    boilerplate: int


def author_lines(parts: list[Part]) -> Author:
    """The lines the author wrote: of the first plain part (or else HTML part) that is not attached, without quoted and forwarded
    text, greeting, closing, signature and disclaimer."""
    own = [p for p in parts if not p.attached]
    body = next((p for p in own if not p.is_html and p.text.strip()), None) or next((p for p in own if p.text.strip()), None)
    if body is None:
        return Author([], 0, 0)
    lines = [x.rstrip() for x in body.text.split("\n")]
    kept: list[str] = []
    quoted = boilerplate = 0
    bars = False  # whether a quote in this mail is marked with bars
    i, n = 0, len(lines)
    while i < n:
        s = lines[i].strip()
        if lines[i].startswith("--") and not lines[i][2:].strip():
            rest = [x.strip() for x in lines[i:] if x.strip()]
            quoted += sum(x[0] in ">|" for x in rest)
            boilerplate += sum(x[0] not in ">|" for x in rest)
            break
        if ORIGINAL.match(s):
            quoted += sum(bool(x.strip()) for x in lines[i:])
            break
        pair = s + " " + lines[i + 1].strip() if s and i + 1 < n and len(lines[i + 1]) < 60 else ""
        if s.startswith(">"):
            quoted += 1
        elif s.endswith(":") and ATTRIBUTION.match(s) or pair.endswith(":") and ATTRIBUTION.match(pair):
            i += 0 if s.endswith(":") else 1
            quoted += 1
            j = i + 1
            while j < n and not lines[j].strip():
                j += 1
            bars = bars or j < n and lines[j].lstrip().startswith("|")
            while bars and j < n and lines[j].lstrip().startswith("|"):
                quoted, i, j = quoted + 1, j, j + 1
        elif bars and s.startswith("|"):
            j = i
            while j < n and lines[j].lstrip().startswith("|"):
                j += 1
            run = [x.strip() for x in lines[i:j]]
            if all(x.endswith("|") and x.count("|") > 2 for x in run):  # a table of the author's own
                kept += lines[i:j]
            else:
                quoted += j - i
            i = j - 1
        else:
            kept.append(lines[i])
        i += 1
    while kept and not kept[-1].strip():
        kept.pop()
    to_end, later = [], 0  # lines that are not blank from each line to the end
    for x in reversed(kept):
        later += bool(x.strip())
        to_end.append(later)
    to_end.reverse()
    for k, x in enumerate(kept):  # a disclaimer runs to the end, a rule above it belongs to it
        ruled = bool(_RULED.fullmatch(x.strip()))
        if not ruled and not DISCLAIMER.match(x.strip()):
            continue
        later = to_end[k]
        if ruled and later <= 9 and not any(re.fullmatch(r"[|+].*[|+]", y.strip()) for y in kept[k + 1 :]) or not ruled and later <= 14:
            while k and not kept[k - 1].strip():
                k -= 1
            boilerplate += later
            kept = kept[:k]
            break
    filled = [k for k, x in enumerate(kept) if x.strip()]
    if filled and GREETING.match(kept[filled[0]].strip()) and len(kept[filled[0]]) < 70:
        boilerplate += 1
        kept = kept[filled[0] + 1 :]
    filled = [k for k, x in enumerate(kept) if x.strip()]
    for back in filled[-4:]:
        if CLOSING.match(kept[back].strip()) and all(len(kept[j]) < 60 for j in filled if j > back):
            boilerplate += sum(j >= back for j in filled)
            kept = kept[:back]
            break
    return Author(kept, quoted, boilerplate)
