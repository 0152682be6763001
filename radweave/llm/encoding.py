"""Text decoded with the wrong character encoding: detection and repair.

Damage shows only in runs of characters beyond ASCII and in escapes, so every text is cut
into such *islands* with their neighbours.  For each distinct island a best-first
graph search looks for the cheapest reachable spelling: nodes are spellings
(hashed in a visited set), edges are unescape steps (one layer of HTML, backslash or percent
escapes) and encode-decode steps (UTF-8 bytes read in one of several code pages; bytes of one
code page read in another), and the cost is the implausibility of the characters in their place.
Unescaping and UTF-8 steps shorten the spelling; a code-page step may follow any step but a
code-page step that made the text no more plausible, so the graph stays finite.  The search
ends when no open spelling can be cheaper than the best one.

An island is damaged if a spelling at least ``MARGIN`` cheaper is reached, or if it holds
what no proper writing has: C1 controls or the replacement character.
"""

from __future__ import annotations

import heapq
import html
import math
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARGIN = 1.9
#: An escape, behind any number of escaped ampersands.
ESCAPED = re.compile(
    r"(?:&|\\u0026|\\x26|%26)(?:amp;)*(?:#[0-9]{2,6}|#x[0-9a-fA-F]{2,5}|[A-Za-z]{2,8}[0-9]{0,2});|\\u[0-9a-fA-F]{4}|\\x[c-fC-F][0-9a-fA-F](?:\\x[89abAB][0-9a-fA-F])+|%[c-fC-F][0-9a-fA-F](?:%[89abAB][0-9a-fA-F])+"
)
_LAYER = re.compile(r"\\u[0-9a-fA-F]{4}|\\x26|%26|&(?:#[0-9]{2,6}|#x[0-9a-fA-F]{2,5}|[A-Za-z]{2,8}[0-9]{0,2});|\\x[c-fC-F][0-9a-fA-F](?:\\x[89abAB][0-9a-fA-F])+|%[c-fC-F][0-9a-fA-F](?:%[89abAB][0-9a-fA-F])+")
ISLAND = re.compile(rf"(?:[^\x00-\x7f]|{ESCAPED.pattern})+")
PLAIN_ISLAND = re.compile(r"[^\x00-\x7f]+")

# Code pages in which UTF-8 bytes are commonly misread.
MISREAD = ("cp1252", "latin-1", "cp1250", "cp1251", "cp1253", "cp1254", "mac_roman", "cp437", "cp850", "cp866", "koi8-r")
# Pairs (read as, written in) of single-byte code pages.
SWAPPED = (
    ("mac_roman", "cp1252"), ("cp1252", "mac_roman"), ("cp437", "cp1252"), ("cp850", "cp1252"), ("cp1252", "cp437"),
    ("cp1252", "cp850"), ("cp1250", "cp1252"), ("cp1251", "cp1252"), ("cp1252", "cp1251"), ("mac_roman", "cp850"), ("cp850", "mac_roman"),
)
# Letters beyond Latin-1 of the languages at hand, and usual signs.
LETTERS = frozenset("ŒœŸńŃǹǸḿḾṣṢẹẸọỌẽẼşŞğĞıİłŁśŚšŠžŽčČěřőűąęćżźţŢğ")
SIGNS = frozenset("°±×÷≤≥µ≈€№™®©²³½¼¾·•†‰→←∅≠∞")
DASHES = frozenset("–—…«»‹›")
OPENING, CLOSING = frozenset("“‘„‚"), frozenset("”")
TRUSTED = frozenset("°±×÷≤≥–—…«»“”‘’„•") | frozenset("µ€²³½¼¾·")


def _byte_of(codec: str) -> dict[int, str]:
    """Translation of every character of a code page's upper half to the character of its byte; free bytes stand for themselves."""
    table = {}
    for b in range(0x80, 0x100):
        table[b] = chr(b) if b < 0xA0 or codec == "latin-1" else "\x00"
    for b in range(0x80, 0x100):
        try:
            table[ord(bytes([b]).decode(codec))] = chr(b)
        except UnicodeDecodeError:
            pass
    return table


class _Bytes(dict):
    """str.translate table: characters outside the code page become a mark."""

    def __missing__(self, key: int) -> str:
        return "\x00"


_TABLES = {c: _Bytes(_byte_of(c)) for c in MISREAD}
#: The surroundings of an apostrophe in an English genitive or negation: no other letter stands there.
_BEFORE = {"s": re.compile("[a-z]{4}$"), "t": re.compile("[a-z]n$")}
_SEQUENCE = re.compile("[\xc2-\xdf][\x80-\xbf]|\xe0[\xa0-\xbf][\x80-\xbf]|[\xe1-\xec\xee\xef][\x80-\xbf]{2}|\xed[\x80-\x9f][\x80-\xbf]|\xf0[\x90-\xbf][\x80-\xbf]{2}")


def _letter_cost(c: str, left: str, right: str) -> float:
    cost = 1.0
    if c.isupper():
        if left.islower():
            cost += 3
        elif c in "ÂÃ" and not right.isalpha():
            cost += 2  # no word of these languages ends so
        elif left.isdigit():
            cost += 3
        elif right and not right.isalpha() and not right.isspace() and right not in ",.;:!?)-'’\x00" and unicodedata.category(right)[0] not in "MCZ":
            cost += 2
        elif right.islower() and left.isupper():
            cost += 2
    else:
        if left.isupper() and (right.isupper() or not right.isalpha()) and left not in "\x00":
            cost += 2 if right.isupper() else 0
        if left.isdigit() or (not left.isalpha() and not right.isalpha() and c not in "àèéòóọẹńôùyáíúaeo" and unicodedata.category(right or " ")[0] != "M"):
            cost += 2
    return cost


def char_cost(c: str, left: str, right: str) -> float:
    """Implausibility of one character between its neighbours ('' at an end)."""
    o = ord(c)
    if o < 0x80:
        return 0.0
    if o < 0xA0 or o == 0xFFFD or 0xE000 <= o < 0xF900:
        return 5.0
    if 0xC0 <= o <= 0xFF and o not in (0xD7, 0xF7):
        extra = 1.0 if o in (0xD0, 0xDE, 0xF0, 0xFE, 0xDF, 0xFF) else 0.0
        return _letter_cost(c, left, right) + extra
    if c in LETTERS:
        return _letter_cost(c, left, right)
    if 0x300 <= o < 0x370:
        rare = 0.0 if o <= 0x30C or o in (0x323, 0x327, 0x328, 0x329, 0x331) else 1.5
        return 1.0 + rare if left.isalpha() or (left and unicodedata.category(left) == "Mn") else 4.0
    if 0x370 <= o < 0x530:
        if not c.isalpha() or o in (0x37E, 0x387) or 0x460 <= o < 0x490:
            return 3.0
        near = [x for x in (left, right) if x.isalpha()]
        own = o < 0x400
        if left.isdigit() and right and not right.isalpha() or right and right in "°±×÷≤≥":
            return 3.0
        if any(x.isalpha() and (ord(x) < 0x370 or (0x370 <= ord(x) < 0x400) != own) for x in near):
            return 2.0
        odd = 1.0 if 0x402 <= o < 0x410 and o not in (0x404, 0x406, 0x407) or 0x452 <= o <= 0x45F and o not in (0x454, 0x456, 0x457) or o >= 0x490 else 0.0
        return 1.0 + odd
    if c in OPENING:
        return 4.0 if left.isalnum() or not right or right.isspace() else 1.0
    if c in CLOSING:
        return 4.0 if right.isalnum() or not left or left.isspace() else 1.0
    if c == "’":
        return 4.0 if left and not left.isascii() and left.isupper() and right.isupper() else 1.0
    if c in DASHES:
        inside = left.isalpha() and right.isalpha()
        return 3.0 if c == "…" and right.isalpha() else 2.0 if inside and c in "–—" else 2.5 if inside else 1.0
    if c in "°±×÷≤≥":
        return 4.0 if left.isalpha() and right.isalpha() else 1.0
    if unicodedata.category(c) in ("Zs", "Cf"):
        return 1.0
    if 0x3040 <= o < 0x3100 or 0x4E00 <= o < 0xA000 or 0xAC00 <= o < 0xD7A4:
        return 1.5  # Kana, Han, Hangul
    if 0xFF00 < o < 0xFF5F or 0xFB00 <= o < 0xFB07:
        return 1.0
    return 3.0


def cost_of(text: str, left: str, right: str, ending: bool = False) -> float:
    """Implausibility of an island between its neighbours; ``ending``: it stands where only an apostrophe does.

    An escape of a character beyond ASCII costs more than any character does, an escape of an ASCII one nothing.
    Letters with an accent among such letters on both sides are rare in the languages at hand.
    """
    total = 0.0
    if not text.isascii() or "&" in text or "\\" in text or "%" in text:
        total += sum(6.0 for m in ESCAPED.finditer(text) if not _unescaped(m.group()).isascii())
    seq = [left, *text, right]
    for i, c in enumerate(text):
        if ord(c) >= 0x80:
            before, after = seq[i], seq[i + 2]
            total += char_cost(c, before, after) + (1.0 if _accented(c) and _accented(before) and _accented(after) else 0.0)
    return total + (2.0 if ending and text.isalpha() else 0.0)


def _accented(c: str) -> bool:
    return len(c) == 1 and (0xC0 <= ord(c) < 0x180) and c not in "×÷"


def _utf8_step(text: str, codec: str) -> str:
    """Every complete UTF-8 sequence among the characters' bytes replaced by its character."""
    raw = text.translate(_TABLES[codec])
    out, at = [], 0
    for m in _SEQUENCE.finditer(raw):
        out += [text[at : m.start()], m.group().encode("latin-1").decode("utf-8")]
        at = m.end()
    if not out:
        return text
    out.append(text[at:])
    return "".join(out)


def _swap_step(text: str, read_as: str, written: str) -> str:
    try:
        return text.encode(read_as).decode(written)
    except UnicodeError:
        return text


def _unescape(m: re.Match) -> str:
    s = m.group()
    if s[0] == "&":
        return html.unescape(s)
    try:
        if s[0] == "%" or s[1] == "x":
            return bytes.fromhex(re.sub(r"%|\\x", "", s)).decode("utf-8")
        return chr(int(s[2:], 16))
    except ValueError:
        return s


def _layer(text: str) -> str:
    """Text with one layer of escapes undone."""
    return _LAYER.sub(_unescape, text)


@lru_cache(maxsize=50_000)
def _unescaped(text: str) -> str:
    """Text with escapes undone until none is left; every escape is longer than what it stands for, so this ends."""
    while (plain := _layer(text)) != text:
        text = plain
    return text


@lru_cache(maxsize=200_000)
def repair_island(text: str, left: str, right: str, ending: bool = False) -> tuple[str, float, float]:
    """(cheapest spelling, its cost, cost as written) of one island."""
    start = cost_of(text, left, right, ending)
    best, least = text, start
    queue: list[tuple[float, int, str, bool, float]] = [(start, 0, text, True, math.inf)]
    visited = {(text, True, math.inf)}
    while queue:
        cost, depth, node, may_swap, limit = heapq.heappop(queue)
        if cost <= limit and cost + 0.1 * depth < least or node == text:
            best, least = (node, cost) if node != text else (best, least)
        if least <= 1.0:
            break  # the goal: one plausible character or none, than which no spelling is cheaper
        steps = [(_utf8_step(node, c), True, limit) for c in MISREAD]
        if "&" in node or "\\" in node or "%" in node:
            steps.append((_layer(node), True, limit))
        if may_swap:  # a spelling that UTF-8 steps reached is given up for another only by the margin that damage needs
            whole = cost_of(node, left, right, ending)
            after = min(limit, whole - MARGIN) if depth else limit
            for a, b in SWAPPED:
                other = _swap_step(node, a, b)
                if other != node:
                    steps.append((other, cost_of(other, left, right, ending) < whole - MARGIN, after))
        for rank, state in enumerate(steps):
            if state[0] != node and state not in visited:
                visited.add(state)
                heapq.heappush(queue, (cost_of(state[0], left, right, ending) + 0.001 * rank, depth + 1, *state))  # commoner code pages first
    return best, least, start


def _unreadable(c: str) -> bool:
    return "\x80" <= c < "\xa0" or c == "\ufffd" or "\ue000" <= c < "\uf900"


def inspect(text: str | None) -> tuple[bool, bool, str | None]:
    """(damaged, fully restored, text with every damaged place in its cheapest spelling)."""
    if not text:
        return False, False, text
    escapes = "&" in text or "\\" in text or "%" in text
    if text.isascii() and not escapes:
        return False, False, text
    damaged, lost, out, at = False, False, [], 0
    for m in (ISLAND if escapes else PLAIN_ISLAND).finditer(text):
        s, e = m.span()
        island = m.group()
        if island.isascii() and _unescaped(island).isascii():
            continue
        right = text[e : e + 1]
        ending = right in _BEFORE and len(island) == 1 and not text[e + 1 : e + 2].isalnum() and _BEFORE[right].search(text, max(0, s - 4), s) is not None
        best, least, start = repair_island(island, text[max(0, s - 1) : s], right, ending)
        if start - least >= MARGIN or any(map(_unreadable, island)):
            damaged = True
            lost |= any(map(_unreadable, best))
            out += [text[at:s], best]
            at = e
    if out:
        out.append(text[at:])
        text = "".join(out)
    return damaged, damaged and not lost, text


def inspect_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, text) to (id, restored, original) of the damaged rows only."""
    for batch in batches:
        ids, flags, texts = [], [], []
        for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            damaged, whole, text = inspect(t)
            if damaged:
                ids.append(i)
                flags.append(whole)
                texts.append(text)
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(flags, pa.bool_()), pa.array(texts, pa.string())], names=["id", "restored", "original"])


def repaired(texts: DataFrame) -> DataFrame:
    """(id, restored, original) of the damaged rows of ``texts`` (id bigint, text string).

    ``original`` is the cheapest reachable text, ``restored`` whether nothing unreadable remains in it. Null,
    empty and undamaged texts give no row; repeated rows each give theirs; other columns are ignored.
    """
    own = texts.select(F.col("id").cast("long").alias("id"), F.col("text").cast("string").alias("text"))
    return own.mapInArrow(inspect_batches, "id long, restored boolean, original string")
