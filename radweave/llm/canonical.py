"""One consistent form for text that looks the same.

Normalisation quick-check properties split every text: characters that are stable
under composition and compatibility folding are left alone as they stand, and
only *unstable segments* (a run of characters whose quick check is "no" or "maybe", widened
to the character before it, with which they may compose) are normalised and spliced back.

Canonical form: composed letters (NFC), plain letters for compatibility forms, a
plain space for every other blank, no invisible characters, one script per word.
Typographic quotes, dashes and signs stay.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from collections.abc import Iterator
from functools import cache, lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from radweave.llm.encoding import inspect

# Letters of other scripts that look like a Latin letter.
LOOKALIKE = {
    "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "У": "Y", "Х": "X",
    "Ѕ": "S", "І": "I", "Ї": "Ï", "Ј": "J", "Ԛ": "Q", "Ԝ": "W", "Ү": "Y", "Ԍ": "G", "Һ": "h", "а": "a", "в": "b", "е": "e", "к": "k", "м": "m", "н": "h",
    "о": "o", "р": "p", "с": "c", "т": "t", "у": "y", "х": "x", "ѕ": "s", "і": "i", "ї": "ï", "ј": "j", "һ": "h", "ԁ": "d", "ԛ": "q", "ԝ": "w", "ё": "ë", "Ё": "Ë",
    "ь": "b", "г": "r", "п": "n", "и": "u", "ү": "y", "ѵ": "v", "ӏ": "l", "Ӏ": "I",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X",
    "α": "a", "γ": "y", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "σ": "o", "τ": "t", "υ": "u", "χ": "x", "ω": "w", "ϲ": "c", "ϳ": "j", "ό": "ó", "ί": "í",
    "Ꭺ": "A", "Ᏼ": "B", "Ꮯ": "C", "Ꭼ": "E", "Ꮋ": "H", "Ꭻ": "J", "Ꮶ": "K", "Ꮮ": "L", "Ꮇ": "M", "Ꮲ": "P", "Ꭱ": "R", "Ꮪ": "S", "Ꭲ": "T", "Ꮃ": "W", "Ꮓ": "Z",
    "Ꭰ": "D", "Ꮐ": "G", "Ꮩ": "V", "Ꭵ": "i", "օ": "o", "ս": "u", "ո": "n", "հ": "h", "ց": "g", "յ": "j",
    "ꓐ": "B", "ꓑ": "P", "ꓓ": "D", "ꓔ": "T", "ꓖ": "G", "ꓗ": "K", "ꓙ": "J", "ꓚ": "C", "ꓜ": "Z", "ꓝ": "F", "ꓟ": "M", "ꓠ": "N", "ꓡ": "L", "ꓢ": "S", "ꓣ": "R", "ꓦ": "V", "ꓧ": "H",
    "ꓪ": "W", "ꓫ": "X", "ꓬ": "Y", "ꓮ": "A", "ꓰ": "E", "ꓲ": "I", "ꓳ": "O", "ꓴ": "U", "ⲟ": "o", "Ⲟ": "O", "ⲥ": "c", "Ⲥ": "C", "ⲣ": "p", "Ⲣ": "P",
}
#: Signs whose folding would change what the reader sees as one sign.
KEEP = frozenset("°±×÷≤≥µΩ℃℉™®©‰′″¹²³ºª¼½¾¨¯´¸")
KINDS = ("compatibility", "decomposed", "invisible", "blank", "mixed_script")

_FOREIGN = re.compile("[" + "".join(LOOKALIKE) + "]")
_LETTER_WORD = re.compile(r"[^\W\d_][^\W\d_̀-ͯ]*(?:[̀-ͯ]+[^\W\d_]*)*")


def _invisible(c: str) -> bool:
    o = ord(c)
    return unicodedata.category(c) == "Cf" or o in (0x034F, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x3164, 0xFFA0) or 0xFE00 <= o <= 0xFE0F or 0x180B <= o <= 0x180F or 0xE0100 <= o <= 0xE01EF


def _blank(c: str) -> bool:
    return unicodedata.category(c) in ("Zs", "Zl", "Zp") and c != " "


def _compatible(c: str) -> bool:
    if c in KEEP or _blank(c) or _invisible(c):
        return False
    d = unicodedata.decomposition(c)
    return d.startswith("<") and unicodedata.normalize("NFKC", c) != c


def _maybe() -> set[int]:
    """Characters whose quick check is "maybe": they may compose with the one before them."""
    out = {*range(0x1161, 0x1176), *range(0x11A8, 0x11C3)}  # Hangul vowels and final consonants
    for o in range(0xC0, sys.maxunicode + 1):
        parts = unicodedata.decomposition(chr(o)).split()
        if len(parts) == 2 and parts[0][0] != "<" and unicodedata.normalize("NFC", chr(o)) == chr(o):
            out.add(int(parts[1], 16))
    return out


@cache
def _patterns() -> tuple[re.Pattern, re.Pattern]:
    """Characters that fail a quick check or may fail it, and the same widened to the segment to normalise."""
    bad, maybe = [], _maybe()
    for o in range(0x80, sys.maxunicode + 1):
        if 0xD800 <= o < 0xE000:
            continue
        c = chr(o)
        if unicodedata.category(c) in ("Cn", "Co"):
            continue
        if _invisible(c) or _blank(c) or _compatible(c) or not unicodedata.is_normalized("NFC", c) or unicodedata.combining(c) or o in maybe:
            bad.append(o)
    ranges, start = [], None
    for i, o in enumerate(bad):
        start = o if start is None else start
        if i + 1 == len(bad) or bad[i + 1] != o + 1:
            ranges.append(f"\\U{start:08x}-\\U{o:08x}")
            start = None
    cls = "".join(ranges)
    return re.compile(f"[{cls}]"), re.compile(f"[^\\s]?[{cls}]+")


def _latin(c: str) -> bool:
    return c.isascii() or 0xC0 <= ord(c) < 0x250 or 0x1E00 <= ord(c) < 0x1F00


@lru_cache(maxsize=100_000)
def _word(word: str) -> str:
    """Word with look-alikes of other scripts turned Latin, if it also has Latin letters and nothing else foreign."""
    if any(c in LOOKALIKE for c in word) and any(c.isalpha() and _latin(c) and c not in LOOKALIKE for c in word):
        return "".join(LOOKALIKE.get(c, c) for c in word)
    return word


@lru_cache(maxsize=100_000)
def _segment(segment: str) -> tuple[str, frozenset]:
    """Canonical form of one unstable segment and the kinds of change made."""
    kinds, out = set(), []
    for c in segment:
        if c.isascii():
            out.append(c)
        elif _invisible(c):
            kinds.add("invisible")
        elif _blank(c):
            kinds.add("blank")
            out.append(" ")
        elif _compatible(c):
            kinds.add("compatibility")
            out.append(unicodedata.normalize("NFKC", c))
        else:
            out.append(c)
    plain = "".join(out)
    composed = unicodedata.normalize("NFC", plain)
    if composed != plain:
        kinds.add("decomposed")
    return composed, frozenset(kinds)


def canonical(text: str | None) -> tuple[str | None, frozenset]:
    """(text in canonical form, kinds of deviation found); a text without deviation comes back unchanged."""
    if not text or text.isascii():
        return text, frozenset()
    single, wide = _patterns()
    kinds: set = set()
    foreign = _FOREIGN.search(text)
    if single.search(text):

        def fold(m: re.Match) -> str:
            new, why = _segment(m.group())
            kinds.update(why)
            return new

        text = wide.sub(fold, text)

    def one_script(m: re.Match) -> str:
        word = m.group()
        if word.isascii():
            return word
        new = _word(word)
        if new != word:
            kinds.add("mixed_script")
        return new

    if foreign:
        text = _LETTER_WORD.sub(one_script, text)
    return text, frozenset(kinds)


def canonical_batches(skip_damaged: bool):
    """(id, text) to (id, kinds, canonical) of the rows that deviate; with ``skip_damaged`` not those read in a wrong encoding."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, why, texts = [], [], []
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                new, kinds = canonical(t)
                if kinds and not (skip_damaged and inspect(t)[0]):
                    ids.append(i)
                    why.append(sorted(kinds))
                    texts.append(new)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(why, pa.list_(pa.string())), pa.array(texts, pa.string())], names=["id", "kinds", "canonical"])

    return run


def deviating(texts: DataFrame, skip_damaged: bool = False) -> DataFrame:
    """(id, kinds, canonical) of the rows of ``texts`` (id bigint, text string) not in the one consistent form.

    Null, empty and consistent texts give no row; with ``skip_damaged`` neither do texts read in a wrong
    encoding; repeated rows each give theirs; other columns are ignored.
    """
    own = texts.select(F.col("id").cast("long").alias("id"), F.col("text").cast("string").alias("text"))
    return own.mapInArrow(canonical_batches(skip_damaged), "id long, kinds array<string>, canonical string")
