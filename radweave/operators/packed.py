"""Several values packed into one text field.

A finite-state tokenizer walks a field once.  Its state is (outside, inside a bare value,
inside quotes, after a closing quote) with an escape flag and a nesting depth;
delimiters count only outside quotes and at depth 0, and quotes are tracked inside brackets too.  A bracket
that is never closed is found at the end of a walk; the field is walked again with it as plain text.
A name that contains a delimiter character (a slash, say) is recognised at the start of a bare value by the
longest known name that ends before a delimiter, so its own slash separates nothing, with or without blanks round it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DELIMITERS = ",;|/+\n\r\t"
QUOTES = {'"': '"', "'": "'", "“": "”"}
OPEN, CLOSE = {"[": "]", "{": "}"}, {"(": ")"}
MAX_NAMES = 10_000


def _known(names: Sequence[str]) -> re.Pattern | None:
    """Pattern of the names that hold a delimiter, blanks flexible around it, longest first, up to a delimiter or the end."""
    hard = sorted({n.strip() for n in names if n and any(d in n for d in DELIMITERS)}, key=lambda n: (-len(n), n))
    if not hard:
        return None
    parts = lambda n: (p for p in re.split(rf"\s*([{re.escape(DELIMITERS)}])\s*|\s+", n) if p != "")

    def spelled(n: str) -> str:
        """Words one or more blanks apart, blanks round a delimiter at will."""
        out, blank = "", ""
        for p in parts(n):
            if p is None:
                continue
            mark = p in DELIMITERS
            out += (r"\s*" if mark or blank == "mark" else r"\s+" if blank else "") + re.escape(p)
            blank = "mark" if mark else "word"
        return out

    body = "|".join(map(spelled, hard))
    return re.compile(rf"(?:{body})(?=[  ]*(?:[{re.escape(DELIMITERS)}\]}}]|$))", re.IGNORECASE)


def split_packed(field: str | None, names: re.Pattern | None = None) -> list[str]:
    """Values of one field in order; empty places are skipped.

    A quote opens only where a value starts, so an apostrophe inside a word is text;
    an unclosed quote keeps the rest of the field as one value; text after a closing quote up to
    the next delimiter belongs to the value.  Inside brackets a quote opens after a bracket, delimiter
    or blank if it is closed again, and hides brackets and delimiters; both stay part of the value.
    A null or blank field has none.
    """
    if field is None or not field.strip():
        return []
    text = field.strip()
    if text[0] in OPEN and text[-1] == OPEN[text[0]]:
        text = text[1:-1]
    plain: set[int] = set()
    while True:
        values, unclosed = _walk(text, names, plain)
        if not unclosed:
            return values
        plain.update(unclosed)


def _walk(text: str, names: re.Pattern | None, plain: set[int]) -> tuple[list[str], list[int]]:
    """Values of a text and the places of brackets left open; those in ``plain`` are text."""
    values: list[str] = []
    buffer: list[str] = []
    opened: list[int] = []
    state, closing, inner, escaped = "outside", "", "", False
    at, end = 0, len(text)

    def emit() -> None:
        nonlocal state, buffer
        value = "".join(buffer).strip()
        if value:
            values.append(value)
        state, buffer = "outside", []

    while at < end:
        c = text[at]
        if state == "quoted":
            if escaped:
                buffer.append(c if c in "\\\"'”" else "\\" + c)
                escaped = False
            elif c == "\\":
                escaped = True
            elif c == closing:
                if text[at + 1 : at + 2] == closing:
                    buffer.append(c)
                    at += 1
                else:
                    state = "after"
            else:
                buffer.append(c)
        elif inner:
            buffer.append(c)
            if c == "\\" and at + 1 < end:
                at += 1
                buffer.append(text[at])
            elif c == inner:
                if text[at + 1 : at + 2] == inner:
                    at += 1
                    buffer.append(inner)
                else:
                    inner = ""
        elif c in DELIMITERS and not opened:
            emit()
        elif state == "outside" and c.isspace():
            pass
        elif state == "outside" and c in QUOTES:
            state, closing = "quoted", QUOTES[c]
        elif state == "outside" and names is not None and (m := names.match(text, at)):
            buffer.append(m.group())
            state, at = "bare", m.end() - 1
        else:
            if state != "after":
                state = "bare"
            if (c in CLOSE or c in OPEN) and at not in plain:
                opened.append(at)
            elif opened and (c in CLOSE.values() or c in OPEN.values()):
                opened.pop()
            elif opened and c in QUOTES and (text[at - 1] in DELIMITERS or text[at - 1].isspace() or text[at - 1] in CLOSE or text[at - 1] in OPEN) and text.find(QUOTES[c], at + 1) > 0:
                inner = QUOTES[c]
            buffer.append(c)
        at += 1
    if escaped:
        buffer.append("\\")
    emit()
    return values, opened


def unpack(df: DataFrame, key: str, fields: Sequence[str], names: DataFrame | None = None, least: int = 1) -> DataFrame:
    """(key, field_name, pos, val): one row per value of the ``fields`` of ``df`` holding at least ``least`` values.

    ``names`` has one column of values that may contain delimiters (at most MAX_NAMES rows).
    Nulls, blanks and empty places give no rows; ``pos`` counts from 1; repeated rows and keys are
    unpacked as they come; further columns are ignored; all fields are read in one pass.
    """
    known: list[str] = []
    if names is not None:
        known = [r[0] for r in names.limit(MAX_NAMES + 1).collect() if r[0]]
        if len(known) > MAX_NAMES:
            raise ValueError(f"more than {MAX_NAMES} names")
    schema = df.select(key).schema
    key_type = schema[0].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pattern = _known(known)
        split = lru_cache(maxsize=50_000)(lambda v: split_packed(v, pattern))
        for batch in batches:
            keys = batch.column(0)
            rows, name, pos, val = [], [], [], []
            for k, field in enumerate(fields):
                for i, v in enumerate(batch.column(k + 1).to_pylist()):
                    values = split(v)
                    if len(values) >= least:
                        rows += [i] * len(values)
                        name += [field] * len(values)
                        pos += range(1, len(values) + 1)
                        val += values
            yield pa.RecordBatch.from_arrays(
                [keys.take(pa.array(rows, pa.int64())), pa.array(name, pa.string()), pa.array(pos, pa.int32()), pa.array(val, pa.string())], names=[key, "field_name", "pos", "val"]
            )

    text = [F.col(f).cast("string").alias(f"field_{k}") for k, f in enumerate(fields)]
    return df.select(F.col(key), *text).mapInArrow(run, f"`{key}` {key_type}, field_name string, pos int, val string")
