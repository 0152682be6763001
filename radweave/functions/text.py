"""Text functions as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from radweave.functions.barrier import let
from radweave.functions.constants import BLANKS


def strip(c: Column) -> Column:
    """Text without leading and trailing blanks of any kind."""
    return F.regexp_replace(c, rf"^[{BLANKS}]+|[{BLANKS}]+$", "")


def word_count(c: Column) -> Column:
    """Number of runs of non-blanks; 0 for a blank text, null for a null."""
    s = strip(c)
    return F.when(s == "", 0).otherwise(F.size(F.split(s, rf"[{BLANKS}]+")))


def is_blank(c: Column) -> Column:
    """True for null and for texts of blanks only."""
    return F.coalesce(strip(c) == "", F.lit(True))


def literal(text: str | Column) -> Column:
    """A plain text as a regex that matches just it."""
    return F.concat(F.lit("\\Q"), text, F.lit("\\E"))


def starts_of(text: Column, phrase: Column) -> Column:
    """0-based starts of the whole-word occurrences of ``phrase``, from the lengths between them.

    The phrase is a literal, so occurrences have one length and their starts follow from
    the pieces that splitting leaves; no function outside the JVM is needed.
    """
    size = F.length(phrase)

    def walk(parts: Column) -> Column:
        end = F.aggregate(
            parts,
            F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out")),
            lambda acc, p: F.struct((acc["at"] + F.length(p) + size).alias("at"), F.array_append(acc["out"], acc["at"] + F.length(p)).alias("out")),
            lambda acc: acc["out"],
        )
        return F.slice(end, F.lit(1), F.size(parts) - 1)

    return let(F.split(text, F.concat(F.lit("\\b"), literal(phrase), F.lit("\\b")), -1), walk)
