"""Keeping costly expressions evaluated once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def once(df: DataFrame, **columns: Column) -> DataFrame:
    """Adds columns through a one-row generator.

    Predicates on them stay above it: the optimizer would otherwise substitute the whole
    expression, with all that it refers to, into every filter below, and large expressions would
    be copied and evaluated many times over.
    """
    one = F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))
    return df.select("*", F.inline_outer(one).alias(*columns))


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value evaluated once, however often it is used: it becomes a lambda's variable."""
    return F.get(F.transform(F.array(value), use), F.lit(0))
