"""Label lists: distribution, agreement, triage and flags of compiled reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from radweave.functions.constants import HIGH_RISK
from radweave.functions.text import strip, word_count


def as_list(column: str | Column) -> Column:
    """Labels of a comma list without blanks and Normal."""
    c = F.col(column) if isinstance(column, str) else column
    return F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), ","), lambda x: strip(x)), lambda x: (x != "") & (x != "Normal"))


def jaccard(a: Column, b: Column) -> Column:
    """Size of the intersection over that of the union; 1 for two empty lists."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / union)


def high_risk(labels: Column) -> Column:
    return F.arrays_overlap(labels, F.array(*[F.lit(x) for x in HIGH_RISK]))


def priority(agreement: Column, labels: Column, words: Column) -> Column:
    """Review priority 0..3; the middle band of agreement is 2 whatever the labels."""
    n, risk = F.size(F.array_distinct(labels)), high_risk(labels)
    return (
        F.when((agreement >= 0.3) & (agreement < 0.5), 2).when((agreement < 0.3) | risk, 3).when(n >= 3, 2).when(F.coalesce(words, F.lit(0)) > 120, 1).otherwise(0)
    )


def compile_flags(df: DataFrame, text: str = "report_text") -> DataFrame:
    """Adds word_count, character_count, has_findings and has_impression."""
    t = F.coalesce(F.col(text), F.lit(""))
    blank = r"[\s]*:"
    return df.select(
        "*", word_count(t).alias("word_count"), F.length(t).alias("character_count"), t.rlike(r"(?i)(findings|comments|body)" + blank).alias("has_findings"),
        t.rlike(r"(?i)(impression|conclusion|summary|notes)" + blank).alias("has_impression"),
    )


def distribution(df: DataFrame, **lists: str) -> DataFrame:
    """Per label, how many records hold it in each of the named list columns, and the share of the first list in percent."""
    cells = F.flatten(F.array(*[_tagged(c, k) for k, c in lists.items()]))
    total = df.agg(F.count(F.lit(1)).alias("total"))
    counts = df.select(F.explode(cells).alias("c")).groupBy("c.label").agg(*[F.count_if(F.col("c.kind") == k).alias(f"{k}_count") for k in lists])
    first = next(iter(lists))
    return counts.withColumn(f"{first}_pct", F.round(F.col(f"{first}_count") / total.scalar() * 100 + 1e-9, 2))


def _tagged(column: str, kind: str) -> Column:
    return F.transform(F.array_distinct(as_list(column)), lambda x: F.struct(x.alias("label"), F.lit(kind).alias("kind")))


def cooccurrence(df: DataFrame, labels: str) -> DataFrame:
    """(label_a, label_b, n): records holding both; pairs are formed inside the row."""
    own = F.array_sort(F.array_distinct(as_list(labels)))
    pairs = F.flatten(F.transform(own, lambda x, i: F.transform(F.slice(own, i + 2, F.size(own)), lambda y: F.struct(x.alias("label_a"), y.alias("label_b")))))
    return df.select(F.explode(pairs).alias("p")).groupBy("p.label_a", "p.label_b").agg(F.count(F.lit(1)).alias("n"))
