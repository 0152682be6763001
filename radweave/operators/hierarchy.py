"""Label hierarchy: three tiers over the finding labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_LABELS = 10_000


def labels_of(hierarchy: DataFrame) -> list[str]:
    """Tier-3 labels in their order, read from a bounded dimension (label, label_idx, tier2)."""
    rows = hierarchy.select("label").orderBy("label_idx").limit(MAX_LABELS + 1).collect()
    if len(rows) > MAX_LABELS:
        raise ValueError("the label dimension is too large")
    return [r["label"] for r in rows]


def tier1(findings: Column, image_ok: Column | None = None) -> Column:
    """indeterminate for a bad image, else abnormal or normal by the findings array."""
    plain = F.when(F.size(findings) > 0, "abnormal").otherwise("normal")
    return plain if image_ok is None else F.when(~F.coalesce(image_ok, F.lit(True)), "indeterminate").otherwise(plain)


def tier2_map(hierarchy: DataFrame) -> Column:
    """Constant map from label to tier-2 group."""
    rows = hierarchy.select("label", "tier2").limit(MAX_LABELS + 1).collect()
    if len(rows) > MAX_LABELS:
        raise ValueError("the label dimension is too large")
    return F.create_map(*[F.lit(x) for r in rows for x in (r["label"], r["tier2"])])


def strict_tier2(label: Column, mapping: Column) -> Column:
    """Tier-2 group of a label; an unknown label is an error."""
    found = F.element_at(mapping, label)
    return F.when(found.isNull(), F.raise_error(F.concat(F.lit("Unknown pathology label: "), F.coalesce(label, F.lit("null"))))).otherwise(found)


def with_hierarchy(df: DataFrame, labels: str, hierarchy: DataFrame, image_ok: str | None = None) -> DataFrame:
    """Adds tier1, tier2 (sorted distinct groups) and tier3 (known labels, order kept) from an array column; unknown labels drop out."""
    mapping = tier2_map(hierarchy)
    known = F.filter(F.col(labels), lambda x: F.element_at(mapping, x).isNotNull())
    df = df.withColumn("tier3", known)
    df = df.withColumn("tier2", F.array_sort(F.array_distinct(F.transform("tier3", lambda x: F.element_at(mapping, x)))))
    return df.withColumn("tier1", tier1(F.col("tier3"), F.col(image_ok) if image_ok else None))
