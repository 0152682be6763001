"""Registered queries of the core operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from radweave.operators import packed
from radweave.plans import analytics, labelling, preparation
from radweave.tables import table

Query = Callable[[SparkSession, str], DataFrame]


def _unpacked(spark: SparkSession, folder: str, least: int) -> DataFrame:
    names = table(spark, folder, "label_hierarchy").select("label")
    gold = packed.unpack(table(spark, folder, "annotated_reports"), "rec_id", ["gold_labels"], names, least)
    return gold.unionByName(packed.unpack(table(spark, folder, "disagreement_log"), "rec_id", ["final_labels", "rb_labels", "bert_labels"], names, least))


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    """One row per value of the label fields that hold two or more."""
    return _unpacked(spark, folder, 2)


def p2_values(spark: SparkSession, folder: str) -> DataFrame:
    """Per field and value in any case: rows it occurs in and its earliest and latest place."""
    rows = _unpacked(spark, folder, 1)
    return rows.groupBy("field_name", F.lower("val").alias("val")).agg(F.countDistinct("rec_id").alias("n_records"), F.min("pos").alias("first_pos"), F.max("pos").alias("last_pos"))


_PLANS = (labelling, analytics, preparation)


def entry(spark: SparkSession, folder: str) -> DataFrame:
    """Flagship query: rule labels of every report."""
    return labelling.rule_labels(spark, folder)


def queries() -> dict[str, Query]:
    found: dict[str, Query] = {"p2_found": p2_found, "p2_values": p2_values}
    for plan in _PLANS:
        found |= plan.queries()
    return found


def oracle_sql() -> dict[str, str]:
    found: dict[str, str] = {}
    for plan in _PLANS:
        found |= plan.oracle_sql()
    return found
