"""Registered queries of the text operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from radweave.llm import canonical, encoding, leakage, mixing, neardup, overlap, pii, spans
from radweave.scratch import settle
from radweave.tables import spread, table

Query = Callable[[SparkSession, str], DataFrame]


def _reports(spark: SparkSession, folder: str, *names: str) -> DataFrame:
    """(id, text) of the report texts of several tables."""
    out = None
    for name in names:
        one = spread(table(spark, folder, name).select(F.col("rec_id").alias("id"), F.col("report_text").alias("text")))
        out = one if out is None else out.unionByName(one)
    return out


def _links(spark: SparkSession, folder: str) -> DataFrame:
    return neardup.similar_texts(_reports(spark, folder, "ensemble_predictions", "annotated_reports"), threshold=0.70, width=3, min_words=20)


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of records with at least 20 words whose share of 3-word sequences is 0.70 or more."""
    return neardup.expand_pairs(_links(spark, folder)).select("rec_id_a", "rec_id_b")


def p5_groups(spark: SparkSession, folder: str) -> DataFrame:
    """Per record with a similar one: its class of equal words, its group and its number of links between different texts."""
    return neardup.membership(_links(spark, folder)).withColumnRenamed("id", "rec_id")


def _documents(spark: SparkSession, folder: str) -> DataFrame:
    return spread(table(spark, folder, "documents").select(F.col("doc_id").alias("id"), "text"))


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    """Maximal runs of at least 300 characters that occur verbatim in another document."""
    return spans.shared_spans(_documents(spark, folder), 300).withColumnRenamed("id", "doc_id")


def p9_share(spark: SparkSession, folder: str) -> DataFrame:
    """Per document: how much of it is shared elsewhere."""
    docs = _documents(spark, folder)
    return spans.shared_share(docs, spans.shared_spans(docs, 300)).withColumnRenamed("id", "doc_id")


def _leaks(spark: SparkSession, folder: str) -> DataFrame:
    items = table(spark, folder, "eval_passages").select("item_id", F.col("passage_text").alias("text"))
    return leakage.leaks(_documents(spark, folder), items).withColumnRenamed("id", "doc_id")


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    """Documents holding at least 10 consecutive words of an item's passage."""
    return _leaks(spark, folder).select("doc_id", "item_id")


def p7_items(spark: SparkSession, folder: str) -> DataFrame:
    """Per item: in how many documents it leaked and how many of its 10-word windows at most stood in one."""
    found = _leaks(spark, folder).groupBy("item_id").agg(F.count(F.lit(1)).alias("n_docs"), F.max("n_windows").alias("most_windows"))
    items = table(spark, folder, "eval_passages").select("item_id", "item_set")
    return items.join(found, "item_id", "left").select("item_id", "item_set", F.coalesce("n_docs", F.lit(0)).alias("n_docs"), F.coalesce("most_windows", F.lit(0)).alias("most_windows"))


def _splits(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    rows = spread(table(spark, folder, "training_reports_augmented").select(F.col("rec_id").alias("id"), F.col("report_text").alias("text"), "split"))
    return rows.filter("split = 'train'"), rows.filter("split in ('val', 'test')")


def _overlaps(spark: SparkSession, folder: str) -> DataFrame:
    return overlap.text_overlaps(*_splits(spark, folder), threshold=0.75, min_words=20)


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of a train row and a val or test row whose share of 3-word sequences is 0.75 or more."""
    return _overlaps(spark, folder).select(F.least("train_id", "eval_id").alias("rec_id_a"), F.greatest("train_id", "eval_id").alias("rec_id_b"))


def p1_report(spark: SparkSession, folder: str) -> DataFrame:
    """Per split and origin of the evaluation record and origin of the training record: pairs, records hit, mean share,
    and how much of the records hit stands anywhere in training (merged intervals)."""
    rows = table(spark, folder, "training_reports_augmented")
    kind = F.when(F.col("is_synthetic"), "synthetic").when(~F.col("is_synthetic"), "real").when(F.col("study_id").rlike("^(synth|hardneg)_"), "synthetic").otherwise("unknown")
    info = rows.select("rec_id", "split", kind.alias("origin"))
    pairs = settle(_overlaps(spark, folder), "overlaps")
    whole = overlap.evaluation_coverage(*_splits(spark, folder), min_words=20)
    named = pairs.join(info.select(F.col("rec_id").alias("eval_id"), F.col("split").alias("eval_split"), F.col("origin").alias("eval_origin")), "eval_id").join(
        info.select(F.col("rec_id").alias("train_id"), F.col("origin").alias("train_origin")), "train_id"
    )
    group = ["eval_split", "eval_origin", "train_origin"]
    counts = named.groupBy(*group).agg(F.count(F.lit(1)).alias("n_pairs"), F.countDistinct("eval_id").alias("n_eval"), F.countDistinct("train_id").alias("n_train"), F.round(F.avg("share"), 4).alias("mean_share"))
    covered = named.select(*group, "eval_id").distinct().join(whole, "eval_id").groupBy(*group).agg(F.round(F.avg("coverage"), 4).alias("mean_coverage"))
    return counts.join(covered, group)


def _damaged(spark: SparkSession, folder: str) -> DataFrame:
    return encoding.repaired(_reports(spark, folder, "ensemble_predictions", "disagreement_log"))


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    """Records whose text shows characters read in a wrong encoding."""
    return _damaged(spark, folder).select(F.col("id").alias("rec_id"))


def p3_repaired(spark: SparkSession, folder: str) -> DataFrame:
    """The same records with the cheapest reachable text, and whether nothing unreadable remains in it."""
    return _damaged(spark, folder).withColumnRenamed("id", "rec_id")


def _deviating(spark: SparkSession, folder: str) -> DataFrame:
    one = canonical.deviating(_reports(spark, folder, "ensemble_predictions"), skip_damaged=True)
    return one.unionByName(canonical.deviating(_reports(spark, folder, "annotated_reports")))


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    """Records written with other characters than the rest."""
    return _deviating(spark, folder).select(F.col("id").alias("rec_id"))


def p4_canonical(spark: SparkSession, folder: str) -> DataFrame:
    """The same records in the one consistent form, with the kinds of deviation."""
    return _deviating(spark, folder).select(F.col("id").alias("rec_id"), F.array_join("kinds", ",").alias("kinds"), "canonical")


def _mixture(spark: SparkSession, folder: str) -> mixing.Mixture:
    docs = spread(table(spark, folder, "documents").select(F.col("doc_id").alias("id"), "source", "text"))
    return mixing.Mixture(docs, table(spark, folder, "mix_targets"))


def p8_mix(spark: SparkSession, folder: str) -> DataFrame:
    """Chosen documents with their tokens, repeats and first place in the interleaved mixture."""
    return _mixture(spark, folder).rows().withColumnRenamed("id", "doc_id")


def p8_order(spark: SparkSession, folder: str) -> DataFrame:
    """The mixture as it is read: one row per use of a document, in the order of slot, source and place."""
    return _mixture(spark, folder).uses().withColumnRenamed("id", "doc_id")


def p8_report(spark: SparkSession, folder: str) -> DataFrame:
    """Rows, repeats, tokens and actual share per source."""
    return _mixture(spark, folder).report()


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    """Every personal detail: record, kind and position of its first character."""
    return pii.find_details(_reports(spark, folder, "ensemble_predictions", "annotated_reports")).select(F.col("id").alias("rec_id"), "kind", "start_at")


def p6_redacted(spark: SparkSession, folder: str) -> DataFrame:
    """Records with personal details, with a typed placeholder in place of each."""
    return pii.redacted(_reports(spark, folder, "ensemble_predictions", "annotated_reports")).withColumnRenamed("id", "rec_id")


def queries() -> dict[str, Query]:
    return {
        "p3_found": p3_found, "p3_repaired": p3_repaired, "p4_found": p4_found, "p4_canonical": p4_canonical,
        "p1_found": p1_found, "p1_report": p1_report, "p7_found": p7_found, "p7_items": p7_items, "p5_found": p5_found, "p5_groups": p5_groups, "p6_found": p6_found, "p6_redacted": p6_redacted, "p8_mix": p8_mix, "p8_order": p8_order, "p8_report": p8_report, "p9_found": p9_found, "p9_share": p9_share,
    }


def oracle_sql() -> dict[str, str]:
    return {}
