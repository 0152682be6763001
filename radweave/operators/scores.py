"""Model probabilities per study, fold and label."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from radweave.functions.constants import LABELS

NORMAL = "Normal"


def deduplicated(scores: DataFrame) -> DataFrame:
    """One row per (study_id, fold, label): the largest probability in ten-thousandths; null probabilities drop out.

    Rows are combined before the shuffle, so one study id standing for a third of all rows
    becomes a few partial rows per task.
    """
    rows = scores.filter("study_id is not null and label is not null and fold is not null")
    return rows.groupBy("study_id", "fold", "label").agg(F.max(F.round(F.col("prob") * 10_000).cast("long")).alias("p"))


def fold_average(scores: DataFrame) -> DataFrame:
    """(study_id, n_folds, probs map, normal_prob): mean over the folds of the study, a missing label counting 0.

    normal_prob is the mean over the folds that have it, null without any. Sums are taken on whole
    ten-thousandths, so the mean does not depend on the order of rows.
    """
    one = deduplicated(scores)
    sums = [F.coalesce(F.sum(F.when(F.col("label") == x, F.col("p"))), F.lit(0)).alias(f"s{i}") for i, x in enumerate(LABELS)]
    normal = F.when(F.col("label") == NORMAL, F.col("p"))
    wide = one.groupBy("study_id").agg(F.size(F.collect_set("fold")).alias("n_folds"), *sums, F.sum(normal).alias("ns"), F.count(normal).alias("nn"))
    probs = F.create_map(*[c for i, x in enumerate(LABELS) for c in (F.lit(x), F.col(f"s{i}") / (F.col("n_folds") * 10_000.0))])
    return wide.select("study_id", "n_folds", probs.alias("probs"), F.when(F.col("nn") > 0, F.col("ns") / (F.col("nn") * 10_000.0)).alias("normal_prob"))


def predictions(scores: DataFrame, threshold: float = 0.5, weak: float = 0.3) -> DataFrame:
    """(study_id, fold, label, score, predicted, uncertain) of the finding labels; Normal is left to ``normal_probability``."""
    rows = deduplicated(scores).filter((F.col("label") != NORMAL) & F.col("p").isNotNull()).withColumn("score", F.col("p") / 10_000.0)
    return rows.select("study_id", "fold", "label", "score", (F.col("score") >= threshold).alias("predicted"), ((F.col("score") >= weak) & (F.col("score") < threshold)).alias("uncertain"))


def predicted_labels(scores: DataFrame, threshold: float = 0.5) -> DataFrame:
    """(study_id, fold, labels): predicted labels, sorted; a fold without any has an empty list."""
    rows = predictions(scores, threshold)
    return rows.groupBy("study_id", "fold").agg(F.array_sort(F.collect_list(F.when(F.col("predicted"), F.col("label")))).alias("labels"))


def normal_probability(scores: DataFrame) -> DataFrame:
    """(study_id, fold, normal_prob): null for a fold without Normal."""
    return deduplicated(scores).groupBy("study_id", "fold").agg((F.max(F.when(F.col("label") == NORMAL, F.col("p"))) / 10_000.0).alias("normal_prob"))


def has_normal(scores: DataFrame) -> DataFrame:
    """(fold, has_normal): whether a fold's model scores Normal too."""
    return scores.groupBy("fold").agg(F.coalesce(F.bool_or(F.col("label") == NORMAL), F.lit(False)).alias("has_normal"))


def threshold_average(thresholds: DataFrame) -> DataFrame:
    """(label, threshold): mean over folds of the thresholds, rounded to 2 places."""
    return thresholds.groupBy("label").agg(F.round(F.avg("threshold") + 1e-9, 2).alias("threshold"))


def linear_sigmoid(vector: Column, weights: list[float], bias: float) -> Column:
    """1 / (1 + exp(-(w . x + b))) over an array column."""
    w = F.array(*[F.lit(float(x)) for x in weights])
    dot = F.aggregate(F.zip_with(vector, w, lambda a, b: a.cast("double") * b), F.lit(0.0), lambda s, x: s + x)
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-(dot + F.lit(float(bias)))))
