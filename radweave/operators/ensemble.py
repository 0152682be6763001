"""Combining rule labels with model probabilities under a policy per label."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from radweave.functions import constants as C
from radweave.functions.barrier import once


def three_places(p: Column) -> Column:
    """Number with three decimals, halves up."""
    return F.format_string("%.3f", F.floor(p * 1000 + 0.5 + 1e-9) / 1000.0)


def four(name: str) -> Column:
    """Column rounded to four places; a hair above, so that ties on decimals go up in any engine."""
    return F.round(F.col(name) + 1e-9, 4)


def policy_of(label: str) -> str:
    """Which source leads for a label."""
    return "bert_primary" if label in C.MODEL_PRIMARY else "rare_unstable" if label in C.RARE else "rule_primary"


def _score_of(label: str) -> Column:
    return F.get(F.filter("results", lambda r: r["label"] == label), F.lit(0))["score"]


def decisions(
    reports: DataFrame, averages: DataFrame, threshold: float | dict = 0.5, rule_threshold: float = 0.55, weak: float = 0.3, high: float = 0.80, rare_high: float = 0.85, suppress_at: float = 0.70,
    lost: str = "ANON", carry: tuple[str, ...] = (),
) -> DataFrame:
    """One row per report and label: flags, scores, inclusion, confidence and, where the sources differ, decision and reason.

    ``reports`` has rec_id, study_id, a text column already turned into ``results`` and ``has_normal_phrase``
    by the rule operator, and ``blank``; ``averages`` comes from ``scores.fold_average``.  The one
    join is on the study; the thirteen labels are unfolded inside the row.  A blank report has no
    detections and full confidence; a study without scores has probability 0 everywhere.  ``lost`` stands for
    studies whose id is gone: their reports count as unscored, and their many rows spread over all tasks
    under keys of their own.  ``carry`` names further columns to keep.
    """
    gone = F.coalesce(F.col("study_id") == lost, F.lit(True))
    key = F.when(gone, F.concat_ws(":", F.lit(lost), F.col("rec_id").cast("string"))).otherwise(F.col("study_id"))
    scored = averages.filter(F.col("study_id") != lost).withColumnRenamed("study_id", "__key")
    joined = reports.withColumn("__key", key).join(scored, "__key", "left").drop("__key")
    normal = F.col("normal_prob")
    active = F.coalesce(normal >= suppress_at, F.lit(False)) & ~F.col("blank")
    rows = []
    for label in C.LABELS:
        cut = threshold.get(label, 0.5) if isinstance(threshold, dict) else threshold
        score = _score_of(label)
        prob = F.when(F.col("blank"), 0.0).otherwise(F.coalesce(F.element_at("probs", label), F.lit(0.0)))
        rows.append(
            F.struct(
                F.lit(label).alias("label"), F.lit(policy_of(label)).alias("policy"), F.coalesce(score >= rule_threshold, F.lit(False)).alias("rb_detected"),
                (~F.col("blank") & (prob >= cut)).alias("bert_detected"), prob.alias("bert_prob"), F.coalesce(score, F.lit(0.0)).alias("rb_score"),
            )
        )
    base = once(joined, active=active, cells=F.array(*rows)).select("rec_id", "study_id", "blank", "has_normal_phrase", "n_folds", "normal_prob", "active", *carry, F.explode("cells").alias("c"))
    base = base.select("rec_id", "study_id", "blank", "has_normal_phrase", "n_folds", "normal_prob", "active", *carry, "c.*")
    rb, model, p = F.col("rb_detected"), F.col("bert_detected"), F.col("bert_prob")
    policy, on = F.col("policy"), F.col("active")
    differ = rb != model
    bar = F.when(policy == "rare_unstable", F.when(on, 0.95).otherwise(rare_high)).otherwise(F.when(on, 0.90).otherwise(high))
    passes = p >= bar
    primary, rare = policy == "bert_primary", policy == "rare_unstable"
    included = F.when(~differ, rb).when(rb | primary, True).otherwise(passes)
    confidence = (
        F.when(~differ, "high")
        .when(primary, F.when(model, "medium").otherwise("low"))
        .when(rb, F.when(rare & (p < weak), "low").otherwise("medium"))
        .otherwise("low")
    )
    # The decision and reason texts below.
    tail = F.when(rare, ", rare").otherwise("")
    decision = (
        F.when(~differ, None)
        .when(primary, F.when(model, "included (BERT primary)").otherwise("included (RB backup)"))
        .when(rb & rare, F.concat(F.lit("included (RB detected, "), F.when(p >= weak, "BERT weak signal").otherwise("no BERT signal"), F.lit(", rare)")))
        .when(rb, F.concat(F.lit("included (RB primary, "), F.when(p >= weak, "BERT weak signal").otherwise("no BERT signal"), F.lit(")")))
        .otherwise(F.concat(F.when(passes, "included (high BERT prob").otherwise("excluded (low BERT prob"), tail, F.lit(")")))
    )
    head = F.when(rare, "Rare label: ").otherwise("Rule-primary: ")
    shown = three_places(p)
    signal = F.when(p >= weak, F.concat(F.lit("BERT weak signal (prob="), shown, F.lit(f" >= {weak})"))).otherwise(F.concat(F.lit("BERT no signal (prob="), shown, F.lit(f" < {weak})")))
    limit = F.when(rare, F.when(on, "0.95").otherwise(str(rare_high))).otherwise(F.when(on, "0.9").otherwise(str(high)))
    lone = F.concat(
        F.when(passes, F.concat(F.lit("BERT-only, high prob ("), shown, F.lit(" >= "))).otherwise(F.concat(F.lit("BERT-only, prob too low ("), shown, F.lit(" < "))), limit, F.lit(")"),
        F.when(on, F.concat(F.lit(" [normal_suppression active, normal_prob="), three_places(F.col("normal_prob")), F.lit("]"))).otherwise(""),
    )
    reason = (
        F.when(~differ, None)
        .when(primary & model, "BERT-primary label: BERT detected, rules missed")
        .when(primary, F.concat(F.lit("BERT-primary label: rules detected, BERT missed (prob="), shown, F.lit(")")))
        .when(rb, F.concat(head, F.lit("rules detected, "), signal))
        .otherwise(F.concat(head, lone))
    )
    return base.select("*", included.alias("included"), confidence.alias("confidence"), decision.alias("decision"), reason.alias("reason"))


def disagreements(cells: DataFrame) -> DataFrame:
    """The disagreement log: rows on which the sources differ."""
    return cells.filter("decision is not null").select(
        "rec_id", "study_id", "label", "policy", "rb_detected", "bert_detected", four("bert_prob").alias("bert_prob"), four("rb_score").alias("rb_score"), "decision", "reason"
    )


def _summary_aggregates() -> list[Column]:
    names = lambda c: F.array_join(F.array_sort(F.collect_list(F.when(F.col(c), F.col("label")))), ",")
    return [
        names("included").alias("final"), names("rb_detected").alias("rb"), names("bert_detected").alias("bert"),
        F.count_if("included").alias("num_labels"), F.count_if("rb_detected").alias("rb_count"), F.count_if("bert_detected").alias("bert_count"),
        F.count_if(F.col("decision").isNotNull()).alias("disagreement_count"), F.max("has_normal_phrase").alias("has_normal_phrase"),
        F.max(F.when(F.col("blank"), 0).otherwise(F.coalesce("n_folds", F.lit(0)))).alias("n_bert_folds"), F.max(F.when(~F.col("blank"), four("normal_prob"))).alias("normal_prob"), F.max("active").alias("normal_suppression_active"),
    ]


def _summary_columns() -> list[Column]:
    plain = lambda c: F.when(F.col(c) == "", "Normal").otherwise(F.col(c))
    kept = ("rb_count", "bert_count", "disagreement_count", "has_normal_phrase", "n_bert_folds", "normal_prob", "normal_suppression_active")
    return [
        plain("final").alias("final_labels"), F.col("num_labels"), (F.col("num_labels") == 0).alias("is_normal"), plain("rb").alias("rb_labels_str"),
        plain("bert").alias("bert_labels_str"), *(F.col(c) for c in kept),
    ]


def summary(cells: DataFrame) -> DataFrame:
    """One row per report: label lists, counts and flags."""
    return cells.groupBy("rec_id", "study_id").agg(*_summary_aggregates()).select("rec_id", "study_id", *_summary_columns())


def short_name(label: str) -> str:
    """Column-friendly name of a label."""
    return label.replace(" / ", "_").replace(" ", "_")


def _wide_aggregates() -> list[Column]:
    columns = []
    for label in C.LABELS:
        own, s = F.col("label") == label, short_name(label)
        columns += [
            F.max(F.when(own, F.col("included").cast("int"))).alias(f"pred_{s}"), F.max(F.when(own, F.col("confidence"))).alias(f"conf_{s}"), F.max(F.when(own, F.col("rb_detected").cast("int"))).alias(f"rb_pred_{s}"),
            F.max(F.when(own, F.col("bert_detected").cast("int"))).alias(f"bert_pred_{s}"), F.max(F.when(own, four("bert_prob"))).alias(f"bert_prob_{s}"),
        ]
    return columns


def wide_record(cells: DataFrame) -> DataFrame:
    """Five columns per label and report: pred, conf, rb_pred, bert_pred and bert_prob, as conditional aggregates over one shuffle."""
    return cells.groupBy("rec_id").agg(*_wide_aggregates())


def full_record(cells: DataFrame, *carried: str) -> DataFrame:
    """Summary, per-label columns and the ``carried`` columns of every report, from one aggregation."""
    own = [F.first(c).alias(c) for c in carried]
    wide = cells.groupBy("rec_id", "study_id").agg(*_summary_aggregates(), *_wide_aggregates(), *own)
    named = [c for c in wide.columns if c.startswith(("pred_", "conf_", "rb_pred_", "bert_pred_", "bert_prob_"))]
    return wide.select("rec_id", "study_id", *_summary_columns(), *named, *carried)


def union_vote(rules: Column, other: Column) -> Column:
    """Older vote: every label that rules or the other extractor found, sorted."""
    return F.array_sort(F.array_union(F.coalesce(rules, F.array()), F.coalesce(other, F.array())))
