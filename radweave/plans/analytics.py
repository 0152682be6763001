"""Queries of distribution, agreement, relational operators and evaluation, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from radweave.functions import constants as C
from radweave.functions.text import strip
from radweave.operators import agreement, ensemble, metrics
from radweave.plans import labelling
from radweave.tables import table

LOST = "ANON"


def _predictions(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "ensemble_predictions")


def label_distribution(spark: SparkSession, folder: str) -> DataFrame:
    """Records per label in the ensemble, rule and model lists."""
    return agreement.distribution(_predictions(spark, folder), ensemble="final_labels", rb="rb_labels_str", bert="bert_labels_str")


def multi_label_stats(spark: SparkSession, folder: str) -> DataFrame:
    """Normal and abnormal counts and the number of labels per report."""
    n = F.col("num_labels")
    pct = lambda c: F.round(c / F.count(F.lit(1)) * 100 + 1e-9, 2)
    return _predictions(spark, folder).agg(
        F.count(F.lit(1)).alias("total_reports"), F.count_if(F.col("is_normal") == 1).alias("normal_count"), pct(F.count_if(F.col("is_normal") == 1)).alias("normal_pct"),
        F.count_if(F.col("is_normal") == 0).alias("abnormal_count"), pct(F.count_if(F.col("is_normal") == 0)).alias("abnormal_pct"), F.round(F.avg(n) + 1e-9, 2).alias("mean_labels"),
        F.median(n).alias("median_labels"), F.max(n).alias("max_labels"), F.count_if(n == 1).alias("with_1"), F.count_if(n == 2).alias("with_2"), F.count_if(n >= 3).alias("with_3plus"),
    )


def confidence_distribution(spark: SparkSession, folder: str) -> DataFrame:
    """Cells per confidence over the dense grid of reports and labels."""
    return labelling.cells(spark, folder).groupBy("confidence").agg(F.count(F.lit(1)).alias("n"))


def disagreement_stats(spark: SparkSession, folder: str) -> DataFrame:
    d = F.col("disagreement_count")
    return _predictions(spark, folder).agg(
        F.sum(d).alias("total_disagreements"), F.count_if(d > 0).alias("reports_with_disagreements"), F.round(F.count_if(d > 0) / F.count(F.lit(1)) * 100 + 1e-9, 2).alias("pct_reports")
    )


def label_cooccurrence(spark: SparkSession, folder: str) -> DataFrame:
    return agreement.cooccurrence(_predictions(spark, folder), "final_labels")


def policy_decisions(spark: SparkSession, folder: str) -> DataFrame:
    """Logged disagreements by policy and decision, with their share of the policy."""
    n = table(spark, folder, "disagreement_log").groupBy("policy", "decision").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("study_id").alias("n_studies"))
    total = n.groupBy("policy").agg(F.sum("n").alias("t"))
    return n.join(total, "policy").select("policy", "decision", "n", "n_studies", F.round(F.col("n") / F.col("t"), 6).alias("share"))


def method_agreement(spark: SparkSession, folder: str) -> DataFrame:
    """Pairwise agreement of the three label lists per report."""
    a, b, c = (agreement.as_list(x) for x in ("rb_labels_str", "bert_labels_str", "final_labels"))
    df = _predictions(spark, folder).select("rec_id", agreement.jaccard(a, b).alias("rb_bert"), agreement.jaccard(a, c).alias("rb_final"), agreement.jaccard(b, c).alias("bert_final"))
    mean = (F.col("rb_bert") + F.col("rb_final") + F.col("bert_final")) / 3
    return df.select("rec_id", *[F.round(x, 6).alias(x) for x in ("rb_bert", "rb_final", "bert_final")], F.round(mean, 6).alias("agreement_score"))


def quality_dashboard(spark: SparkSession, folder: str) -> DataFrame:
    a, b, c = (agreement.as_list(x) for x in ("rb_labels_str", "bert_labels_str", "final_labels"))
    return _predictions(spark, folder).agg(
        F.round(F.avg(agreement.jaccard(a, b)), 6).alias("rb_bert"), F.round(F.avg(agreement.jaccard(a, c)), 6).alias("rb_final"), F.round(F.avg(agreement.jaccard(b, c)), 6).alias("bert_final")
    )


def compiled_reports(spark: SparkSession, folder: str) -> DataFrame:
    """Word and character counts and section flags of every report."""
    df = agreement.compile_flags(_predictions(spark, folder).select("rec_id", "report_text"))
    return df.drop("report_text")


def review_triage(spark: SparkSession, folder: str) -> DataFrame:
    """High-risk flag and priority per report."""
    labels = agreement.as_list("final_labels")
    rate = agreement.jaccard(agreement.as_list("rb_labels_str"), agreement.as_list("bert_labels_str"))
    df = agreement.compile_flags(_predictions(spark, folder).select("rec_id", "report_text", "final_labels", "rb_labels_str", "bert_labels_str"))
    return df.select("rec_id", agreement.high_risk(labels).alias("high_risk"), agreement.priority(rate, labels, F.col("word_count")).alias("review_priority"))


def compiled_join(spark: SparkSession, folder: str) -> DataFrame:
    """Inner equi-join of predictions and annotations on the study; lost study ids match nothing."""
    a = table(spark, folder, "annotated_reports").filter((F.col("study_id") != LOST) & F.col("review_priority").isNotNull()).select("study_id", F.col("rec_id").alias("ann_id"), strip(F.col("review_priority")).alias("review_priority"))
    return _predictions(spark, folder).filter(F.col("study_id") != LOST).select("study_id", "rec_id", "num_labels").join(a, "study_id")


def unprocessed_studies(spark: SparkSession, folder: str) -> DataFrame:
    """Studies of the metadata without a prediction (left anti join)."""
    return table(spark, folder, "study_metadata").select("study_id", "original_folder").join(_predictions(spark, folder).select("study_id").distinct(), "study_id", "left_anti")


def annotated_predictions(spark: SparkSession, folder: str) -> DataFrame:
    """Predictions whose study was annotated (left semi join)."""
    a = table(spark, folder, "annotated_reports").filter(F.col("study_id") != LOST).select("study_id").distinct()
    return _predictions(spark, folder).select("rec_id", "study_id").join(a, "study_id", "left_semi")


def priority_shares(spark: SparkSession, folder: str) -> DataFrame:
    """Normalised value counts of the review priority, blanks trimmed, case folded."""
    v = F.coalesce(F.lower(strip(F.col("review_priority"))), F.lit("missing"))
    df = table(spark, folder, "annotated_reports").groupBy(v.alias("review_priority")).agg(F.count(F.lit(1)).alias("n"))
    return df.select("review_priority", "n", F.round(F.col("n") / df.agg(F.sum("n")).scalar(), 6).alias("share"))


def source_aggregates(spark: SparkSession, folder: str) -> DataFrame:
    """Scalar aggregates of the corpus by source and language."""
    d = table(spark, folder, "documents")
    n = F.col("n_chars")
    return d.groupBy("source", "lang").agg(F.count(F.lit(1)).alias("n_docs"), F.sum(n).alias("chars"), F.round(F.avg(n), 4).alias("mean_chars"), F.median(n).alias("median_chars"), F.max(n).alias("max_chars"), F.count_if(n == 0).alias("n_empty"))


def distinct_studies(spark: SparkSession, folder: str) -> DataFrame:
    """Count distinct, per label of the log."""
    return table(spark, folder, "disagreement_log").groupBy("label").agg(F.countDistinct("study_id").alias("n_studies"), F.countDistinct("rec_id").alias("n_rows"))


def corpus_union(spark: SparkSession, folder: str) -> DataFrame:
    """Union of annotated and augmented training rows with columns missing on one side."""
    a = table(spark, folder, "annotated_reports").select("rec_id", "study_id", "gold_labels", "review_priority")
    t = table(spark, folder, "training_reports_augmented").select("rec_id", "study_id", "gold_labels", "is_synthetic", "neg_target", "split")
    u = a.unionByName(t, allowMissingColumns=True)
    return u.select("rec_id", "study_id", "gold_labels", "review_priority", "is_synthetic", F.coalesce("neg_target", F.lit("")).alias("neg_target"), "split")


def label_set_ops(spark: SparkSession, folder: str) -> DataFrame:
    """Union, intersection and difference of rule and model labels."""
    a, b = agreement.as_list("rb_labels_str"), agreement.as_list("bert_labels_str")
    show = lambda x: F.array_join(F.array_sort(F.array_distinct(x)), ",")
    return _predictions(spark, folder).select("rec_id", show(F.array_union(a, b)).alias("any"), show(F.array_intersect(a, b)).alias("both"), show(F.array_except(a, b)).alias("rb_only"))


def labels_long(spark: SparkSession, folder: str) -> DataFrame:
    """One row per report and label of the ensemble."""
    return _predictions(spark, folder).select("rec_id", F.posexplode(agreement.as_list("final_labels")).alias("pos", "label"))


def score_pivot(spark: SparkSession, folder: str) -> DataFrame:
    """Highest probability per study, one column per label."""
    df = table(spark, folder, "scores").groupBy("study_id").pivot("label", list(C.LABELS)).agg(F.max("prob"))
    return df.select("study_id", *[F.col(f"`{x}`").alias("max_" + ensemble.short_name(x)) for x in C.LABELS])


def top_disagreements(spark: SparkSession, folder: str) -> DataFrame:
    """The three most confident model votes per label of the log: a top-k report."""
    from pyspark.sql import Window as W

    d = table(spark, folder, "disagreement_log")
    w = W.partitionBy("label").orderBy(F.desc("bert_prob"), "rec_id")
    return d.select("label", "rec_id", "bert_prob", F.row_number().over(w).alias("rank")).filter("rank <= 3")


def gold_multi_hot(spark: SparkSession, folder: str) -> DataFrame:
    return metrics.multi_hot(table(spark, folder, "annotated_reports"), "rec_id")


def class_weights(spark: SparkSession, folder: str) -> DataFrame:
    df = metrics.class_weights(metrics.multi_hot(table(spark, folder, "annotated_reports"), "rec_id"))
    return df.select("label", "pos", "neg", F.round("weight", 6).alias("weight"))


def _grid(spark: SparkSession, folder: str) -> DataFrame:
    return metrics.scored_grid(table(spark, folder, "annotated_reports"), table(spark, folder, "scores"))


def metric_labels(spark: SparkSession, folder: str) -> DataFrame:
    df = metrics.confusion(_grid(spark, folder), F.col("prob") >= 0.5)
    return df.select("label", "tp", "fp", "fn", "tn", "support", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")])


def metric_averages(spark: SparkSession, folder: str) -> DataFrame:
    df = metrics.averages(metrics.confusion(_grid(spark, folder), F.col("prob") >= 0.5))
    return df.select(F.round("macro_f1", 6).alias("macro_f1"), F.round("weighted_f1", 6).alias("weighted_f1"), "n_labels")


def metric_exact(spark: SparkSession, folder: str) -> DataFrame:
    df = metrics.exact_match(_grid(spark, folder), F.col("prob") >= 0.5)
    return df.select(F.round("exact_match", 6).alias("exact_match"), "n")


def metric_curves(spark: SparkSession, folder: str) -> DataFrame:
    df = metrics.curve(_grid(spark, folder))
    return df.select("label", F.round("auroc", 6).alias("auroc"), F.round("pr_auc", 6).alias("pr_auc"))


def metric_macro_curves(spark: SparkSession, folder: str) -> DataFrame:
    return metrics.curve(_grid(spark, folder)).agg(F.round(F.avg("auroc"), 6).alias("macro_auroc"), F.round(F.avg("pr_auc"), 6).alias("macro_pr_auc"))


def tuned_thresholds(spark: SparkSession, folder: str) -> DataFrame:
    return metrics.tune(_grid(spark, folder))


def fold_thresholds(spark: SparkSession, folder: str) -> DataFrame:
    """Thresholds tuned per fold of studies, averaged per label."""
    from radweave.operators.scores import threshold_average

    g = _grid(spark, folder).withColumn("fold", metrics.fold_of(F.col("study_id")))
    return threshold_average(metrics.tune(g, "fold"))


def method_comparison(spark: SparkSession, folder: str) -> DataFrame:
    """F1 of rules and model per label and the better one."""
    g = _grid(spark, folder)
    first = table(spark, folder, "annotated_reports").filter(F.col("study_id") != LOST).groupBy("study_id").agg(F.min("rec_id").alias("rec_id"))
    rules = labelling.labelled(spark, folder, "annotated_reports").select("rec_id", labelling.rules.label_list().alias("rb")).join(first, "rec_id").select("study_id", "rb")
    both = g.join(rules, "study_id")
    m = metrics.confusion(both, F.col("prob") >= 0.5).select("label", F.round(F.col("f1") + 1e-9, 4).alias("bert_f1"))
    r = metrics.confusion(both, F.array_contains("rb", F.col("label"))).select("label", F.round(F.col("f1") + 1e-9, 4).alias("rb_f1"))
    return m.join(r, "label").select("label", "bert_f1", "rb_f1", metrics.winner(F.col("bert_f1"), F.col("rb_f1")).alias("winner"))


def normal_stats(spark: SparkSession, folder: str) -> DataFrame:
    """Mean Normal probability, rate called and accuracy."""
    g = _grid(spark, folder).select("study_id", "normal_prob", "n_gold").distinct().filter("normal_prob is not null")
    hat = F.col("normal_prob") >= 0.5
    return g.agg(F.round(F.avg("normal_prob"), 6).alias("mean_prob"), F.round(F.avg(hat.cast("int")), 6).alias("rate"), F.round(F.avg((hat == (F.col("n_gold") == 0)).cast("int")), 6).alias("accuracy"), F.count(F.lit(1)).alias("n"))


def label_losses(spark: SparkSession, folder: str) -> DataFrame:
    return metrics.losses(_grid(spark, folder)).select("label", F.round("bce", 6).alias("bce"), F.round("focal", 6).alias("focal"))


def weighted_label_losses(spark: SparkSession, folder: str) -> DataFrame:
    """The losses with every positive counted by its label's class weight."""
    weights = metrics.class_weights(metrics.multi_hot(table(spark, folder, "annotated_reports"), "rec_id"))
    return metrics.losses(_grid(spark, folder), weights=weights).select("label", F.round("bce", 6).alias("bce"), F.round("focal", 6).alias("focal"))


def fold_split(spark: SparkSession, folder: str) -> DataFrame:
    """Fold of every real training row, stratified by its labels; synthetic ones train in all folds (fold -1)."""
    t = table(spark, folder, "training_reports_augmented").select("rec_id", "gold_labels", F.coalesce("is_synthetic", F.lit(False)).alias("made"))
    return metrics.stratified_folds(t.filter("not made"), "rec_id").unionByName(t.filter("made").select("rec_id", F.lit(-1).alias("fold")))


def queries() -> dict:
    return {
        f.__name__: f
        for f in (
            label_distribution, multi_label_stats, confidence_distribution, disagreement_stats, label_cooccurrence, policy_decisions, method_agreement, quality_dashboard, compiled_reports,
            review_triage, compiled_join, unprocessed_studies, annotated_predictions, priority_shares, source_aggregates, distinct_studies, corpus_union, label_set_ops, labels_long,
            score_pivot, top_disagreements, gold_multi_hot, class_weights, metric_labels, metric_averages, metric_exact, metric_curves, metric_macro_curves, tuned_thresholds, fold_thresholds,
            method_comparison, normal_stats, label_losses, weighted_label_losses, fold_split,
        )
    }


# --- SQL -------------------------------------------------------------------------------------------------

_S = labelling._strip


def _items(table_name: str, column: str, alias: str) -> str:
    return f"{alias} AS (SELECT rec_id, {_S('x')} AS label FROM (SELECT rec_id, unnest(string_split(coalesce({column}, ''), ',')) AS x FROM {table_name}) WHERE {_S('x')} NOT IN ('', 'Normal'))"


_THREE = f"""{_items('ensemble_predictions', 'rb_labels_str', 'ra')}, {_items('ensemble_predictions', 'bert_labels_str', 'rb')}, {_items('ensemble_predictions', 'final_labels', 'rc')},
la AS (SELECT p.rec_id, coalesce((SELECT list(DISTINCT label) FROM ra WHERE ra.rec_id = p.rec_id), []::VARCHAR[]) AS a, coalesce((SELECT list(DISTINCT label) FROM rb WHERE rb.rec_id = p.rec_id), []::VARCHAR[]) AS b,
  coalesce((SELECT list(DISTINCT label) FROM rc WHERE rc.rec_id = p.rec_id), []::VARCHAR[]) AS c, p.report_text FROM ensemble_predictions p)"""


def _jac(x: str, y: str) -> str:
    return f"CASE WHEN len(list_distinct({x} || {y})) = 0 THEN 1.0 ELSE len(list_intersect({x}, {y})) / len(list_distinct({x} || {y}))::DOUBLE END"


_WC = f"CASE WHEN {_S('coalesce(report_text, $$$$)')} = '' THEN 0 ELSE len(string_split_regex({_S('coalesce(report_text, $$$$)')}, '[{C.BLANKS}]+')) END"

_GRID = f"""{labelling._averages().strip()},
gold AS (SELECT study_id, arg_min(coalesce(gold_labels, ''), rec_id) AS g FROM annotated_reports WHERE study_id IS NOT NULL AND study_id <> '{LOST}' GROUP BY study_id),
goldl AS (SELECT DISTINCT study_id, {_S('x')} AS label FROM (SELECT study_id, unnest(string_split(g, ',')) AS x FROM gold)),
grid AS (SELECT a.study_id, a.normal_prob, a.label, a.prob, (l.label IS NOT NULL)::INTEGER AS y, (SELECT count(*) FROM goldl q JOIN label_hierarchy h ON h.label = q.label WHERE q.study_id = a.study_id) AS n_gold
  FROM avgs a JOIN gold g ON g.study_id = a.study_id LEFT JOIN goldl l ON l.study_id = a.study_id AND l.label = a.label)"""


def _conf(hat: str, source: str = "grid", name: str = "conf") -> str:
    return f"""{name} AS (SELECT label, count(*) FILTER ({hat} AND y = 1) AS tp, count(*) FILTER ({hat} AND y = 0) AS fp, count(*) FILTER (NOT ({hat}) AND y = 1) AS fn, count(*) FILTER (NOT ({hat}) AND y = 0) AS tn FROM {source} GROUP BY label),
{name}2 AS (SELECT *, tp + fn AS support, CASE WHEN tp + fp > 0 THEN tp / (tp + fp)::DOUBLE ELSE 0 END AS precision, CASE WHEN tp + fn > 0 THEN tp / (tp + fn)::DOUBLE ELSE 0 END AS recall, CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn)::DOUBLE ELSE 0 END AS f1 FROM {name})"""


_CURVE = """bys AS (SELECT label, prob, sum(y) AS pos, count(*) FILTER (y = 0) AS neg FROM grid GROUP BY label, prob),
cw AS (SELECT label, pos, neg, coalesce(sum(neg) OVER (PARTITION BY label ORDER BY prob ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS nb, sum(pos) OVER (PARTITION BY label ORDER BY prob DESC ROWS UNBOUNDED PRECEDING) AS tp,
  sum(neg) OVER (PARTITION BY label ORDER BY prob DESC ROWS UNBOUNDED PRECEDING) AS fp, sum(pos) OVER (PARTITION BY label) AS P, sum(neg) OVER (PARTITION BY label) AS N FROM bys),
curve AS (SELECT label, CASE WHEN max(P) > 0 AND max(N) > 0 THEN sum(pos * (2 * nb + neg)) / (2.0 * max(P) * max(N)) END AS auroc, CASE WHEN max(P) > 0 AND max(N) > 0 THEN sum(pos * (tp / (tp + fp)::DOUBLE)) / max(P) END AS pr_auc FROM cw GROUP BY label)"""


def _tuned(keys: str = "") -> str:
    k = f", {keys}" if keys else ""
    return f"""ts AS (SELECT 0.1::DOUBLE + i * 0.05::DOUBLE AS t FROM (SELECT unnest(range(0, 17)) AS i)), fs AS (SELECT label{k}, t, 2.0 * count(*) FILTER (y = 1 AND prob >= t) / nullif(count(*) FILTER (prob >= t) + sum(y), 0) AS f1, sum(y) AS P FROM tg, ts GROUP BY label{k}, t),
tuned AS (SELECT label{k}, CASE WHEN max(P) = 0 OR coalesce(max(f1), 0) <= 0 THEN 0.5 ELSE round(min_by(t, struct_pack(a := -coalesce(f1, 0), b := t)), 2) END AS threshold FROM fs GROUP BY label{k})"""


def _fold(key: str) -> str:
    return f"(('0x' || substr(md5({key}::VARCHAR || '42'), 1, 8))::BIGINT % 5)::INTEGER"


def oracle_sql() -> dict[str, str]:
    e, log = "ensemble_predictions", "disagreement_log"
    pct = lambda c: f"round({c} / count(*)::DOUBLE * 100 + 1e-9, 2)"
    show = lambda x: f"array_to_string(list_sort(list_distinct({x})), ',')"
    names = ", ".join(f"max(prob) FILTER (label = '{x}') AS \"max_{ensemble.short_name(x)}\"" for x in C.LABELS)
    risk = "len(list_intersect(c, ['" + "', '".join(C.HIGH_RISK) + "'])) > 0"
    return {
        "label_distribution": f"""WITH {_THREE}, u AS (SELECT DISTINCT rec_id, label, 'c' AS k FROM rc UNION ALL SELECT DISTINCT rec_id, label, 'a' FROM ra UNION ALL SELECT DISTINCT rec_id, label, 'b' FROM rb)
            SELECT label, count(*) FILTER (k = 'c') AS ensemble_count, count(*) FILTER (k = 'a') AS rb_count, count(*) FILTER (k = 'b') AS bert_count, round(count(*) FILTER (k = 'c') / (SELECT count(*) FROM {e})::DOUBLE * 100 + 1e-9, 2) AS ensemble_pct FROM u GROUP BY label""",
        "multi_label_stats": f"""SELECT count(*) AS total_reports, count(*) FILTER (is_normal = 1) AS normal_count, {pct('count(*) FILTER (is_normal = 1)')} AS normal_pct, count(*) FILTER (is_normal = 0) AS abnormal_count,
            {pct('count(*) FILTER (is_normal = 0)')} AS abnormal_pct, round(avg(num_labels) + 1e-9, 2) AS mean_labels, median(num_labels) AS median_labels, max(num_labels) AS max_labels, count(*) FILTER (num_labels = 1) AS with_1,
            count(*) FILTER (num_labels = 2) AS with_2, count(*) FILTER (num_labels >= 3) AS with_3plus FROM {e}""",
        "confidence_distribution": f"WITH {labelling._cells()} SELECT confidence, count(*) AS n FROM cells GROUP BY confidence",
        "disagreement_stats": f"SELECT sum(disagreement_count)::BIGINT AS total_disagreements, count(*) FILTER (disagreement_count > 0) AS reports_with_disagreements, {pct('count(*) FILTER (disagreement_count > 0)')} AS pct_reports FROM {e}",
        "label_cooccurrence": f"WITH {_items(e, 'final_labels', 'rc')}, d AS (SELECT DISTINCT rec_id, label FROM rc) SELECT a.label AS label_a, b.label AS label_b, count(*) AS n FROM d a JOIN d b ON a.rec_id = b.rec_id AND a.label < b.label GROUP BY ALL",
        "policy_decisions": f"WITH n AS (SELECT policy, decision, count(*) AS n, count(DISTINCT study_id) AS n_studies FROM {log} GROUP BY ALL) SELECT policy, decision, n, n_studies, round(n / sum(n) OVER (PARTITION BY policy), 6) AS share FROM n",
        "method_agreement": f"WITH {_THREE}, j AS (SELECT rec_id, {_jac('a', 'b')} AS rb_bert, {_jac('a', 'c')} AS rb_final, {_jac('b', 'c')} AS bert_final FROM la) SELECT rec_id, round(rb_bert, 6) AS rb_bert, round(rb_final, 6) AS rb_final, round(bert_final, 6) AS bert_final, round((rb_bert + rb_final + bert_final) / 3, 6) AS agreement_score FROM j",
        "quality_dashboard": f"WITH {_THREE} SELECT round(avg({_jac('a', 'b')}), 6) AS rb_bert, round(avg({_jac('a', 'c')}), 6) AS rb_final, round(avg({_jac('b', 'c')}), 6) AS bert_final FROM la",
        "compiled_reports": f"SELECT rec_id, ({_WC})::INTEGER AS word_count, length(coalesce(report_text, ''))::INTEGER AS character_count, regexp_matches(coalesce(report_text, ''), '(?i)(findings|comments|body)[\\s\\x0b]*:') AS has_findings, regexp_matches(coalesce(report_text, ''), '(?i)(impression|conclusion|summary|notes)[\\s\\x0b]*:') AS has_impression FROM {e}",
        "review_triage": f"""WITH {_THREE}, j AS (SELECT rec_id, {_jac('a', 'b')} AS r, {risk} AS high_risk, len(c) AS n, {_WC} AS wc FROM la)
            SELECT rec_id, high_risk, CASE WHEN r >= 0.3 AND r < 0.5 THEN 2 WHEN r < 0.3 OR high_risk THEN 3 WHEN n >= 3 THEN 2 WHEN wc > 120 THEN 1 ELSE 0 END AS review_priority FROM j""",
        "compiled_join": f"SELECT e.study_id, e.rec_id, e.num_labels, a.rec_id AS ann_id, {_S('a.review_priority')} AS review_priority FROM {e} e JOIN annotated_reports a ON a.study_id = e.study_id WHERE e.study_id <> '{LOST}' AND a.review_priority IS NOT NULL",
        "unprocessed_studies": f"SELECT study_id, original_folder FROM study_metadata m WHERE NOT EXISTS (SELECT 1 FROM {e} e WHERE e.study_id = m.study_id)",
        "annotated_predictions": f"SELECT rec_id, study_id FROM {e} e WHERE study_id <> '{LOST}' AND EXISTS (SELECT 1 FROM annotated_reports a WHERE a.study_id = e.study_id)",
        "priority_shares": f"WITH n AS (SELECT coalesce(lower({_S('review_priority')}), 'missing') AS review_priority, count(*) AS n FROM annotated_reports GROUP BY 1) SELECT review_priority, n, round(n / (sum(n) OVER ()), 6) AS share FROM n",
        "source_aggregates": "SELECT source, lang, count(*) AS n_docs, sum(n_chars)::BIGINT AS chars, round(avg(n_chars), 4) AS mean_chars, median(n_chars) AS median_chars, max(n_chars) AS max_chars, count(*) FILTER (n_chars = 0) AS n_empty FROM documents GROUP BY ALL",
        "distinct_studies": f"SELECT label, count(DISTINCT study_id) AS n_studies, count(DISTINCT rec_id) AS n_rows FROM {log} GROUP BY label",
        "corpus_union": "SELECT rec_id, study_id, gold_labels, review_priority, NULL::BOOLEAN AS is_synthetic, '' AS neg_target, NULL::VARCHAR AS split FROM annotated_reports UNION ALL SELECT rec_id, study_id, gold_labels, NULL, is_synthetic, coalesce(neg_target, ''), split FROM training_reports_augmented",
        "label_set_ops": f"WITH {_THREE} SELECT rec_id, {show('a || b')} AS any, {show('list_intersect(a, b)')} AS both, {show('list_filter(a, lambda x: NOT list_contains(b, x))')} AS rb_only FROM la",
        "labels_long": f"WITH x AS (SELECT rec_id, unnest(list_filter(list_transform(string_split(coalesce(final_labels, ''), ','), lambda x: {_S('x')}), lambda x: x NOT IN ('', 'Normal'))) AS label, generate_subscripts(list_filter(list_transform(string_split(coalesce(final_labels, ''), ','), lambda x: {_S('x')}), lambda x: x NOT IN ('', 'Normal')), 1) AS i FROM {e}) SELECT rec_id, (i - 1)::INTEGER AS pos, label FROM x",
        "score_pivot": f"SELECT study_id, {names} FROM scores GROUP BY study_id",
        "top_disagreements": f"SELECT label, rec_id, bert_prob, rank::INTEGER AS rank FROM (SELECT label, rec_id, bert_prob, row_number() OVER (PARTITION BY label ORDER BY bert_prob DESC NULLS LAST, rec_id) AS rank FROM {log}) WHERE rank <= 3",
        "gold_multi_hot": f"""WITH {_items('annotated_reports', 'gold_labels', 'g')}, h AS (SELECT a.rec_id, l.label, (EXISTS (SELECT 1 FROM g WHERE g.rec_id = a.rec_id AND g.label = l.label))::INTEGER AS y FROM annotated_reports a CROSS JOIN label_hierarchy l)
            SELECT * FROM h UNION ALL SELECT rec_id, 'Normal', (sum(y) = 0)::INTEGER FROM h GROUP BY rec_id""",
        "class_weights": f"""WITH {_items('annotated_reports', 'gold_labels', 'g')}, h0 AS (SELECT a.rec_id, l.label, (EXISTS (SELECT 1 FROM g WHERE g.rec_id = a.rec_id AND g.label = l.label))::INTEGER AS y FROM annotated_reports a CROSS JOIN label_hierarchy l),
            h AS (SELECT * FROM h0 UNION ALL SELECT rec_id, 'Normal', (sum(y) = 0)::INTEGER FROM h0 GROUP BY rec_id) SELECT label, sum(y)::BIGINT AS pos, count(*) FILTER (y = 0) AS neg, round(CASE WHEN sum(y) = 0 THEN 1.0 ELSE greatest(1.0, least(50.0, count(*) FILTER (y = 0) / sum(y)::DOUBLE)) END, 6) AS weight FROM h GROUP BY label""",
        "metric_labels": f"WITH {_GRID}, {_conf('prob >= 0.5')} SELECT label, tp, fp, fn, tn, support, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1 FROM conf2",
        "metric_averages": f"WITH {_GRID}, {_conf('prob >= 0.5')} SELECT round(avg(f1), 6) AS macro_f1, round(sum(f1 * support) / sum(support), 6) AS weighted_f1, count(*) AS n_labels FROM conf2 WHERE support > 0",
        "metric_exact": f"WITH {_GRID}, p AS (SELECT study_id, bool_and((prob >= 0.5)::INTEGER = y) AS ok FROM grid GROUP BY study_id) SELECT round(avg(ok::INTEGER), 6) AS exact_match, count(*) AS n FROM p",
        "metric_curves": f"WITH {_GRID}, {_CURVE} SELECT label, round(auroc, 6) AS auroc, round(pr_auc, 6) AS pr_auc FROM curve",
        "metric_macro_curves": f"WITH {_GRID}, {_CURVE} SELECT round(avg(auroc), 6) AS macro_auroc, round(avg(pr_auc), 6) AS macro_pr_auc FROM curve",
        "tuned_thresholds": f"WITH {_GRID}, tg AS (SELECT * FROM grid), {_tuned()} SELECT label, threshold FROM tuned",
        "fold_thresholds": f"WITH {_GRID}, tg AS (SELECT *, {_fold('study_id')} AS fold FROM grid), {_tuned('fold')} SELECT label, round(avg(threshold) + 1e-9, 2) AS threshold FROM tuned GROUP BY label",
        "method_comparison": f"""WITH {labelling._results('annotated_reports')}, {_GRID.replace('one AS', 'one AS', 1)}, firsts AS (SELECT study_id, min(rec_id) AS rec_id FROM annotated_reports WHERE study_id <> '{LOST}' GROUP BY study_id),
            g2 AS (SELECT g.*, r.rec_id IS NOT NULL AS rb FROM grid g JOIN firsts f USING (study_id) LEFT JOIN results r ON r.rec_id = f.rec_id AND r.label = g.label AND r.score >= 0.55), {_conf('prob >= 0.5', 'g2', 'm')}, {_conf('rb', 'g2', 'r')}
            SELECT label, bert_f1, rb_f1, CASE WHEN bert_f1 - rb_f1 > 0.01 THEN 'BERT' WHEN bert_f1 - rb_f1 < -0.01 THEN 'RB' ELSE 'Tie' END AS winner FROM (SELECT m.label, round(m.f1 + 1e-9, 4) AS bert_f1, round(r.f1 + 1e-9, 4) AS rb_f1 FROM m2 m JOIN r2 r USING (label))""",
        "normal_stats": f"WITH {_GRID}, d AS (SELECT DISTINCT study_id, normal_prob, n_gold FROM grid WHERE normal_prob IS NOT NULL) SELECT round(avg(normal_prob), 6) AS mean_prob, round(avg((normal_prob >= 0.5)::INTEGER), 6) AS rate, round(avg(((normal_prob >= 0.5) = (n_gold = 0))::INTEGER), 6) AS accuracy, count(*) AS n FROM d",
        "label_losses": f"WITH {_GRID}, q AS (SELECT label, CASE WHEN y = 1 THEN greatest(1e-6, least(1.0 - 1e-6, prob)) ELSE 1.0 - greatest(1e-6, least(1.0 - 1e-6, prob)) END::DOUBLE AS r FROM grid) SELECT label, round(avg(-ln(r)), 6) AS bce, round(avg(pow(1.0 - r, 2) * -ln(r)), 6) AS focal FROM q GROUP BY label",
        "weighted_label_losses": f"""WITH {_GRID}, {_items('annotated_reports', 'gold_labels', 'g')}, h AS (SELECT a.rec_id, l.label, (EXISTS (SELECT 1 FROM g WHERE g.rec_id = a.rec_id AND g.label = l.label))::INTEGER AS y FROM annotated_reports a CROSS JOIN label_hierarchy l),
            w AS (SELECT label, CASE WHEN sum(y) = 0 THEN 1.0 ELSE greatest(1.0, least(50.0, count(*) FILTER (y = 0) / sum(y)::DOUBLE)) END AS weight FROM h GROUP BY label),
            q AS (SELECT q.label, CASE WHEN y = 1 THEN weight ELSE 1.0 END AS w, CASE WHEN y = 1 THEN greatest(1e-6, least(1.0 - 1e-6, prob)) ELSE 1.0 - greatest(1e-6, least(1.0 - 1e-6, prob)) END::DOUBLE AS r FROM grid q JOIN w USING (label))
            SELECT label, round(avg(w * -ln(r)), 6) AS bce, round(avg(pow(1.0 - r, 2) * w * -ln(r)), 6) AS focal FROM q GROUP BY label""",
        "fold_split": f"""WITH s AS (SELECT rec_id, coalesce(is_synthetic, false) AS made, array_to_string(list_sort(list_distinct(list_filter(list_transform(string_split(coalesce(gold_labels, ''), ','), lambda x: {_S('x')}), lambda x: x NOT IN ('', 'Normal')))), ',') AS g FROM training_reports_augmented)
            SELECT rec_id, (row_number() OVER (PARTITION BY g ORDER BY md5(rec_id::VARCHAR || '42'), rec_id) - 1) % 5 AS fold FROM s WHERE NOT made UNION ALL SELECT rec_id, -1 FROM s WHERE made""",
    }
