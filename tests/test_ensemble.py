from __future__ import annotations

import itertools

import pytest
from pyspark.sql import functions as F

from radweave.functions import constants as C
from radweave.operators import ensemble, hierarchy, scores

RESULT = "array<struct<label:string,score:double>>"


def plain(policy, rb, p, normal):
    """(included, confidence, decision) of one cell by the decision table."""
    model, on = p >= 0.5, normal is not None and normal >= 0.7
    if rb == model:
        return rb, "high", None
    if policy == "bert_primary":
        return True, "medium" if model else "low", "included (BERT primary)" if model else "included (RB backup)"
    rare = policy == "rare_unstable"
    if rb:
        weak = p >= 0.3
        if rare:
            return True, "medium" if weak else "low", f"included (RB detected, {'BERT weak signal' if weak else 'no BERT signal'}, rare)"
        return True, "medium", f"included (RB primary, {'BERT weak signal' if weak else 'no BERT signal'})"
    bar = (0.95 if on else 0.85) if rare else (0.90 if on else 0.80)
    return p >= bar, "low", ("included (high" if p >= bar else "excluded (low") + " BERT prob" + (", rare)" if rare else ")")


def test_decision_table(spark):
    cases = list(itertools.product((False, True), (0.0, 0.2999, 0.3, 0.4999, 0.5, 0.7999, 0.8, 0.85, 0.8999, 0.9, 0.95, 1.0), (None, 0.69, 0.7)))
    rows, marks = [], []
    for i, (rb, p, normal) in enumerate(cases):
        rows.append((i, f"s{i}", [(x, 0.6) for x in C.LABELS] if rb else [], False, False))
        marks += [(f"s{i}", 0, x, p) for x in C.LABELS] + ([(f"s{i}", 0, "Normal", normal)] if normal is not None else [])
    reports = spark.createDataFrame(rows, f"rec_id long, study_id string, results {RESULT}, has_normal_phrase boolean, blank boolean")
    table = spark.createDataFrame(marks, "study_id string, fold int, label string, prob double")
    got = {(r.rec_id, r.label): r for r in ensemble.decisions(reports, scores.fold_average(table)).collect()}
    assert len(got) == len(cases) * 13
    for i, (rb, p, normal) in enumerate(cases):
        for label in C.LABELS:
            r = got[i, label]
            assert (r.included, r.confidence, r.decision) == plain(ensemble.policy_of(label), rb, p, normal), (label, rb, p, normal)
            assert (r.reason is None) == (r.decision is None)


def test_blank_and_unscored(spark):
    reports = spark.createDataFrame([(1, "a", [], False, True), (2, None, [("Tuberculosis", 0.7)], True, False)], f"rec_id long, study_id string, results {RESULT}, has_normal_phrase boolean, blank boolean")
    table = spark.createDataFrame([("a", 0, x, 0.99) for x in C.LABELS] + [(None, 0, "Tuberculosis", 0.9)], "study_id string, fold int, label string, prob double")
    s = {r.rec_id: r for r in ensemble.summary(ensemble.decisions(reports, scores.fold_average(table))).collect()}
    assert s[1].is_normal and s[1].final_labels == "Normal" and s[1].n_bert_folds == 0
    assert s[2].final_labels == "Tuberculosis" and s[2].bert_count == 0 and s[2].disagreement_count == 1


def test_fold_average(spark):
    rows = [("a", 0, "Cardiomegaly", 0.5), ("a", 0, "Cardiomegaly", 0.3), ("a", 1, "Atelectasis", 0.2), ("a", 2, "Normal", 0.8), ("a", 2, "Cardiomegaly", None), ("b", 0, "Atelectasis", None)]
    got = {r.study_id: r for r in scores.fold_average(spark.createDataFrame(rows, "study_id string, fold int, label string, prob double")).collect()}
    assert got["a"].n_folds == 3 and got["a"].probs["Cardiomegaly"] == pytest.approx(0.5 / 3) and got["a"].normal_prob == pytest.approx(0.8)
    assert got["b"].normal_prob is None and got["b"].probs["Atelectasis"] == 0.0
    assert scores.fold_average(spark.createDataFrame([], "study_id string, fold int, label string, prob double")).count() == 0


def test_hierarchy(spark):
    h = spark.createDataFrame([("A", 0, "x"), ("B", 1, "y"), ("C", 2, "x")], "label string, label_idx int, tier2 string")
    df = spark.createDataFrame([(1, ["C", "A", "?"], True), (2, [], True), (3, ["B"], False)], "id long, l array<string>, ok boolean")
    got = {r.id: r for r in hierarchy.with_hierarchy(df, "l", h, "ok").collect()}
    assert (got[1].tier1, got[1].tier2, got[1].tier3) == ("abnormal", ["x"], ["C", "A"])
    assert got[2].tier1 == "normal" and got[3].tier1 == "indeterminate"
    with pytest.raises(Exception, match="Unknown pathology label: \\?"):
        df.selectExpr("'?' as l").select(hierarchy.strict_tier2(F.col("l"), hierarchy.tier2_map(h))).collect()


def test_union_vote(spark):
    df = spark.createDataFrame([(["b"], ["a", "b"]), (None, ["c"])], "a array<string>, b array<string>")
    assert [r[0] for r in df.select(ensemble.union_vote(df.a, df.b)).collect()] == [["a", "b"], ["c"]]
