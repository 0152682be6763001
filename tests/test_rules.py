from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from radweave.operators import rules, sections


LEXICON = [
    ("Normal", 0, ["normal study", "clear lungs"]),
    ("Pneumonia / Consolidation", 1, ["consolidation", "homogeneous opacity", "patchy_shadowing", "Patchy shadowing"]),
    ("Tuberculosis", 2, ["cavity", "tb"]),
    ("Cardiomegaly", 4, ["enlarged heart", "massively enlarged heart", "ctr", "cardiothoracic ratio"]),
    ("Pulmonary Edema", 5, ["bat-wing pattern", "perihilar haze"]),
    ("Other Significant Abnormality", 13, ["widened mediastinum"]),
]
#: Report to {label: (score, uncertain, fallback)}, normal flag, cue flag; worked out by hand from the surveyed weights.
CASES = [
    (None, {}, False, False), ("", {}, False, False), (" \n ", {}, False, False), ("fine", {}, False, False),
    ("tb", {"Tuberculosis": (0.5, False, False)}, False, False),
    ("Impression: cavity", {"Tuberculosis": (0.7, False, False)}, False, False),
    ("Findings: tb\nImpression: cavity", {"Tuberculosis": (0.7, False, False)}, False, False),  # one hit a section: no boost
    ("cavity then tb", {"Tuberculosis": (0.56, False, False)}, False, False),  # two hits of a section: the best gains 0.06
    ("Seen: massively enlarged heart", {"Cardiomegaly": (0.69, False, False)}, False, True),  # long + blank + boost
    ("Chest: no tb", {}, False, False), ("there is no tb. A cavity", {"Tuberculosis": (0.5, False, False)}, False, False),
    ("seen no a.\n\ncavity", {"Tuberculosis": (0.5, False, False)}, False, False), ("no evidence\nof cavity", {}, False, False),
    ("no " + "y" * 58 + " tb", {"Tuberculosis": (0.5, False, False)}, False, False),  # the negation lies outside 60 characters
    ("no " + "y" * 55 + " tb", {}, False, False),
    ("likely tb", {"Tuberculosis": (0.325, True, False)}, False, False), ("tb?", {"Tuberculosis": (0.325, True, False)}, False, False),
    ("likely " + "z" * 34 + " tb", {"Tuberculosis": (0.5, False, False)}, False, False),
    ("tbx étb", {}, False, False),
    ("ctr = 0.57", {"Cardiomegaly": (0.74, False, False)}, False, False), ("CTR: 55%", {"Cardiomegaly": (0.7, False, False)}, False, False),
    ("ctr = 0.50", {}, False, False), ("cardiothoracic ratio : 72", {"Cardiomegaly": (0.85, False, False)}, False, False),
    ("ctr=0.40, later ctr = 0.61 and enlarged heart", {"Cardiomegaly": (0.82, False, False)}, False, True),
    ("homogeneous opacity", {"Other Significant Abnormality": (0.35, False, True)}, False, True),
    ("homogeneous opacity, lobar", {"Pneumonia / Consolidation": (0.63, False, False)}, False, True),
    ("bat-wing pattern", {"Pulmonary Edema": (0.63, False, False)}, False, False),
    ("haziness but clear lungs", {}, True, True), ("haziness here", {"Other Significant Abnormality": (0.35, False, True)}, False, True),
    ("Seen: no effusion", {}, False, False), ("fine. no effusion", {}, False, False),
    ("No effusion", {"Other Significant Abnormality": (0.35, False, True)}, False, True),  # the first sentence loses its first letter
    ("Patchy shadowing", {"Pneumonia / Consolidation": (0.69, False, False)}, False, False),  # the underscore counts as a blank, the repeat as a hit
]
SECTIONED = [
    ("Findings: tb\nImpression: cavity", {"findings": "tb", "impression": "cavity"}),
    ("lead text\nFindings\nwithin\nmore", {"findings": "within\nmore"}),
    ("text. Impression: cavity", {"body": "text. Impression: cavity"}),
    ("CHEST RADIOGRAPH REPORT (UPDATED) tb\ncavity seen", {"body": "cavity seen"}),
    ("Comments\ntext\nConclusion:\nconsolidation", {"comments": "text", "conclusion": "consolidation"}),
    ("text\nImpression: tb", {"body": "text", "impression": "tb"}),
    ("Impression:", {"body": "Impression:"}),
    ("CHEST RADIOGRAPH REPORT\n", {"body": "CHEST RADIOGRAPH REPORT"}),
    ("Summary\nall clear\nFindings\nlate", {"summary": "all clear\nFindings\nlate"}),
    ("Findings:\nImpression: tb", {"impression": "tb"}),
]


@pytest.fixture(scope="module")
def lexicon(spark):
    rows = [(label, i, k, p) for label, i, ps in LEXICON for k, p in enumerate(ps)]
    return rules.Lexicon(spark.createDataFrame(rows, "label string, label_idx int, phrase_idx int, phrase string"))


@pytest.fixture(scope="module")
def labelled(spark, lexicon):
    df = spark.createDataFrame([(i, c[0]) for i, c in enumerate(CASES)], "rec_id long, report_text string").withColumn("label", F.lit("clash"))
    return {r.rec_id: r for r in rules.with_labels(df, lexicon).collect()}


@pytest.mark.parametrize("i", range(len(CASES)))
def test_cases_by_hand(labelled, i):
    text, want, normal, cue = CASES[i]
    got = labelled[i]
    assert {r.label: (round(r.score, 9), r.uncertain, r.fallback) for r in got.results} == want, text
    assert (got.has_normal_phrase, got.has_abnormal_cue, got.label) == (normal, cue, "clash"), text


def test_evidence_by_hand(spark, lexicon):
    df = spark.createDataFrame([(1, "Impression: tb, cavity, tb, cavity"), (2, "ctr = 0.60. enlarged heart")], "rec_id long, report_text string")
    got = {r.rec_id: {x.label: [(e.phrase, e.section, e.start, e.end) for e in x.evidence] for x in r.results} for r in rules.with_labels(df, lexicon).collect()}
    assert got[1] == {"Tuberculosis": [("cavity", "impression", 4, 10), ("cavity", "impression", 16, 22), ("tb", "impression", 0, 2)]}
    assert got[2] == {"Cardiomegaly": [("CTR=0.60", "numeric", 0, 10), ("enlarged heart", "body", 12, 26)]}


def test_sections_by_hand(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(SECTIONED)], "rec_id long, report_text string")
    got = {r.rec_id: {s.section: s.text for s in r.sections} for r in sections.with_sections(df).collect()}
    assert got == {i: want for i, (_, want) in enumerate(SECTIONED)}


def test_label_list_and_threshold(spark, lexicon):
    df = spark.createDataFrame([(1, "Impression: cavity"), (2, "tb"), (3, "fine"), (4, "haziness")], "rec_id long, report_text string")
    out = rules.with_labels(df, lexicon)
    rows = {r.rec_id: r for r in out.select("rec_id", rules.label_list().alias("a"), rules.label_list(normal_as_empty=False).alias("b"), rules.label_list(0.3).alias("c")).collect()}
    assert rows[1].a == ["Tuberculosis"] and rows[2].a == [] and rows[2].c == ["Tuberculosis"]
    assert rows[3].b == ["Normal"] and rows[4].a == [] and rows[4].c == ["Other Significant Abnormality"]


def test_empty_table(spark, lexicon):
    df = spark.createDataFrame([], "rec_id long, report_text string")
    assert rules.with_labels(df, lexicon).count() == 0


def test_plan_has_no_shuffle_and_no_python(spark, lexicon, capsys):
    df = spark.createDataFrame([(1, "tb")], "rec_id long, report_text string")
    rules.label_results(rules.with_labels(df, lexicon)).explain()
    plan = capsys.readouterr().out
    assert "Exchange" not in plan and "Python" not in plan and "Join" not in plan
