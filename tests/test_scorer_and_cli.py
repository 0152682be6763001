from __future__ import annotations

import json

import pytest

from radweave import cli
from radweave.operators import scorer, scores


class Length:
    """Probability from the text's length and the fold."""

    def __init__(self, fold):
        self.fold = fold

    def predict(self, texts):
        assert len(texts) <= 2
        return [{"Cardiomegaly": len(t) / 100 + self.fold / 10, "Normal": 0.5} for t in texts]


def test_scorer(spark):
    df = spark.createDataFrame([("a", "x" * 10), ("b", None), ("c", " "), ("d", "x" * 30), ("e", "y")], "study_id string, report_text string")
    table = scorer.score_texts(df, Length, [0, 2], batch_size=2)
    assert {(r.study_id, r.fold): r.prob for r in table.filter("label = 'Cardiomegaly'").collect()} == {("a", 0): 0.1, ("a", 2): 0.3, ("d", 0): 0.3, ("d", 2): 0.5, ("e", 0): 0.01, ("e", 2): 0.21}
    mean = {r.study_id: r for r in scores.fold_average(table).collect()}
    assert mean["a"].n_folds == 2 and mean["a"].probs["Cardiomegaly"] == pytest.approx(0.2) and mean["a"].normal_prob == 0.5
    with pytest.raises(FileNotFoundError):
        scorer.score_texts(df, Length, [])


def test_command_line_resumes(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    (source / "a.txt").write_text("Impression: cavity")
    (tmp_path / "lex.json").write_text(json.dumps({"Normal": ["clear"], "Tuberculosis": ["cavity"]}))
    args = ["--reports-dir", str(source), "--lexicon", str(tmp_path / "lex.json"), "--out", str(tmp_path / "out")]
    assert cli.main(args) == 1 and cli.main(args) == 0
    (source / "b.txt").write_text("clear")
    assert cli.main(args) == 1
    got = {r.study_id: r.labels for r in spark.read.parquet(str(tmp_path / "out" / "labels")).collect()}
    assert got == {"a": ["Tuberculosis"], "b": []}
    assert cli.main([*args, "--fresh"]) == 2


def test_command_line_ensemble_in_batches(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    for k in range(7):
        (source / f"s{k}.txt").write_text("Impression: cavity" if k % 2 else "all fine")
    (tmp_path / "lex.json").write_text(json.dumps({"Normal": ["clear"], "Tuberculosis": ["cavity"]}))
    rows = [(f"s{k}", 0, "Cardiomegaly", 0.9) for k in range(7)] + [("ANON", 0, "Tuberculosis", 0.9)]
    spark.createDataFrame(rows, "study_id string, fold int, label string, prob double").write.parquet(str(tmp_path / "scores"))
    out = f"file://{tmp_path}/out"
    args = ["--reports-dir", str(source), "--lexicon", str(tmp_path / "lex.json"), "--out", out, "--scores", str(tmp_path / "scores"), "--checkpoint-every", "3"]
    assert cli.main(args) == 7
    log = spark.read.parquet(f"{out}/disagreements")
    before = sorted(map(tuple, log.collect()))
    assert len(before) == 7 + 3 and cli.main(args) == 0
    assert sorted(map(tuple, spark.read.parquet(f"{out}/disagreements").collect())) == before
    (source / "late.txt").write_text("cavity")
    assert cli.main(args) == 1 and spark.read.parquet(f"{out}/predictions").count() == 8
    shown = {r.label: r.ensemble_count for r in spark.read.json(f"{out}/distribution").collect()}
    assert shown["Cardiomegaly"] == 7 and shown["Tuberculosis"] == 3
    assert cli.main([*args, "--fresh"]) == 8


def test_command_line_template_reports(spark, tmp_path, capsys):
    spark.createDataFrame([("Tuberculosis, Atelectasis",), (None,)], "gold_labels string").write.parquet(str(tmp_path / "gold"))
    assert cli.main(["synthetic", "--data", str(tmp_path / "gold"), "--out", str(tmp_path / "syn"), "--target", "3", "--review", "1"]) == 6 * 3 - 2
    assert "CHEST RADIOGRAPH" in capsys.readouterr().out
    assert cli.main(["negatives", "--out", str(tmp_path / "neg"), "--per-label", "2"]) == 24


class Words:
    def find(self, texts):
        return [[(t.index("cavity"), t.index("cavity") + 6, "Tuberculosis")] if "cavity" in t else [] for t in texts]


def test_entity_hook(spark):
    df = spark.createDataFrame([("a", "a cavity"), ("b", None), ("c", "none")], "study_id string, report_text string")
    assert [tuple(r) for r in scorer.entity_texts(df, Words).collect()] == [("a", 2, 8, "Tuberculosis")]


def test_exports():
    import radweave

    assert all(getattr(radweave, name) is not None for name in radweave.__all__)
