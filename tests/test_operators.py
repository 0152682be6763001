from __future__ import annotations

import math
import random
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from radweave.functions import text as T
from radweave.operators import agreement, deid, imaging, metrics, sampling, spans, synth, validate
from radweave.operators.rules import Lexicon
from radweave.sources import reports, sinks
from radweave.streaming import incremental


def column(spark, values, kind, f):
    return [r[0] for r in spark.createDataFrame([(v,) for v in values], f"x {kind}").select(f(F.col("x"))).collect()]


def test_text_functions(spark):
    values = ["", "  ", " a  b\tc\n", " x y　", None, "ọ̀ é"]
    assert column(spark, values, "string", T.strip) == [v.strip() if v is not None else None for v in values]
    assert column(spark, values, "string", T.word_count) == [len(v.split()) if v is not None else None for v in values]
    assert column(spark, values, "string", T.is_blank) == [v is None or not v.strip() for v in values]


def test_jaccard_and_priority(spark):
    rows = [([], []), (["a"], []), (["a", "b"], ["b", "c"]), (["a", "a"], ["a"])]
    df = spark.createDataFrame(rows, "a array<string>, b array<string>")
    got = [r[0] for r in df.select(agreement.jaccard(df.a, df.b)).collect()]
    assert got == [len(set(a) & set(b)) / len(set(a) | set(b)) if a or b else 1.0 for a, b in rows]
    cases = [(0.2, [], 0, 3), (0.4, ["Tuberculosis"], 0, 2), (0.9, ["Tuberculosis"], 0, 3), (0.9, ["a", "b", "c"], 0, 2), (0.9, [], 121, 1), (0.9, [], 120, 0), (0.5, [], None, 0), (0.3, [], 0, 2)]
    df = spark.createDataFrame(cases, "j double, l array<string>, w int, want int")
    assert all(r[0] == r.want for r in df.select(agreement.priority(df.j, df.l, df.w).alias("p"), "want").collect())


def grid(spark, n=400, seed=2):
    r = random.Random(seed)
    rows = [(f"s{i}", label, int(r.random() < rate), round(r.random(), 2)) for i in range(n) for label, rate in (("a", 0.3), ("b", 0.0), ("c", 1.0), ("d", 0.05))]
    return rows, spark.createDataFrame(rows, "study_id string, label string, y int, prob double")


def test_curve_and_tuning(spark):
    rows, df = grid(spark)
    got = {r.label: r for r in metrics.curve(df).collect()}
    best = {r.label: r.threshold for r in metrics.tune(df).collect()}
    for label in "abcd":
        own = [(y, p) for _, x, y, p in rows if x == label]
        pos, neg = [p for y, p in own if y], [p for y, p in own if not y]
        if pos and neg:
            auc = sum((p > q) + 0.5 * (p == q) for p in pos for q in neg) / (len(pos) * len(neg))
            ap = last = 0.0
            for t in sorted({p for _, p in own}, reverse=True):
                tp, called = sum(p >= t for p in pos), sum(p >= t for _, p in own)
                ap, last = ap + (tp / len(pos) - last) * tp / called, tp / len(pos)
            assert got[label].auroc == pytest.approx(auc) and got[label].pr_auc == pytest.approx(ap)
        else:
            assert got[label].auroc is None and got[label].pr_auc is None
        want, high = 0.5, 0.0
        for t in range(10, 91, 5):
            tp, called = sum(round(p * 100) >= t for p in pos), sum(round(p * 100) >= t for _, p in own)
            f1 = 2 * tp / (called + len(pos)) if called + len(pos) else 0
            if f1 > high:
                want, high = t / 100, f1
        assert best[label] == pytest.approx(want if pos else 0.5)


def test_confusion_losses_and_exact(spark):
    rows, df = grid(spark, 100)
    hat = F.col("prob") >= 0.5
    c = {r.label: r for r in metrics.confusion(df, hat).collect()}
    loss = {r.label: r for r in metrics.losses(df).collect()}
    for label in "abcd":
        own = [(y, p) for _, x, y, p in rows if x == label]
        tp, fp, fn = sum(y and p >= 0.5 for y, p in own), sum(not y and p >= 0.5 for y, p in own), sum(bool(y and p < 0.5) for y, p in own)
        assert (c[label].tp, c[label].fp, c[label].fn, c[label].support) == (tp, fp, fn, tp + fn)
        assert c[label].f1 == pytest.approx(2 * tp / (2 * tp + fp + fn) if tp + fp + fn else 0)
        right = [min(1 - 1e-6, max(1e-6, p)) if y else 1 - min(1 - 1e-6, max(1e-6, p)) for y, p in own]
        assert loss[label].bce == pytest.approx(np.mean([-math.log(q) for q in right]))
        assert loss[label].focal == pytest.approx(np.mean([(1 - q) ** 2 * -math.log(q) for q in right]))
    ok = {}
    for s, _, y, p in rows:
        ok[s] = ok.get(s, True) and (p >= 0.5) == bool(y)
    assert metrics.exact_match(df, hat).first().exact_match == pytest.approx(np.mean(list(ok.values())))
    assert metrics.curve(df.limit(0)).count() == 0 and metrics.tune(df.limit(0)).count() == 0


def test_weighted_losses(spark):
    rows, df = grid(spark, 100)
    weights = spark.createDataFrame([("a", 3.0), ("b", 50.0), ("c", 1.0)], "label string, weight double")
    loss = {r.label: r for r in metrics.losses(df, weights=weights).collect()}
    for label, w in (("a", 3.0), ("b", 50.0), ("c", 1.0), ("d", 1.0)):
        own = [(w if y else 1.0, min(1 - 1e-6, max(1e-6, p)) if y else 1 - min(1 - 1e-6, max(1e-6, p))) for _, x, y, p in rows if x == label]
        assert loss[label].bce == pytest.approx(np.mean([v * -math.log(q) for v, q in own]))
        assert loss[label].focal == pytest.approx(np.mean([v * (1 - q) ** 2 * -math.log(q) for v, q in own]))


def test_class_weights(spark):
    df = spark.createDataFrame([(1, "Cardiomegaly, Atelectasis"), (2, None), (3, "nan"), (4, " Normal ")], "rec_id long, gold_labels string")
    hot = metrics.multi_hot(df, "rec_id")
    assert {(r.rec_id, r.label) for r in hot.filter("y = 1").collect()} == {(1, "Cardiomegaly"), (1, "Atelectasis"), (2, "Normal"), (3, "Normal"), (4, "Normal")}
    w = {r.label: r.weight for r in metrics.class_weights(hot).collect()}
    assert w["Cardiomegaly"] == 3.0 and w["Tuberculosis"] == 1.0 and w["Normal"] == 1.0


def test_deidentification(spark, monkeypatch):
    values = ["seen 20240101 and 2024-01-01, 12/05/2024; no 123456 or 12345", "a\nb\nDr X\nConsultant Radiologist", "Radiologist line\n1\n2\n3", None, "", "x\r\nDr. A / B\r\n"]
    want = ["seen [REDACTED_DATE] and [REDACTED_DATE], 12/05/2024; no [REDACTED_ID] or 12345", "a\nb", "Radiologist line\n1\n2\n3", None, "", "x"]
    assert column(spark, values, "string", deid.clean_report) == want
    assert column(spark, ["20240131", "", " ", None, "2024", "20241399"], "string", lambda c: deid.shift_date(c, F.lit(1))) == ["20240201", "", "", "", "2024", "20241399"]
    ids = column(spark, ["a", "a", "", None], "string", lambda c: deid.hash_id(c, "k"))
    assert ids[0] == ids[1] and len(ids[0]) == 16 and ids[2:] == ["ANON", "ANON"]
    assert all(-365 <= d <= 365 for d in column(spark, [f"s{i}" for i in range(500)], "string", lambda c: deid.study_offset(c, "k")))
    monkeypatch.delenv("ANON_SECRET_KEY", raising=False)
    with pytest.raises(RuntimeError):
        deid.secret()


def test_defaults(spark):
    r = deid.with_defaults(spark.createDataFrame([(1, None), (2, 12)], "id int, bits int"), bits=16, rows=0).orderBy("id").collect()
    assert [(x.bits, x.rows) for x in r] == [(16, 0), (12, 0)]


def test_validation_of_bare_study(spark):
    files = spark.createDataFrame([], "study_id string, file string, modality string, body_part string, study_desc string, series_desc string, protocol string, view_position string, patient_id string, instance_no int, has_pixels boolean, parse_error string, content string")
    studies = spark.createDataFrame([("a", True)], "study_id string, has_report boolean")
    r = validate.validate_studies(validate.validate_files(files), studies).first()
    assert r.reasons == [validate.REASONS[0]] and not r.is_valid


def test_imaging(spark):
    rng = np.random.default_rng(1)
    wide, tall = rng.random((8, 16)), rng.random((16, 8))
    out = imaging.resize_with_padding(np.ones((8, 16)), (32, 32))
    assert out.shape == (32, 32) and out[:8].sum() == 0 and out[24:].sum() == 0 and (out[8:24] == 1).all()
    assert imaging.resize_with_padding(tall, (32, 32))[:, :8].sum() == 0
    assert np.allclose(imaging.resize_with_padding(wide, (8, 16)), wide)
    with pytest.raises(ValueError):
        imaging.resize_with_padding(np.ones(4))
    pixels = [float(x) for x in rng.normal(size=64)]
    df = spark.createDataFrame([(1, pixels), (2, None), (3, [1.0])], "id long, p array<double>")
    lo, hi = np.percentile(pixels, [1, 99])
    want = (np.clip(pixels, lo, hi) - lo) / (hi - lo + 1e-6)
    got = {r.id: r.v for r in imaging.clip_and_normalise(df, "p", "v").collect()}
    assert np.allclose(got[1], want) and got[2] is None
    done = {r.id: r for r in imaging.preprocess(df, "id", "p", 8, 8, (8, 8)).collect()}
    assert np.allclose(done[1].image, want, atol=1e-6) and done[2].status == done[3].status == "skipped"
    assert imaging.to_uint16(np.array([0, 0.5, 1, 2])).tolist() == [0, 32767, 65535, 65535]


def test_overlaps_and_spans(spark):
    rows = [(label, i, k, p) for label, i, ps in (("A", 1, ["heart", "big heart", "big_heart"]), ("B", 2, ["heart failure", "x"])) for k, p in enumerate(ps)]
    lex = Lexicon(spark.createDataFrame(rows, "label string, label_idx int, phrase_idx int, phrase string"))
    df = spark.createDataFrame([(1, "Big  heart, big heart failure; xheart xx x1"), (2, None), (3, "x")], "rec_id long, report_text string")
    got = {r.rec_id: {tuple(s) for s in r.spans} for r in spans.with_spans(df, lex).collect()}
    assert got[1] == {(5, 10, "A"), (12, 21, "A"), (16, 21, "A"), (16, 29, "B")} and got[2] == set() and got[3] == {(0, 1, "B")}
    kept = {r.rec_id: [tuple(s) for s in r.k] for r in spans.with_spans(df, lex).select("rec_id", spans.without_overlaps(F.col("spans")).alias("k")).collect()}
    assert kept[1] == [(5, 10, "A"), (16, 29, "B")]
    r = random.Random(4)
    many = [sorted({(a := r.randint(0, 60), a + r.randint(1, 9), r.choice("AB")) for _ in range(r.randint(0, 12))}) for _ in range(60)]
    t = spark.createDataFrame([(i, [{"start": a, "end": b, "label": c} for a, b, c in m]) for i, m in enumerate(many)], "i int, s array<struct<start:int,end:int,label:string>>")
    for row in t.select("i", spans.without_overlaps(F.col("s")).alias("k")).collect():
        want = []
        for s in sorted(many[row.i], key=lambda s: (s[0] - s[1], s[0], s[1], s[2])):
            if all(s[1] <= k[0] or k[1] <= s[0] for k in want):
                want.append(s)
        assert [tuple(k) for k in row.k] == sorted(want)


def test_weak_labels(spark):
    lex = Lexicon(spark.createDataFrame([("A", 1, 0, "heart"), ("B", 2, 0, "lung")], "label string, label_idx int, phrase_idx int, phrase string"))
    df = spark.createDataFrame([(1, "heart lung", "A"), (2, "heart", "Normal"), (3, " ", "A"), (4, "none", "A"), (5, "lung", "A, B"), (6, "x", None)], "rec_id long, report_text string, gold_labels string")
    got = {r.rec_id: [tuple(s) for s in r.kept] for r in spans.weak_labels(df, lex, ["A", "B"]).collect()}
    assert got == {1: [(0, 5, "A")], 5: [(0, 4, "B")]}
    assert {r.rec_id for r in spans.weak_labels(df, lex, ["A", "B"], need_span=False).collect()} == {1, 4, 5}


def test_samples(spark):
    df = spark.range(1000).select("id", F.when(F.col("id") < 700, "a").when(F.col("id") < 990, "b").otherwise("c").alias("s"))
    one = sampling.fixed_sample(df, "id", 50).collect()
    assert sorted(r.sample_no for r in one) == list(range(1, 51)) and {r.id for r in one} == {r.id for r in sampling.fixed_sample(df.repartition(7), "id", 50).collect()}
    n = {r.s: r["count"] for r in sampling.stratified_sample(df, "id", "s", 100).groupBy("s").count().collect()}
    assert n == {"a": 70, "b": 29, "c": 1}
    placed = sampling.positions(df.repartition(5), "id").collect()
    assert all(r.position == r.id + 1 for r in placed) and len(placed) == 1000
    assert sampling.positions(df.limit(0), "id").count() == 0
    assert (sampling.pick_size(300), sampling.pick_size(900), sampling.pick_size(900, 497)) == (300, 500, 497)
    assert (sampling.sample_size(population=5637), sampling.sample_size()) == (897, 1067)
    kept, audit = sampling.exclude(df, spark.createDataFrame([(3,), (3,), (5000,)], "id long"), "id")
    assert kept.count() == 999 and {(r.id, r.outcome) for r in audit.collect()} == {(3, "excluded"), (5000, "unknown")}


def test_synthetic(spark):
    real = spark.createDataFrame([("Pulmonary Edema", 7), ("Suspected Malignancy", 12), ("Cardiomegaly", 0)], "label string, n long")
    rows = synth.positives(real, 10).collect()
    assert len(rows) == 3 and {r.gold_labels for r in rows} == {"Pulmonary Edema"} and len({r.study_id for r in rows}) == 3
    assert all("{" not in r.report_text for r in rows)
    neg = synth.hard_negatives(spark, ("A", "B"), 15).collect()
    assert len(neg) == 30 and sum(r.neg_target == "A" for r in neg) == 15 and all("{" not in r.report_text for r in neg)
    assert synth.merge(synth.positives(real, 10), synth.hard_negatives(spark, ("A",), 2)).filter("neg_target = ''").count() == 3


def test_varied_negatives(spark):
    from radweave.operators import templates as T

    rows = synth.varied_negatives(spark).orderBy("study_id").collect()
    assert len(rows) == 180 and len({r.study_id for r in rows}) == 180 and rows[0].study_id == "hardneg_90001"
    assert len({r.neg_target for r in rows}) == 12 and "Other Significant Abnormality" not in {r.neg_target for r in rows}
    for k, r in enumerate(rows):
        own = [(g, t) for x, g, t in T.HARD_NEGATIVES if x == r.neg_target]
        gold, text = own[k % 15 % len(own)]
        assert r.gold_labels == gold and abs(len(r.report_text) - len(text)) < 90
        assert r.report_text.split("\n")[0].removeprefix("AP ") in T.NEGATIVE_HEADERS  # the surveyed swap leaves an AP in front
    assert len({r.report_text for r in rows}) > 120 and any(r.gold_labels != "Normal" for r in rows)
    assert 30 < sum("\n\n" in r.report_text for r in rows) < 80


def test_cooccurrence_of_many_labels(spark):
    df = spark.createDataFrame([(",".join(f"L{i:04d}" for i in range(1_003)),)], "labels string")
    pairs = agreement.cooccurrence(df, "labels")
    assert pairs.count() == 1_003 * 1_002 // 2
    assert pairs.filter("label_a = 'L0000' and label_b in ('L1001', 'L1002')").count() == 2


def test_rare_positives_do_the_whole_job(spark):
    from radweave.operators import templates as T

    real = spark.createDataFrame([("Pulmonary Edema", 7), ("Suspected Malignancy", 55), ("Cardiomegaly", 3)], "label string, n long")
    rows = synth.rare_positives(real, 50).collect()
    count = {x: sum(r.primary_augmented_label == x for r in rows) for x in T.POSITIVES}
    assert count == {"Post-Surgical Changes": 50, "Lung Mass / Nodule": 50, "Pulmonary Edema": 43, "Suspected Malignancy": 0, "Tuberculosis": 50, "Atelectasis": 50}
    assert len({r.study_id for r in rows}) == len(rows) == 243
    extra = normals = 0
    sizes = set()
    for r in rows:
        lines, labels = r.report_text.split("\n"), r.gold_labels.split(",")
        assert "{" not in r.report_text and lines[0] in T.HEADERS and any(x in T.IMPRESSION_HEADERS for x in lines)
        assert r.primary_augmented_label in labels and labels == sorted(set(labels)) and set(labels) <= {r.primary_augmented_label, *T.CO_LABELS[r.primary_augmented_label]}
        normals = sum(x in T.BOILERPLATE for x in lines)
        at = next(i for i, x in enumerate(lines) if i and x in T.IMPRESSION_HEADERS)
        own = at - 1 - normals - (lines[1] in T.FINDINGS_HEADERS) - (len(labels) - 1)
        assert 2 <= normals <= 4 and 1 <= own <= 3
        sizes.add((normals, own))
        extra += len(labels) - 1
    assert len(sizes) == 9 and 0.25 < extra / (3 * len(rows)) < 0.45
    again = synth.rare_positives(real.repartition(3), 50).collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, rows))


def test_sources_and_sinks(spark, tmp_path):
    folder = tmp_path / "reports"
    folder.mkdir()
    for name, text in (("b.txt", " two\nlines \n"), ("a.txt", "één"), ("empty.txt", " \n"), ("skip.md", "no")):
        (folder / name).write_text(text, encoding="utf-8")
    (folder / "bad c+.txt").write_bytes(b"caf\xe9")
    got = {r.study_id: r.report_text for r in reports.scan_reports(spark, str(folder)).collect()}
    assert got == {"a": "één", "b": "two\nlines", "bad c+": "caf�"}
    assert reports.scan_reports(spark, str(folder), keep_empty=True).count() == 4
    (tmp_path / "none").mkdir()
    with pytest.raises(FileNotFoundError):
        reports.scan_reports(spark, str(tmp_path / "none"))
    rows = [(1, 'a "q", b\nnext', None), (2, "", "x;y")]
    df = spark.createDataFrame(rows, "id long, t string, u string")
    sinks.write_csv(df, str(tmp_path / "csv"))
    back = {r.id: r for r in reports.read_csv(spark, str(tmp_path / "csv"), "id long, t string, u string").collect()}
    assert back[1].t == rows[0][1] and back[2].u == "x;y"
    (tmp_path / "lex.json").write_text('{"A": ["x", "x"], "Normal": ["n"]}')
    lex = reports.load_lexicon(spark, [str(tmp_path / "nope.json"), str(tmp_path / "lex.json")])
    assert [tuple(r) for r in lex.orderBy("label_idx", "phrase_idx").collect()] == [("Normal", 0, 0, "n"), ("A", 1, 0, "x"), ("A", 1, 1, "x")]
    with pytest.raises(FileNotFoundError):
        reports.first_existing([str(tmp_path / "nope.json")])
    (tmp_path / "h.yaml").write_text("tier1:\n  - normal\npathology_to_category:\n  'A / B': one\n  C: two\nother: 1\n")
    assert [tuple(r) for r in reports.load_hierarchy(spark, str(tmp_path / "h.yaml")).collect()] == [("A / B", 0, "one"), ("C", 1, "two")]
    study = tmp_path / "root" / "s1"
    study.mkdir(parents=True)
    (study / "x.png").write_bytes(b"123")
    assert [(r.study_id, r.file, r.length) for r in reports.study_files(spark, str(tmp_path / "root"), "*.png").collect()] == [("s1", "x.png", 3)]
    sinks.write_images(spark.createDataFrame([("s", [0.0, 0.5, 2.0])], "study_id string, image array<double>"), str(tmp_path / "img"))
    assert spark.read.parquet(str(tmp_path / "img")).first().image == [0, 32767, 65535]
    with pytest.raises(FileNotFoundError):
        reports.fold_numbers(spark.createDataFrame([], "fold int"))


def test_stream_counts_files_once(spark, tmp_path):
    source = tmp_path / "in"
    spark.range(5).write.parquet(str(source))
    run = lambda: incremental.run_available(spark, str(source), "id long", lambda d: d.withColumn("x", F.col("id") * 2), str(tmp_path / "out"), str(tmp_path / "ck"), 1)
    assert run().count() == 5 and run().count() == 5
    spark.range(5, 8).write.mode("append").parquet(str(source))
    assert sorted(r.x for r in run().collect()) == [2 * i for i in range(8)]
    left = incremental.resume(spark.range(10).toDF("id"), spark.range(8).toDF("id"), "id")
    assert sorted(r.id for r in left.collect()) == [8, 9]


def test_spreadsheets_and_settings(spark, tmp_path):
    import zipfile

    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    sheet = f'<worksheet {ns}><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c><c r="C1" t="inlineStr"><is><t>n</t></is></c></row><row r="2"><c r="A2" t="s"><v>1</v></c><c r="C2"><v>7</v></c></row><row r="3"><c r="C3"><v>8</v></c></row></sheetData></worksheet>'
    with zipfile.ZipFile(tmp_path / "book.xlsx", "w") as z:
        z.writestr("xl/sharedStrings.xml", f"<sst {ns}><si><t>study_id</t></si><si><r><t>s </t></r><r><t>one</t></r></si></sst>")
        z.writestr("xl/worksheets/sheet1.xml", sheet)
    got = reports.read_xlsx(spark, str(tmp_path / "book.xlsx"), "study_id string, n int, other string").collect()
    assert [tuple(r) for r in got] == [("s one", 7, None), (None, 8, None)]
    (tmp_path / "s.yaml").write_text('data:\n  input: /a/b  # note\nnlp:\n  model: "M"\nkinds: ["x", "y"]\n')
    assert reports.load_settings(str(tmp_path / "s.yaml")) == {"data.input": "/a/b", "nlp.model": "M", "kinds": ["x", "y"]}


def test_stratified_folds(spark):
    rows = [(i, "A" if i % 3 else "B, A") for i in range(300)] + [(1000, None)]
    df = spark.createDataFrame(rows, "id long, gold_labels string")
    got = {r.id: r.fold for r in metrics.stratified_folds(df, "id").collect()}
    for want in ({i for i, g in rows if g == "A"}, {i for i, g in rows if g == "B, A"}):
        sizes = [sum(got[i] == f for i in want) for f in range(5)]
        assert max(sizes) - min(sizes) <= 1
    assert got == {r.id: r.fold for r in metrics.stratified_folds(df.repartition(9), "id").collect()} and len(got) == 301
    assert metrics.stratified_folds(df.limit(0), "id").count() == 0


def test_short_sample_is_an_error(spark):
    with pytest.raises(ValueError, match="fewer than 322"):
        sampling.fixed_sample(spark.range(5), "id", 322)


def test_entity_rules(spark):
    from radweave.operators import spans

    df = spark.createDataFrame([(1, "Left mass, a mass lesion; Mass masses"), (2, None)], "id long, report_text string").withColumn("spans", F.lit(1))
    out = {r.id: [tuple(e) for e in r.entities] for r in spans.ruled_spans(df, {"M": ["mass", "mass lesion"], "S": [";"]}).collect()}
    assert out == {1: [(5, 9, "M"), (13, 24, "M"), (24, 25, "S")], 2: []}


def test_preprocess_skips(spark):
    df = spark.createDataFrame([(1, [0.0] * 4, True), (2, [0.0] * 4, False), (3, [0.0] * 4, True), (4, None, True)], "id long, p array<double>, chest boolean")
    got = {r.id: (r.status, r.image is None) for r in imaging.preprocess(df, "id", "p", 2, 2, (2, 2), F.col("chest"), spark.createDataFrame([(3,)], "id long")).collect()}
    assert got == {1: ("ok", False), 2: ("not chest", True), 3: ("exists", True), 4: ("skipped", True)}


def test_intermediate_tables_go_with_their_block(spark, tmp_path):
    from radweave import scratch

    with scratch.cleared(spark):
        kept = scratch.settle(spark.range(3), "some")
        path = kept.inputFiles()[0].removeprefix("file://")
        assert Path(path).exists() and kept.count() == 3
    assert not Path(path).exists()


def test_scan_of_files_of_zero_bytes(spark, tmp_path):
    for folder in ("r1", "r2"):
        (tmp_path / folder).mkdir()
    names = ("a", "b c+", "50% d", "e%20f", "g, ñ", "[h]")
    for n in names:
        (tmp_path / "r1" / f"{n}.txt").write_text(" text ")
        (tmp_path / "r1" / f"{n}0.txt").touch()
    (tmp_path / "r1" / "skip.md").touch()
    scan = lambda folder, keep: sorted(tuple(r) for r in reports.scan_reports(spark, str(tmp_path / folder), keep).collect())
    assert scan("r1", False) == sorted((n, "text") for n in names)
    assert scan("r1", True) == sorted([(n, "text") for n in names] + [(f"{n}0", "") for n in names])
    (tmp_path / "r2" / "a.txt").touch()
    assert scan("r2", False) == [] and scan("r2", True) == [("a", "")]
    assert scan("r?", True) == sorted([*scan("r1", True), ("a", "")])
