"""Queries of the rule extractor and the ensemble, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from radweave.functions import constants as C
from radweave.functions.text import is_blank
from radweave.operators import ensemble, hierarchy, rules, scores, sections
from radweave.tables import spread, table


def reports(spark: SparkSession, folder: str, name: str = "ensemble_predictions") -> DataFrame:
    """(rec_id, study_id, report_text) of one table of reports."""
    return spread(table(spark, folder, name).select("rec_id", "study_id", "report_text"))


def lexicon(spark: SparkSession, folder: str) -> rules.Lexicon:
    return rules.Lexicon(table(spark, folder, "lexicon"))


def labelled(spark: SparkSession, folder: str, name: str = "ensemble_predictions") -> DataFrame:
    return rules.with_labels(reports(spark, folder, name), lexicon(spark, folder))


def rule_sections(spark: SparkSession, folder: str) -> DataFrame:
    """Sections of every report."""
    df = sections.with_sections(reports(spark, folder))
    return df.select("rec_id", F.explode("sections").alias("s")).select("rec_id", "s.section_idx", "s.section", F.col("s.text").alias("section_text"))


def rule_header(spark: SparkSession, folder: str) -> DataFrame:
    """Reports without their heading line."""
    return reports(spark, folder).select("rec_id", sections.strip_header(F.coalesce("report_text", F.lit(""))).alias("plain_text"))


def rule_hits(spark: SparkSession, folder: str) -> DataFrame:
    """Phrase occurrences with offsets, flags and boosted scores."""
    df = rules.with_hits(reports(spark, folder), lexicon(spark, folder))
    rows = df.select("rec_id", F.explode("hits").alias("h")).select("rec_id", "h.*")
    return rows.select("rec_id", "label", "phrase_idx", "phrase", "section", F.col("start").alias("start_at"), F.col("end").alias("end_at"), F.round("score", 6).alias("score"), "uncertain")


def rule_results(spark: SparkSession, folder: str) -> DataFrame:
    """Scored labels of every report."""
    rows = rules.label_results(labelled(spark, folder))
    return rows.select("rec_id", "label", F.round("score", 6).alias("score"), "uncertain", "fallback", F.round("ctr_value", 6).alias("ctr_value"), F.size("evidence").alias("n_evidence"))


def rule_evidence(spark: SparkSession, folder: str) -> DataFrame:
    """Kept evidence of every label in order."""
    rows = rules.label_results(labelled(spark, folder)).select("rec_id", "label", F.posexplode("evidence").alias("ev_no", "e"))
    return rows.select("rec_id", "label", "ev_no", "e.phrase", "e.section", F.col("e.start").alias("start_at"), F.col("e.end").alias("end_at"))


def rule_meta(spark: SparkSession, folder: str) -> DataFrame:
    """Flags and sections found."""
    return labelled(spark, folder).select("rec_id", "has_normal_phrase", "has_abnormal_cue", F.array_join("sections_found", ",").alias("sections_found"))


def rule_labels(spark: SparkSession, folder: str) -> DataFrame:
    """Label list per report, "Normal" for none."""
    return labelled(spark, folder).select("rec_id", F.array_join(F.array_sort(rules.label_list(normal_as_empty=False)), ",").alias("labels"))


def rule_hierarchy(spark: SparkSession, folder: str) -> DataFrame:
    """Three tiers per report."""
    df = labelled(spark, folder).select("rec_id", rules.label_list().alias("labels"))
    df = hierarchy.with_hierarchy(df, "labels", table(spark, folder, "label_hierarchy"))
    return df.select("rec_id", "tier1", F.array_join("tier2", ",").alias("tier2"), F.array_join(F.array_sort("tier3"), ",").alias("tier3"))


def ratio_values(spark: SparkSession, folder: str) -> DataFrame:
    """First cardiothoracic ratio above one half, with its score and place."""
    df = reports(spark, folder).filter("report_text is not null").select("rec_id", rules.ratio_hit(F.lower("report_text")).alias("r")).filter("r is not null")
    return df.select("rec_id", F.round("r.value", 6).alias("ctr_value"), F.round(F.least(F.lit(0.85), 0.60 + (F.col("r.value") - 0.50) * 2.0), 6).alias("score"), F.col("r.start").alias("start_at"), F.col("r.end").alias("end_at"))


def tier_lookup(spark: SparkSession, folder: str) -> DataFrame:
    """Tier-2 group of every logged disagreement's label."""
    mapping = hierarchy.tier2_map(table(spark, folder, "label_hierarchy"))
    return table(spark, folder, "disagreement_log").select("rec_id", "label", hierarchy.strict_tier2(F.col("label"), mapping).alias("tier2"))


def score_average(spark: SparkSession, folder: str) -> DataFrame:
    """Fold mean per study and label."""
    df = scores.fold_average(table(spark, folder, "scores")).select("study_id", "n_folds", F.round("normal_prob", 6).alias("normal_prob"), F.explode("probs").alias("label", "p"))
    return df.select("study_id", "n_folds", "normal_prob", "label", F.round("p", 6).alias("prob"))


def score_predictions(spark: SparkSession, folder: str) -> DataFrame:
    """Predicted and uncertain flags per study, fold and label."""
    return scores.predictions(table(spark, folder, "scores"))


def score_labels(spark: SparkSession, folder: str) -> DataFrame:
    """Predicted label lists and the Normal probability per study and fold."""
    s = table(spark, folder, "scores")
    a = scores.predicted_labels(s).select("study_id", "fold", F.array_join("labels", ",").alias("labels"))
    return a.join(scores.normal_probability(s), ["study_id", "fold"], "full")


def fold_models(spark: SparkSession, folder: str) -> DataFrame:
    """Folds found and whether each scores Normal."""
    return scores.has_normal(table(spark, folder, "scores"))


def vector_scores(spark: SparkSession, folder: str) -> DataFrame:
    """Linear classifier head over the embedding vectors."""
    weights = [((i * 7) % 11 - 5) / 10.0 for i in range(64)]
    return table(spark, folder, "embeddings").select("vec_id", F.round(scores.linear_sigmoid(F.col("embedding"), weights, 0.1), 6).alias("prob"))


def cells(spark: SparkSession, folder: str) -> DataFrame:
    """Report-label decisions of the annotated reports."""
    base = labelled(spark, folder, "annotated_reports").withColumn("blank", is_blank(F.col("report_text")))
    base = base.select("rec_id", "study_id", "results", "has_normal_phrase", "blank", F.coalesce(F.length("report_text"), F.lit(0)).alias("report_length"))
    return ensemble.decisions(base, scores.fold_average(table(spark, folder, "scores")), carry=("report_length",))


def ensemble_decisions(spark: SparkSession, folder: str) -> DataFrame:
    """All decisions, agreeing ones included."""
    return cells(spark, folder).select("rec_id", "label", "policy", "rb_detected", "bert_detected", F.round("bert_prob", 6).alias("bert_prob"), F.round("rb_score", 6).alias("rb_score"), "included", "confidence")


def ensemble_disagreements(spark: SparkSession, folder: str) -> DataFrame:
    return ensemble.disagreements(cells(spark, folder))


def ensemble_summary(spark: SparkSession, folder: str) -> DataFrame:
    return ensemble.summary(cells(spark, folder))


def ensemble_wide(spark: SparkSession, folder: str) -> DataFrame:
    """Wide record of 66 columns."""
    return ensemble.wide_record(cells(spark, folder))


def prediction_record(spark: SparkSession, folder: str) -> DataFrame:
    """Full prediction record: summary, text length and the per-label columns."""
    return ensemble.full_record(cells(spark, folder), "report_length")


def union_vote(spark: SparkSession, folder: str) -> DataFrame:
    """Set-union vote of the logged rule and model labels."""
    split = lambda c: F.filter(F.split(F.coalesce(c, F.lit("")), ","), lambda x: (F.trim(x) != "") & (F.trim(x) != "Normal"))
    e = table(spark, folder, "ensemble_predictions")
    return e.select("rec_id", F.array_join(ensemble.union_vote(split(F.col("rb_labels_str")), split(F.col("bert_labels_str"))), ",").alias("labels"))


# --- SQL -------------------------------------------------------------------------------------------------

_B = C.BLANKS
_WORD = r"[\p{L}\p{N}_]"


def _strip(x: str) -> str:
    return f"regexp_replace({x}, '^[{_B}]+|[{_B}]+$', '', 'g')"


def _words(options: tuple[str, ...]) -> str:
    return "(?:^|[^\\p{L}\\p{N}_])(?:" + "|".join(options) + ")(?:$|[^\\p{L}\\p{N}_])"


def _list(values: tuple[str, ...]) -> str:
    return ", ".join("'" + v + "'" for v in values)


_LAST = rf"(?is)^(.*?)((?:^|\n)[{_B}]*(impression|conclusion|summary)[{_B}]*:?[{_B}]*\n?)(.*)$"
_FIRST = rf"(?is)^((?:.*?\n)??)((findings|comments)[{_B}]*:?[{_B}]*\n?)(.*)$"
_CUE = r"(?s)^(|.*?[^\p{L}\p{N}_])(" + "|".join(C.CUES) + r")(?:$|[^\p{L}\p{N}_])"
_WEIGHT = "CASE section " + " ".join(f"WHEN '{k}' THEN {v}::DOUBLE" for k, v in C.SECTION_WEIGHT.items()) + " END"


def _sections(source: str) -> str:
    pick = lambda p, n: f"regexp_extract(txt, '{p}', {n})"
    rows = " UNION ALL ".join(
        f"SELECT rec_id, {i} AS section_idx, '{n}' AS section, "
        + ("CASE WHEN use_first THEN '' WHEN has_last THEN " + _strip("bef") + " ELSE txt END" if n == "body" else f"CASE WHEN use_first AND fw='{n}' THEN {_strip('inside')} ELSE '' END" if n in ("findings", "comments") else f"CASE WHEN lw='{n}' THEN {_strip('tail')} ELSE '' END")
        + " AS section_text FROM s2 WHERE NOT blank"
        for i, n in enumerate(C.SECTIONS)
    )
    return rf"""
rep AS (SELECT rec_id, study_id, report_text AS raw, (report_text IS NULL OR {_strip('report_text')} = '') AS blank, lower(coalesce(report_text, '')) AS low_all FROM {source}),
s0 AS (SELECT rec_id, raw, blank, {_strip("regexp_replace(coalesce(raw, ''), '" + C.HEADER + "', '')")} AS txt FROM rep),
s1 AS (SELECT *, regexp_matches(txt, '{_LAST}') AS has_last, regexp_matches(txt, '{_FIRST}') AS has_first, {pick(_LAST, 1)} AS bef, lower({pick(_LAST, 3)}) AS lw, {pick(_LAST, 4)} AS tail,
  length({pick(_FIRST, 1)}) AS lead, length({pick(_FIRST, 1)}) + length({pick(_FIRST, 2)}) AS fat, lower({pick(_FIRST, 3)}) AS fw FROM s0),
s2 AS (SELECT *, has_first AND (NOT has_last OR lead < length(bef)) AS use_first, CASE WHEN has_last THEN substr(txt, fat + 1, greatest(0, length(bef) - fat)) ELSE substr(txt, fat + 1) END AS inside FROM s1),
s3 AS ({rows}),
s4 AS (SELECT * FROM s3 WHERE section_text <> ''),
secs AS (SELECT * FROM s4 UNION ALL SELECT rec_id, 5, 'body', {_strip('raw')} FROM s0 WHERE NOT blank AND rec_id NOT IN (SELECT rec_id FROM s4))"""


def _hits(source: str) -> str:
    edge = lambda c, first: f"(regexp_matches({c}, '^{_WORD}$') <> regexp_matches({first}, '^{_WORD}$'))"
    return rf"""{_sections(source)},
secx AS (SELECT *, lower(section_text) AS low, regexp_matches(section_text, '(?i){_words(C.CONFIRMING)}') AS confirmed FROM secs),
vasc AS (SELECT rec_id, bool_or(regexp_matches(low, '{"|".join(C.VASCULAR)}')) AS vascular FROM secx GROUP BY rec_id),
lex AS (SELECT label, label_idx, phrase_idx, phrase, replace(lower(trim(phrase)), '_', ' ') AS m,
  (label = 'Pneumonia / Consolidation' AND lower(trim(phrase)) IN ({_list(C.AMBIGUOUS)})) AS ambiguous FROM lexicon
  WHERE label <> 'Normal' AND trim(phrase) <> '' AND NOT (label = 'Cardiomegaly' AND lower(trim(phrase)) IN ({_list(C.RATIO_PHRASES)}))),
cand AS (SELECT x.rec_id, x.section_idx, x.section, x.low, l.*, string_split(x.low, l.m) AS parts FROM secx x JOIN lex l ON contains(x.low, l.m) JOIN vasc v ON v.rec_id = x.rec_id
  WHERE (NOT l.ambiguous OR x.confirmed) AND (l.label <> 'Pulmonary Edema' OR v.vascular)),
occ0 AS (SELECT *, unnest(range(1, len(parts))) AS k FROM cand),
occ AS (SELECT * EXCLUDE (parts), (list_sum(list_transform(parts[1:k], lambda p: length(p))) + (k - 1) * length(m))::INTEGER AS st, length(m) AS ml FROM occ0),
occ2 AS (SELECT * FROM occ WHERE {edge("CASE WHEN st = 0 THEN '' ELSE substr(low, st, 1) END", "substr(m, 1, 1)")} AND {edge("substr(low, st + ml + 1, 1)", "substr(m, ml, 1)")}),
ctx AS (SELECT *, regexp_replace(substr(low, greatest(0, st - 60) + 1, least(st, 60)), '(?s)^.*(?:\. |\.\n|\n\n)', '') AS lft, substr(low, greatest(0, st - 40) + 1, st + ml + 40 - greatest(0, st - 40)) AS around FROM occ2),
sc0 AS (SELECT *, regexp_matches(around, '{_words(C.UNCERTAIN)}|\?') AS uncertain FROM ctx WHERE NOT regexp_matches(lft, '{_words(C.NEGATIONS)}')),
sc AS (SELECT *, greatest(0.0::DOUBLE, least(0.99::DOUBLE, ({_WEIGHT} + CASE WHEN ml >= 12 THEN 0.08::DOUBLE ELSE 0 END + CASE WHEN contains(m, ' ') THEN 0.05::DOUBLE ELSE 0 END) * CASE WHEN uncertain THEN 0.65::DOUBLE ELSE 1 END)) AS pre FROM sc0),
rk AS (SELECT *, row_number() OVER (PARTITION BY rec_id, label, section_idx ORDER BY pre DESC, phrase_idx, st) AS rn, count(*) OVER (PARTITION BY rec_id, label, section_idx) AS c FROM sc),
hits AS (SELECT rec_id, label, label_idx, phrase_idx, phrase, section, section_idx, st, st + ml AS en, rn, uncertain, CASE WHEN rn = 1 AND c >= 2 THEN least(0.99::DOUBLE, pre + 0.06::DOUBLE) ELSE pre END AS score FROM rk)"""


_RATIO_SQL = rf"""
rt0 AS (SELECT rec_id, low_all, regexp_extract_all(low_all, '{C.RATIO}', 1) AS ds, regexp_extract_all(low_all, '{C.RATIO}', 0) AS ms, string_split_regex(low_all, '{C.RATIO.replace("([0-9]{2,3})", "[0-9]{2,3}")}') AS ps FROM rep WHERE NOT blank),
rt1 AS (SELECT *, list_transform(ds, lambda d: CASE WHEN d::DOUBLE > 1 THEN d::DOUBLE / 100.0 ELSE d::DOUBLE END) AS vs FROM rt0),
rt2 AS (SELECT *, list_position(list_transform(vs, lambda v: v > 0.5), true) AS k FROM rt1),
ratio AS (SELECT rec_id, vs[k] AS v, (list_sum(list_transform(ps[1:k], lambda p: length(p))) + coalesce(list_sum(list_transform(ms[1:k - 1], lambda p: length(p))), 0))::INTEGER AS st, ms[k] AS mt FROM rt2 WHERE k > 0)"""


def _results(source: str) -> str:
    return rf"""{_hits(source)},{_RATIO_SQL},
ev0 AS (SELECT *, row_number() OVER (PARTITION BY rec_id, label ORDER BY score DESC, section_idx, rn) AS er FROM hits),
dict AS (SELECT rec_id, label, round(max(score), 4) AS score, bool_or(uncertain AND er <= 3) AS uncertain, least(count(*), 3) AS n FROM ev0 GROUP BY rec_id, label),
every AS (SELECT rec_id, label, score, uncertain, NULL::DOUBLE AS ctr_value, n FROM dict WHERE NOT (label = 'Cardiomegaly' AND rec_id IN (SELECT rec_id FROM ratio))
  UNION ALL SELECT r.rec_id, 'Cardiomegaly', greatest(least(0.85::DOUBLE, 0.60::DOUBLE + (v - 0.50::DOUBLE) * 2.0), coalesce(d.score, 0)), false, v, least(3, 1 + coalesce(d.n, 0)) FROM ratio r LEFT JOIN dict d ON d.rec_id = r.rec_id AND d.label = 'Cardiomegaly'),
sent AS (SELECT rec_id, unnest(string_split_regex(low_all, '\. |\n')) AS s, generate_subscripts(string_split_regex(low_all, '\. |\n'), 1) AS i FROM rep WHERE NOT blank),
cue AS (SELECT rec_id, bool_or(regexp_matches(s, '{_CUE}') AND NOT regexp_matches(CASE WHEN i = 1 THEN substr(regexp_extract(s, '{_CUE}', 1), 2) ELSE regexp_extract(s, '{_CUE}', 1) END, '{_words(C.NEGATIONS)}')) AS cue FROM sent GROUP BY rec_id),
norm AS (SELECT DISTINCT r.rec_id FROM rep r JOIN lexicon l ON l.label = 'Normal' AND trim(l.phrase) <> '' AND contains(r.low_all, lower(l.phrase))
  AND regexp_matches(r.low_all, '(?:^|[^\p{{L}}\p{{N}}_])' || regexp_escape(lower(l.phrase)) || '(?:$|[^\p{{L}}\p{{N}}_])') WHERE NOT r.blank),
flags AS (SELECT r.rec_id, r.study_id, r.blank, r.rec_id IN (SELECT rec_id FROM norm) AS has_normal_phrase, coalesce(c.cue, false) AS has_abnormal_cue, r.low_all FROM rep r LEFT JOIN cue c USING (rec_id)),
results AS (SELECT *, false AS fallback FROM every UNION ALL
  SELECT rec_id, 'Other Significant Abnormality', 0.35, false, NULL, 1, true FROM flags WHERE has_abnormal_cue AND NOT has_normal_phrase AND rec_id NOT IN (SELECT rec_id FROM every))"""


def _averages() -> str:
    return """
one AS (SELECT study_id, fold, label, max(round(prob * 10000)::BIGINT) AS p FROM scores WHERE study_id IS NOT NULL AND label IS NOT NULL AND fold IS NOT NULL GROUP BY ALL),
foldn AS (SELECT study_id, count(DISTINCT fold) AS n_folds, sum(p) FILTER (label = 'Normal') / (count(p) FILTER (label = 'Normal') * 10000.0) AS normal_prob FROM one GROUP BY study_id),
avgs AS (SELECT f.study_id, f.n_folds, f.normal_prob, l.label, coalesce(sum(o.p), 0) / (f.n_folds * 10000.0) AS prob FROM foldn f CROSS JOIN label_hierarchy l LEFT JOIN one o ON o.study_id = f.study_id AND o.label = l.label GROUP BY f.study_id, f.n_folds, f.normal_prob, l.label)"""


def _three(p: str) -> str:
    return f"printf('%.3f', floor({p} * 1000 + 0.5 + 1e-9) / 1000.0)"


def _cells() -> str:
    shown = _three("bert_prob")
    return rf"""{_results('annotated_reports')},{_averages()},
grid AS (SELECT f.rec_id, f.study_id, f.blank, f.has_normal_phrase, l.label,
  CASE WHEN l.label IN ({_list(C.MODEL_PRIMARY)}) THEN 'bert_primary' WHEN l.label IN ({_list(C.RARE)}) THEN 'rare_unstable' ELSE 'rule_primary' END AS policy,
  coalesce(r.score, 0)::DOUBLE AS rb_score, CASE WHEN f.blank THEN 0.0 ELSE coalesce(a.prob, 0) END::DOUBLE AS bert_prob, n.n_folds, n.normal_prob, coalesce(n.normal_prob >= 0.7, false) AND NOT f.blank AS active
  FROM flags f CROSS JOIN label_hierarchy l LEFT JOIN results r ON r.rec_id = f.rec_id AND r.label = l.label LEFT JOIN avgs a ON a.study_id = f.study_id AND f.study_id <> 'ANON' AND a.label = l.label LEFT JOIN foldn n ON n.study_id = f.study_id AND f.study_id <> 'ANON'),
g2 AS (SELECT *, rb_score >= 0.55 AS rb_detected, NOT blank AND bert_prob >= 0.5 AS bert_detected, CASE WHEN policy = 'rare_unstable' THEN CASE WHEN active THEN 0.95 ELSE 0.85 END ELSE CASE WHEN active THEN 0.9 ELSE 0.8 END END AS bar FROM grid),
cells AS (SELECT *, CASE WHEN rb_detected = bert_detected THEN rb_detected WHEN rb_detected OR policy = 'bert_primary' THEN true ELSE bert_prob >= bar END AS included,
  CASE WHEN rb_detected = bert_detected THEN 'high' WHEN policy = 'bert_primary' THEN CASE WHEN bert_detected THEN 'medium' ELSE 'low' END WHEN rb_detected THEN CASE WHEN policy = 'rare_unstable' AND bert_prob < 0.3 THEN 'low' ELSE 'medium' END ELSE 'low' END AS confidence,
  CASE WHEN rb_detected = bert_detected THEN NULL
    WHEN policy = 'bert_primary' THEN CASE WHEN bert_detected THEN 'included (BERT primary)' ELSE 'included (RB backup)' END
    WHEN rb_detected AND policy = 'rare_unstable' THEN CASE WHEN bert_prob >= 0.3 THEN 'included (RB detected, BERT weak signal, rare)' ELSE 'included (RB detected, no BERT signal, rare)' END
    WHEN rb_detected THEN CASE WHEN bert_prob >= 0.3 THEN 'included (RB primary, BERT weak signal)' ELSE 'included (RB primary, no BERT signal)' END
    WHEN policy = 'rare_unstable' THEN CASE WHEN bert_prob >= bar THEN 'included (high BERT prob, rare)' ELSE 'excluded (low BERT prob, rare)' END
    ELSE CASE WHEN bert_prob >= bar THEN 'included (high BERT prob)' ELSE 'excluded (low BERT prob)' END END AS decision,
  CASE WHEN rb_detected = bert_detected THEN NULL
    WHEN policy = 'bert_primary' AND bert_detected THEN 'BERT-primary label: BERT detected, rules missed'
    WHEN policy = 'bert_primary' THEN 'BERT-primary label: rules detected, BERT missed (prob=' || {shown} || ')'
    ELSE CASE WHEN policy = 'rare_unstable' THEN 'Rare label: ' ELSE 'Rule-primary: ' END || CASE
      WHEN rb_detected AND bert_prob >= 0.3 THEN 'rules detected, BERT weak signal (prob=' || {shown} || ' >= 0.3)' WHEN rb_detected THEN 'rules detected, BERT no signal (prob=' || {shown} || ' < 0.3)'
      ELSE CASE WHEN bert_prob >= bar THEN 'BERT-only, high prob (' || {shown} || ' >= ' ELSE 'BERT-only, prob too low (' || {shown} || ' < ' END
        || CASE WHEN policy = 'rare_unstable' THEN CASE WHEN active THEN '0.95' ELSE '0.85' END ELSE CASE WHEN active THEN '0.9' ELSE '0.8' END END || ')'
        || CASE WHEN active THEN ' [normal_suppression active, normal_prob=' || {_three('normal_prob')} || ']' ELSE '' END END END AS reason FROM g2)"""


_SUMMARY = """
summ0 AS (SELECT rec_id, study_id, string_agg(label, ',' ORDER BY label) FILTER (included) AS fl, string_agg(label, ',' ORDER BY label) FILTER (rb_detected) AS rl, string_agg(label, ',' ORDER BY label) FILTER (bert_detected) AS bl,
  count(*) FILTER (included) AS num_labels, count(*) FILTER (rb_detected) AS rb_count, count(*) FILTER (bert_detected) AS bert_count, count(decision) AS disagreement_count, bool_or(has_normal_phrase) AS has_normal_phrase,
  max(CASE WHEN blank THEN 0 ELSE coalesce(n_folds, 0) END)::INTEGER AS n_bert_folds, max(CASE WHEN blank THEN NULL ELSE round(normal_prob + 1e-9, 4) END) AS normal_prob, bool_or(active) AS normal_suppression_active FROM cells GROUP BY rec_id, study_id),
summ AS (SELECT rec_id, study_id, coalesce(fl, 'Normal') AS final_labels, num_labels, num_labels = 0 AS is_normal, coalesce(rl, 'Normal') AS rb_labels_str, coalesce(bl, 'Normal') AS bert_labels_str,
  rb_count, bert_count, disagreement_count, has_normal_phrase, n_bert_folds, normal_prob, normal_suppression_active FROM summ0)"""


def _wide() -> str:
    cols = []
    for x in C.LABELS:
        s = ensemble.short_name(x)
        for name, value in (("pred", "included::INTEGER"), ("conf", "confidence"), ("rb_pred", "rb_detected::INTEGER"), ("bert_pred", "bert_detected::INTEGER"), ("bert_prob", "round(bert_prob + 1e-9, 4)")):
            cols.append(f"max(CASE WHEN label = '{x}' THEN {value} END) AS \"{name}_{s}\"")
    return "wide AS (SELECT rec_id, " + ", ".join(cols) + " FROM cells GROUP BY rec_id)"


def queries() -> dict:
    return {
        "rule_header": rule_header, "rule_sections": rule_sections, "rule_hits": rule_hits, "rule_results": rule_results, "rule_evidence": rule_evidence, "rule_meta": rule_meta,
        "rule_labels": rule_labels, "rule_hierarchy": rule_hierarchy, "ratio_values": ratio_values, "tier_lookup": tier_lookup, "score_average": score_average,
        "score_predictions": score_predictions, "score_labels": score_labels, "fold_models": fold_models, "vector_scores": vector_scores, "ensemble_decisions": ensemble_decisions,
        "ensemble_disagreements": ensemble_disagreements, "ensemble_summary": ensemble_summary, "ensemble_wide": ensemble_wide, "prediction_record": prediction_record, "union_vote": union_vote,
    }


def oracle_sql() -> dict[str, str]:
    src = "ensemble_predictions"
    weights = ", ".join(str(((i * 7) % 11 - 5) / 10.0) for i in range(64))
    return {
        "rule_header": f"SELECT rec_id, {_strip("regexp_replace(coalesce(report_text, ''), '" + C.HEADER + "', '')")} AS plain_text FROM {src}",
        "rule_sections": f"WITH {_sections(src)} SELECT rec_id, section_idx, section, section_text FROM secs",
        "rule_hits": f"WITH {_hits(src)} SELECT rec_id, label, phrase_idx, phrase, section, st::INTEGER AS start_at, en::INTEGER AS end_at, round(score, 6) AS score, uncertain FROM hits",
        "rule_results": f"WITH {_results(src)} SELECT rec_id, label, round(score, 6) AS score, uncertain, fallback, round(ctr_value, 6) AS ctr_value, n::INTEGER AS n_evidence FROM results",
        "rule_evidence": rf"""WITH {_results(src)}, evs AS (
            SELECT rec_id, label, er AS o, phrase, section, st, en FROM ev0
            UNION ALL SELECT rec_id, 'Cardiomegaly', 0, 'CTR=' || printf('%.2f', v), 'numeric', st, st + length(mt) FROM ratio
            UNION ALL SELECT f.rec_id, 'Other Significant Abnormality', 1, regexp_extract(low_all, '{_CUE}', 2), 'full_text', length(regexp_extract(low_all, '{_CUE}', 1)), length(regexp_extract(low_all, '{_CUE}', 1)) + length(regexp_extract(low_all, '{_CUE}', 2))
              FROM flags f JOIN results r ON r.rec_id = f.rec_id AND r.fallback)
            SELECT rec_id, label, (rn - 1)::INTEGER AS ev_no, phrase, section, st::INTEGER AS start_at, en::INTEGER AS end_at FROM (SELECT *, row_number() OVER (PARTITION BY rec_id, label ORDER BY o) AS rn FROM evs) WHERE rn <= 3""",
        "rule_meta": f"WITH {_results(src)} SELECT f.rec_id, has_normal_phrase, has_abnormal_cue, coalesce((SELECT string_agg(section, ',' ORDER BY section_idx) FROM secs s WHERE s.rec_id = f.rec_id), '') AS sections_found FROM flags f",
        "rule_labels": f"WITH {_results(src)} SELECT f.rec_id, coalesce(string_agg(r.label, ',' ORDER BY r.label), 'Normal') AS labels FROM flags f LEFT JOIN results r ON r.rec_id = f.rec_id AND r.score >= 0.55 GROUP BY f.rec_id",
        "rule_hierarchy": f"""WITH {_results(src)} SELECT f.rec_id, CASE WHEN count(h.label) > 0 THEN 'abnormal' ELSE 'normal' END AS tier1, coalesce(string_agg(DISTINCT h.tier2, ',' ORDER BY h.tier2), '') AS tier2,
            coalesce(string_agg(h.label, ',' ORDER BY h.label), '') AS tier3 FROM flags f LEFT JOIN results r ON r.rec_id = f.rec_id AND r.score >= 0.55 LEFT JOIN label_hierarchy h ON h.label = r.label GROUP BY f.rec_id""",
        "ratio_values": f"""WITH rep AS (SELECT rec_id, report_text IS NULL AS blank, lower(report_text) AS low_all FROM {src}), {_RATIO_SQL}
            SELECT rec_id, round(v, 6) AS ctr_value, round(least(0.85::DOUBLE, 0.60::DOUBLE + (v - 0.50::DOUBLE) * 2.0), 6) AS score, st AS start_at, (st + length(mt))::INTEGER AS end_at FROM ratio""",
        "tier_lookup": "SELECT d.rec_id, d.label, h.tier2 FROM disagreement_log d JOIN label_hierarchy h USING (label)",
        "score_average": f"WITH {_averages()} SELECT study_id, n_folds::INTEGER AS n_folds, round(normal_prob, 6) AS normal_prob, label, round(prob, 6) AS prob FROM avgs",
        "score_predictions": f"WITH {_averages()} SELECT study_id, fold, label, p / 10000.0 AS score, p >= 5000 AS predicted, p >= 3000 AND p < 5000 AS uncertain FROM one WHERE label <> 'Normal' AND p IS NOT NULL",
        "score_labels": f"""WITH {_averages()}, a AS (SELECT study_id, fold, coalesce(string_agg(label, ',' ORDER BY label) FILTER (p >= 5000), '') AS labels FROM one WHERE label <> 'Normal' AND p IS NOT NULL GROUP BY ALL),
            b AS (SELECT study_id, fold, max(p) FILTER (label = 'Normal') / 10000.0 AS normal_prob FROM one GROUP BY ALL) SELECT coalesce(a.study_id, b.study_id) AS study_id, coalesce(a.fold, b.fold) AS fold, labels, normal_prob FROM a FULL JOIN b ON a.study_id = b.study_id AND a.fold = b.fold""",
        "fold_models": "SELECT fold, coalesce(bool_or(label = 'Normal'), false) AS has_normal FROM scores GROUP BY fold",
        "vector_scores": f"SELECT vec_id, round(1.0 / (1.0 + exp(-(list_sum(list_transform(list_zip(embedding, [{weights}]), lambda z: z[1]::DOUBLE * z[2]::DOUBLE)) + 0.1))), 6) AS prob FROM embeddings",
        "ensemble_decisions": f"WITH {_cells()} SELECT rec_id, label, policy, rb_detected, bert_detected, round(bert_prob, 6) AS bert_prob, round(rb_score, 6) AS rb_score, included, confidence FROM cells",
        "ensemble_disagreements": f"WITH {_cells()} SELECT rec_id, study_id, label, policy, rb_detected, bert_detected, round(bert_prob + 1e-9, 4) AS bert_prob, round(rb_score + 1e-9, 4) AS rb_score, decision, reason FROM cells WHERE decision IS NOT NULL",
        "ensemble_summary": f"WITH {_cells()},{_SUMMARY} SELECT * FROM summ",
        "ensemble_wide": f"WITH {_cells()},{_wide()} SELECT * FROM wide",
        "prediction_record": f"WITH {_cells()},{_SUMMARY},{_wide()} SELECT s.*, w.* EXCLUDE (rec_id), coalesce(length(a.report_text), 0)::INTEGER AS report_length FROM summ s JOIN wide w USING (rec_id) JOIN annotated_reports a USING (rec_id)",
        "union_vote": """WITH p AS (SELECT rec_id, unnest(string_split(coalesce(rb_labels_str, '') || ',' || coalesce(bert_labels_str, ''), ',')) AS x FROM ensemble_predictions)
            SELECT rec_id, coalesce(string_agg(DISTINCT x, ',' ORDER BY x) FILTER (trim(x) NOT IN ('', 'Normal')), '') AS labels FROM p GROUP BY rec_id""",
    }
