"""Queries of corpus preparation, de-identification, validation, imaging, spans, sinks and streams, with their SQL."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from radweave.functions import constants as C
from radweave.functions.text import is_blank, strip
from radweave.operators import agreement, deid, imaging, rules, sampling, spans, synth, validate
from radweave.plans import labelling
from radweave.scratch import new_path
from radweave.sources import reports as sources
from radweave.sources import sinks
from radweave.streaming import incremental
from radweave.tables import spread, table

#: Key of the demonstration queries; real runs take ``deid.secret()``.
KEY = "demonstration-key"
RARE = tuple(synth.FINDINGS)

# Header rows composed from the part table: the same text in both engines.
_HEADERS = """
concat('S', cast(cast(floor(p_partkey / 3) as bigint) as varchar(20))) AS study_id, concat(p_name, '-', cast(p_partkey as varchar(20)), '.dcm') AS file,
CASE p_partkey % 7 WHEN 0 THEN 'CR' WHEN 1 THEN 'DX' WHEN 2 THEN 'PX' WHEN 3 THEN 'CT' WHEN 4 THEN 'cr' WHEN 5 THEN NULL ELSE 'DX' END AS modality,
CASE p_partkey % 4 WHEN 0 THEN 'CHEST' WHEN 1 THEN 'ABDOMEN' WHEN 2 THEN '' ELSE NULL END AS body_part, p_name AS study_desc, p_type AS series_desc, p_brand AS protocol,
CASE p_partkey % 5 WHEN 0 THEN 'PA' WHEN 1 THEN 'AP' WHEN 2 THEN 'LAT' WHEN 3 THEN NULL ELSE 'LL' END AS view_position,
CASE p_partkey % 6 WHEN 0 THEN 'ANON_0001' WHEN 1 THEN concat('HN', cast(p_partkey + 10000 as varchar(20))) WHEN 2 THEN '12' WHEN 3 THEN NULL WHEN 4 THEN ' ' ELSE 'anon' END AS patient_id,
CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE p_size END AS instance_no, p_partkey % 9 <> 0 AS has_pixels, CASE WHEN p_partkey % 11 = 0 THEN 'bad preamble' END AS parse_error, p_name AS content
"""


def _headers(spark: SparkSession, folder: str) -> DataFrame:
    table(spark, folder, "part").createOrReplaceTempView("rw_part")
    return spark.sql(f"SELECT {_HEADERS} FROM rw_part")


def _studies(spark: SparkSession, folder: str) -> DataFrame:
    own = _headers(spark, folder).select("study_id").distinct().withColumn("has_report", F.regexp_extract("study_id", "[0-9]+", 0).cast("long") % 4 != 0)
    bare = table(spark, folder, "supplier").select(F.concat(F.lit("X"), F.col("s_suppkey").cast("string")).alias("study_id"), F.lit(True).alias("has_report"))
    return own.unionByName(bare)


def file_validation(spark: SparkSession, folder: str) -> DataFrame:
    df = validate.validate_files(_headers(spark, folder))
    return df.select("study_id", "file", "valid", "chest", "leak", "checksum")


def study_validation(spark: SparkSession, folder: str) -> DataFrame:
    df = validate.validate_studies(validate.validate_files(_headers(spark, folder)), _studies(spark, folder))
    return df.select("study_id", "n_files", "n_valid", "n_chest", "n_pixels", "n_leaks", F.array_join("reasons", "; ").alias("reasons"), "is_valid")


def dataset_validation(spark: SparkSession, folder: str) -> DataFrame:
    return validate.validate_dataset(validate.validate_studies(validate.validate_files(_headers(spark, folder)), _studies(spark, folder)))


def primary_images(spark: SparkSession, folder: str) -> DataFrame:
    return validate.primary_file(validate.validate_files(_headers(spark, folder)))


def hashed_ids(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "study_metadata").select("study_id", deid.hash_id(F.col("study_id"), KEY).alias("hashed"))


def shifted_dates(spark: SparkSession, folder: str) -> DataFrame:
    """Study dates moved by the study's offset; blanks and non-dates as the rules say."""
    day = F.when(F.col("o_orderkey") % 13 == 0, "").when(F.col("o_orderkey") % 17 == 0, "unknown").otherwise(F.date_format("o_orderdate", "yyyyMMdd"))
    study = F.concat(F.lit("C"), F.col("o_custkey").cast("string"))
    return table(spark, folder, "orders").select("o_orderkey", deid.study_offset(study, KEY).alias("offset_days"), deid.shift_date(day, deid.study_offset(study, KEY)).alias("shifted"))


def redacted_reports(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "ensemble_predictions").select("rec_id", deid.redact(F.col("report_text")).alias("redacted"))


def cleaned_reports(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "ensemble_predictions").select("rec_id", deid.clean_report(F.col("report_text")).alias("cleaned"))


def deidentified_headers(spark: SparkSession, folder: str) -> DataFrame:
    df = _headers(spark, folder).withColumn("study_date", F.lit("20240229")).withColumn("sop_instance_uid", F.col("file"))
    df = df.withColumns({c: F.lit("clinic") for c in (*deid.DROPPED, "private_0009_note")})
    out = deid.deidentify_headers(df, KEY)
    kept = F.lit(",".join(sorted(c for c in out.columns if c in deid.DROPPED or c.startswith("private_"))))
    return out.select("study_id", "file", "modality", "patient_id", "patient_name", "study_date", "deidentified", "sop_instance_uid", kept.alias("personal_fields"))


def deidentification_outcomes(spark: SparkSession, folder: str) -> DataFrame:
    """Files per study done and failed, with pixel metadata defaults in place."""
    return deid.outcomes(deid.with_defaults(_headers(spark, folder), modality="DX", bits_stored=16))


def normalised_vectors(spark: SparkSession, folder: str) -> DataFrame:
    """Embedding vectors as 8 x 8 images, clipped and scaled inside the JVM."""
    df = imaging.clip_and_normalise(table(spark, folder, "embeddings").select("vec_id", "embedding"), "embedding", "v")
    return df.select("vec_id", F.round(F.array_min("v"), 6).alias("least"), F.round(F.array_max("v"), 6).alias("most"), F.round(F.aggregate("v", F.lit(0.0), lambda a, x: a + x), 5).alias("total"))


def padded_images(spark: SparkSession, folder: str) -> DataFrame:
    """The same images resized to 12 x 16 on zeros by Arrow batches: pixel sum and grey-level maximum."""
    df = imaging.preprocess(table(spark, folder, "embeddings"), "vec_id", "embedding", 8, 8, (12, 16))
    return df.select("vec_id", "status", F.size("image").alias("n_pixels"), F.round(F.aggregate("image", F.lit(0.0), lambda a, x: a + x.cast("double")), 2).alias("total"), F.array_max(sinks.grey_levels(F.col("image"))).alias("white"))


def qc_sample(spark: SparkSession, folder: str) -> DataFrame:
    """Fixed-size drawn sample with its QC numbers and folders."""
    df = sampling.fixed_sample(table(spark, folder, "study_metadata").select("study_id", "image_path"), "study_id", 100)
    return df.select("study_id", "image_path", F.col("sample_no").alias("qc_id"), F.format_string("%03d_%s", "sample_no", "study_id").alias("folder"))


def stratified_sample(spark: SparkSession, folder: str) -> DataFrame:
    """Proportional sample over the trimmed review priority."""
    df = table(spark, folder, "annotated_reports").select("rec_id", F.coalesce(strip(F.col("review_priority")), F.lit("none")).alias("priority"))
    return sampling.stratified_sample(df, "rec_id", "priority", 100)


def prefill_links(spark: SparkSession, folder: str) -> DataFrame:
    df = table(spark, folder, "study_metadata")
    return df.select("study_id", sampling.prefill_link("https://forms.example/qc", id=F.col("study_id"), image=F.col("image_path")).alias("link"))


def reorganised_studies(spark: SparkSession, folder: str) -> DataFrame:
    """New ids by position over all sorted folders, then only studies with all three files."""
    df = table(spark, folder, "study_metadata").filter("original_folder is not null")
    df = sampling.positions(df, "original_folder", "study_id")
    full = df.filter("image_path is not null and report_path is not null and array_path is not null")
    return full.select("original_folder", F.format_string("anon_study_%05d", "position").alias("new_id"), "position")


def excluded_studies(spark: SparkSession, folder: str) -> DataFrame:
    """Audit of an exclusion list: flagged studies, and ids that are not known."""
    m = table(spark, folder, "study_metadata")
    flagged = m.filter(F.lower(strip(F.coalesce("qc_flag", F.lit("")))) != "ok").select("study_id")
    listed = flagged.unionByName(table(spark, folder, "disagreement_log").select("study_id"))
    return sampling.exclude(m, listed, "study_id")[1]


def kept_studies(spark: SparkSession, folder: str) -> DataFrame:
    m = table(spark, folder, "study_metadata")
    flagged = m.filter(F.lower(strip(F.coalesce("qc_flag", F.lit("")))) != "ok")
    return sampling.exclude(m.select("study_id", "qc_flag"), flagged, "study_id")[0]


def synthetic_reports(spark: SparkSession, folder: str) -> DataFrame:
    """Template reports for rare labels up to a target count."""
    real = table(spark, folder, "annotated_reports").select(F.explode(agreement.as_list("gold_labels")).alias("label")).filter(F.col("label").isin(*RARE)).groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    return synth.positives(real, 200)


def rare_label_reports(spark: SparkSession, folder: str) -> DataFrame:
    """Template reports of all six rare labels up to a target count, labels without a real report included."""
    own = F.array_distinct(agreement.as_list("gold_labels"))
    real = table(spark, folder, "annotated_reports").select(F.explode(own).alias("label")).groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    return synth.rare_positives(real, 200)


def hard_negative_reports(spark: SparkSession, folder: str) -> DataFrame:
    return synth.hard_negatives(spark, C.LABELS[:12])


def varied_negative_reports(spark: SparkSession, folder: str) -> DataFrame:
    """Hard negatives from every label's own templates, with the gold labels of the template."""
    return synth.varied_negatives(spark)


def merged_training(spark: SparkSession, folder: str) -> DataFrame:
    """Real, synthetic and hard-negative rows in one corpus, counted by origin and target."""
    real = table(spark, folder, "annotated_reports").select("study_id", "report_text", "gold_labels")
    all_rows = synth.merge(real, synthetic_reports(spark, folder), hard_negative_reports(spark, folder))
    origin = F.when(F.col("study_id").startswith("synth_"), "synthetic").when(F.col("study_id").startswith("hardneg_"), "hard_negative").otherwise("real")
    return all_rows.groupBy(origin.alias("origin"), "neg_target").agg(F.count(F.lit(1)).alias("n"))


def report_spans(spark: SparkSession, folder: str) -> DataFrame:
    """All lexicon spans with letter-and-digit edges."""
    df = spans.with_spans(spread(table(spark, folder, "ensemble_predictions").select("rec_id", "report_text")), labelling.lexicon(spark, folder))
    return df.select("rec_id", F.explode("spans").alias("s")).select("rec_id", F.col("s.start").alias("start_at"), F.col("s.end").alias("end_at"), "s.label")


def resolved_spans(spark: SparkSession, folder: str) -> DataFrame:
    """Spans without overlaps."""
    df = spans.with_spans(spread(table(spark, folder, "ensemble_predictions").select("rec_id", "report_text")), labelling.lexicon(spark, folder))
    return df.select("rec_id", F.explode(spans.without_overlaps(F.col("spans"))).alias("s")).select("rec_id", F.col("s.start").alias("start_at"), F.col("s.end").alias("end_at"), "s.label")


def weak_labels(spark: SparkSession, folder: str) -> DataFrame:
    """Spans of gold labels for training a span model."""
    df = spans.weak_labels(table(spark, folder, "annotated_reports").select("rec_id", "report_text", "gold_labels"), labelling.lexicon(spark, folder), list(C.LABELS))
    return df.select("rec_id", F.explode("kept").alias("s")).select("rec_id", F.col("s.start").alias("start_at"), F.col("s.end").alias("end_at"), "s.label")


def guarded_labels(spark: SparkSession, folder: str) -> DataFrame:
    """Model labels after the guards."""
    return table(spark, folder, "ensemble_predictions").select("rec_id", F.array_join(spans.guarded(agreement.as_list("bert_labels_str"), F.col("report_text")), ",").alias("labels"))


def _text_folder(spark: SparkSession, folder: str) -> str:
    root = new_path(spark, "texts")
    rows = table(spark, folder, "annotated_reports").select(F.concat("rec_id", F.lit(".txt")).alias("name"), F.coalesce("report_text", F.lit("")).alias("content"))
    sinks.write_files(spread(rows), root, "name", "content")
    return root


def scanned_reports(spark: SparkSession, folder: str) -> DataFrame:
    """Reports written as a folder of text files and scanned: ids from file names, texts stripped, empty ones dropped."""
    return sources.scan_reports(spark, _text_folder(spark, folder)).select("study_id", F.md5("report_text").alias("text_hash"))


def scanned_all(spark: SparkSession, folder: str) -> DataFrame:
    """The same scan with the empty texts kept."""
    return sources.scan_reports(spark, _text_folder(spark, folder), keep_empty=True).select("study_id", F.md5("report_text").alias("text_hash"))


def listed_studies(spark: SparkSession, folder: str) -> DataFrame:
    """Study folders with one file per supplier, listed recursively; only the .png files count."""
    root = new_path(spark, "studies")
    s = table(spark, folder, "supplier")
    name = F.concat(F.lit("study"), F.pmod("s_suppkey", F.lit(7)), F.lit("/"), F.col("s_suppkey"), F.when(F.col("s_suppkey") % 5 == 0, ".txt").otherwise(".png"))
    sinks.write_files(s.select(name.alias("name"), F.col("s_name").alias("content")), root, "name", "content")
    return sources.study_files(spark, root, "*.png").select("study_id", "file", "length")


def lexicon_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    """Lexicon table written as a JSON object of phrase lists and loaded again."""
    rows = table(spark, folder, "lexicon").orderBy("label_idx", "phrase_idx").limit(rules.MAX_PHRASES).collect()
    phrases: dict[str, list] = {}
    for r in rows:
        phrases.setdefault(r["label"], []).append(r["phrase"])
    root = new_path(spark, "lexicon")
    sinks.write_files(spark.createDataFrame([("lexicon.json", json.dumps(phrases, ensure_ascii=False))], "name string, content string"), root, "name", "content")
    return sources.load_lexicon(spark, [f"{root}/missing.json", f"{root}/lexicon.json"])


def hierarchy_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    """Hierarchy table written as YAML and loaded again."""
    rows = table(spark, folder, "label_hierarchy").orderBy("label_idx").limit(rules.MAX_PHRASES).collect()
    text = "version: 1\npathology_to_category:\n" + "".join(f"  \"{r['label']}\": {r['tier2']}\n" for r in rows)
    root = new_path(spark, "hierarchy")
    sinks.write_files(spark.createDataFrame([("hierarchy.yaml", text)], "name string, content string"), root, "name", "content")
    return sources.load_hierarchy(spark, f"{root}/hierarchy.yaml")


def csv_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    """Predictions written to delimited files and read back with a declared schema."""
    path = new_path(spark, "csv")
    sinks.write_csv(table(spark, folder, "ensemble_predictions").select("rec_id", "study_id", F.coalesce("report_text", F.lit("")).alias("report_text"), "final_labels"), path)
    df = sources.read_csv(spark, path, "rec_id long, study_id string, report_text string, final_labels string")
    return df.select("rec_id", "study_id", F.md5(F.coalesce("report_text", F.lit(""))).alias("text_hash"), "final_labels")


def json_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    """Label distribution as one nested JSON document, read back."""
    path = new_path(spark, "json")
    d = table(spark, folder, "ensemble_predictions").agg(F.count(F.lit(1)).alias("total"), F.struct(F.sum("is_normal").alias("normal"), F.sum("disagreement_count").alias("disagreements")).alias("stats"))
    sinks.write_json(d, path)
    return spark.read.schema("total long, stats struct<normal long, disagreements long>").json(path).select("total", "stats.normal", "stats.disagreements")


def streamed_labels(spark: SparkSession, folder: str) -> DataFrame:
    """Rule labels by a file stream with a checkpoint; equals the batch result."""
    lexicon = labelling.lexicon(spark, folder)
    schema = "rec_id long, study_id string, report_text string"

    def label(df: DataFrame) -> DataFrame:
        dealt = df.repartition(spark.sparkContext.defaultParallelism)  # one small file is one split of a stream
        return rules.with_labels(dealt, lexicon).select("rec_id", F.array_join(F.array_sort(rules.label_list(normal_as_empty=False)), ",").alias("labels"))

    return incremental.run_available(spark, f"{folder}/ensemble_predictions.parquet*", schema, label, new_path(spark, "stream"), new_path(spark, "stream-checkpoint"))


def resumed_reports(spark: SparkSession, folder: str) -> DataFrame:
    """Reports not yet processed: blank ones count as done."""
    e = table(spark, folder, "ensemble_predictions")
    return incremental.resume(e.select("rec_id", "study_id"), e.filter(is_blank(F.col("report_text"))))


def queries() -> dict:
    return {
        f.__name__: f
        for f in (
            file_validation, study_validation, dataset_validation, primary_images, hashed_ids, shifted_dates, redacted_reports, cleaned_reports, deidentified_headers, deidentification_outcomes, normalised_vectors,
            padded_images, qc_sample, stratified_sample, prefill_links, reorganised_studies, excluded_studies, kept_studies, synthetic_reports, rare_label_reports, hard_negative_reports, varied_negative_reports, merged_training,
            report_spans, resolved_spans, weak_labels, guarded_labels, scanned_reports, scanned_all, listed_studies, lexicon_round_trip, hierarchy_round_trip, csv_round_trip, json_round_trip, streamed_labels, resumed_reports,
        )
    }


# --- SQL -------------------------------------------------------------------------------------------------

_S = labelling._strip
_UP = "upper(coalesce({}, ''))"
_FILES = f"""hd AS (SELECT {_HEADERS} FROM part),
vf AS (SELECT *, parse_error IS NULL AS valid, parse_error IS NULL AND {_UP.format('modality')} IN ('CR', 'DX', 'PX') AND regexp_matches(upper(concat_ws(' ', coalesce(body_part, ''), coalesce(study_desc, ''), coalesce(series_desc, ''), coalesce(protocol, ''), coalesce(view_position, ''))), '{"|".join(validate.CHEST_WORDS)}') AS chest,
  parse_error IS NULL AND {_S("coalesce(patient_id, '')")} <> '' AND NOT starts_with(upper({_S("coalesce(patient_id, '')")}), 'ANON') AND length({_S("coalesce(patient_id, '')")}) > 4 AS leak, md5(content) AS checksum FROM hd)"""
_STUDY = f"""{_FILES}, st AS (SELECT DISTINCT study_id, regexp_extract(study_id, '[0-9]+')::BIGINT % 4 <> 0 AS has_report FROM hd UNION ALL SELECT 'X' || s_suppkey, true FROM supplier),
c AS (SELECT study_id, count(*) AS n_files, count(*) FILTER (valid) AS n_valid, count(*) FILTER (chest) AS n_chest, count(*) FILTER (valid AND has_pixels) AS n_pixels, count(*) FILTER (leak) AS n_leaks FROM vf GROUP BY study_id),
sv0 AS (SELECT st.study_id, has_report, coalesce(n_files, 0) AS n_files, coalesce(n_valid, 0) AS n_valid, coalesce(n_chest, 0) AS n_chest, coalesce(n_pixels, 0) AS n_pixels, coalesce(n_leaks, 0) AS n_leaks FROM st LEFT JOIN c USING (study_id)),
sv AS (SELECT * EXCLUDE (has_report), array_to_string(list_filter([CASE WHEN n_files = 0 THEN '{validate.REASONS[0]}' END, CASE WHEN n_files > 0 AND n_valid = 0 THEN '{validate.REASONS[1]}' END, CASE WHEN n_files > 0 AND n_pixels = 0 THEN '{validate.REASONS[2]}' END,
  CASE WHEN n_files > 0 AND n_chest = 0 THEN '{validate.REASONS[3]}' END, CASE WHEN n_files > 0 AND NOT has_report THEN '{validate.REASONS[4]}' END], lambda x: x IS NOT NULL), '; ') AS reasons FROM sv0)"""


def _hash(x: str) -> str:
    return f"CASE WHEN coalesce({x}, '') = '' THEN 'ANON' ELSE substr(sha256({x} || '{KEY}'), 1, 16) END"


def _offset(x: str) -> str:
    return f"(('0x' || substr(md5({x} || '{KEY}'), 1, 6))::BIGINT % 731 - 365)::INTEGER"


def _shift(d: str, o: str) -> str:
    return f"CASE WHEN {_S(d)} = '' THEN '' WHEN regexp_matches({d}, '^[0-9]{{8}}$') THEN coalesce(strftime(try_strptime({d}, '%Y%m%d') + to_days({o}), '%Y%m%d'), {d}) ELSE {d} END"


def _redact(x: str) -> str:
    return f"regexp_replace(regexp_replace({x}, '{deid.DATE_LIKE}', '[REDACTED_DATE]', 'g'), '{deid.LONG_NUMBER}', '[REDACTED_ID]', 'g')"


def _pick(options: tuple[str, ...], n: str) -> str:
    quoted = ", ".join("'" + o.replace("'", "''") + "'" for o in options)
    return f"([{quoted}])[(({n}) % {len(options)})::INTEGER + 1]"


def _fill(t: str) -> str:
    out = f"replace(replace({t}, '{{side}}', {_pick(synth.SIDES, 'n')}), '{{zone}}', {_pick(synth.ZONES, 'n // 2')})"
    return f"replace(replace({out}, '{{size}}', printf('%.1f', (15 + (n * 7) % 46) / 10.0)), '{{ctr}}', printf('%.2f', (53 + (n * 3) % 20) / 100.0))"


def _synthetic() -> str:
    labels = ", ".join(f"'{x}'" for x in RARE)
    order = "CASE label " + " ".join(f"WHEN '{x}' THEN {i + 1}" for i, x in enumerate(RARE)) + " END"
    finding = "CASE label " + " ".join(f"WHEN '{x}' THEN {_pick(o, 'n')}" for x, o in synth.FINDINGS.items()) + " END"
    return f"""real AS (SELECT label, count(*) AS n FROM (SELECT {_S('x')} AS label FROM (SELECT unnest(string_split(coalesce(gold_labels, ''), ',')) AS x FROM annotated_reports)) WHERE label IN ({labels}) GROUP BY label),
each AS (SELECT label, {order} * 100000 + unnest(range(1, greatest(0, 200 - n) + 1)) AS n FROM real),
syn AS (SELECT printf('synth_%06d', n) AS study_id, 'CHEST RADIOGRAPH REPORT' || chr(10) || CASE WHEN n % 2 = 0 THEN 'Findings:' || chr(10) ELSE '' END || {_pick(synth.BOILERPLATE, 'n')} || ' There is ' || {_fill(finding)} || '. ' || {_pick(synth.BOILERPLATE, 'n + 1')} || chr(10) || 'Impression: ' || label || '.' AS report_text, label AS gold_labels FROM each)"""


def _negatives() -> str:
    labels, n = C.LABELS[:12], 12 * 15
    body = f"replace({_pick(synth.NEGATIVES, 'id')}, '{{what}}', lower(target))"
    for k, (old, new) in enumerate(synth.SWAPS):
        body = f"CASE WHEN (id // {k + 1}) % 3 = 0 THEN replace({body}, '{old}', '{new}') ELSE {body} END"
    return f"""hn0 AS (SELECT id, {_pick(labels, 'id // 15')} AS target FROM (SELECT unnest(range(0, {n})) AS id)),
hn AS (SELECT printf('hardneg_%05d', id + 90001) AS study_id, 'CHEST RADIOGRAPH REPORT' || CASE WHEN id % 10 < 3 THEN chr(10) || chr(10) ELSE chr(10) END || {body} AS report_text, 'Normal' AS gold_labels, target AS neg_target FROM hn0)"""


def _spans_sql(source: str) -> str:
    edge = "[A-Za-z0-9]"
    return rf"""lx AS (SELECT DISTINCT label, trim(phrase) AS phrase FROM lexicon WHERE label <> 'Normal' AND trim(phrase) <> ''),
lp AS (SELECT *, '(?i)' || regexp_escape(phrase) AS pat FROM lx),
cd AS (SELECT r.rec_id, r.report_text AS t, l.label, string_split_regex(r.report_text, l.pat) AS ps, length(l.phrase) AS ml FROM {source} r JOIN lp l ON regexp_matches(r.report_text, l.pat)),
oc0 AS (SELECT *, unnest(range(1, len(ps))) AS k FROM cd),
oc AS (SELECT rec_id, t, label, (list_sum(list_transform(ps[1:k], lambda p: length(p))) + (k - 1) * ml)::INTEGER AS st, ml FROM oc0),
spn AS (SELECT DISTINCT rec_id, st AS start_at, (st + ml)::INTEGER AS end_at, label FROM oc WHERE NOT regexp_matches(CASE WHEN st = 0 THEN '' ELSE substr(t, st, 1) END, '{edge}') AND NOT regexp_matches(substr(t, st + ml + 1, 1), '{edge}'))"""


def _resolved_sql(spans: str) -> str:
    """Longest first, then earliest, then label; a span goes if it overlaps one kept before it."""
    return f"""ls AS (SELECT rec_id, list([{{'s': start_at, 'e': end_at, 'l': label}}] ORDER BY start_at - end_at, start_at, end_at, label) AS x FROM {spans} GROUP BY rec_id),
rs AS (SELECT rec_id, list_reduce(x, lambda a, b: CASE WHEN len(list_filter(a, lambda k: b[1].s < k.e AND k.s < b[1].e)) > 0 THEN a ELSE list_concat(a, b) END) AS kept FROM ls),
rr AS (SELECT rec_id, unnest(kept) AS k FROM rs)"""


def oracle_sql() -> dict[str, str]:
    e = "ensemble_predictions"
    view = f"(regexp_matches({_UP.format('view_position')}, 'PA|AP|FRONT') OR contains({_UP.format('body_part')}, 'CHEST') OR regexp_matches(upper(concat_ws(' ', study_desc, series_desc)), '{'|'.join(validate.VIEW_WORDS)}'))"
    day = "CASE WHEN o_orderkey % 13 = 0 THEN '' WHEN o_orderkey % 17 = 0 THEN 'unknown' ELSE strftime(o_orderdate, '%Y%m%d') END"
    study = "'C' || o_custkey"
    signature = deid.SIGNATURE.replace("'", "''")
    lines = f"string_split_regex(regexp_replace({_redact('report_text')}, '(?:{deid.LINE_END})$', ''), '{deid.LINE_END}')"
    draw = lambda k: f"md5({k}::VARCHAR || '42')"
    flagged = f"lower({_S("coalesce(qc_flag, '')")}) <> 'ok'"
    guards = "b"
    for label, guard in spans.GUARDS.items():
        guards = f"CASE WHEN NOT regexp_matches(lower(coalesce(report_text, '')), '{'|'.join(guard)}') THEN list_filter({guards}, lambda x: x <> '{label}') ELSE {guards} END"
    return {
        "file_validation": f"WITH {_FILES} SELECT study_id, file, valid, chest, leak, checksum FROM vf",
        "study_validation": f"WITH {_STUDY} SELECT *, reasons = '' AS is_valid FROM sv",
        "dataset_validation": f"WITH {_STUDY} SELECT count(*) AS n_studies, count(*) FILTER (reasons = '') AS n_valid, sum(n_files)::BIGINT AS n_files, sum(n_leaks)::BIGINT AS n_leaks FROM sv",
        "primary_images": f"WITH {_FILES} SELECT study_id, file FROM (SELECT study_id, file, row_number() OVER (PARTITION BY study_id ORDER BY instance_no NULLS LAST, file) AS r FROM vf WHERE valid AND {view}) WHERE r = 1",
        "hashed_ids": f"SELECT study_id, {_hash('study_id')} AS hashed FROM study_metadata",
        "shifted_dates": f"SELECT o_orderkey, {_offset(study)} AS offset_days, {_shift('d', 'o')} AS shifted FROM (SELECT o_orderkey, o_custkey, {day} AS d, {_offset(study)} AS o FROM orders)",
        "redacted_reports": f"SELECT rec_id, {_redact('report_text')} AS redacted FROM {e}",
        "cleaned_reports": f"WITH l AS (SELECT rec_id, report_text, {lines} AS ls FROM {e}) SELECT rec_id, CASE WHEN report_text IS NULL THEN NULL ELSE coalesce(array_to_string(list_filter(ls, lambda x, i: NOT (i > len(ls) - 3 AND regexp_matches({_S('x')}, '{signature}'))), chr(10)), '') END AS cleaned FROM l",
        "deidentified_headers": f"WITH hd AS (SELECT {_HEADERS} FROM part) SELECT study_id, file, modality, 'ANON_' || {_hash('patient_id')} AS patient_id, 'ANON' AS patient_name, {_shift("'20240229'", _offset('study_id'))} AS study_date, true AS deidentified, '2.25.' || (('0x' || substr(md5(file || '{KEY}'), 1, 15))::BIGINT)::VARCHAR AS sop_instance_uid, '' AS personal_fields FROM hd",
        "deidentification_outcomes": f"WITH hd AS (SELECT {_HEADERS} FROM part) SELECT study_id, count(*) FILTER (parse_error IS NULL) AS n_ok, count(*) FILTER (parse_error IS NOT NULL) AS n_failed FROM hd GROUP BY study_id",
        "normalised_vectors": """WITH q AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e, list_aggregate(list_transform(embedding, lambda x: x::DOUBLE), 'quantile_cont', 0.01) AS p, list_aggregate(list_transform(embedding, lambda x: x::DOUBLE), 'quantile_cont', 0.99) AS r FROM embeddings),
            v AS (SELECT vec_id, list_transform(e, lambda x: (greatest(p, least(r, x)) - p) / (r - p + 1e-6)) AS v FROM q) SELECT vec_id, round(list_min(v), 6) AS least, round(list_max(v), 6) AS most, round(list_sum(v), 5) AS total FROM v""",
        "qc_sample": f"SELECT study_id, image_path, r::INTEGER AS qc_id, printf('%03d_%s', r, study_id) AS folder FROM (SELECT *, row_number() OVER (ORDER BY {draw('study_id')}, study_id) AS r FROM study_metadata) WHERE r <= 100",
        "stratified_sample": f"""WITH b AS (SELECT rec_id, coalesce({_S('review_priority')}, 'none') AS priority FROM annotated_reports), q AS (SELECT priority, least(round_even(count(*) / (SELECT count(*) FROM b)::DOUBLE * 100, 0), count(*)) AS quota FROM b GROUP BY priority),
            r AS (SELECT *, row_number() OVER (PARTITION BY priority ORDER BY {draw('rec_id')}, rec_id) AS k FROM b), m AS (SELECT r.rec_id, r.priority, k > quota AS extra FROM r JOIN q USING (priority)) SELECT rec_id, priority FROM m ORDER BY extra, {draw('rec_id')}, rec_id LIMIT 100""",
        "prefill_links": "SELECT study_id, 'https://forms.example/qc?id=' || replace(url_encode(coalesce(study_id, '')), '%20', '+') || '&image=' || replace(url_encode(coalesce(image_path, '')), '%20', '+') AS link FROM study_metadata",
        "reorganised_studies": "SELECT original_folder, printf('anon_study_%05d', position) AS new_id, position FROM (SELECT *, row_number() OVER (ORDER BY original_folder, study_id) AS position FROM study_metadata WHERE original_folder IS NOT NULL) WHERE image_path IS NOT NULL AND report_path IS NOT NULL AND array_path IS NOT NULL",
        "excluded_studies": f"WITH l AS (SELECT study_id FROM study_metadata WHERE {flagged} UNION SELECT study_id FROM disagreement_log) SELECT l.study_id, CASE WHEN m.study_id IS NULL THEN 'unknown' ELSE 'excluded' END AS outcome FROM l LEFT JOIN study_metadata m ON m.study_id = l.study_id",
        "kept_studies": f"SELECT study_id, qc_flag FROM study_metadata WHERE NOT ({flagged})",
        "synthetic_reports": f"WITH {_synthetic()} SELECT * FROM syn",
        "hard_negative_reports": f"WITH {_negatives()} SELECT * FROM hn",
        "merged_training": f"WITH {_synthetic()}, {_negatives()} SELECT origin, neg_target, count(*) AS n FROM (SELECT 'real' AS origin, '' AS neg_target FROM annotated_reports UNION ALL SELECT 'synthetic', '' FROM syn UNION ALL SELECT 'hard_negative', neg_target FROM hn) GROUP BY ALL",
        "report_spans": f"WITH {_spans_sql(e)} SELECT * FROM spn",
        "resolved_spans": f"WITH {_spans_sql(e)}, {_resolved_sql('spn')} SELECT rec_id, k.s AS start_at, k.e AS end_at, k.l AS label FROM rr",
        "weak_labels": f"""WITH {_spans_sql('annotated_reports')}, gl AS (SELECT DISTINCT rec_id, CASE WHEN lower(x) = 'other significantt abnormality' THEN 'Other Significant Abnormality' ELSE x END AS label FROM (SELECT rec_id, trim(unnest(string_split(coalesce(gold_labels, ''), ','))) AS x FROM annotated_reports)),
            own AS (SELECT s.* FROM spn s JOIN gl g ON g.rec_id = s.rec_id AND g.label = s.label), {_resolved_sql('own')} SELECT rec_id, k.s AS start_at, k.e AS end_at, k.l AS label FROM rr""",
        "guarded_labels": f"WITH b AS (SELECT rec_id, report_text, list_filter(list_transform(string_split(coalesce(bert_labels_str, ''), ','), lambda x: {_S('x')}), lambda x: x NOT IN ('', 'Normal')) AS b FROM {e}) SELECT rec_id, array_to_string(list_sort(list_distinct({guards})), ',') AS labels FROM b",
        "scanned_reports": f"SELECT rec_id::VARCHAR AS study_id, md5({_S('report_text')}) AS text_hash FROM annotated_reports WHERE report_text IS NOT NULL AND {_S('report_text')} <> ''",
        "scanned_all": f"SELECT rec_id::VARCHAR AS study_id, md5({_S("coalesce(report_text, '')")}) AS text_hash FROM annotated_reports",
        "listed_studies": "SELECT 'study' || (s_suppkey % 7) AS study_id, s_suppkey || '.png' AS file, length(s_name) AS length FROM supplier WHERE s_suppkey % 5 <> 0",
        "lexicon_round_trip": "SELECT label, (dense_rank() OVER (ORDER BY label_idx) - 1) AS label_idx, (row_number() OVER (PARTITION BY label ORDER BY phrase_idx) - 1) AS phrase_idx, phrase FROM lexicon",
        "hierarchy_round_trip": "SELECT label, (row_number() OVER (ORDER BY label_idx) - 1) AS label_idx, tier2 FROM label_hierarchy",
        "csv_round_trip": f"SELECT rec_id, study_id, md5(coalesce(report_text, '')) AS text_hash, final_labels FROM {e}",
        "json_round_trip": f"SELECT count(*) AS total, sum(is_normal)::BIGINT AS normal, sum(disagreement_count)::BIGINT AS disagreements FROM {e}",
        "streamed_labels": labelling.oracle_sql()["rule_labels"],
        "resumed_reports": f"SELECT rec_id, study_id FROM {e} WHERE report_text IS NOT NULL AND {_S('report_text')} <> ''",
    }
