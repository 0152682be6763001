"""Validation of image headers and studies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from radweave.functions.text import strip

# Modalities and words of chest radiographs.
MODALITIES = ("CR", "DX", "PX")
CHEST_WORDS = ("CHEST", "CXR", "THORAX", "LUNG", "PA", "AP", "THORACIC", "CARDIO", "MEDIASTIN", "PNEUMO")
VIEW_WORDS = ("CHEST", "THORAX", "LUNG", "CXR")
FIELDS = ("body_part", "study_desc", "series_desc", "protocol", "view_position")
REASONS = ("No DICOM files found", "No valid DICOM files", "No DICOM with pixel data", "No chest-candidate images", "Missing report.txt")


def is_chest_xray(df: DataFrame) -> Column:
    """Known modality and a chest word anywhere in the joined description fields."""
    joined = F.upper(F.concat_ws(" ", *[F.coalesce(F.col(c), F.lit("")) for c in FIELDS if c in df.columns]))
    return F.upper(F.coalesce(F.col("modality"), F.lit(""))).isin(*MODALITIES) & joined.rlike("|".join(CHEST_WORDS))


def is_likely_chest_view(view: Column, body: Column, description: Column) -> Column:
    """Frontal view, or a chest body part, or a chest word in the descriptions; no modality test."""
    up = lambda c: F.upper(F.coalesce(c, F.lit("")))
    return up(view).rlike("PA|AP|FRONT") | up(body).rlike("CHEST") | up(description).rlike("|".join(VIEW_WORDS))


def leaks_identity(patient_id: Column) -> Column:
    """True for an id longer than four characters that is not an anonymised one."""
    p = strip(F.coalesce(patient_id, F.lit("")))
    return (p != "") & ~F.upper(p).startswith("ANON") & (F.length(p) > 4)


def validate_files(df: DataFrame) -> DataFrame:
    """Adds valid, chest, leak and checksum of every header row; a row with a parse error is invalid and nothing else."""
    ok = F.col("parse_error").isNull()
    return df.select("*", ok.alias("valid"), (ok & is_chest_xray(df)).alias("chest"), (ok & leaks_identity(F.col("patient_id"))).alias("leak"), F.md5("content").alias("checksum"))


def validate_studies(files: DataFrame, studies: DataFrame) -> DataFrame:
    """One row per study: counts and reasons in their fixed order; valid iff there is none.

    A study without files has only the first reason. An identity leak is counted but does not invalidate.
    """
    c = files.groupBy("study_id").agg(
        F.count(F.lit(1)).alias("n_files"), F.count_if("valid").alias("n_valid"), F.count_if("chest").alias("n_chest"), F.count_if(F.col("valid") & F.col("has_pixels")).alias("n_pixels"), F.count_if("leak").alias("n_leaks")
    )
    s = studies.join(c, "study_id", "left").fillna(0, ["n_files", "n_valid", "n_chest", "n_pixels", "n_leaks"])
    some = F.col("n_files") > 0
    tests = (~some, some & (F.col("n_valid") == 0), some & (F.col("n_pixels") == 0), some & (F.col("n_chest") == 0), some & ~F.col("has_report"))
    reasons = F.array_compact(F.array(*[F.when(t, F.lit(r)) for t, r in zip(tests, REASONS)]))
    return s.withColumn("reasons", reasons).withColumn("is_valid", F.size("reasons") == 0)


def validate_dataset(studies: DataFrame) -> DataFrame:
    """Totals over the studies."""
    return studies.agg(F.count(F.lit(1)).alias("n_studies"), F.count_if("is_valid").alias("n_valid"), F.sum("n_files").alias("n_files"), F.sum("n_leaks").alias("n_leaks"))


def primary_file(files: DataFrame) -> DataFrame:
    """First valid frontal file per study by instance number (missing last), then by name."""
    good = files.filter("valid").withColumn("view_ok", is_likely_chest_view(F.col("view_position"), F.col("body_part"), F.concat_ws(" ", "study_desc", "series_desc")))
    order = F.struct(F.col("instance_no").isNull().alias("a"), F.col("instance_no").alias("b"), F.col("file").alias("c"))
    return good.filter("view_ok").groupBy("study_id").agg(F.min_by("file", order).alias("file"))
