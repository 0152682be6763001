"""De-identification of identifiers, dates, headers and report text."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from radweave.functions.barrier import let
from radweave.functions.constants import BLANKS
from radweave.functions.text import strip

# Header fields that go, and date fields that move.
DROPPED = (
    "patient_birth_date", "patient_address", "other_patient_ids", "other_patient_names", "issuer_of_patient_id", "accession_number", "institution_name", "institution_address",
    "institutional_department_name", "referring_physician_name", "performing_physician_name", "operators_name", "station_name", "device_serial_number", "dicom_study_id",
    "requesting_physician", "requesting_service", "admission_id", "performed_procedure_step_id",
)
DATES = ("study_date", "series_date", "acquisition_date", "content_date")
SIGNATURE = r"(?i)\b(?:Dr|Drs|Dr\.|Doctor|Radiologist)\b|^Dr\.?.+/[" + BLANKS + r"]*.+"
LINE_END = r"\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x{85}\x{2028}\x{2029}]"
DATE_LIKE = r"\b\p{Nd}{4}[-/]?\p{Nd}{2}[-/]?\p{Nd}{2}\b"
LONG_NUMBER = r"\b\p{Nd}{6,}\b"


def secret(name: str = "ANON_SECRET_KEY") -> str:
    """The hashing secret from the environment; it must be set. Plans print literals: keep them out of logs."""
    value = os.environ.get(name)
    if not value:
        raise RuntimeError(f"{name} is not set")
    return value


def hash_id(value: Column, key: str) -> Column:
    """First 16 hex digits of sha256(value + key); null and empty values become ANON."""
    v = F.coalesce(value, F.lit(""))
    return F.when(v == "", "ANON").otherwise(F.substring(F.sha2(F.concat(v, F.lit(key)), 256), 1, 16))


def shift_date(date: Column, days: Column) -> Column:
    """YYYYMMDD moved by days; blank gives an empty text, what is no date stays."""
    d = F.coalesce(date, F.lit(""))
    moved = F.date_format(F.date_add(F.try_to_date(d, "yyyyMMdd"), days), "yyyyMMdd")
    return F.when(strip(d) == "", "").when(d.rlike("^[0-9]{8}$"), F.coalesce(moved, d)).otherwise(d)


def study_offset(study: Column, key: str) -> Column:
    """Days -365..365, the same for every date of a study."""
    return (F.pmod(F.conv(F.substring(F.md5(F.concat(study, F.lit(key))), 1, 6), 16, 10).cast("long"), F.lit(731)) - 365).cast("int")


def redact(text: Column) -> Column:
    """Dates written as eight digits, then longer numbers, replaced by typed marks; line by line."""
    return F.regexp_replace(F.regexp_replace(text, DATE_LIKE, "[REDACTED_DATE]"), LONG_NUMBER, "[REDACTED_ID]")


def drop_signature(text: Column, last: int = 3) -> Column:
    """Text without signature lines among its last lines; lines above are kept whatever they say."""

    def kept(lines: Column) -> Column:
        marked = F.transform(lines, lambda x, i: F.when((i >= F.size(lines) - last) & strip(x).rlike(SIGNATURE), F.lit(None)).otherwise(x))
        return F.filter(marked, lambda x: x.isNotNull())

    return F.array_join(let(F.split(F.regexp_replace(text, f"(?:{LINE_END})$", ""), LINE_END, -1), kept), "\n")


def clean_report(text: Column) -> Column:
    """Dates and numbers redacted, then signature lines dropped; null stays null."""
    return drop_signature(redact(text))


def new_uid(old: Column, key: str) -> Column:
    """Instance id under the root for ids made from numbers; null stays null."""
    return F.concat(F.lit("2.25."), F.conv(F.substring(F.md5(F.concat(old, F.lit(key))), 1, 15), 16, 10))


def deidentify_headers(df: DataFrame, key: str) -> DataFrame:
    """Header rows without personal fields, with hashed ids and shifted dates.

    Personal and private fields that are present are dropped, age and sex stay, every date of a study moves by the
    same days, and every instance gets a new unique id that follows from the old one and the key.
    """
    out = df.drop(*[c for c in df.columns if c in DROPPED or c.startswith("private_")])
    if "sop_instance_uid" in df.columns:
        out = out.withColumn("sop_instance_uid", new_uid(F.col("sop_instance_uid"), key))
    days = study_offset(F.col("study_id"), key)
    for c in DATES:
        if c in df.columns:
            out = out.withColumn(c, shift_date(F.col(c), days))
    if "patient_id" in df.columns:
        out = out.withColumn("patient_id", F.concat(F.lit("ANON_"), hash_id(F.col("patient_id"), key)))
    return out.withColumn("patient_name", F.lit("ANON")).withColumn("deidentified", F.lit(True))


def with_defaults(df: DataFrame, **defaults: object) -> DataFrame:
    """Missing pixel metadata filled with defaults; a field that is absent altogether is added."""
    for name, value in defaults.items():
        df = df.withColumn(name, F.coalesce(F.col(name), F.lit(value)) if name in df.columns else F.lit(value))
    return df


def outcomes(df: DataFrame, error: str = "parse_error") -> DataFrame:
    """(study_id, n_ok, n_failed): files per study that could be de-identified, and that could not; none is dropped silently."""
    return df.groupBy("study_id").agg(F.count_if(F.col(error).isNull()).alias("n_ok"), F.count_if(F.col(error).isNotNull()).alias("n_failed"))
