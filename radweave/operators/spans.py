"""Phrase spans with word-edge matching, overlap resolution, weak labels and guards."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from radweave.functions.barrier import let, once
from radweave.functions.text import is_blank
from radweave.operators.rules import Lexicon

# Words without which a label is taken back; matched anywhere in the text.
GUARDS = {
    "Pleural Effusion": ("effusion", "meniscus", "costophrenic", "blunting", "lamellar", "tracking", "pleural fluid", "pleural collection", "hydropneumothorax"),
    "Tuberculosis": ("tb", "ptb", "koch", "kochs", "gene expert", "cavity", "cavitary", "apical cavitation"),
    "Lung Mass / Nodule": ("mass", "nodule", "nodular", "lesion", "tumor", "neoplasm", "mediastinal mass", "hilar mass"),
}
_EDGE = "[A-Za-z0-9]"


def span_pattern(phrase: Column) -> Column:
    """Pattern of a phrase as it stands, underscores included, in any case; no letter or digit touches either end."""
    return F.concat(F.lit(f"(?i)(?<!{_EDGE})\\Q"), phrase, F.lit(f"\\E(?!{_EDGE})"))


def _starts(text: Column, phrase: Column) -> Column:
    """0-based starts of all matches: they have the phrase's length, so one split gives every place."""
    size = F.length(phrase)

    def walk(parts: Column) -> Column:
        found = F.aggregate(
            parts,
            F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out")),
            lambda a, p: F.struct((a["at"] + F.length(p) + size).alias("at"), F.array_append(a["out"], a["at"] + F.length(p)).alias("out")),
            lambda a: a["out"],
        )
        return F.slice(found, F.lit(1), F.size(parts) - 1)

    return let(F.split(text, span_pattern(phrase), -1), walk)


def with_spans(df: DataFrame, lexicon: Lexicon, text: str = "report_text", out: str = "spans") -> DataFrame:
    """Adds ``out``: all (start, end, label) of the lexicon's phrases, each distinct phrase of a label once, longest first.

    Only phrases that the lower-cased text contains are searched for by pattern.
    """
    df = once(df, __t=F.coalesce(F.col(text), F.lit("")))
    df = once(df, __l=F.lower("__t"))
    usable = F.filter(lexicon.span_column(), lambda p: F.contains(F.col("__l"), p["low"]))
    each = F.transform(usable, lambda p: F.transform(_starts(F.col("__t"), p["phrase"]), lambda at: F.struct(at.alias("start"), (at + F.length(p["phrase"])).alias("end"), p["label"].alias("label"))))
    return once(df, **{out: F.array_distinct(F.flatten(each))}).drop("__t", "__l")


def without_overlaps(spans: Column) -> Column:
    """Spans kept greedily, longest first, then earliest, then label; sorted by place."""
    order = F.array_sort(F.transform(spans, lambda s: F.struct((s["start"] - s["end"]).alias("minus"), s["start"].alias("start"), s["end"].alias("end"), s["label"].alias("label"))))
    empty = F.array().cast("array<struct<start:int,end:int,label:string>>")
    kept = F.aggregate(
        order,
        empty,
        lambda a, s: F.when(F.exists(a, lambda k: (s["start"] < k["end"]) & (k["start"] < s["end"])), a).otherwise(F.array_append(a, F.struct(s["start"].alias("start"), s["end"].alias("end"), s["label"].alias("label")))),
    )
    return F.array_sort(kept)


def guarded(labels: Column, text: Column) -> Column:
    """Labels without those whose guard words are all absent from the lower-cased text; sorted."""
    low = F.lower(F.coalesce(text, F.lit("")))
    for label, guard in GUARDS.items():
        absent = ~low.rlike("|".join(guard))
        labels = F.when(absent, F.array_except(labels, F.array(F.lit(label)))).otherwise(labels)
    return F.array_sort(F.array_distinct(labels))


def clean_gold(gold: Column) -> Column:
    """Labels of a comma list: stripped, one known misspelling put right, blanks dropped."""
    fix = F.transform(F.split(F.coalesce(gold, F.lit("")), ","), lambda x: F.trim(x))
    return F.filter(F.transform(fix, lambda x: F.when(F.lower(x) == "other significantt abnormality", "Other Significant Abnormality").otherwise(x)), lambda x: x != "")


def enough_examples(examples: DataFrame, least: int = 10) -> DataFrame:
    """The examples, or an error if there are fewer than ``least``."""
    if examples.limit(least).count() < least:
        raise ValueError(f"fewer than {least} weakly labelled examples")
    return examples


def weak_labels(df: DataFrame, lexicon: Lexicon, labels: list[str], text: str = "report_text", gold: str = "gold_labels", need_span: bool = True, most: int | None = None, key: str = "rec_id") -> DataFrame:
    """Training rows for a span model: non-overlapping spans of the gold labels; blank, Normal-only and unlabelled reports drop out.

    ``most`` keeps the first examples by ``key``, where a model is to see a bounded number of them.
    """
    known = F.filter(clean_gold(F.col(gold)), lambda x: x.isin(labels))
    df = with_spans(df.filter(~is_blank(F.col(text))).withColumn("allowed", known).filter(F.size("allowed") > 0), lexicon, text)
    df = once(df, kept=without_overlaps(F.filter("spans", lambda s: F.array_contains(F.col("allowed"), s["label"]))))
    df = df.filter(F.size("kept") > 0) if need_span else df
    return df if most is None else df.orderBy(key).limit(most)


def ruled_spans(df: DataFrame, patterns: dict[str, list[str]], text: str = "report_text", out: str = "entities") -> DataFrame:
    """Adds ``out``: (start, end, label) of phrases found as exact runs of tokens, in their own case.

    A token is a run of letters and digits or a single sign. Longer phrases win over shorter ones they overlap.
    """
    rows = [{"label": label, "phrase": p} for label, phrases in patterns.items() for p in dict.fromkeys(phrases) if p.strip()]
    table = F.from_json(F.lit(json.dumps(rows, ensure_ascii=False)), "array<struct<label:string,phrase:string>>")
    df = once(df, __t=F.coalesce(F.col(text), F.lit("")))

    def found(p: Column) -> Column:
        edge = lambda c: F.when(c.rlike(r"[\p{L}\p{N}]"), F.lit(r"[\p{L}\p{N}]")).otherwise(F.lit(r"(?!)"))
        pattern = F.concat(F.lit("(?<!"), edge(F.substring(p["phrase"], 1, 1)), F.lit(")\\Q"), p["phrase"], F.lit("\\E(?!"), edge(F.substring(p["phrase"], -1, 1)), F.lit(")"))
        size = F.length(p["phrase"])
        parts = F.split(F.col("__t"), pattern, -1)
        starts = F.aggregate(parts, F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out")), lambda a, x: F.struct((a["at"] + F.length(x) + size).alias("at"), F.array_append(a["out"], a["at"] + F.length(x)).alias("out")), lambda a: a["out"])
        return F.transform(F.slice(starts, F.lit(1), F.size(parts) - 1), lambda at: F.struct(at.alias("start"), (at + size).alias("end"), p["label"].alias("label")))

    each = F.transform(F.filter(table, lambda p: F.contains(F.col("__t"), p["phrase"])), found)
    return once(df, **{out: without_overlaps(F.array_distinct(F.flatten(each)))}).drop("__t")
