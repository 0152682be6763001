"""Rule labels: phrase matches with negation, uncertainty, section weights and evidence.

Everything about one report is computed inside its row with array functions over a
small constant lexicon: no shuffle, no join, no Python.  The work is one map over the reports
whatever their number, and long forms come from ``explode`` of the row's arrays.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from radweave.functions import constants as C
from radweave.functions.barrier import once
from radweave.functions.text import is_blank, starts_of
from radweave.operators.sections import with_sections

MAX_PHRASES = 10_000
_PHRASE = "array<struct<label_idx:int,label:string,phrase_idx:int,phrase:string,match:string,ambiguous:boolean>>"


class Lexicon:
    """Phrases by label, read once from a bounded table (label, label_idx, phrase_idx, phrase).

    Repeated phrases stay: each copy is a hit of its own.  Null and blank phrases are skipped.
    """

    def __init__(self, table: DataFrame):
        rows = table.select("label", "label_idx", "phrase_idx", "phrase").orderBy("label_idx", "phrase_idx").limit(MAX_PHRASES + 1).collect()
        if len(rows) > MAX_PHRASES:
            raise ValueError(f"more than {MAX_PHRASES} phrases; match such a lexicon by a join on words")
        kept = [r for r in rows if r["phrase"] and r["phrase"].strip()]
        self.normal = [r["phrase"].lower() for r in kept if r["label"] == "Normal"]
        #: Distinct stripped phrases of every finding label, longest first: what the span finder looks for.
        found = sorted({(r["label_idx"], r["label"], r["phrase"].strip()) for r in kept if r["label"] != "Normal"}, key=lambda x: (x[0], -len(x[2]), x[2]))
        self.spans = [{"label": label, "phrase": phrase, "low": phrase.lower()} for _, label, phrase in found]
        self.entries = [
            {
                "label_idx": r["label_idx"], "label": r["label"], "phrase_idx": r["phrase_idx"], "phrase": r["phrase"], "match": r["phrase"].lower().strip().replace("_", " "),
                "ambiguous": r["label"] == "Pneumonia / Consolidation" and r["phrase"].lower().strip() in C.AMBIGUOUS,
            }
            for r in kept
            if r["label"] != "Normal" and not (r["label"] == "Cardiomegaly" and r["phrase"].lower().strip() in C.RATIO_PHRASES)
        ]

    def span_column(self) -> Column:
        """The phrases of ``spans`` as a constant array column."""
        return F.from_json(F.lit(json.dumps(self.spans, ensure_ascii=False)), "array<struct<label:string,phrase:string,low:string>>")

    def column(self) -> Column:
        """The entries as a constant array column."""
        return F.from_json(F.lit(json.dumps(self.entries, ensure_ascii=False)), _PHRASE)


def _any_word(text: Column, phrases: list[str]) -> Column:
    hit = F.lit(False)
    for p in phrases:
        hit = hit | (F.contains(text, F.lit(p)) & text.rlike("\\b\\Q" + p + "\\E\\b"))
    return hit


def cue_flag(lower: Column) -> Column:
    """True if some sentence holds an abnormality word with no negation before it.

    Sentences end at ". " and at a line end. The text before the first sentence end loses its first
    character, as the reference's arithmetic has it.
    """
    cue = r"\b(?:" + "|".join(C.CUES) + r")\b"
    sentence = F.transform(F.split(lower, r"\. |\n", -1), lambda s, i: F.struct(s.alias("s"), (i == 0).alias("first")))
    place = F.transform(sentence, lambda x: F.struct(x["s"].alias("s"), x["first"].alias("first"), F.regexp_instr(x["s"], F.lit(cue)).alias("at")))
    left = lambda x: F.substring(x["s"], F.when(x["first"], 2).otherwise(1), F.greatest(F.lit(0), x["at"] - F.when(x["first"], 2).otherwise(1)))
    return F.exists(place, lambda x: (x["at"] > 0) & ~left(x).rlike(C.whole_words(C.NEGATIONS)))


def ratio_hit(lower: Column) -> Column:
    """Struct (value, start, end) of the first cardiothoracic ratio above 0.5; null without one."""
    texts = F.regexp_extract_all(lower, F.lit(C.RATIO), F.lit(0))
    values = F.transform(F.regexp_extract_all(lower, F.lit(C.RATIO), F.lit(1)), lambda d: F.when(d.cast("double") > 1, d.cast("double") / 100.0).otherwise(d.cast("double")))
    parts = F.split(lower, C.RATIO, -1)
    good = F.filter(F.transform(values, lambda v, i: F.struct(v.alias("value"), i.alias("i"))), lambda x: x["value"] > 0.5)
    k = F.get(good, F.lit(0))["i"]
    start = F.aggregate(F.slice(F.transform(parts, lambda p: F.length(p)), F.lit(1), k + 1), F.lit(0), lambda a, n: a + n) + F.aggregate(
        F.slice(F.transform(texts, lambda p: F.length(p)), F.lit(1), k), F.lit(0), lambda a, n: a + n
    )
    return F.when(F.size(good) > 0, F.struct(F.get(good, F.lit(0))["value"].alias("value"), start.alias("start"), (start + F.length(F.get(texts, k))).alias("end")))


def _scored(section: Column, p: Column, start: Column, window: int) -> Column:
    """Struct of one occurrence: score before any boost, flags and span."""
    low, end = section["low"], start + F.length(p["match"])
    left = F.substring(low, F.greatest(F.lit(0), start - window) + 1, F.least(start, F.lit(window)))
    left = F.regexp_replace(left, r"(?s)^.*(?:\. |\.\n|\n\n)", "")
    at = F.greatest(F.lit(0), start - 40)
    around = F.substring(low, at + 1, end + 40 - at)
    uncertain = around.rlike(C.whole_words(C.UNCERTAIN) + r"|\?")
    weight = F.element_at(F.create_map(*[F.lit(x) for kv in C.SECTION_WEIGHT.items() for x in kv]), section["section"])
    score = weight + F.when(F.length(p["match"]) >= 12, F.lit(0.08)).otherwise(F.lit(0.0))
    score = score + F.when(F.contains(p["match"], F.lit(" ")), F.lit(0.05)).otherwise(F.lit(0.0))
    score = F.when(uncertain, score * F.lit(0.65)).otherwise(score)
    score = F.greatest(F.lit(0.0), F.least(F.lit(0.99), score))
    return F.struct(
        p["label_idx"].alias("label_idx"), section["section_idx"].alias("section_idx"), (-score).alias("minus"), p["phrase_idx"].alias("phrase_idx"), start.alias("start"),
        end.alias("end"), p["label"].alias("label"), p["phrase"].alias("phrase"), section["section"].alias("section"), uncertain.alias("uncertain"),
        left.rlike(C.whole_words(C.NEGATIONS)).alias("negated"),
    )


def with_hits(df: DataFrame, lexicon: Lexicon, text: str = "report_text", negation_window: int = 60) -> DataFrame:
    """Adds ``sections``, ``lower`` and ``hits``: all unnegated phrase occurrences with their boosted scores.

    ``hits`` is ordered by label, section and rank inside the section (score, then lexicon order, then place).
    """
    df = once(with_sections(df, text), lower=F.lower(F.coalesce(F.col(text), F.lit(""))))
    confirm = r"(?i)" + C.whole_words(C.CONFIRMING)
    seen = F.transform(
        F.col("sections"),
        lambda s: F.struct(
            s["section_idx"].alias("section_idx"), s["section"].alias("section"), F.lower(s["text"]).alias("low"), s["text"].rlike(confirm).alias("confirmed"),
            F.lower(s["text"]).rlike("|".join(C.VASCULAR)).alias("vascular"),
        ),
    )
    df = once(once(df, __seen=seen), __vascular=F.exists("__seen", lambda s: s["vascular"]))
    entries = lexicon.column()

    def of_section(s: Column) -> Column:
        usable = F.filter(
            entries, lambda p: F.contains(s["low"], p["match"]) & (~p["ambiguous"] | s["confirmed"]) & ((p["label"] != "Pulmonary Edema") | F.col("__vascular"))
        )
        each = F.transform(usable, lambda p: F.transform(starts_of(s["low"], p["match"]), lambda at: _scored(s, p, at, negation_window)))
        return F.filter(F.flatten(each), lambda h: ~h["negated"])

    df = once(df, __raw=F.array_sort(F.flatten(F.transform("__seen", of_section))))

    def boosted(h: Column, i: Column) -> Column:
        prior, after = F.get(F.col("__raw"), i - 1), F.get(F.col("__raw"), i + 1)
        same = lambda o: F.coalesce((o["label_idx"] == h["label_idx"]) & (o["section_idx"] == h["section_idx"]), F.lit(False))
        best = ~same(prior) & same(after)
        return F.struct(
            h["label"].alias("label"), h["label_idx"].alias("label_idx"), h["phrase_idx"].alias("phrase_idx"), h["phrase"].alias("phrase"), h["section"].alias("section"),
            h["section_idx"].alias("section_idx"), i.alias("rank"), h["start"].alias("start"), h["end"].alias("end"),
            F.when(best, F.least(F.lit(0.99), -h["minus"] + F.lit(0.06))).otherwise(-h["minus"]).alias("score"), h["uncertain"].alias("uncertain"),
        )

    return once(df, hits=F.transform("__raw", boosted)).drop("__raw", "__seen", "__vascular")


_RESULT = (
    "array<struct<label:string,label_idx:int,score:double,uncertain:boolean,ctr_value:double,fallback:boolean,"
    "evidence:array<struct<phrase:string,section:string,start:int,end:int>>>>"
)


def with_labels(df: DataFrame, lexicon: Lexicon, text: str = "report_text", negation_window: int = 60, max_evidence: int = 3) -> DataFrame:
    """Adds ``results`` (one entry per scored label), ``has_normal_phrase``, ``has_abnormal_cue`` and ``sections_found``.

    Null and blank reports have no results, false flags and no sections.
    """
    df = with_hits(df, lexicon, text, negation_window)
    filled = ~is_blank(F.col(text))
    df = once(
        df, has_normal_phrase=filled & _any_word(F.col("lower"), lexicon.normal), has_abnormal_cue=filled & cue_flag(F.col("lower")), __ratio=F.when(filled, ratio_hit(F.col("lower")))
    )
    labels = F.array_distinct(F.transform("hits", lambda h: F.struct(h["label_idx"].alias("label_idx"), h["label"].alias("label"))))

    def of_label(x: Column) -> Column:
        own = F.filter("hits", lambda h: h["label_idx"] == x["label_idx"])
        order = F.array_sort(F.transform(own, lambda h: F.struct((-h["score"]).alias("m"), h["rank"].alias("rank"), h.alias("h"))))
        kept = F.slice(F.transform(order, lambda o: o["h"]), 1, max_evidence)
        return F.struct(
            x["label"].alias("label"), x["label_idx"].alias("label_idx"), F.round(F.array_max(F.transform(own, lambda h: h["score"])), 4).alias("score"),
            F.exists(kept, lambda h: h["uncertain"]).alias("uncertain"), F.lit(None).cast("double").alias("ctr_value"), F.lit(False).alias("fallback"),
            F.transform(kept, lambda h: F.struct(h["phrase"].alias("phrase"), h["section"].alias("section"), h["start"].alias("start"), h["end"].alias("end"))).alias("evidence"),
        )

    df = once(df, __dict=F.transform(labels, of_label).cast(_RESULT))
    ratio, heart = F.col("__ratio"), F.get(F.filter("__dict", lambda r: r["label"] == "Cardiomegaly"), F.lit(0))
    score = F.least(F.lit(0.85), F.lit(0.60) + (ratio["value"] - F.lit(0.50)) * F.lit(2.0))
    numeric = F.array(F.struct(F.format_string("CTR=%.2f", ratio["value"]).alias("phrase"), F.lit("numeric").alias("section"), ratio["start"].alias("start"), ratio["end"].alias("end")))
    merged = F.array(
        F.struct(
            F.lit("Cardiomegaly").alias("label"), F.coalesce(heart["label_idx"], F.lit(-1)).alias("label_idx"), F.greatest(score, heart["score"]).alias("score"),
            F.lit(False).alias("uncertain"), ratio["value"].alias("ctr_value"), F.lit(False).alias("fallback"),
            F.slice(F.concat(numeric, F.coalesce(heart["evidence"], F.array())), 1, max_evidence).alias("evidence"),
        )
    ).cast(_RESULT)
    df = once(df, __all=F.when(ratio.isNotNull(), F.concat(merged, F.filter("__dict", lambda r: r["label"] != "Cardiomegaly"))).otherwise(F.col("__dict")))
    cue = r"\b(" + "|".join(C.CUES) + r")\b"
    start, word = F.regexp_instr("lower", F.lit(cue)) - 1, F.regexp_extract("lower", cue, 1)
    fallback = F.array(
        F.struct(
            F.lit("Other Significant Abnormality").alias("label"), F.lit(-1).alias("label_idx"), F.lit(0.35).alias("score"), F.lit(False).alias("uncertain"),
            F.lit(None).cast("double").alias("ctr_value"), F.lit(True).alias("fallback"),
            F.array(F.struct(word.alias("phrase"), F.lit("full_text").alias("section"), start.alias("start"), (start + F.length(word)).alias("end"))).alias("evidence"),
        )
    ).cast(_RESULT)
    lone = (F.size("__all") == 0) & F.col("has_abnormal_cue") & ~F.col("has_normal_phrase")
    df = once(df, results=F.when(lone, fallback).otherwise(F.col("__all")), sections_found=F.transform("sections", lambda s: s["section"]))
    return df.drop("__dict", "__all", "__ratio")


def label_list(threshold: float = 0.55, normal_as_empty: bool = True) -> Column:
    """Labels of ``results`` at or above the threshold, in result order."""
    found = F.transform(F.filter("results", lambda r: (r["score"] >= threshold) & (r["label"] != "Normal")), lambda r: r["label"])
    return found if normal_as_empty else F.when(F.size(found) == 0, F.array(F.lit("Normal"))).otherwise(found)


def label_results(df: DataFrame, key: str = "rec_id") -> DataFrame:
    """Long form of ``results``: one row per report and label."""
    return df.select(key, F.explode("results").alias("r")).select(key, "r.*")
