"""Template-based reports: synthetic positives and hard negatives, without random state.

Every choice is a function of the report's number, so any partitioning and any engine give the same rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from radweave.operators import templates as T

SIDES = ("left", "right")
ZONES = ("upper", "mid", "lower")
FINDINGS = {
    "Suspected Malignancy": ("spiculated {side} {zone} zone mass of {size} cm", "irregular {side} hilar enlargement, malignancy is suspected"),
    "Lung Mass / Nodule": ("rounded nodule of {size} cm in the {side} {zone} zone", "well-defined {side} {zone} zone mass measuring {size} cm"),
    "Pulmonary Edema": ("perihilar haze with Kerley lines, CTR = {ctr}", "bat-wing opacities with vascular congestion"),
    "Post-Surgical Changes": ("surgical clips in the {side} {zone} zone", "sternal wires in place with {side} pleural thickening"),
}
BOILERPLATE = ("The trachea is central.", "The bones are intact.", "The soft tissues are normal.", "The costophrenic angles are clear.")
NEGATIVES = (
    "There is no evidence of {what}.", "The lungs are clear with no {what}.", "{what} is not seen on this film.", "No focal {what}; the heart is normal in size.",
    "Previous {what} has resolved completely.",
)
SWAPS = (("clear", "well aerated"), ("normal", "unremarkable"))


def _pick(options: tuple[str, ...], n: Column) -> Column:
    return F.element_at(F.array(*[F.lit(o) for o in options]), (F.pmod(n, F.lit(len(options))) + 1).cast("int"))


def fill(template: Column, n: Column) -> Column:
    """Template with its five placeholders filled from the report's number."""
    size = F.format_string("%.1f", (15 + F.pmod(n * 7, F.lit(46))) / 10.0)
    ctr = F.format_string("%.2f", (53 + F.pmod(n * 3, F.lit(20))) / 100.0)
    out = F.replace(F.replace(template, F.lit("{side}"), _pick(SIDES, n)), F.lit("{zone}"), _pick(ZONES, F.floor(n / 2)))
    return F.replace(F.replace(out, F.lit("{size}"), size), F.lit("{ctr}"), ctr)


def positives(real: DataFrame, target: int) -> DataFrame:
    """(study_id, report_text, gold_labels): max(0, target - real count) reports per rare label; ``real`` has (label, n)."""
    base = real.filter(F.col("label").isin(*FINDINGS)).withColumn("need", F.greatest(F.lit(0), F.lit(target) - F.col("n")).cast("int")).filter("need > 0")
    each = base.select("label", F.explode(F.sequence(F.lit(1), F.col("need"))).alias("i"))
    number = F.array_position(F.array(*[F.lit(x) for x in FINDINGS]), F.col("label")) * 100_000 + F.col("i")
    each = each.withColumn("n", number)
    finding = F.lit("")
    for label, options in FINDINGS.items():
        finding = F.when(F.col("label") == label, _pick(options, F.col("n"))).otherwise(finding)
    text = F.concat(
        F.lit("CHEST RADIOGRAPH REPORT\n"), F.when(F.pmod(F.col("n"), F.lit(2)) == 0, "Findings:\n").otherwise(""), _pick(BOILERPLATE, F.col("n")), F.lit(" There is "), fill(finding, F.col("n")), F.lit(". "),
        _pick(BOILERPLATE, F.col("n") + 1), F.lit("\nImpression: "), F.col("label"), F.lit("."),
    )
    return each.select(F.format_string("synth_%06d", "n").alias("study_id"), text.alias("report_text"), F.col("label").alias("gold_labels"))


def _draw(n: Column, what: str | Column, k: int | Column) -> Column:
    """Number below k from the hash of the report's number and a name of the choice: choices of different names do not hang together."""
    name = F.lit(what) if isinstance(what, str) else what
    digest = F.substring(F.md5(F.concat_ws(":", n.cast("string"), name)), 1, 8)
    return F.pmod(F.conv(digest, 16, 10).cast("long"), F.lit(k) if isinstance(k, int) else k).cast("int")


def _drawn(options: Column, n: Column, what: str | Column) -> Column:
    return F.element_at(options, _draw(n, what, F.size(options)) + 1)


def _shuffled(options: Column, n: Column, what: str) -> Column:
    keyed = F.transform(options, lambda x: F.struct(F.md5(F.concat_ws(":", n.cast("string"), F.lit(what), x)).alias("h"), x.alias("x")))
    return F.transform(F.array_sort(keyed), lambda s: s["x"])


def _array(options: tuple[str, ...]) -> Column:
    return F.array(*[F.lit(o) for o in options])


def rare_positives(real: DataFrame, target: int) -> DataFrame:
    """(study_id, report_text, gold_labels, is_synthetic, primary_augmented_label): max(0, target - real count) reports for each of the six rare labels.

    ``real`` has (label, n); a label that it lacks counts 0. Every report has one anatomy, 1 to 3 findings of its label, each
    co-label with 35 in 100, 2 to 4 normal sentences among them in drawn order, an impression and mostly a sign-off.
    """
    rows = [(x, k, list(f), list(i), [(c, list(T.CO_FINDINGS[c]), T.CO_IMPRESSIONS[c]) for c in T.CO_LABELS[x]]) for k, (x, (f, i)) in enumerate(T.POSITIVES.items())]
    schema = "label string, k long, findings array<string>, impressions array<string>, co array<struct<label: string, findings: array<string>, impression: string>>"
    base = real.sparkSession.createDataFrame(rows, schema).join(real.groupBy("label").agg(F.sum("n").alias("n")), "label", "left")
    need = F.greatest(F.lit(0).cast("long"), F.lit(target) - F.coalesce("n", F.lit(0)))
    each = base.withColumn("need", need).filter("need > 0").withColumn("i", F.explode(F.sequence(F.lit(1).cast("long"), F.col("need"))))
    each = each.withColumn("n", (F.col("i") - 1) * len(rows) + F.col("k"))
    n = F.col("n")
    each = each.withColumn("co", F.filter("co", lambda c: _draw(n, F.concat(F.lit("co "), c["label"]), 100) < 35))
    found = F.concat(
        F.slice(_shuffled(F.col("findings"), n, "finding"), F.lit(1), _draw(n, "findings", 3) + 1),
        F.transform("co", lambda c: _drawn(c["findings"], n, F.concat(F.lit("co finding "), c["label"]))),
        F.slice(_shuffled(_array(T.BOILERPLATE), n, "normal"), F.lit(1), _draw(n, "normals", 3) + 2),
    )
    section = F.when(_draw(n, "section", 2) == 0, _drawn(_array(T.FINDINGS_HEADERS), n, "section header")).otherwise("")
    impression = F.concat_ws(" ", _drawn(F.col("impressions"), n, "impression"), F.transform("co", lambda c: c["impression"]))
    tail = F.array(_drawn(_array(T.IMPRESSION_HEADERS), n, "impression header"), impression, _drawn(_array(T.SIGNOFFS), n, "sign-off"))
    lines = F.concat(F.array(_drawn(_array(T.HEADERS), n, "header"), section), _shuffled(found, n, "order"), tail)
    text = F.array_join(F.filter(lines, lambda x: x != ""), "\n")
    anatomy = {
        "{side}": _drawn(_array(("right", "left")), n, "side"), "{zone}": _drawn(_array(("upper", "middle", "lower")), n, "zone"),
        "{size}": ((_draw(n, "size", 46) + 15) / 10.0).cast("string"), "{ctr}": ((_draw(n, "ctr", 20) + 53) / 100.0).cast("string"),
    }
    for mark, value in anatomy.items():
        text = F.replace(text, F.lit(mark), value)
    gold = F.array_join(F.array_sort(F.array_distinct(F.concat(F.array("label"), F.transform("co", lambda c: c["label"])))), ",")
    return each.select(F.format_string("synth_%06d", n).alias("study_id"), text.alias("report_text"), gold.alias("gold_labels"), F.lit(True).alias("is_synthetic"), F.col("label").alias("primary_augmented_label"))


def hard_negatives(spark: SparkSession, labels: tuple[str, ...], per_label: int = 15) -> DataFrame:
    """(study_id, report_text, gold_labels, neg_target): reports that name a finding only to deny it; templates in turn, wording varied."""
    total = len(labels) * per_label
    n = F.col("id")
    target = _pick(labels, F.floor(n / per_label))
    body = F.replace(_pick(NEGATIVES, n), F.lit("{what}"), F.lower(target))
    for k, (old, new) in enumerate(SWAPS):
        body = F.when(F.pmod(F.floor(n / (k + 1)), F.lit(3)) == 0, F.replace(body, F.lit(old), F.lit(new))).otherwise(body)
    gap = F.when(F.pmod(n, F.lit(10)) < 3, "\n\n").otherwise("\n")
    return spark.range(total).select(
        F.format_string("hardneg_%05d", n + 90_001).alias("study_id"), F.concat(F.lit("CHEST RADIOGRAPH REPORT"), gap, body).alias("report_text"), F.lit("Normal").alias("gold_labels"), target.alias("neg_target")
    )


def _replace_first(text: Column, old: Column, new: Column) -> Column:
    at = F.position(old, text)
    return F.when(at > 0, F.concat(F.substr(text, F.lit(1), at - 1), new, F.substr(text, at + F.length(old)))).otherwise(text)


def varied_negatives(spark: SparkSession, per_label: int = 15) -> DataFrame:
    """(study_id, report_text, gold_labels, is_synthetic, neg_target): every label's own templates in turn, with their gold labels.

    A drawn header, 0 to 2 drawn wordings among those that occur in the text, and with 30 in 100 a blank line after the header.
    """
    labels = list(dict.fromkeys(x for x, _, _ in T.HARD_NEGATIVES))
    rows = [(k, x, [(g, t) for y, g, t in T.HARD_NEGATIVES if y == x]) for k, x in enumerate(labels)]
    base = spark.createDataFrame(rows, "k long, label string, options array<struct<gold: string, text: string>>")
    each = base.select("label", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(per_label - 1).cast("long"))).alias("i"), "k", "options")
    each = each.withColumn("n", F.col("k") * per_label + F.col("i")).withColumn("t", F.element_at("options", (F.col("i") % F.size("options") + 1).cast("int")))
    n, text = F.col("n"), F.col("t.text")
    header = _drawn(_array(T.NEGATIVE_HEADERS), n, "header")
    own = F.element_at(F.filter(_array((*T.NEGATIVE_HEADERS, "")), lambda h: F.contains(F.col("t.text"), h)), 1)
    each = each.withColumn("x", F.when(own == "", text).otherwise(_replace_first(text, own, header)))
    swaps = F.array(*[F.struct(F.lit(a).alias("old"), F.lit(b).alias("new")) for a, b in T.NEGATIVE_SWAPS])
    fitting = F.filter(swaps, lambda s: F.contains(F.col("x"), s["old"]))
    keyed = F.array_sort(F.transform(fitting, lambda s: F.struct(F.md5(F.concat_ws(":", n.cast("string"), F.lit("swap"), s["old"])).alias("h"), s.alias("s"))))
    each = each.withColumn("swaps", F.slice(keyed, F.lit(1), _draw(n, "swaps", 3)))
    each = each.withColumn("x", F.aggregate("swaps", F.col("x"), lambda x, w: _replace_first(x, w["s"]["old"], w["s"]["new"])))
    gap = F.when(_draw(n, "gap", 100) < 30, _replace_first(F.col("x"), F.lit("\n"), F.lit("\n\n"))).otherwise(F.col("x"))
    return each.select(F.format_string("hardneg_%05d", n + 90_001).alias("study_id"), gap.alias("report_text"), F.col("t.gold").alias("gold_labels"), F.lit(True).alias("is_synthetic"), F.col("label").alias("neg_target"))


def merge(*parts: DataFrame) -> DataFrame:
    """Union of corpora by column name; a missing neg_target is empty."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out.withColumn("neg_target", F.coalesce("neg_target", F.lit(""))) if "neg_target" in out.columns else out.withColumn("neg_target", F.lit(""))
