"""Evaluation of labels and probabilities against gold labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from radweave.functions.constants import LABELS
from radweave.functions.text import strip
from radweave.operators.scores import fold_average

#: Thresholds tried by tuning: steps added as floats, so the third is a hair above 0.15, as surveyed.
GRID = tuple(0.1 + i * 0.05 for i in range(17))


def gold_array(gold: Column) -> Column:
    """Finding labels of a comma list: stripped, without blanks and Normal; null gives none."""
    return F.filter(F.transform(F.split(F.coalesce(gold, F.lit("")), ","), lambda x: strip(x)), lambda x: (x != "") & (x != "Normal"))


def multi_hot(df: DataFrame, key: str, gold: str = "gold_labels") -> DataFrame:
    """(key, label, y) for every finding label, and Normal = 1 iff none of them is set."""
    own = F.array_intersect(gold_array(F.col(gold)), F.array(*[F.lit(x) for x in LABELS]))
    cells = [F.struct(F.lit(x).alias("label"), F.array_contains("own", x).cast("int").alias("y")) for x in LABELS]
    cells.append(F.struct(F.lit("Normal").alias("label"), (F.size("own") == 0).cast("int").alias("y")))
    return df.select(key, own.alias("own")).select(key, F.explode(F.array(*cells)).alias("c")).select(key, "c.label", "c.y")


def scored_grid(annotated: DataFrame, scores: DataFrame, lost: str = "ANON") -> DataFrame:
    """(study_id, label, y, p, fold_normal): gold and mean probability (in ten-thousandths) per study and finding label.

    A study annotated several times counts with its first record. ``lost`` marks studies whose id
    is gone: they cannot be matched and take no part.
    """
    gold = annotated.filter(F.col("study_id").isNotNull() & (F.col("study_id") != lost)).groupBy("study_id").agg(F.min_by(F.struct(F.coalesce("gold_labels", F.lit("")).alias("g")), "rec_id").alias("s"))
    both = gold.select("study_id", F.col("s.g").alias("gold_labels")).join(fold_average(scores), "study_id")
    own = gold_array(F.col("gold_labels"))
    cells = [F.struct(F.lit(x).alias("label"), F.array_contains("own", x).cast("int").alias("y"), F.element_at("probs", x).alias("prob")) for x in LABELS]
    return both.withColumn("own", own).select("study_id", "normal_prob", F.size(F.array_intersect("own", F.array(*[F.lit(x) for x in LABELS]))).alias("n_gold"), F.explode(F.array(*cells)).alias("c")).select("study_id", "normal_prob", "n_gold", "c.*")


def _safe(n: Column, d: Column) -> Column:
    return F.when(d > 0, n / d).otherwise(0.0)


def confusion(grid: DataFrame, predicted: Column) -> DataFrame:
    """Counts, precision, recall, F1 and support per label; empty denominators give 0."""
    g = grid.withColumn("hat", predicted.cast("int"))
    c = g.groupBy("label").agg(
        F.count_if((F.col("hat") == 1) & (F.col("y") == 1)).alias("tp"), F.count_if((F.col("hat") == 1) & (F.col("y") == 0)).alias("fp"),
        F.count_if((F.col("hat") == 0) & (F.col("y") == 1)).alias("fn"), F.count_if((F.col("hat") == 0) & (F.col("y") == 0)).alias("tn"),
    )
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return c.select("*", _safe(tp, tp + fp).alias("precision"), _safe(tp, tp + fn).alias("recall"), _safe(2 * tp, 2 * tp + fp + fn).alias("f1"), (tp + fn).alias("support"))


def averages(table: DataFrame) -> DataFrame:
    """Macro and weighted F1 over the labels with support."""
    t = table.filter("support > 0")
    return t.agg(F.avg("f1").alias("macro_f1"), (F.sum(F.col("f1") * F.col("support")) / F.sum("support")).alias("weighted_f1"), F.count(F.lit(1)).alias("n_labels"))


def exact_match(grid: DataFrame, predicted: Column) -> DataFrame:
    """Share of studies with all labels right."""
    per = grid.groupBy("study_id").agg(F.bool_and(predicted.cast("int") == F.col("y")).alias("ok"))
    return per.agg(F.avg(F.col("ok").cast("int")).alias("exact_match"), F.count(F.lit(1)).alias("n"))


def class_weights(hot: DataFrame) -> DataFrame:
    """neg / pos per label, clipped to 1..50; 1 for a label without positives."""
    c = hot.groupBy("label").agg(F.sum("y").alias("pos"), F.count_if(F.col("y") == 0).alias("neg"))
    return c.withColumn("weight", F.when(F.col("pos") == 0, 1.0).otherwise(F.greatest(F.lit(1.0), F.least(F.lit(50.0), F.col("neg") / F.col("pos")))))


def curve(grid: DataFrame) -> DataFrame:
    """AUROC and average precision per label; null where one class is missing.

    Equal scores are grouped first, so the windows run over distinct scores (at most 10,001 per label with
    four-place probabilities), not over rows.
    """
    by = grid.groupBy("label", "prob").agg(F.sum("y").alias("pos"), F.count_if(F.col("y") == 0).alias("neg"))
    below = W.partitionBy("label").orderBy("prob").rowsBetween(W.unboundedPreceding, -1)
    above = W.partitionBy("label").orderBy(F.desc("prob")).rowsBetween(W.unboundedPreceding, W.currentRow)
    total = W.partitionBy("label")
    w = by.select(
        "label", "pos", "neg", F.coalesce(F.sum("neg").over(below), F.lit(0)).alias("nb"), F.sum("pos").over(above).alias("tp"), F.sum("neg").over(above).alias("fp"),
        F.sum("pos").over(total).alias("P"), F.sum("neg").over(total).alias("N"),
    )
    pos = F.col("pos")
    area = F.sum(pos * (2 * F.col("nb") + F.col("neg"))) / (2.0 * F.max("P") * F.max("N"))
    prec = F.sum(pos * (F.col("tp") / (F.col("tp") + F.col("fp")))) / F.max("P")
    both = (F.max("P") > 0) & (F.max("N") > 0)
    return w.groupBy("label").agg(F.when(both, area).alias("auroc"), F.when(both, prec).alias("pr_auc"))


def tune(grid: DataFrame, *keys: str) -> DataFrame:
    """Best F1 threshold per label (and further keys) on the grid; the lowest of equals; 0.5 without positives or with F1 0.

    Rows are first counted by the number of thresholds they reach: at most 18 groups per label
    leave a task, then cumulative counts over those groups give every threshold's F1.
    """
    reached = F.size(F.filter(F.array(*[F.lit(t) for t in GRID]), lambda t: F.col("prob") >= t))
    by = grid.withColumn("k", reached).groupBy("label", *keys, "k").agg(F.sum("y").alias("pos"), F.count(F.lit(1)).alias("n"))
    sums = by.groupBy("label", *keys).agg(F.sum("pos").alias("P"), F.map_from_entries(F.collect_list(F.struct("k", F.struct("pos", "n")))).alias("m"))
    at = [
        F.struct(
            _f1(F.expr(f"aggregate(filter(map_entries(m), e -> e.key > {i}), 0L, (a, e) -> a + e.value.pos)"), F.expr(f"aggregate(filter(map_entries(m), e -> e.key > {i}), 0L, (a, e) -> a + e.value.n)")).alias("f1"),
            F.lit(-t).alias("minus"),
        )
        for i, t in enumerate(GRID)
    ]
    best = sums.withColumn("best", F.array_max(F.array(*at)))
    return best.select("label", *keys, F.when((F.col("P") == 0) | (F.col("best.f1") <= 0), 0.5).otherwise(F.round(-F.col("best.minus"), 2)).alias("threshold"))


def _f1(tp: Column, n: Column) -> Column:
    """F1 from true and all positives called, with P positives in the group."""
    return F.when(n + F.col("P") > 0, 2.0 * tp / (n + F.col("P"))).otherwise(0.0)


def losses(grid: DataFrame, gamma: float = 2.0, floor: float = 1e-6, weights: DataFrame | None = None) -> DataFrame:
    """Mean binary cross-entropy and focal loss per label; probabilities are kept off 0 and 1 by ``floor``.

    ``weights`` has (label, weight): positives count by their label's weight, by 1 where it has none.
    """
    p = F.greatest(F.lit(floor), F.least(F.lit(1.0 - floor), F.col("prob")))
    right = F.when(F.col("y") == 1, p).otherwise(1.0 - p)
    bce = -F.log(right)
    if weights is not None:
        grid = grid.join(F.broadcast(weights.select("label", "weight")), "label", "left")
        bce = bce * F.when(F.col("y") == 1, F.coalesce("weight", F.lit(1.0))).otherwise(1.0)
    return grid.groupBy("label").agg(F.avg(bce).alias("bce"), F.avg(F.pow(1.0 - right, gamma) * bce).alias("focal"))


def winner(a: Column, b: Column, margin: float = 0.01) -> Column:
    """BERT, RB or Tie by the difference of two F1 values."""
    return F.when(a - b > margin, "BERT").when(a - b < -margin, "RB").otherwise("Tie")


def fold_of(key: Column, folds: int = 5, seed: str = "42") -> Column:
    """Fold number of a record from the hash of its key: stable under any partitioning."""
    return F.pmod(F.conv(F.substring(F.md5(F.concat(key.cast("string"), F.lit(seed))), 1, 8), 16, 10).cast("long"), F.lit(folds)).cast("int")


def stratified_folds(df: DataFrame, key: str, gold: str = "gold_labels", folds: int = 5, seed: str = "42") -> DataFrame:
    """(key, fold): records of every combination of gold labels dealt out in turn, in the order of a hash of their key.

    Places come from counts of 4,096 hash ranges and the order inside one, so a combination that most
    records have is never sorted in one task.
    """
    digest = F.md5(F.concat(F.col(key).cast("string"), F.lit(seed)))
    rows = df.select(F.col(key), F.array_join(F.array_sort(F.array_distinct(gold_array(F.col(gold)))), ",").alias("stratum"), digest.alias("h")).withColumn("part", F.substring("h", 1, 3))
    count = rows.groupBy("stratum", "part").agg(F.count(F.lit(1)).alias("n"))
    base = count.select("stratum", "part", (F.sum("n").over(W.partitionBy("stratum").orderBy("part")) - F.col("n")).alias("base"))
    inside = F.row_number().over(W.partitionBy("stratum", "part").orderBy("h", key))
    placed = rows.withColumn("at", inside).join(base, ["stratum", "part"])
    return placed.select(key, F.pmod(F.col("base") + F.col("at") - 1, F.lit(folds)).cast("int").alias("fold"))
