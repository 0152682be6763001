"""Command line.

    python -m radweave.cli --reports-dir IN --lexicon lexicon.json --out OUT [--scores SCORES] [--checkpoint-every N] [--fresh]
    python -m radweave.cli synthetic --data ANNOTATED --out OUT [--target 200] [--review N]
    python -m radweave.cli negatives --out OUT [--per-label 15]

The first labels a folder of reports. With a table of model scores (study_id, fold, label, prob) it runs the ensemble:
prediction records, the disagreement log and the label distribution; without one the rules alone. Results are
Parquet tables below OUT, which may lie on shared storage. Reports are worked on in batches of about N, each
complete once written; a second run labels only reports that are not there yet, and --fresh starts over.
The others write template reports for rare labels and hard negatives.
"""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from radweave.operators import agreement, ensemble, rules, scores, synth
from radweave.session import ship
from radweave.sources import reports, sinks
from radweave.streaming.incremental import resume


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path exists on whatever file system it names."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


def _written(spark: SparkSession, path: str) -> bool:
    return exists(spark, f"{path}/_SUCCESS")


def batches(todo: DataFrame, key: str, size: int) -> list[DataFrame]:
    """Parts of about ``size`` rows by the hash of their key; one part for 0."""
    n = max(1, -(-todo.count() // size)) if size else 1
    return [todo if n == 1 else todo.filter(F.pmod(F.xxhash64(key), F.lit(n)) == k) for k in range(n)]


def _rules_only(part: DataFrame, lexicon: rules.Lexicon, out: str) -> None:
    labelled = rules.with_labels(part, lexicon).select(
        "study_id", rules.label_list().alias("labels"), "has_normal_phrase", "has_abnormal_cue", F.transform("results", lambda r: F.struct(r["label"].alias("label"), r["score"].alias("score"))).alias("scores")
    )
    labelled.write.mode("append").parquet(f"{out}/labels")


def _ensemble(part: DataFrame, lexicon: rules.Lexicon, averages: DataFrame, out: str) -> None:
    """Disagreements first: a batch counts as done by its predictions, and a repeated one adds no log row twice."""
    spark = part.sparkSession
    base = rules.with_labels(part, lexicon).select("study_id", F.col("study_id").alias("rec_id"), "results", "has_normal_phrase", F.lit(False).alias("blank"), F.length("report_text").alias("report_length"))
    cells = ensemble.decisions(base, averages, carry=("report_length",))
    log = ensemble.disagreements(cells).drop("rec_id")
    if _written(spark, f"{out}/disagreements"):
        log = log.join(spark.read.parquet(f"{out}/disagreements").select("study_id", "label"), ["study_id", "label"], "left_anti")
    log.write.mode("append").parquet(f"{out}/disagreements")
    ensemble.full_record(cells, "report_length").drop("rec_id").write.mode("append").parquet(f"{out}/predictions")


def extract(argv: list[str]) -> int:
    """Run the extraction and return the number of reports labelled now."""
    parser = argparse.ArgumentParser(description=__doc__)
    parser.add_argument("--reports-dir", required=True)
    parser.add_argument("--lexicon", required=True)
    parser.add_argument("--out", required=True)
    parser.add_argument("--scores", help="Parquet table of model scores; without it the rules label alone")
    parser.add_argument("--checkpoint-every", type=int, default=0, help="reports per batch; 0 for one batch")
    parser.add_argument("--fresh", action="store_true", help="ignore earlier results")
    args = parser.parse_args(argv)
    spark = ship(SparkSession.builder.appName("radweave").getOrCreate())
    lexicon = rules.Lexicon(reports.load_lexicon(spark, [args.lexicon]))
    out = args.out.rstrip("/")
    target = f"{out}/predictions" if args.scores else f"{out}/labels"
    if args.fresh:
        for path in (target, f"{out}/disagreements"):
            hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)
    todo, before = reports.scan_reports(spark, args.reports_dir), 0
    if _written(spark, target):
        before = spark.read.parquet(target).count()
        todo = resume(todo, spark.read.parquet(target), "study_id")
    averages = scores.fold_average(spark.read.parquet(args.scores)) if args.scores else None
    for part in batches(todo, "study_id", args.checkpoint_every):
        if args.scores:
            _ensemble(part, lexicon, averages, out)
        else:
            _rules_only(part, lexicon, out)
    done = spark.read.parquet(target)
    if args.scores:
        sinks.write_json(agreement.distribution(done, ensemble="final_labels", rb="rb_labels_str", bert="bert_labels_str"), f"{out}/distribution")
    return done.count() - before


def synthetic(argv: list[str]) -> int:
    """Write template reports of rare labels and return their number; --review prints some."""
    parser = argparse.ArgumentParser(prog="synthetic")
    parser.add_argument("--data", required=True, help="Parquet table with gold_labels")
    parser.add_argument("--out", required=True)
    parser.add_argument("--target", type=int, default=200)
    parser.add_argument("--review", type=int, default=0, help="reports to print")
    args = parser.parse_args(argv)
    spark = ship(SparkSession.builder.appName("radweave").getOrCreate())
    real = spark.read.parquet(args.data).select(F.explode(F.array_distinct(agreement.as_list("gold_labels"))).alias("label")).groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    sinks.write_parquet(synth.rare_positives(real, args.target), args.out)
    made = spark.read.parquet(args.out)
    for r in made.orderBy("study_id").limit(args.review).collect():
        print(f"--- {r.study_id} ({r.gold_labels})\n{r.report_text}")
    return made.count()


def negatives(argv: list[str]) -> int:
    """Write hard negatives of every label and return their number."""
    parser = argparse.ArgumentParser(prog="negatives")
    parser.add_argument("--out", required=True)
    parser.add_argument("--per-label", type=int, default=15)
    args = parser.parse_args(argv)
    spark = ship(SparkSession.builder.appName("radweave").getOrCreate())
    sinks.write_parquet(synth.varied_negatives(spark, args.per_label), args.out)
    return spark.read.parquet(args.out).count()


def main(argv: list[str] | None = None) -> int:
    """Run a command; extraction without one."""
    import sys

    args = sys.argv[1:] if argv is None else argv
    commands = {"synthetic": synthetic, "negatives": negatives, "extract": extract}
    return commands[args[0]](args[1:]) if args and args[0] in commands else extract(args)


if __name__ == "__main__":
    print(f"{main()} reports written")
