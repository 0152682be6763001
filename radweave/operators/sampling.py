"""Samples, positions and exclusions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from radweave.scratch import settle


def draw(key: Column, seed: str = "42") -> Column:
    """Pseudo-random order of records that needs no state: a hash of key and seed."""
    return F.md5(F.concat(key.cast("string"), F.lit(seed)))


def fixed_sample(df: DataFrame, key: str, n: int, seed: str = "42") -> DataFrame:
    """The n records first in drawn order with their place 1..n; an error if there are fewer. A distributed top-k."""
    if df.limit(n).count() < n:
        raise ValueError(f"fewer than {n} records to sample from")
    top = df.withColumn("draw", draw(F.col(key), seed)).orderBy("draw", key).limit(n)
    out = top.withColumn("sample_no", F.row_number().over(W.orderBy("draw", key)))  # n rows at most
    return out.drop("draw")


def sample_size(z: float = 1.96, p: float = 0.5, error: float = 0.03, population: int | None = None) -> int:
    """Cochran's sample size, corrected for a finite population."""
    n = z * z * p * (1 - p) / (error * error)
    return round(n if population is None else n / (1 + (n - 1) / population))


def pick_size(available: int, earlier: int | None = None, usual: int = 500) -> int:
    """Size of a sample: that of an earlier one, else the usual, never more than there is."""
    return min(earlier if earlier is not None else usual, available)


def stratified_sample(df: DataFrame, key: str, stratum: str, n: int, seed: str = "42") -> DataFrame:
    """Proportional sample: round(share * n) per stratum (halves to even), capped at its size, then trimmed or topped up to n.

    Only each stratum's n first records in drawn order go on (a window limit inside the tasks),
    so a stratum with most of all rows is never sorted as a whole in one place.
    """
    size = df.groupBy(stratum).agg(F.count(F.lit(1)).alias("size"))
    total = size.agg(F.sum("size")).scalar()
    quota = size.select(stratum, F.least(F.bround(F.col("size") / total * n).cast("int"), F.col("size").cast("int")).alias("quota"))
    w = W.partitionBy(stratum).orderBy("draw", key)
    ranked = df.withColumn("draw", draw(F.col(key), seed)).withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)
    marked = ranked.join(quota, stratum).withColumn("extra", (F.col("rank") > F.col("quota")).cast("int"))
    return marked.orderBy("extra", "draw", key).limit(n).drop("extra", "draw", "rank", "quota")


def positions(df: DataFrame, *keys: str, name: str = "position") -> DataFrame:
    """Adds the 1-based place in the order of the keys without a global window: range partitions, their counts, then places inside."""
    ranged = settle(df.repartitionByRange(*[F.col(k) for k in keys]).withColumn("__part", F.spark_partition_id()), "ranged")
    count = ranged.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"))
    base = count.select("__part", (F.sum("__n").over(W.orderBy("__part")) - F.col("__n")).alias("__base"))  # a row per partition
    inside = F.row_number().over(W.partitionBy("__part").orderBy(*keys))
    return ranged.withColumn("__at", inside).join(F.broadcast(base), "__part").withColumn(name, (F.col("__base") + F.col("__at")).cast("long")).drop("__part", "__at", "__base")


def exclude(df: DataFrame, listed: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Rows kept, and the audit of listed keys: excluded or unknown."""
    keys = listed.select(key).distinct()
    audit = keys.join(df.select(key, F.lit(True).alias("known")).distinct(), key, "left").select(key, F.when(F.col("known"), "excluded").otherwise("unknown").alias("outcome"))
    return df.join(keys, key, "left_anti"), audit


def prefill_link(base: str, **values: Column) -> Column:
    """URL with encoded query values."""
    parts = [F.concat(F.lit(k + "="), F.url_encode(F.coalesce(v.cast("string"), F.lit("")))) for k, v in values.items()]
    return F.concat(F.lit(base + "?"), F.concat_ws("&", *parts))
