"""The input tables by name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from radweave.session import ship


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One Parquet table of an input folder."""
    return ship(spark).read.parquet(f"{folder}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """A scan of fewer splits than cores, dealt out to all cores; larger inputs stay as they are.

    For work that is heavy per row on a table so small that it is one file of one row group. A table with
    as many splits as cores is not shuffled.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
