"""Incremental extraction: file streams with a checkpoint, and resume by anti-join."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def resume(todo: DataFrame, done: DataFrame, key: str = "rec_id") -> DataFrame:
    """Rows whose key is not among the processed ones."""
    return todo.join(done.select(key).distinct(), key, "left_anti")


def run_available(spark: SparkSession, source: str, schema: str, transform: Callable[[DataFrame], DataFrame], sink: str, checkpoint: str, files_per_batch: int | None = None, fmt: str = "parquet") -> DataFrame:
    """Process all files of ``source`` that the checkpoint has not seen, append the results to ``sink`` and return its table.

    The checkpoint and the file sink's own log make every file count once, also after a
    failure in the middle. Running again without new files adds nothing.
    """
    reader = spark.readStream.schema(schema).format(fmt)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    result = transform(reader.load(source))
    query = result.writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(result.schema).parquet(sink)
