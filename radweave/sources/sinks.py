"""Sinks: delimited files, JSON, Parquet, grey-level images."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def write_csv(df: DataFrame, path: str) -> None:
    """Delimited files that ``read_csv`` reads back: header, quotes doubled, line ends kept inside quotes."""
    df.write.mode("overwrite").csv(path, header=True, quote='"', escape='"', quoteAll=True, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)


def write_json(df: DataFrame, path: str) -> None:
    """One JSON object per row."""
    df.write.mode("overwrite").json(path)


def write_files(df: DataFrame, root: str, name: str, content: str) -> int:
    """One file a row below ``root`` (a URI of shared storage): ``name`` may hold folders, ``content`` is text. Gives the number of files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fs, base = pafs.FileSystem.from_uri(root)
            for n, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                fs.create_dir(f"{base}/{n}".rsplit("/", 1)[0], recursive=True)
                with fs.open_output_stream(f"{base}/{n}") as f:
                    f.write((text or "").encode("utf-8"))
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], names=["n"])

    return df.select(name, content).mapInArrow(run, "n long").agg(F.sum("n")).first()[0] or 0


def write_parquet(df: DataFrame, path: str, *partition_by: str) -> None:
    """Parquet, in folders per value of the partition columns."""
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def grey_levels(image: Column) -> Column:
    """0..1 pixels as 16-bit grey levels."""
    return F.transform(image, lambda x: F.floor(F.greatest(F.lit(0.0), F.least(F.lit(1.0), x.cast("double"))) * 65535).cast("int"))


def write_images(df: DataFrame, path: str, key: str = "study_id", image: str = "image") -> None:
    """Images as arrays of grey levels, one row each; every task writes its own files."""
    write_parquet(df.select(key, grey_levels(F.col(image)).alias(image)), path)
