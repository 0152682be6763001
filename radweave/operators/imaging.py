"""Image arrays: clipping, scaling, resizing and padding."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from radweave.functions.barrier import let, once


def array_quantile(a: Column, q: float) -> Column:
    """Linear-interpolated quantile of an array column."""
    at = (F.size(a) - 1) * q
    lo = F.floor(at).cast("int")

    def between(s: Column) -> Column:
        low, high = F.get(s, lo), F.get(s, F.least(lo + 1, F.size(a) - 1))
        return low + (high - low) * (at - lo)

    return let(F.sort_array(F.transform(a, lambda x: x.cast("double"))), between)


def clip_and_normalise(df: DataFrame, pixels: str, out: str, low: float = 0.01, high: float = 0.99) -> DataFrame:
    """Adds ``out``: values clipped to two quantiles and scaled to 0..1 over their range (plus 1e-6).

    A null array stays null, an empty one empty.
    """
    df = once(df, __p=array_quantile(F.col(pixels), low), __q=array_quantile(F.col(pixels), high))
    p, q = F.col("__p"), F.col("__q")
    return once(df, **{out: F.transform(pixels, lambda x: (F.greatest(p, F.least(q, x.cast("double"))) - p) / (q - p + 1e-6))}).drop("__p", "__q")


def resize_with_padding(image: np.ndarray, size: tuple[int, int] = (512, 512)) -> np.ndarray:
    """Aspect-keeping bilinear resize (half-pixel centres), centred on zeros; a 2-D array is required."""
    if image.ndim != 2:
        raise ValueError("a 2-D image is required")
    h, w = image.shape
    scale = min(size[0] / h, size[1] / w)
    nh, nw = max(1, int(h * scale)), max(1, int(w * scale))

    def axis(n: int, m: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        at = np.clip((np.arange(m) + 0.5) * n / m - 0.5, 0, n - 1)
        lo = np.floor(at).astype(int)
        return lo, np.minimum(lo + 1, n - 1), at - lo

    y0, y1, fy = axis(h, nh)
    x0, x1, fx = axis(w, nw)
    top = image[y0][:, x0] * (1 - fx) + image[y0][:, x1] * fx
    bottom = image[y1][:, x0] * (1 - fx) + image[y1][:, x1] * fx
    out = np.zeros(size, np.float32)
    oy, ox = (size[0] - nh) // 2, (size[1] - nw) // 2
    out[oy : oy + nh, ox : ox + nw] = top * (1 - fy)[:, None] + bottom * fy[:, None]
    return out


def to_uint16(image: np.ndarray) -> np.ndarray:
    """0..1 values as 16-bit grey levels."""
    return (np.clip(image, 0, 1) * 65535).astype(np.uint16)


def preprocess(df: DataFrame, key: str, pixels: str, height: int, width: int, size: tuple[int, int], chest: Column | None = None, existing: DataFrame | None = None) -> DataFrame:
    """(key, status, image): normalised, resized and padded pixels as a flat array, by Arrow batches.

    A row whose pixels are null or of another length has a status and no image; so has one that is no chest view by
    ``chest`` ("not chest"), or whose key ``existing`` already holds ("exists"); these are not worked on.
    """
    if chest is not None or existing is not None:
        why = F.lit(None).cast("string")
        if existing is not None:
            df = df.join(existing.select(F.col(key), F.lit(True).alias("__done")).distinct(), key, "left")
            why = F.when(F.col("__done"), "exists")
        if chest is not None:
            why = F.when(why.isNull() & ~F.coalesce(chest, F.lit(False)), "not chest").otherwise(why)
        marked = df.withColumn("__why", why)
        rest = marked.filter("__why is not null").select(key, F.col("__why").alias("status"), F.lit(None).cast("array<float>").alias("image"))
        return preprocess(marked.filter("__why is null"), key, pixels, height, width, size).unionByName(rest)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            status, images = [], []
            for p in batch[pixels]:
                if p is None or len(p) != height * width:
                    status.append("skipped")
                    images.append(None)
                    continue
                a = np.asarray(p, np.float64)
                lo, hi = np.percentile(a, [1, 99])
                a = ((np.clip(a, lo, hi) - lo) / (hi - lo + 1e-6)).astype(np.float32).reshape(height, width)
                status.append("ok")
                images.append(resize_with_padding(a, size).ravel().tolist())
            yield pd.DataFrame({key: batch[key], "status": status, "image": images})

    kind = df.select(key).schema[0].dataType.simpleString()
    return df.select(key, pixels).mapInPandas(run, f"{key} {kind}, status string, image array<float>")
