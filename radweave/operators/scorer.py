"""Hooks for outside models: any scorer of text batches as a DataFrame operator."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from typing import Protocol

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from radweave.functions.text import is_blank


class Scorer(Protocol):
    """What a model must offer: probabilities per label for a batch of texts."""

    def predict(self, texts: Sequence[str]) -> Sequence[dict[str, float]]: ...


def score_texts(df: DataFrame, load: Callable[[int], Scorer], folds: Sequence[int], key: str = "study_id", text: str = "report_text", batch_size: int = 16) -> DataFrame:
    """(key, fold, label, prob): the score table of the models ``load(fold)`` returns.

    Each Python worker loads a model once per task and feeds it batches of whole texts. Blank and null texts
    are not scored; probabilities are rounded to four places. No folds is an error.
    """
    if not folds:
        raise FileNotFoundError("no model folds")
    kind = df.select(key).schema[0].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        models = {f: load(f) for f in folds}
        for batch in batches:
            texts = batch.column(1).to_pylist()
            rows, fold, label, prob = [], [], [], []
            for lo in range(0, len(texts), batch_size):
                part = texts[lo : lo + batch_size]
                for f, model in models.items():
                    for i, scores in enumerate(model.predict(part), lo):
                        for name, p in scores.items():
                            rows.append(i)
                            fold.append(f)
                            label.append(name)
                            prob.append(round(float(p), 4))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(rows, pa.int64())), pa.array(fold, pa.int32()), pa.array(label, pa.string()), pa.array(prob, pa.float64())], names=[key, "fold", "label", "prob"]
            )

    return df.filter(~is_blank(F.col(text))).select(F.col(key), F.col(text)).mapInArrow(run, f"`{key}` {kind}, fold int, label string, prob double")


class EntityFinder(Protocol):
    """What a span model must offer: (start, end, label) lists for a batch of texts."""

    def find(self, texts: Sequence[str]) -> Sequence[Sequence[tuple[int, int, str]]]: ...


def entity_texts(df: DataFrame, load: Callable[[], EntityFinder], key: str = "study_id", text: str = "report_text", batch_size: int = 16) -> DataFrame:
    """(key, start_at, end_at, label): the spans that a model finds; blank and null texts have none."""
    kind = df.select(key).schema[0].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load()
        for batch in batches:
            texts = batch.column(1).to_pylist()
            rows, out = [], []
            for lo in range(0, len(texts), batch_size):
                for i, spans in enumerate(model.find(texts[lo : lo + batch_size]), lo):
                    rows += [i] * len(spans)
                    out += spans
            start, end, label = zip(*out) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(rows, pa.int64())), pa.array(start, pa.int32()), pa.array(end, pa.int32()), pa.array(label, pa.string())], names=[key, "start_at", "end_at", "label"]
            )

    return df.filter(~is_blank(F.col(text))).select(F.col(key), F.col(text)).mapInArrow(run, f"`{key}` {kind}, start_at int, end_at int, label string")
