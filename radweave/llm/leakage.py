"""Evaluation passages inside a corpus: prefix-filtered set join on word shingles.

A document contains an item if ``run`` consecutive words of the item's passage
stand in it without a gap.  Every such window of words is a set of
``run - width + 1`` shingles, all of which the document must hold, so one shingle
per window, the rarest, is a sufficient prefix (containment 1 leaves a prefix of
one token).

1. The items' shingles form the vocabulary.  One pass over the corpus keeps, of
   every document, the stretches in which ``run - width + 1`` neighbouring
   shingles belong to the vocabulary (the length bound: no shorter stretch can
   hold a window), with the words of the stretch, and counts in how many
   documents every vocabulary shingle occurs.
2. Shingles are ordered by that rarity; each item window keeps its rarest one as
   prefix token with its offset.
3. The places of prefix tokens, each with the few words around it, are joined to the
   windows; the positional bound drops a pair whose window would leave the
   stretch; the words themselves are compared.  Windows are broadcast up to a
   counted ``BROADCAST_WINDOWS``; beyond it both sides are sorted by token, and a
   token that most documents hold is split by the adaptive skew join.

The vocabulary is sent to the executors only up to ``block`` shingles; a larger
item set is worked through in blocks of items, each against all documents.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from radweave.llm import words
from radweave.scratch import settle

BLOCK = 2_000_000
#: Windows sent to every executor at most: about 250 bytes each.
BROADCAST_WINDOWS = 200_000


def _scan(vocabulary, run: int, width: int):
    """Per batch: rows (id, stretch words) and rows (token, number of documents)."""
    need = run - width + 1

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = vocabulary.value
        gate = np.zeros(1 << 20, bool)
        gate[(known >> np.uint64(44)).astype(np.int64)] = True
        seen = np.zeros(len(known), np.int64)
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            texts = batch.column(1).to_pylist()
            for lo, hi in words.chunks(texts):
                b = words.Batch(texts[lo:hi])
                sh, first = b.shingles(width)
                maybe = np.flatnonzero(gate[(sh >> np.uint64(44)).astype(np.int64)])
                at = np.minimum(np.searchsorted(known, sh[maybe]), max(0, len(known) - 1))
                right = known[at] == sh[maybe] if len(known) else np.zeros(0, bool)
                maybe, at = maybe[right], at[right]
                if not len(maybe):
                    continue
                owner = np.searchsorted(first, maybe, "right") - 1
                pair = np.unique(owner * np.int64(len(known)) + at)
                np.add.at(seen, pair % len(known), 1)
                new = np.r_[True, (maybe[1:] != maybe[:-1] + 1) | (owner[1:] != owner[:-1])]
                begin = np.flatnonzero(new)
                size = np.diff(np.r_[begin, len(maybe)])
                out: list[list] = [[], []]
                read, own = -1, []
                for s, n in zip(begin[size >= need], size[size >= need]):
                    o = int(owner[s])
                    if o != read:
                        read, own = o, words.word_list(texts[lo + o])
                    start = int(maybe[s] - first[o])
                    out[0].append(ids[lo + o])
                    out[1].append(own[start : start + int(n) + width - 1])
                if out[0]:
                    yield _batch(out[0], out[1], None, None)
        hit = np.flatnonzero(seen)
        if len(hit):
            yield _batch(None, None, known[hit].view(np.int64), seen[hit])

    return scan


def _batch(ids, stretch, token, docs) -> pa.RecordBatch:
    n = len(ids) if ids is not None else len(token)
    return pa.RecordBatch.from_arrays(
        [
            pa.array(ids, pa.int64()) if ids is not None else pa.nulls(n, pa.int64()),
            pa.array(stretch, pa.list_(pa.string())) if stretch is not None else pa.nulls(n, pa.list_(pa.string())),
            pa.array(token, pa.int64()) if token is not None else pa.nulls(n, pa.int64()),
            pa.array(docs, pa.int64()) if docs is not None else pa.nulls(n, pa.int64()),
        ],
        names=["id", "stretch", "token", "docs"],
    )


def _windows(run: int, width: int, id_name: str, column: str):
    """Rows (id, words) to rows (id, at, window words, tokens) of every window; ``column`` holds the words."""

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], [], []]
            for i, text in zip(batch.column(id_name).to_pylist(), batch.column(column).to_pylist()):
                w = words.word_list(text)
                token = words.Batch([text]).shingles(width)[0].view(np.int64)
                for k in range(len(w) - run + 1):
                    for c, v in zip(out, (i, k, w[k : k + run], token[k : k + run - width + 1])):
                        c.append(v)
            yield pa.RecordBatch.from_arrays(
                [pa.array(out[0], pa.int64()), pa.array(out[1], pa.int32()), pa.array(out[2], pa.list_(pa.string())), pa.array(out[3], pa.list_(pa.int64()))],
                names=["item_id", "at", "window", "tokens"],
            )

    return windows


def _places(prefix, run: int, width: int):
    """(id, stretch) to rows (id, token, lead, near): every place of a prefix token with the words a window around it can hold.

    ``near`` starts ``lead`` words before the token; it has at most ``2 * run - width`` words, so nothing
    that the join below repeats is longer than that.
    """
    reach = run - width

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = prefix.value
        for batch in batches:
            ids, stretch = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            sh, first = words.Batch([" ".join(s) for s in stretch]).shingles(width)
            at = np.minimum(np.searchsorted(known, sh), max(0, len(known) - 1))
            hit = np.flatnonzero(known[at] == sh) if len(known) else np.zeros(0, np.int64)
            owner = np.searchsorted(first, hit, "right") - 1
            place = hit - first[owner]
            lead = np.minimum(place, reach)
            near = [stretch[o][p - a : p + run] for o, p, a in zip(owner.tolist(), place.tolist(), lead.tolist())]
            yield pa.RecordBatch.from_arrays(
                [pa.array([ids[o] for o in owner.tolist()], pa.int64()), pa.array(sh[hit].view(np.int64)), pa.array(lead.astype(np.int32)), pa.array(near, pa.list_(pa.string()))],
                names=["id", "token", "lead", "near"],
            )

    return places


def leaks(texts: DataFrame, items: DataFrame, run: int = 10, width: int = 3, block: int = BLOCK) -> DataFrame:
    """(id, item_id, n_windows): every item with a window of ``run`` words in a text, and how many of its windows occur.

    ``texts`` has (id, text), ``items`` (item_id, text).  Null and short texts or
    passages contain nothing and are contained nowhere; equal passages under two
    item ids are both reported; repeated rows add nothing; either table may be empty.
    """
    spark = texts.sparkSession
    texts = texts.select(F.col("id").cast("long").alias("id"), F.col("text").cast("string").alias("text")).filter("id is not null and text is not null")
    items = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).filter("item_id is not null and text is not null")
    window_type = "item_id long, at int, window array<string>, tokens array<long>"
    windows = settle(items.mapInArrow(_windows(run, width, "item_id", "text"), window_type), "windows")
    many = windows.select(F.sum(F.size("tokens"))).first()[0] or 0
    blocks = max(1, -(-many // block))
    out = None
    for k in range(blocks):
        own = windows if blocks == 1 else windows.filter(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == k)
        one = _leaks_of(spark, texts, own, run, width)
        out = one if out is None else out.unionByName(one)
    return out


def _leaks_of(spark, texts: DataFrame, windows: DataFrame, run: int, width: int) -> DataFrame:
    tokens = windows.select(F.explode("tokens").alias("token")).distinct().toArrow()["token"].to_numpy()
    known = spark.sparkContext.broadcast(np.sort(tokens.view(np.uint64)))
    scanned = settle(texts.mapInArrow(_scan(known, run, width), "id long, stretch array<string>, token long, docs long"), "scan")
    rarity = scanned.filter("token is not null").groupBy("token").agg(F.sum("docs").alias("docs"))
    ranked = (
        windows.select("item_id", "at", "window", F.posexplode("tokens").alias("offset", "token"))
        .join(rarity, "token", "left")
        .groupBy("item_id", "at", "window")
        .agg(F.min(F.struct(F.coalesce("docs", F.lit(0)).alias("docs"), "token", "offset")).alias("best"))
        .filter("best.docs > 0")
        .select("item_id", "at", "window", F.col("best.token").alias("token"), F.col("best.offset").alias("offset"))
    )
    ranked = settle(ranked, "prefixes")
    few = ranked.count() <= BROADCAST_WINDOWS
    prefix = spark.sparkContext.broadcast(np.sort(ranked.select("token").distinct().toArrow()["token"].to_numpy().view(np.uint64)))
    stretch = scanned.filter("id is not null").select("id", "stretch")
    place = stretch.mapInArrow(_places(prefix, run, width), "id long, token long, lead int, near array<string>")
    met = place.join(F.broadcast(ranked) if few else ranked.hint("merge"), "token").withColumn("begin", F.col("lead") - F.col("offset"))
    met = met.filter((F.col("begin") >= 0) & (F.col("begin") + run <= F.size("near")))
    exact = met.filter(F.slice("near", F.col("begin") + 1, run) == F.col("window"))
    return exact.groupBy("id", "item_id").agg(F.countDistinct("at").alias("n_windows"))
