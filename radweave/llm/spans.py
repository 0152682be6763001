"""Long exact spans shared between records.

A character is shared if it lies in a window of ``length`` characters that also
occurs in another record.  Every window is represented by its *minimiser*, the
smallest hash of a ``length/2``-gram inside it: equal windows have equal
minimisers, so only records meeting in a minimiser need comparing, and about one
row per ``length/4`` characters is shuffled.

1. ``_runs``: per text, the stretches of consecutive windows with one minimiser.
2. Minimisers of at least two records survive; the texts of only those records are
   read again and give each surviving stretch its characters (its context).
3. Equal contexts collapse to one that knows the smallest and largest record holding
   it, so copies never gather.  The contexts of a minimiser are its reference shard:
   a suffix automaton is built of them, and each streams through it.  The matching
   statistics against other records give the maximal spans; every span comes
   from an automaton.
4. A shard of more than ``crowd`` contexts is first cut finer: equal windows also have
   equal minimisers of longer grams, so its contexts are divided by those, and the
   parts compared as in 3.  What is crowded even by the longest gram is divided
   into automata of about ``crowd`` contexts, through each of which all contexts
   of the shard stream, in tasks of their own.
5. Shared windows become maximal character runs per record.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from radweave.llm import words
from radweave.llm.automaton import SuffixAutomaton
from radweave.scratch import settle

_NONE = np.uint64(0xFFFFFFFFFFFFFFFF)


def _points(text: str) -> np.ndarray:
    """Code points of a text."""
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of every w consecutive values, in linear time (block prefix and suffix minima)."""
    n = len(x)
    pad = -n % w
    blocks = np.concatenate([x, np.full(pad, _NONE)]).reshape(-1, w)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[: n - w + 1], ahead[w - 1 : n])


#: Gram sizes as parts of the window: shards by the first, crowded ones cut by the further ones.
GRAMS = (1 / 2, 3 / 4, 7 / 8)


def _minimisers(points: np.ndarray, length: int, level: int = 0) -> np.ndarray:
    """Minimiser of the window at every position of one concatenation of texts (windows may cross texts)."""
    gram = max(1, int(length * GRAMS[level]))
    at = np.arange(len(points) - gram + 1)
    return _sliding_min(words.range_hash(points, at, at + gram), length - gram + 1)


def _chunked(texts: list[str | None], least: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(row numbers, first offsets, code points) of texts of at least ``least`` characters, by bounded chunks."""
    keep = [i for i, t in enumerate(texts) if t and len(t) >= least]
    chosen = [texts[i] for i in keep]
    for lo, hi in words.chunks(chosen):
        parts = [_points(t) for t in chosen[lo:hi]]
        first = np.zeros(len(parts) + 1, np.int64)
        np.cumsum([len(p) for p in parts], out=first[1:])
        yield np.array(keep[lo:hi]), first, np.concatenate(parts)


def _runs(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for rows, first, points in _chunked(batch.column(1).to_pylist(), length):
                low = _minimisers(points, length)
                owner = np.repeat(np.arange(len(rows)), np.diff(first))[: len(low)]
                valid = np.arange(len(low)) + length <= first[owner + 1]
                begin = np.flatnonzero(valid & np.r_[True, (low[1:] != low[:-1]) | (owner[1:] != owner[:-1])])
                stop = np.flatnonzero(valid & np.r_[(low[1:] != low[:-1]) | (owner[1:] != owner[:-1]) | ~valid[1:], True]) + 1
                o = owner[begin]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(low[begin].view(np.int64)), pa.array(ids[rows[o]]), pa.array((begin - first[o]).astype(np.int32)), pa.array((stop - begin).astype(np.int32))],
                    names=["low", "id", "pos", "n"],
                )

    return run


def _contexts(length: int):
    """(id, text, lows, poss, ns) to one row per stretch with its digest and characters."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in range(6)]
            held = 0
            for i, text, lows, poss, ns in zip(*(c.to_pylist() for c in batch.columns)):
                for low, pos, n in zip(lows, poss, ns):
                    row = (low, i, pos, n, text[pos : pos + n - 1 + length])
                    for c, v in zip(out, row):
                        c.append(v)
                held += len(lows)
                if held > 20_000:
                    yield _context_batch(out)
                    out, held = [[] for _ in range(6)], 0
            if held:
                yield _context_batch(out)

    return run


def _context_batch(out: list[list]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.int32()), pa.array(out[3], pa.int32()), pa.array(out[4], pa.string())],
        names=["low", "id", "pos", "n", "context"],
    )


def _divided(length: int, level: int):
    """Contexts (low, digest, id, last, n, context) to their stretches by the minimisers of a longer gram."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            low, digest, first_id, last_id, _, contexts = (c.to_pylist() for c in batch.columns)
            for rows, first, points in _chunked(contexts, length):
                minimum = _minimisers(points, length, level)
                owner = np.repeat(np.arange(len(rows)), np.diff(first))[: len(minimum)]
                valid = np.arange(len(minimum)) + length <= first[owner + 1]
                edge = (minimum[1:] != minimum[:-1]) | (owner[1:] != owner[:-1])
                begin = np.flatnonzero(valid & np.r_[True, edge])
                stop = np.flatnonzero(valid & np.r_[edge | ~valid[1:], True]) + 1
                at, out = rows[owner[begin]].tolist(), [[] for _ in range(8)]
                for r, m, a, n in zip(at, minimum[begin].view(np.int64).tolist(), (begin - first[owner[begin]]).tolist(), (stop - begin).tolist()):
                    for c, v in zip(out, (low[r], digest[r], a, m, first_id[r], last_id[r], n, contexts[r][a : a + n - 1 + length])):
                        c.append(v)
                kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], names=["up_low", "up_digest", "off", "low", "id", "last", "n", "context"])

    return run


def _compare(length: int):
    """Rows (low, block, own, id, last, context, digest) sorted by low and block, own contexts first.

    The own contexts of a block make its automaton; they and all that follow stream through it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, own, automaton = None, [], None
        out: list[list] = [[], [], [], []]

        def stream(low: int, first: int, context: str, digest: int) -> None:
            for a, b in automaton.spans(context, first, length):
                for c, v in zip(out, (low, digest, a, b - length + 1)):
                    c.append(v)

        def build() -> None:
            nonlocal automaton
            automaton = SuffixAutomaton([r[2] for r in own], [r[:2] for r in own])
            for first, _, context, digest in own:
                stream(key[0], first, context, digest)

        for batch in batches:
            for low, block, mine, first, last, context, digest in zip(*(c.to_pylist() for c in batch.columns)):
                if (low, block) != key:
                    if own and automaton is None:
                        build()
                    key, own, automaton = (low, block), [], None
                if mine:
                    own.append((first, last, context, digest))
                elif own:
                    if automaton is None:
                        build()
                    stream(low, first, context, digest)
            yield _hit_batch(out)
            out = [[], [], [], []]
        if own and automaton is None:
            build()
        yield _hit_batch(out)

    return run


def _hit_batch(out: list[list]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.int32()), pa.array(out[3], pa.int32())], names=["low", "digest", "a", "b"])


_HIT = "low long, digest long, a int, b int"


def _hits(contexts: DataFrame, length: int, crowd: int, level: int = 0) -> DataFrame:
    """Shared windows (low, digest, a, b) of contexts unique by (low, digest)."""
    size = contexts.groupBy("low").agg(F.count(F.lit(1)).alias("contexts"), F.min("id").alias("p"), F.max("last").alias("q")).filter("p <> q").select("low", "contexts")
    live = contexts.join(size, "low")
    last_level = level + 1 == len(GRAMS)
    fits = live if last_level else live.filter(F.col("contexts") <= crowd)
    blocks = F.ceil(F.col("contexts") / crowd).cast("int")
    dealt = fits.withColumn("home", F.pmod(F.xxhash64("digest"), blocks).cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0), blocks - 1)))
    dealt = dealt.select("low", "block", (F.col("home") == F.col("block")).alias("own"), "id", "last", "context", "digest")
    found = dealt.repartition("low", "block").sortWithinPartitions("low", "block", F.desc("own")).mapInArrow(_compare(length), _HIT)
    if last_level or size.filter(F.col("contexts") > crowd).isEmpty():
        return found
    crowded = live.filter(F.col("contexts") > crowd).select("low", "digest", "id", "last", "n", "context")
    kind = "up_low long, up_digest long, off int, low long, id long, last long, n int, context string"
    parts = settle(crowded.mapInArrow(_divided(length, level + 1), kind).withColumn("digest", F.xxhash64("low", "context", F.md5("context"))), "divided")
    unique = parts.groupBy("low", "digest").agg(F.min("id").alias("id"), F.max("last").alias("last"), F.min("n").alias("n"), F.min("context").alias("context"))
    inner = _hits(settle(unique, "parts"), length, crowd, level + 1)
    back = parts.join(inner, ["low", "digest"]).select(F.col("up_low").alias("low"), F.col("up_digest").alias("digest"), (F.col("off") + F.col("a")).alias("a"), (F.col("off") + F.col("b")).alias("b"))
    return found.unionByName(back)


def shared_spans(texts: DataFrame, length: int = 300, crowd: int = 200) -> DataFrame:
    """Maximal shared runs (id, start_at, end_at) of ``texts`` (columns id bigint, text string).

    Positions count code points, ``end_at`` is exclusive.  Null, empty and short texts
    have none; repetition inside one record does not count; rows with the same id are
    one record's repeats and do not share with each other; an empty table gives no rows.
    ``crowd`` sets how many contexts share an automaton, not what is found.
    """
    texts = texts.select(F.col("id").cast("long").alias("id"), F.col("text").cast("string").alias("text")).filter("id is not null")
    long_ones = texts.filter(F.length("text") >= length)
    runs = settle(long_ones.mapInArrow(_runs(length), "low long, id long, pos int, n int"), "runs")
    meeting = runs.groupBy("low").agg(F.min("id").alias("p"), F.max("id").alias("q")).filter("p <> q").select("low")
    live = runs.join(meeting, "low", "left_semi")
    per_text = live.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("pos", "low", "n"))).alias("s"))
    per_text = per_text.select("id", F.col("s.low").alias("lows"), F.col("s.pos").alias("poss"), F.col("s.n").alias("ns"))
    read_again = long_ones.join(per_text, "id").select("id", "text", "lows", "poss", "ns")
    stretch = read_again.mapInArrow(_contexts(length), "low long, id long, pos int, n int, context string")
    stretch = settle(stretch.withColumn("digest", F.xxhash64("low", "context", F.md5("context"))), "stretches")
    unique = stretch.groupBy("low", "digest").agg(F.min("id").alias("id"), F.max("id").alias("last"), F.min("n").alias("n"), F.min("context").alias("context"))
    hits = _hits(settle(unique, "contexts"), length, crowd)
    span = stretch.select("low", "digest", "id", "pos").join(hits, ["low", "digest"])
    span = span.select("id", (F.col("pos") + F.col("a")).alias("start_at"), (F.col("pos") + F.col("b") - 1 + length).alias("end_at"))
    return merge_intervals(span)


def merge_intervals(span: DataFrame) -> DataFrame:
    """Union of overlapping or touching intervals (start_at, end_at) per id."""
    before = W.partitionBy("id").orderBy("start_at", "end_at").rowsBetween(W.unboundedPreceding, -1)
    upto = W.partitionBy("id").orderBy("start_at", "end_at").rowsBetween(W.unboundedPreceding, 0)
    fresh = span.withColumn("fresh", F.coalesce((F.col("start_at") > F.max("end_at").over(before)).cast("int"), F.lit(1)))
    island = fresh.withColumn("island", F.sum("fresh").over(upto))
    return island.groupBy("id", "island").agg(F.min("start_at").alias("start_at"), F.max("end_at").alias("end_at")).drop("island")


def shared_share(texts: DataFrame, spans: DataFrame) -> DataFrame:
    """Per record: its length, number of shared runs, shared characters and their share (0 for an empty text, null for a null one)."""
    total = spans.groupBy("id").agg(F.count(F.lit(1)).alias("n_spans"), F.sum(F.col("end_at") - F.col("start_at")).alias("shared_chars"))
    size = texts.select("id", F.length("text").alias("n_chars"))
    filled = size.join(total, "id", "left").select("id", "n_chars", F.coalesce("n_spans", F.lit(0)).alias("n_spans"), F.coalesce("shared_chars", F.lit(0)).alias("shared_chars"))
    return filled.withColumn("shared_share", F.when(F.col("n_chars") > 0, F.col("shared_chars") / F.col("n_chars")).when(F.col("n_chars") == 0, F.lit(0.0)))
