"""Mixing sources to target weights, measured in tokens.

Every source contributes ``min(target_share * total, max_repeats * size)`` tokens,
where ``total`` is by default the size of all sources named in the targets.  A source's
records stand in a fixed pseudo-random order; whole passes are used first,
then the leading records of one more pass.  Running token sums come from two
levels (bucket totals, then order inside a bucket), so no source is sorted in
one task.

Interleaving is Pfair: the uses of a source are cut into blocks; block i of a
source with weight w is released at slot floor(i / w) and due by
ceil((i + 1) / w), and each slot takes the released block with the earliest
deadline.  At any slot every source is within one block of its share.
A block has ``block_tokens`` tokens whatever the size of the input; the schedule is written slot by
slot in one task that holds only the next block of every source.
"""

from __future__ import annotations

import base64
import heapq
import itertools
import math
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from radweave.scratch import settle

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the published splitting pattern of the byte-level BPE vocabulary.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
MAX_SOURCES = 10_000


def token_sizes(texts: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """(id, source, n_tokens) of ``texts`` (id bigint, source string, text string); null and empty texts have 0 tokens.

    The vocabulary file is read on the driver and sent to the executors: about 0.5 MB, whatever the input.
    """
    ranks = texts.sparkSession.sparkContext.broadcast(Path(tokenizer).read_bytes())

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import tiktoken

        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.value.splitlines())}
        encode = tiktoken.Encoding("mix", pat_str=SPLIT, mergeable_ranks=table, special_tokens={}).encode_ordinary
        for batch in batches:
            n = np.fromiter((len(encode(t)) if t else 0 for t in batch.column(2).to_pylist()), np.int64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n)], names=["id", "source", "n_tokens"])

    cols = [F.col("id").cast("long").alias("id"), F.col("source").cast("string").alias("source"), F.col("text").cast("string").alias("text")]
    return texts.select(*cols).mapInArrow(count, "id long, source string, n_tokens long")


def pfair_slots(blocks: dict[str, int]) -> Iterator[tuple[str, int, int]]:
    """(source, block, slot) of an earliest-deadline-first schedule with weights blocks[s] / total, in the order of slots."""
    total = sum(blocks.values())
    due: list[tuple[int, str, int]] = []
    waiting = [(0, s, 0) for s in sorted(blocks) if blocks[s]]
    heapq.heapify(waiting)
    for slot in range(total):
        while waiting and waiting[0][0] <= slot:
            _, s, i = heapq.heappop(waiting)
            heapq.heappush(due, (-(-(i + 1) * total // blocks[s]), s, i))
        deadline, s, i = heapq.heappop(due)
        assert slot < deadline
        yield s, i, slot
        if i + 1 < blocks[s]:
            heapq.heappush(waiting, ((i + 1) * total // blocks[s], s, i + 1))


def _schedule(spark: SparkSession, blocks: dict[str, int]) -> DataFrame:
    """(source, block, slot) of ``pfair_slots``, written by one task in batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            slots = pfair_slots(blocks)
            while batch.num_rows and (part := list(itertools.islice(slots, 50_000))):
                source, block, slot = zip(*part)
                yield pa.RecordBatch.from_arrays([pa.array(source, pa.string()), pa.array(block, pa.int64()), pa.array(slot, pa.int64())], names=["source", "block", "slot"])

    return settle(spark.range(0, 1, 1, 1).mapInArrow(run, "source string, block long, slot long"), "slots")


def _running(sizes: DataFrame, bucket_rows: int, seed: int) -> DataFrame:
    """Adds ``before``: tokens of the source's records earlier in its order."""
    rows = sizes.count()
    buckets = 1 << max(0, math.ceil(math.log2(max(1, rows / bucket_rows))))
    keyed = sizes.withColumn("key", F.xxhash64("id", F.lit(seed))).withColumn("bucket", F.shiftrightunsigned("key", 40).bitwiseAND(F.lit(buckets - 1)))
    totals = keyed.groupBy("source", "bucket").agg(F.sum("n_tokens").alias("t"))
    base = totals.select("source", "bucket", (F.sum("t").over(W.partitionBy("source").orderBy("bucket")) - F.col("t")).alias("base"))
    inside = W.partitionBy("source", "bucket").orderBy("key", "id").rowsBetween(W.unboundedPreceding, W.currentRow)
    ordered = keyed.withColumn("upto", F.sum("n_tokens").over(inside))
    return ordered.join(base, ["source", "bucket"]).select("id", "source", "n_tokens", (F.col("base") + F.col("upto") - F.col("n_tokens")).alias("before"))


class Mixture:
    """The chosen uses, their places and the shares of one mixture.

    ``texts`` has (id bigint, source string, text string), ``targets`` (source, target_share,
    max_repeats).  Records of a source without target, of a null source or without tokens are not
    used; a target whose source has no records gives a report row with 0 tokens; a
    null or negative share or repeat count counts as 0; ids must be unique; repeated target rows of a
    source are an error.
    """

    def __init__(
        self, texts: DataFrame, targets: DataFrame, total: int | None = None, tokenizer: str = TOKENIZER, block_tokens: int = 65_536, bucket_rows: int = 50_000, seed: int = 7
    ):
        spark: SparkSession = texts.sparkSession
        named = targets.select("source", F.greatest(F.coalesce("target_share", F.lit(0.0)), F.lit(0.0)).alias("share"), F.greatest(F.coalesce("max_repeats", F.lit(0)), F.lit(0)).cast("long").alias("most"))
        plan = named.filter("source is not null").limit(MAX_SOURCES + 1).collect()
        if len(plan) > MAX_SOURCES or len({r["source"] for r in plan}) < len(plan):
            raise ValueError(f"targets must name at most {MAX_SOURCES} sources, each once")
        sizes = settle(token_sizes(texts, tokenizer), "tokens")
        used = sizes.join(F.broadcast(spark.createDataFrame([(r["source"],) for r in plan], "source string")), "source", "left_semi").filter("n_tokens > 0 and id is not null")
        size = {r["source"]: r["t"] for r in used.groupBy("source").agg(F.sum("n_tokens").alias("t")).collect()}
        total = sum(size.values()) if total is None else total
        rows = []
        for r in plan:
            have = size.get(r["source"], 0)
            want = min(r["share"] * total, float(r["most"] * have))
            passes = int(want // have) if have else 0
            rows.append((r["source"], r["share"], r["most"], have, passes, want - passes * have if have else 0.0))
        self.quota = spark.createDataFrame(rows, "source string, share double, most long, size long, passes long, extra double")
        chosen = _running(used, bucket_rows, seed).join(F.broadcast(self.quota), "source")
        more = F.col("before") + F.col("n_tokens") / 2 <= F.col("extra")
        chosen = chosen.withColumn("repeats", F.least(F.col("passes") + more.cast("long"), F.col("most"))).filter("repeats > 0")
        self.chosen = settle(chosen.select("id", "source", "n_tokens", "before", "size", "repeats"), "chosen")
        got = {r["source"]: r["t"] for r in self.chosen.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("repeats")).alias("t")).collect()}
        self.block = block_tokens
        blocks = {s: -(-t // block_tokens) for s, t in got.items()}
        self.slots = _schedule(spark, blocks)
        self.last = spark.createDataFrame([(s, n - 1) for s, n in blocks.items()], "source string, last long")

    def uses(self) -> DataFrame:
        """(id, source, n_tokens, use_no, slot): one row per use; reading by (slot, place) is the mixture."""
        each = self.chosen.select("*", F.explode(F.sequence(F.lit(1), F.col("repeats"))).alias("use_no"))
        start = each.withColumn("place", (F.col("use_no") - 1) * F.col("size") + F.col("before"))
        start = start.withColumn("block", F.floor(F.col("place") / self.block))
        start = start.join(F.broadcast(self.last), "source").withColumn("block", F.least("block", "last"))
        return start.join(self.slots, ["source", "block"]).select("id", "source", "n_tokens", "use_no", "slot", "place")

    def rows(self) -> DataFrame:
        """(id, source, n_tokens, repeats, first_slot): one row per chosen record."""
        return self.uses().groupBy("id", "source", "n_tokens").agg(F.count(F.lit(1)).alias("repeats"), F.min("slot").alias("first_slot"))

    def report(self) -> DataFrame:
        """Per source of the targets: rows, uses, most repeats, tokens, target and actual share, and whether the repeats sufficed."""
        own = self.chosen.groupBy("source").agg(
            F.count(F.lit(1)).alias("n_rows"), F.sum("repeats").alias("n_uses"), F.max("repeats").alias("most_repeats"), F.sum(F.col("n_tokens") * F.col("repeats")).alias("tokens")
        )
        all_tokens = own.agg(F.sum("tokens")).scalar()
        zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
        joined = self.quota.join(own, "source", "left")
        return joined.select(
            "source", F.col("share").alias("target_share"), zero("n_rows"), zero("n_uses"), zero("most_repeats"), zero("tokens"),
            F.coalesce(F.col("tokens") / all_tokens, F.lit(0.0)).alias("actual_share"),
            (F.col("passes") + (F.col("extra") > 0).cast("long") < F.col("most")).alias("repeats_left"),
        )
