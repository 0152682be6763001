"""Evaluation records that occur again, exactly or nearly, in training text.

Evaluation texts are cut into passages of three words, normalised.  Of every
text the ``n - ceil(threshold * n) + floor`` rarest distinct passages of its shard are kept:
a text whose share with it reaches the threshold holds at least ``floor`` of
them, whichever they are.  The texts lie in shards of about ``shard_passages``
passages; one task builds the Aho-Corasick automaton of a shard, once, with one code point for
every word, and leaves it with its postings in the shared folder.  Every scanning task loads a
shard and runs all its training texts through it.  Pairs with ``floor`` hits
(fewer for texts of few passages) are verified on the exact passage sets.

``evaluation_coverage`` scans with automata of all passages; the matched intervals, merged,
give how much of every evaluation record stands anywhere in training.

Equal texts are collapsed on both sides before scanning and expanded at the end.
"""

from __future__ import annotations

import hashlib
import pickle
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from radweave.llm import words
from radweave.scratch import new_path, settle

WIDTH = 3
#: Code points that stand for words: the planes above the surrogates. A word beyond them shares one, which only adds candidates.
FIRST_POINT, POINTS = 0x10000, 0x100000
UNKNOWN = "\x00"
#: Texts handled at once, and postings expanded at once.
TOGETHER, EXPANDED = 256, 4_000_000


def _normalised(min_words: int):
    """(side, id, text) to (side, id, h, norm) of the texts of at least ``min_words`` words; h stands for the word sequence."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], [], []]
            for side, i, text in zip(*(c.to_pylist() for c in batch.columns)):
                own = words.word_list(text)
                if len(own) >= max(min_words, WIDTH):
                    norm = " ".join(own)
                    for c, v in zip(out, (side, i, hashlib.blake2b(norm.encode(), digest_size=16).digest(), norm)):
                        c.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int32()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.binary()), pa.array(out[3], pa.string())], names=["side", "id", "h", "norm"])

    return run


def _distinct(train: DataFrame, evaluation: DataFrame, min_words: int) -> tuple[DataFrame, DataFrame]:
    """Members (side, id, rep) and one row (side, id, norm) per side (0 train, 1 evaluation) and word sequence."""
    one = lambda df, side: df.select(F.lit(side).alias("side"), F.col("id").cast("long").alias("id"), F.col("text").cast("string").alias("text"))
    both = one(train, 0).unionByName(one(evaluation, 1)).filter("id is not null and text is not null")
    norm = settle(both.mapInArrow(_normalised(min_words), "side int, id long, h binary, norm string"), "norm")
    single = settle(norm.groupBy("side", "h").agg(F.min(F.struct("id", "norm")).alias("s")).select("side", "h", "s.id", "s.norm"), "single")
    member = norm.select("side", "id", "h").join(single.select("side", "h", F.col("id").alias("rep")), ["side", "h"]).select("side", "id", "rep").distinct()
    return member, single.select("side", "id", "norm")


def _points(number: np.ndarray) -> np.ndarray:
    return (FIRST_POINT + number % POINTS).astype(np.uint32)


def _built(ids: list[int], texts: list[str], threshold: float, floor: int, everything: bool) -> dict:
    """Automaton, postings and needs of one shard of evaluation texts."""
    split = [t.split(" ") for t in texts]
    number: dict[str, int] = {}
    flat = np.array([number.setdefault(w, len(number)) for own in split for w in own], np.int64)
    size = np.array([len(own) for own in split])
    first = np.cumsum(size) - size
    owner = np.repeat(np.arange(len(split)), size - WIDTH + 1)
    at = np.arange(len(owner)) - np.repeat(np.cumsum(size - WIDTH + 1) - (size - WIDTH + 1), size - WIDTH + 1) + first[owner]
    base = len(number) + 1
    _, where, passage = np.unique((flat[at] * base + flat[at + 1]) * base + flat[at + 2], return_index=True, return_inverse=True)
    pair = np.unique(owner * np.int64(len(where)) + passage)
    owner, passage = pair // len(where), pair % len(where)
    n = np.bincount(owner, minlength=len(split))
    must = np.ceil(threshold * n - 1e-9).astype(np.int64)
    need = np.minimum(floor, must)
    rarity = np.bincount(passage)
    order = np.lexsort((passage, rarity[passage], owner))
    rank = np.arange(len(order)) - np.repeat(np.cumsum(n) - n, n)
    kept = order if everything else order[rank < (n - must + need)[owner[order]]]
    owner, passage = owner[kept], passage[kept]
    chosen, value = np.unique(passage, return_inverse=True)
    automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
    start = at[where[chosen]]
    spelled = _points(np.stack([flat[start + k] for k in range(WIDTH)], 1)).tobytes().decode("utf-32-le")
    for k in range(len(chosen)):
        automaton.add_word(spelled[WIDTH * k : WIDTH * k + WIDTH], k)
    automaton.make_automaton()
    order = np.argsort(value, kind="stable")
    return {
        "point": dict(zip(number, _points(np.arange(len(number))).tobytes().decode("utf-32-le"))), "automaton": automaton, "first": np.searchsorted(value[order], np.arange(len(chosen) + 1)),
        "record": owner[order], "ids": np.array(ids, np.int64), "need": need,
    }


def _shards(single: DataFrame, threshold: float, floor: int, shard_passages: int, everything: bool = False) -> tuple[str, int]:
    """Builds every shard's automaton in a task of its own and leaves it in the shared folder: (folder, number of shards)."""
    many = single.agg(F.sum(F.size(F.split("norm", " ")))).first()[0] or 0
    shards = max(1, -(-many // shard_passages))
    path = new_path(single.sparkSession, "automata")

    def build(key: tuple, table: pa.Table) -> pa.Table:
        k = key[0].as_py()
        raw = pickle.dumps(_built(table["id"].to_pylist(), table["norm"].to_pylist(), threshold, floor, everything), protocol=5)
        fs, root = pafs.FileSystem.from_uri(path)
        fs.create_dir(root, recursive=True)
        partial = f"{root}/{k}.{hashlib.blake2b(np.random.bytes(16), digest_size=8).hexdigest()}"
        with fs.open_output_stream(partial) as f:
            f.write(raw)
        fs.move(partial, f"{root}/{k}.automaton")  # a repeated task leaves the same again
        return pa.table({"shard": pa.array([k], pa.int32()), "bytes": pa.array([len(raw)], pa.int64())})

    dealt = single.select(F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int").alias("shard"), "id", "norm")
    dealt.groupBy("shard").applyInArrow(build, "shard int, bytes long").agg(F.sum("bytes")).collect()
    return path, shards


def _load(path: str, k: int) -> dict | None:
    fs, root = pafs.FileSystem.from_uri(path)
    if fs.get_file_info(f"{root}/{k}.automaton").type == pafs.FileType.NotFound:
        return None
    with fs.open_input_stream(f"{root}/{k}.automaton") as f:
        return pickle.loads(f.read())


def _pairs_of(shard: dict, text: np.ndarray, hit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text, record) with enough distinct hits, from (text, passage) hits."""
    first, record, need = shard["first"], shard["record"], shard["need"]
    both = np.unique(text * np.int64(len(first)) + hit)
    text, hit = both // len(first), both % len(first)
    size = first[hit + 1] - first[hit]
    out_text, out_record = [], []
    total = np.cumsum(size)
    lo = 0
    while lo < len(text):  # whole texts only, about EXPANDED postings at once
        hi = int(np.searchsorted(total, (total[lo - 1] if lo else 0) + EXPANDED, "right"))
        hi = max(int(np.searchsorted(text, text[lo], "right")), int(np.searchsorted(text, text[min(hi, len(text) - 1)], "left")) if hi < len(text) else len(text))
        s = size[lo:hi]
        at = np.repeat(first[hit[lo:hi]] - (np.cumsum(s) - s), s) + np.arange(s.sum())
        key, n = np.unique(np.repeat(text[lo:hi], s) * np.int64(len(need)) + record[at], return_counts=True)
        good = n >= need[key % len(need)]
        out_text.append(key[good] // len(need))
        out_record.append(key[good] % len(need))
        lo = hi
    return np.concatenate(out_text), np.concatenate(out_record)


def _scanned(shard: dict, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(text number, passage number) of all matches of the shard's automaton."""
    point, automaton = shard["point"].get, shard["automaton"]
    text, hit = [], []
    for k, t in enumerate(texts):
        own = [v for _, v in automaton.iter("".join([point(w, UNKNOWN) for w in t.split(" ")]))]
        text += [k] * len(own)
        hit += own
    return np.array(text, np.int64), np.array(hit, np.int64)


def _blocks(batches: Iterator[pa.RecordBatch], held: int) -> Iterator[tuple[list[int], list[str]]]:
    """(ids, texts) of about ``held`` characters."""
    ids: list[int] = []
    texts: list[str] = []
    total = 0
    for batch in batches:
        new = batch.column(1).to_pylist()
        ids += batch.column(0).to_pylist()
        texts += new
        total += sum(map(len, new))
        if total > held:
            yield ids, texts
            ids, texts, total = [], [], 0
    if ids:
        yield ids, texts


def _scan(path: str, shards: int, held: int):
    """(id, norm) of training texts to candidate pairs (t, e)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only = _load(path, 0) if shards == 1 else None
        for ids, texts in _blocks(batches, held):
            number = np.array(ids, np.int64)
            for k in range(shards):
                shard = only or _load(path, k)
                if shard is None:
                    continue
                for lo in range(0, len(texts), TOGETHER):
                    text, hit = _scanned(shard, texts[lo : lo + TOGETHER])
                    if len(hit):
                        t, e = _pairs_of(shard, text, hit)
                        yield pa.RecordBatch.from_arrays([pa.array(number[lo + t]), pa.array(shard["ids"][e])], names=["t", "e"])

    return run


def _seen(path: str, shards: int, held: int):
    """(id, norm) of training texts to rows (shard, passage): the passages of a shard found by this task, once each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, texts in _blocks(batches, held):
            for k in range(shards):
                shard = _load(path, k)
                if shard is None:
                    continue
                found: set[str] = set()
                point = shard["point"].get
                for t in texts:
                    w = t.split(" ")
                    for end, _ in shard["automaton"].iter("".join([point(x, UNKNOWN) for x in w])):
                        found.add(" ".join(w[end - WIDTH + 1 : end + 1]))
                yield pa.RecordBatch.from_arrays([pa.array([k] * len(found), pa.int32()), pa.array(sorted(found), pa.string())], names=["shard", "passage"])

    return run


def covered_words(own: list[str], matched: set[tuple[str, ...]]) -> int:
    """Words of a record inside the merged intervals of its matched passages."""
    covered = reach = 0
    for k, p in enumerate(zip(own, own[1:], own[2:])):
        if p in matched:
            covered += k + WIDTH - max(reach, k)
            reach = k + WIDTH
    return covered


def _verify(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], [], []]
            for t, e, x, y in zip(*(c.to_pylist() for c in batch.columns)):
                u, w = x.split(" "), y.split(" ")
                a, b = set(zip(u, u[1:], u[2:])), set(zip(w, w[1:], w[2:]))
                common = a & b
                share = len(common) / (len(a) + len(b) - len(common))
                if share >= threshold:
                    for c, v in zip(out, (t, e, share, covered_words(w, common) / len(w))):
                        c.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.float64()), pa.array(out[3], pa.float64())], names=["t", "e", "share", "coverage"])

    return run


def text_overlaps(
    train: DataFrame, evaluation: DataFrame, threshold: float = 0.75, min_words: int = 20, floor: int = 12, shard_passages: int = 1_500_000, held: int = 32_000_000
) -> DataFrame:
    """Pairs (train_id, eval_id, share, coverage) of two tables (id bigint, text string) with share >= threshold.

    share: distinct 3-word passages in both over those in either; coverage: part of
    the evaluation record's words inside passages that this training text has.  Null texts and texts
    under ``min_words`` words take no part; ids repeated inside a table count once; empty
    tables give no rows.
    """
    member, single = _distinct(train, evaluation, min_words)
    t_single, e_single = (single.filter(F.col("side") == k).select("id", "norm") for k in (0, 1))
    path, shards = _shards(e_single, threshold, floor, shard_passages)
    pairs = settle(t_single.mapInArrow(_scan(path, shards, held), "t long, e long"), "pairs")
    joined = pairs.join(t_single.select(F.col("id").alias("t"), F.col("norm").alias("x")), "t").join(e_single.select(F.col("id").alias("e"), F.col("norm").alias("y")), "e")
    exact = joined.select("t", "e", "x", "y").mapInArrow(_verify(threshold), "t long, e long, share double, coverage double")
    of = lambda k, name, rep: member.filter(F.col("side") == k).select(F.col("id").alias(name), F.col("rep").alias(rep))
    return exact.join(of(0, "train_id", "t"), "t").join(of(1, "eval_id", "e"), "e").select("train_id", "eval_id", "share", "coverage")


def evaluation_coverage(train: DataFrame, evaluation: DataFrame, min_words: int = 20, shard_passages: int = 1_500_000, held: int = 32_000_000) -> DataFrame:
    """(eval_id, n_words, coverage): part of every evaluation record's words inside 3-word passages that stand anywhere in training.

    The same texts take part as in ``text_overlaps``; one of which nothing stands in training has coverage 0.
    """
    member, single = _distinct(train, evaluation, min_words)
    t_single, e_single = (single.filter(F.col("side") == k).select("id", "norm") for k in (0, 1))
    path, shards = _shards(e_single, 1.0, 1, shard_passages, everything=True)
    seen = settle(t_single.mapInArrow(_seen(path, shards, held), "shard int, passage string").distinct(), "seen")

    def merge(records: pa.Table, found: pa.Table) -> pa.Table:
        matched = {tuple(p.split(" ")) for p in found["passage"].to_pylist()}
        own = [t.split(" ") for t in records["norm"].to_pylist()]
        return pa.table({"rep": records["id"], "n_words": pa.array([len(w) for w in own], pa.int32()), "coverage": pa.array([covered_words(w, matched) / len(w) for w in own], pa.float64())})

    dealt = e_single.select(F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int").alias("shard"), "id", "norm")
    each = dealt.groupBy("shard").cogroup(seen.groupBy("shard")).applyInArrow(merge, "rep long, n_words int, coverage double")
    return member.filter("side = 1").select(F.col("id").alias("eval_id"), "rep").join(each, "rep").select("eval_id", "n_words", "coverage")
