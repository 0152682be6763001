"""Near-duplicate records: banded MinHash candidates, Bayesian pruning, exact verification.

1. Every text becomes a set of word shingles; ``bands * rows`` MinHash values
   give one key per band, a 128-bit one-bit-MinHash sketch and a content hash.
2. Copies that meet in a task collapse there, so a text that a third of all rows
   repeat leaves every task once.  The entries travel packed: a row holds up to
   ``ROW`` keys, ids and sketches of one target partition as byte planes, so
   the shuffle has little per-row cost.  Partitions follow from the counted rows: about
   ``PART_BYTES`` each.
3. Inside a partition equal keys make candidates.  Equal content collapses to
   one id at once (a star, never all pairs), the rest is compared
   sketch word by sketch word; a pair is dropped as soon as the posterior
   probability that its similarity reaches the threshold falls below ``epsilon``
   and fewer than ``epsilon`` of the pairs at the threshold are lost by it.
4. Survivors are verified on the exact shingle sets of the whole texts.

Nothing is capped.  A partition that one crowded key makes larger than ``HELD_BYTES`` is
not gathered: it passes on in numbered chunks, and every pair of its chunks is
compared in a task of its own, with the same result.  The output is links between different texts and the class of
every record; ``expand_pairs`` turns them into pairs of records where a result
asks for those.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from radweave.llm import words
from radweave.scratch import settle

BLOCK = 1 << 20
SKETCH_WORDS = 2
#: Bytes of one entry in memory: key, id, content, sketch.
ENTRY = 8 + 8 + 4 + 8 * SKETCH_WORDS
#: Entries of a packed row at most: an Arrow batch of 10,000 rows stays below 100 MB.
ROW = 256
PART_BYTES = 24 << 20
HELD_BYTES = 96 << 20
CHUNK_BYTES = 16 << 20
#: Contents remembered by a task to collapse copies; beyond it the task starts afresh.
REMEMBERED = 500_000

_PACKED = "part int, n int, keys binary, ids binary, content binary, sketch binary, a long, b long"
_CANDIDATE = "a long, b long, copy boolean, part int, chunk int, n int, keys binary, ids binary, content binary, sketch binary"


def _loss_mark(p: float, n: int, most: float) -> int:
    """Largest m such that at most the share ``most`` of binomial counts (n, p) lies below m."""
    below = 0.0
    for m in range(n + 1):
        below += math.comb(n, m) * p**m * (1 - p) ** (n - m)
        if below > most:
            return m
    return n


def pass_marks(threshold: float, epsilon: float, bits: int, words_n: int) -> list[int]:
    """Least matching sketch bits after each word for a pair to stay in.

    With a uniform prior on the similarity s, a one-bit MinHash agrees with
    probability (1 + s) / 2, so after n bits with m matches the posterior of s is
    proportional to ((1+s)/2)^m ((1-s)/2)^(n-m).  The mark is the smallest m with
    P(s >= threshold | m, n) >= epsilon, lowered where more than epsilon / words_n
    of the pairs at the threshold lie below it: all marks together lose at most
    epsilon of those, and less of more similar pairs.
    """
    grid = (np.arange(20_000) + 0.5) / 20_000
    up, down = np.log1p(grid) - math.log(2), np.log1p(-grid) - math.log(2)
    marks = []
    for k in range(1, words_n + 1):
        n = bits * k
        for m in range(n + 1):
            like = m * up + (n - m) * down
            like = np.exp(like - like.max())
            if like[grid >= threshold].sum() / like.sum() >= epsilon:
                marks.append(min(m, _loss_mark((1 + threshold) / 2, n, epsilon / words_n)))
                break
    return marks


def _planes(a: np.ndarray, keep: int) -> bytes:
    """Bytes of an integer array, plane by plane (constant high bytes compress away)."""
    return np.ascontiguousarray(a.view(np.uint8).reshape(len(a), a.itemsize)[:, :keep].T).tobytes()


def _unplanes(raw: list[bytes], keep: int, dtype: np.dtype) -> np.ndarray:
    dtype = np.dtype(dtype)
    out = np.zeros((sum(len(r) for r in raw) // keep, dtype.itemsize), np.uint8)
    at = 0
    for r in raw:
        n = len(r) // keep
        out[at : at + n, :keep] = np.frombuffer(r, np.uint8).reshape(keep, n).T
        at += n
    return out.view(dtype).ravel()


def minhash(hashes: np.ndarray, first: np.ndarray, which: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    """uint32 MinHash values [len(which), len(seeds)] of the non-empty ranges ``which``."""
    out = np.empty((len(which), len(seeds)), np.uint32)
    cut = np.stack([first[which], first[which + 1]], 1).ravel()
    if cut[-1] == len(hashes):
        cut = cut[:-1]
    for k, seed in enumerate(seeds):
        out[:, k] = np.minimum.reduceat(((hashes * seed) >> np.uint64(32)).astype(np.uint32), cut)[::2]
    return out


def _seeds(n: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(1, 1 << 63, n, dtype=np.uint64) << np.uint64(1) | np.uint64(1)


def _pack(bands: int, rows: int, width: int, min_words: int, parts: int):
    need = bands * rows
    band_seeds, sketch_seeds = _seeds(need, 11), _seeds(64 * SKETCH_WORDS, 12)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[tuple[int, int], int] = {}
        for batch in batches:
            ids_all = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            texts = batch.column(1).to_pylist()
            cols: list[list[np.ndarray]] = [[], [], [], []]
            stars: list[tuple[int, int]] = []
            for lo, hi in words.chunks(texts):
                b = words.Batch(texts[lo:hi])
                sh, first = b.shingles(width)
                which = np.flatnonzero((b.counts() >= max(min_words, width)))
                if not len(which):
                    continue
                wid = np.arange(len(sh)) - np.repeat(first[:-1], np.diff(first))
                cut = np.stack([first[which], first[which + 1]], 1).ravel()
                cut = cut[:-1] if cut[-1] == len(sh) else cut
                content = np.add.reduceat(words.mix(sh + wid.astype(np.uint64) * np.uint64(0xE7037ED1A0B428DB)), cut)[::2]
                second = np.bitwise_xor.reduceat(words.mix(sh ^ words.mix(wid.astype(np.uint64))), cut)[::2]
                fresh = np.ones(len(which), bool)
                if len(seen) > REMEMBERED:
                    seen.clear()
                for k, (c, d, i) in enumerate(zip(content.tolist(), second.tolist(), ids_all[lo:hi][which].tolist())):
                    known = seen.setdefault((c, d), i)
                    if known != i:
                        fresh[k] = False
                        stars.append((known, i))
                which, content = which[fresh], content[fresh]
                if not len(which):
                    continue
                sig = minhash(sh, first, which, band_seeds).astype(np.uint16).reshape(len(which), bands, rows)
                key = np.zeros((len(which), bands), np.uint64)
                for r in range(rows):
                    key = (key ^ sig[:, :, r]) * np.uint64(0x9E3779B97F4A7C15)
                    key ^= key >> np.uint64(29)
                key = words.mix(key + np.arange(1, bands + 1, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F))
                bit = (minhash(sh, first, which, sketch_seeds) & 1).astype(np.uint8)
                sketch = np.packbits(bit, axis=1).view(np.uint64)
                cols[0].append(key.ravel())
                cols[1].append(np.repeat(ids_all[lo:hi][which], bands))
                cols[2].append(np.repeat((content >> np.uint64(32)).astype(np.uint32), bands))
                cols[3].append(np.repeat(sketch, bands, axis=0))
            out: list[list] = [[] for _ in range(8)]
            if cols[0]:
                key, ids, content, sketch = (np.concatenate(c) for c in cols)
                part = ((key >> np.uint64(16)) % np.uint64(parts)).astype(np.int64)
                order = np.argsort(part, kind="stable")
                bounds = np.searchsorted(part[order], np.arange(parts + 1)).tolist()
                for p in np.unique(part).tolist():
                    for at in range(bounds[p], bounds[p + 1], ROW):
                        o = order[at : min(at + ROW, bounds[p + 1])]
                        for c, v in zip(out, (p, *_entry_bytes(key[o], ids[o], content[o], sketch[o]), None, None)):
                            c.append(v)
            for n, (a, b) in enumerate(stars):
                for c, v in zip(out, (n % parts, 0, None, None, None, None, a, b)):
                    c.append(v)
            kinds = (pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.binary(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], names=["part", "n", "keys", "ids", "content", "sketch", "a", "b"])

    return run


def _entry_bytes(key: np.ndarray, ids: np.ndarray, content: np.ndarray, sketch: np.ndarray) -> tuple:
    return len(key), _planes(key, 6), _planes(ids, 8), content.tobytes(), np.ascontiguousarray(sketch.T).tobytes()


def _entries(rows: list[tuple]) -> tuple[np.ndarray, ...]:
    """Key, id, content and sketch arrays of packed rows (n, keys, ids, content, sketch)."""
    key, ids = _unplanes([r[1] for r in rows], 6, np.uint64), _unplanes([r[2] for r in rows], 8, np.int64)
    content = np.concatenate([np.frombuffer(r[3], np.uint32) for r in rows])
    sketch = np.concatenate([np.frombuffer(r[4], np.uint64).reshape(SKETCH_WORDS, r[0]) for r in rows], axis=1)
    return key, ids, content, sketch


def _group_pairs(size: np.ndarray, begin: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs (i < j) of all groups, in blocks of about BLOCK pairs, without loops over small groups."""
    row_of = np.repeat(np.arange(len(size)), size)
    left = np.arange(len(row_of)) - np.repeat(np.cumsum(size) - size, size)
    todo = size[row_of] - left - 1  # partners after each member
    base = begin[row_of] + left
    live = np.flatnonzero(todo > 0)
    todo, base = todo[live], base[live]
    total = np.cumsum(todo)
    at = 0
    while at < len(todo):
        end = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + BLOCK, "right")))
        n = todo[at:end]
        i = np.repeat(base[at:end], n)
        j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n)
        yield i, j
        at = end


def _compare(rows: list[tuple], marks: list[int]) -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
    """Candidate pairs (a, b, copy) among the entries of packed rows."""
    key, ids, content, sketch = _entries(rows)
    order = np.lexsort((ids, content, key))
    key, ids, content, sketch = key[order], ids[order], content[order], sketch[:, order]
    new_key = np.r_[True, key[1:] != key[:-1]]
    new_text = new_key | np.r_[True, content[1:] != content[:-1]] | np.r_[True, (sketch[:, 1:] != sketch[:, :-1]).any(0)]
    head = np.flatnonzero(new_text)
    copy = np.flatnonzero(~new_text)
    if len(copy):
        star = np.unique(np.stack([ids[head[np.searchsorted(head, copy, "right") - 1]], ids[copy]], 1), axis=0)
        star = star[star[:, 0] != star[:, 1]]
        yield star[:, 0], star[:, 1], True
    group = np.cumsum(new_key)[head]
    begin = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    size = np.diff(np.r_[begin, len(head)])
    big = size > 1
    for a, b in _group_pairs(size[big], begin[big]):
        a, b = head[a], head[b]
        same = np.zeros(len(a), np.int64)
        for w in range(SKETCH_WORDS):
            same += 64 - np.bitwise_count(sketch[w, a] ^ sketch[w, b]).astype(np.int64)
            keep = same >= marks[w]
            a, b, same = a[keep], b[keep], same[keep]
        if len(a):
            both = np.unique(np.stack([np.minimum(ids[a], ids[b]), np.maximum(ids[a], ids[b])], 1), axis=0)
            yield both[:, 0], both[:, 1], False


def _candidates(marks: list[int], held_bytes: int, chunk_bytes: int):
    """Packed rows of one partition to candidate pairs; a partition beyond ``held_bytes`` passes on in chunks instead."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = chunk = filled = 0
        over = False

        def passed(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
            nonlocal chunk, filled
            for lo in range(0, len(rows), 512):
                own, numbers = rows[lo : lo + 512], []
                for r in own:
                    if filled >= chunk_bytes:
                        chunk, filled = chunk + 1, 0
                    filled += r[0] * ENTRY
                    numbers.append(chunk)
                yield _candidate_batch(None, None, None, numbers, own)

        for batch in batches:
            col = [c.to_pylist() for c in batch.columns]
            star = [(a, b) for a, b in zip(col[6], col[7]) if a is not None]
            if star:
                a, b = np.array(star, np.int64).T
                yield _candidate_batch(a, b, True)
            new = [(n, k, i, c, s, p) for p, n, k, i, c, s in zip(*col[:6]) if n]
            size += sum(r[0] for r in new) * ENTRY
            if over:
                yield from passed(new)
                continue
            held += new
            if size > held_bytes:
                over = True
                yield from passed(held)
                held = []
        if held:
            for a, b, copy in _compare(held, marks):
                yield _candidate_batch(a, b, copy)

    return run


def _candidate_batch(a, b, copy, numbers: list[int] | None = None, rows: list[tuple] | None = None) -> pa.RecordBatch:
    n = len(rows) if rows is not None else len(a)
    nulls = lambda t: pa.nulls(n, t)
    if rows is None:
        arrays = [pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(np.full(n, copy)), nulls(pa.int32()), nulls(pa.int32()), nulls(pa.int32())] + [nulls(pa.binary())] * 4
    else:
        arrays = [nulls(pa.int64()), nulls(pa.int64()), nulls(pa.bool_()), pa.array([r[5] for r in rows], pa.int32()), pa.array(numbers, pa.int32()), pa.array([r[0] for r in rows], pa.int32())]
        arrays += [pa.array([r[k] for r in rows], pa.binary()) for k in range(1, 5)]
    return pa.RecordBatch.from_arrays(arrays, names=["a", "b", "copy", "part", "chunk", "n", "keys", "ids", "content", "sketch"])


def _crowded(chunks: DataFrame, marks: list[int]) -> DataFrame:
    """Candidates of the partitions that passed on in chunks: one task's group per pair of chunks."""
    many = chunks.groupBy("part").agg((F.max("chunk") + 1).alias("chunks"))

    def compare(table: pa.Table) -> pa.Table:
        rows = list(zip(*(table[c].to_pylist() for c in ("n", "keys", "ids", "content", "sketch"))))
        out = [(a, b, np.full(len(a), copy)) for a, b, copy in _compare(rows, marks)]
        a, b, copy = (np.concatenate(c) for c in zip(*out)) if out else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool))
        return pa.table({"a": a, "b": b, "copy": copy})

    pair = F.transform(F.sequence(F.lit(0), F.col("chunks") - 1), lambda o: F.struct(F.least(o, "chunk").alias("i"), F.greatest(o, "chunk").alias("j")))
    each = chunks.join(many, "part").withColumn("p", F.explode(pair)).select("part", "p.i", "p.j", "n", "keys", "ids", "content", "sketch")
    return each.groupBy("part", "i", "j").applyInArrow(compare, "a long, b long, copy boolean")


def verify(width: int, threshold: float):
    """mapInArrow over (a, b, copy, text_a, text_b): exact similarity of the shingle sets; drops pairs below."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False)
            left, right = batch.column(3).to_pylist(), batch.column(4).to_pylist()
            sets: dict[str, set] = {}

            def of(text: str) -> set:
                if text not in sets:
                    if len(sets) > 256:
                        sets.clear()
                    sets[text] = words.shingle_set(text, width)
                return sets[text]

            share, same = np.zeros(len(a)), np.zeros(len(a), bool)
            for i, (x, y) in enumerate(zip(left, right)):
                if x == y:
                    share[i], same[i] = 1.0, True
                    continue
                u, v = of(x), of(y)
                k = len(u & v)
                share[i] = k / max(1, len(u) + len(v) - k)
                if share[i] == 1.0:
                    same[i] = words.word_list(x) == words.word_list(y)
            keep = share >= threshold
            yield pa.RecordBatch.from_arrays(
                [pa.array(a[keep]), pa.array(b[keep]), pa.array(share[keep]), pa.array(same[keep]), batch.column(2).filter(pa.array(keep))], names=["a", "b", "share", "same_words", "copy"]
            )

    return run


def similar_texts(
    texts: DataFrame,
    threshold: float = 0.8,
    width: int = 5,
    min_words: int = 0,
    bands: int = 25,
    rows: int = 4,
    epsilon: float = 1e-4,
    part_bytes: int = PART_BYTES,
    held_bytes: int = HELD_BYTES,
    chunk_bytes: int = CHUNK_BYTES,
) -> DataFrame:
    """Links (a, b, share, same_words) between similar rows of ``texts`` (columns id bigint, text string).

    ``a < b``.  Rows with equal word sequences (``same_words``) are linked only to
    the smallest id among them; every pair of different texts with
    share >= threshold that meets in a band is linked, each through the smallest
    id of its words.  With 25 bands of 4 rows a pair at 0.70 meets with
    probability 0.9990, at 0.75 with 0.99993; pruning loses at most ``epsilon`` of
    the pairs at ``threshold`` and less of those above.

    Null texts and texts with fewer than max(min_words, width) words have no links.
    Ids must be unique and not null; repeated texts are fine, an empty table gives
    no rows, other columns are ignored.
    """
    spark = texts.sparkSession
    texts = texts.select(F.col("id").cast("long").alias("id"), F.col("text").cast("string").alias("text")).filter("id is not null")
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-texts.count() * bands * ENTRY // part_bytes))
    marks = pass_marks(threshold, epsilon, 64, SKETCH_WORDS)
    packed = texts.mapInArrow(_pack(bands, rows, width, min_words, parts), _PACKED)
    first = settle(packed.repartitionById(parts, F.col("part")).mapInArrow(_candidates(marks, held_bytes, chunk_bytes), _CANDIDATE), "candidates")
    found = first.filter("a is not null").select("a", "b", "copy")
    chunks = first.filter("chunk is not null").select("part", "chunk", "n", "keys", "ids", "content", "sketch")
    if not chunks.isEmpty():
        found = found.unionByName(_crowded(chunks, marks))
    found = settle(found.distinct(), "pairs")
    ids = found.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    pool = settle(texts.join(ids, "id", "left_semi"), "pool")
    left = pool.select(F.col("id").alias("a"), F.col("text").alias("text_a"))
    right = pool.select(F.col("id").alias("b"), F.col("text").alias("text_b"))
    joined = found.join(left, "a").join(right, "b").select("a", "b", "copy", "text_a", "text_b")
    exact = joined.mapInArrow(verify(width, threshold), "a long, b long, share double, same_words boolean, copy boolean")
    return _smallest(settle(exact, "verified"))


def _smallest(exact: DataFrame) -> DataFrame:
    """Links through the smallest id of every class: copies hang on some id of their class in one or two steps."""
    up = exact.filter("copy and same_words").groupBy(F.col("b").alias("id")).agg(F.min("a").alias("up"))
    root = up.join(up.select(F.col("id").alias("up"), F.col("up").alias("top")), "up", "left").select("id", F.coalesce("top", "up").alias("root"))
    member = root.unionByName(root.select(F.col("root").alias("id"), "root").distinct())
    least = member.groupBy("root").agg(F.min("id").alias("rep"))
    rep = settle(member.join(least, "root").select("id", "rep"), "classes")
    copies = rep.filter("id <> rep").select(F.col("rep").alias("a"), F.col("id").alias("b"), F.lit(1.0).alias("share"), F.lit(True).alias("same_words"))
    other = exact.filter("not (copy and same_words)")
    other = other.join(rep.select(F.col("id").alias("a"), F.col("rep").alias("x")), "a", "left").join(rep.select(F.col("id").alias("b"), F.col("rep").alias("y")), "b", "left")
    other = other.select(F.coalesce("x", "a").alias("x"), F.coalesce("y", "b").alias("y"), "share", "same_words").filter("x <> y")
    return copies.unionByName(other.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "share", "same_words").distinct())


def classes(links: DataFrame) -> DataFrame:
    """(id, rep) of every row that repeats the words of a smaller id: one row per copy."""
    return links.filter("same_words").groupBy(F.col("b").alias("id")).agg(F.min("a").alias("rep"))


def expand_pairs(links: DataFrame) -> DataFrame:
    """All pairs (rec_id_a, rec_id_b, share) of records behind the links, copies included."""
    links = settle(links, "links")
    copy = classes(links)
    member = copy.unionByName(copy.select(F.col("rep").alias("id"), "rep").distinct())
    across = links.filter("not same_words")
    one = across.join(member.select(F.col("rep").alias("a"), F.col("id").alias("x")), "a", "left").select(F.coalesce("x", "a").alias("x"), "b", "share")
    two = one.join(member.select(F.col("rep").alias("b"), F.col("id").alias("y")), "b", "left").select("x", F.coalesce("y", "b").alias("y"), "share")
    inside = member.alias("m").join(member.alias("n"), F.expr("m.rep = n.rep and m.id < n.id")).select(F.col("m.id").alias("x"), F.col("n.id").alias("y"), F.lit(1.0).alias("share"))
    both = two.unionByName(inside)
    return both.select(F.least("x", "y").alias("rec_id_a"), F.greatest("x", "y").alias("rec_id_b"), "share")


def groups(pairs: DataFrame, rounds: int = 50) -> DataFrame:
    """(id, group_id): connected components of the links, smallest id as the group's id.

    Large-star / small-star steps: every round is one shuffle of the remaining
    links; a hub's neighbours attach to its minimum instead of to each other, so
    no group is ever gathered in one place.
    """
    spark = pairs.sparkSession
    edges = settle(pairs.select(F.col("a").alias("u"), F.col("b").alias("v")).filter("u <> v").distinct(), "edges")
    for _ in range(rounds):
        both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        low2 = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(low2, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").filter("u <> v").distinct()
        nxt = settle(small, "edges")
        if nxt.exceptAll(edges).isEmpty() and edges.exceptAll(nxt).isEmpty():
            edges = nxt
            break
        edges = nxt
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    member = edges.groupBy(F.col("u").alias("id")).agg(F.min("v").alias("group_id"))
    return member.unionByName(member.select(F.col("group_id").alias("id"), "group_id").distinct())


def membership(links: DataFrame) -> DataFrame:
    """(id, class_id, group_id, n_links) of every linked row: links count different texts, copies share their class's."""
    links = settle(links, "links")
    group = groups(links)
    degree = links.filter("not same_words").select(F.explode(F.array("a", "b")).alias("class_id")).groupBy("class_id").count()
    return (
        group.join(classes(links), "id", "left")
        .select("id", F.coalesce("rep", "id").alias("class_id"), "group_id")
        .join(degree, "class_id", "left")
        .select("id", "class_id", "group_id", F.coalesce("count", F.lit(0)).alias("n_links"))
    )
