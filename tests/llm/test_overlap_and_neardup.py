from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from radweave.llm import leakage, neardup, overlap, words

VOCAB = [f"w{i}" for i in range(400)]


def texts(n, seed, low=15, high=60):
    """Random texts, half of them edits of earlier ones, with odd cases."""
    r = random.Random(seed)
    out = [None, "", "É è — ", "only five words in here", "same words " * 30, "Same, WORDS! " * 30]
    while len(out) < n:
        if len(out) > 8 and r.random() < 0.5:
            w = (r.choice([t for t in out if t and len(t.split()) > 14])).split()
            for _ in range(r.randint(0, 4)):
                k = r.randrange(len(w))
                w[k : k + r.randint(0, 1)] = [r.choice(VOCAB)] * r.randint(0, 2)
            out.append(" ".join(w))
        else:
            out.append(" ".join(r.choice(VOCAB) for _ in range(r.randint(low, high))))
    return out


def brute(left, right, threshold, width, least):
    out = {}
    for i, x in left:
        a = words.shingle_set(x, width)
        if len(words.word_list(x)) < least:
            continue
        for j, y in right:
            b = words.shingle_set(y, width)
            if i == j or len(words.word_list(y)) < least:
                continue
            share = len(a & b) / len(a | b)
            if share >= threshold:
                out[i, j] = share
    return out


def frame(spark, rows, id_name="id"):
    return spark.createDataFrame(rows, f"{id_name} long, text string")


def test_batches_equal_single_texts():
    t = texts(60, 1) + ["x" * 5000, "K İ ſ ß", "a\x00b", "1 2 3"]
    b = words.Batch(t)
    sh, first = b.shingles(3)
    seen = {}
    for i, x in enumerate(t):
        w = words.word_list(x)
        assert b.counts()[i] == len(w)
        for h, s in zip(sh[first[i] : first[i + 1]].tolist(), zip(w, w[1:], w[2:])):
            assert seen.setdefault(h, s) == s
    assert len(seen) == len(set(seen.values()))
    assert [(lo, hi) for lo, hi in words.chunks(["a" * 10] * 5, 25)] == [(0, 3), (3, 5)]


@pytest.mark.parametrize(("threshold", "width", "least"), [(0.7, 3, 20), (0.8, 5, 0)])
def test_similar_pairs(spark, threshold, width, least):
    rows = list(enumerate(texts(160, 2)))
    df = frame(spark, rows).withColumn("share", F.lit("clash"))
    got = {(r.rec_id_a, r.rec_id_b): r.share for r in neardup.expand_pairs(neardup.similar_texts(df, threshold, width, least)).collect()}
    want = {k: v for k, v in brute(rows, rows, threshold, width, max(least, width)).items() if k[0] < k[1]}
    assert got.keys() == want.keys()
    assert all(abs(got[k] - v) < 1e-12 for k, v in want.items())


def test_groups_and_membership(spark):
    rows = list(enumerate(texts(160, 3)))
    links = neardup.similar_texts(frame(spark, rows), 0.7, 3, 20)
    pairs = brute(rows, rows, 0.7, 3, 20)
    parent = {i: i for k in pairs for i in k}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in pairs:
        parent[max(find(a), find(b))] = min(find(a), find(b))
    got = {r.id: r for r in neardup.membership(links).collect()}
    assert {i: r.group_id for i, r in got.items()} == {i: find(i) for i in parent}
    same = lambda i, j: words.word_list(rows[i][1]) == words.word_list(rows[j][1])
    for i, r in got.items():
        assert r.class_id == min([j for j in parent if same(i, j)])
        assert r.n_links == len({min(k for k in parent if same(j, k)) for a, j in pairs if a == i and not same(a, j)})


def test_hot_copies_collapse(spark):
    text = " ".join(VOCAB[:40])
    rows = [(i, text) for i in range(300)] + [(1000, text + " tail")]
    links = neardup.similar_texts(frame(spark, rows), 0.7, 3, 20).collect()
    assert len(links) == 300  # a star over the copies and one link between different texts
    assert sum(not r.same_words for r in links) == 1
    assert neardup.expand_pairs(neardup.similar_texts(frame(spark, rows), 0.7, 3, 20)).count() == 301 * 300 // 2


def test_empty_tables(spark):
    none = frame(spark, [])
    assert neardup.expand_pairs(neardup.similar_texts(none)).count() == 0
    assert overlap.text_overlaps(none, none).count() == 0
    assert overlap.text_overlaps(frame(spark, [(1, " ".join(VOCAB[:30]))]), none).count() == 0
    assert leakage.leaks(none, frame(spark, [], "item_id")).count() == 0
    assert leakage.leaks(frame(spark, [(1, "a b c")]), frame(spark, [(1, None), (2, "a b c")], "item_id")).count() == 0


def test_pass_marks_keep_similar_pairs():
    marks = neardup.pass_marks(0.7, 1e-4, 64, 2)
    rng = np.random.default_rng(1)
    hits = rng.random((20_000, 128)) < 0.85  # agreement of one-bit values at similarity 0.7
    lost = (hits[:, :64].sum(1) < marks[0]) | (hits.sum(1) < marks[1])
    assert lost.mean() < 2e-3 and marks[0] < marks[1]


@pytest.mark.parametrize("threshold", [0.5, 0.7, 0.75, 0.8, 0.9])
def test_pass_marks_lose_at_most_epsilon(threshold):
    first, second = neardup.pass_marks(threshold, 1e-4, 64, 2)
    p = (1 + threshold) / 2
    chance = [math.comb(64, k) * p**k * (1 - p) ** (64 - k) for k in range(65)]
    kept = sum(chance[a] * chance[b] for a in range(first, 65) for b in range(65) if a + b >= second)
    assert 1 - kept <= 1e-4


@pytest.mark.parametrize("shard", [300, 1_500_000])
def test_overlaps(spark, shard):
    rows = list(enumerate(texts(150, 5)))
    train, held = rows[::2], rows[1::2]
    got = {(r.train_id, r.eval_id): r for r in overlap.text_overlaps(frame(spark, train), frame(spark, held), 0.75, 20, shard_passages=shard, held=2000).collect()}
    want = brute(train, held, 0.75, 3, 20)
    assert got.keys() == want.keys()
    for (t, e), r in got.items():
        assert r.share == pytest.approx(want[t, e])
        w, other = words.word_list(dict(rows)[e]), words.shingle_set(dict(rows)[t], 3)
        covered = {k + d for k, s in enumerate(zip(w, w[1:], w[2:])) if s in other for d in range(3)}
        assert r.coverage == pytest.approx(len(covered) / len(w))


@pytest.mark.parametrize("shard", [300, 1_500_000])
def test_coverage_of_evaluation_records(spark, shard):
    rows = list(enumerate(texts(90, 6)))
    train, held = rows[::2], rows[1::2]
    seen = set().union(*(words.shingle_set(t, 3) for _, t in train if len(words.word_list(t)) >= 20))
    got = {r.eval_id: r for r in overlap.evaluation_coverage(frame(spark, train), frame(spark, held), 20, shard, 2000).collect()}
    own = {i: words.word_list(t) for i, t in held if len(words.word_list(t)) >= 20}
    assert got.keys() == own.keys()
    for i, w in own.items():
        covered = {k + d for k, s in enumerate(zip(w, w[1:], w[2:])) if s in seen for d in range(3)}
        assert got[i].n_words == len(w) and got[i].coverage == pytest.approx(len(covered) / len(w))


def test_overlap_of_copies_on_both_sides(spark):
    t = " ".join(VOCAB[:30])
    got = overlap.text_overlaps(frame(spark, [(i, t) for i in range(40)]), frame(spark, [(100 + i, t.upper()) for i in range(30)])).collect()
    assert len(got) == 1200 and all(r.share == 1.0 and r.coverage == 1.0 for r in got)


@pytest.mark.parametrize("block", [40, 10_000])
def test_leaks(spark, block):
    r = random.Random(7)
    items = [(i, " ".join(r.choice(VOCAB) for _ in range(r.randint(8, 25)))) for i in range(25)] + [(90, None), (91, ""), (92, "Ten, words; 1 2 3 4 5 6 7 8!")]
    items.append((93, items[0][1]))
    docs = [(1, None), (2, ""), (3, "ten words 1 2 3 4 5 6 7 8")]
    for i in range(10, 90):
        w = [r.choice(VOCAB) for _ in range(r.randint(0, 80))]
        for _ in range(r.randint(0, 2)):
            source = words.word_list(r.choice(items)[1])
            a = r.randint(0, max(0, len(source) - 5))
            w[len(w) // 2 : len(w) // 2] = source[a : a + r.randint(5, 20)]
        docs.append((i, " ".join(w).upper() if i % 3 == 0 else ",  ".join(w)))
    want = {}
    for d, text in docs:
        w = words.word_list(text)
        have = {tuple(w[k : k + 10]) for k in range(len(w) - 9)}
        for i, p in items:
            q = words.word_list(p)
            n = sum(tuple(q[k : k + 10]) in have for k in range(len(q) - 9))
            if n:
                want[d, i] = n
    got = leakage.leaks(frame(spark, docs + docs[5:9]), frame(spark, items, "item_id").withColumn("at", F.lit(1)), block=block)
    assert {(x.id, x.item_id): x.n_windows for x in got.collect()} == want


def test_crowded_partitions_pass_on_in_chunks(spark):
    rows = [*enumerate(texts(160, 4)), *((1_000 + i, " ".join(VOCAB[:40]) + f" tail{i}") for i in range(60))]
    df = frame(spark, rows)
    whole = sorted(map(tuple, neardup.similar_texts(df, 0.7, 3, 20).collect()))
    chunked = sorted(map(tuple, neardup.similar_texts(df, 0.7, 3, 20, held_bytes=20_000, chunk_bytes=9_000).collect()))
    assert len(whole) > 1_700 and whole == chunked
