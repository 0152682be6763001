from __future__ import annotations

import random
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from radweave.llm import mixing, pii, pii_table, spans


def brute(rows, n):
    first, shared = {}, set()
    for i, t in rows:
        for p in range(len(t or "") - n + 1):
            g = t[p : p + n]
            if first.setdefault(g, i) != i:
                shared.add(g)
    out = set()
    for i, t in rows:
        run = None
        for p in range(len(t or "") - n + 1):
            if t[p : p + n] in shared:
                if run and p <= run[1]:
                    run[1] = p + n
                else:
                    if run:
                        out.add((i, *run))
                    run = [p, p + n]
        if run:
            out.add((i, *run))
    return out


@pytest.mark.parametrize("crowd", [1, 500])
@pytest.mark.parametrize("n", [20, 31])
def test_shared_spans(spark, n, crowd):
    r = random.Random(n)
    pool = ["".join(r.choice("abcé \U0001f600") for _ in range(r.randint(5, 60))) for _ in range(12)] + ["ab" * 40, "x" * 50]
    rows = [(1, None), (2, ""), (3, "short"), (4, "ab" * 60), (5, "x" * 30)]
    rows += [(i, "".join(r.choice(pool) if r.random() < 0.4 else "".join(r.choice("defghij") for _ in range(r.randint(1, 40))) for _ in range(r.randint(1, 8)))) for i in range(10, 70)]
    df = spark.createDataFrame(rows, "id long, text string").withColumn("pos", F.lit(1))
    got = spans.shared_spans(df, n, crowd)
    assert {(x.id, x.start_at, x.end_at) for x in got.collect()} == brute(rows, n)
    share = {x.id: x for x in spans.shared_share(df, got).collect()}
    assert len(share) == len(rows) and share[1].shared_share is None and share[2].shared_share == 0.0
    assert all(x.shared_chars <= x.n_chars for x in share.values() if x.n_chars is not None)


def test_spans_of_copies_and_nothing(spark):
    r = random.Random(1)
    t = "".join(r.choice("abcdef") for _ in range(500))
    df = spark.createDataFrame([(i, t) for i in range(50)], "id long, text string")
    assert {(x.start_at, x.end_at) for x in spans.shared_spans(df, 300).collect()} == {(0, 500)}
    assert spans.shared_spans(df.filter("id = 1"), 300).count() == 0
    assert spans.shared_spans(df.limit(0), 300).count() == 0
    twice = spark.createDataFrame([(1, t), (1, t), (2, t[:400])], "id long, text string")
    assert {(x.id, x.start_at, x.end_at) for x in spans.shared_spans(twice, 300).collect()} == {(1, 0, 400), (2, 0, 400)}
    assert spans.shared_spans(twice.filter("id = 1"), 300).count() == 0
    same = spark.createDataFrame([(1, "b" * 500), (2, "b" * 400)], "id long, text string")
    assert {(x.id, x.start_at, x.end_at) for x in spans.shared_spans(same, 300).collect()} == {(1, 0, 500), (2, 0, 400)}


def test_pfair_windows():
    r = random.Random(3)
    for _ in range(20):
        blocks = {f"s{i}": r.randint(0, 40) for i in range(r.randint(1, 7))}
        total = sum(blocks.values())
        out = list(mixing.pfair_slots(blocks))
        assert [s for *_, s in out] == list(range(total))
        done = dict.fromkeys(blocks, 0)
        for s, i, slot in out:
            assert i == done[s]
            done[s] += 1
            for k, n in done.items():
                assert abs(n - Fraction(blocks[k], total) * (slot + 1)) < 1


def test_mixture(spark):
    r = random.Random(5)
    rows = [(i, r.choice(["a", "a", "a", "b", "c", None, "d"]), r.choice(["word " * r.randint(1, 60), "", None])) for i in range(600)]
    docs = spark.createDataFrame(rows, "id long, source string, text string")
    targets = spark.createDataFrame([("a", 0.3, 1), ("b", 0.4, 3), ("c", 0.25, 2), ("e", 0.05, 4)], "source string, target_share double, max_repeats int")
    m = mixing.Mixture(docs, targets, block_tokens=90, bucket_rows=20)
    size = {x.id: x.n_tokens for x in mixing.token_sizes(docs).collect()}
    assert all(size[i] == 0 for i, _, t in rows if not t)
    total = sum(size[i] for i, s, _ in rows if s in ("a", "b", "c", "e"))
    chosen = m.rows().collect()
    most = {"a": 1, "b": 3, "c": 2}
    assert all(x.source in most and 1 <= x.repeats <= most[x.source] and x.n_tokens == size[x.id] > 0 for x in chosen)
    report = {x.source: x for x in m.report().collect()}
    for s, share, limit in (("a", 0.3, 1), ("b", 0.4, 3), ("c", 0.25, 2)):
        have = sum(size[i] for i, q, _ in rows if q == s)
        tokens = sum(x.n_tokens * x.repeats for x in chosen if x.source == s)
        assert report[s].tokens == tokens and abs(tokens - min(share * total, limit * have)) <= 70
    assert report["e"].tokens == 0 and report["e"].n_rows == 0 and sum(x.actual_share for x in report.values()) == pytest.approx(1)
    order = sorted(m.uses().collect(), key=lambda x: (x.slot, x.place))
    whole, running = sum(x.n_tokens for x in order), dict.fromkeys(most, 0)
    seen = 0
    for x in order:
        running[x.source] += x.n_tokens
        seen += x.n_tokens
        for s, n in running.items():
            assert abs(n - report[s].actual_share * seen) <= 2 * m.block + 70
    assert seen == whole
    with pytest.raises(ValueError):
        mixing.Mixture(docs, targets.union(targets))
    assert mixing.Mixture(docs.limit(0), targets).rows().count() == 0


@pytest.fixture(scope="module")
def model():
    return pii.train()


def test_model_on_held_out_rows(model):
    v = model.vocabulary
    rows = pii_table.labelled_table(77, 2, tuple(sorted(w for w in v.small if len(w) > 2)), tuple(sorted(w.capitalize() for w in v.capital)))
    found = pii.Decoder(model).find([t for t, _ in rows])
    want = {(i, a, k) for i, (_, s) in enumerate(rows) for a, _, k in s}
    got = {(i, a, k) for i, s in enumerate(found) for a, _, k in s}
    assert len(want & got) / len(want) > 0.85 and len(want & got) / len(got) > 0.85


def test_windows_equal_whole_viterbi(model):
    """The bound only skips what Viterbi over the whole text leaves outside."""
    rows = [t for t, _ in pii_table.labelled_table(78, 1)][:120]
    rows += ["", " \n", "x", ". ".join(rows[:20])]
    fast = pii.Decoder(model)
    slow = pii.Decoder(model)
    slow.extra = 1e4  # no token can be ruled out
    assert fast.find(rows) == slow.find(rows)


def _plain_viterbi(decoder, text):
    """Labels of all tokens of one text by the recursion as written: begin, transitions, end."""
    tokens = pii.Tokens([text])
    at = np.flatnonzero(tokens.start >= 0)
    if not len(at):
        return []
    m, score = decoder.model, decoder._scores(decoder.types(tokens), at[:1], len(at))[0]
    state, back = score[0] + m.begin, []
    for t in range(1, len(at)):
        step = state[:, None] + m.move
        back.append(step.argmax(0))
        state = step.max(0) + score[t]
    path = [int((state + m.end).argmax())]
    for b in reversed(back):
        path.append(int(b[path[-1]]))
    return path[::-1]


def _labels(decoder, text):
    """Labels of all tokens that the windows leave, seen at the decoder's own paths."""
    tokens = pii.Tokens([text])
    live = np.flatnonzero(tokens.start >= 0)
    begins = {tokens.start[i]: k for k, i in enumerate(live)}
    ends = {tokens.end[i]: k for k, i in enumerate(live)}
    out = [0] * len(live)
    for a, z, kind in decoder.find([text])[0]:
        k = 2 * pii.KINDS.index(kind)
        out[begins[a] : ends[z] + 1] = [k + 1] + [k + 2] * (ends[z] - begins[a])
    return out


@pytest.mark.parametrize("pull", [0.0, 3.0, 8.0])
def test_windows_equal_plain_viterbi_at_the_edges(model, pull):
    """Learned begin and end weights count at a text's first and last token, also where they are strong."""
    begin, end = model.begin.copy(), model.end.copy()
    begin[1::2] += pull
    end[1:] += pull
    decoder = pii.Decoder(pii.Model(model.known, model.vocabulary, model.index, model.weight, model.move, begin, end))
    rows = [t for t, _ in pii_table.labelled_table(79, 1)][:80]
    rows += ["Orsolina Wendorlan", "Seen by Orsolina Wendorlan", "0192-555-4433", "call 0192-555-4433", "12", "no fluid", ""]
    alnum = [t for t in rows if not _odd_start(decoder, t)]
    assert len(alnum) > 60
    for text in alnum:
        assert _labels(decoder, text) == _plain_viterbi(decoder, text), text


def _odd_start(decoder, text):
    """Whether a detail of the plain path begins with a sign, which find() leaves out of it."""
    tokens = pii.Tokens([text])
    at = np.flatnonzero(tokens.start >= 0)
    return any(x and x % 2 and not chr(tokens.points[tokens.start[i]]).isalnum() for x, i in zip(_plain_viterbi(decoder, text), at))


def test_placeholders_and_table(spark, model):
    text = "Patient: Orsolina Wendorlan\nTel 0192-555-4433. No fluid."
    found = pii.Decoder(model).find([text])[0]
    assert [(a, k) for a, _, k in found] == [(9, "name"), (text.index("0192"), "phone")]
    assert pii.placeholder(text, found) == "Patient: [NAME]\nTel [PHONE]. No fluid."
    df = spark.createDataFrame([(1, text), (2, None), (3, ""), (4, text), (5, "clear lung. " * 5000 + text)], "id long, text string")
    df = df.selectExpr("'clash' AS kind", "id", "text")
    rows = pii.find_details(df, model).collect()
    assert {r.id for r in rows} == {1, 4, 5} and sum(r.id == 1 for r in rows) == 2
    red = {r.id: r.redacted for r in pii.redacted(df, model).collect()}
    assert red[4].startswith("Patient: [NAME]") and red[5].endswith("Tel [PHONE]. No fluid.")
    assert pii.find_details(df.limit(0), model).count() == 0


def test_suffix_automaton_equals_brute_force():
    from radweave.llm.automaton import SuffixAutomaton

    r = random.Random(8)
    for _ in range(60):
        texts = ["".join(r.choice("ab" if r.random() < 0.5 else "abc") for _ in range(r.randint(0, 25))) for _ in range(r.randint(1, 5))]
        owners = [r.randint(1, 3) for _ in texts]
        a = SuffixAutomaton(texts, [(o, o) for o in owners])
        for t, o in zip(texts, owners):
            other = [x for x, q in zip(texts, owners) if q != o]
            want = set()
            for e in range(1, len(t) + 1):
                n = max((k for k in range(e + 1) if any(t[e - k : e] in x for x in other)), default=0)
                if n >= 3 and not (e < len(t) and any(t[e - n : e + 1] in x for x in other)):
                    want.add((e - n, e))
            assert set(a.spans(t, o, 3)) == want


def test_span_inside_a_copied_context_of_the_same_record(spark):
    """A record holding a copied passage twice in different surroundings shares both places."""
    r = random.Random(2)
    word = lambda n: "".join(r.choice("abcdefgh") for _ in range(n))
    core = word(60)
    rows = [(1, core + word(50) + core[:45] + word(30)), (2, word(20) + core), (3, word(80))]
    df = spark.createDataFrame(rows, "id long, text string")
    for crowd in (1, 500):
        assert {(x.id, x.start_at, x.end_at) for x in spans.shared_spans(df, 40, crowd).collect()} == brute(rows, 40)
