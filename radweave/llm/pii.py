"""Personal data in free text: a linear-chain conditional random field.

Tokens are letter runs, digit runs, single signs and line ends.  Every token has
a *type* (its spelling with digits reduced to 0 and 9), and every feature depends on
one type at an offset of -3..3, so scores are table look-ups: the
score of a token is the sum of seven rows of per-type tables.  Texts are tokenised, scored and
decoded as numpy arrays over about a million characters at a time.

Most of a report is far from personal data.  An upper bound of what any labelled
segment through a token could gain over "no data" is computed from per-type
maxima; where no segment can gain, the best path is known to be outside, and
Viterbi runs only on the remaining windows, batched by length.  The result
equals Viterbi over whole texts.

The model is trained on ``pii_table.labelled_table`` by minibatch gradient on the exact
conditional likelihood; the fitted weights are kept in the shared folder under a digest of the table,
the code and the vocabularies, so other sessions read them.
"""

from __future__ import annotations

import base64
import hashlib
import io
import json
import unicodedata
from collections.abc import Iterator, Sequence
from functools import cache
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from radweave.llm import pii_table, words
from radweave.llm.canonical import canonical
from radweave.llm.pii_table import labelled_table
from radweave.scratch import shared_root

KINDS = ("name", "phone", "email", "id_number", "address")
VOCABULARIES = ("/opt/tokenizers/byte_bpe_50k.tiktoken", "/opt/tokenizers/byte_bpe_multi_50k.tiktoken")
LABELS = ("O", *(f"{p}-{k}" for k in KINDS for p in "BI"))
K = len(LABELS)
OFFSETS = (-3, -2, -1, 0, 1, 2, 3)
REACH = 3
FAR = -1e6
SPACE, LETTER, DIGIT, SIGN, LINE = range(5)


@cache
def _classes() -> np.ndarray:
    """Character class of every code point of the basic plane; others are signs."""
    out = np.full(65_536, SIGN, np.uint8)
    for o in range(65_536):
        if 0xD800 <= o < 0xE000:
            continue
        cat = unicodedata.category(chr(o))
        if cat[0] in "LM" or cat == "Cf":
            out[o] = LETTER
        elif cat == "Nd":
            out[o] = DIGIT
        elif cat == "Zs":
            out[o] = SPACE
    for o, c in ((9, SPACE), (13, SPACE), (10, LINE), (0x2028, LINE), (0x85, SPACE)):
        out[o] = c
    return out


class Tokens:
    """Tokens of several texts: start and end in one array of code points, with REACH blank tokens around every text."""

    __slots__ = ("end", "first", "owner", "points", "start")

    def __init__(self, texts: Sequence[str]):
        sizes = np.array([len(t) for t in texts], np.int64)
        self.points = np.frombuffer(" ".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
        self.first = np.cumsum(sizes + 1) - (sizes + 1)
        kind = _classes()[np.minimum(self.points, 65_535)]
        kind[self.first[1:] - 1] = SPACE
        change = np.r_[True, kind[1:] != kind[:-1]] | (kind >= SIGN)
        begin = np.flatnonzero(change & (kind != SPACE))
        bound = np.flatnonzero(change)
        stop = np.r_[bound[1:], len(kind)][np.searchsorted(bound, begin)]
        owner = np.searchsorted(self.first, begin, "right") - 1
        shift = REACH * (2 * owner + 1)
        total = len(begin) + 2 * REACH * len(texts)
        self.start, self.end, self.owner = np.full(total, -1, np.int64), np.full(total, -1, np.int64), np.full(total, -1, np.int64)
        at = np.arange(len(begin)) + shift
        self.start[at], self.end[at], self.owner[at] = begin, stop, owner


def _shape(token: str) -> str:
    out = []
    for c in token:
        s = "X" if c.isupper() else "x" if c.isalpha() else "9" if c.isdigit() else c
        if len(out) < 2 or out[-1] != s or out[-2] != s:
            out.append(s)
    return "".join(out)


ENDINGS = ("s", "es", "ed", "d", "ing", "ly", "al", "y", "er", "ous", "ive", "ion", "ness", "less")


class Vocabulary:
    """Whole words of public tokenizers' vocabularies: how common a word is in small letters, and whether only with a capital."""

    def __init__(self, paths: Sequence[str]):
        self.small: dict[str, int] = {}
        capital: set[str] = set()
        for path in paths:
            for line in Path(path).read_bytes().splitlines():
                piece, rank = line.split()
                try:
                    word = base64.b64decode(piece).decode("utf-8")
                except UnicodeDecodeError:
                    continue
                if word[:1] == " " and len(word) > 2 and word[1:].isalpha():
                    if word.islower():
                        self.small.setdefault(word[1:], int(rank))
                    elif word[1:].istitle():
                        capital.add(word[1:].lower())
        self.capital = frozenset(w for w in capital if w not in self.small and len(w) > 3)

    def of(self, low: str) -> str:
        rank = self.small.get(low)
        if rank is not None:
            return "often" if rank < 8_000 else "known" if rank < 25_000 else "seldom"
        if low in self.capital:
            return "proper"
        return "derived" if any(low.endswith(e) and low[: -len(e)] in self.small and len(low) - len(e) > 3 for e in ENDINGS) else "foreign"


def features(token: str, known: frozenset | None, vocabulary: Vocabulary) -> list[str]:
    """Word-shape features of one token type; spellings only of words in ``known``."""
    if token == "":
        return ["edge"]
    if token == "\n":
        return ["line"]
    token = canonical(token)[0] or token
    if token[:1].isdigit():
        n = len(token)
        return ["digits", f"n={min(n, 12)}", f"zeros={len(token) - len(token.lstrip('0'))}", f"dz={min(n, 12)}{token[:1] == '0'}"]
    low = token.lower()
    if not token[:1].isalpha():
        return [f"sign={token}"]
    shape = _shape(token)
    common = vocabulary.of(low)
    out = ["word", f"shape={shape}", f"len={min(len(low), 9)}", common, f"{common}{shape[:2]}"]
    if known is None or low in known:
        out.append(f"w={low}")
    else:
        out += ["rare", f"rare{shape[:2]}", f"end={low[-2:]}"]
    if not low.isascii():
        out.append("accent")
    return out


class Model:
    """Weights per feature and offset, transitions, and the per-type tables grown as types appear."""

    def __init__(self, known: frozenset, vocabulary: Vocabulary, index: dict[str, int], weight: np.ndarray, move: np.ndarray, begin: np.ndarray, end: np.ndarray):
        self.known, self.vocabulary, self.index, self.weight, self.move, self.begin, self.end = known, vocabulary, index, weight, move, begin, end

    def row(self, token: str) -> np.ndarray:
        """Scores [offset, label] that a token of this type adds to its neighbours."""
        f = [self.index[x] for x in features(token, self.known, self.vocabulary) if x in self.index]
        return self.weight[:, f].sum(1) if f else np.zeros((len(OFFSETS), K), np.float32)


def _spell(points: np.ndarray) -> str:
    return points.tobytes().decode("utf-32-le", "surrogatepass")


def _reduced(points: np.ndarray) -> np.ndarray:
    """Code points with every digit reduced to 0 or 9."""
    digit = _classes()[np.minimum(points, 65_535)] == DIGIT
    if not digit.any():
        return points
    out = points.copy()
    d = points[digit]
    out[digit] = np.where((d == 48) | (d == 0xFF10), 48, 57)
    return out


class Decoder:
    """Finds personal data in batches of texts with one model."""

    MOST_TYPES = 400_000

    def __init__(self, model: Model):
        self.model = model
        m = model.move
        enter = max(float((m[:, y] - m[0, 0]).max()) for y in range(1, K))
        leave = max(0.0, float((m[1:, 0] - m[0, 0]).max()))
        self.extra = enter + leave
        # at a text's first and last token begin and end stand in place of the transitions
        self.at_first = float((model.begin[1:] - model.begin[0]).max()) - enter
        self.at_last = max(0.0, float((model.end[1:] - model.end[0]).max())) - leave
        self._reset()

    def _reset(self) -> None:
        self.ids: dict[int, int] = {}
        self.count = 0
        self.table = np.zeros((4096, len(OFFSETS), K), np.float32)
        self.gain = np.zeros((len(OFFSETS), 4096), np.float32)
        self._add("")

    def _add(self, token: str) -> int:
        n = self.count
        if n == len(self.table):
            self.table = np.concatenate([self.table, np.zeros_like(self.table)])
            self.gain = np.concatenate([self.gain, np.zeros_like(self.gain)], axis=1)
        row = self.model.row(token)
        self.table[n] = row
        self.gain[:, n] = (row[:, 1:] - row[:, :1]).max(1)
        self.count += 1
        return n

    def types(self, tokens: Tokens) -> np.ndarray:
        """Type numbers of all tokens (0 for the blank ones)."""
        if self.count > self.MOST_TYPES:
            self._reset()
        points = _reduced(tokens.points)
        live = np.flatnonzero(tokens.start >= 0)
        s, e = tokens.start[live], tokens.end[live]
        h = words.range_hash(points, s, e)
        value, where, inverse = np.unique(h, return_index=True, return_inverse=True)
        own = np.empty(len(value), np.int64)
        for k, (v, w) in enumerate(zip(value.tolist(), where.tolist())):
            t = self.ids.get(v)
            if t is None:
                t = self.ids[v] = self._add(_spell(points[s[w] : e[w]]))
            own[k] = t
        out = np.zeros(len(tokens.start), np.int64)
        out[live] = own[inverse]
        return out

    def find(self, texts: Sequence[str]) -> list[list[tuple[int, int, str]]]:
        """(start, end, kind) of every detail of every text."""
        found: list[list[tuple[int, int, str]]] = [[] for _ in texts]
        if not texts:
            return found
        tokens = Tokens(texts)
        kind = self.types(tokens)
        n = len(kind)
        bound = np.full(n, self.extra, np.float64)
        for o, offset in enumerate(OFFSETS):
            lo, hi = max(0, -offset), n - max(0, offset)
            bound[lo:hi] += self.gain[o][kind[lo + offset : hi + offset]]
        blank = tokens.start < 0
        bound[1:][blank[:-1]] += self.at_first
        bound[:-1][blank[1:]] += self.at_last
        bound[blank] = FAR
        total = np.r_[0.0, np.cumsum(bound)]
        best_after = np.maximum.accumulate(total[1:][::-1])[::-1]
        worst_before = np.minimum.accumulate(total[:-1])
        live = (best_after - worst_before > 0) & ~blank  # a window never leaves its text
        edge = np.flatnonzero(np.diff(np.r_[0, live.astype(np.int8), 0]))
        begin, stop = edge[0::2], edge[1::2]
        if not len(begin):
            return found
        size = stop - begin
        order = np.argsort(size, kind="stable")
        at = 0
        while at < len(order):
            top = at + 1
            while top < len(order) and (top - at) * size[order[top]] < 20_000 and size[order[top]] <= 1.3 * size[order[at]] + 4:
                top += 1
            pick = order[at:top]
            self._window(tokens, kind, begin[pick], size[pick], found)
            at = top
        for spans in found:
            spans.sort()
        return found

    def _scores(self, kind: np.ndarray, begin: np.ndarray, width: int) -> np.ndarray:
        place = begin[:, None] + np.arange(width)[None]
        out = np.zeros((len(begin), width, K), np.float32)
        for o, offset in enumerate(OFFSETS):
            out += self.table[kind[np.clip(place + offset, 0, len(kind) - 1)], o]
        return out

    def _window(self, tokens: Tokens, kind: np.ndarray, begin: np.ndarray, size: np.ndarray, found: list) -> None:
        width = int(size.max())
        score = self._scores(kind, begin, width)
        inside = np.arange(width)[None] < size[:, None]
        score[~inside] = FAR
        score[..., 0][~inside] = 0
        move = self.model.move
        first = tokens.start[begin - 1] < 0  # before it lies the edge of the text
        last = tokens.start[begin + size] < 0
        state = score[:, 0] + np.where(first[:, None], self.model.begin[None], move[0][None])
        back = np.zeros((width, len(begin), K), np.int8)
        for t in range(1, width):
            step = state[:, :, None] + move[None]
            over = last & (size == t)
            step[over, :, 0] = state[over] + self.model.end
            back[t] = step.argmax(1)
            state = np.take_along_axis(step, back[t][:, None, :].astype(np.int64), 1)[:, 0] + score[:, t]
        over = last & (size == width)
        state = state + np.where(over[:, None], self.model.end[None], move[:, 0][None])  # what follows a window is outside, or the edge of the text
        path = np.zeros((len(begin), width), np.int8)
        path[:, -1] = state.argmax(1)
        rows = np.arange(len(begin))
        for t in range(width - 1, 0, -1):
            path[:, t - 1] = back[t][rows, path[:, t]]
        path[~inside] = 0
        for w in np.flatnonzero(path.any(1)):
            p = path[w, : size[w]].tolist()
            t = 0
            while t < len(p):
                if not p[t]:
                    t += 1
                    continue
                k, u = (p[t] - 1) // 2, t + 1
                while u < len(p) and p[u] == 2 * k + 2:
                    u += 1
                a, z = int(begin[w]) + t, int(begin[w]) + u - 1
                while KINDS[k] != "phone" and a < z and not chr(tokens.points[tokens.start[a]]).isalnum():
                    a += 1  # a sign does not begin such a detail
                text = int(tokens.owner[a])
                base = int(tokens.first[text])
                found[text].append((int(tokens.start[a]) - base, int(tokens.end[z]) - base, KINDS[k]))
                t = u


def _gold(tokens: Tokens, spans: Sequence[Sequence[tuple[int, int, str]]]) -> np.ndarray:
    y = np.zeros(len(tokens.start), np.int64)
    for i, own in enumerate(spans):
        lo, hi = np.searchsorted(tokens.owner[tokens.owner >= 0], [i, i + 1])
        at = np.flatnonzero(tokens.owner >= 0)[lo:hi]
        s = tokens.start[at] - tokens.first[i]
        for a, b, kind in own:
            inside = at[(s >= a) & (s < b)]
            y[inside] = 2 * KINDS.index(kind) + 2
            y[inside[:1]] -= 1
    return y


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis))


@cache
def train(seed: int = 3, copies: int = 48, passes: int = 6, rate: float = 0.2, decay: float = 2e-4, lean: tuple[float, ...] = (0.8, 1.2, 0.8, 1.8, 1.8), vocabularies: tuple[str, ...] = VOCABULARIES) -> Model:
    """Fit the field on the labelled table (about 8,000 short texts; the bound is ``copies``).

    ``lean``, by kind, is added to every entry into a detail: one overlooked costs more than a word too many.
    """
    vocabulary = Vocabulary(vocabularies)
    rows = labelled_table(seed, copies, tuple(sorted(w for w in vocabulary.small if len(w) > 2)), tuple(sorted(w.capitalize() for w in vocabulary.capital)))
    counts: dict[str, int] = {}
    for text, spans in rows:
        hidden = [False] * len(text)
        for a, b, kind in spans:
            if kind != "address":
                hidden[a:b] = [True] * (b - a)
        for w in set("".join(" " if h or not c.isalpha() else c for c, h in zip(text, hidden)).lower().split()):
            counts[w] = counts.get(w, 0) + 1
    known = frozenset(w for w, n in counts.items() if n >= 5)
    texts, spans = [t for t, _ in rows], [s for _, s in rows]
    tokens = Tokens(texts)
    points = _reduced(tokens.points)
    spelled = ["" if s < 0 else _spell(points[s:e]) for s, e in zip(tokens.start.tolist(), tokens.end.tolist())]
    index: dict[str, int] = {}
    types: dict[str, int] = {}
    type_features: list[list[int]] = []
    kind = np.empty(len(spelled), np.int64)
    for k, token in enumerate(spelled):
        if token not in types:
            types[token] = len(type_features)
            type_features.append([index.setdefault(f, len(index)) for f in features(token, known, vocabulary)])
        kind[k] = types[token]
    y = _gold(tokens, spans)
    most = max(map(len, type_features))
    grid = np.full((len(type_features), most), len(index), np.int64)
    for k, f in enumerate(type_features):
        grid[k, : len(f)] = f
    weight = np.zeros((len(OFFSETS), len(index) + 1, K), np.float32)
    move, begin, end = np.zeros((K, K), np.float32), np.zeros(K, np.float32), np.zeros(K, np.float32)
    banned = np.zeros((K, K), bool)
    for a in range(K):
        for b in range(2, K, 2):
            banned[a, b] = a not in (b, b - 1)
    move[banned] = -1e4
    begin[2::2] = -1e4
    speed = [np.full_like(weight, 1e-6), np.full_like(move, 1e-6), np.full_like(begin, 1e-6), np.full_like(end, 1e-6)]
    live = np.flatnonzero(tokens.owner >= 0)
    lo = np.searchsorted(tokens.owner[live], np.arange(len(texts)))
    hi = np.searchsorted(tokens.owner[live], np.arange(len(texts)), "right")
    lengths = hi - lo
    rng = np.random.default_rng(seed)
    usable = np.flatnonzero(lengths > 0)
    mean, n_mean = [np.zeros_like(v, dtype=np.float64) for v in (weight, move, begin, end)], 0
    for at in range(passes):
        order = usable[np.argsort(lengths[usable] + rng.random(len(usable)) * 6)]
        chunks = [order[k : k + 48] for k in range(0, len(order), 48)]
        for c in rng.permutation(len(chunks)):
            pick = chunks[c]
            n, width = len(pick), int(lengths[pick].max())
            place = live[np.minimum(lo[pick][:, None] + np.arange(width)[None], len(live) - 1)]
            inside = np.arange(width)[None] < lengths[pick][:, None]
            near = np.stack([grid[kind[place + o]] for o in OFFSETS])  # offset, text, token, feature
            score = np.zeros((n, width, K), np.float32)
            for o in range(len(OFFSETS)):
                score += weight[o][near[o]].sum(2)
            gold = np.where(inside, y[place], 0)
            # forward and backward, stopping at each text's own length
            ahead = np.zeros((width, n, K), np.float32)
            ahead[0] = score[:, 0] + begin
            for t in range(1, width):
                new = _log_sum(ahead[t - 1][:, :, None] + move[None], 1) + score[:, t]
                ahead[t] = np.where(inside[:, t, None], new, ahead[t - 1])
            whole = _log_sum(ahead[-1] + end, 1)
            behind = np.zeros((width, n, K), np.float32)
            behind[-1] = end
            pair = np.zeros((K, K), np.float64)
            for t in range(width - 1, 0, -1):
                joint = move[None] + (score[:, t] + behind[t])[:, None, :]
                prob = np.exp(ahead[t - 1][:, :, None] + joint - whole[:, None, None]) * inside[:, t, None, None]
                pair += prob.sum(0)
                behind[t - 1] = np.where(inside[:, t, None], _log_sum(joint, 2), behind[t])
            unary = np.exp(ahead + behind - whole[None, :, None]).transpose(1, 0, 2) * inside[..., None]
            target = np.zeros_like(unary)
            np.put_along_axis(target, gold[..., None], inside[..., None].astype(unary.dtype), 2)
            diff = (unary - target).astype(np.float32)
            both = inside[:, 1:]
            np.subtract.at(pair, (gold[:, :-1][both], gold[:, 1:][both]), 1)
            last = (lengths[pick] - 1)[:, None, None]
            cell = near + (np.arange(len(OFFSETS)) * (len(index) + 1))[:, None, None, None]
            cell = cell[:, inside]
            share = np.repeat(np.tile(diff[inside], (len(OFFSETS), 1)), most, axis=0)
            width_all = len(OFFSETS) * (len(index) + 1)
            step_weight = np.stack([np.bincount(cell.ravel(), share[:, k], width_all) for k in range(K)], 1).reshape(weight.shape).astype(np.float32)
            step_weight[:, -1] = 0
            steps = [step_weight, pair.astype(np.float32), diff[:, 0].sum(0), np.take_along_axis(diff, last, 1)[:, 0].sum(0)]
            for value, step, sped in zip((weight, move, begin, end), steps, speed):
                step = step / n + decay * value * (np.abs(value) < 1e3)
                sped += step * step
                value -= rate * step / np.sqrt(sped) * (np.abs(value) < 1e3)
            if 2 * (at + 1) > passes:
                n_mean += 1
                for total, value in zip(mean, (weight, move, begin, end)):
                    total += value
    weight, move, begin, end = ((total / n_mean).astype(np.float32) for total in mean)  # the mean over the second half is steadier
    move[0, 1::2] += np.array(lean, np.float32)
    begin[1::2] += np.array(lean, np.float32)
    return Model(known, vocabulary, index, weight[:, :-1], move, begin, end)


def to_bytes(model: Model) -> bytes:
    """The fitted weights as one archive, without the vocabulary."""
    names = json.dumps({"known": sorted(model.known), "features": sorted(model.index, key=model.index.__getitem__)})
    out = io.BytesIO()
    np.savez_compressed(out, names=np.frombuffer(names.encode(), np.uint8), weight=model.weight, move=model.move, begin=model.begin, end=model.end)
    return out.getvalue()


def from_bytes(raw: bytes, vocabulary: Vocabulary) -> Model:
    kept = np.load(io.BytesIO(raw))
    names = json.loads(kept["names"].tobytes())
    return Model(frozenset(names["known"]), vocabulary, {f: k for k, f in enumerate(names["features"])}, kept["weight"], kept["move"], kept["begin"], kept["end"])


@cache
def _digest(vocabularies: tuple[str, ...]) -> str:
    sources = [Path(p).read_bytes() for p in vocabularies] + [Path(m).read_bytes() for m in (__file__, pii_table.__file__)]
    return hashlib.sha256(b"".join(sources)).hexdigest()[:24]


def fitted(spark: SparkSession, vocabularies: tuple[str, ...] = VOCABULARIES) -> Model:
    """The model of ``train``, from the shared folder if a session has left it there, else trained and left there."""
    fs, root = pafs.FileSystem.from_uri(shared_root(spark))
    path = f"{root}/radweave-models/pii-{_digest(vocabularies)}.npz"
    if fs.get_file_info(path).type == pafs.FileType.File:
        with fs.open_input_stream(path) as f:
            return from_bytes(f.read(), Vocabulary(vocabularies))
    model = train(vocabularies=vocabularies)
    fs.create_dir(path.rsplit("/", 1)[0], recursive=True)
    partial = f"{path}.{hashlib.sha256(str(id(spark)).encode()).hexdigest()[:8]}"
    with fs.open_output_stream(partial) as f:
        f.write(to_bytes(model))
    fs.move(partial, path)
    return model


def placeholder(text: str, spans: Sequence[tuple[int, int, str]]) -> str:
    """Text with ``[KIND]`` in place of every span, all else unchanged."""
    out, at = [], 0
    for a, b, kind in spans:
        out += [text[at:a], f"[{kind.upper()}]"]
        at = b
    out.append(text[at:])
    return "".join(out)


def details(model, with_text: bool = False):
    """mapInArrow over (id, text): rows (id, kind, start_at, end_at), or with ``with_text`` (id, n_details, redacted)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder(model.value)
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            out: list[list] = [[], [], [], []]
            for lo, hi in words.chunks(texts, 1 << 20):
                own = [t or "" for t in texts[lo:hi]]
                for i, text, spans in zip(ids[lo:hi], own, decoder.find(own)):
                    if with_text and spans:
                        for c, v in zip(out, (i, len(spans), placeholder(text, spans))):
                            c.append(v)
                    elif not with_text:
                        for a, b, kind in spans:
                            for c, v in zip(out, (i, kind, a, b)):
                                c.append(v)
            if with_text:
                yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int32()), pa.array(out[2], pa.string())], names=["id", "n_details", "redacted"])
            else:
                yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.string()), pa.array(out[2], pa.int32()), pa.array(out[3], pa.int32())], names=["id", "kind", "start_at", "end_at"])

    return run


def find_details(texts: DataFrame, model: Model | None = None) -> DataFrame:
    """(id, kind, start_at, end_at) of every detail in ``texts`` (id bigint, text string), positions in code points.

    Null and empty texts have none; repeated rows each give theirs; other columns are ignored. The model is
    broadcast (about 2 MB with its vocabulary, whatever the input).
    """
    return _mapped(texts, model, False, "id long, kind string, start_at int, end_at int")


def redacted(texts: DataFrame, model: Model | None = None) -> DataFrame:
    """(id, n_details, redacted) of the texts with details: a typed placeholder in place of each, nothing else changed."""
    return _mapped(texts, model, True, "id long, n_details int, redacted string")


def _mapped(texts: DataFrame, model: Model | None, with_text: bool, kind: str) -> DataFrame:
    sent = texts.sparkSession.sparkContext.broadcast(model or fitted(texts.sparkSession))
    own = texts.select(F.col("id").cast("long").alias("id"), F.col("text").cast("string").alias("text"))
    return own.mapInArrow(details(sent, with_text), kind)
