"""Generalised suffix automaton over the texts of one reference shard, with the owners of every substring."""

from __future__ import annotations

from collections.abc import Iterator, Sequence


class SuffixAutomaton:
    """States of all substrings of ``texts``; each knows the smallest and largest owner it occurs in.

    ``owners`` gives per text the smallest and largest record that holds it.  Building and
    streaming take time linear in the characters.
    """

    __slots__ = ("high", "length", "link", "low", "step")

    def __init__(self, texts: Sequence[str], owners: Sequence[tuple[int, int]]):
        step: list[dict[str, int]] = [{}]
        link, length = [-1], [0]
        low: list[int | None] = [None]
        high: list[int | None] = [None]
        for text, (first, last_owner) in zip(texts, owners):
            last = 0
            for c in text:
                q = step[last].get(c)
                if q is not None and length[q] == length[last] + 1:
                    last = q
                elif q is not None:
                    last = self._split(step, link, length, low, high, last, q, c)
                else:
                    new, p = len(length), last
                    length.append(length[last] + 1)
                    step.append({})
                    link.append(0)
                    low.append(None)
                    high.append(None)
                    while p != -1 and c not in step[p]:
                        step[p][c] = new
                        p = link[p]
                    if p != -1:
                        q = step[p][c]
                        link[new] = q if length[q] == length[p] + 1 else self._split(step, link, length, low, high, p, q, c)
                    last = new
                if low[last] is None or first < low[last]:
                    low[last] = first
                if high[last] is None or last_owner > high[last]:
                    high[last] = last_owner
        for v in sorted(range(1, len(length)), key=length.__getitem__, reverse=True):
            u = link[v]
            if low[u] is None or low[v] < low[u]:
                low[u] = low[v]
            if high[u] is None or high[v] > high[u]:
                high[u] = high[v]
        self.step, self.link, self.length, self.low, self.high = step, link, length, low, high

    @staticmethod
    def _split(step, link, length, low, high, p: int, q: int, c: str) -> int:
        """A copy of state q for its shorter substrings, reached from p by c."""
        new = len(length)
        length.append(length[p] + 1)
        step.append(step[q].copy())
        link.append(link[q])
        low.append(None)
        high.append(None)
        while p != -1 and step[p].get(c) == q:
            step[p][c] = new
            p = link[p]
        link[q] = new
        return new

    def spans(self, text: str, owner: int, least: int) -> Iterator[tuple[int, int]]:
        """Maximal (start, end) of ``text`` of at least ``least`` characters occurring in a record other than ``owner``.

        The matching statistics of the text: at every character the longest suffix read so far that
        another record holds; a span is given where the next character does not extend it.
        """
        step, link, length, low, high = self.step, self.link, self.length, self.low, self.high
        v = n = 0
        for at, c in enumerate(text):
            before = n
            while True:
                w = step[v].get(c)
                if w is not None and (low[w] != owner or high[w] != owner):
                    v, n = w, n + 1
                    break
                v = link[v]
                if v == -1:
                    v = n = 0
                    break
                n = length[v]
            if before >= least and n != before + 1:
                yield at - before, at
        if n >= least:
            yield len(text) - n, len(text)
