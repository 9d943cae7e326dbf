"""Upper bounds of likeness over many short texts at once.

difflib's ratio counts matching blocks, which stand in the same order in both texts and so are a common subsequence: twice
the longest common subsequence over both lengths is never below it. That subsequence is found for all texts together by
whole-word bit operations, and only texts whose bound reaches the best score so far need the ratio itself.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

WORD = 64


def common(a: str, b: str) -> int:
    """Length of the longest common subsequence."""
    seen: dict[str, int] = {}
    for i, c in enumerate(a):
        seen[c] = seen.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for c in b:
        hit = row & seen.get(c, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


class Texts:
    """Texts with the places of each character as bits: dense where most texts have it, else of these texts only."""

    def __init__(self, texts: list[str]):
        self.texts = texts
        self.size = np.array([len(t) for t in texts], np.int64)
        self.short = np.flatnonzero(self.size <= WORD)
        self.long = np.flatnonzero(self.size > WORD)
        own = [texts[i] for i in self.short.tolist()]
        codes = np.frombuffer("".join(own).encode("utf-32-le", "surrogatepass"), np.uint32)
        sizes = self.size[self.short]
        owner = np.repeat(np.arange(len(own)), sizes)
        place = np.arange(len(codes)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        order = np.argsort(codes, kind="stable")
        cut = np.flatnonzero(np.r_[True, np.diff(codes[order].astype(np.int64)) != 0, True]) if len(codes) else [0]
        self.bits: dict[str, tuple[np.ndarray | None, np.ndarray]] = {}
        for a, b in zip(cut[:-1], cut[1:], strict=True):
            at = order[a:b]
            rows, first = np.unique(owner[at], return_index=True)
            bits = np.bitwise_or.reduceat(np.uint64(1) << place[at].astype(np.uint64), first)
            if 4 * len(rows) > len(own):
                dense = np.zeros(len(own), np.uint64)
                dense[rows] = bits
                rows, bits = None, dense
            self.bits[chr(codes[at[0]])] = (rows, bits)

    def bounds(self, text: str, least: float) -> tuple[np.ndarray, np.ndarray]:
        """For each of the texts, a bound of its ratio, exact enough where it could reach `least`, and whether one of the two
        may hold the other."""
        n, both = len(text), len(text) + self.size
        out = np.where(both > 0, 2.0 * np.minimum(n, self.size) / np.maximum(both, 1), 1.0)
        within = np.ones(len(self.texts), bool)
        wanted = out >= least
        if wanted[self.short].any():
            row = np.full(len(self.short), ~np.uint64(0))
            for c in text:
                if got := self.bits.get(c):
                    rows, bits = got
                    if rows is None:
                        hit = row & bits
                        row = (row + hit) | (row - hit)
                    else:
                        own = row[rows]
                        hit = own & bits
                        row[rows] = (own + hit) | (own - hit)
            self._set(out, within, self.short, n, WORD - np.bitwise_count(row).astype(np.int64))
        rest = self.long[wanted[self.long]]
        if len(rest):
            self._set(out, within, rest, n, np.array([common(text, self.texts[i]) for i in rest.tolist()], np.int64))
        return out, within

    def _set(self, out: np.ndarray, within: np.ndarray, at: np.ndarray, n: int, same: np.ndarray) -> None:
        size = self.size[at]
        out[at] = np.where(n + size > 0, 2.0 * same / np.maximum(n + size, 1), 1.0)
        within[at] = same == np.minimum(n, size)


def first_best(bound: np.ndarray, score: Callable[[int], float], least: float) -> tuple[float, int]:
    """The greatest score of at least `least` and its place, of equal ones the first; (0.0, -1) for none. bound: no score is
    greater; scores are asked for in falling order of their bounds."""
    best, at = 0.0, -1
    places = np.flatnonzero(bound >= least)
    for i in places[np.argsort(-bound[places], kind="stable")].tolist():
        if at >= 0 and (bound[i] < best or (bound[i] == best and i > at)):
            break
        x = score(i)
        if x >= least and (at < 0 or x > best or (x == best and i < at)):
            best, at = x, i
    return best, at
