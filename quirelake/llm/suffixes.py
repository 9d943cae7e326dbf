"""Suffix sorting of byte shards by induction, with queues that spill to disk.

One pass of induction reads its suffixes from a priority queue ordered by (first byte, rank of the rest). As
the rest's ranks arrive in order, the queue is one first-in-first-out spool per byte, whose blocks go to a
temporary file beyond a memory bound. All entries of one byte that wait at a time are handled as one block.
"""

from __future__ import annotations

import tempfile

import numpy as np

SPOOL_BYTES = 64 << 20


class Spools:
    """First-in-first-out queues of positions by symbol; blocks beyond the memory bound lie in one file."""

    def __init__(self, symbols: int, most: int = SPOOL_BYTES):
        self.blocks: list[list] = [[] for _ in range(symbols)]
        self.most, self.held, self.file = most, 0, None

    def put(self, symbol: int, block: np.ndarray) -> None:
        if self.held + block.nbytes > self.most:
            if self.file is None:
                self.file = tempfile.TemporaryFile()
            at = self.file.seek(0, 2)
            self.file.write(block.tobytes())
            self.blocks[symbol].append((at, len(block)))
        else:
            self.held += block.nbytes
            self.blocks[symbol].append(block)

    def take(self, symbol: int) -> np.ndarray:
        out = []
        for x in self.blocks[symbol]:
            if isinstance(x, tuple):
                self.file.seek(x[0])
                x = np.frombuffer(self.file.read(8 * x[1]), np.int64)
            else:
                self.held -= x.nbytes
            out.append(x)
        self.blocks[symbol] = []
        return out[0] if len(out) == 1 else np.concatenate(out) if out else np.zeros(0, np.int64)

    def deal(self, symbols: np.ndarray, block: np.ndarray) -> None:
        """Put each position in its symbol's queue, in the block's order."""
        if not len(block):
            return
        order = np.argsort(symbols, kind="stable")
        sorted_ = symbols[order]
        cut = np.flatnonzero(np.r_[True, sorted_[1:] != sorted_[:-1]])
        for a, b in zip(cut, np.r_[cut[1:], len(block)], strict=True):
            self.put(int(sorted_[a]), block[order[a:b]])

    def close(self) -> None:
        if self.file is not None:
            self.file.close()


def small_types(s: np.ndarray) -> np.ndarray:
    """True where the suffix is smaller than the next one; the last symbol is the unique least one."""
    n = len(s)
    step = np.sign(s[1:].astype(np.int32) - s[:-1].astype(np.int32))
    nearest = np.where(step != 0, np.arange(n - 1), n)
    nearest = np.minimum.accumulate(nearest[::-1])[::-1]
    out = np.ones(n, bool)
    inner = nearest < n
    out[:-1][inner] = step[nearest[inner]] > 0
    return out


def _by_symbol(s: np.ndarray, block: np.ndarray, symbols: int) -> list[np.ndarray]:
    cut = np.searchsorted(s[block], np.arange(symbols + 1))
    return [block[cut[c] : cut[c + 1]] for c in range(symbols)]


def induced(s: np.ndarray, small: np.ndarray, lms: np.ndarray, symbols: int, spool: int = SPOOL_BYTES) -> np.ndarray:
    """All suffixes in order, from the leftmost small ones in order (lms): large ones in one pass upwards, then
    small ones in one pass downwards."""
    seeds, queue = _by_symbol(s, lms, symbols), Spools(symbols, spool)
    large: list[np.ndarray] = []

    def pass_on(block: np.ndarray, want_small: bool, own: int) -> np.ndarray:
        before = block[block > 0] - 1
        before = before[small[before] == want_small]
        sym = s[before]
        stay = sym == own
        queue.deal(sym[~stay], before[~stay])
        return before[stay]

    for c in range(symbols):
        got, block = [], queue.take(c)
        while len(block):
            got.append(block)
            block = pass_on(block, False, c)
        large.append(np.concatenate(got) if got else np.zeros(0, np.int64))
        pass_on(seeds[c], False, c)
    queue.close()
    queue = Spools(symbols, spool)
    out: list[np.ndarray] = []
    for c in range(symbols - 1, -1, -1):
        got, block = [], queue.take(c)
        if c == 0:
            block = np.array([len(s) - 1], np.int64)
        while len(block):
            got.append(block)
            block = pass_on(block, True, c)
        pass_on(large[c][::-1], True, c)
        out += [*got, large[c][::-1]]
    queue.close()
    return np.concatenate(out)[::-1]


def doubled(names: np.ndarray) -> np.ndarray:
    """Suffix order of a string of names by prefix doubling: each round induces the order of twice the length."""
    n, rank, step = len(names), names.astype(np.int64), 1
    while True:
        key = (rank + 1) * (n + 2)
        key[: n - step] += rank[step:] + 1 if step < n else 0
        order = np.argsort(key, kind="stable")
        new = np.r_[False, key[order][1:] != key[order][:-1]].cumsum()
        rank = np.empty(n, np.int64)
        rank[order] = new
        if new[-1] == n - 1:
            return order
        step *= 2


def suffix_array(text: np.ndarray, spool: int = SPOOL_BYTES) -> np.ndarray:
    """Suffix order of an array of symbols of at least 1; a least symbol 0 is put at its end and left out again."""
    s = np.r_[text.astype(np.int16), np.int16(0)]
    n, symbols = len(s), int(s.max()) + 1
    if n == 1:
        return np.zeros(0, np.int64)
    small = small_types(s)
    lms = np.flatnonzero(small[1:] & ~small[:-1]) + 1
    first = induced(s, small, lms[np.argsort(s[lms], kind="stable")], symbols, spool)
    is_lms = np.zeros(n, bool)
    is_lms[lms] = True
    got = first[is_lms[first]]  # the leftmost small suffixes, ordered by the substring up to the next one
    nth = np.empty(n, np.int64)
    nth[lms] = np.arange(len(lms))
    end = np.r_[lms[1:], n - 1]
    length = (end - lms + 1)[nth[got]]
    same = length[1:] == length[:-1]
    live, at = np.flatnonzero(same), 0
    while len(live):
        live = live[at < length[live]]
        differs = s[got[live] + at] != s[got[live + 1] + at]
        same[live[differs]] = False
        live = live[~differs]
        at += 1
    name = np.empty(len(lms), np.int64)
    name[nth[got]] = np.r_[0, (~same).cumsum()] if len(got) else got
    order = got if len(got) == 0 or name.max() == len(lms) - 1 else lms[doubled(name)]
    return induced(s, small, order, symbols, spool)[1:]


def repeated_starts(text: np.ndarray, length: int, valid: np.ndarray, spool: int = SPOOL_BYTES) -> np.ndarray:
    """True at each valid start whose next `length` symbols also start at another place. All starts that share
    so long a prefix with a valid one must be valid as well."""
    sa = suffix_array(text, spool)
    out = np.zeros(len(text), bool)
    pair = np.flatnonzero(valid[sa[1:]] & valid[sa[:-1]])
    at, step = 0, 8
    while at < length and len(pair):  # neighbours' common prefix, as far as it can matter
        width = min(step, length - at)
        look = np.arange(at, at + width)
        keep = np.ones(len(pair), bool)
        for a in range(0, len(pair), 1 << 17):
            x = pair[a : a + (1 << 17)]
            keep[a : a + len(x)] = (text[sa[x][:, None] + look] == text[sa[x + 1][:, None] + look]).all(axis=1)
        pair, at, step = pair[keep], at + width, min(2 * step, 64)
    out[sa[pair]] = True
    out[sa[pair + 1]] = True
    return out
