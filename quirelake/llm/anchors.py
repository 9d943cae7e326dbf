"""Sampling of all windows of a text by the least hash inside each, so that equal windows always meet.

Every window of `width` units (bytes or words) takes as its key the least hash of the runs of `k` units
inside it. The key depends on the window's content alone. Neighbouring windows mostly share their key, so a
text turns into few segments (key, first window, last window), about one for each 2 / (width - k + 2) units,
and no two equal windows, wherever they stand, get different keys.
"""

from __future__ import annotations

import numpy as np
import xxhash

from quirelake.llm.common import random_words, rolled, span_hashes, window_min, word_spans

PART = 2 << 20  # bytes of text handled at once
body_hash = xxhash.xxh3_64_intdigest


def segments(units: np.ndarray, offs: np.ndarray, width: int, k: int, loops: bool = False):
    """(row, key, first, count, loop) of each segment. units: one 64-bit word for each byte or word of all rows, row
    r at offs[r]:offs[r+1]; first: the first window's place in units; count: its number of windows; loop: where
    asked for, False only if the segment's windows are certain to differ from each other."""
    none = np.zeros(0, np.int64)
    if len(units) < width:
        return none, none, none, none, none.astype(bool)
    hashes, w = rolled(units, k), width - k + 1
    low = window_min(hashes, w)
    row = np.repeat(np.arange(len(offs) - 1), np.diff(offs))[: len(low)]
    ok = offs[row + 1] - np.arange(len(low)) >= width
    same = low[1:] == low[:-1]
    new, last = ok.copy(), ok.copy()
    new[1:] &= ~(ok[:-1] & same)
    last[:-1] &= ~(ok[1:] & same)
    first = np.flatnonzero(new)
    loop = np.zeros(len(first), bool)
    if loops and len(first):  # equal windows of one segment have their least runs at different places
        pad = np.zeros(w - 1, np.uint64)
        at = np.flatnonzero(hashes == window_min(np.concatenate([pad, low, pad]), w, np.maximum))
        at = at[:-1][(hashes[at[1:]] == hashes[at[:-1]]) & (np.diff(at) <= w)]
        at = np.minimum(at, np.maximum(offs[np.searchsorted(offs, at, "right")] - width, 0))
        loop[np.maximum(np.searchsorted(first, at, "right") - 1, 0)] = True
    return row[first], low[first].view(np.int64), first, np.flatnonzero(last) + 1 - first, loop


def byte_segments(data: np.ndarray, offs: np.ndarray, width: int, k: int, loops: bool = False):
    """As segments(), with the content hash of each segment, (row, key, body, first, count, loop); first counts from the row's start."""
    row, key, first, count, loop = segments(BYTES[data], offs, width, k, loops)
    raw, f = data.tobytes(), xxhash.xxh3_64_intdigest
    body = np.fromiter((f(raw[a:b]) for a, b in zip(first.tolist(), (first + count + width - 1).tolist(), strict=True)), np.uint64, len(first))
    return row, key, body.view(np.int64), first - offs[row] if len(row) else first, count, loop


def words(data: np.ndarray, offs: np.ndarray):
    """(starts, ends, offsets of rows among the words, hashes) of all words of all rows."""
    starts, ends = word_spans(data, offs)
    at = np.searchsorted(starts, offs)
    return starts, ends, at, span_hashes(data, starts, ends)


def word_segments(hashes: np.ndarray, at: np.ndarray, width: int, k: int, loops: bool = False):
    """As byte_segments(), over word hashes."""
    row, key, first, count, loop = segments(hashes, at, width, k, loops)
    raw, f = memoryview(np.ascontiguousarray(hashes)).cast("B"), xxhash.xxh3_64_intdigest
    body = np.fromiter((f(raw[8 * a : 8 * b]) for a, b in zip(first.tolist(), (first + count + width - 1).tolist(), strict=True)), np.uint64, len(first))
    return row, key, body.view(np.int64), first - at[row] if len(row) else first, count, loop


BYTES = random_words(256, 1001)


def flagged(row: np.ndarray, key: np.ndarray, lists) -> np.ndarray:
    """True where the row's list (an Arrow list column over the rows) holds the segment's key."""
    values = lists.flatten().to_numpy(zero_copy_only=False)
    if not len(values) or not len(key):
        return np.zeros(len(key), bool)
    sizes = np.diff(lists.offsets.to_numpy())
    if lists.null_count:
        sizes = np.where(lists.is_valid().to_numpy(zero_copy_only=False), sizes, 0)
    known, nth = np.unique(values, return_inverse=True)
    pairs = np.repeat(np.arange(len(sizes)), sizes) * len(known) + nth
    at = np.minimum(np.searchsorted(known, key), len(known) - 1)
    return (known[at] == key) & np.isin(row * len(known) + at, pairs)


def unions(row: np.ndarray, start: np.ndarray, end: np.ndarray, rows: int) -> list[list[tuple[int, int]]]:
    """For each row the maximal runs of its intervals, which come ordered by row, start and end."""
    out: list[list[tuple[int, int]]] = [[] for _ in range(rows)]
    if len(row):
        new = np.flatnonzero(np.r_[True, (row[1:] != row[:-1]) | (start[1:] > end[:-1])])
        for r, s, e in zip(row[new].tolist(), start[new].tolist(), end[np.r_[new[1:] - 1, len(end) - 1]].tolist(), strict=True):
            out[r].append((s, e))
    return out
