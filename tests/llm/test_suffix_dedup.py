import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from quirelake.llm.suffix_dedup import repeated_bytes
from quirelake.llm.suffixes import repeated_starts, suffix_array
from tests.llm.helpers import copies, table


def brute(texts, length):
    raw = [(t or "").encode() for t in texts]
    seen = Counter(x[i : i + length] for x in raw for i in range(len(x) - length + 1))
    out = []
    for x in raw:
        gone = np.zeros(len(x), bool)
        for i in range(len(x) - length + 1):
            if seen[x[i : i + length]] > 1:
                gone[i : i + length] = True
        runs = int((gone & ~np.r_[False, gone[:-1]]).sum()) if len(x) else 0
        out.append((len(x), int(gone.sum()), runs, hashlib.sha256(bytes(b for b, g in zip(x, gone, strict=True) if not g)).hexdigest()))
    return out


@pytest.mark.parametrize("spool", [0, 40, 1 << 20])
def test_suffix_array(spool):
    rng = random.Random(spool)
    for _ in range(150):
        a = np.array([rng.randint(1, rng.choice([1, 2, 3, 256])) for _ in range(rng.randint(1, 50))])
        assert suffix_array(a, spool).tolist() == sorted(range(len(a)), key=lambda i: a[i:].tolist())
    assert suffix_array(np.zeros(0, int)).tolist() == []


def test_repeated_starts():
    a = np.array([1, 2, 3, 1, 2, 3, 1])
    assert repeated_starts(a, 3, np.array([1, 1, 1, 1, 1, 0, 0], bool)).tolist() == [True, True, False, True, True, False, False]


@pytest.mark.parametrize(("length", "seed"), [(200, 1), (40, 2), (32, 3)])
def test_against_brute_force(spark, length, seed):
    texts = copies(seed)
    got = repeated_bytes(table(spark, texts).repartition(5), length, shard_bytes=1000).orderBy("doc_id").collect()
    assert [tuple(r)[1:] for r in got] == brute(texts, length)


def test_edges(spark):
    assert repeated_bytes(table(spark, [])).collect() == []
    texts = ["q" * 199, "w" * 200, "e" * 201, None, None]
    got = repeated_bytes(table(spark, texts, ids=[None, 1, 1, 2, 2], extra="1 as key")).collect()
    assert sorted((r.n_bytes, r.n_removed, r.n_spans) for r in got) == [(0, 0, 0), (0, 0, 0), (199, 0, 0), (200, 0, 0), (201, 201, 1)]
    twice = repeated_bytes(table(spark, ["z" * 50 + "k" * 200] * 2, ids=[3, 3])).collect()
    assert [(r.doc_id, r.n_removed) for r in twice] == [(3, 250)] * 2


def test_very_long_text(spark):
    unit = "".join(chr(97 + i * i % 26) + str(i) for i in range(100))
    rows = repeated_bytes(table(spark, [unit * 3000, "é" * 90, unit, None], [3, 2, 1, 1])).orderBy("doc_id", "n_bytes").collect()
    assert [(r.n_bytes, r.n_removed) for r in rows] == [(0, 0), (len(unit), len(unit)), (180, 0), (3000 * len(unit), 3000 * len(unit))]
