import random
import re

import numpy as np
import pytest
import xxhash

from quirelake.llm.simhash import fingerprint, linked, near_duplicates, near_links, thresholds
from tests.llm.helpers import copies, table


def brute_print(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 3]).encode(), seed=42) for i in range(max(1, len(w) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(fps, most=3):
    parent = list(range(len(fps)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= most:
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    return [root(i) for i in range(len(fps))]


def near_prints(seed, n):
    rng = random.Random(seed)
    fps = [rng.getrandbits(64) for _ in range(n)]
    while len(fps) < 4 * n:
        x = rng.choice(fps)
        for _ in range(rng.randint(1, 4)):
            x ^= 1 << rng.randrange(64)
        fps.append(x)
    return sorted(set(fps))


def test_fingerprint():
    for t in [*copies(2), "A b", "É a B", None]:
        assert fingerprint((t or "").encode()) == brute_print(t)


def test_thresholds():
    assert thresholds([[0, 5, 50, 500]] * 4, 3) == [0, 0, 0, 0]
    assert sum(thresholds([[0, 5, 50, 500], [0, 900, 950, 999], [0, 1, 2, 3]], 3)) == 1


@pytest.mark.parametrize("n", [20, 400])
def test_near_links(n):
    fps = near_prints(n, n)
    rows = near_links(np.array(fps, np.uint64), 3)
    parent = list(range(len(fps)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in rows:
        a, b = root(i), root(j)
        assert a != b
        parent[max(a, b)] = min(a, b)
    assert [root(i) for i in range(len(fps))] == brute_components(fps)


@pytest.mark.parametrize("m", [2, 3, 4])
def test_linked(spark, m):
    fps = near_prints(m, 60)
    signed = np.array(fps, np.uint64).view(np.int64).tolist()
    links = linked(spark.createDataFrame([(x,) for x in signed], "fp long"), m=m).collect()
    at = {x: i for i, x in enumerate(signed)}
    parent = list(range(len(fps)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for r in links:
        a, b = root(at[r.a]), root(at[r.b])
        parent[max(a, b)] = min(a, b)
    assert [root(i) for i in range(len(fps))] == brute_components(fps)


def test_near_duplicates(spark):
    texts = copies(7) * 2
    long = [f"w{i}" for i in range(400)]
    texts += [" ".join(long), " ".join([*long[:200], "x", *long[201:]]), " ".join(long[:399])]
    ids = [*range(5, 5 + len(texts))]
    got = sorted(near_duplicates(table(spark, texts, ids, extra="1 as fp")).collect())
    fps = [brute_print(t) for t in texts]
    assert [r.fingerprint for r in got] == [f"{x:016x}" for x in fps]
    assert [r.component_id for r in got] == [ids[i] for i in brute_components(fps)]
    assert near_duplicates(table(spark, [])).collect() == []
    assert {(r.doc_id, r.component_id) for r in near_duplicates(table(spark, [None, "", "a"], [None, 4, None])).collect()} == {(None, 4), (4, 4), (None, None)}


def test_large_buckets_divide():
    """Fingerprints that agree in some groups of bits, and links across the size switch, against all pairs."""
    rng = np.random.default_rng(3)
    for bits in ([*range(16)], [*range(0, 64, 4)], [*range(40, 64)], [*range(64)]):
        seeds = rng.integers(0, 1 << 20, 60)
        fps = {sum(1 << b for b in rng.choice(bits, 8, replace=False).tolist()) ^ int(s) << 20 for s in seeds for _ in range(14)}
        fps |= {x ^ 1 << int(b) for x in list(fps)[:200] for b in rng.choice(64, 2)}
        fps = np.array(sorted(fps), np.uint64)
        assert len(fps) > 256
        got = near_links(fps, 3)
        assert all(int(fps[i] ^ fps[j]).bit_count() <= 3 for i, j in got)
        parent = list(range(len(fps)))

        def root(i):
            while parent[i] != i:
                i = parent[i]
            return i

        for i in range(len(fps)):
            for j in np.flatnonzero(np.bitwise_count(fps ^ fps[i]) <= 3).tolist():
                parent[root(j)] = root(i)
        want = len({root(i) for i in range(len(fps))})
        assert len(got) == len(fps) - want
