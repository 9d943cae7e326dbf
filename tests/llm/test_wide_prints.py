import random

import numpy as np

import corpus_pipeline
from quirelake.llm import shingles, simhash
from quirelake.llm.common import Scratch
from quirelake.llm.shingles import bucket_links, distinct, most_bits
from quirelake.llm.simhash import CHECKS, MATRIX, majorities, near_lists, wide_lists, wide_plan
from tests.llm.helpers import table


def test_stage_takes_its_candidates_from_groups_of_bits(spark, monkeypatch):
    """The near-dedup stage picks thresholds by op7's programme, and without lists of its groups only copies go."""
    own = [f"w{i}" for i in range(200)]
    docs = table(spark, [" ".join(own), " ".join(own), " ".join([*own[:100], "x", *own[101:]]), "other text"])
    picked, plain = [], simhash.thresholds
    monkeypatch.setattr(simhash, "thresholds", lambda cost, total: picked.append(plain(cost, total)) or picked[-1])
    assert sorted(r.doc_id for r in corpus_pipeline.deduplicate(spark, docs, "").collect()) == [0, 3]
    assert len(picked) == 1 and {-1, 0} == set(picked[0])
    lists = shingles.wide_lists
    monkeypatch.setattr(shingles, "wide_lists", lambda *args: lists(*args).where("false"))
    assert sorted(r.doc_id for r in corpus_pipeline.deduplicate(spark, docs, "").collect()) == [0, 2, 3]


def test_majorities():
    rng = np.random.default_rng(5)
    sizes = [1, 2, 5, 254, 255, 256, 700, 3]
    at = np.r_[0, np.cumsum(sizes)]
    hashes = rng.integers(0, 1 << 63, at[-1]).astype(np.uint64)
    got = majorities(hashes, at, 3)
    salts = simhash.random_words(3, 13)
    for r, n in enumerate(sizes):
        for w in range(3):
            h = simhash.mixed(hashes[at[r] : at[r + 1]] + salts[w]).tolist()
            assert int(got[r, w]) == sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > n)


def test_distinct():
    hashes, at = distinct(np.array([3, 1, 3, 2, 2, 1, 1], np.uint64), np.array([0, 3, 3, 5, 7, 7]))
    assert (hashes.tolist(), at.tolist()) == ([1, 3, 2, 1], [0, 2, 2, 3, 4, 4])


def brute_pairs(rows, most):
    return {(i, j) for j in range(len(rows)) for i in range(j) if sum((a ^ b).bit_count() for a, b in zip(rows[i], rows[j], strict=True)) <= most}


def flipped(rng, row, n):
    row = list(row)
    for b in rng.sample(range(64 * len(row)), n):
        row[b // 64] ^= 1 << b % 64
    return row


def test_near_lists():
    rng = random.Random(4)
    for n in (30, MATRIX + 40):
        rows = [[rng.getrandbits(64) for _ in range(CHECKS)] for _ in range(n // 2)]
        rows += [flipped(rng, rng.choice(rows[:9]), rng.randint(0, 70)) for _ in range(n - len(rows))]
        lists = near_lists(np.array(rows, np.uint64).T, 57)
        held = {(i, j) for x in lists for j in x for i in x if i < j}
        assert brute_pairs(rows, 57) <= held
        assert all(len(x) > 1 for x in lists)
    assert near_lists(np.zeros((CHECKS, 40), np.uint64), 57) == [[*range(40)]]


def test_pigeonhole(spark):
    """All pairs that differ in fewer bits than groups are probed are in a list, over several batches and rounds."""
    rng = random.Random(8)
    words, m, need = wide_plan(1 << 17, shingles.SHARE, 1e-6)
    assert need > simhash.ROUND and words * m >= need
    rows = [[rng.getrandbits(64) for _ in range(words + CHECKS)] for _ in range(300)]
    rows += [flipped(rng, rng.choice(rows), rng.randint(1, need - 1)) for _ in range(300)]
    near = brute_pairs(rows, need - 1)
    assert len(near) > 250
    signed = [(i, [x - (1 << 64) if x >> 63 else x for x in r]) for i, r in enumerate(rows)]
    prints = spark.createDataFrame(signed, "node long, fp array<long>").repartition(3)
    got = wide_lists(prints, Scratch(spark, "test"), words, m, need, most_bits(CHECKS)).collect()
    assert near <= {(i, j) for r in got for j in r.nodes for i in r.nodes if i < j}


def test_bucket_links():
    rng = random.Random(6)
    sets, fps = [], []
    for _ in range(8):
        own = rng.sample(range(1 << 60), rng.choice([5, 9, 60, 300]))
        for _ in range(6):
            h = np.array(sorted(own), np.uint64)
            sets.append(h)
            fps.append(majorities(h, np.array([0, len(h)]), 9)[0])
            own = [x if rng.random() > 0.05 else rng.randrange(1 << 60) for x in own]
    links, root = bucket_links(sets, np.array(fps).T.copy()), list(range(len(sets)))
    for i in range(len(sets)):
        for j in range(i):
            if shingles.alike(sets[j], sets[i]) and root[i] != root[j]:
                root = [root[j] if r == root[i] else r for r in root]
    assert all(root[i] == root[j] for i, j in links)
    assert len(links) == len(sets) - len(set(root))


def test_loss_of_pairs_at_the_least_similarity():
    """Sets of 300 shingles at 0.8 meet in a probed group about as often as computed, and pass the comparison."""
    rng = np.random.default_rng(2)
    words, m, need = wide_plan(1 << 17, shingles.SHARE, 1e-6)
    both, ends = rng.integers(0, 1 << 63, (60, 320)).astype(np.uint64), np.array([0, 304, 608])
    for row in both:  # 264 of 340 in common would be 0.78; 272 of 336 are 0.81
        x = np.r_[row[:304], row[:272], rng.integers(0, 1 << 63, 32).astype(np.uint64)]
        a, b = majorities(x, ends, words + CHECKS)
        groups = [int(a[w] ^ b[w]) >> 64 * g // m & (1 << 64 // m) - 1 for w in range(words) for g in range(m)]
        assert not all(groups)
        assert np.bitwise_count(a ^ b)[words:].sum() <= most_bits(CHECKS)
