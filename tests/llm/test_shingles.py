import random
import re

import corpus_pipeline
from quirelake.llm.shingles import near_copies
from tests.llm.helpers import copies, table


def shingles(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute_groups(texts, least=0.8):
    sets, root = [shingles(t) for t in texts], list(range(len(texts)))
    for i, x in enumerate(sets):
        for j in range(i):
            if len(x & sets[j]) >= least * len(x | sets[j]) and root[i] != root[j]:
                a, b = sorted((root[i], root[j]))
                root = [a if r == b else r for r in root]
    return root


def edited(seed):
    """Texts with up to ten words replaced: similarities on both sides of 0.8, chains among them."""
    rng, out = random.Random(seed), []
    for _ in range(12):
        own = [f"w{rng.randint(0, 9999)}" for _ in range(rng.choice([40, 150, 400]))]
        for _ in range(6):
            out.append(" ".join(own))
            own = list(own)
            for _ in range(rng.randint(0, max(1, len(own) // 35))):
                own[rng.randrange(len(own))] = f"x{rng.randint(0, 9999)}"
    return out


def test_against_brute_force(spark):
    texts = [*copies(7), *edited(1), "A b", "a  B", "a b c", "", " "]
    want = brute_groups(texts)
    got = {r.doc_id: r.root for r in near_copies(table(spark, texts).repartition(3)).collect()}
    first = {}
    for i in range(len(texts)):
        first.setdefault(got[i], i)
    assert [first[got[i]] for i in range(len(texts))] == want
    assert len(set(want)) < len(texts) - 20


def test_stage_drops_near_copies_of_0_83(spark):
    """Documents 1 and 177 have a similarity of 0.83 and fingerprints 11 bits apart."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = docs.orderBy("doc_id").collect()
    got = {r.doc_id for r in corpus_pipeline.deduplicate(spark, docs, "").collect()}
    groups = brute_groups([r.text for r in rows])
    assert got == {r.doc_id for i, r in enumerate(rows) if groups[i] == i}
    assert 1 in got and 177 not in got
    assert corpus_pipeline.deduplicate(spark, table(spark, []), "").collect() == []
