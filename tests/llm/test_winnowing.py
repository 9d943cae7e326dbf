import hashlib
import random
import re

import pytest

from quirelake.llm.winnowing import decontaminated
from tests.llm.helpers import table


def words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def brute(texts, items):
    out = []
    for t in texts:
        w, hit, found = words(t), set(), set()
        for i, x in items:
            b = words(x)
            n = min(13, len(b))
            windows = {tuple(b[j : j + n]) for j in range(len(b) - n + 1)} if n else set()
            for p in range(len(w) - n + 1):
                if n and tuple(w[p : p + n]) in windows:
                    hit.update(range(p, p + n))
                    found |= {i} - {None}
        if not found:
            hit = set()
        ids = ",".join(sorted(map(str, found)))
        out.append((len(w), len(hit), len(found), hashlib.sha256(ids.encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)))
    return out


def case(seed, short):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcé漢9") for _ in range(rng.randint(1, 3))) for _ in range(60)]
    line = lambda k: " ".join(rng.choice(vocabulary) for _ in range(k))
    items = [(i, line(rng.choice([13, 14, 20, 30]))) for i in range(8)]
    if short:
        items += [(20 + i, line(n)) for i, n in enumerate(short)]
    texts = []
    for _ in range(60):
        parts = [line(rng.randint(0, 40))]
        for _ in range(rng.randint(0, 2)):
            own = rng.choice(items)[1].split()
            a = rng.randint(0, max(0, len(own) - 12))
            parts += [rng.choice([" ", "--", ", "]).join(own[a : a + rng.choice([12, 13, 14, 40])]).upper().replace("É", "é"), line(rng.randint(0, 30))]
        texts.append(" ".join(parts))
    return [*texts, None, "", "...", items[0][1]], [*items, (90, ""), (91, None), (92, "?!")]


@pytest.mark.parametrize(("seed", "short"), [(1, []), (2, [12, 9]), (3, [8, 7, 5]), (4, [4, 3, 2]), (5, [1, 6])])
def test_against_brute_force(spark, seed, short):
    texts, items = case(seed, short)
    got = decontaminated(table(spark, texts, extra="1 as items").repartition(3), spark.createDataFrame(items, "item_id long, text string")).orderBy("doc_id").collect()
    assert [tuple(r)[1:6] for r in got] == brute(texts, items)


def test_edges(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminated(table(spark, []), none).collect() == []
    got = decontaminated(table(spark, ["a b", "a b", "c"], [1, 1, None]), spark.createDataFrame([(5, "A b"), (5, "zz"), (None, "c")], "item_id long, text string")).collect()
    assert sorted((r.n_hit, r.contaminated) for r in got) == [(0, False), (2, True), (2, True)]
    assert [r.n_hit for r in decontaminated(table(spark, ["a b"]), none).collect()] == [0]
