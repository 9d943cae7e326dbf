import hashlib
import re

import pytest

from quirelake.llm.substring_dedup import repeated_words
from tests.llm.helpers import copies, table


def brute(texts, width):
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in texts]
    seen, out = set(), []
    for own in words:
        gone = [False] * len(own)
        for i in range(len(own) - width + 1):
            w = tuple(own[i : i + width])
            if w in seen:
                gone[i : i + width] = [True] * width
            seen.add(w)
        left = [w for w, g in zip(own, gone, strict=True) if not g]
        out.append((len(own), sum(gone), hashlib.sha256(" ".join(left).encode()).hexdigest()))
    return out


@pytest.mark.parametrize(("width", "seed", "vocabulary"), [(20, 1, None), (6, 2, None), (4, 3, ["a", "b"]), (20, 4, ["x", "y"])])
def test_against_brute_force(spark, width, seed, vocabulary):
    texts = copies(seed, vocabulary=vocabulary)
    got = repeated_words(table(spark, texts).repartition(5), width).orderBy("doc_id").collect()
    assert [tuple(r)[1:] for r in got] == brute(texts, width)


def test_edges(spark):
    assert repeated_words(table(spark, [])).collect() == []
    long = " ".join(f"w{i}" for i in range(25))
    got = repeated_words(table(spark, [long, long, None, "a"], ids=[5, None, 6, 6], extra="1 as start")).collect()
    assert sorted((r.doc_id is None, r.n_words, r.n_removed) for r in got) == [(False, 0, 0), (False, 1, 0), (False, 25, 25), (True, 25, 0)]
    again = repeated_words(table(spark, [long + " " + long])).first()
    assert (again.n_words, again.n_removed) == (50, 25)


def test_rows_of_equal_id_rank_by_row(spark):
    """Whether the passage's surroundings differ (its node branches) or not, one of the rows keeps it."""
    line = lambda c, n: " ".join(f"{c}{i}" for i in range(n))
    both = [line("w", 25), line("a", 9) + " " + line("w", 25) + " " + line("b", 9)]
    for texts in (both, [*both, line("w", 25) + " z"], [line("w", 25)] * 2):
        got = repeated_words(table(spark, texts, [5] * len(texts))).collect()
        assert sorted(r.n_removed for r in got) == ([0, 0] if texts[0] == texts[1] else [0, *[25] * (len(texts) - 1)])
    long = line("w", 25) + " "
    assert [r.n_removed for r in repeated_words(table(spark, [long * 40_000, long], [1, 2])).orderBy("doc_id").collect()] == [25 * 39_999, 25]
