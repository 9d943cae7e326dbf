import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from quirelake.llm.line_rules import cleaned, line_passes, repeat_words
from tests.llm.helpers import DOCS, copies, table


def base(text):
    t = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    tri = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    hit = {i + k for i in range(len(w) - 2) if tri[tuple(w[i : i + 3])] > 1 for k in range(3)}
    seen, dup = set(), 0
    for line in t.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(hit), len(w) < 50 or 100 * len(hit) > 50 * len(w)


def test_base_counts(spark):
    rng = random.Random(1)
    texts = copies(8) + [" ".join(rng.choice("abc") for _ in range(n)) for n in (1, 2, 3, 4, 5, 60)] + ["a|b #*$%&|<>\n\na|b #*$%&|<>", "x\x0by\x0cz\r\n" * 30, "w " * 5000]
    got = cleaned(table(spark, texts, extra="1 as s")).orderBy("doc_id").collect()
    assert [(r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got] == [base(t) for t in texts]


@pytest.mark.parametrize("seed", [1, 2])
def test_repeat_words(spark, seed):
    rng = random.Random(seed)
    lists = [[rng.choice(["a", "b", "ab", "é"]) for _ in range(rng.randint(0, 12))] for _ in range(150)]
    got = spark.createDataFrame([(i, x) for i, x in enumerate(lists)], "i int, w array<string>").select("i", repeat_words(F.col("w")).alias("n")).orderBy("i").collect()
    assert [r.n for r in got] == [base(" ".join(x))[4] for x in lists]


def test_lines_and_verdicts(spark):
    prose = "\n".join("This " + " ".join(f"word{i}a{k}" for k in range(12)) + " ends." for i in range(12))
    menu = "\n".join(" | ".join(f"item{i}x{k}" for k in range(9)) for i in range(9))
    shout = "\n".join(" ".join(f"LOUD{i}{k}!!" for k in range(9)) for i in range(9))
    texts = [prose, menu, shout, prose + "\n" + menu, prose + "\nClick here to subscribe.", "short text.", None, ""]
    got = cleaned(table(spark, texts)).orderBy("doc_id").collect()
    assert [r.kept for r in got] == [True, False, False, True, True, False, False, False]
    assert got[0].clean_text == prose and got[3].clean_text == prose and got[4].clean_text == prose and got[1].clean_text == ""
    assert cleaned(spark.createDataFrame([], DOCS)).collect() == []


def test_clean_labelled_documents_stay(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    got = cleaned(docs).join(labels, "doc_id").where("n_words >= 50").groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("kept")).collect()
    kept = {r.quality: r.kept for r in got}
    assert kept[1] >= 0.98 and kept[0] <= 0.25


def test_phrases_are_whole_words(spark):
    lines = ["They design in small teams", "the catalog in use is old", "Please sign in now", "Log in: here", "cookies"]
    passed = spark.createDataFrame([(x,) for x in lines], "l string").select(line_passes(F.col("l")).alias("p")).collect()
    assert [r.p for r in passed] == [True, True, False, False, False]


def test_repeated_rows(spark):
    rows = cleaned(table(spark, ["one two three\n" * 30] * 2 + [None], [1, 1, 1])).collect()
    assert len(rows) == 3 and rows[0][:6] == rows[1][:6]
