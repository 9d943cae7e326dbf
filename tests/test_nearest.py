"""Bounds of likeness against difflib; titles of large books against all pairs."""

import difflib
import random
import time

import numpy as np
from pyspark.sql import functions as F

from quirelake.operators import matching as M
from quirelake.operators.nearest import Texts, common, first_best


def text(r, most=90):
    return "".join(r.choice("abcde é漢😀") for _ in range(r.randrange(most)))


def test_bounds_hold():
    r = random.Random(4)
    for n in (0, 1, 80):
        texts = [text(r) for _ in range(n)] + [""] * (n > 1)
        own = Texts(texts)
        for x in ["", *(text(r, 200) for _ in range(40)), *texts[:3]]:
            bound, within = own.bounds(x, 0.58)
            for t, b, w in zip(texts, bound, within, strict=True):
                ratio = difflib.SequenceMatcher(None, x, t).ratio()
                assert b >= ratio or b == ratio == 0
                assert w or not (x in t or t in x)
                if b >= 0.58 and x and t:
                    assert b == 2.0 * common(x, t) / (len(x) + len(t))


def test_first_best():
    scores = [0.5, 0.9, 0.9, 1.0, 0.7]
    assert first_best(np.array([1.0, 0.9, 1.0, 1.0, 1.0]), scores.__getitem__, 0.6) == (1.0, 3)
    assert first_best(np.array([1.0, 0.9, 1.0, 0.1, 1.0]), scores.__getitem__, 0.6) == (0.9, 1)
    assert first_best(np.array([0.5]), scores.__getitem__, 0.6) == first_best(np.array([]), scores.__getitem__, 0.6) == (0.0, -1)


def test_scores_against_all_pairs():
    r = random.Random(5)
    words = "the long night of rivers and roads to Été cillmi notes chapter".split()
    title = lambda: " ".join(r.choice(words) for _ in range(r.randrange(1, 7)))
    row = lambda t: {"title": t, "match_key": t.lower().replace(" ", ""), "number": r.randrange(3), "rest_key": t.lower().replace(" ", "")[2:]}
    own = [row(title()) for _ in range(150)]
    for score, least, kind in ((M.signal_score, 0.78, M.SignalBounds), (M.heading_score, 0.84, M.WordBounds), (M.note_title_score, 0.58, M.WordBounds)):
        bounds = kind(own)
        for x in (row(title() + r.choice(["", " x", " and a very long line that goes on" * 6])) for _ in range(60)):
            top = max((score(x, c), -i) for i, c in enumerate(own))
            want = (top[0], -top[1]) if top[0] >= least else (0.0, -1)
            assert first_best(bounds(x, least), lambda i, x=x, score=score: score(x, own[i]), least) == want


def test_a_large_book(spark):
    """3000 chapters and 600 titles without an equal key: all pairs took minutes."""
    name = lambda c, i: F.concat_ws(" ", *(F.substring(F.sha2((i + k).cast("string"), 256), 1, 7) for k in range(0, 60000, 10000)), F.lit(c))
    own = M.numbered_chapters(spark.range(3000).select(F.lit("b").alias("book"), F.col("id").cast("int").alias("chapter_no"), name("end", F.col("id")).alias("title")), ["book"])
    titles = spark.range(600).select(F.lit("b").alias("book"), "id", name("ends", F.col("id") * 5 % 3000).alias("title"))
    began = time.perf_counter()
    got = M.best_chapters(titles, own, ["book"], M.heading_score, M.LEAST_HEADING).collect()
    assert time.perf_counter() - began < 60
    assert len(got) == 600 and all(r.chapter_no == r.id * 5 % 3000 and r.score > 0.95 for r in got)
