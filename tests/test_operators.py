import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quirelake.functions import hooks
from quirelake.functions import text as T
from quirelake.operators import folds
from quirelake.operators import notes as N
from quirelake.operators import ordering as O


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_numbered_over_blocks(spark):
    data = [("a", i * 7) for i in range(50)] + [("b", 3), ("b", 1_000_000)]
    df = spark.createDataFrame(data, "g string, o long")
    got = {(r.g, r.o): r.n for r in O.numbered(df, ["g"], "o", "n", block=20).collect()}
    assert got == {**{("a", i * 7): i + 1 for i in range(50)}, ("b", 3): 1, ("b", 1_000_000): 2}


def test_islands_and_strict_runs(spark):
    df = spark.createDataFrame([("a", p, i) for i, p in enumerate([1, 2, 2, 3, 5, 6, 0, -1])], "g string, p int, t int")
    assert rows(O.islands(df, ["g"], "p")) == [("a", 1, 3, 3), ("a", 5, 6, 2)]
    assert rows(O.islands(df, ["g"], "p", gap=2)) == [("a", 1, 6, 5)]
    assert len(rows(O.strict_runs(df.where("p > 0"), ["g"], "p", "t"))) == 3


def test_merged_runs(spark):
    df = spark.createDataFrame([("a", 1, 9), ("a", 2, 3), ("a", 11, 12), ("a", 14, 15)], "g string, start int, end int")
    assert rows(O.merged_runs(df, ["g"], 1)) == [("a", 1, 9, 2), ("a", 11, 12, 1), ("a", 14, 15, 1)]
    assert rows(O.merged_runs(df, ["g"], 2)) == [("a", 1, 15, 4)]


@pytest.mark.parametrize("width", [1, 4, 100])
def test_interval_and_as_of_joins(spark, width):
    rng = random.Random(width)
    points = [(rng.choice("ab"), rng.randint(0, 60), i) for i in range(80)]
    ranges = [(rng.choice("ab"), s := rng.randint(0, 60), s + rng.randint(0, 20), i) for i in range(20)]
    p = spark.createDataFrame(points, "g string, at int, i int")
    r = spark.createDataFrame(ranges, "g string, s int, e int, j int")
    got = O.interval_join(p, r, ["g"], "at", "s", "e", width).select("i", "j")
    assert rows(got) == sorted(((i, j) for g, at, i in points for h, s, e, j in ranges if g == h and s <= at <= e), key=repr)
    starts = {(g, s): j for g, s, _, j in ranges}
    one = spark.createDataFrame([(g, s, j) for (g, s), j in starts.items()], "g string, s int, j int")
    got = {r.i: r.j for r in O.as_of(p, one, ["g"], "at", "s", ["j"]).collect()}
    for g, at, i in points:
        before = [s for h, s in starts if h == g and s <= at]
        assert got[i] == (starts[g, max(before)] if before else None)


def test_filling(spark):
    df = spark.createDataFrame([("a", 1, 10), ("a", 2, None), ("a", 3, 12), ("a", 4, None), ("a", 5, 20), ("a", 6, None)], "g string, o int, v int")
    assert [r.v_filled for r in O.filled(df, ["g"], "o", "v").orderBy("o").collect()] == [10, 11, 12, None, 20, None]
    assert [r.v_filled for r in O.interpolated(df, ["g"], "o", "v").orderBy("o").collect()] == [10, 11, 12, 16, 20, None]


def test_latest_and_upserted(spark):
    df = spark.createDataFrame([(1, 1, "a"), (1, 3, "b"), (1, 2, "c"), (2, 1, None)], "k int, at int, v string")
    assert rows(O.latest(df, ["k"], ["at"])) == [(1, 3, "b"), (2, 1, None)]
    old = spark.createDataFrame([(1, "x", "y"), (2, "z", None)], "k int, a string, b string")
    new = spark.createDataFrame([(1, None, "n"), (3, "q", None)], "k int, a string, b string")
    assert rows(O.upserted(old, new, ["k"])) == [(1, "x", "n"), (2, "z", None), (3, "q", None)]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from("123"), max_size=6), st.lists(st.sampled_from("123"), max_size=6))
def test_alignment(a, b):
    score, left, right = N.aligned(a, b)
    assert [x for x in left if x is not None] == a and [x for x in right if x is not None] == b
    assert score == sum(-1 if x is None or y is None else 1 if x == y else -1 for x, y in zip(left, right, strict=True))


def test_chunks(spark):
    df = spark.createDataFrame([("c", i, n) for i, n in enumerate([4, 4, 1, 30, 2, 2, 2])], "g string, o int, n int")
    assert [r.chunk for r in folds.chunked(df, ["g"], "o", "n", 10).orderBy("o").collect()] == [0, 0, 1, 2, 3, 3, 3]


def test_note_items(spark):
    lines = ["1. First", "more", "", "2) Second", "99. then lower", "[3] Third"]
    df = spark.createDataFrame([("d", i, s) for i, s in enumerate(lines)], "g string, o long, s string")
    assert [(r.number, r.text) for r in folds.note_items(df, ["g"], "o", "s").orderBy("at").collect()] == [(1, "First more"), (2, "Second 99. then lower"), (3, "Third")]


def test_arrow_functions(spark):
    garbled = "".join(chr(ord(c) - 48) if ord(c) > 80 else c for c in "this is a readable sentence in fact")
    df = spark.createDataFrame([("Élève ß", "abc [^x] [^y] [^x]", ["y", "x"]), (None, None, None)], "a string, t string, r array<string>")
    got = df.select(folds.folded("a"), folds.local_references("t", "r"), folds.ratio("a", "a")).collect()
    assert got[0][0] == "eleve" and got[0][1] == "abc [^2] [^1] [^2]" and got[0][2] == 1.0 and got[1][0] == ""
    assert spark.createDataFrame([(garbled,)], "t string").select(folds.repaired("t")).first()[0] != ""


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(max_size=20), min_size=1, max_size=8))
def test_text_functions_take_any_text(spark, texts):
    df = spark.createDataFrame([(t,) for t in [*texts, None]], "t string")
    c = F.col("t")
    got = df.select("t", T.squeezed(c).alias("s"), T.is_meta(c).alias("m"), T.title_key(c).alias("k"), T.ends_sentence(c).alias("e"), T.garble_stats(c).alias("g"), T.note_definition(c).alias("d"), T.roman(c).alias("r")).collect()
    assert len(got) == len(texts) + 1 and all(r.s is not None for r in got)


def test_hooks(spark):
    df = spark.createDataFrame([(i, f"t{i}") for i in range(10)], "i int, t string").repartition(2)

    def shout(texts):
        return [t.upper() for t in texts]

    def broken(texts):
        raise RuntimeError("429 too many requests")

    assert rows(hooks.called(df, "t", shout, most=3).select("i", "answer")) == [(i, f"T{i}") for i in range(10)]
    assert {r.error for r in hooks.called(df, "t", broken).collect()} == {"rate"}
    assert [hooks.error_class(x) for x in ("quota hit", "connection reset", "bad input")] == ["quota", "transient", "fatal"]
