"""Heading graph, roles and hints on stated cases."""

from pyspark.sql import functions as F

from quirelake.operators import contents as C
from quirelake.operators import regions as R

CAND = "book string, text string, page_no int, source string, label string, family string, level_hint int, top boolean, weight string, align string, confidence double"


def candidates(spark, rows):
    df = spark.createDataFrame([("b", t, p, s, "doc_title" if s == "block" else "", "chapter", 1, True, "bold", "center", 0.5) for t, p, s in rows], CAND)
    col = lambda c: F.col(c)
    return df.withColumns({"title_key": C.title_key(F.col("text")), "score": C.evidence(col), "strong": C.is_strong(col)})


def test_heading_graph(spark):
    rows = spark.createDataFrame([("b", 1, "One", 3), ("b", 2, "Two", 10), ("b", 3, "Three", 20), ("b", 4, "Four", 30), ("b", 5, "Five", 5), ("b", 6, "Six", 90)], "book string, row_id int, title string, target int")
    cand = candidates(spark, [("ONE", 4, "block"), ("one", 5, "font_band"), ("Two", 16, "block"), ("Three", 31, "block"), ("Five", 60, "block")])
    roles = spark.createDataFrame([("b", p, "note" if p == 25 else "body") for p in range(1, 80)], "book string, page_no int, page_role string")
    got = {r.row_id: (r.anchor, r.strategy) for r in C.heading_graph(rows, cand, roles, ["book"]).collect()}
    assert got == {1: (4, "local_exact"), 2: (16, "expanded_exact"), 3: (20, "monotonic_target"), 4: (30, "provisional"), 5: (5, "provisional"), 6: (None, "unresolved")}
    assert C.heading_graph(rows.where("false"), cand, roles, ["book"]).collect() == []


def test_roles(spark):
    rows = [("Part One", "", 1, "body"), ("Chapter 4: X", "", 3, "body"), ("A STUDY OF X", "", 1, "front_matter"), ("To my friend", "", 1, "front_matter"), ("Some section", "", 3, "body"), ("A chapter", "", 2, "body"), ("Notes", "", 2, "note"), ("Index", "", 2, "other"), ("Appendix A", "back_matter", 2, "body"), ("Acknowledgments", "", 2, "body"), ("x", "container", 1, "body"), (None, "", 1, "body"), ("Conclusion", "", 1, "other"), ("Odd", "", 1, "other")]
    df = spark.createDataFrame(rows, "t string, r string, l int, p string")
    got = [r.x for r in df.select(C.semantic_role(F.col("t"), F.col("r"), F.col("l"), F.lit(2), F.col("p")).alias("x")).collect()]
    assert got == ["part", "chapter", "book_title", "front_matter", "section", "chapter", "endnotes", "back_matter", "post_body", "front_matter", "part", "unknown", "chapter", "unknown"]


def test_hints_against_a_walk(spark):
    import random

    rng = random.Random(2)
    rows = [(f"b{b}", p, rng.choice(["body", "note", "other", "front_matter", "noise"]), rng.choice(["", "index", "x"]), 0.5, rng.choice([None, 0, 3, 8])) for b in range(30) for p in range(1, 15)]
    rows = [(b, p, r, w, c, next(x[5] for x in rows if x[0] == b)) for b, p, r, w, c, _ in rows]
    got = {(r.book, r.page_no): (r.page_role, r.reason, r.confidence) for r in R.hinted_roles(spark.createDataFrame(rows, "book string, page_no int, page_role string, reason string, confidence double, hint int"), ["book"]).collect()}
    state = {}
    for b, p, role, why, sure, hint in rows:
        seen, stopped = state.get(b, (False, False))
        if hint and p >= hint and not stopped:
            if role == "note":
                seen = True
            elif seen and role == "other" and why in R.STOP_REASONS:
                stopped = True
            elif role in ("body", "other", "front_matter"):
                role, why, sure, seen = "note", "endnotes_start_page_hint", 0.9, True
        state[b] = (seen, stopped)
        assert got[b, p] == (role, why, sure), (b, p)
