"""Note scans against stated cases and a plain walk."""

import pytest
from pyspark.sql import functions as F

from quirelake.functions import note_lines as L
from quirelake.operators.note_scan import Items, first_marker, follower, items_of_kind, note_scans, scan_score

PAGES = "book string, page_no int, markdown string, footnotes string, blocks array<string>"


def scans(spark, rows, reviewer=None):
    df = spark.createDataFrame([("b", i, m, f, b) for i, (m, f, b) in enumerate(rows, 1)], PAGES)
    return note_scans(df, reviewer).orderBy("page_no").collect()


def numbers(scan):
    return [x["number"] for x in scan["items"]]


def test_page_kinds(spark):
    got = scans(spark, [
        ("Body paragraph with marker [1].", "", ["1. First page note.", "2. Second page note."]),
        ("Closing body paragraph.\nNOTES\n1. first note line\n2. second note line", "", None),
        ("Closing body paragraph.\n## NOTES\n1. first note line\n2. second note line", "", []),
        ("Plain.", None, None),
        ("\n".join(f"{n}. note number {n}" for n in range(14, 19)), "", []),
        (None, "", []),
        ("NOTES\nblurred line", "", []),
        ("List of Illustrations\n1. Portrait, musée\n2. Gravure", "", []),
        ("3. Huile sur toile\n4. Dessin, collection", "", []),
        ("1. one of a list\n2. two", "7. a footnote here", ["7. a footnote here"]),
    ])
    assert [r.page_kind for r in got] == ["body_with_page_footnotes", "mixed_body_endnotes", "mixed_body_endnotes", "body", "body", "body", "body", "body", "body", "body_with_page_footnotes"]
    assert [numbers(r) for r in got[:3]] == [[1, 2]] * 3 and got[1].note_start == 1 and got[1].section_hints == ["NOTES"]
    assert got[4].ambiguity_flags == ["isolated_numbered_page"] and got[6].ambiguity_flags == ["notes_header_without_items"]
    assert [r.items for r in got[7:9]] == [[], []]
    assert scans(spark, []) == []


def test_continued_notes_and_section_titles(spark):
    got = scans(spark, [("NOTES\nChapter One\n1. a note\nmore of it.\n2. another\nChapter Two\n1. a third", "", []), ("3. goes on\n4. and on", "", [])])
    assert [(x["number"], x["section_title"]) for x in got[0].items] == [(1, "Chapter One"), (2, "Chapter One"), (1, "Chapter Two")]
    assert got[0]["items"][0]["text"] == "1. a note\nmore of it." and got[0].ambiguity_flags == ["duplicate_numbers", "non_monotonic_numbers"]
    assert got[1].page_kind == "endnote_collection" and numbers(got[1]) == [3, 4]


def test_lost_numbers_come_from_the_page_before(spark):
    got = scans(spark, [("x", "4. The fourth note.\n5. The fifth note.", []), ("x", "1bid., p. ^12 |\n7. The seventh note.", []), ("x", "lbid., p. ^12 |\n7. The seventh note.", [])])
    assert [numbers(r) for r in got] == [[4, 5], [6, 7], [7]]


@pytest.mark.parametrize(("text", "want"), [
    ("1. First note of all. 2. Second note of all", [(1, "First note of all."), (2, "Second note of all")]),
    ("1. As is said in vol. 2 Second part of it", [(1, "As is said in vol."), (2, "Second part of it")]),
    ("1. A note\nlbid. ^^ here\n3. A third", [(1, "A note\nlbid. ^^ here"), (3, "A third")]),
    ("1. A note.\nlbid. ^^ here\n3. A third", [(1, "A note."), (2, "lbid. ^^ here"), (3, "A third")]),
    ("1. A note.\nlbid. ^^ here", [(1, "A note."), (2, "lbid. ^^ here")]),
    ("1. A note of length 2.\nits text", [(1, "A note of length"), (2, "its text")]),
    ("1. A note\n2.\nits text", [(1, "A note"), (2, "its text")]),
    ("1. A note\n45. of them were lost", [(1, "A note\n45. of them were lost")]),
    ("1 2. Torn digits", [(12, "Torn digits")]),
    ("I 3. A stray mark", [(3, "A stray mark")]),
    ("some words that run on for long 4 Then a note", [(4, "Then a note")]),
    ("* A starred note\n† Another", [(0, "A starred note"), (0, "Another")]),
    ("1999 was a year", [(1999, "was a year")]),
])
def test_items(spark, text, want):
    lines = spark.createDataFrame([(text,)], "t string").select(L.classified(L.broken_lines(F.col("t"))).alias("x")).first().x
    fold = Items()
    for x in lines:
        fold.feed(x.asDict(True))
    assert [(x["number"], x["body"]) for x in fold.end()] == want


def test_follower():
    assert follower("A long enough text. 3. Next text here", 2) == ("A long enough text.", 3, "Next text here")
    assert follower("A long enough text. 9. Next text here", 2) is None
    assert follower("A long enough text. 3. lower case here", 2) is None


def test_reviewer_and_columns(spark):
    asked = []

    def reviewer(page, scan):
        return {"items": [{"kind": "endnote", "marker": "1.", "number": 1, "text": "found"}, {"kind": ""}]} if page["page_no"] == 2 else None

    got = scans(spark, [("Clean body.", "", []), ("NOTES\nblurred line", "", []), ("NOTES\nblurred", "", [])], reviewer)
    assert [r.reviewed for r in got] == [False, True, False] and got[1]["items"][0]["confidence"] == 0.75 and not asked
    df = spark.createDataFrame([("b", 1, "x", "[3] One.\n4. Two.", None)], PAGES)
    row = note_scans(df).select(F.struct("*").alias("s")).select(scan_score(F.col("s")).alias("score"), first_marker(F.col("s"), "footnote").alias("first"), F.size(items_of_kind(F.col("s"), "endnote")).alias("n")).first()
    assert tuple(row) == (25.0, "3", 0)


def test_line_columns(spark):
    rows = [("1. a\n[2] b\nmore\n* c",), (None,), ("plain",)]
    got = spark.createDataFrame(rows, "t string").select(L.split_at_markers(F.col("t")).alias("x")).collect()
    assert [r.x for r in got] == [["1. a", "[2] b\nmore", "* c"], [], ["plain"]]
    one = spark.range(1).select(L.joined_unique(F.array(F.lit(" a"), F.lit("b"), F.lit("a "), F.lit(""))).alias("u"), L.bare_digit_context(F.lit("the Encyclopédie "), F.lit(". Then")).alias("a"), L.bare_digit_context(F.lit("in August "), F.lit(", 1789")).alias("b"), L.noisy_next(F.lit("!| 14a The body")).alias("n")).first()
    assert tuple(one) == ("a\nb", True, False, "The body")
    pages = spark.createDataFrame([([("image", "", 0)], "<img src=1>"), ([("text", "x" * 30, 0)], "<img>"), ([], "short"), ([], "y" * 60), ([("text", "cap", 0), ("image", "", 0)], "z" * 80), ([("text", "cap", 0)], "12" * 40)], "b array<struct<label:string,text:string,heading_level:int>>, m string")
    assert [r.f for r in pages.select(L.is_figure_page(F.col("b"), F.col("m")).alias("f")).collect()] == [True, False, True, False, True, True]


def test_each_page_is_read_once(spark):
    """Neighbours' needs travel with the pages: one fold each for endnotes and footnotes, one reading of the pages."""
    df = spark.createDataFrame([("b", n, f"{n}. A line of text.", "", []) for n in range(1, 4)], "book string, page_no int, markdown string, footnotes string, blocks array<string>")
    plan = note_scans(df)._jdf.queryExecution().executedPlan().toString()
    plan = plan.partition("== Initial Plan ==")[0]
    assert plan.count("MapInArrow") == 2 and plan.count("Scan ExistingRDD") == 1
