"""Audit codes, number repair and placed markers on stated cases and against plain walks."""

import pytest
from pyspark.sql import functions as F

from quirelake.operators import audit as A
from quirelake.operators import sequences as S

FILES = "path string, content string, role string, expected_title string, next_title string, in_contents boolean, markers array<string>"
GOOD = "# One\n\nIt is a good chapter, with a marker[^1] and an end.\n\n[^1]: A note."


@pytest.mark.parametrize(("content", "more", "code"), [
    (GOOD, {}, None), ("# Two\n\nText.", {}, "wrong_title"), (GOOD, {"role": "container"}, "semantic_role_mismatch"), (GOOD, {"in_contents": False}, "manual_toc_mismatch"),
    ("# One\n\nand so it goes.", {}, "mid_sentence_opening"), ("# One\n\nCopyright 1999\nAll rights reserved", {}, "front_matter_leak"), ("# One\n\nBibliography of works.", {}, "back_matter_leak"),
    ("# One\n\nIntro ...... 12\n", {}, "toc_residue"), ("# One\n\nText [3] here.", {}, "raw_note_marker_leak"), ("# One\n\nText <sup>3</sup> here.", {}, "raw_note_marker_leak"), ("# One\n\nText [EN-3].", {}, "legacy_note_token_leak"),
    ("# One\n\nText[^2].", {}, "missing_note_definition"), ("# One\n\nText.\n\n[^2]: x", {}, "orphan_note_definition"), ("# One\n\nText goes\n### Head\nmore.", {}, "mid_paragraph_heading"),
    ("# One\n\n### A\n\nText.\n\n### a\n\nMore.", {}, "duplicated_heading"), ("# One\n\n" + ("A long paragraph that comes twice in this one chapter, word by word.\n\n" * 2), {}, "duplicate_paragraph"),
    ("# One\n\nText.\n\n## Two\n\nText.", {"next_title": "Two"}, "chapter_boundary_swallow_next"), ("# One\n\n" + "Word " * 20 + "end", {}, "chapter_boundary_missing_tail"),
])
def test_codes(spark, content, more, code):
    row = {"path": "a.md", "content": content, "role": "chapter", "expected_title": "One", "next_title": None, "in_contents": True, "markers": None} | more
    got = A.issues(spark.createDataFrame([tuple(row.values())], FILES)).first()
    want = {"missing_note_definition", "orphan_note_definition"}
    assert (code in got.issue_codes if code else got.issue_codes == []), got.issue_codes
    assert set(got.issue_codes) <= {code, "local_note_contract_broken"} if code in want else len(got.issue_codes) <= 1
    assert got.severity == (A.SEVERITY[code] if code else "minor")


def test_report(spark):
    rows = [("a.md", GOOD, "chapter", "One", None, True, None), ("b.md", "# X", "chapter", "Y", None, True, None), ("index.md", "# X [3]", "index_file", "Y", None, True, None), ("c.md", None, "chapter", "", None, None, None), ("d.md", "# One\n\nText [3].", "chapter", "One", None, True, ["4"])]
    audited = A.issues(spark.createDataFrame(rows, FILES))
    got = A.report(audited.withColumn("book", F.lit("b")), ["book"]).first()
    assert (got.files, got.with_issues, got.blocking, got.codes, got.can_ship) == (5, 1, 1, ["wrong_title"], False)


def numbers(spark, column, rows):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, n array<int>")
    return [r.x for r in df.select("i", column(F.col("n")).alias("x")).orderBy("i").collect()]


def test_mended_numbers(spark):
    got = numbers(spark, S.mended, [[1, 99, 2], [1, 99, 3], [3, 1976, 4], [3, 1976, 5], [5, 2, 7], [1, 2, 3], [1, 7, 2], [], [4]])
    flat = [[x.number for x in r if x.keep] for r in got]
    assert flat == [[1, 2], [1, 2, 3], [3, 4], [3, 4, 5], [5, 6, 7], [1, 2, 3], [1, 7, 2], [], [4]]
    assert numbers(spark, S.restarted, [[1, 2, 1, 2, 5], [1, 2, 3], [1, 2, 1, 2, 9], [7, 1, 2, 3, 11, 12], []]) == [[1, 2, 3, 4, 5], [1, 2, 3], [1, 2, 1, 2, 9], [7, 8, 9, 10, 11, 12], []]


def test_section_scores(spark):
    assert numbers(spark, S.section_score, [[1, 2, 3], [2, 4], [3, 1], []]) == [1.0, pytest.approx(2 / 3 - 0.08), pytest.approx(2 / 3 - 0.2), None]
    df = spark.createDataFrame([([1, 2, 3], [1, 3]), ([1, 3], [1, 2, 3]), ([], [1]), ([1], [])], "a array<int>, b array<int>")
    assert [r.x for r in df.select(S.better_section(F.col("a"), F.col("b")).alias("x")).collect()] == ["first", "second", "second", "first"]


def test_placed_markers(spark):
    cases = {"a[^3] b": [("footnote_ref", "3", 1, 5)], "x $^{4}$ y": [("latex", "4", 2, 8)], "x $^{**}$": [("latex_symbol", "**", 2, 9)], "x <sup> 5 </sup>": [("html", "5", 2, 16)], "x¹² y": [("unicode", "12", 1, 3)], "x [7] [1789]": [("bracket", "7", 2, 5)], "it's '12 so": [("apostrophe", "12", 5, 8)], "end]* »**": [("after_bracket", "*", 3, 5), ("after_quote", "**", 6, 9)], "the Encyclopédie 11. Then": [("bare_digit", "11", 17, 19)], "on page 11. Then": [], "August 4, 1789": [], "": []}
    df = spark.createDataFrame([(k,) for k in cases], "t string")
    for r in df.select("t", S.placed_markers(F.col("t")).alias("x")).collect():
        assert [(x.form, x.marker, x.start, x.end) for x in r.x] == cases[r.t], r.t


def test_pages_and_items(spark):
    note = "\n".join(f"{i}. A note here" for i in range(1, 5))
    rows = [("b", 1, "Text\nmore\nand more.", 1, 9), ("b", 2, note, 1, 9), ("b", 3, "5. A last one\nx y\nu v", 1, 9), ("b", 5, "Text\n1. one in a list\nx\ny\nz", 1, 9), ("b", 8, "NOTES\n1. a note", 1, 9)]
    got = S.collection_pages(spark.createDataFrame(rows, "book string, page_no int, text string, chapter_no int, chapter_end int"), ["book"]).collect()
    assert sorted((r.page_no, r.why) for r in got) == [(2, "strong"), (3, "joined"), (8, "signal")]
    item = "struct<kind:string,marker:string,number:int,text:string,order:int>"
    scans = spark.createDataFrame([("b", 2, [("endnote", "1.", 1, "one", 1), ("endnote", "99.", 99, "two", 2), ("footnote", "*", 0, "f", 3)]), ("b", 3, [("endnote", "3.", 3, "three", 1)])], f"book string, page_no int, items array<{item}>")
    regions = spark.createDataFrame([("b", "r1", [2, 3], "endnote"), ("b", "r2", [3], "endnote"), ("b", "r3", [2], "footnote")], "book string, region_id string, pages array<int>, note_kind string")
    got = {r.note_item_id: (r.marker, r.text, r.reconstructed) for r in S.region_items(scans, regions, ["book"]).collect()}
    assert got == {"en-r1-00001": ("1", "one", False), "en-r1-00002": ("2", "two", True), "en-r1-00003": ("3", "three", False), "fn-r3-00001": ("*", "f", False)}


def test_index(spark):
    items = spark.createDataFrame([("b", 1, 1, "short", 5, ""), ("b", 1, 1, "a longer text", 6, ""), ("b", 2, 1, "x", 9, ""), ("b", None, 3, "y", 20, " Hint "), ("b", None, 4, "z", 21, None)], "book string, chapter_no int, number int, text string, page_no int, hint string")
    index = S.endnote_index(items, ["book"])
    assert sorted((r.chapter_no or 0, r.number, r.text, r.readings, r.scope) for r in index.collect()) == [(0, 3, "y", 1, "book"), (0, 4, "z", 1, "book"), (1, 1, "a longer text", 2, "chapter"), (2, 1, "x", 1, "chapter")]
    assert {r.number: (r.chapters, r.shared, r.used_in) for r in S.registry(index, ["book"]).collect()} == {1: (2, True, [1, 2]), 3: (1, False, []), 4: (1, False, [])}
    assert {r.group: r.n for r in S.groups(items, ["book"]).collect()} == {"chapter:1": 2, "chapter:2": 1, "hint:hint": 1, "book": 1}
