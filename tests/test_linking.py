"""Note links on stated cases."""

from quirelake.operators import linking as K

NOTES = "book string, chapter_no int, note_id string, page_no int, marker string, note_kind string, priority int"
ANCHORS = "book string, chapter_no int, anchor_id string, page_no int, paragraph int, start int, marker string, kind string, certainty double, synthetic boolean, source_text string"


def linked(spark, notes, anchors):
    n = spark.createDataFrame([("b", 1, *x, 0) for x in notes], NOTES)
    a = spark.createDataFrame([("b", 1, i, p, 0, s, m, k, 1.0, False, "") for i, p, s, m, k in anchors], ANCHORS)
    rows = K.links(n, a, ["book", "chapter_no"]).collect()
    return {r.note_id or r.anchor_id: (r.anchor_id, r.status, r.resolver) for r in rows}


def test_endnotes_take_markers_in_reading_order(spark):
    got = linked(spark, [("n1", 50, "1", "endnote"), ("n2", 51, "1", "endnote"), ("n3", 50, "2", "endnote"), ("n4", 50, "", "endnote")], [("a2", 9, 0, "1", "endnote"), ("a1", 3, 0, "1", "unknown"), ("a3", 4, 0, "2", "endnote")])
    assert got["n1"] == ("a1", "matched", "repair") and got["n2"] == ("a2", "matched", "repair")
    assert got["n3"] == ("a3", "matched", "rule") and got["n4"] == (None, "ignored", "rule")


def test_endnote_repairs(spark):
    got = linked(spark, [("n1", 50, "112", "endnote"), ("n2", 50, "5", "endnote")], [("a1", 3, 0, "12", "endnote"), ("a9", 7, 0, "7", "endnote"), ("far", 7, 5, "900", "endnote")])
    assert got["n1"] == ("a1", "matched", "repair")
    assert got["n2"] == ("a9", "matched", "fallback") and "far" not in got
    got = linked(spark, [("n1", 50, "3", "endnote"), ("n2", 52, "3", "endnote")], [("a1", 3, 0, "3", "endnote")])
    assert got == {"n1": ("a1", "matched", "repair"), "n2": (None, "ignored", "repair")}
    assert linked(spark, [("n1", 50, "3", "endnote")], []) == {"n1": (None, "orphan_note", "rule")}


def test_footnotes(spark):
    got = linked(
        spark,
        [("f1", 5, "1", "footnote"), ("f2", 5, "2", "footnote"), ("f3", 8, "3", "footnote"), ("f4", 8, "14", "footnote"), ("f5", 20, "9", "footnote"), ("f6", 30, "*", "footnote"), ("f7", 30, "*", "footnote"), ("f8", 41, "6", "footnote")],
        [("a1", 5, 0, "1", "footnote"), ("far", 9, 0, "2", "footnote"), ("x", 7, 0, "3", "footnote"), ("y", 9, 0, "3", "footnote"), ("p", 8, 1, "4", "footnote"), ("s1", 30, 1, "*", "footnote"), ("s2", 30, 2, "*", "unknown"), ("u", 41, 0, "6", "unknown"), ("big", 60, 0, "88", "footnote")],
    )
    assert got["f1"] == ("a1", "matched", "rule") and got["f2"] == ("synthetic-f2", "matched", "fallback")
    assert got["f3"] == (None, "ambiguous", "rule") and got["f4"] == ("p", "matched", "repair")
    assert got["f5"][0] == "synthetic-f5" and got["f6"][0] == "s1" and got["f7"][0] == "s2"
    assert got["f8"] == ("u", "matched", "repair") and "big" not in got and "far" not in got


def test_recovery_and_overrides(spark):
    orphans = spark.createDataFrame([("b", 1, "n7", "7"), ("b", 1, "n8", "8"), ("b", 1, "n9", "")], "book string, chapter_no int, note_id string, marker string")
    pages = spark.createDataFrame([("b", 1, 3, "nothing"), ("b", 1, 5, "é text ^{7} and [8]"), ("b", 1, 4, "see ⁷ here")], "book string, chapter_no int, page_no int, text string")
    got = {r.note_id: (r.page_no, r.start, r.source_text) for r in K.recovered_anchors(orphans, pages, ["book", "chapter_no"]).collect()}
    assert got == {"n7": (4, 4, "⁷"), "n8": (5, 16, "[8]")}
    anchors = spark.createDataFrame([("b", 1, "a1", 3, 0, 0, "1", "endnote", 1.0, False, "")], ANCHORS)
    kind = "book string, chapter_no int, target_id string, action string, anchor_id string, page_no int, paragraph int, start int, end int, marker string, kind string, certainty double, source_text string"
    rows = [("b", 1, "t1", "create", "new", 4, 0, 2, 5, "2", None, None, None), ("b", 1, "t2", "create", "a1", 4, 0, 2, 5, "2", None, 1.0, ""), ("b", 1, "t3", "drop", "z", 4, 0, 2, 5, "2", None, 1.0, ""), ("b", 1, "t4", "create", "q", 0, 0, 2, 5, "2", None, 1.0, ""), ("b", 1, "t5", "create", "new", 4, 0, 2, 5, "2", None, 1.0, ""), ("b", 1, "t6", None, "r", 4, 0, 2, 5, "2", None, 1.0, "")]
    new, rejected = K.with_created_anchors(anchors, spark.createDataFrame(rows, kind), ["book", "chapter_no"])
    assert sorted(r.anchor_id for r in new.collect()) == ["a1", "new"]
    assert {r.target_id: r.reason for r in rejected.collect()} == {"t2": "anchor_id_conflict", "t3": "action=drop", "t4": "invalid", "t5": "anchor_id_conflict", "t6": "action=missing"}
    notes = spark.createDataFrame([("b", 1, "n1", "r1", 3, "1", "endnote", "x")], "book string, chapter_no int, note_id string, region_id string, page_no int, marker string, note_kind string, text string")
    regions = spark.createDataFrame([("b", 1, "r1", 3, 3, "endnote")], "book string, chapter_no int, region_id string, page_start int, page_end int, note_kind string")
    over = spark.createDataFrame([("b", 1, "t1", "create", "n2", "r1", 4, "2", "endnote", "y"), ("b", 1, "t2", "create", "n3", "", 5, "3", "endnote", "z"), ("b", 1, "t3", "create", "n4", "", 5, "3", "endnote", " ")], "book string, chapter_no int, target_id string, action string, note_id string, region_id string, page_no int, marker string, note_kind string, text string")
    n, r, bad = K.with_created_notes(notes, regions, over, ["book", "chapter_no"])
    assert {x.note_id: x.region_id for x in n.collect()} == {"n1": "r1", "n2": "r1", "n3": "note-region-b-1-5-endnote"}
    assert r.count() == 2 and [x.target_id for x in bad.collect()] == ["t3"]


def test_overlay(spark):
    kind = "book string, unit_id string, source_text string, translated_text string, status string"
    fresh = spark.createDataFrame([("b", "u1", "a  text", None, "pending"), ("b", "u2", "changed", None, "pending"), ("b", "u3", "x", None, "pending")], kind)
    stored = spark.createDataFrame([("b", "u1", "a text", "ein Text", "done"), ("b", "u2", "old", "alt", "done"), ("b", "u3", "x", " ", "done")], kind)
    got = {r.unit_id: (r.translated_text, r.status) for r in K.overlaid(fresh, stored, ["book"]).collect()}
    assert got == {"u1": ("ein Text", "done"), "u2": (None, "pending"), "u3": (None, "pending")}
