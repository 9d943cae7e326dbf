"""Small sinks and shapes on stated cases."""

import json

from pyspark.sql import functions as F

from quirelake.sources import exports as E


def test_csv_and_json(spark):
    rows = spark.createDataFrame([("b", 2, 'A "quoted", title', None), ("b", 1, "Plain", 3)], "book string, visual_order int, title string, page int")
    assert E.contents_csv(rows, ["book"], "visual_order", ["title", "page"]).first().csv == '﻿title,page\r\nPlain,3\r\n"A ""quoted"", title",\r\n'
    files = spark.createDataFrame([("b", "z.md", "é"), ("b", "a.md", "x")], "book string, name string, content string")
    assert E.bundle_json(files, ["book"]).first().bundle == '{"a.md":"x","z.md":"é"}'
    over = spark.createDataFrame([("b", "link", "l1", "old", 1), ("b", "link", "l1", "new", 2), ("b", "anchor", "a", "p", 1), ("b", " ", "x", "p", 1)], "book string, scope string, target_id string, payload string, seq int")
    got = E.override_groups(over, ["book"]).first().overrides
    assert {k: json.loads(v) for k, v in got.items()} == {"link": {"l1": "new"}, "anchor": {"a": "p"}}


def test_split_store(spark, tmp_path):
    docs = spark.createDataFrame([("d1", "T1"), ("d2", "T2")], "doc string, title string")
    pages = spark.createDataFrame([("d1", 1), ("d1", 2), ("d2", 1)], "doc string, page_no int")
    for _ in range(2):
        E.split_store(spark, {"catalog": docs, "pages": pages}, "catalog", str(tmp_path), "doc")
    E.split_store(spark, {"catalog": docs, "pages": pages.where("doc = 'd2'")}, "catalog", str(tmp_path), "doc")
    assert spark.read.parquet(f"{tmp_path}/pages").groupBy("doc").count().orderBy("doc").collect() == [("d1", 2), ("d2", 1)]


def test_encodings(spark):
    df = spark.createDataFrame([("Aé 1!漢", ), (None,)], "text string")
    assert [tuple(r.x) for r in df.select(E.encoding_pattern(F.col("text")).alias("x")).collect()] == [(1, 1, 1, 1, 1, 1, 1, 0), (0,) * 8]
    shifted = "".join(chr(ord(c) + 47) if c != " " else c for c in "plain words of a sentence moved")
    got = E.repaired_pages(spark.createDataFrame([("as it was, a sentence here",), (shifted,), (None,)], "text string")).collect()
    assert [r.mended for r in got] == [False, True, False] and got[1].text == "plain words of a sentence moved"


def test_fallback_sections(spark):
    rows = [("b", 1, "Rivers", "body", 5, False, True, False, 0.0), ("b", 2, "Index", "body", 9, True, True, True, 1.0), ("b", 3, "Small", "body", 1, False, False, False, 0.0), ("b", 4, "Notes", "body", 3, False, False, True, 0.0), ("b", 5, "x", "note", 9, True, False, False, 0.0), ("c", 1, "One", "body", 2, False, False, False, 0.0), ("c", 2, "Two", "body", 3, False, False, False, 0.0)]
    got = E.fallback_sections(spark.createDataFrame(rows, "book string, section_no int, title string, start_role string, span int, visual boolean, top_title boolean, font boolean, strength double"), ["book"])
    assert {(r.book, r.section_no): (r.kept, r.score, r.reject_reason) for r in got.collect()} == {("b", 1): (True, 3.0, None), ("b", 2): (False, None, "non_body_family"), ("b", 3): (False, -1.8, None), ("b", 4): (False, None, "note_heading"), ("b", 5): (False, None, "note_partition"), ("c", 1): (False, -1.8, None), ("c", 2): (True, 0.5, None)}
    assert {(r.book, r.section_no): r.chapter_no for r in E.owning_sections(got, ["book"]).collect()} == {("b", 1): 1, ("b", 2): 1, ("b", 3): 1, ("b", 4): 1, ("b", 5): 1, ("c", 1): None, ("c", 2): 2}
