import io
import json
import zipfile

from pyspark.sql import functions as F

from quirelake.sources import files
from quirelake.streaming import runs

SF = "/root/testdata/sf0.001"


def block(label, text, order, box):
    return {"block_label": label, "block_content": text, "block_order": order, "block_bbox": box}


def layout(n):
    own = [block("text", f"Body of page {n} goes on here.", 2, [80.0, 300.0, 800.0, 400.0]), block("header", "Running Head", 1, [80.0, 10.0, 800.0, 40.0]), block("footnote", "1. A note.", 3, [80.0, 1100.0, 800.0, 1150.0])]
    return {"prunedResult": {"width": 900, "height": 1200, "parsing_res_list": own}, "markdown": {"text": f"page {n}\x07"}}


def test_layout(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"layoutParsingResults": [layout(i) for i in range(4)]}))
    (tmp_path / "b.json").write_text(json.dumps({"pages": [layout(9)]}))
    (tmp_path / "c.json").write_text(json.dumps([layout(7), layout(8)]))
    p = files.layout_pages(spark, str(tmp_path))
    assert p.count() == 7
    first = p.where(F.col("file").endswith("a.json")).orderBy("page_no").first()
    assert [b.label for b in first.blocks] == ["header", "text"] and [b.text for b in first.note_blocks] == ["1. A note."] and first.indent == 90.0
    clean = files.without_running_heads(p.where(F.col("file").endswith("a.json")), ["file"])
    assert {tuple(b.label for b in r.blocks) for r in clean.collect()} == {("text",)}


def test_lists(spark, tmp_path):
    (tmp_path / "toc.csv").write_text("﻿title,depth,page\nOne,0,5\nTwo,1,x\nThree,,9\n")
    assert sorted(map(tuple, files.contents_list(spark, str(tmp_path / "toc.csv")).collect())) == [("One", 0, 5), ("Three", 0, 9)]
    (tmp_path / "g.csv").write_text("﻿term,target\nEsprit,mind\n,x\nÂme,soul\n")
    assert sorted(map(tuple, files.glossary(spark, str(tmp_path / "g.csv")).collect())) == [("Esprit", "mind"), ("Âme", "soul")]
    (tmp_path / "m.json").write_text(json.dumps({"books": [{"slug": "a", "doc_id": "1", "include_in_default_batch": True, "expected_page_count": 3}]}))
    assert files.manifest(spark, str(tmp_path / "m.json")).where("include_in_default_batch").first().slug == "a"


def test_workbook(spark, tmp_path):
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    with zipfile.ZipFile(tmp_path / "w.xlsx", "w") as z:
        z.writestr("xl/sharedStrings.xml", f"<sst {ns}><si><t>Title</t></si><si><r><t>Ch</t></r><r><t>apter</t></r></si></sst>")
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet {ns}><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c><c r="AB1"><v>7</v></c></row><row r="2"><c r="A2" t="s"><v>1</v></c><c r="B2" t="inlineStr"><is><t>x</t></is></c></row></sheetData></worksheet>')
    got = files.workbook_rows(spark, str(tmp_path / "w.xlsx")).orderBy("row", "col").collect()
    assert [(r.row, r.col, r.value) for r in got] == [(1, 0, "Title"), (1, 27, "7"), (2, 0, "Chapter"), (2, 1, "x")]


def test_sinks(spark, tmp_path):
    at = str(tmp_path / "t")
    rows = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("b", 1, "z")], "doc_id string, phase int, v string")
    files.replace_partitions(rows, at, ["doc_id", "phase"])
    files.replace_partitions(spark.createDataFrame([("a", 2, "new")], rows.schema), at, ["doc_id", "phase"])
    files.delete_phases(spark, at, "doc_id", "b", 1)
    assert sorted((r.doc_id, r.phase, r.v) for r in spark.read.parquet(at).collect()) == [("a", 1, "x"), ("a", 2, "new")]
    log = str(tmp_path / "log")
    for v in ("p", "q"):
        files.append_revisions(spark.createDataFrame([(v,)], "v string"), log)
    assert spark.read.parquet(log).count() == 2
    z = files.bundles(spark.createDataFrame([("k", "b.md", "B"), ("k", "a.md", "A"), ("k", "../evil", "E")], "book string, name string, content string"), "book").first()
    assert zipfile.ZipFile(io.BytesIO(z.zip)).namelist() == ["a.md", "b.md"]
    j = spark.createDataFrame([('{"a": 1}',), ("broken",), (None,)], "t string").select(files.json_or(F.col("t"), "a int", F.struct(F.lit(7).alias("a"))).alias("j"))
    assert [r.j.a if r.j else None for r in j.collect()][0] == 1


def test_streams(spark, tmp_path):
    stream = runs.events(spark, f"{SF}/events.parquet")
    runs.appended(stream.select("event_id", "user_id", "event_type"), str(tmp_path / "log"), str(tmp_path / "c1")).awaitTermination()
    n = spark.read.parquet(f"{SF}/events.parquet").count()
    assert spark.read.parquet(str(tmp_path / "log")).count() == n
    runs.appended(stream.select("event_id", "user_id", "event_type"), str(tmp_path / "log"), str(tmp_path / "c1")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "log")).count() == n  # the cursor gives nothing twice
    runs.upserting(stream.select("user_id", "event_id"), str(tmp_path / "up"), str(tmp_path / "c2"), ["user_id"], ["event_id"]).awaitTermination()
    newest = {r.user_id: r.event_id for r in spark.read.parquet(str(tmp_path / "up" / "version=0")).collect()}
    want = spark.read.parquet(f"{SF}/events.parquet").groupBy("user_id").agg(F.max("event_id").alias("e")).collect()
    assert newest == {r.user_id: r.e for r in want}
