"""Page functions on stated cases."""

from pyspark.sql import functions as F

from quirelake.functions import pages as P

BLOCKS = "array<struct<label:string,text:string>>"


def one(spark, value, kind, column):
    return spark.createDataFrame([(value,)], f"c {kind}").select(column(F.col("c")).alias("x")).first().x


def lines(spark, column, *texts):
    return one(spark, list(texts), "array<string>", column)


def test_texts_and_headings(spark):
    df = spark.createDataFrame([(None, " a ", "b", [("doc_title", "The  Title"), ("text", "x"), ("paragraph_title", "the title!"), ("paragraph_title", "Two")], "# H"), ("e", None, None, [], "# One\ntext\n## one\n##Two\n" + "x\n" * 9 + "# Late"), (" ", "", None, None, None)], f"e string, m string, n string, b {BLOCKS}, t string")
    got = df.select(P.markdown_text(F.col("e"), F.col("m"), F.col("n")).alias("x"), P.headings(F.col("b"), F.col("t")).alias("h"), P.section_hint(P.headings(F.col("b"), F.col("t")), F.array(F.lit("hint"))).alias("s")).collect()
    assert [(r.x, r.h, r.s) for r in got] == [("a", ["The Title", "Two"], "The Title"), ("e", ["One", "Two"], "One"), ("", [], "hint")]


def test_body_paragraphs(spark):
    df = spark.createDataFrame([("# H\nline one\nline two\n\nNOTES\n1. a note\nnext para", [("text", "Line one, line two"), ("text", "a longer block of text here"), ("paragraph_title", "a title of some length"), ("text", "short")])], f"m string, b {BLOCKS}")
    got = df.select(P.body_paragraphs(F.col("m"), F.col("b")).alias("x")).first().x
    assert [(p.text, p.source) for p in got] == [("line one line two", "markdown"), ("next para", "markdown"), ("a longer block of text here", "block")]
    rows = spark.createDataFrame([([("a", True), ("b", None), ("c", False)],)], "p array<struct<text:string,consumed:boolean>>")
    assert [p.text for p in rows.select(P.visible(F.col("p")).alias("x")).first().x] == ["b", "c"]


def test_bands(spark):
    band = lambda *x: tuple(lines(spark, P.note_band, *x))
    assert band("body", "----", "1. a") == (2, 3) and band("body", "1. a", "2. b", "more") == (1, 4)
    assert band("1. list", "body", "3. a", "4. b") == (2, 4) and band("body", "* a", "** b", "c") == (1, 4)
    assert band("body", "1. a") == (-1, -1) and band("1. a") == (-1, -1) and band() == (-1, -1)
    items = lines(spark, P.band_items, "goes on", "1. a", "more", "* b")
    assert [tuple(x) for x in items] == [("", "goes on"), ("1", "a more"), ("*", "b")]


def test_positions(spark):
    place = lambda bottoms, top: spark.createDataFrame([(bottoms, top)], "b array<double>, t double").select(P.confident_paragraph(F.col("b"), F.col("t")).alias("x")).first().x
    assert place([100.0], 300.0) == 0 and place([100.0], 400.0) is None
    assert place([100.0, 280.0], 300.0) == 1 and place([200.0, 210.0], 300.0) is None and place([100.0, 210.0], 300.0) == 1
    assert place([None, 500.0], 300.0) is None and place([], 3.0) is None
    df = spark.createDataFrame([(["The first  paragraph here", "second one the first paragraph"], ["the first paragraph", "SECOND one", "abc"])], "p array<string>, b array<string>")
    assert df.select(P.paragraph_blocks(F.col("p"), F.col("b")).alias("x")).first().x == [[0], [1]]


def test_blocks_and_neighbours(spark):
    kind = "array<struct<label:string,text:string,heading_level:int,is_meta:boolean>>"
    rows = [("doc_title", "Title", 0, False), ("text", "(a line)", 0, False), ("text", "A paragraph that is long enough to stand by itself, without doubt.", 0, False), ("text", "short end", 0, False), ("text", "https://x.y", 0, False), ("text", "## Sub", 0, None), ("text", "m", 0, True)]
    assert [tuple(x) for x in one(spark, rows, kind, P.merged_blocks)] == [(1, "Title\n(a line)"), (0, "A paragraph that is long enough to stand by itself, without doubt. short end"), (2, "Sub")]
    texts = ["alpha beta gamma delta", "second paragraph of all", "third"]
    find = lambda raw: spark.createDataFrame([(texts, raw)], "t array<string>, r string").select(P.next_paragraphs(F.col("t"), F.col("r"), 2).alias("x")).first().x
    assert find("beta gamma  delta") == texts[1:] and find("second paragraph of all") == ["third"] and find("none of this here") == [] and find(None) == []


def test_rules(spark):
    heading = lambda t: one(spark, t, "string", P.is_block_heading)
    assert heading("3. The Rise of Cities") and heading("On Rivers and Roads") and not heading("It ends here.") and not heading("a, b, c, and so on") and not heading("short") and not heading(None)
    prose = lambda t: one(spark, t, "string", P.is_prose)
    assert prose("# H\nIt is a sentence.") and not prose("# H\nTITLE") and prose("# H\nword [^3]") and not prose("# H") and not prose(None)
    blurb = spark.createDataFrame([("# A. Writer\n## A. WRITER\n" + "a line of prose that goes on and on until it is long enough ok\n" * 4, ["A. Writer", "A. WRITER"], 99, 100), ("x", ["a"], 99, 100), (None, [], 1, 100)], "m string, h array<string>, p int, t int")
    assert [r.x for r in blurb.select(P.is_author_blurb(*(F.col(c) for c in "mhpt")).alias("x")).collect()] == [True, False, False]
    skip = spark.createDataFrame([("All rights reserved", True), ("Publisher: X", True), ("Publisher: X", False), ("y" * 2000 + " isbn", True), (None, True)], "t string, l boolean")
    assert [r.x for r in skip.select(P.is_skipped(F.col("t"), F.col("l")).alias("x")).collect()] == [True, True, False, False, False]
    labels = spark.createDataFrame([("i", "ii"), ("3", "3"), (None, "4"), ("3", None)], "a string, b string")
    assert [r.x for r in labels.select(P.print_label(F.col("a"), F.col("b")).alias("x")).collect()] == ["i-ii", "3", "", "3"]


def test_json(spark):
    cases = {r"abc\n\"d": ('abc\n"d', False), 'done" more': ("done", True), r"cut \u00e": ("cut ", False), r"éé\q\\": ("ééq\\", False), "line\nbreak": ("line\nbreak", False), "end\\": ("end", False), "": ("", False)}
    for raw, want in cases.items():
        assert tuple(one(spark, raw, "string", P.json_prefix)) == want, raw
    assert one(spark, '{"x": 1, "translation" : "Guten \\u0054ag, "', "string", P.json_preview) == "Guten Tag, " and one(spark, '{"x"', "string", P.json_preview) == ""
    row = spark.createDataFrame([(86400, None, 3)], "t long, a string, b int").select(P.unix_time(F.col("t")).alias("t"), P.plain_json("a", "b").alias("j")).first()
    assert tuple(row) == ("1970-01-02 00:00:00", '{"a":null,"b":3}')
