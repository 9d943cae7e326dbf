"""Jobs, edits, runs, claims, polls and PDF contents on stated cases."""

from pyspark.sql import functions as F

from quirelake.operators import jobs as J
from quirelake.sources import pdf


def test_edits(spark):
    current = spark.createDataFrame([("d", 1, "old", 3, "model"), ("d", 2, "same", 1, "model"), ("d", 3, "x", 5, "model")], "doc string, seg int, text string, version int, editor string")
    edits = spark.createDataFrame([("d", 1, "new", 3), ("d", 1, "other", 3), ("d", 2, "same", 1), ("d", 3, "y", 4), ("d", 9, "z", 0)], "doc string, seg int, text string, base_version int")
    new, revisions, rejected = J.edited(current, edits, ["doc", "seg"])
    assert sorted((r.seg, r.text, r.version, r.editor) for r in new.collect()) == [(1, "new", 4, "manual"), (2, "same", 1, "model"), (3, "x", 5, "model")]
    assert [(r.seg, r.text, r.version) for r in revisions.collect()] == [(1, "new", 4)]
    assert sorted((r.seg, r.reason) for r in rejected.collect()) == [(1, "conflict"), (2, "unchanged"), (3, "conflict"), (9, "unknown")]


def test_counts(spark):
    seg = spark.createDataFrame([("d", 1, "manual", "done"), ("d", 1, "model", "error"), ("d", 2, "model", "error")], "doc string, page_no int, editor string, status string")
    assert sorted((r.page_no, r.manual, r.failed, r.partial) for r in J.segment_counts(seg, ["doc", "page_no"]).collect()) == [(1, 1, 1, True), (2, 0, 1, False)]
    kind = "doc string, unit_id string, segments array<struct<page_no:int,paragraphs:array<struct<status:string,error:string>>>>"
    units = spark.createDataFrame([("d", "u", [(3, [("done", None), ("error", "rate")]), (4, [("error", None)])])], kind)
    assert sorted((r.page_no, r.paragraph, r.error) for r in J.failed_places(units, ["doc"]).collect()) == [(3, 1, "rate"), (4, 0, "")]
    files = spark.createDataFrame([("d", "a", None), ("d", None, "b"), ("d", "c [待翻译] [FN-x]", "d"), ("d", "e", "e")], "doc string, content string, old string")
    r = J.drift(files, ["doc"]).first()
    assert (r.files, r.added, r.removed, r.changed, r.legacy_tokens, r.pending) == (3, 1, 1, 1, 1, 1)
    judged = spark.createDataFrame([("d", 1, True, []), ("d", 5, False, ["x"]), ("e", 1, False, ["y"])], "doc string, phase int, passes boolean, failures array<string>")
    got = {x.doc: (x.structure_state, x.can_ship, x.blocking_reasons, x.share_done) for x in J.status(judged, spark.createDataFrame([("d", 4, 2)], "doc string, total int, done int"), ["doc"]).collect()}
    assert got == {"d": ("ready", False, ["x"], 0.5), "e": ("review_required", False, ["y"], 0.0)}


def test_jobs_and_views(spark):
    pages = spark.createDataFrame([("d", 1, "# Head\n\nOne.\n\nTwo."), ("d", 2, None)], "doc string, page_no int, text string")
    seg = J.segments(pages, ["doc"])
    assert [(r.paragraph, r.heading_level, r.text) for r in seg.orderBy("paragraph").collect()] == [(0, 1, "Head"), (1, 0, "One."), (2, 0, "Two.")]
    notes = spark.createDataFrame([("d", 1, "endnote", 2, "e"), ("d", 1, "footnote", 1, "f"), ("d", 1, "footnote", 2, " ")], "doc string, page_no int, note_kind string, number int, text string")
    assert [(r.job, r.kind, r.text) for r in J.page_jobs(seg, notes, ["doc"]).orderBy("job").collect()] == [(1, "body", "One."), (2, "body", "Two."), (3, "footnote", "f"), (4, "endnote", "e")]
    tr = spark.createDataFrame([("d", 1, 1, "eins", "done", "model", 1), ("d", 1, 1, "Eins.", "done", "manual", 2), ("d", 1, 2, None, "error", "model", 1)], "doc string, page_no int, paragraph int, translation string, status string, editor string, version int")
    shown = J.display(seg, tr, ["doc"])
    assert [(r.translation, r.state) for r in shown.orderBy("paragraph").collect()] == [("", "pending"), ("Eins.", "manual"), ("", "error")]
    page = J.editor_pages(shown, ["doc"]).first()
    assert [x.state for x in page.rows] == ["pending", "manual", "error"] and (page.manual, page.pending) == (1, 1)
    text = J.markdown(shown, notes.where("note_kind = 'endnote'").select("doc", "number", "text"), ["doc"]).first().markdown
    assert text == "# Head\n\n> One.\n\nEins.\n\n> Two.\n\n[待翻译]\n\n### NOTES\n\n[^2]: e\n"
    foot = J.inline_footnotes(seg, spark.createDataFrame([("d", 1, 1, 2, "b"), ("d", 1, 1, 1, "a")], "doc string, page_no int, paragraph int, number int, text string"), ["doc"])
    assert foot.where("paragraph = 1").first().text == "One.\n\n* a\n* b"
    units = spark.createDataFrame([("d", "u1", "body", None, 1, "s", "t", "done"), ("d", "u2", "body", None, 1, "s2", " ", "pending"), ("d", "u3", "footnote", "n", 1, "f", None, "done")], "doc string, unit_id string, kind string, note_id string, page_no int, source_text string, translated_text string, status string")
    body, note = J.projections(units, ["doc"])
    assert (body.first().text, body.first().open, note.first().text) == ("t\n\ns2", 1, "f")
    cases = [([], []), ([0] * 4, ["a"] * 4), ([1, 0, 0, 0, 0], ["References", *"abcd"]), ([0, 0, 0, 0], ["A (1999)", "B (2001a)", "c", "d"]), ([0], ["a long paragraph that is no short piece"])]
    df = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i int, n array<int>, t array<string>")
    assert [r.x for r in df.select("i", J.needs_model(F.col("n"), F.col("t")).alias("x")).orderBy("i").collect()] == [True, True, False, False, False]


def test_runs_claims_polls(spark):
    log = [("r", 1, 1, "ok"), ("r", 2, 2, "error"), ("r", 3, 2, "rate"), ("r", 4, 2, "error"), ("r", 5, 3, "manual"), ("s", 1, 1, "ok"), ("s", 2, 2, "quota"), ("t", 1, 1, "error"), ("t", 2, 1, "ok"), ("u", 1, 5, "error")]
    got = {r.run: (r.done, r.failed, r.manual, r.retried, r.next_page, r.phase) for r in J.run_loops(spark.createDataFrame(log, "run string, seq int, page_no int, outcome string"), ["run"]).collect()}
    assert got == {"r": (1, 1, 1, 2, 2, "partial_failed"), "s": (1, 0, 0, 0, None, "quota_exceeded"), "t": (1, 0, 0, 1, None, "done"), "u": (0, 0, 0, 1, 5, "running")}
    log = [("r", 1, "a", "claim"), ("r", 2, "b", "claim"), ("r", 3, "b", "release"), ("r", 4, "a", "release"), ("r", 5, "c", "claim"), ("s", 1, "a", "claim"), ("s", 2, "a", "release")]
    assert {r.run: (r.owner, r.refused) for r in J.claims(spark.createDataFrame(log, "run string, seq int, token string, action string"), ["run"]).collect()} == {"r": ("c", 1), "s": (None, 0)}
    events = spark.createDataFrame([("r", 1, 0.2, "log"), ("r", 2, 0.9, "done"), ("r", 3, 5.0, "log"), ("s", 4, 0.1, "log")], "run string, cursor int, at double, event_type string")
    assert sorted(r.cursor for r in J.until_end(events, ["run"]).collect()) == [1, 2, 4]
    polls = spark.createDataFrame([(r, i, 0.5 * i) for r in ("r", "s", "v") for i in range(1, 8)], "run string, poll int, at double")
    got = {}
    for r in J.polled(events, polls, ["run"]).orderBy("run", "poll").collect():
        got.setdefault(r.run, []).append((r.n, r.end))
    assert got == {"r": [(1, None), (1, "done")], "s": [(1, None), (0, None), (0, None), (0, "idle")], "v": [(0, None), (0, None), (0, "idle")]}
    labels = J.rederived_labels(spark.createDataFrame([("d", 1, "old")], "doc string, page_no int, label string"), spark.createDataFrame([("d", 1, "iv")], "doc string, page_no int, label string"), ["doc"])
    assert labels.first().label == "iv"


def test_pdf(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"1|One|0\n2|Sub|4\n1||2")

    def reader(raw, pages=None):
        return [{"position": i, "level": int(a), "title": b, "file_idx": int(c)} for i, (a, b, c) in enumerate(x.split("|") for x in raw.decode().split("\n"))]

    marks = pdf.rows(spark, str(tmp_path), "bookmarks", reader)
    assert [(r.title, r.depth, r.file_idx) for r in pdf.bookmark_contents(marks).orderBy("position").collect()] == [("One", 0, 0), ("Sub", 1, 4)]
    assert pdf.rows(spark, str(tmp_path), "bookmarks", reader, [4]).count() == 1
    files = spark.createDataFrame([("f", 200), ("g", 0)], "file string, n_pages int")
    assert [(r.first, r.end) for r in pdf.chunks(files).orderBy("chunk").collect()] == [(0, 90), (90, 180), (180, 200)]
    links = [("f", 3, 10.0 + 20 * (i == 2), 10.0 * i, 5 + 10 * i, f"Title {i} .. {i}") for i in range(5)] + [("f", 3, 10.0, 60.0, 25, "again 9"), ("f", 4, 1.0, 1.0, 9, "few"), ("f", 8, 1.0, 1.0, 90, "x"), ("f", 8, 1.0, 2.0, 40, "y"), ("f", 8, 1.0, 3.0, 20, "z"), ("f", 150, 1.0, 3.0, 20, "late")]
    df = spark.createDataFrame(links, "file string, file_idx int, x double, y double, target int, line string")
    got = pdf.link_contents(df, files).orderBy("visual_order").collect()
    assert [(r.title, r.depth, r.file_idx) for r in got] == [(f"Title {i} ..", int(i == 2), 5 + 10 * i) for i in range(5)]
    assert [r.target for r in pdf.page_targets(df, 8).orderBy("visual_order").collect()] == [90, 40, 20]
    labels = pdf.aligned_labels(spark.createDataFrame([("f", 1, "ii")], "file string, file_idx int, label string"), files.where("n_pages > 0"))
    assert labels.count() == 200 and labels.where("label = 'ii'").first().file_idx == 1
