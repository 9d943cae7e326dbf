"""References against stated cases and a plain walk."""

import random
import re

from pyspark.sql import functions as F

from quirelake.functions import references as R

IDS = ["fn-1", "en-1", "en-2", "7"]
KINDS = {"fn-1": "footnote", "en-1": "endnote", "en-2": "endnote", "7": "endnote"}
SEQUENCES = {"1": ["fn-1", "en-1"], "2": ["en-2"], "*": ["7"]}


def plain(text):
    """The chain by a walk with state."""
    order, feet, used = [], [], {}

    def label(note):
        if KINDS.get(note) == "footnote":
            if note not in feet:
                feet.append(note)
            return "*"
        if note not in order:
            order.append(note)
        return f"[^{order.index(note) + 1}]"

    def token(m):
        g = [(x or "").strip() for x in m.groups()]
        strip = lambda x: "en-" + re.sub("(?i)^en-(?=[0-9])", "", x)
        note = g[0] or g[1] or (strip(g[2]) if g[2] else "") or (strip(g[3]) if g[3] else "") or g[4] or g[5]
        other = note[3:] if note.lower().startswith("en-") else "en-" + note
        note = note if note in IDS else other if other in IDS else ""
        return label(note) if note else m[0]

    def raw(m):
        k = re.search(r"\*{1,4}|[0-9]{1,4}[A-Za-z]?|[⁰¹²³⁴⁵⁶⁷⁸⁹]+", m[0])[0].translate(str.maketrans("⁰¹²³⁴⁵⁶⁷⁸⁹", "0123456789")).lower()
        notes = SEQUENCES.get(k, [])
        n = used.get(k, 0)
        used[k] = n + 1
        return label(notes[min(n, len(notes) - 1)]) if notes else m[0]

    text = re.sub(r"(?i)\{\{NOTE_REF:([^}\]]+)\]\}\}", r"{{NOTE_REF:\1}}", text)
    text = re.sub(R.TOKEN, token, text)
    for p in R.RAW.values():
        text = re.sub(p, raw, text)
    return text, order, feet


def test_chain_against_a_walk(spark):
    rng = random.Random(3)
    parts = ["{{NOTE_REF:en-2}}", "{{NOTE_REF:fn-1]}}", "{{FN_REF:fn-1}}", "{{EN_REF:7}}", "[EN-en-1]", "[FN-fn-1]", "[^7]", "[^zz]", "[1]", "[2]", "[1]", "[9]", "$^{1}$", "<sup>[2]</sup>", "$^{*}$", "¹", "²", "x ", "é, "]
    texts = ["".join(rng.choices(parts, k=rng.randint(0, 14))) for _ in range(200)] + [""]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", "t", F.array(*map(F.lit, IDS)).alias("known"), F.create_map(*(F.lit(x) for kv in KINDS.items() for x in kv)).alias("kinds"), F.map_from_arrays(F.array(*map(F.lit, SEQUENCES)), F.array(*(F.array(*map(F.lit, v)) for v in SEQUENCES.values()))).alias("seq"))
    for r in R.rewritten(df, "t", "known", "kinds", "seq").collect():
        assert (r.t, r.ordered_ids, r.footnote_ids) == plain(texts[r.i]), texts[r.i]


def one(spark, column, *values):
    df = spark.createDataFrame([tuple(values)], ", ".join(f"c{i} string" for i in range(len(values))))
    return df.select(column(*(F.col(f"c{i}") for i in range(len(values)))).alias("x")).first().x


def test_tokens(spark):
    assert one(spark, R.legacy_as_tokens, "a[EN-en-01] b[fn-fn-2] c[^en-3] [^4]") == "a{{NOTE_REF:en-01}} b{{NOTE_REF:fn-2}} c{{NOTE_REF:en-3}} [^4]"
    assert one(spark, R.unnested, "x {{NOTE_REF:a{{NOTE_REF:b}}c}} {{NOTE_REF:{{NOTE_REF:d}}}}") == "x {{NOTE_REF:b}} {{NOTE_REF:abc}} {{NOTE_REF:d}}"
    inject = lambda t, s, m, i: tuple(one(spark, lambda a, b, c, d: R.injected_once(a, b, c, d), t, s, m, i))
    assert inject("a [3] b [3]", "", "3", "en-3") == ("a {{NOTE_REF:en-3}} b [3]", True)
    assert inject("a $^{3}$", "$^{3}$", "3", "en-3") == ("a {{NOTE_REF:en-3}}", True)
    assert inject("a [ ^3 ] b", "", "3", "en-3") == ("a {{NOTE_REF:en-3}} b", True)
    assert inject("a [FN-x]", "", "9", "x") == ("a {{NOTE_REF:x}}", True)
    assert inject("none", "", "3", "en-3") == ("none", False) and inject(None, "", "3", "") == ("", False)
    assert tuple(one(spark, R.raised_as_tags, "a¹² b³")) == ("a<sup>12</sup> b<sup>3</sup>", 2)
    assert one(spark, R.marker_key, "EN-12") == "12" and one(spark, R.marker_key, "**") == "**" and one(spark, R.aliases, "007") == ["007", "7"]


def test_notes_block(spark):
    block = lambda t: one(spark, R.notes_block, t)
    want = "Body.\n\n### NOTES\n\n[^1]: 1. One\n[^2]: 2. Two\n"
    assert block("Body.\n\n[^1]: One\n[^2]: 2. Two\n") == want == block(want)
    assert block("[^1]: a") == "### NOTES\n\n[^1]: 1. a" and block("no notes\n") == "no notes\n" and block(None) == ""


def test_export_tests(spark):
    assert one(spark, R.clean_note, " [3] A <sup>2</sup> note ") == "A note"
    assert tuple(one(spark, R.markdown_prefix, "  [^1]: x")) == ("  [^1]: ", "x") and tuple(one(spark, R.markdown_prefix, "## h")) == ("## ", "h") and tuple(one(spark, R.markdown_prefix, " t")) == (" ", "t")
    assert one(spark, R.is_garbled_block, "ABCDEF123456;;") and not one(spark, R.is_garbled_block, "A plain sentence of words.") and not one(spark, R.is_garbled_block, "漢字漢字漢字漢字漢字AB12") and one(spark, R.is_garbled_block, "plain words \x01 and more")
    assert one(spark, R.without_image_tail, "text\n\n![a](b)\n<div><img src='x'></div>\n") == "text" and one(spark, R.without_image_tail, "![a](b) text") == "![a](b) text"
    assert one(spark, R.can_repeat, "word " * 20 + "end.") and not one(spark, R.can_repeat, "word " * 20) and not one(spark, R.can_repeat, "# " + "word " * 20 + ".")
    assert one(spark, R.is_exportable_heading, "A Short Heading") and not one(spark, R.is_exportable_heading, "It ends. Then more") and not one(spark, R.is_exportable_heading, "")
    assert one(spark, R.swallows_next, "x\n## The Next One\ny", "The next one!") and not one(spark, R.swallows_next, "the next one", "The next one")
    assert one(spark, R.raw_marker_hits, "a[1] 2[3] [4a]") == ["1", "4a"]
    rows = [("b", "n1", "[1] short"), ("b", "n1", "longer <sup>2</sup> text here"), ("b", "n1", None), ("b", "n2", "  ")]
    got = R.best_definitions(spark.createDataFrame(rows, "book string, note_id string, t string"), ["book", "note_id"], "t").collect()
    assert [tuple(r) for r in got] == [("b", "n1", "longer text here")]
    items = spark.createDataFrame([("b", 2, "en-1", "1"), ("b", 1, "x", "01"), ("b", 3, "y", "*")], "book string, page_no int, note_id string, marker string")
    assert R.marker_sequences(items, ["book"], ["page_no"]).first().sequences == {"1": ["x", "en-1"], "01": ["x"], "x": ["x"], "y": ["y"], "*": ["y"]}
