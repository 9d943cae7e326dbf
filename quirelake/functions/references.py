"""References to notes in texts: tokens, raw markers, local labels; and tests of exported chapters. Column functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quirelake.functions import text as T
from quirelake.functions.markers import DIGITS, RAISED

# Forms of references, of raw markers, of text markup, of line prefixes; marks of garbled text.
TOKEN = r"(?i)\{\{NOTE_REF:([^}]+)\}\}|\{\{FN_REF:([^}]+)\}\}|\{\{EN_REF:([^}]+)\}\}|\[EN-([^\]{}]+)\]|\[FN-([^\]{}]+)\]|\[\^([^\]]+)\]"
BROKEN_TOKEN = r"(?i)\{\{NOTE_REF:([^}\]]+)\]\}\}"
RAW = {
    "bracket": r"(?<![0-9])\[([0-9]{1,4}[A-Za-z]?)\](?![0-9])",
    "superscript": r"(?i)\$\s*\^\{\s*\[?[0-9]{1,4}[A-Za-z]?\]?\s*\}\s*\$|\$\s*\^\{\s*\*{1,4}\s*\}\s*\$|<sup>\s*\[?[0-9]{1,4}[A-Za-z]?\]?\s*</sup>",
    "unicode": f"[{RAISED}]+",
}
BODY_MARKUP = r"(?i)\$\s*\^\{\s*\[?[0-9]{1,4}[A-Za-z]?\]?\s*\}\s*\$|\$\s*\^\{\s*(\*{1,4})\s*\}\s*\$|<sup>\s*\[?[0-9]{1,4}[A-Za-z]?\]?\s*</sup>"
LEADING_MARKER = r"(?i)^\s*(?:\[[0-9]{1,4}[A-Za-z]?\]|[0-9]{1,4}[A-Za-z]?[.)]|\*{1,4}\s+|<sup>\s*[0-9]{1,4}[A-Za-z]?\s*</sup>)\s*"
IMAGE_TAIL = r"(?is)(?:(?:\n\s*)*(?:<div[^>]*>\s*<img\b[^>]*>\s*</div>|!\[[^\]]*\]\([^)]+\))\s*)+$"
PREFIX = r"^(\s*\[\^[^\]]+\]:\s+|\s*#{1,6}\s+|\s*[-*+]\s+|\s*[0-9]+\.\s+|\s*>\s+|\s*)(.*)$"
CONTROL = r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]"
CJK = r"[\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{F900}-\x{FAFF}]"
SENTENCE_MARKS = "[.!?;:。！？；：]"


def marker_key(c: Column) -> Column:
    """A marker as letters and digits, without the label of endnotes; stars stay."""
    t = F.lower(F.translate(F.trim(T.plain(c)), RAISED, DIGITS))
    bare = F.regexp_replace(t, "[^0-9a-z]+", "")
    return F.when(F.regexp_like(t, F.lit(r"^\*{1,4}$")), t).otherwise(F.regexp_replace(bare, "^en(?=[0-9]+$)", ""))


def aliases(c: Column) -> Column:
    """A marker's key, and the key without leading zeros."""
    k = marker_key(c)
    return F.array_distinct(F.filter(F.array(k, F.regexp_replace(k, "^0+", "")), lambda x: x != ""))


def known_id(note_id: Column, known: Column) -> Column:
    """A note id in the form in which an array holds it, with or without the label of endnotes; empty if it doesn't."""
    t = F.trim(T.plain(note_id))
    other = F.when(F.regexp_like(t, F.lit("(?i)^en-")), F.substring(t, 4, 1 << 30)).otherwise(F.concat(F.lit("en-"), t))
    return F.when(t == "", "").when(F.array_contains(known, t), t).when(F.array_contains(known, other), other).otherwise("")


def token_id(hit: Column) -> Column:
    """The note id that a reference names."""
    part = lambda i: F.trim(F.regexp_extract(hit, TOKEN, i))
    endnote = lambda x: F.concat(F.lit("en-"), F.regexp_replace(x, "(?i)^en-(?=[0-9])", ""))
    return F.when(part(1) != "", part(1)).when(part(2) != "", part(2)).when(part(3) != "", endnote(part(3))).when(part(4) != "", endnote(part(4))).when(part(5) != "", part(5)).otherwise(part(6))


def legacy_as_tokens(c: Column) -> Column:
    """[EN-en-1], [FN-fn-1] and [^en-1] as protected tokens."""
    return F.regexp_replace(T.plain(c), r"(?i)\[EN-(en-[0-9]+)\]|\[FN-(fn-[0-9]+)\]|\[\^(en-[0-9]+)\]", "{{NOTE_REF:$1$2$3}}")


def unnested(c: Column) -> Column:
    """Tokens inside tokens taken apart: the inner one, then the outer one where it has text of its own. Each round opens
    one level, and there are no more levels than tokens."""
    t = T.plain(c)
    rounds = F.sequence(F.lit(1), F.greatest(F.lit(1), F.regexp_count(t, F.lit(r"(?i)\{\{NOTE_REF:"))))
    bare = r"(?i)\{\{NOTE_REF:\{\{NOTE_REF:([^{}]+)\}\}\}\}"
    nested = r"(?i)\{\{NOTE_REF:([^{}]*)\{\{NOTE_REF:([^{}]+)\}\}([^{}]*)\}\}"
    return F.aggregate(rounds, t, lambda acc, _: F.regexp_replace(F.regexp_replace(acc, bare, "{{NOTE_REF:$1}}"), nested, "{{NOTE_REF:$2}} {{NOTE_REF:$1$2$3}}"))


def _first_replaced(text: Column, part: Column, new: Column) -> Column:
    at = F.call_function("instr", text, part)
    return F.concat(F.substr(text, F.lit(1), at - 1), new, F.substr(text, at + F.char_length(part), F.char_length(text)))


def injected_once(text: Column, source_marker: Column, marker: Column, note_id: Column, phrase: Column | None = None) -> Column:
    """struct(text, done): the token of a note in place of its marker's first occurrence: as written, in brackets, as an
    old label, behind a phrase where one is given, or in brackets with blanks or a caret."""
    token, t = F.concat(F.lit("{{NOTE_REF:"), note_id, F.lit("}}")), T.plain(text)
    out = None
    wanted = [F.trim(source_marker), F.concat(F.lit("["), F.trim(marker), F.lit("]")), F.concat(F.lit("[EN-"), note_id, F.lit("]")), F.concat(F.lit("[FN-"), note_id, F.lit("]"))]
    for w in wanted:
        on, new = (w != "") & F.contains(t, w), _first_replaced(t, w, token)
        out = F.when(on, new) if out is None else out.when(on, new)
    if phrase is not None:
        out = out.when((F.trim(phrase) != "") & F.contains(t, F.trim(phrase)), _first_replaced(t, F.trim(phrase), F.concat(F.trim(phrase), token)))
    loose = F.concat(F.lit(r"\[\s*(?:\^)?\s*\Q"), F.trim(marker), F.lit(r"\E\s*\]"))
    parts = F.split(t, loose, 2)
    out = out.when((F.trim(marker) != "") & (F.size(parts) > 1), F.concat(F.get(parts, 0), token, F.get(parts, 1)))
    return F.struct(F.coalesce(F.when(note_id != "", out), t).alias("text"), ((note_id != "") & F.coalesce(out.isNotNull(), F.lit(False))).alias("done"))


def raised_as_tags(c: Column) -> Column:
    """struct(text, n): runs of raised digits as <sup>n</sup>, and how many."""
    t, hits = T.plain(c), F.regexp_extract_all(T.plain(c), F.lit(RAW["unicode"]), F.lit(0))
    gaps = F.split(t, RAW["unicode"], -1)
    tagged = F.concat(F.array_join(F.zip_with(F.slice(gaps, F.lit(1), F.size(hits)), hits, lambda g, h: F.concat(g, F.lit("<sup>"), F.translate(h, RAISED, DIGITS), F.lit("</sup>"))), ""), F.element_at(gaps, -1))
    return F.struct(tagged.alias("text"), F.size(hits).alias("n"))


def notes_block(c: Column) -> Column:
    """Definition lines `[^n]: text` as `[^n]: n. text`, under a NOTES heading, which is put in where there is none;
    doing it twice changes nothing."""
    line = r"^\[\^([0-9]+)\]:\s*(.*?)\s*$"
    lines = F.split(F.regexp_replace(T.plain(c), "\n$", ""), "\n", -1)
    is_line = lambda x: F.regexp_like(x, F.lit(line))
    number = lambda x: F.regexp_extract(x, line, 1).cast("int").cast("string")
    body = lambda x: F.regexp_extract(x, line, 2)
    printed = lambda x: F.concat(F.lit("[^"), number(x), F.lit("]: "), F.when(F.startswith(body(x), F.concat(number(x), F.lit(". "))), body(x)).otherwise(F.concat(number(x), F.lit(". "), body(x))))
    new = F.array_join(F.transform(lines, lambda x: F.when(is_line(x), printed(x)).otherwise(x)), "\n")
    has, heading = F.exists(lines, is_line), F.exists(lines, lambda x: F.startswith(F.trim(x), F.lit("### NOTES")))
    parts = F.split(F.concat(F.lit("\n"), new), r"\n(?=\[\^[0-9]+\]:)", 2)
    body_part = F.regexp_replace(F.regexp_replace(F.get(parts, 0), "^\n", ""), r"\s+$", "")
    with_heading = F.concat(body_part, F.when(body_part != "", "\n\n").otherwise(""), F.lit("### NOTES\n\n"), F.coalesce(F.get(parts, 1), F.lit("")))
    out = F.regexp_replace(F.when(has & ~heading, with_heading).otherwise(new), r"\s+$", "")
    return F.when(T.plain(c) == "", "").otherwise(F.concat(out, F.when(F.endswith(T.plain(c), F.lit("\n")), "\n").otherwise("")))


def clean_note(c: Column) -> Column:
    """A note's text without body markup and its own leading marker, white space squeezed."""
    return T.squeezed(F.regexp_replace(F.trim(F.regexp_replace(F.trim(T.plain(c)), BODY_MARKUP, "")), LEADING_MARKER, ""))


def definition_rank(c: Column) -> Column:
    """Of several definitions of a note the greatest rank wins: without body markup before with it, then the longest."""
    t = F.trim(T.plain(c))
    return F.when(t == "", F.struct(F.lit(-1).alias("clean"), F.lit(0).alias("size"))).otherwise(F.struct(F.when(F.regexp_like(t, F.lit(BODY_MARKUP)), 0).otherwise(1).alias("clean"), F.char_length(t).alias("size")))


def markdown_prefix(c: Column) -> Column:
    """struct(prefix, content) of a line."""
    t = T.plain(c)
    return F.struct(F.regexp_extract(t, PREFIX, 1).alias("prefix"), F.regexp_extract(t, PREFIX, 2).alias("content"))


def is_garbled_block(c: Column) -> Column:
    """Twelve or more visible characters with control marks, a run of capitals and digits, or mostly such characters;
    mostly Chinese text without the first two is not."""
    t = F.trim(T.plain(c))
    solid = F.regexp_replace(t, r"\s", "")
    n = F.char_length(solid)
    odd = F.regexp_like(t, F.lit(CONTROL)) | F.regexp_like(t, F.lit("[A-Z0-9@;:<>=?]{12,}"))
    capital = F.char_length(F.regexp_replace(solid, r"[^\p{Lu}\p{Nd}@;:<>=?]", ""))
    return (n >= 12) & (odd | ((10 * F.char_length(F.regexp_replace(solid, f"[^{CJK[1:]}", "")) < 3 * n) & (100 * capital >= 55 * n)))


def without_image_tail(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.trim(T.plain(c)), IMAGE_TAIL, ""), r"\s+$", "")


def can_repeat(c: Column) -> Column:
    """A paragraph long enough that a second copy of it is a fault: 80 characters, 12 words, a sentence mark, no heading."""
    t = T.squeezed(c)
    return ~F.startswith(t, F.lit("#")) & (F.char_length(t) >= 80) & (F.size(F.split(t, " ")) >= 12) & F.regexp_like(t, F.lit(SENTENCE_MARKS))


def is_exportable_heading(c: Column) -> Column:
    """A section heading that is no sentence: under 16 words and 110 characters, no closing mark, no second sentence."""
    t = T.squeezed(c)
    long = (F.size(F.split(t, " ")) >= 16) | (F.char_length(t) >= 110)
    return (t != "") & ~long & ~F.regexp_like(t, F.lit("[!;]$")) & ~F.regexp_like(t, F.lit(r"[.!;]\s+[A-Za-zÀ-ÖØ-öø-ÿ]"))


def swallows_next(content: Column, next_title: Column) -> Column:
    """Whether a chapter's text has a heading that is the next chapter's title."""
    key = lambda x: F.regexp_replace(F.lower(x), r"[^\p{L}0-9]+", "")
    heads = F.filter(F.split(T.plain(content), "\n"), lambda x: F.regexp_like(F.trim(x), F.lit(r"^#{1,6}\s+\S")))
    return (key(T.plain(next_title)) != "") & F.exists(heads, lambda x: key(F.regexp_replace(F.trim(x), r"^#{1,6}\s+", "")) == key(next_title))


def raw_marker_hits(c: Column, allowed: Column | None = None) -> Column:
    """Raw [n] markers of a text, those of an array only where one is given."""
    hits = F.regexp_extract_all(T.plain(c), F.lit(RAW["bracket"]), F.lit(1))
    return hits if allowed is None else F.filter(hits, lambda h: F.array_contains(F.transform(allowed, marker_key), marker_key(h)))


# local labels


def _relabelled(df: DataFrame, text: str, pattern: str, ids) -> DataFrame:
    """One pass: `ids` gives, for the array of hits, each hit's note id (empty: the hit stays). Endnotes get numbers by
    first use, which go on in _order; footnotes become a star and are kept in _feet."""
    hits = F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(0))
    df = df.withColumn("_hits", hits).withColumn("_gaps", F.split(F.col(text), pattern, -1)).withColumn("_ids", ids(F.col("_hits")))
    kind = lambda i: F.coalesce(F.try_element_at("_kinds", i), F.lit(""))
    df = df.withColumn("_order", F.array_distinct(F.concat("_order", F.filter("_ids", lambda i: (i != "") & (kind(i) != "footnote")))))
    df = df.withColumn("_feet", F.array_distinct(F.concat("_feet", F.filter("_ids", lambda i: kind(i) == "footnote"))))
    label = lambda h, i: F.when(i == "", h).when(kind(i) == "footnote", "*").otherwise(F.concat(F.lit("[^"), F.array_position("_order", i).cast("string"), F.lit("]")))
    labels = F.zip_with("_hits", "_ids", label)
    joined = F.concat(F.array_join(F.zip_with(F.slice("_gaps", F.lit(1), F.size(labels)), labels, lambda g, x: F.concat(g, x)), ""), F.element_at("_gaps", -1))
    return df.withColumn(text, F.when(F.size("_hits") > 0, joined).otherwise(F.col(text))).drop("_hits", "_gaps", "_ids")


def _keys(hits: Column) -> Column:
    return F.transform(hits, lambda h: marker_key(F.regexp_extract(h, rf"\*{{1,4}}|[0-9]{{1,4}}[A-Za-z]?|[{RAISED}]+", 0)))


def _consumed(hits: Column) -> Column:
    """ids of raw markers: the n-th use of a marker, over all passes, is the n-th note of its sequence, at most the last."""
    keys = _keys(hits)

    def one(k: Column, i: Column) -> Column:
        notes = F.coalesce(F.try_element_at("_sequences", k), F.array().cast("array<string>"))
        before = F.size(F.filter(F.slice(keys, F.lit(1), i), lambda x: x == k)) + F.size(F.filter("_used", lambda x: x == k))
        return F.when(F.size(notes) == 0, "").otherwise(F.get(notes, F.least(before, F.size(notes) - 1)))

    return F.transform(keys, one)


def rewritten(df: DataFrame, text: str, known: str, kinds: str, sequences: str) -> DataFrame:
    """df with the references of `text` as local labels, and the columns ordered_ids and footnote_ids. known: array of note
    ids; kinds: map from id to endnote or footnote; sequences: map from marker key to an array of ids. Tokens come
    first, then raw markers in brackets, superscripts and raised digits."""
    names = df.columns
    none = F.array().cast("array<string>")
    out = df.withColumns({"_order": none, "_feet": none, "_used": none, "_kinds": F.col(kinds), "_sequences": F.col(sequences)})
    out = out.withColumn(text, F.regexp_replace(T.plain(F.col(text)), BROKEN_TOKEN, "{{NOTE_REF:$1}}"))
    out = _relabelled(out, text, TOKEN, lambda hits: F.transform(hits, lambda h: known_id(token_id(h), F.col(known))))
    for pattern in RAW.values():
        out = out.withColumn("_next", F.concat("_used", _keys(F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(0)))))
        out = _relabelled(out, text, pattern, _consumed).withColumn("_used", F.col("_next")).drop("_next")
    return out.select(*names, F.col("_order").alias("ordered_ids"), F.col("_feet").alias("footnote_ids"))


def marker_sequences(items: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """Per group, a map from each marker alias to its notes in order. items: group, order columns, note_id, marker."""
    rows = items.select(*key, *order, "note_id", F.explode(F.array_union(aliases(F.col("note_id")), aliases(F.col("marker")))).alias("alias"))
    lists = rows.groupBy(*key, "alias").agg(F.array_sort(F.collect_list(F.struct(*order, "note_id"))).alias("_n"))
    return lists.groupBy(*key).agg(F.map_from_entries(F.collect_list(F.struct("alias", F.transform("_n", lambda x: x["note_id"])))).alias("sequences"))


def best_definitions(notes: DataFrame, key: list[str], text: str) -> DataFrame:
    """The best text of each note id, by a sum with map-side combination."""
    rows = notes.withColumn("_t", clean_note(F.col(text))).where("_t <> ''")
    return rows.groupBy(*key).agg(F.max_by("_t", F.struct(definition_rank(F.col("_t")), F.col("_t"))).alias("text"))
