"""Pages: their text and headings, body paragraphs, footnote bands, note positions, unfinished JSON. Column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quirelake.functions import markers as M
from quirelake.functions import text as T

# Line forms, boilerplate of books, limits of note positions.
HEADING = r"^\s{0,3}#{1,6}\s*(.+?)\s*$"
DEFINITION = r"^\s*(?:\[\^?[0-9]{1,4}\]|[0-9]{1,4}[.)]|<sup>\s*[0-9]{1,4}\s*</sup>|\$\s*\^\{[0-9]{1,4}\}\s*\$|\^\{[0-9]{1,4}\}|[⁰¹²³⁴⁵⁶⁷⁸⁹]{1,4})\s*\S+"
TITLE_LABELS = ("doc_title", "paragraph_title")
SEPARATOR = r"^[-=_]{3,}\s*$"
BAND_ITEM = r"(?s)^\s*([0-9]{1,4})(?:\s*[.、）)\]]\s*|\s+)(.*)$"
SYMBOL_ITEM = r"(?s)^\s*(\*{1,4}|†{1,2}|‡{1,2}|§|¶)\s+(.*)$"
REACH, SURE, LIKELY, FACTOR, SLACK = 240.0, 40.0, 100.0, 1.8, 20.0
STRONG = (r"(^|[^a-z0-9_])all rights reserved([^a-z0-9_]|$)", r"(^|[^a-z0-9_])copyright([^a-z0-9_]|$)", r"(^|[^a-z0-9_])isbn(-1[03])?([^a-z0-9_]|$)", r"(^|[^a-z0-9_])cip([^a-z0-9_]|$)", "版权所有", "图书在版编目")
WEAK = (r"(^|[^a-z0-9_])publisher([^a-z0-9_]|$)", r"(^|[^a-z0-9_])printed in([^a-z0-9_]|$)", r"(^|[^a-z0-9_])editorial([^a-z0-9_]|$)", "出版社", "印刷", "定价")


def markdown_text(enriched: Column, plain: Column, nested: Column) -> Column:
    """The first of three texts that is not blank, trimmed."""
    return F.coalesce(*(F.nullif(F.trim(T.plain(c)), F.lit("")) for c in (enriched, plain, nested)), F.lit(""))


def headings(blocks: Column, markdown: Column) -> Column:
    """Distinct headings by key: of title blocks (label, text) in order, else of the first eight lines."""
    from_blocks = F.transform(F.filter(F.coalesce(blocks, F.array().cast(blocks_type())), lambda b: F.lower(b["label"]).isin(*TITLE_LABELS)), lambda b: T.squeezed(b["text"]))
    lines = F.filter(F.slice(F.split(T.plain(markdown), "\n", -1), 1, 8), lambda x: F.regexp_like(x, F.lit(HEADING)))
    from_lines = F.transform(lines, lambda x: T.squeezed(F.regexp_extract(x, HEADING, 1)))

    def distinct(a: Column) -> Column:
        keyed = F.filter(F.transform(a, lambda x: F.struct(T.title_key(x).alias("key"), x.alias("text"))), lambda x: x["key"] != "")
        return F.transform(F.filter(keyed, lambda x, i: F.array_position(F.transform(keyed, lambda y: y["key"]), x["key"]) == i + 1), lambda x: x["text"])

    own = distinct(from_blocks)
    return F.when(F.size(own) > 0, own).otherwise(distinct(from_lines))


def blocks_type() -> str:
    return "array<struct<label:string,text:string>>"


def section_hint(page_headings: Column, scan_hints: Column) -> Column:
    """The first heading, else the first hint of the note scan."""
    return F.coalesce(F.get(page_headings, 0), F.get(scan_hints, 0), F.lit(""))


def body_paragraphs(markdown: Column, blocks: Column) -> Column:
    """array<struct<text, source>>: paragraphs of the text without headings, notes headings and definitions, then blocks of twenty
    characters or more; one of each key of letters and digits."""
    drop = lambda x: F.regexp_like(x, F.lit(HEADING)) | T.is_notes_heading(x) | F.regexp_like(T.squeezed(x), F.lit(DEFINITION))
    lines = F.transform(F.split(T.plain(markdown), "\n", -1), lambda x: F.when(drop(x), "").otherwise(T.squeezed(x)))
    texts = F.transform(F.split(F.array_join(lines, "\n"), r"\n{2,}", -1), lambda x: F.trim(F.regexp_replace(x, "\n+", " ")))
    own = F.transform(F.filter(texts, lambda x: x != ""), lambda x: F.struct(x.alias("text"), F.lit("markdown").alias("source")))
    texts_of = F.transform(F.filter(F.coalesce(blocks, F.array().cast(blocks_type())), lambda b: ~F.lower(F.coalesce(b["label"], F.lit(""))).isin(*TITLE_LABELS)), lambda b: T.squeezed(b["text"]))
    kept = F.filter(texts_of, lambda x: (F.char_length(x) >= 20) & ~drop(x))
    both = F.concat(own, F.transform(kept, lambda x: F.struct(x.alias("text"), F.lit("block").alias("source"))))
    keyed = F.filter(F.transform(both, lambda x, i: F.struct(F.lower(F.regexp_replace(x["text"], r"[^\p{L}\p{Nd}_]+", "")).alias("key"), i.alias("i"), x.alias("x"))), lambda x: x["key"] != "")
    # sorted by key and place, the first of each key stands behind another key
    firsts = T.let(F.array_sort(keyed), lambda a: F.filter(a, lambda x, i: (i == 0) | (F.get(a, i - 1)["key"] != x["key"])))
    return F.transform(F.array_sort(F.transform(firsts, lambda x: F.struct(x["i"].alias("i"), x["x"].alias("x")))), lambda x: x["x"])


def visible(paragraphs: Column) -> Column:
    """Paragraphs that the page before has not taken in."""
    return F.filter(paragraphs, lambda p: ~F.coalesce(p["consumed"], F.lit(False)))


def is_prose(markdown: Column) -> Column:
    """Whether the text behind a page's first heading is prose: references, long or finished lines."""
    body = F.trim(F.regexp_replace(T.plain(markdown), r"(?s)^.*?(?m:^)\s{0,3}#{1,6}[^\n]*\n?", ""))
    refs = F.regexp_like(body, F.lit(r"\{\{NOTE_REF:|\[\^[^\]]+\]|\^\{[0-9]+\}|<sup>\s*[0-9]+\s*</sup>"))
    lines = F.slice(F.filter(F.transform(F.split(body, "\n"), lambda x: F.trim(x)), lambda x: x != ""), 1, 10)
    n = lambda size, p=None: F.size(F.filter(lines, lambda x: (F.char_length(x) >= size) & (F.regexp_like(x, F.lit(p)) if p else F.lit(True))))
    total = F.aggregate(F.slice(lines, 1, 6), F.lit(0), lambda a, x: a + F.char_length(x))
    ends = "[.!?。！？]"
    return (body != "") & (refs | (n(60) >= 2) | ((n(60) >= 1) & (n(30) >= 3)) | (n(40, ends) >= 2) | ((n(40, ends) >= 1) & (total >= 180)) | (n(10, ends) >= 1) | ((n(0, "[a-zà-ÿ]") >= 2) & (total >= 70)))


def is_author_blurb(markdown: Column, page_headings: Column, page_no: Column, total: Column) -> Column:
    """A note on the author among the last pages: two headings that are no chapters, the second in capitals, and prose."""
    lines = F.slice(F.filter(F.transform(F.split(T.plain(markdown), "\n"), lambda x: F.trim(x)), lambda x: (x != "") & ~F.regexp_like(x, F.lit(HEADING))), 1, 24)
    chapter = lambda h: F.regexp_like(F.lower(F.coalesce(h, F.lit(""))), F.lit(r"^(chapter|chapitre|lecture|lesson|le[cç]on|part|introduction|conclusion|epilogue)([^a-z]|$)"))
    prose = F.size(F.filter(lines, lambda x: (F.char_length(x) >= 60) & F.regexp_like(F.lower(x), F.lit("[a-zà-ÿ]{4,}"))))
    size = F.aggregate(lines, F.lit(0), lambda a, x: a + F.char_length(x))
    rear = (total >= 40) & (page_no >= F.greatest(F.lit(1), total - F.greatest(F.lit(12), F.floor(total * 0.04))))
    names = (F.size(page_headings) >= 2) & ~chapter(F.get(page_headings, 0)) & ~chapter(F.get(page_headings, 1)) & (T.uppercase_share(F.coalesce(F.get(page_headings, 1), F.lit(""))) >= 0.45)
    return F.coalesce(rear & (F.size(lines) >= 4) & names & ((prose >= 2) | ((prose >= 1) & (size >= 150))), F.lit(False))


def is_block_heading(c: Column) -> Column:
    """Whether a title block reads like a heading: 8 to 120 characters, few marks and words, mostly letters."""
    t = T.squeezed(M.to_brackets(c))
    p = F.regexp_replace(t, r"^[0-9]+[.)]\s*", "")
    count = lambda marks: F.char_length(p) - F.char_length(F.translate(p, marks, ""))
    letters = F.char_length(F.regexp_replace(p, r"\P{L}", ""))
    return F.char_length(p).between(8, 120) & ~F.regexp_like(p, F.lit("[.!?]$")) & (count(":") <= 1) & (count(",") <= 1) & (count(";") == 0) & (F.size(F.split(p, r"\s+")) <= 18) & (100 * letters >= 55 * F.char_length(p)) & (F.regexp_like(p, F.lit(r"^\p{Lu}")) | F.regexp_like(t, F.lit("^[0-9]")))


def print_label(first: Column, last: Column) -> Column:
    """The printed label of a stretch of pages; one label where both agree."""
    a, b = T.plain(first), T.plain(last)
    return F.when(a == "", "").when((b == "") | (a == b), a).otherwise(F.concat(a, F.lit("-"), b))


def merged_blocks(blocks: Column) -> Column:
    """Blocks (label, text, heading_level, is_meta) as paragraphs (heading_level, text): title labels give a level, marked lines
    their own; short ends without a closing mark, and texts in parentheses, go on with the paragraph before."""
    kept = F.filter(blocks, lambda b: ~F.coalesce(b["is_meta"], F.lit(False)) & (F.char_length(T.plain(b["text"])) >= 2))

    def one(b: Column) -> Column:
        lines = F.filter(F.transform(F.split(T.plain(b["text"]), "\n"), lambda x: F.trim(x)), lambda x: (x != "") & ~T.is_meta(x))
        text, given = F.trim(F.array_join(lines, " ")), F.coalesce(b["heading_level"], F.lit(0))
        level = F.when(T.heading_level(text) > 0, T.heading_level(text)).when(given > 0, given).when(b["label"] == "doc_title", 1).when(b["label"] == "paragraph_title", 2).otherwise(0)
        return F.struct(level.alias("heading_level"), T.heading_text(text).alias("text"))

    rows = F.filter(F.transform(kept, one), lambda r: r["text"] != "")
    joins = lambda r: (r["heading_level"] == 0) & (((F.char_length(r["text"]) < 60) & ~F.regexp_like(r["text"], F.lit("[.;!?。；！？]$"))) | F.regexp_like(r["text"], F.lit(r"^\([^)]+\)$")))

    def add(acc: Column, r: Column) -> Column:
        last = F.element_at(acc, -1)
        grown = F.struct(last["heading_level"].alias("heading_level"), F.concat(last["text"], F.when(last["heading_level"] > 0, "\n").otherwise(" "), r["text"]).alias("text"))
        return F.when((F.size(acc) > 0) & joins(r), F.concat(F.slice(acc, F.lit(1), F.greatest(F.lit(0), F.size(acc) - 1)), F.array(grown))).otherwise(F.concat(acc, F.array(r)))

    return F.aggregate(rows, F.array().cast("array<struct<heading_level:int,text:string>>"), add)


def next_paragraphs(texts: Column, raw: Column, n: int = 1) -> Column:
    """The paragraphs behind the one that holds the last, or else the first, sixty characters of a text."""
    t, squeezed = T.squeezed(raw), F.transform(texts, lambda x: T.squeezed(x))
    size = F.least(F.lit(60), F.char_length(t))
    at = lambda part: F.array_min(F.filter(F.transform(squeezed, lambda x, i: F.when(F.contains(x, part), i)), lambda i: i.isNotNull()))
    hit = F.when(size > 10, F.coalesce(at(F.right(t, size)), at(F.left(t, size))))
    return F.when(hit.isNotNull(), F.slice(texts, hit + 2, F.lit(n))).otherwise(F.array().cast("array<string>"))


def note_band(lines: Column) -> Column:
    """struct(start, end) of a page's lines of notes: behind a separator, else the lowest run of two or more numbered lines to the
    end, else the lowest run of symbol lines to the end; -1 for none."""
    size = F.size(lines)
    flags = lambda p: F.transform(lines, lambda x: F.regexp_like(x, F.lit(p)))

    def top(a: Column, i: Column) -> Column:
        """First place of the run of true values that reaches i."""
        return F.coalesce(F.array_max(F.filter(F.transform(a, lambda x, j: F.when(~x & (j < i), j)), lambda j: j.isNotNull())) + 1, F.lit(0))

    places = lambda a, need: F.array_max(F.filter(F.transform(a, lambda x, j: F.when(x & (F.coalesce(F.get(a, j + 1), F.lit(False)) if need == 2 else F.lit(True)), j)), lambda j: j.isNotNull()))
    line = F.array_min(F.filter(F.transform(lines, lambda x, j: F.when(F.regexp_like(x, F.lit(SEPARATOR)), j)), lambda j: j.isNotNull()))
    numbered, symbols = flags(BAND_ITEM), flags(SYMBOL_ITEM)
    pair, symbol = places(numbered, 2), places(symbols, 1)
    start = F.when(size < 2, -1).when(line.isNotNull(), line + 1).when(pair.isNotNull(), top(numbered, pair)).when(symbol.isNotNull(), top(symbols, symbol)).otherwise(-1)
    return F.struct(start.alias("start"), F.when(start < 0, -1).otherwise(size).alias("end"))


def band_items(lines: Column) -> Column:
    """array<struct<marker, text>> of a band's lines; a line without marker goes on with the item before, one before all
    items is an item without marker. Lines of one page are few."""

    def add(acc: Column, x: Column) -> Column:
        part = lambda i: F.concat(F.regexp_extract(x, BAND_ITEM, i), F.when(F.regexp_like(x, F.lit(BAND_ITEM)), "").otherwise(F.regexp_extract(x, SYMBOL_ITEM, i)))
        last = F.element_at(acc, -1)
        item = F.array(F.struct(part(1).alias("marker"), F.trim(part(2)).alias("text")))
        grown = F.concat(F.slice(acc, F.lit(1), F.greatest(F.lit(0), F.size(acc) - 1)), F.array(F.struct(last["marker"].alias("marker"), F.concat(last["text"], F.lit(" "), x).alias("text"))))
        none = F.concat(acc, F.array(F.struct(F.lit("").alias("marker"), x.alias("text"))))
        return F.when(part(1) != "", F.concat(acc, item)).when((F.size(acc) > 0) & (last["marker"] != ""), grown).otherwise(none)

    return F.aggregate(lines, F.array().cast("array<struct<marker:string,text:string>>"), add)


def confident_paragraph(bottoms: Column, top: Column) -> Column:
    """The place of the paragraph that a footnote at `top` surely belongs to: the lowest one above it, if it is the only
    one within 240, or within 40, or within 100 and the next is 1.8 times as far. bottoms: array of box ends, null for none."""
    rows = F.filter(F.transform(bottoms, lambda b, i: F.when(b.isNotNull() & (b <= top + SLACK), F.struct(F.greatest(F.lit(0.0), top - b).alias("d"), (-i).alias("i")))), lambda x: x.isNotNull())
    best, second = F.get(F.array_sort(rows), 0), F.get(F.array_sort(rows), 1)
    ok = F.when(F.size(rows) == 1, best["d"] <= REACH).otherwise((best["d"] <= SURE) | ((best["d"] <= LIKELY) & (second["d"] >= best["d"] * FACTOR)))
    return F.when(ok, -best["i"])


def paragraph_blocks(paragraphs: Column, blocks: Column) -> Column:
    """For each paragraph the places of the blocks whose first fifty characters it holds; a block serves the first
    paragraph that holds it."""
    norm = lambda x: F.lower(T.squeezed(x))
    keys = F.transform(blocks, lambda b: F.substring(norm(b), 1, 50))
    texts = F.transform(paragraphs, lambda p: norm(p))
    owner = F.transform(keys, lambda k: F.when(F.char_length(k) >= 5, F.array_min(F.filter(F.transform(texts, lambda t, i: F.when(F.contains(t, k), i)), lambda i: i.isNotNull()))))
    return F.transform(paragraphs, lambda p, i: F.filter(F.transform(owner, lambda o, j: F.when(o == i, j)), lambda j: j.isNotNull()))


def boilerplate_kind(text: Column) -> Column:
    """strong or weak boilerplate of a page of front matter, or none."""
    t = F.lower(T.squeezed(text))
    return F.when(T.either(t, STRONG), "strong").when(T.either(t, WEAK), "weak").otherwise("")


def is_skipped(text: Column, leading: Column) -> Column:
    """Whether an export leaves a page out: strong boilerplate on a leading or very short page, weak on a short leading one."""
    n, kind = F.char_length(T.squeezed(text)), boilerplate_kind(text)
    return (n > 0) & (((leading | (n <= 120)) & (kind == "strong") & (n <= 1600)) | (leading & (n <= 220) & (kind != "")))


def json_prefix(c: Column) -> Column:
    """struct(text, closed) of an unfinished JSON string, from behind its opening quote: up to the closing quote or as far as its
    escapes are whole."""
    raw = F.regexp_extract(T.plain(c), r'(?s)^((?:[^"\\]|\\.)*+)', 1)
    closed = F.substr(T.plain(c), F.char_length(raw) + 1, F.lit(1)) == '"'
    # an escape of code points that is cut off or wrong ends the string
    cut = F.regexp_extract(raw, r"(?s)^((?:[^\\]|\\[^u]|\\u[0-9a-fA-F]{4})*+)", 1)
    decoded = F.from_json(F.concat(F.lit('{"a":"'), cut, F.lit('"}')), "a string", {"allowUnquotedControlChars": "true", "allowBackslashEscapingAnyCharacter": "true"})["a"]
    return F.struct(F.coalesce(decoded, F.lit("")).alias("text"), (closed & (cut == raw)).alias("closed"))


def json_preview(c: Column, name: str = "translation") -> Column:
    """What an unfinished JSON text holds of a field so far."""
    start = rf'(?s)^.*?"{name}"\s*:\s*"'
    return F.when(F.regexp_like(T.plain(c), F.lit(start)), json_prefix(F.regexp_replace(T.plain(c), start, ""))["text"]).otherwise("")


def unix_time(c: Column, pattern: str = "yyyy-MM-dd HH:mm:ss") -> Column:
    """Seconds since the epoch as local time of the session; empty for none."""
    return F.when(c > 0, F.date_format(F.timestamp_seconds(c), pattern)).otherwise("")


def plain_json(*columns: str) -> Column:
    """A record as JSON, nulls included."""
    return F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})
