"""Text tests and rewrites on lines, paragraphs and pages, as column functions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns of metadata lines, journal names, boilerplate of author notes, title families, closers.
META = (
    r"^https?://", r"^doi:\s*10\.", r"^10\.[0-9]{4,}/", r"sagepub\.com|journals\.sagepub|springer\.com|wiley\.com", r"©.*[0-9]{4}", r"^article\s*reuse\s*guidelines", r"^sage$", r"^article$",
    r"^[0-9]{1,4}[–\-][0-9]{1,4}$", r"^vol\.\s*[0-9]+", r"^accepted:|^received:|^published:", r"^corresponding\s+author", r"^(e-?mail:\s*)?\S+@\S+\.\S+$",
)
JOURNAL = r"^(history|journal|annals|bulletin|review|archives|proceedings|quarterly|american|british|european|international)\s+(of|for)\s+[a-z0-9_]+"
AUTHOR_NOTE = (r"corresponding\s+author", r"e-?mail:\s*\S+@", r"^\S+@\S+\.\S+$", r"^[0-9]+,?\s+sec\.", r"university,?\s+[0-9]+", r"(street|road|ave|blvd|district),?\s", r"(taiwan|china|usa|uk|japan|korea)\s*\.?\s*$")
FAMILIES = (
    ("contents", r"^contents\b|^table of contents$|^table$|^table des mati[eè]res$|^sommaire$"),
    ("illustrations", r"^illustrations?$|^list of illustrations$|^list of figures$|^liste des illustrations?$|^liste des figures?$|^tables and maps$|^tables$|^figures and tables$|^figures$"),
    ("bibliography", r"^bibliograph|^references?$|^works cited$|^livres et articles\b"),
    ("index", r"^index\b|^indices?\b"),
    ("appendix", r"^appendix\b|^appendices$|^annex|^glossary$|^note on sources$|^sources?$|^conventions$|^abbreviations?$"),
    ("front_matter", r"^acknowledg|^remerciement|^foreword$|^preface$|^avant-propos$|^avertissement$|^abstract$|^introduction$"),
)
CLOSERS = r"[.!?…。！？;:»”\"')\]]"
#: Ranges that hold all letters whose capital form has several characters, these letters, and for each the one character that stands for its capital.
SPREAD = "ßŉǰΐΰև\u1e96-\u1fff\ufb00-\ufb17"
SPREAD_LETTERS = "ßŉǰΐΰև" + "".join(map(chr, [*range(0x1E96, 0x2000), *range(0xFB00, 0xFB18)]))
SINGLE = "".join("ẞ" if c == "ß" else next((x for x in (c.upper(), c.title()) if len(x) == 1), c) for c in SPREAD_LETTERS)
ACCENTS = ("àáâãäåçèéêëìíîïñòóôõöùúûüýÿ", "aaaaaaceeeeiiiinooooouuuuyy")


def either(c: Column, patterns) -> Column:
    return reduce(lambda a, b: a | b, (F.regexp_like(c, F.lit(p)) for p in patterns))


def let(value: Column, body) -> Column:
    """body(value) with value computed once, also inside lambdas, where Spark shares no common parts."""
    return F.element_at(F.transform(F.array(value), body), 1)


def plain(c: Column) -> Column:
    """Null as empty."""
    return F.coalesce(c, F.lit(""))


def joined(c: Column) -> Column:
    """An array of lines as one text; null as empty."""
    return F.coalesce(F.array_join(c, "\n"), F.lit(""))


def without_tags(c: Column) -> Column:
    return F.regexp_replace(c, "<[^>]+>", "")


def squeezed(c: Column) -> Column:
    """White space runs as one space, ends trimmed."""
    return F.trim(F.regexp_replace(plain(c), r"\s+", " "))


def upper_each(c: Column) -> Column:
    """Capital letters one for one: no letter becomes several, as upper() makes SS of ß."""
    one = lambda x: F.when(F.regexp_like(x, F.lit(f"[{SPREAD}]")), F.translate(x, SPREAD_LETTERS, SINGLE)).otherwise(F.upper(x))
    parts = F.transform(F.split(c, f"(?<=[{SPREAD}])|(?=[{SPREAD}])", -1), one)
    return F.when(F.regexp_like(c, F.lit(f"[{SPREAD}]")), F.array_join(parts, "")).otherwise(F.upper(c))


def sanitised(c: Column) -> Column:
    """Without control characters but tab and line ends."""
    return F.regexp_replace(plain(c), r"[\x00-\x08\x0b\x0c\x0e-\x1f]", "")


def heading_level(c: Column) -> Column:
    return F.char_length(F.regexp_extract(c, r"^(#{1,6})\s+", 1))


def heading_text(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"^#{1,6}\s+", ""))


def is_meta(c: Column) -> Column:
    """Addresses, identifiers, page ranges, journal names and the like, and lines under two characters."""
    t = F.lower(F.trim(c))
    return (F.char_length(t) < 2) | either(t, META) | ((F.char_length(t) < 60) & F.regexp_like(t, F.lit(JOURNAL)))


def is_author_note(c: Column) -> Column:
    """At least half of a note's lines are addresses, and none is numbered."""
    ls = F.filter(F.transform(F.split(F.lower(plain(c)), "\n", -1), lambda x: F.trim(x)), lambda x: x != "")
    return ~F.exists(ls, lambda x: F.regexp_like(x, F.lit(r"^[0-9]+[.)]\s*"))) & (F.size(ls) > 0) & (2 * F.size(F.filter(ls, lambda x: either(x, AUTHOR_NOTE))) >= F.size(ls))


def odd_share(c: Column) -> Column:
    """Share of characters outside common scripts and punctuation."""
    odd = F.char_length(F.regexp_replace(c, r"[\x00-\x7f -ɏ‐-‧‰-⁞　-〿一-鿿]", ""))
    return odd / F.nullif(F.char_length(c), F.lit(0))


def uppercase_share(c: Column) -> Column:
    n = F.char_length(F.regexp_replace(c, r"\P{L}", ""))
    return F.coalesce(F.char_length(F.regexp_replace(c, r"\P{Lu}", "")) / F.nullif(n, F.lit(0)), F.lit(0.0))


def is_notes_heading(c: Column) -> Column:
    return F.regexp_like(F.lower(plain(c)), F.lit(r"^\s*(?:#+\s*)?(notes?|endnotes?|notes to pages?.*)\s*$"))


def title_family(c: Column) -> Column:
    t = F.lower(squeezed(c))
    return F.coalesce(*(F.when(F.regexp_like(t, F.lit(p)), name) for name, p in FAMILIES), F.lit("body"))


def title_key(c: Column) -> Column:
    """Lower case, accents of Latin letters folded, letters and digits only."""
    return F.regexp_replace(F.translate(F.lower(squeezed(c)), *ACCENTS), "[^0-9a-z]+", "")


def chapter_key(c: Column) -> Column:
    """A title without its label and number."""
    t = F.regexp_replace(F.lower(squeezed(c)), r"^\s*(?:chapter|chapitre|part|section)\b[:\s\-]*", "")
    return F.regexp_replace(F.regexp_replace(F.trim(t), r"^\s*(?:[0-9]+|[ivxlcdm]+)[.)]\s*", ""), "[^0-9a-zà-ÿ]+", "")


def summary_key(c: Column) -> Column:
    return F.lower(F.regexp_replace(squeezed(c), r"\s+([?!:;,])", "$1"))


def ends_sentence(c: Column) -> Column:
    """Whether the text, without trailing note markers, ends a sentence."""
    bare = F.regexp_replace(F.trim(plain(c)), r"(?:\s*(?:\[\^?[0-9]{1,4}\]|\$?\^\{[0-9]{1,4}\}\$?|[⁰¹²³⁴⁵⁶⁷⁸⁹]+))+$", "")
    return F.regexp_like(bare, F.lit("[.!?…。！？][\"'”’»)\\]]*$"))


def without_trailing_markers(c: Column) -> Column:
    return F.regexp_replace(F.trim(plain(c)), r"(?:\s*(?:\[\^?[0-9]{1,4}\]|\$?\^\{[0-9]{1,4}\}\$?|[⁰¹²³⁴⁵⁶⁷⁸⁹]+))+$", "")


def ends_midway(c: Column) -> Column:
    return (F.char_length(F.trim(plain(c))) >= 10) & ~ends_sentence(c)


def starts_low(c: Column) -> Column:
    return F.regexp_like(F.trim(plain(c)), F.lit(r"^\p{Ll}"))


def starts_with_continuation(c: Column) -> Column:
    return F.regexp_like(F.trim(plain(c)), F.lit(r"^[,;:)\]}.]"))


def continues(before: Column, after: Column) -> Column:
    """Whether after goes on with before's sentence."""
    return ends_midway(before) & (starts_low(after) | starts_with_continuation(after))


def caps_title_level(c: Column) -> Column:
    """3 for a title in capitals, else 0."""
    t = F.trim(plain(c))
    words = F.filter(F.split(t, r"\s+"), lambda w: (F.char_length(w) > 1) & F.regexp_like(w, F.lit(r"^\p{L}+$")))
    letters = F.char_length(F.regexp_replace(t, r"\P{L}", ""))
    ok = F.char_length(t).between(3, 120) & (F.regexp_count(t, F.lit(r"\p{Ll}")) == 0) & (letters >= 0.6 * F.char_length(t)) & (F.size(words) >= 2) & ~(ends_sentence(t) & (F.char_length(t) > 60))
    return F.when(ok, 3).otherwise(0)


def is_colon_title(c: Column) -> Column:
    t = F.trim(plain(c))
    return (F.char_length(F.regexp_replace(t, "[^:]", "")) == 1) & F.regexp_like(t, F.lit(r"^\p{Lu}[^:]{2,60}:\s*\p{Lu}")) & (F.char_length(t) <= 120) & ~ends_sentence(t)


def is_sentence_like(c: Column) -> Column:
    """Eight or more words with punctuation inside or mostly in lower case."""
    words = F.filter(F.split(squeezed(c), " "), lambda w: w != "")
    low = F.filter(words, lambda w: F.regexp_like(w, F.lit(r"^\p{Ll}")))
    return (F.size(words) >= 8) & (F.regexp_like(c, F.lit("[,;.!?]")) | (2 * F.size(low) > F.size(words)))


def is_bibliography_entry(c: Column) -> Column:
    return F.regexp_like(squeezed(c), F.lit(r":\s*[^:]{6,},\s*[0-9]{4}\.?\s*$"))


def note_definition(c: Column) -> Column:
    """struct(marker, body) of a note line; both empty when it is none."""
    t = F.trim(heading_text(plain(c)))
    p = r"^(?:\[([0-9]{1,4})\]|([0-9]{1,4})[.)\]])\s*(\S.*)$"
    marker = F.concat(F.regexp_extract(t, p, 1), F.regexp_extract(t, p, 2))
    ok = ~is_notes_heading(t) & (marker != "") & ~((F.regexp_extract(t, p, 2) != "") & marker.try_cast("int").between(1900, 2100))
    return F.struct(F.when(ok, F.regexp_replace(F.regexp_replace(marker, "^0+(?=[0-9])", ""), "^$", "")).otherwise("").alias("marker"), F.when(ok, F.regexp_extract(t, p, 3)).otherwise("").alias("body"))


def symbol_note(c: Column) -> Column:
    """The symbol of a symbol note line, or empty."""
    return F.regexp_extract(F.trim(plain(c)), r"^([*†‡§¶]{1,4})\s+\S", 1)


def marker_only(c: Column) -> Column:
    return F.regexp_extract(F.trim(plain(c)), r"^\[?([0-9]{1,4})[.)\]]?$", 1)


def trailing_next_marker(c: Column, current: Column) -> Column:
    """A number at the end of a note that is the next or next but one marker, or null."""
    n = F.regexp_extract(F.trim(plain(c)), r"\s([0-9]{1,4})\.?$", 1).try_cast("int")
    return F.when(n.between(current + 1, current + 2), n)


def broken_at_markers(c: Column) -> Column:
    """A line end before inline note starts, unless a citation word precedes."""
    return F.regexp_replace(plain(c), r"(?<!\b(?:p|pp|vol|no|fig|chap|n)\.)(?<=[.;!?»\"])[ ]+(?=[0-9]{1,3}\.[ ]+\p{Lu})", "\n")


def safe_title(c: Column) -> Column:
    """A title that can be a file name."""
    return F.substring(F.trim(F.regexp_replace(F.regexp_replace(plain(c), r"[\\/:*?\"<>|#^\[\]]", " "), r"\s+", " ")), 1, 80)


def escaped_asterisks(c: Column) -> Column:
    return F.regexp_replace(plain(c), r"(?m)^(\s*)\*(?!\*)", r"$1\\*")


def paragraph_key(c: Column) -> Column:
    """Lower case, without references, white space squeezed."""
    return F.trim(F.regexp_replace(F.lower(squeezed(c)), r"\[\^[0-9]+\]", ""))


def paragraphs(c: Column) -> Column:
    """Paragraphs of a text without headings."""
    return F.filter(F.transform(F.split(plain(c), r"\n\s*\n+", -1), lambda x: F.trim(x)), lambda p: (p != "") & ~F.startswith(p, F.lit("#")))


def lacks_tail(c: Column) -> Column:
    t = F.trim(plain(c))
    return (F.char_length(t) >= 60) & ~F.regexp_like(t, F.lit(CLOSERS + "$"))


def roman(c: Column) -> Column:
    """Value of a roman numeral: a sign counts negative before a larger one."""
    of = F.create_map(*(F.lit(x) for kv in (("i", 1), ("v", 5), ("x", 10), ("l", 50), ("c", 100), ("d", 500), ("m", 1000)) for x in kv))
    step = lambda acc, ch: F.struct((acc["n"] + F.when(of[ch] < acc["last"], -of[ch]).otherwise(of[ch])).alias("n"), F.greatest(acc["last"], of[ch]).alias("last"))
    total = F.aggregate(F.filter(F.split(F.reverse(F.lower(F.trim(c))), ""), lambda x: x != ""), F.struct(F.lit(0).alias("n"), F.lit(0).alias("last")), step)["n"]
    return F.when(F.regexp_like(F.lower(F.trim(c)), F.lit("^[ivxlcdm]+$")), total)


def column_index(c: Column) -> Column:
    """Spreadsheet column letters as a number from 0."""
    letters = F.filter(F.split(F.upper(F.regexp_replace(c, "[^A-Za-z]", "")), ""), lambda x: x != "")
    return F.aggregate(letters, F.lit(0), lambda a, x: a * 26 + F.ascii(x) - 64) - 1


def page_span(start: Column, end: Column) -> Column:
    return F.when(start == end, start.cast("string")).otherwise(F.concat_ws("-", start.cast("string"), end.cast("string")))


def frozen(note_id: Column) -> Column:
    """The protected token of a note reference."""
    return F.concat(F.lit("{{NOTE_REF:"), note_id, F.lit("}}"))


def thawed(c: Column, endnotes_as_carets: bool = False) -> Column:
    """Protected tokens as visible references; no space before them."""
    c = F.regexp_replace(c, r"[ ]*\{\{NOTE_REF:(en-[^}]+)\}\}", r"[^$1]" if endnotes_as_carets else r"[EN-$1]")
    return F.regexp_replace(c, r"[ ]*\{\{NOTE_REF:([^}]+)\}\}", r"[^$1]")


def note_refs(c: Column) -> Column:
    """Distinct ids of protected tokens and visible references, in order."""
    hits = F.regexp_extract_all(c, F.lit(r"\{\{NOTE_REF:[^}]+\}\}|\[\^[^\]]+\]"), F.lit(0))
    return F.array_distinct(F.transform(hits, lambda x: F.regexp_extract(x, r"^(?:\{\{NOTE_REF:|\[\^)([^}\]]+)", 1)))


def garble_stats(c: Column) -> Column:
    """Shares that tell readable text: letters, lower-case letters, digits, spaces, odd characters."""
    t = plain(c)
    solid = F.regexp_replace(t, r"\s", "")
    n = F.nullif(F.char_length(solid), F.lit(0))
    share = lambda keep: F.coalesce(F.char_length(F.regexp_replace(solid, keep, "")) / n, F.lit(0.0))
    return F.struct(share(r"\P{L}").alias("letters"), share(r"\P{Ll}").alias("lower"), share(r"[^0-9]").alias("digits"), (F.char_length(t) - F.char_length(solid)).alias("spaces"), (F.char_length(t) >= 10).alias("long_enough"))


def shifted(c: Column, by: int) -> Column:
    """Printable ASCII characters moved by an offset, others as they are."""
    code = lambda x: F.ascii(x)
    move = lambda x: F.when(code(x).between(33, 126) & (code(x) + by).between(33, 126), F.char(code(x) + by)).otherwise(x)
    return F.array_join(F.transform(F.filter(F.split(c, ""), lambda x: x != ""), move), "")
