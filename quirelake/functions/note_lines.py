"""Lines of note pages: numbered, embedded, noisy and lost notes, as column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quirelake.functions import text as T

# Headings of note pages, picture lists, title starts, citation words before a number, noise marks.
NOTES_HEADING = r"^\s*(notes?|endnotes?|注释|脚注|尾注)\s*$"
PICTURE_LIST = r"^\s*(list(e)?\s+(of\s+)?(illustrations?|figures?|plates?)|liste\s+des\s+illustrations?)([^a-z0-9_]|$)"
PICTURE_WORDS = r"©|cm([^a-z0-9_]|$)|mus[ée]e|biblioth[eè]que|gravure|huile|lithograph|dessin|eau-forte|collection"
TITLE_START = r"^([0-9]+[.\s]|(chapter|introduction|epilogue|afterword|appendix|preface|conclusion|le[cç]on|lesson)([^a-z0-9_]|$))"
CITATION_WORDS = ("p", "pp", "f", "fo", "f°", "esp", "para", "paras", "fol", "fols", "col", "cols", "vol", "n°", "no", "nos", "nr", "art", "chap", "sect", "§", "t", "tome", "liv", "bk", "book", "ch", "cf", "voir", "see", "infra", "supra", "ibid", "op", "loc", "id", "éd", "ed", "eds", "dir", "trad", "tr")
CLOSERS = (".", ";", ":", "!", "?", ")", "]", "»", "”", '"', "'")
TEXT_LABELS = ("text", "paragraph_title", "doc_title")
PICTURE_LABELS = ("image", "figure_title", "vision_footnote")
LEFT_WORD = r"([A-Za-zàâäéèêëïîôöùûüÿçœÀÂÄÉÈÊËÏÎÔÖÙÛÜŸÇŒ]+)$"
#: Words of four or more letters before a number that is no marker.
NUMBER_WORDS = (
    "chap", "chapitre", "article", "figure", "tableau", "tabl", "sect", "section", "voir", "infra", "supra", "elle", "elles",
    "letter", "letters", "lettre", "lettres", "page", "pages", "para", "paragraph", "paragraphe", "number", "numbers", "numéro", "numéros",
    "ligne", "lignes", "line", "lines", "colonne", "note", "notes", "chapter", "chapters", "part", "partie", "book", "livre", "livres",
    "strophe", "stanza", "scene", "scène", "épître", "epistle", "tome", "tomes", "volume", "volumes", "lesson", "leçon", "leçons", "mémoire", "memoir",
    "needs", "expect", "about", "some", "almost", "nearly",
    "january", "february", "march", "april", "june", "july", "august", "september", "october", "november", "december",
    "janvier", "février", "mars", "avril", "juin", "juillet", "août", "septembre", "octobre", "novembre", "décembre",
)
NOISE = r"^\s*[IiLl|'.,‘’“”]\s*((?:\[[0-9]{1,4}\]|[0-9]{1,4}[.;:,)、\]])\s*\S.+)$"
SPLIT_NUMBER = r"^\s*((?:[0-9][\s,.-]*){2,4})(?:[.;:,)、\]:-]|\s{1,3})(\S.+)$"
NUMBERED = r"^\s*(?:\[([0-9]{1,4})\]|([0-9]{1,4})[.;:,)、\]]|([0-9]{1,4})\s{1,3})\s*(\S.+)$"
ONLY_MARKER = r"^\s*(?:\[([0-9]{1,4})\]|([0-9]{1,4})[.;:,)、\]])\s*$"
EMBEDDED = r"^.{20,}?\s+([0-9]{1,4})\s+(\S.*)$"
SYMBOL = r"^\s*(\*{1,4}|†{1,2}|‡{1,2}|§|¶)\s+(\S.*)$"
NOISY_NEXT = r"^\s*([!¡|\[\]().,;:'\"“”‘’?/\\-]{1,6})\s*([0-9]{1,4}[A-Za-zÀ-ÖØ-öø-ÿ]{0,6})\s+(\S.*)$"


def normal_line(c: Column) -> Column:
    """Raised markers of formulas as [n], ends trimmed."""
    t = F.regexp_replace(F.trim(T.plain(c)), r"\$\s*\^\{([0-9]+)\}\s*\$", "[$1]")
    raised = F.trim(F.regexp_replace(t, r"(^|[^0-9A-Za-z_\[])\^\{([0-9]+)\}", "$1[$2]"))
    return F.when(F.contains(T.plain(c), F.lit("^{")), raised).otherwise(F.trim(T.plain(c)))


def without_heading(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"^\s{0,3}#{1,6}\s*", ""))


def is_heading_of_notes(c: Column) -> Column:
    return F.regexp_like(F.lower(without_heading(c)), F.lit(NOTES_HEADING))


def number_token(c: Column) -> Column:
    """The number of a token whose digits may stand apart; null for none or more than four."""
    d = F.regexp_replace(T.plain(c), "[^0-9]", "")
    return F.when(F.char_length(d).between(1, 4), d.cast("int"))


def numbered_line(c: Column) -> Column:
    """struct(number, marker, body) of a line that begins with a note number; null for any other. A stray mark before
    the number goes, digits torn apart join, a bare year is no number."""

    def read(t: Column) -> Column:
        def torn(x: Column) -> Column:
            return F.when(x["n"].isNotNull() & (x["rest"] != ""), F.struct(x["n"].alias("number"), F.concat(x["n"].cast("string"), F.lit(".")).alias("marker"), x["rest"].alias("body")))

        def plain(x: Column) -> Column:
            n = F.concat(x["a"], x["b"], x["c"]).try_cast("int")
            marker = F.when(x["a"] != "", F.concat(F.lit("["), n.cast("string"), F.lit("]"))).otherwise(F.concat(n.cast("string"), F.lit(".")))
            return F.when(n.isNotNull() & ~((x["c"] != "") & n.between(1900, 2100)), F.struct(n.alias("number"), marker.alias("marker"), F.trim(x["rest"]).alias("body")))

        split = F.struct(number_token(F.regexp_extract(t, SPLIT_NUMBER, 1)).alias("n"), F.trim(F.regexp_extract(t, SPLIT_NUMBER, 2)).alias("rest"))
        parts = F.struct(*(F.regexp_extract(t, NUMBERED, i).alias(name) for i, name in enumerate(("a", "b", "c", "rest"), 1)))
        return F.coalesce(T.let(split, torn), T.let(parts, plain))

    def cleaned(t: Column) -> Column:
        return F.when(F.regexp_like(t, F.lit(NOISE)), F.regexp_extract(t, NOISE, 1)).otherwise(t)

    # only a line with a digit near its start can begin with a number
    return F.when(F.regexp_like(T.plain(c), F.lit(r"^.{0,8}?[0-9]")), T.let(normal_line(c), lambda t: T.let(cleaned(t), read)))


def embedded_line(c: Column) -> Column:
    """struct(number, body) of a number of at most 20 inside a line, after twenty or more characters; else null."""
    t = normal_line(c)
    n, rest = number_token(F.regexp_extract(t, EMBEDDED, 1)), F.trim(F.regexp_extract(t, EMBEDDED, 2))
    # only a line with a digit behind so many characters can hold one
    return F.when(F.regexp_like(T.plain(c), F.lit("(?s)^.{21,}[0-9]")), F.when((n <= 20) & (rest != ""), F.struct(n.alias("number"), rest.alias("body"))))


def embedded_definition(c: Column, last: Column) -> Column:
    """As embedded_line(), where a last number is known: from that number to the next but one."""
    t = without_heading(T.plain(c))
    n, rest = number_token(F.regexp_extract(t, EMBEDDED, 1)), F.trim(F.regexp_extract(t, EMBEDDED, 2))
    near = F.when(last.isNull(), n <= 20).otherwise(n.between(last, last + 2))
    return F.when(near & (rest != "") & ~is_heading_of_notes(t), F.struct(n.alias("number"), rest.alias("body")))


def symbol_line(c: Column) -> Column:
    """struct(marker, body) of a line that begins with a note symbol; else null."""
    t = normal_line(c)
    return F.when(F.regexp_extract(t, SYMBOL, 1) != "", F.struct(F.regexp_extract(t, SYMBOL, 1).alias("marker"), F.trim(F.regexp_extract(t, SYMBOL, 2)).alias("body")))


def only_marker(c: Column) -> Column:
    t = normal_line(c)
    return F.when(F.regexp_like(t, F.lit(ONLY_MARKER)), number_token(F.concat(F.regexp_extract(t, ONLY_MARKER, 1), F.regexp_extract(t, ONLY_MARKER, 2))))


def lost_note(c: Column, read: Column | None = None) -> Column:
    """Whether a line looks like a note whose number was not read: noise marks, runs of capitals, or a misread ibid. read:
    its numbered_line(), where that is known."""

    def hints(x: Column) -> Column:
        noise = F.regexp_count(x["t"], F.lit(r"[\^\[\]\\|/_]")) >= 2
        return (F.char_length(x["low"]) >= 4) & (F.regexp_like(x["low"], F.lit("[iyjl]bid")) | noise | (F.regexp_count(x["t"], F.lit("[A-Z]{3,}")) >= 2))

    both = lambda t: T.let(F.struct(t.alias("t"), F.regexp_replace(F.lower(t), "[^a-z0-9]+", "").alias("low")), hints)
    return (numbered_line(c) if read is None else read).isNull() & only_marker(c).isNull() & T.let(normal_line(c), both)


def noisy_next(c: Column) -> Column:
    """The body of a line whose noise hides the next number, or empty."""
    t = without_heading(T.plain(c))
    noise, token = F.regexp_extract(t, NOISY_NEXT, 1), F.regexp_extract(t, NOISY_NEXT, 2)
    ok = (noise != "") & ((F.char_length(noise) >= 2) | F.regexp_like(token, F.lit("[0-9][A-Za-zÀ-ÖØ-öø-ÿ]"))) & numbered_line(t).isNull() & only_marker(t).isNull() & ~is_heading_of_notes(t)
    return F.when(ok, F.trim(F.regexp_extract(t, NOISY_NEXT, 3))).otherwise("")


def is_complete(c: Column) -> Column:
    return F.right(normal_line(c), F.lit(1)).isin(*CLOSERS)


def is_title_line(c: Column, read: Column | None = None) -> Column:
    """A line that can head a section of notes. read: its numbered_line(), where that is known."""

    def looks(t: Column) -> Column:
        letters = F.char_length(F.regexp_replace(t, r"\P{L}", ""))
        short = (F.char_length(t) <= 120) & ~F.regexp_like(t, F.lit(r"[.!?。！？]\s*$")) & (letters >= F.greatest(F.lit(4), F.floor(F.char_length(t) / 3)))
        return (t != "") & (F.regexp_like(F.lower(t), F.lit(TITLE_START)) | short) & ~is_heading_of_notes(t)

    return (numbered_line(c) if read is None else read).isNull() & T.let(normal_line(c), looks)


def broken_lines(c: Column) -> Column:
    """A text's lines, not empty, in normal form; a line also ends before a number that follows a sentence's end, unless a
    citation word stands before it."""
    before = "|".join(rf"(?<![0-9A-Za-zÀ-ÿ_]){w}" for w in CITATION_WORDS)
    broken = F.regexp_replace(T.plain(c), rf"(?i)(?<=[.\])»”])\s+(?=(?:[0-9][\s,.-]*){{1,4}}[.,)、\]])(?<!(?:{before})\.\s{{1,9}})", "\n")
    return F.filter(F.transform(F.split(broken, "\n", -1), normal_line), lambda x: x != "")


def classified(lines: Column) -> Column:
    """array<struct> of what each line is, for the fold over a page. Lines come in normal form."""

    def one(x: Column, read: Column) -> Column:
        return F.struct(
            x.alias("line"), read.alias("numbered"), embedded_line(x).alias("embedded"), symbol_line(x).alias("symbol"), only_marker(x).alias("only"),
            lost_note(x, read).alias("lost"), F.regexp_like(F.lower(x), F.lit(NOTES_HEADING)).alias("bare_heading"), is_heading_of_notes(x).alias("heading"), is_title_line(x, read).alias("title"),
        )

    return F.transform(lines, lambda x: T.let(numbered_line(x), lambda read: one(x, read)))


def joined_unique(texts: Column, mark: str = "\n") -> Column:
    """Distinct texts in order of their first place, without empty ones."""
    return F.array_join(F.array_distinct(F.filter(F.transform(texts, lambda x: F.trim(x)), lambda x: x != "")), mark)


def split_at_markers(c: Column) -> Column:
    """A footnote text as items, each beginning with its marker line."""
    start = r"(?:\[[0-9]{1,4}\]|[0-9]{1,4}[.)]|[*†‡§¶]{1,4}\s)"
    return F.filter(F.transform(F.split(T.plain(c), rf"\n(?=\s*{start})", -1), lambda x: F.trim(x)), lambda x: x != "")


def is_picture_list(lines: Column, before: Column) -> Column:
    """A page that is a list of pictures by its own first line, or goes on with one of the page before."""
    head = lambda a: F.regexp_like(F.lower(without_heading(F.coalesce(F.get(a, 0), F.lit("")))), F.lit(PICTURE_LIST))
    first = F.slice(lines, 1, 8)
    numbered = F.size(F.filter(first, lambda x: numbered_line(x).isNotNull()))
    hints = F.size(F.filter(first, lambda x: F.regexp_like(F.lower(x), F.lit(PICTURE_WORDS))))
    return head(lines) | (F.coalesce(head(before), F.lit(False)) & (numbered >= 2) & (hints >= 2))


def begins_with_notes(lines: Column) -> Column:
    """A notes heading among the first three lines, or two or more numbered lines at the top."""
    own = F.regexp_like(F.lower(without_heading(F.coalesce(F.get(lines, 0), F.lit("")))), F.lit(PICTURE_LIST))
    return ~own & (F.exists(F.slice(lines, 1, 3), is_heading_of_notes) | F.coalesce(numbered_line(F.get(lines, 0)).isNotNull() & numbered_line(F.get(lines, 1)).isNotNull(), F.lit(False)))


def is_figure_page(blocks: Column, markdown: Column) -> Column:
    """A page of pictures, from its blocks (label, text, heading_level) and text: no heading and no text block of twenty
    characters; then an image tag, no blocks and under fifty characters, pictures with captions only, little text, or
    over three digits in ten characters."""
    label = lambda b: F.lower(F.coalesce(b["label"], F.lit("")))
    size = lambda b: F.char_length(F.trim(T.plain(b["text"])))
    is_text = lambda b: label(b).isin(*TEXT_LABELS)
    plain = F.trim(T.without_tags(T.plain(markdown)))
    n = F.char_length(plain)
    telling = F.exists(blocks, lambda b: (is_text(b) & (size(b) >= 20)) | (F.coalesce(b["heading_level"], F.lit(0)) > 0))
    pictures = F.exists(blocks, lambda b: label(b).isin(*PICTURE_LABELS)) & ~F.exists(blocks, lambda b: is_text(b) & (size(b) > 120))
    digits = F.char_length(F.regexp_replace(plain, "[^0-9]", ""))
    rest = F.when(F.size(blocks) == 0, n < 50).otherwise(pictures | (n < 50) | (digits > 0.3 * n))
    return ~telling & (F.contains(T.plain(markdown), F.lit("<img")) | rest)


def bare_digit_context(before: Column, after: Column) -> Column:
    """Whether a bare number may be a marker: a word of four or more letters on its left that introduces no page, date
    or part, and no further number behind the marks on its right."""
    word = F.lower(F.regexp_extract(F.rtrim(before), LEFT_WORD, 1))
    return (F.char_length(word) >= 4) & ~word.isin(*NUMBER_WORDS) & ~F.regexp_like(after, F.lit(r"^[\s.,;:)\]}»”’]*[0-9]"))
