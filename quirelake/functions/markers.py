"""Note markers in text: normal forms, tests and extraction, as column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quirelake.functions.text import let

# Digits and their superscripts, symbols, certainty and priority of the ways to write a marker.
DIGITS = "0123456789"
RAISED = "⁰¹²³⁴⁵⁶⁷⁸⁹"
SYMBOLS = "*†‡§¶#"
FORMS = {  # name: (pattern with the marker as group 1, priority, certainty)
    "footnote_ref": (r"\[\^([0-9]{1,4})\]", 0, 1.0),
    "latex": (r"\$\s*\^\{([0-9]{1,4})\}\s*\$", 0, 1.0),
    "plain": (r"\^\{([0-9]{1,4})\}", 1, 0.4),
    "html": (r"(?i)<sup>\s*([0-9]{1,4})\s*</sup>", 2, 1.0),
    "unicode": (r"([⁰¹²³⁴⁵⁶⁷⁸⁹]+)", 3, 1.0),
    "bracket": (r"\[([0-9]{1,4})\]", 4, 1.0),
}


def to_brackets(c: Column) -> Column:
    """Any of $^{n}$, ^{n}, [^n] and superscript digits as [n]; ends trimmed."""
    out = F.trim(F.coalesce(c, F.lit("")))
    for pattern in (r"\$\s*\^\{([0-9]{1,6})\}\s*\$", r"\^\{([0-9]{1,6})\}", r"\[\^([0-9]{1,6})\]"):
        out = F.regexp_replace(out, pattern, "[$1]")
    return F.translate(F.regexp_replace(out, f"([{RAISED}]+)", "[$1]"), RAISED, DIGITS)


def to_carets(c: Column) -> Column:
    """Any marker as [^n]."""
    return F.regexp_replace(to_brackets(c), r"\[([0-9]{1,6})\]", r"[^$1]")


def to_superscripts(c: Column) -> Column:
    """[n] as raised digits. Only digits inside markers are raised: text and markers are taken apart and put together."""
    b = to_brackets(c)
    gaps, hits = F.split(b, r"\[[0-9]{1,6}\]", -1), F.regexp_extract_all(b, F.lit(r"\[([0-9]{1,6})\]"), F.lit(1))
    return F.concat(F.array_join(F.zip_with(F.slice(gaps, F.lit(1), F.size(hits)), hits, lambda g, h: F.concat(g, F.translate(h, DIGITS, RAISED))), ""), F.element_at(gaps, -1))


def note_list_text(c: Column) -> Column:
    """Note lines as `[n] text`."""
    line = lambda x: F.regexp_replace(F.trim(x), r"^(?:\[([0-9]{1,4})\]|([0-9]{1,4})[.)])\s*(.*)$", "[$1$2] $3")
    return F.trim(F.array_join(F.transform(F.split(to_brackets(c), "\n", -1), line), "\n"))


def normal_marker(c: Column) -> Column:
    """Symbols as they are; else digits without leading zeros, `0` for zeros; empty without a digit."""
    raw = F.trim(F.coalesce(c, F.lit("")))
    d = F.regexp_replace(F.translate(raw, RAISED, DIGITS), "[^0-9]", "")
    bare = F.regexp_replace(d, "^0+", "")
    return F.when(F.regexp_like(raw, F.lit(r"^[*†‡§¶]{1,4}$")), raw).when(d == "", "").when(bare == "", "0").otherwise(bare)


def tagged_marker(c: Column) -> Column:
    """`n:12` for numbers, `s:*` for others, empty for empty."""
    raw = F.trim(F.coalesce(c, F.lit("")))
    bare = F.regexp_replace(raw, "^0+(?=[0-9])", "")
    return F.when(raw == "", "").when(F.regexp_like(raw, F.lit("^[0-9]+$")), F.concat(F.lit("n:"), bare)).otherwise(F.concat(F.lit("s:"), F.lower(raw)))


def leading_marker(c: Column) -> Column:
    """The tagged marker that a note line starts with, or empty."""
    m = F.regexp_extract(to_brackets(c), r"^\s*(?:\[([0-9]{1,3})\]|([0-9]{1,3})[.)]|([*†‡§¶#])\s)", 0)
    return tagged_marker(F.regexp_replace(m, r"[\[\].)\s]", ""))


def inline_markers(c: Column) -> Column:
    """The distinct tagged number markers of a text, sorted."""
    return F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(to_brackets(c), F.lit(r"\[([0-9]{1,3})\]"), F.lit(1)), tagged_marker)))


def is_year(c: Column) -> Column:
    """A marker of four digits from 1500 to 2100."""
    m = normal_marker(c)
    return (F.char_length(m) == 4) & F.coalesce(m.try_cast("int").between(1500, 2100), F.lit(False))


def marker_aliases(c: Column) -> Column:
    return F.array_distinct(F.filter(F.array(F.trim(c), normal_marker(c), F.lower(F.trim(c))), lambda x: x != ""))


def digits_inside(short: Column, long: Column) -> Column:
    """Whether short's digits are an ordered, proper part of long's digits."""
    pattern = F.concat(F.lit("^[0-9]*"), F.array_join(F.transform(F.filter(F.split(short, ""), lambda d: d != ""), lambda d: F.concat(d, F.lit("[0-9]*"))), ""), F.lit("$"))
    return (short != "") & (short != long) & F.regexp_like(short, F.lit("^[0-9]+$")) & F.regexp_like(long, F.lit("^[0-9]+$")) & F.regexp_like(long, pattern)


def scanned(c: Column) -> Column:
    """array<struct<priority, form, marker, certainty>> of all markers, forms of higher priority first; a marker that a
    higher form already gave stays out, and so do years."""
    forms = sorted(FORMS.items(), key=lambda x: (x[1][1], x[0]))

    def found(text: Column, left: list) -> Column:
        (form, (pattern, priority, certainty)), *more = left
        rows = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)), _hit(priority, form, certainty))
        # overlapping text is taken once, and each form's remaining text is made once
        return F.concat(rows, let(F.regexp_replace(text, pattern, " "), lambda t: found(t, more))) if more else rows

    return F.filter(found(c, forms), lambda x: ~is_year(x["marker"]))


def _hit(priority: int, form: str, certainty: float):
    return lambda m: F.struct(F.lit(priority).alias("priority"), F.lit(form).alias("form"), normal_marker(m).alias("marker"), F.lit(certainty).alias("certainty"))


def has_marker(text: Column, marker: Column) -> Column:
    """Whether a text refers to this number in any form."""
    return F.array_contains(F.transform(scanned(text), lambda x: x["marker"]), marker)
