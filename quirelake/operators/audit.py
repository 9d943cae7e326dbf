"""The audit of exported chapter files: one projection per file, no join but the next chapter's title."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quirelake.functions import references as R
from quirelake.functions import text as T

# Issue codes with their severity; patterns of leaks.
SEVERITY = {
    "wrong_title": "blocking", "semantic_role_mismatch": "blocking", "manual_toc_mismatch": "blocking", "mid_sentence_opening": "major", "front_matter_leak": "blocking", "back_matter_leak": "major", "toc_residue": "blocking",
    "raw_note_marker_leak": "blocking", "legacy_note_token_leak": "blocking", "missing_note_definition": "blocking", "orphan_note_definition": "blocking", "local_note_contract_broken": "blocking",
    "mid_paragraph_heading": "major", "duplicated_heading": "major", "duplicate_paragraph": "major", "chapter_boundary_swallow_next": "blocking", "chapter_boundary_missing_tail": "major",
}
RANK = {"blocking": 3, "major": 2, "minor": 1}
FRONT = r"(?i)\b(copyright|all rights reserved|printed in|library of congress|isbn|published by|code de la propriété intellectuelle)\b"
BACK = r"(?i)\b(bibliograph(y|ie)|index( des?| historique)?|glossary|works cited|references?)\b"
TOC_LINE = r"(?im)^\s*.+\.{3,}\s*[0-9]+\s*$"
TOC_HEADING = r"(?im)^\s*(table of contents|contents|table des mati[eè]res|sommaire|目录)\b"
LEGACY = r"(?i)\[FN-[^\]]+\]|\[\^en-[^\]]+\]|\[EN-[^\]]+\]|\{\{(NOTE_REF|FN_REF|EN_REF):[^}]+\}\}"
RAW_MARKS = r"(?i)\$\s*\^\{\s*\[?[0-9]{1,4}[A-Za-z]?\]?\s*\}\s*\$|<sup>\s*\[?[0-9]{1,4}[A-Za-z]?\]?\s*</sup>|[⁰¹²³⁴⁵⁶⁷⁸⁹]+"
LOCAL_DEF = r"(?m)^\s*\[\^([0-9]+)\]:"
PREVIEW = 280


def _key(c: Column) -> Column:
    return F.regexp_replace(F.lower(T.plain(c)), r"[^\p{L}0-9]+", "")


def split_definitions(content: Column) -> tuple[Column, Column]:
    """(lines of the body, lines of definitions and of what goes on with them)."""
    lines = F.split(T.plain(content), "\n", -1)
    is_def = lambda x: F.regexp_like(x, F.lit(r"^\s*\[\^[^\]]+\]:"))
    first = F.array_min(F.filter(F.transform(lines, lambda x, i: F.when(is_def(x), i)), lambda i: i.isNotNull()))
    return F.when(first.isNull(), lines).otherwise(F.slice(lines, F.lit(1), F.coalesce(first, F.lit(0)))), F.when(first.isNull(), F.array().cast("array<string>")).otherwise(F.slice(lines, F.coalesce(first, F.lit(0)) + 1, F.size(lines)))


def repeats(a: Column) -> Column:
    return F.size(a) - F.size(F.array_distinct(a))


def issues(files: DataFrame) -> DataFrame:
    """files (path, content, role, expected_title, next_title, in_contents, markers: array or null) with codes, severity, counts of
    references and definitions, and samples. Files of the role index_file have no issues."""
    body_lines, def_lines = split_definitions(F.col("content"))
    df = files.withColumns({"_body": F.array_join(body_lines, "\n"), "_defs": F.array_join(def_lines, "\n"), "_lines": body_lines})
    df = df.withColumns({"_p": T.paragraphs(F.col("_body")), "_refs": F.array_distinct(F.regexp_extract_all("_body", F.lit(r"\[\^([0-9]+)\]"), F.lit(1))), "_known": F.array_distinct(F.regexp_extract_all(T.plain(F.col("content")), F.lit(LOCAL_DEF), F.lit(1)))})
    title = F.regexp_extract(T.plain(F.col("content")), r"(?m)^\s{0,3}#{1,6}\s*(.+?)\s*$", 1)
    first, last = F.coalesce(F.get("_p", 0), F.lit("")), F.coalesce(F.try_element_at(F.col("_p"), F.lit(-1)), F.lit(""))
    opening = F.array_join(F.slice("_p", 1, 2), "\n")
    chapter, expected = F.col("role") == "chapter", T.plain(F.col("expected_title"))
    bracket = F.when(F.col("markers").isNull(), F.size(R.raw_marker_hits(F.col("_body")))).otherwise(F.size(R.raw_marker_hits(F.col("_body"), F.col("markers"))))
    def_leak = F.regexp_like("_defs", F.lit(r"(?m)^\s*\[\^[^\]]+\]:\s*(\[[0-9]{1,4}[A-Za-z]?\]|<sup>\s*[0-9]{1,4}[A-Za-z]?\s*</sup>|[⁰¹²³⁴⁵⁶⁷⁸⁹]+)\s+"))
    missing, orphan = F.array_except("_refs", "_known"), F.array_except("_known", "_refs")
    sections = F.transform(F.filter("_lines", lambda x: F.regexp_like(x, F.lit(r"^###\s+\S"))), lambda x: F.lower(T.squeezed(F.regexp_replace(x, r"^###\s+", ""))))
    inside = F.exists(F.transform("_lines", lambda x, i: F.startswith(F.trim(x), F.lit("### ")) & (i > 0) & (F.trim(F.coalesce(F.get("_lines", i - 1), F.lit(""))) != "") & ~F.startswith(F.trim(F.coalesce(F.get("_lines", i - 1), F.lit(""))), F.lit("#"))), lambda x: x)
    keys = F.filter(F.transform("_p", lambda x: T.paragraph_key(x)), lambda x: F.char_length(x) >= 60)
    short = F.size(F.filter(F.split(opening, "\n"), lambda x: (F.trim(x) != "") & (F.char_length(x) > 80))) == 0
    front_lines = F.size(F.filter(F.split(opening, "\n"), lambda x: F.regexp_like(x, F.lit(FRONT))))
    tests = {
        "wrong_title": (expected != "") & (_key(title) != _key(expected)),
        "semantic_role_mismatch": F.col("role").isin("container", "back_matter"),
        "manual_toc_mismatch": (_key(expected) != "") & ~F.coalesce(F.col("in_contents"), F.lit(True)),
        "mid_sentence_opening": T.starts_low(first) | T.starts_with_continuation(first),
        "front_matter_leak": chapter & ((front_lines >= 2) | ((front_lines == 1) & short)),
        "back_matter_leak": chapter & F.regexp_like(opening, F.lit(BACK)),
        "toc_residue": F.regexp_like(T.plain(F.col("content")), F.lit(TOC_HEADING)) | F.regexp_like(T.plain(F.col("content")), F.lit(TOC_LINE)),
        "raw_note_marker_leak": (bracket > 0) | F.regexp_like("_body", F.lit(RAW_MARKS)) | def_leak,
        "legacy_note_token_leak": F.regexp_like(T.plain(F.col("content")), F.lit(LEGACY)),
        "missing_note_definition": F.size(missing) > 0,
        "orphan_note_definition": F.size(orphan) > 0,
        "local_note_contract_broken": F.size(missing) + F.size(orphan) > 0,
        "mid_paragraph_heading": inside,
        "duplicated_heading": repeats(sections) > 0,
        "duplicate_paragraph": repeats(keys) > 0,
        "chapter_boundary_swallow_next": F.coalesce(R.swallows_next(F.col("content"), F.col("next_title")), F.lit(False)),
        "chapter_boundary_missing_tail": T.lacks_tail(last),
    }
    codes = F.when(F.col("role") == "index_file", F.array().cast("array<string>")).otherwise(F.array_compact(F.array(*(F.when(F.coalesce(t, F.lit(False)), c) for c, t in tests.items()))))
    rank = F.create_map(*(F.lit(x) for c, s in SEVERITY.items() for x in (c, RANK[s])))
    out = df.withColumn("issue_codes", codes).withColumn("_r", F.array_max(F.transform("issue_codes", lambda c: rank[c])))
    sample = lambda i: F.left(F.coalesce(F.get("_p", i), F.lit("")), F.lit(PREVIEW))
    return out.select(
        *files.columns, "issue_codes", F.when(F.col("_r") == 3, "blocking").when(F.col("_r") == 2, "major").otherwise("minor").alias("severity"), F.size("_refs").alias("n_refs"), F.size("_known").alias("n_definitions"),
        F.slice(F.array_sort(missing), 1, 8).alias("missing_definitions"), F.slice(F.array_sort(orphan), 1, 8).alias("orphan_definitions"), F.size(F.regexp_extract_all(T.plain(F.col("content")), F.lit(LEGACY), F.lit(0))).alias("legacy_tokens"),
        sample(F.lit(0)).alias("opening"), sample(F.floor(F.size("_p") / 2).cast("int")).alias("middle"), sample(F.size("_p") - 1).alias("tail"),
    )


def with_next_titles(files: DataFrame, key: list[str], order: str) -> DataFrame:
    """The next chapter's title of each file; a window over one book's files."""
    return files.withColumn("next_title", F.lead("expected_title").over(Window.partitionBy(*key).orderBy(order)))


def report(audited: DataFrame, key: list[str]) -> DataFrame:
    """Per book: files, files with issues, counts of severities, the codes found, whether it can ship (no blocking issue)."""
    n = lambda s: F.count_if((F.size("issue_codes") > 0) & (F.col("severity") == s)).alias(s)
    codes = F.array_sort(F.array_distinct(F.flatten(F.collect_set("issue_codes"))))
    out = audited.groupBy(*key).agg(F.count("*").alias("files"), F.count_if(F.size("issue_codes") > 0).alias("with_issues"), n("blocking"), n("major"), n("minor"), codes.alias("codes"))
    return out.withColumn("can_ship", F.col("blocking") == 0)
