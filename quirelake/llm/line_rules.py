"""Line-first cleaning with DataFrame functions only.

Every line is judged by itself: navigation bars, symbol and exclamation noise, shouting, the same few words over and
over, and boilerplate phrases, as whole words, in short lines. Failing lines are removed, and a document that loses more than half
of its words is rejected; so are documents that fail the base rules on length and repetition.

No step shuffles: all rules are array and string functions on one row. Repeated 3-word windows are found by sorting
one packed 64-bit number per window (36 bits of hash, 28 bits of place); only windows whose hash bits meet another's
are then compared as text, so the count is exact. Texts of up to 2**28 words are covered, which a 2 GB string cannot
exceed by much; a longer one fails loudly.

Defined results: a null text has no lines and no words, and fails the base rules; lines without a word are neither
counted nor judged; rows are judged by themselves, equal ones alike; an empty table gives an empty result; other
columns are kept away.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quirelake.llm.common import read

# White space of the word rule, noise symbols, boilerplate phrases.
BLANK = "[\\x20\\x09-\\x0D]+"
WORD = "[^\\x20\\x09-\\x0D]"
SYMBOLS = "#*$%&|<>"
PHRASES = "cookies?|privacy policy|terms of use|terms of service|all rights reserved|javascript|click here|sign in|log in|subscribe|lorem ipsum|read more|share this"
WHOLE = f"(^|[^a-z0-9])({PHRASES})([^a-z0-9]|$)"  # phrases count as whole words only
PLACE_BITS = 28
MIN_WORDS = 50


def let(value: Column, body) -> Column:
    """body(value) with value computed once, also where body uses it inside lambdas."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), BLANK, -1), lambda w: w != "")


def count_of(text: Column, chars: str) -> Column:
    """How many of these characters a text has."""
    return F.regexp_count(text, F.lit("[" + chars.replace("|", "\\|") + "]"))


def repeat_words(w: Column) -> Column:
    """Words inside 3-word windows that occur twice or more in the array."""
    low = F.lit((1 << PLACE_BITS) - 1).cast("long")
    high = F.lit(-(1 << PLACE_BITS)).cast("long")
    item = F.get

    def alike(a: Column, part) -> Column:
        return F.filter(a, lambda x, i: (part(x) == part(item(a, i - 1))) | F.coalesce(part(x) == part(item(a, i + 1)), F.lit(False)))

    packed = F.sort_array(F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(item(w, i), item(w, i + 1), item(w, i + 2)).bitwiseAND(high).bitwiseOR(i.cast("long"))))
    met = let(packed, lambda a: alike(a, lambda x: F.shiftright(x, PLACE_BITS)))
    line = lambda p: F.concat(item(w, p), F.lit(" "), item(w, p + 1), F.lit(" "), item(w, p + 2), F.lit("\n"), F.lpad(p.cast("string"), 9, "0"))
    named = F.sort_array(F.transform(met, lambda x: line(x.bitwiseAND(low).cast("int"))))
    same = let(named, lambda a: alike(a, lambda x: F.substring_index(x, "\n", 1)))
    at = F.sort_array(F.transform(same, lambda x: F.substring_index(x, "\n", -1).cast("int")))
    start = F.struct(F.lit(0).alias("end"), F.lit(0).alias("n"))
    total = F.aggregate(at, start, lambda acc, p: F.struct((p + 3).alias("end"), (acc["n"] + 3 - F.greatest(F.lit(0), acc["end"] - p)).alias("n")))["n"]
    return F.when(F.size(w) >= 4, total).otherwise(0)


def line_passes(line: Column) -> Column:
    """All rules on one line."""

    def judged(w: Column) -> Column:
        n = F.size(w)
        marked = F.regexp_like(line, F.lit("[|»›!#*$%&<>]"))  # few lines have any, and only they are counted
        navigation = (count_of(line, "|") >= 3) | (count_of(line, "»›") >= 2)
        punctuation = (3 * count_of(line, SYMBOLS) > n) | (3 * count_of(line, "!") > n)
        letters = F.char_length(F.regexp_replace(line, "\\P{L}", ""))
        capitals = 2 * F.char_length(F.regexp_replace(line, "\\P{Lu}", "")) > letters
        # with more than half capitals, two stand with at most one letter between them, or there is one letter only
        close = F.regexp_like(line, F.lit(r"\p{Lu}\P{L}*+(?:\p{L}\P{L}*+)?\p{Lu}|^\P{L}*+\p{Lu}\P{L}*+$"))
        shouting = (n >= 5) & close & capitals
        repeating = (n >= 10) & (4 * F.size(F.array_distinct(w)) < n)
        boilerplate = (n <= 12) & F.regexp_like(F.lower(line), F.lit(WHOLE))
        return ~((marked & (navigation | punctuation)) | shouting | repeating | boilerplate)

    return let(words(line), judged)


def cleaned(docs: DataFrame, most_lost: float = 0.5) -> DataFrame:
    """doc_id, the base counts, the cleaned text, the verdict and its parts; one row per row of docs."""
    d = docs.select(F.col("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    lines = F.filter(F.split("text", "\n", -1), lambda x: F.regexp_like(x, F.lit(WORD)))
    stats = let(lines, lambda a: F.struct((F.size(a) - F.size(F.array_distinct(a))).alias("n_dup_lines"), F.filter(a, line_passes).alias("good")))
    counts = let(words(F.col("text")), lambda w: F.struct(F.size(w).alias("n_words"), repeat_words(w).alias("n_repeat_words"), F.char_length(F.array_join(w, "")).cast("long").alias("word_chars")))
    d = d.select("doc_id", "text", stats.alias("s"), counts.alias("c"))
    clean = F.array_join("s.good", "\n")
    n, r = F.col("c.n_words").cast("long"), F.col("c.n_repeat_words").cast("long")
    d = d.select(
        "doc_id",
        n.alias("n_words"),
        F.col("c.word_chars").alias("word_chars"),
        count_of(F.col("text"), SYMBOLS).cast("long").alias("n_symbols"),
        F.col("s.n_dup_lines").cast("long").alias("n_dup_lines"),
        r.alias("n_repeat_words"),
        ((n < MIN_WORDS) | (100 * r > 50 * n)).alias("base_failed"),
        clean.alias("clean_text"),
        F.size(words(clean)).cast("long").alias("n_clean_words"),
    )
    return d.withColumn("kept", ~F.col("base_failed") & (F.col("n_clean_words") >= (1 - most_lost) * F.col("n_words")))


def op5_line_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cleaned(read(spark, sf_dir, "documents")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_clean_words")


QUERIES = {"op5_line_rules": op5_line_rules}
ORACLE_SQL = {
    "op5_line_rules": rf"""
with t as (select doc_id, coalesce(text, '') as text from documents),
w as (select *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') as w, list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) as ls from t),
g as (select *, list_filter(ls, lambda l: not (
    length(l) - length(replace(l, '|', '')) >= 3 or length(l) - length(translate(l, '»›', '')) >= 2
    or 3 * (length(l) - length(translate(l, '#*$%&|<>', ''))) > len(regexp_extract_all(l, '[^\x20\x09-\x0D]+'))
    or 3 * (length(l) - length(replace(l, '!', ''))) > len(regexp_extract_all(l, '[^\x20\x09-\x0D]+'))
    or (len(regexp_extract_all(l, '[^\x20\x09-\x0D]+')) >= 5 and 2 * length(regexp_replace(l, '[^\p{{Lu}}]', '', 'g')) > length(regexp_replace(l, '[^\p{{L}}]', '', 'g')))
    or (len(regexp_extract_all(l, '[^\x20\x09-\x0D]+')) >= 10 and 4 * len(list_distinct(regexp_extract_all(l, '[^\x20\x09-\x0D]+'))) < len(regexp_extract_all(l, '[^\x20\x09-\x0D]+')))
    or (len(regexp_extract_all(l, '[^\x20\x09-\x0D]+')) <= 12 and regexp_matches(lower(l), '{WHOLE}')))) as good from w),
tri as (select r, p, count(*) over (partition by r, k) as c from (select r, unnest(range(len(w) - 2)) as p, unnest([concat_ws(' ', w[i + 1], w[i + 2], w[i + 3]) for i in range(len(w) - 2)]) as k
  from (select row_number() over () as r, w from g) where len(w) >= 3)),
rep as (select r, count(distinct p + o) as n from tri, range(3) as x(o) where c > 1 group by r),
n as (select row_number() over () as r, * from g)
select doc_id, len(w)::bigint as n_words, length(array_to_string(w, ''))::bigint as word_chars,
  (length(text) - length(translate(text, '#*$%&|<>', '')))::bigint as n_symbols,
  (len(ls) - len(list_distinct(ls)))::bigint as n_dup_lines, coalesce(rep.n, 0)::bigint as n_repeat_words,
  (len(w) < 50 or 100 * coalesce(rep.n, 0) > 50 * len(w)) as base_failed,
  not (len(w) < 50 or 100 * coalesce(rep.n, 0) > 50 * len(w)) and 2 * len(regexp_extract_all(array_to_string(good, chr(10)), '[^\x20\x09-\x0D]+')) >= len(w) as kept,
  len(regexp_extract_all(array_to_string(good, chr(10)), '[^\x20\x09-\x0D]+'))::bigint as n_clean_words
from n left join rep using (r)"""
}
