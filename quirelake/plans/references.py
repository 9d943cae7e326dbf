"""Queries over references, definitions and exported text."""

from __future__ import annotations

from pyspark.sql import functions as F

from quirelake.functions import references as R
from quirelake.functions import text as T
from quirelake.sources.books import anchors, contents, notes, pages, samples, sql

QUERIES, ORACLE_SQL = {}, {}


def query(name: str, tables: str, body: str):
    def keep(f):
        QUERIES[name] = f
        if body:
            ORACLE_SQL[name] = sql(tables, body)
        return f

    return keep


def quoted(pattern: str) -> str:
    return pattern.replace("'", "''")


LEGACY = "x as (select doc_id, k, s || case n % 3 when 0 then ' [EN-en-' || n || ']' when 1 then ' [FN-fn-' || n || ']' else ' [^en-' || n || ']' end as t from sm)"


@query("legacy_references", "sm", f"with {LEGACY} select doc_id, k, regexp_replace(t, '\\[EN-(en-[0-9]+)\\]|\\[FN-(fn-[0-9]+)\\]|\\[\\^(en-[0-9]+)\\]', '{{{{NOTE_REF:\\1\\2\\3}}}}', 'gi') as t from x")
def legacy_references(spark, d):
    n = F.col("n").cast("string")
    tail = F.when(F.col("n") % 3 == 0, F.concat(F.lit(" [EN-en-"), n)).when(F.col("n") % 3 == 1, F.concat(F.lit(" [FN-fn-"), n)).otherwise(F.concat(F.lit(" [^en-"), n))
    return samples(spark, d).select("doc_id", "k", R.legacy_as_tokens(F.concat("s", tail, F.lit("]"))).alias("t"))


@query("unnested_references", "sm", "select doc_id, k, '{{NOTE_REF:en-' || n || '}} {{NOTE_REF:a' || 'en-' || n || 'b}} ' || s as t from sm")
def unnested_references(spark, d):
    n = F.col("n").cast("string")
    return samples(spark, d).select("doc_id", "k", R.unnested(F.concat(F.lit("{{NOTE_REF:a{{NOTE_REF:en-"), n, F.lit("}}b}} "), F.col("s"))).alias("t"))


@query("raised_tags", "sm", "select doc_id, k, array_to_string(list_transform(regexp_extract_all(s, '[⁰¹²³⁴⁵⁶⁷⁸⁹]+|[^⁰¹²³⁴⁵⁶⁷⁸⁹]+'), lambda x: case when regexp_matches(x, '^[⁰¹²³⁴⁵⁶⁷⁸⁹]') then '<sup>' || translate(x, '⁰¹²³⁴⁵⁶⁷⁸⁹', '0123456789') || '</sup>' else x end), '') as t, len(regexp_extract_all(s, '[⁰¹²³⁴⁵⁶⁷⁸⁹]+'))::int as n from sm")
def raised_tags(spark, d):
    return samples(spark, d).select("doc_id", "k", R.raised_as_tags(F.col("s")).alias("r")).select("doc_id", "k", F.col("r.text").alias("t"), "r.n")


CLEAN = f"trim(regexp_replace(regexp_replace(trim(regexp_replace(trim(s), '{quoted(R.BODY_MARKUP)}', '', 'g')), '{quoted(R.LEADING_MARKER)}', ''), '\\s+', ' ', 'g'))"


@query("clean_notes", "sm", f"select doc_id, k, {CLEAN} as t from sm")
def clean_notes(spark, d):
    return samples(spark, d).select("doc_id", "k", R.clean_note(F.col("s")).alias("t"))


@query("chosen_definitions", "sm", f"with c as (select doc_id, n, {CLEAN} as t from sm) select doc_id, n, max_by(t, {{'m': (not regexp_matches(t, '{quoted(R.BODY_MARKUP)}'))::int, 'l': length(t), 't': t}}) as text from c where t <> '' group by all")
def chosen_definitions(spark, d):
    return R.best_definitions(samples(spark, d), ["doc_id", "n"], "s")


PARAGRAPHS = "ps as (select doc_id, unnest(regexp_split_to_array(text, '\\n\\s*\\n+')) as p from documents where text is not null), pc as (select doc_id, p, trim(regexp_replace(p, '\\s+', ' ', 'g')) as t from ps)"


@query("repeatable_paragraphs", "pg", f"with {PARAGRAPHS} select doc_id, count(*) as n, count_if(not starts_with(t, '#') and length(t) >= 80 and len(string_split(t, ' ')) >= 12 and regexp_matches(t, '{R.SENTENCE_MARKS}')) as can_repeat from pc group by doc_id")
def repeatable_paragraphs(spark, d):
    rows = pages(spark, d).where("text is not null").select("doc_id", F.explode(F.split("text", r"\n\s*\n+", -1)).alias("p"))
    return rows.groupBy("doc_id").agg(F.count("*").alias("n"), F.count_if(R.can_repeat(F.col("p"))).alias("can_repeat"))


@query("exportable_headings", "sm", r"with t as (select doc_id, k, trim(regexp_replace(s, '\s+', ' ', 'g')) as t from sm) select doc_id, k, t <> '' and len(string_split(t, ' ')) < 16 and length(t) < 110 and not regexp_matches(t, '[!;]$') and not regexp_matches(t, '[.!;]\s+[A-Za-zÀ-ÖØ-öø-ÿ]') as exportable from t")
def exportable_headings(spark, d):
    return samples(spark, d).select("doc_id", "k", R.is_exportable_heading(F.col("s")).alias("exportable"))


@query("garbled_blocks", "sm", r"with v as (select doc_id, k, n, case n % 4 when 0 then upper(s) || n when 1 then '漢字漢字' || s when 2 then translate(s, 'aeiou', '@;:<>') else s end as t from sm), w as (select *, regexp_replace(trim(t), '\s', '', 'g') as b from v) select doc_id, k, length(b) >= 12 and (regexp_matches(t, '[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]') or regexp_matches(t, '[A-Z0-9@;:<>=?]{12,}') or (10 * length(regexp_replace(b, '[^\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{F900}-\x{FAFF}]', '', 'g')) < 3 * length(b) and 100 * length(regexp_replace(b, '[^\p{Lu}\p{Nd}@;:<>=?]', '', 'g')) >= 55 * length(b))) as garbled from w")
def garbled_blocks(spark, d):
    s, r = F.col("s"), F.col("n") % 4
    t = F.when(r == 0, F.concat(T.upper_each(s), F.col("n").cast("string"))).when(r == 1, F.concat(F.lit("漢字漢字"), s)).when(r == 2, F.translate(s, "aeiou", "@;:<>")).otherwise(s)
    return samples(spark, d).select("doc_id", "k", T.let(t, R.is_garbled_block).alias("garbled"))


@query("swallowed_chapters", "ct", r"with n as (select book, chapter_no, title, lead(title) over (partition by book order by chapter_no) as next from ct) select book, chapter_no, coalesce(regexp_replace(lower(next), '[^\p{L}0-9]+', '', 'g') <> '' and chapter_no % 3 = 0, false) as swallows from n")
def swallowed_chapters(spark, d):
    """Each third chapter's text is given the next title as a heading."""
    rows = contents(spark, d).select("book", "chapter_no", "title")
    after = rows.select("book", (F.col("chapter_no") - 1).alias("chapter_no"), F.col("title").alias("next"))
    text = F.concat(F.lit("Body.\n"), F.when(F.col("chapter_no") % 3 == 0, "## ").otherwise(""), F.coalesce("next", F.lit("")), F.lit("\nmore"))
    return rows.join(after, ["book", "chapter_no"], "left").select("book", "chapter_no", F.coalesce(R.swallows_next(text, F.col("next")), F.lit(False)).alias("swallows"))


@query("marker_note_lists", "an nt", "with a as (select book, marker % 50 as m, note_page, 'en-' || marker as id from nt) select book, m::varchar as alias, array_to_string(list(id order by note_page, id), ',') as ids from a group by all")
def marker_note_lists(spark, d):
    items = notes(spark, d).select("book", (F.col("marker") % 50).cast("string").alias("marker"), "note_page", F.concat(F.lit("en-"), F.col("marker").cast("string")).alias("note_id"))
    lists = items.groupBy("book", "marker").agg(F.array_sort(F.collect_list(F.struct("note_page", "note_id"))).alias("n"))
    return lists.select("book", F.col("marker").alias("alias"), F.array_join(F.transform("n", lambda x: x["note_id"]), ",").alias("ids"))


@query("injected_references", "sm", "select doc_id, k, case when contains(s, '[' || n || ']') then replace(s[1:instr(s, '[' || n || ']') - 1], '', '') || '{{NOTE_REF:en-' || n || '}}' || s[instr(s, '[' || n || ']') + length(n::varchar) + 2:] when contains(s, '[^' || n || ']') then s[1:instr(s, '[^' || n || ']') - 1] || '{{NOTE_REF:en-' || n || '}}' || s[instr(s, '[^' || n || ']') + length(n::varchar) + 3:] else s end as t, contains(s, '[' || n || ']') or contains(s, '[^' || n || ']') as done from sm")
def injected_references(spark, d):
    n = F.col("n").cast("string")
    got = R.injected_once(F.col("s"), F.lit(""), n, F.concat(F.lit("en-"), n))
    return samples(spark, d).select("doc_id", "k", got.alias("r")).select("doc_id", "k", F.col("r.text").alias("t"), "r.done")


@query("local_labels", "", "")
def local_labels(spark, d):
    """Sample lines with all references of a document as local labels; numbers stand for endnotes."""
    rows = samples(spark, d).groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "s"))), lambda x: x["s"]), "\n").alias("text"), F.array_sort(F.collect_set(F.col("n").cast("string"))).alias("known"))
    pairs = F.transform("known", lambda x: F.struct(x.alias("key"), F.array(x).alias("value")))
    rows = rows.select("doc_id", "text", "known", F.map_from_arrays("known", F.transform("known", lambda x: F.when(x.cast("int") % 4 == 0, "footnote").otherwise("endnote"))).alias("kinds"), F.map_from_entries(pairs).alias("sequences"))
    return R.rewritten(rows, "text", "known", "kinds", "sequences").select("doc_id", "text", "ordered_ids", "footnote_ids")


@query("notes_blocks", "", "")
def notes_blocks(spark, d):
    rows = anchors(spark, d).groupBy("book", "page_no").agg(F.array_join(F.transform(F.array_sort(F.collect_list("marker")), lambda m: F.concat(F.lit("[^"), m.cast("string"), F.lit("]: note"))), "\n").alias("t"))
    return rows.select("book", "page_no", R.notes_block(F.concat(F.lit("Body\n"), F.col("t"))).alias("t"))
