"""Queries over page texts, bands, positions, exports' left-out pages, unfinished JSON."""

from __future__ import annotations

from pyspark.sql import functions as F

from quirelake.functions import pages as P
from quirelake.functions import text as T
from quirelake.operators.folds import ratio
from quirelake.sources.books import pages, samples, sql

QUERIES, ORACLE_SQL = {}, {}


def query(name: str, tables: str, body: str):
    def keep(f):
        QUERIES[name] = f
        if body:
            ORACLE_SQL[name] = sql(tables, body)
        return f

    return keep


@query("page_heading_lists", "pg", r"with l as (select book, page_no, list_filter(string_split('## ' || text, chr(10))[1:8], lambda x: regexp_matches(x, '^\s{0,3}#{1,6}\s*(.+?)\s*$')) as ls from pg), h as (select book, page_no, list_transform(ls, lambda x: trim(regexp_replace(regexp_extract(x, '^\s{0,3}#{1,6}\s*(.+?)\s*$', 1), '\s+', ' ', 'g'))) as hs from l), k as (select *, list_transform(hs, lambda x: regexp_replace(translate(lower(x), 'ACC0', 'ACC1'), '[^0-9a-z]+', '', 'g')) as ks from h) select book, page_no, list_filter(hs, lambda x, i: ks[i] <> '' and list_position(ks, ks[i]) = i) as headings from k".replace("ACC0", T.ACCENTS[0]).replace("ACC1", T.ACCENTS[1]))
def page_heading_lists(spark, d):
    none = F.array().cast(P.blocks_type())
    return pages(spark, d).select("book", "page_no", P.headings(none, F.concat(F.lit("## "), F.col("text"))).alias("headings"))


@query("page_body_paragraphs", "", "")
def page_body_paragraphs(spark, d):
    """Paragraphs of texts whose lines also come as blocks, each once."""
    lines = F.filter(F.split(T.plain(F.col("text")), "\n"), lambda x: x != "")
    blocks = F.transform(lines, lambda x: F.struct(F.lit("text").alias("label"), x.alias("text")))
    rows = pages(spark, d).select("book", "page_no", P.body_paragraphs(F.col("text"), blocks).alias("p"))
    return rows.select("book", "page_no", F.size("p").alias("n"), F.size(F.filter("p", lambda x: x["source"] == "block")).alias("from_blocks"))


BAND = "band as (select book, page_no, list_filter(string_split(case page_no % 4 when 0 then 'body' || chr(10) || '----' || chr(10) || '1. a' when 1 then 'body' || chr(10) || '1. a' || chr(10) || '2. b' || chr(10) || 'more' when 2 then 'body' || chr(10) || '* a' || chr(10) || 'b' else 'body' || chr(10) || 'x' end, chr(10)), lambda x: x <> '') as ls, case page_no % 4 when 0 then 2 when 1 then 1 when 2 then 1 else -1 end as start from pg)"


def bands(spark, d):
    m = F.col("page_no") % 4
    text = F.when(m == 0, "body\n----\n1. a").when(m == 1, "body\n1. a\n2. b\nmore").when(m == 2, "body\n* a\nb").otherwise("body\nx")
    return pages(spark, d).select("book", "page_no", F.split(text, "\n").alias("ls")).withColumn("band", P.note_band(F.col("ls")))


@query("page_note_bands", "pg", f'with {BAND} select book, page_no, start, case when start < 0 then -1 else len(ls) end::int as "end" from band')
def page_note_bands(spark, d):
    return bands(spark, d).select("book", "page_no", "band.start", "band.end")


@query("band_note_items", "pg", f"with {BAND} select book, page_no, case page_no % 4 when 0 then ['1'] when 1 then ['1', '2'] else ['*'] end as markers, case page_no % 4 when 0 then ['a'] when 1 then ['a', 'b more'] else ['a b'] end as texts from band where start >= 0")
def band_note_items(spark, d):
    rows = bands(spark, d).where("band.start >= 0")
    items = P.band_items(F.slice("ls", F.col("band.start") + 1, F.size("ls")))
    return rows.select("book", "page_no", items.alias("i")).select("book", "page_no", F.transform("i", lambda x: x["marker"]).alias("markers"), F.transform("i", lambda x: x["text"]).alias("texts"))


@query("confident_paragraphs", "pg", "with v as (select book, page_no, [(doc_id * 37 % 500)::double, (doc_id * 91 % 500)::double, (doc_id * 13 % 500)::double] as b, 400.0 as t from pg), c as (select book, page_no, unnest(b) as x, generate_subscripts(b, 1) - 1 as i, t from v), d as (select book, page_no, greatest(0, t - x) as dist, i from c where x <= t + 20), r as (select *, row_number() over (partition by book, page_no order by dist, -i) as rn, count(*) over (partition by book, page_no) as n, lead(dist) over (partition by book, page_no order by dist, -i) as second from d), o as (select * from r where rn = 1) select v.book, v.page_no, case when n = 1 and dist <= 240 then i when n > 1 and (dist <= 40 or (dist <= 100 and second >= dist * 1.8)) then i end::int as place from v left join o using (book, page_no)")
def confident_paragraphs(spark, d):
    n = F.col("doc_id")
    bottoms = F.array(*((n * k % 500).cast("double") for k in (37, 91, 13)))
    return pages(spark, d).select("book", "page_no", P.confident_paragraph(bottoms, F.lit(400.0)).alias("place"))


@query("block_headings", "sm", r"with b as (select doc_id, k, trim(regexp_replace(translate(regexp_replace(regexp_replace(regexp_replace(regexp_replace(trim(s), '\$\s*\^\{([0-9]{1,6})\}\s*\$', '[\1]', 'g'), '\^\{([0-9]{1,6})\}', '[\1]', 'g'), '\[\^([0-9]{1,6})\]', '[\1]', 'g'), '([⁰¹²³⁴⁵⁶⁷⁸⁹]+)', '[\1]', 'g'), '⁰¹²³⁴⁵⁶⁷⁸⁹', '0123456789'), '\s+', ' ', 'g')) as t from sm), p as (select *, regexp_replace(t, '^[0-9]+[.)]\s*', '') as p from b) select doc_id, k, length(p) between 8 and 120 and not regexp_matches(p, '[.!?]$') and length(p) - length(replace(p, ':', '')) <= 1 and length(p) - length(replace(p, ',', '')) <= 1 and not contains(p, ';') and len(string_split(p, ' ')) <= 18 and length(regexp_replace(p, '\P{L}', '', 'g')) >= 0.55 * length(p) and (regexp_matches(p, '^\p{Lu}') or regexp_matches(t, '^[0-9]')) as heading from p")
def block_headings(spark, d):
    return samples(spark, d).select("doc_id", "k", P.is_block_heading(F.col("s")).alias("heading"))


@query("page_label_spans", "pg", "select book, page_no, case when page_no % 7 = 0 then '' when page_no % 5 = 0 then page_no::varchar when (page_no + 2)::varchar = page_no::varchar then page_no::varchar else page_no || '-' || (page_no + 2) end as label from pg")
def page_label_spans(spark, d):
    n = F.col("page_no")
    first = F.when(n % 7 != 0, n.cast("string"))
    last = F.when(n % 5 != 0, (n + 2).cast("string"))
    return pages(spark, d).select("book", "page_no", P.print_label(first, last).alias("label"))


@query("following_paragraphs", "pg", r"with p as (select book, page_no, list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '') as ls from pg) select book, page_no, case when length(trim(regexp_replace(ls[1], '\s+', ' ', 'g'))) > 10 then array_to_string(ls[list_position(list_transform(ls, lambda x: contains(trim(regexp_replace(x, '\s+', ' ', 'g')), right(trim(regexp_replace(ls[1], '\s+', ' ', 'g')), 60))), true) + 1:][1:1], '') else '' end as next from p where len(ls) > 0")
def following_paragraphs(spark, d):
    rows = pages(spark, d).select("book", "page_no", F.filter(F.split("text", "\n"), lambda x: F.trim(x) != "").alias("ls")).where("size(ls) > 0")
    return rows.select("book", "page_no", F.array_join(P.next_paragraphs(F.col("ls"), F.get("ls", 0)), "").alias("next"))


KIND = lambda t: "case when " + " or ".join(f"regexp_matches({t}, '{p}')" for p in P.STRONG) + " then 'strong' when " + " or ".join(f"regexp_matches({t}, '{p}')" for p in P.WEAK) + " then 'weak' else '' end"


@query("skipped_pages", "pg", f"with v as (select book, page_no, lower(trim(regexp_replace(coalesce(case page_no % 9 when 0 then left(text, 100) || ' All rights reserved' when 1 then left(text, 60) || ' publisher' else text end, ''), '\\s+', ' ', 'g'))) as t from pg), k as (select *, {KIND('t')} as kind from v) select book, page_no, kind, length(t) > 0 and (((page_no <= 12 or length(t) <= 120) and kind = 'strong' and length(t) <= 1600) or (page_no <= 12 and length(t) <= 220 and kind <> '')) as skipped from k")
def skipped_pages(spark, d):
    m = F.col("page_no") % 9
    t = F.when(m == 0, F.concat(F.left("text", F.lit(100)), F.lit(" All rights reserved"))).when(m == 1, F.concat(F.left("text", F.lit(60)), F.lit(" publisher"))).otherwise(F.col("text"))
    return pages(spark, d).select("book", "page_no", P.boilerplate_kind(t).alias("kind"), P.is_skipped(t, F.col("page_no") <= 12).alias("skipped"))


@query("repeated_covers", "", "")
def repeated_covers(spark, d):
    """Leading pages of a book that are near copies of an earlier leading page: at most twelve pages a book are compared."""
    lead = pages(spark, d).where("page_no <= 12").select("book", "page_no", F.lower(T.squeezed(F.col("text"))).alias("t")).where("char_length(t) between 24 and 1600")
    pairs = lead.join(lead.select("book", F.col("page_no").alias("later"), F.col("t").alias("u")), "book").where("later > page_no and least(char_length(t), char_length(u)) >= 0.85 * greatest(char_length(t), char_length(u))")
    return pairs.withColumn("ratio", ratio(F.col("t"), F.col("u"))).where("ratio >= 0.92").groupBy("book", F.col("later").alias("page_no")).agg(F.min("page_no").alias("like_page"))


@query("json_previews", "sm", "select doc_id, k, replace(s, '\\', '') as preview from sm")
def json_previews(spark, d):
    """Texts as unfinished JSON give back what was written so far."""
    clean = F.regexp_replace("s", r"\\", "")
    quoted = F.regexp_replace(F.to_json(F.struct(clean.alias("translation"))), r"\}$", "")
    cut = F.when(F.col("n") % 2 == 0, F.regexp_replace(quoted, '"$', "")).otherwise(quoted)
    return samples(spark, d).select("doc_id", "k", P.json_preview(cut).alias("preview"))


@query("unix_times", "", "")
def unix_times(spark, d):
    return samples(spark, d).select("doc_id", "k", P.unix_time(F.col("n") * 86_399).alias("at"))


@query("records_as_json", "sm", "select doc_id, k, '{\"doc_id\":' || doc_id || ',\"k\":' || k || ',\"n\":' || n || '}' as j from sm")
def records_as_json(spark, d):
    return samples(spark, d).select("doc_id", "k", P.plain_json("doc_id", "k", "n").alias("j"))


@query("prose_pages", "", "")
def prose_pages(spark, d):
    return pages(spark, d).groupBy("book").agg(F.count_if(P.is_prose(F.concat(F.lit("# Heading\n"), F.col("text")))).alias("prose"), F.count("*").alias("n"))
