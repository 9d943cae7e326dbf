"""Queries over the text and marker functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from quirelake.functions import markers as M
from quirelake.functions import text as T
from quirelake.sources.books import notes, pages, samples, sql, table

QUERIES, ORACLE_SQL = {}, {}


def query(name: str, tables: str, body: str):
    def keep(f):
        QUERIES[name] = f
        if body:
            ORACLE_SQL[name] = sql(tables, body) if tables else body
        return f

    return keep


BR = r"regexp_replace(regexp_replace(regexp_replace(trim(s), '\$\s*\^\{([0-9]{1,6})\}\s*\$', '[\1]', 'g'), '\^\{([0-9]{1,6})\}', '[\1]', 'g'), '\[\^([0-9]{1,6})\]', '[\1]', 'g')"
BRACKETS = f"translate(regexp_replace({BR}, '([⁰¹²³⁴⁵⁶⁷⁸⁹]+)', '[\\1]', 'g'), '⁰¹²³⁴⁵⁶⁷⁸⁹', '0123456789')"


@query("marker_forms", "sm", f"select doc_id, k, {BRACKETS} as brackets, regexp_replace({BRACKETS}, '\\[([0-9]{{1,6}})\\]', '[^\\1]', 'g') as carets from sm")
def marker_forms(spark, d):
    return samples(spark, d).select("doc_id", "k", M.to_brackets(F.col("s")).alias("brackets"), M.to_carets(F.col("s")).alias("carets"))


@query("marker_superscripts", "sm", f"""with b as (select doc_id, k, {BRACKETS} as b from sm)
select doc_id, k, array_to_string(list_transform(regexp_extract_all(b, '\\[[0-9]{{1,6}}\\]|[^\\[]+|\\['), lambda x: case when regexp_full_match(x, '\\[[0-9]{{1,6}}\\]') then translate(replace(replace(x, '[', ''), ']', ''), '0123456789', '⁰¹²³⁴⁵⁶⁷⁸⁹') else x end), '') as raised from b""")
def marker_superscripts(spark, d):
    return samples(spark, d).select("doc_id", "k", M.to_superscripts(F.col("s")).alias("raised"))


@query("marker_normal", "sm", """with t as (select doc_id, k, unnest(['00' || n, ' ' || n || '.', '²³', '*', '', 'n' || n, '000', (1490 + 7 * n)::varchar]) as m from sm),
u as (select *, trim(m) as r, regexp_replace(translate(trim(m), '⁰¹²³⁴⁵⁶⁷⁸⁹', '0123456789'), '[^0-9]', '', 'g') as g from t),
v as (select *, case when regexp_matches(r, '^[*†‡§¶]{1,4}$') then r when g = '' then '' when ltrim(g, '0') = '' then '0' else ltrim(g, '0') end as normal from u)
select doc_id, k, m, normal, case when r = '' then '' when regexp_full_match(r, '[0-9]+') then 'n:' || case when ltrim(r, '0') = '' then '0' else ltrim(r, '0') end else 's:' || lower(r) end as tagged,
 length(normal) = 4 and coalesce(try_cast(normal as int) between 1500 and 2100, false) as is_year,
 len(list_distinct(list_filter([r, normal, lower(r)], lambda x: x <> ''))) as n_aliases from v""")
def marker_normal(spark, d):
    n = F.col("n").cast("string")
    m = F.explode(F.array(F.concat(F.lit("00"), n), F.concat(F.lit(" "), n, F.lit(".")), F.lit("²³"), F.lit("*"), F.lit(""), F.concat(F.lit("n"), n), F.lit("000"), (1490 + 7 * F.col("n")).cast("string")))
    t = samples(spark, d).select("doc_id", "k", m.alias("m"))
    c = F.col("m")
    return t.select("doc_id", "k", "m", M.normal_marker(c).alias("normal"), M.tagged_marker(c).alias("tagged"), M.is_year(c).alias("is_year"), F.size(M.marker_aliases(c)).cast("long").alias("n_aliases"))


@query("marker_inline", "sm", f"""select doc_id, k, list_sort(list_distinct(list_transform(regexp_extract_all({BRACKETS}, '\\[([0-9]{{1,3}})\\]', 1), lambda x: 'n:' || case when ltrim(x, '0') = '' then '0' else ltrim(x, '0') end))) as markers,
 case when regexp_matches({BRACKETS}, '^\\s*(\\[[0-9]{{1,3}}\\]|[0-9]{{1,3}}[.)])') then 'n:' || (regexp_extract({BRACKETS}, '[0-9]{{1,3}}')::int)::varchar when regexp_matches({BRACKETS}, '^\\s*[*†‡§¶#]\\s') then 's:' || regexp_extract({BRACKETS}, '[*†‡§¶#]') else '' end as lead from sm""")
def marker_inline(spark, d):
    return samples(spark, d).select("doc_id", "k", M.inline_markers(F.col("s")).alias("markers"), M.leading_marker(F.col("s")).alias("lead"))


@query("marker_scan", "sm", r"""with h as (
 select doc_id, k, 0 as priority, 'footnote_ref' as form, unnest(regexp_extract_all(s, '\[\^([0-9]{1,4})\]', 1)) as m, 1.0 as certainty from sm
 union all select doc_id, k, 0, 'latex', unnest(regexp_extract_all(s, '\$\s*\^\{([0-9]{1,4})\}\s*\$', 1)), 1.0 from sm
 union all select doc_id, k, 1, 'plain', unnest(regexp_extract_all(regexp_replace(s, '\$\s*\^\{([0-9]{1,4})\}\s*\$', ' ', 'g'), '\^\{([0-9]{1,4})\}', 1)), 0.4 from sm
 union all select doc_id, k, 2, 'html', unnest(regexp_extract_all(s, '(?i)<sup>\s*([0-9]{1,4})\s*</sup>', 1)), 1.0 from sm
 union all select doc_id, k, 3, 'unicode', unnest(regexp_extract_all(s, '([⁰¹²³⁴⁵⁶⁷⁸⁹]+)', 1)), 1.0 from sm
 union all select doc_id, k, 4, 'bracket', unnest(regexp_extract_all(s, '\[([0-9]{1,4})\]', 1)), 1.0 from sm)
select doc_id, k, priority, form, (translate(m, '⁰¹²³⁴⁵⁶⁷⁸⁹', '0123456789')::bigint)::varchar as marker, certainty::double as certainty from h where not translate(m, '⁰¹²³⁴⁵⁶⁷⁸⁹', '0123456789')::bigint between 1500 and 2100""")
def marker_scan(spark, d):
    rows = samples(spark, d).select("doc_id", "k", F.explode(M.scanned(F.col("s"))).alias("h"))
    return rows.select("doc_id", "k", "h.priority", "h.form", "h.marker", "h.certainty")


@query("line_tests", "sm", r"""select doc_id, k, length(regexp_extract(s, '^(#{1,6})\s+', 1)) as level, trim(regexp_replace(s, '^#{1,6}\s+', '')) as heading,
 regexp_matches(lower(s), '^\s*(?:#+\s*)?(notes?|endnotes?|notes to pages?.*)\s*$') as notes_heading, regexp_replace(s, '<[^>]+>', '', 'g') as no_tags,
 regexp_matches(trim(s), '^\p{Ll}') as starts_low, regexp_matches(trim(s), '^[,;:)\]}.]') as continues, length(regexp_replace(s, '\P{L}', '', 'g')) as letters,
 regexp_extract(trim(s), '^([*†‡§¶]{1,4})\s+\S', 1) as symbol, regexp_extract(trim(s), '^\[?([0-9]{1,4})[.)\]]?$', 1) as only_marker,
 regexp_replace(trim(s), '(?:\s*(?:\[\^?[0-9]{1,4}\]|\$?\^\{[0-9]{1,4}\}\$?|[⁰¹²³⁴⁵⁶⁷⁸⁹]+))+$', '') as untailed,
 regexp_matches(regexp_replace(trim(s), '(?:\s*(?:\[\^?[0-9]{1,4}\]|\$?\^\{[0-9]{1,4}\}\$?|[⁰¹²³⁴⁵⁶⁷⁸⁹]+))+$', ''), '[.!?…。！？]["''”’»)\]]*$') as ends from sm""")
def line_tests(spark, d):
    c = F.col("s")
    return samples(spark, d).select("doc_id", "k", T.heading_level(c).cast("long").alias("level"), T.heading_text(c).alias("heading"), T.is_notes_heading(c).alias("notes_heading"), T.without_tags(c).alias("no_tags"), T.starts_low(c).alias("starts_low"), T.starts_with_continuation(c).alias("continues"), F.char_length(F.regexp_replace(c, r"\P{L}", "")).cast("long").alias("letters"), T.symbol_note(c).alias("symbol"), T.marker_only(c).alias("only_marker"), T.without_trailing_markers(c).alias("untailed"), T.ends_sentence(c).alias("ends"))


META_SQL = " or ".join(f"regexp_matches(t, '{p}')" for p in T.META)


@query("meta_lines", "sm", f"""with x as (select doc_id, k, unnest([s, 'https://a.b/' || n, '10.1000/' || n, n || '–' || (n + 3), 'Vol. ' || n, 'Journal of Note ' || n, 'a' || n || '@b.org', '© 20' || (10 + n % 80), ' ', 'x']) as v, generate_subscripts([1,2,3,4,5,6,7,8,9,10], 1)::int as i from sm), y as (select *, lower(trim(v)) as t from x)
select doc_id, k, i, length(t) < 2 or {META_SQL} or (length(t) < 60 and regexp_matches(t, '{T.JOURNAL}')) as meta from y""")
def meta_lines(spark, d):
    n = F.col("n").cast("string")
    values = F.array(F.col("s"), F.concat(F.lit("https://a.b/"), n), F.concat(F.lit("10.1000/"), n), F.concat(n, F.lit("–"), (F.col("n") + 3).cast("string")), F.concat(F.lit("Vol. "), n), F.concat(F.lit("Journal of Note "), n), F.concat(F.lit("a"), n, F.lit("@b.org")), F.concat(F.lit("© 20"), (10 + F.col("n") % 80).cast("string")), F.lit(" "), F.lit("x"))
    return samples(spark, d).select("doc_id", "k", F.posexplode(values).alias("i", "v")).select("doc_id", "k", (F.col("i") + 1).alias("i"), T.is_meta(F.col("v")).alias("meta"))


FAMILY_SQL = " ".join(f"when regexp_matches(t, '{p}') then '{n}'" for n, p in T.FAMILIES)


@query("title_families", "sm", f"""with x as (select doc_id, k, n, lower(trim(regexp_replace(s, '\\s+', ' ', 'g'))) as t from sm union all select doc_id, k, n, ['contents', 'list of figures', 'bibliography', 'index of names', 'appendix ' || n, 'introduction', 'foreword', 'sources', 'tables', 'references'][(n % 10) + 1] from sm)
select t, case {FAMILY_SQL} else 'body' end as family, count(*) as n from x group by 1, 2""")
def title_families(spark, d):
    s = samples(spark, d)
    made = F.element_at(F.array(F.lit("contents"), F.lit("list of figures"), F.lit("bibliography"), F.lit("index of names"), F.concat(F.lit("appendix "), F.col("n").cast("string")), F.lit("introduction"), F.lit("foreword"), F.lit("sources"), F.lit("tables"), F.lit("references")), F.col("n") % 10 + 1)
    t = s.select(F.lower(T.squeezed(F.col("s"))).alias("t")).unionByName(s.select(made.alias("t")))
    return t.groupBy("t", T.title_family(F.col("t")).alias("family")).agg(F.count("*").alias("n"))


@query("title_keys", "sm", r"""select doc_id, k, regexp_replace(translate(lower(trim(regexp_replace(s, '\s+', ' ', 'g'))), 'àáâãäåçèéêëìíîïñòóôõöùúûüýÿ', 'aaaaaaceeeeiiiinooooouuuuyy'), '[^0-9a-z]+', '', 'g') as title_key,
 regexp_replace(regexp_replace(trim(regexp_replace(lower(trim(regexp_replace(s, '\s+', ' ', 'g'))), '^\s*(?:chapter|chapitre|part|section)\b[:\s\-]*', '')), '^\s*(?:[0-9]+|[ivxlcdm]+)[.)]\s*', ''), '[^0-9a-zà-ÿ]+', '', 'g') as chapter_key,
 lower(regexp_replace(trim(regexp_replace(s, '\s+', ' ', 'g')), '\s+([?!:;,])', '\1', 'g')) as summary_key from sm""")
def title_keys(spark, d):
    c = F.col("s")
    return samples(spark, d).select("doc_id", "k", T.title_key(c).alias("title_key"), T.chapter_key(c).alias("chapter_key"), T.summary_key(c).alias("summary_key"))


@query("note_definitions", "sm", r"""with x as (select doc_id, k, trim(regexp_replace(s, '^#{1,6}\s+', '')) as t from sm),
y as (select *, regexp_extract(t, '^(?:\[([0-9]{1,4})\]|([0-9]{1,4})[.)\]])\s*(\S.*)$', ['a', 'b', 'body']) as g from x)
select doc_id, k, try_cast(case when g.a <> '' then g.a else g.b end as int)::varchar as marker, g.body as body from y where g.a || g.b <> '' and not (g.b <> '' and coalesce(try_cast(g.b as int), 0) between 1900 and 2100)""")
def note_definitions(spark, d):
    rows = samples(spark, d).select("doc_id", "k", T.note_definition(F.col("s")).alias("d"))
    return rows.where("d.marker <> ''").select("doc_id", "k", "d.marker", "d.body")


@query("paragraph_states", "pg", r"""with p as (select doc_id, text, trim(text) as t, lag(text) over (partition by book order by page_no) as b from pg)
select doc_id, length(t) >= 10 and not regexp_matches(t, '[.!?…。！？]["''”’»)\]]*$') as midway, length(t) >= 60 and not regexp_matches(t, '[.!?…。！？;:»”"'')\]]$') as no_tail,
 len(list_filter(list_transform(regexp_split_to_array(text, '\n\s*\n+'), lambda x: trim(x)), lambda x: x <> '' and not starts_with(x, '#')))::bigint as n_paragraphs,
 coalesce(length(trim(b)) >= 10 and not regexp_matches(trim(b), '[.!?…。！？]["''”’»)\]]*$') and regexp_matches(t, '^(\p{Ll}|[,;:)\]}.])'), false) as continued from p""")
def paragraph_states(spark, d):
    from pyspark.sql import Window

    c = F.col("text")
    before = F.lag("text").over(Window.partitionBy("book").orderBy("page_no"))
    return pages(spark, d).withColumn("b", before).select("doc_id", T.ends_midway(c).alias("midway"), T.lacks_tail(c).alias("no_tail"), F.size(T.paragraphs(c)).cast("long").alias("n_paragraphs"), F.coalesce(T.continues(F.col("b"), c), F.lit(False)).alias("continued"))


@query("garble_shares", "pg", r"""with p as (select doc_id, text, regexp_replace(text, '\s', '', 'g') as o from pg)
select doc_id, round(length(regexp_replace(o, '\P{L}', '', 'g')) / length(o)::double, 6) as letters, round(length(regexp_replace(o, '\P{Ll}', '', 'g')) / length(o)::double, 6) as lower, round(length(regexp_replace(o, '[^0-9]', '', 'g')) / length(o)::double, 6) as digits,
 length(text) - length(o) as spaces, round(length(regexp_replace(o, '\P{Lu}', '', 'g')) / nullif(length(regexp_replace(o, '\P{L}', '', 'g')), 0)::double, 6) as upper_share from p where length(o) > 0""")
def garble_shares(spark, d):
    g = T.garble_stats(F.col("text"))
    rows = pages(spark, d).select("doc_id", g.alias("g"), T.uppercase_share(F.col("text")).alias("u")).where("g.letters is not null")
    return rows.select("doc_id", F.round("g.letters", 6).alias("letters"), F.round("g.lower", 6).alias("lower"), F.round("g.digits", 6).alias("digits"), F.col("g.spaces").cast("long").alias("spaces"), F.round("u", 6).alias("upper_share"))


@query("encoding_shift", "", "select o_orderkey, array_to_string(list_transform(string_split(o_orderpriority, ''), lambda x: case when ord(x) between 33 and 126 and ord(x) + 3 between 33 and 126 then chr((ord(x) + 3)::int) else x end), '') as shifted from orders")
def encoding_shift(spark, d):
    return table(spark, d, "orders").select("o_orderkey", T.shifted(F.col("o_orderpriority"), 3).alias("shifted"))


@query("roman_numbers", "", "with r as (select c_custkey, ['i','iv','ix','xiv','xl','xc','cd','mcmxc','viii','mm'][c_custkey % 10 + 1] as s, [1,4,9,14,40,90,400,1990,8,2000][c_custkey % 10 + 1] as v from customer) select c_custkey, v::int as v, (ascii(substr('ABZ', (c_custkey % 3 + 1)::int, 1)) - 65)::int as col from r")
def roman_numbers(spark, d):
    words = F.array(*(F.lit(x) for x in ("i", "iv", "ix", "xiv", "xl", "xc", "cd", "mcmxc", "viii", "mm")))
    at = (F.col("c_custkey") % 10 + 1).cast("int")
    return table(spark, d, "customer").select("c_custkey", T.roman(F.element_at(words, at)).alias("v"), T.column_index(F.element_at(F.array(F.lit("A1"), F.lit("B7"), F.lit("Z2")), (F.col("c_custkey") % 3 + 1).cast("int"))).alias("col"))


@query("frozen_references", "nt", """select book, marker, 'text {{NOTE_REF:' || i || '}}' as frozen, 'text' || case when starts_with(i, 'en-') then '[EN-' else '[^' end || i || ']' as visible, 'text[^' || i || ']' as carets, case when starts_with(i, 'en-') then 'endnote' else 'footnote' end as kind
from (select book, marker, case when marker % 2 = 0 then 'en-' else 'fn-' end || book || '-' || marker as i from nt)""")
def frozen_references(spark, d):
    i = F.concat(F.when(F.col("marker") % 2 == 0, "en-").otherwise("fn-"), F.col("book"), F.lit("-"), F.col("marker").cast("string"))
    rows = notes(spark, d).withColumn("i", i).withColumn("f", F.concat(F.lit("text "), T.frozen(F.col("i"))))
    return rows.select("book", "marker", F.col("f").alias("frozen"), T.thawed(F.col("f")).alias("visible"), T.thawed(F.col("f"), True).alias("carets"), F.when(F.startswith("i", F.lit("en-")), "endnote").otherwise("footnote").alias("kind"))


@query("digit_subsequences", "", r"""select p_partkey, a, b, a <> b and regexp_matches(b, '^[0-9]*' || array_to_string(list_transform(string_split(a, ''), lambda x: x || '[0-9]*'), '') || '$') as inside from (select p_partkey, (p_partkey % 97)::varchar as a, (p_partkey * 7)::varchar as b from part)""")
def digit_subsequences(spark, d):
    rows = table(spark, d, "part").select("p_partkey", (F.col("p_partkey") % 97).cast("string").alias("a"), (F.col("p_partkey") * 7).cast("string").alias("b"))
    return rows.withColumn("inside", M.digits_inside(F.col("a"), F.col("b")))


@query("safe_file_titles", "sm", r"""select doc_id, k, substr(trim(regexp_replace(regexp_replace(s, '[\\/:*?"<>|#^\[\]]', ' ', 'g'), '\s+', ' ', 'g')), 1, 80) as title, trim(regexp_replace(lower(trim(regexp_replace(s, '\s+', ' ', 'g'))), '\[\^[0-9]+\]', '', 'g')) as paragraph_key,
 case when n = k then n::varchar else n || '-' || k end as span from sm""")
def safe_file_titles(spark, d):
    return samples(spark, d).select("doc_id", "k", T.safe_title(F.col("s")).alias("title"), T.paragraph_key(F.col("s")).alias("paragraph_key"), T.page_span(F.col("n"), F.col("k")).alias("span"))
