"""Queries over verdicts: phase judges, module gates, snapshots."""

from __future__ import annotations

from pyspark.sql import functions as F

from quirelake.operators import gates as G
from quirelake.operators import ordering as O
from quirelake.plans.links import LINKS, links
from quirelake.sources.books import chapters, pages, sql

QUERIES, ORACLE_SQL = {}, {}

#: A book's facts; odd markers stand for footnotes, even ones for endnotes.
FACTS = f"""{LINKS},
p as (select book, count(*) as n_pages, count_if(trim(text) = '') as units_without_source, count_if(doc_id % 7 = 0) as units_not_done, count_if(regexp_matches(text, '\\[[0-9]{{1,4}}\\]')) as raw_markers_left,
  count_if(contains(text, '{{{{NOTE_REF:')) as note_refs_left, count_if(doc_id % 11 = 0) as roles_out_of_place, count_if(regexp_matches(text, '!\\[[^\\]]*\\]\\([^)]*\\)\\s*$')) as image_tails from pg group by book),
c as (select book, count(*) as n_chapters, count_if(title = '') as chapters_without_heads, count_if(title <> '') as chapters_exported, count_if(end_page < start_page) as chapters_without_pages from ch group by book),
k as (select lk.*, chapter_no, marker % 2 = 1 as foot from lk join ch on lk.book = ch.book and page_no between start_page and end_page),
l as (select book, count_if(foot and status = 'orphan_anchor') as footnote_orphan_anchor, count_if(foot and status = 'orphan_note') as footnote_orphan_note, count_if(not foot and status = 'orphan_anchor') as endnote_orphan_anchor,
  count_if(not foot and status = 'orphan_note') as endnote_orphan_note, count_if(marker % 97 = 0) as ambiguous, count(note_page) as n_notes, count_if(status = 'matched') as n_matched, count_if(status = 'matched' and marker % 19 = 0) as skipped_synthetic, count(distinct chapter_no) as chapters_with_notes from k group by book),
m as (select book, count_if(a <> n and a > n) as chapters_misaligned, count_if(low <> 1) as chapters_not_from_one, count_if(high - low + 1 > a) as chapters_with_gap from (select book, chapter_no, count(*) as a, count(note_page) as n, min(marker) as low, max(marker) as high from k group by all) group by book),
facts as (select p.book, n_pages, 0 as pages_without_role, n_chapters, chapters_without_pages, chapters_without_heads = 0 as titles_aligned, n_pages % 3 > 0 as sections_aligned, chapters_without_heads, 0 as chapters_out_of_order, roles_out_of_place, 0 as toc_conflicts,
  case when footnote_orphan_anchor = 0 then 'footnote_only' else 'mixed' end as book_type, 0 as modes_inconsistent, chapters_misaligned as chapters_to_review, 1 as reviews_approved, n_chapters - chapters_with_notes as chapters_without_notes,
  0 as regions_without_kind, chapters_with_gap as regions_misaligned, 0 as regions_unbound, 0 as regions_empty, footnote_orphan_note as items_unassigned, n_notes > 0 as notes_captured, 0 as body_note_overlaps, 0 as chapters_without_policy, chapters_not_from_one as markers_not_renumbered,
  footnote_orphan_anchor, footnote_orphan_note, endnote_orphan_anchor, endnote_orphan_note, ambiguous, n_notes, n_matched, n_matched - skipped_synthetic as injected, skipped_synthetic as skipped, skipped_synthetic, 0 as unmatched_frozen, 0 as duplicate_injections,
  chapters_misaligned, 0 as chapters_mismatched, skipped_synthetic as synthetic_anchors, chapters_not_from_one, chapters_misaligned as chapters_not_all_matched, chapters_with_gap, case when units_not_done = 0 then 'ready' else 'idle' end as structure_state, 0 as blocking_reasons, chapters_misaligned as reviews_required,
  n_pages as n_units, units_without_source, units_not_done, 0 as units_not_marked, false as test_mode, units_not_done = 0 as can_ship, note_refs_left, raw_markers_left, chapters_exported, 0 as chapters_with_open_refs, image_tails, 0 as headings_inside, 0 as chapters_swallowing_next
  from p join c using (book) join l using (book) join m using (book))"""


def facts(spark, d):
    """The same facts, by sums per book."""
    n = lambda on: F.count_if(F.expr(on))
    p = pages(spark, d).groupBy("book").agg(
        F.count("*").alias("n_pages"), n("trim(text) = ''").alias("units_without_source"), n("doc_id % 7 = 0").alias("units_not_done"), F.count_if(F.regexp_like("text", F.lit(r"\[[0-9]{1,4}\]"))).alias("raw_markers_left"),
        F.count_if(F.contains("text", F.lit("{{NOTE_REF:"))).alias("note_refs_left"), n("doc_id % 11 = 0").alias("roles_out_of_place"), F.count_if(F.regexp_like("text", F.lit(r"!\[[^\]]*\]\([^)]*\)\s*$"))).alias("image_tails"),
    )
    ch = chapters(spark, d)
    c = ch.groupBy("book").agg(F.count("*").alias("n_chapters"), n("title = ''").alias("chapters_without_heads"), n("title <> ''").alias("chapters_exported"), n("end_page < start_page").alias("chapters_without_pages"))
    k = O.interval_join(links(spark, d), ch.select("book", "chapter_no", "start_page", "end_page"), ["book"], "page_no", "start_page", "end_page").withColumn("foot", F.expr("marker % 2 = 1"))
    # sums per chapter first: books and markers are combined from them
    by_chapter = k.groupBy("book", "chapter_no").agg(
        *(n(f"{'not ' * (kind == 'endnote')}foot and status = '{s}'").alias(f"{kind}_{s}") for kind in ("footnote", "endnote") for s in ("orphan_anchor", "orphan_note")),
        n("marker % 97 = 0").alias("ambiguous"), F.count("note_page").alias("n_notes"), n("status = 'matched'").alias("n_matched"), n("status = 'matched' and marker % 19 = 0").alias("skipped_synthetic"), F.count("*").alias("a"), F.min("marker").alias("low"), F.max("marker").alias("high"),
    )
    sums = ("footnote_orphan_anchor", "footnote_orphan_note", "endnote_orphan_anchor", "endnote_orphan_note", "ambiguous", "n_notes", "n_matched", "skipped_synthetic")
    m = by_chapter.groupBy("book").agg(*(F.sum(s).alias(s) for s in sums), F.count("*").alias("chapters_with_notes"), n("a > n_notes").alias("chapters_misaligned"), n("low <> 1").alias("chapters_not_from_one"), n("high - low + 1 > a").alias("chapters_with_gap"))
    return p.join(c, "book").join(m, "book").selectExpr(
        "*", "0 as pages_without_role", "chapters_without_heads = 0 as titles_aligned", "n_pages % 3 > 0 as sections_aligned", "0 as chapters_out_of_order", "0 as toc_conflicts", "case when footnote_orphan_anchor = 0 then 'footnote_only' else 'mixed' end as book_type",
        "0 as modes_inconsistent", "chapters_misaligned as chapters_to_review", "1 as reviews_approved", "n_chapters - chapters_with_notes as chapters_without_notes", "0 as regions_without_kind", "chapters_with_gap as regions_misaligned", "0 as regions_unbound", "0 as regions_empty",
        "footnote_orphan_note as items_unassigned", "n_notes > 0 as notes_captured", "0 as body_note_overlaps", "0 as chapters_without_policy", "chapters_not_from_one as markers_not_renumbered", "n_matched - skipped_synthetic as injected", "skipped_synthetic as skipped", "0 as unmatched_frozen",
        "0 as duplicate_injections", "0 as chapters_mismatched", "skipped_synthetic as synthetic_anchors", "chapters_misaligned as chapters_not_all_matched", "case when units_not_done = 0 then 'ready' else 'idle' end as structure_state", "0 as blocking_reasons", "chapters_misaligned as reviews_required",
        "n_pages as n_units", "0 as units_not_marked", "false as test_mode", "units_not_done = 0 as can_ship", "0 as chapters_with_open_refs", "0 as headings_inside", "0 as chapters_swallowing_next",
    )


def query(name: str, body: str):
    def keep(f):
        QUERIES[name] = f
        ORACLE_SQL[name] = sql("an nt ch", f"with {FACTS}{body}")
        return f

    return keep


_RULES = ", ".join(f"{{'phase': {p}, 'code': '{c}', 'severity': '{s}', 'there': {on}}}" for p, c, s, on in G.PHASES)
_GATES = ", ".join(f"{{'module': {m}, 'gate': '{g}', 'kind': '{k}', 'holds': {on}, 'why': '{why}'}}" for m, g, k, why, on in G.MODULES)
_CODES = "list_transform(list_filter(r, lambda x: x.there and x.phase <= phase and x.severity = '{0}'), lambda x: x.code)"
_HARD = f", g as (select book, unnest([{_GATES}]) as g from facts), h as (select book, g.module as module, g.gate as gate, g.kind as kind, g.holds as holds, case when not g.holds and g.kind = 'hard' then g.why end as reason from g)"


@query("phase_judges", f", r as (select book, [{_RULES}] as r from facts) select book, phase, len({_CODES.format('failure')}) = 0 as passes, {_CODES.format('failure')} as failures, {_CODES.format('warning')} as warnings from r, (select unnest([1, 2, 3, 4, 5, 6]) as phase)")
def phase_judges(spark, d):
    return G.judged(facts(spark, d), ["book"])


@query("named_gates", f"{_HARD} select * from h")
def named_gates(spark, d):
    return G.module_gates(facts(spark, d), ["book"])


@query("book_snapshots", f"{_HARD} select book, min(module) filter (not holds) as stops_at, coalesce(list(reason order by module, gate) filter (not holds), []) as reasons, count_if(not holds) = 0 as ready from h where kind = 'hard' group by book")
def book_snapshots(spark, d):
    return G.snapshot(facts(spark, d), ["book"])
