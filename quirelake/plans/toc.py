"""Queries over contents lists, candidates, reviews, nested records and module gates."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quirelake.functions import hooks
from quirelake.functions import text as T
from quirelake.operators import notes as N
from quirelake.operators import ordering as O
from quirelake.plans.links import IN_CHAPTER, LINKS, chapter_links, links
from quirelake.sources.books import chapters, contents, lines, notes, pages, sql, table

QUERIES, ORACLE_SQL = {}, {}


def query(name: str, tables: str, body: str):
    def keep(f):
        QUERIES[name] = f
        if body:
            ORACLE_SQL[name] = sql(tables, body) if tables else body
        return f

    return keep


TREE = "tr as (select book, page_no, (doc_id % 3)::int as depth, lower(split_part(replace(text, chr(10), ' '), ' ', 1)) as title, doc_id from pg where doc_id % 4 <> 0)"


def tree(spark, d):
    """Contents rows with depths, some of them alike."""
    p = pages(spark, d).where("doc_id % 4 <> 0")
    return p.select("book", "page_no", (F.col("doc_id") % 3).cast("int").alias("depth"), F.lower(F.split_part(F.regexp_replace("text", "\n", " "), F.lit(" "), F.lit(1))).alias("title"), "doc_id")


@query("toc_dedup", "pg", f"with {TREE} select book, title, depth, min(page_no) as page_no from tr group by all")
def toc_dedup(spark, d):
    return tree(spark, d).groupBy("book", "title", "depth").agg(F.min("page_no").alias("page_no"))


@query("toc_role_counts", "pg", f"with {TREE} select book, count_if(depth = 0) as chapters, count_if(depth = 1) as sections, count_if(depth > 1) as entries from tr group by book")
def toc_role_counts(spark, d):
    return tree(spark, d).groupBy("book").agg(F.count_if(F.col("depth") == 0).alias("chapters"), F.count_if(F.col("depth") == 1).alias("sections"), F.count_if(F.col("depth") > 1).alias("entries"))


@query("toc_chapter_level", "pg", f"with {TREE}, c as (select book, depth, count(*) as n from tr group by all) select book, coalesce(min(depth) filter (where n >= 3), min(depth)) as level from c group by book")
def toc_chapter_level(spark, d):
    """The smallest level with three rows or more, else the smallest."""
    c = tree(spark, d).groupBy("book", "depth").agg(F.count("*").alias("n"))
    return c.groupBy("book").agg(F.coalesce(F.min(F.when(F.col("n") >= 3, F.col("depth"))), F.min("depth")).alias("level"))


@query("toc_promoted_ranges", "pg", f"with {TREE}, t as (select book, page_no, depth, lead(page_no) over (partition by book, depth order by page_no) as nx from tr), p as (select * from t where depth = 0), k as (select p.book, p.page_no, count(c.page_no) as children from p left join t c on c.book = p.book and c.depth = 1 and c.page_no > p.page_no and c.page_no < coalesce(p.nx, 1000000) group by all) select book, page_no, children, children >= 3 as promoted from k")
def toc_promoted_ranges(spark, d):
    """Top rows with their children up to the next top row; the parent is found as of the child's page."""
    t = tree(spark, d)
    top = t.where("depth = 0").select("book", F.col("page_no").alias("parent"))
    kids = t.where("depth = 1").select("book", "page_no")
    owned = O.as_of(kids, top.withColumn("start", F.col("parent")), ["book"], "page_no", "start", ["parent"]).where("parent < page_no")
    n = owned.groupBy("book", "parent").agg(F.count("*").alias("n"))
    out = top.join(n, ["book", "parent"], "left").select("book", F.col("parent").alias("page_no"), F.coalesce("n", F.lit(0)).alias("children"))
    return out.withColumn("promoted", F.col("children") >= 3)


@query("toc_anomalies", "pg", f"with {TREE}, x as (select book, page_no, case when doc_id % 19 = 0 then page_no + 400 else page_no end as target from tr), y as (select *, lag(target) over w as p, lead(target) over w as q from x window w as (partition by book order by page_no)) select book, page_no, target from y where not coalesce(abs(target - p) > 200 and abs(target - q) > 200, false)")
def toc_anomalies(spark, d):
    """Rows whose target doesn't jump against both neighbours."""
    w = Window.partitionBy("book").orderBy("page_no")
    x = tree(spark, d).select("book", "page_no", F.when(F.col("doc_id") % 19 == 0, F.col("page_no") + 400).otherwise(F.col("page_no")).alias("target"))
    jump = (F.abs(F.col("target") - F.lag("target").over(w)) > 200) & (F.abs(F.col("target") - F.lead("target").over(w)) > 200)
    return x.withColumn("jump", F.coalesce(jump, F.lit(False))).where("not jump").drop("jump")


@query("toc_back_matter", "pg", f"with {TREE}, b as (select book, min(page_no) as start from tr where doc_id % 29 = 1 and page_no > 20 group by book) select tr.book, tr.page_no, coalesce(tr.page_no >= start, false) as demoted from tr left join b using (book)")
def toc_back_matter(spark, d):
    t = tree(spark, d)
    b = t.where("doc_id % 29 = 1 and page_no > 20").groupBy("book").agg(F.min("page_no").alias("start"))
    return t.join(b, "book", "left").select("book", "page_no", F.coalesce(F.col("page_no") >= F.col("start"), F.lit(False)).alias("demoted"))


@query("toc_near_variants", "pg", f"with {TREE} select a.book, a.page_no, min(b.page_no) as earlier from tr a join tr b on a.book = b.book and a.title = b.title and b.page_no < a.page_no and a.page_no - b.page_no <= 12 group by all")
def toc_near_variants(spark, d):
    """Titles that also stand up to twelve pages earlier: neighbours in page order, not pairs."""
    w = Window.partitionBy("book", "title").orderBy("page_no").rangeBetween(-12, -1)
    return tree(spark, d).select("book", "page_no", F.min("page_no").over(w).alias("earlier")).where("earlier is not null")


@query("toc_depth_map", "pg", f"with {TREE} select book, count(*) as n, sum(page_no * (depth + 1))::bigint as checksum from (select book, page_no // 2 as page_no, max_by(depth, doc_id) as depth from tr group by book, page_no // 2) group by book")
def toc_depth_map(spark, d):
    m = tree(spark, d).groupBy("book", F.floor(F.col("page_no") / 2).cast("int").alias("page_no")).agg(F.max_by("depth", "doc_id").alias("depth"))
    maps = m.groupBy("book").agg(F.map_from_entries(F.collect_list(F.struct("page_no", "depth"))).alias("m"))
    total = F.aggregate(F.map_entries("m"), F.lit(0).cast("long"), lambda a, e: a + e["key"] * (e["value"] + 1))
    return maps.select("book", F.size("m").cast("long").alias("n"), total.alias("checksum"))


@query("edge_candidates", "pg", "select book, page_no from (select *, max(page_no) over (partition by book) as z from pg) where page_no <= least(8, z) or page_no > greatest(8, z - 8)")
def edge_candidates(spark, d):
    """The first and the last eight pages of each book, without overlap."""
    p = pages(spark, d).select("book", "page_no")
    z = p.groupBy("book").agg(F.max("page_no").alias("z"))
    return p.join(z, "book").where("page_no <= least(8, z) or page_no > greatest(8, z - 8)").select("book", "page_no")


@query("neighbour_candidates", "pg", "with s as (select book, page_no from pg where doc_id % 9 = 0), e as (select distinct s.book, s.page_no + o - 1 as page_no from s, range(3) r(o)), m as (select book, max(page_no) as z from pg group by book) select e.book, e.page_no::int as page_no from e join m using (book) anti join s on s.book = e.book and s.page_no = e.page_no where e.page_no between 1 and z")
def neighbour_candidates(spark, d):
    p = pages(spark, d).select("book", "page_no", "doc_id")
    s = p.where("doc_id % 9 = 0").select("book", "page_no")
    z = p.groupBy("book").agg(F.max("page_no").alias("z"))
    e = s.select("book", F.explode(F.sequence(F.col("page_no") - 1, F.col("page_no") + 1)).alias("page_no")).distinct()
    return e.join(s, ["book", "page_no"], "left_anti").join(z, "book").where("page_no between 1 and z").select("book", "page_no")


@query("best_in_bands", "ln", "with b as (select book, page_no, k, case when k < 3 then 'top' else 'middle' end as band, length(line) as score from ln), r as (select *, row_number() over (partition by book, page_no, band order by score desc, k) as r from b) select book, page_no, band, k, score from r where r <= case when band = 'top' then 3 else 2 end")
def best_in_bands(spark, d):
    b = lines(spark, d).select("book", "page_no", "k", F.when(F.col("k") < 3, "top").otherwise("middle").alias("band"), F.char_length("line").cast("long").alias("score"))
    r = b.withColumn("r", F.row_number().over(Window.partitionBy("book", "page_no", "band").orderBy(F.desc("score"), "k"))).where("r <= 3")
    return r.where("band = 'top' or r <= 2").drop("r")


@query("candidate_runs", "pg", "with c as (select book, page_no, round(0.1::double * (doc_id % 11), 4) as score from pg where doc_id % 11 >= 4), r as (select *, sum(case when g is null or g > 2 then 1 else 0 end) over (partition by book order by page_no) as run from (select *, page_no - lag(page_no) over (partition by book order by page_no) as g from c)), t as (select book, min(page_no) as start, max(page_no) as \"end\", round(sum(score), 4) as score from r group by book, run) select * from t")
def candidate_runs(spark, d):
    w = Window.partitionBy("book").orderBy("page_no")
    c = pages(spark, d).where("doc_id % 11 >= 4").select("book", "page_no", F.round(0.1 * (F.col("doc_id") % 11), 4).alias("score"))
    c = c.withColumn("run", F.sum(F.coalesce((F.col("page_no") - F.lag("page_no").over(w) > 2).cast("int"), F.lit(1))).over(w))
    return c.groupBy("book", "run").agg(F.min("page_no").alias("start"), F.max("page_no").alias("end"), F.round(F.sum("score"), 4).alias("score")).drop("run")


@query("best_candidate_run", "pg", "")
def best_candidate_run(spark, d):
    r = candidate_runs(spark, d)
    return r.groupBy("book").agg(F.max_by("start", F.struct("score", F.col("end") - F.col("start"), -F.col("start"))).alias("start"))


ORACLE_SQL["best_candidate_run"] = ORACLE_SQL["candidate_runs"].replace("select * from t", "select book, max_by(start, (score, \"end\" - start, -start)) as start from t group by book")


@query("unresolved_clusters", "an nt ch", f"with {IN_CHAPTER} select book, chapter_no, count(*) as n, list(marker order by marker)[1:3] as first_markers, count(distinct page_no) as pages from lc where status <> 'matched' group by all")
def unresolved_clusters(spark, d):
    c = chapter_links(spark, d).where("status <> 'matched'")
    return c.groupBy("book", "chapter_no").agg(F.count("*").alias("n"), F.slice(F.array_sort(F.collect_list("marker")), 1, 3).alias("first_markers"), F.count_distinct("page_no").alias("pages"))


@query("structure_reviews", "an nt ch", f"with {LINKS}, r as (select 'orphan_note' as review_type, book || '-' || marker as id, 'major' as severity from lk where status = 'orphan_note' union select 'orphan_anchor', book || '-' || marker, 'minor' from lk where status = 'orphan_anchor' union select 'sparse_chapter', book || '-c' || chapter_no, 'blocking' from ch where chapter_no % 4 = 0) select review_type, severity, count(*) as n from r group by all")
def structure_reviews(spark, d):
    lk = links(spark, d).select("status", F.concat_ws("-", "book", F.col("marker").cast("string")).alias("id"))
    a = lk.where("status = 'orphan_note'").select(F.lit("orphan_note").alias("review_type"), "id", F.lit("major").alias("severity"))
    b = lk.where("status = 'orphan_anchor'").select(F.lit("orphan_anchor").alias("review_type"), "id", F.lit("minor").alias("severity"))
    c = chapters(spark, d).where("chapter_no % 4 = 0").select(F.lit("sparse_chapter").alias("review_type"), F.concat(F.col("book"), F.lit("-c"), F.col("chapter_no").cast("string")).alias("id"), F.lit("blocking").alias("severity"))
    return a.unionByName(b).unionByName(c).dropDuplicates(["review_type", "id"]).groupBy("review_type", "severity").agg(F.count("*").alias("n"))


@query("nested_segments", "an ch", "select ch.book, chapter_no, count(*) as n, sum(case when (page_no + marker) % 2 = 0 then 1 else 0 end)::bigint as done, max(marker) as last from an join ch on an.book = ch.book and page_no between start_page and end_page group by all")
def nested_segments(spark, d):
    """Units with nested segments; states are set inside the arrays and counted there."""
    from quirelake.sources.books import anchors

    ch = chapters(spark, d).select("book", "chapter_no", "start_page", "end_page")
    a = O.interval_join(anchors(spark, d), ch, ["book"], "page_no", "start_page", "end_page")
    u = a.groupBy("book", "chapter_no").agg(F.array_sort(F.collect_list(F.struct("marker", "page_no"))).alias("segments"))
    u = u.withColumn("segments", F.transform("segments", lambda s: s.withField("state", F.when((s["page_no"] + s["marker"]) % 2 == 0, "done").otherwise("pending"))))
    return u.select("book", "chapter_no", F.size("segments").cast("long").alias("n"), F.size(F.filter("segments", lambda s: s["state"] == "done")).cast("long").alias("done"), F.element_at("segments", -1)["marker"].alias("last"))


@query("remapped_pages", "pg", "select doc_id, page_no + case when page_no % 7 = 0 then 100 else 0 end as page_no, list_transform([page_no, page_no + 1], lambda x: x + case when x % 7 = 0 then 100 else 0 end) as pages from pg")
def remapped_pages(spark, d):
    move = lambda x: x + F.when(x % 7 == 0, 100).otherwise(0)
    return pages(spark, d).select("doc_id", move(F.col("page_no")).alias("page_no"), F.transform(F.array(F.col("page_no"), F.col("page_no") + 1), move).alias("pages"))


@query("priority_pages", "an nt", "with x as (select book, marker % 5 as g, page_no as p, 0 as o, marker from an union all select book, marker % 5, note_page, 1, marker from nt), y as (select book, g, p, min((o, marker)) as f from x group by all) select book, g::int as g, list(p order by f)[1:6] as pages from y group by book, g")
def priority_pages(spark, d):
    """Distinct pages of a cluster, those of markers before those of notes."""
    from quirelake.sources.books import anchors

    a = anchors(spark, d).select("book", (F.col("marker") % 5).alias("g"), F.col("page_no").alias("p"), F.lit(0).alias("o"), "marker")
    b = notes(spark, d).select("book", (F.col("marker") % 5).alias("g"), F.col("note_page").alias("p"), F.lit(1).alias("o"), "marker")
    y = a.unionByName(b).groupBy("book", "g", "p").agg(F.min(F.struct("o", "marker")).alias("f"))
    return y.groupBy("book", "g").agg(F.slice(F.transform(F.array_sort(F.collect_list(F.struct("f", "p"))), lambda x: x["p"]), 1, 6).alias("pages"))


@query("auto_actions", "", "with e as (select event_id, user_id, value, try_cast(json_extract_string(props, '$.k') as int) as k from events), r as (select *, row_number() over (partition by user_id order by value desc, event_id) as r from e where value >= 20) select event_id, user_id, k from r where r = 1")
def auto_actions(spark, d):
    """Actions over a confidence, the best per note."""
    e = table(spark, d, "events").where("value >= 20").select("event_id", "user_id", "value", F.get_json_object("props", "$.k").try_cast("int").alias("k"))
    return O.first_of(e, ["user_id"], [-F.col("value"), F.col("event_id")]).select("event_id", "user_id", "k")


@query("parsed_actions", "", "select event_id, case when event_id % 3 = 0 then 0 when event_id % 3 = 1 then 1 else 2 end::bigint as n, 'plain' || event_id as answer from events")
def parsed_actions(spark, d):
    e = table(spark, d, "events").select("event_id")
    one = F.concat(F.lit('note: [{"action": "match", "link": "'), F.col("event_id").cast("string"), F.lit('", "confidence": 0.9}'))
    text = F.when(F.col("event_id") % 3 == 0, "no list").when(F.col("event_id") % 3 == 1, F.concat(one, F.lit("] end"))).otherwise(F.concat(one, F.lit(', {"action": "ignore", "link": "x"}, {"action": "drop", "link": "y"}]')))
    leaked = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit('{"translation": "plain'), F.col("event_id").cast("string"), F.lit('"}'))).otherwise(F.concat(F.lit("plain"), F.col("event_id").cast("string")))
    return e.select("event_id", F.size(hooks.actions(text)).cast("long").alias("n"), hooks.unwrapped(leaked).alias("answer"))


@query("prompts", "ct", "select book, chapter_no, 'Translate.' || chr(10) || chr(10) || title as prompt, ceil(length('Translate.' || chr(10) || chr(10) || title) / 3.0)::bigint as tokens from ct")
def prompts(spark, d):
    p = hooks.prompt([F.lit("Translate."), F.lit(" "), F.col("title")])
    return contents(spark, d).select("book", "chapter_no", p.alias("prompt"), hooks.token_estimate(p).alias("tokens"))


@query("hooked_answers", "ct", "select book, chapter_no, title as answer, '' as error from ct")
def hooked_answers(spark, d):
    return hooks.called(contents(spark, d).select("book", "chapter_no", "title"), "title").select("book", "chapter_no", "answer", "error")


@query("index_pages", "pg", "with p as (select book, page_no, percent_rank() over (partition by book order by page_no) as r, len(regexp_extract_all(text, '(?m)^\\s*[A-ZÀ-ÖØ-Þ][^\\n]{1,80}\\.$')) as n from pg) select book, page_no, n from p where r >= 0.8 and n >= 2")
def index_pages(spark, d):
    p = pages(spark, d)
    z = p.groupBy("book").agg(F.count("*").alias("z"))
    n = F.regexp_count("text", F.lit(r"(?m)^\s*[A-ZÀ-ÖØ-Þ][^\n]{1,80}\.$")).cast("long")
    p = p.join(z, "book").select("book", "page_no", ((F.col("page_no") - 1) / F.greatest(F.lit(1), F.col("z") - 1)).alias("r"), n.alias("n"))
    return p.where("r >= 0.8 and n >= 2").select("book", "page_no", "n")


@query("module_gates", "an nt ch", f"""with {IN_CHAPTER}, c as (select book, count(*) as pages, max(page_no) as z from pg group by book), l as (select book, count(*) as links, count(distinct marker) as markers, count_if(status = 'orphan_anchor') as o from lk group by book), h as (select book, sum(end_page - start_page + 1) as covered from ch group by book)
select book, pages = z as pages_whole, covered = pages as chapters_cover, links = markers as links_unique, o <= 10 as orphans_few, pages = z and covered = pages and links = markers and o <= 10 as can_ship from c join l using (book) join h using (book)""")
def module_gates(spark, d):
    """Hard gates of a book's structure, and whether it may be shipped."""
    c = pages(spark, d).groupBy("book").agg(F.count("*").alias("pages"), F.max("page_no").alias("z"))
    lk = links(spark, d).groupBy("book").agg(F.count("*").alias("links"), F.count_distinct("marker").alias("markers"), F.count_if(F.col("status") == "orphan_anchor").alias("o"))
    h = chapters(spark, d).groupBy("book").agg(F.sum(F.col("end_page") - F.col("start_page") + 1).alias("covered"))
    g = c.join(lk, "book").join(h, "book").select("book", (F.col("pages") == F.col("z")).alias("pages_whole"), (F.col("covered") == F.col("pages")).alias("chapters_cover"), (F.col("links") == F.col("markers")).alias("links_unique"), (F.col("o") <= N.MOST_ORPHANS).alias("orphans_few"))
    return g.withColumn("can_ship", F.col("pages_whole") & F.col("chapters_cover") & F.col("links_unique") & F.col("orphans_few"))


@query("gate_reasons", "an nt ch", "")
def gate_reasons(spark, d):
    g = module_gates(spark, d)
    names = ("pages_whole", "chapters_cover", "links_unique", "orphans_few")
    return g.select("book", F.array_compact(F.array(*(F.when(~F.col(n), n) for n in names))).alias("reasons"), F.when(F.col("can_ship"), "ready").otherwise("blocked").alias("state"))


ORACLE_SQL["gate_reasons"] = "select book, list_filter([case when not pages_whole then 'pages_whole' end, case when not chapters_cover then 'chapters_cover' end, case when not links_unique then 'links_unique' end, case when not orphans_few then 'orphans_few' end], lambda x: x is not null) as reasons, case when can_ship then 'ready' else 'blocked' end as state from (" + ORACLE_SQL["module_gates"] + ")"


@query("titles_alike", "pg", f"with {TREE}, k as (select book, title, count(*) as n, count(distinct depth) as depths from tr group by all) select book, count(*) as titles, count_if(n > 1) as repeated, count_if(depths > 1) as mixed from k group by book")
def titles_alike(spark, d):
    k = tree(spark, d).groupBy("book", "title").agg(F.count("*").alias("n"), F.count_distinct("depth").alias("depths"))
    return k.groupBy("book").agg(F.count("*").alias("titles"), F.count_if(F.col("n") > 1).alias("repeated"), F.count_if(F.col("depths") > 1).alias("mixed"))


@query("common_titles", "pg", f"with {TREE} select title from tr where book = 'src0' intersect select title from tr where book <> 'src0'")
def common_titles(spark, d):
    t = tree(spark, d)
    return t.where("book = 'src0'").select("title").intersect(t.where("book <> 'src0'").select("title"))


@query("keys_of_titles", "ct", "select book, chapter_no, regexp_replace(translate(lower(title), 'àáâãäåçèéêëìíîïñòóôõöùúûüýÿ', 'aaaaaaceeeeiiiinooooouuuuyy'), '[^0-9a-z]+', '', 'g') as key from ct")
def keys_of_titles(spark, d):
    return contents(spark, d).select("book", "chapter_no", T.title_key(F.col("title")).alias("key"))
