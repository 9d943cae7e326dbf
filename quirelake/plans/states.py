"""Queries over runs, segments, usage and event logs."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from quirelake.operators import ordering as O
from quirelake.operators import states as S
from quirelake.sources.books import contents, sql, table
from quirelake.streaming import runs

QUERIES, ORACLE_SQL = {}, {}


def query(name: str, tables: str, body: str):
    def keep(f):
        QUERIES[name] = f
        if body:
            ORACLE_SQL[name] = sql(tables, body) if tables else body
        return f

    return keep


def units(spark, d):
    state = F.when(F.col("o_orderstatus") == "F", "done").when(F.col("o_orderstatus") == "P", "error").otherwise("pending")
    return table(spark, d, "orders").select(F.col("o_custkey").alias("run"), F.col("o_orderkey").alias("unit"), state.alias("state"), "o_orderpriority", "o_orderdate")


@query("unit_progress", "", "select o_custkey as run, count(*) as total, count_if(o_orderstatus = 'F') as done, count_if(o_orderstatus = 'P') as error, count_if(o_orderstatus not in ('F', 'P')) as pending, min(o_orderkey) filter (where o_orderstatus <> 'F') as next_unit from orders group by o_custkey")
def unit_progress(spark, d):
    return S.progress(units(spark, d), ["run"])


@query("latest_run", "", "select o_custkey, max_by(o_orderkey, (o_orderdate, o_orderkey)) as o_orderkey, max(o_orderdate) as at from orders group by o_custkey")
def latest_run(spark, d):
    o = table(spark, d, "orders").select("o_custkey", "o_orderkey", F.col("o_orderdate").alias("at"))
    return O.latest(o, ["o_custkey"], ["at", "o_orderkey"])


@query("effective_run", "", "select o_custkey, coalesce(max_by(o_orderkey, (o_orderdate, o_orderkey)) filter (where o_orderstatus = 'P'), max_by(o_orderkey, (o_orderdate, o_orderkey))) as run from orders group by o_custkey")
def effective_run(spark, d):
    o = table(spark, d, "orders")
    at = F.struct("o_orderdate", "o_orderkey")
    running = F.col("o_orderstatus") == "P"
    return o.groupBy("o_custkey").agg(F.coalesce(F.max_by(F.when(running, F.col("o_orderkey")), F.when(running, at)), F.max_by("o_orderkey", at)).alias("run"))


@query("resume_points", "", "with t as (select distinct l_orderkey as run, l_linenumber as n from lineitem), f as (select distinct l_orderkey as run, l_linenumber as n from lineitem where l_linestatus = 'F') select run, min(n) as resume_at, count(*) as remaining from t anti join f using (run, n) group by run")
def resume_points(spark, d):
    li = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("run"), "l_linenumber", "l_linestatus")
    return S.resume_points(li.select("run", "l_linenumber").distinct(), li.where("l_linestatus = 'F'").distinct(), ["run"], "l_linenumber")


@query("retry_summary", "", "select l_orderkey as run, count_if(l_returnflag = 'R') as failed, count_if(l_returnflag = 'A') as manual, min(l_linenumber) filter (where l_returnflag = 'R') as next_failed, case when count_if(l_returnflag = 'A') > 0 then 'manual_required' when count_if(l_returnflag = 'R') > 0 then 'partial_failed' when count_if(l_linestatus = 'F') >= count(*) then 'done' else 'running' end as state from lineitem group by l_orderkey")
def retry_summary(spark, d):
    li = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("run")).agg(F.count_if(F.col("l_returnflag") == "R").alias("failed"), F.count_if(F.col("l_returnflag") == "A").alias("manual"), F.min(F.when(F.col("l_returnflag") == "R", F.col("l_linenumber"))).alias("next_failed"), F.count_if(F.col("l_linestatus") == "F").alias("d"), F.count("*").alias("t"))
    return li.select("run", "failed", "manual", "next_failed", S.state_label(F.col("failed"), F.col("manual"), F.col("d"), F.col("t")).alias("state"))


@query("segment_pairs", "", "select a.conv_id, a.turn, a.text as source, b.text as translation from conversations a join conversations b on a.conv_id = b.conv_id and b.turn = a.turn + 1 where a.role = 'user' and b.role = 'assistant'")
def segment_pairs(spark, d):
    c = table(spark, d, "conversations").select("conv_id", "turn", "role", "text")
    a = c.where("role = 'user'").select("conv_id", "turn", F.col("text").alias("source"))
    b = c.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("translation"))
    return a.join(b, ["conv_id", "turn"])


@query("segment_current", "", "with l as (select conv_id, role, turn, length(text) as n from conversations union all select conv_id, role, turn + 100, length(text) * 2 from conversations where turn % 3 = 0) select conv_id, role, max(turn) as turn, max_by(n, turn) as n from l group by all")
def segment_current(spark, d):
    """The newest revision per (conversation, role) of an append-only log."""
    c = table(spark, d, "conversations").select("conv_id", "role", "turn", F.char_length("text").cast("long").alias("n"))
    log = c.unionByName(c.where("turn % 3 = 0").select("conv_id", "role", (F.col("turn") + 100).alias("turn"), (F.col("n") * 2).alias("n")))
    return S.current(log, ["conv_id", "role"], ["turn", "n"])


@query("recent_revisions", "", "select conv_id, turn, text from conversations order by turn desc, conv_id desc limit 50")
def recent_revisions(spark, d):
    """The fifty newest revisions: a report with a fixed length."""
    return table(spark, d, "conversations").select("conv_id", "turn", "text").orderBy(F.desc("turn"), F.desc("conv_id")).limit(50)


@query("document_upsert", "", "with n as (select doc_id, case when quality = 1 then 'good' end as lang, null::varchar as source from labels union all select 10000000 + item_id, 'xx', 'bench' from benchmark) select coalesce(n.doc_id, d.doc_id) as doc_id, coalesce(n.lang, d.lang) as lang, coalesce(n.source, d.source) as source from documents d full join n on d.doc_id = n.doc_id")
def document_upsert(spark, d):
    old = table(spark, d, "documents").select("doc_id", "lang", "source")
    a = table(spark, d, "labels").select("doc_id", F.when(F.col("quality") == 1, "good").alias("lang"), F.lit(None).cast("string").alias("source"))
    b = table(spark, d, "benchmark").select((F.col("item_id") + 10_000_000).alias("doc_id"), F.lit("xx").alias("lang"), F.lit("bench").alias("source"))
    return O.upserted(old, a.unionByName(b), ["doc_id"])


@query("override_upsert", "", "with l as (select doc_id % 50 as target, quality, toxic, doc_id as updated_at from labels) select target, max_by(quality, updated_at) as quality, max_by(toxic, updated_at) as toxic, max(updated_at) as updated_at from l group by target")
def override_upsert(spark, d):
    rows = table(spark, d, "labels").select((F.col("doc_id") % 50).alias("target"), "quality", "toxic", F.col("doc_id").alias("updated_at"))
    return O.latest(rows, ["target"], ["updated_at"])


@query("glossary_issues", "ct", """with g as (select distinct lower(t) as t from (select unnest(string_split(title, ' ')) as t from ct) where length(t) > 9),
s as (select a.conv_id, a.turn, a.text as source, b.text as target from conversations a join conversations b on a.conv_id = b.conv_id and b.turn = a.turn + 1 where a.role = 'user' and b.role = 'assistant'),
m as (select conv_id, turn, count(t) as matched, coalesce(count_if(not contains(target, upper(t))), 0) as missing from s left join g on contains(lower(source), t) group by all) select conv_id, turn, matched, missing, missing > 0 as has_issue from m""")
def glossary_issues(spark, d):
    g = contents(spark, d).select(F.explode(F.split(F.lower("title"), " ")).alias("term")).where(F.char_length("term") > 9).distinct().withColumn("target", F.upper("term"))
    s = S.glossary_check(segment_pairs(spark, d), g, "source", "translation")
    return s.select("conv_id", "turn", F.size("matched").cast("long").alias("matched"), F.size("missing").cast("long").alias("missing"), "has_issue")


@query("usage_summary", "", "")
def usage_summary(spark, d):
    stage = F.element_at(F.array(*(F.lit(s) for s in S.STAGES)), (F.col("l_linenumber") % 4 + 1).cast("int"))
    e = table(spark, d, "lineitem").select(stage.alias("stage"), F.col("l_returnflag").alias("model"), F.col("l_partkey").alias("prompt"), F.col("l_suppkey").alias("completion"))
    return S.usage(e, "stage", "model", ["prompt", "completion"])


ORACLE_SQL["usage_summary"] = """with e as (select ['layout', 'contents', 'repair', 'translation'][l_linenumber % 4 + 1] as stage, l_returnflag as model, l_partkey as prompt, l_suppkey as completion from lineitem)
select stage, model, grouping(stage, model)::bigint as level, count(*) as requests, sum(prompt)::bigint as prompt, sum(completion)::bigint as completion from e group by grouping sets ((stage), (model), ())"""


@query("usage_rollup", "", "select l_returnflag, l_linestatus, count(*) as n, round(sum(l_quantity), 2) as quantity from lineitem group by rollup (l_returnflag, l_linestatus)")
def usage_rollup(spark, d):
    return table(spark, d, "lineitem").rollup("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("quantity"))


@query("status_cube", "", "select o_orderstatus, o_orderpriority, count(*) as n from orders group by cube (o_orderstatus, o_orderpriority)")
def status_cube(spark, d):
    return table(spark, d, "orders").cube("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"))


@query("review_counts", "", "with t as (select unnest(['toxic', 'low_quality', 'clean', 'never']) as review_type), r as (select case when toxic = 1 then 'toxic' when quality = 0 then 'low_quality' else 'clean' end as review_type, count(*) as n from labels group by 1) select review_type, coalesce(n, 0) as n from t left join r using (review_type)")
def review_counts(spark, d):
    kinds = spark.createDataFrame([(x,) for x in ("toxic", "low_quality", "clean", "never")], "review_type string")
    kind = F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 0, "low_quality").otherwise("clean")
    r = table(spark, d, "labels").groupBy(kind.alias("review_type")).agg(F.count("*").alias("n"))
    return kinds.join(r, "review_type", "left").select("review_type", F.coalesce("n", F.lit(0)).alias("n"))


@query("ordered_units", "", "select o_orderkey, row_number() over (order by case o_orderstatus when 'O' then 0 when 'F' then 1 else 2 end, o_custkey, o_orderkey) as place from orders")
def ordered_units(spark, d):
    """A global order by status, run and unit: ranked inside ranges, so that no task holds the table."""
    rank = F.when(F.col("o_orderstatus") == "O", 0).when(F.col("o_orderstatus") == "F", 1).otherwise(2)
    o = table(spark, d, "orders").select("o_orderkey", rank.alias("r"), "o_custkey")
    sums = o.groupBy("r", "o_custkey").agg(F.count("*").alias("n"))
    by_rank = sums.groupBy("r").agg(F.sum("n").alias("rn"))
    before_rank = by_rank.select("r", F.coalesce(F.sum("rn").over(Window.orderBy("r").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("b0"))  # three rows
    blocks = sums.withColumn("blk", F.floor(F.col("o_custkey") / 512))
    by_block = blocks.groupBy("r", "blk").agg(F.sum("n").alias("bn")).withColumn("b1", F.coalesce(F.sum("bn").over(Window.partitionBy("r").orderBy("blk").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("bn")
    inner = blocks.withColumn("b2", F.coalesce(F.sum("n").over(Window.partitionBy("r", "blk").orderBy("o_custkey").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    at = inner.join(by_block, ["r", "blk"]).join(before_rank, "r").select("r", "o_custkey", (F.col("b0") + F.col("b1") + F.col("b2")).alias("b"))
    own = o.withColumn("i", F.row_number().over(Window.partitionBy("r", "o_custkey").orderBy("o_orderkey")))
    return own.join(at, ["r", "o_custkey"]).select("o_orderkey", (F.col("i") + F.col("b")).alias("place"))


@query("numeric_first_order", "", "select p_partkey, dense_rank() over (order by try_cast(nullif(regexp_replace(p_brand, '[^0-9]', '', 'g'), '') as int), p_brand) as place from part")
def numeric_first_order(spark, d):
    p = table(spark, d, "part").select("p_partkey", "p_brand")
    brands = p.select("p_brand").distinct().withColumn("number", F.regexp_replace("p_brand", "[^0-9]", "").try_cast("int"))
    ranks = brands.withColumn("place", F.dense_rank().over(Window.orderBy("number", "p_brand")))  # one row a brand
    return p.join(ranks, "p_brand").select("p_partkey", F.col("place").cast("long").alias("place"))


@query("json_fields", "", "select event_id, try_cast(json_extract_string(props, '$.k') as int) as k, json_extract_string(props, '$.missing') is null as missing from events")
def json_fields(spark, d):
    j = F.from_json("props", "k string, missing string")
    return table(spark, d, "events").select("event_id", j.alias("j")).select("event_id", F.col("j.k").try_cast("int").alias("k"), F.col("j.missing").isNull().alias("missing"))


@query("cursor_events", "", "select event_type, count(*) as n, max(event_id) as cursor from events where event_id > 500 group by event_type")
def cursor_events(spark, d):
    return runs.after(table(spark, d, "events"), 500).groupBy("event_type").agg(F.count("*").alias("n"), F.max("event_id").alias("cursor"))


def _log(spark, d):
    return table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))


@query("daily_events", "", "select date_trunc('day', ts)::date as day, event_type, count(*) as n, round(sum(value), 4) as total from events group by all")
def daily_events(spark, d):
    return runs.windowed(_log(spark, d), "1 day").select(F.to_date("w.start").alias("day"), "event_type", "n", "total")


@query("sliding_events", "", "select (date_trunc('hour', ts) - to_hours(o))::timestamp as start, event_type, count(*) as n from events, range(3) r(o) group by all")
def sliding_events(spark, d):
    return runs.windowed(_log(spark, d), "3 hours", "1 hour").select(F.col("w.start").cast("timestamp_ntz").alias("start"), "event_type", "n")


@query("user_sessions", "", "with g as (select user_id, ts, case when ts - lag(ts) over (partition by user_id order by ts) < interval 6 hours then 0 else 1 end as b from events), s as (select *, sum(b) over (partition by user_id order by ts rows unbounded preceding) as r from g) select user_id, min(ts) as start, max(ts) + interval 6 hours as \"end\", count(*) as n from s group by user_id, r")
def user_sessions(spark, d):
    s = runs.sessions(_log(spark, d), "6 hours")
    return s.select("user_id", F.col("w.start").cast("timestamp_ntz").alias("start"), F.col("w.end").cast("timestamp_ntz").alias("end"), "n")


def _shared(spark) -> str:
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="streams-")
    return f"{at.rstrip('/')}/stream-{uuid.uuid4().hex}"


@query("streamed_daily_events", "", "select date_trunc('day', ts)::date as day, event_type, count(*) as n from events group by all")
def streamed_daily_events(spark, d):
    """The daily counts by a stream over the event files, all windows given at its end."""
    name = f"daily_{uuid.uuid4().hex}"
    s = runs.windowed(runs.events(spark, f"{d}/events.parquet"), "1 day")
    return runs.drained(s, name, _shared(spark), "complete").select(F.to_date("w.start").alias("day"), "event_type", "n")


@query("streamed_run_states", "", "")
def streamed_run_states(spark, d):
    name = f"runs_{uuid.uuid4().hex}"
    s = runs.run_states(runs.events(spark, f"{d}/events.parquet"))
    return runs.drained(s, name, _shared(spark), "update")
