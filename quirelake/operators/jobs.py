"""Translation jobs, manual edits, run loops, claims and the views that a reader and an editor see."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quirelake.functions import text as T
from quirelake.operators.ordering import latest

# Outcomes of a page, the outcomes that end a run, empty polls before a reader is idle.
OUTCOMES = ("ok", "error", "rate", "quota", "stop", "manual")
ENDINGS = ("done", "error_msg")
IDLE_POLLS = 3
LOOP = "done int, failed int, manual int, retried int, next_page int, phase string"


def edited(current: DataFrame, edits: DataFrame, key: list[str], by: str = "manual") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(current with accepted edits, new revisions, rejected edits). current: key, text, version, editor; edits: key,
    text, base_version. An edit counts if its base is the present version; of several with one base the first text wins. An
    edit without a change makes no revision."""
    first = edits.groupBy(*key, "base_version").agg(F.min("text").alias("_text"))
    rows = edits.join(first, [*key, "base_version"]).join(current.select(*key, F.col("version").alias("_now"), F.col("text").alias("_old")), key, "left")
    rows = rows.withColumn("reason", F.when(F.col("_now").isNull(), "unknown").when((F.col("base_version") != F.col("_now")) | (F.col("text") != F.col("_text")), "conflict").when(F.col("text").eqNullSafe(F.col("_old")), "unchanged"))
    good = rows.where("reason is null").select(*key, F.col("text").alias("_new"), (F.col("_now") + 1).alias("_next"))
    new = current.join(good, key, "left").select(*key, F.coalesce("_new", "text").alias("text"), F.coalesce("_next", "version").alias("version"), F.when(F.col("_next").isNotNull(), by).otherwise(F.col("editor")).alias("editor"))
    revisions = good.select(*key, F.col("_new").alias("text"), F.col("_next").alias("version"), F.lit(by).alias("editor"))
    return new, revisions, rows.where("reason is not null").select(*key, "base_version", "text", "reason")


def segment_counts(segments: DataFrame, key: list[str]) -> DataFrame:
    """Manual and failed segments of each page, and whether some but not all failed."""
    out = segments.groupBy(*key).agg(F.count("*").alias("segments"), F.count_if(F.col("editor") == "manual").alias("manual"), F.count_if(F.col("status") == "error").alias("failed"))
    return out.withColumn("partial", (F.col("failed") > 0) & (F.col("failed") < F.col("segments")))


def failed_places(units: DataFrame, key: list[str]) -> DataFrame:
    """Where paragraphs of units failed: units (key, unit_id, segments: array of page_no and paragraphs with status)."""
    pages = units.select(*key, "unit_id", F.explode("segments").alias("s"))
    rows = pages.select(*key, "unit_id", "s.page_no", F.posexplode("s.paragraphs").alias("paragraph", "p"))
    return rows.where("p.status = 'error'").select(*key, "unit_id", "page_no", "paragraph", F.coalesce("p.error", F.lit("")).alias("error"))


def drift(files: DataFrame, key: list[str]) -> DataFrame:
    """Counters over exported files (content) and the files of the run before (old; null for a new one)."""
    legacy = F.size(F.regexp_extract_all(T.plain(F.col("content")), F.lit(r"(?i)\[FN-[^\]]+\]|\[EN-[^\]]+\]|\{\{(?:NOTE_REF|FN_REF|EN_REF):[^}]+\}\}"), F.lit(0)))
    waiting = F.size(F.regexp_extract_all(T.plain(F.col("content")), F.lit(r"\[待翻译\]"), F.lit(0)))
    return files.groupBy(*key).agg(F.count("content").alias("files"), F.count_if(F.col("old").isNull()).alias("added"), F.count_if(F.col("content").isNull()).alias("removed"), F.count_if(F.col("content") != F.col("old")).alias("changed"), F.coalesce(F.sum(legacy), F.lit(0)).alias("legacy_tokens"), F.coalesce(F.sum(waiting), F.lit(0)).alias("pending"))


def status(judged: DataFrame, progress: DataFrame, key: list[str]) -> DataFrame:
    """The state of a book from its verdicts (key, phase, passes, failures) and its units (key, total, done)."""
    v = judged.groupBy(*key).agg(F.min(F.when(~F.col("passes"), F.col("phase"))).alias("blocked_at"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("failures")))).alias("blocking_reasons"), F.max(F.when(F.col("passes"), F.col("phase"))).alias("reached"))
    out = v.join(progress.select(*key, "total", "done"), key, "left")
    ready = F.coalesce(F.col("blocked_at") > 4, F.lit(True))
    return out.select(*key, F.when(ready, "ready").otherwise("review_required").alias("structure_state"), "blocked_at", "blocking_reasons", (F.coalesce(F.col("done") == F.col("total"), F.lit(False)) & F.col("blocked_at").isNull()).alias("can_ship"), F.round(F.coalesce(F.col("done") / F.nullif(F.col("total"), F.lit(0)), F.lit(0.0)), 4).alias("share_done"))


# jobs and views


def segments(pages: DataFrame, key: list[str]) -> DataFrame:
    """Paragraph segments of pages (key, page_no, text), numbered; headings apart from text."""
    rows = pages.select(*key, "page_no", F.posexplode(F.filter(F.transform(F.split(T.plain(F.col("text")), r"\n\s*\n+"), lambda x: F.trim(x)), lambda x: x != "")).alias("paragraph", "text"))
    return rows.withColumns({"heading_level": T.heading_level(F.col("text")), "text": F.when(T.heading_level(F.col("text")) > 0, T.heading_text(F.col("text"))).otherwise(F.col("text"))})


def page_jobs(paragraphs: DataFrame, notes: DataFrame, key: list[str]) -> DataFrame:
    """Jobs of pages: body paragraphs in order, then notes that start on the page in order of their numbers."""
    body = paragraphs.where("heading_level = 0").select(*key, "page_no", F.lit("body").alias("kind"), F.col("paragraph").cast("long").alias("place"), "text")
    note = notes.select(*key, "page_no", F.col("note_kind").alias("kind"), F.col("number").cast("long").alias("place"), "text")
    order = F.struct(F.when(F.col("kind") == "body", 0).when(F.col("kind") == "footnote", 1).otherwise(2), F.col("place"))
    return body.unionByName(note).where("trim(text) <> ''").withColumn("job", F.row_number().over(Window.partitionBy(*key, "page_no").orderBy(order, "text")))


def needs_model(levels: Column, texts: Column) -> Column:
    """Whether a page's paragraphs should be put in order by a model: none, or over three short ones; lists of references are left."""
    heads = F.exists(F.zip_with(levels, texts, lambda n, t: (n > 0) & F.regexp_like(t, F.lit("(?i)^(References|Bibliography|Works Cited)"))), lambda x: x)
    body = F.transform(F.filter(F.arrays_zip(levels.alias("n"), texts.alias("t")), lambda p: p["n"] == 0), lambda p: p["t"])
    cited = F.size(F.filter(body, lambda t: F.regexp_like(F.left(t, F.lit(80)), F.lit(r"\([0-9]{4}[a-z]?\)"))))
    short = F.size(F.filter(body, lambda t: F.char_length(t) < 30))
    return F.when(F.size(texts) == 0, True).when(heads, False).when((F.size(body) > 0) & (2 * cited >= F.size(body)), False).otherwise(short > 3)


def display(paragraphs: DataFrame, translations: DataFrame, key: list[str]) -> DataFrame:
    """Rows of the reading view: each paragraph with its newest translation and its state."""
    newest = latest(translations, [*key, "page_no", "paragraph"], ["version"])
    out = paragraphs.join(newest.select(*key, "page_no", "paragraph", "translation", "status", "editor"), [*key, "page_no", "paragraph"], "left")
    state = F.when(F.col("editor") == "manual", "manual").when(F.col("status") == "error", "error").when(F.trim(T.plain(F.col("translation"))) != "", "done").otherwise("pending")
    return out.select(*key, "page_no", "paragraph", "heading_level", "text", F.coalesce("translation", F.lit("")).alias("translation"), state.alias("state"))


def editor_pages(shown: DataFrame, key: list[str]) -> DataFrame:
    """One row per page with its paragraphs nested in order."""
    rows = F.array_sort(F.collect_list(F.struct("paragraph", "heading_level", "text", "translation", "state")))
    return shown.groupBy(*key, "page_no").agg(rows.alias("rows"), F.count_if(F.col("state") == "manual").alias("manual"), F.count_if(F.col("state") == "pending").alias("pending"))


def projections(units: DataFrame, key: list[str]) -> tuple[DataFrame, DataFrame]:
    """(page view, note view) of units (key, unit_id, kind, note_id, page_no, source_text, translated_text, status)."""
    u = units.withColumn("text", F.coalesce(F.nullif(F.trim(T.plain(F.col("translated_text"))), F.lit("")), F.col("source_text")))
    body = u.where("kind = 'body'").groupBy(*key, "page_no").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("unit_id", "text"))), lambda x: x["text"]), "\n\n").alias("text"), F.count_if(F.col("status") != "done").alias("open"))
    return body, u.where("kind <> 'body'").select(*key, "note_id", "kind", "page_no", "text", "status")


def markdown(shown: DataFrame, notes: DataFrame, key: list[str], quote: bool = True) -> DataFrame:
    """One Markdown text per chapter: headings, sources as quotes, translations, and definitions of the chapter's notes.
    shown: key, page_no, paragraph, heading_level, text, translation; notes: key, number, text."""
    source = F.concat(F.lit("> "), F.regexp_replace("text", "\n", "\n> "))
    done = F.trim(T.plain(F.col("translation")))
    block = F.when(F.col("heading_level") > 0, F.concat(F.repeat(F.lit("#"), F.col("heading_level")), F.lit(" "), F.when(done != "", done).otherwise(F.col("text"))))
    block = block.otherwise(F.concat_ws("\n\n", F.when(F.lit(quote), source), F.when(done != "", done).otherwise(F.lit("[待翻译]"))))
    body = shown.groupBy(*key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page_no", "paragraph", block.alias("b")))), lambda x: x["b"]), "\n\n").alias("body"))
    line = F.concat(F.lit("[^"), F.col("number").cast("string"), F.lit("]: "), T.squeezed(F.col("text")))
    defs = notes.groupBy(*key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("number", line.alias("l")))), lambda x: x["l"]), "\n").alias("defs"))
    return body.join(defs, key, "left").select(*key, F.concat(F.concat_ws("\n\n", "body", F.concat(F.lit("### NOTES\n\n"), F.col("defs"))), F.lit("\n")).alias("markdown"))


def inline_footnotes(paragraphs: DataFrame, footnotes: DataFrame, key: list[str]) -> DataFrame:
    """Paragraphs with their footnotes right behind them, as starred lines."""
    own = footnotes.groupBy(*key, "page_no", "paragraph").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("number", "text"))), lambda x: F.concat(F.lit("* "), x["text"])), "\n").alias("_n"))
    out = paragraphs.join(own, [*key, "page_no", "paragraph"], "left")
    return out.withColumn("text", F.concat_ws("\n\n", "text", F.col("_n"))).drop("_n")


# runs


def run_loops(log: DataFrame, key: list[str], retries: int = 2) -> DataFrame:
    """The state of each run after its log (key, seq, page_no, outcome): a failed page is tried again up to `retries` times,
    a page without hope waits for manual work, quota and stop end the run, which a later entry takes up again. Runs are
    folded independently of each other."""
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in log.schema.fields if f.name in key)

    def fold(keys: tuple, p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values("seq", kind="stable")
        state: dict[int, str] = {}
        tries: dict[int, int] = {}
        phase, retried = "idle", 0
        for page, outcome in zip(p["page_no"], p["outcome"], strict=True):
            if outcome in ("quota", "stop"):
                phase = "quota_exceeded" if outcome == "quota" else "stopped"
                continue
            phase = "running"
            if outcome == "ok" and state.get(page) != "manual":
                state[page] = "done"
            elif outcome == "manual":
                state[page] = "manual"
            elif outcome in ("error", "rate") and state.get(page) not in ("done", "manual"):
                tries[page] = tries.get(page, 0) + 1
                retried += 0 < tries[page] <= retries
                state[page] = "failed" if tries[page] > retries else "waiting"
        got = list(state.values())
        open_ = [n for n, s in sorted(state.items()) if s in ("waiting", "failed")]
        if phase == "running":
            phase = "done" if not open_ else "partial_failed" if all(state[n] == "failed" for n in open_) else "running"
        row = {"done": got.count("done"), "failed": got.count("failed"), "manual": got.count("manual"), "retried": retried, "next_page": open_[0] if open_ else None, "phase": phase}
        out = pd.DataFrame([row]).astype({"next_page": "Int32"})
        for name, value in zip(key, keys, strict=True):
            out[name] = value
        return out[[*key, *(c.split()[0] for c in LOOP.split(", "))]]

    return log.groupBy(*key).applyInPandas(fold, f"{kinds}, {LOOP}")


def claims(log: DataFrame, key: list[str]) -> DataFrame:
    """Who owns each run after a log (key, seq, token, action: claim or release): the first claim since the last release
    by the owner. Others are refused as busy."""
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in log.schema.fields if f.name in key)

    def fold(keys: tuple, p: pd.DataFrame) -> pd.DataFrame:
        owner, refused = None, 0
        for token, action in zip(p.sort_values("seq")["token"], p.sort_values("seq")["action"], strict=True):
            if action == "claim":
                refused += owner not in (None, token)
                owner = owner or token
            elif token == owner:
                owner = None
        out = pd.DataFrame([{"owner": owner, "refused": refused}])
        for name, value in zip(key, keys, strict=True):
            out[name] = value
        return out[[*key, "owner", "refused"]]

    return log.groupBy(*key).applyInPandas(fold, f"{kinds}, owner string, refused int")


def until_end(events: DataFrame, key: list[str]) -> DataFrame:
    """Events (key, cursor, event_type) up to each stream's first ending, the ending included."""
    end = events.where(F.col("event_type").isin(*ENDINGS)).groupBy(*key).agg(F.min("cursor").alias("_end"))
    return events.join(end, key, "left").where("_end is null or cursor <= _end").drop("_end")


def polled(events: DataFrame, polls: DataFrame, key: list[str], limit: float = 600.0) -> DataFrame:
    """How a reader's polls (key, poll, at: seconds) go over events (key, at, event_type): how many new events each brings, and
    how the reading ends: done or error_msg, idle after three empty polls, or timeout."""
    steps = polls.withColumn("_before", F.coalesce(F.lag("at").over(Window.partitionBy(*key).orderBy("poll")), F.lit(-1.0)))
    own = events.select(*key, F.col("at").alias("_at"), "event_type")
    got = steps.join(own, key, "left").groupBy(*key, "poll", "at").agg(F.count_if((F.col("_at") > F.col("_before")) & (F.col("_at") <= F.col("at"))).alias("n"), F.min(F.when((F.col("_at") > F.col("_before")) & (F.col("_at") <= F.col("at")) & F.col("event_type").isin(*ENDINGS), F.col("event_type"))).alias("ending"))
    w = Window.partitionBy(*key).orderBy("poll").rowsBetween(-(IDLE_POLLS - 1), 0)
    got = got.withColumn("_idle", (F.sum("n").over(w) == 0) & (F.count("*").over(w) == IDLE_POLLS))
    got = got.withColumn("end", F.coalesce("ending", F.when(F.col("at") > limit, "timeout").when(F.col("_idle"), "idle")))
    first = got.where("end is not null").groupBy(*key).agg(F.min("poll").alias("_stop"))
    return got.join(first, key, "left").where("_stop is null or poll <= _stop").select(*key, "poll", "n", "end")


def rederived_labels(entries: DataFrame, pages: DataFrame, key: list[str]) -> DataFrame:
    """Stored entries with the printed labels of their pages as they are now."""
    return entries.drop("label").join(pages.select(*key, "page_no", F.coalesce("label", F.col("page_no").cast("string")).alias("label")), [*key, "page_no"], "left")
