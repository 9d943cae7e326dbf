"""Notes linked to the markers in the text of their chapter, by passes that carry which markers are used.

All state lives inside one chapter: its notes and markers are cogrouped and folded, and chapters spread over all tasks. A chapter is
bounded by its book. Overrides and recovered markers are joins before the fold.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quirelake.functions import text as T
from quirelake.functions.markers import DIGITS, RAISED

# Pages between a footnote and its marker, certainty of made-up and recovered markers.
WINDOW, SYNTHETIC, RECOVERED = 1, 0.4, 0.7
LINK = "note_id string, anchor_id string, status string, resolver string, confidence double, note_kind string, marker string, page_no int"


def is_inside(short: str, long: str) -> bool:
    """Whether short's digits are an ordered, proper part of long's."""
    rest = iter(long)
    return short.isdigit() and long.isdigit() and len(short) < len(long) and all(c in rest for c in short)


@dataclass
class Anchor:
    anchor_id: str
    page_no: int
    paragraph: int
    start: int
    marker: str
    kind: str
    certainty: float
    synthetic: bool
    text: str = ""

    def place(self) -> tuple[int, int, int]:
        return self.page_no, self.paragraph, self.start


def without_doubles(anchors: list[Anchor]) -> list[Anchor]:
    """Of anchors of the same paragraph and text the surest stays, then the first."""
    best: dict[tuple, Anchor] = {}
    for a in anchors:
        at = (a.page_no, a.paragraph, a.text) if a.text else (a.anchor_id,)
        if at not in best or (-a.certainty, a.start) < (-best[at].certainty, best[at].start):
            best[at] = a
    return [a for a in anchors if any(a is b for b in best.values())]


@dataclass
class Chapter:
    """The fold over one chapter; book_type decides the last pass."""

    anchors: list[Anchor]
    named: bool = True  # its chapter stands in the contents list
    used: set = field(default_factory=set)
    links: list = field(default_factory=list)

    def free(self, marker: str, kinds: set[str], synthetic: bool = False, near: int | None = None) -> list[Anchor]:
        got = [a for a in self.anchors if a.marker == marker and a.kind in kinds and a.anchor_id not in self.used and (synthetic or not a.synthetic) and (near is None or abs(a.page_no - near) <= WINDOW)]
        return without_doubles(got)

    def add(self, note: dict | None, status: str, resolver: str, anchor: Anchor | None = None, confidence: float | None = None, **more) -> None:
        if anchor is not None and status == "matched":
            self.used.add(anchor.anchor_id)
        sure = max(0.0, min(1.0, anchor.certainty)) if confidence is None and anchor is not None else confidence or 0.0
        base = {"note_id": None, "marker": "", "page_no": 0, "note_kind": ""} if note is None else {"note_id": note["note_id"], "marker": note["marker"], "page_no": note["page_no"], "note_kind": note["note_kind"]}
        self.links.append(base | {"anchor_id": anchor.anchor_id if anchor else None, "status": status, "resolver": resolver, "confidence": sure} | more)

    def endnote(self, note: dict) -> None:
        if not note["marker"]:
            return self.add(note, "ignored", "rule")
        direct = self.free(note["marker"], {"endnote", "unknown"})
        found = direct or self.free(note["marker"], {"endnote"}, synthetic=True)
        if not found:
            return self.add(note, "orphan_note", "rule")
        resolver = "repair" if len(found) > 1 else "rule" if direct else "fallback"
        self.add(note, "matched", resolver, min(found, key=Anchor.place))

    def footnote(self, note: dict) -> None:
        marker, page = note["marker"], note["page_no"]
        if not marker:
            return self.add(note, "ignored", "rule")
        if set(marker) == {"*"}:  # an editor's note belongs to its page
            own = [a for a in self.free(marker, {"footnote", "unknown"}) if a.page_no == page]
            if own:
                return self.add(note, "matched", "rule", min(own, key=lambda a: (a.paragraph, a.start)))
        found = self.free(marker, {"footnote"}, near=page)
        if len(found) == 1:
            return self.add(note, "matched", "rule", found[0])
        if found:
            best = min(abs(a.page_no - page) for a in found)
            near = [a for a in found if abs(a.page_no - page) == best]
            return self.add(note, "matched", "repair", near[0]) if len(near) == 1 else self.add(note, "ambiguous", "rule")
        parts = [a for a in self.anchors if not a.synthetic and a.anchor_id not in self.used and a.kind in ("footnote", "unknown") and abs(a.page_no - page) <= WINDOW and is_inside(a.marker, marker)]
        if len(parts) == 1:
            parts[0].marker, parts[0].kind = marker, "footnote"
            return self.add(note, "matched", "repair", parts[0], 1.0)
        made = Anchor(f"synthetic-{note['note_id']}", page, 999, 0, marker, "footnote", SYNTHETIC, True)
        self.anchors.append(made)
        self.add(note, "matched", "fallback", made)

    def explicit(self) -> None:
        """Made-up markers give way to the only explicit one that is still free."""
        for x in self.links:
            if x["note_kind"] == "footnote" and x["status"] == "matched" and str(x["anchor_id"]).startswith("synthetic-"):
                found = self.free(x["marker"], {"footnote", "unknown"}, near=x["page_no"])
                if len(found) == 1:
                    self.used.add(found[0].anchor_id)
                    x |= {"anchor_id": found[0].anchor_id, "resolver": "repair", "confidence": found[0].certainty}

    def orphans(self, notes: list[dict]) -> None:
        """Explicit markers that no note took up; in a named chapter only within the range of its notes' numbers."""
        known = {(n["note_kind"], n["marker"]) for n in notes if n["marker"]}
        range_of: dict[str, list[int]] = {}
        for kind, marker in known:
            if marker.isdigit():
                range_of.setdefault(kind, []).append(int(marker))
        for a in self.anchors:
            kind = "endnote" if a.kind == "unknown" else a.kind
            if a.synthetic or not a.marker or a.anchor_id in self.used or (kind, a.marker) in known:
                continue
            numbers = range_of.get(kind)
            if not self.named and not numbers:
                continue
            if self.named and numbers and a.marker.isdigit() and not min(numbers) <= int(a.marker) <= max(numbers):
                continue
            self.add(None, "orphan_anchor", "rule", a, 0.0, note_kind=kind, marker=a.marker, page_no=a.page_no)

    def repaired(self) -> None:
        """Late repair of endnotes: the only free marker, else the nearest unless two are as near, else the only one
        whose digits are part of the note's; then the nearest orphan marker."""
        open_ = [x for x in self.links if x["note_kind"] == "endnote" and x["status"] in ("orphan_note", "ambiguous")]
        for x in open_:
            page = x["page_no"]
            key = lambda a, page=page: (abs(a.page_no - page), *a.place())
            found = sorted(self.free(x["marker"], {"endnote", "unknown"}), key=key)
            parts = [a for a in self.anchors if not a.synthetic and a.anchor_id not in self.used and a.kind in ("endnote", "unknown") and is_inside(a.marker, x["marker"])]
            if len(found) == 1 or (found and key(found[0])[0] != key(found[1])[0]):
                self.used.add(found[0].anchor_id)
                x |= {"anchor_id": found[0].anchor_id, "status": "matched", "resolver": "repair", "confidence": found[0].certainty}
            elif len(parts) == 1:
                parts[0].marker, parts[0].kind = x["marker"], "endnote"
                self.used.add(parts[0].anchor_id)
                x |= {"anchor_id": parts[0].anchor_id, "status": "matched", "resolver": "repair", "confidence": 1.0}
        by_id = {a.anchor_id: a for a in self.anchors}
        for x in open_:
            if x["status"] == "matched":
                continue
            free = [y for y in self.links if y["note_kind"] == "endnote" and y["status"] == "orphan_anchor" and y["anchor_id"] not in self.used]
            if free:
                y = min(free, key=lambda y: (abs(by_id[y["anchor_id"]].page_no - x["page_no"]), by_id[y["anchor_id"]].page_no, y["anchor_id"]))
                self.used.add(y["anchor_id"])
                x |= {"anchor_id": y["anchor_id"], "status": "matched", "resolver": "fallback", "confidence": by_id[y["anchor_id"]].certainty}
                y |= {"status": "ignored", "resolver": "fallback", "confidence": 1.0}
        self.links = [y for y in self.links if y["status"] != "orphan_anchor" or y["anchor_id"] not in self.used]

    def winners(self, priority: dict[str, int]) -> None:
        """Notes that share a marker: as many as there are real markers keep one each, by priority and reading order;
        the others are ignored."""
        by_id, groups = {a.anchor_id: a for a in self.anchors}, {}
        for x in self.links:
            if x["note_kind"] == "endnote" and x["marker"] and x["note_id"] is not None:
                groups.setdefault(x["marker"], []).append(x)
        for rows in groups.values():
            held = [by_id[x["anchor_id"]] for x in rows if x["status"] == "matched"]
            real = list(dict.fromkeys(a.anchor_id for a in held if not a.synthetic))
            ids = real or list({(a.page_no, a.start): a.anchor_id for a in reversed(held)}.values())[::-1]
            rivals = sorted((x for x in rows if x["status"] in ("matched", "orphan_note", "ambiguous")), key=lambda x: (-priority.get(x["note_id"], 0), x["page_no"], x["note_id"]))
            if not ids or len(rivals) < 2:
                continue
            for x, anchor_id in zip(rivals, ids, strict=False):
                x |= {"anchor_id": anchor_id, "status": "matched", "resolver": "repair", "confidence": max(0.0, min(1.0, x["confidence"] or 1.0))}
            for x in rivals[len(ids) :]:
                x |= {"anchor_id": None, "status": "ignored", "resolver": "repair", "confidence": 1.0}


def link_chapter(notes: list[dict], anchors: list[Anchor], named: bool = True) -> list[dict]:
    """All passes over a chapter's notes (note_id, page_no, marker, note_kind, priority) and anchors."""
    fold = Chapter(sorted(anchors, key=lambda a: (*a.place(), a.anchor_id)), named)
    notes = sorted(notes, key=lambda n: (n["page_no"], n["note_id"]))
    for n in notes:
        if n["note_kind"] == "endnote":
            fold.endnote(n)
    for n in notes:
        if n["note_kind"] == "footnote":
            fold.footnote(n)
    fold.explicit()
    fold.orphans(notes)
    fold.repaired()
    fold.winners({n["note_id"]: n["priority"] for n in notes})
    return fold.links


def links(notes: DataFrame, anchors: DataFrame, key: list[str]) -> DataFrame:
    """Links of all chapters. notes: key, note_id, page_no, marker, note_kind, priority; anchors: key, anchor_id, page_no,
    paragraph, start, marker, kind, certainty, synthetic, source_text. Notes without a chapter are a chapter of their own
    that has no name."""
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in notes.schema.fields if f.name in key)

    def fold(keys: tuple, n: pd.DataFrame, a: pd.DataFrame) -> pd.DataFrame:
        own = [Anchor(x.anchor_id, int(x.page_no), int(x.paragraph), int(x.start), x.marker or "", x.kind, float(x.certainty), bool(x.synthetic), x.source_text or "") for x in a.itertuples(index=False)]
        rows = [{"note_id": x.note_id, "page_no": int(x.page_no), "marker": x.marker or "", "note_kind": x.note_kind, "priority": int(x.priority)} for x in n.itertuples(index=False)]
        out = pd.DataFrame(link_chapter(rows, own, not any(pd.isna(k) for k in keys)), columns=[c.split()[0] for c in LINK.split(", ")])
        for name, value in zip(key, keys, strict=True):
            out[name] = value
        return out[[*key, *(c.split()[0] for c in LINK.split(", "))]]

    return notes.groupBy(*key).cogroup(anchors.groupBy(*key)).applyInPandas(fold, f"{kinds}, {LINK}")


def found_marker(body: Column, marker: Column) -> Column:
    """struct(start, end, matched) of the first place of a known marker in a text, in any form; null if there is none."""
    quoted = F.concat(F.lit(r"\Q"), marker, F.lit(r"\E"))
    forms = [F.concat(F.lit(a), quoted, F.lit(b)) for a, b in ((r"\[\s*", r"\s*\]"), (r"\$\s*\^\s*\{\s*", r"\s*\}\s*\$"), (r"<sup>\s*", r"\s*</sup>"), (r"\^\s*\{\s*", r"\s*\}"), (r"\^\s*", r"\b"), (r"»\s*", r"\b"))]
    forms.append(F.when(F.regexp_like(marker, F.lit("^[0-9]+$")), F.translate(marker, DIGITS, RAISED)))
    out = None
    for p in forms:
        hit = F.regexp_substr(T.plain(body), p)
        place = F.struct((F.call_function("instr", T.plain(body), hit) - 1).alias("start"), (F.call_function("instr", T.plain(body), hit) - 1 + F.char_length(hit)).alias("end"), hit.alias("matched"))
        out = F.when(hit.isNotNull(), place) if out is None else out.when(hit.isNotNull(), place)
    return F.when(marker != "", out)


def recovered_anchors(orphans: DataFrame, pages: DataFrame, key: list[str]) -> DataFrame:
    """Markers of orphan endnotes (key, note_id, marker) found on the body pages (key, page_no, text) of their chapter: the first page wins."""
    rows = orphans.join(pages, key).withColumn("_at", found_marker(F.col("text"), F.col("marker"))).where("_at is not null")
    best = rows.groupBy(*key, "note_id", "marker").agg(F.min(F.struct("page_no", F.col("_at.start").alias("start"), F.col("_at.end").alias("end"), F.col("_at.matched").alias("matched"))).alias("a"))
    return best.select(*key, F.concat(F.lit("recovered-"), F.col("note_id")).alias("anchor_id"), "a.page_no", F.lit(0).alias("paragraph"), "a.start", "marker", F.lit("endnote").alias("kind"), F.lit(RECOVERED).alias("certainty"), F.lit(True).alias("synthetic"), F.col("a.matched").alias("source_text"), "note_id")


def created(overrides: DataFrame, existing: DataFrame, key: list[str], name: str, valid: Column) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected) overrides (key, target_id, action, ...): action must be create, the id new, the row valid; of
    several with one id the first target wins."""
    rows = overrides.withColumn("_id", F.coalesce(F.nullif(F.trim(F.col(name)), F.lit("")), F.col("target_id")))
    known = existing.select(*key, F.col(name).alias("_id"), F.lit(True).alias("_known")).distinct()
    rows = rows.join(known, [*key, "_id"], "left")
    first = rows.where(F.lower("action") == "create").groupBy(*key, "_id").agg(F.min("target_id").alias("_first"))
    rows = rows.join(first, [*key, "_id"], "left")
    why = F.when(~F.coalesce(F.lower("action") == "create", F.lit(False)), F.concat(F.lit("action="), F.coalesce(F.nullif(F.lower("action"), F.lit("")), F.lit("missing")))).when(F.col("_known") | (F.col("target_id") != F.col("_first")), f"{name}_conflict").when(~F.coalesce(valid, F.lit(False)), "invalid")
    rows = rows.withColumn("reason", why)
    accepted = rows.where("reason is null").withColumn(name, F.col("_id"))
    return accepted.drop("_id", "_known", "_first", "reason"), rows.where("reason is not null").select(*key, "target_id", "reason")


def with_created_anchors(anchors: DataFrame, overrides: DataFrame, key: list[str]) -> tuple[DataFrame, DataFrame]:
    """(anchors with created ones, rejected overrides with reasons)."""
    valid = (F.col("page_no") > 0) & (F.col("start") >= 0) & (F.col("end") > F.col("start"))
    accepted, rejected = created(overrides, anchors, key, "anchor_id", valid)
    new = accepted.select(*key, "anchor_id", "page_no", F.coalesce("paragraph", F.lit(0)).alias("paragraph"), "start", "marker", F.coalesce("kind", F.lit("endnote")).alias("kind"), F.coalesce("certainty", F.lit(0.0)).alias("certainty"), F.lit(False).alias("synthetic"), F.coalesce("source_text", F.lit("")).alias("source_text"))
    return anchors.unionByName(new), rejected


def with_created_notes(notes: DataFrame, regions: DataFrame, overrides: DataFrame, key: list[str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(notes with created ones, regions with a one-page region for each unknown one, rejected overrides)."""
    valid = (F.col("page_no") > 0) & (F.trim(F.col("marker")) != "") & (F.trim(F.col("text")) != "")
    accepted, rejected = created(overrides, notes, key, "note_id", valid)
    known = regions.select(*key, "region_id", F.lit(True).alias("_known")).distinct()
    accepted = accepted.join(known, [*key, "region_id"], "left")
    made = F.concat_ws("-", F.lit("note-region"), *(F.col(k).cast("string") for k in key), F.col("page_no").cast("string"), F.col("note_kind"))
    accepted = accepted.withColumn("region_id", F.when(F.col("_known"), F.col("region_id")).otherwise(made))
    new = accepted.where("_known is null").select(*key, "region_id", F.col("page_no").alias("page_start"), F.col("page_no").alias("page_end"), "note_kind").distinct()
    return notes.unionByName(accepted.select(*notes.columns)), regions.unionByName(new), rejected


def overlaid(fresh: DataFrame, stored: DataFrame, key: list[str]) -> DataFrame:
    """Fresh units (key, unit_id, source_text, translated_text, status) with stored translations where the source text is unchanged."""
    s = stored.select(*key, "unit_id", F.col("source_text").alias("_source"), F.col("translated_text").alias("_text"), F.col("status").alias("_status"))
    same = F.col("_source").isNotNull() & (T.squeezed(F.col("_source")) == T.squeezed(F.col("source_text"))) & (F.trim(T.plain(F.col("_text"))) != "")
    out = fresh.join(s, [*key, "unit_id"], "left")
    return out.withColumns({"translated_text": F.when(same, F.col("_text")).otherwise(F.col("translated_text")), "status": F.when(same, F.col("_status")).otherwise(F.col("status"))}).drop("_source", "_text", "_status")
