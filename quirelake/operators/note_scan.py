"""Note scans of pages: which pages hold footnotes or endnotes, and their items.

A page's items depend on its own lines, on its neighbours' lines, and on the greatest footnote number of the page
before, which that page's own lines give: lost notes are numbered below the numbers that are read. So pages send tests and
numbers to their neighbours' page numbers, and are folded independently of each other: no task holds a book.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from quirelake.functions import note_lines as L

ITEM = "struct<kind:string,marker:string,number:int,text:string,order:int,source:string,confidence:double,section_title:string>"
SCAN = f"page_kind string, items array<{ITEM}>, section_hints array<string>, ambiguity_flags array<string>, note_start int, reviewed boolean"
#: An inline next marker, the marks that may stand before it, citation words before a number.
FOLLOWER = re.compile(r"(?:\s*[,;:·•]+\s*|\s+)(?P<token>\d(?:[ ,.\-]{0,2}\d){0,3})(?:[.,)、\]]|\s{1,3})")
TRAILING = re.compile(r"^(?P<body>.+?)\s+(?P<token>(?:\d[\s,.\-]*){1,4})[.,)、\]]\s*$")
CITED = re.compile(r"(?:" + "|".join(rf"(?<!\w){re.escape(w)}" for w in L.CITATION_WORDS) + r")\.$", re.IGNORECASE)
OPENERS = "\"'«(["


def digits(token: str) -> int | None:
    d = re.sub(r"\D", "", token)
    return int(d) if 0 < len(d) <= 4 else None


def follower(text: str, number: int) -> tuple[str, int, str] | None:
    """(text before, next number, text after) of the first inline marker of one of the next two notes."""

    def begins(m: re.Match) -> bool:
        before, after, n = text[: m.start()].rstrip(), text[m.end() :].strip(), digits(m["token"])
        if len(before) < 8 or len(after) < 8 or n is None or not number < n <= number + 2:
            return False
        if not (after[0].isupper() or after[0] in OPENERS):
            return False
        marked = any(c in ",;:·•" for c in text[m.start() : m.start("token")]) or before[-1] in ".;,:!?»”"
        return marked or (len(before) >= 24 and not before[-1].isdigit() and bool(re.search("[.!?;:]", before)) and not CITED.search(before[-12:]))

    m = next(filter(begins, FOLLOWER.finditer(text)), None)
    return (text[: m.start()].rstrip(), digits(m["token"]), text[m.end() :].strip()) if m else None


class Items:
    """Folds classified lines into note items. `waiting` holds lines that look like notes whose number was lost: they
    become items of their own if exactly their numbers are missing before the next one, else they go on with the open item."""

    def __init__(self, last: int | None = None):
        self.done: list[dict] = []
        self.open: dict | None = None
        self.waiting: list[str] = []
        self.last = last

    def begin(self, number: int, marker: str, body: str) -> None:
        self.open = {"number": number, "marker": marker, "body": body}
        self.last = number

    def close(self) -> None:
        if self.open and self.open["body"]:
            self.done.append(self.open)
        self.open = None

    def unfold(self) -> None:
        """Take the notes that stand inside the open one's text apart."""
        while self.open["number"] and (got := follower(self.open["body"], self.open["number"])):
            self.open["body"], number, rest = got
            self.close()
            self.begin(number, f"{number}.", rest)

    def go_on(self, line: str) -> None:
        self.open["body"] = f"{self.open['body']}\n{line}".strip()
        self.unfold()

    def flush(self) -> None:
        for line in self.waiting:
            self.go_on(line)
        self.waiting = []

    def restore(self, before: int) -> None:
        """Waiting lines as items, numbered from the one before."""
        self.done += [{"number": n, "marker": f"{n}.", "body": line} for n, line in enumerate(self.waiting, before + 1)]
        self.last = before + len(self.waiting)
        self.waiting = []

    def numbered(self, number: int, marker: str, body: str, line: str) -> None:
        if self.open:
            now = self.open["number"]
            if number > now + 2 and body.lstrip("# ")[:1].islower():  # text that begins with a number
                self.flush()
                return self.go_on(line)
            if self.waiting and number - now - 1 == len(self.waiting) and self.open["body"].endswith(L.CLOSERS):
                self.close()
                self.restore(now)
            else:
                self.flush()
                self.close()
        elif self.waiting and self.last is not None and number - self.last - 1 == len(self.waiting):
            self.restore(self.last)
        self.waiting = []
        tail = TRAILING.match(body)
        n = digits(tail["token"]) if tail else None
        if n is not None and number and number < n <= number + 2 and len(f"{number}. {tail['body']}") >= 8:
            self.begin(number, marker, tail["body"].rstrip())
            self.close()
            return self.begin(n, f"{n}.", "")
        self.begin(number, marker, body)
        self.unfold()

    def feed(self, x: dict) -> None:
        got = x["numbered"] or (None if self.open else x["embedded"])
        if got:
            return self.numbered(got["number"], got.get("marker") or f"{got['number']}.", got["body"], x["line"])
        if x["symbol"]:
            return self.numbered(0, x["symbol"]["marker"], x["symbol"]["body"], x["line"])
        only = x["only"]
        if self.open and only is not None and self.open["number"] < only <= self.open["number"] + 2:
            self.flush()
            self.close()
            return self.begin(int(only), f"{int(only)}.", "")
        if x["lost"]:
            self.waiting.append(x["line"])
        elif self.open:
            self.flush()
            self.go_on(x["line"])

    def end(self) -> list[dict]:
        if self.open:
            if 0 < len(self.waiting) <= 2 and self.open["body"].endswith(L.CLOSERS):
                now = self.open["number"]
                self.close()
                self.restore(now)
            else:
                self.flush()
                self.close()
        return self.done


def _item(kind: str, source: str, confidence: float, order: int, x: dict, title: str = "") -> dict:
    text = f"{x['number']}. {x['body']}" if x["number"] else f"{x['marker']} {x['body']}"
    return {"kind": kind, "marker": x["marker"], "number": int(x["number"]), "text": text, "order": order, "source": source, "confidence": confidence, "section_title": title}


def footnote_items(blocks: list[list[dict]], loose: list[dict], last: int | None) -> list[dict]:
    """Items of the footnote blocks, else of the footnote text; numbers go on from block to block."""
    out: list[dict] = []
    for lines in blocks:
        fold = Items(last)
        for x in lines:
            fold.feed(x)
        for x in fold.end():
            out.append(_item("footnote", "blocks", 1.0, len(out) + 1, x))
            last = x["number"] or last
    if out:
        return out
    fold = Items(last)
    for x in loose:
        fold.feed(x)
    return [_item("footnote", "footnotes", 1.0, i, x) for i, x in enumerate(fold.end(), 1)]


def endnote_scan(lines: list[dict], pictures: bool, has_blocks: bool, beside_notes: bool) -> dict:
    """Endnotes of a page's text: behind a notes heading, or of a page that begins with numbers and goes on with notes."""
    out = {"page_kind": "body", "items": [], "section_hints": [], "ambiguity_flags": [], "note_start": None}
    numbers = [i for i, x in enumerate(lines) if x["numbered"]]
    heading = next((i for i, x in enumerate(lines) if x["bare_heading"] or (i and x["heading"])), None)
    if pictures or not lines or (heading is None and not numbers):
        return out
    if heading is not None:
        out["section_hints"].append(lines[heading]["line"])
        out["note_start"], at = heading, heading + 1
        if not any(i > heading for i in numbers):
            return out | {"ambiguity_flags": ["notes_header_without_items"]}
    elif has_blocks:
        return out | {"ambiguity_flags": ["numbered_body_page_with_footnotes"]}
    elif len(numbers) >= 2 and numbers[0] <= 1 and (beside_notes or lines[numbers[0]]["numbered"]["number"] <= 2):
        out["note_start"] = at = numbers[0]
    else:
        return out | {"ambiguity_flags": ["isolated_numbered_page"]}
    title, current = "", None
    for i in range(at, len(lines)):
        x = lines[i]
        if x["bare_heading"]:
            continue
        if x["numbered"]:
            current = _item("endnote", "markdown", 0.88, len(out["items"]) + 1, x["numbered"], title)
            current["text"] = x["line"]
            out["items"].append(current)
        elif x["title"] and i + 1 < len(lines) and lines[i + 1]["numbered"]:
            title, current = x["line"], None
            if title not in out["section_hints"]:
                out["section_hints"].append(title)
        elif current:
            current["text"] += "\n" + x["line"]
    if not out["items"]:
        return out | {"ambiguity_flags": ["notes_header_without_items"]}
    out["page_kind"] = "mixed_body_endnotes" if out["note_start"] else "endnote_collection"
    seen = [x["number"] for x in out["items"]]
    out["ambiguity_flags"] = ["duplicate_numbers"] * (len(set(seen)) < len(seen)) + ["non_monotonic_numbers"] * (seen != sorted(seen))
    return out


def scan_score(scan: Column) -> Column:
    """Ten and its confidence for each item, three for a page of notes, less two for each doubt."""
    sure = F.aggregate(scan["items"], F.lit(0.0), lambda a, x: a + F.coalesce(x["confidence"], F.lit(0.0)))
    return 10.0 * F.size(scan["items"]) + sure + F.when(scan["page_kind"] != "body", 3.0).otherwise(0.0) - 2.0 * F.size(scan["ambiguity_flags"])


def items_of_kind(scan: Column, kind: str) -> Column:
    return F.filter(scan["items"], lambda x: x["kind"] == kind)


def first_marker(scan: Column, kind: str) -> Column:
    """The first item's marker of a kind, digits only where it has any."""
    m = F.get(items_of_kind(scan, kind), 0)["marker"]
    d = F.regexp_replace(m, "[^0-9]", "")
    return F.coalesce(F.when(d != "", d).otherwise(m), F.lit(""))


def note_scans(pages: DataFrame, reviewer=None) -> DataFrame:
    """book, page_no and the scan of each page (book, page_no, markdown, footnotes, blocks: array of footnote texts).

    reviewer: a function (page as dict, scan as dict) -> scan as dict or None, asked about scans with doubts; its
    scan counts where it scores at least as much.
    """
    keyed = pages.select("book", "page_no", L.broken_lines(F.col("markdown")).alias("lines"), L.broken_lines(F.col("footnotes")).alias("loose"), F.transform(F.coalesce("blocks", F.array().cast("array<string>")), L.broken_lines).alias("blocks"))
    keyed = keyed.select("book", "page_no", F.struct("lines", "loose", "blocks").alias("own"), F.slice("lines", 1, 8).alias("top"), L.begins_with_notes(F.col("lines")).alias("notes"))
    # a page and what its neighbours need of it go out together: one exchange, and each page is read once
    met = sent(keyed, {"own": (0, F.col("own")), "top_before": (1, F.col("top")), "notes_before": (1, F.col("notes")), "notes_after": (-1, F.col("notes"))})
    rows = met.select("book", "page_no", F.explode("own").alias("own"), F.get("top_before", 0).alias("top_before"), F.array_contains(F.concat("notes_before", "notes_after"), True).alias("beside_notes"))
    rows = rows.select(
        "book", "page_no", L.classified(F.col("own.lines")).alias("lines"), L.classified(F.col("own.loose")).alias("loose"), F.transform("own.blocks", L.classified).alias("blocks"),
        L.is_picture_list(F.col("own.lines"), F.col("top_before")).alias("pictures"), "beside_notes",
    )
    names = ["page_kind", "items", "section_hints", "ambiguity_flags", "note_start"]
    first = f"book string, page_no int, {SCAN}".rpartition(",")[0]
    shapes = [to_arrow_schema(StructType.fromDDL(x)) for x in (first, f"book string, page_no int, {SCAN}")]
    told = F.when(F.size("blocks") > 0, F.flatten("blocks")).otherwise(F.col("loose"))
    most = F.nullif(F.array_max(F.transform(told, lambda x: F.coalesce(x["numbered"]["number"], F.lit(0)))), F.lit(0))
    texts = F.transform("lines", lambda x: x["line"]) if reviewer else F.array().cast("array<string>")
    # a page without numbers and headings has no endnotes, whatever its lines
    telling = F.exists("lines", lambda x: x["numbered"].isNotNull() | x["bare_heading"] | x["heading"])
    fed = rows.select("book", "page_no", F.when(telling, F.col("lines")).otherwise(F.slice("lines", 1, 0)).alias("lines"), F.coalesce("pictures", F.lit(False)).alias("pictures"), (F.size("blocks") > 0).alias("has_blocks"), "beside_notes", "loose", "blocks", most.alias("most"), texts.alias("texts"))
    kept = ["loose", "blocks", "most", "texts"]

    def endnotes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = b.select(["book", "page_no", "lines", "pictures", "has_blocks", "beside_notes"]).to_pylist()
            rows_ = [{"book": r["book"], "page_no": r["page_no"]} | endnote_scan(r["lines"], r["pictures"], r["has_blocks"], bool(r["beside_notes"])) for r in own]
            out = pa.RecordBatch.from_pylist(rows_, schema=shapes[0])
            yield pa.RecordBatch.from_arrays([*out.columns, *(b.column(c) for c in kept)], names=[*out.schema.names, *kept])

    ends = fed.mapInArrow(endnotes, ", ".join([first, *(f"{c} {fed.schema[c].dataType.simpleString()}" for c in kept)]))
    ends = ends.select("book", "page_no", F.struct(*names, *kept).alias("own"))
    met = sent(ends, {"own": (0, F.col("own")), "last": (1, F.when(F.size("own.items") == 0, F.col("own.most")))})

    def footnotes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for r in b.to_pylist():
                scan = {n: r[n] for n in names}
                if not scan["items"]:
                    foot = footnote_items(r["blocks"], r["loose"], r["last"])
                    scan = {"page_kind": "body_with_page_footnotes" if foot else "body", "items": foot, "section_hints": [], "ambiguity_flags": [] if foot else scan["ambiguity_flags"], "note_start": None}
                scan["reviewed"] = False
                if reviewer and scan["ambiguity_flags"]:
                    scan = reviewed(scan, reviewer({"book": r["book"], "page_no": r["page_no"], "lines": r["texts"]}, scan))
                out.append({"book": r["book"], "page_no": r["page_no"], **scan})
            yield pa.RecordBatch.from_pylist(out, schema=shapes[1])

    both = met.select("book", "page_no", F.explode("own").alias("own"), F.get("last", 0).alias("last"))
    return both.select("book", "page_no", *(f"own.{c}" for c in ("loose", "blocks", *names, "texts")), "last").mapInArrow(footnotes, f"book string, page_no int, {SCAN}")


def sent(pages: DataFrame, what: dict[str, tuple[int, Column]]) -> DataFrame:
    """book, page_no and lists of what pages (book, page_no, ...) send themselves and their neighbours: name: (pages ahead, value).
    Pages that nothing but a neighbour knows of have an empty first list."""
    ahead = sorted({n for n, _ in what.values()})
    to = [F.struct((F.col("page_no") + n).alias("page_no"), *(F.when(F.lit(m == n), x).alias(name) for name, (m, x) in what.items())) for n in ahead]
    out = pages.select("book", F.explode(F.array(*to)).alias("x")).select("book", "x.*")
    return out.groupBy("book", "page_no").agg(*(F.collect_list(name).alias(name) for name in what))


def reviewed(scan: dict, answer: dict | None) -> dict:
    """The reviewer's scan in proper form if it scores at least as much as the rules', else the rules'."""
    if not isinstance(answer, dict):
        return scan
    items = []
    for i, x in enumerate(answer.get("items") or [], 1):
        x = {"kind": "", "marker": "", "number": None, "text": "", "section_title": "", **x, "order": i, "source": x.get("source") or "review", "confidence": float(x.get("confidence") or 0.75)}
        if x["kind"] and x["text"]:
            items.append(x)
    texts = lambda key: [str(v).strip() for v in answer.get(key) or [] if str(v).strip()]
    new = {"page_kind": answer.get("page_kind") or scan["page_kind"], "items": items, "section_hints": texts("section_hints"), "ambiguity_flags": texts("ambiguity_flags"), "note_start": scan["note_start"], "reviewed": True}
    score = lambda s: 10 * len(s["items"]) + sum(x["confidence"] for x in s["items"]) + 3 * (s["page_kind"] != "body") - 2 * len(s["ambiguity_flags"])
    return new if score(new) >= score(scan) else scan
