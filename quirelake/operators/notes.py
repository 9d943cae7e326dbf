"""Notes, the markers that refer to them, and the links between both."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WINDOW = 1  # greatest distance in pages between a marker and its footnote
MOST_ORPHANS, MOST_FALLBACK = 10, 0.30


def linked(anchors: DataFrame, notes: DataFrame, group: list[str], window: int = WINDOW) -> DataFrame:
    """Markers with their note by group and marker: matched within the window, else orphan_note; orphan_anchor without
    a note. One equi-join; no candidate pairs beyond equal markers."""
    out = anchors.join(notes, [*group, "marker"], "left")
    near = F.abs(F.col("note_page") - F.col("page_no")) <= window
    return out.withColumn("status", F.when(near, "matched").when(F.col("note_page").isNull(), "orphan_anchor").otherwise("orphan_note"))


def link_counts(links: DataFrame, by: list[str]) -> DataFrame:
    """Counts by status and the share of links that lack a partner."""
    n = lambda s: F.count_if(F.col("status") == s).alias(s)
    out = links.groupBy(*by).agg(F.count("*").alias("n"), n("matched"), n("orphan_note"), n("orphan_anchor"))
    return out.withColumn("fallback_ratio", F.round(F.col("orphan_note") / F.nullif(F.col("matched") + F.col("orphan_note"), F.lit(0)), 6))


def passes_quality(orphan_anchors: Column, fallback_ratio: Column) -> Column:
    return (orphan_anchors <= MOST_ORPHANS) & (F.coalesce(fallback_ratio, F.lit(0.0)) <= MOST_FALLBACK)


def nearest_unique(pairs: DataFrame, note: list[str], distance: str) -> DataFrame:
    """The single nearest candidate of each note; none where several are equally near. Sums only, so that a note
    with very many candidates is combined map-side."""
    best = pairs.groupBy(*note).agg(F.min(distance).alias(distance))
    near = pairs.join(best, [*note, distance])
    single = near.groupBy(*note).agg(F.count("*").alias("_n")).where("_n = 1").drop("_n")
    return near.join(single, note)


def greedy_pairs(notes: DataFrame, anchors: DataFrame, group: list[str]) -> DataFrame:
    """One-to-one matching in reading order: each note, in page order, takes the earliest unused anchor of its marker.
    Equal markers of a group pair off in order, so the n-th note gets the n-th anchor."""
    place = lambda page: Window.partitionBy(*group, "marker").orderBy(page)
    a = anchors.withColumn("nth", F.row_number().over(place("page_no")))
    b = notes.withColumn("nth", F.row_number().over(place("note_page")))
    return b.join(a, [*group, "marker", "nth"], "left")


def gaps(df: DataFrame, group: list[str], marker: str) -> DataFrame:
    """Numbers missing between the least and the greatest marker of a group."""
    bounds = df.groupBy(*group).agg(F.min(marker).alias("_a"), F.max(marker).alias("_b"))
    every = bounds.select(*group, F.explode(F.sequence("_a", "_b")).alias(marker))
    return every.join(df.select(*group, marker).distinct(), [*group, marker], "left_anti")


def without_outliers(markers: Column) -> Column:
    """A sorted array of numbers up to the first jump of over 20 that is also over half of the number before it."""
    first = F.array_min(F.filter(F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(markers) - 1)), lambda i: F.when((F.get(markers, i) - F.get(markers, i - 1) > 20) & (F.get(markers, i) - F.get(markers, i - 1) > 0.5 * F.get(markers, i - 1)), i)), lambda i: i.isNotNull()))
    return F.when(F.size(markers) < 2, markers).otherwise(F.slice(markers, F.lit(1), F.coalesce(first, F.size(markers))))


def contracts(links: DataFrame, by: list[str]) -> DataFrame:
    """Per group: whether its notes start at one, have no gap, are all matched, and number as many as its markers."""
    notes = F.array_sort(F.collect_set(F.when(F.col("note_page").isNotNull(), F.col("marker"))))
    out = links.groupBy(*by).agg(notes.alias("_notes"), F.count_distinct("marker").alias("n_markers"), F.count_if(F.col("status") == "matched").alias("n_matched"), F.count_if(F.col("status") == "orphan_anchor").alias("n_orphans"))
    cut = without_outliers(F.col("_notes"))
    out = out.withColumn("_cut", cut)
    return out.select(*by, (F.coalesce(F.array_min("_notes"), F.lit(0)) == 1).alias("starts_at_one"), (F.size("_notes") > 0).alias("any"), (F.coalesce(F.array_max("_cut") - F.array_min("_cut") + 1, F.lit(0)) == F.size("_cut")).alias("no_gap"), (F.col("n_matched") == F.size("_notes")).alias("all_matched"), (F.size("_notes") == F.col("n_markers")).alias("equal_counts"), F.size("_notes").cast("long").alias("n_notes"), "n_markers", "n_orphans")


def aligned(a: list[str], b: list[str]) -> tuple[int, list, list]:
    """Global alignment of two lists with scores 1, -1, -1; of equal ways back the diagonal one, then a deletion."""
    m, n = len(a), len(b)
    top = [[-j for j in range(n + 1)]]
    for i in range(1, m + 1):
        row = [-i]
        for j in range(1, n + 1):
            row.append(max(top[i - 1][j - 1] + (1 if a[i - 1] == b[j - 1] else -1), top[i - 1][j] - 1, row[j - 1] - 1))
        top.append(row)
    left, right = [], []
    while m or n:
        if m and n and top[m][n] == top[m - 1][n - 1] + (1 if a[m - 1] == b[n - 1] else -1):
            m, n = m - 1, n - 1
            left.append(a[m])
            right.append(b[n])
        elif m and top[m][n] == top[m - 1][n] - 1:
            m -= 1
            left.append(a[m])
            right.append(None)
        else:
            n -= 1
            left.append(None)
            right.append(b[n])
    return top[len(a)][len(b)], left[::-1], right[::-1]


def alignment(links: DataFrame, by: list[str]) -> DataFrame:
    """Per group, its marker list against its note list: clean, mismatches (equal lengths) or misaligned, the score,
    and how many of each side have no partner. Groups are chapters, so lists are short."""
    lists = links.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.when(F.col("page_no").isNotNull(), F.struct("page_no", "marker")))), lambda x: x["marker"].cast("string")).alias("a"), F.transform(F.array_sort(F.collect_list(F.when(F.col("note_page").isNotNull(), F.struct("note_page", "marker")))), lambda x: x["marker"].cast("string")).alias("b"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            rows = []
            for a, b in zip(p["a"], p["b"], strict=True):
                a, b = list(a), list(b)
                score, left, right = aligned(a, b)
                status = "clean" if a == b else "mismatches" if len(a) == len(b) else "misaligned"
                rows.append((status, score, sum(x is None for x in right), sum(x is None for x in left)))
            out = p[by].copy()
            out[["alignment_status", "score", "extra_markers", "extra_notes"]] = rows
            yield out

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in lists.schema.fields if f.name in by)
    return lists.mapInPandas(run, f"{fields}, alignment_status string, score int, extra_markers int, extra_notes int")
