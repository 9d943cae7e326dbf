"""Folds that carry state from row to row, one group at a time, on Arrow batches.

Groups are chapters or documents, whose size doesn't grow with the corpus; rows of a group are held together by
applyInPandas, and equal groups spread over all tasks.
"""

from __future__ import annotations

import difflib
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType, StringType


def chunked(df: DataFrame, group: list[str], order: str, size: str, most: int, joint: int = 2) -> DataFrame:
    """Greedy chunks of neighbouring rows: a row joins while the chunk, its joints and the row stay within `most`; a
    larger row stands alone. Adds column chunk."""

    def fold(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values(order, kind="stable")
        chunk, held, out = 0, None, []
        for n in p[size]:
            if held is not None and held + joint + n > most:
                chunk, held = chunk + 1, None
            held = n if held is None else held + joint + n
            out.append(chunk)
        return p.assign(chunk=out)

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema.fields)
    return df.groupBy(*group).applyInPandas(fold, f"{fields}, chunk int")


def local_numbers(refs: Column) -> Column:
    """References of a chapter numbered by first use."""
    return F.transform(F.array_distinct(refs), lambda r, i: F.struct(r.alias("ref"), (i + 1).alias("number")))


NUMBERED = re.compile(r"^(?:\[(\d{1,4})\]|(\d{1,4})[.)])\s*(\S.*)$")


def note_items(df: DataFrame, group: list[str], order: str, line: str) -> DataFrame:
    """Lines of a group folded into note items: a numbered line starts an item, others go on with it; a number that
    jumps by more than twenty and is followed by lower case is text, not a note."""
    names = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema.fields if f.name in group)

    def fold(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values(order, kind="stable")
        items: list[list] = []
        last = 0
        for at, t in zip(p[order], p[line].fillna(""), strict=True):
            m = NUMBERED.match(t.strip())
            n = int(m[1] or m[2]) if m else 0
            if m and not (last and n - last > 20 and m[3][:1].islower()):
                items.append([n, at, m[3].strip()])
                last = n
            elif items and t.strip():
                items[-1][2] += " " + t.strip()
        out = pd.DataFrame(items, columns=["number", "at", "text"])
        for g in group:
            out[g] = p[g].iloc[0]
        return out[[*group, "number", "at", "text"]]

    return df.groupBy(*group).applyInPandas(fold, f"{names}, number int, at long, text string")


@pandas_udf(DoubleType())
def ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Similarity of two texts: one where either holds the other, else the matching blocks' share."""
    return pd.Series([1.0 if x and y and (x in y or y in x) else difflib.SequenceMatcher(None, x or "", y or "").ratio() for x, y in zip(a, b, strict=True)])


@pandas_udf(StringType())
def folded(a: pd.Series) -> pd.Series:
    """Compatibility decomposition without combining marks, lower case, letters and digits only."""
    import unicodedata

    fold = lambda x: re.sub("[^0-9a-z]+", "", "".join(c for c in unicodedata.normalize("NFKD", (x or "").lower()) if not unicodedata.combining(c)))
    return a.map(fold)


@pandas_udf(StringType())
def repaired(a: pd.Series) -> pd.Series:
    """Text whose characters were moved by a constant, moved back by the offset that reads best; else as it is."""
    offsets = (48, 47, 46, -48, -47, -46, 32, -32, 64, -64, 16, -16, 96, -96, 80, -80)

    def readable(x: str) -> float:
        solid = [c for c in x if not c.isspace()]
        return sum(c.isascii() and c.isalpha() for c in solid) / max(1, len(solid))

    def fix(x: str | None) -> str | None:
        if not x or len(x) < 20 or readable(x) >= 0.6:
            return x
        tries = ["".join(chr(ord(c) + o) if not c.isspace() and 32 < ord(c) + o < 0x250 else c for c in x) for o in offsets]
        best = max(tries, key=readable)
        return best if readable(best) >= 0.8 else x

    return a.map(fix)


@pandas_udf(StringType())
def local_references(text: pd.Series, refs: pd.Series) -> pd.Series:
    """Note references [^id] of a text as numbers by their place in `refs`; unknown ones stay."""
    out = []
    for t, r in zip(text, refs, strict=True):
        at = {x: i + 1 for i, x in enumerate(dict.fromkeys(r))} if r is not None else {}
        out.append(re.sub(r"\[\^([^\]]+)\]", lambda m, at=at: f"[^{at[m[1]]}]" if m[1] in at else m[0], t or ""))
    return pd.Series(out)
