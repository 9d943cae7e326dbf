"""Calls to outside models as pluggable functions, and the text around such calls.

A hook is a plain function from a list of texts to a list of texts. It runs inside mapInPandas with bounded batches,
so a partition holds a few requests at a time, order is kept by the caller's key, and a lost executor repeats its own
partition only. Without a hook the stub gives the text back.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Hook = Callable[[list[str]], list[str]]


def stub(texts: list[str]) -> list[str]:
    return list(texts)


def error_class(message: str) -> str:
    """quota, rate, transient or fatal, by the words of an error."""
    low = message.lower()
    for name, words in (("quota", ("quota", "insufficient", "billing")), ("rate", ("rate limit", "429", "too many")), ("transient", ("timeout", "timed out", "502", "503", "connection", "reset"))):
        if any(w in low for w in words):
            return name
    return "fatal"


def called(df: DataFrame, text: str, hook: Hook = stub, most: int = 32, tries: int = 3, first_wait: float = 0.0) -> DataFrame:
    """df with columns answer and error: batches of at most `most` texts, repeated with doubled waits on rate limits
    and passing faults, never on others."""

    def ask(texts: list[str]) -> tuple[list[str | None], str]:
        wait = first_wait
        for n in range(tries):
            try:
                return list(hook(texts)), ""
            except Exception as e:  # the hook's own faults become rows
                kind = error_class(str(e))
                if kind in ("quota", "fatal") or n == tries - 1:
                    return [None] * len(texts), kind
                time.sleep(wait)
                wait = min(90.0, 2 * wait)
        return [None] * len(texts), "fatal"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            for a in range(0, len(p), most):
                own = p.iloc[a : a + most].copy()
                own["answer"], own["error"] = ask(own[text].fillna("").tolist())
                yield own

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    return df.mapInPandas(run, f"{fields}, answer string, error string")


def prompt(parts: list[Column], sep: str = "\n\n") -> Column:
    return F.concat_ws(sep, *(F.when(F.trim(p) != "", p) for p in parts))


def token_estimate(text: Column) -> Column:
    """A third of the characters and one per wide character, rounded up."""
    wide = F.char_length(F.regexp_replace(text, "[^一-鿿]+", ""))
    return F.ceil((F.char_length(text) - wide) / 3 + wide)


def actions(text: Column) -> Column:
    """The valid actions in a model's answer: the outermost list, parsed tolerantly."""
    schema = "array<struct<action: string, link: string, confidence: double>>"
    parsed = F.from_json(F.regexp_extract(text, r"(?s)(\[.*\])", 1), schema)
    return F.filter(F.coalesce(parsed, F.array().cast(schema)), lambda a: a["action"].isin("match", "ignore", "create") & (F.coalesce(a["link"], F.lit("")) != ""))


def unwrapped(text: Column, field: str = "translation") -> Column:
    """The field of a text that turns out to be a JSON object, else the text."""
    return F.coalesce(F.when(F.startswith(F.trim(text), F.lit("{")), F.get_json_object(text, f"$.{field}")), text)
