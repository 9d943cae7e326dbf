"""The queries of this subpackage and their SQL."""

from __future__ import annotations

import importlib

MODULES = ("suffix_dedup", "substring_dedup", "warc", "token_planes", "line_rules", "winnowing", "simhash", "language", "piece_scan", "private_data")


def _parts(attr: str) -> dict:
    out = {}
    for name in MODULES:
        out |= getattr(importlib.import_module(f"quirelake.llm.{name}"), attr)
    return out


def queries() -> dict:
    return _parts("QUERIES")


def oracle_sql() -> dict:
    return _parts("ORACLE_SQL")
