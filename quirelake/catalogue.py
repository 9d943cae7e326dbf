"""All queries of the library with their SQL twins."""

from __future__ import annotations

from quirelake.plans import contents, documents, gates, linking, links, matching, pagetexts, paragraphs, references, scalars, states, toc, work

PARTS = (scalars, links, documents, states, toc, paragraphs, gates, matching, references, contents, linking, pagetexts, work)
QUERIES: dict = {name: f for p in PARTS for name, f in p.QUERIES.items()}
ORACLE_SQL: dict[str, str] = {name: s for p in PARTS for name, s in p.ORACLE_SQL.items()}
FLAGSHIP = "note_link_summary"

#: Counts that DuckDB gives as 128-bit numbers.
_COUNTS = {
    "note_link_summary": "orphan_note orphan_anchor",
    "chapter_contracts": "n_orphans",
    "page_role_counts": "noise front_matter body note other",
    "duplicate_paragraphs": "across_pages",
    "unit_progress": "done error pending",
    "retry_summary": "failed manual",
    "toc_role_counts": "chapters sections entries",
    "titles_alike": "repeated mixed",
    "repeatable_paragraphs": "can_repeat",
    "toc_offset_summary": "navigable ready unresolved",
    "endnote_streams": 'own page prior "first"',
    "chapter_bindings": "unassigned_items",
    "region_alignment": "aligned",
    "marker_origin_counts": "explicit synthetic uncertain repaired",
    "segment_states": "manual failed",
    "export_drift": "added removed changed",
}
for _name, _columns in _COUNTS.items():
    _casts = ", ".join(f"{c}::bigint as {c}" for c in _columns.split())
    ORACLE_SQL[_name] = f"select * replace ({_casts}) from ({ORACLE_SQL[_name]})"
