"""Verdicts on a book: the six phases and the hard and soft gates of the seven modules.

A book's facts are one row of counters, gathered by map-side sums and small joins; every rule is a condition on that row, so a
verdict is a projection. Conditions are SQL text that any engine reads alike.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Codes of findings. (phase, code, severity, condition under which it is found)
PHASES = (
    (1, "phase1.no_pages", "failure", "n_pages = 0"),
    (1, "phase1.no_chapters", "failure", "n_chapters = 0"),
    (1, "phase1.chapter_missing_pages", "failure", "chapters_without_pages > 0"),
    (1, "phase1.toc_alignment_review_required", "failure", "not titles_aligned or not sections_aligned"),
    (1, "phase1.chapter_without_section_heads", "warning", "chapters_without_heads > 0"),
    (2, "phase2.note_region_missing_kind", "failure", "regions_without_kind > 0"),
    (2, "phase2.region_marker_misaligned", "failure", "regions_misaligned > 0"),
    (2, "phase2.chapter_note_mode_review_required", "failure", "chapters_to_review > 0"),
    (2, "phase2.chapter_no_notes", "warning", "chapters_without_notes > 0"),
    (3, "phase3.footnote_orphan_anchor", "failure", "footnote_orphan_anchor > 0"),
    (3, "phase3.footnote_orphan_note", "failure", "footnote_orphan_note > 0"),
    (3, "phase3.endnote_orphan_anchor", "failure", "endnote_orphan_anchor > 0"),
    (3, "phase3.endnote_orphan_note", "failure", "endnote_orphan_note > 0"),
    (3, "phase3.ambiguous_note_link", "failure", "ambiguous > 0"),
    (3, "phase3.freeze_unmatched_frozen", "failure", "unmatched_frozen > 0"),
    (3, "phase3.freeze_duplicate_injection", "failure", "duplicate_injections > 0"),
    (3, "phase3.chapter_anchor_misaligned", "failure", "chapters_misaligned > 0"),
    (3, "phase3.synthetic_anchor_warn", "warning", "synthetic_anchors > 0"),
    (3, "phase3.chapter_anchor_mismatches_warn", "warning", "chapters_mismatched > 0"),
    (4, "phase4.structure_state_not_ready", "failure", "structure_state <> 'ready'"),
    (4, "phase4.blocking_reasons_present", "failure", "blocking_reasons > 0"),
    (4, "phase4.review_required_structure", "failure", "reviews_required > 0"),
    (5, "phase5.no_translation_units", "failure", "n_units = 0"),
    (5, "phase5.unit_missing_source_text", "failure", "units_without_source > 0"),
    (5, "phase5.test_mode_mark_pending", "failure", "test_mode and units_not_marked > 0"),
    (5, "phase5.real_mode_unit_incomplete", "failure", "not test_mode and units_not_done > 0"),
    (6, "phase6.cannot_ship", "failure", "not can_ship"),
    (6, "phase6.note_ref_residual", "failure", "note_refs_left > 0"),
    (6, "phase6.chapter_coverage_mismatch", "failure", "n_chapters > 0 and chapters_exported <> n_chapters"),
    (6, "phase6.raw_marker_residual_warn", "warning", "raw_markers_left > 0"),
)
#: (module, gate, kind, reason, condition under which it holds)
MODULES = (
    (1, "toc.pages_classified", "hard", "toc_pages_unclassified", "n_pages > 0 and pages_without_role = 0"),
    (1, "toc.has_exportable_chapters", "hard", "toc_no_exportable_chapter", "n_chapters > 0"),
    (1, "toc.chapter_titles_aligned", "hard", "toc_chapter_title_mismatch", "titles_aligned"),
    (1, "toc.chapter_order_monotonic", "hard", "toc_chapter_order_non_monotonic", "chapters_out_of_order = 0"),
    (1, "toc.role_semantics_valid", "hard", "toc_role_semantics_invalid", "roles_out_of_place = 0"),
    (1, "toc.section_alignment_warn", "soft", "", "sections_aligned"),
    (1, "toc.visual_toc_conflict_warn", "soft", "", "toc_conflicts = 0"),
    (2, "book_type.resolved", "hard", "book_type_unresolved", "book_type in ('mixed', 'endnote_only', 'footnote_only', 'no_notes')"),
    (2, "book_type.chapter_modes_consistent", "hard", "book_type_chapter_modes_inconsistent", "modes_inconsistent = 0"),
    (2, "book_type.no_unapproved_review_required", "hard", "book_type_review_required_unapproved", "chapters_to_review <= reviews_approved"),
    (2, "book_type.low_confidence_warn", "soft", "", "chapters_to_review = 0"),
    (3, "split.regions_bound", "hard", "split_regions_unbound", "regions_unbound = 0"),
    (3, "split.items_extracted", "hard", "split_items_unassigned_owner", "regions_empty = 0 and items_unassigned = 0 and notes_captured"),
    (3, "split.body_note_disjoint", "hard", "split_body_note_overlap", "body_note_overlaps = 0"),
    (3, "split.cross_page_continuity_ok", "hard", "split_cross_page_continuity_missing", "chapters_without_pages = 0"),
    (3, "split.policy_applied", "hard", "split_policy_missing", "chapters_without_policy = 0"),
    (3, "split.footnote_only_synthesized", "hard", "split_footnote_only_synthesis_failed", "book_type <> 'footnote_only' or markers_not_renumbered = 0"),
    (3, "split.mixed_marker_materialized", "hard", "split_mixed_marker_materialization_failed", "true"),
    (4, "link.first_marker_is_one", "hard", "link_first_marker_not_one", "chapters_not_from_one = 0"),
    (4, "link.endnotes_all_matched", "hard", "link_endnote_not_all_matched", "chapters_not_all_matched = 0"),
    (4, "link.no_ambiguous_left", "hard", "link_ambiguous_remaining", "ambiguous = 0"),
    (4, "link.no_orphan_note", "hard", "link_orphan_note_remaining", "endnote_orphan_note = 0"),
    (4, "link.endnote_only_no_orphan_anchor", "hard", "link_endnote_only_orphan_anchor_remaining", "book_type <> 'endnote_only' or endnote_orphan_anchor = 0"),
    (4, "link.contract_first_marker_is_one", "hard", "contract_first_marker_not_one", "chapters_not_from_one = 0"),
    (4, "link.no_marker_gap", "hard", "contract_marker_gap", "chapters_with_gap = 0"),
    (4, "link.def_anchor_aligned", "hard", "contract_def_anchor_mismatch", "chapters_misaligned = 0"),
    (4, "link.quality_ok", "hard", "link_quality_low", "footnote_orphan_anchor + endnote_orphan_anchor <= 10 and 10 * (footnote_orphan_note + endnote_orphan_note) <= 3 * n_notes"),
    (4, "link.footnote_orphan_anchor_warn", "soft", "", "footnote_orphan_anchor = 0"),
    (4, "link.synthetic_anchor_warn", "soft", "", "synthetic_anchors = 0"),
    (5, "freeze.only_matched_frozen", "hard", "freeze_only_matched_violation", "unmatched_frozen = 0"),
    (5, "freeze.no_duplicate_injection", "hard", "freeze_duplicate_injection", "duplicate_injections = 0"),
    (5, "freeze.accounting_closed", "hard", "freeze_accounting_unclosed", "injected + skipped = n_matched"),
    (5, "freeze.all_matched_refs_injected", "hard", "freeze_matched_ref_not_injected", "skipped = 0"),
    (5, "freeze.unit_contract_valid", "hard", "freeze_unit_contract_invalid", "units_without_source = 0"),
    (5, "freeze.synthetic_skip_warn", "soft", "", "skipped_synthetic = 0"),
    (5, "freeze.conflict_skip_warn", "soft", "", "skipped = skipped_synthetic"),
    (6, "merge.chapter_files_emitted", "hard", "merge_chapter_files_emitted_failed", "chapters_exported = n_chapters"),
    (6, "merge.local_refs_closed", "hard", "merge_local_refs_unclosed", "chapters_with_open_refs = 0"),
    (6, "merge.no_frozen_ref_leak", "hard", "merge_frozen_ref_leak", "note_refs_left = 0"),
    (6, "merge.no_raw_marker_leak_in_body", "hard", "merge_raw_marker_leak", "raw_markers_left = 0"),
    (6, "merge.image_tail_warn", "soft", "", "image_tails = 0"),
    (6, "merge.section_heading_warn", "soft", "", "headings_inside = 0"),
    (7, "export.order_follows_toc", "hard", "export_order_not_follow_toc", "chapters_exported = n_chapters and chapters_out_of_order = 0"),
    (7, "export.semantic_contract_ok", "hard", "export_semantic_contract_broken", "sections_aligned and titles_aligned"),
    (7, "export.audit_can_ship", "hard", "export_audit_blocking", "can_ship"),
    (7, "export.no_cross_chapter_contamination", "hard", "export_cross_chapter_contamination", "chapters_swallowing_next = 0"),
    (7, "export.no_raw_marker_leak_book_level", "hard", "export_raw_marker_leak", "raw_markers_left = 0 and note_refs_left = 0"),
)


def found(phase: int) -> Column:
    """array<struct<phase, code, severity>> of what a phase finds, together with all phases before it."""
    rules = [F.when(F.expr(on), F.struct(F.lit(p).alias("phase"), F.lit(code).alias("code"), F.lit(severity).alias("severity"))) for p, code, severity, on in PHASES if p <= phase]
    return F.filter(F.array(*rules), lambda x: x.isNotNull())


def judged(facts: DataFrame, key: list[str]) -> DataFrame:
    """One row per book and phase: whether it passes, the codes of its failures and warnings."""
    codes = lambda a, severity: F.transform(F.filter(a, lambda x: x["severity"] == severity), lambda x: x["code"])
    every = F.array(*(F.struct(F.lit(p).alias("phase"), found(p).alias("found")) for p in range(1, 7)))
    rows = facts.select(*key, F.explode(every).alias("v")).select(*key, "v.phase", "v.found")
    return rows.select(*key, "phase", (F.size(codes(F.col("found"), "failure")) == 0).alias("passes"), codes(F.col("found"), "failure").alias("failures"), codes(F.col("found"), "warning").alias("warnings"))


def module_gates(facts: DataFrame, key: list[str]) -> DataFrame:
    """One row per book and gate: module, gate, kind, whether it holds, and the reason where a hard one does not."""
    gates = F.array(*(F.struct(F.lit(m).alias("module"), F.lit(g).alias("gate"), F.lit(k).alias("kind"), F.expr(on).alias("holds"), F.lit(why).alias("why")) for m, g, k, why, on in MODULES))
    rows = facts.select(*key, F.explode(gates).alias("g")).select(*key, "g.*")
    return rows.select(*key, "module", "gate", "kind", "holds", F.when(~F.col("holds") & (F.col("kind") == "hard"), F.col("why")).alias("reason"))


def snapshot(facts: DataFrame, key: list[str]) -> DataFrame:
    """One row per book: the first module that does not hold, all reasons in module order, whether the book can ship."""
    rows = module_gates(facts, key).where("kind = 'hard'")
    out = rows.groupBy(*key).agg(F.min(F.when(~F.col("holds"), F.col("module"))).alias("stops_at"), F.array_sort(F.collect_list(F.when(~F.col("holds"), F.struct("module", "gate", "reason")))).alias("_r"))
    return out.select(*key, "stops_at", F.transform("_r", lambda x: x["reason"]).alias("reasons"), F.col("stops_at").isNull().alias("ready"))
