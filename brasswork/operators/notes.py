"""Notes and texts for people: of manifests, review queues, governance reports.

A text is a table of lines (place, key, line): the artifact's own lines have an empty key, a record's lines its id, and a
record's lines follow one another by place. Lists of records are as long as the batch, so no row, task or driver ever
holds a whole text; records aren't numbered, which would take all of them through one task.
"""

from __future__ import annotations

from ..functions import vocab as V
from ..functions.dialect import Dialect
from .evaluate import filled


def notes(d: Dialect, texts) -> str:
    """Those of (condition, text) whose condition holds."""
    return d.compact(*[(condition, filled(d, text)) for condition, text in texts])


def manifest_notes(d: Dialect) -> dict[str, str]:
    """Needs the report's counts, report_attached, manifest_version, path_source and contract_source (what is cited)."""
    return {"review_notes": notes(d, V.MANIFEST_NOTES)}


def queue_notes(d: Dialect) -> dict[str, str]:
    """Needs the queue's counts, bundle_path, report_path and decision_source (what is cited)."""
    return {"review_notes": notes(d, V.QUEUE_NOTES)}


def governance_inputs(d: Dialect) -> dict[str, str]:
    """Which artifacts a report was made from (has_... columns), the flags by severity, and the health in capitals."""
    levels = {f"n_{k}": d.size(d.only("flags", lambda x, k=k: f"{x} LIKE '{k}:%'")) for k in ("critical", "warning", "info")}
    return {"inputs": d.join(d.compact(*[(c, d.text(t)) for c, t in V.GOVERNANCE_INPUTS]), ", "), "health": "upper(overall_health)", "n_flags": d.size("flags"), **levels}


def governance_notes(d: Dialect) -> dict[str, str]:
    return {"governance_notes": notes(d, V.GOVERNANCE_NOTES)}


def _shown(d: Dialect, texts) -> str:
    """(place, condition, template) as an array of texts that begin with their place in four digits."""
    return d.compact(*[(condition, filled(d, f"{place:04d}{text}")) for place, condition, text in texts])


def _lines(relation, make, key: str = "''", after: str = "0"):
    """A row for each of an array's texts; `after` is added to its place."""
    out = relation.add(lambda d: {"lines": make(d)}).explode("lines", "text_line")
    return out.select(lambda d: {"place": f"CAST(left(text_line, 4) AS INT) + {after}", "key": key, "line": "substr(text_line, 5)"})


def _headed(relation, texts, noted: bool = True):
    """A one-row artifact's own lines, and its notes at the end."""

    def make(d: Dialect) -> str:
        own = _shown(d, [*texts, (9000, "true", "--- Review Notes ---")] if noted else texts)
        return d.plus(own, d.each("review_notes", lambda x: f"concat('9001  - ', {x})")) if noted else own

    return _lines(relation, make)


def _always(texts) -> list[tuple[int, str, str]]:
    return [(i, "true", t) for i, t in enumerate(texts)]


def report_lines(report, records):
    """A handoff report's text: its counts, then the ids of blocked and of quarantined records, each list if it has any."""
    places = {kind: 100 * (i + 1) for i, (kind, _) in enumerate(V.REPORT_LISTS)}
    heads = [(places[k] + i, f"total_{k} > 0", t) for k, title in V.REPORT_LISTS for i, t in enumerate(("", title))]
    listed = records.where(lambda d: d.isin("outcome_category", places))
    at = " ".join(f"WHEN '{k}' THEN {p}" for k, p in places.items())
    return _headed(report, [*_always(V.REPORT_LINES), *heads], noted=False).union(_lines(listed, lambda d: _shown(d, [(2, "true", "  {document_id}")]), "document_id", f"CASE outcome_category {at} END"))


def bundle_lines(manifest, references):
    """A manifest's text: its counts, each list's references (none: said so), its notes."""
    places = {kind: 100 * (i + 1) for i, (kind, _) in enumerate(V.BUNDLE_LISTS)}
    heads = [(places[k] + i, c, t) for k, title in V.BUNDLE_LISTS for i, (c, t) in enumerate((("true", ""), ("true", f"--- {title} ({{total_{k}}}) ---"), (f"total_{k} = 0", "  (none)")))]
    shown = [
        (10, "true", "  document_id : {document_id}"),
        (11, "true", "       routing    : {routing_label}"),
        (12, "true", "       outcome    : {outcome_category} / {outcome_reason}"),
        (13, "coalesce(gold_artifact_path, '') <> ''", "       gold       : {gold_artifact_path}"),
        (14, "list_name = 'exported' AND coalesce(export_artifact_path, '') <> ''", "       export     : {export_artifact_path}"),
    ]
    at = " ".join(f"WHEN '{k}' THEN {p}" for k, p in places.items())
    return _headed(manifest, [*_always(V.BUNDLE_LINES), *heads]).union(_lines(references, lambda d: _shown(d, shown), "document_id", f"CASE list_name {at} END"))


def queue_lines(queue, entries):
    """A review queue's text: its counts, its entries (none: said so), its notes."""
    heads = [(100, "true", ""), (101, "total_entries > 0", "--- Queue Entries ---"), (101, "total_entries = 0", "  (no entries — all records exported successfully)")]
    shown = [
        (110, "true", "  document_id       : {document_id}"),
        (111, "true", "       gold_record_id    : {gold_record_id}"),
        (112, "true", "       reason_category   : {review_reason_category}"),
        (113, "true", "       document_type     : {document_type_label}"),
        (114, "true", "       routing_label     : {routing_label}"),
        (115, "coalesce(gold_artifact_path, '') <> ''", "       gold_artifact    : {gold_artifact_path}"),
        (116, "first_errors <> ''", "       contract_errors  : {first_errors}"),
    ]
    own = entries.add(lambda d: {"first_errors": f"coalesce({d.join(d.head('contract_errors', 2), '; ')}, '')", "gold_record_id": "coalesce(gold_record_id, 'n/a')"})
    return _headed(queue, [*_always(V.QUEUE_LINES), *heads]).union(_lines(own, lambda d: _shown(d, shown), "document_id"))
