"""Notes, texts, decisions, constraints, strategies, prompts, stored layers: results written out by hand."""

from __future__ import annotations

import json

import pytest

from brasswork.functions import prompts
from brasswork.functions.registry import DomainNotFound, DomainNotImplemented
from brasswork.operators import bronze, notes, review, silver, strategies
from brasswork.plans import bootstrap
from brasswork.plans.relation import Relation
from brasswork.sources import artifacts, layers, sinks

COUNTS = "total_records_processed int, total_ineligible_skipped int, total_eligible int, total_exported int, total_quarantined int, total_contract_blocked int, total_skipped_not_export_ready int, report_attached boolean, path_source string, contract_source string, manifest_version string, pipeline_run_id string, processed_at string, review_notes array<string>"


def rows(spark, relation, data, schema):
    return relation.on(spark.createDataFrame(data, schema))


def test_manifest_notes(spark):
    made = [(9, 2, 7, 3, 2, 1, 1, True, "rule", "contract", "v0.1.0", "r", "t", []), (0, 0, 0, 0, 0, 0, 0, False, "rule", "contract", "v0.1.0", "r", "t", [])]
    got = [r.review_notes for r in rows(spark, Relation().add(notes.manifest_notes), made, COUNTS).collect()]
    assert got[0][:3] == [
        "Batch processed 9 record(s): 7 eligible, 2 ineligible/skipped before classification.",
        "Export outcomes: 3 exported, 2 quarantined, 1 contract-blocked, 1 skipped.",
        "3 record(s) successfully written as Bedrock handoff artifact(s). Export paths are in exported_records[].export_artifact_path.",
    ]
    assert len(got[0]) == 9 and got[0][6].startswith("B-4 HandoffBatchReport is attached") and got[0][8] == "Manifest schema version: v0.1.0. Authoritative contract: contract."
    assert len(got[1]) == 5 and got[1][2].startswith("B-4 HandoffBatchReport was not generated")


def test_manifest_text(spark):
    manifest = spark.createDataFrame([(2, 0, 2, 1, 1, 0, 0, True, "rule", "contract", "v0.1.0", "r", "t", ["first", "second"])], COUNTS)
    refs = spark.createDataFrame([("exported", "a", "ops", "exported", "none", "gold/a", "exports/a"), ("quarantined", "b", "quarantine", "quarantined", "routing_quarantine", None, None)], "list_name string, document_id string, routing_label string, outcome_category string, outcome_reason string, gold_artifact_path string, export_artifact_path string")
    # A relation over a table of its own stands for the references.
    refs.createOrReplaceTempView("refs_of_test")
    text = notes.bundle_lines(Relation(), Relation(table="refs")).on(manifest, lambda r: r.on(spark.table("refs_of_test")))
    lines = [r.line for r in text.orderBy("place", "key", "line").collect()]
    assert lines[lines.index("--- Exported Records (1) ---") :] == [
        "--- Exported Records (1) ---", "  document_id : a", "       routing    : ops", "       outcome    : exported / none", "       gold       : gold/a", "       export     : exports/a", "",
        "--- Quarantined Records (1) ---", "  document_id : b", "       routing    : quarantine", "       outcome    : quarantined / routing_quarantine", "",
        "--- Contract Blocked Records (0) ---", "  (none)", "", "--- Skipped Records (0) ---", "  (none)", "--- Review Notes ---", "  - first", "  - second",
    ]
    assert lines[:5] == ["=== Handoff Batch Review Bundle (B-5) ===", "Manifest Version   : v0.1.0", "Batch ID           : r", "Pipeline Run ID    : r", "Generated At       : t"]


def test_governance_notes(spark):
    schema = "environment string, overall_health string, flags array<string>, has_evaluation boolean, has_handoff boolean, has_bundle boolean, has_queue boolean"
    made = [("dev", "critical", ["critical:a", "warning:b", "warning:c", "info:d"], True, False, True, False), ("prod", "healthy", [], False, False, False, False)]
    got = [r.governance_notes for r in rows(spark, Relation().add(notes.governance_inputs).add(notes.governance_notes), made, schema).collect()]
    assert got[0][:3] == ["Governance report generated for environment: 'dev'. Overall health status: CRITICAL.", "Input artifacts consumed: evaluation report (A-4), handoff bundle manifest (B-5).", "4 governance flag(s) derived: 1 critical, 2 warning, 1 info."]
    assert got[1][1].startswith("No input artifacts provided.") and got[1][2] == "0 governance flag(s) derived: 0 critical, 0 warning, 0 info." and len(got[1]) == 5


def test_decisions(spark):
    schema = "decision_id string, queue_entry_id string, document_id string, pipeline_run_id string, decided_at string, decision string, decision_rationale string, reprocessing_request_id string"
    made = [("d", "q", "x", "r", "t", "confirm_quarantine", "why", None), ("d", "q", "x", "r", "t", "request_reprocessing", "why", ""), ("", None, "x", "r", "t", "escalate", "", None), ("d", "q", "x", "r", "t", None, "why", None)]
    got = review.checked(spark.createDataFrame(made, schema)).collect()
    known = "('approve_for_export', 'confirm_quarantine', 'request_reprocessing', 'reject_unresolved')"
    assert [r.decision_errors for r in got] == [
        [],
        ["reprocessing_request_id is required when decision == 'request_reprocessing'."],
        ["decision_id is required.", "queue_entry_id is required.", "decision_rationale is required and must not be empty.", f"decision 'escalate' is not a valid review decision. Must be one of: {known}."],
        [f"decision 'None' is not a valid review decision. Must be one of: {known}."],
    ]
    assert [(r.is_actionable, r.is_terminal) for r in got] == [(False, True), (True, False), (False, False), (False, False)]


def test_constraints(spark):
    good = ("." + "txt", "a" * 64, "success", None, "t", 1, 1)
    schema = "file_extension string, file_hash string, parse_status string, parse_failure_reason string, parsed_text string, char_count int, file_size_bytes int"
    made = [good, (None, None, None, None, None, None, None), (".pdf", "A" * 64, "failed", None, "t", None, 0), (".md", "a", "partial", None, "", None, 3)]
    assert [r.constraint_violations for r in bronze.violations(spark.createDataFrame(made, schema)).collect()] == [[], ["extension", "file_hash", "parse_status", "file_size_bytes"], ["failed_shape", "file_size_bytes"], ["file_hash", "char_count"]]
    schema = "validation_status string, has_fields boolean, field_coverage_pct double, document_id string, bronze_record_id string, extraction_id string, pipeline_run_id string"
    made = [("valid", True, 1.0, "a", "b", "c", "r"), ("valid", None, 0.5, "a", "b", "c", None), ("invalid", False, 0.0, "a", "b", "c", "r"), (None, None, None, None, "b", "c", "r"), ("lost", True, -0.1, "a", "b", "c", "r")]
    assert [r.constraint_violations for r in rows(spark, Relation().add(silver.constraints), made, schema).collect()] == [[], ["valid_without_fields", "pipeline_run_id"], [], ["validation_status", "field_coverage_pct", "document_id"], ["validation_status", "field_coverage_pct"]]


def test_strategies_and_prompts(spark):
    assert strategies.parser("a/B.TXT") is strategies.LOCAL_PARSER and strategies.parser("x.pdf").remote and strategies.parser("x").remote
    with pytest.raises(strategies.RemoteOnly):
        strategies.parser("x.docx").apply(spark.range(1))
    with pytest.raises(strategies.RemoteOnly):
        strategies.classifier(None, remote=True).apply(spark.range(1))
    with pytest.raises(DomainNotFound):
        strategies.extractor("poem")
    with pytest.raises(DomainNotImplemented):
        strategies.classifier("quality_audit_record")
    found = strategies.extractor("incident_report").apply(spark.createDataFrame([("Severity: high\nStatus: open\n",)], "parsed_text string")).first()
    assert (found.severity, found.status) == ("High", "open")
    assert prompts.ids() == ["cisa_advisory_extract_v1", "fda_warning_letter_extract_v1", "incident_report_extract_v1"]
    assert prompts.for_domain("incident_report").render("a {b}").endswith("Text:\na {b}") and "- severity (string, required)" in prompts.prompt("incident_report_extract_v1").template
    with pytest.raises(KeyError):
        prompts.prompt("none")
    with pytest.raises(DomainNotImplemented):
        prompts.for_domain("quality_audit_record")


def test_stored_layers(spark, tmp_path):
    (tmp_path / "a.txt").write_text("District Office: Chicago District.\nDate: March 3, 2024\nIssued to:\nJane Q. Porter\nVice President\nCustomer 1 Pharmaceuticals Inc.\n\nViolation 1: Failure to keep records.\nCorrective action is needed within fifteen (15) working days.\n")
    (tmp_path / "b.txt").write_text("")
    names = bootstrap.create_tables(spark, str(tmp_path))
    assert {r.file_name: r.file_size_bytes > 0 for r in spark.table(names["bronze"]).collect()} == {"a.txt": True, "b.txt": False}
    got = {r.file_name: r for r in spark.sql(f"SELECT file_name, document_type_label, routing_label, export_ready, classification_confidence, try_variant_get(export_payload, '$.issue_date', 'string') AS issued FROM {names['gold']}").collect()}
    assert tuple(got["a.txt"])[1:] == ("fda_warning_letter", "regulatory_review", True, None, "2024-03-03")
    assert [r.constraint_violations for r in bronze.violations(bronze.bronze(bronze.admitted(bronze.scan_files(spark, str(tmp_path)))[0], "r")).orderBy("file_name").collect()] == [[], ["file_size_bytes"]]
    again = bootstrap.create_tables(spark, str(tmp_path))
    assert again == names and spark.table(names["gold"]).count() == 2


def test_layers_follow_their_input(spark, tmp_path):
    path = str(tmp_path / "t.parquet")
    spark.range(3).write.parquet(path)
    relation = Relation("t").layer("test-layer")
    assert relation.frame(spark, str(tmp_path)).count() == 3
    assert layers.stored(spark, str(tmp_path), "test-layer") is not None
    spark.range(5).write.mode("overwrite").parquet(path)
    assert relation.frame(spark, str(tmp_path)).count() == 5


def test_empty_artifacts(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"n": 1}')
    (tmp_path / "b.json").write_text("")
    (tmp_path / "c.txt").write_text("")
    with pytest.raises(ValueError, match="b.json"):
        artifacts.scan(spark, "n int", folder=str(tmp_path))
    good, skipped = artifacts.tolerant(spark, "n int", str(tmp_path))
    assert [r.n for r in good.collect()] == [1] and [r[0].rsplit("/", 1)[-1] for r in skipped.collect()] == ["b.json"]


def test_reload():
    event = {"delivery_event_id": "e", "pipeline_run_id": "r", "batch_id": "r", "generated_at": "t", "status": "prepared", "schema_version": "v0.2.0"}
    assert sinks.reload(json.dumps(event), "delivery_event") == event
    with pytest.raises(ValueError, match="status='sent'"):
        sinks.reload(json.dumps(event | {"status": "sent"}), "delivery_event")
    with pytest.raises(ValueError, match="missing keys: checks"):
        sinks.reload(json.dumps({"batch_id": "r", "validation_status": "failed"}), "validation_result")
