"""Classification, routing, contract, outcomes."""

from __future__ import annotations

import json

from brasswork.functions import vocab as V
from brasswork.operators import batch, evaluate
from brasswork.operators.contract import gate, quarantine_errors, validated
from brasswork.operators.gold import classified, ready, routed
from brasswork.plans.relation import Relation

GOOD = {
    "document_id": "d", "source_file": "a.txt", "document_type": V.LETTER, "routing_label": "regulatory_review",
    "extracted_fields": {"issuing_office": "x", "recipient_company": "c", "issue_date": "2024-01-01", "violation_type": ["a"], "corrective_action_requested": True},
    "parsed_text_excerpt": "", "provenance": {"ingested_at": "x", "pipeline_run_id": "r", "extraction_model": "m", "classification_model": "c", "classification_confidence": None, "schema_version": "v0.1.0"},
}


def errors(spark, payload):
    df = spark.createDataFrame([(payload if isinstance(payload, str) else json.dumps(payload),)], "export_payload string")
    return validated(Relation()).on(df).first().contract_found


def changed(**more):
    return {**GOOD, **more}


def test_good_payload(spark):
    assert errors(spark, GOOD) == []


def test_missing_keys_come_alone(spark):
    bad = {k: v for k, v in GOOD.items() if k not in ("routing_label", "provenance")} | {"document_id": ""}
    assert errors(spark, bad) == ["Missing required field: 'routing_label'", "Missing required field: 'provenance'"]


def test_missing_null_and_wrong_fields(spark):
    fields = {**GOOD["extracted_fields"], "violation_type": [], "corrective_action_requested": "yes", "issue_date": None}
    del fields["issuing_office"]
    assert errors(spark, changed(extracted_fields=fields)) == [
        "Missing required FDA warning letter extracted_field: 'issuing_office'",
        "Required FDA warning letter extracted_field 'issue_date' is null",
        "'violation_type' must be a non-empty array of violation category strings",
        "'corrective_action_requested' must be a boolean",
    ]


def test_provenance(spark):
    p = {**GOOD["provenance"], "classification_confidence": 1.5, "ingested_at": None}
    del p["schema_version"]
    found = errors(spark, changed(provenance=p))
    assert found[0].startswith("Required provenance field 'ingested_at' is null") and found[1] == "Missing required provenance field: 'schema_version'" and found[2].endswith("1.5 out of range [0.0, 1.0]")
    assert errors(spark, changed(provenance={**GOOD["provenance"], "classification_confidence": True})) == []
    assert errors(spark, changed(provenance=7)) == ["'provenance' must be an object"]


def test_blank_and_bans(spark):
    assert errors(spark, changed(document_id=" \n")) == ["'document_id' must be a non-empty string"]
    assert "quarantine" in errors(spark, changed(routing_label="quarantine"))[0]
    assert errors(spark, changed(document_type="other", extracted_fields={})) == []


def test_signals_and_routes(spark):
    schema = "document_class_hint string, validation_status string, field_coverage_pct double, signals int, document_id string"
    df = spark.createDataFrame([(V.INCIDENT, "valid", 1.0, 4, "a"), (None, "partial", 0.6, 2, "b"), (V.INCIDENT, "partial", 0.4444, 2, "c"), (None, "valid", 0.1, 1, "d"), (None, "partial", 0.7, 3, "e")], schema)
    got = Relation().add(lambda d: classified(d, V.INCIDENT)).add(routed).add(ready).on(df).collect()
    assert [(r.classification_confidence, r.routing_label, r.export_ready) for r in got] == [
        (1.0, "incident_management", True), (0.6, "quarantine", False), (0.8, "quarantine", False), (0.0, "quarantine", False), (0.7, "incident_management", True),
    ]


def test_gate_and_outcomes(spark):
    bad = json.dumps(changed(document_id=""))
    schema = "id string, export_payload string, export_ready boolean, routing_label string"
    df = spark.createDataFrame([("a", json.dumps(GOOD), True, "regulatory_review"), ("b", bad, True, "regulatory_review"), ("c", bad, False, "quarantine"), ("d", bad, False, "security_ops")], schema)
    got = {r.id: (r.export_ready, r.outcome_category, r.outcome_reason) for r in gate(df).collect()}
    assert got == {"a": (True, "exported", "none"), "b": (False, "contract_blocked", "contract_validation_failed"), "c": (False, "quarantined", "routing_quarantine"), "d": (False, "skipped_not_export_ready", "export_not_attempted")}
    report = Relation().agg((), batch.report).on(gate(df)).first()
    assert (report.total_exported, report.total_export_attempts, report.reason_export_not_attempted) == (1, 2, 1)


def test_quarantine_shape(spark):
    df = spark.createDataFrame([(False, "quarantine", None), (None, "x", "p")], "export_ready boolean, routing_label string, export_path string")
    a, b = Relation().add(quarantine_errors).on(df).collect()
    assert a.quarantine_errors == [] and len(b.quarantine_errors) == 3


def test_nearest_rank(spark):
    df = spark.createDataFrame([(float(x),) for x in (5, 1, 4, 2, 3, 3, None)] if False else [(x,) for x in (5.0, 1.0, 4.0, 2.0, 3.0, 3.0, None)], "v double")
    for p in (1, 10, 25, 50, 99, 100):
        got = evaluate.nearest(Relation(), "v", {"p": p}).on(df).first().p
        values = [1.0, 2.0, 3.0, 3.0, 4.0, 5.0]
        assert got == values[max(0, int(6 * p / 100) - 1)], p


def test_empty_tables(spark):
    none = spark.createDataFrame([], "parse_status string, char_count long")
    r = Relation().agg((), evaluate.bronze_metrics).on(none).first()
    assert r.total_documents == 0 and r.parse_success_rate is None
