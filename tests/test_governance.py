"""Governance from artifacts' texts and files: results written out by hand."""

from __future__ import annotations

import json

from brasswork.operators import governance
from brasswork.plans import evaluation, governing
from brasswork.plans.relation import Relation
from tests.test_delivery import EVENT, SHARE
from tests.test_evaluation import layers

SCHEMA = "report_id string, generated_at string, environment string, " + ", ".join(f"{k}_path string, {k}_text string" for k in governance.INPUTS)
EVALUATION = {
    "pipeline_run_id_filter": "r", "bronze": {"metrics": {"parse_success_rate": 0.5455}}, "silver": None, "gold": {"metrics": {"export_ready_rate": "much", "classification_success_rate": 1, "schema_version_distribution": {"v0.2.0": 1, "v0.1.0": 2}}},
    "traceability": {"gold_to_silver_link_rate": 1.0, "pipeline_run_id_coverage": 0.5, "orphaned_gold_count": 2, "orphaned_silver_count": 0}, "bootstrap_path_detected": True, "all_observations": list("abcdefg"),
}
HANDOFF = {"pipeline_run_id": "q", "total_records_processed": 9, "total_eligible": 8, "total_exported": 1, "total_quarantined": 5, "total_contract_blocked": 2, "total_skipped_not_export_ready": None, "contract_blocked_document_ids": ["x"], "quarantined_document_ids": None}
QUEUE = {"pipeline_run_id": "r", "schema_version": "v0.3.0", "total_records_reviewed": 10, "total_entries": 2, "entries_by_reason": {"quarantined": 2, "contract_blocked": 0}}


def passes(spark, *cases):
    """A case: (id, environment, evaluation, handoff, bundle, queue)."""
    made = [(k, "then", env, *[x for name, t in zip(governance.INPUTS, texts) for x in (None if t is None else f"{name}.json", t if t is None or isinstance(t, str) else json.dumps(t))]) for k, env, *texts in cases]
    return governance.governed(Relation()).on(spark.createDataFrame(made, SCHEMA))


def test_reports(spark):
    found = passes(spark, ("all", "dev", EVALUATION, HANDOFF, {"batch_id": "b"}, QUEUE), ("none", "lab", None, None, None, None), ("void", "prod", " {} ", "{cut", "[1]", {"total_entries": 0, "total_records_reviewed": 0, "entries_by_reason": [1]}))
    got = {r.governance_report_id: r for r in governance.reports(found).collect()}
    whole = got["all"]
    assert len(whole) == 12 and whole.schema_version == "v1.0.0" and whole.reporting_scope.input_pipeline_run_ids == ["r", "q"] and whole.reporting_scope.handoff_bundle_path == "bundle.json"
    q = whole.quality_summary
    assert (q.bronze_parse_success_rate, q.silver_extraction_validity_rate, q.gold_export_ready_rate, q.gold_classification_success_rate, q.traceability_silver_to_bronze_link_rate, q.traceability_orphaned_gold_count) == (0.5455, None, None, 1.0, None, 2)
    assert len(q.quality_observations) == 6 and q.quality_observations[0].startswith("Bootstrap path detected: ") and q.quality_observations[1:] == list("abcde")
    h = whole.handoff_health
    assert (h.export_success_rate, h.quarantine_rate, h.contract_block_rate, h.total_skipped_not_export_ready, h.contract_blocked_document_ids, h.quarantined_document_ids) == (0.125, 0.625, 0.25, None, ["x"], [])
    assert whole.review_queue_summary.entries_by_reason == {"contract_blocked": 0, "quarantined": 2} and whole.review_queue_summary.review_queue_pressure_pct == 0.2
    d = whole.schema_drift
    assert d.schema_versions_detected == ["v0.1.0", "v0.2.0", "v0.3.0"] and d.mixed_schema_versions and d.environment_names_detected == ["dev"] and len(d.missing_provenance_fields) == 2 and len(d.drift_observations) == 2
    assert d.unexpected_routing_combinations == ["More than 50% of eligible records quarantined (5/8) — review classification taxonomy and routing logic."]
    assert [(f.severity, f.signal) for f in whole.governance_flags] == [
        ("warning", "bronze_parse_success_below_threshold"), ("critical", "orphaned_gold_records_detected"), ("warning", "mixed_schema_versions_detected"), ("warning", "missing_provenance_fields"), ("warning", "unexpected_routing_combinations"),
        ("warning", "review_queue_pressure_elevated"), ("info", "contract_blocked_records_present"), ("warning", "low_export_success_rate"),
    ]
    # 54.55 lies below its decimal, so it rounds down; flags have their category.
    assert whole.governance_flags[0].detail.startswith("Bronze parse success rate 54.5% is below the 90% threshold.") and whole.governance_flags[1].category == "traceability_defect" and whole.overall_health_status == "critical"
    none = got["none"]
    assert none.overall_health_status == "healthy" and none.governance_flags == [] and none.reporting_scope.input_pipeline_run_ids == [] and none.quality_summary.bootstrap_path_detected is False
    assert none.quality_summary.quality_observations == ["No evaluation report available for this governance pass."] and none.handoff_health.handoff_observations == ["No handoff batch report available for this governance pass."] and none.review_queue_summary.review_queue_observations == ["No review queue artifact available for this governance pass."]
    assert none.schema_drift.drift_observations == ["Environment 'lab' is not in the bounded environment vocabulary ['dev', 'prod', 'staging']. Use 'dev', 'staging', or 'prod'."] and none.governance_notes[1].startswith("No input artifacts provided.")
    void = got["void"]
    assert void.quality_summary.quality_observations == ["No evaluation report available for this governance pass."] and void.handoff_health.total_exported is None and void.reporting_scope.handoff_bundle_path == "bundle.json"
    assert void.review_queue_summary.review_queue_observations == ["No records required human review in this batch."] and void.review_queue_summary.review_queue_pressure_pct is None and void.review_queue_summary.entries_by_reason == {}
    lines = next(r.t for r in found.where("report_id = 'all'").select(governance.text().alias("t")).collect()).split("\n")
    assert lines[3:8] == ["  Report ID        : all", "  Generated at     : then", "  Environment      : dev", "  Schema version   : v1.0.0", "  Health status    : CRITICAL"]
    for line in ("  Pipeline run IDs       : r, q", "  Bronze parse success rate      : 54.5%", "  Silver extraction validity     : N/A", "  Orphaned Gold records          : 2", "  Bootstrap path detected        : YES", "    [note] a", "    contract_blocked: 0", "  Schema versions detected  : ['v0.1.0', 'v0.2.0', 'v0.3.0']", "  Governance Flags (8 total)", "  [CRITICAL] traceability_defect / orphaned_gold_records_detected", "  Total skipped             : N/A"):
        assert line in lines, line
    bare = next(r.t for r in found.where("report_id = 'none'").select(governance.text().alias("t")).collect()).split("\n")
    assert "  Evaluation report      : not provided" in bare and "  Missing provenance fields : ['none']" in bare and "  No governance flags raised. All thresholds met." in bare and not any(x.startswith("  Pipeline run IDs") for x in bare)


def test_health_from_written_files(spark, tmp_path):
    """What governance reads from a stored evaluation is what the layers gave; artifacts that aren't there are absent."""
    out = str(tmp_path / "out")
    whole = evaluation.evaluate(spark, layers(tmp_path), out, "then", run_id="run")
    (tmp_path / "queue.json").write_text(json.dumps(QUEUE))
    given = [("g 1", "then", "dev", f"{out}/report_run.json", str(tmp_path / "nowhere.json"), None, f"file:{tmp_path}/queue.json"), ("g2", "then", "dev", None, None, None, None)]
    reports = {r.governance_report_id: r for r in governing.govern(spark.createDataFrame(given, "report_id string, generated_at string, environment string, " + ", ".join(f"{k}_path string" for k in governance.INPUTS)), str(tmp_path / "reports")).collect()}
    q, trace = reports["g 1"].quality_summary, json.loads(whole["traceability"]["metrics"])
    assert q.bronze_parse_success_rate == json.loads(whole["bronze"]["metrics"])["parse_success_rate"] == 0.9 and q.silver_extraction_validity_rate == 0.75 and (q.traceability_gold_to_silver_link_rate, q.traceability_orphaned_gold_count) == (trace["gold_to_silver_link_rate"], 1)
    assert q.bootstrap_path_detected and q.quality_observations[1:] == whole["all_observations"] and reports["g 1"].handoff_health.total_exported is None and reports["g 1"].overall_health_status == "critical" and reports["g2"].overall_health_status == "healthy"
    found = json.load(open(tmp_path / "reports" / "governance_report_g_1.json"))
    assert len(found) == 12 and found["quality_summary"]["traceability_orphaned_gold_count"] == 1 and found["handoff_health"]["total_exported"] is None and (tmp_path / "reports" / "governance_report_g2.txt").read_text().startswith("=" * 72)


def test_deliveries_from_files(spark, tmp_path):
    (tmp_path / "bundle.json").write_text("{}")
    for name, bundle in (("a", "bundle.json"), ("b", "lost.json")):
        (tmp_path / f"{name}.json").write_text(json.dumps(EVENT | {"bundle_artifact_path": str(tmp_path / bundle)}))
    (tmp_path / "share.json").write_text(json.dumps(SHARE))
    made = [(k, "then", "r", None, "local_repo_only", str(tmp_path / f"{k}.json"), str(tmp_path / "share.json")) for k in ("a", "b", "c")]
    given = spark.createDataFrame(made, "validation_run_id string, validated_at string, pipeline_run_id string, expected_event_id string, workspace_mode string, event_path string, manifest_path string")
    got = {r.validation_run_id: r for r in governing.validate(given, "share", "gold", str(tmp_path / "out")).collect()}
    assert {k: (r.validation_status, len(r.checks_failed)) for k, r in got.items()} == {"a": ("not_provisioned", 0), "b": ("not_provisioned", 1), "c": ("failed", 9)}
    assert json.load(open(tmp_path / "out" / "delivery_validation_b.json"))["checks_failed"] == ["bundle_path_exists"]
