"""Delivery validation from the artifacts' texts: results written out by hand."""

from __future__ import annotations

import json
import os

from brasswork.operators import delivery
from brasswork.plans.relation import Relation
from brasswork.sources import files

SCHEMA = "validation_run_id string, validated_at string, pipeline_run_id string, expected_event_id string, workspace_mode string, event_path string, event_text string, manifest_path string, manifest_text string, bundle_exists boolean"
EVENT = {"delivery_event_id": "e", "pipeline_run_id": "r", "batch_id": "r", "generated_at": "t", "eligible_record_count": 3, "exported_record_count": 2, "quarantined_record_count": 1, "contract_blocked_count": 0, "routing_labels": ["a", "b"], "bundle_artifact_path": "b.json", "schema_version": "v0.2.0"}
SHARE = {"status": "designed", "setup_sql": "CREATE SHARE s", "c2_validation_queries": [{"name": "q"}]}


def results(spark, *cases):
    """By id; a case is (id, workspace, event, manifest, bundle_exists, expected id)."""
    made = [(k, "then", "r", expected, mode, "event.json", e if e is None or isinstance(e, str) else json.dumps(e), "share.json", m if m is None or isinstance(m, str) else json.dumps(m), bundle) for k, mode, e, m, bundle, expected in cases]
    return delivery.results(delivery.validated(Relation()).on(spark.createDataFrame(made, SCHEMA)), "share", "gold")


def test_statuses(spark):
    local, own = "local_repo_only", "personal_databricks"
    given = SHARE | {"status": "provisioned"}
    rows = results(
        spark,
        ("fine", own, EVENT, given, True, "e"), ("half", local, EVENT, given, True, None), ("none", local, EVENT, SHARE, True, None), ("unset", None, EVENT, SHARE, False, None),
        ("unsure", own, EVENT, given, False, None), ("lost", local, None, None, None, "e"), ("cut", local, '{"a":', "[1]", True, None), ("closed", own, EVENT | {"delivery_mechanism": "email", "status": "sent"}, given, True, None),
        ("typed", own, EVENT | {"exported_record_count": "2", "eligible_record_count": 3.0, "share_name": None}, given, True, None), ("wrong", own, EVENT | {"exported_record_count": -2, "eligible_record_count": 1.5, "batch_id": 7, "routing_labels": ["a", None]}, given, True, None),
        ("ids", own, EVENT | {"pipeline_run_id": "q"}, given, True, "f"), ("empty", own, EVENT | {"routing_labels": []}, {"setup_sql": " \n", "c2_validation_queries": {"a": 1}}, True, None), ("idle", own, EVENT | {"routing_labels": [], "exported_record_count": 0}, given, True, None),
    ).collect()
    got = {r.validation_run_id: r for r in rows}
    assert {k: r.validation_status for k, r in got.items()} == {"fine": "validated", "half": "partially_validated", "none": "not_provisioned", "unset": "not_provisioned", "unsure": "failed", "lost": "failed", "cut": "failed", "closed": "failed", "typed": "validated", "wrong": "failed", "ids": "failed", "empty": "failed", "idle": "validated"}
    assert len(got["fine"].checks_passed) == 15 and got["fine"].checks_failed == [] and got["fine"].checks_passed[-1] == "evidence_sufficiency" and len(rows[0]) == 18
    assert got["fine"].validation_reason.startswith("All critical producer-side checks passed. ") and got["fine"].observations[1] == "Share preparation manifest parsed: status='provisioned', c2_validation_queries=1."
    assert got["fine"].observations[0] == "Delivery event 'e' validated: schema_version=v0.2.0, status='prepared', exported_record_count=2, routing_labels=['a', 'b']." and got["fine"].observations[-1] == "Overall validation status: 'validated'. Checks passed: 15. Checks failed: 0."
    assert got["unset"].validation_reason.endswith("baseline state. Non-critical check failures noted: ['bundle_path_exists']. ") and got["unset"].workspace_mode == "local_repo_only" and got["none"].validation_reason.endswith("baseline state. ")
    assert got["unsure"].checks_failed == ["bundle_path_exists", "evidence_sufficiency"]
    assert got["unsure"].validation_reason == "Status downgraded to 'failed': evidence sufficiency check failed. Status 'validated' claimed but 1 check(s) failed: ['bundle_path_exists']."
    assert (got["lost"].delivery_event_id, got["lost"].checks_passed, got["cut"].delivery_event_id, got["cut"].checks_passed) == ("e", ["evidence_sufficiency"], None, ["delivery_event_exists", "share_manifest_exists", "evidence_sufficiency"])
    details = {k: {c.check_name: c.detail for c in r.check_details} for k, r in got.items()}
    assert details["lost"]["delivery_event_exists"] == "Delivery event artifact not found at: event.json" and details["cut"]["share_manifest_parseable"] == "Share manifest is not a JSON object."
    assert details["closed"]["delivery_event_parseable"] == "Failed to parse delivery event: delivery_mechanism, status" and details["wrong"]["delivery_event_parseable"] == "Failed to parse delivery event: batch_id, eligible_record_count, exported_record_count, routing_labels"
    assert details["ids"]["cross_id_consistency"] == "pipeline_run_id mismatch: event has 'q', expected 'r'. | delivery_event_id mismatch: event has 'e', expected 'f'. | batch_id ('r') does not equal pipeline_run_id ('q'). C-1 design requires batch_id == pipeline_run_id."
    assert got["empty"].checks_failed == ["routing_labels_present", "share_manifest_has_setup_sql", "share_manifest_has_c2_queries", "share_provisioning_acknowledged"] and details["empty"]["routing_labels_present"] == "exported_record_count=2 but routing_labels is empty."
    assert got["empty"].observations[1] == "Share preparation manifest parsed: status='unknown', c2_validation_queries=0." and details["idle"]["routing_labels_present"].startswith("No exported records")
    assert (got["fine"].share_name, got["fine"].shared_object_name, got["typed"].share_name) == ("share", "gold", "share") and got["fine"].artifacts_checked == ["event.json", "share.json"]


def test_pair_of_files(spark, tmp_path):
    files.write(delivery.files_of(results(spark, ("a/b:c", "local_repo_only", EVENT, SHARE, True, None), ("x", "local_repo_only", None, None, None, None))), str(tmp_path / "out"))
    assert sorted(os.listdir(tmp_path / "out")) == ["delivery_validation_a_b:c.json", "delivery_validation_a_b:c.txt", "delivery_validation_x.json", "delivery_validation_x.txt"]
    found = json.load(open(tmp_path / "out" / "delivery_validation_x.json"))
    assert len(found) == 18 and found["delivery_event_id"] is None and found["check_details"][0] == {"check_name": "delivery_event_exists", "passed": False, "detail": "Delivery event artifact not found at: event.json"}
    lines = (tmp_path / "out" / "delivery_validation_a_b:c.txt").read_text().split("\n")
    assert lines[3:10] == ["Validation Run ID  : a/b:c", "Pipeline Run ID    : r", "Delivery Event ID  : e", "Validated At       : then", "Workspace Mode     : local_repo_only", "Validation Scope   : producer_side_only", "Schema Version     : v0.2.0"]
    assert lines[19] == "Status             : NOT_PROVISIONED" and "Checks Failed (0)  : []" in lines and lines[-9:-5] == ["ARTIFACTS CHECKED", "-" * 40, "  - event.json", "  - share.json"]
