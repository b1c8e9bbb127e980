"""Manifests written, read again and validated: hand-written expectations."""

from __future__ import annotations

import json

from brasswork.sources import bundles, files

BATCH = {"manifest_version": "v0.1.0", "pipeline_run_id": "run/1", "generated_at": "now", "total_records_processed": 5, "total_ineligible_skipped": 1, "total_eligible": 4, "total_exported": 1, "total_quarantined": 1, "total_contract_blocked": 1, "total_skipped_not_export_ready": 1}
DISTRIBUTION = {"exported": 1, "quarantined": 1, "contract_blocked": 1, "skipped_not_export_ready": 1}


def written(spark, tmp_path, report=None):
    gold = lambda d: f"{tmp_path}/gold/{d}.json"
    refs = [("run/1", d, f"g{d}", o, "r", route, gold(d), f"{tmp_path}/export/{d}.json" if o == "exported" else None) for d, o, route in (("a", "exported", "ops"), ("b", "quarantined", "quarantine"), ("c", "contract_blocked", "ops"), ("d", "odd", "ops"))]
    references = spark.createDataFrame(refs, f"batch_id string, {bundles.REF}")
    batches = spark.createDataFrame([("run/1", *BATCH.values(), DISTRIBUTION, report, ["note"])], "batch_id string, manifest_version string, pipeline_run_id string, generated_at string, " + ", ".join(f"{k} bigint" for k in bundles.REQUIRED[4:]) + ", outcome_distribution map<string,bigint>, report_artifacts struct<json_path:string,text_path:string>, review_notes array<string>")
    files.write(bundles.manifests(references, batches), f"{tmp_path}/bundles")
    for d in "abcd":
        (tmp_path / "gold").mkdir(exist_ok=True)
        (tmp_path / "gold" / f"{d}.json").write_text("{}")
    (tmp_path / "export").mkdir(exist_ok=True)
    (tmp_path / "export" / "a.json").write_text("")
    return bundles.read(spark, f"{tmp_path}/bundles")


def test_what_is_written_comes_back_and_passes(spark, tmp_path):
    texts = written(spark, tmp_path)
    m = bundles.parsed(texts).collect()[0].m
    assert [r.document_id for r in m.exported_records] == ["a"] and [r.document_id for r in m.skipped_records] == ["d"] and m.outcome_distribution == DISTRIBUTION and m.review_notes == ["note"]
    r = bundles.results(texts).collect()[0]
    # d has an unknown outcome and counts as skipped, so that list's category is wrong, as written.
    assert (r.checks_run, r.checks_passed, r.bundle_valid, r.failed_checks) == (23, 22, False, ["skipped_records_correct_outcome_category"])
    assert r.contradictions == ["skipped_records contains records with wrong outcome_category (expected 'skipped_not_export_ready'): ['d']"] and r.observations == ["1" + bundles.BLOCKED]
    r = bundles.results(texts, paths=False).collect()[0]
    assert (r.checks_run, r.checks_failed, r.batch_id) == (19, 1, "run/1") and r.observations == ["1" + bundles.BLOCKED, bundles.SKIPPED]


def test_missing_files(spark, tmp_path):
    report = (f"{tmp_path}/report.json", f"{tmp_path}/report.txt")
    texts = written(spark, tmp_path, report)
    (tmp_path / "report.txt").write_text("here")
    (tmp_path / "gold" / "b.json").unlink()
    (tmp_path / "export" / "a.json").unlink()
    r = bundles.results(texts, validated_at="then").collect()[0]
    assert r.failed_checks[1:] == ["report_artifact_json_exists", "gold_artifact_paths_exist", "export_artifact_paths_exist"]
    assert r.missing_paths == [f"report_artifacts.json_path: {tmp_path}/report.json", f"gold_artifact_path: {tmp_path}/gold/b.json", f"export_artifact_path: {tmp_path}/export/a.json"]
    said = {c.check_name: c.detail for c in r.check_results}
    assert said["gold_artifact_paths_exist"] == "1 gold artifact path(s) not found on disk" and said["report_artifact_text_exists"] is None and said["report_artifact_json_exists"] == f"report_artifacts.json_path path not found on disk: {tmp_path}/report.json"
    pair = {x.name: x.content for x in bundles.texts_of(bundles.results(texts, validated_at="then")).collect()}
    assert json.loads(pair["bundle_validation_run_1.json"])["checks_run"] == 23
    lines = pair["bundle_validation_run_1.txt"].split("\n")
    assert lines[:9] == ["=== B-6 Bundle Integrity Validation ===", "Bundle Valid       : INVALID", "Batch ID           : run/1", "Validated At       : then", "", "--- Check Summary ---", "Checks Run         : 23", "Checks Passed      : 19", "Checks Failed      : 4"]
    assert "  FAIL: export_artifact_paths_exist" in lines and "  [PASS] manifest_version_known" in lines and f"  [FAIL] report_artifact_json_exists — report_artifacts.json_path path not found on disk: {tmp_path}/report.json" in lines and lines[-2:] == [f"  - 1{bundles.BLOCKED}", ""]


def test_every_check_can_fail(spark):
    ref = lambda d, g, o, route, path: {"document_id": d, "gold_record_id": g, "outcome_category": o, "outcome_reason": "", "routing_label": route, "gold_artifact_path": None, "export_artifact_path": path}
    lists = {
        "exported_records": [ref("a", "g", "exported", "ops", None), ref("b", "g", "quarantined", "quarantine", "p")],
        "quarantined_records": [ref("a", "", "quarantined", "ops", "q"), ref("", "", "exported", "quarantine", None)],
        "contract_blocked_records": [ref("c", "h", None, "ops", None)], "skipped_records": [],
    }
    broken = BATCH | {"batch_id": "x", "pipeline_run_id": "y", "manifest_version": "v9", "total_records_processed": 9, "outcome_distribution": {"exported": 2}} | lists
    cases = {"broken": json.dumps(broken), "cut": json.dumps(broken)[:-1], "empty": "", "list": "[]", "lacking": json.dumps({k: v for k, v in broken.items() if k != "total_eligible"}), "bare": json.dumps({k: 0 for k in bundles.REQUIRED} | {"manifest_version": "v0.1.0", "batch_id": "x", "pipeline_run_id": "x"})}
    texts = spark.createDataFrame(list(cases.items()), "key string, content string")
    got = {r.key: r for r in bundles.results(texts, paths=False).collect()}
    for k in ("cut", "empty", "list", "lacking"):
        assert (got[k].checks_run, got[k].checks_passed, got[k].failed_checks, got[k].batch_id, got[k].observations) == (1, 0, ["manifest_parses_correctly"], None, []), k
    assert got["lacking"].check_results[0].detail == bundles.INCOMPLETE and got["cut"].check_results[0].detail == bundles.UNREADABLE
    assert got["bare"].bundle_valid and got["bare"].checks_run == 19 and got["bare"].observations == [bundles.ZERO, bundles.SKIPPED]
    r = got["broken"]
    passing = {"total_contract_blocked_consistent", "skipped_records_correct_outcome_category"}
    assert r.failed_checks == [c for c in bundles.CHECKS[:19] if c not in passing]
    assert r.count_mismatches == [
        "total_records_processed (9) != total_eligible (4) + total_ineligible_skipped (1) = 5", "total_eligible (4) != sum of record lists (5): exported=2, quarantined=2, contract_blocked=1, skipped=0",
        "total_exported (1) != len(exported_records) (2)", "total_quarantined (1) != len(quarantined_records) (2)", "total_skipped_not_export_ready (1) != len(skipped_records) (0)",
        "outcome_distribution['quarantined']=0 but quarantined_records has 2 entries", "outcome_distribution['contract_blocked']=0 but contract_blocked_records has 1 entries",
    ]
    assert r.duplicate_identifiers == ["Duplicate document_ids across record lists: ['a']", "Duplicate gold_record_ids across record lists: ['g']"]
    assert r.contradictions == [
        "Exported records missing export_artifact_path: ['a']", "quarantined_records[document_id=a] has export_artifact_path='q'", "exported_records contains records with wrong outcome_category (expected 'exported'): ['b']",
        "quarantined_records contains records with wrong outcome_category (expected 'quarantined'): ['']", "contract_blocked_records contains records with wrong outcome_category (expected 'contract_blocked'): ['c']",
        "Quarantined records with non-quarantine routing_label: ['a']", "Exported records with routing_label='quarantine' (contradictory state): ['b']",
    ]
    assert {(v.key, v.check_name) for v in bundles.violations(texts, paths=False).collect()} == {(k, c) for k, x in got.items() for c in x.failed_checks}
