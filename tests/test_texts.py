"""Texts and results written out by hand: none of them is made by the code that they check."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from brasswork.functions import vocab as V
from brasswork.operators import batch as B
from brasswork.operators import evaluate as E
from brasswork.plans.relation import Relation
from brasswork.sources import artifacts, sinks


def texts(spark, relation, rows, schema, column):
    return [r[0] for r in relation.on(spark.createDataFrame(rows, schema)).select(column).collect()]


def test_review_reasons(spark):
    rows = [
        ("quarantined", "unknown", "quarantine", []),
        ("contract_blocked", "fda_warning_letter", "regulatory_review", ["a", "b", "c", "d", "e"]),
        ("contract_blocked", "fda_warning_letter", "regulatory_review", []),
        ("extraction_failed", "unknown", "quarantine", []),
        ("odd", "unknown", "quarantine", []),
    ]
    got = texts(spark, Relation().add(B.review_text), rows, "review_reason_category string, document_type_label string, routing_label string, contract_errors array<string>", "review_reason")
    assert got == [
        "Record quarantined during pipeline classification. document_type='unknown', routing='quarantine'. Causes include: unknown document type, low classification confidence, low Silver field coverage, or invalid Silver extraction.",
        "Record failed Bedrock contract validation (B-1). Export payload was not written. Validation errors: a; b; c (and 2 more) Review the Gold artifact and correct the extraction or contract fields.",
        "Record failed Bedrock contract validation (B-1). Export payload was not written. Review the Gold artifact and correct the extraction or contract fields.",
        "Record could not be classified due to a pipeline classification error. The document was processed but produced an 'unknown' type result. Review the Silver artifact and consider re-extraction.",
        "Review required. reason_category='odd'.",
    ]


def test_threshold_warnings(spark):
    make = lambda targets: Relation().add(lambda d: E.warnings(d, targets))
    bronze = [(0.9, 0.1, 321.5, 42, 0.25), (0.95, 0.05, 500.0, 100, 0.0), (None, None, None, None, None)]
    got = texts(spark, make(V.BRONZE_TARGETS), bronze, "parse_success_rate double, parse_failure_rate double, median_char_count double, p10_char_count long, zero_char_count_rate double", "threshold_warnings")
    assert got == [
        [
            "parse_success_rate 90.00% is below target 95.00%",
            "parse_failure_rate 10.00% exceeds target 5.00% — review batch for format issues or path errors",
            "median_char_count 321.5 is below target 500 — possible PDF parsing issue (scanned or image-only documents)",
            "p10_char_count 42 is below target 100 — near-empty parses detected at the 10th percentile",
            "zero_char_count_rate is 25.00% — investigate ai_parse_document call immediately",
        ],
        [],
        [],
    ]
    gold = [(0.9, 0.1, 0.1, 0.8, 0.8, 0.1, 0.125)]
    got = texts(spark, make(V.GOLD_TARGETS), gold, "classification_success_rate double, unknown_label_rate double, quarantine_rate double, export_ready_rate double, mean_classification_confidence double, low_confidence_rate double, confidence_null_rate double", "threshold_warnings")
    assert got[0][0].startswith("confidence_null_rate=12.50%: classification_confidence is null for 12% of records. ") or got[0][0].startswith("confidence_null_rate=12.50%: classification_confidence is null for 13% of records. ")
    trace = [(0.5, 1.0, 1.0, 1.0, 0, 3)]
    got = texts(spark, make(V.TRACE_TARGETS), trace, "gold_to_silver_link_rate double, silver_to_bronze_link_rate double, pipeline_run_id_coverage double, schema_version_coverage double, orphaned_silver_count long, orphaned_gold_count long", "threshold_warnings")
    assert got == [["gold_to_silver_link_rate=0.5000: 3 Gold record(s) have no matching Silver extraction_id — pipeline defect", "orphaned_gold_count=3: these Gold records cannot be traced to Silver — treat as pipeline defect requiring investigation"]]


def test_delivery_checks(spark):
    names = "event_exists boolean, event_parses boolean, manifest_exists boolean, manifest_parses boolean, bundle_exists boolean, schema_version string, status string, delivery_mechanism string, batch_id string, pipeline_run_id string, bundle_path string, exported int, n_labels int, setup_sql string, n_queries int, manifest_status string"
    good = (True, True, True, True, True, "v0.2.0", "prepared", "delta_sharing", "r", "r", "b.json", 2, 1, "CREATE", 3, "designed")
    rows = [good, (False, False, True, True, False, *[None] * 6, None, None, " ", None, "lost"), (*good[:5], "v0.1.0", "sent", "email", "a", "b", "", 1, 0, "x", 0, None)]
    got = texts(spark, Relation().add(B.delivery_checks), rows, names, "failed")
    assert got[0] == []
    assert got[1] == ["delivery_event_exists", "delivery_event_parseable", "delivery_event_schema_version", "delivery_event_status_known", "delivery_mechanism_known", "cross_id_consistency", "bundle_path_referenced", "bundle_path_exists", "routing_labels_present", "share_manifest_has_setup_sql", "share_manifest_has_c2_queries", "share_provisioning_acknowledged"]
    assert got[2] == ["delivery_event_schema_version", "delivery_event_status_known", "delivery_mechanism_known", "cross_id_consistency", "bundle_path_referenced", "bundle_path_exists", "routing_labels_present", "share_manifest_has_c2_queries", "share_provisioning_acknowledged"]


def test_bundle_results(spark):
    rows = [(True, []), (True, ["x", "y"]), (False, ["x"])]
    got = [tuple(r)[2:] for r in Relation().add(B.bundle_result).on(spark.createDataFrame(rows, "parses boolean, failed array<string>")).collect()]
    assert got == [(19, 0, 19, True), (19, 2, 17, False), (1, 1, 0, False)]


def test_artifacts(spark, tmp_path):
    schema = "document_id string, n int"
    with pytest.raises(FileNotFoundError):
        artifacts.scan(spark, schema, folder=str(tmp_path))
    (tmp_path / "a.json").write_text(json.dumps({"document_id": "a", "n": 1}, indent=2))
    (tmp_path / "b.json").write_text(json.dumps({"document_id": "b"}))
    (tmp_path / "c.txt").write_text("no")
    (tmp_path / "exports").mkdir()
    (tmp_path / "exports" / "d.json").write_text("{}")
    assert {(r.document_id, r.n) for r in artifacts.scan(spark, schema, folder=str(tmp_path)).collect()} == {("a", 1), ("b", None)}
    assert artifacts.scan(spark, schema, folder=str(tmp_path), file=str(tmp_path / "b.json")).count() == 1
    (tmp_path / "e.json").write_text("{not json")
    with pytest.raises(ValueError):
        artifacts.scan(spark, schema, folder=str(tmp_path))
    good, skipped = artifacts.tolerant(spark, schema, str(tmp_path))
    assert good.count() == 2 and skipped.first()[0].endswith("e.json")
    with pytest.raises(FileNotFoundError):
        artifacts.scan(spark, schema, folder=str(tmp_path / "missing"))


def test_reports_and_share_manifest(spark, tmp_path):
    report = spark.range(1).select(F.lit(3).alias("total"), F.lit(None).cast("double").alias("rate"))
    sinks.write_report(report, "handoff", "run/1 a:b", str(tmp_path / "out"))
    assert json.loads((tmp_path / "out" / "handoff_run_1_a_b.json").read_text()) == {"total": 3, "rate": None}
    assert (tmp_path / "out" / "handoff_run_1_a_b.txt").read_text() == "handoff\ntotal: 3\nrate: n/a"
    name, text = sinks.share_manifest("s", "r", "c.gold.t", "c.gold.e", "assets")
    found = json.loads(text)
    assert name == "delta_share_preparation_manifest.json" and found["status"] == "designed" and [q["name"] for q in found["c2_validation_queries"]] == ["confirm_share_exists", "query_export_ready_records", "query_delivery_events", "verify_routing_label_transparency"]
    assert "ALTER SHARE s\n  ADD TABLE c.gold.t\n  AS assets\n  COMMENT 'Gold-tier" in found["setup_sql"] and found["setup_sql"].endswith("GRANT SELECT ON SHARE s TO RECIPIENT r;")


def test_a_receiver_reads_only_what_is_ready(spark):
    spark.sql("CREATE DATABASE IF NOT EXISTS shared")
    rows = [("a", "regulatory_review", "v0.2.0", True), ("b", "quarantine", "v0.2.0", False), ("c", "security_ops", "v0.1.0", True)]
    spark.createDataFrame(rows, "document_id string, routing_label string, schema_version string, export_ready boolean").write.mode("overwrite").saveAsTable("shared.assets")
    told = {q["name"]: q["sql"].rstrip(";") for q in sinks.validation_statements("shared", "assets", "shared.events")}
    assert [tuple(r) for r in spark.sql(told["query_export_ready_records"]).collect()] == [("a", "regulatory_review", "v0.2.0")]
    assert {r.routing_label for r in spark.sql(told["verify_routing_label_transparency"]).collect()} == {"regulatory_review", "security_ops"}
    spark.sql("DROP TABLE shared.assets")
