"""The evaluation run over folders of artifacts, some missing."""

from __future__ import annotations

import json
import os

from brasswork.functions import vocab as V
from brasswork.plans import evaluation
from brasswork.sources import sinks


def put(folder, records):
    os.makedirs(folder)
    for i, r in enumerate(records):
        (folder / f"{i}.json").write_text(r if isinstance(r, str) else json.dumps(r))


def layers(tmp_path):
    bronze = [{"document_id": f"d{i}", "bronze_record_id": f"b{i}", "parse_status": "success", "char_count": 1000 + i, "pipeline_run_id": "r", "schema_version": "v0.1.0"} for i in range(9)]
    bronze += [{"document_id": "d9", "bronze_record_id": "b9", "parse_status": "failed", "char_count": None, "pipeline_run_id": None, "schema_version": "v0.1.0"}, "not JSON", ""]
    whole = {n: ["x"] if n in V.LISTS else True if n in V.BOOLEANS else "x" for n in V.REQUIRED[V.LETTER]}
    silver = [{"document_id": f"d{i}", "bronze_record_id": f"b{i}", "extraction_id": f"e{i}", "validation_status": "valid", "field_coverage_pct": 1.0, "extracted_fields": whole, "pipeline_run_id": "r", "schema_version": "v0.1.0"} for i in range(3)]
    silver += [{"document_id": "dx", "bronze_record_id": "bx", "extraction_id": "e3", "validation_status": "invalid", "field_coverage_pct": 0.0, "extracted_fields": None, "pipeline_run_id": "bootstrap_sql_v1", "schema_version": "v0.1.0"}]
    gold = [{"document_id": "d0", "extraction_id": "e0", "gold_record_id": "g0", "document_type_label": V.LETTER, "routing_label": "regulatory_review", "classification_confidence": 0.9, "export_ready": True, "pipeline_run_id": "r", "schema_version": "v0.1.0"}]
    gold += [{"document_id": "d1", "extraction_id": "none", "gold_record_id": "g1", "document_type_label": "unknown", "routing_label": "quarantine", "classification_confidence": None, "export_ready": False, "pipeline_run_id": "r", "schema_version": "v0.1.0"}]
    out = {}
    for name, rows in (("bronze", bronze), ("silver", silver), ("gold", gold)):
        put(tmp_path / name, rows)
        out[name] = str(tmp_path / name)
    return out


def test_all_layers(spark, tmp_path):
    folders, out, track = layers(tmp_path), str(tmp_path / "out"), str(tmp_path / "track")
    got = evaluation.evaluate(spark, folders, out, "then", run_id="run", track=track)
    bronze, silver, gold, trace = (json.loads(got[k]["metrics"]) for k in ("bronze", "silver", "gold", "traceability"))
    assert (bronze["total_documents"], bronze["parse_success_rate"], bronze["parse_failure_rate"], bronze["p10_char_count"], bronze["median_char_count"]) == (10, 0.9, 0.1, 1000, 1004.0)
    assert (silver["total_records"], silver["schema_validity_rate"], silver["required_field_null_rate"], silver["p25_field_coverage_pct"]) == (4, 0.75, 0.25, 0.0)
    assert (gold["quarantine_rate"], gold["confidence_null_rate"], gold["mean_classification_confidence"]) == (0.5, 0.5, 0.9)
    assert (trace["gold_to_silver_link_rate"], trace["silver_to_bronze_link_rate"], trace["orphaned_gold_count"], trace["orphaned_silver_count"], trace["placeholders"]) == (0.5, 0.75, 1, 1, 1)
    assert (got["bronze"]["flagged_record_count"], got["silver"]["flagged_record_count"], got["gold"]["flagged_record_count"], got["review_queue_size"], got["bootstrap_path_detected"]) == (1, 1, 1, 3, True)
    assert got["all_warnings"][0] == "parse_success_rate 90.00% is below target 95.00%" and any(w.startswith("gold_to_silver_link_rate=0.5000: 1 Gold record(s)") for w in got["all_warnings"])
    assert len(got["gold"]["observations"]) == 1 and len(got["all_observations"]) == 2
    written = sorted(os.listdir(out))
    assert written == ["eval_bronze_run.json", "eval_gold_run.json", "eval_silver_run.json", "eval_traceability_run.json", "flagged_bronze_run", "flagged_gold_run", "flagged_silver_run", "flagged_traceability_run", "report_run.json", "report_run.txt"]
    assert json.load(open(f"{out}/report_run.json")) == evaluation.document(got) and json.load(open(f"{out}/eval_gold_run.json"))["metrics"]["quarantine_rate"] == 0.5
    lines = open(f"{out}/report_run.txt").read().split("\n")
    assert lines[3:8] == ["  Report ID        : run", "  Generated at     : then", "  Pipeline filter  : all", "  Review queue     : 3 record(s) flagged", "  Bootstrap path   : DETECTED"]
    assert "  Gold→Silver link  : 50.0%" in lines and f"    {'parse_success_rate':<40} 0.9000" in lines and "  [WARN] parse_success_rate 90.00% is below target 95.00%" in lines
    # A second write of the same run changes nothing; nulls aren't there.
    before = {(r.experiment, r.run, r.key): r.value for r in sinks.tracked(spark, track).collect()}
    assert before["bronze", "run", "parse_success_rate"] == 0.9 and len(before) == sum(v is not None for m in (bronze, silver, gold, trace) for v in m.values())
    sinks.track(spark.createDataFrame([("bronze", "parse_success_rate", 0.1), ("bronze", "none", None)], "layer string, key string, value double"), "run", track)
    assert {(r.experiment, r.run, r.key): r.value for r in sinks.tracked(spark, track).collect()} == before


def test_a_missing_layer_is_null_alone(spark, tmp_path):
    folders = layers(tmp_path)
    (tmp_path / "void").mkdir()
    result, flags = evaluation.run(spark, {k: evaluation.found(spark, k, v) for k, v in (folders | {"silver": str(tmp_path / "nowhere")}).items()})
    rows = {r.layer: r for r in result.collect()}
    assert [rows[k].present for k in ("bronze", "silver", "gold", "traceability")] == [True, False, True, False] and set(flags) == {"bronze", "gold"}
    assert rows["silver"].metrics is None and rows["silver"].threshold_warnings is None and rows["gold"].total_records == 2
    whole = evaluation.report(result, "r", "then").first()
    assert whole.silver is None and whole.traceability is None and whole.bronze.total_records == 10 and whole.review_queue_size == 2
    assert "SILVER" not in evaluation.text(whole.asDict(recursive=True)) and "Traceability" not in evaluation.text(whole.asDict(recursive=True))
    assert evaluation.found(spark, "gold", str(tmp_path / "void")) is None and evaluation.found(spark, "gold", None) is None
    result, _ = evaluation.run(spark, {k: evaluation.found(spark, k, v) for k, v in folders.items()}, skip=("gold",))
    assert {r.layer: r.present for r in result.collect()} == {"bronze": True, "silver": True, "gold": False, "traceability": False}
    nothing = evaluation.report(evaluation.run(spark, {})[0], "r", "then").first()
    assert (nothing.bronze, nothing.all_warnings, nothing.review_queue_size, nothing.bootstrap_path_detected) == (None, [], 0, False)


def test_errors_by_first_seen(spark):
    from brasswork.operators import evaluate as E
    from brasswork.plans.relation import Relation

    made = [("b", 1, ["q", "z"]), ("a", 9, ["m", "z"]), ("a", 10, ["k"]), ("a", 2, []), ("b", 0, ["k", "m"]), ("b", 3, ["a"]), ("c", 0, ["one", "one", "one"])]
    table = Relation(table="t")
    df = spark.createDataFrame(made, "domain string, ord bigint, validation_errors array<string>")
    got = E.error_frequency(table, ("a", "b")).on(df, lambda r: r.on(df)).orderBy("place").collect()
    assert [(r.error, r.n) for r in got] == [("one", 3), ("m", 2), ("z", 2), ("k", 2), ("q", 1), ("a", 1)] and got[1].rate == 0.2857


def test_placeholder_note(spark, tmp_path):
    result, _ = evaluation.run(spark, {k: evaluation.found(spark, k, v) for k, v in layers(tmp_path).items()})
    note = {r.layer: r for r in result.collect()}["traceability"].observations
    assert len(note) == 1 and note[0].startswith("1 record(s) carry a placeholder pipeline_run_id (bootstrap_sql_v1). These records originated")
