"""Governance of a pass from the artifacts that it was given, as JSON texts; each may be absent.

Input, a row a pass: report_id, generated_at, environment, and for each of evaluation, handoff, bundle and queue a text and a path (evaluation_text,
evaluation_path, ...). A text that is null, an empty object or no JSON object counts as absent: what it would tell is null, and a note says so. A
value of a wrong type is null. Run ids keep the order of the inputs; the queue's reasons stand in the order of their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import vocab as V
from ..functions.dialect import Dialect
from .delivery import shown
from .evaluate import filled
from .notes import notes

INPUTS = ("evaluation", "handoff", "bundle", "queue")
RATES = {
    "bronze_parse_success_rate": "bronze.metrics.parse_success_rate",
    "silver_extraction_validity_rate": "silver.metrics.schema_validity_rate",
    "gold_export_ready_rate": "gold.metrics.export_ready_rate",
    "gold_classification_success_rate": "gold.metrics.classification_success_rate",
    "traceability_gold_to_silver_link_rate": "traceability.gold_to_silver_link_rate",
    "traceability_silver_to_bronze_link_rate": "traceability.silver_to_bronze_link_rate",
    "traceability_pipeline_run_id_coverage": "traceability.pipeline_run_id_coverage",
}
ORPHANS = {"traceability_orphaned_silver_count": "traceability.orphaned_silver_count", "traceability_orphaned_gold_count": "traceability.orphaned_gold_count"}
TOTALS = ("total_records_processed", "total_exported", "total_quarantined", "total_contract_blocked", "total_skipped_not_export_ready")
SHARES = {"export_success_rate": "total_exported", "quarantine_rate": "total_quarantined", "contract_block_rate": "total_contract_blocked"}

# Observations (condition, text), in their order.
QUALITY_NOTES = (
    ("NOT evaluation_there", "No evaluation report available for this governance pass."),
    ("bootstrap_path_detected", "Bootstrap path detected: placeholder pipeline_run_id values present. classification_confidence may be null for bootstrap-origin records."),
)
HANDOFF_NOTES = (
    ("NOT handoff_there", "No handoff batch report available for this governance pass."),
    ("total_contract_blocked > 0", "{total_contract_blocked} record(s) blocked by Bedrock contract validation. Review contract_blocked_document_ids for field-level detail."),
    ("total_quarantined > 0", "{total_quarantined} record(s) routed to quarantine. Review the Gold artifacts for classification context."),
)
QUEUE_NOTES = (
    ("NOT queue_there", "No review queue artifact available for this governance pass."),
    ("total_queue_entries = 0", "No records required human review in this batch."),
    ("total_queue_entries > 0", "{total_queue_entries} record(s) entered the review queue. Review decisions should be recorded using the ReviewDecision schema."),
)
MISSING = (
    ("traceability_pipeline_run_id_coverage < 1.0", "pipeline_run_id (coverage < 100%)"),
    ("bootstrap_path_detected", "pipeline_run_id (placeholder 'bootstrap_sql_v1' values present — not real MLflow run IDs)"),
)
UNEXPECTED = (("total_eligible > 0 AND coalesce(total_quarantined, 0) / CAST(total_eligible AS DOUBLE) > 0.5", "More than 50% of eligible records quarantined ({total_quarantined}/{total_eligible}) — review classification taxonomy and routing logic."),)
DRIFT_NOTES = (
    ("mixed_schema_versions", "Mixed schema versions detected across artifacts: {versions_shown}. Artifacts produced at different schema versions should be reviewed for provenance field completeness."),
    ("unknown_environment", "Environment '{environment}' is not in the bounded environment vocabulary ['dev', 'prod', 'staging']. Use 'dev', 'staging', or 'prod'."),
    ("missing_shown <> ''", "Missing or placeholder provenance fields detected: {missing_shown}"),
)
# Flags in their order: condition, severity, category, signal, detail.
_G = V.GOVERNANCE
FLAGS = (
    (f"bronze_parse_success_rate < {_G['bronze']}", "warning", "quality_degradation", "bronze_parse_success_below_threshold", "Bronze parse success rate {bronze_parse_success_rate:.1%} is below the 90% threshold. Review Bronze artifacts for parse failures."),
    (f"silver_extraction_validity_rate < {_G['silver']}", "warning", "quality_degradation", "silver_extraction_validity_below_threshold", "Silver extraction validity rate {silver_extraction_validity_rate:.1%} is below the 80% threshold. Review extraction prompts and Silver schema alignment."),
    (f"gold_export_ready_rate < {_G['gold']}", "warning", "quality_degradation", "gold_export_ready_rate_below_threshold", "Gold export-ready rate {gold_export_ready_rate:.1%} is below the 70% threshold. Review classification taxonomy and routing rules."),
    (f"traceability_gold_to_silver_link_rate < {_G['link']}", "warning", "traceability_defect", "gold_to_silver_link_incomplete", "Gold→Silver traceability link rate {traceability_gold_to_silver_link_rate:.1%} is below 100%. Some Gold records cannot be traced to their Silver origin."),
    (f"traceability_silver_to_bronze_link_rate < {_G['link']}", "warning", "traceability_defect", "silver_to_bronze_link_incomplete", "Silver→Bronze traceability link rate {traceability_silver_to_bronze_link_rate:.1%} is below 100%. Some Silver records cannot be traced to their Bronze origin."),
    ("traceability_orphaned_gold_count > 0", "critical", "traceability_defect", "orphaned_gold_records_detected", "{traceability_orphaned_gold_count} orphaned Gold record(s) detected — no matching Silver record found. Full lineage is broken for these records."),
    ("traceability_orphaned_silver_count > 0", "warning", "traceability_defect", "orphaned_silver_records_detected", "{traceability_orphaned_silver_count} orphaned Silver record(s) detected — no matching Bronze record found."),
    ("mixed_schema_versions", "warning", "contract_schema_inconsistency", "mixed_schema_versions_detected", "Multiple schema versions detected across artifacts: {versions_shown}. Ensure artifacts in the same governance scope share a consistent schema version."),
    ("missing_shown <> ''", "warning", "contract_schema_inconsistency", "missing_provenance_fields", "Missing or incomplete provenance fields detected: {missing_shown}. Provenance is required for full traceability and Bedrock contract compliance."),
    ("unexpected_shown <> ''", "warning", "contract_schema_inconsistency", "unexpected_routing_combinations", "Unexpected document/routing patterns detected: {unexpected_shown}"),
    (f"review_queue_pressure_pct >= {_G['pressure_critical']}", "critical", "review_queue_pressure", "review_queue_pressure_critical", "Review queue pressure {review_queue_pressure_pct:.1%} exceeds critical threshold (50%). Immediate review of queued records is recommended."),
    (f"review_queue_pressure_pct >= {_G['pressure_warning']} AND review_queue_pressure_pct < {_G['pressure_critical']}", "warning", "review_queue_pressure", "review_queue_pressure_elevated", "Review queue pressure {review_queue_pressure_pct:.1%} exceeds warning threshold (20%). Consider reviewing queued records before the next pipeline run."),
    ("total_contract_blocked > 0", "info", "export_handoff_reliability_concern", "contract_blocked_records_present", "{total_contract_blocked} record(s) blocked by Bedrock contract validation. Export artifacts were NOT written for these records. Review contract_blocked_document_ids for field-level detail."),
    (f"export_success_rate < {_G['export_rate']}", "warning", "export_handoff_reliability_concern", "low_export_success_rate", "Export success rate {export_success_rate:.1%} is below 50% of eligible records. Review classification, contract, and routing rules."),
)
GAP = "chr(1)"


def _parsed(d: Dialect) -> dict[str, str]:
    return {k: f"CASE WHEN NOT {d.has(f'{k}_text', r'^\s*[{]\s*[}]\s*$', '')} THEN {d.parsed(f'{k}_text')} END" for k in INPUTS}


def _there(d: Dialect) -> dict[str, str]:
    return {f"{k}_there": f"coalesce({d.kind_of(d.whole_type(k))}, '') = 'object'" for k in INPUTS}


def _told(d: Dialect) -> dict[str, str]:
    """Null-safe members: what isn't an object has none."""
    number = lambda v, key, kind: d.number(d.said(v, key), kind)
    return {
        **{n: number("evaluation", p, "DOUBLE") for n, p in RATES.items()}, **{n: number("evaluation", p, "BIGINT") for n, p in ORPHANS.items()},
        "bootstrap_path_detected": f"coalesce({d.said('evaluation', 'bootstrap_path_detected')} = 'true', false)", "first_observations": f"coalesce({d.head(d.items('evaluation', 'all_observations'), 5)}, {d.empty()})",
        "filter_run": f"coalesce({d.said('evaluation', 'pipeline_run_id_filter')}, '')", "gold_versions": f"coalesce({d.keys('evaluation', 'gold.metrics.schema_version_distribution')}, {d.empty()})",
        **{n: number("handoff", n, "BIGINT") for n in (*TOTALS, "total_eligible")}, "handoff_run": f"coalesce({d.said('handoff', 'pipeline_run_id')}, '')",
        **{n: f"coalesce({d.items('handoff', n)}, {d.empty()})" for n in ("contract_blocked_document_ids", "quarantined_document_ids")},
        "total_records_reviewed": number("queue", "total_records_reviewed", "BIGINT"), "total_queue_entries": number("queue", "total_entries", "BIGINT"), "queue_run": f"coalesce({d.said('queue', 'pipeline_run_id')}, '')",
        "queue_version": f"coalesce({d.said('queue', 'schema_version')}, '')", "entries_by_reason": f"coalesce({d.pairs('queue', 'entries_by_reason')}, {d.empty()})",
        "bundle_used": f"coalesce(nullif(bundle_path, ''), {d.said('bundle', 'batch_id')})",
    }


def _derived(d: Dialect) -> dict[str, str]:
    rates = {n: f"{t} / CAST(nullif(total_eligible, 0) AS DOUBLE)" for n, t in SHARES.items()}
    runs = d.compact(("filter_run <> ''", "filter_run"), ("handoff_run <> '' AND handoff_run <> filter_run", "handoff_run"), ("queue_run <> '' AND queue_run <> filter_run AND queue_run <> handoff_run", "queue_run"))
    return rates | {
        "review_queue_pressure_pct": "CASE WHEN total_records_reviewed > 0 THEN total_queue_entries / CAST(total_records_reviewed AS DOUBLE) END", "input_pipeline_run_ids": runs,
        "schema_versions_detected": d.sorted(d.plus("gold_versions", d.compact(("queue_version <> ''", "queue_version")))), "missing_provenance_fields": notes(d, MISSING), "unexpected_routing_combinations": notes(d, UNEXPECTED),
        "unknown_environment": f"NOT coalesce({d.isin('environment', V.ENVIRONMENTS)}, false)",
    }


def _shown(d: Dialect) -> dict[str, str]:
    return {"mixed_schema_versions": f"{d.size('schema_versions_detected')} > 1", "versions_shown": shown(d, "schema_versions_detected"), "missing_shown": d.join("missing_provenance_fields", "; "), "unexpected_shown": d.join("unexpected_routing_combinations", "; ")}


def _flagged(d: Dialect) -> dict[str, str]:
    return {
        "quality_observations": d.plus(notes(d, QUALITY_NOTES), "first_observations"), "handoff_observations": notes(d, HANDOFF_NOTES), "review_queue_observations": notes(d, QUEUE_NOTES), "drift_observations": notes(d, DRIFT_NOTES),
        "flags": d.compact(*[(c, f"concat({', '.join([d.text(f'{severity}:'), d.text(category), GAP, d.text(signal), GAP, filled(d, detail)])})") for c, severity, category, signal, detail in FLAGS]),
    }


def _health(d: Dialect) -> dict[str, str]:
    some = lambda level: f"{d.size(d.only('flags', lambda x: f"{x} LIKE '{level}:%'"))} > 0"
    paths = {f"has_{k}": f"coalesce({'bundle_used' if k == 'bundle' else f'{k}_path'}, '') <> ''" for k in INPUTS}
    return paths | {"overall_health": d.ladder((some("critical"), "'critical'"), (some("warning"), "'degraded'"), other="'healthy'")}


def governed(relation):
    """A relation of passes with their summaries, drift, flags, health and notes."""
    from .notes import governance_inputs, governance_notes

    for step in (_parsed, _there, _told, _derived, _shown, _flagged, _health, governance_inputs, governance_notes):
        relation = relation.add(step)
    return relation


def _flag_parts(x: Column) -> Column:
    head, rest = F.split_part(x, F.lit("\x01"), F.lit(1)), (F.split_part(x, F.lit("\x01"), F.lit(2)), F.split_part(x, F.lit("\x01"), F.lit(3)))
    return F.struct(F.split_part(head, F.lit(":"), F.lit(2)).alias("category"), F.split_part(head, F.lit(":"), F.lit(1)).alias("severity"), rest[0].alias("signal"), rest[1].alias("detail"))


def reports(passes: DataFrame) -> DataFrame:
    """The passes as documents of 12 members."""
    c = F.col
    scope = F.struct(c("evaluation_path").alias("evaluation_report_path"), c("handoff_path").alias("handoff_report_path"), c("bundle_used").alias("handoff_bundle_path"), c("queue_path").alias("review_queue_path"), "environment", "input_pipeline_run_ids")
    drift = F.struct("schema_versions_detected", "mixed_schema_versions", "missing_provenance_fields", "unexpected_routing_combinations", F.array("environment").alias("environment_names_detected"), F.lit(False).alias("mixed_environments_detected"), "drift_observations")
    return passes.select(
        c("report_id").alias("governance_report_id"), "generated_at", "environment", F.lit("v1.0.0").alias("schema_version"), scope.alias("reporting_scope"),
        F.struct(*RATES, *ORPHANS, "bootstrap_path_detected", "quality_observations").alias("quality_summary"),
        F.struct(*TOTALS, *SHARES, "contract_blocked_document_ids", "quarantined_document_ids", "handoff_observations").alias("handoff_health"),
        F.struct("total_records_reviewed", "total_queue_entries", F.map_from_arrays(F.transform("entries_by_reason", lambda x: F.substring_index(x, ": ", 1)), F.transform("entries_by_reason", lambda x: F.substring_index(x, ": ", -1).try_cast("bigint"))).alias("entries_by_reason"), "review_queue_pressure_pct", "review_queue_observations").alias("review_queue_summary"),
        drift.alias("schema_drift"), F.transform("flags", _flag_parts).alias("governance_flags"), "governance_notes", c("overall_health").alias("overall_health_status"),
    )


# Heads and lines of a report's text; {name} is a column, {name%} a rate, {name?} a count, either N/A where null.
WIDE, THIN = "=" * 72, "-" * 60
TEXT = (
    ("", (WIDE, "  Pipeline — Governance Monitoring Report (E-2)", WIDE, "  Report ID        : {report_id}", "  Generated at     : {generated_at}", "  Environment      : {environment}", "  Schema version   : v1.0.0", "  Health status    : {health}", WIDE), None),
    ("  Reporting Scope", ("  Environment            : {environment}", "  Evaluation report      : {evaluation_path!}", "  Handoff report (B-4)   : {handoff_path!}", "  Handoff bundle (B-5)   : {bundle_used!}", "  Review queue (E-0)     : {queue_path!}", "  Pipeline run IDs       : {input_pipeline_run_ids,}"), None),
    ("  Quality Summary", ("  Bronze parse success rate      : {bronze_parse_success_rate%}", "  Silver extraction validity     : {silver_extraction_validity_rate%}", "  Gold export-ready rate         : {gold_export_ready_rate%}", "  Gold classification success    : {gold_classification_success_rate%}", "  Traceability Gold→Silver       : {traceability_gold_to_silver_link_rate%}", "  Traceability Silver→Bronze     : {traceability_silver_to_bronze_link_rate%}", "  Pipeline run_id coverage       : {traceability_pipeline_run_id_coverage%}", "  Orphaned Silver records        : {traceability_orphaned_silver_count?}", "  Orphaned Gold records          : {traceability_orphaned_gold_count?}", "  Bootstrap path detected        : {bootstrap_path_detected&}"), ("quality_observations", "  Observations:")),
    ("  Handoff Health (B-4)", ("  Total processed           : {total_records_processed?}", "  Total exported            : {total_exported?}", "  Total quarantined         : {total_quarantined?}", "  Total contract blocked    : {total_contract_blocked?}", "  Total skipped             : {total_skipped_not_export_ready?}", "  Export success rate       : {export_success_rate%}", "  Quarantine rate           : {quarantine_rate%}", "  Contract block rate       : {contract_block_rate%}"), ("handoff_observations", "  Observations:")),
    ("  Review Queue Pressure (E-0)", ("  Records reviewed          : {total_records_reviewed?}", "  Queue entries             : {total_queue_entries?}", "  Queue pressure            : {review_queue_pressure_pct%}"), ("review_queue_observations", "  Observations:")),
    ("  Schema / Contract Drift Indicators", ("  Schema versions detected  : {schema_versions_detected[none detected]}", "  Mixed schema versions     : {mixed_schema_versions&}", "  Missing provenance fields : {missing_provenance_fields[none]}", "  Unexpected routing combos : {unexpected_routing_combinations[none]}", "  Environments detected     : ['{environment}']", "  Mixed environments        : no"), ("drift_observations", "  Drift observations:")),
)


def _line(template: str) -> Column:
    """A line from its template; null where it has no place in the text."""
    start, end = template.find("{"), template.rfind("}")
    if start < 0:
        return F.lit(template)
    head, inner, tail = template[:start], template[start + 1 : end], template[end + 1 :]
    if inner[-1] == "%":
        value = F.coalesce(F.concat(F.call_function("format_number", F.col(inner[:-1]) * 100, F.lit("0.0")), F.lit("%")), F.lit("N/A"))
    elif inner[-1] == "?":
        value = F.coalesce(F.col(inner[:-1]).cast("string"), F.lit("N/A"))
    elif inner[-1] == "&":
        value = F.when(F.col(inner[:-1]), "YES").otherwise("no")
    elif inner[-1] == "!":
        value = F.coalesce(F.nullif(F.col(inner[:-1]), F.lit("")), F.lit("not provided"))
    elif inner[-1] == ",":
        return F.when(F.size(inner[:-1]) > 0, F.concat(F.lit(head), F.array_join(inner[:-1], ", ")))
    elif inner[-1] == "]":
        name, none = inner[:-1].split("[")
        value = F.when(F.size(name) == 0, F.lit(f"['{none}']")).otherwise(F.concat(F.lit("["), F.array_join(F.transform(name, lambda x: F.concat(F.lit("'"), x, F.lit("'"))), ", "), F.lit("]")))
    else:
        value = F.coalesce(F.col(inner).cast("string"), F.lit("None"))
    return F.concat(F.lit(head), value, F.lit(tail))


def text() -> Column:
    """A report's text, from the columns of `governed`."""
    none = F.array().cast("array<string>")
    headed = lambda title: [F.lit(THIN), title if isinstance(title, Column) else F.lit(title), F.lit(THIN)]
    parts = []
    for title, lines, noted in TEXT:
        parts.append(F.array_compact(F.array(*(headed(title) if title else []), *[_line(t) for t in lines])))
        if title.startswith("  Review Queue"):
            parts.append(F.when(F.size("entries_by_reason") > 0, F.concat(F.array(F.lit("  Entries by reason:")), F.transform("entries_by_reason", lambda x: F.concat(F.lit("    "), x)))).otherwise(none))
        if noted:
            parts.append(F.when(F.size(noted[0]) > 0, F.concat(F.array(F.lit(""), F.lit(noted[1])), F.transform(noted[0], lambda x: F.concat(F.lit("    [note] "), x)))).otherwise(none))
        parts.append(F.array(F.lit("")))
    flag = lambda x: F.array(F.concat(F.lit("  ["), F.upper(_flag_parts(x)["severity"]), F.lit("] "), _flag_parts(x)["category"], F.lit(" / "), _flag_parts(x)["signal"]), F.concat(F.lit("    "), _flag_parts(x)["detail"]))
    parts.append(F.array(*headed(F.concat(F.lit("  Governance Flags ("), F.size("flags").cast("string"), F.lit(" total)")))))
    parts.append(F.when(F.size("flags") > 0, F.flatten(F.transform("flags", flag))).otherwise(F.array(F.lit("  No governance flags raised. All thresholds met."))))
    parts.append(F.array(F.lit(""), *headed("  Governance Notes")))
    parts.append(F.transform("governance_notes", lambda x: F.concat(F.lit("  - "), x)))
    parts.append(F.array(F.lit(""), F.lit(WIDE), F.lit("")))
    return F.array_join(F.concat(*parts), "\n")


def files_of(passes: DataFrame) -> DataFrame:
    """(name, content) of each report's pair of files: JSON with nulls, and text."""
    name = F.concat(F.lit("governance_report_"), F.translate("report_id", "/: ", "___"))
    doc = reports(passes).select("governance_report_id", F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("content"))
    one = doc.select(F.concat(F.lit("governance_report_"), F.translate("governance_report_id", "/: ", "___"), F.lit(".json")).alias("name"), "content")
    return one.unionByName(passes.select(F.concat(name, F.lit(".txt")).alias("name"), text().alias("content")))
