"""Closed vocabularies, field lists and thresholds of the record pipeline."""

from __future__ import annotations

# Layer statuses.
PARSE_STATUSES = ("success", "partial", "failed")
VALIDATION_STATUSES = ("valid", "partial", "invalid")
SCHEMA_VERSION, SCHEMA_VERSION_DELIVERY = "v0.1.0", "v0.2.0"
EXTENSIONS = {".pdf": "application/pdf", ".docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document", ".txt": "text/plain", ".md": "text/markdown"}
TEXT_EXTENSIONS = (".txt", ".md")
PARSER, EXTRACTOR, CLASSIFIER = "local_text_parser/v1", "local_rule_extractor/v1", "local_rule_classifier/v1"

# Domains, their fields (required, optional), routing, prompt and the fields that count as signals.
LETTER, ADVISORY, INCIDENT = "fda_warning_letter", "cisa_advisory", "incident_report"
REQUIRED = {
    LETTER: ("issuing_office", "recipient_company", "issue_date", "violation_type", "corrective_action_requested"),
    ADVISORY: ("advisory_id", "title", "published_date", "severity_level", "remediation_available"),
    INCIDENT: ("incident_date", "incident_type", "severity", "status"),
}
OPTIONAL = {
    LETTER: ("recipient_name", "cited_regulations", "response_deadline_days", "product_involved", "summary"),
    ADVISORY: ("affected_products", "cve_ids", "remediation_summary", "summary"),
    INCIDENT: ("incident_id", "affected_systems", "root_cause", "resolution_summary", "reported_by"),
}
ROUTES = {LETTER: "regulatory_review", ADVISORY: "security_ops", INCIDENT: "incident_management"}
PROMPTS = {LETTER: "fda_warning_letter_extract_v1", ADVISORY: "cisa_advisory_extract_v1", INCIDENT: "incident_report_extract_v1"}
SIGNALS = {
    LETTER: (("issuing_office", "recipient_company", "violation_type", "corrective_action_requested", "issue_date"), 3),
    ADVISORY: (("advisory_id", "severity_level", "cve_ids", "affected_products", "remediation_available"), 2),
    INCIDENT: (("incident_date", "incident_type", "severity", "status", "incident_id"), 2),
}
DOMAINS = tuple(REQUIRED)
LISTS = ("violation_type", "cited_regulations", "affected_products", "cve_ids", "affected_systems")
BOOLEANS = ("corrective_action_requested", "remediation_available")
NUMBERS = ("response_deadline_days",)
UNKNOWN, QUARANTINE = "unknown", "quarantine"
PLANNED_DOMAINS = ("standard_operating_procedure", "quality_audit_record", "technical_case_record")

# Gold thresholds and confidence steps.
LEAST_CONFIDENCE, LEAST_COVERAGE, FULL_COVERAGE = 0.70, 0.50, 0.70
BASE, HINTED, VALID, COVERED = 0.60, 0.20, 0.10, 0.10
EXCERPT = 2000

# Outcomes, reasons, review reasons.
OUTCOMES = ("exported", "quarantined", "contract_blocked", "skipped_not_export_ready")
REASONS = ("none", "routing_quarantine", "contract_validation_failed", "export_not_attempted")
REVIEW_REASONS = ("quarantined", "contract_blocked", "extraction_failed")
DECISIONS = ("approve_for_export", "confirm_quarantine", "request_reprocessing", "reject_unresolved")
ACTIONABLE, TERMINAL, REPROCESS = ("approve_for_export", "request_reprocessing"), ("confirm_quarantine", "reject_unresolved"), "request_reprocessing"
SEVERITIES, INCIDENT_STATUSES = ("Critical", "High", "Low", "Medium"), ("open", "resolved", "under_review")

# The export contract.
PAYLOAD_KEYS = ("document_id", "source_file", "document_type", "routing_label", "extracted_fields", "parsed_text_excerpt", "provenance")
PROVENANCE_KEYS = ("ingested_at", "pipeline_run_id", "extraction_model", "classification_model", "classification_confidence", "schema_version")

# Evaluation targets (metric, comparison that warns, target, text of the warning; {} is the metric).
BRONZE_TARGETS = (
    ("parse_success_rate", "<", 0.95, "parse_success_rate {:.2%} is below target 95.00%"),
    ("parse_failure_rate", ">", 0.05, "parse_failure_rate {:.2%} exceeds target 5.00% — review batch for format issues or path errors"),
    ("median_char_count", "<", 500, "median_char_count {} is below target 500 — possible PDF parsing issue (scanned or image-only documents)"),
    ("p10_char_count", "<", 100, "p10_char_count {} is below target 100 — near-empty parses detected at the 10th percentile"),
    ("zero_char_count_rate", ">", 0.0, "zero_char_count_rate is {:.2%} — investigate ai_parse_document call immediately"),
)
SILVER_TARGETS = (
    ("schema_validity_rate", "<", 0.80, "schema_validity_rate {:.2%} is below target 80.00% — review extraction prompt or rule logic for the failing document class"),
    ("invalid_rate", ">", 0.10, "invalid_rate {:.2%} exceeds target 10.00% — review prompt template and required field extraction coverage"),
    ("mean_field_coverage_pct", "<", 0.75, "mean_field_coverage_pct {:.2%} is below target 75.00%"),
    ("p25_field_coverage_pct", "<", 0.50, "p25_field_coverage_pct {:.2%} is below target 50.00% — bottom quartile of records have low coverage"),
    ("required_field_null_rate", ">", 0.05, "required_field_null_rate {:.2%} exceeds target 5.00% — specific required fields may not exist in this document domain; check schema or extraction logic"),
)
GOLD_TARGETS = (
    ("classification_success_rate", "<", 0.85, "classification_success_rate {:.2%} is below target 85.00% — taxonomy may need expansion or classifier logic may need review"),
    ("unknown_label_rate", ">", 0.15, "unknown_label_rate {:.2%} exceeds target 15.00% — review document class hints or classifier signal thresholds"),
    ("quarantine_rate", ">", 0.15, "quarantine_rate {:.2%} exceeds target 15.00% — systematic quality issue upstream (extraction or classification)"),
    ("export_ready_rate", "<", 0.70, "export_ready_rate {:.2%} is below target 70.00% — review Silver coverage or classification confidence thresholds"),
    ("mean_classification_confidence", "<", 0.75, "mean_classification_confidence {:.2%} is below target 75.00% — classifier is uncertain; review rule logic or label taxonomy"),
    ("low_confidence_rate", ">", 0.20, "low_confidence_rate {:.2%} exceeds target 20.00%"),
    ("confidence_null_rate", ">", 0.0, "confidence_null_rate={:.2%}: classification_confidence is null for {:.0%} of records. Confidence-based thresholds not evaluated for those records. See observations for context (likely bootstrap SQL path)."),
)
TRACE_TARGETS = (
    ("gold_to_silver_link_rate", "<", 1.0, "gold_to_silver_link_rate={:.4f}: {orphaned_gold_count} Gold record(s) have no matching Silver extraction_id — pipeline defect"),
    ("silver_to_bronze_link_rate", "<", 1.0, "silver_to_bronze_link_rate={:.4f}: {orphaned_silver_count} Silver record(s) have no matching Bronze bronze_record_id — pipeline defect"),
    ("pipeline_run_id_coverage", "<", 1.0, "pipeline_run_id_coverage={:.4f}: some records have null pipeline_run_id — traceability to pipeline batch is broken"),
    ("schema_version_coverage", "<", 1.0, "schema_version_coverage={:.4f}: some records have null schema_version — contract drift detection may fail"),
    ("orphaned_silver_count", ">", 0, "orphaned_silver_count={}: these Silver records cannot be traced to Bronze — treat as pipeline defect requiring investigation"),
    ("orphaned_gold_count", ">", 0, "orphaned_gold_count={}: these Gold records cannot be traced to Silver — treat as pipeline defect requiring investigation"),
)

# Texts of observations and review reasons ({name} is a column).
NULL_CONFIDENCE = "confidence_null_rate={confidence_null_rate:.2%}: {null_confidences} of {total_records} records have null classification_confidence. This is expected for records produced by the A-3B Databricks bootstrap SQL path (ai_classify variant does not expose a scalar confidence score). Confidence-based metrics are computed only over records with non-null confidence values."
PLACEHOLDERS = "{placeholders} record(s) carry pipeline_run_id='bootstrap_sql_v1' (placeholder, not a real MLflow run ID). These records originated from the A-3B bootstrap SQL execution, not from a tracked MLflow pipeline run."
PLACEHOLDERS_TRACED = "{placeholders} record(s) carry a placeholder pipeline_run_id ({placeholder_list}). These records originated from the A-3B Databricks bootstrap SQL execution, not from a tracked MLflow pipeline run. This is a documented implementation detail of the bootstrap path. Full lineage via document_id is still intact."
REVIEW_TEXTS = {
    "quarantined": "Record quarantined during pipeline classification. document_type='{document_type_label}', routing='{routing_label}'. Causes include: unknown document type, low classification confidence, low Silver field coverage, or invalid Silver extraction.",
    "contract_blocked": "Record failed Bedrock contract validation (B-1). Export payload was not written.{errors_summary} Review the Gold artifact and correct the extraction or contract fields.",
    "extraction_failed": "Record could not be classified due to a pipeline classification error. The document was processed but produced an 'unknown' type result. Review the Silver artifact and consider re-extraction.",
}
REVIEW_TEXT = "Review required. reason_category='{review_reason_category}'."

# What a handoff unit may carry, and what delivery events may say.
HANDOFF_TYPES = (LETTER, ADVISORY, INCIDENT, *PLANNED_DOMAINS)
HANDOFF_ROUTES = ("regulatory_review", "security_ops", "incident_management", "quality_management", "knowledge_base")
OPTIONAL_PAYLOAD_KEYS = ("page_count", "char_count", "extraction_prompt_id")
MECHANISM, DELIVERY_STATUSES = "delta_sharing", ("prepared", "failed")
SHORT_PARSE, LOW_SILVER_COVERAGE, VERY_LOW_CONFIDENCE = 100, 0.40, 0.50
PLACEHOLDER_RUNS = ("bootstrap_sql_v1",)

# Notes of manifests, review queues and governance reports (when a note is given, its text; {name} is a column).
MANIFEST_NOTES = (
    ("true", "Batch processed {total_records_processed} record(s): {total_eligible} eligible, {total_ineligible_skipped} ineligible/skipped before classification."),
    ("true", "Export outcomes: {total_exported} exported, {total_quarantined} quarantined, {total_contract_blocked} contract-blocked, {total_skipped_not_export_ready} skipped."),
    ("total_exported > 0", "{total_exported} record(s) successfully written as Bedrock handoff artifact(s). Export paths are in exported_records[].export_artifact_path."),
    ("total_quarantined > 0", "{total_quarantined} record(s) routed to quarantine (governance path). No export file was written for quarantined records. Gold artifact paths are in quarantined_records[].gold_artifact_path."),
    ("total_contract_blocked > 0", "{total_contract_blocked} record(s) were export-ready but failed B-1 contract validation. No export file was written for blocked records. Review contract_blocked_records and the corresponding Gold artifacts for field-level contract violation detail."),
    ("total_skipped_not_export_ready > 0", "{total_skipped_not_export_ready} record(s) were not export-ready and not quarantined. No export was attempted. Gold artifact paths are in skipped_records[]."),
    ("report_attached", "B-4 HandoffBatchReport is attached via report_artifacts. The report provides outcome counts, reason code distributions, and a human-readable batch summary."),
    ("NOT report_attached", "B-4 HandoffBatchReport was not generated for this bundle. Rerun with --report-dir to produce a structured outcome report alongside this bundle."),
    ("true", "Export artifact path pattern: <export_dir>/<routing_label>/<document_id>.json ({path_source})."),
    ("true", "Manifest schema version: {manifest_version}. Authoritative contract: {contract_source}."),
)
QUEUE_NOTES = (
    ("true", "Review queue generated for {total_records_reviewed} eligible pipeline records. {total_entries} record(s) added to the review queue."),
    ("entries_quarantined > 0", "{entries_quarantined} record(s) quarantined during pipeline classification. Review the Gold artifact for classification context and routing reason."),
    ("entries_contract_blocked > 0", "{entries_contract_blocked} record(s) blocked by B-1 Bedrock contract validation. Review the Gold artifact and contract_validation_errors for field-level detail."),
    ("entries_extraction_failed > 0", "{entries_extraction_failed} record(s) produced an 'unknown' document type during classification. Review the Silver artifact and consider re-extraction with a corrected class hint."),
    ("total_entries = 0", "No records required human review in this batch. All eligible records were exported successfully."),
    ("coalesce(bundle_path, '') <> ''", "B-5 batch manifest referenced at: {bundle_path}. The manifest contains full per-record artifact paths for this batch."),
    ("coalesce(report_path, '') <> ''", "B-4 handoff batch report referenced at: {report_path}. The report contains outcome counts and reason code distributions."),
    ("true", "Review decisions should be recorded using the ReviewDecision schema ({decision_source}). For records requiring reprocessing, a ReprocessingRequest artifact should be produced alongside the decision."),
    ("true", "This is an upstream review queue artifact. Human review workflows, case management tooling, and downstream decisioning are outside this repo's boundary."),
)
GOVERNANCE_INPUTS = (("has_evaluation", "evaluation report (A-4)"), ("has_handoff", "handoff batch report (B-4)"), ("has_bundle", "handoff bundle manifest (B-5)"), ("has_queue", "review queue artifact (E-0)"))
GOVERNANCE_NOTES = (
    ("true", "Governance report generated for environment: '{environment}'. Overall health status: {health}."),
    ("inputs <> ''", "Input artifacts consumed: {inputs}."),
    ("inputs = ''", "No input artifacts provided. Governance report is empty — run evaluation, handoff, and review queue pipelines first."),
    ("true", "{n_flags} governance flag(s) derived: {n_critical} critical, {n_warning} warning, {n_info} info."),
    ("true", "This governance report is an upstream-only artifact. It summarizes pipeline quality and operational state derived from existing structured outputs. It does not represent a dashboard, cross-case analytics product, or downstream Bedrock runtime monitoring layer."),
    ("true", "Governance signals are derived deterministically from evaluation, handoff, review queue, and environment artifacts. No live Databricks workspace or external credentials are required to produce this report."),
)

# Lines of the texts of handoff reports, manifests and review queues ({name} is a column).
REPORT_LINES = (
    "=== Handoff Batch Report (B-4) ===", "Pipeline Run ID    : {pipeline_run_id}", "Batch Processed At : {processed_at}", "",
    "--- Record Counts ---", "Total Processed         : {total_records_processed}", "Ineligible Skipped      : {total_ineligible_skipped}", "Eligible for Export     : {total_eligible}", "Export Attempts         : {total_export_attempts}", "",
    "--- Outcome Counts ---", "Exported                : {total_exported}", "Quarantined             : {total_quarantined}", "Contract Blocked        : {total_contract_blocked}", "Skipped (not ready)     : {total_skipped_not_export_ready}", "",
    "--- Outcome Distribution ---", *[f"  {o}: {{total_{o}}}" for o in OUTCOMES], "",
    "--- Reason Code Distribution ---", *[f"  {r}: {{reason_{r}}}" for r in REASONS],
)
REPORT_LISTS = (("contract_blocked", "--- Contract Blocked Document IDs ---"), ("quarantined", "--- Quarantined Document IDs ---"))
BUNDLE_LINES = (
    "=== Handoff Batch Review Bundle (B-5) ===", "Manifest Version   : {manifest_version}", "Batch ID           : {pipeline_run_id}", "Pipeline Run ID    : {pipeline_run_id}", "Generated At       : {processed_at}", "",
    "--- Record Counts ---", "Total Processed    : {total_records_processed}", "Ineligible Skipped : {total_ineligible_skipped}", "Eligible           : {total_eligible}", "",
    "--- Outcome Counts ---", "Exported           : {total_exported}", "Quarantined        : {total_quarantined}", "Contract Blocked   : {total_contract_blocked}", "Skipped (not ready): {total_skipped_not_export_ready}",
)
BUNDLE_LISTS = (("exported", "Exported Records"), ("quarantined", "Quarantined Records"), ("contract_blocked", "Contract Blocked Records"), ("skipped_not_export_ready", "Skipped Records"))
QUEUE_LINES = (
    "=== Human Review Queue (E-0) ===", "Review Queue ID    : {review_queue_id}", "Pipeline Run ID    : {pipeline_run_id}", "Generated At       : {processed_at}", "Schema Version     : {schema_version}", "",
    "--- Queue Counts ---", "Total Records Reviewed : {total_records_reviewed}", "Total Queue Entries    : {total_entries}", "",
    "--- Entries by Reason ---", *[f"  {r}: {{entries_{r}}}" for r in REVIEW_REASONS],
)

# What stored artifacts must have, and columns whose values are closed.
ARTIFACT_KEYS = {
    "delivery_event": ("delivery_event_id", "pipeline_run_id", "batch_id", "generated_at", "status", "schema_version"),
    "validation_result": ("batch_id", "validation_status", "checks"),
    "review_queue": ("review_queue_id", "pipeline_run_id", "queue_entries"),
    "handoff_bundle": ("manifest_version", "batch_id", "pipeline_run_id"),
    "governance_report": ("governance_report_id", "environment", "overall_health_status"),
}

# Governance thresholds.
GOVERNANCE = {"bronze": 0.90, "silver": 0.80, "gold": 0.70, "link": 1.0, "pressure_warning": 0.20, "pressure_critical": 0.50, "export_rate": 0.50, "routing_anomaly": 0.50}
ENVIRONMENTS = ("dev", "staging", "prod")
