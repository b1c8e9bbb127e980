"""Batch artifacts: report, manifest, review queue, delivery event; consistency checks; governance."""

from __future__ import annotations

from ..functions import vocab as V
from ..functions.dialect import Dialect
from .evaluate import filled


def report(d: Dialect) -> dict[str, str]:
    """Counts by outcome and reason (all of the vocabulary), attempts, and the share exported."""
    out = {"total_eligible": "count(*)"}
    out |= {f"total_{o}": d.count_if(f"outcome_category = '{o}'") for o in V.OUTCOMES}
    out |= {f"reason_{r}": d.count_if(f"outcome_reason = '{r}'") for r in V.REASONS}
    out["total_export_attempts"] = d.count_if("outcome_category IN ('exported', 'contract_blocked')")
    return out


def references(d: Dialect) -> dict[str, str]:
    """A manifest's references: the list that a record belongs to (unknown outcomes count as skipped), and its paths."""
    known = d.isin("outcome_category", V.OUTCOMES)
    return {
        "list_name": f"CASE WHEN {known} THEN outcome_category ELSE 'skipped_not_export_ready' END",
        "gold_artifact_path": "concat('gold/', gold_record_id, '.json')",
        "export_artifact_path": "CASE WHEN outcome_category = 'exported' THEN concat('exports/', routing_label, '/', document_id, '.json') END",
    }


def review(d: Dialect) -> dict[str, str]:
    """Why a record waits for a person; null if it doesn't."""
    return {
        "review_reason_category": d.ladder(
            ("outcome_category = 'quarantined'", "'quarantined'"),
            ("outcome_category = 'contract_blocked'", "'contract_blocked'"),
            (f"outcome_category = 'skipped_not_export_ready' AND document_type_label = '{V.UNKNOWN}'", "'extraction_failed'"),
        )
    }


def review_text(d: Dialect) -> dict[str, str]:
    """Why a record waits, in words: the first three contract errors, and how many more there are."""
    first = d.join(d.head("contract_errors", 3), "; ")
    more = f"CASE WHEN {d.size('contract_errors')} > 3 THEN concat(' (and ', CAST({d.size('contract_errors')} - 3 AS STRING), ' more)') ELSE '' END"
    errors = f"CASE WHEN {d.size('contract_errors')} > 0 THEN concat(' Validation errors: ', {first}, {more}) ELSE '' END"
    texts = {k: filled(d, t).replace("CAST(errors_summary AS STRING)", errors) for k, t in V.REVIEW_TEXTS.items()}
    return {"review_reason": d.ladder(*[(f"review_reason_category = '{k}'", t) for k, t in texts.items()], other=filled(d, V.REVIEW_TEXT))}


def queue_counts(d: Dialect) -> dict[str, str]:
    return {"total_records_reviewed": "count(*)", "total_entries": d.count_if("review_reason_category IS NOT NULL"), **{f"entries_{r}": d.count_if(f"review_reason_category = '{r}'") for r in V.REVIEW_REASONS}}


def delivery_event(d: Dialect) -> dict[str, str]:
    """Counts, and the routing labels of exported records as a sorted list."""
    labels = d.sorted(d.distinct("routing_label", "outcome_category = 'exported'"))
    counts = {"record_count_total": "count(*)", **{f"record_count_{o}": d.count_if(f"outcome_category = '{o}'") for o in V.OUTCOMES}}
    return {**counts, "routing_labels": d.join(labels, ","), "status": "max('prepared')", "schema_version": f"max('{V.SCHEMA_VERSION_DELIVERY}')"}


def bundle_checks(d: Dialect) -> dict[str, str]:
    """Consistency of a manifest's references (rows), as failures per check."""
    failing = {
        "exported_have_path": "list_name = 'exported' AND coalesce(export_artifact_path, '') = ''",
        "others_have_no_path": "list_name <> 'exported' AND coalesce(export_artifact_path, '') <> ''",
        **{f"{o}_category": f"list_name = '{o}' AND coalesce(outcome_category, '') <> '{o}'" for o in V.OUTCOMES},
        "quarantined_routing": f"list_name = 'quarantined' AND coalesce(routing_label, '') <> '{V.QUARANTINE}'",
        "exported_not_quarantine": f"list_name = 'exported' AND routing_label = '{V.QUARANTINE}'",
    }
    return {k: d.count_if(v) for k, v in failing.items()}


def duplicates(relation, key: str):
    """Ids that occur more than once; empty ids don't count."""
    return relation.where(lambda d: f"coalesce({key}, '') <> ''").agg((key,), lambda d: {"times": "count(*)"}).where(lambda d: "times > 1")


def manifest_counts(d: Dialect) -> dict[str, str]:
    """A manifest's declared totals against its lists: the names of those that disagree."""
    listed = " + ".join(f"listed_{o}" for o in V.OUTCOMES)
    cases = [("declared_total <> declared_eligible + declared_ineligible", "total_processed"), (f"declared_eligible <> {listed}", "eligible_sum")]
    cases += [(f"declared_{o} <> listed_{o}", f"{o}_count") for o in V.OUTCOMES]
    cases += [(" OR ".join(f"coalesce(distribution_{o}, 0) <> listed_{o}" for o in V.OUTCOMES), "outcome_distribution")]
    return {"failed_checks": d.compact(*[(c, f"'{n}'") for c, n in cases])}


def missing_paths(references, listing):
    """Referenced artifact paths that a listing of files doesn't have; nothing referenced is nothing missing."""
    gold = references.select(lambda d: {"path": "gold_artifact_path"})
    exports = references.where(lambda d: "export_artifact_path IS NOT NULL").select(lambda d: {"path": "export_artifact_path"})
    return gold.union(exports).join(listing, "anti", ("path",))


def bundle_repeats(d: Dialect) -> dict[str, str]:
    """How many references of a manifest repeat an id that isn't empty."""
    return {f"no_duplicate_{k}s": f"count(nullif({k}, '')) - count(DISTINCT nullif({k}, ''))" for k in ("document_id", "gold_record_id")}


def bundle_failures(d: Dialect) -> dict[str, str]:
    """Names of the reference checks with failures."""
    return {"failed_refs": d.compact(*[(f"{k} > 0", f"'{k}'") for k in (*bundle_checks(d), *bundle_repeats(d))])}


def bundle_structure(d: Dialect) -> dict[str, str]:
    """Names of the structural checks that a manifest fails: its version, and its batch's id against the run's."""
    return {"failed_structure": d.compact((f"coalesce(manifest_version, '') <> '{V.SCHEMA_VERSION}'", "'manifest_version_known'"), ("coalesce(batch_id, '') <> coalesce(pipeline_run_id, '')", "'batch_id_pipeline_run_id_consistent'"))}


def bundle_result(d: Dialect) -> dict[str, str]:
    """A bundle's result from its failed checks: one that doesn't parse has that check alone, others 19."""
    failed = f"CASE WHEN parses THEN {d.size('failed')} ELSE 1 END"
    return {"checks_run": "CASE WHEN parses THEN 19 ELSE 1 END", "checks_failed": failed, "checks_passed": f"CASE WHEN parses THEN 19 - {d.size('failed')} ELSE 0 END", "bundle_valid": f"({failed}) = 0"}


def delivery_checks(d: Dialect) -> dict[str, str]:
    """Names of the delivery checks that fail, in their order.

    Columns: event_exists, event_parses, manifest_exists, manifest_parses, bundle_exists (booleans), the event's fields, the
    share manifest's status, setup_sql and number of queries. What can't be read fails all checks that need it.
    """
    event, share = "(event_exists AND event_parses)", "(manifest_exists AND manifest_parses)"
    cases = [
        ("NOT event_exists", "delivery_event_exists"),
        (f"NOT {event}", "delivery_event_parseable"),
        (f"NOT {event} OR schema_version <> '{V.SCHEMA_VERSION_DELIVERY}'", "delivery_event_schema_version"),
        (f"NOT {event} OR NOT {d.isin('status', V.DELIVERY_STATUSES)}", "delivery_event_status_known"),
        (f"NOT {event} OR delivery_mechanism <> '{V.MECHANISM}'", "delivery_mechanism_known"),
        (f"NOT {event} OR batch_id <> pipeline_run_id", "cross_id_consistency"),
        (f"NOT {event} OR coalesce(bundle_path, '') = ''", "bundle_path_referenced"),
        (f"NOT {event} OR coalesce(bundle_path, '') = '' OR NOT bundle_exists", "bundle_path_exists"),
        (f"NOT {event} OR (exported > 0 AND n_labels = 0)", "routing_labels_present"),
        ("NOT manifest_exists", "share_manifest_exists"),
        (f"NOT {share}", "share_manifest_parseable"),
        (f"NOT {share} OR trim(coalesce(setup_sql, '')) = ''", "share_manifest_has_setup_sql"),
        (f"NOT {share} OR coalesce(n_queries, 0) = 0", "share_manifest_has_c2_queries"),
        (f"NOT {share} OR NOT {d.isin("coalesce(manifest_status, '')", ('designed', 'provisioned'))}", "share_provisioning_acknowledged"),
    ]
    return {"failed": d.compact(*[(c, f"'{n}'") for c, n in cases])}


def delivery_status(d: Dialect) -> dict[str, str]:
    """Status from failed checks (`critical_failed`, `any_failed`), provisioning and workspace; then the evidence gate."""
    first = d.ladder(
        ("critical_failed", "'failed'"),
        ("workspace_mode = 'local_repo_only' AND NOT provisioned", "'not_provisioned'"),
        ("workspace_mode = 'local_repo_only'", "'partially_validated'"),
        other="'validated'",
    )
    return {"first_status": first, "validation_status": f"CASE WHEN ({first}) = 'validated' AND (workspace_mode = 'local_repo_only' OR any_failed) THEN 'failed' ELSE {first} END"}


def governance_rates(d: Dialect) -> dict[str, str]:
    return {
        "export_rate": "total_exported / CAST(nullif(total_eligible, 0) AS DOUBLE)",
        "quarantine_share": "total_quarantined / CAST(nullif(total_eligible, 0) AS DOUBLE)",
        "queue_pressure": "total_entries / CAST(nullif(total_records_reviewed, 0) AS DOUBLE)",
    }


def governance_flags(d: Dialect) -> dict[str, str]:
    """Signals in their fixed order, each as 'severity:signal'."""
    g = V.GOVERNANCE
    cases = [
        (f"parse_success_rate < {g['bronze']}", "warning:bronze_parse_success_low"),
        (f"schema_validity_rate < {g['silver']}", "warning:silver_validity_low"),
        (f"gold_export_ready_rate < {g['gold']}", "warning:gold_export_ready_low"),
        (f"gold_to_silver_rate < {g['link']}", "warning:gold_to_silver_link_incomplete"),
        (f"silver_to_bronze_rate < {g['link']}", "warning:silver_to_bronze_link_incomplete"),
        ("orphaned_gold_count > 0", "critical:orphaned_gold_records"),
        ("orphaned_silver_count > 0", "warning:orphaned_silver_records"),
        ("schema_versions > 1", "warning:mixed_schema_versions"),
        ("missing_provenance", "warning:missing_provenance"),
        (f"quarantine_share > {g['routing_anomaly']}", "warning:routing_anomaly"),
        (f"queue_pressure >= {g['pressure_critical']}", "critical:review_queue_pressure"),
        (f"queue_pressure >= {g['pressure_warning']} AND queue_pressure < {g['pressure_critical']}", "warning:review_queue_pressure"),
        ("total_contract_blocked > 0", "info:contract_blocked_records"),
        (f"export_rate < {g['export_rate']}", "warning:export_rate_low"),
        ("environments > 1", "warning:mixed_environments"),
    ]
    return {"flags": d.compact(*[(c, f"'{v}'") for c, v in cases])}


def governance_health(d: Dialect) -> dict[str, str]:
    def some(level: str) -> str:
        return f"{d.size(d.only('flags', lambda x: f"{x} LIKE '{level}:%'"))} > 0"

    return {"overall_health": d.ladder((some("critical"), "'critical'"), (some("warning"), "'degraded'"), other="'healthy'")}
