"""Validation of a delivery by its two artifacts: the delivery event and the share's preparation manifest, as JSON texts.

Input, a row a delivery: validation_run_id, validated_at, pipeline_run_id, expected_event_id, workspace_mode, event_path, event_text, manifest_path,
manifest_text, bundle_exists (whether the bundle that the event names is a file). A null path: none was given; a null text: no such file.
An event with a member that is missing, of a wrong type or outside its vocabulary isn't an event at all: it fails to parse, and so all checks that
need one; the check's text names those members. A manifest need only be a JSON object; queries that aren't a list count as none.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import vocab as V
from ..functions.dialect import Dialect
from .evaluate import filled

TEXTS = ("delivery_event_id", "pipeline_run_id", "batch_id", "generated_at")
COUNTS = ("eligible_record_count", "exported_record_count", "quarantined_record_count", "contract_blocked_count")
LOOSE = ("share_name", "shared_object_name", "bundle_artifact_path", "report_artifact_path", "status_reason", "notes")
CLOSED = {"delivery_mechanism": (V.MECHANISM,), "status": V.DELIVERY_STATUSES, "schema_version": (V.SCHEMA_VERSION_DELIVERY,)}

# Checks in their order, each with what fails it (condition, text) and the text of a pass; {name} is a column.
NO_EVENT, NO_MANIFEST = ("NOT event_ok", "No delivery event to check."), ("NOT manifest_ok", "No manifest to check.")
CHECKS = (
    ("delivery_event_exists", (("event_path IS NULL", "No delivery event path provided."), ("event_text IS NULL", "Delivery event artifact not found at: {event_path}")), "Found: {event_path}"),
    ("delivery_event_parseable", (("event_path IS NULL OR event_text IS NULL", "Delivery event path is missing or does not exist."), ("NOT event_ok", "Failed to parse delivery event: {event_wrong}")), "Parsed as DeliveryEvent (delivery_event_id={delivery_event_id})."),
    ("delivery_event_schema_version", (NO_EVENT,), "schema_version='{schema_version}' is correct."),
    ("delivery_event_status_known", (NO_EVENT,), "status='{status}' is a known delivery status."),
    ("delivery_mechanism_known", (NO_EVENT,), "delivery_mechanism='{delivery_mechanism}' matches C-0 decision."),
    ("cross_id_consistency", (NO_EVENT, ("id_errors <> ''", "{id_errors}")), "delivery_event_id, pipeline_run_id, and batch_id are internally consistent."),
    ("bundle_path_referenced", (NO_EVENT, ("bundle = ''", "delivery_event.bundle_artifact_path is not set.")), "bundle_artifact_path='{bundle}'."),
    ("bundle_path_exists", (NO_EVENT, ("bundle = ''", "No bundle_artifact_path set in delivery event."), ("NOT coalesce(bundle_exists, false)", "Bundle artifact not found at: {bundle}")), "Bundle artifact exists at: {bundle}"),
    ("routing_labels_present", (NO_EVENT, ("exported_record_count > 0 AND labels = '[]'", "exported_record_count={exported_record_count} but routing_labels is empty.")), "{labels_text}"),
    ("share_manifest_exists", (("manifest_path IS NULL", "No share manifest path provided."), ("manifest_text IS NULL", "Share preparation manifest not found at: {manifest_path}")), "Found: {manifest_path}"),
    ("share_manifest_parseable", (("manifest_path IS NULL OR manifest_text IS NULL", "Share manifest path is missing or does not exist."), ("NOT manifest_ok AND manifest_json", "Share manifest is not a JSON object."), ("NOT manifest_ok", "Failed to parse share manifest: not JSON")), "Parsed share manifest (status='{manifest_shown}')."),
    ("share_manifest_has_setup_sql", (NO_MANIFEST, ("setup_bare = ''", "Share manifest has empty or missing setup_sql field.")), "setup_sql present ({setup_length} chars)."),
    ("share_manifest_has_c2_queries", (NO_MANIFEST, ("n_queries = 0", "Share manifest has no c2_validation_queries.")), "{n_queries} C-2 validation query descriptor(s) present."),
    ("share_provisioning_acknowledged", (NO_MANIFEST, ("manifest_status = ''", "Share manifest has no 'status' field."), ("manifest_status NOT IN ('designed', 'provisioned')", "Unknown manifest status: '{manifest_status}'. Known: ['designed', 'provisioned']")), "Share provisioning status is acknowledged as '{manifest_status}'."),
)
CRITICAL = ("delivery_event_parseable", "delivery_event_schema_version", "delivery_mechanism_known", "cross_id_consistency", "share_manifest_has_setup_sql", "share_manifest_has_c2_queries")
# A status's reason; what non-critical failures add.
REASONS = {
    "failed": "Validation failed: {n_critical} critical check(s) failed — {critical_shown}. Producer-side delivery artifacts have schema or consistency errors. Review check_details for full detail.",
    "not_provisioned": "Producer-side artifact validation completed. Delta Share provisioning status is 'designed': the share has not been created in Unity Catalog. Runtime validation cannot proceed until setup_sql is executed in a Databricks workspace with CREATE SHARE privilege. This is not an error — it is the honest C-1 baseline state. {noted}",
    "partially_validated": "Producer-side artifact validation completed. Workspace mode is 'local_repo_only': no live Databricks workspace queries were executed. Runtime validation (Delta Share queryability, delivery event table row, payload conformance at v0.2.0) requires Databricks workspace access. Status: partially_validated — producer-side layer is verified; runtime end-to-end validation is pending.{noted}",
    "validated": "All critical producer-side checks passed. Workspace mode is 'personal_databricks' with runtime evidence provided. Delivery layer is confirmed as runtime-checkable in the personal workspace.",
}
NOTED = "Non-critical check failures noted: {failed_shown}."
UNSURE = "Status 'validated' claimed but {n_failed} check(s) failed: {failed_shown}."
SURE = "Evidence is appropriate for claimed status '{first_status}' (scope=producer_side_only, workspace={workspace})."
DOWNGRADED = "Status downgraded to 'failed': evidence sufficiency check failed. "
OBSERVATIONS = (
    ("event_ok", "Delivery event '{delivery_event_id}' validated: schema_version={schema_version}, status='{status}', exported_record_count={exported_record_count}, routing_labels={labels}."),
    ("NOT event_ok", "Delivery event artifact was not found or could not be parsed."),
    ("manifest_ok", "Share preparation manifest parsed: status='{manifest_noted}', c2_validation_queries={n_queries}."),
    ("manifest_ok AND NOT provisioned", "Share provisioning status is 'designed': the Delta Share has not been executed in Unity Catalog. To proceed, run setup_sql from the manifest in a Databricks SQL notebook with CREATE SHARE privilege."),
    ("NOT manifest_ok", "Share preparation manifest was not found or could not be parsed."),
    ("local", "Workspace mode is 'local_repo_only': no live Databricks workspace queries were executed. Runtime validation evidence (share queryability, delivery event table row, payload conformance) was not collected."),
    ("n_all_failed > 0", "{n_all_failed} check(s) failed: {all_failed_shown}."),
    ("true", "Overall validation status: '{validation_status}'. Checks passed: {n_all_passed}. Checks failed: {n_all_failed}."),
)
GIVEN = ("validation_run_id", "validated_at", "pipeline_run_id", "expected_event_id", "workspace_mode", "event_path", "event_text", "manifest_path", "manifest_text", "bundle_exists")
SURE_CHECK = "evidence_sufficiency"


def shown(d: Dialect, xs: str) -> str:
    """A list of texts as ['a', 'b']."""
    quoted = d.each(xs, lambda x: f"concat({d.text(chr(39))}, {x}, {d.text(chr(39))})")
    return f"concat('[', {d.join(quoted, ', ')}, ']')"


def _parsed(d: Dialect) -> dict[str, str]:
    return {"event": d.parsed("event_text"), "manifest": d.parsed("manifest_text")}


def _typed(d: Dialect) -> dict[str, str]:
    names = (*TEXTS, *COUNTS, *LOOSE, *CLOSED)
    return {f"t_{n}": d.type_of("event", n) for n in (*names, "routing_labels")} | {f"s_{n}": d.said("event", n) for n in names} | {
        "labels_found": d.items("event", "routing_labels"), "event_kind": d.kind_of(d.whole_type("event")), "manifest_kind": d.kind_of(d.whole_type("manifest")),
        "setup_sql": f"coalesce({d.said('manifest', 'setup_sql')}, '')", "setup_bare": d.strip(f"coalesce({d.said('manifest', 'setup_sql')}, '')"), "n_queries": f"coalesce({d.members('manifest', 'c2_validation_queries')}, 0)",
        "manifest_said": d.said("manifest", "status"), "manifest_has_status": d.type_of("manifest", "status"),
    }


def _read(d: Dialect) -> dict[str, str]:
    kind = lambda n: f"coalesce({d.kind_of(f't_{n}')}, 'none')"
    wrong = [(f"{kind(n)} <> 'string'", n) for n in TEXTS]
    wrong += [(f"{kind(n)} NOT IN ('number', 'string') OR NOT coalesce({d.has(f's_{n}', r'^ *[+]?[0-9]+([.]0+)? *$', '')}, false)", n) for n in COUNTS]
    wrong += [(f"{kind(n)} NOT IN ('none', 'null', 'string')", n) for n in LOOSE]
    wrong += [(f"{kind(n)} <> 'none' AND NOT coalesce({kind(n)} = 'string' AND {d.isin(f's_{n}', known)}, false)", n) for n, known in CLOSED.items()]
    some = d.size(d.only("labels_found", lambda x: f"{x} IS NULL"))
    wrong.append((f"{kind('routing_labels')} <> 'none' AND NOT coalesce({kind('routing_labels')} = 'array' AND {some} = 0, false)", "routing_labels"))
    named = d.join(d.compact(*[(c, f"'{n}'") for c, n in wrong]), ", ")
    return {"event_wrong": f"CASE WHEN coalesce(event_kind, '') <> 'object' THEN 'not a JSON object' ELSE {named} END", "manifest_ok": "manifest_path IS NOT NULL AND coalesce(manifest_kind, '') = 'object'", "manifest_json": "manifest_kind IS NOT NULL"}


def _taken(d: Dialect) -> dict[str, str]:
    """The event's values (defaults where they are left out), the manifest's status as texts show it."""
    own = {n: f"s_{n}" for n in TEXTS if n != "pipeline_run_id"} | {n: d.number(f"regexp_replace(trim(s_{n}), '[.]0+$', '')", "BIGINT") for n in COUNTS}
    closed = {n: f"coalesce(s_{n}, '{known[0]}')" for n, known in CLOSED.items()}
    return own | closed | {
        "event_ok": "event_path IS NOT NULL AND event_wrong = ''", "event_run": "s_pipeline_run_id", "bundle": "coalesce(s_bundle_artifact_path, '')", "labels": shown(d, f"coalesce(labels_found, {d.empty()})"),
        "manifest_status": "coalesce(manifest_said, '')", "manifest_shown": "CASE WHEN manifest_has_status IS NULL THEN '?' ELSE coalesce(manifest_said, 'None') END",
        "manifest_noted": "CASE WHEN manifest_has_status IS NULL THEN 'unknown' ELSE coalesce(manifest_said, 'None') END", "setup_length": "length(setup_sql)",
        "provisioned": "manifest_ok AND coalesce(manifest_said, '') = 'provisioned'", "workspace": "coalesce(workspace_mode, 'local_repo_only')", "local": "coalesce(workspace_mode, 'local_repo_only') = 'local_repo_only'",
    }


def _ids(d: Dialect) -> dict[str, str]:
    cases = (
        ("coalesce(pipeline_run_id, '') <> '' AND event_run <> pipeline_run_id", "pipeline_run_id mismatch: event has '{event_run}', expected '{pipeline_run_id}'."),
        ("coalesce(expected_event_id, '') <> '' AND delivery_event_id <> expected_event_id", "delivery_event_id mismatch: event has '{delivery_event_id}', expected '{expected_event_id}'."),
        ("batch_id <> event_run", "batch_id ('{batch_id}') does not equal pipeline_run_id ('{event_run}'). C-1 design requires batch_id == pipeline_run_id."),
    )
    label = d.ladder(("exported_record_count = 0", d.text("No exported records in batch; routing labels check not applicable.")), other=filled(d, "routing_labels present: {labels}."))
    return {"id_errors": d.join(d.compact(*[(c, filled(d, t)) for c, t in cases]), " | "), "labels_text": label}


def _checked(d: Dialect) -> dict[str, str]:
    details = {f"detail_{n}": d.ladder(*[(c, filled(d, t)) for c, t in fails], other=filled(d, good)) for n, fails, good in CHECKS}
    return details | {f"fails_{n}": " OR ".join(f"({c})" for c, _ in fails) for n, fails, _ in CHECKS}


def _judged(d: Dialect) -> dict[str, str]:
    names = [n for n, *_ in CHECKS]
    return {
        "failed": d.compact(*[(f"fails_{n}", f"'{n}'") for n in names]),
        "passed": d.compact(*[(f"NOT fails_{n}", f"'{n}'") for n in names]),
        "critical": d.compact(*[(f"fails_{n}", f"'{n}'") for n in names if n in CRITICAL]),
    }


def _status(d: Dialect) -> dict[str, str]:
    first = d.ladder((f"{d.size('critical')} > 0", "'failed'"), ("local AND NOT provisioned", "'not_provisioned'"), ("local", "'partially_validated'"), other="'validated'")
    return {"first_status": first, "n_failed": d.size("failed"), "n_critical": d.size("critical"), "failed_shown": shown(d, "failed"), "critical_shown": shown(d, "critical")}


def _evidence(d: Dialect) -> dict[str, str]:
    unsure = "first_status = 'validated' AND n_failed > 0"
    note = filled(d, NOTED)
    noted = d.ladder(("n_failed = 0", "''"), ("first_status = 'not_provisioned'", f"concat({note}, ' ')"), other=f"concat(' ', {note})")
    return {"unsure": unsure, "validation_status": f"CASE WHEN {unsure} THEN 'failed' ELSE first_status END", "evidence": f"CASE WHEN {unsure} THEN {filled(d, UNSURE)} ELSE {filled(d, SURE)} END", "noted": noted}


def _result(d: Dialect) -> dict[str, str]:
    one = lambda when: d.compact((when, f"'{SURE_CHECK}'"))
    reasons = d.ladder(("unsure", f"concat({d.text(DOWNGRADED)}, evidence)"), *[(f"first_status = '{k}'", filled(d, t)) for k, t in REASONS.items()])
    return {"checks_passed": d.plus("passed", one("NOT unsure")), "checks_failed": d.plus("failed", one("unsure")), "validation_reason": reasons}


def _observed(d: Dialect) -> dict[str, str]:
    return {"n_all_passed": d.size("checks_passed"), "n_all_failed": d.size("checks_failed"), "all_failed_shown": shown(d, "checks_failed")}


def _last(d: Dialect) -> dict[str, str]:
    return {
        "observations": d.compact(*[(c, filled(d, t)) for c, t in OBSERVATIONS]),
        "artifacts_checked": d.nonnull(["event_path", "manifest_path"]),
        "found_event_id": "CASE WHEN event_ok THEN delivery_event_id ELSE expected_event_id END",
    }


def validated(relation):
    """A relation of deliveries with their checks, status, reason and observations."""
    for step in (_parsed, _typed, _read, _taken, _ids, _checked, _judged, _status, _evidence, _result, _observed, _last):
        relation = relation.add(step)
    return relation


def results(checked: DataFrame, share: str, shared_as: str) -> DataFrame:
    """The results as documents of 18 members; `share` and `shared_as` stand where the event names none."""
    details = F.array(*[F.struct(F.lit(n).alias("check_name"), (~F.col(f"fails_{n}")).alias("passed"), F.col(f"detail_{n}").alias("detail")) for n, *_ in CHECKS], F.struct(F.lit(SURE_CHECK).alias("check_name"), (~F.col("unsure")).alias("passed"), F.col("evidence").alias("detail")))
    own = lambda n, other: F.when(F.col("event_ok") & (F.coalesce(f"s_{n}", F.lit("")) != ""), F.col(f"s_{n}")).otherwise(other)
    return checked.select(
        "validation_run_id", "pipeline_run_id", F.col("found_event_id").alias("delivery_event_id"), "validated_at", F.lit(V.MECHANISM).alias("delivery_mechanism"), own("share_name", share).alias("share_name"), own("shared_object_name", shared_as).alias("shared_object_name"),
        F.lit("producer_side_only").alias("validation_scope"), "validation_status", "validation_reason", "checks_passed", "checks_failed", details.alias("check_details"), "observations", "artifacts_checked",
        F.array().cast("array<string>").alias("queries_executed"), F.coalesce("workspace_mode", F.lit("local_repo_only")).alias("workspace_mode"), F.lit(V.SCHEMA_VERSION_DELIVERY).alias("schema_version"),
    )


# Lines of a result's text.
WIDE, THIN = "=" * 70, "-" * 40


def text() -> F.Column:
    """A result's text, from the columns of `results`."""

    def line(head: str, column, none: str = "") -> F.Column:
        return F.concat(F.lit(head), F.coalesce(F.nullif(column if isinstance(column, F.Column) else F.col(column), F.lit("")), F.lit(none)))

    def listing(column: str) -> F.Column:
        return F.concat(F.lit("["), F.array_join(F.transform(column, lambda x: F.concat(F.lit("'"), x, F.lit("'"))), ", "), F.lit("]"))

    def counted(head: str, column: str) -> F.Column:
        return F.concat(F.lit(f"{head} ("), F.size(column).cast("string"), F.lit(")  : "), listing(column))

    def some(column: str, mark: str) -> F.Column:
        rows = F.transform(column, lambda x: F.concat(F.lit(mark), x))
        return F.when(F.size(column) > 0, rows).otherwise(F.array(F.lit("  (none)")))

    head = [F.lit(WIDE), F.lit("DELIVERY LAYER VALIDATION RESULT (C-2)"), F.lit(WIDE), line("Validation Run ID  : ", "validation_run_id"), line("Pipeline Run ID    : ", "pipeline_run_id"), line("Delivery Event ID  : ", "delivery_event_id", "(not resolved)"), line("Validated At       : ", "validated_at"), line("Workspace Mode     : ", "workspace_mode"), line("Validation Scope   : ", "validation_scope"), line("Schema Version     : ", "schema_version"), F.lit("")]
    head += [F.lit("DELIVERY CONFIGURATION"), F.lit(THIN), line("Delivery Mechanism : ", "delivery_mechanism"), line("Share Name         : ", "share_name", "(not set)"), line("Shared Object      : ", "shared_object_name", "(not set)"), F.lit("")]
    head += [F.lit("VALIDATION STATUS"), F.lit(THIN), line("Status             : ", F.upper("validation_status")), line("Reason             : ", "validation_reason"), F.lit(""), F.lit("CHECK SUMMARY"), F.lit(THIN), counted("Checks Passed", "checks_passed"), counted("Checks Failed", "checks_failed"), F.lit(""), F.lit("OBSERVATIONS"), F.lit(THIN)]
    tail = ["", WIDE, "Validation scope: producer_side_only (local_repo_only baseline).", "Runtime end-to-end validation requires Databricks workspace access.", WIDE]
    between = F.array(F.lit(""), F.lit("ARTIFACTS CHECKED"), F.lit(THIN))
    return F.array_join(F.concat(F.array(*head), F.transform("observations", lambda x: F.concat(F.lit("  • "), x)), between, some("artifacts_checked", "  - "), F.array(*map(F.lit, tail))), "\n")


def files_of(found: DataFrame) -> DataFrame:
    """(name, content) of each result's pair of files: JSON with nulls, and text."""
    name = F.concat(F.lit("delivery_validation_"), F.translate("validation_run_id", "/\\", "__"))
    pair = F.array(F.struct(F.concat(name, F.lit(".json")).alias("name"), F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("content")), F.struct(F.concat(name, F.lit(".txt")).alias("name"), text().alias("content")))
    return found.select(F.explode(pair).alias("f")).select("f.name", "f.content")
