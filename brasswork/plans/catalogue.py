"""The registered queries of the record pipeline: each a relation that Spark runs and DuckDB repeats."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import vocab as V
from ..functions.dialect import Dialect
from ..operators import batch as B
from ..operators import bronze, delivery, governance, notes, review, silver, typed
from ..operators import evaluate as E
from ..operators.contract import gated, quarantine_errors, validated
from ..operators.extract import iso_date, with_fields
from ..operators.gold import graded, outcome, signals
from ..operators.silver import extracted
from ..sources import rendered as R
from ..sources import sinks
from . import bootstrap, documents, evaluation, statements
from .relation import Relation


def silver_of(domain: str) -> Relation:
    return extracted(R.BY_DOMAIN[domain](), domain, cut=True).layer(f"silver-{domain}")


def flat(d: Dialect, names) -> dict[str, str]:
    """Columns by name; lists as text."""
    return {n: d.join(n, " | ") if n in V.LISTS or n in ("validation_errors", "review_reasons", "contract_errors") else n for n in names}


def fields(domain: str, names=None) -> Relation:
    own = names or V.REQUIRED[domain] + V.OPTIONAL[domain]
    return silver_of(domain).select(lambda d: flat(d, ("document_id", *own)))


SILVER_COLUMNS = ("document_id", "bronze_record_id", "ord", "domain", "document_class_hint", "field_coverage_pct", "validation_status", "validation_errors")


def all_silver() -> Relation:
    parts = [silver_of(k).select(lambda d: {c: c for c in SILVER_COLUMNS} | {"extraction_id": "concat('ext-', bronze_record_id)", "pipeline_run_id": "'run-1'"}) for k in V.DOMAINS]
    return parts[0].union(*parts[1:])


GOLD_COLUMNS = ("document_id", "bronze_record_id", "ord", "domain", "validation_status", "field_coverage_pct", "document_type_label", "classification_confidence", "routing_label", "export_ready")


def _gold(domain: str) -> Relation:
    ids = {"extraction_id": "concat('ext-', bronze_record_id)", "gold_record_id": "concat('gold-', bronze_record_id)", "pipeline_run_id": "'run-1'"}
    return graded(silver_of(domain), domain).select(lambda d: {c: c for c in GOLD_COLUMNS} | ids)


def all_gold() -> Relation:
    parts = [_gold(k) for k in V.DOMAINS]
    return parts[0].union(*parts[1:]).layer("gold")


def blocked(relation: Relation) -> Relation:
    """Contract errors by the record's number, so that all outcomes occur; then the outcome."""
    made = lambda d: {
        "contract_errors": f"CASE WHEN export_ready AND ord % 17 = 3 THEN {d.nonnull([d.text(f'error {i}') for i in range(4)])} ELSE {d.empty()} END",
        "was": "export_ready",
    }
    demoted = relation.add(made).select(lambda d: {c: c for c in GOLD_COLUMNS if c not in ("export_ready", "document_type_label")} | {"extraction_id": "extraction_id", "gold_record_id": "gold_record_id", "pipeline_run_id": "pipeline_run_id", "contract_errors": "contract_errors", "export_ready": f"was AND {d.size('contract_errors')} = 0 AND ord % 23 <> 5", "document_type_label": "CASE WHEN ord % 23 = 5 THEN 'unknown' ELSE document_type_label END"})
    return demoted.add(outcome)


def outcomes() -> Relation:
    return blocked(all_gold())


def payloads() -> Relation:
    """Export payloads as JSON text from orders: keys left out, nulls, wrong types, by the order's number."""
    o = "o_orderkey"
    q = lambda k, v: f"'\"{k}\":{v}'"

    def fields_json(d: Dialect) -> str:
        return d.ladder(
            (f"{o} % 3 = 0", f"""concat('{{"issuing_office":"x","recipient_company":', CASE WHEN {o} % 6 = 0 THEN 'null' ELSE '"c"' END, ',"issue_date":"2024-01-01"', CASE WHEN {o} % 4 = 0 THEN '' ELSE CASE WHEN {o} % 4 = 1 THEN ',"violation_type":[]' ELSE ',"violation_type":["a"]' END END, ',"corrective_action_requested":', CASE WHEN {o} % 5 = 0 THEN '"yes"' ELSE 'true' END, '}}')"""),
            (f"{o} % 3 = 1", f"""concat('{{"advisory_id":"A","title":"t","published_date":"2024-01-01","severity_level":', CASE WHEN {o} % 4 = 0 THEN '"Severe"' ELSE '"High"' END, ',"remediation_available":', CASE WHEN {o} % 5 = 0 THEN 'null' ELSE 'false' END, '}}')"""),
            other=f"""concat('{{"incident_date":"2024-01-01","incident_type":"x","severity":"High","status":', CASE WHEN {o} % 4 = 0 THEN '"shut"' ELSE '"open"' END, '}}')""",
        )

    kind = f"CASE {o} % 3 WHEN 0 THEN '{V.LETTER}' WHEN 1 THEN '{V.ADVISORY}' ELSE '{V.INCIDENT}' END"
    return Relation("orders").add(lambda d: {"fields_json": fields_json(d)}).select(
        lambda d: {
            "document_id": f"CAST({o} AS STRING)",
            "ord": o,
            "export_ready": f"{o} % 19 <> 0",
            "routing_label": f"CASE WHEN {o} % 29 = 0 OR {o} % 19 = 0 THEN 'quarantine' ELSE 'security_ops' END",
            "export_payload": f"""concat('{{"document_id":', CASE WHEN {o} % 31 = 0 THEN '"  "' ELSE concat('"', CAST({o} AS STRING), '"') END, ',"source_file":', CASE WHEN {o} % 37 = 0 THEN '7' ELSE '"a.txt"' END,
                ',"document_type":"', CASE WHEN {o} % 41 = 0 THEN 'unknown' ELSE {kind} END, '","routing_label":"', CASE WHEN {o} % 29 = 0 THEN 'quarantine' ELSE 'security_ops' END, '"',
                CASE WHEN {o} % 43 = 0 THEN '' ELSE concat(',"extracted_fields":', CASE WHEN {o} % 47 = 0 THEN '[1]' ELSE fields_json END) END,
                ',"parsed_text_excerpt":', CASE WHEN {o} % 53 = 0 THEN 'null' ELSE '"text"' END,
                ',"provenance":', CASE WHEN {o} % 59 = 0 THEN 'true' ELSE concat('{{"ingested_at":"x","pipeline_run_id":', CASE WHEN {o} % 61 = 0 THEN 'null' ELSE '"r"' END, ',"extraction_model":"m","classification_model":"c",', CASE WHEN {o} % 67 = 0 THEN '' ELSE concat('"classification_confidence":', CASE {o} % 7 WHEN 0 THEN 'null' WHEN 1 THEN '1.5' WHEN 2 THEN '"high"' ELSE '0.9' END, ',') END, '"schema_version":"v0.1.0"}}') END, '}}')""",
        }
    )


def answers(domain: str) -> Relation:
    """Raw answers of an extractor as JSON texts, from orders: members left out, nulls, wrong types, texts that aren't JSON."""
    o = "o_orderkey"

    def member(name: str, k: int) -> str:
        good = "'[\"a\",\"b\"]'" if name in V.LISTS else f"CASE {o} % 6 WHEN 0 THEN 'false' WHEN 1 THEN '1' WHEN 2 THEN '\"Yes\"' ELSE 'true' END" if name in V.BOOLEANS else f"CASE {o} % 4 WHEN 0 THEN '15' WHEN 1 THEN '15.0' WHEN 2 THEN '\" 7 \"' ELSE 'true' END" if name in V.NUMBERS else f"concat('\"', o_orderpriority, ' {k}\"')"
        wrong = f"CASE {o} % 5 WHEN 0 THEN '5.5' WHEN 1 THEN '\"maybe\"' WHEN 2 THEN '{{\"x\":[1]}}' WHEN 3 THEN '[\"a\",null]' ELSE '[1]' END"
        return f"CASE WHEN ({o} + {k}) % 13 = 0 THEN '' WHEN ({o} + {k}) % 17 = 0 THEN '\"{name}\":null,' WHEN ({o} + {k}) % 43 = 0 THEN concat('\"{name}\":', {wrong}, ',') ELSE concat('\"{name}\":', {good}, ',') END"

    whole = ", ".join(member(n, k) for k, n in enumerate(typed.names_of(domain)))
    text = f"CASE WHEN {o} % 53 = 0 THEN NULL WHEN {o} % 59 = 0 THEN 'no JSON {{' WHEN {o} % 61 = 0 THEN '[1]' ELSE concat('{{', {whole}, '\"more\":1}}') END"
    return Relation("orders").select(lambda d: {"document_id": f"concat('{domain}-', CAST({o} AS STRING))", "raw": text})


def _typed(domain: str) -> Relation:
    kept = {"document_id": "document_id", "has_fields": "has_fields", "field_coverage_pct": "coverage_or_none", "validation_status": "status_or_invalid"}
    return typed.built(answers(domain), domain).select(lambda d: kept | {"errors": d.join("errors_or_one", " | ")} | {n: d.join(n, "|") if n in V.LISTS else f"CAST({n} AS INT)" if n in V.NUMBERS else n for n in typed.names_of(domain)})


def trace() -> tuple[Relation, Relation, Relation]:
    """Bronze, Silver and Gold of events, with broken links by the event's number."""
    base = Relation("events").where(lambda d: "event_type = 'error'")
    bronze = base.where(lambda d: "event_id % 6 <> 0").select(lambda d: {"bronze_record_id": "concat('b', CAST(event_id AS STRING))", "document_id": "CAST(event_id AS STRING)", "pipeline_run_id": "CASE WHEN event_id % 9 = 0 THEN 'bootstrap_sql_v1' ELSE 'r' END", "schema_version": "'v0.1.0'"})
    silver = base.select(lambda d: {"bronze_record_id": "CASE WHEN event_id % 8 = 0 THEN NULL WHEN event_id % 8 = 1 THEN '' ELSE concat('b', CAST(event_id AS STRING)) END", "extraction_id": "concat('e', CAST(event_id AS STRING))", "document_id": "CAST(event_id AS STRING)", "pipeline_run_id": "CASE WHEN event_id % 10 = 0 THEN NULL ELSE 'r' END", "schema_version": "'v0.1.0'"})
    gold = base.where(lambda d: "event_id % 5 <> 0").select(lambda d: {"extraction_id": "concat('e', CAST(event_id + CASE WHEN event_id % 7 = 0 THEN 1000000000 ELSE 0 END AS STRING))", "gold_record_id": "concat('g', CAST(event_id AS STRING))", "document_id": "CAST(event_id AS STRING)", "pipeline_run_id": "'r'", "schema_version": "CASE WHEN event_id % 11 = 0 THEN '' ELSE 'v0.2.0' END", "export_ready": "event_id % 3 = 0", "routing_label": "CASE WHEN event_id % 3 = 0 THEN 'incident_management' ELSE 'quarantine' END"})
    return bronze, silver, gold


def _lineage() -> Relation:
    """Bronze, then Silver and Gold by document: which layers a document reached."""
    bronze, silver, gold = trace()
    s = silver.select(lambda d: {"document_id": "document_id", "in_silver": "true"})
    g = gold.select(lambda d: {"document_id": "document_id", "in_gold": "true", "export_ready": "export_ready", "routing_label": "routing_label"})
    joined = bronze.select(lambda d: {"document_id": "document_id"}).join(s, "left", ("document_id",)).join(g, "left", ("document_id",))
    return joined.select(lambda d: {"document_id": "document_id", "silver_exists": "in_silver IS NOT NULL", "gold_exists": "in_gold IS NOT NULL", "export_ready": "export_ready", "routing_label": "routing_label", "full_lineage": "CASE WHEN in_silver IS NOT NULL AND in_gold IS NOT NULL THEN 'complete' ELSE 'incomplete' END"})


def _beside(first: Relation, *others: Relation) -> Relation:
    """One-row relations as one row."""
    whole = first.add(lambda d: {"one": "1"})
    for other in others:
        whole = whole.join(other.add(lambda d: {"one": "1"}), "inner", ("one",))
    return whole


def _warned(whole: Relation, targets) -> Relation:
    return whole.add(lambda d: E.warnings(d, targets)).select(lambda d: {"threshold_warnings": d.join("threshold_warnings", "; ")})


def _bronze_p() -> Relation:
    return E.nearest(R.natural().where(lambda d: "parse_status IN ('success', 'partial')"), "char_count", {"p10_char_count": 10, "p25_char_count": 25})


def _required_nulls() -> Relation:
    """The reference's rate over all records: the letters' required fields, which records of other domains don't have."""
    names = V.REQUIRED[V.LETTER]
    held = {k: [n if n in V.REQUIRED[k] + V.OPTIONAL[k] else f"-{n}" for n in names] for k in V.DOMAINS}
    empty = lambda k: lambda d: {"empty_slots": E.empty_slots(d, held[k])}
    parts = [silver_of(k).select(empty(k)) for k in V.DOMAINS]
    return parts[0].union(*parts[1:]).agg((), lambda d: {"required_field_null_rate": f"round(sum(empty_slots) / CAST(nullif(count(*) * {len(names)}, 0) AS DOUBLE), 4)"})


def _trace_rates() -> Relation:
    bronze, silver, gold = trace()
    a = E.link_rate(gold, silver, "extraction_id", "gold_to_silver").add(lambda d: {"one": "1"})
    b = E.link_rate(silver, bronze, "bronze_record_id", "silver_to_bronze").add(lambda d: {"one": "1"})
    return a.join(b, "inner", ("one",)).select(lambda d: {k: k for k in ("gold_to_silver_rate", "silver_to_bronze_rate", "orphaned_gold_count", "orphaned_silver_count")})


def _coverage_of_layers() -> Relation:
    parts = [r.select(lambda d: {"pipeline_run_id": "pipeline_run_id", "schema_version": "schema_version"}) for r in trace()]
    return parts[0].union(*parts[1:]).agg((), lambda d: {"run_id_coverage": E.rate(d, "coalesce(pipeline_run_id, '') <> ''"), "schema_version_coverage": E.rate(d, "coalesce(schema_version, '') <> ''"), "placeholder_runs": d.count_if(d.isin("pipeline_run_id", V.PLACEHOLDER_RUNS))})


def _run_metrics() -> Relation:
    """Runs as months of events: the share of errors a run, and its drop since the run before."""
    by = Relation("events").select(lambda d: {"run": "concat(CAST(year(ts) AS STRING), '-', lpad(CAST(month(ts) AS STRING), 2, '0'), '-', lpad(CAST(day(ts) AS STRING), 2, '0'))", "bad": "event_type = 'error'"})
    rates = by.agg(("run",), lambda d: {"metric": E.rate(d, "NOT bad")})
    moved = rates.add(lambda d: {"before": "lag(metric) OVER (ORDER BY run)"})
    return moved.add(lambda d: {"drift": "round(metric - before, 4)"}).select(lambda d: {"run": "run", "metric": "metric", "drift": "drift", "dropped": "coalesce(drift < -0.10, false)"})


def _drift() -> Relation:
    """One row with the drift of the layers: schema versions, and whether run ids are missing or placeholders.

    Environments stay one: records carry no environment, and the reference counts only the one that a run is given.
    """
    parts = [r.select(lambda d: {"schema_version": "schema_version"}) for r in trace()]
    versions = parts[0].union(*parts[1:]).where(lambda d: "coalesce(schema_version, '') <> ''").agg(("schema_version",), lambda d: {"n": "count(*)"}).agg((), lambda d: {"schema_versions": "count(*)"})
    runs = _coverage_of_layers().select(lambda d: {"missing_provenance": "coalesce(run_id_coverage < 1, false) OR placeholder_runs > 0"})
    return _beside(versions, runs).select(lambda d: {"schema_versions": "schema_versions", "environments": "1", "missing_provenance": "missing_provenance"})


def _governance() -> Relation:
    """One row with the quality, handoff, queue and lineage figures that governance reads."""
    bronze = R.natural().agg((), E.bronze_metrics).select(lambda d: {"parse_success_rate": "parse_success_rate"})
    silver = all_silver().agg((), E.silver_metrics).select(lambda d: {"schema_validity_rate": "schema_validity_rate"})
    gold = all_gold().agg((), E.gold_metrics).select(lambda d: {"gold_export_ready_rate": "export_ready_rate"})
    batch = outcomes().agg((), B.report)
    queue = outcomes().add(B.review).agg((), B.queue_counts)
    whole = _beside(bronze, silver, gold, batch, queue, _trace_rates(), _drift())
    return whole.add(B.governance_rates).add(B.governance_flags).add(B.governance_health)


def _manifest() -> Relation:
    """Manifests by customer: what they declare and what their lists hold, wrong by the customer's number."""
    c = "c_custkey"
    listed = {f"listed_{o}": f"{c} % {5 + i}" for i, o in enumerate(V.OUTCOMES)}
    declared = {f"declared_{o}": f"{c} % {5 + i} + CASE WHEN {c} % {17 + i} = 0 THEN 1 ELSE 0 END" for i, o in enumerate(V.OUTCOMES)}
    shown = {f"distribution_{o}": f"CASE WHEN {c} % {19 + i} = 0 THEN NULL ELSE {c} % {5 + i} END" for i, o in enumerate(V.OUTCOMES)}
    total = " + ".join(listed.values())
    return Relation("customer").select(lambda d: {"batch_id": c, **listed, **declared, **shown, "declared_eligible": f"{total} + CASE WHEN {c} % 31 = 0 THEN 2 ELSE 0 END", "declared_ineligible": f"{c} % 3", "declared_total": f"{total} + {c} % 3"})


def _bundles() -> Relation:
    """Manifests by customer with their versions and ids, some wrong, and the names of all the checks that they fail."""
    c = "c_custkey"
    ids = Relation("customer").select(lambda d: {"key": c, "manifest_version": f"CASE {c} % 13 WHEN 0 THEN 'v9' WHEN 1 THEN NULL ELSE '{V.SCHEMA_VERSION}' END", "batch_id": f"concat('run-', CAST({c} AS STRING))", "pipeline_run_id": f"concat('run-', CAST({c} + CASE WHEN {c} % 29 = 0 THEN 1 ELSE 0 END AS STRING))", "parses": f"{c} % 37 <> 0"}).add(B.bundle_structure)
    counts = _manifest().add(B.manifest_counts).select(lambda d: {"key": "batch_id", "failed_counts": "failed_checks"})
    # References by batch; a path is left out, a record listed twice or under another id, by the record's number.
    broken = {"export_artifact_path": "CASE WHEN ord % 101 = 0 THEN NULL ELSE export_artifact_path END", "document_id": "CASE WHEN ord % 89 = 0 THEN 'doc' ELSE document_id END", "gold_record_id": "CASE WHEN ord % 61 = 0 THEN 'gold' ELSE gold_record_id END"}
    listed = outcomes().add(B.references).select(lambda d: {"key": "ord % 97 + 1", **{k: k for k in ("list_name", "outcome_category", "routing_label")}, **broken})
    refs = listed.agg(("key",), lambda d: {**B.bundle_checks(d), **B.bundle_repeats(d)}).add(B.bundle_failures).select(lambda d: {"key": "key", "failed_refs": "failed_refs"})
    whole = ids.join(counts, "inner", ("key",)).join(refs, "left", ("key",))
    return whole.add(lambda d: {"failed": d.plus("failed_structure", "failed_counts", f"coalesce(failed_refs, {d.empty()})")})


def _deliveries() -> Relation:
    """Delivery events and share manifests by customer, as a validator finds them, with what may be wrong."""
    c = "c_custkey"
    return Relation("customer").select(
        lambda d: {
            "key": c, "event_exists": f"{c} % 31 <> 0", "event_parses": f"{c} % 17 <> 0", "manifest_exists": f"{c} % 23 <> 0", "manifest_parses": f"{c} % 19 <> 0", "bundle_exists": f"{c} % 7 <> 0",
            "schema_version": f"CASE WHEN {c} % 11 = 0 THEN 'v0.1.0' ELSE '{V.SCHEMA_VERSION_DELIVERY}' END", "status": f"CASE {c} % 5 WHEN 0 THEN 'sent' WHEN 1 THEN 'failed' ELSE 'prepared' END", "delivery_mechanism": f"CASE WHEN {c} % 41 = 0 THEN 'email' ELSE '{V.MECHANISM}' END",
            "batch_id": f"CAST({c} AS STRING)", "pipeline_run_id": f"CAST({c} + CASE WHEN {c} % 13 = 0 THEN 1 ELSE 0 END AS STRING)", "bundle_path": f"CASE {c} % 9 WHEN 0 THEN NULL WHEN 1 THEN '' ELSE 'bundle.json' END", "exported": f"{c} % 4", "n_labels": f"{c} % 3",
            "setup_sql": f"CASE {c} % 8 WHEN 0 THEN '  ' WHEN 1 THEN NULL ELSE 'CREATE SHARE s' END", "n_queries": f"CASE WHEN {c} % 6 = 0 THEN NULL ELSE {c} % 5 END", "manifest_status": f"CASE {c} % 4 WHEN 0 THEN NULL WHEN 1 THEN 'provisioned' WHEN 2 THEN 'designed' ELSE 'lost' END",
        }
    ).add(B.delivery_checks)


def _delivered() -> Relation:
    """Deliveries by customer with the texts of their two artifacts: lost, cut, without a member, with wrong or unknown values, by the customer's number."""
    c = "c_custkey"

    def event(d: Dialect) -> str:
        run = f"concat('run-', CAST({c} AS STRING))"
        parts = [
            f"""CASE WHEN {c} % 43 = 0 THEN '{{"a":1' ELSE concat('{{"delivery_event_id":"e', CAST({c} AS STRING), '","pipeline_run_id":"') END""", f"concat({run}, CASE WHEN {c} % 13 = 0 THEN 'x' ELSE '' END)", f"""concat('","batch_id":"', {run}, '","generated_at":"now"')""",
            f"""CASE {c} % 11 WHEN 0 THEN ',"schema_version":"v0.1.0"' WHEN 1 THEN '' ELSE ',"schema_version":"{V.SCHEMA_VERSION_DELIVERY}"' END""", f"""CASE WHEN {c} % 17 = 0 THEN ',"status":"sent"' WHEN {c} % 17 = 1 THEN ',"status":"failed"' ELSE '' END""",
            f"""CASE WHEN {c} % 41 = 0 THEN ',"delivery_mechanism":"email"' ELSE ',"delivery_mechanism":"{V.MECHANISM}"' END""", f"""concat(',"eligible_record_count":9,"exported_record_count":', CASE {c} % 7 WHEN 0 THEN '-1' WHEN 1 THEN '"2"' WHEN 2 THEN '3.0' WHEN 3 THEN '0' ELSE '4' END, ',"quarantined_record_count":0')""",
            f"""CASE WHEN {c} % 37 = 0 THEN '' ELSE ',"contract_blocked_count":0' END""", f"""CASE {c} % 5 WHEN 0 THEN '' WHEN 1 THEN ',"routing_labels":[]' WHEN 2 THEN ',"routing_labels":["a","b"]' WHEN 3 THEN ',"routing_labels":["a"]' ELSE CASE WHEN {c} % 2 = 0 THEN ',"routing_labels":["a",1]' ELSE ',"routing_labels":["c"]' END END""",
            f"""CASE {c} % 9 WHEN 0 THEN ',"bundle_artifact_path":null' WHEN 1 THEN ',"bundle_artifact_path":""' WHEN 2 THEN '' ELSE ',"bundle_artifact_path":"bundle.json"' END""", "'}'",
        ]
        return f"CASE WHEN {c} % 31 = 0 THEN NULL WHEN {c} % 47 = 0 THEN '[1]' ELSE concat({', '.join(parts)}) END"

    def manifest(d: Dialect) -> str:
        status = f"""CASE {c} % 4 WHEN 0 THEN '' WHEN 1 THEN ',"status":"provisioned"' WHEN 2 THEN ',"status":"designed"' ELSE CASE WHEN {c} % 8 = 3 THEN ',"status":"lost"' ELSE ',"status":"provisioned"' END END"""
        queries = f"""CASE WHEN {c} % 21 = 0 THEN '' WHEN {c} % 22 = 0 THEN ',"c2_validation_queries":[]' WHEN {c} % 23 = 0 THEN ',"c2_validation_queries":"q"' ELSE ',"c2_validation_queries":[{{"name":"a"}},{{"name":"b"}}]' END"""
        setup = f"""CASE WHEN {c} % 19 = 0 THEN '"setup_sql":"  "' WHEN {c} % 19 = 1 THEN '"setup_sql":null' ELSE '"setup_sql":"CREATE SHARE s"' END"""
        return f"""CASE WHEN {c} % 29 = 0 THEN NULL WHEN {c} % 53 = 0 THEN '[2]' WHEN {c} % 59 = 0 THEN 'no JSON' ELSE concat('{{', {setup}, {status}, {queries}, '}}') END"""

    given = {"key": c, "validation_run_id": f"concat('v-', CAST({c} AS STRING))", "validated_at": "'now'", "pipeline_run_id": f"concat('run-', CAST({c} AS STRING))", "expected_event_id": f"CASE {c} % 3 WHEN 0 THEN NULL WHEN 1 THEN concat('e', CAST({c} AS STRING)) ELSE concat('e', CAST({c} + CASE WHEN {c} % 14 = 0 THEN 1 ELSE 0 END AS STRING)) END"}
    paths = {"workspace_mode": f"CASE WHEN {c} % 3 = 0 THEN 'local_repo_only' ELSE 'personal_databricks' END", "event_path": f"CASE WHEN {c} % 61 <> 0 THEN 'event.json' END", "manifest_path": f"CASE WHEN {c} % 67 <> 0 THEN 'share.json' END", "bundle_exists": f"{c} % 6 <> 0"}
    return delivery.validated(Relation("customer").select(lambda d: given | paths | {"event_text": event(d), "manifest_text": manifest(d)}))


def _passes() -> Relation:
    """Governance passes by customer with the texts of their artifacts, some absent, empty, cut or without a member, by the customer's number."""
    c = "c_custkey"
    rate = lambda n, k: f"CAST(CAST(({c} * {n} % 100) / 100.0 AS DECIMAL(4,2)) AS STRING)" if k else f"CASE WHEN {c} % {n} = 0 THEN 'null' ELSE CAST(CAST(({c} % {n}) / {n}.0 AS DECIMAL(6,4)) AS STRING) END"
    number = lambda x: f"CAST({x} AS STRING)"

    def evaluation_text(d: Dialect) -> str:
        trace = f"""CASE WHEN {c} % 8 = 0 THEN 'null' ELSE concat('{{"gold_to_silver_link_rate":', CASE WHEN {c} % 3 = 0 THEN '1.0' ELSE {rate(7, True)} END, ',"silver_to_bronze_link_rate":1.0,"pipeline_run_id_coverage":', CASE WHEN {c} % 6 = 0 THEN '0.5' ELSE '1.0' END, ',"orphaned_silver_count":', {number(f'{c} % 4')}, ',"orphaned_gold_count":', {number(f'{c} % 3')}, '}}') END"""
        notes_ = f"""CASE {c} % 4 WHEN 0 THEN '[]' WHEN 1 THEN '["a","b","c","d","e","f"]' WHEN 2 THEN 'null' ELSE '["x"]' END"""
        whole = f"""concat('{{"bronze":{{"metrics":{{"parse_success_rate":', {rate(3, True)}, '}}}},"silver":', CASE WHEN {c} % 5 = 0 THEN 'null' ELSE concat('{{"metrics":{{"schema_validity_rate":', {rate(11, False)}, '}}}}') END, ',"gold":{{"metrics":{{"export_ready_rate":', {rate(13, True)}, ',"classification_success_rate":"high"', CASE WHEN {c} % 7 = 0 THEN ',"schema_version_distribution":{{"v0.1.0":3,"v0.2.0":1}}' ELSE '' END, '}}}},"traceability":', {trace}, ',"bootstrap_path_detected":', CASE WHEN {c} % 9 = 0 THEN 'true' ELSE 'false' END, ',"all_observations":', {notes_}, CASE WHEN {c} % 2 = 0 THEN ',"pipeline_run_id_filter":"run-a"' ELSE '' END, '}}')"""
        return f"CASE WHEN {c} % 10 = 0 THEN NULL WHEN {c} % 23 = 0 THEN ' {{ }} ' WHEN {c} % 29 = 0 THEN '{{cut' WHEN {c} % 31 = 0 THEN '[1]' ELSE {whole} END"

    def handoff_text(d: Dialect) -> str:
        whole = f"""concat('{{"pipeline_run_id":', CASE {c} % 3 WHEN 0 THEN '"run-a"' WHEN 1 THEN '"run-b"' ELSE 'null' END, ',"total_records_processed":', {number(f'{c} % 50')}, ',"total_eligible":', {number(f'{c} % 20')}, ',"total_exported":', {number(f'{c} % 9')}, ',"total_quarantined":', CASE WHEN {c} % 12 = 0 THEN 'null' ELSE {number(f'{c} % 13')} END, ',"total_contract_blocked":', {number(f'{c} % 3')}, ',"quarantined_document_ids":["q', {number(c)}, '"]}}')"""
        return f"CASE WHEN {c} % 11 = 0 THEN NULL ELSE {whole} END"

    def queue_text(d: Dialect) -> str:
        whole = f"""concat('{{"pipeline_run_id":', CASE {c} % 4 WHEN 0 THEN '"run-a"' WHEN 1 THEN '"run-c"' ELSE '""' END, ',"schema_version":"v0.1.0","total_records_reviewed":', {number(f'{c} % 15')}, ',"total_entries":', {number(f'{c} % 6')}, ',"entries_by_reason":{{"quarantined":', {number(f'{c} % 5')}, ',"contract_blocked":1}}}}')"""
        return f"CASE WHEN {c} % 13 = 0 THEN NULL ELSE {whole} END"

    given = {"key": c, "report_id": f"concat('gov ', CAST({c} AS STRING))", "generated_at": "'then'", "environment": f"CASE {c} % 4 WHEN 0 THEN 'dev' WHEN 1 THEN 'prod' WHEN 2 THEN 'staging' ELSE 'lab' END"}
    paths = {"evaluation_path": f"CASE WHEN {c} % 10 <> 0 THEN 'report.json' END", "handoff_path": f"CASE WHEN {c} % 11 <> 0 THEN 'handoff.json' END", "bundle_path": f"CASE WHEN {c} % 2 = 0 THEN 'bundle.json' END", "queue_path": f"CASE WHEN {c} % 13 <> 0 THEN 'queue.json' END"}
    bundle = f"""CASE WHEN {c} % 3 = 0 THEN concat('{{"batch_id":"batch-', CAST({c} AS STRING), '"}}') END"""
    return governance.governed(Relation("customer").select(lambda d: given | paths | {"evaluation_text": evaluation_text(d), "handoff_text": handoff_text(d), "bundle_text": bundle, "queue_text": queue_text(d)}))


def _traced() -> Relation:
    """One row with the links between the layers, and the shares of records with run and version."""
    rates = _trace_rates().select(lambda d: {"gold_to_silver_link_rate": "gold_to_silver_rate", "silver_to_bronze_link_rate": "silver_to_bronze_rate", "orphaned_gold_count": "orphaned_gold_count", "orphaned_silver_count": "orphaned_silver_count"})
    return _beside(rates, _coverage_of_layers().select(lambda d: {"pipeline_run_id_coverage": "run_id_coverage", "schema_version_coverage": "schema_version_coverage", "placeholder_runs": "placeholder_runs"}))


def _observed() -> Relation:
    """Gold metrics of a batch part of which came without confidences and from a placeholder run, with observations."""
    rows = all_gold().select(lambda d: {k: k for k in GOLD_COLUMNS if k != "classification_confidence"} | {"classification_confidence": "CASE WHEN ord % 3 = 0 THEN classification_confidence END", "pipeline_run_id": "CASE WHEN ord % 10 = 0 THEN 'bootstrap_sql_v1' ELSE 'run-1' END"})
    found = rows.agg((), lambda d: {**E.gold_metrics(d), "placeholders": d.count_if(d.isin("pipeline_run_id", V.PLACEHOLDER_RUNS))})
    return found.add(lambda d: {"null_confidences": "CAST(floor(confidence_null_rate * total_records) AS BIGINT)"}).add(E.observations)


def _report() -> Relation:
    """One row: all layers' warnings together, how many records wait for review, whether placeholder runs were met."""
    layers = {
        "bronze": (_beside(R.natural().agg((), E.bronze_metrics), _bronze_p()), V.BRONZE_TARGETS, E.flagged(R.natural(), E.bronze_flags)),
        "silver": (_beside(all_silver().agg((), E.silver_metrics), E.nearest(all_silver(), "field_coverage_pct", {"p25_field_coverage_pct": 25}), _required_nulls()), V.SILVER_TARGETS, E.flagged(all_silver(), E.silver_flags)),
        "gold": (all_gold().agg((), E.gold_metrics), V.GOLD_TARGETS, E.flagged(outcomes(), E.gold_flags)),
    }
    parts = []
    for name, (whole, targets, flagged) in layers.items():
        parts.append(whole.add(lambda d, t=targets: E.warnings(d, t)).select(lambda d, n=name: {f"{n}_warnings": "threshold_warnings"}))
        parts.append(flagged.agg((), lambda d, n=name: {f"{n}_flagged": "count(*)"}))
    traced = _traced().add(lambda d: E.warnings(d, V.TRACE_TARGETS)).select(lambda d: {"trace_warnings": "threshold_warnings", "bootstrap_path_detected": "placeholder_runs > 0"})
    whole = _beside(parts[0], *parts[1:], traced)
    return whole.select(lambda d: {"all_warnings": d.join(d.plus("bronze_warnings", "silver_warnings", "gold_warnings", "trace_warnings"), "; "), "review_queue_size": "bronze_flagged + silver_flagged + gold_flagged", "bootstrap_path_detected": "bootstrap_path_detected"})


def _silver_rows() -> Relation:
    """Silver records some of which break a rule, by their number."""
    kept = {k: k for k in ("document_id", "bronze_record_id", "domain", "extraction_id")}
    broken = {
        "pipeline_run_id": "CASE WHEN ord % 71 = 0 THEN NULL ELSE pipeline_run_id END",
        "validation_status": "CASE WHEN ord % 41 = 0 THEN 'lost' WHEN ord % 43 = 0 THEN NULL ELSE validation_status END",
        "field_coverage_pct": "CASE WHEN ord % 47 = 0 THEN 1.5e0 WHEN ord % 53 = 0 THEN NULL ELSE field_coverage_pct END",
        "has_fields": "ord % 6 <> 0",
    }
    return all_silver().select(lambda d: kept | broken)


def _bronze_rows() -> Relation:
    """Bronze records some of which break a rule, by their number."""
    known = ("document_id", "parsed_text", "char_count")
    return R.natural().select(
        lambda d: {k: k for k in known}
        | {
            "file_extension": f"CASE WHEN ord % 61 = 0 THEN '.xls' ELSE {d.extract('file_name', '([.][^./]+)$', '')} END",
            "file_hash": "CASE WHEN ord % 67 = 0 THEN left(file_hash, 63) ELSE upper(file_hash) END",
            "parse_status": "CASE WHEN ord % 71 = 0 THEN NULL ELSE parse_status END",
            "parse_failure_reason": "CASE WHEN ord % 2 = 0 THEN parse_error END",
            "file_size_bytes": "char_count",
        }
    ).add(bronze.constraints)


def _batch() -> Relation:
    """One row: the batch's report with what came before the gate, and the run's name."""
    made = all_silver().agg((), lambda d: {"total_records_processed": "count(*)", "total_ineligible_skipped": d.count_if("validation_status = 'invalid'")})
    named = {"pipeline_run_id": "'run-1'", "processed_at": "'2024-01-01T00:00:00+00:00'", "manifest_version": f"'{V.SCHEMA_VERSION}'", "schema_version": f"'{V.SCHEMA_VERSION}'", "report_attached": "true", "path_source": "'path rule'", "contract_source": "'contract'"}
    return _beside(outcomes().agg((), B.report), made).add(lambda d: named).add(notes.manifest_notes)


def _queue() -> Relation:
    """One row: the review queue's counts and notes."""
    named = {"pipeline_run_id": "'run-1'", "review_queue_id": "'queue-1'", "processed_at": "'2024-01-01T00:00:00+00:00'", "schema_version": f"'{V.SCHEMA_VERSION}'", "bundle_path": "'bundle_run-1.json'", "report_path": "CAST(NULL AS STRING)", "decision_source": "'decisions'"}
    return outcomes().add(B.review).agg((), B.queue_counts).add(lambda d: named).add(notes.queue_notes)


def _entries() -> Relation:
    """The review queue's entries, with an id of their own, paths and errors."""
    rows = outcomes().add(B.review).where(lambda d: "review_reason_category IS NOT NULL").add(B.review_text).add(B.references)
    kept = ("document_id", "gold_record_id", "pipeline_run_id", "document_type_label", "routing_label", "review_reason", "review_reason_category", "gold_artifact_path", "export_artifact_path", "contract_errors")
    return rows.select(lambda d: {"queue_entry_id": d.made_id("'queue'", "pipeline_run_id", "gold_record_id")} | {k: k for k in kept} | {"bundle_path": "'bundle_run-1.json'", "report_path": "CAST(NULL AS STRING)"})


def _decisions() -> Relation:
    """Decisions on orders, with missing columns and unknown decisions by the order's number."""
    o = "o_orderkey"
    some = lambda n, x: f"CASE WHEN {o} % {n} = 0 THEN '' WHEN {o} % {n} = 1 THEN NULL ELSE {x} END"
    named = " ".join(f"WHEN {i} THEN '{k}'" for i, k in enumerate(V.DECISIONS))
    return Relation("orders").select(
        lambda d: {
            "decision_id": some(31, f"concat('d', CAST({o} AS STRING))"), "queue_entry_id": some(37, f"concat('q', CAST({o} % 5000 AS STRING))"), "document_id": some(41, f"CAST({o} AS STRING)"), "pipeline_run_id": some(43, "'run-1'"),
            "decided_at": some(47, "'2024-01-01'"), "decision_rationale": some(5, "'seen'"), "decision": f"CASE {o} % 6 {named} WHEN 4 THEN 'escalate' END", "reprocessing_request_id": some(7, f"concat('r', CAST({o} AS STRING))"),
        }
    )


def _requests() -> Relation:
    queue = Relation("customer").where(lambda d: "c_custkey < 5000").select(lambda d: {"queue_entry_id": "concat('q', CAST(c_custkey AS STRING))", "gold_record_id": "concat('g', CAST(c_custkey AS STRING))", "review_reason_category": "'quarantined'"})
    return review.requested(_decisions(), queue)


def _files() -> Relation:
    """Letters as files: path, length, content."""
    rows = R.letters().select(lambda d: {"path": "concat('/raw/letters/', document_id, '.txt')", "content": "parsed_text", "parsed_text": "parsed_text"})
    return rows.add(lambda d: {"length": d.octets("content")}).select(bootstrap.bronze_projection)


def _governed() -> Relation:
    """Governance with its notes; one artifact is missing."""
    given = {"environment": "'dev'", "has_evaluation": "true", "has_handoff": "true", "has_bundle": "false", "has_queue": "true"}
    return _governance().add(lambda d: given).add(notes.governance_inputs).add(notes.governance_notes)


def _counts(relation: Relation, *keys: str) -> Relation:
    return relation.agg(keys, lambda d: {"n": "count(*)"})


def _texts(names):
    return lambda d: flat(d, names)


RELATIONS: dict[str, Callable[[], Relation]] = {
    # Bronze
    "bronze_parse_status": lambda: R.natural().select(lambda d: {k: k for k in ("document_id", "parse_status", "char_count", "parse_model")}),
    "bronze_file_hash": lambda: R.natural().select(lambda d: {"document_id": "document_id", "file_hash": "file_hash"}),
    "bronze_constraints": lambda: _bronze_rows().select(lambda d: {"document_id": "document_id", "violations": d.join("constraint_violations", ",")}),
    "bronze_metrics": lambda: R.natural().agg((), E.bronze_metrics),
    "bronze_percentiles": _bronze_p,
    "bronze_flags": lambda: E.flagged(R.natural(), E.bronze_flags).select(_texts(("document_id", "parse_status", "char_count", "review_reasons"))),
    "bronze_thresholds": lambda: _warned(_beside(R.natural().agg((), E.bronze_metrics), _bronze_p()), V.BRONZE_TARGETS),
    # Silver
    "fda_fields": lambda: fields(V.LETTER),
    "cisa_fields": lambda: fields(V.ADVISORY),
    "incident_fields": lambda: fields(V.INCIDENT),
    "fda_regulations": lambda: _counts(fields(V.LETTER, ("cited_regulations", "violation_type")).select(lambda d: {"cited_regulations": "cited_regulations"}), "cited_regulations"),
    "cisa_severity": lambda: _counts(fields(V.ADVISORY, ("severity_level",)).select(lambda d: {"severity_level": "severity_level"}), "severity_level"),
    "cisa_remediation": lambda: _counts(fields(V.ADVISORY, ("remediation_available",)).select(lambda d: {"remediation_available": "remediation_available"}), "remediation_available"),
    "incident_severity": lambda: _counts(fields(V.INCIDENT, ("severity", "status")).select(lambda d: {"severity": "severity", "status": "status"}), "severity", "status"),
    "norm_dates": lambda: Relation("orders").select(lambda d: {"key": "o_orderkey", "raw": f"CASE o_orderkey % 4 WHEN 0 THEN {R._long_date('o_orderdate')} WHEN 1 THEN concat(CAST(month(o_orderdate) AS STRING), '/', CAST(day(o_orderdate) AS STRING), '/', CAST(year(o_orderdate) AS STRING)) WHEN 2 THEN '14 March 2025' ELSE 'Foo 3, 2020' END"}).select(lambda d: {"key": "key", "with_slashes": iso_date(d, "raw", True), "without": iso_date(d, "raw", False)}),
    "summary_sentences": lambda: Relation("documents").select(lambda d: {"doc_id": "doc_id", "summary": d.sentences("text")}),
    **{f"{n}_validation": (lambda k=k: silver_of(k).select(_texts(("document_id", "field_coverage_pct", "validation_status", "validation_errors")))) for n, k in (("fda", V.LETTER), ("cisa", V.ADVISORY), ("incident", V.INCIDENT))},
    "silver_constraints": lambda: _silver_rows().add(silver.constraints).select(lambda d: {"document_id": "document_id", "violations": d.join("constraint_violations", ",")}),
    "silver_coverage": lambda: all_silver().agg(("domain", "field_coverage_pct"), lambda d: {"n": "count(*)"}),
    "silver_metrics": lambda: all_silver().agg((), E.silver_metrics),
    "silver_percentiles": lambda: E.nearest(all_silver(), "field_coverage_pct", {"p25_field_coverage_pct": 25}),
    "silver_required_nulls": lambda: silver_of(V.LETTER).agg((), lambda d: E.required_null_rate(d, V.REQUIRED[V.LETTER])),
    "silver_error_frequency": lambda: E.error_frequency(all_silver(), V.DOMAINS),
    "silver_flags": lambda: E.flagged(all_silver(), E.silver_flags).select(_texts(("document_id", "validation_status", "review_reasons"))),
    "silver_thresholds": lambda: _warned(_beside(all_silver().agg((), E.silver_metrics), E.nearest(all_silver(), "field_coverage_pct", {"p25_field_coverage_pct": 25}), _required_nulls()), V.SILVER_TARGETS),
    # Gold
    "gold_signals": lambda: silver_of(V.INCIDENT).add(lambda d: signals(d, V.INCIDENT)).select(lambda d: {"document_id": "document_id", "signals": "signals"}),
    "gold_confidence": lambda: all_gold().select(lambda d: {k: k for k in ("document_id", "document_type_label", "classification_confidence")}),
    "gold_routing": lambda: _counts(all_gold(), "document_type_label", "routing_label"),
    "gold_export_ready": lambda: all_gold().select(lambda d: {"document_id": "document_id", "export_ready": "export_ready"}),
    "gold_metrics": lambda: all_gold().agg((), E.gold_metrics),
    "gold_null_confidence": lambda: all_gold().select(lambda d: {c: c for c in GOLD_COLUMNS if c != "classification_confidence"} | {"classification_confidence": "CASE WHEN ord % 3 = 0 THEN classification_confidence END"}).agg((), E.gold_metrics),
    "gold_thresholds": lambda: all_gold().agg((), E.gold_metrics).add(lambda d: E.warnings(d, V.GOLD_TARGETS)).select(lambda d: {"threshold_warnings": d.join("threshold_warnings", "; ")}),
    "label_distribution": lambda: E.ranked(all_gold().select(lambda d: {"document_type_label": f"CASE WHEN ord % 21 = 0 THEN '{V.UNKNOWN}' ELSE coalesce(document_type_label, '{V.UNKNOWN}') END"}), "document_type_label"),
    "gold_observations": lambda: _observed().select(lambda d: {"observations": d.join("observations", " | ")}),
    "gold_flags": lambda: E.flagged(outcomes(), E.gold_flags).select(_texts(("gold_record_id", "document_type_label", "review_reasons"))),
    # Contract and batch
    **{f"{name}_typed": (lambda domain=domain: _typed(domain)) for name, domain in (("fda", V.LETTER), ("cisa", V.ADVISORY), ("incident", V.INCIDENT))},
    "contract_errors": lambda: validated(payloads()).select(lambda d: {"document_id": "document_id", "errors": d.join("contract_found", "; ")}),
    "export_gate": lambda: gated(payloads()).select(lambda d: {"document_id": "document_id", "was_ready": "was_ready", "exported": "exported", "n_errors": d.size("contract_errors")}),
    "quarantine_shape": lambda: payloads().add(lambda d: {"export_path": "CASE WHEN ord % 4 = 0 THEN 'a/b.json' END"}).add(quarantine_errors).select(lambda d: {"document_id": "document_id", "errors": d.join("quarantine_errors", "; ")}),
    "outcomes": lambda: _counts(outcomes(), "outcome_category", "outcome_reason", "routing_label"),
    "handoff_report": lambda: outcomes().agg((), B.report),
    "handoff_manifest_refs": lambda: outcomes().add(B.references).select(lambda d: {k: k for k in ("document_id", "gold_record_id", "routing_label", "outcome_category", "outcome_reason", "list_name", "gold_artifact_path", "export_artifact_path")}),
    "review_queue": lambda: outcomes().add(B.review).where(lambda d: "review_reason_category IS NOT NULL").select(lambda d: {k: k for k in ("document_id", "gold_record_id", "review_reason_category")}),
    "review_queue_counts": lambda: outcomes().add(B.review).agg((), B.queue_counts),
    "review_reason_text": lambda: outcomes().add(B.review).add(B.review_text).where(lambda d: "review_reason_category IS NOT NULL").select(lambda d: {"document_id": "document_id", "review_reason": "review_reason"}),
    "review_queue_entries": lambda: _entries().select(lambda d: flat(d, ("queue_entry_id", "document_id", "gold_record_id", "pipeline_run_id", "document_type_label", "routing_label", "review_reason", "review_reason_category", "gold_artifact_path", "export_artifact_path", "bundle_path", "report_path", "contract_errors"))),
    "review_queue_notes": lambda: _queue().select(lambda d: {"review_notes": d.join("review_notes", " | ")}),
    "review_queue_text": lambda: notes.queue_lines(_queue(), _entries()),
    "review_decisions": lambda: _decisions().add(review.decision_checks).select(lambda d: {k: k for k in ("decision_id", "decision", "is_actionable", "is_terminal")} | {"decision_errors": d.join("decision_errors", " ")}),
    "reprocessing_requests": lambda: _requests(),
    "reprocessing_checks": lambda: _requests().select(lambda d: {k: k for k in ("reprocessing_request_id", "document_id", "original_pipeline_run_id", "linked_queue_entry_id", "linked_decision_id")} | {"requested_at": "CASE WHEN linked_queue_entry_id LIKE '%7' THEN '' ELSE requested_at END", "reprocessing_reason": "CASE WHEN linked_decision_id LIKE '%3' THEN NULL ELSE reprocessing_reason END"}).add(review.request_checks).select(lambda d: {"linked_decision_id": "linked_decision_id", "request_errors": d.join("request_errors", " ")}),
    "manifest_notes": lambda: _batch().select(lambda d: {"review_notes": d.join("review_notes", " | ")}),
    "handoff_report_text": lambda: notes.report_lines(_batch(), outcomes()),
    "manifest_text": lambda: notes.bundle_lines(_batch(), outcomes().add(B.references)),
    "delivery_event": lambda: outcomes().agg((), B.delivery_event),
    "bundle_checks": lambda: outcomes().add(B.references).add(lambda d: {"broken": "CASE WHEN ord % 101 = 0 THEN NULL ELSE export_artifact_path END"}).select(lambda d: {k: k for k in ("list_name", "outcome_category", "routing_label")} | {"export_artifact_path": "broken"}).agg((), B.bundle_checks),
    "bundle_duplicates": lambda: B.duplicates(outcomes().select(lambda d: {"document_id": "concat('d', CAST(ord % 5000 AS STRING))"}), "document_id"),
    "delivery_status_matrix": lambda: Relation("nation").select(lambda d: {"n": "n_nationkey", "critical_failed": "n_nationkey % 5 = 0", "any_failed": "n_nationkey % 5 = 0 OR n_nationkey % 3 = 0", "provisioned": "n_nationkey % 2 = 0", "workspace_mode": "CASE WHEN n_nationkey % 4 = 0 THEN 'local_repo_only' ELSE 'personal_databricks' END"}).add(B.delivery_status).select(lambda d: {"n": "n", "first_status": "first_status", "validation_status": "validation_status"}),
    # Lineage and governance
    "trace_rates": _trace_rates,
    "trace_coverage": _coverage_of_layers,
    "trace_orphan_gold": lambda: E.orphans(trace()[2], trace()[1], "extraction_id").select(lambda d: {"gold_record_id": "gold_record_id", "extraction_id": "extraction_id"}),
    "trace_orphan_silver": lambda: E.orphans(trace()[1], trace()[0], "bronze_record_id").select(lambda d: {"extraction_id": "extraction_id", "bronze_record_id": "bronze_record_id"}),
    "trace_thresholds": lambda: _warned(_traced(), V.TRACE_TARGETS),
    "trace_observations": lambda: evaluation.measured("traceability", *trace()).select(lambda d: {"observations": d.join("observations", " | "), "placeholders": "placeholders", "placeholder_list": "placeholder_list"}),
    "evaluation_report": _report,
    "lineage_trace_sql": _lineage,
    "lineage_summary_sql": lambda: _lineage().agg((), lambda d: {"total_documents": "count(*)", "silver_count": d.count_if("silver_exists"), "gold_export_ready_count": d.count_if("coalesce(export_ready, false)"), "quarantine_count": d.count_if("coalesce(routing_label, '') = 'quarantine'"), "full_lineage_count": d.count_if("full_lineage = 'complete'")}),
    "governance_flags": lambda: _governance().select(lambda d: {"flags": d.join("flags", ",")}),
    "governance_health": lambda: _governance().select(lambda d: {k: k for k in ("overall_health", "export_rate", "quarantine_share", "queue_pressure")}),
    "governance_reports": lambda: _passes().select(lambda d: {k: f"round({k}, 6)" for k in (*governance.RATES, *governance.SHARES, "review_queue_pressure_pct")} | {k: k for k in ("key", "overall_health", "bundle_used", *governance.ORPHANS, *governance.TOTALS)} | {k: d.join(k, " | ") for k in ("flags", "governance_notes", "quality_observations", "handoff_observations", "review_queue_observations", "drift_observations", "input_pipeline_run_ids", "schema_versions_detected", "entries_by_reason", "quarantined_document_ids")}),
    "governance_notes": lambda: _governed().select(lambda d: {"governance_notes": d.join("governance_notes", " | ")}),
    "bootstrap_bronze": lambda: _files().select(lambda d: {k: k for k in ("document_id", "source_path", "file_name", "file_size_bytes", "file_hash", "parse_status", "pipeline_run_id", "schema_version")}),
    "bootstrap_silver": lambda: bootstrap.silver_projection(_files()).select(lambda d: {"document_id": "document_id", "file_name": "file_name", "extraction_prompt_id": "extraction_prompt_id", **{n: d.json_text("extraction_result", n) for n in bootstrap.FIELDS}}),
    "bootstrap_gold": lambda: bootstrap.gold_projection(bootstrap.silver_projection(_files())).select(lambda d: {k: k for k in ("document_id", "document_type_label", "routing_label", "classification_confidence", "export_ready", "pipeline_run_id", "schema_version")}),
    "routing_distinct": lambda: outcomes().where(lambda d: "export_ready").agg(("routing_label",), lambda d: {"n": "count(*)"}).select(lambda d: {"routing_label": "routing_label"}),
    "metric_drift": _run_metrics,
    "orphan_flags": lambda: E.orphans(trace()[2], trace()[1], "extraction_id").select(lambda d: {"layer": "'gold'", "issue": "'orphaned_gold'", "record_id": "gold_record_id"}).union(E.orphans(trace()[1], trace()[0], "bronze_record_id").select(lambda d: {"layer": "'silver'", "issue": "'orphaned_silver'", "record_id": "extraction_id"})),
    "manifest_count_checks": lambda: _manifest().add(B.manifest_counts).select(lambda d: {"batch_id": "batch_id", "failed_checks": d.join("failed_checks", ",")}),
    "bundle_structure": lambda: _bundles().select(lambda d: {"key": "key", "failed": d.join("failed_structure", ",")}),
    "bundle_results": lambda: _bundles().add(B.bundle_result).select(lambda d: {k: k for k in ("key", "checks_run", "checks_passed", "checks_failed", "bundle_valid")} | {"failed": d.join("failed", ",")}),
    "delivery_checks": lambda: _deliveries().select(lambda d: {"key": "key", "failed": d.join("failed", ","), "passed": f"14 - {d.size('failed')}"}),
    "delivery_results": lambda: _delivered().select(lambda d: {k: k for k in ("key", "found_event_id", "validation_status", "validation_reason", "n_all_passed", "n_all_failed")} | {k: d.join(k, " | ") for k in ("checks_passed", "checks_failed", "observations", "artifacts_checked")} | {"details": d.join(d.nonnull([*[f"detail_{n}" for n, *_ in delivery.CHECKS], "evidence"]), " | ")}),
    "missing_paths": lambda: B.missing_paths(outcomes().add(B.references), outcomes().where(lambda d: "ord % 13 <> 0").add(B.references).select(lambda d: {"path": "gold_artifact_path"}).union(outcomes().where(lambda d: "ord % 11 <> 0").add(B.references).select(lambda d: {"path": "coalesce(export_artifact_path, '')"})).agg(("path",), lambda d: {"k": "count(*)"}).select(lambda d: {"path": "path"})),
    "latest_delivery_events": lambda: Relation("events").select(lambda d: {"delivery_event_id": "CAST(event_id AS STRING)", "generated_at": "ts", "event_id": "event_id"}).top("generated_at DESC, event_id DESC", 5).select(lambda d: {"delivery_event_id": "delivery_event_id"}),
    "export_ready_sample": lambda: _shared_gold().where(lambda d: f"export_ready AND schema_version = '{V.SCHEMA_VERSION_DELIVERY}'").select(lambda d: {k: k for k in ("document_id", "routing_label", "schema_version")}).top("document_id", 10),
    "metric_rows": lambda: all_gold().agg((), E.gold_metrics).select(lambda d: {"pairs": d.nonnull([f"concat('{k}=', {d.fixed(f'CAST({k} AS DOUBLE)', 4)})" for k in ("classification_success_rate", "quarantine_rate", "export_ready_rate", "mean_classification_confidence")])}).explode("pairs", "pair").select(lambda d: {"pair": "pair"}),
    "bronze_source_links": lambda: E.link_rate(trace()[0].select(lambda d: {"document_id": "document_id"}), Relation("events").where(lambda d: "event_type = 'error' AND event_id % 4 <> 0").select(lambda d: {"document_id": "CAST(event_id AS STRING)"}), "document_id", "bronze_to_source").select(lambda d: {"bronze_to_source_rate": "bronze_to_source_rate", "unlinked": "orphaned_bronze_count"}),
    "review_rates": lambda: outcomes().add(B.review).agg((), B.queue_counts).select(lambda d: {"review_queue_rate": "round(total_entries / CAST(nullif(total_records_reviewed, 0) AS DOUBLE), 4)", "entries": "total_entries"}),
}

def _shared_gold() -> Relation:
    """Gold rows as a share shows them, two thirds of them of batches that were delivered and carry the delivery's version."""
    return outcomes().add(lambda d: {"schema_version": f"CASE WHEN ord % 3 = 0 THEN '{V.SCHEMA_VERSION}' ELSE '{V.SCHEMA_VERSION_DELIVERY}' END"})


def evaluation_partial(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The evaluation run where Silver isn't there: Bronze and Gold are measured, Silver and lineage are null."""
    result, _ = evaluation.run(spark, {"bronze": R.natural().frame(spark, sf_dir), "silver": None, "gold": outcomes().frame(spark, sf_dir)})
    return result.select("layer", "present", "total_records", "flagged_record_count", F.array_join("threshold_warnings", "; ").alias("warnings"), F.array_join("observations", "; ").alias("observations"))


def tracked_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gold's metrics as the tracker's rows."""
    return sinks.metric_rows(evaluation.gold(outcomes()).frame(spark, sf_dir).select(*evaluation.SHOWN["gold"]), "gold", "run-1")


def sql_function_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Letters' fields and labels by the registered SQL functions."""
    return statements.sql_fields(spark, R.letters().frame(spark, sf_dir))


def _sql_function_sql() -> str:
    names, least = V.SIGNALS[V.LETTER]
    there = " + ".join(f"CASE WHEN coalesce(CAST({n} AS STRING), '') <> '' THEN 1 ELSE 0 END" for n in names if n in bootstrap.FIELDS)
    kept = {n: f"CAST({n} AS STRING)" for n in bootstrap.FIELDS}
    return with_fields(R.letters(), V.LETTER).select(lambda d: {"document_id": "document_id", **kept, "document_type_label": f"CASE WHEN {there} >= {least} THEN '{V.LETTER}' ELSE '{V.UNKNOWN}' END"}).sql()


def _evaluation_sql() -> str:
    parts = []
    for layer, table in (("bronze", R.natural()), ("gold", outcomes())):
        one, flags = evaluation.measured(layer, table).sql(), evaluation.flagged(layer, table).sql()
        parts.append(f"SELECT '{layer}' AS layer, true AS present, CAST(total_records AS BIGINT) AS total_records, (SELECT count(*) FROM ({flags})) AS flagged_record_count, array_to_string(threshold_warnings, '; ') AS warnings, array_to_string(observations, '; ') AS observations FROM ({one})")
    parts += [f"SELECT '{layer}', false, NULL, NULL, NULL, NULL" for layer in ("silver", "traceability")]
    return " UNION ALL ".join(parts)


def _tracked_sql() -> str:
    rows = " UNION ALL ".join(f"SELECT 'gold' AS experiment, 'run-1' AS run, '{k}' AS key, CAST({k} AS DOUBLE) AS value FROM m" for k in evaluation.SHOWN["gold"])
    return f"WITH m AS ({evaluation.gold(outcomes()).sql()}) SELECT * FROM ({rows}) WHERE value IS NOT NULL"


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {name: (lambda spark, sf_dir, make=make: make().frame(spark, sf_dir)) for name, make in RELATIONS.items()} | documents.QUERIES | {"evaluation_partial": evaluation_partial, "tracked_metrics": tracked_metrics, "sql_function_fields": sql_function_fields}

ORACLE_SQL: dict[str, str] = {name: make().sql() for name, make in RELATIONS.items()} | documents.ORACLE_SQL | {"evaluation_partial": _evaluation_sql(), "tracked_metrics": _tracked_sql(), "sql_function_fields": _sql_function_sql()}
