"""Gold: signals, confidence, routing, readiness, payload."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import vocab as V
from ..functions.dialect import Dialect
from .silver import populated


def eligible(d: Dialect) -> str:
    return "coalesce(validation_status, '') <> 'invalid'"


def signals(d: Dialect, domain: str) -> dict[str, str]:
    names, least = V.SIGNALS[domain]
    filled = " + ".join(f"CASE WHEN {populated(d, n)} THEN 1 ELSE 0 END" for n in names)
    found = [
        f"coalesce(document_class_hint, '') = '{domain}'",
        f"({filled}) >= {least}",
        "coalesce(validation_status, '') IN ('valid', 'partial')",
        f"coalesce(field_coverage_pct, 0.0) >= {V.LEAST_COVERAGE}",
    ]
    return {"signals": " + ".join(f"CASE WHEN {s} THEN 1 ELSE 0 END" for s in found)}


def classified(d: Dialect, domain: str) -> dict[str, str]:
    """Two signals make a label; the score grows with hint, validity and coverage, added in that order."""
    hinted = f"CASE WHEN coalesce(document_class_hint, '') = '{domain}' THEN {V.HINTED}e0 ELSE 0e0 END"
    valid = f"CASE WHEN validation_status = 'valid' THEN {V.VALID}e0 ELSE 0e0 END"
    covered = f"CASE WHEN coalesce(field_coverage_pct, 0.0) >= {V.FULL_COVERAGE} THEN {V.COVERED}e0 ELSE 0e0 END"
    score = f"round(least(1e0, {V.BASE}e0 + {hinted} + {valid} + {covered}), 4)"
    return {
        "document_type_label": f"CASE WHEN signals >= 2 THEN '{domain}' ELSE '{V.UNKNOWN}' END",
        "classification_confidence": f"CASE WHEN signals >= 2 THEN {score} ELSE 0e0 END",
    }


def routed(d: Dialect) -> dict[str, str]:
    """Quarantine for unknown, unsure, invalid or thin records; else by label. A null confidence passes."""
    bad = [f"document_type_label = '{V.UNKNOWN}'", f"classification_confidence < {V.LEAST_CONFIDENCE}", "validation_status = 'invalid'", f"coalesce(field_coverage_pct, 0.0) < {V.LEAST_COVERAGE}"]
    routes = [(f"document_type_label = '{k}'", f"'{v}'") for k, v in V.ROUTES.items()]
    return {"routing_label": d.ladder(*[(b, f"'{V.QUARANTINE}'") for b in bad], *routes, other=f"'{V.QUARANTINE}'")}


def ready(d: Dialect) -> dict[str, str]:
    return {
        "export_ready": f"document_type_label <> '{V.UNKNOWN}' AND routing_label <> '{V.QUARANTINE}' AND coalesce(classification_confidence >= {V.LEAST_CONFIDENCE}, true)"
        f" AND coalesce(validation_status, '') IN ('valid', 'partial') AND coalesce(field_coverage_pct, 0.0) >= {V.LEAST_COVERAGE}"
        " AND coalesce(document_id, '') <> '' AND coalesce(document_type_label, '') <> ''"
    }


def outcome(d: Dialect) -> dict[str, str]:
    """What became of a record: exported, blocked by the contract, quarantined or skipped."""
    errors = f"coalesce({d.size('contract_errors')} > 0, false)"
    return {
        "outcome_category": d.ladder(("export_ready", "'exported'"), (errors, "'contract_blocked'"), (f"routing_label = '{V.QUARANTINE}'", "'quarantined'"), other="'skipped_not_export_ready'"),
        "outcome_reason": d.ladder(("export_ready", "'none'"), (errors, "'contract_validation_failed'"), (f"routing_label = '{V.QUARANTINE}'", "'routing_quarantine'"), other="'export_not_attempted'"),
    }


def graded(relation, domain: str):
    """Adds to a Silver relation of one domain: signals, label, confidence, route, readiness."""
    return relation.where(eligible).add(lambda d: signals(d, domain)).add(lambda d: classified(d, domain)).add(routed).add(ready)


def payload(row: DataFrame, run_id: str, delivery_event_id: str | None = None, mechanism: str | None = None, share: str | None = None) -> DataFrame:
    """Adds export_payload (JSON, null fields kept). Needs source_file, ingested_at and parsed_text beside Gold columns."""
    fields = F.coalesce(*[F.when(F.col("domain") == k, F.to_json(k, {"ignoreNullFields": "false"})) for k in V.DOMAINS], F.lit("{}"))
    version = V.SCHEMA_VERSION_DELIVERY if delivery_event_id else V.SCHEMA_VERSION
    provenance = [F.col("ingested_at").cast("string").alias("ingested_at"), F.lit(run_id).alias("pipeline_run_id"), F.col("extraction_model"), F.lit(V.CLASSIFIER).alias("classification_model"), F.col("classification_confidence"), F.lit(version).alias("schema_version")]
    if delivery_event_id:
        provenance += [F.lit(mechanism).alias("delivery_mechanism"), F.lit(share).alias("delta_share_name"), F.lit(delivery_event_id).alias("delivery_event_id")]
    head = F.to_json(F.struct("document_id", "source_file", F.col("document_type_label").alias("document_type"), "routing_label"), {"ignoreNullFields": "false"})
    tail = F.to_json(F.struct(F.left(F.coalesce("parsed_text", F.lit("")), F.lit(V.EXCERPT)).alias("parsed_text_excerpt"), F.struct(*provenance).alias("provenance")), {"ignoreNullFields": "false"})
    whole = F.concat(F.expr("left(_head, length(_head) - 1)"), F.lit(',"extracted_fields":'), F.col("_fields"), F.lit(","), F.expr("substr(_tail, 2)"))
    return row.withColumns({"_fields": fields, "_head": head, "_tail": tail}).withColumn("export_payload", whole).drop("_fields", "_head", "_tail")


def gold(silver: DataFrame, bronze: DataFrame, run_id: str, export_base: str = "exports", **delivery) -> DataFrame:
    """Gold records of eligible Silver records, with payload, contract errors, final readiness, export path and outcome.

    Bronze gives file name and ingest time by a left join; what it lacks reads 'unknown' and ''.
    """
    from ..plans.relation import Relation
    from .contract import gate

    looked_up = bronze.select("bronze_record_id", F.coalesce("file_name", "source_path", F.lit("unknown")).alias("source_file"), F.col("ingested_at").cast("string").alias("ingested_at"), "parsed_text")
    rows = silver.join(looked_up, "bronze_record_id", "left").fillna({"source_file": "unknown", "ingested_at": ""})
    parts = []
    for domain in V.DOMAINS:
        part = rows.where(F.col("domain") == domain).select("*", f"{domain}.*")
        part = graded(Relation(), domain).on(part).drop(*V.REQUIRED[domain], *V.OPTIONAL[domain], "signals")
        parts.append(part)
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    out = payload(out, run_id, **delivery)
    out = gate(out)
    out = out.withColumn("export_path", F.when(F.col("export_ready"), F.concat_ws("/", F.lit(export_base), "routing_label", F.concat("document_id", F.lit(".json")))))
    return out.withColumns({"gold_record_id": F.concat(F.lit("gold-"), "extraction_id"), "pipeline_run_id": F.lit(run_id), "classification_model": F.lit(V.CLASSIFIER)})
