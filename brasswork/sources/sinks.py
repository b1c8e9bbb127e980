"""Sinks: append-only layer tables, export payloads, report pairs, metric rows, share statements."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import vocab as V
from . import files


def append(df: DataFrame, path: str, by: str | None = None) -> None:
    """Append records to a layer's table."""
    writer = df.write.mode("append")
    (writer.partitionBy(by) if by else writer).parquet(path)


def export_table(gold: DataFrame, path: str) -> None:
    """Payloads of exported records, a folder per routing label."""
    rows = gold.where("export_ready").select("routing_label", "document_id", "export_payload")
    rows.write.mode("overwrite").partitionBy("routing_label").json(path)


def export_files(gold: DataFrame, base: str) -> None:
    """Exactly one file per exported record: <base>/<routing_label>/<document_id>.json, published when all are written."""
    rows = gold.where("export_ready")
    files.write(rows.select(F.concat("routing_label", F.lit("/"), "document_id", F.lit(".json")).alias("name"), F.col("export_payload").alias("content")), base)


def safe_name(run_id: str, delivery: bool = False) -> str:
    """A run id as a file name: reports replace / : and blanks, delivery artifacts / and backslashes."""
    return run_id.translate(str.maketrans({c: "_" for c in ("/\\" if delivery else "/: ")}))


def report_pair(report: DataFrame, kind: str, run_id: str) -> DataFrame:
    """A one-row report as (name, content) rows: JSON with nulls, and plain text lines."""
    name = f"{kind}_{safe_name(run_id)}"
    as_json = report.select(F.lit(f"{name}.json").alias("name"), F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("content"))
    lines = F.concat_ws("\n", F.lit(kind), *[F.concat(F.lit(f"{c}: "), F.coalesce(F.col(c).cast("string"), F.lit("n/a"))) for c in report.columns])
    return as_json.unionByName(report.select(F.lit(f"{name}.txt").alias("name"), lines.alias("content")))


def metric_rows(metrics: DataFrame, experiment: str, run_id: str) -> DataFrame:
    """Metrics as (experiment, run, key, value); nulls and booleans are left out."""
    kept = [c for c, t in metrics.dtypes if t not in ("boolean", "string") and not t.startswith(("array", "struct", "map"))]
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("key"), F.col(c).cast("double").alias("value")) for c in kept]))
    return metrics.select(F.lit(experiment).alias("experiment"), F.lit(run_id).alias("run"), pairs.alias("p")).select("experiment", "run", "p.key", "p.value").where("value is not null")


def track(metrics: DataFrame, run_id: str, base: str) -> None:
    """Append (layer, key, value) metrics of a run, a file for each metric: what the run has there already stays, and nulls aren't there."""
    told = metrics.where("value is not null").select(F.concat("layer", F.lit(f"/{safe_name(run_id)}/"), "key", F.lit(".json")).alias("name"), F.to_json(F.struct(F.col("layer").alias("experiment"), F.lit(run_id).alias("run"), "key", "value")).alias("content"))
    files.write(told, base, keep=True)


def tracked(spark, base: str) -> DataFrame:
    """(experiment, run, key, value) of all metrics that `track` wrote."""
    return spark.read.schema("experiment string, run string, key string, value double").option("recursiveFileLookup", "true").json(base)


def delivery_events_ddl(table: str) -> str:
    """Statement for the table of delivery events."""
    columns = ["delivery_event_id STRING NOT NULL", "pipeline_run_id STRING NOT NULL", "batch_id STRING NOT NULL", "delivery_mechanism STRING NOT NULL", "status STRING NOT NULL", "schema_version STRING NOT NULL", "generated_at TIMESTAMP NOT NULL", *[f"record_count_{k} BIGINT" for k in ("total", "exported", "quarantined", "contract_blocked", "skipped_not_export_ready")], "routing_labels ARRAY<STRING>", "share_name STRING", "shared_object_name STRING", "bundle_artifact_path STRING", "report_artifact_path STRING", "notes STRING"]
    return f"CREATE TABLE IF NOT EXISTS {table} (\n  " + ",\n  ".join(columns) + "\n) USING parquet"


def share_statements(share: str, recipient: str, gold: str, events: str, shared_as: str, version: str = V.SCHEMA_VERSION_DELIVERY) -> list[str]:
    """Statements that would set up a share; text only, never run here."""

    def text(s: str) -> str:
        return "'" + s.replace("'", "''") + "'"

    return [
        f"CREATE SHARE IF NOT EXISTS {share}\n  COMMENT {text(f'Gold table share. Schema version: {version}. Delivery mechanism: delta_sharing.')}",
        f"ALTER SHARE {share}\n  ADD TABLE {gold}\n  AS {shared_as}\n  COMMENT {text(f'Gold-tier classified AI-ready assets. Export-ready records only. schema_version: {version}.')}",
        f"ALTER SHARE {share}\n  ADD TABLE {events}\n  AS delivery_events\n  COMMENT {text('Per-batch delivery event log. One row per pipeline run.')}",
        f"CREATE RECIPIENT IF NOT EXISTS {recipient}\n  COMMENT {text('Recipient of the share. Its activation link is delivered out-of-band.')}",
        f"GRANT SELECT ON SHARE {share} TO RECIPIENT {recipient}",
    ]


def verification_statements(share: str) -> list[str]:
    """Statements by which the sender confirms the share and its grants."""
    return [f"SHOW ALL IN SHARE {share}", f"SHOW GRANTS ON SHARE {share}"]


def validation_statements(share: str, shared_as: str, events: str, version: str = V.SCHEMA_VERSION_DELIVERY) -> list[dict[str, str]]:
    """Queries by which a receiver checks what was shared: name, description, statement, what it should give."""
    return [
        {"name": "confirm_share_exists", "description": "Confirm the share exists in Unity Catalog.", "sql": f"SHOW ALL IN SHARE {share};", "expected": f"Table '{shared_as}' visible in share."},
        {
            "name": "query_export_ready_records",
            "description": "Query the shared Gold table for export-ready records from a V2 batch.",
            "sql": f"SELECT document_id, routing_label, schema_version FROM {share}.{shared_as} WHERE export_ready = true AND schema_version = '{version}' LIMIT 10;",
            "expected": "Rows present with schema_version = 'v0.2.0'.",
        },
        {
            "name": "query_delivery_events",
            "description": "Confirm at least one delivery event row is present.",
            "sql": f"SELECT delivery_event_id, batch_id, status, exported_record_count FROM {events} ORDER BY generated_at DESC LIMIT 5;",
            "expected": "Rows present with status = 'prepared'.",
        },
        {
            "name": "verify_routing_label_transparency",
            "description": "Confirm routing labels are visible in the shared table.",
            "sql": f"SELECT DISTINCT routing_label FROM {share}.{shared_as} WHERE export_ready = true;",
            "expected": "At least 'regulatory_review' visible (V1 FDA domain).",
        },
    ]


def load_artifact(text: str, required: tuple[str, ...]) -> dict:
    """A stored artifact; all required keys must be there."""
    found = json.loads(text)
    missing = [k for k in required if k not in found]
    if missing:
        raise ValueError(f"missing keys: {', '.join(missing)}")
    return found


def reload(text: str, kind: str) -> dict:
    """A stored artifact of a kind; its keys must be there, and a delivery event's status and version be known ones."""
    found = load_artifact(text, V.ARTIFACT_KEYS[kind])
    closed = {"status": V.DELIVERY_STATUSES, "schema_version": (V.SCHEMA_VERSION_DELIVERY,)} if kind == "delivery_event" else {}
    wrong = [f"{k}={found[k]!r}" for k, known in closed.items() if found[k] not in known]
    if wrong:
        raise ValueError(f"unknown values: {', '.join(wrong)}")
    return found


def share_manifest(share: str, recipient: str, gold: str, events: str, shared_as: str, provisioned: bool = False) -> tuple[str, str]:
    """File name and JSON text of a share's preparation manifest."""
    found = {
        "manifest_version": "v0.1.0",
        "status": "provisioned" if provisioned else "designed",
        "share_name": share,
        "shared_as": shared_as,
        "recipient_name": recipient,
        "setup_sql": ";\n\n".join(share_statements(share, recipient, gold, events, shared_as)) + ";",
        "verification_sql": verification_statements(share),
        "delivery_events_ddl": delivery_events_ddl(events),
        "c2_validation_queries": validation_statements(share, shared_as, events),
    }
    return "delta_share_preparation_manifest.json", json.dumps(found, indent=2)


def write_report(report: DataFrame, kind: str, run_id: str, folder: str) -> DataFrame:
    """Write a one-row report's JSON and text, a file each, into `folder`; gives (name, content) back."""
    pair = report_pair(report, kind, run_id)
    files.write(pair, folder)
    return pair
