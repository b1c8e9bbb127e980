"""The layers as stored tables made by statements alone: files to Bronze, Bronze to Silver, Silver to Gold.

Hosted model calls give way to this library's rules; what they answer has the same form, a JSON object of fields and
{"response": [label]}. Confidence stays null here, as such answers have none.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import vocab as V
from ..functions.dialect import Dialect
from ..operators import bronze, gold, silver
from ..operators.extract import with_fields
from .relation import Relation

RUN, PROMPT = V.PLACEHOLDER_RUNS[0], "fda_warning_letter_v1"
#: The fields that are extracted.
FIELDS = ("issuing_office", "recipient_company", "recipient_name", "issue_date", "corrective_action_requested", "summary")
TABLES = ("parsed_documents", "extracted_records_smoke", "ai_ready_assets_smoke")


def bronze_projection(d: Dialect) -> dict[str, str]:
    """Of (path, length, content, parsed_text)."""
    return {
        "document_id": d.made_id("'document'", "path"),
        "source_path": "path",
        "file_name": d.extract("path", "[^/]+$", "", 0),
        "file_size_bytes": "CAST(length AS BIGINT)",
        "file_hash": d.digest("content"),
        "parse_status": "'success'",
        "parsed_text": "parsed_text",
        "pipeline_run_id": f"'{RUN}'",
        "schema_version": f"'{V.SCHEMA_VERSION}'",
    }


def silver_projection(relation: Relation) -> Relation:
    """Adds extraction_result (JSON of `FIELDS`) and the constants to a Bronze relation; keeps what Gold's rules read."""
    found = with_fields(relation.add(lambda d: {"document_class_hint": f"'{V.LETTER}'"}), V.LETTER).add(lambda d: silver.scored(d, V.LETTER)).add(silver.verdict).add(lambda d: gold.signals(d, V.LETTER))
    kept = ("document_id", "source_path", "file_name", "signals", "pipeline_run_id", "schema_version")
    return found.select(lambda d: {k: k for k in kept} | {"extraction_result": d.json_object(FIELDS), "extraction_prompt_id": f"'{PROMPT}'"})


def gold_projection(relation: Relation) -> Relation:
    """Label from the classifier's answer, then route and readiness from the label."""
    answer = lambda d: {"document_type_result": f"""concat('{{"response":["', CASE WHEN signals >= 2 THEN '{V.LETTER}' ELSE '{V.UNKNOWN}' END, '"]}}')"""}
    labelled = relation.add(answer).add(lambda d: {"document_type_label": d.variant_text("document_type_result", "response[0]")})
    known = f"coalesce(document_type_label, '') = '{V.LETTER}'"
    kept = ("document_id", "source_path", "file_name", "document_type_result", "document_type_label", "pipeline_run_id", "schema_version")
    return labelled.select(
        lambda d: {k: k for k in kept}
        | {"routing_label": f"CASE WHEN {known} THEN '{V.ROUTES[V.LETTER]}' ELSE '{V.QUARANTINE}' END", "classification_confidence": "CAST(NULL AS DOUBLE)", "export_payload": "extraction_result", "export_ready": known}
    )


def create_tables(spark: SparkSession, folder: str, database: str = "default") -> dict[str, str]:
    """Make or replace the three tables from the text files of a folder; gives layer to table name.

    The stored result columns are variants. An empty folder gives empty tables; a folder that isn't there is an error.
    """
    files = bronze.scan_files(spark, folder)
    text = F.regexp_replace(F.expr("make_valid_utf8(cast(content AS string))"), "\r\n?", "\n")
    names = [f"{database}.{t}" for t in TABLES]

    def stored(df: DataFrame, name: str, clock: str) -> None:
        df.withColumn(clock, F.current_timestamp()).write.mode("overwrite").saveAsTable(name)

    stored(Relation().select(bronze_projection).on(files.withColumn("parsed_text", text)), names[0], "parsed_at")
    silver_rows = silver_projection(Relation()).on(spark.table(names[0]))
    stored(silver_rows.withColumn("extraction_result", F.parse_json("extraction_result")), names[1], "extracted_at")
    gold_rows = gold_projection(Relation()).on(spark.table(names[1]))
    stored(gold_rows.withColumn("document_type_result", F.parse_json("document_type_result")), names[2], "classified_at")
    return dict(zip(("bronze", "silver", "gold"), names))
