"""The layers as stored tables by SQL text alone: the rules are SQL functions of the session, and every table is made by a statement that calls them.

`register` makes the functions; they hold built-in expressions only, so Catalyst inlines them into the statements' plans:
parse_document(content, options), extract_fields(parsed, schema, options), classify_document(extraction, labels, options), made_document_id(path).
A classifier by rules sees the extraction alone: the expected class is one signal, three of its fields that are there another; both make the first
label, if the labels have it. (`bootstrap.gold_projection` also sees the record's validation.)
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from ..functions import vocab as V
from ..operators import bronze
from ..operators.extract import STEPS
from .bootstrap import FIELDS, PROMPT, RUN
from .relation import SPARK

OPTIONS = "options MAP<STRING, STRING>"
#: The extraction's schema, as the statements tell it.
SCHEMA = '{"issuing_office": {"type": "string"}, "recipient_company": {"type": "string"}, "recipient_name": {"type": "string"}, "issue_date": {"type": "string"}, "corrective_action_requested": {"type": "boolean"}, "summary": {"type": "string"}}'
LABELS = '{"fda_warning_letter": "FDA-issued warning letter to a regulated company", "unknown": "Document does not clearly match the FDA warning letter class"}'


def functions() -> list[str]:
    """The statements that make the functions: one for each rule, which calls those of the steps before it."""
    out = [
        f"CREATE OR REPLACE TEMPORARY FUNCTION made_document_id(path STRING) RETURNS STRING RETURN {SPARK.made_id(SPARK.text('document'), 'path')}",
        f"CREATE OR REPLACE TEMPORARY FUNCTION parse_document(content BINARY, {OPTIONS}) RETURNS STRING RETURN regexp_replace(make_valid_utf8(cast(content AS string)), '\\r\\n?', '\\n')",
    ]
    steps = STEPS[V.LETTER](SPARK)
    for step in steps:
        for name, rule in step.items():
            if name.startswith("x_") or name in FIELDS:
                # What a rule takes from the steps before it are arguments, which are computed once however often the rule names them.
                used = sorted(set(re.findall(r"\bx_[a-z]+\b", rule)))
                if used:
                    out.append(f"CREATE OR REPLACE TEMPORARY FUNCTION rule_{name}(t STRING, {', '.join(f'{x} {_type(x)}' for x in used)}) RETURNS {_type(name)} RETURN {rule}")
                    rule = f"rule_{name}(t, {', '.join(f'letter_{x}(t)' for x in used)})"
                out.append(f"CREATE OR REPLACE TEMPORARY FUNCTION letter_{name}(t STRING) RETURNS {_type(name)} RETURN {rule}")
    members = ", ".join(f"'{n}', letter_{n}(coalesce(parsed, ''))" for n in FIELDS)
    out.append(f"CREATE OR REPLACE TEMPORARY FUNCTION extract_fields(parsed STRING, schema STRING, {OPTIONS}) RETURNS VARIANT RETURN parse_json(to_json(named_struct({members}), map('ignoreNullFields', 'false')))")
    names, least = V.SIGNALS[V.LETTER]
    there = " + ".join(f"CASE WHEN coalesce(try_variant_get(extraction, '$.{n}', 'string'), '') <> '' THEN 1 ELSE 0 END" for n in names if n in FIELDS)
    label = f"CASE WHEN ({there}) >= {least} AND array_contains(json_object_keys(labels), '{V.LETTER}') THEN '{V.LETTER}' ELSE '{V.UNKNOWN}' END"
    out.append(f"""CREATE OR REPLACE TEMPORARY FUNCTION classify_document(extraction VARIANT, labels STRING, {OPTIONS}) RETURNS VARIANT RETURN parse_json(concat('{{"response":["', {label}, '"]}}'))""")
    return out


def _type(name: str) -> str:
    return "ARRAY<STRING>" if name in ("x_violations", "x_inline", "x_parts", "x_cited") else "BOOLEAN" if name in V.BOOLEANS else "STRING"


def register(spark: SparkSession) -> None:
    for statement in functions():
        spark.sql(statement)


def layer_statements(bronze_table: str, silver_table: str, gold_table: str, smoke_table: str, source: str = "landing") -> list[str]:
    """Statements that make the tables again from `source` (path, length, content): the parsed texts alone, Bronze, Silver, Gold."""

    def made(table: str, query: str) -> list[str]:
        # The session catalog's file tables can't be replaced in one statement.
        return [f"DROP TABLE IF EXISTS {table}", f"CREATE TABLE {table} USING parquet AS\n{query}"]

    schema, labels = (SPARK.text(x) for x in (SCHEMA, LABELS))
    last = f"'{RUN}' AS pipeline_run_id, '{V.SCHEMA_VERSION}' AS schema_version"
    answer = "try_variant_get(document_type_result, '$.response[0]', 'string')"
    return [
        *made(smoke_table, f"SELECT path AS source_path, current_timestamp() AS parsed_at, parse_document(content, MAP('version', '2.0')) AS parsed_content FROM {source}"),
        *made(bronze_table, f"""SELECT made_document_id(path) AS document_id, path AS source_path, regexp_extract(path, '[^/]+$', 0) AS file_name, length AS file_size_bytes, sha2(content, 256) AS file_hash,
  current_timestamp() AS ingested_at, current_timestamp() AS parsed_at, 'success' AS parse_status, parse_document(content, MAP('version', '2.0')) AS parsed_content, {last} FROM {source}"""),
        *made(silver_table, f"""SELECT document_id, source_path, file_name, parsed_at, extract_fields(parsed_content, {schema}, MAP('version', '2.0')) AS extraction_result,
  current_timestamp() AS extracted_at, '{PROMPT}' AS extraction_prompt_id, {last} FROM {bronze_table}"""),
        *made(gold_table, f"""WITH classified AS (
  SELECT *, classify_document(extraction_result, {labels}, MAP('version', '2.0')) AS document_type_result FROM {silver_table})
SELECT document_id, source_path, file_name, current_timestamp() AS classified_at, document_type_result, {answer} AS document_type_label,
  CASE WHEN {answer} = '{V.LETTER}' THEN '{V.ROUTES[V.LETTER]}' ELSE '{V.QUARANTINE}' END AS routing_label, CAST(NULL AS DOUBLE) AS classification_confidence, extraction_result AS export_payload,
  coalesce({answer} = '{V.LETTER}', false) AS export_ready, {last} FROM classified"""),
    ]


def lineage_statements(bronze_table: str, silver_table: str, gold_table: str) -> list[str]:
    """Queries over the tables: which layers each document reached, by file name; their counts."""
    joined = f"FROM {bronze_table} b LEFT JOIN {silver_table} s ON b.document_id = s.document_id LEFT JOIN {gold_table} g ON b.document_id = g.document_id"
    whole = "s.document_id IS NOT NULL AND g.document_id IS NOT NULL"
    return [
        f"SELECT b.document_id, b.file_name, b.parse_status, s.extracted_at IS NOT NULL AS has_silver_record, g.document_type_label, g.routing_label, g.export_ready, {whole} AS full_lineage_present, b.schema_version AS bronze_schema_version, s.schema_version AS silver_schema_version, g.schema_version AS gold_schema_version {joined} ORDER BY b.file_name",
        f"SELECT count(*) AS total_documents, count_if(b.parse_status = 'success') AS bronze_success_count, count_if(s.document_id IS NOT NULL) AS silver_record_count, count_if(g.export_ready) AS gold_export_ready_count, count_if(g.routing_label = 'quarantine') AS quarantine_count, count_if({whole}) AS full_lineage_count {joined}",
    ]


def create_tables(spark: SparkSession, folder: str, database: str = "default") -> tuple[DataFrame, DataFrame]:
    """Make the four tables from a folder's text files (empty ones too) by statements; gives the lineage queries' results."""
    register(spark)
    bronze.scan_files(spark, folder).createOrReplaceTempView("landing")
    names = [f"{database}.{t}" for t in ("parsed_documents_sql", "extracted_records_sql", "ai_ready_assets_sql", "parsed_documents_smoke_sql")]
    for statement in layer_statements(*names):
        spark.sql(statement)
    first, second = (spark.sql(s) for s in lineage_statements(*names[:3]))
    return first, second


def sql_fields(spark: SparkSession, letters: DataFrame) -> DataFrame:
    """The extraction by the registered function, over letters with document_id and parsed_text, a column for each field."""
    register(spark)
    view = "letters_for_sql_functions"
    letters.createOrReplaceTempView(view)
    members = ", ".join(f"try_variant_get(e, '$.{n}', 'string') AS {n}" for n in FIELDS)
    return spark.sql(f"""WITH found AS (SELECT document_id, extract_fields(parsed_text, {SPARK.text(SCHEMA)}, MAP('version', '2.0')) AS e FROM {view})
SELECT document_id, {members}, try_variant_get(classify_document(e, {SPARK.text(LABELS)}, MAP('version', '2.0')), '$.response[0]', 'string') AS document_type_label FROM found""")
