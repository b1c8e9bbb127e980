"""Registered queries over nested documents, whose SQL is written apart from the code that runs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import bundles


def handoff_bundles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A manifest for each customer with its orders as references, as JSON text; some are cut, lack a key, or are wrong, by number."""
    refs = spark.read.parquet(f"{sf_dir}/orders.parquet").selectExpr(
        "o_custkey AS key",
        "CASE o_orderkey % 4 WHEN 0 THEN 'exported' WHEN 1 THEN 'quarantined' WHEN 2 THEN 'contract_blocked' ELSE 'skipped_not_export_ready' END AS list_name",
        "CASE WHEN o_orderkey % 89 = 0 THEN 'doc' ELSE concat('d', o_orderkey) END AS document_id",
        "CASE WHEN o_orderkey % 67 = 0 THEN '' WHEN o_orderkey % 61 < 2 THEN 'gold' ELSE concat('g', o_orderkey) END AS gold_record_id",
        "CASE WHEN o_orderkey % 71 = 0 THEN NULL ELSE CASE o_orderkey % 4 WHEN 0 THEN 'exported' WHEN 1 THEN 'quarantined' WHEN 2 THEN 'contract_blocked' ELSE 'skipped_not_export_ready' END END AS outcome_category",
        "'none' AS outcome_reason",
        "CASE WHEN (o_orderkey % 4 = 1) <> (o_orderkey % 73 = 0) THEN 'quarantine' ELSE 'ops' END AS routing_label",
        "concat('gold/', o_orderkey) AS gold_artifact_path",
        "CASE WHEN (o_orderkey % 4 = 0) <> (o_orderkey % 83 = 0) THEN concat('export/', o_orderkey) END AS export_artifact_path",
    )
    counts = refs.groupBy("key").agg(F.count("*").alias("n"), *[F.count_if(F.col("list_name") == k).alias(f"n_{k}") for k in bundles.LISTS])
    run = "concat('run-', key)"
    batches = counts.selectExpr(
        f"{run} AS batch_id",
        "CASE WHEN key % 13 = 0 THEN 'v9' ELSE 'v0.1.0' END AS manifest_version",
        "concat('run-', key + CASE WHEN key % 29 = 0 THEN 1 ELSE 0 END) AS pipeline_run_id",
        "CASE WHEN key % 41 <> 0 THEN 'now' END AS generated_at",
        "n + key % 3 + CASE WHEN key % 19 = 0 THEN 1 ELSE 0 END AS total_records_processed",
        "key % 3 AS total_ineligible_skipped",
        "n + CASE WHEN key % 17 = 0 THEN 1 ELSE 0 END AS total_eligible",
        "n_exported + CASE WHEN key % 23 = 0 THEN 1 ELSE 0 END AS total_exported",
        *[f"n_{k} AS total_{k}" for k in list(bundles.LISTS)[1:]],
        "map('exported', n_exported, 'quarantined', n_quarantined + CASE WHEN key % 31 = 0 THEN 1 ELSE 0 END, 'contract_blocked', n_contract_blocked, 'skipped_not_export_ready', n_skipped_not_export_ready) AS outcome_distribution",
    )
    made = bundles.manifests(refs.withColumn("batch_id", F.expr(run)), batches)
    key = F.substring_index("batch_id", "-", -1).cast("long").alias("key")
    content = F.expr("CASE WHEN substring_index(batch_id, '-', -1) % 37 = 0 THEN left(content, length(content) - 1) WHEN substring_index(batch_id, '-', -1) % 41 = 0 THEN replace(content, '\"generated_at\"', '\"other\"') ELSE content END")
    return made.select(key, content.alias("content"))


def bundle_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The results of all manifests, read from their JSON."""
    out = bundles.results(handoff_bundles(spark, sf_dir), paths=False)
    return out.select("key", "batch_id", "bundle_valid", "checks_run", "checks_passed", "checks_failed", F.array_join("failed_checks", ",").alias("failed_checks"), F.array_join("count_mismatches", " | ").alias("count_mismatches"), F.size("observations").alias("observations"))


SQL = """
WITH refs AS (
  SELECT o_custkey AS key, o_orderkey AS o, o_orderkey % 4 AS list,
         CASE WHEN o_orderkey % 89 = 0 THEN 'doc' ELSE 'd' || o_orderkey END AS doc,
         nullif(CASE WHEN o_orderkey % 67 = 0 THEN '' WHEN o_orderkey % 61 < 2 THEN 'gold' ELSE 'g' || o_orderkey END, '') AS gold
  FROM orders
), counts AS (
  SELECT key, count(*) AS n, count(*) FILTER (list = 0) AS e, count(*) FILTER (list = 1) AS q, count(*) FILTER (list = 2) AS c, count(*) FILTER (list = 3) AS s,
         count(*) FILTER (list = 0 AND o % 83 = 0) AS no_path, count(*) FILTER (list <> 0 AND o % 83 = 0) AS a_path,
         count(*) FILTER (list = 0 AND o % 71 = 0) AS e_off, count(*) FILTER (list = 1 AND o % 71 = 0) AS q_off, count(*) FILTER (list = 2 AND o % 71 = 0) AS c_off, count(*) FILTER (list = 3 AND o % 71 = 0) AS s_off,
         count(*) FILTER (list = 1 AND o % 73 = 0) AS q_route, count(*) FILTER (list = 0 AND o % 73 = 0) AS e_route,
         count(doc) - count(DISTINCT doc) AS docs_again, count(gold) - count(DISTINCT gold) AS golds_again
  FROM refs GROUP BY key
), failing AS (
  SELECT *, CASE WHEN key % 37 = 0 OR key % 41 = 0 THEN ['manifest_parses_correctly'] ELSE list_filter([
    CASE WHEN key % 13 = 0 THEN 'manifest_version_known' END, CASE WHEN key % 29 = 0 THEN 'batch_id_pipeline_run_id_consistent' END,
    CASE WHEN (key % 19 = 0) <> (key % 17 = 0) THEN 'total_records_processed_consistent' END, CASE WHEN key % 17 = 0 THEN 'total_eligible_consistent' END, CASE WHEN key % 23 = 0 THEN 'total_exported_consistent' END,
    CASE WHEN key % 31 = 0 THEN 'outcome_distribution_consistent' END, CASE WHEN no_path > 0 THEN 'exported_records_have_export_paths' END, CASE WHEN a_path > 0 THEN 'non_exported_records_no_export_paths' END,
    CASE WHEN e_off > 0 THEN 'exported_records_correct_outcome_category' END, CASE WHEN q_off > 0 THEN 'quarantined_records_correct_outcome_category' END,
    CASE WHEN c_off > 0 THEN 'contract_blocked_records_correct_outcome_category' END, CASE WHEN s_off > 0 THEN 'skipped_records_correct_outcome_category' END,
    CASE WHEN q_route > 0 THEN 'quarantined_records_have_quarantine_routing' END, CASE WHEN e_route > 0 THEN 'exported_records_non_quarantine_routing' END,
    CASE WHEN docs_again > 0 THEN 'no_duplicate_document_ids' END, CASE WHEN golds_again > 0 THEN 'no_duplicate_gold_record_ids' END], lambda x: x IS NOT NULL) END AS failed,
  key % 37 <> 0 AND key % 41 <> 0 AS parses
  FROM counts
)
SELECT key, CASE WHEN parses THEN 'run-' || key END AS batch_id, len(failed) = 0 AS bundle_valid, CASE WHEN parses THEN 19::BIGINT ELSE 1 END AS checks_run,
       CASE WHEN parses THEN 19 - len(failed) ELSE 0 END AS checks_passed, len(failed) AS checks_failed, array_to_string(failed, ',') AS failed_checks,
       CASE WHEN NOT parses THEN '' ELSE array_to_string(list_filter([
         CASE WHEN (key % 19 = 0) <> (key % 17 = 0) THEN 'total_records_processed (' || (n + key % 3 + (key % 19 = 0)::INT) || ') != total_eligible (' || (n + (key % 17 = 0)::INT) || ') + total_ineligible_skipped (' || (key % 3) || ') = ' || (n + (key % 17 = 0)::INT + key % 3) END,
         CASE WHEN key % 17 = 0 THEN 'total_eligible (' || (n + 1) || ') != sum of record lists (' || n || '): exported=' || e || ', quarantined=' || q || ', contract_blocked=' || c || ', skipped=' || s END,
         CASE WHEN key % 23 = 0 THEN 'total_exported (' || (e + 1) || ') != len(exported_records) (' || e || ')' END,
         CASE WHEN key % 31 = 0 THEN 'outcome_distribution[''quarantined'']=' || (q + 1) || ' but quarantined_records has ' || q || ' entries' END], lambda x: x IS NOT NULL), ' | ') END AS count_mismatches,
       CASE WHEN NOT parses THEN 0 WHEN c > 0 THEN 2 ELSE 1 END::INT AS observations
FROM failing
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"bundle_documents": bundle_documents}
ORACLE_SQL: dict[str, str] = {"bundle_documents": SQL}
