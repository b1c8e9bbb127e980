"""Handoff bundles: batch manifests as nested documents, written, read again and validated in Spark.

A manifest is one JSON document for each batch: its totals, and four lists of record references by outcome. Many manifests are checked at
once: the checks look into the nested lists by array functions, each of its document's own, and give a row for each check; paths
are met with listings that tasks make, by one anti-join. A document that doesn't parse, or lacks a required key, has one failed check.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import vocab as V
from . import files

REF = "document_id string, gold_record_id string, outcome_category string, outcome_reason string, routing_label string, gold_artifact_path string, export_artifact_path string"
LISTS = {"exported": "exported_records", "quarantined": "quarantined_records", "contract_blocked": "contract_blocked_records", "skipped_not_export_ready": "skipped_records"}
# A manifest's required keys, in their order.
REQUIRED = ("manifest_version", "batch_id", "pipeline_run_id", "generated_at", "total_records_processed", "total_ineligible_skipped", "total_eligible", "total_exported", "total_quarantined", "total_contract_blocked", "total_skipped_not_export_ready")
SCHEMA = (
    "manifest_version string, batch_id string, pipeline_run_id string, generated_at string, "
    + ", ".join(f"{k} bigint" for k in REQUIRED[4:])
    + ", outcome_distribution map<string, bigint>, "
    + ", ".join(f"{name} array<struct<{REF.replace(' string', ':string')}>>" for name in LISTS.values())
    + ", report_artifacts struct<json_path:string,text_path:string>, review_notes array<string>"
)
# Names of the checks, in their order.
PARSES = "manifest_parses_correctly"
COUNTS = ("total_records_processed_consistent", "total_eligible_consistent", "total_exported_consistent", "total_quarantined_consistent", "total_contract_blocked_consistent", "total_skipped_consistent", "outcome_distribution_consistent")
REFERENCES = (
    "exported_records_have_export_paths", "non_exported_records_no_export_paths", "exported_records_correct_outcome_category", "quarantined_records_correct_outcome_category",
    "contract_blocked_records_correct_outcome_category", "skipped_records_correct_outcome_category", "quarantined_records_have_quarantine_routing", "exported_records_non_quarantine_routing",
)
UNIQUE = ("no_duplicate_document_ids", "no_duplicate_gold_record_ids")
PATHS = ("report_artifact_json_exists", "report_artifact_text_exists", "gold_artifact_paths_exist", "export_artifact_paths_exist")
CHECKS = ("manifest_version_known", "batch_id_pipeline_run_id_consistent", *COUNTS, *REFERENCES, *UNIQUE, *PATHS)
# Observations.
ZERO = "Bundle contains zero eligible records. All counts are zero — this is valid but worth confirming."
BLOCKED = " record(s) were contract-blocked. Review contract_blocked_records for field-level contract violation detail."
SKIPPED = "Filesystem path existence checks were skipped (check_paths=False). Run with check_paths=True to verify all referenced artifact files exist."
UNREADABLE, INCOMPLETE = "Bundle file could not be parsed as JSON", "Bundle JSON is missing required manifest fields and cannot be validated."


def manifests(references: DataFrame, batches: DataFrame) -> DataFrame:
    """(batch_id, name, content) of each batch's manifest: the rows of `batches` have what isn't a list, those of `references` go to the lists.

    A batch's references make one document, as its format says; batches are grouped apart from each other.
    """
    ref = F.struct(*[c.split()[0] for c in REF.split(", ")])
    known = F.col("outcome_category").isin(*V.OUTCOMES)
    list_name = F.coalesce(F.when(known, F.col("outcome_category")), F.lit("skipped_not_export_ready"))
    held = references.withColumn("_list", F.coalesce("list_name", list_name) if "list_name" in references.columns else list_name)
    lists = held.groupBy("batch_id").agg(*[F.array_sort(F.collect_list(F.when(F.col("_list") == k, ref))).alias(v) for k, v in LISTS.items()])
    empty = F.from_json(F.lit("[]"), f"array<struct<{REF.replace(' string', ':string')}>>")
    whole = batches.join(lists, "batch_id", "left").withColumns({v: F.coalesce(v, empty) for v in LISTS.values()})
    return whole.select("batch_id", F.concat(F.lit("handoff_bundle_"), F.translate("batch_id", "/: ", "___"), F.lit(".json")).alias("name"), F.to_json(F.struct(*[c for c in whole.columns]), {"ignoreNullFields": "false"}).alias("content"))


def read(spark: SparkSession, folder: str) -> DataFrame:
    """(key, content) of the manifests of a folder; the key is the file's path. Empty files are there too."""
    kept = spark.read.option("pathGlobFilter", "*.json").text(folder, wholetext=True).select(F.input_file_name().alias("key"), F.col("value").alias("content"))
    return kept.unionByName(files.listing(spark, folder, ".json").where("length = 0").select(F.col("path").alias("key"), F.lit("").alias("content")))


def parsed(texts: DataFrame) -> DataFrame:
    """(key, problem, m): each text's manifest as a struct, or why there is none."""
    value = texts.select("key", "content", F.try_parse_json("content").alias("v"))
    there = reduce(lambda a, b: a & b, [F.expr(f"schema_of_variant(variant_get(v, '$.{k}'))").isNotNull() for k in REQUIRED])
    problem = F.when(F.col("v").isNull(), F.lit(UNREADABLE)).when(~there, F.lit(INCOMPLETE))
    return value.select("key", problem.alias("problem"), F.when(problem.isNull(), F.from_json("content", SCHEMA)).alias("m"))


def _shown(ids: Column) -> Column:
    return F.when(F.size(ids) == 0, F.lit("[]")).otherwise(F.concat(F.lit("['"), F.array_join(ids, "', '"), F.lit("']")))


def _text(x: Column) -> Column:
    return F.coalesce(x.cast("string"), F.lit("None"))


def _checks() -> list[tuple[str, Column, Column]]:
    """(name, passed, messages) of the checks of m; messages are texts, of which the detail is joined."""
    m, none = (lambda k: F.col(f"m.{k}")), F.array().cast("array<string>")
    lists = {v: F.coalesce(m(v), F.from_json(F.lit("[]"), f"array<struct<{REF.replace(' string', ':string')}>>")) for v in LISTS.values()}
    size = {k: F.size(lists[v]) for k, v in LISTS.items()}
    every = reduce(lambda a, b: a + b, size.values())
    out: list[tuple[str, Column, Column]] = []

    def add(name: str, passed: Column, message: Column) -> None:
        passed = F.coalesce(passed, F.lit(False))
        out.append((name, passed, F.when(~passed, F.array(message)).otherwise(none)))

    def ids(rows: Column, wrong) -> Column:
        return F.transform(F.filter(rows, wrong), lambda r: F.coalesce(r["document_id"], F.lit("")))

    def named(name: str, rows: Column, wrong, message: str) -> None:
        add(name, F.size(F.filter(rows, wrong)) == 0, F.concat(F.lit(message), _shown(ids(rows, wrong))))

    add("manifest_version_known", m("manifest_version") == V.SCHEMA_VERSION, F.concat(F.lit("manifest_version '"), _text(m("manifest_version")), F.lit(f"' does not match known version '{V.SCHEMA_VERSION}'")))
    add("batch_id_pipeline_run_id_consistent", m("batch_id").eqNullSafe(m("pipeline_run_id")), F.concat(F.lit("batch_id '"), _text(m("batch_id")), F.lit("' != pipeline_run_id '"), _text(m("pipeline_run_id")), F.lit("'")))
    total, eligible, other = m("total_records_processed"), m("total_eligible"), m("total_ineligible_skipped")
    add(COUNTS[0], total == eligible + other, F.concat(F.lit("total_records_processed ("), _text(total), F.lit(") != total_eligible ("), _text(eligible), F.lit(") + total_ineligible_skipped ("), _text(other), F.lit(") = "), _text(eligible + other)))
    listed = F.concat_ws(", ", *[F.concat(F.lit(f"{'skipped' if k.startswith('skipped') else k}="), n) for k, n in size.items()])
    add(COUNTS[1], eligible == every, F.concat(F.lit("total_eligible ("), _text(eligible), F.lit(") != sum of record lists ("), every, F.lit("): "), listed))
    for name, (k, v) in zip(COUNTS[2:6], LISTS.items()):
        add(name, m(f"total_{k}") == size[k], F.concat(F.lit(f"total_{k} ("), _text(m(f"total_{k}")), F.lit(f") != len({v}) ("), size[k], F.lit(")")))
    told = {k: F.coalesce(m("outcome_distribution")[k], F.lit(0)) for k in LISTS}
    off = F.array_compact(F.array(*[F.when(told[k] != size[k], F.concat(F.lit(f"outcome_distribution['{k}']="), told[k], F.lit(f" but {k}_records has "), size[k], F.lit(" entries"))) for k in LISTS]))
    out.append((COUNTS[6], F.size(off) == 0, off))

    exported, others = lists["exported_records"], [v for k, v in LISTS.items() if k != "exported"]
    named(REFERENCES[0], exported, lambda r: r["export_artifact_path"].isNull(), "Exported records missing export_artifact_path: ")

    def leading(v: str) -> Column:
        found = F.filter(lists[v], lambda r: r["export_artifact_path"].isNotNull())
        return F.transform(found, lambda r: F.concat(F.lit(f"{v}[document_id="), F.coalesce(r["document_id"], F.lit("")), F.lit("] has export_artifact_path='"), r["export_artifact_path"], F.lit("'")))

    def of_category(k: str):
        return lambda r: F.coalesce(r["outcome_category"], F.lit("")) != k

    led = [leading(v) for v in others]
    out.append((REFERENCES[1], F.size(F.concat(*led)) == 0, F.concat(*led)))
    for name, (k, v) in zip(REFERENCES[2:6], LISTS.items()):
        named(name, lists[v], of_category(k), f"{v} contains records with wrong outcome_category (expected '{k}'): ")
    named(REFERENCES[6], lists["quarantined_records"], lambda r: F.coalesce(r["routing_label"], F.lit("")) != V.QUARANTINE, "Quarantined records with non-quarantine routing_label: ")
    named(REFERENCES[7], exported, lambda r: F.coalesce(r["routing_label"], F.lit("")) == V.QUARANTINE, f"Exported records with routing_label='{V.QUARANTINE}' (contradictory state): ")
    for name, key in zip(UNIQUE, ("document_id", "gold_record_id")):
        own = F.array_sort(F.filter(F.concat(*[F.transform(x, lambda r: r[key]) for x in lists.values()]), lambda x: F.coalesce(x, F.lit("")) != ""))
        again = F.array_distinct(F.filter(own, lambda x, i: (i > 0) & (x == F.element_at(own, F.greatest(i, F.lit(1))))))
        add(name, F.size(again) == 0, F.concat(F.lit(f"Duplicate {key}s across record lists: "), _shown(again)))
    return out


_CHECK = "array<struct<ord:int,check_name:string,passed:boolean,messages:array<string>,detail:string>>"


def _paths(whole: DataFrame) -> DataFrame:
    """(key, ord, check_name, passed, messages, detail) of the four checks of paths."""
    known = whole.where("problem IS NULL")
    base = len(CHECKS) - len(PATHS)

    def asked_of(v: str) -> Column:
        export = (lambda r: r["export_artifact_path"]) if v == "exported_records" else (lambda r: F.lit(None).cast("string"))
        return F.transform(F.col(f"m.{v}"), lambda r: F.struct(r["gold_artifact_path"].alias("gold"), export(r).alias("export")))

    def told_as(head: str):
        return lambda p: F.concat(F.lit(head), p)

    refs = [asked_of(v) for v in LISTS.values()]
    none = F.from_json(F.lit("[]"), "array<struct<gold:string,export:string>>")
    listed = known.select("key", F.explode(F.concat(*[F.coalesce(r, none) for r in refs])).alias("r")).select("key", F.expr("stack(2, 2, r.gold, 3, r.export) AS (k, path)"))
    report = known.select("key", F.expr("stack(2, 0, m.report_artifacts.json_path, 1, m.report_artifacts.text_path) AS (k, path)"))
    asked = listed.unionByName(report).where("coalesce(path, '') <> ''")
    gone = files.missing(asked).groupBy("key").agg(*[F.array_sort(F.collect_list(F.when(F.col("k") == k, F.col("path")))).alias(f"gone_{k}") for k in range(4)])
    told = known.select("key", F.col("m.report_artifacts").alias("report")).join(gone, "key", "left")
    empty, rows = F.array().cast("array<string>"), []
    for k, name in enumerate(PATHS):
        lost = F.coalesce(f"gone_{k}", empty)
        if k < 2:
            of = ("json_path", "text_path")[k]
            unset = F.when(F.col("report").isNull(), F.lit("No report_artifacts referenced — path check not applicable.")).when(F.coalesce(F.col(f"report.{of}"), F.lit("")) == "", F.lit(f"report_artifacts.{of} is not set — skipped."))
            detail = F.when(F.size(lost) > 0, F.concat(F.lit(f"report_artifacts.{of} path not found on disk: "), F.try_element_at(lost, F.lit(1)))).otherwise(unset)
            messages = F.transform(lost, told_as(f"report_artifacts.{of}: "))
        else:
            of = ("gold", "export")[k - 2]
            detail = F.when(F.size(lost) > 0, F.concat(F.size(lost), F.lit(f" {of} artifact path(s) not found on disk")))
            messages = F.transform(lost, told_as(f"{of}_artifact_path: "))
        rows.append(F.struct(F.lit(base + k).alias("ord"), F.lit(name).alias("check_name"), (F.size(lost) == 0).alias("passed"), messages.alias("messages"), detail.alias("detail")))
    return told.select("key", F.inline(F.array(*rows)))


def checked(texts: DataFrame, paths: bool = True) -> DataFrame:
    """(key, ord, check_name, passed, messages, detail) of every check of (key, content) manifests; keys are unique."""
    whole = parsed(texts)
    own = [F.struct(F.lit(i).alias("ord"), F.lit(name).alias("check_name"), passed.alias("passed"), said.alias("messages"), F.when(F.size(said) > 0, F.array_join(said, "; ")).alias("detail")) for i, (name, passed, said) in enumerate(_checks())]
    failed = F.array(F.struct(F.lit(0).alias("ord"), F.lit(PARSES).alias("check_name"), F.lit(False).alias("passed"), F.array().cast("array<string>").alias("messages"), F.col("problem").alias("detail")))
    out = whole.select("key", F.inline(F.when(F.col("problem").isNotNull(), failed.cast(_CHECK)).otherwise(F.array(*own).cast(_CHECK))))
    return out.unionByName(_paths(whole)) if paths else out


def results(texts: DataFrame, paths: bool = True, validated_at: str | None = None) -> DataFrame:
    """One row for each manifest: verdict, counts of checks, failed checks, messages by kind, observations."""
    told = checked(texts, paths)
    kinds = {"count_mismatches": COUNTS, "contradictions": REFERENCES, "duplicate_identifiers": UNIQUE, "missing_paths": PATHS}
    of = {k: F.flatten(F.transform(F.array_sort(F.collect_list(F.when(F.col("check_name").isin(*names), F.struct("ord", "messages")))), lambda x: x["messages"])).alias(k) for k, names in kinds.items()}
    failed = F.transform(F.array_sort(F.collect_list(F.when(~F.col("passed"), F.struct("ord", "check_name")))), lambda x: x["check_name"])
    detail = F.array_sort(F.collect_list(F.struct("ord", "check_name", "passed", "detail")))
    counted = told.groupBy("key").agg(F.count("*").alias("checks_run"), F.count_if("passed").alias("checks_passed"), failed.alias("failed_checks"), *of.values(), detail.alias("check_results"))
    noted = F.array_compact(
        F.array(
            F.when(F.col("m.total_eligible") == 0, F.lit(ZERO)),
            F.when(F.col("m.total_contract_blocked") > 0, F.concat(F.col("m.total_contract_blocked"), F.lit(BLOCKED))),
            F.when(F.col("problem").isNull() & F.lit(not paths), F.lit(SKIPPED)),
        )
    )
    whole = parsed(texts).select("key", F.col("m.batch_id").alias("batch_id"), noted.alias("observations"))
    out = counted.join(whole, "key")
    return out.select(
        "key", (F.size("failed_checks") == 0).alias("bundle_valid"), "batch_id", "checks_run", "checks_passed", (F.col("checks_run") - F.col("checks_passed")).alias("checks_failed"), "check_results", "failed_checks",
        *kinds, "observations", (F.lit(validated_at) if validated_at else F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX")).alias("validated_at"),
    )


def violations(texts: DataFrame, paths: bool = True) -> DataFrame:
    """(key, check_name, message): what is wrong with each manifest, a row a message."""
    own = F.when(F.size("messages") > 0, F.col("messages")).otherwise(F.array("detail"))
    return checked(texts, paths).where("not passed").select("key", "check_name", F.explode(own).alias("message"))


def texts_of(found: DataFrame) -> DataFrame:
    """(name, content) of the report pair of each of `results`: JSON, and text for people."""
    blank = F.array(F.lit(""))

    def block(head: str, rows: Column, start: str = "  ") -> Column:
        return F.when(F.size(rows) > 0, F.concat(F.array(F.lit(f"--- {head} ---")), F.transform(rows, lambda x: F.concat(F.lit(start), x)), blank)).otherwise(F.array().cast("array<string>"))

    head = F.array(
        F.lit("=== B-6 Bundle Integrity Validation ==="), F.concat(F.lit("Bundle Valid       : "), F.when(F.col("bundle_valid"), "VALID").otherwise("INVALID")), F.concat(F.lit("Batch ID           : "), F.coalesce("batch_id", F.lit("(unknown)"))),
        F.concat(F.lit("Validated At       : "), "validated_at"), F.lit(""), F.lit("--- Check Summary ---"), F.concat(F.lit("Checks Run         : "), "checks_run"), F.concat(F.lit("Checks Passed      : "), "checks_passed"),
        F.concat(F.lit("Checks Failed      : "), "checks_failed"), F.lit(""),
    )
    detail = F.transform("check_results", lambda r: F.concat(F.lit("  ["), F.when(r["passed"], "PASS").otherwise("FAIL"), F.lit("] "), r["check_name"], F.coalesce(F.concat(F.lit(" — "), r["detail"]), F.lit(""))))
    lines = F.concat(
        head, block("Failed Checks", F.col("failed_checks"), "  FAIL: "), block("Count Mismatches", F.col("count_mismatches")), block("Missing Artifact Paths", F.col("missing_paths")), block("Duplicate Identifiers", F.col("duplicate_identifiers")),
        block("Contradictions", F.col("contradictions")), F.array(F.lit("--- Check Detail ---")), detail, blank, block("Observations", F.col("observations"), "  - "),
    )
    name = F.concat(F.lit("bundle_validation_"), F.translate(F.coalesce("batch_id", F.lit("unknown")), "/: ", "___"))
    shown = F.struct(*[c for c in found.columns if c != "key"])
    pair = F.array(F.struct(F.concat(name, F.lit(".json")).alias("name"), F.to_json(shown, {"ignoreNullFields": "false"}).alias("content")), F.struct(F.concat(name, F.lit(".txt")).alias("name"), F.array_join(lines, "\n").alias("content")))
    return found.select(F.inline(pair))
