"""The evaluation run: each layer's metrics, warnings, observations and flags, whatever layers there are.

A layer is a relation over a table of its name, so it runs on stored artifacts, on tables, and in SQL alike. A layer that is skipped,
whose folder is missing, or that has no readable record, is there with nulls; lineage needs all three. Nothing here depends on the number
of records but the flagged rows, which stay rows.
"""

from __future__ import annotations

import json
import uuid
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import vocab as V
from ..functions.dialect import Dialect
from ..operators import evaluate as E
from ..sources import artifacts, files, sinks
from .relation import Relation

LAYERS = ("bronze", "silver", "gold")
IDS = {"bronze": "bronze_record_id", "silver": "extraction_id", "gold": "gold_record_id"}
SCHEMAS = {
    "bronze": "document_id string, bronze_record_id string, parse_status string, char_count bigint, pipeline_run_id string, schema_version string",
    "silver": "document_id string, bronze_record_id string, extraction_id string, validation_status string, field_coverage_pct double, extracted_fields string, pipeline_run_id string, schema_version string",
    "gold": "document_id string, extraction_id string, gold_record_id string, document_type_label string, routing_label string, classification_confidence double, export_ready boolean, pipeline_run_id string, schema_version string",
}
TARGETS = {"bronze": V.BRONZE_TARGETS, "silver": V.SILVER_TARGETS, "gold": V.GOLD_TARGETS, "traceability": V.TRACE_TARGETS}
FLAGS = {"bronze": E.bronze_flags, "silver": E.silver_flags, "gold": E.gold_flags}
RESULT = "layer string, present boolean, total_records bigint, flagged_record_count bigint, metrics string, threshold_warnings array<string>, observations array<string>"


def _beside(*rows: Relation) -> Relation:
    """One-row relations as one row."""
    return reduce(lambda a, b: a.join(b.add(lambda d: {"one": "1"}), "inner", ("one",)), rows[1:], rows[0].add(lambda d: {"one": "1"}))


def placeholders(d: Dialect) -> str:
    return d.count_if(f"coalesce({d.isin('pipeline_run_id', V.PLACEHOLDER_RUNS)}, false)")


def placeholder_list(d: Dialect) -> str:
    """Which placeholder runs occur, sorted: at most as many as there are such names."""
    return d.join(d.sorted(d.distinct("pipeline_run_id", f"coalesce({d.isin('pipeline_run_id', V.PLACEHOLDER_RUNS)}, false)")), ", ")


def bronze(table: Relation) -> Relation:
    good = table.where(lambda d: "parse_status IN ('success', 'partial')")
    return _beside(table.agg((), E.bronze_metrics), E.nearest(good, "char_count", {"p10_char_count": 10, "p25_char_count": 25})).add(lambda d: {"total_records": "total_documents"})


def silver(table: Relation) -> Relation:
    """Needs empty_slots: how many of the letters' required fields a record lacks."""
    slots = len(V.REQUIRED[V.LETTER])
    nulls = {"required_field_null_rate": f"round(sum(empty_slots) / CAST(nullif(count(*) * {slots}, 0) AS DOUBLE), 4)"}
    return _beside(table.agg((), lambda d: E.silver_metrics(d) | nulls), E.nearest(table, "field_coverage_pct", {"p25_field_coverage_pct": 25}))


def gold(table: Relation) -> Relation:
    return table.agg((), lambda d: E.gold_metrics(d) | {"null_confidences": d.count_if("classification_confidence IS NULL"), "placeholders": placeholders(d)})


def traceability(b: Relation, s: Relation, g: Relation) -> Relation:
    one = E.link_rate(g, s, "extraction_id", "gold_to_silver").select(lambda d: {"gold_to_silver_link_rate": "gold_to_silver_rate", "orphaned_gold_count": "orphaned_gold_count"})
    two = E.link_rate(s, b, "bronze_record_id", "silver_to_bronze").select(lambda d: {"silver_to_bronze_link_rate": "silver_to_bronze_rate", "orphaned_silver_count": "orphaned_silver_count"})
    parts = [r.select(lambda d, k=k: {"layer": f"'{k}'", "pipeline_run_id": "pipeline_run_id", "schema_version": "schema_version"}) for k, r in (("bronze", b), ("silver", s), ("gold", g))]
    whole = parts[0].union(*parts[1:]).agg(
        (),
        lambda d: {"total_records": "count(*)", **{f"total_{k}": d.count_if(f"layer = '{k}'") for k in LAYERS}, "pipeline_run_id_coverage": E.rate(d, "coalesce(pipeline_run_id, '') <> ''"), "schema_version_coverage": E.rate(d, "coalesce(schema_version, '') <> ''"), "placeholders": placeholders(d), "placeholder_list": placeholder_list(d)},
    )
    return _beside(whole, one, two)


MEASURES = {"bronze": bronze, "silver": silver, "gold": gold}
# Metrics by layer, in their order.
SHOWN = {
    "bronze": ("total_documents", "parse_success_rate", "parse_partial_rate", "parse_failure_rate", "zero_char_count_rate", "median_char_count", "p10_char_count", "p25_char_count"),
    "silver": ("total_records", "schema_validity_rate", "partial_rate", "invalid_rate", "mean_field_coverage_pct", "p25_field_coverage_pct", "required_field_null_rate"),
    "gold": ("total_records", "classification_success_rate", "unknown_label_rate", "quarantine_rate", "export_ready_rate", "confidence_null_rate", "mean_classification_confidence", "low_confidence_rate"),
    "traceability": ("total_bronze", "total_silver", "total_gold", "gold_to_silver_link_rate", "silver_to_bronze_link_rate", "pipeline_run_id_coverage", "schema_version_coverage", "orphaned_silver_count", "orphaned_gold_count", "placeholders"),
}


def measured(layer: str, *tables: Relation) -> Relation:
    """One row: the layer's metrics, warnings and observations."""
    whole = traceability(*tables) if layer == "traceability" else MEASURES[layer](tables[0])

    def noted(d: Dialect) -> dict[str, str]:
        cases = [("confidence_null_rate > 0", E.filled(d, V.NULL_CONFIDENCE))] if layer == "gold" else []
        cases += [("placeholders > 0", E.filled(d, {"gold": V.PLACEHOLDERS, "traceability": V.PLACEHOLDERS_TRACED}[layer]))] if layer in ("gold", "traceability") else []
        return {"observations": d.compact(*cases) if cases else d.empty()}

    return whole.add(lambda d: E.warnings(d, TARGETS[layer])).add(noted)


def flagged(layer: str, table: Relation) -> Relation:
    """The records of a layer that wait for review."""
    return E.flagged(table, FLAGS[layer])


def found(spark: SparkSession, layer: str, folder: str | None) -> DataFrame | None:
    """A layer's readable artifacts; None where the folder is missing or has none."""
    if not folder:
        return None
    try:
        rows, _ = artifacts.tolerant(spark, SCHEMAS[layer], folder)
        if not rows.limit(1).count():
            return None
    except AnalysisException:
        return None
    if layer == "silver":
        value = "get_json_object(extracted_fields, '$.{}')"
        empty = " + ".join(f"CASE WHEN coalesce({value.format(n)}, '') IN ('', '[]') THEN 1 ELSE 0 END" for n in V.REQUIRED[V.LETTER])
        rows = rows.withColumn("empty_slots", F.expr(empty))
    return rows


def run(spark: SparkSession, layers: dict[str, DataFrame | None], skip: tuple[str, ...] = ()) -> tuple[DataFrame, dict[str, DataFrame]]:
    """Four rows (see `RESULT`), one for each layer and one for lineage, and the flagged records of the layers that are there."""
    held = {k: v for k, v in layers.items() if v is not None and k not in skip}

    def on(relation: Relation) -> DataFrame:
        return relation.on(held[relation.table], on)

    table = {k: Relation(table=k) for k in LAYERS}
    rows, flags = [], {}
    for layer in (*LAYERS, "traceability"):
        whole = layer in held if layer != "traceability" else len(held) == 3 and layer not in skip
        if not whole:
            rows.append(spark.range(1).selectExpr(f"'{layer}' AS layer", "false AS present", *[f"CAST(NULL AS {c.split()[1]}) AS {c.split()[0]}" for c in RESULT.split(", ")[2:]]))
            continue
        one = on(measured(layer, *([table[k] for k in LAYERS] if layer == "traceability" else [table[layer]])))
        metrics = F.to_json(F.struct(*SHOWN[layer]), {"ignoreNullFields": "false"})
        out = one.select(F.lit(layer).alias("layer"), F.lit(True).alias("present"), F.col("total_records").cast("bigint").alias("total_records"), metrics.alias("metrics"), "threshold_warnings", "observations")
        if layer == "traceability":
            orphans = [(k, child, parent, key) for k, child, parent, key in (("gold", "gold", "silver", "extraction_id"), ("silver", "silver", "bronze", "bronze_record_id"))]
            lost = [on(E.orphans(table[c], table[p], key)).select(F.lit(k).alias("layer"), F.lit(f"orphaned_{k}").alias("issue"), F.col(IDS[k]).alias("record_id")) for k, c, p, key in orphans]
            flags[layer] = lost[0].unionByName(lost[1])
        else:
            flags[layer] = on(flagged(layer, table[layer]))
        counted = flags[layer].agg(F.count("*").alias("flagged_record_count")).withColumn("layer", F.lit(layer))
        rows.append(out.join(counted, "layer").select(*[c.split()[0] for c in RESULT.split(", ")]))
    return reduce(DataFrame.unionByName, rows), flags


def report(result: DataFrame, report_id: str, generated_at: str, pipeline_run_id: str | None = None) -> DataFrame:
    """One row from `run`'s rows: a struct for each layer (null where it isn't there), all warnings and observations, the review queue's size, placeholder runs."""
    names = [c.split()[0] for c in RESULT.split(", ")[2:]]
    place = F.expr("CASE layer WHEN 'bronze' THEN 0 WHEN 'silver' THEN 1 WHEN 'gold' THEN 2 ELSE 3 END")
    each = [F.max(F.when((F.col("layer") == k) & F.col("present"), F.struct(*names))).alias(k) for k in (*LAYERS, "traceability")]
    texts = [F.flatten(F.transform(F.array_sort(F.collect_list(F.struct(place.alias("p"), F.coalesce(c, F.array().cast("array<string>")).alias("x")))), lambda s: s["x"])).alias(a) for a, c in (("all_warnings", "threshold_warnings"), ("all_observations", "observations"))]
    queue = F.coalesce(F.sum(F.when(F.col("layer") != "traceability", F.col("flagged_record_count"))), F.lit(0)).alias("review_queue_size")
    told = F.get_json_object("metrics", "$.confidence_null_rate").cast("double") > 0
    placed = F.get_json_object("metrics", "$.placeholders").cast("long") > 0
    boot = F.coalesce(F.max((F.col("layer") == "gold") & F.coalesce(told, F.lit(False)) | (F.col("layer") == "traceability") & F.coalesce(placed, F.lit(False))), F.lit(False)).alias("bootstrap_path_detected")
    whole = result.agg(*each, *texts, queue, boot)
    return whole.select(F.lit(report_id).alias("report_id"), F.lit(generated_at).alias("generated_at"), F.lit(pipeline_run_id).cast("string").alias("pipeline_run_id_filter"), *whole.columns)


def document(whole: dict) -> dict:
    """A report's row (as a dict) as it is written: metrics as objects, those of lineage beside its other members."""
    out = dict(whole)
    for layer in (*LAYERS, "traceability"):
        if own := whole[layer]:
            metrics = json.loads(own["metrics"])
            out[layer] = {k: v for k, v in own.items() if k != "metrics"} | metrics if layer == "traceability" else own | {"metrics": metrics}
    return out


_WIDE, _THIN = "=" * 70, "-" * 60


def text(whole: dict) -> str:
    """A report's row (as a dict) for people."""
    lines = [
        _WIDE, "  Pipeline — Evaluation Report", _WIDE, f"  Report ID        : {whole['report_id']}", f"  Generated at     : {whole['generated_at']}", f"  Pipeline filter  : {whole['pipeline_run_id_filter'] or 'all'}",
        f"  Review queue     : {whole['review_queue_size']} record(s) flagged", f"  Bootstrap path   : {'DETECTED' if whole['bootstrap_path_detected'] else 'not detected'}", _WIDE, "",
    ]
    for layer in (*LAYERS, "traceability"):
        own = whole[layer]
        if own is None:
            continue
        metrics = json.loads(own["metrics"])
        if layer == "traceability":
            shown = lambda k: "N/A" if metrics[k] is None else f"{metrics[k]:.1%}"
            lines += [_THIN, "  Traceability", _THIN, *[f"  {k.title():<18}: {metrics[f'total_{k}']}" for k in LAYERS], ""]
            lines += [f"  Gold→Silver link  : {shown('gold_to_silver_link_rate')}", f"  Silver→Bronze link: {shown('silver_to_bronze_link_rate')}", f"  pipeline_run_id   : {shown('pipeline_run_id_coverage')}", f"  schema_version    : {shown('schema_version_coverage')}", ""]
            lines += [f"  Orphaned Silver   : {metrics['orphaned_silver_count']}", f"  Orphaned Gold     : {metrics['orphaned_gold_count']}", f"  Placeholder IDs   : {metrics['placeholders']}"]
        else:
            lines += [_THIN, f"  Layer: {layer.upper()}", _THIN, f"  Records evaluated : {own['total_records']}", f"  Flagged records   : {own['flagged_record_count']}", "", "  Metrics:"]
            lines += [f"    {k:<40} {f'{v:.4f}' if isinstance(v, float) else v}" for k, v in metrics.items()]
        for head, key, mark in (("Threshold warnings", "threshold_warnings", "WARN"), ("Observations", "observations", "note")):
            if own[key]:
                lines += ["", f"  {head}:", *[f"    [{mark}] {x}" for x in own[key]]]
        lines.append("")
    lines += [_WIDE, "  ALL THRESHOLD WARNINGS", _WIDE, *[f"  [WARN] {x}" for x in whole["all_warnings"]], ""] if whole["all_warnings"] else [_WIDE, "  All thresholds met.", _WIDE, ""]
    if whole["all_observations"]:
        lines += [_THIN, "  All Observations", _THIN, *[f"  [note] {x}" for x in whole["all_observations"]], ""]
    return "\n".join(lines)


def evaluate(spark: SparkSession, folders: dict[str, str | None], out: str, generated_at: str, skip: tuple[str, ...] = (), run_id: str | None = None, track: str | None = None) -> dict:
    """Scan, measure, write: eval_<layer>_<id>.json for each layer that is there, flagged_<layer> rows where any are, and the report pair.

    Gives the report back. With `track`, the layers' metrics also go to that folder, once for each run and metric.
    """
    run_id = run_id or str(uuid.uuid4())
    result, flags = run(spark, {k: found(spark, k, folders.get(k)) for k in LAYERS}, skip)
    rows = result.collect()  # four
    for r in rows:
        if r.present and r.flagged_record_count:
            flags[r.layer].write.mode("overwrite").json(f"{out}/flagged_{r.layer}_{run_id}")
    held = spark.createDataFrame(rows, RESULT)
    single = held.where("present").select(F.concat(F.lit("eval_"), "layer", F.lit(f"_{run_id}.json")).alias("name"), F.to_json(F.struct(F.lit(run_id).alias("eval_run_id"), F.col("layer").alias("experiment"), F.from_json("metrics", "map<string,double>").alias("metrics"), "threshold_warnings"), {"ignoreNullFields": "false"}).alias("content"))
    row = report(held, run_id, generated_at).first().asDict(recursive=True)
    pair = spark.createDataFrame([(f"report_{run_id}.json", json.dumps(document(row), indent=2, ensure_ascii=False)), (f"report_{run_id}.txt", text(row))], "name string, content string")
    files.write(single.unionByName(pair), out)
    if track:
        sinks.track(held.where("present").select("layer", F.explode(F.from_json("metrics", "map<string,double>")).alias("key", "value")), run_id, track)
    return row
