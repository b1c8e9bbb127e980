"""Typed construction: an extractor's raw JSON answer becomes a domain's typed fields, or one error, record by record.

An answer that can't be built (a member of the wrong type) isn't dropped and stops nothing: its record is invalid, with coverage 0, no
fields and one error that names the members. An answer that isn't a JSON object, or a null one, counts as an empty answer: its
required fields are missing. Members that a domain doesn't know are left out.

Types: a text takes texts only; a flag takes true and false, 0 and 1, and the usual words for them; a number takes whole numbers
in any of these forms; a list takes lists of texts. Null is no value, in each of them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import vocab as V
from ..functions.dialect import Dialect
from .silver import scored, verdict

# Words that stand for a flag.
YES, NO = ("1", "on", "t", "true", "y", "yes"), ("0", "off", "f", "false", "n", "no")
FAILED = "Field model construction failed: "


def names_of(domain: str) -> tuple[str, ...]:
    return (*V.REQUIRED[domain], *V.OPTIONAL[domain])


def struct_of(domain: str) -> T.StructType:
    """A domain's fields with their types."""
    kind = {**dict.fromkeys(V.BOOLEANS, T.BooleanType()), **dict.fromkeys(V.NUMBERS, T.LongType()), **dict.fromkeys(V.LISTS, T.ArrayType(T.StringType()))}
    return T.StructType([T.StructField(n, kind.get(n, T.StringType())) for n in names_of(domain)])


def _word(d: Dialect, name: str) -> str:
    return f"lower({d.strip(f'said_{name}')})"


def _wrong(d: Dialect, name: str) -> str:
    """Whether a member that is there can't be taken."""
    kind, said = f"kind_{name}", f"said_{name}"
    if name in V.LISTS:
        return f"{kind} <> 'array' OR {d.size(d.only(f'items_{name}', lambda x: f'{x} IS NULL'))} > 0"
    if name in V.BOOLEANS:
        number = d.number(said, "double")
        return f"NOT ({kind} = 'boolean' OR ({kind} = 'number' AND {number} IN (0e0, 1e0)) OR ({kind} = 'string' AND {d.isin(_word(d, name), YES + NO)}))"
    if name in V.NUMBERS:
        number = d.number(said, "double")
        return f"NOT ({kind} = 'boolean' OR ({kind} = 'number' AND {number} = floor({number})) OR ({kind} = 'string' AND {d.has(_word(d, name), '^[+-]?[0-9]{1,18}([.]0+)?$', '')}))"
    return f"{kind} <> 'string'"


def _value(d: Dialect, name: str) -> str:
    said = f"said_{name}"
    if name in V.LISTS:
        return f"items_{name}"
    if name in V.BOOLEANS:
        return f"CASE WHEN kind_{name} = 'number' THEN {d.number(said, 'double')} = 1e0 WHEN {said} IS NOT NULL THEN {d.isin(_word(d, name), YES)} END"
    if name in V.NUMBERS:
        whole = d.replace(_word(d, name), "[.]0*$", "''")
        return f"CASE WHEN kind_{name} = 'boolean' THEN CASE WHEN {said} = 'true' THEN CAST(1 AS BIGINT) ELSE CAST(0 AS BIGINT) END WHEN kind_{name} = 'number' THEN CAST({d.number(said, 'double')} AS BIGINT) ELSE {d.number(whole, 'bigint')} END"
    return said


def built(relation, domain: str, raw: str = "raw"):
    """Adds the domain's typed fields of the column `raw` (JSON text), coverage, status and errors."""
    names = names_of(domain)

    def members(d: Dialect) -> dict[str, str]:
        out = {f"type_{n}": d.type_of("raw_value", n) for n in names}
        out |= {f"said_{n}": d.said("raw_value", n) for n in names if n not in V.LISTS}
        return out | {f"items_{n}": d.items("raw_value", n) for n in names if n in V.LISTS}

    def expected(name: str) -> str:
        return "a list of texts" if name in V.LISTS else "true or false" if name in V.BOOLEANS else "a whole number" if name in V.NUMBERS else "a text"

    def checked(d: Dialect) -> dict[str, str]:
        cases = [(f"coalesce(kind_{n}, 'null') <> 'null' AND ({_wrong(d, n)})", f"concat({d.text(f'{n} must be {expected(n)}; got ')}, kind_{n})") for n in names]
        return {"construction": d.compact(*cases)}

    def rescued(d: Dialect) -> dict[str, str]:
        broken = f"{d.size('construction')} > 0"
        errors = f"concat({d.text(FAILED)}, {d.join('construction', '; ')})"
        return {
            "has_fields": f"NOT ({broken})",
            "coverage_or_none": f"CASE WHEN {broken} THEN 0e0 ELSE field_coverage_pct END",
            "status_or_invalid": f"CASE WHEN {broken} THEN 'invalid' ELSE validation_status END",
            "errors_or_one": f"CASE WHEN {broken} THEN {d.nonnull([errors])} ELSE validation_errors END",
        }

    out = relation.add(lambda d: {"raw_value": d.parsed(raw)}).add(members)
    out = out.add(lambda d: {f"kind_{n}": d.kind_of(f"type_{n}") for n in names}).add(checked)
    out = out.add(lambda d: {n: f"CASE WHEN {d.size('construction')} = 0 THEN {_value(d, n)} END" for n in names})
    return out.add(lambda d: scored(d, domain)).add(verdict).add(rescued)


def assembled(rows: DataFrame, domain: str, run_id: str, model: str, raw: str = "raw") -> DataFrame:
    """Silver records of one domain from Bronze columns and a raw answer: every row gives one, whatever its answer holds."""
    from ..plans.relation import Relation

    kept = rows.select("document_id", "bronze_record_id", "document_class_hint", F.col(raw).alias("raw"))
    out = built(Relation(), domain).on(kept)
    fields = F.when(F.col("has_fields"), F.struct(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in struct_of(domain)]))
    return out.select(
        "document_id", "bronze_record_id", F.expr("concat('ext-', bronze_record_id)").alias("extraction_id"), F.lit(run_id).alias("pipeline_run_id"), "document_class_hint", F.lit(domain).alias("domain"),
        F.lit(V.PROMPTS[domain]).alias("extraction_prompt_id"), F.lit(model).alias("extraction_model"), F.col("coverage_or_none").alias("field_coverage_pct"),
        F.col("status_or_invalid").alias("validation_status"), F.col("errors_or_one").alias("validation_errors"), F.lit(V.SCHEMA_VERSION).alias("schema_version"), fields.alias(domain),
    )


def classified(rows: DataFrame, raw: str = "raw") -> DataFrame:
    """Label and confidence of a classifier's raw JSON answer; what can't be read, or is out of range, is unknown with confidence 0.

    Adds document_type_label and classification_confidence (null where the answer gives none on purpose) to every row.
    """
    value, label, kind = F.try_parse_json(F.col(raw)), F.col("_label"), F.col("_kind")
    told = rows.withColumn("_value", value).withColumns({"_label": F.expr("try_variant_get(_value, '$.document_type_label', 'string')"), "_kind": F.expr("schema_of_variant(variant_get(_value, '$.classification_confidence'))"), "_said": F.expr("try_variant_get(_value, '$.classification_confidence', 'double')")})
    number = ~F.coalesce(kind, F.lit("VOID")).isin("STRING", "BOOLEAN") & F.col("_said").between(0, 1)
    fits = label.isin(*V.DOMAINS, V.UNKNOWN) & (F.coalesce(kind, F.lit("VOID")).eqNullSafe("VOID") | F.coalesce(number, F.lit(False)))
    fits = F.coalesce(fits, F.lit(False))
    return told.withColumns({"document_type_label": F.when(fits, label).otherwise(V.UNKNOWN), "classification_confidence": F.when(fits, F.col("_said")).otherwise(0.0)}).drop("_value", "_label", "_kind", "_said")
