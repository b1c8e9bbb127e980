"""Silver: eligibility, dispatch by class hint, typed fields, coverage, validation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import vocab as V
from ..functions.dialect import Dialect
from .extract import with_fields

#: The domain without a hint.
DEFAULT = V.LETTER


class UnknownDomain(ValueError):
    """A class hint that no extractor serves."""


def eligible(d: Dialect) -> str:
    """Only failed parses are left out; a missing status is eligible."""
    return "coalesce(parse_status, '') <> 'failed'"


def populated(d: Dialect, name: str, x: str | None = None) -> str:
    """Not null, not an empty text, not an empty list; false and 0 are populated."""
    x = x or name
    if name in V.LISTS:
        return f"coalesce({d.size(x)} > 0, false)"
    if name in V.BOOLEANS or name in V.NUMBERS:
        return f"({x} IS NOT NULL)"
    return f"coalesce({x} <> '', false)"


def coverage(d: Dialect, domain: str) -> str:
    names = V.REQUIRED[domain] + V.OPTIONAL[domain]
    total = " + ".join(f"CASE WHEN {populated(d, n)} THEN 1 ELSE 0 END" for n in names)
    return f"round(({total}) / CAST({len(names)} AS DOUBLE), 4)"


def missing(d: Dialect, domain: str) -> dict[str, str]:
    required = d.compact(*[(f"NOT {populated(d, n)}", d.text(f"Required field '{n}' is missing or null.")) for n in V.REQUIRED[domain]])
    optional = d.compact(*[(f"NOT {populated(d, n)}", d.text(f"Optional field '{n}' is not populated.")) for n in V.OPTIONAL[domain]])
    return {"missing_required": required, "missing_optional": optional}


def verdict(d: Dialect) -> dict[str, str]:
    status = d.ladder((f"{d.size('missing_required')} > 0", "'invalid'"), (f"{d.size('missing_optional')} > 0", "'partial'"), other="'valid'")
    errors = d.ladder((f"{d.size('missing_required')} > 0", "missing_required"), other="missing_optional")
    return {"validation_status": status, "validation_errors": errors}


def scored(d: Dialect, domain: str) -> dict[str, str]:
    return {"field_coverage_pct": coverage(d, domain), **missing(d, domain)}


def extracted(relation, domain: str, cut: bool = False):
    """Adds to a relation with parsed_text: the domain's fields, coverage, status and errors."""
    names = V.REQUIRED[domain] + V.OPTIONAL[domain]
    kept = ("document_id", "bronze_record_id", "ord", "domain", "document_class_hint", *names, "field_coverage_pct", "validation_status", "validation_errors")
    out = with_fields(relation, domain).add(lambda d: scored(d, domain)).add(verdict)
    return out.select(lambda d: {k: k for k in kept}) if cut else out


def constraints(d: Dialect) -> dict[str, str]:
    """Names of the rules that a Silver record breaks (has_fields says whether it has any extracted fields)."""
    cases = [
        (f"NOT {d.isin("coalesce(validation_status, '')", V.VALIDATION_STATUSES)}", "'validation_status'"),
        ("validation_status = 'valid' AND NOT coalesce(has_fields, false)", "'valid_without_fields'"),
        ("coalesce(field_coverage_pct < 0.0 OR field_coverage_pct > 1.0, true)", "'field_coverage_pct'"),
        *[(f"{c} IS NULL", f"'{c}'") for c in ("document_id", "bronze_record_id", "extraction_id", "pipeline_run_id")],
    ]
    return {"constraint_violations": d.compact(*cases)}


def silver(bronze: DataFrame, run_id: str) -> DataFrame:
    """Silver records of Bronze records: each domain by its own rules, one struct per domain (the others null).

    A null hint means `DEFAULT`; a hint without an extractor raises `UnknownDomain`, an empty one too.
    """
    from ..plans.relation import Relation

    other = bronze.where(F.col("document_class_hint").isNotNull() & ~F.col("document_class_hint").isin(*V.DOMAINS)).select("document_class_hint").limit(1).collect()
    if other:
        raise UnknownDomain(f"no extractor for class hint {other[0][0]!r}")
    kept = bronze.where(~F.col("parse_status").eqNullSafe("failed")).withColumn("domain", F.coalesce("document_class_hint", F.lit(DEFAULT)))
    parts = []
    for domain in V.DOMAINS:
        names = V.REQUIRED[domain] + V.OPTIONAL[domain]
        part = extracted(Relation(), domain).on(kept.where(F.col("domain") == domain))
        common = ["document_id", "bronze_record_id", F.expr("concat('ext-', bronze_record_id)").alias("extraction_id"), F.lit(run_id).alias("pipeline_run_id"), "document_class_hint", "domain", F.lit(V.PROMPTS[domain]).alias("extraction_prompt_id"), F.lit(V.EXTRACTOR).alias("extraction_model"), "field_coverage_pct", "validation_status", "validation_errors", F.lit(V.SCHEMA_VERSION).alias("schema_version")]
        parts.append(part.select(*common, F.struct(*names).alias(domain)))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    return out
