"""Evaluation: metrics, thresholds and flags of each layer, and lineage between layers."""

from __future__ import annotations

import re

from ..functions import vocab as V
from ..functions.dialect import Dialect


def rate(d: Dialect, condition: str, over: str = "count(*)") -> str:
    """Share of rows, to four places; null without rows."""
    return f"round({d.count_if(condition)} / CAST(nullif({over}, 0) AS DOUBLE), 4)"


def nearest(relation, column: str, percents: dict[str, int]):
    """Values at the ranks floor(n * p / 100), 1 at least, of a column's rising values: one row, by value counts.

    Counts per value are cumulated, so no task sorts all rows, only distinct values.
    """
    counted = relation.where(lambda d: f"{column} IS NOT NULL").agg((column,), lambda d: {"k": "count(*)"})
    ranked = counted.add(lambda d: {"upto": f"sum(k) OVER (ORDER BY {column})", "n": "sum(k) OVER ()"})
    return ranked.agg((), lambda d: {name: f"min(CASE WHEN upto >= greatest(1, floor(n * {p} / 100.0)) THEN {column} END)" for name, p in percents.items()})


def bronze_metrics(d: Dialect) -> dict[str, str]:
    good = "coalesce(parse_status, '') IN ('success', 'partial')"
    return {
        "total_documents": "count(*)",
        "parse_success_rate": rate(d, "parse_status = 'success'"),
        "parse_partial_rate": rate(d, "parse_status = 'partial'"),
        "parse_failure_rate": rate(d, "parse_status = 'failed'"),
        "zero_char_count_rate": rate(d, "parse_status = 'success' AND char_count = 0"),
        "median_char_count": f"CAST({d.median(f'CASE WHEN {good} THEN char_count END')} AS DOUBLE)",
    }


def bronze_flags(d: Dialect) -> dict[str, str]:
    return {
        "review_reasons": d.compact(
            ("parse_status = 'failed'", "'parse_status=failed'"),
            (f"parse_status = 'success' AND char_count < {V.SHORT_PARSE}", "concat('suspiciously_short_parse (char_count=', CAST(char_count AS STRING), ')')"),
            ("parse_status IN ('success', 'partial') AND char_count = 0", "'zero_char_count_despite_non_failed_status'"),
        )
    }


def silver_metrics(d: Dialect) -> dict[str, str]:
    return {
        "total_records": "count(*)",
        "schema_validity_rate": rate(d, "validation_status = 'valid'"),
        "partial_rate": rate(d, "validation_status = 'partial'"),
        "invalid_rate": rate(d, "validation_status = 'invalid'"),
        "mean_field_coverage_pct": "round(avg(field_coverage_pct), 4)",
    }


def silver_flags(d: Dialect) -> dict[str, str]:
    return {
        "review_reasons": d.compact(
            ("validation_status = 'invalid'", "'validation_status=invalid'"),
            (f"field_coverage_pct < {V.LOW_SILVER_COVERAGE}", f"concat('low_field_coverage (field_coverage_pct=', {d.fixed('field_coverage_pct')}, ')')"),
        )
    }


def gold_metrics(d: Dialect) -> dict[str, str]:
    c = "classification_confidence"
    return {
        "total_records": "count(*)",
        "classification_success_rate": rate(d, f"coalesce(document_type_label, '{V.UNKNOWN}') <> '{V.UNKNOWN}'"),
        "unknown_label_rate": rate(d, f"coalesce(document_type_label, '{V.UNKNOWN}') = '{V.UNKNOWN}'"),
        "quarantine_rate": rate(d, f"routing_label = '{V.QUARANTINE}'"),
        "export_ready_rate": rate(d, "export_ready"),
        "confidence_null_rate": rate(d, f"{c} IS NULL"),
        "mean_classification_confidence": f"round(avg({c}), 4)",
        "low_confidence_rate": rate(d, f"{c} < {V.LEAST_CONFIDENCE}", f"count({c})"),
    }


def gold_flags(d: Dialect) -> dict[str, str]:
    c = "classification_confidence"
    return {
        "review_reasons": d.compact(
            (f"document_type_label = '{V.UNKNOWN}'", "'document_type_label=unknown'"),
            (f"{c} < {V.VERY_LOW_CONFIDENCE}", f"concat('very_low_confidence (classification_confidence=', {d.fixed(c)}, ')')"),
            ("export_ready = false", "'export_ready=false'"),
        )
    }


def filled(d: Dialect, template: str, own: str = "") -> str:
    """A text whose {name:form} parts are columns; {:form} is the column `own`. Forms: .2% and .0%, .4f, none."""
    parts, at = [], 0
    for m in re.finditer(r"\{(\w*)(?::\.(\d)([%f]))?\}", template):
        column, digits, kind = m[1] or own, m[2], m[3]
        shown = f"CAST({column} AS STRING)" if not kind else d.fixed(f"CAST({column}{' * 100' if kind == '%' else ''} AS DOUBLE)", int(digits))
        parts += [d.text(template[at : m.start()]), shown, *(["'%'"] if kind == "%" else [])]
        at = m.end()
    return f"concat({', '.join([*parts, d.text(template[at:])])})"


def warnings(d: Dialect, targets) -> dict[str, str]:
    """A text for each metric that misses its target; null metrics don't warn."""
    return {"threshold_warnings": d.compact(*[(f"{name} {sign} {target}", filled(d, text, name)) for name, sign, target, text in targets])}


def observations(d: Dialect) -> dict[str, str]:
    """Notes on records without confidence, and on records of placeholder runs."""
    return {"observations": d.compact(("confidence_null_rate > 0", filled(d, V.NULL_CONFIDENCE)), ("placeholders > 0", filled(d, V.PLACEHOLDERS)))}


def ranked(relation, key: str):
    """Counts of a column's values, their share of all, and their place: the most frequent first, ties by value."""
    return relation.agg((key,), lambda d: {"n": "count(*)"}).add(lambda d: {"rate": "round(n / CAST(sum(n) OVER () AS DOUBLE), 4)", "place": f"row_number() OVER (ORDER BY n DESC, {key})"})


def error_frequency(records, domains):
    """How often each validation error occurs, for each record: the most frequent first, ties by what was seen first (domain, ord, place in the list)."""
    nth = "CASE domain " + " ".join(f"WHEN '{k}' THEN {i}" for i, k in enumerate(domains)) + f" ELSE {len(tuple(domains))} END"
    by = records.explode("validation_errors", "error").agg(("error",), lambda d: {"n": "count(*)", "seen": f"min({d.together(nth, 'ord', d.place('validation_errors', 'error'))})"}).add(lambda d: {"one": "1"})
    total = records.agg((), lambda d: {"records": "count(*)"}).add(lambda d: {"one": "1"})
    return by.join(total, "inner", ("one",)).select(lambda d: {"error": "error", "n": "n", "rate": "round(n / CAST(records AS DOUBLE), 4)", "place": "row_number() OVER (ORDER BY n DESC, seen)"})


def flagged(relation, flags):
    """Rows that have a reason to be reviewed."""
    return relation.add(flags).where(lambda d: f"{d.size('review_reasons')} > 0")


def empty_slots(d: Dialect, names) -> str:
    """The number of a row's empty slots; a name that the row doesn't have (with a dash before it) is one."""
    from .silver import populated

    return " + ".join("1" if n.startswith("-") else f"CASE WHEN {populated(d, n)} THEN 0 ELSE 1 END" for n in names)


def required_null_rate(d: Dialect, names) -> dict[str, str]:
    """Empty required slots among all; a name that the rows don't have counts as empty."""
    return {"required_field_null_rate": f"round(sum({empty_slots(d, names)}) / CAST(nullif(count(*) * {len(names)}, 0) AS DOUBLE), 4)"}


def orphans(child, parent, key: str):
    """Child rows whose key is null, empty or unknown to the parent."""
    known = parent.where(lambda d: f"coalesce({key}, '') <> ''").agg((key,), lambda d: {"links": "count(*)"}).select(lambda d: {key: key})
    return child.join(known, "anti", (key,))


def link_rate(child, parent, key: str, name: str):
    """Share of child rows with a known parent, and the number of orphans; one row."""
    known = parent.where(lambda d: f"coalesce({key}, '') <> ''").agg((key,), lambda d: {"links": "count(*)"})
    return child.join(known, "left", (key,)).agg((), lambda d: {f"{name}_rate": rate(d, "links IS NOT NULL"), f"orphaned_{name.split('_')[0]}_count": d.count_if("links IS NULL")})
