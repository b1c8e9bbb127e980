"""The export contract: checks of a JSON payload, quarantine shape, and the gate in front of the export."""

from __future__ import annotations

from ..functions import vocab as V
from ..functions.dialect import Dialect

# The contract's messages.
NOT_OBJECT = "payload must be a dict object"
UNKNOWN_TYPE = "'document_type' is 'unknown' — this record should be quarantined, not treated as a valid handoff unit (B-0 §3)"
QUARANTINED = "'routing_label' is 'quarantine' — quarantine records must not be treated as handoff units; they have export_ready=False and produce no export file (B-0 §3, §6)"
DOMAIN_NAMES = {V.LETTER: "FDA warning letter", V.ADVISORY: "CISA advisory", V.INCIDENT: "incident report"}


#: Members of a payload whose type is looked at, and of its two parts.
TOP = ("extracted_fields", "provenance", "parsed_text_excerpt", "document_id", "source_file", "document_type", "routing_label")
FIELDS = tuple(dict.fromkeys(n for k in V.DOMAINS for n in V.REQUIRED[k]))


def _kind(d: Dialect, name: str) -> str:
    return f"coalesce({d.kind_of(f't_{name}')}, '')"


def _blank(d: Dialect, key: str) -> str:
    return f"({_kind(d, key)} <> 'string' OR {d.strip(f's_{key}')} = '')"


def _top(d: Dialect) -> str:
    cases = [(_blank(d, k), d.text(f"'{k}' must be a non-empty string")) for k in ("document_id", "source_file")]
    cases += [(_blank(d, "document_type"), d.text("'document_type' must be a non-empty string")), ("s_document_type = 'unknown'", d.text(UNKNOWN_TYPE))]
    cases += [(_blank(d, "routing_label"), d.text("'routing_label' must be a non-empty string")), ("s_routing_label = 'quarantine'", d.text(QUARANTINED))]
    return d.compact(*cases)


def _domain(d: Dialect, domain: str) -> str:
    """Errors of a domain's required fields."""
    cases = []
    for name in V.REQUIRED[domain]:
        kind = _kind(d, name)
        cases.append((f"t_{name} IS NULL", d.text(f"Missing required {DOMAIN_NAMES[domain]} extracted_field: '{name}'")))
        cases.append((f"{kind} = 'null'", d.text(f"Required {DOMAIN_NAMES[domain]} extracted_field '{name}' is null")))
        here = f"{kind} NOT IN ('', 'null')"
        if name == "violation_type":
            cases.append((f"{here} AND ({kind} <> 'array' OR n_violation_type = 0)", d.text("'violation_type' must be a non-empty array of violation category strings")))
        elif name in V.BOOLEANS:
            cases.append((f"{here} AND {kind} <> 'boolean'", d.text(f"'{name}' must be a boolean")))
        elif name in ("severity_level", "status"):
            known = V.SEVERITIES if name == "severity_level" else V.INCIDENT_STATUSES
            cases.append((f"{here} AND NOT {d.isin(f's_{name}', known)}", f"concat({d.text(f"'{name}' must be one of {sorted(known)}; got '")}, s_{name}, {d.text(chr(39))})"))
    return d.compact(*cases)


def _provenance(d: Dialect) -> str:
    cases = []
    for key in V.PROVENANCE_KEYS:
        cases.append((f"t_{key} IS NULL", d.text(f"Missing required provenance field: '{key}'")))
        if key != "classification_confidence":
            cases.append((f"{_kind(d, key)} = 'null'", d.text(f"Required provenance field '{key}' is null. All provenance fields except classification_confidence must be non-null.")))
    kind, value = _kind(d, "classification_confidence"), "s_classification_confidence"
    number = f"CASE WHEN {kind} = 'boolean' THEN CASE WHEN {value} = 'true' THEN 1e0 ELSE 0e0 END ELSE {d.number(value, 'double')} END"
    cases.append((f"{kind} IN ('string', 'array', 'object')", d.text("provenance.classification_confidence must be a number (0.0–1.0) or null")))
    cases.append((f"{kind} IN ('number', 'boolean') AND NOT ({number} BETWEEN 0 AND 1)", f"concat('provenance.classification_confidence ', {value}, ' out of range [0.0, 1.0]')"))
    return d.compact(*cases)


def validated(relation):
    """Adds contract_found, the ordered errors of export_payload (JSON text) whether or not it is to be exported.

    The payload is parsed once, into a column; its members' types and texts are columns too, of which the rules are made.
    """

    def members(d: Dialect) -> dict[str, str]:
        v = "payload_value"
        types = {f"t_{k}": d.type_of(v, k) for k in TOP}
        return types | {f"s_{k}": d.said(v, k) for k in ("document_id", "source_file", "document_type", "routing_label")} | {"payload_fields": d.part(v, "extracted_fields"), "payload_provenance": d.part(v, "provenance")}

    def parts(d: Dialect) -> dict[str, str]:
        f, p = "payload_fields", "payload_provenance"
        types = {f"t_{k}": d.type_of(f, k) for k in FIELDS} | {f"t_{k}": d.type_of(p, k) for k in V.PROVENANCE_KEYS}
        texts = {f"s_{k}": d.said(f, k) for k in ("severity_level", "status")} | {"s_classification_confidence": d.said(p, "classification_confidence")}
        missing = d.compact(*[(f"t_{k} IS NULL", d.text(f"Missing required field: '{k}'")) for k in V.PAYLOAD_KEYS])
        return types | texts | {"n_violation_type": f"coalesce({d.size(d.items(f, 'violation_type'))}, 0)", "payload_missing": missing}

    def checks(d: Dialect) -> dict[str, str]:
        held = f"{_kind(d, 'extracted_fields')} = 'object'"
        found = {f"errors_{i}": f"CASE WHEN {held} AND s_document_type = '{k}' THEN {_domain(d, k)} ELSE {d.empty()} END" for i, k in enumerate(V.DOMAINS)}
        return {
            "errors_top": _top(d),
            "errors_fields": d.compact((f"NOT {held}", d.text("'extracted_fields' must be an object"))),
            **found,
            "errors_excerpt": d.compact((f"{_kind(d, 'parsed_text_excerpt')} <> 'string'", d.text("'parsed_text_excerpt' must be a string"))),
            "errors_provenance": f"CASE WHEN {_kind(d, 'provenance')} <> 'object' THEN {d.compact(('true', d.text("'provenance' must be an object")))} ELSE {_provenance(d)} END",
        }

    def whole(d: Dialect) -> dict[str, str]:
        order = ["errors_top", "errors_fields", *[f"errors_{i}" for i in range(len(V.DOMAINS))], "errors_excerpt", "errors_provenance"]
        return {"contract_found": f"CASE WHEN {d.size('payload_missing')} > 0 THEN payload_missing ELSE {d.plus(*order)} END"}

    return relation.add(lambda d: {"payload_value": d.parsed("export_payload")}).add(members).add(parts).add(checks).add(whole)


def gated(relation):
    """Adds contract_errors (of records that were ready) and exported: ready, and without errors."""

    def gate(d: Dialect) -> dict[str, str]:
        return {"contract_errors": f"CASE WHEN export_ready THEN contract_found ELSE {d.empty()} END", "was_ready": "export_ready"}

    def demoted(d: Dialect) -> dict[str, str]:
        return {"exported": f"was_ready AND {d.size('contract_errors')} = 0"}

    return validated(relation).add(gate).add(demoted)


def gate(rows):
    """`gated` on a DataFrame: export_ready after the gate, contract_errors, outcome; working columns go."""
    from ..plans.relation import Relation
    from .gold import outcome

    kept = rows.columns
    out = gated(Relation()).on(rows)
    out = out.drop("export_ready").withColumnRenamed("exported", "export_ready").select(*kept, "contract_errors")
    return Relation().add(outcome).on(out)


def quarantine_errors(d: Dialect) -> dict[str, str]:
    """What a quarantined Gold row must look like: not ready, routed to quarantine, without an export path."""
    got = "CASE WHEN export_ready IS NULL THEN 'None' WHEN export_ready THEN 'True' ELSE 'False' END"
    return {
        "quarantine_errors": d.compact(
            ("NOT coalesce(export_ready = false, false)", f"concat('Quarantine records must have export_ready=False; got ', {got})"),
            ("coalesce(routing_label, '') <> 'quarantine'", f"concat({d.text("Quarantine records must have routing_label='quarantine'; got '")}, coalesce(routing_label, 'None'), {d.text(chr(39))})"),
            ("export_path IS NOT NULL", f"concat({d.text("Quarantine records must not have an export_path; got '")}, export_path, {d.text("'. Only export_ready=True records produce export files (B-0 §7).")})"),
        )
    }
