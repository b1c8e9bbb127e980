"""Field extraction: a text expression per field of each domain, in a dialect."""

from __future__ import annotations

from ..functions import patterns as P
from ..functions.dialect import Dialect
from ..functions.vocab import ADVISORY, INCIDENT, LETTER


def iso_date(d: Dialect, raw: str, slashes: bool) -> str:
    """Dates with English month names (and m/d/yyyy) as yyyy-MM-dd; anything else as it is. No range checks."""
    month, day, year = (d.extract(raw, P.NAMED_DATE, "", g) for g in (1, 2, 3))
    number = d.ladder(*[(f"lower({month}) = '{name}'", f"'{i:02d}'") for i, name in enumerate(P.MONTHS, 1)])
    named = f"concat({year}, '-', {number}, '-', lpad({day}, 2, '0'))"
    cases = [(f"({number}) IS NOT NULL", named)]
    if slashes:
        m, dd, y = (d.extract(raw, P.SLASHED_DATE, "", g) for g in (1, 2, 3))
        cases.append((f"{m} IS NOT NULL", f"concat({y}, '-', lpad({m}, 2, '0'), '-', lpad({dd}, 2, '0'))"))
    return d.ladder(*cases, other=raw)


def _list(d: Dialect, xs: str) -> str:
    return f"CASE WHEN {d.size(xs)} > 0 THEN {xs} END"


def _bullets(d: Dialect, section: str, skip: str | None = None) -> str:
    lines = d.each(d.split(section, "\n"), lambda x: d.replace(d.strip(x), P.BULLET, "''"))
    return d.head(d.only(lines, lambda x: f"length({x}) > 2" + (f" AND {x} NOT LIKE '{skip}%'" if skip else "")), 10)


# Each domain: steps of named expressions over the text `t`; names that start with x_ are intermediate, computed once.


def _letter(d: Dialect) -> list[dict[str, str]]:
    t = "t"
    first = {
        "x_office": d.clean(d.first(t, P.OFFICE)),
        "x_date": d.strip(d.coalesce(d.extract(t, P.ISSUED), d.extract(f"left({t}, 500)", P.ISSUED_NEAR_TOP, ""))),
        "x_violations": d.each(d.all(t, P.VIOLATION), d.clean),
        "x_inline": d.each(d.all(t, P.REGULATION, "", 0), lambda x: d.replace(x, r"\s+", "' '")),
        "x_parts": d.each(d.all(d.coalesce(d.extract(t, P.REGULATION_PARTS), "''"), r"\d+", "", 0), lambda x: f"concat('21 CFR Part ', {x})"),
        "x_opening": d.strip(d.extract(t, P.GREETING, "s")),
    }
    second = {"x_cited": d.sorted(d.plus("x_inline", "x_parts")), "x_summary": d.sentences("x_opening")}
    last = {
        "issuing_office": d.coalesce("x_office", d.ladder((f"{t} LIKE '%Chicago District%'", "'FDA Chicago District Office'"))),
        "recipient_company": d.clean(d.first(t, P.COMPANY, "m")),
        "recipient_name": d.strip(d.extract(t, P.RECIPIENT, "m")),
        "issue_date": iso_date(d, "x_date", False),
        "violation_type": d.ladder((f"{d.size('x_violations')} > 0", "x_violations"), (d.has(t, P.CGMP), d.nonnull(["'CGMP Violations'"]))),
        "cited_regulations": _list(d, "x_cited"),
        "corrective_action_requested": d.any(t, P.CORRECTIVE),
        "response_deadline_days": d.number(d.first(t, P.DEADLINE, ""), "int"),
        "product_involved": d.coalesce(d.strip(d.extract(t, P.LOT, "")), d.clean(d.extract(t, P.DRUG, "")), d.ladder((d.has(t, P.GENERIC_DRUG), "'Pharmaceutical drug products'"))),
        "summary": "CASE WHEN length(x_summary) > 20 THEN x_summary END",
    }
    return [first, second, last]


def _advisory(d: Dialect) -> list[dict[str, str]]:
    t, top, near = "t", "left(t, 500)", "left(t, 2000)"
    lines = d.only(d.each(d.split(t, r"\r\n|\n|\r"), d.strip), lambda x: f"length({x}) > 10 AND NOT {d.has(x, P.NOT_TITLE)} AND {d.has(x, '[A-Za-z]{3,}', '')}")
    first = {
        "x_title": d.strip(d.replace(d.strip(d.extract(t, P.TITLE, "m")), r"^#+|#+\Z", "''")),
        "x_date": d.strip(d.coalesce(d.first(t, P.PUBLISHED), d.extract(top, P.PUBLISHED_NEAR_TOP, ""), d.extract(top, P.ISO_DATE, ""))),
        "x_level": d.extract(t, P.LEVEL),
        "x_score": d.number(d.first(t, P.CVSS), "double"),
        "x_section": d.extract(t, P.PRODUCTS),
        "x_inline": d.head(d.each(d.all(t, P.PRODUCTS_INLINE), d.strip), 5),
        "x_found": d.sorted(d.all(t, P.CVE, "i", 0)),
        "x_remedy": d.strip(d.extract(t, P.REMEDY)),
        "x_executive": d.extract(t, P.EXECUTIVE),
        "x_long": d.at(d.only(d.each(d.split(t, r"\n{2,}"), d.strip), lambda x: f"length({x}) > 50"), 1),
    }
    second = {"x_listed": _bullets(d, "x_section"), "x_remedy_cut": d.cut("x_remedy"), "x_executive_cut": d.sentences(d.strip("x_executive")), "x_opening": d.sentences("x_long")}
    last = {
        "advisory_id": d.strip(d.first(t, P.ADVISORY_ID)),
        "title": d.coalesce("x_title", f"left({d.at(lines, 1)}, 200)"),
        "published_date": iso_date(d, "x_date", True),
        "severity_level": d.ladder(
            ("x_level IS NOT NULL", d.capital("x_level")),
            ("x_score >= 9", "'Critical'"), ("x_score >= 7", "'High'"), ("x_score >= 4", "'Medium'"), ("x_score IS NOT NULL", "'Low'"),
            (d.has(near, P.CRITICAL), "'Critical'"), (d.has(near, P.HIGH_RISK), "'High'"),
        ),
        "remediation_available": d.ladder((d.any(t, P.NO_FIX), "false"), (d.any(t, P.FIX), "true"), (d.has(t, P.FIX_SECTION, "im"), "true")),
        "affected_products": d.ladder((f"{d.size('x_listed')} > 0", "x_listed"), (f"{d.size('x_inline')} > 0", "x_inline")),
        "cve_ids": _list(d, "x_found"),
        "remediation_summary": "CASE WHEN length(x_remedy_cut) > 10 THEN x_remedy_cut END",
        "summary": d.ladder(("x_executive IS NOT NULL", "nullif(x_executive_cut, '')"), ("length(x_opening) > 20", "x_opening")),
    }
    return [first, second, last]


def _incident(d: Dialect) -> list[dict[str, str]]:
    t = "t"
    ranks = ("Critical", "High", "Medium", "Low")
    inline = d.each(d.only(d.split(d.strip(d.extract(t, P.SYSTEMS_INLINE)), P.SYSTEMS_BREAK), lambda x: f"{d.strip(x)} <> ''"), d.clean)
    first = {
        "x_date": d.strip(d.coalesce(d.first(t, P.OCCURRED), d.extract(f"left({t}, 1000)", P.DATED, "im"), d.extract(f"left({t}, 500)", P.ISO_DATE, ""))),
        "x_type": d.clean(d.extract(t, P.TYPE)),
        "x_level": d.extract(t, P.INCIDENT_LEVEL),
        "x_priority": d.extract(t, P.PRIORITY),
        "x_bare": d.extract(f"left({t}, 500)", P.BARE_PRIORITY, ""),
        "x_status": f"lower({d.extract(t, P.STATUS)})",
        "x_section": d.extract(t, P.SYSTEMS),
        "x_inline": inline,
        "x_cause": d.at(d.split(d.strip(d.extract(t, P.CAUSE)), P.NEXT_HEADING), 1),
        "x_resolution": d.at(d.split(d.strip(d.extract(t, P.RESOLUTION)), P.NEXT_HEADING), 1),
    }
    second = {"x_listed": _bullets(d, "x_section", "#"), "x_cause_cut": d.cut("x_cause"), "x_resolution_cut": d.cut("x_resolution")}
    last = {
        "incident_id": d.strip(d.first(t, P.INCIDENT_ID)),
        "incident_date": iso_date(d, "x_date", True),
        "incident_type": d.ladder(("length(x_type) < 100", "x_type"), *[(d.has(t, p), d.text(v)) for p, v in P.TYPE_WORDS]),
        "severity": d.ladder(
            ("x_level IS NOT NULL", d.capital("x_level")),
            ("x_priority IS NOT NULL", d.ladder(*[(f"x_priority = '{i}'", f"'{r}'") for i, r in enumerate(ranks, 1)])),
            ("x_bare IS NOT NULL", d.ladder(*[(f"x_bare = 'P{i}'", f"'{r}'") for i, r in enumerate(ranks, 1)])),
            *[(d.has(f"left({t}, 1500)", p), d.text(v)) for p, v in P.LEVEL_WORDS],
        ),
        "status": d.ladder(
            (d.isin("x_status", ("resolved", "closed")), "'resolved'"), (d.isin("x_status", ("open", "in progress", "investigating")), "'open'"), ("x_status = 'under review'", "'under_review'"),
            *[(d.has(t, p), d.text(v)) for p, v in P.STATUS_WORDS],
        ),
        "affected_systems": d.ladder((f"{d.size('x_listed')} > 0", "x_listed"), (f"{d.size('x_inline')} > 0", "x_inline")),
        "root_cause": "CASE WHEN length(x_cause_cut) > 10 THEN x_cause_cut END",
        "resolution_summary": "CASE WHEN length(x_resolution_cut) > 10 THEN x_resolution_cut END",
        "reported_by": d.clean(d.first(t, P.REPORTED)),
    }
    return [first, second, last]


STEPS = {LETTER: _letter, ADVISORY: _advisory, INCIDENT: _incident}


def with_fields(relation, domain: str):
    """Adds the domain's fields (and intermediate columns) to a relation with parsed_text."""
    out = relation.add(lambda d: {"t": "coalesce(parsed_text, '')"})
    for i in range(3):
        out = out.add(lambda d, i=i: STEPS[domain](d)[i])
    return out
