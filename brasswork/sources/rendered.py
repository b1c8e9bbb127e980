"""Bronze relations over stored tables: documents as they are, and domain documents rendered from business tables."""

from __future__ import annotations

from ..functions import vocab as V
from ..functions.dialect import Dialect
from ..plans.relation import Relation

NL = "chr(10)"


def _date(ts: str) -> str:
    return f"concat(CAST(year({ts}) AS STRING), '-', lpad(CAST(month({ts}) AS STRING), 2, '0'), '-', lpad(CAST(day({ts}) AS STRING), 2, '0'))"


def _s(x: str) -> str:
    return f"CAST({x} AS STRING)"


def _long_date(ts: str) -> str:
    months = ("January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December")
    name = "CASE month({0}) ".format(ts) + " ".join(f"WHEN {i} THEN '{m}'" for i, m in enumerate(months, 1)) + " END"
    return f"concat({name}, ' ', {_s(f'day({ts})')}, ', ', {_s(f'year({ts})')})"


def natural() -> Relation:
    """`documents` as Bronze: text, length, hash, status by length."""
    return Relation("documents").select(
        lambda d: {
            "document_id": f"concat('doc-', {_s('doc_id')})",
            "bronze_record_id": f"concat('bronze-doc-', {_s('doc_id')})",
            "ord": "doc_id",
            "file_name": f"concat({_s('doc_id')}, CASE WHEN doc_id % 97 = 5 THEN '.pdf' ELSE '.txt' END)",
            "parse_error": "CASE WHEN doc_id % 97 = 5 THEN 'remote parser is not available' END",
            "text": "text",
            "source_system": "source",
        }
    ).add(bronze_outcome)


def bronze_outcome(d: Dialect) -> dict[str, str]:
    """Status, text and length after parsing: an error makes a failed row without text, no text a partial one."""
    size = "length(coalesce(text, ''))"
    return {
        "parse_status": f"CASE WHEN parse_error IS NOT NULL THEN 'failed' WHEN {size} = 0 THEN 'partial' ELSE 'success' END",
        "parsed_text": "CASE WHEN parse_error IS NULL THEN coalesce(text, '') END",
        "char_count": f"CASE WHEN parse_error IS NULL THEN CAST({size} AS BIGINT) END",
        "parse_model": f"CASE WHEN parse_error IS NULL THEN '{V.PARSER}' ELSE 'unknown' END",
        "file_hash": d.digest("coalesce(text, '')"),
    }


def incidents() -> Relation:
    """Incident reports from error events; lines left out by the event's number make partial and invalid ones."""
    e = "event_id"
    lines = [
        f"CASE WHEN {e} % 11 = 0 THEN '' ELSE concat('Incident ID: INC-', {_s('year(ts)')}, '-', lpad({_s(f'{e} % 1000000')}, 6, '0'), {NL}) END",
        f"concat('Incident Date: ', {_date('ts')}, {NL})",
        f"concat('Incident Type: ', CASE {e} % 3 WHEN 0 THEN 'Service Outage' WHEN 1 THEN 'Data Loss' ELSE 'Network Failure' END, {NL})",
        f"CASE WHEN {e} % 7 = 0 THEN '' ELSE concat('Severity: ', CASE {e} % 4 WHEN 0 THEN 'Critical' WHEN 1 THEN 'high' WHEN 2 THEN 'Medium' ELSE 'LOW' END, {NL}) END",
        f"concat('Status: ', CASE {e} % 5 WHEN 0 THEN 'open' WHEN 1 THEN 'Resolved' WHEN 2 THEN 'closed' WHEN 3 THEN 'In Progress' ELSE 'under review' END, {NL})",
        f"CASE WHEN {e} % 5 = 0 THEN '' ELSE concat('Reported by: User ', {_s('user_id')}, '.', {NL}, {NL}) END",
        f"CASE WHEN {e} % 10 = 0 THEN '' ELSE concat('Affected Systems:', {NL}, '- gateway ', {_s(f'{e} % 9')}, {NL}, '* queue ', {_s(f'{e} % 4')}, {NL}, {NL}) END",
        f"CASE WHEN {e} % 15 = 0 THEN '' ELSE concat('Root Cause:', {NL}, 'A change to service ', {_s('user_id')}, ' exhausted its pool.', {NL}, 'Next Steps Taken: none', {NL}, {NL}) END",
        f"CASE WHEN {e} % 20 = 0 THEN '' ELSE concat('Resolution:', {NL}, 'The pool was widened and the service restarted.', {NL}) END",
    ]
    return _bronze(Relation("events").where(lambda d: "event_type = 'error'"), "incident", e, lines, f"CASE WHEN {e} % 13 = 0 THEN NULL ELSE '{V.INCIDENT}' END", V.INCIDENT)


def letters() -> Relation:
    """Regulatory letters from orders."""
    o = "o_orderkey"
    lines = [
        f"CASE WHEN {o} % 9 = 0 THEN '' ELSE concat('District Office: ', CASE {o} % 3 WHEN 0 THEN 'Chicago District' WHEN 1 THEN 'Dallas District' ELSE 'Seattle District' END, '.', {NL}) END",
        f"concat('Date: ', {_long_date('o_orderdate')}, {NL})",
        f"concat('Issued to:', {NL}, 'Jane Q. Porter', {NL}, 'Vice President', {NL}, 'Customer ', {_s('o_custkey')}, ' Pharmaceuticals Inc.', {NL}, {NL})",
        f"concat('Dear Ms. Porter,', {NL}, {NL}, 'We inspected your site. Records for order ', {_s(o)}, ' were not kept. ', CASE WHEN {o} % 2 = 0 THEN 'Please send a plan! ' ELSE '' END, 'Reply soon. Thank you.', {NL}, {NL})",
        f"CASE WHEN {o} % 7 = 0 THEN '' ELSE concat('Violation 1: Failure to keep records.', {NL}, 'Violation 2 - Mixed lots,', {NL}) END",
        f"CASE WHEN {o} % 4 = 0 THEN '' ELSE concat('See 21 CFR § 211.', {_s(f'{o} % 200')}, '(b) and 21  CFR § 210.1, under Title 21, Code of Federal Regulations (CFR), Parts 210 and 211', {NL}) END",
        f"CASE WHEN {o} % 5 = 0 THEN '' ELSE concat('Corrective action is needed within fifteen (', {_s(f'{o} % 20 + 1')}, ') working days.', {NL}) END",
        f"CASE WHEN {o} % 3 = 0 THEN concat('Lot #A', {_s(f'{o} % 100')}, ' (Amoxicillin Capsules, 500 mg)', {NL}) ELSE '' END",
    ]
    return _bronze(Relation("orders"), "letter", o, lines, f"CASE WHEN {o} % 10 = 0 THEN NULL ELSE '{V.LETTER}' END", V.LETTER)


def advisories() -> Relation:
    """Security advisories from parts."""
    p = "p_partkey"
    lines = [
        f"concat('Title: ', p_name, ' flaw', {NL})",
        f"CASE WHEN {p} % 8 = 0 THEN '' ELSE concat('Advisory ID: ICSA-24-', lpad({_s(f'{p} % 1000')}, 3, '0'), '-', lpad({_s(f'{p} % 100')}, 2, '0'), {NL}) END",
        f"concat('Release Date: ', {_s(f'{p} % 12 + 1')}, '/', {_s(f'{p} % 28 + 1')}, '/2024', {NL})",
        f"CASE {p} % 4 WHEN 0 THEN concat('Severity: HIGH', {NL}) WHEN 1 THEN concat('CVSS v3 Base Score: ', {_s(f'{p} % 10')}, '.5', {NL}) WHEN 2 THEN concat('A high risk for ', p_brand, {NL}) ELSE '' END",
        f"CASE {p} % 3 WHEN 0 THEN concat('No known patch exists for it.', {NL}) WHEN 1 THEN concat('Updates are available.', {NL}) ELSE '' END",
        f"concat('It is tracked as CVE-2024-', lpad({_s(f'{p} % 100000')}, 5, '0'), ' and CVE-2023-1234.', {NL}, {NL})",
        f"CASE WHEN {p} % 6 = 0 THEN '' ELSE concat('Affected Products:', {NL}, '- ', p_brand, ' ', p_type, {NL}, '- ', p_name, {NL}, {NL}) END",
        f"CASE WHEN {p} % 5 = 0 THEN '' ELSE concat('Executive Summary:', {NL}, 'An attacker may stop ', p_name, '. It takes one packet. No login is asked. More follows.', {NL}, {NL}) END",
        f"CASE WHEN {p} % 2 = 0 THEN '' ELSE concat('Mitigations:', {NL}, 'Keep the device off the network and apply the update when it is out.', {NL}) END",
    ]
    return _bronze(Relation("part"), "advisory", p, lines, f"'{V.ADVISORY}'", V.ADVISORY)


def _bronze(rows: Relation, name: str, key: str, lines: list[str], hint: str, domain: str) -> Relation:
    return rows.select(
        lambda d: {
            "document_id": f"concat('{name}-', {_s(key)})",
            "bronze_record_id": f"concat('bronze-{name}-', {_s(key)})",
            "ord": f"CAST({key} AS BIGINT)",
            "parsed_text": f"concat({', '.join(lines)})",
            "document_class_hint": hint,
            "domain": f"'{domain}'",
            "parse_status": "'success'",
        }
    )


BY_DOMAIN = {V.INCIDENT: incidents, V.LETTER: letters, V.ADVISORY: advisories}
