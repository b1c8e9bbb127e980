"""Extraction, coverage and validation on small texts, against expectations written by hand."""

from __future__ import annotations

import pytest

from brasswork.functions import vocab as V
from brasswork.operators.silver import UnknownDomain, extracted, silver
from brasswork.plans.relation import Relation

INCIDENT = """Incident ID: INC-2024-0042
Incident Date: March 5, 2024
Incident Type: Service Outage.
Severity: high
Status: In Progress
Reported by: Alex Doe,
Affected Systems:
- Payments API
* Queue

Root Cause:
A pool was exhausted by retries.
Next Steps Taken: none
"""

ADVISORY = """# Flaw in Pump Controller
Advisory ID: ICSA-24-123-01
Release Date: 3/7/2024
CVSS v3 Base Score: 9.1
Vendor has released a patch. CVE-2024-12345, cve-2024-12345 and CVE-2023-0001.
Affected Products:
- Pump 1.0
- Pump 2.0
"""

LETTER = """District Office: Dallas District.
**Date:** July 4, 2023
Issued to:
Jane Q. Porter
Vice President
Acme Pharmaceuticals Inc.

Dear Ms. Porter,

We inspected the site. Records were missing! Please answer. More text.

Violation 1 — Missing records.
Violation 2: Mixed lots,
21 CFR § 211.22(a) and 21  CFR § 211.100
Title 21, Code of Federal Regulations (CFR), Parts 210 and 211
Corrective action within fifteen (15) working days.
"""


def rows(spark, text, domain, hint=None):
    df = spark.createDataFrame([("d", "b", 0, domain, hint or domain, text)], "document_id string, bronze_record_id string, ord long, domain string, document_class_hint string, parsed_text string")
    return extracted(Relation(), domain).on(df).first()


def test_incident(spark):
    r = rows(spark, INCIDENT, V.INCIDENT)
    assert (r.incident_id, r.incident_date, r.incident_type, r.severity, r.status, r.reported_by) == ("INC-2024-0042", "2024-03-05", "Service Outage", "High", "open", "Alex Doe")
    assert r.affected_systems[:2] == ["Payments API", "Queue"]
    assert r.root_cause == "A pool was exhausted by retries."
    assert r.validation_status == "partial" and r.validation_errors == ["Optional field 'resolution_summary' is not populated."]
    assert r.field_coverage_pct == round(8 / 9, 4)


def test_priority_beyond_four_is_final(spark):
    r = rows(spark, "Priority: P7\ncritical", V.INCIDENT)
    assert r.severity is None
    assert rows(spark, "seen P2 today", V.INCIDENT).severity == "High"


def test_advisory(spark):
    r = rows(spark, ADVISORY, V.ADVISORY)
    assert (r.title, r.advisory_id, r.published_date, r.severity_level, r.remediation_available) == ("Flaw in Pump Controller", "ICSA-24-123-01", "2024-03-07", "Critical", True)
    assert r.cve_ids == ["CVE-2023-0001", "CVE-2024-12345", "cve-2024-12345"]
    assert r.affected_products == ["Pump 1.0", "Pump 2.0"]


def test_no_fix_comes_first(spark):
    assert rows(spark, "No known patch is available. Updates are available.", V.ADVISORY).remediation_available is False
    assert rows(spark, "nothing said", V.ADVISORY).remediation_available is None


def test_letter(spark):
    r = rows(spark, LETTER, V.LETTER)
    assert (r.issuing_office, r.recipient_company, r.recipient_name) == ("Dallas District", "Acme Pharmaceuticals Inc", "Jane Q. Porter")
    assert r.issue_date == "2023-07-04"
    assert r.violation_type == ["Missing records", "Mixed lots"]
    assert r.cited_regulations == ["21 CFR Part 210", "21 CFR Part 211", "21 CFR § 211.100", "21 CFR § 211.22(a)"]
    assert (r.corrective_action_requested, r.response_deadline_days) == (True, 15)
    assert r.summary == "We inspected the site. Records were missing! Please answer."


def test_empty_text_is_invalid(spark):
    for domain in V.DOMAINS:
        r = rows(spark, "", domain)
        assert r.validation_status == "invalid" and len(r.validation_errors) >= 4


def test_unicode_letters_count_as_word_letters(spark):
    assert rows(spark, "Étion District Office", V.LETTER).issuing_office == "Étion District Office"


def test_dispatch(spark):
    schema = "document_id string, bronze_record_id string, parse_status string, parsed_text string, document_class_hint string"
    made = spark.createDataFrame([("1", "b1", "success", INCIDENT, V.INCIDENT), ("2", "b2", "failed", None, V.INCIDENT), ("3", "b3", None, LETTER, None)], schema)
    got = {r.document_id: r for r in silver(made, "r").collect()}
    assert set(got) == {"1", "3"} and got["3"].domain == V.LETTER and got["1"][V.INCIDENT].severity == "High" and got["1"][V.LETTER] is None
    with pytest.raises(UnknownDomain):
        silver(spark.createDataFrame([("1", "b", "success", "x", "")], schema), "r")
