"""Typed construction from raw answers: hand-written expectations."""

from __future__ import annotations

from brasswork.functions import vocab as V
from brasswork.operators import typed

WHOLE = '"issuing_office":"Office","recipient_company":"C","issue_date":"2024-01-01","violation_type":["a"],"corrective_action_requested":true'
MORE = ',"recipient_name":"R","cited_regulations":["21 CFR"],"response_deadline_days":15,"product_involved":"P","summary":"S"'
CASES = {
    "whole": (f"{{{WHOLE}{MORE}}}", "valid", 1.0, []),
    "unknown member": (f'{{{WHOLE}{MORE},"other":[1]}}', "valid", 1.0, []),
    "word for a flag": (f"{{{WHOLE}{MORE}}}".replace("true", '" On "'), "valid", 1.0, []),
    "number for a flag": (f"{{{WHOLE}{MORE}}}".replace("true", "0"), "valid", 1.0, []),
    "text for a number": (f"{{{WHOLE}{MORE}}}".replace(":15", ':"15.0"'), "valid", 1.0, []),
    "broken number": (f"{{{WHOLE}{MORE}}}".replace(":15", ":15.5"), "invalid", 0.0, ["Field model construction failed: response_deadline_days must be a whole number; got number"]),
    "broken text": (f"{{{WHOLE}{MORE}}}".replace('"Office"', "5"), "invalid", 0.0, ["Field model construction failed: issuing_office must be a text; got number"]),
    "broken flag and list": (f"{{{WHOLE}{MORE}}}".replace("true", "2").replace('["a"]', '["a",null]'), "invalid", 0.0, ["Field model construction failed: violation_type must be a list of texts; got array; corrective_action_requested must be true or false; got number"]),
    "text for a list": (f"{{{WHOLE}{MORE}}}".replace('["a"]', '"a"'), "invalid", 0.0, ["Field model construction failed: violation_type must be a list of texts; got string"]),
    "nulls": (f'{{{WHOLE},"summary":null}}', "partial", 0.5, [f"Optional field '{n}' is not populated." for n in V.OPTIONAL[V.LETTER]]),
    "not an object": ("[1]", "invalid", 0.0, [f"Required field '{n}' is missing or null." for n in V.REQUIRED[V.LETTER]]),
    "not JSON": ("{", "invalid", 0.0, [f"Required field '{n}' is missing or null." for n in V.REQUIRED[V.LETTER]]),
    "no answer": (None, "invalid", 0.0, [f"Required field '{n}' is missing or null." for n in V.REQUIRED[V.LETTER]]),
}


def test_every_answer_gives_a_record(spark):
    rows = spark.createDataFrame([(k, f"b {k}", None, v[0]) for k, v in CASES.items()], "document_id string, bronze_record_id string, document_class_hint string, raw string")
    got = {r.document_id: r for r in typed.assembled(rows, V.LETTER, "run", "model").collect()}
    for k, (_, status, coverage, errors) in CASES.items():
        r = got[k]
        assert (r.validation_status, r.field_coverage_pct, sorted(r.validation_errors)) == (status, coverage, sorted(errors)), k
        assert (r[V.LETTER] is None) == k.startswith(("broken", "text for a list")), k
    assert got["word for a flag"][V.LETTER].corrective_action_requested is True and got["number for a flag"][V.LETTER].corrective_action_requested is False
    assert got["text for a number"][V.LETTER].response_deadline_days == 15
    fields = typed.assembled(rows, V.LETTER, "run", "model").schema[V.LETTER].dataType
    assert fields.simpleString() == typed.struct_of(V.LETTER).simpleString()


def test_a_classifier_that_fails_says_unknown(spark):
    told = f'{{"document_type_label":"{V.LETTER}","classification_confidence":'
    cases = [(told + "0.9}", V.LETTER, 0.9), (told + "null}", V.LETTER, None), (told + "1}", V.LETTER, 1.0), (told + "1.5}", V.UNKNOWN, 0.0), (told + '"0.9"}', V.UNKNOWN, 0.0), ('{"document_type_label":"essay"}', V.UNKNOWN, 0.0), ("{", V.UNKNOWN, 0.0), (None, V.UNKNOWN, 0.0), ("[]", V.UNKNOWN, 0.0)]
    rows = spark.createDataFrame([(i, raw) for i, (raw, _, _) in enumerate(cases)], "i int, raw string")
    got = {r.i: (r.document_type_label, r.classification_confidence) for r in typed.classified(rows).collect()}
    assert got == {i: (label, confidence) for i, (_, label, confidence) in enumerate(cases)}
