"""Queries whose inputs were cut or replaced by fixed values, against plain Python."""

from __future__ import annotations

import re

from brasswork.functions import vocab as V
from brasswork.plans import catalogue as C

SF = "/root/testdata/sf0.001"


def test_summary_reads_beyond_a_prefix(spark, tmp_path):
    texts = ["word " * 600 + "one.  Two " + "long " * 600 + "is it? Three! Four.", "no stop " * 500, " A.\nB! ", ""]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.summary for r in C.QUERIES["summary_sentences"](spark, str(tmp_path)).collect()}
    assert got == {i: " ".join(re.split(r"(?<=[.!?])\s+", t.strip())[:3]).strip() for i, t in enumerate(texts)}


def test_all_bronze_and_silver_thresholds_can_warn(spark, tmp_path):
    texts = ["x" * 20] * 20 + ["y" * 600] * 80
    spark.createDataFrame([(i * 97, t, "s") for i, t in enumerate(texts)], "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    assert C.QUERIES["bronze_thresholds"](spark, str(tmp_path)).collect()[0][0] == "p10_char_count 20 is below target 100 — near-empty parses detected at the 10th percentile"
    # The reference: the letters' required fields over all records, absent in the other domains.
    letter = C.silver_of(V.LETTER).frame(spark, SF).select(*V.REQUIRED[V.LETTER]).collect()
    rows = C.all_silver().frame(spark, SF).collect()
    empty = sum(v in (None, "", []) for r in letter for v in r) + 5 * (len(rows) - len(letter))
    said = C.QUERIES["silver_thresholds"](spark, SF).collect()[0][0]
    assert f"required_field_null_rate {empty / len(rows) / 5:.2%} exceeds target 5.00%" in said
    covered = sorted(r.field_coverage_pct for r in rows)
    p25 = covered[max(0, len(covered) * 25 // 100 - 1)]
    assert ("p25_field_coverage_pct" in said) == (p25 < 0.5)
    low = C.E.nearest(C.all_silver().add(lambda d: {"low": "field_coverage_pct / 4"}), "low", {"p25_field_coverage_pct": 25})
    whole = C._beside(C.all_silver().agg((), C.E.silver_metrics), low, C._required_nulls())
    assert "p25_field_coverage_pct" in C._warned(whole, V.SILVER_TARGETS).frame(spark, SF).collect()[0][0]


def test_governance_reads_drift_from_the_layers(spark, tmp_path):
    flags = C.QUERIES["governance_flags"](spark, SF).collect()[0][0].split(",")
    assert "warning:missing_provenance" in flags and "warning:mixed_schema_versions" in flags and "warning:mixed_environments" not in flags
    # No Gold rows (numbers by fives) leave one schema version; numbers off 9 and 10 have real runs only.
    for name, ids, expected in (("one", (5, 25), (1, 1, False)), ("null", (10, 20), (1, 1, True)), ("placeholder", (45,), (1, 1, True)), ("two", (1, 2), (2, 1, False)), ("none", (), (0, 1, False))):
        spark.createDataFrame([(i, "error") for i in ids], "event_id long, event_type string").write.parquet(f"{tmp_path}/{name}/events.parquet")
        got = C._drift().frame(spark, f"{tmp_path}/{name}").collect()[0]
        assert (got.schema_versions, got.environments, got.missing_provenance) == expected, name
