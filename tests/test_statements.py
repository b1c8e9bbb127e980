"""The layers by SQL text: the statements run as they stand, over functions that hold the rules."""

from __future__ import annotations

from brasswork.functions import vocab as V
from brasswork.plans import bootstrap, statements
from brasswork.plans.relation import Relation

LETTER = "FOOD AND DRUG ADMINISTRATION\nChicago District Office\n\nWARNING LETTER\n\nMarch 3, 2024\n\nAcme Pharma, Inc.\n\nDear Dr. Smith:\n\nWe inspected your plant and found several deviations. You should take corrective action. More follows.\n\n1. Failure to clean.\n"


def test_statements(spark, tmp_path):
    (tmp_path / "a.txt").write_text(LETTER.replace("\n", "\r\n"))
    (tmp_path / "b.txt").write_text("Nothing of that kind.")
    (tmp_path / "c.txt").write_text("")
    for _ in range(2):
        trace, counts = statements.create_tables(spark, str(tmp_path))
        rows = trace.collect()
        assert [r.file_name for r in rows] == ["a.txt", "b.txt", "c.txt"] and all(r.full_lineage_present and r.has_silver_record for r in rows)
        assert [(r.document_type_label, r.routing_label, r.export_ready) for r in rows] == [(V.LETTER, "regulatory_review", True), ("unknown", "quarantine", False), ("unknown", "quarantine", False)]
        assert tuple(counts.first()) == (3, 3, 3, 1, 2, 3)
    # The function finds what the relation of the same rules finds.
    by_name = {r.file_name: r for r in spark.sql(f"SELECT file_name, {', '.join(f"try_variant_get(extraction_result, '$.{n}', 'string') AS {n}" for n in bootstrap.FIELDS)} FROM extracted_records_sql").collect()}
    text = spark.createDataFrame([("a.txt", LETTER)], "file_name string, parsed_text string").selectExpr("*", "'d' AS document_id", "'p' AS source_path", "'r' AS pipeline_run_id", "'v' AS schema_version")
    want = bootstrap.silver_projection(Relation()).on(text).selectExpr(*[f"get_json_object(extraction_result, '$.{n}') AS {n}" for n in bootstrap.FIELDS]).first().asDict()
    assert {n: by_name["a.txt"][n] for n in bootstrap.FIELDS} == want and want["issue_date"] == "2024-03-03" and want["corrective_action_requested"] == "true"
    smoke = {r.source_path.rsplit("/", 1)[-1]: r.parsed_content for r in spark.table("parsed_documents_smoke_sql").collect()}
    assert smoke == {"a.txt": LETTER, "b.txt": "Nothing of that kind.", "c.txt": ""}
    assert spark.sql("SELECT try_variant_get(classify_document(parse_json('{}'), '{\"other\": \"x\"}', map()), '$.response[0]', 'string')").first()[0] == "unknown"
