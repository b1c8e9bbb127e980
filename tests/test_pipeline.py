"""Files to Gold in batch and as a stream; registry, names, sinks; queries against DuckDB."""

from __future__ import annotations

import glob
import math
import os

import pytest

from brasswork.functions import registry
from brasswork.functions import vocab as V
from brasswork.plans import pipeline
from brasswork.plans.config import environment
from brasswork.sources import sinks
from brasswork.streaming import ingest

from .test_extract import INCIDENT

SF = "/root/testdata/sf0.001"


@pytest.fixture
def landing(tmp_path):
    folder = tmp_path / "landing"
    folder.mkdir()
    (folder / "a.txt").write_text(INCIDENT)
    (folder / "b.md").write_bytes(b"Status: open\xff\r\n")
    (folder / "c.pdf").write_bytes(b"%PDF")
    (folder / "d.exe").write_bytes(b"MZ")
    return str(folder)


def test_batch(spark, landing, tmp_path):
    layers = pipeline.run(spark, landing, str(tmp_path / "out"), "r1", V.INCIDENT)
    bronze = {r.file_name: r for r in layers["bronze"].collect()}
    assert set(bronze) == {"a.txt", "b.md", "c.pdf"} and bronze["c.pdf"].parse_status == "failed" and bronze["b.md"].parsed_text == "Status: open�\n"
    assert layers["rejected"].count() == 1
    gold = layers["gold"].collect()
    assert [(r.outcome_category, r.routing_label, r.export_ready) for r in gold] == [("exported", "incident_management", True)]
    assert [r.lineage for r in pipeline.lineage(spark, layers).collect()] == ["complete", "incomplete", "incomplete"]
    sinks.export_files(layers["gold"], str(tmp_path / "exports"))
    assert glob.glob(str(tmp_path / "exports/incident_management/*.json"))


def test_stream(spark, landing, tmp_path):
    args = (spark, landing, str(tmp_path / "out"), str(tmp_path / "state"), V.INCIDENT)
    ingest.start(*args, once=True).awaitTermination()
    (tmp_path / "landing" / "e.txt").write_text(INCIDENT)
    ingest.start(*args, once=True).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out/bronze")).count() == 4
    assert spark.read.parquet(str(tmp_path / "out/gold")).count() == 2


def test_registry_and_names():
    assert registry.keys(True) == sorted(V.DOMAINS)
    with pytest.raises(registry.DomainNotImplemented):
        registry.require_active(V.PLANNED_DOMAINS[0])
    with pytest.raises(registry.DomainNotFound):
        registry.domain("x")
    assert environment("PROD").table("silver") == "documents_prod_silver.extracted_records"
    with pytest.raises(ValueError):
        environment("moon")
    assert sinks.safe_name("a/b:c d") == "a_b_c_d" and sinks.safe_name("a/b:c\\d", delivery=True) == "a_b:c_d"


def _plain(v):
    return None if v is None or isinstance(v, float) and math.isnan(v) else v if isinstance(v, bool) else round(float(v), 6) if isinstance(v, int | float) else str(v)


@pytest.mark.parametrize("name", ["bronze_metrics", "bronze_flags", "cisa_fields", "incident_fields", "fda_validation", "silver_error_frequency", "outcomes", "contract_errors", "trace_rates", "governance_health"])
def test_against_duckdb(spark, name):
    import duckdb

    from brasswork.plans.catalogue import ORACLE_SQL, QUERIES

    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    found = QUERIES[name](spark, SF)
    q = con.execute(ORACLE_SQL[name])
    names = [c[0] for c in q.description]
    assert sorted(names) == sorted(found.columns)
    expected = sorted((tuple(_plain(v) for v in r) for r in q.fetchall()), key=repr)
    assert sorted((tuple(_plain(r[c]) for c in names) for r in found.collect()), key=repr) == expected
