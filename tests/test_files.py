"""Files that are published whole, listings by tasks, and a stream that equals the batch."""

from __future__ import annotations

import json
import os

import pytest
from pyspark.sql import functions as F

from brasswork.operators import bronze
from brasswork.plans import pipeline
from brasswork.sources import files
from brasswork.streaming import ingest


def tree(base) -> dict[str, bytes]:
    return {os.path.relpath(os.path.join(d, n), base): open(os.path.join(d, n), "rb").read() for d, _, names in os.walk(base) for n in names}


def test_a_failed_job_leaves_no_file_and_a_rerun_changes_nothing(spark, tmp_path):
    base = str(tmp_path / "out")
    rows = spark.range(40).repartition(4).select(F.concat(F.lit("a/"), F.col("id").cast("string"), F.lit(".json")).alias("name"), F.concat(F.lit("é "), F.col("id").cast("string")).alias("content"))
    broken = rows.withColumn("content", F.when(F.col("name") == "a/17.json", F.raise_error(F.lit("injected"))).otherwise(F.col("content")))
    with pytest.raises(Exception, match="injected"):
        files.write(broken, base)
    assert tree(base) == {}
    files.write(rows, base)
    whole = tree(base)
    assert whole == {f"a/{i}.json": f"é {i}".encode() for i in range(40)}
    with pytest.raises(Exception, match="injected"):
        files.write(broken, base)
    assert tree(base) == whole and os.listdir(base) == ["a"]
    files.write(rows, base)
    assert tree(base) == whole
    changed = rows.withColumn("content", F.lit("new"))
    files.write(changed, base, keep=True)
    assert tree(base) == whole
    files.write(changed, base)
    assert set(tree(base).values()) == {b"new"}


@pytest.mark.parametrize("name", ["../x", "/x", "a//b", ""])
def test_a_name_stays_under_its_base(spark, tmp_path, name):
    with pytest.raises(Exception, match="not the name of a file"):
        files.write(spark.createDataFrame([(name, "c")], "name string, content string"), str(tmp_path / "out"))
    assert tree(tmp_path) == {}


def test_a_killed_attempt_is_never_published(spark, tmp_path):
    writer = files.named_files()({"base": str(tmp_path)}).writer(None, False)

    def rows():
        yield {"name": "x.json", "content": "whole"}
        raise KeyboardInterrupt

    with pytest.raises(KeyboardInterrupt):
        writer.write(rows())
    done = writer.write(iter([{"name": "x.json", "content": "whole"}, {"name": "y.json", "content": b"raw"}]))
    assert "x.json" not in os.listdir(tmp_path)
    writer.commit([done, None])
    assert tree(tmp_path) == {"x.json": b"whole", "y.json": b"raw"}


def test_records(spark, tmp_path):
    records = spark.createDataFrame([("r1", None, [1]), ("r2", "t", None)], "id string, text string, held array<int>")
    files.write_records(records, "id", str(tmp_path))
    assert {k: json.loads(v) for k, v in tree(tmp_path).items()} == {"r1.json": {"id": "r1", "text": None, "held": [1]}, "r2.json": {"id": "r2", "text": "t", "held": None}}


def test_missing_paths(spark, tmp_path):
    for name in ("a/one.json", "b/two.json"):
        os.makedirs(tmp_path / name.split("/")[0], exist_ok=True)
        (tmp_path / name).write_text("")
    paths = [f"{tmp_path}/a/one.json", f"file:{tmp_path}/b/two.json", f"file://{tmp_path}/a/one.json", f"{tmp_path}/a/three.json", f"{tmp_path}/c/four.json"]
    got = files.missing(spark.createDataFrame([(p,) for p in paths], "path string"))
    assert sorted(r.path for r in got.collect()) == sorted(paths[3:])


def test_stream_equals_batch(spark, tmp_path):
    landing, out = tmp_path / "landing", str(tmp_path / "stream")
    landing.mkdir()
    for name, content in (("empty.txt", b""), ("bad.txt", b"Incident ID: INC-2024-1\n\xff\xfe end"), ("good.txt", "Schäden\r\nSeverity: High".encode()), ("slides.ppt", b"x"), ("nothing.pdf", b"")):
        (landing / name).write_bytes(content)

    def once():
        ingest.start(spark, str(landing), out, str(tmp_path / "check"), "incident_report", once=True).awaitTermination()

    def stored(name):
        return {r.source_path if name == "bronze" else r.path: r for r in spark.read.parquet(f"{out}/{name}").collect()}

    once()
    batch = pipeline.run(spark, str(landing), str(tmp_path / "batch"), "r", "incident_report")
    same = ("document_id", "file_hash", "file_size_bytes", "parse_status", "parsed_text", "char_count", "mime_type")
    want, got = {r.source_path: r for r in batch["bronze"].collect()}, stored("bronze")
    assert len(got) == 4 and {k: [r[c] for c in same] for k, r in got.items()} == {k: [r[c] for c in same] for k, r in want.items()}
    assert {k: r.reason for k, r in stored("rejected").items()} == {r.path: r.reason for r in batch["rejected"].collect()} != {}
    once()
    assert len(stored("bronze")) == 4
    (landing / "late.txt").write_bytes(b"")
    os.utime(landing / "late.txt", (1, 1))  # older than all that was seen
    once()
    assert len(stored("bronze")) == 5
    assert spark.read.parquet(f"{out}/gold").count() == batch["gold"].count()


def test_empty_files_are_scanned(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes(b"")
    (tmp_path / "b.txt").write_bytes(b"b")
    got = {r.path: (r.length, bytes(r.content)) for r in bronze.scan_files(spark, str(tmp_path)).collect()}
    assert got == {f"file:{tmp_path}/a.txt": (0, b""), f"file:{tmp_path}/b.txt": (1, b"b")}
