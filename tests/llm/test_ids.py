"""Ids of 64 bits beside nulls come back as they went in, from every operator and stage that runs in Python."""

from __future__ import annotations

import pytest

import corpus_pipeline
from brasswork.llm import _shared, arrowfile, chat, fingerprint, jaccardjoin, linededup, packing, quality

IDS = [2**53 + 1, 2**53 + 3, 2**63 - 1, -(2**63), -(2**53) - 1, 7, None, None]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, f"text {k} of some words that are all its own {k}", "en", "s", 40) for k, i in enumerate(IDS)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1)


@pytest.fixture(scope="module")
def labels(spark, docs):
    return spark.createDataFrame([(2**53 + 1, 1), (2**53 + 3, 0), (7, 1)], "doc_id long, quality int")


def order(ids):
    return sorted(ids, key=lambda x: (x is None, x or 0))


RUNS = {
    "packing": lambda docs, labels, tmp: packing.pack(docs),
    "quality": lambda docs, labels, tmp: quality.scores(docs, labels),
    "jaccard": lambda docs, labels, tmp: jaccardjoin.join(docs),
    "arrow": lambda docs, labels, tmp: arrowfile.read_documents(arrowfile.write_shards(docs, str(tmp))),
    "fingerprint": lambda docs, labels, tmp: fingerprint.fingerprints(docs),
    "lines": lambda docs, labels, tmp: linededup.dedup(docs),
    "stage_jaccard": lambda docs, labels, tmp: corpus_pipeline.stage_jaccard(docs.sparkSession, docs, ""),
    "stage_pii": lambda docs, labels, tmp: corpus_pipeline.stage_pii(docs.sparkSession, docs, ""),
    "stage_mixing": lambda docs, labels, tmp: corpus_pipeline.stage_mixing(docs.sparkSession, docs, "").dropDuplicates(["text"]),
    "stage_packing": lambda docs, labels, tmp: corpus_pipeline.stage_packing(docs.sparkSession, docs, ""),
}


@pytest.mark.parametrize("name", RUNS)
def test_documents(docs, labels, tmp_path, name):
    assert order(r.doc_id for r in RUNS[name](docs, labels, tmp_path).select("doc_id").collect()) == order(IDS)


@pytest.mark.parametrize("name", ["jaccard", "fingerprint"])
def test_components(docs, labels, tmp_path, name):
    assert all(r.doc_id == r.component_id for r in RUNS[name](docs, labels, tmp_path).collect())


def test_conversations(spark):
    turns = spark.createDataFrame([(i, t, "user", f"turn {t}") for i in IDS[:7] for t in range(2)], "conv_id long, turn long, role string, text string").coalesce(1)
    got = chat.read_back(chat.windows(turns)).collect()
    assert order(r.conv_id for r in got) == order(IDS[:7]) and all(r.n_turns == 2 for r in got)


def test_in_pandas(spark):
    _shared.ship(spark)
    rows = [(i, [1, 2], b"x", 0.5, True) for i in IDS] + [(None, None, None, None, None)]
    frame = spark.createDataFrame(rows, "id long, held array<long>, raw binary, share double, yes boolean").coalesce(1)
    assert sorted(map(str, _shared.in_pandas(frame, lambda batches: batches, "id long, held array<long>, raw binary, share double, yes boolean").collect())) == sorted(map(str, frame.collect()))
