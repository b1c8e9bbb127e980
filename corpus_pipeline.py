"""Corpus pipeline: quality classifier, n-gram Jaccard join, PII, mixing, packing. Each stage's rows are written and reread."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from brasswork.llm import _shared, jaccardjoin, mixing, packing, quality, surrogates

#: Near duplicates: shingles of five words, likeness of 0.8 or more.
WIDTH, PERCENT = 5, 80


def stage_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained classifier doesn't reject."""
    return quality.kept(docs, _shared.table(spark, sf_dir, "labels"))


def stage_jaccard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one with the smallest doc_id (one row of it); null ids come last."""
    chosen, repeated = jaccardjoin.representatives(docs, WIDTH, PERCENT)
    none, key, mark = names = _shared.fresh(docs, "_none", "_keep", "_text")

    def keyed(doc_id: Column, text_hash: Column) -> list[Column]:
        return [doc_id.isNull().alias(none), F.coalesce(doc_id, F.lit(0)).alias(key), text_hash.alias(mark)]

    rows = docs.select("*", *keyed(F.col("doc_id").cast("long"), F.xxhash64(F.col("text").cast("string"))))
    kept = _shared.with_small(rows, chosen.select(*keyed(F.col("doc_id"), F.col("mark"))), names, how="left_semi")
    if repeated:
        kept = kept.dropDuplicates(names)
    return kept.select(*docs.columns)


def stage_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Entities replaced by surrogates; n_chars follows the new text."""
    out = surrogates.replace(docs)
    return out.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), F.col("n_chars"))).select(*docs.columns)


def stage_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mixture shows them, each at least once."""
    return mixing.mixed_documents(docs)


def stage_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of packed sequences."""
    return packing.pack(docs).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


_done: list = []


def _cleared(stage):
    """A stage that first removes its predecessor's working tables: the predecessor's result is written by then."""

    @functools.wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        _shared.drop(_done)
        _done.clear()
        before = len(_shared.made())
        out = stage(spark, docs, sf_dir)
        if stage is not stage_packing:
            _done.extend(_shared.made(before))
        return out

    return run_stage


STAGES = [
    ("quality", _cleared(stage_quality)),
    ("jaccard", _cleared(stage_jaccard)),
    ("pii", _cleared(stage_pii)),
    ("mixing", _cleared(stage_mixing)),
    ("packing", _cleared(stage_packing)),
]

#: SQL can't express the classifier's training or the packing's linear program.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, each one's result written and reread as the next one's input."""
    docs = _shared.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = _shared.written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
