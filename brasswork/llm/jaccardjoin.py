"""N-gram Jaccard join (operator 4): prefix filters under several global token orders, then exact verification.

Texts become sets of hashed word shingles; equal sets collapse to one node before anything is dealt by token. Two sets
of at least `percent` likeness share a token among the first n - ceil(percent * n) + 1 of each, under any global order
of tokens. Three orders are used. The first (rare tokens first, by a fixed-size table of token counts over all
documents) deals postings to buckets; candidates must also share prefix tokens under the second and third before their
sets are compared. Before that, bitmaps in which every token turns a bit over bound the difference from below: two sets
differ by at least as many tokens as their bitmaps by bits. A bitmap has as many bits as the set has tokens (the next
power of two, `BITS` at least); the longer one of a pair is folded to the other's length.

Groups of near copies never expand into all pairs (`_links`). In a bucket, each set names the first of the bucket's `PIVOTS`
smallest numbers that the positional filter lets through (if the shared token is the first common one, the overlap is
at most what either set has left from it on, `r`); numbers are hashes, so a group's buckets mostly name the same one,
and each set is compared with the nearest that it names, by the bitmaps. Verified links join sets into components. Then
each set names, in each bucket, at most one mate of another component (the nearest, where the bucket carries bitmaps),
and each component's nearest of these pairs is verified. Only sets of a bucket that are still in different components are
then paired with one another, all of those that the positional filter and the bitmaps let through: first each component's
nearest pair, then, of what still joins different components, every pair. So no link between components is missed, and links
inside a component change nothing. In a
bucket with more than `HOT` sets, bitmaps are compared before pairs are made, and with more than `BLOCK` it is split
into blocks, whose pairs of blocks go to different tasks.

Defined results: null or blank text has no shingles and is linked with nothing; a text with fewer words than `width`
has one shingle; equal texts are linked; a null doc_id is linked like any other, and a component's id is its smallest
doc_id that isn't null; repeated rows each give a row; an empty table gives no rows; other columns don't matter.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _links, _shared
from ._shingles import mixed

WIDTH = 3
PERCENT = 90
#: Counters of the table of token counts, dealt in chunks; its size doesn't depend on the input.
COUNTERS = 1 << 21
CHUNKS = 64
SEEDS = (np.uint64(0x5851F42D4C957F2D), np.uint64(0x14057B7EF767814F), np.uint64(0x2545F4914F6CDD1D))


def _packed(counts: np.ndarray) -> bytes:
    """Mostly small counts, squeezed: as bytes by place value."""
    return zlib.compress(counts.astype("<i8").view(np.uint8).reshape(-1, 8).T.tobytes(), 1)


def _unpacked(raw: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(raw), dtype=np.uint8).reshape(8, -1).T.copy().view("<i8").ravel()


def token_classes(docs: DataFrame, width: int) -> bytes:
    """How frequent tokens are: a byte for each of `COUNTERS` hashed counters over all documents' sets."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts = np.zeros(COUNTERS, dtype=np.int64)
        for batch in batches:
            for part in _links.slices(batch):
                for s in _links.sets(part["text"].tolist(), width):
                    np.add.at(counts, (s % np.uint64(COUNTERS)).astype(np.int64), 1)
        task = TaskContext.get().partitionId()
        if counts.any():
            yield pd.DataFrame({"chunk": np.arange(CHUNKS), "task": task, "counts": [_packed(c) for c in counts.reshape(CHUNKS, -1)]})

    def add(part: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(COUNTERS // CHUNKS, dtype=np.int64)
        for c in part["counts"]:
            total += _unpacked(c)
        return pd.DataFrame({"chunk": [part["chunk"].iloc[0]], "task": [part["task"].iloc[0] // 64], "counts": [_packed(total)]})

    schema = "chunk int, task int, counts binary"
    part = docs.mapInPandas(_shared.frugal(count), schema)
    part = part.groupBy("chunk", F.floor(F.col("task") / 64)).applyInPandas(add, schema)  # at most 64 tables in a group
    rows = part.groupBy("chunk").applyInPandas(add, schema).collect()  # CHUNKS rows of a fixed size
    counts = np.zeros((CHUNKS, COUNTERS // CHUNKS))
    for r in rows:
        counts[r["chunk"]] = _unpacked(r["counts"])
    counts = counts.ravel()
    usual = max(1.0, counts.mean())
    return np.clip(np.floor(2 * np.log2(np.maximum(counts, usual) / usual)), 0, 63).astype(np.uint8).tobytes()


def _prefix(s: np.ndarray, classes: np.ndarray | None, seed: np.uint64, percent: int) -> np.ndarray:
    """The first tokens of a set under the order (class, keyed hash): as many as the filter needs, in order."""
    n = len(s)
    p = n - (percent * n + 99) // 100 + 1
    key = mixed(s ^ seed)
    if classes is not None:
        key = (key >> np.uint64(6)) | (classes[(s % np.uint64(COUNTERS)).astype(np.int64)].astype(np.uint64) << np.uint64(58))
    first = np.argpartition(key, p - 1)[:p] if p < n else np.arange(n)
    return s[first[np.argsort(key[first], kind="stable")]].view(np.int64)


def _linked(docs: DataFrame, width: int, percent: int, marked: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows with their set's number (`marked`: and a hash of their text), sets with their least doc_id and rows, labels of linked sets."""
    spark = docs.sparkSession
    _shared.ship(spark)
    kept = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _shared.text_or_empty().alias("text"), *([F.xxhash64(F.col("text").cast("string")).alias("mark")] if marked else []))
    table = spark.sparkContext.broadcast(token_classes(kept.select("text"), width))  # COUNTERS bytes

    def prefixes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        classes = np.frombuffer(table.value, dtype=np.uint8)
        seen: set[int] = set()  # sets of this task: only their first row is dealt on
        for batch in batches:
            for part in _links.slices(batch):
                sets = _links.sets(part["text"].tolist(), width)
                nids = [_links.node(s) for s in sets]
                heads = []
                for nid, s in zip(nids, sets):
                    heads.append(len(s) > 0 and nid not in seen)
                    seen.add(nid)
                made = {"n": [len(s) for s in sets], "nid": nids}
                made["first"] = [_prefix(s, classes, SEEDS[0], percent) if h else None for s, h in zip(sets, heads)]
                # Half of a token's bits do for the other orders: a false agreement only costs a comparison.
                made["second"] = [_prefix(s, classes, SEEDS[1], percent).astype(np.int32) if h else None for s, h in zip(sets, heads)]
                made["third"] = [_prefix(s, None, SEEDS[2], percent).astype(np.int32) if h else None for s, h in zip(sets, heads)]
                made["bits"] = [_links.bitmap(s) if h else None for s, h in zip(sets, heads)]
                own = {"doc_id": part["doc_id"].array} | ({"mark": part["mark"].to_numpy()} if marked else {})
                yield pd.DataFrame(own | made)

    schema = f"doc_id long, {'mark long, ' if marked else ''}n int, nid long, first array<long>, second array<int>, third array<int>, bits array<long>"
    signed = _shared.written(_shared.in_pandas(kept, prefixes, schema).withColumn("row", F.monotonically_increasing_id()), "signed")
    nodes, full = _links.heads(signed, "first")
    postings = full.select("nid", "n", F.posexplode("first").alias("pos", "token")).select("token", "nid", "n", (F.col("n") - F.col("pos")).cast("int").alias("r"))
    labels = _links.linked(kept, nodes, full, postings, width, percent, ("second", "third"))
    return signed, nodes, labels


def representatives(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> tuple[DataFrame, bool]:
    """(doc_id, mark) of one row of each component and of all rows without words, and whether a (doc_id, mark) repeats.

    Components are those of the sets, so neither repeated nor null ids mix them up; mark is xxhash64(text). The row with
    the smallest doc_id stays (null ids come last), then the one with the smallest mark.
    """
    signed, _, labels = _linked(docs, width, percent, marked=True)
    rank = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "mark")
    by_set = signed.where("n > 0").groupBy("nid").agg(F.min(rank).alias("first"))
    by_component = by_set.join(labels.withColumnRenamed("node", "nid"), "nid", "left").groupBy(F.coalesce("label", "nid").alias("label")).agg(F.min("first").alias("first"))
    chosen = by_component.select("first.doc_id", "first.mark").union(signed.where("n = 0").select("doc_id", "mark").distinct())
    repeated = signed.groupBy("doc_id", "mark").count().where("count > 1").limit(1).count()
    return _shared.written(chosen, "chosen"), bool(repeated)


def join(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles and component_id of every (doc_id, text) row."""
    signed, nodes, labels = _linked(docs, width, percent)

    by_node = _links.components_of(nodes, labels)
    rows = signed.select("doc_id", F.col("n").cast("long").alias("n_shingles"), "nid")
    blank = rows.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return blank.union(_shared.left_join(rows.where("n_shingles > 0"), by_node, "nid", "rows").select("doc_id", "n_shingles", "component_id"))


def op4_jaccardjoin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join(_shared.table(spark, sf_dir, "documents"))
