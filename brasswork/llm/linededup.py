"""Line dedup (operator 12): two Bloom filters find suspected repeats; only those are shuffled and confirmed.

A line's key is the line without the white space at its ends, with A-Z in lower case. A key of at least `LEAST` code
points that several documents hold stays in the one with the smallest doc_id and loses all its lines in the others.

* Filters: each build task sets its documents' distinct keys in a filter of keys seen once and, where all is set by an
  earlier document already, in one of keys seen twice. Tasks are as many as cores, so what they send (their filters, in
  blocks) doesn't grow with the documents. Merging keeps the meaning: seen twice is what either has twice or both have once.
* Probe: a line whose key isn't in the second filter is in no other document. The others are sent as (doc_id, 16-byte
  digest) and counted by partial sums, so a line that every document holds burdens no task; digests that one document
  alone has were suspected wrongly and drop out.
* Drop: digests to drop are gathered by document and meet its text.

A filter has `PER_KEY` bits a line, at most `MOST_BITS`; that bounds what is broadcast. Beyond it more lines are suspected wrongly,
up to all, which costs a shuffle of their digests and changes no result.

Defined results: a null or empty text is one empty line; rows with the same doc_id are one document; so are rows with
a null doc_id, which comes after all others; an empty table gives no rows; other columns don't matter.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _shared

LEAST = 10
PER_KEY = 16
#: Bits of a filter at most: 64 MB.
MOST_BITS = 1 << 29
#: Bytes of a block in which a filter travels.
BLOCK = 1 << 16

BLANK = b" \t\n\x0b\x0c\r"


def key_of(line: bytes, least: int = LEAST) -> bytes | None:
    """The key of a line (UTF-8), or None if it is too short to count."""
    key = line.strip(BLANK).lower()  # of bytes: A-Z alone
    if len(key) < least or len(key) < 4 * least and sum(b & 0xC0 != 0x80 for b in key) < least:
        return None
    return key


def _digest(key: bytes) -> bytes:
    return hashlib.blake2b(key, digest_size=16).digest()


def _digests(text: bytes, least: int) -> set[bytes]:
    """Digests of the distinct keys of a text."""
    keys = {key_of(line, least) for line in text.split(b"\n")}
    keys.discard(None)
    return {_digest(k) for k in keys}


def positions(digests: list[bytes], bits: int) -> np.ndarray:
    """The two different bits of each digest, for a filter of a power of two bits."""
    words = np.frombuffer(b"".join(digests), dtype="<u8").reshape(-1, 2)
    first = words[:, 0] & np.uint64(bits - 1)
    step = (words[:, 1] & np.uint64(bits - 1)) | np.uint64(1)
    return np.stack([first, (first + step) & np.uint64(bits - 1)], axis=1).astype(np.int64)


def has(bitmap: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether each bit is set."""
    return (bitmap[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1


def _set(bitmap: np.ndarray, at: np.ndarray) -> None:
    np.bitwise_or.at(bitmap, at >> 3, np.left_shift(1, at & 7).astype(np.uint8))


def add(once: np.ndarray, twice: np.ndarray, at: np.ndarray) -> None:
    """Add keys by their bits, each document's keys distinct: a bit that was set before, or that two keys set, counts twice."""
    own, count = np.unique(at.ravel(), return_counts=True)
    _set(twice, own[(count > 1) | has(once, own)])
    _set(once, own)


def merge(once: np.ndarray, twice: np.ndarray, more_once: np.ndarray, more_twice: np.ndarray) -> None:
    """Add the filters of other documents to `once` and `twice`."""
    twice |= more_twice | (once & more_once)
    once |= more_once


def _texts(batch: pa.RecordBatch) -> list[bytes]:
    return batch.column("text").to_pylist()


def _built(bits: int, least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        once, twice = np.zeros(bits // 8, dtype=np.uint8), np.zeros(bits // 8, dtype=np.uint8)
        held: list[bytes] = []
        for batch in batches:
            for text in _texts(batch):
                held.extend(_digests(text, least))
                if len(held) >= 100_000:
                    add(once, twice, positions(held, bits))
                    held = []
        if held:
            add(once, twice, positions(held, bits))
        for k in range(0, len(once), BLOCK):
            if once[k : k + BLOCK].any():
                yield pa.RecordBatch.from_arrays([pa.array([k // BLOCK], pa.int32()), pa.array([once[k : k + BLOCK].tobytes()]), pa.array([twice[k : k + BLOCK].tobytes()])], ["block", "once", "twice"])

    return run


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks in order: one row for each block that has keys seen twice."""

    def done(block: int, twice: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([twice.tobytes()])], ["block", "twice"])

    current, once, twice = None, None, None
    for batch in batches:
        for block, a, b in zip(batch.column("block").to_pylist(), batch.column("once"), batch.column("twice")):
            a, b = (np.frombuffer(x.as_buffer(), dtype=np.uint8) for x in (a, b))
            if block != current:
                if current is not None and twice.any():
                    yield done(current, twice)
                current, once, twice = block, a.copy(), b.copy()
            else:
                merge(once, twice, a, b)
    if current is not None and twice.any():
        yield done(current, twice)


def seen_twice(texts: DataFrame, bits: int, least: int = LEAST) -> bytes:
    """The filter of keys that several texts hold (with some that only seem so); at most `bits` bits reach the driver."""
    tasks = max(1, texts.sparkSession.sparkContext.defaultParallelism)
    parts = texts.coalesce(tasks).mapInArrow(_shared.frugal(_built(bits, least)), "block int, once binary, twice binary")
    blocks = parts.repartition("block").sortWithinPartitions("block").mapInArrow(_shared.frugal(_merged), "block int, twice binary")
    out = np.zeros(bits // 8, dtype=np.uint8)
    for row in blocks.collect():
        own = np.frombuffer(row["twice"], dtype=np.uint8)
        out[row["block"] * BLOCK : row["block"] * BLOCK + len(own)] = own
    return out.tobytes()


def bits_for(lines: int, most: int = MOST_BITS) -> int:
    """Bits of a filter: a power of two, at least `PER_KEY` for each line as long as `most` allows."""
    return min(most, max(8 * 64, 1 << (PER_KEY * max(lines, 1) - 1).bit_length()))


def dedup(docs: DataFrame, least: int = LEAST, most_bits: int = MOST_BITS) -> DataFrame:
    """(doc_id, text, n_lines, n_dropped) of each row: its text without repeated lines, its lines before, and those dropped."""
    spark = docs.sparkSession
    _shared.ship(spark)
    rows = _shared.take(docs, doc_id="long", text="string").withColumn("text", _shared.text_or_empty()).withColumn("mark", F.xxhash64("text")).withColumn("text", F.col("text").cast("binary"))
    lines = rows.agg(F.sum(F.octet_length("text") - F.octet_length(F.replace(F.col("text").cast("string"), F.lit("\n"), F.lit(""))) + 1).alias("n")).first()["n"] or 0
    bits = bits_for(lines, most_bits)
    filled = spark.sparkContext.broadcast(seen_twice(rows.select("text"), bits, least))

    def suspected(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        twice = np.frombuffer(filled.value, dtype=np.uint8)
        for batch in batches:
            found = [list(_digests(text, least)) for text in _texts(batch)]
            flat = [d for own in found for d in own]
            if not flat:
                continue
            keep = has(twice, positions(flat, bits)).all(axis=1)
            at = pa.array(np.repeat(np.arange(len(found)), [len(own) for own in found])[keep])
            kept = pa.array([d for d, k in zip(flat, keep) if k], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(at), batch.column("mark").take(at), kept], ["doc_id", "mark", "digest"])

    suspects = _shared.written(rows.mapInArrow(_shared.frugal(suspected), "doc_id long, mark long, digest binary"), "suspects")
    counted = suspects.groupBy("digest").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"), F.count_if(F.col("doc_id").isNull()).alias("none"), F.count("*").alias("rows"))
    repeated = _shared.written(counted.where("first < last or first is not null and none > 0").select("digest", "first", "rows"), "repeated")
    lost = _shared.left_join(suspects, repeated, "digest", "rows").where("first is not null and (doc_id is null or doc_id > first)")
    none, key = F.col("doc_id").isNull().alias("none"), F.coalesce("doc_id", F.lit(0)).alias("key")
    lost = lost.groupBy(none, key, "mark").agg(F.collect_set("digest").alias("lost"))

    def dropped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, gone, texts = [], [], []
            for text, lost in zip(_texts(batch), batch.column("lost").to_pylist()):
                if lost:
                    away, own = set(lost), text.split(b"\n")
                    kept = [x for x in own if (k := key_of(x, least)) is None or _digest(k) not in away]
                    n.append(len(own))
                    gone.append(len(own) - len(kept))
                    text = b"\n".join(kept)
                else:
                    n.append(text.count(b"\n") + 1)
                    gone.append(0)
                texts.append(text)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.binary()), pa.array(n, pa.int64()), pa.array(gone, pa.int64())], ["doc_id", "text", "n_lines", "n_dropped"])

    both = rows.select("doc_id", "text", none, key, "mark").join(lost, ["none", "key", "mark"], "left").select("doc_id", "text", "lost")
    out = both.mapInArrow(_shared.frugal(dropped), "doc_id long, text binary, n_lines long, n_dropped long")
    return out.withColumn("text", F.col("text").cast("string"))


def op12_linededup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that earlier documents hold, dropped from `documents`."""
    out = dedup(_shared.table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


SQL = r"""
WITH lines AS (
  SELECT doc_id, pos, line, translate(trim(line, E' \t\n\x0b\x0c\r'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS line_key
  FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), E'\n')) AS line, generate_subscripts(string_split(coalesce(text, ''), E'\n'), 1) AS pos FROM documents)
), repeated AS (
  SELECT line_key, min(doc_id) AS first_id FROM lines WHERE length(line_key) >= 10 GROUP BY line_key HAVING count(DISTINCT doc_id) > 1
), told AS (
  SELECT l.doc_id, l.pos, l.line, r.line_key IS NOT NULL AND l.doc_id > r.first_id AS gone FROM lines l LEFT JOIN repeated r USING (line_key)
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, E'\n' ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM told GROUP BY doc_id
"""
