"""Token-ID output (operator 5): Arrow files of fixed-size-list batches with random access.

Documents are dealt by ranges of doc_id, encoded, ended with `end_id` and written in ascending order. Each range
becomes one shard: `<shard>.arrow`, an Arrow IPC file whose record batches hold `input_ids` (fixed-size list of
`length` ids) and `mask` (fixed-size list of booleans, false only in the padding of a shard's last sequence), and
`<shard>.docs.arrow`, with each document's first id in the shard and its number of ids. All sequences are equally
long, so sequence k of a shard is row k % rows of batch k // rows: a memory-mapped reader touches only that row.

Tasks write under a name of their own and rename at the end; the manifest row names the attempt that counted, so a
repeated or lost attempt leaves at most an unused file. Files go through pyarrow.fs, to any store it knows by URI.

Defined results: null text is an empty text (only its end id); a null doc_id comes first; repeated doc_ids follow one
another by text; an empty table gives no shard and no rows; other columns don't matter.
"""

from __future__ import annotations

import os
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import _shared, _tokens

LENGTH = 2048
BATCH = 256
END_ID = 2


def _store(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri if "://" in uri else f"file://{os.path.abspath(uri.removeprefix('file:'))}")


class SequenceWriter:
    """Streams ids into equal-length sequences of an Arrow file; holds one batch at a time."""

    def __init__(self, sink, kind: np.dtype, length: int = LENGTH, batch: int = BATCH):
        self.length, self.most = length, length * batch
        self.ids_type = pa.list_(pa.from_numpy_dtype(kind), length)
        self.mask_type = pa.list_(pa.bool_(), length)
        self.writer = pa.ipc.new_file(sink, pa.schema([("input_ids", self.ids_type), ("mask", self.mask_type)]))
        self.buffer, self.held, self.kind, self.total = [], 0, kind, 0

    def add(self, ids: np.ndarray) -> None:
        self.buffer.append(ids)
        self.held += len(ids)
        self.total += len(ids)
        while self.held >= self.most:
            self._flush(self.most)

    def _flush(self, n: int) -> None:
        flat = np.concatenate(self.buffer)
        now, rest = flat[:n], flat[n:]
        self.buffer, self.held = [rest], len(rest)
        rows = -(-len(now) // self.length)
        mask = np.arange(rows * self.length) < len(now)
        ids = np.zeros(rows * self.length, dtype=self.kind)
        ids[: len(now)] = now
        arrays = [pa.FixedSizeListArray.from_arrays(pa.array(x), type=t) for x, t in ((ids, self.ids_type), (mask, self.mask_type))]
        self.writer.write_batch(pa.record_batch(arrays, names=["input_ids", "mask"]))

    def close(self) -> None:
        if self.held:
            self._flush(self.held)
        self.writer.close()


class SequenceReader:
    """Random access to a shard: sequences by number, or any span of its id stream, without copies where mapped."""

    def __init__(self, uri: str, length: int = LENGTH, batch: int = BATCH):
        store, path = _store(uri)
        self.source = pa.memory_map(path) if isinstance(store, fs.LocalFileSystem) else store.open_input_file(path)
        self.file, self.length, self.rows = pa.ipc.open_file(self.source), length, batch
        self.at, self.current = -1, None

    def _batch(self, k: int) -> tuple[np.ndarray, pa.Array]:
        if k != self.at:
            b = self.file.get_batch(k)
            self.current = (b.column(0).flatten().to_numpy(), b.column(1).flatten())
            self.at = k
        return self.current

    def sequence(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and mask of sequence k."""
        ids, mask = self._batch(k // self.rows)
        a = k % self.rows * self.length
        return ids[a : a + self.length], mask.slice(a, self.length).to_numpy(zero_copy_only=False)

    def span(self, start: int, n: int) -> np.ndarray:
        """Ids start .. start + n of the shard's stream."""
        parts, each = [], self.rows * self.length
        while n > 0:
            ids, _ = self._batch(start // each)
            part = ids[start % each : start % each + n]
            parts.append(part)
            start, n = start + len(part), n - len(part)
        return np.concatenate(parts) if parts else np.zeros(0, dtype="<u2")

    def close(self) -> None:
        self.source.close()


MANIFEST = "uri string, first_id long, task long, n_docs long, n_ids long"


def write_shards(docs: DataFrame, folder: str, tokenizer: str | None = None, shards: int | None = None, length: int = LENGTH, batch: int = BATCH, end_id: int = END_ID) -> DataFrame:
    """Write all documents (doc_id, text); returns the written manifest, one row per shard, with `base`: the ids in earlier shards."""
    tokenizer = tokenizer or _tokens.default_path()

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        enc, task = _tokens.encoder(tokenizer), TaskContext.get().partitionId()
        store, root = _store(folder)
        name, out, at = "", None, 0
        starts: list[tuple[int | None, int, int]] = []
        for b in batches:
            for doc_id, text in zip(b["doc_id"], b["text"]):
                if out is None:
                    store.create_dir(root, recursive=True)
                    name = f"shard-{task:06d}-{uuid.uuid4().hex}"
                    sink = store.open_output_stream(f"{root}/{name}.arrow.part")
                    out = SequenceWriter(sink, enc.dtype, length, batch)
                ids = np.append(np.frombuffer(enc.encode(text), dtype=enc.dtype), np.array([end_id], dtype=enc.dtype))
                out.add(ids)
                starts.append((None if pd.isna(doc_id) else int(doc_id), at, len(ids)))
                at += len(ids)
        if out is None:
            return
        out.close()
        sink.close()
        index = pa.table({"doc_id": pa.array([s[0] for s in starts], pa.int64()), "start": pa.array([s[1] for s in starts], pa.int64()), "n_tokens": pa.array([s[2] for s in starts], pa.int64())})
        with store.open_output_stream(f"{root}/{name}.docs.arrow.part") as f, pa.ipc.new_file(f, index.schema) as w:
            w.write_table(index, max_chunksize=50_000)
        for end in (".docs.arrow", ".arrow"):
            store.move(f"{root}/{name}{end}.part", f"{root}/{name}{end}")
        yield pd.DataFrame({"uri": [f"{folder}/{name}"], "first_id": pd.array([starts[0][0]], dtype="Int64"), "task": [task], "n_docs": [len(starts)], "n_ids": [at]})

    _shared.ship(docs.sparkSession)
    kept = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _shared.text_or_empty().alias("text"))
    dealt = kept.repartitionByRange(shards, "doc_id") if shards else kept.repartitionByRange("doc_id")
    manifest = _shared.written(_shared.in_pandas(dealt.sortWithinPartitions("doc_id", "text"), write, MANIFEST), "manifest")
    before = Window.orderBy("task").rowsBetween(Window.unboundedPreceding, -1)  # one short row per shard
    return manifest.withColumn("base", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))


def read_documents(manifest: DataFrame, length: int = LENGTH, batch: int = BATCH) -> DataFrame:
    """Read the shards back: a row per document with its place in the whole stream and the crc32 of its ids."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for uri, base in zip(b["uri"], b["base"]):
                shard = SequenceReader(f"{uri}.arrow", length, batch)
                store, path = _store(f"{uri}.docs.arrow")
                with store.open_input_file(path) as f:
                    index = pa.ipc.open_file(f)
                    for k in range(index.num_record_batches):
                        part = index.get_batch(k)
                        ids, starts, sizes = (part.column(c).to_pandas(types_mapper=lambda _: pd.Int64Dtype()) for c in ("doc_id", "start", "n_tokens"))
                        sums = [zlib.crc32(shard.span(s, n).astype("<u4").tobytes()) for s, n in zip(starts, sizes)]
                        yield pd.DataFrame({"doc_id": ids, "start": starts + int(base), "n_tokens": sizes, "ids_crc32": sums})
                shard.close()

    _shared.ship(manifest.sparkSession)
    spread = manifest.select("uri", "base").repartition(max(1, manifest.count()), "uri")  # a number: small rows stay spread
    return _shared.in_pandas(spread, read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op5_arrowfile(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = _shared.new_path(spark, "arrow")
    return read_documents(write_shards(_shared.table(spark, sf_dir, "documents"), folder))
