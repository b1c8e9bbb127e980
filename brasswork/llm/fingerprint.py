"""Document fingerprints (operator 6): MinHash over word shingles, in vectorised numpy.

A text's words (runs of characters outside U+0020 and U+0009-000D, A-Z in lower case) give its shingles of
`SHINGLE` words; with fewer words, the whole sequence is one shingle. Each shingle is hashed to 64 bits (a polynomial
over random byte values, prefix sums for all words of a batch at once), and `PERMUTATIONS` universal hash functions
(multiply, add, take the high half) are minimised over the shingles. Likeness is the share of equal minima.

`near_duplicates` deals the sets of shingles to the buckets of their signature bands and verifies Jaccard on the sets;
`_links` says how: buckets are searched whole, bitmaps of the sets rule out mates before they make a pair, and groups of copies never expand into all pairs. A pair of 80 % likeness
shares a band with a probability of 0.998. `fingerprints` takes its result along: component_id is the smallest doc_id
reachable over links of 80 % (the document's own without any).

Documents are dealt by ranges of doc_id, with a copy of each range's successor; texts travel compressed.

Defined results: null text is an empty text; a text without words has the all-ones signature, which is like only
itself, and is linked with nothing; a null doc_id comes first; repeated doc_ids follow one another by a hash of their
text; one document alone is its own successor; an empty table gives no rows; other columns don't matter.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _links, _shared
from ._shingles import mixed, shingles

SHINGLE = 5
PERMUTATIONS = 128
#: Bands of the signature, and minima in each.
BANDS, DEEP = 16, 5
SEED = 20_240_601
NEAR = 80


def _parameters(n: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(SEED)
    return rng.integers(1, 2**63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 2**63, n, dtype=np.uint64)


def signatures(texts: list[str], width: int = SHINGLE, n: int = PERMUTATIONS) -> np.ndarray:
    """MinHash signatures, one row of `n` unsigned 32-bit minima per text."""
    hashes, starts = shingles(texts, width)
    a, b = _parameters(n)
    out = np.full((len(texts), n), 0xFFFFFFFF, dtype=np.uint32)
    counts = np.diff(starts)
    full = np.flatnonzero(counts)
    for low in range(0, len(full), 64):  # blocks keep the working set in cache and memory bounded
        rows = full[low : low + 64]
        first, last = starts[rows[0]], starts[rows[-1] + 1]
        for cut in range(first, last, 1 << 16):
            end = min(last, cut + (1 << 16))
            inside = rows[(starts[rows] < end) & (starts[rows + 1] > cut)]
            part = hashes[cut:end]
            at = np.maximum(starts[inside] - cut, 0)
            for p in range(n):
                least = np.minimum.reduceat(((part * a[p] + b[p]) >> np.uint64(32)).astype(np.uint32), at)
                out[inside, p] = np.minimum(out[inside, p], least)
    return out


def likeness(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return (x == y).mean(axis=-1)


def edited(text: str, following: str) -> str:
    """The last quarter of the code points replaced by as many of the following text's first."""
    k = len(text) // 4
    return text[: len(text) - k] + following[:k]


RESULT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, component_id long"

#: Bytes of texts in a range of documents, and ranges at most.
RANGE, RANGES = 64 << 20, 1 << 16


def _rows(held: list[tuple], following: str, width: int, n: int) -> pd.DataFrame:
    """Result rows of (doc_id, text, component_id) documents in order; `following` is the text after the last."""
    texts = [h[1] for h in held]
    changed = [edited(t, f) for t, f in zip(texts, [*texts[1:], following])]
    sig = signatures([*texts, following], width, n)
    own, new = sig[:-1], signatures(changed, width, n)
    return pd.DataFrame(
        {
            "doc_id": pd.array([h[0] for h in held], dtype="Int64"),
            "n_chars": [len(t) for t in texts],
            "edited_sha256": [hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in changed],
            "fingerprint": [s.astype(">u4").tobytes().hex() for s in own],
            "edited_fingerprint": [s.astype(">u4").tobytes().hex() for s in new],
            "near_edited": likeness(own, new),
            "near_next": likeness(own, sig[1:]),
            "component_id": pd.array([h[2] for h in held], dtype="Int64"),
        }
    )


def _range_of(bounds: list[int]) -> Column:
    """How many of the sorted bounds are below doc_id: by steps of about their number's root, then one by one."""
    if not bounds:
        return F.lit(0)
    step = max(1, int(len(bounds) ** 0.5))
    held, doc_id = F.lit(bounds).cast("array<long>"), F.col("doc_id")

    def below(some: Column) -> Column:
        return F.aggregate(some, F.lit(0), lambda n, b: n + (b < doc_id).cast("int"))

    coarse = below(F.lit(bounds[step - 1 :: step]).cast("array<long>")) * step
    return F.coalesce(coarse + below(F.slice(held, coarse + 1, F.lit(step))), F.lit(0))


def fingerprints(docs: DataFrame, parts: int | None = None, width: int = SHINGLE, n: int = PERMUTATIONS, percent: int = NEAR) -> DataFrame:
    """Fingerprint every document and its edited text, with their likeness and the likeness to the next document."""
    spark = docs.sparkSession
    _shared.ship(spark)
    near = _shared.written(near_duplicates(docs, width, n, percent).where("not doc_id <=> component_id"), "near")
    kept = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(_shared.text_or_empty()).alias("mark"), _shared.text_or_empty().alias("text"))
    # Ranges of doc_id with a leading copy of each range's successor: bounds are one number per range.
    if parts is None:
        size = kept.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        parts = min(RANGES, max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // RANGE)))
    shares = [i / parts for i in range(1, parts)]
    found = kept.agg(F.percentile_approx("doc_id", F.array(*[F.lit(s) for s in shares]) if shares else F.array(F.lit(0.5)), 20 * parts).alias("q"), F.count("*").alias("n")).first()
    if not found["n"]:
        return spark.createDataFrame([], RESULT)
    part = _range_of(sorted(set(found["q"] or [])))
    dealt = kept.withColumn("part", part)
    firsts = kept.select("doc_id").withColumn("part", part).groupBy("part").agg(F.min(F.struct(F.col("doc_id").isNotNull().alias("has"), "doc_id")).alias("m")).collect()
    order = sorted(r["part"] for r in firsts)
    to = {p: order[i - 1] for i, p in enumerate(order)}  # the range before it; the first goes to the last
    head = spark.createDataFrame([(r["m"]["doc_id"], to[r["part"]]) for r in firsts], "first_id long, part int")
    lead = kept.join(F.broadcast(head), F.col("doc_id").eqNullSafe(F.col("first_id"))).groupBy("doc_id", "part").agg(F.min(F.struct("mark", "text")).alias("m"))
    rows = dealt.select("part", F.lit(2).alias("kind"), "doc_id", "mark", "text").unionByName(lead.select("part", F.lit(3).alias("kind"), "doc_id", "m.mark", "m.text"))
    told = near.select("doc_id", "mark", "component_id").distinct().withColumn("part", part).select("part", F.lit(1).alias("kind"), "doc_id", "mark", F.lit(None).cast("binary").alias("text"), "component_id")

    def squeezed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b.assign(doc_id=b["doc_id"].astype("Int64"), text=[zlib.compress(t.encode("utf-8", "surrogatepass"), 1) for t in b["text"]])

    rows = _shared.in_pandas(rows, squeezed, "part int, kind int, doc_id long, mark long, text binary").withColumn("component_id", F.lit(None).cast("long"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[tuple] = []
        size, current, known = 0, None, {}
        for b in batches:
            for kind, doc_id, mark, text, component in zip(b["kind"], b["doc_id"], b["mark"], b["text"], b["component_id"]):
                doc_id = None if pd.isna(doc_id) else int(doc_id)
                if doc_id != current or kind == 3:
                    current, known = doc_id, {}
                if kind == 1:  # where a document of this id is linked to, before the document itself
                    known[mark] = None if pd.isna(component) else int(component)
                    continue
                text = zlib.decompress(text).decode("utf-8", "surrogatepass")
                if kind == 3 or size > 2_000_000:
                    if held:
                        yield _rows(held, text, width, n)
                    held, size = [], 0
                if kind == 2:
                    held.append((doc_id, text, known.get(mark, doc_id)))
                    size += len(text)

    in_order = rows.unionByName(told).repartition(parts, "part").sortWithinPartitions("part", F.col("kind") == 3, "doc_id", "kind", "mark")
    return _shared.in_pandas(in_order, run, RESULT)


_STEP = np.uint64(0xD1342543DE82EF95)


def bands(signature: np.ndarray, number: int = BANDS, deep: int = DEEP) -> np.ndarray:
    """A 64-bit bucket for each band of each row of `signature`."""
    out = np.empty((len(signature), number), dtype=np.uint64)
    for k in range(number):
        run = np.full(len(signature), k + 1, dtype=np.uint64)
        for i in range(k * deep, (k + 1) * deep):
            run = mixed(run * _STEP + signature[:, i].astype(np.uint64))
        out[:, k] = run
    return out.view(np.int64)


def near_duplicates(docs: DataFrame, width: int = SHINGLE, n: int = PERMUTATIONS, percent: int = NEAR) -> DataFrame:
    """doc_id, mark (xxhash64 of the text) and component_id: the smallest doc_id reachable over verified links of bucket-mates."""
    _shared.ship(docs.sparkSession)

    def sign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: set[int] = set()  # sets of this task: only their first row is dealt on
        for batch in batches:
            for part in _links.slices(batch):
                texts = part["text"].tolist()
                own = _links.sets(texts, width)
                nids = [_links.node(s) for s in own]
                first = []
                for nid, s in zip(nids, own):
                    first.append(len(s) > 0 and nid not in seen)
                    seen.add(nid)
                at = np.flatnonzero(first)
                dealt = dict(zip(at.tolist(), bands(signatures([texts[i] for i in at], width, n))))
                yield pd.DataFrame(
                    {
                        "doc_id": part["doc_id"].array,
                        "mark": part["mark"].to_numpy(),
                        "n": [len(s) for s in own],
                        "nid": nids,
                        "bands": [dealt.get(i) for i in range(len(own))],
                        "bits": [_links.bitmap(s) if f else None for s, f in zip(own, first)],
                    }
                )

    kept = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(_shared.text_or_empty()).alias("mark"), _shared.text_or_empty().alias("text"))
    before = len(_shared.made())
    signed = _shared.in_pandas(kept, sign, "doc_id long, mark long, n int, nid long, bands array<long>, bits array<long>")
    signed = _shared.written(signed.withColumn("row", F.monotonically_increasing_id()), "signed")
    nodes, full = _links.heads(signed, "bands")
    postings = full.select(F.explode("bands").alias("token"), "nid", "n", F.col("n").alias("r"))
    labels = _links.linked(kept, nodes, full, postings, width, percent, whole=True)
    rows = signed.select("doc_id", "mark", "n", "nid")
    blank = rows.where("n = 0").select("doc_id", "mark", F.col("doc_id").alias("component_id"))
    out = blank.union(_shared.left_join(rows.where("n > 0"), _links.components_of(nodes, labels), "nid", "rows").select("doc_id", "mark", "component_id"))
    done = _shared.made(before)
    out = _shared.written(out, "components")
    _shared.drop(done)
    return out


def op6_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(_shared.table(spark, sf_dir, "documents"))
