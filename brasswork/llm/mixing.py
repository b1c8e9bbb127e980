"""Mixing sources to target weights (operator 2): temperature mixing. DataFrame functions only.

A source's weight is its token share to the power `exponent`, normalised. The exponent is bisected (many-way: each
pass evaluates `PROBES` exponents in one aggregation, and keeps the bracket) until the entropy of the weights meets
`entropy` (a share of the largest possible), lowered where a source would repeat more than `repeats` times. The
weights are realised over a token budget, by default the least that shows every document once: each source is read
in a keyed permutation, epoch after epoch, and a document's place in its source's stream of tokens gives the block
that it falls in, so that every block holds each source by its weight, in a keyed order of its own.

Running token sums over a permutation are summed in two levels (per hash bucket, then inside it), so a source that
holds a third of all rows is spread over many tasks. Tokens are counted as runs of non-blank characters.

Defined results: null source is a source of its own (''); null or blank text counts one token, so each document is
placed; repeated rows are placed as often as they occur; one source alone gets weight 1; an empty table gives no
rows; other columns are carried along.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import _shared

ENTROPY = 0.9
REPEATS = 4.0
PROBES = 64
PASSES = 5
#: Tokens of a block of the mixed stream, and of a bucket of the running sums.
BLOCK = 1_000_000
BUCKET = 200_000


def token_count(text: Column) -> Column:
    return F.greatest(F.lit(1), F.regexp_count(F.coalesce(text, F.lit("")), F.lit("[^\\x20\\x09-\\x0D]+"))).cast("long")


def shares(tokens: DataFrame) -> DataFrame:
    """source, tokens, docs, share of (source, tokens) rows."""
    by = tokens.groupBy("source").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("docs"))
    total = by.agg(F.sum("tokens")).scalar()
    return by.withColumn("share", F.col("tokens") / total)


def _probe(by: DataFrame, low: float, high: float) -> list:
    """Relative entropy and repetitions at `PROBES` exponents between low and high, in one pass over the sources."""
    step = (high - low) / (PROBES - 1)
    at = by.select("share", F.explode(F.transform(F.sequence(F.lit(0), F.lit(PROBES - 1)), lambda i: F.lit(low) + i * F.lit(step))).alias("a"))
    x = F.pow("share", "a")
    z, zl, n = F.sum(x), F.sum(x * F.log("share")), F.count("*")
    grouped = at.groupBy("a").agg(z.alias("z"), zl.alias("zl"), n.alias("n"), F.max(F.pow("share", F.col("a") - 1)).alias("most"), F.min(F.pow("share", F.col("a") - 1)).alias("least"))
    entropy = F.log("z") - F.col("a") * F.col("zl") / F.col("z")
    return grouped.select("a", (entropy / F.greatest(F.log("n"), F.lit(1e-300))).alias("h"), (F.col("most") / F.col("least")).alias("r"), "n").orderBy("a").collect()


def exponent(by: DataFrame, entropy: float = ENTROPY, repeats: float = REPEATS) -> float:
    """The largest exponent in 0..1 whose weights have at least the target entropy, raised where repeats would exceed."""
    low, high = 0.0, 1.0
    for _ in range(PASSES):
        rows = _probe(by, low, high)
        if not rows or rows[0]["n"] < 2:
            return 1.0
        good = [r["a"] for r in rows if r["h"] >= entropy]
        if len(good) == len(rows):
            low = high
            break
        low, high = (max(good), min(r["a"] for r in rows if r["a"] > max(good))) if good else (low, rows[1]["a"])
    found = low
    low, high = found, 1.0
    for _ in range(PASSES):
        rows = _probe(by, low, high)
        fits = [r["a"] for r in rows if r["r"] <= repeats * (1 + 1e-12)]
        if len(fits) == len(rows) or low == high:
            return low
        high = min(fits) if fits else 1.0
        low = max([r["a"] for r in rows if r["a"] < high], default=low)
    return high


def weights(by: DataFrame, a: float) -> DataFrame:
    """Adds weight, and epochs: how often each document of a source is shown when the rarest-shown source is shown once."""
    z = by.agg(F.sum(F.pow("share", F.lit(a)))).scalar()
    least = by.agg(F.min(F.pow("share", F.lit(a - 1)))).scalar()
    return by.withColumn("weight", F.pow("share", F.lit(a)) / z).withColumn("epochs", F.pow("share", F.lit(a - 1)) / least)


def _draw(key: str, *parts: Column) -> Column:
    """A keyed number in 0..1."""
    return F.pmod(F.xxhash64(F.lit(key), *parts), F.lit(1 << 52)) / F.lit(float(1 << 52))


def mix(docs: DataFrame, entropy: float = ENTROPY, repeats: float = REPEATS, budget: int | None = None, block: int = BLOCK, key: str = "mix") -> DataFrame:
    """The mixed stream of (doc_id, source, text, ...) rows: adds tokens, weight, epoch, block and place.

    Ordered by (block, place) it is the stream. `budget` is in tokens; None shows each document at least once.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("source"), token_count(F.col("text").cast("string")).alias("tokens"), F.xxhash64("doc_id", "text").alias("mark"))
    thin = _shared.written(rows, "mixrows")
    by = _shared.written(shares(thin), "mixshares")
    a = exponent(by, entropy, repeats)
    w = weights(by, a)
    if budget is not None:
        w = w.withColumn("epochs", F.col("weight") * F.lit(float(budget)) / F.col("tokens"))
    # A source's stream: whole epochs and a part of one. Rows of the same id and text are told apart by a number.
    same = Window.partitionBy("doc_id", "mark").orderBy("source")
    told = thin.withColumn("copy", F.row_number().over(same))
    w = _shared.written(w.select("source", "tokens", "weight", "epochs").withColumnRenamed("tokens", "source_tokens"), "mixweights")
    # Sums per bucket of the permutation, then inside the bucket.
    seen = _shared.with_small(told, w, ["source"]).withColumn("epoch", F.explode(F.sequence(F.lit(0), F.greatest(F.ceil("epochs").cast("int") - 1, F.lit(0)))))
    draw = _draw(key, F.col("source"), F.col("epoch"), F.col("doc_id"), F.col("mark"), F.col("copy"))
    seen = seen.withColumn("draw", draw).withColumn("bucket", F.floor(F.col("draw") * F.greatest(F.lit(1), F.ceil(F.col("source_tokens") / F.lit(BUCKET)))).cast("long"))
    sums = seen.groupBy("source", "epoch", "bucket").agg(F.sum("tokens").alias("n"))
    before = Window.partitionBy("source", "epoch").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    first = sums.select("source", "epoch", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    inside = Window.partitionBy("source", "epoch", "bucket").orderBy("draw", "doc_id", "mark", "copy").rowsBetween(Window.unboundedPreceding, -1)
    placed = seen.withColumn("run", F.coalesce(F.sum("tokens").over(inside), F.lit(0)))
    placed = _shared.with_small(placed, first, ["source", "epoch", "bucket"])
    at = F.col("epoch") * F.col("source_tokens") + F.col("first") + F.col("run")
    placed = placed.withColumn("at", at).where(F.col("at") < F.col("epochs") * F.col("source_tokens") * (1 + 1e-12) - F.lit(1e-6))
    share = F.col("weight") * F.lit(float(block))
    placed = placed.select("doc_id", "mark", "copy", "source", "tokens", "weight", "epoch", F.floor(F.col("at") / share).cast("long").alias("block"), _draw(key + "-place", F.col("doc_id"), F.col("mark"), F.col("copy"), F.col("epoch")).alias("place"))
    return placed


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The documents themselves, as often as the mixture shows them, with all their columns."""
    placed = mix(docs, **options)
    of, number, id_, mark, copy, times, again = _shared.fresh(docs, "_of", "_number", "_id", "_mark", "_copy", "_times", "_again")
    counts = placed.groupBy(F.col("doc_id").alias(id_), F.col("mark").alias(mark), F.col("copy").alias(copy)).agg(F.count("*").cast("int").alias(times))
    counts = _shared.written(counts, "mixcounts")
    told = docs.withColumn(of, F.xxhash64("doc_id", "text"))
    same = F.col("doc_id").cast("long").eqNullSafe(F.col(id_)) & (F.col(of) == F.col(mark))
    if counts.where(F.col(copy) > 1).limit(1).count():
        # Copies of a row are alike but for their source, so any order of theirs will do.
        told = told.withColumn(number, F.row_number().over(Window.partitionBy("doc_id", of).orderBy(F.coalesce(F.col("source").cast("string"), F.lit("")))))
        same = same & (F.col(number) == F.col(copy))
    small = _shared.is_small(counts)
    joined = told.join(F.broadcast(counts) if small else counts, same)
    return joined.withColumn(again, F.explode(F.sequence(F.lit(1), F.col(times)))).select(*docs.columns)


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = mix(_shared.table(spark, sf_dir, "documents"))
    return placed.select("doc_id", "source", "tokens", "weight", "epoch", "block", "place")
