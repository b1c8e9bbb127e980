"""Hard-negative mining (operator 11): block matrix multiply in two dimensions, summed where a shuffle brings chunks together, top-k per window.

Vectors become integers and are dealt to blocks of rows, each cut into chunks of `WIDTH` components; the rows asked for
(anchors) are dealt likewise. A label with many rows has blocks of its own, the others share blocks by a hash. A cell is a group of
anchor blocks and a group of row blocks, brought to one task by a shuffle of their chunks: it multiplies each chunk of an anchor block
with the same chunk of a row block, adds these partial tiles exactly, and takes from the sum what may be among the best. A tile is at
most `ANCHORS` x `ROWS` numbers and never leaves its task. The first pass multiplies blocks that share labels: an anchor's best rows,
merged over cells by a window, are its positives. The second multiplies blocks of other labels and takes the best rows in
the window of each positive, which are merged likewise.

Products are taken in single or double precision where no sum can leave the integers that it holds exactly, else in 64-bit integers.
The shuffles hold vectors and best rows, not scores. The work is anchors times rows, once over both passes, as the question has it.

Defined results: rows with a null id, label or vector, or a null or non-finite component, take no part, nor do empty vectors
and those with a component so large that 100 times a score might leave 64 bits; only vectors of the same length
have scores; repeated rows are rows of their own; an anchor without positives gives no rows; an empty table gives no rows;
other columns don't matter. Rows with equal score and id follow by their place in the input.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import _shared

ANCHORS = 256
ROWS = 2048
WIDTH = 32
POSITIVES = 5
NEGATIVES = 10
#: Bytes of anchors (as 64-bit numbers) that a task holds, row blocks of a cell at most, cells for each core about.
HELD, MOST_BLOCKS, CELLS = 8 << 20, 256, 6
#: Found rows that wait until they are cut to the best.
PENDING = 1 << 15
#: Least and greatest share of a positive's score, in percent, that a hard negative has.
LOW, HIGH = 30, 90
#: Levels of a component's unit.
SCALE = 256

#: Vectors that may have the same label: of one length, and of one label with many rows or of some with few.
_GROUP = ["size", "pure", "g"]


def integers(rows: DataFrame, scale: int = SCALE) -> DataFrame:
    """(id, label, vector) rows that take part, with components floor(scale * x) as long, and a number for each row."""
    own = rows.select(F.col("id").cast("long").alias("id"), F.col("label").cast("long").alias("label"), F.col("vector").cast("array<double>").alias("vector"))
    most = F.sqrt(F.lit(float(2**63 - 1)) / (100 * F.size("vector"))) / scale - 1
    odd = F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) > most))
    kept = own.where("id is not null and label is not null and vector is not null").where((F.size("vector") > 0) & ~odd)
    return kept.select("id", "label", F.size("vector").alias("size"), F.transform("vector", lambda x: F.floor(x * scale)).alias("vector"), F.monotonically_increasing_id().alias("row"))


def _grouped(rows: DataFrame) -> DataFrame:
    """Rows with their group: labels with at least `ROWS` rows are groups of their own, the others share some by a hash."""
    counts = _shared.written(rows.groupBy("size", "label").agg(F.count("*").alias("n")), "labels")
    large = counts.where(F.col("n") >= ROWS).select("size", "label", F.lit(1).alias("pure"))
    rest = counts.where(F.col("n") < ROWS).groupBy("size").agg(F.ceil(F.sum("n") / ROWS).cast("int").alias("m"))
    told = _shared.with_small(_shared.with_small(rows, large, ["size", "label"], how="left"), rest, ["size"], how="left")
    own = F.when(F.col("pure") == 1, F.col("label")).otherwise(F.pmod(F.xxhash64("label"), F.col("m")))
    return told.withColumn("g", own).withColumn("pure", F.coalesce("pure", F.lit(0))).drop("m")


def _narrow(part: np.ndarray) -> np.ndarray:
    """The same numbers in 16, 32 or 64 bits."""
    most = int(max(part.max(initial=0), -part.min(initial=0)))
    return np.ascontiguousarray(part, dtype=next(t for t, end in ((np.int16, 2**15), (np.int32, 2**31), (np.int64, 2**64)) if most < end))


def _blocks(rows: DataFrame, most: int) -> DataFrame:
    """Rows of `_grouped` dealt to blocks of about `most` rows: written (size, pure, g, block, c, row, id, label, part), a row for each chunk.

    row, id and label are 64-bit numbers in ascending order of id, then row; part has `WIDTH` components of each.
    """
    key = [*_GROUP, "block"]
    counts = rows.groupBy(*_GROUP).agg(F.ceil(F.count("*") / most).cast("int").alias("n"))
    dealt = _shared.with_small(rows, counts, _GROUP).withColumn("block", F.pmod(F.xxhash64("row"), F.col("n")).cast("int"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, held = None, []

        def done() -> Iterator[pa.RecordBatch]:
            size = current[0]
            row, id_, label = (np.concatenate([h[k] for h in held]) for k in range(3))
            vector = np.concatenate([h[3] for h in held]).reshape(-1, size)
            for c in range(0, size, WIDTH):
                own = [pa.array([x], t) for x, t in zip((*current, c // WIDTH), (pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int32()))]
                own += [pa.array([x.tobytes()]) for x in (row, id_, label, _narrow(vector[:, c : c + WIDTH]))]
                yield pa.RecordBatch.from_arrays(own, [*key, "c", "row", "id", "label", "part"])

        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.stack([batch.column(k).to_numpy().astype(np.int64) for k in key], axis=1)
            turn = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1
            for a, b in zip([0, *turn.tolist()], [*turn.tolist(), len(keys)]):
                if (own := tuple(keys[a].tolist())) != current:
                    if held:
                        yield from done()
                    current, held = own, []
                part = batch.slice(a, b - a)
                held.append([part.column(k).to_numpy() for k in ("row", "id", "label")] + [part.column("vector").flatten().to_numpy()])
        if held:
            yield from done()

    in_order = dealt.repartition(*key).sortWithinPartitions(*key, "id", "row").select(*key, "row", "id", "label", "vector")
    out = in_order.mapInArrow(_shared.frugal(run), "size int, pure int, g long, block int, c int, row binary, id binary, label binary, part binary")
    return _shared.written(out, "blocks")


def _longs(x: pa.Scalar) -> np.ndarray:
    return np.frombuffer(x.as_buffer(), dtype=np.int64)


def _kind(most: float) -> type:
    """Numbers that hold all integers up to `most`, and their sums in any order."""
    return np.float32 if most < 2**24 else np.float64 if most < 2**53 else np.int64


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of the rows of two blocks of 64-bit integers."""
    kind = _kind(float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * a.shape[1])
    return a.astype(kind) @ b.astype(kind).T


class _Block:
    """Rows of a block, in ascending order of id, and the chunks of their vectors."""

    def __init__(self, group: tuple, number: int, row: np.ndarray, id_: np.ndarray, label: np.ndarray):
        self.group, self.number, self.row, self.id, self.label = group, number, row, id_, label
        self.parts, self.most, self.cast = [], [], {}

    def add(self, part: pa.Scalar, width: int) -> None:
        held = part.as_buffer()
        numbers = np.frombuffer(held, dtype=f"<i{held.size // (len(self.row) * width)}").reshape(-1, width)
        self.parts.append(numbers)
        self.most.append(float(max(int(numbers.max()), -int(numbers.min()))))

    def of(self, kind: type) -> list[np.ndarray]:
        if kind not in self.cast:
            self.cast[kind] = [p.astype(kind) for p in self.parts]
        return self.cast[kind]

    def tile(self, other: _Block) -> np.ndarray:
        """Scores with the rows of another block: the sum of the partial tiles of all chunks."""
        kind = _kind(sum(x * y * p.shape[1] for x, y, p in zip(self.most, other.most, self.parts)))
        mine_, others = self.of(kind), other.of(kind)
        total = mine_[0] @ others[0].T
        for x, y in zip(mine_[1:], others[1:]):
            total += x @ y.T
        return total


#: Below and above all scores, and exact in each kind of numbers.
_LOW, _HIGH = -(2**62), 2**62


def _ranked(at: np.ndarray) -> np.ndarray:
    """Places from 0 within runs of equal numbers."""
    new = np.flatnonzero(np.diff(at, prepend=-1))
    return np.arange(len(at)) - np.repeat(new, np.diff(np.append(new, len(at))))


class _Best:
    """The rows found so far for each anchor of a block, cut to those that may be among the best."""

    def __init__(self, block: _Block):
        n = len(block.row)
        self.block, self.found, self.waiting, self.begun = block, [np.zeros(0, dtype=np.int64)] * 4, 0, False
        self.least = np.full(n, _LOW)  # lower scores are out, and equal ones with a greater id than `last`
        self.last = np.full(n, 2**63 - 1)
        self.pending: list[list[np.ndarray]] = []

    def gather(self, other: _Block, tile: np.ndarray, hit: np.ndarray) -> None:
        at = np.flatnonzero(hit)
        if not len(at):
            return
        i, j = np.divmod(at, tile.shape[1])
        score = tile.reshape(-1)[at].astype(np.int64)
        ok = (other.row[j] != self.block.row[i]) & ((score > self.least[i]) | (other.id[j] <= self.last[i]))
        i, j, score = i[ok], j[ok], score[ok]
        self.pending.append([i, score, other.id[j], other.row[j]])
        self.waiting += len(i)
        if self.waiting > PENDING:
            self.cut()

    def cut(self) -> None:
        self.found = [np.concatenate(x) for x in zip(self.found, *self.pending)]
        self.pending, self.waiting = [], 0
        order = np.lexsort((self.found[3], self.found[2], -self.found[1], self.found[0]))
        self.found = [x[order] for x in self.found]
        self.choose()

    def bound(self, places: np.ndarray, most: int) -> None:
        """Raise the least score that counts, given rows in order, anchor by anchor: to that of the last place."""
        i, score, id_, _ = (x[places] for x in self.found)
        end = np.flatnonzero(_ranked(i) == most - 1)
        self.least[i[end]], self.last[i[end]] = score[end], id_[end]

    def first(self, tile: np.ndarray, most: int) -> None:
        """The least score that counts after the first tile, whose other entries are set low."""
        self.begun = True
        if tile.shape[1] >= most:
            place = tile.shape[1] - most
            np.maximum(self.least, np.partition(tile, place, axis=1)[:, place].astype(np.int64), out=self.least)


class _Positives(_Best):
    """The best rows of each anchor's own label."""

    schema = "size int, pure int, g long, block int, anchor long, anchor_id long, positive_row long, positive_id long, positive_score long"

    def __init__(self, block: _Block, own: pa.Scalar | None, positives: int):
        super().__init__(block)
        self.most = positives

    def take(self, other: _Block) -> None:
        tile = self.block.tile(other)
        same = None if other.group[1] else self.block.label[:, None] == other.label
        if not self.begun:
            self.first(tile if same is None else np.where(same, tile, tile.dtype.type(_LOW)), self.most + 1)  # the anchor may be among them
        hit = tile >= self.least.astype(tile.dtype)[:, None]
        if same is not None:
            hit &= same
        self.gather(other, tile, hit)

    def choose(self) -> None:
        keep = np.flatnonzero(_ranked(self.found[0]) < self.most)
        self.found = [x[keep] for x in self.found]
        self.bound(np.arange(len(keep)), self.most)

    def result(self) -> list[np.ndarray]:
        self.cut()
        i, score, id_, row = self.found
        return [*[np.full(len(i), x) for x in (*self.block.group, self.block.number)], self.block.row[i], self.block.id[i], row, id_, score]


class _Negatives(_Best):
    """The best rows of other labels in the window of each of an anchor's positives."""

    schema = "anchor long, anchor_id long, place int, positive_id long, positive_score long, negative_row long, negative_id long, negative_score long"

    def __init__(self, block: _Block, own: pa.Scalar | None, negatives: int, low: int, high: int):
        super().__init__(block)
        self.most = negatives
        values = own.values if own is not None and own.is_valid else None
        anchor, place, id_, score = (values.field(k).to_numpy() if values is not None else np.zeros(0, dtype=np.int64) for k in ("anchor", "place", "positive_id", "positive_score"))
        shape = len(block.row), int(place.max(initial=1))
        sorter = np.argsort(block.row)
        i = sorter[np.searchsorted(block.row, anchor, sorter=sorter)]
        self.positive, self.score = np.zeros(shape, dtype=np.int64), np.zeros(shape, dtype=np.int64)
        self.lows, self.highs = np.full(shape, _HIGH), np.full(shape, _LOW)
        within = -(-low * score // 100) <= high * score // 100  # else no score is in the window
        for k, x in ((self.positive, id_), (self.score, score), (self.lows, -(-low * score // 100)), (self.highs, high * score // 100)):
            k[i[within], place[within] - 1] = x[within]
        self.least = self.lows.min(axis=1)
        self.top = self.highs.max(axis=1)
        self.narrow = np.argmin(np.where(self.lows == _HIGH, _HIGH, self.highs), axis=1)  # the window that ends first

    def take(self, other: _Block) -> None:
        a, b = self.block.group, other.group
        if a == b and a[1]:
            return
        tile = self.block.tile(other)
        same = None if a[1] and b[1] else self.block.label[:, None] == other.label
        low = tile.dtype.type(_LOW)
        if not self.begun:
            ends = np.take_along_axis(self.highs, self.narrow[:, None], axis=1).astype(tile.dtype)
            under = tile <= ends
            if same is not None:
                under &= ~same
            self.first(np.where(under, tile, low), self.most)
        hit = tile >= self.least.astype(tile.dtype)[:, None]
        hit &= tile <= self.top.astype(tile.dtype)[:, None]
        if same is not None:
            hit &= ~same
        self.gather(other, tile, hit)

    def windows(self) -> list[np.ndarray]:
        """For each place, which of the found rows are the best of its window."""
        i, score = self.found[:2]
        out = []
        for place in range(self.lows.shape[1]):
            at = np.flatnonzero((score >= self.lows[i, place]) & (score <= self.highs[i, place]))
            out.append(at[_ranked(i[at]) < self.most])
        return out

    def choose(self) -> None:
        i, score = self.found[:2]
        self.bound(np.flatnonzero(score <= self.highs[i, self.narrow[i]]), self.most)
        keep = np.unique(np.concatenate(self.windows()))
        self.found = [x[keep] for x in self.found]

    def result(self) -> list[np.ndarray]:
        self.cut()
        out = []
        for place, at in enumerate(self.windows()):
            i, score, id_, row = (x[at] for x in self.found)
            out.append([self.block.row[i], self.block.id[i], np.full(len(i), place + 1), self.positive[i, place], self.score[i, place], row, id_, score])
        return [np.concatenate(x) for x in zip(*out)]


def _mined(kind: type[_Best], cell: list[str], *asked: int):
    """Best rows of each cell's anchors, of chunks in order: the anchors' blocks, then those of rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        columns = [x.split() for x in kind.schema.split(", ")]
        types = {"int": pa.int32(), "long": pa.int64()}
        current, anchors, block = None, [], None

        def met() -> None:
            if block is not None:
                for a in anchors:
                    a.take(block)

        def done() -> Iterator[pa.RecordBatch]:
            met()
            for a in anchors:
                found = a.result()
                if len(found[0]):
                    yield pa.RecordBatch.from_arrays([pa.array(x, types[t]) for x, (_, t) in zip(found, columns)], [n for n, _ in columns])

        for batch in batches:
            held = {k: batch.column(k).to_pylist() for k in {*cell, *_GROUP, "block", "side", "c"}}
            for k in range(batch.num_rows):
                if (own := tuple(held[x][k] for x in cell)) != current:
                    yield from done()
                    current, anchors, block = own, [], None
                if held["c"][k] == 0:
                    if held["side"][k]:
                        met()
                    new = _Block(tuple(held[x][k] for x in _GROUP), held["block"][k], *(_longs(batch.column(x)[k]) for x in ("row", "id", "label")))
                    if held["side"][k]:
                        block = new
                    else:
                        anchors.append(kind(new, batch.column("own")[k], *asked))
                size = held["size"][k]
                (block if held["side"][k] else anchors[-1].block).add(batch.column("part")[k], min(WIDTH, size - held["c"][k] * WIDTH))
        yield from done()

    return _shared.frugal(run)


_OWN = "array<struct<anchor: long, place: int, positive_id: long, positive_score: long>>"


def _cells(anchors: DataFrame, rows: DataFrame, by: list[str]) -> tuple[DataFrame, list[str]]:
    """Chunks of blocks of each cell in a row, the anchors' first; cells are pairs of groups of blocks that agree in `by`."""
    spark, cell = rows.sparkSession, [*by, "i", "j"]
    n = [x.where("c = 0").groupBy(*by).agg(F.sum(F.octet_length("row") * F.col("size")).alias("a"), F.count("*").alias("b")) for x in (anchors, rows)]
    counts = _shared.written(n[0].drop("b").join(n[1].drop("a"), by).select(*by, "b", F.ceil(F.col("a") / HELD).cast("int").alias("n_i")), "counts")
    work = counts.agg(F.sum(F.col("n_i") * F.col("b"))).first()[0] or 0
    each = min(MOST_BLOCKS, max(1, work // (CELLS * spark.sparkContext.defaultParallelism)))
    counts = counts.select(*by, "n_i", F.ceil(F.col("b") / each).cast("int").alias("n_j"))
    cells = counts.agg(F.sum(F.col("n_i") * F.col("n_j"))).first()[0] or 1

    def dealt(x: DataFrame, side: int, own: str, other: str) -> DataFrame:
        turn = F.pmod(F.xxhash64("pure", "g") % 1_000_000 + F.col("block"), F.col(f"n_{own}")).cast("int")
        told = _shared.with_small(x, counts, by).withColumn(own, turn).withColumn(other, F.explode(F.sequence(F.lit(0), F.col(f"n_{other}") - 1)))
        return told.select(*_GROUP, "i", "j", F.lit(side).alias("side"), "block", "c", "row", "id", "label", "part", "own" if side == 0 else F.lit(None).cast(_OWN).alias("own"))

    both = dealt(anchors, 0, "i", "j").union(dealt(rows, 1, "j", "i"))
    order = [*cell, "side", *_GROUP, "block", "c"]
    return both.repartition(min(cells, 20_000), *cell).sortWithinPartitions(*dict.fromkeys(order)), cell


def mine(rows: DataFrame, asked: Column, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH) -> DataFrame:
    """Hard negatives of the (id, label, vector) rows for which `asked` holds: a row for each anchor, positive and rank."""
    _shared.ship(rows.sparkSession)
    held = _grouped(_shared.written(integers(rows), "integers"))
    anchors, others = _blocks(held.where(asked), ANCHORS), _blocks(held, ROWS)
    cells, cell = _cells(anchors.withColumn("own", F.lit(None).cast(_OWN)), others, _GROUP)
    near = Window.partitionBy("anchor").orderBy(F.desc("positive_score"), "positive_id", "positive_row")
    first = cells.mapInArrow(_mined(_Positives, cell, positives), _Positives.schema).withColumn("place", F.row_number().over(near)).where(F.col("place") <= positives)
    own = first.groupBy(*_GROUP, "block").agg(F.collect_list(F.struct("anchor", "place", "positive_id", "positive_score")).alias("own"))
    own = _shared.written(own, "positives")  # of a block: ANCHORS x positives
    told = _shared.with_small(anchors, own, [*_GROUP, "block"])
    cells, cell = _cells(told, others, ["size"])
    found = cells.mapInArrow(_mined(_Negatives, cell, negatives, low, high), _Negatives.schema)
    hard = Window.partitionBy("anchor", "place").orderBy(F.desc("negative_score"), "negative_id", "negative_row")
    out = found.withColumn("rank", F.row_number().over(hard)).where(F.col("rank") <= negatives)
    return out.select("anchor_id", F.col("place").alias("positive_rank"), "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def op11_hardnegatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every hundredth row of `embeddings`, with some labels moved on."""
    rows = _shared.table(spark, sf_dir, "embeddings")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(rows.select(F.col("vec_id").alias("id"), moved.alias("label"), F.col("embedding").alias("vector")), F.col("id") % 100 == 0)


SQL = r"""
WITH held AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scores AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same, list_sum(list_transform(list_zip(a.v, b.v), lambda p: p[1] * p[2]))::BIGINT AS score
  FROM held a JOIN held b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
), positives AS (
  SELECT anchor_id, other_id AS positive_id, score AS positive_score, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) AS positive_rank
  FROM scores WHERE same QUALIFY positive_rank <= 5
)
SELECT anchor_id, positive_id, (row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other_id))::INTEGER AS rank, other_id AS negative_id,
       positive_score, score AS negative_score, positive_rank::INTEGER AS positive_rank
FROM positives JOIN scores USING (anchor_id)
WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
QUALIFY rank <= 10
"""
