"""Packing (operator 1): cutting-stock column generation over a histogram of piece lengths.

A document's ids are cut into full pieces of `capacity` and one shorter rest. Rests are counted by length class
(`grain` ids wide, so at most capacity / grain classes whatever the input), the classes' demand is the right-hand
side of a cutting-stock linear program, a knapsack dynamic programme prices new patterns by the duals, the optimal
pattern counts are rounded down and what is left (at most one pattern per class) is packed by best fit. Patterns own
ranges of ranks within each class; pieces are ranked within their class without a shuffle of the pieces: each task
ranks its own, and small per-task counts give each task its first rank.

Defined results: null text is an empty text, which still holds its end id (one piece of length 1); a null doc_id is
kept; repeated rows are packed as often as they occur; an empty table gives no rows; other columns don't matter.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import _shared, _tokens

CAPACITY = 2048
GRAIN = 8
END_ID = 1

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, cls int, task long, rank long, ids binary"


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, grain: int = GRAIN, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """Encode each whole text, append `end_id` and cut; one row per piece with its class and its rank in task and class."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = _tokens.encoder(tokenizer)
        task = TaskContext.get().partitionId()
        seen: dict[int, int] = {}
        for batch in batches:
            rows, owners = [], []
            for doc_id, text in zip(batch["doc_id"], batch["text"]):
                ids = np.frombuffer(enc.encode(text), dtype=enc.dtype)
                ids = np.append(ids.astype("<u4"), np.array([end_id], dtype="<u4"))
                for start in range(0, len(ids), capacity):
                    own = ids[start : start + capacity].tobytes()
                    length = len(own) // 4
                    cls = -(-length // grain)
                    rank = seen.get(cls, 0)
                    seen[cls] = rank + 1
                    owners.append(doc_id)
                    rows.append((start, length, zlib.crc32(own), len(ids), cls, task, rank, own if with_ids else None))
            out = pd.DataFrame(rows, columns=[c.split()[0] for c in PIECES.split(", ")][1:])
            yield out.assign(doc_id=pd.array(owners, dtype="Int64"))

    _shared.ship(docs.sparkSession)
    kept = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _shared.text_or_empty().alias("text"))
    return _shared.in_pandas(kept, cut, PIECES)


def _best_pattern(value: np.ndarray, weights: np.ndarray, room: int) -> tuple[float, np.ndarray]:
    """Unbounded knapsack by dynamic programming: the pattern (count per class) of the largest value."""
    best = np.zeros(room + 1)
    last = np.full(room + 1, -1)
    useful = value > 1e-12
    w, v, at = weights[useful], value[useful], np.flatnonzero(useful)
    for space in range(1, room + 1):
        best[space], last[space] = best[space - 1], -1
        n = np.searchsorted(w, space, side="right")
        if n:
            worth = best[space - w[:n]] + v[:n]
            k = int(worth.argmax())
            if worth[k] > best[space] + 1e-12:
                best[space], last[space] = worth[k], at[k]
    pattern, space = np.zeros(len(weights), dtype=np.int64), room
    while space > 0:
        if last[space] < 0:
            space -= 1
        else:
            pattern[last[space]] += 1
            space -= int(weights[last[space]])
    return float(best[room]), pattern


def _first_basis(weights: np.ndarray, need: np.ndarray, room: int) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """A feasible basis, its amounts and its inverse: the fullest pattern of what is left, as often as it fits.

    Each pattern uses up one more class, which stays out of later patterns: in that order of classes the basis is
    triangular, and forward substitution inverts it.
    """
    left, basis, amount, order = need.copy(), [], [], []
    alive = np.ones(len(weights), dtype=bool)
    while alive.any():
        worth = np.where(alive, weights * (1 + 1e-3 * weights / room), 0.0)
        _, pattern = _best_pattern(worth, weights, room)
        used = pattern > 0
        times = float((left[used] / pattern[used]).min())
        out = int(np.flatnonzero(used)[(left[used] / pattern[used]).argmin()])
        left = np.maximum(left - times * pattern, 0)
        left[out] = 0
        alive[out] = False
        basis.append(pattern)
        amount.append(times)
        order.append(out)
    inverse = np.zeros((len(weights), len(weights)))
    for i, cls in enumerate(order):
        row = np.array([pattern[cls] for pattern in basis[:i]], dtype=float)
        inverse[i] = -(row[:, None] * inverse[:i]).sum(axis=0)
        inverse[i, cls] += 1
        inverse[i] /= basis[i][cls]
    return basis, np.array(amount), inverse


def solve(demand: dict[int, int], room: int, rounds: int = 3000, gap: float = 2e-4) -> list[tuple[dict[int, int], int]]:
    """Patterns ({class: count}, times) that meet `demand` exactly with few sequences of `room` classes' width.

    Revised simplex with an explicit basis inverse; columns come from the knapsack until Farley's bound is within `gap`.
    At most `room` classes: plain sums do, so no linear-algebra library (and none of its threads) runs on the driver.
    """
    weights = np.array(sorted(c for c, n in demand.items() if n > 0), dtype=np.int64)
    if not len(weights):
        return []
    need = np.array([demand[int(c)] for c in weights], dtype=float)
    basis, amount, inverse = _first_basis(weights, need, room)
    for _ in range(rounds):
        duals = inverse.sum(axis=0)
        worth, pattern = _best_pattern(np.maximum(duals, 0), weights, room)
        if worth <= 1 + 1e-9 or 1 - 1 / worth < gap:
            break
        step = (inverse * pattern).sum(axis=1)
        ratios = np.where(step > 1e-9, amount / np.where(step > 1e-9, step, 1), np.inf)
        out = int(ratios.argmin())
        if not np.isfinite(ratios[out]):
            break
        theta = ratios[out]
        amount = np.maximum(amount - theta * step, 0)
        amount[out] = theta
        row = inverse[out] / step[out]
        inverse -= np.outer(step, row)
        inverse[out] = row
        basis[out] = pattern
    left, plan = need.astype(np.int64), []
    for column, x in sorted(zip(basis, amount), key=lambda p: -p[1]):
        times = int(x + 1e-6)
        used = column > 0
        times = min(times, int((left[used] // column[used]).min()))
        if times > 0:
            left = left - times * column
            plan.append(({int(w): int(n) for w, n in zip(weights, column) if n}, times))
    return plan + [(p, 1) for p in _best_fit({int(w): int(n) for w, n in zip(weights, left) if n}, room)]


def _best_fit(left: dict[int, int], room: int) -> list[dict[int, int]]:
    """Best-fit decreasing of the few pieces that rounding down left."""
    open_by_space: dict[int, list[dict[int, int]]] = {}
    for w in sorted(left, reverse=True):
        for _ in range(left[w]):
            space = next((s for s in range(w, room + 1) if open_by_space.get(s)), None)
            held = open_by_space[space].pop() if space is not None else {}
            held[w] = held.get(w, 0) + 1
            open_by_space.setdefault((room if space is None else space) - w, []).append(held)
    return [held for group in open_by_space.values() for held in group]


def _ranges(plan: list[tuple[dict[int, int], int]]) -> dict[int, dict[str, np.ndarray]]:
    """Per class: first rank, pieces per sequence, first sequence and first slot of each range of ranks."""
    found: dict[int, list[tuple[int, int, int, int]]] = {}
    taken: dict[int, int] = {}
    sequence = 0
    for pattern, times in plan:
        slot = 0
        for cls in sorted(pattern, reverse=True):
            each = pattern[cls]
            found.setdefault(cls, []).append((taken.get(cls, 0), each, sequence, slot))
            taken[cls] = taken.get(cls, 0) + each * times
            slot += each
        sequence += times
    return {c: dict(zip(("rank", "each", "sequence", "slot"), np.array(r, dtype=np.int64).T)) for c, r in found.items()}


def assign(cut: DataFrame, capacity: int = CAPACITY, grain: int = GRAIN) -> DataFrame:
    """Pack written pieces: adds sequence_id, and offset (gapless from 0 in each sequence)."""
    if capacity % grain:
        raise ValueError("capacity must be a multiple of grain")
    per_task = cut.groupBy("task", "cls").agg(F.count("*").alias("n"))
    # Only as many rows as there are classes; the counts are over all pieces.
    demand = {r["cls"]: r["n"] for r in per_task.groupBy("cls").agg(F.sum("n").alias("n")).collect()}
    ranges = _ranges(solve(demand, capacity // grain))
    before = Window.partitionBy("cls").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    first = per_task.select("task", "cls", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            ranks = (batch["first"] + batch["rank"]).to_numpy()
            sequence, slot = np.zeros(len(batch), dtype=np.int64), np.zeros(len(batch), dtype=np.int64)
            classes = batch["cls"].to_numpy()
            for cls in np.unique(classes):
                own, at = ranges[int(cls)], np.flatnonzero(classes == cls)
                k = np.searchsorted(own["rank"], ranks[at], side="right") - 1
                into = ranks[at] - own["rank"][k]
                sequence[at] = own["sequence"][k] + into // own["each"][k]
                slot[at] = own["slot"][k] + into % own["each"][k]
            yield batch.drop(columns=["cls", "task", "rank", "first"]).assign(sequence_id=sequence, slot=slot)

    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, ids binary, sequence_id long, slot long"
    ranked = _shared.with_small(cut, first, ["task", "cls"]).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "ids", "cls", "task", "rank", "first")
    placed = _shared.in_pandas(ranked, place, schema)
    run = Window.partitionBy("sequence_id").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    return placed.withColumn("offset", F.coalesce(F.sum("length").over(run), F.lit(0)).cast("long"))


def pack(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, grain: int = GRAIN, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """Pack all documents (doc_id, text) into sequences of at most `capacity` ids; one row per piece.

    With `with_ids`, column ids holds each piece's ids (little-endian unsigned 32-bit), else null.
    """
    cut = _shared.written(pieces(docs, tokenizer or _tokens.default_path(), capacity, grain, end_id, with_ids), "pieces")
    return assign(cut, capacity, grain)


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = pack(_shared.table(spark, sf_dir, "documents"))
    return packed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
