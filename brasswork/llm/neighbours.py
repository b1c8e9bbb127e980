"""Approximate nearest neighbours (operator 10): sharded, robust-pruned directed graphs with beam search.

Vectors are dealt to shards of about `SHARD` rows by a hash of their id, so equal vectors spread over all shards.
Vectors of different lengths have no distance: each length has shards of its own, and a query searches those of its own.
Each shard builds one graph over its distinct vectors: batches of vectors search the graph so far greedily from the
medoid, the visited nodes are pruned by relaxed distance (a neighbour stays only if no kept one is `ALPHA` times
nearer to it than the vector is), and reverse edges are pruned likewise. A second pass repeats that on the full graph.
Queries run a beam search in every shard; the shards' nearest are merged, with distances taken in double precision
from the original vectors. A node answers with all ids of its vector, so copies cost no recall.

The graph of a shard is one row of a written table: a lost executor rebuilds or rereads single shards. Queries reach
the shards as rows beside them, never as a broadcast.

Defined results: vectors that are null, zero, or hold null or non-finite components take no part, nor do null ids; a
vector alone of its length finds nothing; rows with the same id and vector count once; ties go to the smaller id; an empty table gives
no rows; other columns don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import _shared

SHARD = 8192
DEGREE = 32
BEAM = 64
#: Beam of queries; wider than the beam of building.
WIDE = 160
ALPHA = 1.2
BATCH = 256


def _distances(x: np.ndarray, points: np.ndarray, norms: np.ndarray, nodes: np.ndarray) -> np.ndarray:
    """Squared distances (float32) of each row of x to its row of nodes; -1 marks no node and gives infinity."""
    near = points[nodes]
    d = norms[nodes] - 2 * np.einsum("bd,bkd->bk", x, near) + np.einsum("bd,bd->b", x, x)[:, None]
    return np.where(nodes < 0, np.inf, np.maximum(d, 0)).astype(np.float32)


def beam_search(x: np.ndarray, points: np.ndarray, edges: np.ndarray, entry: int, beam: int, collect: bool = False) -> tuple[np.ndarray, np.ndarray, list]:
    """Beam search for many queries at once. Returns nodes and distances, nearest first, and the nodes expanded."""
    n, count = len(x), len(points)
    norms = np.einsum("nd,nd->n", points, points)
    nodes = np.full((n, beam), -1, dtype=np.int64)
    dist = np.full((n, beam), np.inf, dtype=np.float32)
    open_ = np.zeros((n, beam), dtype=bool)
    nodes[:, 0] = entry
    dist[:, 0] = _distances(x, points, norms, nodes[:, :1])[:, 0]
    open_[:, 0] = True
    seen = np.zeros((n, count + 1), dtype=bool)
    seen[:, entry] = seen[:, count] = True  # the last column stands for "no node"
    expanded = []
    alive = np.arange(n)
    while len(alive):
        first = open_[alive].argmax(axis=1)
        going = open_[alive, first]
        alive, first = alive[going], first[going]
        if not len(alive):
            break
        at = nodes[alive, first]
        open_[alive, first] = False
        if collect:
            expanded.append((alive, at, dist[alive, first]))
        near = edges[at]
        near = np.where(near < 0, count, near)
        fresh = ~seen[alive[:, None], near]
        seen[alive[:, None], near] = True
        near = np.where(fresh, near, -1)
        d = _distances(x[alive], points, norms, near)
        all_nodes = np.concatenate([nodes[alive], near], axis=1)
        all_dist = np.concatenate([dist[alive], d], axis=1)
        all_open = np.concatenate([open_[alive], fresh], axis=1)
        best = np.argsort(all_dist, axis=1, kind="stable")[:, :beam]
        nodes[alive] = np.take_along_axis(all_nodes, best, 1)
        dist[alive] = np.take_along_axis(all_dist, best, 1)
        open_[alive] = np.take_along_axis(all_open, best, 1)
    return nodes, dist, expanded


def _prune(owner: np.ndarray, candidates: np.ndarray, dist: np.ndarray, points: np.ndarray, degree: int, alpha: float) -> np.ndarray:
    """Robust pruning for a block of nodes: candidate rows (-1: none) with their distances to the owner."""
    order = np.argsort(dist, axis=1, kind="stable")
    candidates, dist = np.take_along_axis(candidates, order, 1), np.take_along_axis(dist, order, 1)
    alive = (candidates >= 0) & np.isfinite(dist) & (candidates != owner[:, None])
    vectors = points[candidates]
    norms = np.einsum("bkd,bkd->bk", vectors, vectors)
    between = norms[:, :, None] + norms[:, None, :] - 2 * vectors @ vectors.transpose(0, 2, 1)
    rows, out = np.arange(len(owner)), np.full((len(owner), degree), -1, dtype=np.int64)
    for slot in range(degree):
        first = alive.argmax(axis=1)
        left = alive[rows, first]
        if not left.any():
            break
        out[left, slot] = candidates[rows[left], first[left]]
        alive &= ~(alpha * alpha * between[rows, first] <= dist)
        alive[rows, first] = False
    return out


def build_graph(points: np.ndarray, degree: int = DEGREE, beam: int = BEAM, alpha: float = ALPHA, batch: int = BATCH, seed: int = 7) -> tuple[np.ndarray, int]:
    """Directed graph over distinct points (float32): edges (-1: none) and the entry node (the medoid)."""
    n = len(points)
    edges = np.full((n, degree), -1, dtype=np.int64)
    entry = int(((points - points.mean(axis=0)) ** 2).sum(axis=1).argmin())
    order = np.random.default_rng(seed).permutation(n)
    order = np.concatenate([[entry], order[order != entry]])
    # Batches double until `batch`, so that early nodes see one another; the second pass refines all of them.
    for last in (False, True):
        low = 0 if last else 1
        while low < n:
            size = batch if last else max(1, min(batch, low))
            own = order[low : low + size]
            _, _, expanded = beam_search(points[own], points, edges, entry, beam, collect=True)
            width = len(expanded)
            candidates = np.full((len(own), width + degree), -1, dtype=np.int64)
            dist = np.full((len(own), width + degree), np.inf, dtype=np.float32)
            for k, (rows, nodes, d) in enumerate(expanded):
                candidates[rows, k], dist[rows, k] = nodes, d
            old = edges[own]
            norms = np.einsum("nd,nd->n", points, points)
            known = (old[:, :, None] == candidates[:, None, :width]).any(axis=2)
            candidates[:, width:] = np.where(known, -1, old)
            dist[:, width:] = _distances(points[own], points, norms, candidates[:, width:])
            if candidates.shape[1] > 3 * beam:
                best = np.argsort(dist, axis=1)[:, : 3 * beam]
                candidates, dist = np.take_along_axis(candidates, best, 1), np.take_along_axis(dist, best, 1)
            edges[own] = _prune(own, candidates, dist, points, degree, alpha)
            _reverse(own, edges, points, degree, alpha)
            low += size
    return edges, entry


def _reverse(own: np.ndarray, edges: np.ndarray, points: np.ndarray, degree: int, alpha: float) -> None:
    """Add the edges back from new neighbours; lists that overflow are pruned again."""
    source = np.repeat(own, degree)
    target = edges[own].ravel()
    source, target = source[target >= 0], target[target >= 0]
    order = np.argsort(target, kind="stable")
    source, target = source[order], target[order]
    nodes, starts, counts = np.unique(target, return_index=True, return_counts=True)
    most = int(counts.max()) if len(counts) else 0
    if not most:
        return
    added = np.full((len(nodes), most), -1, dtype=np.int64)
    added[np.repeat(np.arange(len(nodes)), counts), np.arange(len(target)) - np.repeat(starts, counts)] = source
    added[(added[:, :, None] == edges[nodes][:, None, :]).any(axis=2)] = -1
    both = np.concatenate([edges[nodes], added], axis=1)
    over = (both >= 0).sum(axis=1) > degree
    fits = np.flatnonzero(~over)
    packed = np.take_along_axis(both[fits], np.argsort(both[fits] < 0, axis=1, kind="stable"), 1)
    edges[nodes[fits]] = packed[:, :degree]
    norms = np.einsum("nd,nd->n", points, points)
    for at in np.array_split(np.flatnonzero(over), max(1, int(over.sum()) // 128)):
        if len(at):
            d = _distances(points[nodes[at]], points, norms, both[at])
            edges[nodes[at]] = _prune(nodes[at], both[at], d, points, degree, alpha)


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, vector array<double>) of the rows that take part."""
    v = F.col("embedding").cast("array<double>")
    kept = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("vector")).where("vec_id is not null and vector is not null")
    return kept.where(F.forall("vector", lambda c: F.coalesce(F.abs(c) < F.lit(float("inf")), F.lit(False)) & ~F.coalesce(F.isnan(c), F.lit(True))) & F.exists("vector", lambda c: c != 0))


INDEX = "shard int, dims int, entry int, nodes int, edges binary, vectors binary, ids binary, first binary"


def build_index(vectors: DataFrame, shard: int = SHARD, degree: int = DEGREE, beam: int = BEAM, alpha: float = ALPHA) -> DataFrame:
    """One row per shard over all usable vectors: its graph, distinct vectors and their ids; written, so built once."""
    rows = usable(vectors).withColumn("dims", F.size("vector"))
    sizes = rows.groupBy("dims").agg(F.count("*").alias("n")).orderBy("dims").collect()  # a row a length
    first, shards = F.lit(0), 0
    many = F.lit(1)
    for r in sizes:
        number = -(-r["n"] // shard)
        first, many = F.when(F.col("dims") == r["dims"], F.lit(shards)).otherwise(first), F.when(F.col("dims") == r["dims"], F.lit(number)).otherwise(many)
        shards += number

    def build(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("vec_id", kind="stable")
        own = np.array(part["vector"].tolist(), dtype=np.float64) + 0.0  # -0.0 is 0.0
        distinct, which = np.unique(own, axis=0, return_inverse=True)
        pairs = np.unique(np.stack([which.ravel(), part["vec_id"].to_numpy()], axis=1), axis=0)
        first = np.searchsorted(pairs[:, 0], np.arange(len(distinct) + 1))
        points = distinct.astype(np.float32)
        edges, entry = build_graph(points, degree, beam, alpha)
        return pd.DataFrame({"shard": [key[0]], "dims": [own.shape[1]], "entry": [entry], "nodes": [len(distinct)], "edges": [edges.astype("<i4").tobytes()], "vectors": [distinct.tobytes()], "ids": [pairs[:, 1].astype("<i8").tobytes()], "first": [first.astype("<i8").tobytes()]})

    _shared.ship(vectors.sparkSession)
    dealt = rows.withColumn("shard", (first + F.pmod(F.xxhash64("vec_id"), many)).cast("int")).drop("dims")
    dealt = dealt.repartition(max(1, shards), "shard")  # a number: graphs of small shards take long, too, and stay spread
    return _shared.written(dealt.groupBy("shard").applyInPandas(build, INDEX), "annindex")


FOUND = "query_id long, vec_id long, score double"


def search(index: DataFrame, queries: DataFrame, k: int = 10, beam: int = WIDE, degree: int = DEGREE) -> DataFrame:
    """The k nearest found of each query (vec_id, vector): query_id, rank, vec_id, score. A query never finds its own id."""
    names = [c.split()[0] for c in INDEX.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        graph: dict = {}
        for b in batches:
            for at in range(0, len(b), 512):
                part = b.iloc[at : at + 512]
                for shard, group in part.groupby("shard", sort=True):
                    heads = group[group["kind"] == 0]
                    if len(heads):
                        graph = _opened(heads.iloc[0], degree)
                    asked = group[group["kind"] == 1]
                    if len(asked):
                        assert graph["shard"] == shard
                        yield _answers(graph, asked, k, beam)

    _shared.ship(index.sparkSession)
    heads = index.select(F.lit(0).alias("kind"), F.lit(None).cast("long").alias("query_id"), F.lit(None).cast("array<double>").alias("vector"), *names)
    # Each shard gets every query of its length: the work that the method asks for. One row a query and shard, in blocks of 512.
    places, shards = index.select("shard", "dims"), index.count()
    asked = _shared.with_small(queries.select(F.lit(1).alias("kind"), F.col("vec_id").alias("query_id"), "vector", F.size("vector").alias("dims")), places, ["dims"])
    for name, kind in (c.split() for c in INDEX.split(", ")[2:]):
        asked = asked.withColumn(name, F.lit(None).cast(kind))
    both = heads.unionByName(asked).repartition(max(1, shards), "shard").sortWithinPartitions("shard", "kind", "query_id")
    found = both.select("kind", "query_id", "vector", *names).mapInPandas(run, FOUND)
    best = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _opened(row: pd.Series, degree: int) -> dict:
    n = int(row["nodes"])
    vectors = np.frombuffer(row["vectors"], dtype=np.float64).reshape(n, -1)
    return {"shard": int(row["shard"]), "entry": int(row["entry"]), "vectors": vectors, "points": vectors.astype(np.float32), "edges": np.frombuffer(row["edges"], dtype="<i4").reshape(n, degree).astype(np.int64), "ids": np.frombuffer(row["ids"], dtype="<i8"), "first": np.frombuffer(row["first"], dtype="<i8")}


def _answers(graph: dict, asked: pd.DataFrame, k: int, beam: int) -> pd.DataFrame:
    own = np.array(asked["vector"].tolist(), dtype=np.float64)
    nodes, _, _ = beam_search(own.astype(np.float32), graph["points"], graph["edges"], graph["entry"], beam)
    rows = []
    for query, x, near in zip(asked["query_id"].astype("int64"), own, nodes):
        near = near[near >= 0]
        score = np.sqrt(((graph["vectors"][near] - x) ** 2).sum(axis=1))
        got: list[tuple[float, int]] = []
        for s, node in sorted(zip(score.tolist(), near.tolist())):
            if len(got) > k and s > got[k][0]:
                break
            ids = graph["ids"][graph["first"][node] : graph["first"][node + 1]]
            got += [(s, int(i)) for i in ids[: k + 1] if i != query]  # in ascending order; more than k never matter
        rows += [(int(query), i, s) for s, i in sorted(got)[:k]]
    return pd.DataFrame(rows, columns=["query_id", "vec_id", "score"])


def op10_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _shared.table(spark, sf_dir, "embeddings")
    index = build_index(vectors)
    asked = usable(vectors).where("vec_id % 100 = 0").dropDuplicates(["vec_id"])
    found = search(index, asked)
    return found.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
