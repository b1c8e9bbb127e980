"""Links between sets of shingles that share a bucket: candidates, exact verification, components.

Used by operators that deal postings (bucket, set) in different ways. See `jaccardjoin` for what is done in a bucket.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import _components, _shared
from ._shingles import mixed, shingles

#: Least bits of a set's bitmap.
BITS = 1024
#: Sets of a bucket that the others may name; sets from which on a bucket carries bitmaps, and is split.
PIVOTS = 3
HOT = 512
BLOCK = 4096
_LEAST = -(2**63)


def sets(texts: list[str], width: int) -> list[np.ndarray]:
    hashes, starts = shingles(texts, width)
    return [np.unique(hashes[a:b]) for a, b in zip(starts[:-1], starts[1:])]


def node(s: np.ndarray) -> int:
    """A set's number: 64 bits of a cryptographic hash of its sorted tokens."""
    return int.from_bytes(hashlib.blake2b(s.tobytes(), digest_size=8).digest(), "little", signed=True)


def slices(batch: pd.DataFrame, most: int = 1_000_000) -> Iterator[pd.DataFrame]:
    """Parts of a batch with so many characters at most, or one row."""
    at = (batch["text"].str.len().cumsum() // most).to_numpy()
    for _, part in batch.groupby(at, sort=False):
        yield part


def bitmap(s: np.ndarray) -> np.ndarray:
    """Each token turns one bit over: 64-bit words as signed numbers."""
    size = max(BITS, 1 << (len(s) - 1).bit_length())
    at = ((mixed(s) >> np.uint64(20)) % np.uint64(size)).astype(np.int64)
    odd = (np.bincount(at, minlength=size) & 1).astype(np.uint8)
    return np.packbits(odd, bitorder="little").view("<i8")


def _apart(one: Column, two: Column) -> Column:
    """Bits by which two bitmaps differ, the longer one folded once; 0 (no bound) if that doesn't make them alike in length."""

    def folded(b: Column, other: Column) -> Column:
        half = (F.size(b) / 2).cast("int")
        return F.when(F.size(b) > F.size(other), F.zip_with(F.slice(b, F.lit(1), half), F.slice(b, half + 1, half), lambda x, y: x.bitwiseXOR(y))).otherwise(b)

    x, y = folded(one, two), folded(two, one)
    return F.when(F.size(x) == F.size(y), F.aggregate(F.zip_with(x, y, lambda a, b: F.bit_count(a.bitwiseXOR(b))), F.lit(0), lambda a, b: a + b)).otherwise(F.lit(0))


def _need(percent: int, n, m):
    """The smallest overlap of sets with n and m tokens that are alike enough."""
    return -(-percent * (n + m) // (100 + percent))


def _starred(percent: int):
    """Postings sorted by token and set: those of tokens with several sets, with the pivot that each set names (or null).

    A token with more than `HOT` sets also gets a row without a set, whose `n` is their number.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: pd.DataFrame | None = None  # the first rows of the last token so far
        before = 0  # how many of its rows came earlier

        def hot(token: int, size: int) -> Iterator[pd.DataFrame]:
            if size > HOT:
                yield pd.DataFrame({"token": [token], "nid": pd.array([None], dtype="Int64"), "n": [size], "r": [0], "star": pd.array([None], dtype="Int64")})

        for b in batches:
            h = 0 if held is None else len(held)
            b = b if held is None else pd.concat([held, b], ignore_index=True)
            token, nid, n, r = (b[c].to_numpy() for c in ("token", "nid", "n", "r"))
            if not len(token):
                continue
            new = np.concatenate([[True], token[1:] != token[:-1]])
            starts = np.flatnonzero(new)
            first = starts[np.cumsum(new) - 1]
            size = np.diff(np.append(starts, len(b)))
            inside = np.arange(len(b)) - first
            star, found = np.zeros(len(b), dtype=np.int64), np.zeros(len(b), dtype=bool)
            for k in range(PIVOTS):
                at = np.minimum(first + k, len(b) - 1)
                fits = ~found & (inside > k) & (np.minimum(r, r[at]) >= _need(percent, n.astype(np.int64), n[at]))
                star[fits], found = nid[at[fits]], found | fits
            keep = np.repeat(size > 1, size)
            if before > 1:
                keep[:h] = False
            out = b[keep]
            if len(out):
                yield out.assign(star=pd.Series(star[keep], index=out.index, dtype="Int64").where(found[keep]))
            whole = size.copy()
            whole[0] += before - h
            for g in np.flatnonzero(whole[:-1] > HOT):
                yield from hot(int(token[starts[g]]), int(whole[g]))
            before = int(whole[-1])
            held = b.iloc[starts[-1] : starts[-1] + PIVOTS]
        if held is not None:
            yield from hot(int(held["token"].iloc[0]), before)

    return run


def _bits_apart(bits: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Bits by which the bitmaps of rows i and j differ: as `_apart`, of many pairs."""
    out = np.zeros(len(i), dtype=np.int64)
    length = np.zeros(len(bits), dtype=np.int64)
    used = np.unique(np.concatenate([i, j]))
    length[used] = [len(bits[k]) for k in used]
    least, most = np.minimum(length[i], length[j]), np.maximum(length[i], length[j])
    for words in np.unique(least):
        at = np.flatnonzero((least == words) & (most <= 2 * words))
        if not len(at):
            continue
        rows = np.unique(np.concatenate([i[at], j[at]]))
        held = np.stack([np.bitwise_xor.reduce(np.asarray(bits[k]).view(np.uint64).reshape(-1, words), axis=0) for k in rows])
        x, y = np.searchsorted(rows, i[at]), np.searchsorted(rows, j[at])
        step = max(1, 800_000 // int(words))
        for k in range(0, len(at), step):
            out[at[k : k + step]] = np.bitwise_count(held[x[k : k + step]] ^ held[y[k : k + step]]).sum(axis=1, dtype=np.int64)
    return out


def _crossed(percent: int, nearest: bool = False, whole: bool = False):
    """Pairs within a bucket (or a pair of its blocks) whose components differ and that size, position and bitmaps let through.

    With `nearest`, each set names one of its later mates at most: where there are bitmaps, that with the fewest bits apart.
    With `whole`, all rows have bitmaps, which are compared at their full lengths; else those of hot buckets are, folded.
    """
    names, key = ("token", "low", "high", "block", "nid", "n", "r", "label", "bits"), ("token", "low", "high")

    def fits(c: dict[str, np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
        n, m = c["n"][i], c["n"][j]
        return (c["label"][i] != c["label"][j]) & (np.minimum(c["r"][i], c["r"][j]) >= _need(percent, n, m))

    def named(c: dict[str, np.ndarray], i: np.ndarray, j: np.ndarray) -> Iterator[pd.DataFrame]:
        a, b = c["nid"][i], c["nid"][j]
        if len(a):
            yield pd.DataFrame({"x": np.minimum(a, b), "y": np.maximum(a, b)})

    def large(c: dict[str, np.ndarray]) -> Iterator[pd.DataFrame]:
        low, high = c["low"][0], c["high"][0]
        one, two = np.flatnonzero(c["block"] == low), np.flatnonzero(c["block"] == high)
        bits = None
        if c["bits"][0] is not None and not whole:
            bits = np.stack([np.bitwise_xor.reduce(np.asarray(w).view(np.uint64).reshape(-1, BITS // 64), axis=0) for w in c["bits"]])
        for start in range(0, len(one), 256):
            x = one[start : start + 256]
            i, j = np.repeat(x, len(two)), np.tile(two, len(x))
            ok = fits(c, i, j) & ((i < j) if low == high else True)
            i, j = i[ok], j[ok]
            if (whole or bits is not None) and len(i):
                n, m = c["n"][i], c["n"][j]
                far = _bits_apart(c["bits"], i, j) if whole else np.concatenate([np.bitwise_count(bits[i[k : k + 50_000]] ^ bits[j[k : k + 50_000]]).sum(axis=1, dtype=np.int64) for k in range(0, len(i), 50_000)])
                ok = far <= n + m - 2 * _need(percent, n, m)
                i, j, share = i[ok], j[ok], (far / (n + m))[ok]
            else:
                share = np.zeros(len(i))
            if nearest:
                order = np.lexsort((share, i))
                i, j = i[order], j[order]
                first = np.diff(i, prepend=-1) != 0
                i, j = i[first], j[first]
            yield from named(c, i, j)

    def groups(c: dict[str, np.ndarray], starts: np.ndarray, end: int) -> Iterator[pd.DataFrame]:
        """Whole groups from row starts[0] to `end`: the small ones of all groups at once."""
        if not len(starts):
            return
        size = np.diff(np.append(starts, end))
        mixed_ = np.minimum.reduceat(c["label"][:end], starts) != np.maximum.reduceat(c["label"][:end], starts)
        for g in np.flatnonzero(mixed_ & (size > 32)):
            yield from large({k: v[starts[g] : starts[g] + size[g]] for k, v in c.items()})
        own = mixed_ & (size <= 32) & (c["low"][starts] == c["high"][starts])
        number = np.repeat(np.where(own, np.arange(len(starts)), -1), size)
        free = number >= 0  # rows that may still name a mate
        for d in range(1, int(size[own].max(initial=0))):
            i = np.flatnonzero(free[:-d] & (number[:-d] == number[d:]))
            i = i[fits(c, i, i + d)]
            if whole and len(i):
                n, m = c["n"][i], c["n"][i + d]
                i = i[_bits_apart(c["bits"], i, i + d) <= n + m - 2 * _need(percent, n, m)]
            if nearest:
                free[i] = False
            yield from named(c, i, i + d)
        for g in np.flatnonzero(mixed_ & (size <= 32) & ~own):
            if c["low"][starts[g]] != c["high"][starts[g]]:
                yield from large({k: v[starts[g] : starts[g] + size[g]] for k, v in c.items()})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[str, np.ndarray] | None = None  # the last group so far, at most two blocks
        for b in batches:
            if not len(b):
                continue
            c = {k: b[k].to_numpy() for k in names}
            c["n"], c["r"] = c["n"].astype(np.int64), c["r"].astype(np.int64)
            if held is not None:
                c = {k: np.concatenate([held[k], c[k]]) for k in names}
            turn = np.any([c[k][1:] != c[k][:-1] for k in key], axis=0)
            starts = np.concatenate([[0], np.flatnonzero(turn) + 1])
            yield from groups(c, starts[:-1], int(starts[-1]))
            held = {k: v[starts[-1] :] for k, v in c.items()}
        if held is not None:
            yield from groups(held, np.array([0]), len(held["token"]))

    return run


def _texts(keyed: DataFrame, least: DataFrame) -> DataFrame:
    """Texts of the documents whose ids are in `least`; by a broadcast of ids where few, else by a shuffle."""
    wanted = least.select(F.coalesce("least", F.lit(_LEAST)).alias("wanted")).distinct()
    return _shared.with_small(keyed, wanted, ["wanted"], how="left_semi").select("text")


def heads(signed: DataFrame, dealt: str) -> tuple[DataFrame, DataFrame]:
    """Sets (nid, least doc_id, rows, ...) and one row of each set, of rows (row, doc_id, nid, n, ...).

    Only a set's first row in each task has the column `dealt`; of those that several tasks left, one stays.
    """
    nodes = signed.where("n > 0").groupBy("nid").agg(F.min("doc_id").alias("least"), F.count("*").alias("rows"), F.min(F.when(F.col(dealt).isNotNull(), F.col("row"))).alias("head"), F.count(dealt).alias("heads"))
    nodes = _shared.written(nodes, "nodes")
    first = signed.where(F.col(dealt).isNotNull())
    again = first.select("nid", "row").join(nodes.where("heads > 1").select("nid", "head"), "nid").where("row <> head").select("row")
    return nodes, _shared.with_small(first, _shared.written(again, "again"), ["row"], how="left_anti")


def linked(kept: DataFrame, nodes: DataFrame, full: DataFrame, postings: DataFrame, width: int, percent: int, orders: tuple[str, ...] = (), whole: bool = False) -> DataFrame:
    """(node, label) of the sets that are linked with others: label is the least set of a component.

    `kept` has the documents (doc_id, text), `nodes` and `full` come from `heads`; `full` has nid, n, bits and prefixes
    under the named `orders`; `postings` are (token, nid, n, r) rows. With `whole`, the bitmaps of all sets go to their buckets
    and bound pairs there: for buckets that hold many sets that aren't alike enough.
    """
    in_order = postings.repartition("token").sortWithinPartitions("token", "nid")
    shared = _shared.written(in_order.mapInPandas(_shared.frugal(_starred(percent)), "token long, nid long, n int, r int, star long"), "shared")
    keyed = kept.withColumn("wanted", F.coalesce("doc_id", F.lit(_LEAST)))

    def sets_of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for part in slices(batch):
                own = [s for s in sets(part["text"].tolist(), width) if len(s)]
                yield pd.DataFrame({"nid": [node(s) for s in own], "tokens": [s.view(np.int64) for s in own]})

    def with_both(pairs: DataFrame, *names: str) -> DataFrame:
        """Pairs (x, y, ...) with the named columns of both sets, those of y with an ending."""
        ends = _shared.written(pairs.select(F.col("x").alias("nid")).union(pairs.select("y")).distinct(), "ends")
        own = _shared.written(_shared.with_small(full.select("nid", *names), ends, ["nid"], how="left_semi"), "own")
        return pairs.join(own.withColumnRenamed("nid", "x"), "x").join(own.select(F.col("nid").alias("y"), *[F.col(c).alias(f"{c}_y") for c in names]), "y")

    def near(pairs: DataFrame) -> DataFrame:
        """Pairs (x, y) that the bitmaps don't rule out, with the share of bits by which they differ."""
        both = with_both(pairs, "n", "bits").withColumn("bits_apart", _apart(F.col("bits"), F.col("bits_y")))
        total = F.col("n") + F.col("n_y")
        fits = F.col("bits_apart") <= total - 2 * F.ceil(F.lit(percent) * total / F.lit(100 + percent))
        return _shared.written(both.where(fits).select("x", "y", (F.col("bits_apart") / total).alias("apart")), "near")

    def verified(pairs: DataFrame) -> DataFrame:
        """Written pairs (x, y) that share prefix tokens under the other orders too and whose sets are alike enough."""
        alive = pairs.select("x", "y")
        if orders:
            both = with_both(alive, *orders)
            for c in orders:
                both = both.where(F.arrays_overlap(c, f"{c}_y"))
            alive = _shared.written(both.select("x", "y"), "alive")
        ends = _shared.written(alive.select(F.col("x").alias("nid")).union(alive.select("y")).distinct().join(nodes.select("nid", "least"), "nid"), "ends")
        held = _shared.with_small(_texts(keyed, ends).mapInPandas(_shared.frugal(sets_of), "nid long, tokens array<long>"), ends.select("nid"), ["nid"], how="left_semi")
        held = _shared.written(held, "sets")
        if held.count() > ends.count():  # a doc_id that repeats, or is null, brings a set more than once
            held = _shared.written(held.dropDuplicates(["nid"]), "sets")
        ones = _shared.with_small(held.withColumnRenamed("nid", "x"), alive, ["x"])
        others = _shared.with_small(held.withColumnsRenamed({"nid": "y", "tokens": "tokens_y"}), alive.select("y").distinct(), ["y"], how="left_semi")
        both = ones.join(others, "y")
        same = F.size(F.array_intersect("tokens", "tokens_y"))
        alike = 100 * same >= percent * (F.size("tokens") + F.size("tokens_y") - same)
        return _shared.written(both.where(alike).select(F.col("x").alias("a"), F.col("y").alias("b")), "links")

    nearest = F.struct("apart", "x", "y")
    stars = shared.where("star is not null").select(F.least("nid", "star").alias("x"), F.greatest("nid", "star").alias("y"), "nid").distinct()
    stars = _shared.written(stars, "stars")
    best = near(stars.select("x", "y").distinct()).join(stars, ["x", "y"]).groupBy("nid").agg(F.min(nearest).alias("best"))
    links = verified(_shared.written(best.select("best.x", "best.y").distinct(), "best"))
    labels = _components.components(links)

    # Buckets whose sets are in different components.
    hot = _shared.written(shared.where("nid is null").select("token", F.col("n").alias("k")), "hot")
    none = F.lit(None).cast("array<long>").alias("bits")
    blocks = F.ceil(F.coalesce("k", F.lit(1)) / F.lit(BLOCK)).cast("int")
    some_hot = whole or hot.limit(1).count()

    def crossed_pairs(labels: DataFrame, nearest: bool) -> DataFrame:
        """Pairs (x, y, apart) of sets that share a bucket and are in different components; `nearest`: one a posting at most."""
        postings = _shared.with_small(shared.where("nid is not null").select("token", "nid", "n", "r"), hot, ["token"], how="left")

        def labelled(some: DataFrame) -> DataFrame:
            return _shared.with_small(some, labels.withColumnRenamed("node", "nid"), ["nid"], how="left").withColumn("label", F.coalesce("label", "nid"))

        every = labelled(postings.where("k is null")).select("token", F.lit(0).alias("low"), F.lit(0).alias("high"), F.lit(0).alias("block"), "nid", "n", "r", "label", none)
        if some_hot:  # buckets whose sets are all in one component have nothing to pair, and aren't dealt
            dealt = _shared.written(labelled(postings if whole else postings.where("k is not null")), "hotly")
            apart_still = dealt.groupBy("token").agg(F.min("label").alias("least"), F.max("label").alias("most")).where("least <> most").select("token")
            dealt = _shared.with_small(dealt, _shared.written(apart_still, "apart"), ["token"], how="left_semi")
            dealt = dealt.withColumn("block", F.pmod(F.xxhash64("nid"), blocks).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
            bits = full.select("nid", "bits")
            if whole:
                bits = _shared.with_small(bits, _shared.written(dealt.select("nid").distinct(), "ends"), ["nid"], how="left_semi")
            dealt = dealt.join(bits, "nid").select("token", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "block", "nid", "n", "r", "label", "bits")
            every = dealt if whole else every.union(dealt)
        in_order = every.repartition("token", "low", "high").sortWithinPartitions("token", "low", "high")
        return near(_shared.written(in_order.mapInPandas(_shared.frugal(_crossed(percent, nearest, whole)), "x long, y long").distinct(), "crossed"))

    def apart(pairs: DataFrame) -> DataFrame:
        """Pairs whose sets are in different components, with both labels."""
        for end in ("x", "y"):
            own = labels.select(F.col("node").alias(end), F.col("label").alias(f"label_{end}"))
            pairs = _shared.with_small(pairs, own, [end], how="left").withColumn(f"label_{end}", F.coalesce(f"label_{end}", end))
        return pairs.where("label_x <> label_y")

    def nearest_of(pairs: DataFrame) -> DataFrame:
        """Each component's nearest pair (x, y) of those between components."""
        each = apart(pairs).select(F.explode(F.array("label_x", "label_y")).alias("label"), "x", "y", "apart")
        return _shared.written(each.groupBy("label").agg(F.min(nearest).alias("best")).select("best.x", "best.y").distinct(), "tried")

    # Nearest mates join what belongs together, a row a posting at most; what stays apart is then paired whole.
    _shared.release(nodes.sparkSession)  # many small jobs came before, and as many follow
    tried = nearest_of(crossed_pairs(labels, True))
    _shared.release(nodes.sparkSession)
    links = links.union(verified(tried))
    labels = _components.components(links)
    rest = _shared.written(crossed_pairs(labels, False).join(tried, ["x", "y"], "left_anti"), "rest")
    if rest.limit(1).count():
        tried = nearest_of(rest)
        links = links.union(verified(tried))
        labels = _components.components(links)
        rest = _shared.written(apart(rest).select("x", "y").join(tried, ["x", "y"], "left_anti"), "rest")
        if rest.limit(1).count():
            links = links.union(verified(rest))
            labels = _components.components(links)
    return labels


def components_of(nodes: DataFrame, labels: DataFrame) -> DataFrame:
    """Written (nid, rows, component_id): the smallest doc_id of each set's component."""
    least = nodes.join(labels.withColumnRenamed("node", "nid"), "nid")
    whole = least.groupBy("label").agg(F.min("least").alias("found"))
    found = least.select("nid", "label").join(whole, "label").select("nid", "found")
    return _shared.written(nodes.join(found, "nid", "left").select("nid", "rows", F.coalesce("found", "least").alias("component_id")), "bynode")
