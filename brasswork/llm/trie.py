"""Conversation prefix trie (operator 13): chained digests of prefixes, grouped to nodes, sums of subtrees.

Each turn is hashed where it is read, so only digests move. A conversation's turns stream in order through a chain
(the digest of d turns is SHA-256 over the digest of d - 1 turns and the d-th turn's), giving one row for each prefix, the empty
one included; rows with the same (depth, digest) are one node, told by partial sums, so a prefix that all share burdens no task.

Sums over subtrees: each node's numbers go to all its ancestors. The nodes whose smallest member is the same
conversation lie in a row, from some depth to that conversation's end. They are summed by a running sum among themselves, and only
their total goes to the ancestors above the row, one row for each; these are prefixes of that conversation, so rows stay
as many as prefixes, where one row for each node and ancestor would grow with the square of a conversation's length.

The members that end at a node are hashed in ascending order: ranges of them are joined to pieces of text by many tasks, and
what streams through one task for each node is those pieces.

Defined results: rows with a null conv_id belong to no conversation and take no part; null role or text is empty; a null turn comes first;
rows with the same turn follow by the digest of role and text, repeated ones included; an empty table gives no rows;
other columns don't matter.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import _shared

ROOT = hashlib.sha256(b"").digest()
#: Characters of a piece of joined ids.
PIECE = 1 << 16


def turns_of(conversations: DataFrame) -> DataFrame:
    """(conv_id, pos, digest, bytes) of each turn: its place from 1, the digest of role and text, bytes of the text."""
    role, text = _shared.text_or_empty("role"), _shared.text_or_empty()
    whole = F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)
    rows = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.unhex(F.sha2(whole, 256)).alias("digest"), F.octet_length(text).cast("long").alias("bytes"))
    by_turn = Window.partitionBy("conv_id").orderBy("turn", "digest", "bytes")
    return rows.select("conv_id", F.row_number().over(by_turn).alias("pos"), "digest", "bytes")


def prefixes(turns: DataFrame) -> DataFrame:
    """Written (conv_id, depth, digest, parent, bytes, ends) of every prefix of (conv_id, part, pos, digest, bytes) rows.

    A row without a digest stands for a conversation itself, which may have no turns; each needs one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["conv_id", "depth", "digest", "parent", "bytes", "ends"]
        last: list | None = None

        def frame(rows: list[list]) -> pa.RecordBatch:
            kinds = [pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.int64(), pa.bool_()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

        for batch in batches:
            rows = []
            for conv_id, digest, size in zip(batch.column("conv_id").to_pylist(), batch.column("digest").to_pylist(), batch.column("bytes").to_pylist()):
                if digest is None:
                    new = [conv_id, 0, ROOT, None, 0, True]
                else:
                    last[5] = False
                    new = [conv_id, last[1] + 1, hashlib.sha256(last[2] + digest).digest(), last[2], size, True]
                if last is not None:
                    rows.append(last)
                last = new
            if rows:
                yield frame(rows)
        if last is not None:
            yield frame([last])

    in_order = turns.repartition("conv_id").sortWithinPartitions("conv_id", F.col("digest").isNotNull(), "part", "pos").select("conv_id", "digest", "bytes")
    return _shared.written(in_order.mapInArrow(_shared.frugal(run), "conv_id long, depth int, digest binary, parent binary, bytes long, ends boolean"), "prefixes")


def _ends(prefixes: DataFrame) -> DataFrame:
    """(digest, ends_sha256) of the nodes at which conversations end."""

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, first, held, size = None, 0, [], 0

        def done() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([node], pa.binary()), pa.array([first], pa.int64()), pa.array([",".join(held)])], ["digest", "first", "ids"])

        for batch in batches:
            for digest, conv_id in zip(batch.column("digest").to_pylist(), batch.column("conv_id").to_pylist()):
                if digest != node or size >= PIECE:
                    if held:
                        yield done()
                    node, first, held, size = digest, conv_id, [], 0
                held.append(str(conv_id))
                size += len(held[-1]) + 1
        if held:
            yield done()

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, state = None, hashlib.sha256()
        for batch in batches:
            nodes, found = [], []
            for digest, ids in zip(batch.column("digest").to_pylist(), batch.column("ids").to_pylist()):
                if digest == node:
                    state.update(b",")
                else:
                    if node is not None:
                        nodes.append(node)
                        found.append(state.hexdigest())
                    node, state = digest, hashlib.sha256()
                state.update(ids.encode())
            if nodes:
                yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.binary()), pa.array(found)], ["digest", "ends_sha256"])
        if node is not None:
            yield pa.RecordBatch.from_arrays([pa.array([node], pa.binary()), pa.array([state.hexdigest()])], ["digest", "ends_sha256"])

    members = prefixes.where("ends").select("digest", "conv_id").repartitionByRange("digest", "conv_id").sortWithinPartitions("digest", "conv_id")
    joined = members.mapInArrow(_shared.frugal(pieces), "digest binary, first long, ids string")
    return joined.repartition("digest").sortWithinPartitions("digest", "first").select("digest", "ids").mapInArrow(_shared.frugal(hashed), "digest binary, ends_sha256 string")


def trie(found: DataFrame) -> DataFrame:
    """The nodes of written `prefixes`: digest, smallest member, depth, parent, members, children, sums of the subtree, hash of the ends."""
    nodes = found.groupBy("depth", "digest", "parent").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.max("bytes").alias("bytes"))
    nodes = _shared.written(nodes, "nodes")
    children = nodes.where("parent is not null").groupBy(F.col("parent").alias("digest")).agg(F.count("*").alias("n_children"))
    nodes = nodes.join(children, "digest", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)))
    leaf, saved = F.when(F.col("n_children") == 0, 1).otherwise(0).cast("long"), (F.col("n_convs") - 1) * F.col("bytes")
    nodes = _shared.written(nodes.withColumn("leaf", leaf).withColumn("saved", saved), "nodes")

    # Nodes of the same smallest member lie in a row: running sums from the deepest, and the row's total.
    below = Window.partitionBy("conv_id").orderBy(F.desc("depth")).rowsBetween(Window.unboundedPreceding, 0)
    own = nodes.select("*", F.sum("leaf").over(below).alias("own_leaves"), F.sum("saved").over(below).alias("own_saved"))
    totals = nodes.groupBy("conv_id").agg(F.min("depth").alias("top"), F.sum("leaf").alias("leaves"), F.sum("saved").alias("saved"))
    above = found.select("conv_id", "depth", "digest").join(totals, "conv_id").where("depth < top")
    above = above.groupBy("digest").agg(F.sum("leaves").alias("more_leaves"), F.sum("saved").alias("more_saved"))

    def whole(a: str, b: str) -> Column:
        return F.col(a) + F.coalesce(b, F.lit(0))

    summed = own.join(above, "digest", "left").join(_ends(found), "digest", "left")
    summed = _shared.written(
        summed.select(
            "digest", "parent", "conv_id", F.col("depth").cast("long").alias("depth"), "n_convs", "n_children", whole("own_leaves", "more_leaves").alias("n_leaves"), whole("own_saved", "more_saved").alias("saved_tokens"),
            F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"),
        ),
        "summed",
    )
    parents = summed.where("n_children > 0").select(F.col("digest").alias("parent"), F.col("conv_id").alias("parent_conv_id"), "n_children")
    return _shared.left_join(summed.withColumnRenamed("n_children", "children"), parents, "parent", "n_children").withColumnRenamed("children", "n_children")


def rebuilt(turns: DataFrame) -> DataFrame:
    """Turns of each conversation c after the first h of its own follow the first h of conversation c - c % 5; h is crc32(c) % 9.

    `turns` come from `turns_of`. At most nine conversations share a base, whose first eight turns alone are copied.
    """
    turns = _shared.written(turns, "turns")
    convs = turns.select("conv_id").distinct().select("conv_id", (F.col("conv_id") - F.col("conv_id") % 5).alias("base"), (F.crc32(F.col("conv_id").cast("string")) % 9).alias("h"))
    convs = _shared.written(convs, "convs")
    alone = convs.select("conv_id", F.lit(0).alias("part"), F.lit(0).alias("pos"), F.lit(None).cast("binary").alias("digest"), F.lit(0).cast("long").alias("bytes"))
    first = turns.where("pos <= 8").withColumnRenamed("conv_id", "base").join(convs, "base").where("pos <= h").select("conv_id", F.lit(1).alias("part"), "pos", "digest", "bytes")
    own = turns.where(F.col("pos") > F.crc32(F.col("conv_id").cast("string")) % 9).select("conv_id", F.lit(2).alias("part"), "pos", "digest", "bytes")
    return alone.unionByName(first).unionByName(own)


def op13_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trie of rebuilt `conversations`."""
    _shared.ship(spark)
    out = trie(prefixes(rebuilt(turns_of(_shared.table(spark, sf_dir, "conversations")))))
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


SQL = r"""
WITH own AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS pos, coalesce(role, '') AS role, coalesce(text, '') AS text
  FROM conversations WHERE conv_id IS NOT NULL
), convs AS (
  SELECT conv_id, conv_id - conv_id % 5 AS base,
         xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda c: ord(c)::BIGINT)),
             lambda a, b: list_reduce(list_prepend(xor(a, b), [0::BIGINT, 1, 2, 3, 4, 5, 6, 7]), lambda x, i: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384::BIGINT) ELSE x // 2 END)), 4294967295::BIGINT) % 9 AS h
  FROM (SELECT DISTINCT conv_id FROM own)
), turns AS (
  SELECT c.conv_id, 1 AS part, o.pos, o.role, o.text FROM convs c JOIN own o ON o.conv_id = c.base AND o.pos <= c.h
  UNION ALL SELECT c.conv_id, 2, o.pos, o.role, o.text FROM convs c JOIN own o ON o.conv_id = c.conv_id AND o.pos > c.h
), placed AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY part, pos) AS depth, strlen(text) AS bytes, sha256(strlen(role) || ':' || role || text) AS said FROM turns
), chains AS (
  SELECT conv_id, depth, bytes, string_agg(said, '') OVER (PARTITION BY conv_id ORDER BY depth ROWS UNBOUNDED PRECEDING) AS chain FROM placed
  UNION ALL SELECT conv_id, 0, 0, '' FROM convs
), prefixes AS (
  SELECT *, depth = max(depth) OVER (PARTITION BY conv_id) AS ends FROM chains
), nodes AS (
  SELECT depth, chain, min(conv_id) AS conv_id, count(*) AS n_convs, max(bytes) AS bytes,
         sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256
  FROM prefixes GROUP BY depth, chain
), families AS (
  SELECT n.*, p.conv_id AS parent_conv_id, (SELECT count(*) FROM nodes k WHERE k.depth = n.depth + 1 AND k.chain[:64 * n.depth] = n.chain) AS n_children
  FROM nodes n LEFT JOIN nodes p ON p.depth = n.depth - 1 AND p.chain = n.chain[:64 * (n.depth - 1)]
)
SELECT a.conv_id, a.depth, a.parent_conv_id, a.n_convs, a.n_children, a.ends_sha256,
       count(*) FILTER (b.n_children = 0) AS n_leaves, sum((b.n_convs - 1) * b.bytes)::BIGINT AS saved_tokens
FROM families a JOIN families b ON b.depth >= a.depth AND b.chain[:64 * a.depth] = a.chain
GROUP BY ALL
"""
