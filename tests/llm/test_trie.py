"""The prefix trie against plain Python."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import defaultdict

from brasswork.llm import _shared, queries, trie


def plain(rows: list[tuple]) -> list[tuple]:
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            whole = f"{len((role or '').encode())}:{role or ''}{text or ''}"
            own[conv].append(((turn is not None, turn or 0), hashlib.sha256(whole.encode()).digest(), role or "", text or ""))
    said = {c: [x[2:] for x in sorted(v)] for c, v in own.items()}
    built = {}
    for c in said:
        h = zlib.crc32(str(c).encode()) % 9
        base = c - (abs(c) % 5) * (1 if c >= 0 else -1)
        built[c] = tuple(said.get(base, [])[:h] + said[c][h:])
    members = defaultdict(list)
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            members[turns[:d]].append(c)
    children = defaultdict(list)
    for node in members:
        if node:
            children[node[:-1]].append(node)
    sums = {}
    for node in sorted(members, key=len, reverse=True):
        leaves = sum(sums[k][0] for k in children[node]) or 1
        saved = sum(sums[k][1] for k in children[node]) + (len(members[node]) - 1) * (len(node[-1][1].encode()) if node else 0)
        sums[node] = leaves, saved
    out = []
    for node, convs in members.items():
        ends = ",".join(map(str, sorted(c for c in convs if built[c] == node)))
        out.append((min(convs), len(node), min(members[node[:-1]]) if node else None, len(convs), len(children[node]), *sums[node], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def run(spark, rows: list[tuple]) -> list[tuple]:
    frame = spark.createDataFrame([(*r, 1, "x", b"y") for r in rows], "conv_id long, turn long, role string, text string, depth int, part string, digest binary").repartition(3)
    _shared.ship(spark)
    out = trie.trie(trie.prefixes(trie.rebuilt(trie.turns_of(frame))))
    return sorted((tuple(r) for r in out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256").collect()), key=str)


def test_awkward(spark, monkeypatch):
    monkeypatch.setattr(trie, "PIECE", 40)
    rng = random.Random(3)
    rows = [(c, t, rng.choice(["user", "assistant", None]), rng.choice(["a", "b", "é", "", None])) for c in range(120) for t in range(rng.randrange(1, 12))]
    rows += [(c, t, "user", "same") for c in range(1000, 1300) for t in range(9)]  # a hot conversation
    rows += [(2**53 + k, t, "user", f"long {t}") for k in range(4) for t in range(40)] + [(2**63 - 1, 0, "user", "x"), (-(2**63), 3, "user", "x"), (-7, 0, "user", "n"), (-5, 0, "user", "m")]
    rows += [(500, None, "user", "first"), (500, 0, "user", "then"), (500, 0, "user", "tie"), (500, 0, "user", "tie"), (None, 0, "user", "nobody"), (600, 0, None, None), (601, 0, "", ""), (602, 0, "us", "er"), (603, 0, "user", ""), (604, 0, "", "user")]
    assert run(spark, rows) == plain(rows)


def test_small(spark):
    assert run(spark, []) == []
    assert run(spark, [(None, 0, "user", "a")]) == []
    rows = [(c, 0, "user", "only") for c in (1, 3)]
    assert run(spark, rows) == plain(rows)


def test_registered(spark):
    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert sorted((tuple(r) for r in queries.QUERIES["op13_trie"](spark, sf).collect()), key=str) == plain(rows)
