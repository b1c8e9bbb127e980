"""Line dedup against plain Python, with filters large and far too small."""

from __future__ import annotations

import hashlib
from collections import defaultdict

import numpy as np
import pytest

from brasswork.llm import linededup, queries

BLANK = " \t\n\x0b\x0c\r"


def key_of(line: str) -> str:
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(BLANK))


def plain(rows: list[tuple]) -> list[tuple]:
    order = lambda d: (d is None, d or 0)
    holders = defaultdict(set)
    for doc_id, text in rows:
        for line in (text or "").split("\n"):
            holders[key_of(line)].add(order(doc_id))
    out = []
    for doc_id, text in rows:
        own = (text or "").split("\n")
        kept = [x for x in own if len(key_of(x)) < 10 or len(holders[key_of(x)]) < 2 or min(holders[key_of(x)]) == order(doc_id)]
        out.append((doc_id, "\n".join(kept), len(own), len(own) - len(kept)))
    return sorted(out, key=str)


ROWS = [
    (2**53 + 1, "A shared line here\nown one, two, three\nshort\nA shared line here"),
    (2**53, "short\n\t a SHARED line here \r\nÄLTERE Zeile hier"),
    (-(2**63), "zwölf ältere\nältere Zeile hier"),
    (2**63 - 1, "ÄLTERE zeile hier\nshort\nA shared line here"),
    (None, "A shared line here\nonly rows without an id\nshort"),
    (None, "only rows without an id\nnine char"),
    (7, None), (8, ""), (9, "\n\n"), (10, " \t\r\n \x0b\x0c"), (11, "nine char"), (12, "nine char"), (13, "ten  chars"), (14, "TEN  CHARS"), (14, "TEN  CHARS"),
    (15, "ééééééééé"), (16, "ééééééééé"), (17, "éééééééééé"), (18, "éééééééééé"), (19, " ten  chars"), (20, "ten  chars "), (21, "a shared line here x"), (22, "line " * 60_000), (23, "LINE " * 60_000),
    *[(100 + i, f"line number {i % 7}\nA very common line\nunique line of {i}\n\nA very common line") for i in range(50)],
]


@pytest.mark.parametrize("most_bits", [linededup.MOST_BITS, 512])
def test_awkward(spark, most_bits):
    docs = spark.createDataFrame([(d, t, 1, "x", 2) for d, t in ROWS], "doc_id long, text string, mark long, digest string, lost int").repartition(3)
    got = sorted((tuple(r) for r in linededup.dedup(docs, most_bits=most_bits).select("doc_id", "text", "n_lines", "n_dropped").collect()), key=str)
    assert got == plain(ROWS)


def test_nothing(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert linededup.dedup(docs).collect() == []


def test_filters():
    rng = np.random.default_rng(1)
    bits, many = 1 << 14, [rng.bytes(16) for _ in range(600)]
    whole = np.zeros(bits // 8, np.uint8), np.zeros(bits // 8, np.uint8)
    linededup.add(*whole, linededup.positions(many, bits))
    linededup.add(*whole, linededup.positions(many[:50], bits))
    parts = []
    for own in (many, many[:50]):
        parts.append((np.zeros(bits // 8, np.uint8), np.zeros(bits // 8, np.uint8)))
        linededup.add(*parts[-1], linededup.positions(own, bits))
    linededup.merge(*parts[0], *parts[1])
    for once, twice in (whole, parts[0]):
        at = linededup.positions(many, bits)
        assert linededup.has(once, at).all() and linededup.has(twice, at[:50]).all()
        assert linededup.has(twice, at[50:]).all(axis=1).mean() < 0.1  # suspected wrongly


def test_registered(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    want = sorted((d, n, gone, hashlib.sha256(t.encode()).hexdigest()) for d, t, n, gone in plain(rows))
    assert sorted(map(tuple, queries.QUERIES["op12_linededup"](spark, sf).collect())) == want
