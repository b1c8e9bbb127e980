"""Pairs that the linking of fingerprints makes, and the bound by bitmaps."""

from __future__ import annotations

import random

import numpy as np

from brasswork.llm import _links, _shared, fingerprint


def _texts() -> list[str]:
    """Texts of one family that share buckets, few of them 80 % alike."""
    rng = random.Random(7)
    base = [f"w{k}" for k in range(150)]
    out = []
    for i in range(160):
        words = list(base)
        for k in rng.sample(range(150), 5):
            words[k] = f"e{i}_{k}"
        out.append(" ".join(words))
    return out + [x + " end" for x in out[:5]]


def test_few_pairs(spark, monkeypatch):
    texts = _texts()
    made, written = [], _shared.written

    def counted(df, label):
        out = written(df, label)
        if label == "crossed":
            made.append(out.count())
        return out

    monkeypatch.setattr(_shared, "written", counted)
    found = {r.doc_id: r.component_id for r in fingerprint.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert sum(made) < 5 * len(texts)  # not a share of all pairs
    assert all(found[160 + k] == found[k] for k in range(5))


def test_bits_apart():
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 2**63, n, dtype=np.uint64)) for n in (5, 900, 1000, 1030, 1500, 2040, 2100, 4000, 5000)]
    bits = np.empty(len(sets), dtype=object)
    bits[:] = [_links.bitmap(s) for s in sets]
    i, j = (x.ravel() for x in np.meshgrid(range(len(sets)), range(len(sets))))
    for a, b, far in zip(i, j, _links._bits_apart(bits, i, j)):
        assert far <= len(np.setxor1d(sets[a], sets[b]))
        assert (far == 0) == (a == b or max(len(bits[a]), len(bits[b])) > 2 * min(len(bits[a]), len(bits[b])))
