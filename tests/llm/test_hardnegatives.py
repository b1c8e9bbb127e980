"""Hard negatives against plain Python."""

from __future__ import annotations

import math
import random

import numpy as np
from pyspark.sql import functions as F

from brasswork.llm import hardnegatives, queries


def plain(rows: list[tuple], positives: int = 5, negatives: int = 10) -> list[tuple]:
    held = [(i, label, [math.floor(256 * float(x)) for x in v]) for i, label, v in rows if i is not None and label is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for at, (anchor, label, v) in enumerate(held):
        if anchor % 100:
            continue
        scored = sorted(((sum(a * b for a, b in zip(v, w)), i, k, other) for k, (i, other, w) in enumerate(held) if k != at and len(w) == len(v)), key=lambda x: (-x[0], x[1]))
        for place, (score, i, _, _) in enumerate([x for x in scored if x[3] == label][:positives], 1):
            found = [x for x in scored if x[3] != label and 30 * score <= 100 * x[0] <= 90 * score][:negatives]
            out += [(anchor, place, i, rank, x[1], score, x[0]) for rank, x in enumerate(found, 1)]
    return sorted(out)


def run(spark, rows: list[tuple]) -> list[tuple]:
    frame = spark.createDataFrame([(*r, 1, "x") for r in rows], "id long, label int, vector array<double>, row int, size string").repartition(3)
    return sorted(map(tuple, hardnegatives.mine(frame, F.col("id") % 100 == 0).collect()))


def test_awkward(spark, monkeypatch):
    monkeypatch.setattr(hardnegatives, "ANCHORS", 3)
    monkeypatch.setattr(hardnegatives, "ROWS", 16)
    rng = random.Random(2)
    rows = [(i * 5, rng.randrange(3), [rng.gauss(0.3, 1) for _ in range(70)]) for i in range(120)]
    rows += [(2**53 + 100 - 2**53 % 100 + 1 + i, 1, [0.5] * 70) for i in range(4)]  # ties and equal vectors
    rows += [(700, 1, [0.1] * 5), (703, 1, [0.2] * 5), (704, 2, [0.15] * 5), (800, 1, [1.0]), (900, 1, [1e5, -1e5]), (901, 1, [1e5, -1e5]), (902, 0, [5e4, -5e4])]
    rows += [(None, 1, [1.0] * 70), (100, None, [1.0] * 70), (200, 1, None), (300, 1, []), (400, 1, [None] + [1.0] * 69), (500, 1, [float("nan")] + [1.0] * 69), (600, 1, [float("inf")] + [1.0] * 69)]
    want = plain(rows)
    assert want and run(spark, rows) == want


def test_repeated(spark):
    rows = [(0, 1, [1.0, 2.0]), (0, 1, [1.0, 2.0]), (1, 2, [0.5, 1.0]), (1, 2, [0.5, 1.0]), (2, 1, [1.0, 1.9])]
    assert run(spark, rows) == plain(rows)
    assert run(spark, []) == [] and run(spark, [(0, 1, [1e300, 1.0]), (1, 1, [1.0, 1.0])]) == []


def test_product():
    rng = np.random.default_rng(0)
    for most in (1000, 2**31):
        a, b = (rng.integers(-most, most, (5, 32)) for _ in range(2))
        want = [[sum(int(x) * int(y) for x, y in zip(p, q)) for q in b] for p in a]
        if most == 1000:
            assert hardnegatives.product(a, b).tolist() == want
        else:
            assert hardnegatives.product(a // 64, b // 64).tolist() == [[sum(int(x) * int(y) for x, y in zip(p // 64, q // 64)) for q in b] for p in a]


def test_registered(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r.vec_id, (r.label + 1) % 10 if r.vec_id % 7 == 0 else r.label, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    assert sorted(map(tuple, queries.QUERIES["op11_hardnegatives"](spark, sf).collect())) == plain(rows)


def test_scores_stay_in_tasks(spark):
    """What is written is as long as the rows, not as their pairs."""
    from brasswork.llm import _shared

    rng = random.Random(3)
    frame = spark.createDataFrame([(i, i % 4, [rng.gauss(0, 1) for _ in range(8)]) for i in range(1500)], "id long, label int, vector array<double>").repartition(3)
    before = len(_shared.made())
    assert hardnegatives.mine(frame, F.lit(True)).count()
    files = [f for _, path in _shared.made(before) for f in spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("length").collect()]
    assert sum(f.length for f in files) < 1500 * 1500  # a byte a pair


def test_labels_and_cells(spark, monkeypatch):
    """Labels of many and of few rows, several cells, products in each kind of numbers, copies with equal scores."""
    monkeypatch.setattr(hardnegatives, "ANCHORS", 4)
    monkeypatch.setattr(hardnegatives, "ROWS", 16)
    monkeypatch.setattr(hardnegatives, "HELD", 2048)
    monkeypatch.setattr(hardnegatives, "MOST_BLOCKS", 2)
    monkeypatch.setattr(hardnegatives, "PENDING", 8)
    rng = random.Random(4)
    rows = []
    for i in range(400):
        scale = rng.choice([1, 1, 1, 300, 3.5e4])
        rows.append((i * 20, rng.choice([0, 1, 1, 2, 10 + rng.randrange(60)]), [scale * rng.gauss(0.5, 1) for _ in range(40)]))
    rows += [(10_000 + i, i % 3, [0.25] * 40) for i in range(150)]
    want = plain(rows)
    assert want and run(spark, rows) == want
