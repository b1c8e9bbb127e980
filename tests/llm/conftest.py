from __future__ import annotations

import random

import pytest


def prose(rng: random.Random, n: int) -> str:
    words = ["alpha", "beta", "gamma", "delta", "river", "stone", "Über", "straße", "niño", "tree,", "house.", "light", "x1", "Night"]
    return " ".join(rng.choice(words) + str(rng.randrange(400)) for _ in range(n))


@pytest.fixture(scope="session")
def awkward(spark):
    """Documents with nulls, empty and long texts, copies, repeated rows and columns with clashing names."""
    rng = random.Random(5)
    base = prose(rng, 120)
    rows = [(i, prose(rng, rng.randrange(1, 200)), "en", f"s{i % 3}") for i in range(40)]
    rows += [(100, None, None, None), (101, "", "en", "s0"), (102, " \n\t ", "en", "s0"), (103, "one", "en", None), (104, "one two", "en", "s1")]
    rows += [(105, "word " * 30_000, "en", "s0"), (106, "x" * 50_000, "en", "s0"), (107, base, "en", "s0"), (108, base, "en", "s0"), (108, base, "en", "s0")]
    for i in range(60):  # near copies of one text
        words = base.split()
        for _ in range(i % 4):
            words[rng.randrange(len(words))] = f"edit{i}"
        rows.append((200 + i, " ".join(words), "en", "s0"))
    rows += [(None, "no id here at all", "en", "s2"), (None, base + " tail", "en", "s2")]
    made = [(i, t, lang, s, len(t or ""), 1, "k", 2.0, 3, "m") for i, t, lang, s in rows]
    return spark.createDataFrame(made, "doc_id long, text string, lang string, source string, n_chars long, rank int, _key string, label double, nid int, _mark string")


@pytest.fixture(scope="session")
def nothing(spark, awkward):
    return spark.createDataFrame([], awkward.schema)
