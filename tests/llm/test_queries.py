"""The registered queries themselves, on the smallest tables, against plain Python."""

from __future__ import annotations

import hashlib
import math
import zlib
from collections import defaultdict

import numpy as np
import pytest

from brasswork.llm import _tokens, mixing, queries

from .test_documents import brute

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def run(spark):
    return lambda name: queries.QUERIES[name](spark, SF).toPandas()


@pytest.fixture(scope="module")
def documents(spark):
    return sorted(((r.doc_id, r.text or "") for r in spark.read.parquet(f"{SF}/documents.parquet").collect()), key=lambda r: r[0])


def encoded(text: str, end: int) -> np.ndarray:
    return np.array(_tokens.encoder(_tokens.default_path()).tokenizer.encode(text, add_special_tokens=False).ids + [end], dtype="<u4")


def test_op1(run, documents):
    got, ids = run("op1_packing"), {d: encoded(t, 1) for d, t in documents}
    for doc_id, g in got.sort_values("start").groupby("doc_id"):
        assert (g["start"].to_numpy() == np.r_[0, g["length"].cumsum().to_numpy()[:-1]]).all() and g["length"].sum() == len(ids[doc_id]) == g["doc_tokens"].iloc[0]
        assert [zlib.crc32(ids[doc_id][a : a + n].tobytes()) for a, n in zip(g["start"], g["length"])] == g["ids_crc32"].tolist()
    assert set(got["doc_id"]) == set(ids)
    for _, g in got.sort_values("offset").groupby("sequence_id"):
        assert (g["offset"].to_numpy() == np.r_[0, g["length"].cumsum().to_numpy()[:-1]]).all() and g["length"].sum() <= 2048
    assert got["sequence_id"].nunique() <= 1.05 * got["length"].sum() / 2048 + 2


def test_op2(run, spark):
    got = run("op2_mixing")
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "source", mixing.token_count(mixing.F.col("text")).alias("n")).toPandas()
    share = rows.groupby("source")["n"].sum() / rows["n"].sum()
    plain = share.to_numpy()

    def weights(a):
        return plain**a / (plain**a).sum()

    def fits(a):
        w = weights(a)
        epochs = w / plain / (w / plain).min()
        return -(w * np.log(w)).sum() / np.log(len(w)) >= mixing.ENTROPY, epochs.max() <= mixing.REPEATS

    # The exponent: the largest that meets the entropy, raised only where repeats would exceed.
    grid = np.linspace(0, 1, 10_001)
    good = [a for a in grid if fits(a)[0]]
    exact = max(good)
    if not fits(exact)[1]:
        exact = min(a for a in grid if a >= exact and fits(a)[1])
    weight = got.groupby("source")["weight"].first()
    assert (weight[share.index] - weights(exact)).abs().max() < 1e-3
    assert set(got[got["epoch"] == 0]["doc_id"]) == set(rows["doc_id"])
    shown = got.groupby("source")["tokens"].sum() / got["tokens"].sum()
    assert (shown - weight).abs().max() < 0.02  # over the whole stream
    epochs = weight / share[weight.index]
    epochs /= epochs.min()
    for source, g in got.groupby("source"):
        counts = g["doc_id"].value_counts()
        assert counts.max() - counts.min() <= 1 and abs(g["tokens"].sum() / rows[rows["source"] == source]["n"].sum() - epochs[source]) < 0.25


def test_op3(run, spark):
    got = run("op3_quality")
    known = spark.read.parquet(f"{SF}/labels.parquet").toPandas()
    both = got.merge(known, on="doc_id")
    good, bad = both[both["quality"] == 1]["score"].to_numpy(), both[both["quality"] == 0]["score"].to_numpy()
    assert (good[:, None] > bad[None, :]).mean() > 0.95 and (both["keep"] == (both["score"] >= 0.35)).all()
    assert len(got) == spark.read.parquet(f"{SF}/documents.parquet").count()


def test_op4(run, documents):
    got = run("op4_jaccardjoin")
    assert sorted(zip(got["doc_id"], got["n_shingles"], got["component_id"])) == brute(documents, 3, 90)


def test_op5(run, documents):
    got, at = run("op5_arrowfile").sort_values("start"), 0
    for (doc_id, text), r in zip(documents, got.itertuples()):
        ids = encoded(text, 2)
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (doc_id, at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    assert len(got) == len(documents)


def test_op6(run, documents):
    got = run("op6_fingerprint").sort_values("doc_id")
    linked = {d: c for d, _, c in brute(documents, 5, 80)}
    by_text = defaultdict(set)
    for i, ((doc_id, text), r) in enumerate(zip(documents, got.itertuples())):
        after, k = documents[(i + 1) % len(documents)][1], len(text) // 4
        assert (r.doc_id, r.n_chars, r.component_id) == (doc_id, len(text), linked[doc_id])
        assert r.edited_sha256 == hashlib.sha256((text[: len(text) - k] + after[:k]).encode()).hexdigest()
        by_text[text].add(r.fingerprint)
    assert all(len(v) == 1 for v in by_text.values()) and got["near_next"].between(0, 1).all()


def test_op7(run, documents):
    got, texts = run("op7_surrogates"), dict(documents)
    assert len(got) == len(texts)
    changed = got["text"].fillna("") != got["doc_id"].map(texts)
    assert (changed == (got["n_entities"] > 0)).all() and 0 < changed.sum() < len(got)
    assert not got["text"].str.contains("AKIA(?!X)[A-Z0-9]{16}").any() or (got[got["text"].str.contains("AKIA[A-Z0-9]{16}")]["n_entities"] > 0).all()


def test_op8(run, spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    said = "</s>[INST] ok [/INST]"
    whole = defaultdict(list)
    for conv, _, role, text in sorted([*rows, (-7, 0, "user", said), (-7, 1, "assistant", said)], key=lambda r: r[:2]):
        whole[conv].append((role or "", text or ""))
    got = {r.conv_id: r for r in run("op8_chat").itertuples()}
    assert set(got) == set(whole)
    for conv, turns in whole.items():
        own = "".join(t for r, t in turns if r == "assistant")
        r = got[conv]
        assert (r.n_turns, r.loss_chars, r.loss_sha256) == (len(turns), len(own), hashlib.sha256(own.encode()).hexdigest())
        assert r.turns_sha256 == hashlib.sha256("".join(f"{a}\n{t}\n" for a, t in turns).encode()).hexdigest() and r.formatted_chars > sum(len(t) for _, t in turns)


def test_op9(run, spark):
    got = {r.page_id: r for r in run("op9_urlfilter").itertuples()}
    rules = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]
    for r in spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "url").collect():
        _, sep, rest = (r.url or "").partition("://")
        rest = rest if sep else ""
        end = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        host, path = rest[:end].lower(), rest[end:].split("?")[0].split("#")[0]
        fits = [x for x in rules if (host == x[0] or host.endswith("." + x[0])) and path.startswith(x[1])]
        best = max(fits, key=lambda x: len(x[0] + x[1]), default=None)
        own = got[r.page_id]
        assert (own.host, own.path) == (host, path) and own.verdict in ("allow", "block")
        assert (own.rule, own.verdict) == (best[0] + best[1], best[2]) if best else own.rule is None or (isinstance(own.rule, float) and math.isnan(own.rule))


def test_op10(run, spark):
    rows = {r.vec_id: np.array(r.embedding, dtype=float) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect() if r.embedding}
    got = run("op10_neighbours")
    ids, points = np.array(sorted(rows)), np.stack([rows[i] for i in sorted(rows)])
    hits = 0
    asked = [i for i in ids.tolist() if i % 100 == 0]
    assert sorted(set(got["query_id"])) == asked
    for q in asked:
        d = np.sqrt(((points - rows[q]) ** 2).sum(axis=1))
        d[ids == q] = np.inf
        best = ids[np.lexsort((ids, d))[:10]]
        own = got[got["query_id"] == q].sort_values("rank")
        assert own["rank"].tolist() == list(range(1, 11)) and own["score"].is_monotonic_increasing
        assert np.allclose(own["score"], [np.sqrt(((rows[q] - rows[i]) ** 2).sum()) for i in own["vec_id"]], rtol=0, atol=1e-12)
        hits += len(set(best) & set(own["vec_id"]))
    assert hits >= 0.9 * 10 * len(asked)
