"""Chat formatting, URL filter, nearest neighbours, the pipeline's stages."""

from __future__ import annotations

import hashlib
import math
from collections import defaultdict

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from brasswork.llm import chat, neighbours, urlfilter

PARTS = st.lists(st.sampled_from(["\\", "<", "|", "<s>", "</s>", "[INST]", "\n", "a", "<\\s>", "<\\\\|im_end|>", "<|im_end|>", ">", "[/", "INST]", "é"]), max_size=9).map("".join)


@settings(max_examples=300, deadline=None)
@given(PARTS)
def test_escape_is_reversible(text):
    out = chat.escape(text)
    assert chat.unescape(out) == text and not any(c in out for c in chat.CONTROL)
    assert chat._role_in(chat._role_out(text)) == text and "\n" not in chat._role_out(text)


def test_chat(spark):
    long = "word " * 5000
    rows = [(1, 0, "system", "be kind"), (1, 1, "user", "hi </s>"), (1, 2, "assistant", "<|im_end|> ok"), (1, 3, "user", long), (1, 4, "assistant", long)]
    rows += [(2, i, "user" if i % 2 == 0 else "assistant", f"turn {i} " * 20) for i in range(60)]
    rows += [(3, 0, None, None), (3, None, "assistant", "first"), (None, 0, "user", ""), (4, 1, "assistant", "tie"), (4, 1, "assistant", "tie")]
    turns = spark.createDataFrame([(*r, 9) for r in rows], "conv_id long, turn long, role string, text string, loss int")
    whole = defaultdict(list)
    for conv, turn, role, text in sorted(rows, key=lambda r: (-1 if r[0] is None else r[0], -1 if r[1] is None else r[1], r[2] or "", r[3] or "")):
        whole[conv].append((role or "", text or ""))
    for budget in (60, 300, 2048):
        formatted = chat.windows(turns, budget=budget)
        made = formatted.toPandas()
        assert all(sum(t) <= budget or len(t) - f == 1 for t, f in zip(made["turn_tokens"], made["first_new"]))
        got = {(None if math.isnan(r.conv_id or 0) else r.conv_id): r for r in chat.read_back(formatted).collect()}
        assert set(got) == set(whole)
        for conv, own in whole.items():
            said = "".join(t for r, t in own if r == "assistant")
            assert (got[conv].n_turns, got[conv].loss_chars) == (len(own), len(said))
            assert got[conv].turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in own).encode()).hexdigest()
            assert got[conv].loss_sha256 == hashlib.sha256(said.encode()).hexdigest()
    kept = chat.windows(turns.where("conv_id = 1"), budget=300).toPandas().sort_values("window_no")
    assert all("be kind" in t for t, n in zip(kept["text"], kept["turn_tokens"]) if sum(n) <= 300)
    assert chat.read_back(chat.windows(turns.where("false"))).count() == 0


def test_urls(spark):
    urls = ["https://A.Example.net/en/1?x#y", "http://x.example.net/de/", "http://example.com/de/a", "http://a.org/fr/z", "http://net", "no url", None, "x://", "ftp://Host?q", "http://notexample.net/en/"]
    urls += [f"https://blog{i % 7}.river.example.org/en/{i}" for i in range(500)] + [f"http://www.casino-win{i % 3}.example.org/en/{i}" for i in range(60)]
    pages = spark.createDataFrame([(i, u, "", "x") for i, u in enumerate(urls)], "page_id long, url string, html string, host string")
    got = {r.page_id: r for r in urlfilter.judge(pages).collect()}
    assert [(got[i].host, got[i].path, got[i].rule) for i in range(10)] == [
        ("a.example.net", "/en/1", "example.net/en/"), ("x.example.net", "/de/", "net/"), ("example.com", "/de/a", "example.com/de/"), ("a.org", "/fr/z", "org/fr/"), ("net", "", None),
        ("", "", None), ("", "", None), ("", "", None), ("host", "", None), ("notexample.net", "/en/", "net/"),
    ]
    assert [got[i].verdict for i in (0, 1, 2, 3, 5, 6)] == ["allow", "block", "block", "allow", "allow", "allow"]
    assert all(got[10 + i].verdict == "allow" for i in range(500)) and sum(got[510 + i].verdict == "block" for i in range(60)) >= 54
    # The score against a plain model of the other folds.
    texts = [(got[i].host + got[i].path, got[i].rejected) for i in got]
    made = spark.createDataFrame([(t,) for t, _ in texts], "text string").select("text", F.pmod(F.xxhash64(F.lit("fold"), "text"), F.lit(urlfilter.FOLDS)).alias("fold")).distinct().collect()
    fold = {r.text: r.fold for r in made}
    pad = lambda t: "\x02" * urlfilter.ORDER + t.lower() + "\x03"

    def score(t):
        counts = [defaultdict(int), defaultdict(int)]
        for other, rejected in texts:
            if other and fold[other] != fold[t]:
                s = pad(other)
                for i in range(urlfilter.ORDER, len(s)):
                    for k in range(urlfilter.ORDER + 1):
                        counts[rejected][("n", s[i - k : i + 1])] += 1
                        counts[rejected][("c", k, s[i - k : i])] += 1
        s, total = pad(t), 0.0
        for i in range(urlfilter.ORDER, len(s)):
            logs = []
            for c in counts:
                p = 1 / 256
                for k in range(urlfilter.ORDER + 1):
                    p = (c[("n", s[i - k : i + 1])] + urlfilter.BETA * p) / (c[("c", k, s[i - k : i])] + urlfilter.BETA)
                logs.append(math.log(p))
            total += logs[0] - logs[1]
        return total / (len(s) - urlfilter.ORDER)

    assert max(abs(score(got[i].host + got[i].path) - got[i].score) for i in [*range(10), *range(10, len(urls), 29)] if got[i].score is not None) < 1e-9
    # A verdict that differs from the list: the host has a seed word, but the model finds the rest like accepted URLs.
    more = spark.createDataFrame([(1000, "https://win.blog1.river.example.org/en/3", "", "x"), (1001, None, "", "x"), (None, "http://blog1.river.example.org/en/3", "", "x"), (1002, "http://blog1.river.example.org/en/" + "9" * 30_000, "", "x")], pages.schema)
    beyond = {r.page_id: r for r in urlfilter.judge(pages.union(more).union(more)).collect()}
    assert beyond[1000].verdict == "allow" and beyond[1000].rejected
    assert beyond[1001].verdict == beyond[None].verdict == beyond[1002].verdict == "allow"
    assert urlfilter.judge(pages.where("false")).count() == 0


def test_neighbours(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(20, 16))
    vectors = [(i, (centres[i % 20] + 0.4 * rng.normal(size=16)).tolist()) for i in range(1500)]
    vectors += [(2000 + i, [1.0] * 16) for i in range(400)]  # copies
    vectors += [(3000, None), (3001, [0.0] * 16), (3002, [float("nan")] * 16), (3003, [None] * 16), (3004, [1.0]), (3005, [2.0]), (None, [1.0] * 16), (0, vectors[0][1])]
    rows = spark.createDataFrame([(i, v, 1) for i, v in vectors], "vec_id long, embedding array<double>, rank int")
    own = {i: np.array(v) for i, v in vectors[:1900]}
    index = neighbours.build_index(rows, shard=700)
    asked = neighbours.usable(rows).where("vec_id % 50 = 0").dropDuplicates(["vec_id"])
    got = defaultdict(list)
    for r in neighbours.search(index, asked).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.score, r.vec_id))
    assert set(got) == {i for i in own if i % 50 == 0}
    hits, total = 0, 0
    for q, found in got.items():
        exact = sorted((float(np.sqrt(((own[q] - v) ** 2).sum())), i) for i, v in own.items() if i != q)[:10]
        assert found == sorted(found) and all(abs(s - np.sqrt(((own[q] - own[i]) ** 2).sum())) < 1e-12 for s, i in found)
        hits += len({i for _, i in found} & {i for _, i in exact})
        total += 10
    assert hits / total >= 0.95
    short = [(r.query_id, r.vec_id, r.score) for r in neighbours.search(index, neighbours.usable(rows).where("vec_id >= 3000")).collect()]
    assert sorted(short) == [(3004, 3005, 1.0), (3005, 3004, 1.0)]  # lengths don't mix
    assert [i for _, i in got[2000]] == list(range(2001, 2011))  # ties go to the smaller ids
    assert neighbours.search(neighbours.build_index(rows.where("false")), asked.where("false")).count() == 0


def test_pipeline_stages(spark, awkward, tmp_path):
    import corpus_pipeline

    folder = str(tmp_path)
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    docs = awkward
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, stage(spark, docs, folder)
        docs.write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        if name != "packing":
            assert docs.columns == awkward.columns
        if name == "jaccard":
            kept = [r.doc_id for r in docs.collect()]
            assert 107 in kept and 108 not in kept and 200 not in kept and 5 in kept and len([k for k in kept if k is not None]) == len({k for k in kept if k is not None})
    assert docs.count() and before.count()
