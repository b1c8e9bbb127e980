"""Quality classifier (operator 3): co-training of a text view and a page-metadata view.

The text view sees numeric traits of a document's whole text (shares of signs, capitals, digits, repeated words and
lines, endings of words, lengths); the metadata view sees language, source and length. Two logistic regressions are
trained on a bounded sample of labelled rows (`SAMPLE`, by a hash of doc_id). In each round, each view scores all
unlabelled rows and labels the `ADDED` of each class that it is most confident of, and the *other* view learns from
them. Both views are then calibrated on held-out labelled rows (Platt), and their calibrated log-odds are combined by
a third regression on the same rows. All documents are scored; those below `CUT` are rejected.

Texts are read once, for the traits; training sees traits only. Defined results: null text is an empty text; labels
that are null or not 0/1 don't count, and several labels of a document are averaged; without two classes of labels
nothing is rejected and scores are null; a null doc_id is scored like any other; repeated rows get a row each; an
empty table gives no rows; other columns are carried along by `kept`.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _shared

#: Labelled rows that training uses at most.
SAMPLE = 20_000
ROUNDS = 5
#: A pseudo-label needs this probability, and at most so many are added a round and class.
SURE = 0.97
ADDED = 400
#: Documents with a smaller combined probability of good quality are rejected.
CUT = 0.35
LANGS, SOURCES = 16, 64

_CLASS = np.zeros(256, dtype=np.uint8)
_CLASS[[32, *range(9, 14)]] = 1
_CLASS[48:58] = 2
_CLASS[65:91] = 3
_CLASS[97:123] = 4
_CLASS[128:] = 5
_CLASS[[ord(c) for c in ".,;:'\"?()-"]] = 6
_CLASS[[ord(c) for c in "!"]] = 7
_CLASS[[ord(c) for c in "|"]] = 8
#: The rest (0): signs that prose rarely has.

_TRAITS = 18


def traits(text: str) -> list[float]:
    """Numeric traits of a whole text."""
    raw = text.encode("utf-8", "surrogatepass")
    n = max(1, len(raw))
    share = np.bincount(_CLASS[np.frombuffer(raw, dtype=np.uint8)], minlength=9) / n
    words = text.split()
    k = max(1, len(words))
    lines = [x for x in text.split("\n") if x]
    distinct = len(set(words)) / k
    again = sum(a == b for a, b in zip(words, words[1:])) / k
    odd = sum(not w[-1].isalnum() and w[-1] not in ".,;:?)'\"" for w in words) / k
    upper = sum(w.isupper() and len(w) > 1 for w in words) / k
    most = 0.0
    if words:
        counts: dict[str, int] = {}
        for w in words:
            counts[w] = counts.get(w, 0) + 1
        most = max(counts.values()) / k
    return [
        share[0] * 10, share[2] * 10, share[3] * 5, share[5] * 5, share[6] * 10, share[7] * 10, share[8] * 20, share[1] * 5,
        distinct, distinct * math.log1p(k), again * 5, odd * 3, upper * 3, most * 3,
        math.log1p(len(words)), len(text) / k / 10 if k < len(text) else 1.0, math.log1p(len(lines)), 1 - len(set(lines)) / max(1, len(lines)),
    ]


def metadata(lang: str | None, source: str | None, n_chars: float | None) -> list[float]:
    """Hashed language and source, and the length, as `metadata_matrix` spreads them."""
    return [zlib.crc32((lang or "").encode()) % LANGS, zlib.crc32((source or "").encode()) % SOURCES, max(0.0, n_chars or 0.0)]


def metadata_matrix(rows: np.ndarray) -> np.ndarray:
    """One-hot language and source and length traits."""
    out = np.zeros((len(rows), LANGS + SOURCES + 3))
    at = np.arange(len(rows))
    out[at, rows[:, 0].astype(int)] = 1
    out[at, LANGS + rows[:, 1].astype(int)] = 1
    size = np.log1p(rows[:, 2])
    out[:, -3:] = np.c_[size / 5, np.maximum(0, 5 - size), np.maximum(0, size - 9)]
    return out


def _matrix(frame: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Inputs of the two views."""
    if not len(frame):
        return np.zeros((0, _TRAITS)), np.zeros((0, LANGS + SOURCES + 3))
    return np.stack(frame["traits"].to_list()).astype(float), metadata_matrix(np.stack(frame["meta"].to_list()).astype(float))


class Logistic:
    """Ridge logistic regression by Newton steps; classes weigh alike."""

    def __init__(self, ridge: float = 1.0, balanced: bool = True):
        self.ridge, self.balanced = ridge, balanced

    def fit(self, x: np.ndarray, y: np.ndarray) -> "Logistic":
        self.mean, self.scale = x.mean(axis=0), x.std(axis=0) + 1e-6
        z = np.c_[np.clip((x - self.mean) / self.scale, -8, 8), np.ones(len(x))]
        weight = np.where(y > 0.5, len(y) / max(1, 2 * (y > 0.5).sum()), len(y) / max(1, 2 * (y <= 0.5).sum())) if self.balanced else np.ones(len(y))
        self.beta = np.zeros(z.shape[1])
        ridge = np.full(z.shape[1], self.ridge)
        ridge[-1] = 1e-6
        for _ in range(30):
            p = 1 / (1 + np.exp(-np.clip(z @ self.beta, -30, 30)))
            h = (z * (weight * p * (1 - p) + 1e-9)[:, None]).T @ z + np.diag(ridge)
            step = np.linalg.solve(h, z.T @ (weight * (y - p)) - ridge * self.beta)
            self.beta += np.clip(step, -5, 5)
            if np.abs(step).max() < 1e-6:
                break
        return self

    def odds(self, x: np.ndarray) -> np.ndarray:
        z = np.c_[np.clip((x - self.mean) / self.scale, -8, 8), np.ones(len(x))]
        return np.clip(z @ self.beta, -30, 30)


def _p(odds: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-odds))


class Views:
    """The two classifiers, their calibrations and the combination."""

    def fit(self, x: tuple[np.ndarray, np.ndarray], y: np.ndarray, sure: Callable[[list[Logistic]], list[tuple[np.ndarray, np.ndarray, np.ndarray]]], rounds: int = ROUNDS) -> "Views":
        """`sure` gives, for each view's model, the unlabelled rows it is most confident of: both inputs and labels."""
        held = np.arange(len(y)) % 4 == 3
        if len(set(y[~held])) < 2 or len(set(y[held])) < 2:
            held = np.zeros(len(y), dtype=bool)
        train = [[x[v][~held], y[~held]] for v in (0, 1)]
        self.model = [Logistic().fit(*t) for t in train]
        for _ in range(rounds):
            given = sure(self.model)
            if not any(len(g[2]) for g in given):
                break
            for v, g in enumerate(given):
                other = 1 - v
                train[other][0] = np.r_[train[other][0], g[other]]
                train[other][1] = np.r_[train[other][1], g[2]]
            self.model = [Logistic().fit(*t) for t in train]
        use = held if held.any() else np.ones(len(y), dtype=bool)
        raw = [m.odds(x[v][use]) for v, m in enumerate(self.model)]
        self.platt = [Logistic(0.1, False).fit(r[:, None], y[use]) for r in raw]
        both = np.c_[self.platt[0].odds(raw[0][:, None]), self.platt[1].odds(raw[1][:, None])]
        self.joint = Logistic(0.1, False).fit(both, y[use])
        return self

    def score(self, x: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Calibrated probabilities of good quality: text view, metadata view, both."""
        odds = [c.odds(m.odds(x[v])[:, None]) for v, (m, c) in enumerate(zip(self.model, self.platt))]
        return _p(odds[0]), _p(odds[1]), _p(self.joint.odds(np.c_[odds[0], odds[1]]))


def traced(docs: DataFrame) -> DataFrame:
    """doc_id, mark (of the row), traits of text and metadata; the one pass over texts."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            n_chars = b["n_chars"].astype("float64").fillna(0)
            yield pd.DataFrame({"doc_id": b["doc_id"].astype("Int64"), "mark": b["mark"], "traits": [traits(t) for t in b["text"]], "meta": [metadata(a, s, n) for a, s, n in zip(b["lang"], b["source"], n_chars)]})

    _shared.ship(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _mark().alias("mark"), _shared.text_or_empty().alias("text"), F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"), F.col("n_chars").cast("double").alias("n_chars"))
    return _shared.in_pandas(rows, run, "doc_id long, mark long, traits array<float>, meta array<float>")


def _mark():
    return F.xxhash64("text", "lang", "source", "n_chars")


def _surest(found: DataFrame) -> DataFrame:
    """A few hundred rows with the `ADDED` surest of each view and class among them, however many tasks have left rows.

    Counts by steps of the odds, ever finer, find where the last of them is; what ties there goes by `tie`.
    """
    groups = {(v, sign): [0.0, 64.0, ADDED, 0] for v in (0, 1) for sign in (1, -1)}  # from, width, rows still needed, rows there
    mine = [(F.col("view") == v) & (F.col("sign") == sign) for v, sign in groups]
    open_ = set(groups)
    for _ in range(4):
        step = F.lit(None).cast("long")
        for own, (key, (low, width, _, _)) in zip(mine, groups.items()):
            if key in open_:
                step = F.when(own & (F.col("odds") >= low) & (F.col("odds") < low + width), F.floor((F.col("odds") - low) / (width / 1024))).otherwise(step)
        counts = found.withColumn("step", step).where("step is not null").groupBy("view", "sign", "step").count().collect()  # at most 1024 rows a group
        for key in list(open_):
            low, width, need, _ = groups[key]
            for r in sorted((r for r in counts if (r["view"], r["sign"]) == key), key=lambda r: -r["step"]):
                groups[key] = [low + r["step"] * width / 1024, width / 1024, need, r["count"]]
                if r["count"] >= need:
                    break
                need -= r["count"]
            if groups[key][3] <= 4 * groups[key][2] + 40:
                open_.discard(key)
    kept = F.lit(False)
    for own, (key, (low, _, need, there)) in zip(mine, groups.items()):
        edge = F.col("odds") >= low + groups[key][1]
        share = min(1.0, (4 * need + 40) / max(1, there))
        kept = kept | (own & (edge | ((F.col("odds") >= low) & (F.pmod("tie", F.lit(1 << 31)) <= F.lit(int(share * (1 << 31)))))))
    return found.where(kept)


def confident(pool: DataFrame) -> Callable[[list[Logistic]], list[tuple[np.ndarray, np.ndarray, np.ndarray]]]:
    """For `Views.fit`: scores all rows of `pool` (row, tie, traits, meta) and takes each row once."""
    taken: set[int] = set()

    def sure(model: list[Logistic]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        gone = np.array(sorted(taken), dtype=np.int64)
        order = ["odds", "tie", "row"]

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            best: list[pd.DataFrame] = []  # of this task: at most ADDED rows a view and class
            for b in batches:
                b = b[~np.isin(b["row"].to_numpy(), gone)]
                if not len(b):
                    continue
                x = _matrix(b)
                for v in (0, 1):
                    odds = model[v].odds(x[v])
                    for sign in (1, -1):
                        ok = _p(sign * odds) >= SURE
                        best.append(b[ok].assign(view=v, sign=sign, odds=sign * odds[ok]))
                whole = pd.concat(best).sort_values(order, ascending=[False, True, True])
                best = [whole.groupby(["view", "sign"], sort=False).head(ADDED)]
            if best:
                yield best[0][["view", "sign", "odds", "tie", "row", "traits", "meta"]]

        found = _shared.written(pool.mapInPandas(_shared.frugal(run), "view int, sign int, odds double, tie long, row long, traits array<float>, meta array<float>"), "sure")
        picks = _surest(found).toPandas().sort_values(order, ascending=[False, True, True]).groupby(["view", "sign"]).head(ADDED)
        taken.update(picks["row"].tolist())
        return [(*_matrix(own), (own["sign"] > 0).to_numpy(dtype=float)) for own in (picks[picks["view"] == v] for v in (0, 1))]

    return sure


def scores(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, rounds: int = ROUNDS, cut: float = CUT) -> DataFrame:
    """doc_id, mark, text_score, meta_score, score, keep of every row of (doc_id, text, lang, source, n_chars)."""
    rows = _shared.written(traced(docs).withColumn("row", F.monotonically_increasing_id()), "traits")
    known = labels.where("quality in (0, 1) and doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.round(F.avg("quality")).alias("y"))
    order = [F.xxhash64(F.lit("sample"), "doc_id"), "doc_id", "mark"]
    some = rows.join(known, "doc_id")
    share = (1.2 * sample + 100) / max(1, some.count())
    if share < 1:  # by the same hash as the order, so that little more than `sample` rows leave the tasks
        some = some.where(F.pmod(order[0], F.lit(1 << 31)) <= F.lit(int(share * (1 << 31))))
    labelled = some.orderBy(*order).limit(sample).select("y", "traits", "meta").toPandas()  # at most `sample` rows of short vectors
    if labelled["y"].nunique() < 2:
        none = F.lit(None).cast("double")
        return rows.select("doc_id", "mark", none.alias("text_score"), none.alias("meta_score"), none.alias("score"), F.lit(True).alias("keep"))

    pool = rows.join(known, "doc_id", "left_anti").select("row", F.xxhash64(F.lit("sample"), "doc_id").alias("tie"), "traits", "meta")
    sure = confident(_shared.written(pool, "pool"))
    views = Views().fit(_matrix(labelled), labelled["y"].to_numpy(dtype=float), sure, rounds)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                t, m, s = views.score(_matrix(b))
                yield pd.DataFrame({"doc_id": b["doc_id"].astype("Int64"), "mark": b["mark"], "text_score": t, "meta_score": m, "score": s, "keep": s >= cut})

    return _shared.in_pandas(rows, run, "doc_id long, mark long, text_score double, meta_score double, score double, keep boolean")


def kept(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The documents that aren't rejected, with all their columns."""
    mark, key, id_, of, out_key = _shared.fresh(docs, "_mark", "_key", "_id", "_of", "_out")
    out = scores(docs, labels, **options).where(~F.col("keep")).select(F.col("doc_id").alias(id_), F.col("mark").alias(of)).distinct()
    out = out.withColumn(out_key, F.xxhash64(id_, of))
    marked = docs.withColumn(mark, _mark()).withColumn(key, F.xxhash64(F.col("doc_id").cast("long"), mark))
    small = _shared.is_small(out)
    same = (F.col(key) == F.col(out_key)) & F.col("doc_id").cast("long").eqNullSafe(F.col(id_)) & (F.col(mark) == F.col(of))
    joined = marked.join(F.broadcast(out) if small else out, same, "left_anti")
    return joined.select(*docs.columns)


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scores(_shared.table(spark, sf_dir, "documents"), _shared.table(spark, sf_dir, "labels"))
    return out.select("doc_id", "text_score", "meta_score", "score", "keep")
