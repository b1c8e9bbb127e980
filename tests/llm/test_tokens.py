"""The encoder's ids and its work for each word."""

from __future__ import annotations

import random

import numpy as np

from brasswork.llm import _tokens


class Counted(dict):
    """Counts its lookups."""

    asked = 0

    def get(self, key, default=None):
        Counted.asked += 1
        return super().get(key, default)

    def __getitem__(self, key):
        Counted.asked += 1
        return super().__getitem__(key)

    def __contains__(self, key):
        Counted.asked += 1
        return super().__contains__(key)


def test_ids_and_lookups(monkeypatch):
    monkeypatch.setattr(_tokens, "MEMO_WORDS", 50)
    rng = random.Random(1)
    encoder = _tokens.Encoder(_tokens.default_path())
    words = ["".join(rng.choice("abcdeXYZäß'é,.7!<>|") for _ in range(rng.randrange(1, 9))) for _ in range(400)]
    words += ["don't", "we'LL", "<|endoftext|>", "x<s>y", "ﬁ", "İx", " ", "é", "Straße", "東京", "\x1c", "ſ"]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randrange(60))) + rng.choice(["", "\n", "\t x"]) for _ in range(60)]
    whole = encoder.tokenizer.encode_batch(texts, add_special_tokens=False)
    assert [np.frombuffer(encoder.encode(t), encoder.dtype).tolist() for t in texts] == [e.ids for e in whole]

    encoder.memo = Counted({"": b""})  # each word of a text is looked up once, a new one once more
    encoder.encode("known")
    Counted.asked = 0
    encoder.encode(" ".join(["known"] * 1000 + ["new"]))
    encoder.encode(" ".join(["known"] * 1000 + ["newer"]))
    assert Counted.asked <= 2002 + 3
