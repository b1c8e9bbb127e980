"""Word shingles of many texts at once, hashed to 64 bits with numpy prefix sums."""

from __future__ import annotations

import numpy as np

_rng = np.random.default_rng(90_210)
_VALUE = _rng.integers(1, 2**63, 256, dtype=np.uint64)
#: A-Z count as a-z.
_VALUE[65:91] = _VALUE[97:123]
_BLANK = np.zeros(256, dtype=bool)
_BLANK[[32, *range(9, 14)]] = True
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))
_STEP = np.uint64(0xD1342543DE82EF95)
_STARTED = np.uint64(0x632BE59BD9B4E019)
#: Bytes that are hashed at once.
CHUNK = 600_000
_powers: list[np.ndarray] = []


def _powers_to(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        size = max(n, 1 << 16)
        up, down = np.full(size, _BASE), np.full(size, _INVERSE)
        up[0] = down[0] = 1
        _powers[:] = [np.multiply.accumulate(up), np.multiply.accumulate(down)]
    return _powers[0], _powers[1]


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads all bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _words(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, first byte and end of each word."""
    raw = np.frombuffer(data, dtype=np.uint8)
    word = np.zeros(len(raw) + 2, dtype=np.int8)
    word[1:-1] = ~_BLANK[raw]
    turn = np.diff(word)
    start, end = np.flatnonzero(turn == 1), np.flatnonzero(turn == -1)
    if not len(start):
        return np.zeros(0, dtype=np.uint64), start, end
    up, down = _powers_to(len(raw) + 1)
    sums = np.zeros(len(raw) + 1, dtype=np.uint64)
    np.cumsum(_VALUE[raw] * up[: len(raw)], out=sums[1:])
    return mixed((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64)), start, end


def shingles(texts: list[str], width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all shingles in text order (repeats included), and where each text's begin (one more for the end).

    A text with fewer words than `width` has one shingle, of all its words; one without words has none.
    """
    parts, counts = [], []
    encoded = [t.encode("utf-8", "surrogatepass") for t in texts]
    low = 0
    while low < len(encoded):
        high, size = low, 0
        while high < len(encoded) and (high == low or size + len(encoded[high]) < CHUNK):
            size += len(encoded[high]) + 1
            high += 1
        group = encoded[low:high]
        hashes, start, _ = _words(b" ".join(group))
        edges = np.cumsum([0] + [len(g) + 1 for g in group])
        at = np.searchsorted(start, edges)
        n = np.diff(at)
        made = np.where(n >= width, n - width + 1, np.minimum(n, 1))
        run = np.full(max(0, len(hashes) - width + 1), _STARTED)
        for k in range(width):
            run = mixed(run * _STEP + hashes[k : k + len(run)])
        owner = np.repeat(np.arange(len(group)), made)
        inside = np.arange(len(owner)) - np.repeat(np.cumsum(made) - made, made)
        place = at[:-1][owner] + inside
        out = np.zeros(len(owner), dtype=np.uint64)
        long = n[owner] >= width
        out[long] = run[place[long]]
        for j in np.flatnonzero(~long):
            h = _STARTED + np.uint64(n[owner[j]])
            h = np.array([h])
            for w in hashes[at[owner[j]] : at[owner[j] + 1]]:
                h = mixed(h * _STEP + w)
            out[j] = h[0]
        parts.append(out)
        counts.append(made)
        low = high
    hashes = np.concatenate(parts) if parts else np.zeros(0, dtype=np.uint64)
    counts = np.concatenate(counts) if counts else np.zeros(0, dtype=np.int64)
    return hashes, np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)
