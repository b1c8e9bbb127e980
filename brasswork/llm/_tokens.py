"""Token ids from the vocabulary files of public tokenizers, with a word memo in each Python worker."""

from __future__ import annotations

import json
import os
import re
from array import array

import numpy as np

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: Words kept by a worker's memo. The frequent ones come early; a full memo takes no more, which changes speed only.
MEMO_WORDS = 150_000

# The splitter of the vocabulary whose words go to the library's model directly.
KNOWN_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Words on whose lower case, composed form and letter classes all Unicode versions agree: printable ASCII, Latin-1 letters.
_PLAIN = re.compile(r"[!-~À-ÖØ-öø-ÿ]+")
#: KNOWN_SPLIT for such words in lower case.
_PIECES = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^\sa-z0-9ß-öø-ÿ]+")


def _byte_letters() -> list[str]:
    """The letter that byte-level vocabularies write for each byte: printable ones themselves, the rest from U+0100 on."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b if b in own else next(rest)) for b in range(256)]

_encoders: dict[str, "Encoder"] = {}


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _drops_space(spec: dict) -> bool:
    """True if ids of a text are the ids of its blank-separated parts in a row.

    That holds for a normaliser that works on single characters and runs of white space, and a splitter that throws
    white space away and whose pieces never span it.
    """
    steps = (spec.get("normalizer") or {}).get("normalizers", [])
    parts = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])
    spaces = any(s["type"] == "Replace" and s["pattern"] == {"Regex": "\\s+"} for s in steps)
    others = all(s["type"] in ("NFC", "Lowercase", "Replace") for s in steps)
    split = bool(parts) and parts[0]["type"] == "Split" and parts[0]["behavior"] == "Removed" and parts[0]["invert"]
    blind = all(p["type"] != "ByteLevel" or not (p["add_prefix_space"] or p["use_regex"]) for p in parts)
    plain = not spec.get("post_processor") and not any(t["lstrip"] or t["rstrip"] for t in spec.get("added_tokens", []))
    return spaces and others and split and blind and plain and "[^\\s" in json.dumps(parts[0]["pattern"]).replace("\\\\", "\\")


class Encoder:
    """Encodes whole texts with the tokenizers library (no special tokens are added).

    If the tokenizer drops white space, each distinct word is encoded by the library once and remembered.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.by_word = _drops_space(spec)
        self.direct = self.by_word and spec["pre_tokenizer"]["pretokenizers"][0]["pattern"] == {"Regex": KNOWN_SPLIT}
        self.direct = self.direct and spec["pre_tokenizer"]["pretokenizers"][1:] == [{"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]
        marks = [t["content"] for t in spec.get("added_tokens", [])]
        self.marked = re.compile("|".join(map(re.escape, marks)) or "(?!)").search
        self.letters_only = not any(m.isalpha() for m in marks)
        self.letters = dict(enumerate(_byte_letters()))
        self.dtype = np.dtype("<u2") if self.tokenizer.get_vocab_size(with_added_tokens=True) <= 65_536 else np.dtype("<u4")
        self.code = {2: "H", 4: "I"}[self.dtype.itemsize]
        self.memo: dict[str, bytes] = {"": b""}
        self.pieces: dict[str, bytes] = {}

    def _ids(self, texts: list[str]) -> list[bytes]:
        kind = self.dtype
        return [np.array(e.ids, dtype=kind).tobytes() for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]

    def _piece(self, piece: str) -> bytes:
        """Ids of one piece of a plain word, in lower case."""
        ids = self.pieces.get(piece)
        if ids is None:
            plain = piece if piece.isascii() else piece.encode().decode("latin-1").translate(self.letters)
            ids = array(self.code, [t.id for t in self.tokenizer.model.tokenize(plain)]).tobytes()
            if len(self.pieces) < MEMO_WORDS:
                self.pieces[piece] = ids
        return ids

    def _word(self, word: str) -> bytes:
        """Ids of a word without blanks: from the model for plain words, else through the library's whole chain."""
        if not self.direct:
            return self._ids([word])[0]
        if self.letters_only and word.isalpha() and word.isascii():  # one piece
            return self._piece(word.lower())
        if not _PLAIN.fullmatch(word) or self.marked(word):
            return self._ids([word])[0]
        return b"".join([self._piece(p) for p in _PIECES.findall(word.lower())])

    def encode(self, text: str) -> bytes:
        """Ids of one text as little-endian bytes of `dtype`."""
        if not self.by_word:
            return self._ids([text])[0]
        for blank in "\n\t\r\x0b\x0c":
            if blank in text:
                text = text.replace(blank, " ")
        words, memo = text.split(" "), self.memo
        found = list(map(memo.get, words))
        own: dict[str, bytes] = {}  # of this text, where the memo is full
        at = 0
        while True:
            try:
                at = found.index(None, at)
            except ValueError:
                return b"".join(found)
            word = words[at]
            ids = memo.get(word) or own.get(word)
            if ids is None:
                ids = self._word(word)
                (memo if len(memo) < MEMO_WORDS else own)[word] = ids
            found[at] = ids


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]
