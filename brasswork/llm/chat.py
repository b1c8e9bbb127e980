"""Chat formatting (operator 8): budgeted, turn-aligned windows with a loss mask.

A conversation's turns are written as `<|im_start|>role`, a line end, the text and `<|im_end|>`, a line end. Prefix
sums of the turns' tokens choose windows: each new turn goes to the current window while the budget lasts; a new
window starts with the system turn again (if it takes at most half of the budget) and with the latest turns before it
that fit into `history` of the budget. Repeated turns are context: they carry no loss. Loss is on the texts of
assistant turns in the one window that has them as new turns. A turn larger than the budget gets a window of its own.

Control strings inside roles and texts get a backslash after their first character, and those that already have some
there get one more; taking one away again gives the original, whatever it was.

A conversation is streamed turn by turn in its own order, so memory is bounded by a window, not by a conversation.
Turns with the same number follow by role and text. Defined results: null text or role is empty; a null conv_id is a
conversation of its own; a null turn comes first; repeated rows are turns of their own; an empty table gives no rows;
other columns don't matter.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _shared, _tokens

BUDGET = 2048
HISTORY = 0.25
OPEN, CLOSE = "<|im_start|>", "<|im_end|>"

# Control strings of common chat formats.
CONTROL = ("<|im_start|>", "<|im_end|>", "<|endoftext|>", "<|startoftext|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")

_PLAIN = re.compile("|".join(rf"{re.escape(c[0])}(?P<b{i}>\\*){re.escape(c[1:])}" for i, c in enumerate(CONTROL)))


def escape(text: str) -> str:
    """Break every control string in `text`, reversibly."""
    return _PLAIN.sub(lambda m: m[0][0] + "\\" + m[0][1:], text)


def unescape(text: str) -> str:
    """Undo `escape`."""
    return _PLAIN.sub(lambda m: m[0][0] + m[0][2:] if m[0][1] == "\\" else m[0], text)


def _role_out(role: str) -> str:
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def _role_in(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role), flags=re.S)


WINDOW = "conv_id long, window_no int, first_new int, n_turns int, text string, turn_tokens array<int>, loss array<struct<start:int,end:int>>"


class _Windows:
    """The windows of one conversation, made while its turns stream in."""

    def __init__(self, conv_id: int | None, budget: int, history: float):
        self.conv_id, self.budget, self.room = conv_id, budget, int(budget * history)
        self.system: tuple[str, str, int] | None = None
        self.repeated: list[tuple[str, str, int]] = []
        self.new: list[tuple[str, str, int]] = []
        self.tokens, self.number, self.turns, self.led = 0, 0, 0, False

    def add(self, role: str, text: str, tokens: int) -> tuple | None:
        """Take the next turn; a window that it closes comes back."""
        done = None
        if self.new and self.tokens + tokens > self.budget:
            done = self.row()
            self._next(tokens)
        if self.turns == 0 and role == "system" and tokens <= self.budget // 2:
            self.system = (role, text, tokens)
        self.new.append((role, text, tokens))
        self.tokens += tokens
        self.turns += 1
        return done

    def _next(self, tokens: int) -> None:
        before = self.repeated + self.new
        if self.led or self.system and self.number == 0:  # the system turn leads the window
            before = before[1:]
        used = self.system[2] if self.system and self.system[2] + tokens <= self.budget else 0
        head = [self.system] if used else []
        most = min(self.room, self.budget - used - tokens)
        kept, held = [], 0
        for turn in reversed(before):  # a suffix of the prefix sums
            if held + turn[2] > most:
                break
            kept.append(turn)
            held += turn[2]
        self.repeated, self.new = head + kept[::-1], []
        self.tokens, self.led = used + held, bool(head)
        self.number += 1

    def row(self) -> tuple:
        parts, loss, at = [], [], 0
        for k, (role, text, _) in enumerate(self.repeated + self.new):
            body = escape(text)
            head = f"{OPEN}{_role_out(role)}\n"
            if role == "assistant" and k >= len(self.repeated) and body:
                loss.append((at + len(head), at + len(head) + len(body)))
            parts.append(head + body + CLOSE + "\n")
            at += len(parts[-1])
        return self.conv_id, self.number, len(self.repeated), len(self.repeated) + len(self.new), "".join(parts), [t[2] for t in self.repeated + self.new], loss


def windows(turns: DataFrame, tokenizer: str | None = None, budget: int = BUDGET, history: float = HISTORY) -> DataFrame:
    """Format (conv_id, turn, role, text) rows; one row per window, those of a conversation in a row and in order.

    `first_new` turns at a window's start are repeated; `loss` has the character spans of `text` that carry loss.
    """
    tokenizer = tokenizer or _tokens.default_path()
    names = [c.split()[0] for c in WINDOW.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc, current, rows, size = _tokens.encoder(tokenizer), None, [], 0
        for b in batches:
            for conv_id, role, text in zip(b["conv_id"], b["role"], b["text"]):
                conv_id = None if pd.isna(conv_id) else int(conv_id)
                if current is None or current.conv_id != conv_id:
                    if current is not None:
                        rows.append(current.row())
                    current = _Windows(conv_id, budget, history)
                tokens = len(enc.encode(text)) // enc.dtype.itemsize
                done = current.add(role, text, tokens + 4)  # two markers, role and line end
                if done:
                    rows.append(done)
                if len(rows) >= 2000:
                    yield _frame(rows, names)
                    rows = []
        if current is not None:
            rows.append(current.row())
        if rows:
            yield _frame(rows, names)

    _shared.ship(turns.sparkSession)
    kept = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), _shared.text_or_empty("role").alias("role"), _shared.text_or_empty().alias("text"))
    return _shared.in_pandas(kept.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text"), run, WINDOW)


def _frame(rows: list[tuple], names: list[str]) -> pd.DataFrame:
    out = _table(rows, names)
    out["loss"] = [[{"start": a, "end": e} for a, e in x] for x in out["loss"]]
    return out


def _table(rows: list[tuple], names: list[str]) -> pd.DataFrame:
    """Rows that begin with a conv_id, or null, as pandas: the ids apart, which floats would round."""
    out = pd.DataFrame([r[1:] for r in rows], columns=names[1:])
    out.insert(0, names[0], pd.array([r[0] for r in rows], dtype="Int64"))
    return out


_TURN = re.compile(re.escape(OPEN) + r"([^\n]*)\n(.*?)" + re.escape(CLOSE) + "\n", re.S)

DIGEST = "conv_id long, n_turns int, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def read_back(formatted: DataFrame) -> DataFrame:
    """Parse the windows of `windows` (rows of a conversation still in a row): turns, loss and length of each conversation."""
    names = [c.split()[0] for c in DIGEST.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        state, started = None, False
        for b in batches:
            rows = []
            for conv_id, number, first, text, loss in zip(b["conv_id"], b["window_no"], b["first_new"], b["text"], b["loss"]):
                conv_id = None if pd.isna(conv_id) else int(conv_id)
                if number == 0:
                    if started:
                        rows.append(_digest(state))
                    state, started = [conv_id, 0, hashlib.sha256(), 0, hashlib.sha256(), 0], True
                for k, m in enumerate(_TURN.finditer(text)):
                    if k >= first:
                        state[1] += 1
                        state[2].update(f"{_role_in(m[1])}\n{unescape(m[2])}\n".encode("utf-8", "surrogatepass"))
                for span in loss:
                    said = unescape(text[span["start"] : span["end"]])
                    state[3] += len(said)
                    state[4].update(said.encode("utf-8", "surrogatepass"))
                state[5] += len(text)
            if rows:
                yield _table(rows, names)
        if started:
            yield _table([_digest(state)], names)

    return _shared.in_pandas(formatted.select("conv_id", "window_no", "first_new", "text", "loss"), run, DIGEST)


def _digest(state: list) -> tuple:
    return state[0], state[1], state[2].hexdigest(), state[3], state[4].hexdigest(), state[5]


def op8_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    turns = _shared.table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(more)
    out = read_back(windows(turns))
    return out.withColumn("n_turns", F.col("n_turns").cast("long"))
