"""Chat formatting in budgeted windows: prefix sums of turn tokens choose turn-aligned spans, the system turn stays, limited history is repeated, repeated targets are masked."""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterable, Iterator
from itertools import accumulate

import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import whole_token_counter
from .common import table

BUDGET, HISTORY = 1024, 256
VOCABULARY = "byte_bpe_50k.json"
TARGET, SYSTEM = "assistant", "system"

TURN, END = "<|turn|>", "<|end|>\n"
#: Heads and tails of control strings, this template's and others'; a text's own ones get a backslash between the two.
_CONTROL = re.compile(r"([<\[])(\\*)(?=\||/?s>|</?SYS>>|/?INST\])")
_ESCAPED = re.compile(r"([<\[])\\(\\*)(?=\||/?s>|</?SYS>>|/?INST\])")
_PARSED = re.compile(r"<\|turn\|>([^\n]*)\n(.*?)<\|end\|>\n", re.S)

WINDOWS = {"window": "int", "text": "string", "loss": "array<struct<start:long,end:long>>", "n_repeated": "int", "n_turns": "int", "n_tokens": "long"}
_LOSS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def escape(text: str) -> str:
    return _CONTROL.sub(r"\1\\\2", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1\2", text)


def turn_parts(role: str, text: str) -> tuple[str, str, str]:
    """What stands before the text, the text, and what follows it; joined they are the turn."""
    return f"{TURN}{escape(role.replace('\\', '\\\\').replace(chr(10), '\\n'))}\n", escape(text), END


def parse(formatted: str) -> Iterator[tuple[str, str]]:
    back = {"\\\\": "\\", "\\n": "\n"}
    for role, text in _PARSED.findall(formatted):
        yield re.sub(r"\\[\\n]", lambda m: back[m[0]], unescape(role)), unescape(text)


class _Turn:
    __slots__ = ("before", "role", "text", "tokens")

    def __init__(self, role: str, before: str, text: str, tokens: int):
        self.role, self.before, self.text, self.tokens = role, before, text, tokens


class Windows:
    """The windows of one conversation, fed turn by turn; what it holds is one window at most."""

    def __init__(self, budget: int, history: int):
        self.budget, self.history = budget, history
        self.system: _Turn | None = None
        self.repeated: list[_Turn] = []
        self.new: list[_Turn] = []
        self.used = self.number = self.seen = 0

    def add(self, turn: _Turn) -> Iterator[dict]:
        if self.new and self.used + turn.tokens > self.budget:
            yield self.close()
            self._begin(turn.tokens)
        if not self.seen and turn.role == SYSTEM:
            self.system = turn
        self.seen += 1
        self.new.append(turn)
        self.used += turn.tokens

    def _begin(self, needed: int) -> None:
        """The next window repeats the system turn and then as much of the end of the last one as history and budget allow."""
        last = [t for t in [*self.repeated, *self.new] if t is not self.system]
        fixed = self.system.tokens if self.system else 0
        room = min(self.history, self.budget - fixed - needed)
        sums = [0, *accumulate(t.tokens for t in last)]
        kept = last[bisect_left(sums, sums[-1] - max(0, room)) :]
        self.repeated = ([self.system] if self.system else []) + kept
        self.new, self.used = [], fixed + sum(t.tokens for t in kept)

    def close(self) -> dict:
        at, out, loss = 0, [], []
        for k, t in enumerate([*self.repeated, *self.new]):
            whole = f"{t.before}{t.text}{END}"
            if k >= len(self.repeated) and t.role == TARGET:
                begin = at + len(t.before)
                loss.append({"start": begin, "end": begin + len(t.text)})
            at += len(whole)
            out.append(whole)
        row = {"window": self.number, "text": "".join(out), "loss": loss, "n_repeated": len(self.repeated), "n_turns": len(self.new), "n_tokens": self.used}
        self.number += 1
        return row


def _beside(key: str, made: Iterable[str]) -> list[str]:
    """The names of made columns, with an underscore before one that the key is called like."""
    return [f"_{n}" if n == key else n for n in made]


def _flushed(key: str, kind: pa.DataType, rows: list[tuple[object, dict]]) -> pa.RecordBatch:
    of = lambda n: [r[n] for _, r in rows]
    kinds = (pa.int32(), pa.string(), _LOSS, pa.int32(), pa.int32(), pa.int64())
    made = [pa.array(of(n), k) for n, k in zip(WINDOWS, kinds, strict=True)]
    return pa.RecordBatch.from_arrays([pa.array([k for k, _ in rows], kind), *made], names=[key, *_beside(key, WINDOWS)])


def format_chat(df: DataFrame, conversation: str = "conv_id", order: str = "turn", role: str = "role", text: str = "text", budget: int = BUDGET, history: int = HISTORY, vocabulary: str | None = None) -> DataFrame:
    """One row a window: conversation, window, text, loss, n_repeated, n_turns, n_tokens, in order within a partition.

    ``loss`` are the code-point ranges of the window's new assistant texts; the first n_repeated turns repeat the
    system turn and history and are outside it, so each assistant text is a target once. A window is within ``budget``
    tokens unless the system turn and one turn alone exceed it: turns are never cut. Turns are read as a sorted stream
    and a task holds one window at a time, so a conversation may have any number of turns. Null texts and roles are
    empty; null conversations are one conversation; turns of equal order follow by role and text, repeated rows are
    all kept; an empty table gives an empty result; other columns are not returned. Where the conversation's column is
    called like a made one, the made one gets an underscore before its name. One conversation is one task, however long:
    its windows follow from each other.
    """
    path = vocabulary or public_tokenizers.path(VOCABULARY)
    rows = df.select(F.col(conversation).alias("c"), F.col(order).alias("o"), F.coalesce(F.col(role), F.lit("")).alias("r"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    kind = df.schema[conversation].dataType.simpleString()
    rows = rows.repartition("c").sortWithinPartitions("c", "o", "r", "t").select("c", "r", "t")

    def run(batches):
        count = whole_token_counter(path)
        windows: Windows | None = None
        now, c_type, out, size = None, None, [], 0
        for batch in batches:
            c_type = batch.column("c").type
            ids, roles = batch.column("c").to_pylist(), batch.column("r").to_pylist()
            parts = [turn_parts(r, t) for r, t in zip(roles, batch.column("t").to_pylist(), strict=True)]
            tokens = count(["".join(p) for p in parts])
            for c, r, (before, body, _), n in zip(ids, roles, parts, tokens, strict=True):
                if windows is None or c != now:
                    if windows is not None:
                        out.append((now, windows.close()))
                    windows, now = Windows(budget, history), c
                for row in windows.add(_Turn(r, before, body, n)):
                    out.append((now, row))
                    size += len(row["text"])
                if len(out) >= 1000 or size > 1 << 23:
                    yield _flushed(conversation, c_type, out)
                    out, size = [], 0
        if windows is not None:
            out.append((now, windows.close()))
            yield _flushed(conversation, c_type, out)

    made = ", ".join(f"{n} {k}" for n, k in zip(_beside(conversation, WINDOWS), WINDOWS.values(), strict=True))
    return rows.mapInArrow(run, f"`{conversation}` {kind}, {made}")


def digests(windows: Iterable[tuple[object, str, list[dict], int]]) -> Iterator[tuple[object, int, str, int, str, int]]:
    """From the windows of conversations in order: what they say, read back from their texts."""
    now, state, begun = None, None, False
    for c, text, loss, repeated in windows:
        if not begun or c != now:
            if begun:
                yield now, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4]
            now, state, begun = c, [0, hashlib.sha256(), 0, hashlib.sha256(), 0], True
        for k, (role, said) in enumerate(parse(text)):
            if k >= repeated:
                state[0] += 1
                state[1].update(f"{role}\n{said}\n".encode("utf-8", "surrogatepass"))
        for span in loss:
            said = unescape(text[span["start"] : span["end"]])
            state[2] += len(said)
            state[3].update(said.encode("utf-8", "surrogatepass"))
        state[4] += len(text)
    if begun:
        yield now, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4]


def read_back(windows: DataFrame, conversation: str = "conv_id") -> DataFrame:
    """One row a conversation from windows as ``format_chat`` returns them, in its order."""
    kind = windows.schema[conversation].dataType.simpleString()

    def run(batches):
        c_type = []

        def rows():
            for b in batches:
                c_type.append(b.column(0).type)
                yield from zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)

        found = []

        def batch():
            kinds = [c_type[0], pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*found, strict=True), kinds, strict=True)], names=[conversation, "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

        for row in digests(rows()):
            found.append(row)
            if len(found) == 5000:
                yield batch()
                found = []
        if found:
            yield batch()

    return windows.select(conversation, "text", "loss", "n_repeated").mapInArrow(run, f"`{conversation}` {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def op8_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, TARGET, said)], "conv_id long, turn long, role string, text string")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").union(more)
    return read_back(format_chat(rows))
