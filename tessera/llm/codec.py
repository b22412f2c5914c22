"""Byte-level BPE to ids and back: many words are merged at once, as flat arrays of symbols."""

from __future__ import annotations

import functools
import json
import re
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bpe import _byte_alphabet, tokenizer, without_category
from .common import table

VOCABULARY = "byte_bpe_50k.json"
#: Characters of text that a worker encodes at once, and of one text that are split at once.
GROUP_CHARS = 1_000_000
#: Distinct pre-tokens that a worker remembers from batch to batch; beyond it the memory starts anew.
REMEMBERED = 400_000
#: Pre-tokens of more symbols are merged by neighbourhoods instead of one lowest pair a round.
LONG = 256
_NONE = np.int64(1) << 62
#: Ids that are turned into bytes at once.
STEP = 100_000


def merge_rounds(symbols: np.ndarray, starts: np.ndarray, codec: Codec) -> tuple[np.ndarray, np.ndarray]:
    """(ids, starts) of words, given as the ids of their single bytes; no word is empty.

    A round merges, in every word, all places of the word's lowest-ranked pair, the left one first where they overlap.
    """
    n = len(starts)
    done: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    words, sizes = np.arange(n), np.diff(np.append(starts, len(symbols)))
    rank = codec.ranks(symbols, starts)
    while len(words):
        starts = np.cumsum(sizes) - sizes
        least = np.minimum.reduceat(rank, starts)
        over = least == _NONE
        if over.any():  # these words are ready
            of = np.repeat(over, sizes)
            done.append((words[over], sizes[over], symbols[of]))
            symbols, rank, words, sizes, least = symbols[~of], rank[~of], words[~over], sizes[~over], least[~over]
            continue
        pick = rank == np.repeat(least, sizes)
        if (sizes > LONG).any():
            pick |= _safe(rank, codec.longest) & np.repeat(sizes > LONG, sizes)
        at = np.flatnonzero(pick)
        new_run = np.concatenate(([True], (at[1:] != at[:-1] + 1) | (rank[at[1:]] != rank[at[:-1]])))
        begins = np.flatnonzero(new_run)
        offset = np.arange(len(at)) - np.repeat(begins, np.diff(np.append(begins, len(at))))
        at = at[offset % 2 == 0]
        symbols[at] = codec.merged[rank[at]]
        keep = np.ones(len(symbols), bool)
        keep[at + 1] = False
        sizes = sizes - np.bincount(np.searchsorted(starts, at, "right") - 1, minlength=len(sizes))
        place = (np.cumsum(keep) - 1)[at]
        symbols, rank = symbols[keep], rank[keep]
        ends = np.cumsum(sizes) - 1
        last = np.zeros(len(symbols), bool)
        last[ends] = True
        stale = np.zeros(len(symbols), bool)
        stale[place] = stale[place[place > 0] - 1] = True
        rank[stale] = _NONE
        stale = np.flatnonzero(stale & ~last)
        rank[stale] = codec.rank_of(symbols[stale], symbols[stale + 1])
    order = np.argsort(np.concatenate([w for w, _, _ in done])) if done else np.array([], np.int64)
    flat = np.concatenate([s for _, _, s in done]) if done else symbols
    sizes = np.concatenate([s for _, s, _ in done]) if done else sizes
    begin = (np.cumsum(sizes) - sizes)[order]
    sizes = sizes[order]
    starts = np.cumsum(sizes) - sizes
    return flat[np.repeat(begin - starts, sizes) + np.arange(len(flat))], starts


def _safe(rank: np.ndarray, reach: int) -> np.ndarray:
    """Pairs that nothing within reach can come before.

    Only a token that is made of lower-ranked pairs could take a pair's symbol away, and it spans at most ``reach`` of
    them. Overlapping pairs of one rank are merged from the left, so a run of them is safe as a whole or not at all.
    """
    wide, low = 1, np.concatenate((np.full(reach, _NONE), rank, np.full(reach, _NONE)))
    while 2 * wide <= 2 * reach + 1:
        low = np.minimum(low[:-wide], low[wide:])
        wide *= 2
    rest = 2 * reach + 1 - wide
    low = np.minimum(low[: len(low) - rest], low[rest:]) if rest else low
    safe = (rank == low) & (rank < _NONE)
    begins = np.flatnonzero(np.concatenate(([True], rank[1:] != rank[:-1])))
    lengths = np.diff(np.append(begins, len(rank)))
    return np.repeat(np.logical_and.reduceat(safe, begins), lengths)


class Codec:
    """Encodes and decodes with the vocabulary, merges and special tokens of a tokenizer file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            data = json.load(f)
        vocabulary = data["model"]["vocab"]
        alphabet = _byte_alphabet()
        self.byte_ids = np.zeros(256, np.int64)
        for c, b in alphabet.items():
            self.byte_ids[b] = vocabulary[c]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in data["model"]["merges"]]
        left, right = (np.array([vocabulary[p[k]] for p in pairs], np.int64) for k in (0, 1))
        self.merged = np.array([vocabulary[a + b] for a, b in pairs], np.int64)  # by rank
        keys = left << 32 | right
        self.by_key = np.argsort(keys, kind="stable")
        self.keys = keys[self.by_key]
        self.special = {t["content"]: t["id"] for t in data["added_tokens"]}
        self.cut = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        content = {i: bytes(alphabet[c] for c in t) if all(c in alphabet for c in t) else t.encode() for t, i in vocabulary.items()}
        content |= {i: t.encode() for t, i in self.special.items()}
        listed = [content.get(i, b"") for i in range(max(content) + 1)]
        self.sizes = np.array([len(x) for x in listed], np.int64)
        self.offsets = np.cumsum(self.sizes) - self.sizes
        self.bytes = np.frombuffer(b"".join(listed), np.uint8)
        self.longest = int(self.sizes[self.merged].max()) if len(self.merged) else 1
        self.pieces = regex.compile(public_tokenizers.PATTERN)
        #: Characters without a category here: libraries differ on them, so the tokenizer itself splits such texts.
        self.odd = without_category()
        self.splitter = tokenizer(path).pre_tokenizer
        self.safe_cut = re.compile(r"(?<=[^\s]) (?=[A-Za-z0-9])")
        self.known: dict[str, bytes] = {}
        self.odd_words: set[str] = set()

    def _is_odd(self, text: str) -> bool:
        return not text.isascii() and bool(self.odd[np.frombuffer(text.encode("utf-32-le"), "<u4")].any())

    def rank_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left << 32 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.by_key[at], _NONE)

    def ranks(self, symbols: np.ndarray, starts: np.ndarray) -> np.ndarray:
        out = np.full(len(symbols), _NONE)
        out[:-1] = self.rank_of(symbols[:-1], symbols[1:])
        out[starts[1:] - 1] = _NONE
        return out

    def _split(self, text: str) -> Iterator[tuple[list[str], set[str]]]:
        """The pre-tokens of a text without special tokens, in lists of bounded length, and those of them that aren't remembered. A space between words always begins a pre-token."""
        at = 0
        while at < len(text):
            cut = self.safe_cut.search(text, at + GROUP_CHARS) if len(text) - at > GROUP_CHARS else None
            end = cut.start() if cut else len(text)
            part, at = text[at:end], end
            pieces = self.pieces.findall(part)
            fresh = set(pieces).difference(self.known)
            if not self.odd_words.isdisjoint(pieces) or self._is_odd("".join(fresh)):
                pieces = [part[i:j] for _, (i, j) in self.splitter.pre_tokenize_str(part)]
                fresh = set(pieces).difference(self.known)
                self.odd_words.update(filter(self._is_odd, fresh))
            yield pieces, fresh

    def _learn(self, words: list[str]) -> None:
        raw = [w.encode() for w in words]
        sizes = np.array([len(x) for x in raw], np.int64)
        ids, starts = merge_rounds(self.byte_ids[np.frombuffer(b"".join(raw), np.uint8)], np.cumsum(sizes) - sizes, self)
        flat, ends = ids.astype("<u4").tobytes(), np.append(starts[1:], len(ids)) * 4
        self.known.update(zip(words, (flat[a:b] for a, b in zip((starts * 4).tolist(), ends.tolist(), strict=True)), strict=True))

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        out: list[list[bytes]] = [[] for _ in texts]
        waiting: list[tuple[list[bytes], list[str]]] = []
        fresh: set[str] = set()
        chars = 0

        def flush() -> None:
            nonlocal chars
            if len(self.known) + len(fresh) > REMEMBERED:
                self.known.clear()
                fresh.update(w for _, pieces in waiting for w in pieces)
                self.odd_words = {w for w in self.odd_words if w in fresh}
            if fresh:
                self._learn(list(fresh))
            for to, pieces in waiting:
                to.append(b"".join(map(self.known.__getitem__, pieces)))
            waiting.clear()
            fresh.clear()
            chars = 0

        def plain(to: list[bytes], text: str) -> None:
            nonlocal chars
            for pieces, new in self._split(text):
                waiting.append((to, pieces))
                fresh.update(new)
                chars += len(text)
                if chars >= GROUP_CHARS:
                    flush()

        for to, text in zip(out, texts, strict=True):
            at, text = 0, text or ""
            for m in self.cut.finditer(text) if self.cut else ():
                plain(to, text[at : m.start()])
                flush()
                to.append(self.special[m.group()].to_bytes(4, "little"))
                at = m.end()
            plain(to, text[at:] if at else text)
        flush()
        return [b"".join(x) for x in out]

    def _bytes_of(self, ids: np.ndarray, sizes: np.ndarray) -> bytes:
        stops = np.cumsum(sizes)
        return self.bytes[np.repeat(self.offsets[ids] - (stops - sizes), sizes) + np.arange(stops[-1])].tobytes()

    def decode(self, ids: np.ndarray, ends: np.ndarray) -> list[str]:
        """The text of each run of ids; bytes that aren't UTF-8 become replacement characters, ids of no token nothing."""
        ids = ids.astype(np.int64)
        ids = np.where((ids >= 0) & (ids < len(self.sizes)), ids, -1)
        sizes = np.where(ids < 0, 0, self.sizes[ids])
        flat = b"".join(self._bytes_of(ids[a : a + STEP], sizes[a : a + STEP]) for a in range(0, len(ids), STEP))
        stops = np.append(0, np.cumsum(sizes))[np.append(0, ends)].tolist()
        return [flat[a:b].decode(errors="replace") for a, b in zip(stops[:-1], stops[1:], strict=True)]


@functools.cache
def codec(path: str) -> Codec:
    """One a worker process, so that tasks share what it remembers."""
    return Codec(path)


def _regrouped(batches, column: str, size, use):
    """Record batches with the columns that ``use`` makes of each group of rows whose ``column`` has bounded size."""
    for batch in batches:
        sizes = np.cumsum(size(batch.column(column)))
        at = 0
        while at < batch.num_rows:
            most = (sizes[at - 1] if at else 0) + GROUP_CHARS
            end = max(at + 1, int(np.searchsorted(sizes, most, "right")))
            yield use(batch.slice(at, end - at))
            at = end


def _with(batch: pa.RecordBatch, name: str, values: pa.Array) -> pa.RecordBatch:
    keep = [c for c in batch.schema.names if c != name]
    return pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], values], names=[*keep, name])


def _schema(df: DataFrame, name: str, kind: T.DataType) -> T.StructType:
    return T.StructType([f for f in df.schema if f.name != name] + [T.StructField(name, kind)])


def encode(df: DataFrame, text: str = "text", into: str = "ids", packed: bool = False, vocabulary: str | None = None) -> DataFrame:
    """df with the token ids of each whole text in a column ``into``: an array of integers or, if ``packed``, their little-endian unsigned 32-bit bytes.

    Null and empty texts have no ids. Strings of special tokens inside a text count as the library does by default: as
    that one token. No token is added, cut off or padded. Repeated rows are encoded alike, an empty table stays empty, a
    column called ``into`` is replaced, others pass through.
    """
    path = vocabulary or public_tokenizers.path(VOCABULARY)

    def run(batches):
        def use(batch):
            ids = codec(path).encode(batch.column(text).to_pylist())
            if packed:
                return _with(batch, into, pa.array(ids, pa.binary()))
            ends = np.cumsum([0, *map(len, ids)]) // 4
            return _with(batch, into, pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(ids), "<i4"))))

        return _regrouped(batches, text, lambda c: np.array(c.fill_null("").to_pandas().str.len(), np.int64), use)

    return df.mapInArrow(run, _schema(df, into, T.BinaryType() if packed else T.ArrayType(T.IntegerType())))


def decode(df: DataFrame, ids: str = "ids", into: str = "decoded", vocabulary: str | None = None) -> DataFrame:
    """df with the text of the token ids in ``ids`` (array of integers, or packed bytes) in a column ``into``.

    Null ids give an empty text, ids of no token and null elements nothing, special tokens their string, bytes that
    aren't UTF-8 replacement characters. Repeated rows are decoded alike, an empty table stays empty, a column called
    ``into`` is replaced, others pass through.
    """
    path = vocabulary or public_tokenizers.path(VOCABULARY)
    packed = isinstance(df.schema[ids].dataType, T.BinaryType)

    def run(batches):
        def size(column):
            return np.array([len(x) // 4 if x else 0 for x in column.to_pylist()], np.int64) if packed else np.array(column.value_lengths().fill_null(0), np.int64)

        def use(batch):
            column = batch.column(ids)
            sizes = size(column)
            if packed:
                flat = np.frombuffer(b"".join((x or b"")[: len(x or b"") // 4 * 4] for x in column.to_pylist()), "<u4")
            else:
                flat = np.array(column.flatten().fill_null(-1), np.int64)
            return _with(batch, into, pa.array(codec(path).decode(flat, np.cumsum(sizes)), pa.string()))

        return _regrouped(batches, ids, size, use)

    return df.mapInArrow(run, _schema(df, into, T.StringType()))


def op13_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = encode(table(spark, sf_dir, "documents").select("doc_id", "text"), packed=True).select("doc_id", "ids")
    return decode(texts).select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
