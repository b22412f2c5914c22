"""Byte-pair token ids and counts by pre-token: each distinct pre-token is encoded once and looked up afterwards."""

from __future__ import annotations

import functools
import re
import sys
import unicodedata

import numpy as np
import public_tokenizers
import regex
from tokenizers import Tokenizer, normalizers, pre_tokenizers

#: Distinct pre-tokens that a worker remembers from task to task; beyond it the memory starts anew.
REMEMBERED = 400_000
#: Distinct words whose ids a worker remembers, likewise.
WORDS = 700_000


def tokenizer(path: str) -> Tokenizer:
    found = Tokenizer.from_file(path)
    found.no_truncation()
    found.no_padding()
    return found


class WholeTokenCounter:
    """Counts byte-level BPE tokens. A pre-token in ``whole`` is one token; only the rest is merged."""

    def __init__(self, path: str):
        import json

        self.library = tokenizer(path)
        with open(path, encoding="utf-8") as f:
            data = json.load(f)
        self.special = [t["content"] for t in data["added_tokens"]]
        self.whole = self._proved(data["model"]["vocab"])
        self.count = dict.fromkeys(self.whole, 1)
        self.pieces = regex.compile(public_tokenizers.PATTERN)
        self.cut = re.compile("|".join(map(re.escape, self.special))) if self.special else None
        #: Characters without a category here: libraries split them differently, so the library counts such texts itself.
        self.odd = without_category()

    def _proved(self, vocabulary: dict[str, int]) -> list[str]:
        """The vocabulary strings that the library encodes, alone, as exactly their own token."""
        alphabet = _byte_alphabet()
        texts, ids = [], []
        for token, number in vocabulary.items():
            try:
                texts.append(bytes(alphabet[c] for c in token).decode())
                ids.append(number)
            except (KeyError, UnicodeDecodeError):
                continue
        return [t for t, n, e in zip(texts, ids, self.library.encode_batch_fast(texts, add_special_tokens=False), strict=True) if e.ids == [n]]

    def __call__(self, texts: list[str | None]) -> list[int]:
        split = []
        missing: set[str] = set()
        known = self.count
        if len(known) > len(self.whole) + REMEMBERED:
            known = self.count = dict.fromkeys(self.whole, 1)
        for t in texts:
            parts, n = [t or ""], 0
            if t and not t.isascii() and self.odd[np.frombuffer(t.encode("utf-32-le", "surrogatepass"), "<u4")].any():
                split.append((len(self.library.encode_batch_fast([t], add_special_tokens=False)[0].ids), []))
                continue
            if self.cut and self.cut.search(t or ""):
                n = len(self.cut.findall(t))
                parts = self.cut.split(t)
            found = [x for p in parts for x in self.pieces.findall(p)]
            missing.update(x for x in found if x not in known)
            split.append((n, found))
        if missing:
            rest = list(missing)
            for k in range(0, len(rest), 10_000):
                part = rest[k : k + 10_000]
                known.update(zip(part, map(len, self.library.encode_batch_fast(part, add_special_tokens=False)), strict=True))
        return [n + sum(map(known.__getitem__, found)) for n, found in split]


@functools.cache
def without_category() -> np.ndarray:
    """Whether each code point is one that Unicode, as known here, has not assigned."""
    return np.array([unicodedata.category(chr(c)) == "Cn" for c in range(sys.maxunicode + 1)])


def _byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(other)}


_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F], np.uint64)
_LOW = np.array([(1 << (8 * k)) - 1 for k in range(9)], np.uint64)
_SPACE, _LETTER, _NUMBER, _OTHER = range(4)


class WordTable:
    """Words of up to 16 bytes to numbers, many at once: the bytes themselves are the key, in an open-addressing table of flat arrays."""

    def __init__(self, most: int):
        self.bits = (2 * most).bit_length()
        self.rows = np.zeros((1 << self.bits, 3), np.uint64)  # both halves of the word, number + 1

    def find(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number or -1, the place where the word is or would go) of words (n x 2)."""
        with np.errstate(over="ignore"):
            mixed = (words[:, 0] ^ (words[:, 1] * _MIX[1])) * _MIX[0]
            mixed = (mixed ^ (mixed >> np.uint64(32))) * _MIX[1]
        place = (mixed >> np.uint64(64 - self.bits)).astype(np.int64)
        there = self.rows[place]
        number = there[:, 2].astype(np.int64) - 1
        at = np.flatnonzero((number >= 0) & ((there[:, 0] != words[:, 0]) | (there[:, 1] != words[:, 1])))
        while len(at):
            place[at] = (place[at] + 1) & ((1 << self.bits) - 1)
            there = self.rows[place[at]]
            number[at] = there[:, 2].astype(np.int64) - 1
            at = at[(there[:, 2] > 0) & (there[:, :2] != words[at]).any(axis=1)]
        return number, place

    def add(self, words: np.ndarray, first: int) -> None:
        """Enters distinct words that aren't in the table, with numbers from first on."""
        left = np.arange(len(words))
        while len(left):
            place = self.find(words[left])[1]
            one = np.unique(place, return_index=True)[1]  # of those that go to one place the others look on
            self.rows[place[one], :2] = words[left[one]]
            self.rows[place[one], 2] = (first + left[one] + 1).astype(np.uint64)
            left = np.delete(left, one)


class WordIds:
    """Ids of a word-level BPE (lower case, white space dropped) as little-endian bytes.

    Words are independent in this vocabulary, so a text's ids are those of its words, joined; each distinct word is
    encoded once. Latin-1 texts are cut as arrays of bytes, the way the vocabulary's own pattern cuts them: runs of
    letters, single digits, runs of other characters, and English contractions. Texts with other characters, with
    control characters that libraries class differently, or with special tokens go to the library whole.
    """

    ODD = re.compile(r"[^\x01-\x1b\x20-\x84\x86-\xff]")
    #: Bytes of text that are cut at once, and of a word that the table holds.
    SLICE, LONGEST = 1 << 18, 16

    def __init__(self, path: str):
        self.library = tokenizer(path)
        special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.special = re.compile("|".join(map(re.escape, special))) if special else None
        self.kind = "<u2" if self.library.get_vocab_size(with_added_tokens=True) <= 1 << 16 else "<u4"
        vocabulary = self.library.get_vocab()
        #: Whether an id ends a word.
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        #: The library's merges without its normaliser and pattern, for words that are already cut and lower-cased.
        self.merges = tokenizer(path)
        self.merges.normalizer = normalizers.Sequence([])
        self.merges.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        characters = [chr(c) for c in range(256)]
        self.lower = "".join(c.lower() for c in characters).encode("latin-1")
        self.classes = np.array([_SPACE if c.isspace() else {"L": _LETTER, "N": _NUMBER}.get(unicodedata.category(c)[0], _OTHER) for c in characters], np.uint8)
        self._forget()

    def _forget(self) -> None:
        self.table, self.long = WordTable(WORDS + self.SLICE), {}
        self.flat, self.starts = np.array([], self.kind), np.array([0], np.int64)

    def _learn(self, fresh: list[bytes]) -> None:
        """Encodes words together, which get the next numbers: the last id of a word, and no other, has the end-of-word mark."""
        flats, lengths = [self.flat], []
        for i in range(0, len(fresh), 5_000):
            part = [w.decode("latin-1") for w in fresh[i : i + 5_000]]
            ids = np.array(self.merges.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, self.kind)
            ends = np.flatnonzero(self.ends[ids]) + 1
            if len(ends) != len(part):
                each = [np.array(e.ids, self.kind) for e in self.library.encode_batch_fast(part, add_special_tokens=False)]
                ids, ends = np.concatenate(each), np.cumsum([len(x) for x in each])
            flats.append(ids)
            lengths.append(np.diff(ends, prepend=0))
        self.flat = np.concatenate(flats)
        self.starts = np.concatenate((self.starts, self.starts[-1] + np.cumsum(np.concatenate(lengths))))

    def _cut(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(beginning, end) of each word of lower-case bytes that end in white space."""
        kind = self.classes[data]
        change = kind[1:] != kind[:-1]
        begins = np.concatenate(([True], change | (kind[1:] == _NUMBER))) & (kind != _SPACE)
        quote = np.flatnonzero((data == ord("'")) & begins)
        if len(quote):
            one, two = data[quote + 1], data[np.minimum(quote + 2, len(data) - 1)]
            short = np.isin(one, np.frombuffer(b"stmd", np.uint8))
            long = ((two == ord("e")) & ((one == ord("r")) | (one == ord("v")))) | ((one == ord("l")) & (two == ord("l")))
            begins[quote[short | long] + 1] = False
            rest = np.concatenate((quote[short] + 2, quote[long] + 3))
            begins[rest[kind[rest] != _SPACE]] = True
        begin = np.flatnonzero(begins)
        stops = np.flatnonzero(np.concatenate((change & (kind[1:] == _SPACE), [False]))) + 1  # where white space begins
        following = np.append(begin[1:], len(data))
        stop = np.append(stops, len(data))[np.searchsorted(stops, begin, "right")]
        return begin, np.minimum(following, stop)

    def _numbers(self, data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The number of each word; new ones are learned."""
        size = end - begin
        wide = np.lib.stride_tricks.as_strided(np.append(data, np.zeros(16, np.uint8)), (len(data) + 8, 8), (1, 1))
        words = np.stack([np.ascontiguousarray(wide[np.minimum(begin + 8 * k, len(data))]).view("<u8").ravel() & _LOW[np.clip(size - 8 * k, 0, 8)] for k in (0, 1)], axis=1)
        number, place = self.table.find(words)
        wrong = size > self.LONGEST
        missing = np.flatnonzero((number < 0) & ~wrong)
        if len(missing):
            some = missing[np.unique(place[missing], return_index=True)[1]]
            while len(some):  # one word a place; those that share a place with another come next
                first = len(self.starts) - 1
                self._learn([data[a:b].tobytes() for a, b in zip(begin[some].tolist(), end[some].tolist(), strict=True)])
                self.table.add(words[some], first)
                number[missing], place[missing] = self.table.find(words[missing])
                missing = missing[number[missing] < 0]
                some = missing[np.unique(place[missing], return_index=True)[1]]
        long = [(k, data[begin[k] : end[k]].tobytes()) for k in np.flatnonzero(wrong).tolist()]
        if fresh := list(dict.fromkeys(w for _, w in long if w not in self.long)):
            self.long.update(zip(fresh, range(len(self.starts) - 1, len(self.starts) - 1 + len(fresh)), strict=True))
            self._learn(fresh)
        for k, w in long:
            number[k] = self.long[w]
        return number

    def _encode(self, parts: list[bytes]) -> list[bytes]:
        """Ids of each part of lower-case bytes."""
        if len(self.starts) > WORDS:
            self._forget()
        data = np.frombuffer(b" ".join(parts) + b" ", np.uint8)
        begin, end = self._cut(data)
        number = self._numbers(data, begin, end)
        lengths = self.starts[number + 1] - self.starts[number]
        ends = np.concatenate(([0], np.cumsum(lengths)))
        flat = self.flat[np.repeat(self.starts[number] - ends[:-1], lengths) + np.arange(ends[-1])].tobytes()
        stops = ends[np.searchsorted(begin, np.cumsum([len(x) + 1 for x in parts]))] * self.flat.itemsize
        return [flat[a:b] for a, b in zip([0, *stops[:-1].tolist()], stops.tolist(), strict=True)]

    def __call__(self, texts: list[str | None]) -> list[bytes]:
        out: list[bytes] = [b""] * len(texts)
        whole: list[int] = []
        owners: list[int] = []
        parts: list[bytes] = []
        held = 0

        def flush() -> None:
            nonlocal owners, parts, held
            for k, ids in zip(owners, self._encode(parts) if parts else [], strict=True):
                out[k] += ids
            owners, parts, held = [], [], 0

        for k, t in enumerate(texts):
            if not t:
                continue
            if self.ODD.search(t) or (self.special and self.special.search(t)):
                whole.append(k)
                continue
            data, at = t.encode("latin-1").translate(self.lower), 0
            while at < len(data):
                cut = data.find(b" ", at + self.SLICE)
                cut = len(data) if cut < 0 else cut
                owners.append(k)
                parts.append(data[at:cut])
                held, at = held + cut - at, cut
                if held >= self.SLICE:
                    flush()
        flush()
        for k in whole:
            out[k] = np.array(self.library.encode_batch_fast([texts[k]], add_special_tokens=False)[0].ids, self.kind).tobytes()
        return out


@functools.cache
def whole_token_counter(path: str) -> WholeTokenCounter:
    """One a worker process, so that tasks share what it remembers."""
    return WholeTokenCounter(path)


@functools.cache
def word_ids(path: str) -> WordIds:
    """One a worker process, so that tasks share what it remembers."""
    return WordIds(path)
