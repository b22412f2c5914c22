"""Lexical retrieval packing: documents in an order of lexical closeness are cut into shards, and in each shard a BM25 inverted index with the statistics of the whole corpus ranks, for a seed document, the unused neighbours that fill its window."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import islice
from typing import NamedTuple

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bpe import word_ids
from .common import stored, table

WINDOW, END = 2048, 1
VOCABULARY = "word_bpe_49k.json"
#: Tokens of a shard, each document counting ``DOC_TOKENS`` more; a task works through many shards, one at a time.
SHARD_TOKENS, DOC_TOKENS = 1 << 21, 8
#: Bytes of text that a task orders and packs, on average.
TASK_BYTES = 32 << 20
K1, B = 1.2, 0.75
#: How many of the best unused neighbours are tried for one that fits whole before the best is cut at the window's end.
AHEAD = 24
#: A term in at least one of so many documents of a shard has a row of weights instead of postings.
DENSE = 8
GROUP_CHARS = 1_000_000
#: Documents, at most about, from which the directions of closeness are learned; and those directions.
LEARNED, DIRECTIONS = 2_000, 8
#: Bits of the place along the last direction; with the sides of all directions there are at most 2 ** (DIRECTIONS + FINE) keys.
FINE = 12
#: Rows of one key are spread along the key's share of the order in so many steps.
SPREAD = 1 << 20

PIECES = "start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class Corpus(NamedTuple):
    """What BM25 needs of a whole corpus: idf by term, mean length."""

    idf: np.ndarray
    mean: float

    @classmethod
    def of(cls, df: np.ndarray, n: int, tokens: int) -> Corpus:
        return cls(np.log1p((n - df + 0.5) / (df + 0.5)), tokens / max(1, n))

    def weigh(self, term: np.ndarray, tf: np.ndarray, length) -> np.ndarray:
        return (self.idf[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / self.mean))).astype(np.float32)


class ShardIndex:
    """BM25 weights by term over the distinct documents of one shard, all in flat arrays; without ``corpus`` these documents are all there are."""

    def __init__(self, docs: list[np.ndarray], corpus: Corpus | None = None):
        numbers: dict[bytes, int] = {}
        self.which = np.array([numbers.setdefault(d.tobytes(), len(numbers)) for d in docs])
        self.members = np.argsort(self.which, kind="stable")
        n = self.n = len(numbers)
        self.member_at = np.searchsorted(self.which[self.members], np.arange(n + 1))
        distinct = [docs[k] for k in self.members[self.member_at[:-1]]]
        lengths = np.array([len(d) for d in distinct])
        top = max(int(d.max()) for d in distinct) + 1
        keys = np.repeat(np.arange(n) * top, lengths)
        keys += np.concatenate(distinct)
        keys.sort()
        first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
        tf = np.diff(np.append(first, len(keys)))
        doc, term = keys[first] // top, keys[first] % top
        if corpus is None:
            copies = np.diff(self.member_at)
            corpus = Corpus.of(np.bincount(term, copies[doc], top), len(docs), int((lengths * copies).sum()))
        weight = corpus.weigh(term, tf, lengths[doc])
        self.doc_at, self.doc_terms = np.searchsorted(doc, np.arange(n + 1)), term
        order = np.argsort(term, kind="stable")
        self.term_at = np.concatenate(([0], np.cumsum(np.bincount(term, minlength=top))))
        self.docs, self.weights = doc[order], weight[order]
        many = np.flatnonzero(np.diff(self.term_at) * DENSE >= n)
        self.row = np.full(top, -1)
        self.row[many] = np.arange(len(many))
        self.dense = np.zeros((len(many), n), np.float32)
        at = self.row[term] >= 0
        self.dense[self.row[term[at]], doc[at]] = weight[at]

    def scores(self, seed: int) -> np.ndarray:
        """The exact score of each distinct document for all terms of the seed."""
        own = self.which[seed]
        terms = self.doc_terms[self.doc_at[own] : self.doc_at[own + 1]]
        row = self.row[terms]
        asked = np.zeros(len(self.dense), np.float32)
        asked[row[row >= 0]] = 1
        total = (asked @ self.dense).astype(np.float64)
        spans = [slice(a, b) for a, b in zip(self.term_at[terms[row < 0]].tolist(), self.term_at[terms[row < 0] + 1].tolist(), strict=True)]
        if spans:
            total += np.bincount(np.concatenate([self.docs[s] for s in spans]), np.concatenate([self.weights[s] for s in spans]), self.n)
        return total

    def neighbours(self, seed: int, free: np.ndarray) -> Iterator[int]:
        """All free documents that share terms with the seed, best first, ties by position; ``free`` may change on the way."""
        score = self.scores(seed)
        score[np.bincount(self.which, free, self.n) == 0] = 0
        best = min(4 * AHEAD, self.n)
        least = np.partition(score, -best)[-best]
        for some in (np.flatnonzero(score >= max(least, 1e-300)), np.flatnonzero((score < least) & (score > 0))):
            for g in some[np.argsort(-score[some], kind="stable")].tolist():
                for d in self.members[self.member_at[g] : self.member_at[g + 1]].tolist():
                    if free[d]:
                        yield d


def pack(docs: list[np.ndarray], window: int = WINDOW, corpus: Corpus | None = None) -> list[tuple[int, int, int, int, int]]:
    """(document, start, length, sequence, offset) of each piece. Every sequence but the last is full.

    The window's seed is the document that was cut at its start, or the next unused one. Neighbours go in best first,
    of the ``AHEAD`` best unused ones those that fit whole before others; if none does, the best is cut, and its rest
    seeds the next window.
    """
    if not docs:
        return []
    index = ShardIndex(docs, corpus)
    free = np.ones(len(docs), np.float32)
    sizes = [len(d) for d in docs]
    out: list[tuple[int, int, int, int, int]] = []
    sequence, filled, following = 0, 0, 0
    seed, start = 0, 0

    def put(doc: int, begin: int) -> int:
        """Places a document's ids from begin on in this window, as many as fit; returns where they end."""
        nonlocal filled
        free[doc] = 0
        take = min(sizes[doc] - begin, window - filled)
        out.append((doc, begin, take, sequence, filled))
        filled += take
        return begin + take

    while True:
        end = put(seed, start)
        cut = (seed, end) if end < sizes[seed] else None
        ranked = index.neighbours(seed, free) if filled < window else iter(())
        ahead = list(islice(ranked, AHEAD))
        while filled < window and cut is None:
            if not ahead:
                while following < len(docs) and not free[following]:
                    following += 1
                if following == len(docs):
                    return out
                ahead = [following]
            fits = next((d for d in ahead if sizes[d] <= window - filled), ahead[0])
            ahead.remove(fits)
            end = put(fits, 0)
            if end < sizes[fits]:
                cut = (fits, end)
            ahead += islice(ranked, AHEAD - len(ahead))
        sequence, filled = sequence + 1, 0
        if cut is None:
            while following < len(docs) and not free[following]:
                following += 1
            if following == len(docs):
                return out
            cut = (following, 0)
        seed, start = cut


class Closeness(NamedTuple):
    """Term by direction, and where each direction is halved."""

    along: np.ndarray
    middle: np.ndarray

    @classmethod
    def learned(cls, docs: list[np.ndarray], size: int) -> Closeness:
        """The leading right singular vectors of a sample's idf-weighted term vectors, by one step of subspace iteration."""
        docs, along = [d for d in docs if len(d)], np.zeros((size, DIRECTIONS), np.float32)
        if not docs:
            return cls(along, np.zeros(DIRECTIONS, np.float32))
        owner = np.repeat(np.arange(len(docs)), [len(d) for d in docs])
        pairs, tf = np.unique(owner * size + np.concatenate(docs), return_counts=True)
        owner, term = pairs // size, pairs % size
        df = np.bincount(term, minlength=size)
        idf = np.log1p(len(docs) / (df + 1.0))
        weight = tf * idf[term]
        weight = weight / np.sqrt(np.bincount(owner, weight**2))[owner]
        start = np.random.default_rng(0).standard_normal((size, 3 * DIRECTIONS))
        q = np.linalg.qr(np.stack([np.bincount(owner, weight * start[term, j], len(docs)) for j in range(start.shape[1])], axis=1))[0]
        back = np.stack([np.bincount(term, weight * q[owner, j], size) for j in range(q.shape[1])])
        axes = np.linalg.svd(back, full_matrices=False)[2][:DIRECTIONS].T
        along[:, : axes.shape[1]] = axes * idf[:, None]
        free = cls(along, np.zeros(DIRECTIONS, np.float32))
        return cls(along, np.median(free.places(docs), axis=0).astype(np.float32))

    def places(self, docs: list[np.ndarray]) -> np.ndarray:
        """Where each document lies; equal documents lie at the same place."""
        pairs = [np.ascontiguousarray(p).view(np.complex64).ravel() for p in np.split(self.along, DIRECTIONS // 2, axis=1)]  # two directions in one look-up
        found = np.array([[p.take(d).sum() for p in pairs] for d in docs], np.complex64).reshape(len(docs), len(pairs)).view(np.float32)
        return found / np.maximum(1e-9, np.sqrt((found**2).sum(axis=1, keepdims=True)))

    def keys(self, docs: list[np.ndarray]) -> np.ndarray:
        """A number by which lexically close documents are near each other: on which side of each direction's middle a document lies, then how far along the last."""
        x = self.places(docs)
        key = np.zeros(len(docs), np.int64)
        for j in range(x.shape[1]):
            key = key * 2 + (x[:, j] > self.middle[j])
        return (key << FINE) + np.clip((x[:, -1] + 1) * (1 << FINE) / 2, 0, (1 << FINE) - 1).astype(np.int64)


def tokenized(df: DataFrame, text: str, vocabulary: str, close: Closeness) -> DataFrame:
    """df, its text replaced by ``_ids``, token ids and the end mark as little-endian bytes, ``_key``, its place in the order of closeness, and ``_n``, how many ids."""
    schema = T.StructType([f for f in df.schema if f.name != text] + [T.StructField("_ids", T.BinaryType()), T.StructField("_key", T.LongType()), T.StructField("_n", T.LongType())])
    shared = df.sparkSession.sparkContext.broadcast(close)

    def run(batches):
        ids = word_ids(vocabulary)
        end = np.array([END], ids.kind).tobytes()

        def made(batch):
            found = [x + end for x in ids(batch.column(text).to_pylist())]
            docs = [np.frombuffer(x, ids.kind) for x in found]
            keep = [c for c in batch.schema.names if c != text]
            made = [pa.array(found, pa.binary()), pa.array(shared.value.keys(docs)), pa.array([len(d) for d in docs], pa.int64())]
            return pa.RecordBatch.from_arrays([batch.column(c) for c in keep] + made, names=[*keep, "_ids", "_key", "_n"])

        for batch in batches:
            start, chars = 0, 0
            for k, t in enumerate(batch.column(text)):
                chars += len(t.as_py() or "")
                if chars > GROUP_CHARS:
                    yield made(batch.slice(start, k + 1 - start))
                    start, chars = k + 1, 0
            if start < batch.num_rows:
                yield made(batch.slice(start))

    return df.mapInArrow(run, schema)


def corpus_statistics(ids: DataFrame, kind: str) -> Corpus:
    """Document frequencies, count and mean length over all rows; the vocabulary bounds what comes to the driver."""

    def count(batches):
        df, n, tokens = np.zeros(0, np.int32), 0, 0
        there = np.zeros(np.iinfo(kind).max + 1 if kind == "<u2" else 1 << 20, np.int8)
        for batch in batches:
            for x in batch.column("_ids"):
                terms = np.frombuffer(x.as_buffer(), kind)
                n, tokens, top = n + 1, tokens + len(terms), int(terms.max()) + 1
                if top > len(df):
                    df = np.append(df, np.zeros(top - len(df), np.int64))
                there[: len(df)] = 0
                there[terms] = 1
                df += there[: len(df)]
        k = np.flatnonzero(df)
        yield pa.RecordBatch.from_pydict({"k": np.append(k, [-1, -2]), "c": np.append(df[k], [n, tokens])})

    found = {r["k"]: r["c"] for r in ids.select("_ids").mapInArrow(count, "k long, c long").groupBy("k").agg(F.sum("c").alias("c")).collect()}
    n, tokens = found.pop(-1, 0), found.pop(-2, 0)
    df = np.zeros(max(found, default=0) + 1, np.int64)
    df[list(found)] = list(found.values())
    return Corpus.of(df, n, tokens)


def in_shards(ids: DataFrame, shard_tokens: int) -> tuple[DataFrame, int]:
    """ids(_id, _ids, _key, _n) with ``_shard``, and the number of shards: equal stretches of the order of closeness, cut at exact borders.

    The sizes of all keys before a row's own say where its key begins; the rows of a key, however many, are spread
    along its share by a hash of id and text. A row's shard thus depends on the table alone, not on how it is partitioned.
    """
    keys = stored(ids.groupBy("_key").agg(F.sum(F.col("_n") + DOC_TOKENS).alias("_size")), "packing-keys")
    side = F.shiftright("_key", FINE).cast("int")
    begins, total = [0] * (1 << DIRECTIONS), 0
    for r in sorted(keys.groupBy(side.alias("side")).agg(F.sum("_size").alias("size")).collect()):
        begins[r["side"]] = total
        total += r["size"]
    shards = max(1, -(-total // shard_tokens))
    earlier = F.sum("_size").over(Window.partitionBy(side).orderBy("_key").rowsBetween(Window.unboundedPreceding, -1))
    begin = F.element_at(F.array(*map(F.lit, begins)).cast("array<double>"), side + 1) + F.coalesce(earlier, F.lit(0))
    places = keys.select("_key", "_size", begin.alias("_begin"))
    along = F.pmod(F.xxhash64("_id", "_ids"), F.lit(SPREAD)) / SPREAD
    shard = F.least(F.floor((F.col("_begin") + F.col("_size") * along) * shards / max(1, total)), F.lit(shards - 1))
    return ids.join(F.broadcast(places), "_key").select("_id", "_ids", "_key", shard.alias("_shard")), shards  # at most 2 ** (DIRECTIONS + FINE) keys


def pack_documents(df: DataFrame, text: str = "text", id: str = "doc_id", window: int = WINDOW, vocabulary: str | None = None, shard_tokens: int = SHARD_TOKENS, task_bytes: int = TASK_BYTES) -> DataFrame:
    """One row a piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Rows are put in an order of lexical closeness, whose directions are learned from about ``LEARNED`` rows, drawn by a
    hash. The order is cut into equal shards of at most about ``shard_tokens``, which are dealt to tasks; copies lie
    beside each other and fill as many shards as they need. BM25 statistics are those of all rows, scores are exact over
    all terms, and a seed's neighbours are looked for in its own shard, all of it. Only a shard's last sequence is short.
    Shards, and the order in them, follow from keys, ids and texts, so a table gives the same pieces however it is
    partitioned and however many tasks pack it. Null and empty texts are the end mark alone. Repeated rows are packed
    each; other columns are not returned; an empty table gives an empty result.
    """
    path = vocabulary or public_tokenizers.path(VOCABULARY)
    words = word_ids(path)
    kind = words.kind
    size, n = df.agg(F.coalesce(F.sum(F.octet_length(text)), F.lit(0)) + 4 * F.count("*"), F.count("*")).first()
    rows = df.select(F.col(id).alias("_id"), F.col(text).alias("_text"))
    spread = 1 << 30
    drawn = rows.filter(F.pmod(F.xxhash64("_id", "_text"), F.lit(spread)) < min(spread, int(spread * LEARNED / max(1, n)) + 1))
    sample = sorted(r["_text"] or "" for r in drawn.select("_text").distinct().toLocalIterator())
    close = Closeness.learned([np.frombuffer(x, kind) for x in words(sample)], len(words.ends))
    ids = stored(tokenized(rows, "_text", path, close), "packing-ids")
    shared = df.sparkSession.sparkContext.broadcast(corpus_statistics(ids, kind))
    id_type = df.schema[id].dataType.simpleString()
    dealt, shards = in_shards(ids, shard_tokens)
    tasks = max(1, min(shards, -(-size // task_bytes)))
    order = ["_shard", "_key", "_id", F.xxhash64("_ids")]
    ordered = dealt.repartitionById(tasks, F.pmod("_shard", F.lit(tasks)).cast("int")).sortWithinPartitions(*order)

    def packed(names: list, docs: list[np.ndarray], shard: int) -> pa.RecordBatch:
        doc, start, length, sequence, offset = (np.array(c, np.int64) for c in zip(*pack(docs, window, shared.value), strict=True))
        crc = [zlib.crc32(docs[d][a : a + n].astype("<u4").tobytes()) for d, a, n in zip(doc.tolist(), start.tolist(), length.tolist(), strict=True)]
        return pa.RecordBatch.from_pydict({
            id: pa.concat_arrays(names).take(pa.array(doc)),
            "start": start,
            "length": length,
            "ids_crc32": np.array(crc, np.int64),
            "doc_tokens": np.array([len(d) for d in docs], np.int64)[doc],
            "sequence_id": sequence + (shard << 32),
            "offset": offset,
        })

    def run(batches):
        names, docs, now = [], [], None
        for batch in batches:
            shard = batch.column("_shard").to_numpy(zero_copy_only=False)
            cuts = [0, *(np.flatnonzero(shard[1:] != shard[:-1]) + 1).tolist(), batch.num_rows]
            for at, end in zip(cuts[:-1], cuts[1:], strict=True):
                if at == end:
                    continue
                if docs and shard[at] != now:
                    yield packed(names, docs, now)
                    names, docs = [], []
                now = int(shard[at])
                names.append(batch.column("_id").slice(at, end - at))
                docs += [np.frombuffer(x.as_py(), kind) for x in batch.column("_ids").slice(at, end - at)]
        if docs:
            yield packed(names, docs, now)

    return ordered.select("_id", "_ids", "_shard").mapInArrow(run, f"`{id}` {id_type}, {PIECES}")


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))
