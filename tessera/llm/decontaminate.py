"""Benchmark decontamination: a broadcast hash set of normalised benchmark n-grams, scanned over every training window."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import free_name, stored, table

N = 13
#: Share of hit words, as a fraction one over this, from which a document is contaminated.
SHARE = 20
#: Bytes of benchmark text whose windows may be broadcast; a larger benchmark is joined.
BLOCK_BYTES = 16 << 20
#: Logarithm of the bits that say which window hashes a joined benchmark has; 64 MB of them.
FILTER_BITS = 29
#: Words whose hashes a task remembers.
REMEMBERED = 200_000

#: Lower-cases A-Z, keeps digits and every byte of a non-ASCII character, turns the rest into blanks.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)

#: What a scan adds to a row: words in all, merged half-open ranges of hit words, and the items found.
RANGES = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))


def _hits(items: DataFrame) -> T.StructType:
    return T.StructType([T.StructField("n_words", T.LongType()), T.StructField("hits", RANGES), T.StructField("items", T.ArrayType(items.schema["id"].dataType))])


def words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_FOLD).split()


class _Vocabulary(dict):
    """Word to number, from 1; words that no item has are 0."""

    def __missing__(self, word: bytes) -> int:
        return 0


class _WordHashes(dict):
    """Word to 64 bits; so many are remembered."""

    def __missing__(self, word: bytes) -> int:
        found = xxhash.xxh64_intdigest(word)
        if len(self) < REMEMBERED:
            self[word] = found
        return found


def _hash(columns: Iterable[np.ndarray]) -> np.ndarray:
    """One number for each row of some columns."""
    total: np.ndarray | None = None
    with np.errstate(over="ignore"):
        for c in columns:
            c = c.astype(np.uint64, copy=False)
            total = c if total is None else (total * _MULTIPLIER + c) ^ (total >> np.uint64(29))
    return total


class _Windows(NamedTuple):
    """Distinct windows of one length in order of their hash: where their words stand, and which items have them (from at[k] to at[k + 1])."""

    hashes: np.ndarray
    places: np.ndarray
    at: np.ndarray
    items: np.ndarray


class WindowIndex:
    """The windows of some benchmark items in flat arrays. A document position is looked up only where all its words occur in items; hash hits are verified word by word."""

    def __init__(self, items: Iterable[tuple[int, str | None]], n: int = N):
        self.vocabulary = _Vocabulary()
        self.numbers: list[int] = []
        flat: list[np.ndarray] = []
        places: dict[int, list[np.ndarray]] = defaultdict(list)
        owners: dict[int, list[np.ndarray]] = defaultdict(list)
        at = 0
        for item, text in items:
            ids = np.array([self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words(text)], np.int32)
            if size := min(n, len(ids)):
                many = len(ids) - size + 1
                places[size].append(np.arange(at, at + many, dtype=np.int32))
                owners[size].append(np.full(many, len(self.numbers), np.int32))
                self.numbers.append(item)
                flat.append(ids)
                at += len(ids)
        self.flat = np.concatenate(flat) if flat else np.array([], np.int32)
        self.windows = {size: self._sorted(size, np.concatenate(places.pop(size)), np.concatenate(owners.pop(size))) for size in sorted(places)}

    def _sorted(self, size: int, places: np.ndarray, owners: np.ndarray) -> _Windows:
        hashes = _hash(self.flat[places + k] for k in range(size))
        order = np.argsort(hashes, kind="stable").astype(np.int32)
        hashes, places, owners = hashes[order], places[order], owners[order]
        new = np.concatenate(([True], hashes[1:] != hashes[:-1]))
        for k in range(size):  # equal hashes of unequal words are told apart
            w = self.flat[places + k]
            new[1:] |= w[1:] != w[:-1]
        first = np.flatnonzero(new)
        return _Windows(hashes[first], places[first], np.append(first, len(places)).astype(np.int32), owners)

    def find(self, ids: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(length, positions, windows) of the occurrences of windows in ids; 0 is in no window."""
        run = np.concatenate(([0], np.cumsum(ids != 0)))
        for size, found in self.windows.items():
            if len(ids) < size:
                continue
            at = np.flatnonzero(run[size:] - run[:-size] == size)
            if not len(at):
                continue
            hashes = _hash(ids[at + k] for k in range(size))
            low = np.searchsorted(found.hashes, hashes)
            many = np.searchsorted(found.hashes, hashes, "right") - low
            at, ends = np.repeat(at, many), np.cumsum(many)
            window = np.arange(len(at)) + np.repeat(low - (ends - many), many)
            same = np.ones(len(at), bool)
            for k in range(size):
                same &= ids[at + k] == self.flat[found.places[window] + k]
            if same.any():
                yield size, at[same], window[same]

    def having(self, size: int, window: int) -> list[int]:
        """The items that have a window."""
        found = self.windows[size]
        return [self.numbers[k] for k in found.items[found.at[window] : found.at[window + 1]].tolist()]


class _Block:
    """Items as they are broadcast; a worker process builds their index once."""

    def __init__(self, items: list[tuple[int, str | None]], n: int):
        self.items, self.n, self._index = items, n, None

    def index(self) -> WindowIndex:
        if self._index is None:
            self._index, self.items = WindowIndex(self.items, self.n), []
        return self._index


def _merged(ranges: Iterable[tuple[int, int]]) -> list[dict]:
    out: list[list[int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1][1] = max(b, out[-1][1])
        else:
            out.append([a, b])
    return [{"start": a, "end": b} for a, b in out]


def _scan(index: WindowIndex, texts: Iterable[str | None]) -> list[dict]:
    """Texts are scanned in groups of about a million words, held apart by a 0."""
    out: list[dict] = []
    lookup = index.vocabulary.__getitem__
    group: list[np.ndarray] = []
    starts: list[int] = []
    at = 0

    def flush() -> None:
        nonlocal group, starts, at
        first, begins = len(out) - len(starts), np.array(starts)
        hits: dict[int, list] = defaultdict(list)
        seen: dict[int, set] = defaultdict(set)
        for size, places, windows in index.find(np.concatenate(group)) if group else ():
            rows = np.searchsorted(begins, places, "right") - 1
            for k, p, w in zip(rows.tolist(), (places - begins[rows]).tolist(), windows.tolist(), strict=True):
                hits[k].append((p, p + size))
                seen[k].add((size, w))
        for k, ranges in hits.items():
            out[first + k] |= {"hits": _merged(ranges), "items": sorted({i for x in seen[k] for i in index.having(*x)})}
        group, starts, at = [], [], 0

    for text in texts:
        found = words(text)
        ids = np.zeros(len(found) + 1, np.int32)
        ids[:-1] = np.fromiter(map(lookup, found), np.int32, len(found))
        out.append({"n_words": len(found), "hits": [], "items": []})
        group.append(ids)
        starts.append(at)
        at += len(ids)
        if at > 1_000_000:
            flush()
    flush()
    return out


def _with(df: DataFrame, into: str, kind: T.DataType) -> T.StructType:
    return T.StructType([f for f in df.schema if f.name != into] + [T.StructField(into, kind)])


def _added(batch: pa.RecordBatch, into: str, values: pa.Array) -> pa.RecordBatch:
    keep = [c for c in batch.schema.names if c != into]
    return pa.RecordBatch.from_arrays([batch.column(c) for c in keep] + [values], names=[*keep, into])


def _scanned(df: DataFrame, text: str, into: str, items: DataFrame, n: int) -> DataFrame:
    """Benchmarks of a bounded size: their windows are broadcast, and one scan finds all."""
    shared = df.sparkSession.sparkContext.broadcast(_Block([tuple(r) for r in items.toLocalIterator()], n))
    kind = pa.struct([("n_words", pa.int64()), ("hits", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), ("items", pa.list_(pa.string() if isinstance(items.schema["id"].dataType, T.StringType) else pa.int64()))])

    def run(batches):
        index = shared.value.index()
        for batch in batches:
            yield _added(batch, into, pa.array(_scan(index, batch.column(text).to_pylist()), kind))

    return df.mapInArrow(run, _with(df, into, _hits(items)))


def _hashed(found: list[bytes], known: _WordHashes) -> np.ndarray:
    return np.fromiter(map(known.__getitem__, found), np.uint64, len(found))


def _item_windows(items: DataFrame, n: int) -> DataFrame:
    """(id, size, window, hash): each item's windows as joined words."""

    def run(batches):
        known = _WordHashes()
        for batch in batches:
            for item, text in zip(batch.column("id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                found = words(text)
                if size := min(n, len(found)):
                    many = len(found) - size + 1
                    h = _hashed(found, known)
                    hashes = _hash(h[k : k + many] for k in range(size)).view(np.int64)
                    for at in range(0, many, 10_000):
                        some = range(at, min(many, at + 10_000))
                        yield pa.RecordBatch.from_pydict({"id": pa.array([item] * len(some), batch.column("id").type), "size": np.full(len(some), size, np.int32), "window": pa.array([b" ".join(found[i : i + size]) for i in some], pa.binary()), "hash": hashes[some.start : some.stop]})

    return items.mapInArrow(run, f"id {items.schema['id'].dataType.simpleString()}, size int, window binary, hash long").distinct()


def _joined(df: DataFrame, text: str, into: str, items: DataFrame, n: int, filter_bits: int) -> DataFrame:
    """Benchmarks of any size: a bit array of a bounded size, made of all window hashes, is broadcast; the document windows that pass it are joined with the benchmark's by their words."""
    windows = stored(_item_windows(items, n), "decontaminate-windows")
    sizes = [r["size"] for r in windows.select("size").distinct().collect()]  # n at most
    bits = min(filter_bits, max(16, (16 * windows.count()).bit_length()))
    slot = F.shiftrightunsigned("hash", 64 - bits)
    rows = windows.select(slot.alias("s")).groupBy(F.shiftright("s", 6).alias("k")).agg(F.bit_or(F.expr("shiftleft(1L, cast(s & 63 as int))")).alias("v"))
    mask = np.zeros(1 << (bits - 6), np.uint64)
    for r in rows.toLocalIterator():  # 2 ** (filter_bits - 6) at most
        mask[r["k"]] = np.uint64(r["v"] & 0xFFFFFFFFFFFFFFFF)
    shared = df.sparkSession.sparkContext.broadcast(mask)
    row, found = free_name(df, "_row"), T.StructType([T.StructField("n_words", T.LongType()), T.StructField("near", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("size", T.IntegerType()), T.StructField("window", T.BinaryType())])))])
    kind = pa.struct([("n_words", pa.int64()), ("near", pa.list_(pa.struct([("start", pa.int64()), ("size", pa.int32()), ("window", pa.binary())])))])

    def run(batches):
        known, mask = _WordHashes(), shared.value

        def near(found):
            h, out = _hashed(found, known), []
            for size in sizes:
                if len(found) >= size:
                    many = len(found) - size + 1
                    s = _hash(h[k : k + many] for k in range(size)) >> np.uint64(64 - bits)
                    hit = np.flatnonzero((mask[s >> np.uint64(6)] >> (s & np.uint64(63))) & np.uint64(1))
                    out += [{"start": p, "size": size, "window": b" ".join(found[p : p + size])} for p in hit.tolist()]
            return out

        for batch in batches:
            texts = [words(t.as_py()) for t in batch.column(text)]
            yield _added(batch, into, pa.array([{"n_words": len(t), "near": near(t)} for t in texts], kind))

    scanned = stored(df.drop(into).withColumn(row, F.monotonically_increasing_id()).mapInArrow(run, _with(df.drop(into).withColumn(row, F.lit(0).cast("long")), into, found)), "decontaminate-scan")
    near = scanned.select(F.col(row).alias("row"), F.explode(f"{into}.near").alias("x")).select("row", "x.*")
    hits = near.join(windows, ["size", "window"]).groupBy("row").agg(F.collect_set(F.struct("start", (F.col("start") + F.col("size")).alias("end"))).alias("hits"), F.sort_array(F.collect_set("id")).alias("items"))

    def merge(batches):
        for batch in batches:
            ranges = [_merged((x["start"], x["end"]) for x in r) for r in batch.column("hits").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(ranges, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), batch.column("items")], names=["_hit_row", "_hit_ranges", "_hit_items"])

    merged = hits.mapInArrow(merge, T.StructType([T.StructField("_hit_row", T.LongType()), T.StructField("_hit_ranges", RANGES), T.StructField("_hit_items", _hits(items)["items"].dataType)])).alias("hit")
    value = F.struct(F.col(f"doc.{into}.n_words").alias("n_words"), F.coalesce("hit._hit_ranges", F.array().cast(RANGES)).alias("hits"), F.coalesce("hit._hit_items", F.array().cast(_hits(items)["items"].dataType)).alias("items"))
    out = scanned.alias("doc").join(merged, F.col(f"doc.{row}") == F.col("hit._hit_row"), "left")
    return out.select(*[F.col(f"doc.`{c}`") for c in df.columns if c != into], value.alias(into))


def find_contamination(df: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", into: str = "contamination", n: int = N, block_bytes: int = BLOCK_BYTES, filter_bits: int = FILTER_BITS) -> DataFrame:
    """df with a struct ``into``: n_words, merged word ranges that benchmark windows hit, and the ids of items found, in order: whole numbers, or else texts.

    The benchmark's size is measured first. Up to ``block_bytes`` its windows are broadcast; beyond, what is broadcast
    is a bit array of at most 2 ** ``filter_bits`` bits over all window hashes, and the document windows that pass it
    are joined with the benchmark's, word by word. Both give the same rows. Null texts, and texts without words, have
    no hits; null or wordless items have no windows; items with null ids are left out; equal items and repeated rows
    each count for themselves. Empty tables give empty results. Other columns pass through, one named ``into`` is
    replaced.
    """
    items = benchmark.filter(F.col(item_id).isNotNull() & F.col(item_text).isNotNull()).select(F.col(item_id).cast("long" if isinstance(benchmark.schema[item_id].dataType, T.IntegralType) else "string").alias("id"), F.col(item_text).alias("text"))
    size = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    if size <= block_bytes:
        return _scanned(df, text, into, items, n)
    return _joined(df, text, into, items, n, filter_bits)


def is_contaminated(into: str = "contamination", share: int = SHARE):
    c = F.col(into)
    hit = F.aggregate(c["hits"], F.lit(0).cast("long"), lambda a, x: a + x["end"] - x["start"])
    return (hit > 0) & (share * hit >= c["n_words"])


def drop_contaminated(df: DataFrame, benchmark: DataFrame, text: str = "text", **options) -> DataFrame:
    """The rows of df that aren't contaminated, with their columns as they were; rows without text or words stay, an empty table stays empty."""
    into = free_name(df, "_contamination")
    found = find_contamination(df, benchmark, text, into=into, **options)
    return found.filter(~is_contaminated(into)).select(*[F.col(f"`{c}`") for c in df.columns])


def remove_spans(df: DataFrame, benchmark: DataFrame, text: str = "text", **options) -> DataFrame:
    """df with the hit words cut out of its texts, each run of them with the characters between its words. Null texts stay null, repeated rows are cut alike, an empty table stays empty."""
    import re

    word = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")

    @F.pandas_udf(T.StringType())
    def cut(texts, found):
        def one(t, ranges):
            if t is None or not len(ranges):
                return t
            at = [m.span() for m in word.finditer(t)]
            for r in reversed(list(ranges)):
                t = t[: at[r["start"]][0]] + t[at[r["end"] - 1][1] :]
            return t

        import pandas as pd

        return pd.Series([one(t, r) for t, r in zip(texts, found, strict=True)], dtype=object)

    into = free_name(df, "_contamination")
    found = find_contamination(df, benchmark, text, into=into, **options)
    return found.withColumn(text, cut(F.col(text), F.col(f"{into}.hits"))).select(*[F.col(f"`{c}`") for c in df.columns])


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_contamination(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    c = F.col("contamination")
    return found.select(
        "doc_id",
        c["n_words"].alias("n_words"),
        F.aggregate(c["hits"], F.lit(0).cast("long"), lambda a, x: a + x["end"] - x["start"]).alias("n_hit"),
        F.size(c["items"]).cast("long").alias("n_items"),
        F.sha2(F.array_join(F.sort_array(F.transform(c["items"], lambda x: x.cast("string"))), ","), 256).alias("items_sha256"),
        is_contaminated().alias("contaminated"),
    )
