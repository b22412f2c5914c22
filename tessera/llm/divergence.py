"""How much the vocabularies of a language's sources differ: terms cut from bytes, counted, smoothed and compared in whole numbers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import stored, table

#: Documents of a language that must hold a term for it to count, what is added to each count, ranks of the term report.
MIN_DOCS, SMOOTHING, TOP = 30, 5, 50
#: Bytes of text cut at once; a longer text is cut in several goes.
RANGE_BYTES = 2 << 20
#: Distinct terms, and counts of a term in a group, that a task holds before it hands them on.
HELD_TERMS, HELD_COUNTS = 500_000, 1_000_000
#: Counts in one block of terms when sources are compared; as many as there are pairs of sources if that is more, so that a block's sums are fewer than its counts.
BLOCK_COUNTS = 50_000

_CODES = np.arange(256)
_UPPER = (_CODES >= ord("A")) & (_CODES <= ord("Z"))
#: Each byte in lower case, and whether it belongs to a term: letters of ASCII and every byte of other characters.
LOWER = np.where(_UPPER, _CODES + 32, _CODES).astype(np.uint8)
TERM = _UPPER | ((_CODES >= ord("a")) & (_CODES <= ord("z"))) | (_CODES >= 128)

#: The five primes of XXH64.
_P1, _P2, _P3, _P4, _P5 = (np.uint64(p) for p in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))


def _turn(x: np.ndarray, by: int) -> np.ndarray:
    return (x << np.uint64(by)) | (x >> np.uint64(64 - by))


def xxh64(rows: np.ndarray) -> np.ndarray:
    """XXH64 of each row of a matrix of bytes. Rows of under 32 bytes are hashed together, longer ones by the library."""
    n, size = rows.shape
    if size >= 32:
        return np.fromiter((xxhash.xxh64_intdigest(r.tobytes()) for r in rows), np.uint64, n)
    with np.errstate(over="ignore"):
        h, at = np.full(n, _P5 + np.uint64(size), np.uint64), 0
        while size - at >= 8:
            lane = np.ascontiguousarray(rows[:, at : at + 8]).view("<u8").ravel()
            h = _turn(h ^ (_turn(lane * _P2, 31) * _P1), 27) * _P1 + _P4
            at += 8
        if size - at >= 4:
            lane = np.ascontiguousarray(rows[:, at : at + 4]).view("<u4").ravel().astype(np.uint64)
            h = _turn(h ^ (lane * _P1), 23) * _P2 + _P3
            at += 4
        for k in range(at, size):
            h = _turn(h ^ (rows[:, k].astype(np.uint64) * _P5), 11) * _P1
        h = (h ^ (h >> np.uint64(33))) * _P2
        h = (h ^ (h >> np.uint64(29))) * _P3
        return h ^ (h >> np.uint64(32))


def same_slices(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(a row of each distinct kind, the kind of each row) of a matrix of bytes: sorted by hash, then neighbours are compared byte by byte."""
    h = xxh64(rows)
    order = np.argsort(h)
    new = np.concatenate(([True], h[order[1:]] != h[order[:-1]]))
    lined = rows[order]
    if (~new[1:] & (lined[1:] != lined[:-1]).any(axis=1)).any():  # two slices of one hash
        kinds, of = np.unique(lined, axis=0, return_inverse=True)
        of = of.ravel()
    else:
        kinds, of = lined[new], np.cumsum(new) - 1
    out = np.empty(len(rows), np.int64)
    out[order] = of
    return kinds, out


def _summed(keys: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    """Each key once, ascending, with the sums of its values."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    return keys[first], *[np.add.reduceat(v[order], first) for v in values]


class TermCounter:
    """Counts the terms of texts by group: in how many texts each stands, and how often."""

    def __init__(self):
        self.groups: dict[tuple[str, str], int] = {}
        self.group_docs: list[int] = []
        self._reset()

    def _reset(self) -> None:
        self.numbers: dict[bytes, int] = {}
        self.held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.n_held = 0

    def _cut(self, data: np.ndarray, doc_starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(beginning, end) of each term; none crosses the beginning of a text."""
        term = TERM[data]
        edge = np.zeros(len(data) + 1, bool)
        edge[doc_starts] = edge[-1] = edge[0] = True
        begins, ends = edge[:-1] & term, edge[1:] & term
        begins[1:] |= term[1:] & ~term[:-1]
        ends[:-1] |= term[:-1] & ~term[1:]
        return np.flatnonzero(begins), np.flatnonzero(ends) + 1

    def _number(self, data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The number of each slice's term."""
        sizes = end - begin
        order = np.argsort(np.minimum(sizes, 65535).astype(np.uint16), kind="stable")
        if len(sizes) and sizes.max() >= 65535:
            order = order[np.argsort(sizes[order], kind="stable")]
        cuts = np.flatnonzero(np.diff(sizes[order])) + 1
        out = np.empty(len(begin), np.int64)
        for at in np.split(order, cuts) if len(order) else ():
            size = int(sizes[at[0]])
            kinds, of = same_slices(np.lib.stride_tricks.sliding_window_view(data, size)[begin[at]])
            flat = kinds.tobytes()
            numbers = self.numbers
            listed = [numbers.setdefault(flat[k : k + size], len(numbers)) for k in range(0, len(flat), size)]
            out[at] = np.array(listed)[of]
        return out

    def _ranges(self, data: np.ndarray) -> Iterator[tuple[int, int]]:
        """Stretches of bounded length that end where no term does go on."""
        at = 0
        while at < len(data):
            end = at + RANGE_BYTES
            while end < len(data) and TERM[data[end]]:
                ahead = np.flatnonzero(~TERM[data[end : end + RANGE_BYTES]])
                end += int(ahead[0]) if len(ahead) else RANGE_BYTES
            yield at, min(end, len(data))
            at = end

    def add(self, data: np.ndarray, offsets: np.ndarray, groups: np.ndarray) -> None:
        """Takes in texts that lie one after the other in ``data``: text k, of group groups[k], from offsets[k] to offsets[k + 1]."""
        data, parts = LOWER[data], []
        for a, b in [(0, len(data))] if len(offsets) > 2 else self._ranges(data):
            here = offsets[(offsets >= a) & (offsets < b)] - a
            begin, end = self._cut(data[a:b], here)
            if len(begin):
                doc = np.searchsorted(offsets, begin + a, "right") - 1
                parts.append(_summed(doc << 32 | self._number(data[a:b], begin, end), np.ones(len(begin), np.int64)))
        if not parts:
            return
        keys, counts = _summed(*map(np.concatenate, zip(*parts, strict=True))) if len(parts) > 1 else parts[0]
        keys = groups[keys >> 32] << 32 | (keys & 0xFFFFFFFF)
        self.held.append(_summed(keys, np.ones(len(keys), np.int64), counts))
        self.n_held += len(self.held[-1][0])

    def group(self, lang: str, source: str) -> int:
        g = self.groups.setdefault((lang, source), len(self.groups))
        if g == len(self.group_docs):
            self.group_docs.append(0)
        self.group_docs[g] += 1
        return g

    def full(self) -> bool:
        if self.n_held > HELD_COUNTS:
            self.held = [_summed(*map(np.concatenate, zip(*self.held, strict=True)))]
            self.n_held = len(self.held[0][0])
        return self.n_held > HELD_COUNTS or len(self.numbers) > HELD_TERMS

    def taken(self) -> Iterator[pa.RecordBatch]:
        """What was counted, as rows (lang, source, term, docs, n); begins anew."""
        if not self.held:
            return
        keys, docs, counts = _summed(*map(np.concatenate, zip(*self.held, strict=True)))
        terms = pa.array(list(self.numbers), pa.binary())
        names = [pa.array([g[k] for g in self.groups], pa.string()) for k in (0, 1)]
        self._reset()
        for a in range(0, len(keys), 200_000):
            key = keys[a : a + 200_000]
            g = pa.array(key >> 32)
            yield pa.RecordBatch.from_arrays([names[0].take(g), names[1].take(g), terms.take(pa.array(key & 0xFFFFFFFF)).cast(pa.string()), pa.array(docs[a : a + len(key)]), pa.array(counts[a : a + len(key)])], names=["lang", "source", "term", "docs", "n"])

    def seen_groups(self) -> pa.RecordBatch:
        """A row without a term for each group, with its number of texts."""
        n = len(self.groups)
        return pa.RecordBatch.from_arrays([*[pa.array([g[k] for g in self.groups], pa.string()) for k in (0, 1)], pa.nulls(n, pa.string()), pa.array(self.group_docs, pa.int64()), pa.array([0] * n, pa.int64())], names=["lang", "source", "term", "docs", "n"])


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counter = TermCounter()
    for batch in batches:
        text, lang, source = (c.fill_null("") for c in batch.columns)
        text = text.cast(pa.large_binary())
        groups = np.array([counter.group(*p) for p in zip(lang.to_pylist(), source.to_pylist(), strict=True)], np.int64)
        offsets = np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + len(text) + 1] if len(text) else np.zeros(1, np.int64)
        data = np.frombuffer(text.buffers()[2] or b"", np.uint8)
        at = 0
        while at < len(text):
            end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + RANGE_BYTES, "right")) - 1)
            counter.add(data[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at], groups[at:end])
            at = end
            if counter.full():
                yield from counter.taken()
    yield from counter.taken()
    yield counter.seen_groups()


def share(count: Column, whole: Column) -> Column:
    """1 + floor(1000000000 * (count + SMOOTHING) / whole), by long division in steps of 1000, so that nothing overflows."""
    left, out = count + SMOOTHING, F.lit(1).cast("long")
    for step in (1_000_000, 1_000, 1):
        left = left * 1_000
        left_over = left % whole
        out, left = out + ((left - left_over) / whole).cast("long") * step, left_over
    return out


def _shares(count: np.ndarray, whole: np.ndarray) -> np.ndarray:
    """``share`` of arrays."""
    left, out = count + SMOOTHING, 1
    for step in (1_000_000, 1_000, 1):
        left = left * 1_000
        out, left = out + left // whole * step, left % whole
    return out


def block_divergences(source: np.ndarray, term: np.ndarray, count: np.ndarray, whole: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(a, b, sum over the block's terms of the difference of both shares) for sources a < b, from counts as (source, term, count) and each source's whole.

    A matrix in compressed rows: a source without a term has there the share of no count. So a pair's sum is what it
    would be if b had no counts, from sorted shares and their running sums, and what b's counts change in it.
    """
    n, terms = len(whole), int(term.max()) + 1 if len(term) else 0
    order = np.lexsort((term, source))
    source, term, count = source[order], term[order], count[order]
    starts = np.searchsorted(source, np.arange(n + 1))
    value, empty = _shares(count, whole[source]), _shares(np.zeros(n, np.int64), whole)
    pairs = []
    for a in range(n - 1):
        own = np.full(terms, empty[a])
        own[term[starts[a] : starts[a + 1]]] = value[starts[a] : starts[a + 1]]
        lined = np.sort(own)
        sums = np.append(0, np.cumsum(lined))
        others = empty[a + 1 :]
        below = np.searchsorted(lined, others)
        total = others * below - sums[below] + (sums[-1] - sums[below]) - others * (terms - below)
        rest = slice(starts[a + 1], len(source))
        facing = own[term[rest]]
        change = np.abs(value[rest] - facing) - np.abs(empty[source[rest]] - facing)
        begins = starts[a + 1 : -1] - starts[a + 1]
        filled = np.flatnonzero(np.diff(np.append(begins, len(change))))
        if len(filled):
            total[filled] += np.add.reduceat(change, begins[filled])
        pairs.append(total)
    a, b = np.triu_indices(n, 1)
    return a, b, np.concatenate(pairs) if pairs else np.array([], np.int64)


def _compared(key: tuple, counts: pa.Table, sources: pa.Table) -> pa.Table:
    numbers, whole = (np.array(sources.column(c), np.int64) for c in ("source_no", "source_whole"))
    order = np.argsort(numbers)
    numbers, whole = numbers[order], whole[order]
    term = np.array(counts.column("term").combine_chunks().dictionary_encode().indices, np.int64)
    a, b, value = block_divergences(np.searchsorted(numbers, np.array(counts.column("no"), np.int64)), term, np.array(counts.column("n"), np.int64), whole)
    return pa.table({"lang": pa.array([key[0].as_py()] * len(a), pa.string()), "a": numbers[a], "b": numbers[b], "value": value})


def divergence(df: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", min_docs: int = MIN_DOCS, top: int = TOP) -> DataFrame:
    """Rows (lang, source, part, item, value, rank): how far each source of a language is from its other sources, and the terms that it has more of than its language.

    A term is a run of letters of ASCII, lower-cased, and of characters beyond it; one counts where ``min_docs`` texts of
    the language hold it. Shares are smoothed, in billionths. Part ``pair`` has every other source of the language
    with the sum of differences of shares over all terms that count; part ``term`` the ``top`` terms by excess over the
    language. Ranks go by value descending, then item in bytes. Null texts, languages and sources are empty ones; a
    source without terms is compared like any other, and has 0 where no term of the language counts. Repeated rows count
    each. An empty table gives no rows. Other columns of df are not read.
    """
    spark = df.sparkSession
    read = df.select(F.col(text).alias("text"), F.col(lang).cast("string").alias("lang"), F.col(source).cast("string").alias("source"))
    counted = read.mapInArrow(_counted, "lang string, source string, term string, docs long, n long")
    # dealt by language and term once: the sums by source and over the language both lie within that
    by_source = counted.repartition("lang", "term").groupBy("lang", "source", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("n"))
    by_term = Window.partitionBy("lang", "term")
    entries = by_source.select("*", F.sum("docs").over(by_term).alias("lang_docs"), F.sum("n").over(by_term).alias("lang_n"), (F.row_number().over(by_term.orderBy("source")) == 1).alias("first"))
    entries = stored(entries.filter(F.col("term").isNull() | (F.col("lang_docs") >= min_docs)).drop("docs", "lang_docs"), "divergence-counts")
    kept = entries.filter(F.col("term").isNotNull())
    langs = kept.groupBy("lang").agg(F.count_if("first").alias("terms"), F.sum("n").alias("lang_total"), F.count("*").alias("counts"))
    totals = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = entries.filter(F.col("term").isNull()).select("lang", "source").join(totals, ["lang", "source"], "left").join(langs, "lang", "left")
    smooth = F.coalesce("terms", F.lit(0)) * SMOOTHING
    # small and read several times; as a written table its size is known, so Spark broadcasts it only below its limit
    groups = stored(
        groups.select(
            "lang",
            "source",
            (F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1).alias("no"),
            (F.coalesce("total", F.lit(0)) + smooth).alias("whole"),
            (F.coalesce("lang_total", F.lit(0)) + smooth).alias("lang_whole"),
            F.ceil(F.coalesce("counts", F.lit(0)) / F.greatest(F.lit(BLOCK_COUNTS), F.pow(F.count("*").over(Window.partitionBy("lang")), F.lit(2)))).alias("blocks"),
        ),
        "divergence-groups",
    )
    placed = kept.join(groups, ["lang", "source"])
    blocks = placed.select("lang", F.pmod(F.xxhash64("term"), "blocks").alias("block"), "no", "term", "n").groupBy("lang", "block")
    facing = groups.filter("blocks > 0").select(F.col("lang").alias("of_lang"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("of_block"), F.col("no").alias("source_no"), F.col("whole").alias("source_whole")).groupBy("of_lang", "of_block")
    sums = blocks.cogroup(facing).applyInArrow(_compared, "lang string, a long, b long, value long").groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    one, other = groups.select("lang", "source", "no"), groups.select("lang", F.col("source").alias("item"), F.col("no").alias("other"))
    pairs = one.join(other, "lang").filter("no <> other").select("lang", "source", "item", F.least("no", "other").cast("long").alias("a"), F.greatest("no", "other").cast("long").alias("b"))
    pairs = pairs.join(sums, ["lang", "a", "b"], "left").select("lang", "source", F.lit("pair").alias("part"), "item", F.coalesce("value", F.lit(0)).alias("value"))
    excess = share(F.col("n"), F.col("whole")) - share(F.col("lang_n"), F.col("lang_whole"))
    terms = placed.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), excess.alias("value")).filter("value > 0")
    rank = F.row_number().over(Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")).alias("rank")
    return pairs.select("*", rank).unionByName(terms.select("*", rank).filter(F.col("rank") <= top))


def op11_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence(table(spark, sf_dir, "documents"))
