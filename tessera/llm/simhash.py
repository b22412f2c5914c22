"""SimHash near-duplicates by generalised pigeonhole: correlated bits share a partition, each partition has its own threshold.

Two fingerprints within ``distance`` bits are, for thresholds that sum to distance - parts + 1, within the threshold of
at least one partition. A threshold t is met in the middle: one side lists the keys within t // 2 bits of its own, the
other those within t - t // 2, and equal keys meet. Every meeting is verified on the whole fingerprint.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import free_name, row_hash, stored, table
from .components import connected_components

BITS, DISTANCE, SHINGLE, SEED = 64, 4, 4, 42
#: Two wide partitions: chance meetings stay rare up to billions of fingerprints.
PARTS = 2
#: Fingerprints with an equal half from which on their place counts as crowded.
CROWD = 8
#: Cost of one listed key against one verified meeting, for the allocation of thresholds.
KEY_COST = 4.0
#: Fingerprints listed under a key above which its list is split, and those of a block.
LONG, BLOCK = 8_192, 4_096
#: Long keys up to which they are broadcast.
BROADCAST_KEYS = 100_000


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    begins = np.concatenate(([0], ends[:-1] + 1))
    k = min(shingle, len(words))
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[a:b], SEED) for a, b in zip(begins[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist(), strict=True)], np.uint64)
    ones = np.zeros(BITS, np.int64)
    for i in range(0, len(hashes), 1 << 15):
        ones += np.unpackbits(hashes[i : i + (1 << 15)].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big")


def fingerprints(df: DataFrame, text: str = "text", into: str = "fingerprint") -> DataFrame:
    """df with the 64-bit fingerprint of each whole text as a signed long. Texts without words, null ones too, have 0."""
    from pyspark.sql import types as T

    schema = T.StructType([f for f in df.schema if f.name != into] + [T.StructField(into, T.LongType())])

    def run(batches):
        for batch in batches:
            found = np.array([fingerprint(t.as_py()) for t in batch.column(text)], np.uint64).view(np.int64)
            keep = [c for c in batch.schema.names if c != into]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in keep] + [pa.array(found, pa.int64())], names=[*keep, into])

    return df.mapInArrow(run, schema)


def bit_statistics(prints: DataFrame) -> tuple[int, np.ndarray]:
    """Rows, and how often each pair of bits is set together (64 x 64), over all of prints(print long)."""

    def count(batches):
        both, n = np.zeros((BITS, BITS)), 0
        for batch in batches:
            x = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            for i in range(0, len(x), 1 << 14):
                b = ((x[i : i + (1 << 14), None] >> np.arange(BITS, dtype=np.uint64)) & np.uint64(1)).astype(np.float64)
                both += b.T @ b
            n += len(x)
        yield pa.RecordBatch.from_pydict({"k": np.arange(BITS * BITS + 1, dtype=np.int32), "v": np.append(both.ravel(), n)})

    found = prints.mapInArrow(count, "k int, v double").groupBy("k").agg(F.sum("v").alias("v")).collect()
    total = np.zeros(BITS * BITS + 1)
    for r in found:
        total[r["k"]] = r["v"]
    return int(total[-1]), total[:-1].reshape(BITS, BITS)


def group_bits(n: int, both: np.ndarray, parts: int = PARTS) -> list[list[int]]:
    """Bits in parts of equal width, each grown from a free bit by the free bit most correlated with it so far."""
    p = np.diag(both) / max(n, 1)
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    correlation = np.abs(both / max(n, 1) - np.outer(p, p)) / np.outer(spread, spread)
    np.fill_diagonal(correlation, 0)
    free, out = list(range(BITS)), []
    for k in range(parts):
        width = -(-len(free) // (parts - k))
        group = [max(free, key=lambda b: correlation[b, free].sum())]
        free.remove(group[0])
        while len(group) < width:
            best = max(free, key=lambda b: correlation[b, group].sum())
            group.append(best)
            free.remove(best)
        out.append(sorted(group))
    return out


def allocate(n: int, both: np.ndarray, groups: list[list[int]], distance: int = DISTANCE) -> list[int]:
    """Thresholds, from -1 (partition unused), that sum to distance - parts + 1 at least estimated cost.

    A pair differs in bit b with probability 2 p (1 - p); the number of differing bits in a partition follows by
    convolution, and with it the expected meetings for each threshold. Dynamic programming picks the thresholds.
    """
    p = np.diag(both) / max(n, 1)
    differ = 2 * p * (1 - p)
    costs = []
    for g in groups:
        within = np.array([1.0])
        for b in g:
            within = np.convolve(within, [1 - differ[b], differ[b]])
        within = np.cumsum(within)
        ball = np.cumsum([_choose(len(g), k) for k in range(distance + 1)])
        cost = [0.0]
        for t in range(distance + 1):
            sides = ball[t - t // 2]
            cost.append(KEY_COST * n * sides + n * n / 2 * within[min(t, len(within) - 1)])
        costs.append(cost)
    total = distance - len(groups) + 1
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for cost in costs:
        step: dict[int, tuple[float, list[int]]] = {}
        for spent, (c, chosen) in best.items():
            for t in range(-1, distance + 1):
                key = spent + t
                if key not in step or c + cost[t + 1] < step[key][0]:
                    step[key] = (c + cost[t + 1], [*chosen, t])
        best = step
    return best[total][1]


def _choose(n: int, k: int) -> int:
    out = 1
    for i in range(k):
        out = out * (n - i) // (i + 1)
    return out


def _masks(bits: list[int], radius: int) -> np.ndarray:
    return np.array([sum(1 << b for b in c) for r in range(radius + 1) for c in combinations(bits, r)], np.uint64)


def listed(nodes: DataFrame, groups: list[list[int]], thresholds: list[int]) -> DataFrame:
    """(key, print, part_of): the keys around each fingerprint of nodes(print long, part_of long), each key's other bits telling its partition."""
    plan = [(np.uint64(mask), np.uint64(fill), _masks(bits, t - t // 2)) for bits, t, mask, fill in _partitions(groups, thresholds)]

    def run(batches):
        for batch in batches:
            x, owner = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("print", "part_of"))
            x = x.view(np.uint64)
            for i in range(0, len(x), 2048):
                y, o = x[i : i + 2048], owner[i : i + 2048]
                for mask, fill, around in plan:
                    keys = (((y & mask) | fill)[:, None] ^ around[None, :]).ravel().view(np.int64)
                    yield pa.RecordBatch.from_pydict({"key": keys, "print": np.repeat(y.view(np.int64), len(around)), "part_of": np.repeat(o, len(around))})

    return nodes.select("print", "part_of").mapInArrow(run, "key long, print long, part_of long")


def _partitions(groups: list[list[int]], thresholds: list[int]) -> list[tuple[list[int], int, int, int]]:
    """(bits, threshold, mask, fill) of the partitions in use; fill sets bits outside the mask as no other partition's does."""
    out = []
    for k, (bits, t) in enumerate(zip(groups, thresholds, strict=True)):
        mask = sum(1 << b for b in bits)
        if t >= 0:
            out.append((bits, t, mask, (0x9E3779B97F4A7C15 * (k + 1)) % (1 << BITS) & ~mask))
    return out


def in_cells(rows: DataFrame, nodes: DataFrame, groups: list[list[int]], thresholds: list[int], long: int = LONG, block: int = BLOCK) -> DataFrame:
    """rows(key, print, part_of) with ``cell``: the lists of long keys are cut into blocks, and each pair of blocks is a cell, so none holds more than two blocks.

    A key that only one part lists can't link any two and goes if it is long. The keys are counted only where the
    commonest value of a partition makes a long one possible.
    """
    plan = _partitions(groups, thresholds)
    values = nodes.select(F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.col("print").bitwiseAND(F.lit(_signed(mask))).alias("v")) for k, (_, _, mask, _) in enumerate(plan)])).alias("x")).select("x.*")
    most = values.groupBy("k", "v").agg(F.count("*").alias("n")).groupBy("k").agg(F.max("n").alias("n")).collect()
    if not any(r["n"] * len(_masks(plan[r["k"]][0], plan[r["k"]][1] - plan[r["k"]][1] // 2)) > long for r in most):
        return rows.withColumn("cell", F.lit(0).cast("long"))
    counted = rows.groupBy("key").agg(F.count("*").alias("n"), F.min("part_of").alias("lo"), F.max("part_of").alias("hi")).filter(F.col("n") > long)
    counted = stored(counted.select("key", F.when(F.col("lo") == F.col("hi"), 0).otherwise(F.ceil(F.col("n") / block)).cast("int").alias("blocks")), "simhash-long")
    if counted.count() <= BROADCAST_KEYS:
        counted = F.broadcast(counted)
    rows = rows.join(counted, "key", "left").filter("blocks is null or blocks > 0")
    own = F.pmod(F.xxhash64("print"), F.col("blocks"))
    cells = F.when(F.col("blocks").isNull(), F.array(F.lit(0).cast("long"))).otherwise(F.transform(F.sequence(F.lit(0).cast("long"), F.col("blocks") - F.lit(1).cast("long")), lambda j: F.least(own, j) * F.col("blocks") + F.greatest(own, j)))
    return rows.select("key", "print", "part_of", F.explode(cells).alias("cell"))


def _signed(mask: int) -> int:
    return mask - (1 << BITS) if mask >> (BITS - 1) else mask


def meetings(rows: DataFrame, groups: list[list[int]], thresholds: list[int], distance: int) -> DataFrame:
    """(a, b): parts with fingerprints that share a key and are within ``distance`` bits, for rows(key, cell, print, part_of).

    Cells are read as a sorted stream. One listed by a single part is passed over in one step, however many list it; the
    rest compare each fingerprint with those after it in the cell, all cells at once.
    """
    plan = [(np.uint64(mask), np.uint64(fill), t // 2) for _, t, mask, fill in _partitions(groups, thresholds)]

    def linked(key, cell, x, part):
        starts = np.flatnonzero(np.concatenate(([True], (key[1:] != key[:-1]) | (cell[1:] != cell[:-1]))))
        sizes = np.diff(np.append(starts, len(key)))
        mixed = np.minimum.reduceat(part, starts) != np.maximum.reduceat(part, starts)
        take = np.repeat(mixed, sizes)
        key, x, part = key[take], x[take].view(np.uint64), part[take]
        sizes = sizes[mixed]
        left = np.repeat(sizes, sizes) - np.arange(len(key)) + np.repeat(np.cumsum(sizes) - sizes, sizes) - 1  # rows of the key after this one
        wide = key.view(np.uint64)
        inner = np.zeros(len(key), bool)  # rows of the small side too
        for mask, fill, radius in plan:
            inner |= ((wide & ~mask) == fill) & (np.bitwise_count((wide ^ x) & mask) <= radius)
        found, d, at = [], 1, np.flatnonzero(left >= 1)
        while len(at):
            near = (part[at] != part[at + d]) & (inner[at] | inner[at + d]) & (np.bitwise_count(x[at] ^ x[at + d]) <= distance)
            if near.any():
                p, q = part[at[near]], part[at[near] + d]
                found.append(np.unique(np.stack((np.minimum(p, q), np.maximum(p, q)), axis=1), axis=0))
            d += 1
            at = at[left[at] >= d]
        return np.unique(np.concatenate(found), axis=0) if found else np.zeros((0, 2), np.int64)

    def run(batches):
        kept = tuple(np.array([], np.int64) for _ in range(4))
        for batch in batches:
            new = [batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("key", "cell", "print", "part_of")]
            if not len(new[0]):
                continue
            now = [np.concatenate(x) for x in zip(kept, new, strict=True)]
            first = int(np.searchsorted(now[0], now[0][-1]))
            last = first + int(np.searchsorted(now[1][first:], now[1][-1]))  # the last cell may go on
            kept = tuple(x[last:] for x in now)
            if last:
                out = linked(*(x[:last] for x in now))
                yield pa.RecordBatch.from_pydict({"a": out[:, 0], "b": out[:, 1]})
        if len(kept[0]):
            out = linked(*kept)
            yield pa.RecordBatch.from_pydict({"a": out[:, 0], "b": out[:, 1]})

    return rows.select("key", "cell", "print", "part_of").repartition("key", "cell").sortWithinPartitions("key", "cell").mapInArrow(run, "a long, b long")


def crowded(prints: DataFrame, most: int = CROWD) -> DataFrame:
    """The fingerprints that share one of their halves with others, at least ``most`` in all: where dense groups are."""
    halves = prints.select("print", F.explode(F.array(F.struct(F.lit(0).alias("h"), F.col("print").bitwiseAND(0xFFFFFFFF).alias("v")), F.struct(F.lit(1).alias("h"), F.shiftrightunsigned("print", 32).alias("v")))).alias("x")).select("print", "x.*")
    many = halves.groupBy("h", "v").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= most)
    return halves.join(many, ["h", "v"], "left_semi").select("print").distinct()


def close_links(prints: DataFrame) -> DataFrame:
    """(a, b): links that join all of these fingerprints within two bits of each other, without listing pairs.

    Each fingerprint is listed under the 65 values within one bit of it. Those listed under one value are within two
    bits of each other and at most 65, and two within two bits share a value; so each list becomes a star.
    """
    around = _masks(list(range(BITS)), 1)

    def run(batches):
        for batch in batches:
            x = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            for i in range(0, len(x), 2048):
                y = x[i : i + 2048]
                yield pa.RecordBatch.from_pydict({"key": (y[:, None] ^ around[None, :]).ravel().view(np.int64), "print": np.repeat(y.view(np.int64), len(around))})

    lists = prints.mapInArrow(run, "key long, print long").groupBy("key").agg(F.min("print").alias("a"), F.collect_list("print").alias("near"))
    return lists.filter(F.size("near") > 1).select("a", F.explode("near").alias("b")).filter("a < b").distinct()


def links(nodes: DataFrame, distance: int = DISTANCE, parts: int = PARTS, long: int = LONG, block: int = BLOCK) -> DataFrame:
    """(a, b), a < b: the parts that a pair of fingerprints within ``distance`` bits joins, for nodes(print long, part_of long)."""
    n, both = bit_statistics(nodes.select("print"))
    groups = group_bits(n, both, parts)
    thresholds = allocate(n, both, groups, distance)
    rows = in_cells(listed(nodes, groups, thresholds), nodes, groups, thresholds, long, block)
    return meetings(rows, groups, thresholds, distance).distinct()


def near_duplicates(df: DataFrame, text: str = "text", id: str = "doc_id", distance: int = DISTANCE, parts: int = PARTS) -> DataFrame:
    """(id, fingerprint long, component_id): one row per row of df, the component being its smallest id.

    Rows of equal fingerprints, also the many without words, are one node of the graph, so exact copies cost one row
    each. In crowded places nodes within two bits are joined first, without pairs; the probe then links the parts so
    found and the other nodes. Null ids
    take part in links but are never a component's name unless it has no other. Repeated rows are returned as often as
    they occur; other columns are not returned; an empty table gives an empty result.
    """
    prints = stored(fingerprints(df.select(F.col(id).alias("id"), F.col(text).alias("text")), "text", "print").select("id", "print"), "simhash")
    nodes = stored(prints.groupBy("print").agg(F.min("id").alias("id")), "simhash-nodes")
    if distance >= 2:
        near = connected_components(stored(close_links(crowded(nodes.select("print"))), "simhash-close"))
        nodes = nodes.join(near.withColumnRenamed("node", "print"), "print", "left").select("print", "id", F.coalesce("root", "print").alias("part_of"))
    else:
        nodes = nodes.withColumn("part_of", F.col("print"))
    nodes = stored(nodes, "simhash-parts")
    far = connected_components(stored(links(nodes, distance, parts), "simhash-links"))
    grouped = nodes.join(far.withColumnRenamed("node", "part_of"), "part_of", "left").select("print", "id", F.coalesce("root", "part_of").alias("root"))
    grouped = stored(grouped, "simhash-grouped")
    smallest = grouped.groupBy("root").agg(F.min("id").alias("component_id"))
    named = grouped.join(smallest, "root").select("print", "component_id")
    return prints.join(named, "print").select(F.col("id").alias(id), F.col("print").alias("fingerprint"), "component_id")


def keep_first(df: DataFrame, text: str = "text", id: str = "doc_id", **options) -> DataFrame:
    """One row of each group of near-duplicates, with the columns of df: the one of the smallest id.

    Ids may be of any type that has an order. Rows without one come after those with one; among equal ids a hash of the
    whole row decides, and of wholly equal rows one stays. Null and empty texts are near-duplicates of each other; an
    empty table stays empty. Only ids and hashes travel to find the rows that stay.
    """
    # rows are told apart by their hash with their id; _i keeps the id's own order, _t stands for it where null must equal null
    parts = {"_n": F.col(id).isNull(), "_i": F.col(id), "_t": F.coalesce(F.col(id).cast("string"), F.lit("")), "_h": row_hash(df)}
    own = {free_name(df, k): c for k, c in parts.items()}
    named = df.select(F.struct(*[c.alias(k) for k, c in own.items()]).alias("_id"), F.col(text).alias("_text"))
    found = near_duplicates(named, "_text", "_id", **options)
    alike = [k for k in own if k != list(own)[1]]
    kept = found.filter(F.col("_id") == F.col("component_id")).select("_id.*").select(*alike).distinct()
    return df.withColumns({k: own[k] for k in alike}).join(kept, alike, "left_semi").dropDuplicates(alike).select(*[F.col(f"`{c}`") for c in df.columns])


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")
