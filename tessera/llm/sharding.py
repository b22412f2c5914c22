"""Sharding by longest processing time: groups that stay together go, largest first, to the least-loaded shard."""

from __future__ import annotations

import heapq
import uuid
from collections.abc import Iterable, Iterator
from itertools import islice

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import listed, shared_dir, stored, table

SHARDS = 40
#: Size that each row adds to that of its text.
ROW_BYTES = 16
#: Rows, or groups, that are numbered together, on average.
PIECE_ROWS = 50_000
#: A group of at least one row in so many is looked up by broadcast, so there are this many such groups at most.
HOT = 10_000
#: Size classes up to which their table is broadcast.
BROADCAST_CLASSES = 100_000
#: Size classes whose schedule the driver holds at once.
PART_CLASSES = 20_000


def schedule(classes: Iterable[tuple[int, int]], shards: int) -> Iterator[list[tuple[int, int]]]:
    """Longest processing time over classes of (size, groups of that size), largest first: for each, (shard, groups) in order of shard. Holds the shards' loads alone.

    Groups of one size are interchangeable, so a class is placed at once: the shards that its groups would be popped to,
    one by one, are those of the least loads that the heap would show.
    """
    heap = [(0, k) for k in range(shards)]
    for size, many in classes:
        taken: dict[int, int] = {}
        if size and many > 4 * shards:
            loads = np.zeros(shards, np.int64)
            for load, k in heap:
                loads[k] = load
            low, high = int(loads.min()), int(loads.max()) + size * many
            while high - low > 1:  # the highest level below which no more than ``many`` pops lie
                level = (low + high) // 2
                if int(np.maximum(0, -(-(level - loads) // size)).sum()) <= many:
                    low = level
                else:
                    high = level
            below = np.maximum(0, -(-(low - loads) // size))
            taken = {k: int(n) for k, n in enumerate(below) if n}
            heap = [(int(load), k) for k, load in enumerate(loads + below * size)]
            heapq.heapify(heap)
            many -= int(below.sum())
        for _ in range(many):
            load, k = heap[0]
            heapq.heapreplace(heap, (load + size, k))
            taken[k] = taken.get(k, 0) + 1
        yield sorted(taken.items())


def assign_shards(df: DataFrame, size: Column, group: Column, shards: int = SHARDS) -> DataFrame:
    """df with ``shard`` (0 to shards - 1) and ``slot`` (gapless from 0 in each shard).

    Rows of an equal ``group`` share a shard, null being a group of its own; a group above the mean load is alone in its
    shard as far as loads allow. Every group is scheduled, at every size of the input: what the driver holds is the number
    of groups of each size, at most the square root of twice all bytes. Group sizes are combined before the shuffle, so a
    group with a third of all rows is one number; the schedule is written in parts of ``PART_CLASSES`` sizes; no text and no group is ever gathered. Null and negative sizes count 0;
    repeated rows each count; an empty table gives an empty result. Other columns pass through, those named shard or
    slot are replaced.
    """
    if shards < 1:
        raise ValueError("shards must be at least 1")
    key = F.when(group.isNull(), F.lit("")).otherwise(F.concat(F.lit("="), group.cast("string")))
    rows = stored(df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), key.alias("g"), F.greatest(F.lit(0), F.coalesce(size, F.lit(0))).cast("long").alias("size")), "sharding")
    groups = stored(rows.groupBy("g").agg(F.sum("size").alias("size"), F.count("*").alias("n")), "sharding-groups")
    n_groups, n_rows = groups.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    classes = groups.groupBy("size").agg(F.count("*").alias("n")).toPandas().sort_values("size", ascending=False)
    placed = _placed(df.sparkSession, classes["size"].to_numpy(), classes["n"].to_numpy(), shards)
    numbered = _numbered(groups, "size", max(4, n_groups // PIECE_ROWS), "rank").join(F.broadcast(placed) if len(classes) <= BROADCAST_CLASSES else placed, "size")
    where = stored(numbered.select("g", "n", F.get("shards", F.size(F.filter("ends", lambda e: e <= F.col("rank")))).alias("shard")), "sharding-where")
    hot = F.broadcast(where.filter(F.col("n") * HOT >= n_rows).select("g", "shard"))
    cold = where.filter(F.col("n") * HOT < n_rows).select("g", "shard")
    both = rows.join(hot, "g").unionByName(rows.join(hot, "g", "left_anti").join(cold, "g"))
    numbered = _numbered(both.select("shard", "g", "row"), "shard", max(4, n_rows // (shards * PIECE_ROWS)), "slot")
    return numbered.select(*[F.col(f"row.`{c}`") for c in df.columns if c not in ("shard", "slot")], "shard", "slot")


def _placed(spark: SparkSession, sizes: np.ndarray, many: np.ndarray, shards: int) -> DataFrame:
    """The schedule as (size, ends, shards): in a size class, the groups of rank below ends[k] and not below ends[k - 1] go to shards[k]. Written in parts, so that the driver holds one part."""
    path = f"{shared_dir(spark)}/sharding-schedule-{uuid.uuid4().hex}"
    plan, schema = schedule(zip(sizes.tolist(), many.tolist(), strict=True), shards), "size long, ends array<long>, shards array<int>"
    for at in range(0, max(1, len(sizes)), PART_CLASSES):
        part = list(islice(plan, PART_CLASSES))
        rows = pd.DataFrame({"size": sizes[at : at + len(part)], "ends": [np.cumsum([n for _, n in x]).tolist() for x in part], "shards": [[k for k, _ in x] for x in part]})
        spark.createDataFrame(rows, schema).write.mode("append").parquet(path)
    return listed(spark.read.schema(schema).parquet(path), path)


def _numbered(df: DataFrame, key: str, pieces: int, into: str) -> DataFrame:
    """df with gapless numbers from 0 in each key without gathering a key: rows are numbered in hashed pieces of it, and each piece starts where those before it end."""
    dealt = stored(df.withColumn("piece", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(pieces)).cast("int")), "sharding-dealt")
    counts = dealt.groupBy(key, "piece").agg(F.count("*").alias("n_piece"))
    before = counts.withColumn("start", F.coalesce(F.sum("n_piece").over(Window.partitionBy(key).orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("n_piece")
    place = F.row_number().over(Window.partitionBy(key, "piece").orderBy("g")) - 1
    return dealt.withColumn(into, place.cast("long")).join(before, [key, "piece"]).withColumn(into, F.col(into) + F.col("start")).drop("start", "piece")


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = table(spark, sf_dir, "documents").select(
        "doc_id",
        (F.octet_length(text) + ROW_BYTES).cast("long").alias("size"),
        F.crc32(F.encode(text, "utf-8")).alias("text_crc32"),
        F.sha2(text, 256).alias("digest"),
    )
    return assign_shards(rows, F.col("size"), F.col("digest")).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
