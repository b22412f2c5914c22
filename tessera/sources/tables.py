"""Keyed Parquet tables by partition, merged once a token; what has been done is on disk, so another process can go on."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.merge import merge


def _path(spark: SparkSession, *parts: str):
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path("/".join(parts))
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path


def exists(spark: SparkSession, *parts: str) -> bool:
    fs, path = _path(spark, *parts)
    return fs.exists(path)


def remove(spark: SparkSession, *parts: str) -> None:
    fs, path = _path(spark, *parts)
    fs.delete(path, True)


def names(spark: SparkSession, *parts: str) -> list[str]:
    fs, path = _path(spark, *parts)
    return sorted(s.getPath().getName() for s in fs.listStatus(path)) if fs.exists(path) else []


#: Tasks that list a table's folders; Spark's own number would be one a folder.
LISTERS = 32
_LISTING = "spark.sql.sources.parallelPartitionDiscovery.parallelism"


def read(spark: SparkSession, path: str) -> DataFrame | None:
    """The table, or None before its first merge."""
    _finish(spark, path)
    if not exists(spark, path, "data"):
        return None
    old = spark.conf.get(_LISTING, None)
    spark.conf.set(_LISTING, LISTERS)
    try:
        # partition columns are text as written: a guessed type would turn 0700 into 700
        found = spark.read.parquet(f"{path}/data").schema
        schema = T.StructType([T.StructField(f.name, T.StringType()) if f.name.startswith("p_") else f for f in found])
        return spark.read.schema(schema).parquet(f"{path}/data")
    finally:
        spark.conf.set(_LISTING, old) if old else spark.conf.unset(_LISTING)


def partition(value: Column) -> Column:
    """A value as text that is neither null nor empty, the same for the same values only."""
    text = value.cast("string")
    marked = F.when(text.rlike("^(~|__HIVE)"), F.concat(F.lit("~~"), text)).otherwise(text)
    return F.when(text.isNull(), "~null").when(text == "", "~empty").otherwise(marked)


#: Partitions that a merge names one by one to the scan; where it touches more, their range is named, and the join tells them.
NAMED = 2000


def touched(spark: SparkSession, path: str, rows: DataFrame, by: dict[str, Column]) -> DataFrame | None:
    """The table's rows in the partitions that ``rows`` fall into, other partitions unread; None before the first merge."""
    base = read(spark, path)
    if base is None:
        return None
    places = rows.select(*[partition(c).alias(p) for p, c in by.items()]).distinct()
    named = places.limit(NAMED + 1).collect()
    if len(named) <= NAMED:
        for p in by:
            base = base.filter(F.col(p).isin(sorted({r[p] for r in named})))
    else:
        ends = places.agg(*[f(p).alias(f"{n}_{p}") for p in by for n, f in (("min", F.min), ("max", F.max))]).first()
        for p in by:
            base = base.filter(F.col(p).between(ends[f"min_{p}"], ends[f"max_{p}"]))
    return base.join(places, list(by), "left_semi")


def _finish(spark: SparkSession, path: str) -> None:
    """Publishes merges that were computed whole but not yet, or not wholly, published."""
    for token in names(spark, path, "staged"):
        if exists(spark, path, "staged", token, "_SUCCESS"):
            _publish(spark, path, token)
        else:
            remove(spark, path, "staged", token)


def _publish(spark: SparkSession, path: str, token: str) -> None:
    if not exists(spark, path, "done", token):
        staged = spark.read.parquet(f"{path}/staged/{token}")
        by = [c for c in staged.columns if c.startswith("p_")]
        if not staged.isEmpty():
            staged.hint("rebalance", *by).write.partitionBy(*by).mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(f"{path}/data")
        fs, mark = _path(spark, path, "done", token)
        fs.create(mark).close()
    remove(spark, path, "staged", token)


def merge_into(spark: SparkSession, path: str, updates: DataFrame, keys: list[str], by: dict[str, Column], token: str | None = None, policy: dict[str, str] | None = None) -> bool:
    """Merge updates, unique by keys, into the table at path; False if a merge of this token is already in it.

    ``by`` names the partition columns, which begin with p_, and gives their expressions over the keys, so that equal
    keys share a partition. Keys and partition values may be null. Only touched partitions are read and replaced. The
    result is staged whole, and refused if a key comes twice in it, before anything is replaced; an interrupted
    replacement is repeated by whoever reads or merges next. A merge without a token can't be told from another and
    leaves no mark. One process at a time may write.
    """
    _finish(spark, path)
    if token and exists(spark, path, "done", token):
        return False
    once, token = token is None, token or f"once-{uuid.uuid4().hex}"
    base = touched(spark, path, updates, by)
    updates = updates.withColumns({p: partition(c) for p, c in by.items()})
    if base is not None:
        added = [f for f in updates.schema if f.name not in base.columns]
        updates = merge(base.withColumns({f.name: F.lit(None).cast(f.dataType) for f in added}), updates, keys, policy)
    updates.write.mode("overwrite").parquet(f"{path}/staged/{token}")
    if spark.read.parquet(f"{path}/staged/{token}").groupBy(*keys).count().filter("count > 1").limit(1).count():
        remove(spark, path, "staged", token)
        raise ValueError(f"keys come twice: {', '.join(keys)}")
    _publish(spark, path, token)
    if once:
        remove(spark, path, "done", token)
    return True


def month(ts: str = "open_ts"):
    return F.date_format(ts, "yyyy-MM")
