"""Identity operators: duplicates are told by null-safe keys, order by an explicit sequence."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def flag_duplicates(df: DataFrame, keys: list[str], into: str = "is_duplicate") -> DataFrame:
    """Every member of a group of equal keys is flagged; null keys equal each other."""
    return df.withColumn(into, F.count(F.lit(1)).over(Window.partitionBy(*keys)) > 1)


def keep_last(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key by order. Combined before the shuffle, so a hot key is one row a task."""
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.max_by(F.struct(*[F.col(c) for c in rest]), F.struct(*[F.col(c) for c in order])).alias("_row"))
    return best.select(*keys, "_row.*").select(*df.columns)


def revised(df: DataFrame, keys: list[str], vintage: str, into: str = "is_revised") -> DataFrame:
    """Whether a vintage is later than the first of its key."""
    return df.withColumn(into, F.col(vintage) > F.min(vintage).over(Window.partitionBy(*keys)))
