"""Bars from a stream of ticks, merged batch by batch into a Parquet table by day."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import tables

KEYS = ["symbol", "open_ts"]


def tick_stream(spark: SparkSession, directory: str, glob: str = "events.parquet", per_trigger: int = 1000) -> DataFrame:
    schema = spark.read.parquet(f"{directory}/{glob}").schema
    raw = spark.readStream.schema(schema).option("pathGlobFilter", glob).option("maxFilesPerTrigger", per_trigger).parquet(directory)
    volume = F.regexp_extract("props", "(-?[0-9]+)", 1).try_cast("double")
    return raw.select(F.col("event_id").alias("seq"), F.col("event_type").alias("symbol"), F.col("ts").cast("timestamp").alias("ts"), F.col("value").alias("price"), volume.alias("volume"))


def bar_stream(ticks: DataFrame, minutes: int = 5, late: str = "30 minutes") -> DataFrame:
    """Tumbling bars with a watermark: state of a bar is dropped once no tick within ``late`` can reach it."""
    order = F.struct("ts", "seq")
    grouped = ticks.withWatermark("ts", late).groupBy("symbol", F.window("ts", f"{minutes} minutes").alias("w"))
    bars = grouped.agg(F.min_by("price", order).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", order).alias("close"), F.sum("volume").alias("volume"), F.count(F.lit(1)).alias("trade_count"))
    return bars.select("symbol", F.col("w.start").cast("timestamp_ntz").alias("open_ts"), "open", "high", "low", "close", "volume", "trade_count")


class MergedTable:
    """Bars merged batch by batch, by day. Which batches are in it is kept beside the data, so a batch that comes again, also to another process, changes nothing."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def read(self) -> DataFrame | None:
        found = tables.read(self.spark, self.path)
        return None if found is None else found.drop("p_day")

    def merge(self, batch: DataFrame, batch_id: int) -> None:
        tables.merge_into(self.spark, self.path, batch, KEYS, {"p_day": F.to_date("open_ts").cast("string")}, f"batch-{batch_id}")


def _shared(spark: SparkSession) -> str:
    """The folder that driver and executors share; on a local master a temporary one will do."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir names no folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="tessera-stream-")
    return found.rstrip("/")


def run(spark: SparkSession, directory: str, root: str, minutes: int = 5) -> MergedTable:
    """All ticks in a directory through the stream, until none are left; goes on where an earlier run with this root ended."""
    table = MergedTable(spark, f"{root}/bars")
    running = bar_stream(tick_stream(spark, directory), minutes).writeStream.outputMode("update").foreachBatch(table.merge).option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start()
    running.awaitTermination()
    return table


def replay(spark: SparkSession, directory: str, minutes: int = 5) -> DataFrame:
    """All ticks in a directory through the stream; the merged bars."""
    return run(spark, directory, f"{_shared(spark)}/stream-{uuid.uuid4().hex}", minutes).read()
