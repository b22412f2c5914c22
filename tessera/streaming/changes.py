"""Contract rolls and gap-safe returns of a stream of bars: each symbol's last bar is keyed state, which a timer drops.

The state meets one row a symbol and Arrow batch. Bars pass it by and are compared in windows by symbol and day, with the
last bar of earlier batches put before them, so a symbol is as many tasks as a batch has days of it.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions import timeops as t
from ..functions.windows import lagged
from ..sources import tables
from .bars import MergedTable

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
BAR = "symbol string, at long, seq long, close double, contract string"
BEFORE = "symbol string, at long, close double, contract string, watermark long"
KEYS = ["symbol", "open_ts"]


def _newest(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Each symbol's last bar of each part; of one moment the last by sequence."""
    for part in parts:
        yield part.sort_values(["at", "seq"]).drop_duplicates("symbol", keep="last")


class LastBar(StatefulProcessor):
    """Keeps each symbol's last bar, and gives the one from before this batch, or a row of nulls, with the watermark in milliseconds.

    A symbol silent for ``idle_days`` of event time is forgotten.
    """

    def __init__(self, idle_days: int):
        self.idle_ms = idle_days * 86_400_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "at long, close double, contract string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        at, close, contract = self.last.get() if self.last.exists() else (None, None, None)
        yield Row(symbol=key[0], at=at, close=close, contract=contract, watermark=timerValues.getCurrentWatermarkInMs())
        new = max(rows, key=lambda r: (r["at"], r["seq"] is None, r["seq"] or 0))
        if at is None or new["at"] > at:
            self.last.update((new["at"], new["close"], new["contract"]))
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(new["at"] // 1000 + self.idle_ms)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        self.last.clear()
        yield from ()

    def close(self) -> None:
        pass


def carried(bars: DataFrame, late: str = "1 hour", idle_days: int = 30) -> DataFrame:
    """A stream of bars with symbol, open_ts, close, contract and ingest_seq, and in each batch for each of its symbols a row ``is_before``: the last bar of earlier batches."""
    rows = bars.select(F.col("symbol"), t.micros(F.col("open_ts")).alias("at"), F.col("ingest_seq").alias("seq"), "close", "contract").filter("at is not null")
    last = rows.mapInPandas(_newest, BAR).withColumn("ts", F.timestamp_micros("at")).withWatermark("ts", late)
    before = last.groupBy("symbol").transformWithState(LastBar(idle_days), BEFORE, "append", "EventTime")
    return rows.withColumn("is_before", F.lit(False)).unionByName(before.withColumn("is_before", F.lit(True)), allowMissingColumns=True)


def compared(bars: DataFrame, before: DataFrame, minutes: int = 5, idle_days: int = 30) -> DataFrame:
    """(symbol, open_ts, close, contract, return, is_roll, outgoing_contract) of a batch: each bar against the one before it of its symbol, also if that came in an earlier batch.

    Bars at or before the last one seen came too late and are left out; so are those of a symbol without one that are
    older than any that could have been forgotten by now. Of bars of one moment the last by sequence counts, as in a grid.
    """
    limit = F.coalesce("at", F.col("watermark") * 1000 - idle_days * 86_400_000_000)
    limits = before.select(F.col("symbol").alias("_symbol"), limit.alias("_limit"))
    new = bars.join(limits, F.col("symbol").eqNullSafe(F.col("_symbol")) & (F.col("at") > F.col("_limit")))
    one = new.groupBy("symbol", "at").agg(F.max_by(F.struct("close", "contract"), F.struct(F.col("seq").isNull(), F.col("seq"))).alias("_bar")).select("symbol", "at", "_bar.*", F.lit(True).alias("_new"))
    series = one.unionByName(before.filter("at is not null").select("symbol", "at", "close", "contract", F.lit(False).alias("_new")))
    series = lagged(series.withColumn("open_ts", t.from_micros(F.col("at"))), "symbol", "open_ts", (), {"_at": "at", "_close": "close", "_contract": "contract"})
    known = (F.col("at") - F.col("_at") == minutes * t.MINUTE) & (F.col("_close") != 0) & ~F.isnan("_close")
    code = F.coalesce("contract", F.lit(""))
    roll = F.col("_at").isNotNull() & (code != "") & (code != F.coalesce("_contract", F.lit("")))
    found = {"return": F.when(known, F.col("close") / F.col("_close") - 1), "is_roll": roll, "outgoing_contract": F.when(roll, F.col("_contract"))}
    return series.filter("_new").select("symbol", "open_ts", "close", "contract", *[c.alias(n) for n, c in found.items()])


def run(spark: SparkSession, directory: str, root: str, files_per_batch: int = 1 << 30, minutes: int = 5, late: str = "1 hour", idle_days: int = 30, states: int = 8) -> MergedTable:
    """All bars in a directory of Parquet files, oldest files first, through the stream until none are left; goes on where an earlier run with this root ended. Files of one batch may hold bars in any order, those of a later one only later bars. ``states`` is the number of partitions of a new root's state, which holds a row a symbol."""
    schema = spark.read.option("recursiveFileLookup", True).parquet(directory).schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).option("recursiveFileLookup", True).parquet(directory)
    table = MergedTable(spark, f"{root}/changes")

    def take(batch: DataFrame, batch_id: int) -> None:
        # written once: each look at the batch itself would run the state again, in the stream's session without AQE
        path = f"{root}/batches/{batch_id}"
        batch.write.mode("overwrite").partitionBy("is_before").parquet(path)
        if tables.exists(spark, path, "is_before=true"):
            bars, before = spark.read.schema(BAR).parquet(f"{path}/is_before=false"), spark.read.schema(BEFORE).parquet(f"{path}/is_before=true")
            compared(bars, before, minutes, idle_days).write.mode("overwrite").parquet(f"{path}/found")
            table.merge(spark.read.parquet(f"{path}/found"), batch_id)
        tables.remove(spark, path)

    settings = {"spark.sql.streaming.stateStore.providerClass": ROCKS, "spark.sql.shuffle.partitions": str(states)}  # keyed state with timers needs the first
    old = {key: spark.conf.get(key, None) for key in settings}
    try:
        for key, value in settings.items():
            spark.conf.set(key, value)
        running = carried(stream, late, idle_days).writeStream.outputMode("append").foreachBatch(take).option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start()
    finally:  # the stream has a copy of them; the batches' own work takes the session's
        for key, value in old.items():
            spark.conf.set(key, value) if value else spark.conf.unset(key)
    running.awaitTermination()
    return table


def rolls(found: DataFrame) -> DataFrame:
    """The contract changes in what ``run`` found, with the columns of the batch operator."""
    return found.filter("is_roll").select("symbol", F.col("open_ts").alias("roll_ts"), F.col("open_ts").alias("decision_ts"), "outgoing_contract", F.col("contract").alias("incoming_contract"), F.lit("unadjusted").alias("adjustment"))
