"""An explicit time grid over all instruments: slots without a bar stay empty, returns never cross a gap."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import timeops as t


def aligned(bars: DataFrame, minutes: int = 5, columns: tuple[str, ...] = ("open", "high", "low", "close", "volume")) -> DataFrame:
    """One row for every symbol and slot between the first and last bar of any symbol.

    Bars off the grid vanish; of several in a slot the last by ``ingest_seq`` stays. A slot is observed if it has a
    close. The return is against the slot before, where both are observed and the earlier close isn't zero.
    Slots are made symbol by symbol from two numbers and meet the bars in one aggregate. As the grid has no holes, a day
    needs one slot of the day before, so rows are dealt by symbol and day once.
    """
    span = Window.partitionBy()  # over as many rows as there are symbols
    by_symbol = bars.groupBy("symbol").agg(F.min("open_ts").alias("lo"), F.max("open_ts").alias("hi")).select("symbol", F.min("lo").over(span).alias("lo"), F.max("hi").over(span).alias("hi"))
    bar = F.struct(*columns)
    slots = by_symbol.select("symbol", F.explode(t.grid(t.floor_minutes(F.col("lo"), minutes), t.floor_minutes(F.col("hi"), minutes), minutes)).alias("slot_ts"))
    seen = bars.filter(t.on_boundary(F.col("open_ts"), minutes)).select("symbol", F.col("open_ts").alias("slot_ts"), bar.alias("bar"), "ingest_seq")
    rows = slots.unionByName(seen, allowMissingColumns=True)
    # each slot once for its own day and, the last of a day, once for the next
    own, next_ = F.to_date("slot_ts"), F.to_date(t.plus_minutes(F.col("slot_ts"), minutes))
    dealt = rows.withColumn("_day", F.explode(F.array_distinct(F.array(own, next_)))).repartition("symbol", "_day")
    last = dealt.groupBy("symbol", "_day", "slot_ts").agg(F.max_by("bar", "ingest_seq").alias("bar"))
    out = last.select("symbol", "slot_ts", "_day", *[F.col(f"bar.{c}").alias(c) for c in columns])
    before = F.lag("close").over(Window.partitionBy("symbol", "_day").orderBy("slot_ts"))
    out = out.withColumn("_before", before).filter(F.col("_day") == own)
    before = F.col("_before")
    return out.withColumns({
        "is_observed": F.col("close").isNotNull(),
        "is_missing": F.col("close").isNull(),
        "return": F.when(F.col("close").isNotNull() & before.isNotNull() & (before != 0), F.col("close") / before - 1),
    }).drop("_before", "_day")
