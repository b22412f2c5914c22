"""Official yields: vintages, point-in-time curves, spreads."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.windows import running
from .dedupe import keep_last, revised

#: Spread name: (long leg, short leg).
SPREADS = {
    "us_2s10s": ("US10Y", "US2Y"),
    "us_5s10s": ("US10Y", "US5Y"),
    "us_2s5s": ("US5Y", "US2Y"),
    "de_2s10s": ("DE10Y", "DE2Y"),
    "gb_2s10s": ("GB10Y", "GB2Y"),
    "us_de_10y": ("US10Y", "DE10Y"),
}


def vintages(initial: DataFrame, revisions: DataFrame) -> DataFrame:
    """First releases and revisions as one bitemporal series: the last row of a vintage stays, later vintages than a date's first are revised."""
    rows = initial.withColumn("kind", F.lit(0)).unionByName(revisions.withColumn("kind", F.lit(1)), allowMissingColumns=True)
    rows = keep_last(rows, ["symbol", "observation_date", "vintage_date"], ["kind", "ingest_seq"])
    return revised(rows, ["symbol", "observation_date"], "vintage_date").drop("kind")


def available_from(vintage: str = "vintage_date"):
    """The conservative moment from which a vintage may be used: midnight after its date, UTC."""
    return F.date_add(vintage, 1).cast("timestamp_ntz")


def curve(yields: DataFrame, spreads: dict[str, tuple[str, str]] = SPREADS) -> DataFrame:
    """One row for each availability time: every symbol's last known yield, spreads in basis points, their change and its direction.

    The columns' symbols are those that the spreads name, so the schema doesn't depend on data; times with no known
    value at all are absent; a change without an earlier spread is null and unchanged in direction. Forward filling
    goes day by day; what a day takes over from earlier ones is one row a day, which also tells the spreads before its
    first row.
    """
    symbols = sorted({s for legs in spreads.values() for s in legs})
    order = F.struct("observation_date", "vintage_date", "value")
    of = lambda s, c: F.when(F.col("symbol") == s, c)
    wide = yields.filter(F.col("value").isNotNull() & F.col("symbol").isin(symbols)).groupBy("available_ts").agg(*[F.max_by(of(s, F.col("value")), of(s, order)).alias(s) for s in symbols])
    wide = wide.withColumn("_day", F.to_date("available_ts"))
    known = F.struct(*[F.max_by(s, F.when(F.col(s).isNotNull(), F.col("available_ts"))).alias(s) for s in symbols])
    before = Window.orderBy(F.col("_day").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)  # over as many rows as there are days
    days = wide.groupBy("_day").agg(known.alias("_own")).select(F.col("_day").alias("_d"), F.struct(*[F.last(F.col(f"_own.{s}"), ignorenulls=True).over(before).alias(s) for s in symbols]).alias("_then"))
    w = Window.partitionBy("_day").orderBy(F.col("available_ts").asc_nulls_last())
    up_to = w.rowsBetween(Window.unboundedPreceding, 0)
    filled = wide.join(days, F.col("_day").eqNullSafe(F.col("_d"))).withColumns({s: F.coalesce(F.last(s, ignorenulls=True).over(up_to), F.col(f"_then.{s}")) for s in symbols})
    spread = lambda value, a, b: (value(a) - value(b)) * 100
    filled = filled.withColumns({n: spread(F.col, a, b) for n, (a, b) in spreads.items()}).withColumn("_n", F.row_number().over(w))
    was = {n: F.when(F.col("_n") == 1, spread(lambda s: F.col(f"_then.{s}"), a, b)).otherwise(F.lag(n).over(w)) for n, (a, b) in spreads.items()}
    filled = filled.withColumns({f"{n}_change": F.col(n) - was[n] for n in spreads}).drop("_day", "_d", "_then", "_n")
    return filled.withColumns({f"{n}_direction": F.when(F.col(f"{n}_change") > 0, "steepening").when(F.col(f"{n}_change") < 0, "flattening").otherwise("unchanged") for n in spreads})


def as_of(events: DataFrame, values: DataFrame, key: str, at: str, available: str, value: str, into: str) -> DataFrame:
    """events with the last value whose availability isn't later than each event; null for an event without a time.

    Both streams are one, dealt by key and day; what a day needs from earlier ones is one row, so no range join is
    needed and a key with most of the rows is as many tasks as it has days.
    """
    both = events.withColumns({"_at": F.col(at), "_rank": F.lit(1), "_value": F.lit(None).cast(values.schema[value].dataType)}).unionByName(
        values.select(key, F.col(available).alias("_at"), F.lit(0).alias("_rank"), F.col(value).alias("_value")), allowMissingColumns=True
    )
    found = running(both, key, "_at", ("_rank", "_value"), {"_found": ("last", "_value")}).filter("_rank = 1")
    return found.withColumn(into, F.when(F.col("_at").isNotNull(), F.col("_found"))).drop("_at", "_rank", "_value", "_found")
