"""Coverage of expected slots by observed bars."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import timeops as t


def missing_slots(bars: DataFrame, expected: DataFrame) -> DataFrame:
    """(symbol, trading_date, n_missing, first_missing, last_missing): expected slots without a regular bar under the same date."""
    wanted = expected
    if "symbol" not in expected.columns:  # a calendar that all symbols share is one row, which each symbol unfolds
        slots = expected.agg(F.collect_list(F.struct("trading_date", "slot_ts")).alias("slots"))
        wanted = bars.select("symbol").distinct().join(F.broadcast(slots)).select("symbol", F.explode("slots").alias("s")).select("symbol", "s.*")
    seen = bars.filter("is_regular").select("symbol", "trading_date", F.col("open_ts").alias("slot_ts")).distinct()
    gone = wanted.join(seen, ["symbol", "trading_date", "slot_ts"], "left_anti")
    return gone.groupBy("symbol", "trading_date").agg(F.count(F.lit(1)).alias("n_missing"), F.min("slot_ts").alias("first_missing"), F.max("slot_ts").alias("last_missing"))


def gaps(bars: DataFrame, minutes: int = 5) -> DataFrame:
    """Gaps of over a bar within a symbol's UTC day, where no calendar tells what to expect."""
    w = Window.partitionBy("symbol", F.to_date("open_ts")).orderBy("open_ts")
    gap = t.micros(F.col("open_ts")) - t.micros(F.lag("open_ts").over(w))
    found = bars.withColumn("_gap", gap).filter(F.col("_gap") > minutes * t.MINUTE)
    return found.select("symbol", F.col("open_ts").alias("issue_ts"), F.greatest(F.lit(0).cast("long"), F.floor(F.col("_gap") / (minutes * t.MINUTE)) - 1).alias("n_estimated"))


def by_envelope(bars: DataFrame, minutes: int = 5) -> DataFrame:
    """Slots expected if each day ran from its first to its last bar."""
    days = bars.groupBy("symbol", F.to_date("open_ts").alias("day")).agg(F.min("open_ts").alias("lo"), F.max("open_ts").alias("hi"))
    slots = ((t.micros(F.col("hi")) - t.micros(F.col("lo"))) / (minutes * t.MINUTE)).cast("long") + 1
    return days.groupBy("symbol").agg(F.sum(slots).alias("n_expected"), F.count(F.lit(1)).alias("n_days"))


def coverage(bars: DataFrame, expected: DataFrame, catalogue: DataFrame | None = None, start=None, end=None, basis: str = "calendar") -> DataFrame:
    """One row a symbol, also for those of a catalogue without bars: window, rows, dates, sessions, expected and covered slots, what is missing, percentage, basis.

    Bars count as covering if regular and on any expected slot, whatever date they carry; repeated bars count each.
    ``expected`` has (symbol, trading_date, slot_ts) or, for a calendar all symbols share, (trading_date, slot_ts).
    """
    own = "symbol" in expected.columns
    per_symbol = ["symbol"] if own else []
    slots = expected.groupBy(*per_symbol, "slot_ts").agg(F.collect_set("trading_date").alias("_dates")).select(*[F.col(c).alias("_s") for c in per_symbol], F.col("slot_ts").alias("_slot"), "_dates")
    on = [F.col("open_ts") == F.col("_slot"), *[F.col("symbol") == F.col("_s") for _ in per_symbol]]
    rows = bars.select("symbol", "open_ts", "trading_date", "is_regular").join(slots, on, "left")
    hit = F.col("_slot").isNotNull() & F.coalesce("is_regular", F.lit(False))
    rows = rows.select("symbol", "open_ts", "trading_date", hit.alias("_hit"), (hit & F.coalesce(F.array_contains("_dates", F.col("trading_date")), F.lit(False))).alias("_dated"))
    # of several bars in one slot one is told as new, a dated one if there is any
    w = Window.partitionBy("symbol", "trading_date").orderBy("open_ts", F.desc("_dated"))
    rows = rows.withColumn("_new", F.coalesce(F.col("open_ts") != F.lag("open_ts").over(w), F.lit(True)))
    dates = rows.groupBy("symbol", "trading_date").agg(F.count("*").alias("n"), F.min("open_ts").alias("lo"), F.max("open_ts").alias("hi"), F.count_if("_hit").alias("hits"), F.count_if(F.col("_dated") & F.col("_new")).alias("seen"))
    per_date = expected.groupBy(*per_symbol, "trading_date").agg(F.count(F.lit(1)).alias("slots"))
    due = per_date.select(*[F.col(c).alias("_s") for c in per_symbol], F.col("trading_date").alias("_date"), "slots")
    dates = dates.join(due, [F.col("trading_date") == F.col("_date"), *[F.col("symbol") == F.col("_s") for _ in per_symbol]], "left")
    seen = dates.groupBy("symbol").agg(
        F.sum("n").alias("n_observed"), F.count("trading_date").alias("n_dates"), F.min("lo").alias("first_ts"), F.max("hi").alias("last_ts"), F.sum("hits").alias("n_covering"), F.sum("seen").alias("_seen"), F.count_if(F.col("seen") == F.col("slots")).alias("_whole")
    )
    sums = [F.sum("slots").alias("n_expected"), F.count(F.lit(1)).alias("scheduled_sessions")]
    per = per_date.groupBy("symbol").agg(*sums) if own else per_date.agg(*sums)
    base = catalogue.select("symbol").distinct().join(seen, "symbol", "left") if catalogue is not None else seen
    base = base.join(per, "symbol", "left") if own else base.join(F.broadcast(per))  # one row
    zero = F.lit(0).cast("long")
    base = base.withColumns({c: F.coalesce(c, zero) for c in ("n_expected", "_seen", "_whole")})
    base = base.withColumns({"sessions_with_missing": F.coalesce("scheduled_sessions", zero) - F.col("_whole"), "missing_inside": F.col("n_expected") - F.col("_seen")})
    return _rated(base, start, end, F.lit(basis))


def coverage_without_calendar(bars: DataFrame, catalogue: DataFrame | None = None, always_open: bool = False, start=None, end=None, minutes: int = 5) -> DataFrame:
    """The columns of ``coverage`` where no calendar tells what to expect: every slot from the first to the last bar if the market never closes, else from each day's first to its last bar."""
    if always_open:
        expected = bars.groupBy("symbol").agg(((t.micros(F.max("open_ts")) - t.micros(F.min("open_ts"))) / (minutes * t.MINUTE)).cast("long").alias("n")).select("symbol", (F.col("n") + 1).alias("n_expected"))
    else:
        expected = by_envelope(bars, minutes).select("symbol", "n_expected")
    missing = gaps(bars, minutes).groupBy("symbol").agg(F.sum("n_estimated").alias("missing_inside"))
    none = F.lit(None).cast("long")
    base = _observed(bars, catalogue).join(expected, "symbol", "left").join(missing, "symbol", "left")
    base = base.withColumns({"missing_inside": F.coalesce("missing_inside", F.lit(0).cast("long")), "n_covering": F.col("n_observed"), "scheduled_sessions": none, "sessions_with_missing": none})
    return _rated(base, start, end, F.lit("always_open" if always_open else "observed_envelope"))


def _observed(bars: DataFrame, catalogue: DataFrame | None) -> DataFrame:
    seen = bars.groupBy("symbol").agg(F.count(F.lit(1)).alias("n_observed"), F.countDistinct("trading_date").alias("n_dates"), F.min("open_ts").alias("first_ts"), F.max("open_ts").alias("last_ts"))
    return catalogue.select("symbol").distinct().join(seen, "symbol", "left") if catalogue is not None else seen


def _rated(base: DataFrame, start, end, basis: Column) -> DataFrame:
    zero = F.lit(0).cast("long")
    base = base.withColumns({c: F.coalesce(c, zero) for c in ("n_observed", "n_dates", "n_covering", "n_expected")})
    some = F.col("n_expected") > 0
    return base.select(
        "symbol",
        (F.col("first_ts") if start is None else t.moment(start)).alias("window_start"),
        (t.plus_minutes(F.col("last_ts"), 5) if end is None else t.moment(end)).alias("window_end"),
        "n_observed", "n_dates", "first_ts", "last_ts", "scheduled_sessions", "n_covering", "n_expected",
        F.when(some, F.greatest(zero, F.col("n_expected") - F.col("n_covering"))).alias("missing_expected"),
        "sessions_with_missing", "missing_inside",
        F.when(some, F.col("n_covering") * 100.0 / F.col("n_expected")).alias("coverage_percentage"),
        basis.alias("expected_basis"),
    )
