"""Instruments of many calendars in one frame: zone, session rules and what to expect follow from a catalogue, row by row."""

from __future__ import annotations

from datetime import date
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import timeops as t
from . import quality as Q
from . import sessions as S

#: Of an instrument: its symbol, its calendar's name, its time zone where it has no calendar, and whether its market never closes.
CATALOGUE = ("symbol", "session_calendar", "exchange_timezone", "always_open")
UTC = "UTC"


def rules(spark: SparkSession, calendars: dict[str, S.Calendar] = S.CALENDARS) -> DataFrame:
    """(calendar, zone, roll_minutes) of each known calendar."""
    return spark.createDataFrame([(c.name, c.zone, 60 * c.roll[0] + c.roll[1] if c.roll else None) for c in calendars.values()], "calendar string, zone string, roll_minutes int")


def market_sessions(spark: SparkSession, catalogue: DataFrame, start: date, end: date, closed: dict[str, tuple[date, ...]] | None = None) -> DataFrame:
    """The sessions of all calendars that a catalogue names, once each; a name without rules is an error. There are at most as many as there are rules."""
    named = {r[0] for r in catalogue.select("session_calendar").filter("session_calendar is not null").distinct().limit(len(S.CALENDARS) + 1).collect()}
    if unknown := sorted(named - S.CALENDARS.keys()):
        raise ValueError(f"calendars without rules: {', '.join(unknown)}")
    found = [S.sessions(spark, name, start, end, (closed or {}).get(name, ())) for name in sorted(named)]
    none = S.sessions(spark, "24/7", start, start).limit(0)
    return reduce(DataFrame.unionByName, found, none) if found else none


def _with_market(bars: DataFrame, catalogue: DataFrame) -> DataFrame:
    """bars with _cal, _zone, _roll and _never, those of instruments that aren't in the catalogue without a calendar and in UTC."""
    known = catalogue.select(F.col("symbol").alias("_s"), F.col("session_calendar").alias("_cal"), F.col("exchange_timezone").alias("_own"), F.coalesce("always_open", F.lit(False)).alias("_never"))
    known = known.join(rules(bars.sparkSession), F.col("_cal") == F.col("calendar"), "left")
    known = known.select("_s", "_cal", F.coalesce("zone", "_own", F.lit(UTC)).alias("_zone"), F.col("roll_minutes").alias("_roll"), "_never")
    return bars.join(known, F.col("symbol") == F.col("_s"), "left").drop("_s").withColumns({"_zone": F.coalesce("_zone", F.lit(UTC)), "_never": F.coalesce("_never", F.lit(False))})


def classify(bars: DataFrame, catalogue: DataFrame, found: DataFrame) -> DataFrame:
    """bars with the columns of ``sessions.classify``, each by its instrument's own calendar; those without one get local dates and unknown flags.

    One plan whatever the number of instruments and calendars: zone and roll are columns, and sessions are joined by
    calendar and UTC day. ``found`` is a sessions table of all the calendars, made by ``market_sessions`` or brought along.
    """
    out = S._classified(_with_market(bars, catalogue), found, F.col("_zone"), F.col("_roll"))
    bare = F.col("_cal").isNull()
    return out.withColumns({
        "is_regular": F.when(~bare, F.col("is_regular")),
        "is_extended": F.when(~bare, F.col("is_extended")),
        "session_type": F.when(bare, "unclassified_no_calendar").otherwise(F.col("session_type")),
        "is_holiday": ~bare & F.col("is_holiday"),
    }).drop("_cal", "_zone", "_roll", "_never")


def _slots(lo: Column, hi: Column, minutes: int) -> Column:
    """How many slots begin in [lo, hi), counted from the first at or after lo; 0 for an empty stretch."""
    step = minutes * t.MINUTE
    return F.greatest(F.lit(0).cast("long"), F.ceil((t.micros(hi) - t.micros(t.ceil_minutes(lo, minutes))) / step))


def clipped(found: DataFrame, start, end, minutes: int = 5) -> DataFrame:
    """Sessions that have slots in a window, with _lo and _hi, where they begin and end in it, and n_slots, breaks not counted. No slot is made."""
    lo, hi = F.greatest(F.col("open_ts"), t.moment(start)), F.least(F.col("close_ts"), t.moment(end))
    b0, b1 = F.greatest(F.col("break_start"), F.col("_lo")), F.least(F.col("break_end"), F.col("_hi"))
    on_break = F.when(F.col("break_start").isNotNull() & (b0 < b1), _slots(b0, b1, minutes)).otherwise(F.lit(0))
    out = found.withColumns({"_lo": t.ceil_minutes(lo, minutes), "_hi": hi})
    return out.withColumn("n_slots", _slots(F.col("_lo"), F.col("_hi"), minutes) - on_break).filter("n_slots > 0")


def coverage(bars: DataFrame, catalogue: DataFrame, found: DataFrame, start, end, minutes: int = 5) -> DataFrame:
    """The columns of ``coverage.coverage``, one row for each instrument of the catalogue, also those without bars, each on its own basis.

    With a calendar that has sessions in the window, what is expected are their slots; without, every slot from the
    first to the last bar where the market never closes, else from each date's first to its last bar, and what is missing
    inside is estimated from gaps within a date. Bars are classified ones, within the window.

    Slots are counted, not made: whether a bar is on one follows from its session's bounds. Rows are dealt by symbol
    and date, and what a date comes to is one row.
    """
    sessions = clipped(found, start, end, minutes)
    per = sessions.groupBy("calendar").agg(F.sum("n_slots").alias("_slots"), F.count("*").alias("_sessions"))
    known = catalogue.select("symbol", "session_calendar", F.coalesce("always_open", F.lit(False)).alias("always_open")).join(per, F.col("session_calendar") == F.col("calendar"), "left").drop("calendar")
    listed = S.by_day(sessions).select(F.col("calendar").alias("_of"), F.col("_day").alias("_on"), F.col("trading_date").alias("_date"), "_lo", "_hi", F.col("break_start").alias("_b0"), F.col("break_end").alias("_b1"), "n_slots")
    ts = F.col("open_ts")
    rows = bars.select("symbol", "open_ts", "trading_date", "is_regular").join(known.select(F.col("symbol").alias("_s"), F.col("session_calendar").alias("_cal")), F.col("symbol") == F.col("_s"), "left").drop("_s")
    rows = rows.join(listed, (F.col("_cal") == F.col("_of")) & (F.to_date("open_ts") == F.col("_on")) & (ts >= F.col("_lo")) & (ts < F.col("_hi")), "left")
    on_break = F.coalesce((ts >= F.col("_b0")) & (ts < F.col("_b1")), F.lit(False))
    hit = F.col("_date").isNotNull() & F.coalesce("is_regular", F.lit(False)) & t.on_boundary(ts, minutes) & ~on_break
    rows = rows.withColumn("_hit", hit).withColumn("_dated", F.col("_hit") & (F.col("_date") == F.col("trading_date")))
    w = Window.partitionBy("symbol", "trading_date").orderBy("open_ts", F.desc("_dated"))
    before = F.lag("open_ts").over(w)
    gap = F.floor((t.micros(ts) - t.micros(before)) / (minutes * t.MINUTE)) - 1
    rows = rows.withColumns({"_new": F.coalesce(ts != before, F.lit(True)), "_gap": F.greatest(F.lit(0).cast("long"), F.coalesce(gap, F.lit(0).cast("long")))})
    dates = rows.groupBy("symbol", "trading_date").agg(
        F.count("*").alias("n"),
        F.min("open_ts").alias("lo"),
        F.max("open_ts").alias("hi"),
        F.sum("_gap").alias("gaps"),
        F.count_if("_hit").alias("hits"),
        F.count_if(F.col("_dated") & F.col("_new")).alias("seen"),
        F.max(F.when(F.col("_dated"), F.col("n_slots"))).alias("slots"),
    )
    span = lambda lo, hi: F.floor((t.micros(hi) - t.micros(lo)) / (minutes * t.MINUTE)).cast("long") + 1
    seen = dates.groupBy("symbol").agg(
        F.sum("n").alias("n_observed"),
        F.count("trading_date").alias("n_dates"),
        F.min("lo").alias("first_ts"),
        F.max("hi").alias("last_ts"),
        F.sum("gaps").alias("_gaps"),
        F.sum("hits").alias("_hits"),
        F.sum("seen").alias("_seen"),
        F.count_if(F.col("seen") == F.col("slots")).alias("_whole"),
        F.sum(span(F.col("lo"), F.col("hi"))).alias("_envelope"),
    )
    zero, scheduled = F.lit(0).cast("long"), F.col("_slots").isNotNull()
    out = known.join(seen, "symbol", "left").withColumns({c: F.coalesce(c, zero) for c in ("n_observed", "n_dates", "_gaps", "_hits", "_seen", "_whole", "_envelope")})
    always = F.when(F.col("n_observed") > 0, span(F.col("first_ts"), F.col("last_ts"))).otherwise(zero)
    out = out.withColumns({
        "n_expected": F.when(scheduled, F.col("_slots")).when(F.col("always_open"), always).otherwise(F.col("_envelope")),
        "n_covering": F.when(scheduled, F.col("_hits")).otherwise(F.col("n_observed")),
    })
    some = F.col("n_expected") > 0
    return out.select(
        "symbol",
        t.moment(start).alias("window_start"),
        t.moment(end).alias("window_end"),
        "n_observed", "n_dates", "first_ts", "last_ts",
        F.col("_sessions").alias("scheduled_sessions"),
        "n_covering", "n_expected",
        F.when(some, F.greatest(zero, F.col("n_expected") - F.col("n_covering"))).alias("missing_expected"),
        F.when(scheduled, F.col("_sessions") - F.col("_whole")).alias("sessions_with_missing"),
        F.when(scheduled, F.col("_slots") - F.col("_seen")).otherwise(F.col("_gaps")).alias("missing_inside"),
        F.when(some, F.col("n_covering") * 100.0 / F.col("n_expected")).alias("coverage_percentage"),
        F.when(scheduled, "calendar").when(F.col("always_open"), "always_open").otherwise("observed_envelope").alias("expected_basis"),
    )


def evaluate(bars: DataFrame, catalogue: DataFrame, settings: Q.Settings = Q.Settings(), only: tuple[str, ...] | None = None) -> DataFrame:
    """The issues of ``quality.evaluate``, with each instrument's own zone and its own word on whether its market never closes.

    An instrument whose zone no database knows has one issue for that, and none for dates; without a zone there are none
    for dates either.
    """
    bad = Q.invalid_zones(catalogue)
    zones = catalogue.join(bad.select(F.col("symbol").alias("_bad")), F.col("symbol") == F.col("_bad"), "left")
    zones = zones.select(F.col("symbol").alias("_s"), F.when(F.col("_bad").isNull(), F.col("exchange_timezone")).alias("_zone"), F.coalesce("always_open", F.lit(False)).alias("_never"))
    found = Q.evaluate(bars.join(zones, F.col("symbol") == F.col("_s"), "left").drop("_s"), settings, zone=F.col("_zone"), always_open=F.coalesce("_never", F.lit(False)), only=only)
    if only is not None and "invalid_exchange_timezone" not in only:
        return found
    first = bars.join(bad.select(F.col("symbol").alias("_bad"), "exchange_timezone"), F.col("symbol") == F.col("_bad")).groupBy("symbol").agg(F.min_by("bar_id", F.struct("open_ts", "bar_id")).alias("bar_id"), F.min("open_ts").alias("issue_ts"), F.first("exchange_timezone").alias("observed_value"))
    text = {"issue_type": "invalid_exchange_timezone", "severity": "error", "disposition": "retained", "expected": "a zone of the time-zone database"}
    return found.unionByName(first.withColumns({k: F.lit(v) for k, v in text.items()}).select(*found.columns))


def expected_slots(catalogue: DataFrame, found: DataFrame, start, end, minutes: int = 5) -> DataFrame:
    """(symbol, trading_date, slot_ts) of every instrument with a calendar, as ``coverage.missing_slots`` takes them."""
    slots = S.expected_slots(found, start, end, minutes)
    return catalogue.select("symbol", F.col("session_calendar").alias("_cal")).join(slots, F.col("_cal") == F.col("calendar")).select("symbol", "trading_date", "slot_ts")
