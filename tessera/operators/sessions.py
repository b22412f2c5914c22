"""Exchange sessions as a table made by rule, and the classification of bars against them."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import timeops as t


@dataclass(frozen=True)
class Calendar:
    """Hours are local clock times as (hour, minute); an opening the day before has ``overnight``. Weekdays count from Monday, 0."""

    name: str
    zone: str
    open: tuple[int, int]
    close: tuple[int, int]
    weekdays: tuple[int, ...] = (0, 1, 2, 3, 4)
    overnight: bool = False
    lunch: tuple[tuple[int, int], tuple[int, int]] | None = None
    us_holidays: bool = False
    few_holidays: bool = False
    roll: tuple[int, int] | None = None


def _globex(name: str) -> Calendar:
    return Calendar(name, "America/Chicago", (17, 0), (16, 0), overnight=True, few_holidays=True, roll=(17, 0))


#: Usual hours of the calendars that instruments name.
CALENDARS = {
    c.name: c
    for c in (
        Calendar("XNYS", "America/New_York", (9, 30), (16, 0), us_holidays=True),
        Calendar("XHKG", "Asia/Hong_Kong", (9, 30), (16, 0), lunch=((12, 0), (13, 0))),
        Calendar("HKEX", "Asia/Hong_Kong", (9, 30), (16, 0), lunch=((12, 0), (13, 0))),
        Calendar("CME_EQUITY", "America/Chicago", (17, 0), (16, 0), overnight=True, roll=(17, 0)),
        *map(_globex, ("CME_Equity", "CBOT_Bond", "CBOT_Equity", "CBOT_Rate", "CMEGlobex_CL", "GC", "SI")),
        Calendar("CFE", "America/Chicago", (8, 30), (15, 15), us_holidays=True),
        Calendar("CBOE_Index_Options", "America/Chicago", (8, 30), (15, 15), us_holidays=True),
        Calendar("ICE", "America/New_York", (20, 0), (18, 0), overnight=True, few_holidays=True, roll=(20, 0)),
        Calendar("EUREX", "Europe/Berlin", (9, 0), (17, 30), few_holidays=True),
        Calendar("EUREX_Bond", "Europe/Berlin", (1, 10), (22, 0), few_holidays=True),
        Calendar("24/7", "UTC", (0, 0), (24, 0), weekdays=tuple(range(7))),
    )
}


def _easter(year: int) -> date:
    a, b, c = year % 19, year // 100, year % 100
    h = (19 * a + b - b // 4 - (b - (b + 8) // 25 + 1) // 3 + 15) % 30
    w = (32 + 2 * (b % 4) + 2 * (c // 4) - h - c % 4) % 7
    m = (a + 11 * h + 22 * w) // 451
    month, day = divmod(h + w - 7 * m + 114, 31)
    return date(year, month, day + 1)


def us_holidays(year: int) -> dict[date, bool]:
    """Days without a session (False) and with an early close at 13:00 (True), by today's rules. One-off closures aren't known."""

    def nth(month: int, weekday: int, n: int) -> date:
        first = date(year, month, 1)
        return first + timedelta(days=(weekday - first.weekday()) % 7 + 7 * (n - 1))

    def observed(d: date, saturday_counts: bool = True) -> date | None:
        if d.weekday() == 5:
            return d - timedelta(days=1) if saturday_counts else None
        return d + timedelta(days=1) if d.weekday() == 6 else d

    last_may = nth(6, 0, 1) - timedelta(days=7)
    thanks = nth(11, 3, 4)
    closed = [observed(date(year, 1, 1), False), nth(1, 0, 3), nth(2, 0, 3), _easter(year) - timedelta(days=2), last_may, observed(date(year, 7, 4)), nth(9, 0, 1), thanks, observed(date(year, 12, 25))]
    if year >= 2022:
        closed.append(observed(date(year, 6, 19)))
    out = {d: False for d in closed if d}
    for early in (thanks + timedelta(days=1), date(year, 12, 24), date(year, 7, 3)):
        if early.weekday() < 5 and early not in out:
            out[early] = True
    return out


def few_holidays(year: int) -> dict[date, bool]:
    """The days on which nearly every exchange is closed: New Year, Good Friday, Christmas."""
    return {date(year, 1, 1): False, _easter(year) - timedelta(days=2): False, date(year, 12, 25): False}


def _at(day: Column, clock: tuple[int, int], zone: str) -> Column:
    h, m = clock
    local = t.plus_minutes(day.cast("timestamp_ntz"), 60 * h + m)
    return t.utc_time(local, zone)


def sessions(spark: SparkSession, calendar: str | Calendar, start: date, end: date, closed: tuple[date, ...] = ()) -> DataFrame:
    """Regular sessions with trading dates from start to end, both included: calendar, trading_date, open_ts, close_ts, break_start, break_end, is_shortened.

    The length that is usual is the most frequent one, the least of several; a session is shortened if it is over a
    minute below it. Rules don't know one-off or lunar holidays: ``closed`` names such days. Anyone with a better
    schedule passes a table of these columns to the operators instead.
    """
    c = CALENDARS[calendar] if isinstance(calendar, str) else calendar
    rule = us_holidays if c.us_holidays else few_holidays if c.few_holidays else lambda y: {}
    special = {d: early for y in range(start.year, end.year + 1) for d, early in rule(y).items()} | dict.fromkeys(closed, False)
    days = spark.range((end - start).days + 1).select(F.date_add(F.lit(start), F.col("id").cast("int")).alias("trading_date")).filter(F.weekday("trading_date").isin(*c.weekdays))
    if without := [d for d, early in special.items() if not early]:
        days = days.filter(~F.col("trading_date").isin(without))
    day = F.col("trading_date")
    close = _at(day, c.close, c.zone)
    if early := [d for d, e in special.items() if e]:
        close = F.when(day.isin(early), _at(day, (13, 0), c.zone)).otherwise(close)
    none = F.lit(None).cast("timestamp_ntz")
    out = days.select(
        F.lit(c.name).alias("calendar"),
        "trading_date",
        _at(F.date_sub(day, 1) if c.overnight else day, c.open, c.zone).alias("open_ts"),
        close.alias("close_ts"),
        (_at(day, c.lunch[0], c.zone) if c.lunch else none).alias("break_start"),
        (_at(day, c.lunch[1], c.zone) if c.lunch else none).alias("break_end"),
    )
    return with_shortened(out)


def with_shortened(found: DataFrame) -> DataFrame:
    length = t.micros(F.col("close_ts")) - t.micros(F.col("open_ts"))
    usual = found.groupBy("calendar").agg(F.expr("mode() WITHIN GROUP (ORDER BY unix_micros(cast(close_ts as timestamp)) - unix_micros(cast(open_ts as timestamp)))").alias("_usual"))
    return found.join(usual, "calendar").withColumn("is_shortened", length < F.col("_usual") - t.MINUTE).drop("_usual")


def overlapping(found: DataFrame, start, end) -> DataFrame:
    """Sessions with a moment in common with a window, touching ends not counted."""
    return found.filter((F.col("close_ts") > t.moment(start)) & (F.col("open_ts") < t.moment(end)))


ADDED = ("trading_date", "day_of_week", "is_regular", "is_extended", "session_type", "minutes_since_open", "minutes_until_close", "is_holiday", "is_shortened")


def classify(bars: DataFrame, found: DataFrame, calendar: str | Calendar) -> DataFrame:
    """bars with trading_date, day_of_week, is_regular, is_extended, session_type, minutes_since_open, minutes_until_close, is_holiday, is_shortened.

    ``found`` is a sessions table, made by rule or brought along; the calendar gives the zone and when a date rolls.

    A session is listed under each UTC day that it touches, so the search for a bar's session is an equality join on
    the day with the hours as a further condition, and sessions across midnight are found.
    """
    c = CALENDARS[calendar] if isinstance(calendar, str) else calendar
    roll = F.lit(60 * c.roll[0] + c.roll[1]) if c.roll else None
    return _classified(bars.withColumn("_cal", F.lit("")), found.withColumn("calendar", F.lit("")), F.lit(c.zone), roll).drop("_cal")


def by_day(found: DataFrame) -> DataFrame:
    """Each session once for each UTC day that it touches, as ``_day``."""
    return found.withColumn("_day", F.explode(F.sequence(F.to_date("open_ts"), F.to_date(t.from_micros(t.micros(F.col("close_ts")) - 1)))))


def _classified(bars: DataFrame, found: DataFrame, zone: Column, roll: Column | None) -> DataFrame:
    """bars, which name their calendar in ``_cal``, classified against its sessions; zone and roll, in minutes of the local day, may be columns."""
    bars = bars.drop(*[x for x in ADDED if x in bars.columns])
    local = t.local_time(F.col("open_ts"), zone)
    candidate = F.to_date(local)
    if roll is not None:
        candidate = F.when(F.hour(local) * 60 + F.minute(local) >= roll, F.date_add(candidate, 1)).otherwise(candidate)
    listed = by_day(found).select(F.col("calendar").alias("_of"), F.col("_day").alias("_on"), F.col("trading_date").alias("_date"), F.col("open_ts").alias("_open"), F.col("close_ts").alias("_close"), F.col("break_start").alias("_b0"), F.col("break_end").alias("_b1"), F.col("is_shortened").alias("_short"))
    dates = found.select(F.col("calendar").alias("_dated"), F.col("trading_date").alias("_date_of")).distinct().withColumn("_is_session_day", F.lit(True))
    out = bars.withColumns({"_day": F.to_date("open_ts"), "_candidate": candidate})
    inside = (F.col("open_ts") >= F.col("_open")) & (F.col("open_ts") < F.col("_close"))
    out = out.join(listed, (F.col("_cal") == F.col("_of")) & (F.col("_day") == F.col("_on")) & inside, "left").drop("_of", "_on")
    out = out.join(dates, (F.col("_cal") == F.col("_dated")) & (F.col("_candidate") == F.col("_date_of")), "left").drop("_dated", "_date_of")
    in_session = F.col("_date").isNotNull()
    on_break = in_session & F.coalesce((F.col("open_ts") >= F.col("_b0")) & (F.col("open_ts") < F.col("_b1")), F.lit(False))
    session_day = F.coalesce("_is_session_day", F.lit(False))
    kind = F.when(on_break, "scheduled_break_observation").when(in_session, "regular_session").when(session_day, "extended_session").otherwise("outside_scheduled_market")
    out = out.withColumns({
        "trading_date": F.when(in_session, F.col("_date")).otherwise(F.col("_candidate")),
        "is_regular": in_session & ~on_break,
        "is_extended": kind == "extended_session",
        "session_type": kind,
        "minutes_since_open": F.when(in_session & ~on_break, t.minutes_between(F.col("_open"), F.col("open_ts"))),
        "minutes_until_close": F.when(in_session & ~on_break, t.minutes_between(F.col("open_ts"), F.col("_close"))),
        "is_holiday": ~session_day,
        "is_shortened": in_session & F.coalesce("_short", F.lit(False)),
    })
    return out.withColumn("day_of_week", F.weekday("trading_date")).drop("_short", "_day", "_candidate", "_date", "_open", "_close", "_b0", "_b1", "_is_session_day")


def unclassified(bars: DataFrame, zone: str) -> DataFrame:
    """bars of an instrument without a calendar: local dates, flags and minutes unknown."""
    none, day, false = F.lit(None).cast("boolean"), F.to_date(t.local_time(F.col("open_ts"), zone)), F.lit(False)
    minutes = F.lit(None).cast("bigint")
    return bars.withColumns({"trading_date": day, "day_of_week": F.weekday(day), "is_regular": none, "is_extended": none, "session_type": F.lit("unclassified_no_calendar"), "minutes_since_open": minutes, "minutes_until_close": minutes, "is_holiday": false, "is_shortened": false})


def expected_slots(found: DataFrame, start, end, minutes: int = 5) -> DataFrame:
    """(calendar, trading_date, slot_ts): the slots of sessions clipped to a window, without breaks."""
    lo = F.greatest(F.col("open_ts"), t.moment(start))
    hi = F.least(F.col("close_ts"), t.moment(end))
    clipped = found.withColumns({"_lo": t.ceil_minutes(lo, minutes), "_hi": hi}).filter("_lo < _hi")
    last = t.from_micros(t.micros(F.col("_hi")) - 1)
    slots = clipped.withColumn("slot_ts", F.explode(t.grid(F.col("_lo"), F.greatest(F.col("_lo"), last), minutes)))
    on_break = F.coalesce((F.col("slot_ts") >= F.col("break_start")) & (F.col("slot_ts") < F.col("break_end")), F.lit(False))
    return slots.filter(~on_break).select("calendar", "trading_date", "slot_ts")


def decision_times(bars: DataFrame, zone: str = "Europe/London", hours: tuple[int, ...] = (14, 17, 19)) -> DataFrame:
    """For each trading date with a regular bar: the moments of local decision hours in UTC, against the session's open and close."""
    days = bars.filter("is_regular").groupBy("symbol", "trading_date").agg(F.min("open_ts").alias("session_open"), F.max("close_ts").alias("session_close"))
    out = days.withColumn("local_hour", F.explode(F.array(*[F.lit(h) for h in hours])))
    at = t.utc_time(t.plus_minutes(F.col("trading_date").cast("timestamp_ntz"), F.col("local_hour") * 60), zone)
    out = out.withColumn("decision_ts", at)
    return out.withColumns({
        "minutes_from_open": t.minutes_between(F.col("session_open"), F.col("decision_ts")),
        "minutes_until_close": t.minutes_between(F.col("decision_ts"), F.col("session_close")),
        "is_before_open": F.col("decision_ts") < F.col("session_open"),
        "is_in_session": (F.col("session_open") <= F.col("decision_ts")) & (F.col("decision_ts") < F.col("session_close")),
    })
