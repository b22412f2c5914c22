"""Queries over instruments of several calendars in one frame."""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import timeops as t
from ..operators import bars as B, coverage as C, markets as M
from .views import BARS5, RAW, SESSIONS, TICKS, raw_bars, read

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}

FIRST, LAST = date(2023, 12, 28), date(2024, 3, 31)
START, END = datetime(2024, 1, 2), datetime(2024, 1, 23, 12)
#: An instrument for each kind of calendar: day session, lunch break, overnight, round the clock, none, none but never closed, and one without bars.
LISTED = [
    ("click", "XNYS", None, False),
    ("error", "HKEX", None, False),
    ("view", "CME_Equity", None, False),
    ("purchase", "24/7", None, True),
    ("signup_0", None, "Asia/Tokyo", False),
    ("signup_1", None, None, True),
    ("absent", "HKEX", None, False),
]
COLUMNS = "symbol string, session_calendar string, exchange_timezone string, always_open boolean"


def query(name: str, sql: str):
    def add(f):
        QUERIES[name] = f
        ORACLE_SQL[name] = sql
        return f

    return add


def catalogue(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(LISTED, COLUMNS)


def ticks(spark: SparkSession, sf: str) -> DataFrame:
    """Each event as a bar of one moment; those of one type are two instruments."""
    price = F.col("value")
    symbol = F.when(F.col("event_type") == "signup", F.concat(F.lit("signup_"), (F.col("user_id") % 2).cast("string"))).otherwise(F.col("event_type"))
    contract = F.concat(F.lit("C"), F.floor((F.dayofyear("ts") - 1) / 10).cast("string"))
    volume = F.regexp_extract("props", "(-?[0-9]+)", 1).try_cast("double")
    return read(spark, sf, "events").select(F.col("event_id").alias("ingest_seq"), symbol.alias("symbol"), contract.alias("contract"), F.col("ts").alias("open_ts"), price.alias("open"), price.alias("high"), price.alias("low"), price.alias("close"), volume.alias("volume"), price.alias("vwap"), F.lit(1).cast("long").alias("trade_count"))


def classified(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(classified five-minute bars of the window, catalogue, sessions)."""
    listed = catalogue(spark)
    found = M.market_sessions(spark, listed, FIRST, LAST)
    inside = B.resample(ticks(spark, sf), 5, expected=2).filter((F.col("open_ts") >= t.moment(START)) & (F.col("open_ts") < t.moment(END)))
    return M.classify(inside, listed, found), listed, found


_ZONES = {"XNYS": "America/New_York", "HKEX": "Asia/Hong_Kong", "CME_Equity": "America/Chicago", "24/7": "UTC"}
_LISTED = ", ".join(f"('{s}', {f"'{c}'" if c else 'null'}, '{_ZONES.get(c) or z or 'UTC'}', {1020 if c == 'CME_Equity' else 'null'}, {str(never).lower()})" for s, c, z, never in LISTED)
_TICKS = TICKS.replace("event_type symbol", "case when event_type = 'signup' then 'signup_' || (user_id % 2) else event_type end symbol")
_BARS = BARS5.replace(TICKS, _TICKS)
_MARKETS = f"""{SESSIONS}, cat as (select * from (values {_LISTED}) v(symbol, cal, zone, roll, never)),
  days as (select cast(d as date) d, cast(d as timestamp) t from (select unnest(generate_series(date '2023-12-28', date '2024-03-31', interval 1 day)) d)),
  cals as (
    select 'XNYS' cal, trading_date d, open_ts o, close_ts c, cast(null as timestamp) b0, cast(null as timestamp) b1 from sess
    union all select 'HKEX', d, t + interval 90 minute, t + interval 480 minute, t + interval 240 minute, t + interval 300 minute from days where isodow(d) <= 5
    union all select 'CME_Equity', d, timezone('UTC', timezone('America/Chicago', t - interval 7 hour)), timezone('UTC', timezone('America/Chicago', t + interval 16 hour)), null, null from days where isodow(d) <= 5 and d not in (date '2024-01-01', date '2024-03-29')
    union all select '24/7', d, t, t + interval 24 hour, null, null from days)"""
_PLACED = """x as (select r.*, cat.cal, never, timezone(zone, timezone('UTC', r.{ts})) lt, roll from {of} r join cat on r.symbol = cat.symbol),
  y as (select *, cast(case when roll is not null and hour(lt) * 60 + minute(lt) >= roll then lt + interval 1 day else lt end as date) cand from x),
  z as (select y.*, k.d sd, o, c, coalesce({ts} >= b0 and {ts} < b1, false) on_break, exists (select 1 from cals q where q.cal = y.cal and q.d = y.cand) is_day from y left join cals k on k.cal = y.cal and {ts} >= o and {ts} < c),
  cls as (select *, coalesce(sd, cand) tdate, case when cal is not null then sd is not null and not on_break end regular from z)"""


@query(
    "d16_many_calendars",
    f"""with {_TICKS}, {_MARKETS}, {_PLACED.format(ts='ts', of='ticks')} select seq, symbol, tdate trading_date, cast(isodow(tdate) - 1 as integer) day_of_week, regular is_regular, case when cal is not null then sd is null and is_day end is_extended,
    case when cal is null then 'unclassified_no_calendar' when on_break then 'scheduled_break_observation' when sd is not null then 'regular_session' when is_day then 'extended_session' else 'outside_scheduled_market' end session_type,
    case when regular then (epoch_us(ts) - epoch_us(o)) // 60000000 end minutes_since_open, case when regular then (epoch_us(c) - epoch_us(ts)) // 60000000 end minutes_until_close, cal is not null and not is_day is_holiday, false is_shortened from cls""",
)
def d16_many(spark, sf):
    listed = catalogue(spark)
    out = M.classify(ticks(spark, sf), listed, M.market_sessions(spark, listed, FIRST, LAST))
    return out.select(F.col("ingest_seq").alias("seq"), "symbol", "trading_date", "day_of_week", "is_regular", "is_extended", "session_type", "minutes_since_open", "minutes_until_close", "is_holiday", "is_shortened")


_SLOTS = """slots as (select cal, d, slot_ts from (select cal, d, b0, b1, unnest(generate_series(greatest(o, timestamp '2024-01-02'), least(c, timestamp '2024-01-23 12:00') - interval 5 minute, interval 5 minute)) slot_ts from cals where c > timestamp '2024-01-02' and o < timestamp '2024-01-23 12:00') where not coalesce(slot_ts >= b0 and slot_ts < b1, false))"""
_IN_WINDOW = f"""with {_BARS}, {_MARKETS}, inw as (select * from bars where open_ts >= timestamp '2024-01-02' and open_ts < timestamp '2024-01-23 12:00'), {_PLACED.format(ts='open_ts', of='inw')}, {_SLOTS},
  gone as (select cat.symbol, s.d, s.slot_ts from cat join slots s on s.cal = cat.cal where not exists (select 1 from cls b where b.symbol = cat.symbol and b.regular and b.tdate = s.d and b.open_ts = s.slot_ts))"""


@query(
    "d5_many_calendars",
    f"""{_IN_WINDOW},
    e as (select cal, count(*) n, count(distinct d) sessions from slots group by 1),
    o as (select symbol, count(*) n, count(distinct tdate) n_dates, min(open_ts) first_ts, max(open_ts) last_ts from cls group by 1),
    h as (select symbol, count(*) n from cls b where regular and exists (select 1 from slots s where s.cal = b.cal and s.slot_ts = b.open_ts) group by 1),
    m as (select symbol, count(*) n, count(distinct d) sessions from gone group by 1),
    g as (select symbol, cast(sum(greatest(0, gap // 300000000 - 1)) as bigint) n from (select symbol, epoch_us(open_ts) - epoch_us(lag(open_ts) over (partition by symbol, tdate order by open_ts)) gap from cls) where gap > 300000000 group by 1),
    v as (select symbol, cast(sum(n) as bigint) n from (select symbol, (epoch_us(max(open_ts)) - epoch_us(min(open_ts))) // 300000000 + 1 n from cls group by symbol, tdate) group by 1),
    a as (
      select cat.symbol, coalesce(o.n, 0) n_observed, coalesce(n_dates, 0) n_dates, first_ts, last_ts, e.sessions scheduled_sessions, case when cat.cal is null then coalesce(o.n, 0) else coalesce(h.n, 0) end n_covering,
        case when cat.cal is not null then e.n when never then coalesce((epoch_us(last_ts) - epoch_us(first_ts)) // 300000000 + 1, 0) else coalesce(v.n, 0) end n_expected, case when cat.cal is not null then coalesce(m.sessions, 0) end sessions_with_missing,
        case when cat.cal is not null then coalesce(m.n, 0) else coalesce(g.n, 0) end missing_inside, case when cat.cal is not null then 'calendar' when never then 'always_open' else 'observed_envelope' end expected_basis
      from cat left join o on o.symbol = cat.symbol left join e on e.cal = cat.cal left join h on h.symbol = cat.symbol left join m on m.symbol = cat.symbol left join g on g.symbol = cat.symbol left join v on v.symbol = cat.symbol)
    select *, timestamp '2024-01-02' window_start, timestamp '2024-01-23 12:00' window_end, case when n_expected > 0 then greatest(0, n_expected - n_covering) end missing_expected, case when n_expected > 0 then n_covering * 100.0::double / n_expected end coverage_percentage from a""",
)
def d5_many(spark, sf):
    return M.coverage(*classified(spark, sf), START, END)


@query("q28a_many_calendars", f"{_IN_WINDOW} select symbol, d trading_date, count(*) n_missing, min(slot_ts) first_missing, max(slot_ts) last_missing from gone where symbol in (select symbol from cls) group by 1, 2")
def q28a_many(spark, sf):
    bars, listed, found = classified(spark, sf)
    there = bars.select("symbol").distinct()
    return C.missing_slots(bars, M.expected_slots(listed.join(there, "symbol", "left_semi"), found, START, END))


_ZONED = [("click", None, "America/New_York", False), ("error", None, "Asia/Hong_Kong", False), ("view", None, "Mars/Olympus", False), ("purchase", None, "Asia/Tokyo", True), ("signup", None, None, False)]


@query(
    "d4_many_zones",
    f"""with {RAW}, cat as (select * from (values {", ".join(f"('{s}', {f"'{z}'" if z and not z.startswith('Mars') else 'null'}, {str(never).lower()})" for s, _, z, never in _ZONED)}) v(symbol, zone, never)), j as (select raw.*, zone, never from raw join cat on raw.symbol = cat.symbol)
    select bar_id, symbol, open_ts issue_ts, 'timezone_or_trading_date_mismatch' issue_type, strftime(trading_date, '%Y-%m-%d') observed_value from j where zone is not null and cast(timezone(zone, timezone('UTC', open_ts)) as date) <> trading_date
    union all select bar_id, symbol, open_ts, 'unexpected_weekend_observation', dayname(open_ts) from j where isodow(open_ts) >= 6 and not never
    union all select arg_min(bar_id, struct_pack(o := open_ts, b := bar_id)), symbol, min(open_ts), 'invalid_exchange_timezone', 'Mars/Olympus' from j where symbol = 'view' group by symbol""",
)
def d4_zones(spark, sf):
    listed = spark.createDataFrame(_ZONED, COLUMNS)
    found = M.evaluate(raw_bars(spark, sf), listed, only=("timezone_or_trading_date_mismatch", "unexpected_weekend_observation", "invalid_exchange_timezone"))
    return found.select("bar_id", "symbol", "issue_ts", "issue_type", "observed_value")


@query(
    "d14_contract_rows",
    f"""with {_BARS}, {_MARKETS}, k as (select symbol parent, contract, max(open_ts) last_ts from bars group by 1, 2)
    select parent || '__RAW__' || k.contract symbol, cal session_calendar, never always_open, 'future_contract' instrument_type, k.contract provider_symbol, k.contract, cast(last_ts as date) expiry, false is_continuous, true enabled, false required from k join cat on cat.symbol = parent""",
)
def d14_rows(spark, sf):
    bars = B.resample(ticks(spark, sf), 5, expected=2).withColumns({"expiry": F.to_date("open_ts"), "is_continuous": F.lit(True)})
    return B.contract_rows(bars, catalogue(spark)).drop("exchange_timezone")
