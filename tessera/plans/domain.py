"""Queries of the composite operators: bars, sessions, coverage, curves, merges, research."""

from __future__ import annotations

from datetime import date, datetime, timedelta

from pyspark.sql import functions as F

from ..functions import timeops as t
from ..functions.windows import running
from ..operators import align, bars as B, coverage as C, curve as Y, merge as M, research as R, rolls, sessions as S, split as P
from ..streaming import bars as live
from .views import BARS5, RAW, SESSIONS, TICKS, YIELDS, bars5, raw_bars, read, tick_bars, ticks, yields

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}

FIRST, LAST = date(2023, 12, 28), date(2024, 3, 31)
#: The coverage window: three weeks from the second of January 2024.
START, END = datetime(2024, 1, 2), datetime(2024, 1, 23)


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLE_SQL[name] = sql
        return f

    return add


@query("d2_bars_5m", f'with {BARS5} select symbol, contract, open_ts, close_ts, "open", high, low, "close", volume, round(vwap, 6) vwap, trade_count, is_partial from bars')
def d2(spark, sf):
    return bars5(spark, sf).select("symbol", "contract", "open_ts", "close_ts", "open", "high", "low", "close", "volume", F.round("vwap", 6).alias("vwap"), "trade_count", "is_partial")


_BARS15 = """b15 as (
  select symbol, time_bucket(interval 15 minute, open_ts) bar_ts, arg_min("open", open_ts) "open", max(high) high, min(low) low, arg_max("close", open_ts) "close", coalesce(sum(volume), 0) volume,
    cast(sum(trade_count) as bigint) trade_count, count(*) n_observed, min(open_ts) first_ts, max(open_ts) last_ts, count(*) = 3 is_complete from bars group by 1, 2)"""


@query(
    "d10_bars_15m",
    f"""with {BARS5}, {_BARS15} select *, case when is_complete and lag(is_complete) over w and bar_ts - lag(bar_ts) over w = interval 15 minute and lag("close") over w <> 0 then "close" / lag("close") over w - 1 end "return"
    from b15 window w as (partition by symbol order by bar_ts)""",
)
def d10(spark, sf):
    return B.observed_bars(bars5(spark, sf))


_GRID = """grid as (select symbol, unnest(generate_series(lo, hi, interval 5 minute)) slot_ts from (select min(open_ts) lo, max(open_ts) hi from bars), (select distinct symbol from bars)),
  g0 as (select grid.symbol, slot_ts, "open", high, low, "close", volume from grid left join bars on grid.symbol = bars.symbol and slot_ts = open_ts),
  g as (select *, "close" is not null is_observed, "close" is null is_missing, case when lag("close") over (partition by symbol order by slot_ts) <> 0 then "close" / lag("close") over (partition by symbol order by slot_ts) - 1 end "return" from g0)"""


@query("d7_aligned_grid", f"with {BARS5}, {_GRID} select * from g")
def d7(spark, sf):
    return align.aligned(bars5(spark, sf))


@query(
    "d11_decision_times",
    """with d as (select distinct cast(o_orderdate as date) trading_date from orders), x as (
      select trading_date, trading_date + interval 870 minute session_open, trading_date + interval 1260 minute session_close, unnest([14, 17, 19]) local_hour from d),
    y as (select *, timezone('UTC', timezone('Europe/London', trading_date + to_hours(local_hour))) decision_ts from x)
    select 'X' symbol, trading_date, session_open, session_close, local_hour, decision_ts, date_diff('minute', session_open, decision_ts) minutes_from_open, date_diff('minute', decision_ts, session_close) minutes_until_close,
      decision_ts < session_open is_before_open, session_open <= decision_ts and decision_ts < session_close is_in_session from y""",
)
def d11(spark, sf):
    day = F.to_date("o_orderdate")
    bars = read(spark, sf, "orders").select(F.lit("X").alias("symbol"), day.alias("trading_date"), t.plus_minutes(day.cast("timestamp_ntz"), 870).alias("open_ts"), t.plus_minutes(day.cast("timestamp_ntz"), 1260).alias("close_ts"), F.lit(True).alias("is_regular"))
    return S.decision_times(bars)


@query(
    "d13_rolls",
    f"""with {BARS5}, l as (select *, lag(contract) over (partition by symbol order by open_ts, bar_id) was, row_number() over (partition by symbol order by open_ts, bar_id) n from bars)
    select symbol, open_ts roll_ts, open_ts decision_ts, was outgoing_contract, contract incoming_contract, 'unadjusted' adjustment from l where n > 1 and contract <> was""",
)
def d13(spark, sf):
    return rolls.rolls(bars5(spark, sf))


@query("d14_raw_contracts", f"""with {BARS5} select symbol || '__RAW__' || contract symbol, contract, count(*) n, min(open_ts) first_ts, max(open_ts) last_ts from bars group by 1, 2""")
def d14(spark, sf):
    return B.raw_contracts(bars5(spark, sf)).groupBy("symbol", "contract").agg(F.count("*").alias("n"), F.min("open_ts").alias("first_ts"), F.max("open_ts").alias("last_ts"))


_SPAN = "(select cast(min(ts) as date) lo, cast(max(ts) as date) hi from events)"


def _span(spark, sf):
    """First and last day of the events: one row."""
    return read(spark, sf, "events").agg(F.min(F.to_date("ts")), F.max(F.to_date("ts"))).first()


@query("d15_sessions", f"with {SESSIONS} select trading_date, open_ts, close_ts, false is_shortened from sess, {_SPAN} where trading_date between lo and hi")
def d15(spark, sf):
    """The sessions of the days that the events span."""
    return S.sessions(spark, "XNYS", *_span(spark, sf)).select("trading_date", "open_ts", "close_ts", "is_shortened")


_CLASSIFIED = """cls as (
  select x.*, s.trading_date sd, s.open_ts so, s.close_ts sc, cast(timezone('America/New_York', timezone('UTC', x.ots)) as date) cand from (select *, {ts} ots from {of}) x left join sess s on x.ots >= s.open_ts and x.ots < s.close_ts),
  c2 as (select *, coalesce(sd, cand) tdate, sd is not null is_regular, sd is null and cand in (select trading_date from sess) is_extended, cand not in (select trading_date from sess) is_holiday from cls)"""


@query(
    "d16_sessions_classified",
    f"""with {TICKS}, {SESSIONS}, {_CLASSIFIED.format(ts='ts', of='ticks')} select seq, tdate trading_date, is_regular, is_extended, is_holiday,
    case when is_regular then 'regular_session' when is_extended then 'extended_session' else 'outside_scheduled_market' end session_type, case when is_regular then (epoch_us(ots) - epoch_us(so)) // 60000000 end minutes_since_open,
    case when is_regular then (epoch_us(sc) - epoch_us(ots)) // 60000000 end minutes_until_close, cast(isodow(tdate) - 1 as integer) day_of_week, false is_shortened from c2""",
)
def d16(spark, sf):
    return S.classify(tick_bars(spark, sf), S.sessions(spark, "XNYS", FIRST, LAST), "XNYS").select(F.col("ingest_seq").alias("seq"), "trading_date", "is_regular", "is_extended", "is_holiday", "session_type", "minutes_since_open", "minutes_until_close", "day_of_week", "is_shortened")


_KIND = "case when on_break then 'scheduled_break_observation' when sd is not null then 'regular_session' when cand in (select trading_date from s) then 'extended_session' else 'outside_scheduled_market' end"
_SINCE = "case when sd is not null and not on_break then (epoch_us(ts) - epoch_us(o)) // 60000000 end minutes_since_open, case when sd is not null and not on_break then (epoch_us(c) - epoch_us(ts)) // 60000000 end minutes_until_close"


@query(
    "d16_lunch_break",
    f"""with {TICKS}, s as (select cast(d as date) trading_date, cast(d as timestamp) + interval 90 minute o, cast(d as timestamp) + interval 480 minute c from (select unnest(generate_series(date '2023-12-28', date '2024-03-31', interval 1 day)) d) where isodow(d) <= 5),
    j as (select ticks.*, s.trading_date sd, o, c, cast(ts + interval 8 hour as date) cand, coalesce(ts >= o + interval 150 minute and ts < o + interval 210 minute, false) on_break from ticks left join s on ts >= o and ts < c)
    select seq, coalesce(sd, cand) trading_date, {_KIND} session_type, {_SINCE} from j""",
)
def d16_lunch(spark, sf):
    return S.classify(tick_bars(spark, sf), S.sessions(spark, "HKEX", FIRST, LAST), "HKEX").select(F.col("ingest_seq").alias("seq"), "trading_date", "session_type", "minutes_since_open", "minutes_until_close")


@query(
    "d16_overnight",
    f"""with {TICKS}, s as (select cast(d as date) trading_date, timezone('UTC', timezone('America/Chicago', cast(d as timestamp) - interval 7 hour)) o, timezone('UTC', timezone('America/Chicago', cast(d as timestamp) + interval 16 hour)) c
      from (select unnest(generate_series(date '2023-12-28', date '2024-03-31', interval 1 day)) d) where isodow(d) <= 5 and cast(d as date) not in (date '2024-01-01', date '2024-03-29')),
    l as (select *, timezone('America/Chicago', timezone('UTC', ts)) lt from ticks),
    j as (select l.*, s.trading_date sd, o, c, cast(case when hour(lt) >= 17 then lt + interval 1 day else lt end as date) cand, false on_break from l left join s on ts >= o and ts < c)
    select seq, coalesce(sd, cand) trading_date, {_KIND} session_type, {_SINCE} from j""",
)
def d16_overnight(spark, sf):
    return S.classify(tick_bars(spark, sf), S.sessions(spark, "CME_Equity", FIRST, LAST), "CME_Equity").select(F.col("ingest_seq").alias("seq"), "trading_date", "session_type", "minutes_since_open", "minutes_until_close")


def _classified(spark, sf):
    inside = bars5(spark, sf).filter((F.col("open_ts") >= t.moment(START)) & (F.col("open_ts") < t.moment(END)))
    return S.classify(inside, S.sessions(spark, "XNYS", FIRST, LAST), "XNYS")


def _expected(spark):
    return S.expected_slots(S.sessions(spark, "XNYS", FIRST, LAST), START, END).drop("calendar")


_COVER = f"""with {BARS5}, {SESSIONS}, inw as (select * from bars where open_ts >= timestamp '2024-01-02' and open_ts < timestamp '2024-01-23'), {_CLASSIFIED.format(ts='open_ts', of='inw')},
  slots as (select trading_date, unnest(generate_series(open_ts, close_ts - interval 5 minute, interval 5 minute)) slot_ts from sess where open_ts >= timestamp '2024-01-02' and close_ts <= timestamp '2024-01-23')"""


@query(
    "d5_coverage",
    f"""{_COVER}, n as (select count(*) n_expected, count(distinct trading_date) n_sessions from slots),
    w as (select symbol, trading_date, slot_ts from (select distinct symbol from inw), slots), m as (select symbol, count(*) n_missing from w where not exists (select 1 from c2 where is_regular and c2.symbol = w.symbol and c2.tdate = w.trading_date and c2.open_ts = w.slot_ts) group by symbol, trading_date),
    ms as (select symbol, count(*) sessions_with_missing, cast(sum(n_missing) as bigint) missing_inside from m group by 1)
    select c2.symbol, timestamp '2024-01-02' window_start, timestamp '2024-01-23' window_end, any_value(n_sessions) scheduled_sessions, coalesce(any_value(sessions_with_missing), 0) sessions_with_missing, coalesce(any_value(missing_inside), 0) missing_inside, 'calendar' expected_basis, count(*) n_observed, count(distinct tdate) n_dates, min(open_ts) first_ts, max(open_ts) last_ts, count(*) filter (is_regular and open_ts in (select slot_ts from slots)) n_covering, any_value(n_expected) n_expected,
      greatest(0, any_value(n_expected) - count(*) filter (is_regular and open_ts in (select slot_ts from slots))) missing_expected, count(*) filter (is_regular and open_ts in (select slot_ts from slots)) * 100.0::double / any_value(n_expected) coverage_percentage
    from c2 left join ms on c2.symbol = ms.symbol, n group by c2.symbol""",
)
def d5(spark, sf):
    return C.coverage(_classified(spark, sf), _expected(spark), start=START, end=END)


def _without_calendar(expected: str, basis: str) -> str:
    return f"""with {BARS5}, e as ({expected}), g as (select symbol, cast(sum(greatest(0, gap // 300000000 - 1)) as bigint) missing_inside from (select symbol, epoch_us(open_ts) - epoch_us(lag(open_ts) over (partition by symbol, cast(open_ts as date) order by open_ts)) gap from bars) where gap > 300000000 group by 1),
    o as (select symbol, count(*) n_observed, count(distinct cast(open_ts as date)) n_dates, min(open_ts) first_ts, max(open_ts) last_ts from bars group by 1)
    select o.symbol, first_ts window_start, last_ts + interval 5 minute window_end, n_observed, n_dates, first_ts, last_ts, cast(null as bigint) scheduled_sessions, n_observed n_covering, n_expected, greatest(0, n_expected - n_observed) missing_expected,
      cast(null as bigint) sessions_with_missing, coalesce(missing_inside, 0) missing_inside, n_observed * 100.0::double / n_expected coverage_percentage, '{basis}' expected_basis from o join e on o.symbol = e.symbol left join g on o.symbol = g.symbol"""


@query("d5_coverage_envelope", _without_calendar("select symbol, cast(sum(n) as bigint) n_expected from (select symbol, (epoch_us(max(open_ts)) - epoch_us(min(open_ts))) // 300000000 + 1 n from bars group by symbol, cast(open_ts as date)) group by 1", "observed_envelope"))
def d5_envelope(spark, sf):
    return C.coverage_without_calendar(bars5(spark, sf).withColumn("trading_date", F.to_date("open_ts")))


@query("d5_coverage_always_open", _without_calendar("select symbol, (epoch_us(max(open_ts)) - epoch_us(min(open_ts))) // 300000000 + 1 n_expected from bars group by 1", "always_open"))
def d5_always(spark, sf):
    return C.coverage_without_calendar(bars5(spark, sf).withColumn("trading_date", F.to_date("open_ts")), always_open=True)


@query("d16_unclassified", f"with {TICKS}, z as (select *, cast(timezone('Asia/Tokyo', timezone('UTC', ts)) as date) d from ticks) select seq, d trading_date, cast(isodow(d) - 1 as integer) day_of_week, 'unclassified_no_calendar' session_type, false is_holiday from z")
def d16_unclassified(spark, sf):
    return S.unclassified(tick_bars(spark, sf), "Asia/Tokyo").select(F.col("ingest_seq").alias("seq"), "trading_date", "day_of_week", "session_type", "is_holiday")


@query("f15_record_ids", f"with {TICKS} select seq, sha256('=' || symbol || '|' || coalesce('=' || case when seq % 4 <> 0 then contract end, '~')) id from ticks")
def f15(spark, sf):
    from ..functions.schema import record_id

    x = ticks(spark, sf).withColumn("c", F.when(F.col("seq") % 4 != 0, F.col("contract")))
    return x.select("seq", record_id("symbol", "c").alias("id"))


@query("t6_complete_only", f"with {TICKS} select symbol, open_ts from (select distinct symbol, time_bucket(interval 5 minute, ts) open_ts from ticks) where open_ts < timestamp '2024-01-20 10:05'")
def t6(spark, sf):
    from .collect import complete_only

    return complete_only(bars5(spark, sf).select("symbol", "open_ts").distinct(), datetime(2024, 1, 20, 10, 7, 30))


@query("t8_available_from", f"with {YIELDS} select obs_id, cast(vintage_date + 1 as timestamp) available_ts from yields")
def t8(spark, sf):
    return yields(spark, sf).select("obs_id", Y.available_from().alias("available_ts"))


@query(
    "q28a_missing_slots",
    f"""{_COVER}, w as (select symbol, trading_date, slot_ts from (select distinct symbol from inw), slots)
    select symbol, trading_date, count(*) n_missing, min(slot_ts) first_missing, max(slot_ts) last_missing from w where not exists (select 1 from c2 where is_regular and c2.symbol = w.symbol and c2.tdate = w.trading_date and c2.open_ts = w.slot_ts) group by 1, 2""",
)
def q28a(spark, sf):
    return C.missing_slots(_classified(spark, sf), _expected(spark))


@query(
    "q28b_gaps",
    f"""with {BARS5}, l as (select *, epoch_us(open_ts) - epoch_us(lag(open_ts) over (partition by symbol, cast(open_ts as date) order by open_ts)) gap from bars)
    select symbol, open_ts issue_ts, greatest(0, gap // 300000000 - 1) n_estimated from l where gap > 300000000""",
)
def q28b(spark, sf):
    return C.gaps(bars5(spark, sf))


@query(
    "a11_envelope",
    f"""with {BARS5}, d as (select symbol, cast(open_ts as date) d, (epoch_us(max(open_ts)) - epoch_us(min(open_ts))) // 300000000 + 1 n from bars group by 1, 2) select symbol, cast(sum(n) as bigint) n_expected, count(*) n_days from d group by 1""",
)
def a11(spark, sf):
    return C.by_envelope(bars5(spark, sf))


_LEGS = sorted({s for legs in Y.SPREADS.values() for s in legs})
_FILLED = ", ".join(f"last_value({s} ignore nulls) over (order by available_ts rows unbounded preceding) {s}" for s in _LEGS)
_WIDE = ", ".join(f"""arg_max("value", struct_pack(o := observation_date, v := vintage_date, x := "value")) filter (symbol = '{s}') {s}""" for s in _LEGS)
_SPREAD = ", ".join(f"({a} - {b}) * 100 {n}" for n, (a, b) in Y.SPREADS.items())
_CHANGE = ", ".join(f"{n} - lag({n}) over (order by available_ts) {n}_change" for n in Y.SPREADS)
_TURN = ", ".join(f"case when {n}_change > 0 then 'steepening' when {n}_change < 0 then 'flattening' else 'unchanged' end {n}_direction" for n in Y.SPREADS)


@query(
    "d8_curve",
    f"""with {YIELDS}, wide as (select available_ts, {_WIDE} from yields where "value" is not null group by 1), filled as (select available_ts, {_FILLED} from wide),
    sp as (select *, {_SPREAD} from filled), ch as (select *, {_CHANGE} from sp) select *, {_TURN} from ch""",
)
def d8(spark, sf):
    return Y.curve(yields(spark, sf))


@query(
    "d9_vintages",
    f"""with {YIELDS}, k as (select *, case when obs_id % 2 = 0 then 0 else 1 end kind from yields),
    r as (select * from (select *, row_number() over (partition by symbol, observation_date, vintage_date order by kind desc, obs_id desc) rn from k) where rn = 1)
    select symbol, observation_date, vintage_date, obs_id, "value", vintage_date > min(vintage_date) over (partition by symbol, observation_date) is_revised from r""",
)
def d9(spark, sf):
    y = yields(spark, sf).drop("is_revised")
    return Y.vintages(y.filter("obs_id % 2 = 0"), y.filter("obs_id % 2 = 1")).select("symbol", "observation_date", "vintage_date", "obs_id", "value", "is_revised")


@query(
    "d19_split",
    f"""with {TICKS}, e as (select min(ts) lo, max(ts) hi from ticks), c as (select time_bucket(interval 5 minute, least(hi - interval 6 day, lo + to_microseconds(cast(round((epoch_us(hi) - epoch_us(lo)) * 0.8) as bigint)))) cut from e)
    select case when ts < cut then 'discovery' else 'untouched' end part, symbol, count(*) n, min(ts) first_ts, max(ts) last_ts from ticks, c group by 1, 2""",
)
def d19(spark, sf):
    x = ticks(spark, sf)
    s = P.split(*P.bounds(x, "ts"), test_days=6)
    both = s.discovery(x, "ts").withColumn("part", F.lit("discovery")).unionByName(s.untouched(x, "ts").withColumn("part", F.lit("untouched")))
    return both.groupBy("part", "symbol").agg(F.count("*").alias("n"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


@query(
    "d20_earlier_window",
    f"""with {TICKS}, e as (select min(ts) lo from ticks where ts >= timestamp '2024-01-20') select symbol, count(*) n from ticks, e where ts >= lo - interval 7 day and ts < lo group by 1""",
)
def d20(spark, sf):
    x = ticks(spark, sf)
    lo, _ = P.bounds(x.filter(F.col("ts") >= t.moment(datetime(2024, 1, 20))), "ts")
    start, end = P.earlier_window(lo, 7)
    return x.filter((F.col("ts") >= t.moment(start)) & (F.col("ts") < t.moment(end))).groupBy("symbol").agg(F.count("*").alias("n"))


@query(
    "d23_preflight",
    f"""with {RAW}, p as (select count(*) "rows", coalesce(bool_and("open" is not null and high is not null and low is not null and "close" is not null), false) priced, coalesce(bool_and(close_ts - open_ts = interval 5 minute), false) regular from raw)
    select *, "rows" > 0 and priced and regular valid from p""",
)
def d23(spark, sf):
    return B.preflight(raw_bars(spark, sf))


@query(
    "j14_as_of",
    """with c as (select event_id, user_id, ts from events where event_type = 'click'), e as (select user_id, ts, "value" v from events where event_type = 'error')
    select c.event_id, c.user_id, c.ts, e.v last_error from c asof left join e on c.user_id = e.user_id and c.ts >= e.ts""",
)
def j14(spark, sf):
    e = read(spark, sf, "events")
    return Y.as_of(e.filter("event_type = 'click'").select("event_id", "user_id", "ts"), e.filter("event_type = 'error'"), "user_id", "ts", "ts", "value", "last_error").select("event_id", "user_id", "ts", "last_error")


_KEYS = ["symbol", "contract", "open_ts"]
_COLS = ["symbol", "contract", "open_ts", "close", "volume", "bar_id"]


def _base_and_updates(spark, sf):
    """All bars, and all bars again with other closes, every third one under a key of its own."""
    b = bars5(spark, sf).select(*_COLS)
    return b, b.withColumns({"close": F.col("close") + 1, "contract": F.when(F.col("bar_id") % 3 == 0, F.concat("contract", F.lit("N"))).otherwise(F.col("contract"))})


@query(
    "u5_merge_bars",
    f"""with {BARS5}, upd as (select * replace ("close" + 1 as "close", case when bar_id % 3 = 0 then contract || 'N' else contract end as contract) from bars)
    select symbol, contract, open_ts, "close", volume, bar_id from upd union all select symbol, contract, open_ts, "close", volume, bar_id from bars where bar_id % 3 = 0""",
)
def u5(spark, sf):
    return M.merge(*_base_and_updates(spark, sf), _KEYS)


@query(
    "u6_merge_yields",
    f"""with {YIELDS}, d as (select * from (select *, row_number() over (partition by symbol, observation_date, vintage_date order by obs_id desc) rn from yields) where rn = 1),
    upd as (select symbol, observation_date, case when obs_id % 3 = 0 then vintage_date + 4000 else vintage_date end vintage_date, "value" + 1 "value", published_ts - interval 1 day published_ts from d)
    select coalesce(u.symbol, b.symbol) symbol, coalesce(u.observation_date, b.observation_date) observation_date, cast(coalesce(u.vintage_date, b.vintage_date) as date) vintage_date, case when u.symbol is not null then u."value" else b."value" end "value",
      least(u.published_ts, b.published_ts) published_ts, case when b.obs_id is not null then 'old' else 'new' end source
    from d b full join upd u on b.symbol = u.symbol and b.observation_date = u.observation_date and b.vintage_date = u.vintage_date""",
)
def u6(spark, sf):
    d = M.latest(yields(spark, sf), ["symbol", "observation_date", "vintage_date"], "obs_id").select("symbol", "observation_date", "vintage_date", "obs_id", "value", "published_ts")
    base = d.withColumn("source", F.lit("old")).drop("obs_id")
    new = d.withColumns({"vintage_date": F.when(F.col("obs_id") % 3 == 0, F.date_add("vintage_date", 4000)).otherwise(F.col("vintage_date")), "value": F.col("value") + 1, "published_ts": t.plus_minutes(F.col("published_ts"), -1440), "source": F.lit("new")}).drop("obs_id")
    return M.merge(base, new, ["symbol", "observation_date", "vintage_date"], M.YIELD_POLICY)


@query(
    "u11_counters",
    f"""with {BARS5} select 2 * count(*) received, count(*) filter (bar_id % 3 = 0) inserted, count(*) filter (bar_id % 3 <> 0) updated, count(*) duplicates from bars""",
)
def u11(spark, sf):
    base, new = _base_and_updates(spark, sf)
    return M.counters(base, new.unionByName(new), _KEYS, "bar_id")


@query(
    "u8_merge_rolls",
    f"""with {BARS5}, l as (select symbol, open_ts roll_ts, contract incoming, lag(contract) over (partition by symbol order by open_ts) outgoing, bar_id from bars), r as (select * from l where outgoing is not null and outgoing <> incoming)
    select symbol, case when bar_id % 2 = 0 then roll_ts + interval 1 second else roll_ts end roll_ts, incoming, outgoing, case when bar_id % 2 = 0 then 'new' else 'kept' end incoming_oi from r
    union all select symbol, roll_ts, incoming, outgoing, 'kept' from r where bar_id % 2 = 0""",
)
def u8(spark, sf):
    """All rolls, and all again, every second one a second later: kept, new and lone ones."""
    b = bars5(spark, sf)
    r = rolls.rolls(b).join(b.select("symbol", F.col("open_ts").alias("roll_ts"), F.col("contract").alias("incoming_contract"), "bar_id"), ["symbol", "roll_ts", "incoming_contract"])
    r = r.select("symbol", "roll_ts", F.col("incoming_contract").alias("incoming"), F.col("outgoing_contract").alias("outgoing"), "bar_id")
    later = F.when(F.col("bar_id") % 2 == 0, F.col("roll_ts") + F.expr("interval 1 second")).otherwise(F.col("roll_ts"))
    new = r.withColumns({"roll_ts": later, "incoming_oi": F.lit("new")}).drop("bar_id")
    return M.merge(r.drop("bar_id").withColumn("incoming_oi", F.lit("kept")), new, ["symbol", "roll_ts", "incoming"], M.ROLL_POLICY)


def _grid(spark, sf):
    return align.aligned(bars5(spark, sf))


_G = f"with {BARS5}, {_GRID} "
_GW = "window w as (partition by symbol order by slot_ts)"


@query("r1_forward_returns", _G + "select symbol, slot_ts, " + ", ".join(f"""case when "close" <> 0 then lead("close", {k}) over w / "close" - 1 end forward_{k}""" for k in (1, 3, 6, 12, 48)) + f" from g {_GW}")
def r1(spark, sf):
    return R.forward_returns(_grid(spark, sf)).select("symbol", "slot_ts", *[f"forward_{k}" for k in (1, 3, 6, 12, 48)])


@query("r2_excursions", _G + """select symbol, slot_ts, case when "close" <> 0 then max(high) over n / "close" - 1 end mfe, case when "close" <> 0 then min(low) over n / "close" - 1 end mae from g window n as (partition by symbol order by slot_ts rows between 1 following and 12 following)""")
def r2(spark, sf):
    return R.excursions(_grid(spark, sf)).select("symbol", "slot_ts", "mfe", "mae")


@query("r3_time_to_threshold", _G + "select symbol, slot_ts, coalesce(" + ", ".join(f"""case when lead(high, {k}) over w >= "close" * 1.05::double then {k} end""" for k in range(1, 13)) + f") steps_to_threshold from g {_GW}")
def r3(spark, sf):
    return R.time_to_threshold(_grid(spark, sf)).select("symbol", "slot_ts", "steps_to_threshold")


@query("r4_trailing", _G + """select symbol, slot_ts, round(stddev_samp("return") over n, 6) realised_vol, round(case when avg(volume) over n <> 0 then volume / avg(volume) over n end, 6) relative_volume from g window n as (partition by symbol order by slot_ts rows between 12 preceding and 1 preceding)""")
def r4(spark, sf):
    return R.trailing(_grid(spark, sf)).select("symbol", "slot_ts", F.round("realised_vol", 6).alias("realised_vol"), F.round("relative_volume", 6).alias("relative_volume"))


@query(
    "r5_intrabar",
    f"""with {BARS5} select bar_id, round(case when "close" <> 0 then (high - low) / "close" end, 9) range_share, round(case when high <> low then ("close" - low) / (high - low) end, 9) close_position,
    round(case when vwap <> 0 then "close" / vwap end - 1, 9) vwap_deviation, round(case when lag("close") over w <> 0 then "open" / lag("close") over w end - 1, 9) open_gap from bars window w as (partition by symbol order by open_ts)""",
)
def r5(spark, sf):
    return R.intrabar(bars5(spark, sf)).select("bar_id", *[F.round(c, 9).alias(c) for c in ("range_share", "close_position", "vwap_deviation", "open_gap")])


@query("r6_acceleration", _G + f"""select symbol, slot_ts, "return" - lag("return") over w acceleration from g {_GW}""")
def r6(spark, sf):
    return R.acceleration(_grid(spark, sf)).select("symbol", "slot_ts", "acceleration")


@query("r7_drawdown", f"""with {BARS5} select bar_id, case when max("close") over w <> 0 then "close" / max("close") over w end - 1 drawdown from bars window w as (partition by symbol order by open_ts rows unbounded preceding)""")
def r7(spark, sf):
    return R.drawdown(bars5(spark, sf)).select("bar_id", "drawdown")


@query(
    "r8_opening_range",
    f"""with {BARS5}, d as (select *, cast(open_ts as date) "day", min(open_ts) over (partition by symbol, cast(open_ts as date)) s from bars) select symbol, "day", max(high) range_high, min(low) range_low from d where open_ts < s + interval 30 minute group by 1, 2""",
)
def r8(spark, sf):
    return R.opening_range(bars5(spark, sf))


@query("r9_breadth", _G + """select slot_ts, count(*) filter ("return" > 0) n_up, count(*) filter ("return" < 0) n_down, count("return") n_known from g group by 1""")
def r9(spark, sf):
    return R.breadth(_grid(spark, sf))


@query("r10_differential", _G + """select slot_ts, max("return") filter (symbol = 'click') - max("return") filter (symbol = 'error') differential from g where symbol in ('click', 'error') group by 1""")
def r10(spark, sf):
    return R.differential(_grid(spark, sf), "click", "error")


@query(
    "r11_lagged_correlation",
    _G + """, w as (select slot_ts, max("return") filter (symbol = 'click') x, max("return") filter (symbol = 'error') y from g where symbol in ('click', 'error') group by 1),
    s as (select x, k lag, case k when 0 then y when 1 then lead(y, 1) over (partition by k order by slot_ts) when 2 then lead(y, 2) over (partition by k order by slot_ts) else lead(y, 3) over (partition by k order by slot_ts) end y from w, (select unnest([0, 1, 2, 3]) k))
    select lag, count(*) n, round(corr(x, y), 6) correlation from s where x is not null and y is not null group by 1""",
)
def r11(spark, sf):
    return R.lagged_correlation(_grid(spark, sf), "click", "error").withColumn("correlation", F.round("correlation", 6))


@query(
    "r12_conditional_probability",
    _G + f""", p as (select symbol, "return" r, lead("return") over w nx from g {_GW}), q as (select * from p where r is not null and nx is not null), b as (select avg(case when nx > 0 then 1.0 else 0 end) base from q)
    select cast(sign(r) as integer) sign, count(*) n, count(*) filter (nx > 0) n_up, round(any_value(base), 9) base_rate, round(count(*) filter (nx > 0) / count(*)::double, 9) p_up, round(count(*) filter (nx > 0) / count(*)::double - any_value(base), 9) uplift from q, b group by 1""",
)
def r12(spark, sf):
    return R.conditional_probability(_grid(spark, sf)).withColumns({c: F.round(c, 9) for c in ("base_rate", "p_up", "uplift")})


@query(
    "r13_false_discovery",
    """with x as (select l_orderkey * 10 + l_linenumber test_id, l_returnflag family, (l_discount * 100 + l_tax * 1000 + 1) / 200 p_value, count(*) over (partition by l_orderkey, l_linenumber) c from lineitem),
    r as (select *, row_number() over (partition by family order by p_value, test_id) k, count(*) over (partition by family) n from x where c = 1)
    select test_id, family, round(least(1.0, min(p_value * n / k) over (partition by family order by k desc rows unbounded preceding)), 9) q_value from r""",
)
def r13(spark, sf):
    from pyspark.sql import Window

    x = read(spark, sf, "lineitem").withColumn("c", F.count("*").over(Window.partitionBy("l_orderkey", "l_linenumber"))).filter("c = 1")
    x = x.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("test_id"), F.col("l_returnflag").alias("family"), ((F.col("l_discount") * 100 + F.col("l_tax") * 1000 + 1) / 200).alias("p_value"))
    return R.false_discovery(x).select("test_id", "family", F.round("q_value", 9).alias("q_value"))


@query(
    "r14_graduated",
    """with e as (select p_brand signal, cast(l_shipdate as date) "day", l_discount * 1000 return_bp from lineitem join part on l_partkey = p_partkey)
    select signal, count(distinct "day") n_days, count(*) n_events, round(avg(return_bp), 6) gross_bp, round(avg(return_bp) - 5, 6) net_bp from e group by 1 having count(distinct "day") >= 60 and count(*) >= 80 and avg(return_bp) >= 10""",
)
def r14(spark, sf):
    e = read(spark, sf, "lineitem").join(read(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey")).select(F.col("p_brand").alias("signal"), F.to_date("l_shipdate").alias("day"), (F.col("l_discount") * 1000).alias("return_bp"))
    return R.graduated(e).withColumns({c: F.round(c, 6) for c in ("gross_bp", "net_bp")})


@query("t1_stream_bars", f"""with {BARS5} select symbol, open_ts, "open", high, low, "close", volume, trade_count from (select symbol, open_ts, "open", high, low, "close", volume, trade_count from bars)""")
def t1(spark, sf):
    return live.replay(spark, sf).select("symbol", "open_ts", "open", "high", "low", "close", "volume", "trade_count")


@query("p7_overlapping_sessions", f"with {SESSIONS}, w as (select min(ts) lo, max(ts) hi from events where event_type = 'error') select trading_date, open_ts, close_ts from sess, w where close_ts > lo and open_ts < hi")
def p7(spark, sf):
    """The sessions with a moment in common with the time from the first to the last error."""
    lo, hi = read(spark, sf, "events").filter("event_type = 'error'").agg(F.min("ts"), F.max("ts")).first()
    return S.overlapping(S.sessions(spark, "XNYS", FIRST, LAST), lo, hi).select("trading_date", "open_ts", "close_ts")


@query(
    "u7_merge_sessions",
    f"""with {TICKS}, {SESSIONS}, seen as (select cast(ts as date) d, min(ts) o, max(ts) c from ticks group by 1), r as (select s.* from sess s, {_SPAN} where trading_date between lo and hi)
    select coalesce(trading_date, d) trading_date, coalesce(o, open_ts) open_ts, coalesce(c, close_ts) close_ts from r full join seen on d = trading_date""",
)
def u7(spark, sf):
    """The scheduled sessions, replaced by what was traded on each day, with days that no schedule knows."""
    scheduled = S.sessions(spark, "XNYS", *_span(spark, sf)).select("trading_date", "open_ts", "close_ts")
    seen = ticks(spark, sf).groupBy(F.to_date("ts").alias("trading_date")).agg(F.min("ts").alias("open_ts"), F.max("ts").alias("close_ts"))
    return M.merge(scheduled, seen, ["trading_date"])


@query("u9_merge_instruments", "select case when n_regionkey = 2 then n_nationkey + 1000 else n_nationkey end n_nationkey, n_name || '_new' n_name, n_regionkey from nation union all select n_nationkey, n_name, n_regionkey from nation where n_regionkey = 2")
def u9(spark, sf):
    n = read(spark, sf, "nation")
    n = n.select("n_nationkey", "n_name", "n_regionkey")
    new = n.withColumns({"n_nationkey": F.when(F.col("n_regionkey") == 2, F.col("n_nationkey") + 1000).otherwise(F.col("n_nationkey")), "n_name": F.concat("n_name", F.lit("_new"))})
    return M.merge(n, new, ["n_nationkey"])


@query("u10_merge_settings", "select r_name setting_key, case when r_regionkey > 2 then 'kept' else 'changed' end setting_value from region")
def u10(spark, sf):
    r = read(spark, sf, "region")
    base, new = r.select(F.col("r_name").alias("setting_key"), F.lit("kept").alias("setting_value")), r.filter("r_regionkey <= 2").select(F.col("r_name").alias("setting_key"), F.lit("changed").alias("setting_value"))
    return M.merge(base, new, ["setting_key"])


@query("j2_yields_enriched", f"with {YIELDS} select obs_id, y.symbol, country, \"value\" from yields y join (select * from (values ('US2Y', 'US'), ('US5Y', 'US'), ('DE2Y', 'DE')) v(symbol, country)) i on y.symbol = i.symbol")
def j2(spark, sf):
    i = spark.createDataFrame([("US2Y", "US"), ("US5Y", "US"), ("DE2Y", "DE")], "symbol string, country string")
    return yields(spark, sf).join(i, "symbol").select("obs_id", "symbol", "country", "value")


@query("o1_nulls_last", f"with {RAW} select bar_id, row_number() over (partition by symbol order by \"close\" nulls last, bar_id) place from raw")
def o1(spark, sf):
    return running(raw_bars(spark, sf).withColumn("one", F.lit(1).cast("long")), "symbol", "close", ("bar_id",), {"place": ("sum", "one")}, F.floor("close")).select("bar_id", "place")


@query(
    "d12_split_dates",
    f"""with {TICKS}, e as (select time_bucket(interval 5 minute, min(ts)) lo, time_bucket(interval 5 minute, max(ts)) hi from ticks), c as (select *, lo + to_microseconds(cast(round((epoch_us(hi) - epoch_us(lo)) * 0.8) as bigint)) by_share from e)
    select lo "start", time_bucket(interval 5 minute, least(hi - interval 6 day, by_share)) cutoff, hi + interval 5 minute "end", cast((epoch_us(time_bucket(interval 5 minute, least(hi - interval 6 day, by_share))) - epoch_us(lo)) // 86400000000 as integer) discovery_days from c""",
)
def d12(spark, sf):
    """The split's dates for all ticks on the five-minute grid; d19_split holds the rule against rows."""
    s = P.split(*P.bounds(ticks(spark, sf).select(t.floor_minutes(F.col("ts"), 5).alias("open_ts"))), test_days=6)
    return spark.createDataFrame([(s.start, s.cutoff, s.end, (s.cutoff - s.start) // timedelta(days=1))], "start timestamp_ntz, cutoff timestamp_ntz, `end` timestamp_ntz, discovery_days int")
