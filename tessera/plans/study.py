"""Queries of the evaluation of signals."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import timeops as t
from ..operators import sessions as S, study as R
from .domain import _G, FIRST, LAST, _grid
from .views import BARS5, SESSIONS, bars5

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str):
    def add(f):
        QUERIES[name] = f
        ORACLE_SQL[name] = sql
        return f

    return add


_FOLDS = f"""with {BARS5}, l as (select symbol, open_ts start_ts, open_ts + interval 120 minute end_ts from bars),
  d as (select day, cast((row_number() over (order by day) - 1) * 4 // count(*) over () as integer) test_fold from (select distinct cast(start_ts as date) as day from l)),
  p as (select l.*, test_fold from l join d on cast(start_ts as date) = day), tested as (select distinct test_fold, start_ts, end_ts from p where test_fold > 0),
  f as (select p.*, fold from p, (select unnest([1, 2, 3]) fold)),
  met as (select distinct f.fold, f.start_ts, exists (select 1 from tested s where s.test_fold = f.fold and f.start_ts < s.end_ts and f.end_ts > s.start_ts) purged, exists (select 1 from tested s where s.test_fold = f.fold and f.start_ts < s.end_ts + interval 1440 minute and f.end_ts > s.start_ts - interval 1440 minute) embargoed from (select distinct fold, start_ts, end_ts from f) f),
  r as (select symbol, f.start_ts, f.end_ts, f.fold, test_fold, case when test_fold = f.fold then 'test' when purged then 'purged' when embargoed then 'embargoed' else 'train' end role from f join met on met.fold = f.fold and met.start_ts = f.start_ts)"""


def _labels(spark, sf):
    return bars5(spark, sf).select("symbol", F.col("open_ts").alias("start_ts"), t.plus_minutes(F.col("open_ts"), 120).alias("end_ts"))


@query("r16_walk_forward", f"{_FOLDS} select symbol, start_ts, end_ts, fold, role from r where test_fold <= fold")
def r16(spark, sf):
    return R.purged_folds(_labels(spark, sf), folds=3, embargo_minutes=1440)


@query("r16_purged_folds", f"{_FOLDS} select symbol, start_ts, end_ts, fold, role from r")
def r16_both(spark, sf):
    return R.purged_folds(_labels(spark, sf), folds=3, embargo_minutes=1440, forward=False)


_WEIGHT = " + ".join(f"case when u >= {p!r}::double then 1 else 0 end" for p in R.POISSON)


@query(
    "r15_block_bootstrap",
    _G
    + f""", s as (select symbol, cast(floor(date_diff('day', date '1970-01-01', cast(slot_ts as date)) / 2) as bigint) block, count("return") n, sum("return") total from g where "return" is not null group by 1, 2),
    u as (select s.*, r, cast('0x' || substr(md5(r || '|' || block), 1, 8) as bigint) / 4294967296::double u from s, (select unnest(generate_series(1, 200)) r)),
    m as (select symbol, r, sum(w * total) / nullif(sum(w * n), 0) mean from (select *, {_WEIGHT} w from u) group by 1, 2),
    e as (select symbol, quantile_cont(mean, 0.025) low, quantile_cont(mean, 0.975) high from m group by 1)
    select s.symbol, cast(sum(n) as bigint) n, count(*) n_blocks, round(sum(total) / sum(n), 9) mean, round(any_value(low), 9) low, round(any_value(high), 9) high from s join e on s.symbol = e.symbol group by 1""",
)
def r15(spark, sf):
    return R.block_bootstrap(_grid(spark, sf), "return", block_days=2).select("symbol", "n", "n_blocks", *[F.round(c, 9).alias(c) for c in ("mean", "low", "high")])


@query(
    "r17_event_study",
    _G
    + """, a as (select symbol, slot_ts, lag(slot_ts) over (partition by symbol order by slot_ts) was from g where abs("return") > 0.5),
    ev as (select symbol, slot_ts event_ts, coalesce(slot_ts - was <= interval 60 minute, false) is_overlapping from a),
    b as (select hour(slot_ts) * 60 + minute(slot_ts) clock, avg("return") base, avg(case when "return" > 0 then 1.0::double when "return" is not null then 0 end) base_up from g group by 1),
    m as (select is_overlapping, cast(k as integer) step, "return" r, base, base_up from ev, (select unnest(generate_series(-6, 12)) k) left join g on g.symbol = ev.symbol and g.slot_ts = event_ts + k * interval 5 minute
      left join b on clock = hour(event_ts + k * interval 5 minute) * 60 + minute(event_ts + k * interval 5 minute))
    select is_overlapping, step, count(*) n_events, count(r) n_known, round(avg(r), 9) mean_return, round(avg(case when r > 0 then 1.0::double when r is not null then 0 end), 9) share_up, round(avg(case when r is not null then base end), 9) base_return,
      round(avg(case when r is not null then base_up end), 9) base_up, round(avg(r) - avg(case when r is not null then base end), 9) uplift from m group by 1, 2""",
)
def r17(spark, sf):
    found = R.event_study(_grid(spark, sf), F.abs("return") > 0.5)
    return found.select("is_overlapping", "step", "n_events", "n_known", *[F.round(c, 9).alias(c) for c in ("mean_return", "share_up", "base_return", "base_up", "uplift")])


@query(
    "r18_rolling_correlation",
    _G
    + """, w as (select slot_ts, max("return") filter (symbol = 'click') c, max("return") filter (symbol = 'error') e, max("return") filter (symbol = 'view') v from g group by 1),
    p as (select 'click' a, 'error' b, slot_ts, c x, e y from w union all select 'click', 'view', slot_ts, c, v from w union all select 'error', 'view', slot_ts, e, v from w),
    k as (select *, count(*) filter (x is not null and y is not null) over f n, corr(y, x) over f r, max(x) filter (y is not null) over f - min(x) filter (y is not null) over f dx, max(y) filter (x is not null) over f - min(y) filter (x is not null) over f dy from p window f as (partition by a, b order by slot_ts rows between 47 preceding and current row)),
    q as (select a, b, slot_ts, n, case when n >= 12 and dx > 0 and dy > 0 then r end correlation from k)
    select a, b, slot_ts, n, round(correlation, 6) correlation, round(correlation - lag(correlation, 48) over (partition by a, b order by slot_ts), 6) change from q""",
)
def r18(spark, sf):
    return R.rolling_correlation(_grid(spark, sf), ("click", "error", "view")).withColumns({c: F.round(c, 6) for c in ("correlation", "change")})


@query(
    "r19_session_targets",
    f"""with {BARS5}, {SESSIONS}, pr as (select symbol, s.open_ts so, s.close_ts sc, arg_min("open", b.open_ts) first_open, arg_max("close", b.open_ts) last_close from bars b join sess s on b.open_ts >= s.open_ts and b.open_ts < s.close_ts group by 1, 2, 3),
    c as (select b.symbol, contract, b.open_ts, b.close_ts, "close", last_close from bars b asof left join pr on b.symbol = pr.symbol and b.close_ts <= pr.sc), o as (select c.*, first_open from c asof left join pr on c.symbol = pr.symbol and c.close_ts <= pr.so)
    select symbol, contract, open_ts, case when "close" <> 0 then last_close / "close" - 1 end to_close, case when "close" <> 0 then first_open / "close" - 1 end to_next_open from o""",
)
def r19(spark, sf):
    return R.session_targets(bars5(spark, sf), S.sessions(spark, "XNYS", FIRST, LAST)).select("symbol", "contract", "open_ts", "to_close", "to_next_open")


_HISTORY = "count({v}) over h n_history, avg({v}) over h mean, stddev_samp({v}) over h dev, list(abs({v})) filter ({v} is not null) over h seen"
_AGAINST = "n_history, case when n_history >= 3 and {v} is not null and dev > 1e-12 then round(({v} - mean) / dev, 6) end z_score, case when n_history >= 3 and {v} is not null then len(list_filter(seen, lambda x: x < abs({v}))) / n_history::double end \"rank\""
_SAME = "order by slot_ts rows between 10 preceding and 1 preceding"


@query(
    "r20_same_time",
    _G + f""", k as (select symbol, slot_ts, "return" r, {_HISTORY.format(v='"return"')} from g window h as (partition by symbol, hour(slot_ts), minute(slot_ts) {_SAME})) select symbol, slot_ts, {_AGAINST.format(v="r")} from k""",
)
def r20(spark, sf):
    return R.same_time_history(_grid(spark, sf)).select("symbol", "slot_ts", "n_history", F.round("z_score", 6).alias("z_score"), "rank")


@query(
    "r20_divergence",
    _G
    + f""", s as (select slot_ts, abs(sum(sign("return")) filter (symbol in ('click', 'error'))) / nullif(count("return") filter (symbol in ('click', 'error')), 0)::double agreement, abs(sum(sign("return")) filter (symbol in ('view', 'purchase'))) / nullif(count("return") filter (symbol in ('view', 'purchase')), 0)::double other_agreement,
      avg("return") filter (symbol in ('click', 'error')) - avg("return") filter (symbol in ('view', 'purchase')) difference from g where symbol <> 'signup' group by 1),
    k as (select *, {_HISTORY.format(v="difference")} from s window h as (partition by hour(slot_ts), minute(slot_ts) {_SAME})) select slot_ts, agreement, other_agreement, round(difference, 9) difference, {_AGAINST.format(v="difference")} from k""",
)
def r20_groups(spark, sf):
    out = R.group_divergence(_grid(spark, sf), ("click", "error"), ("view", "purchase"))
    return out.select("slot_ts", "agreement", "other_agreement", F.round("difference", 9).alias("difference"), "n_history", F.round("z_score", 6).alias("z_score"), "rank")
