"""One query for each quality rule."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import quality as Q
from .views import RAW, YIELDS, raw_bars, yields

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}

#: For runs short enough to occur in the test tables.
SETTINGS = Q.Settings(stale_run=2, zero_volume_run=3)
_FLAT = "round({c} / 20) * 20"


def _bars(spark, sf_dir):
    """The raw bars with prices rounded so far that runs of equal closes occur."""
    return raw_bars(spark, sf_dir).withColumn("close", F.round(F.col("close") / 4) * 4).withColumns({"high": F.when(F.col("bar_id") % 79 == 0, F.col("open") - 1).otherwise(F.greatest("open", "close")), "low": F.least("open", "close")})


FLAT = RAW.replace("from raw0), sound", 'from (select * replace (round("close" / 4) * 4 as "close") from raw0)), sound')


def _pre(issue: str):
    def run(spark, sf_dir):
        return Q.preinsert(raw_bars(spark, sf_dir))[1].filter(F.col("issue_type") == issue).select("bar_id", "symbol", "issue_ts", "severity", "disposition")

    return run


def _evaluated(issue: str):
    def run(spark, sf_dir):
        return Q.evaluate(_bars(spark, sf_dir), SETTINGS, zone="America/New_York", only=(issue,)).select("bar_id", "symbol", "issue_ts", "severity")

    return run


def _yield(issue: str):
    def run(spark, sf_dir):
        return Q.evaluate_yields(yields(spark, sf_dir)).filter(F.col("issue_type") == issue).select("obs_id", "symbol", "issue_ts", "severity")

    return run


_BAD = 'open_ts is null or close_ts is null or "open" is null or high is null or low is null or "close" is null'
_OHLC = 'high < greatest("open", "close", low) or low > least("open", "close", high)'
_DUP = "select *, count(*) over (partition by symbol, open_ts, contract, is_continuous) n from {t}"

#: (name, issue, severity, disposition, rows)
_PRE = [
    ("q2_malformed", "missing_or_malformed_required_field", "error", "excluded", f"select * from raw where {_BAD}"),
    ("q3_invalid_ohlc", "invalid_ohlc", "error", "excluded", f"select * from sound where {_OHLC}"),
    ("q4_negative_price", "negative_price", "warning", "retained", 'select * from sound where least("open", high, low, "close") < 0'),
    ("q5_negative_volume", "negative_volume", "error", "excluded", "select * from raw where volume < 0"),
    ("q6_interval", "unexpected_interval_length", "error", "excluded", "select * from sound where close_ts - open_ts <> interval 5 minute"),
    ("q7_boundary", "inconsistent_bar_boundary", "error", "excluded", "select * from sound where time_bucket(interval 5 minute, open_ts) <> open_ts"),
    ("q8_duplicate", "duplicated_provider_page_or_bar", "error", "deduplicated", f"select * from ({_DUP.format(t='raw')}) where n > 1"),
]
for name, issue, severity, disposition, rows in _PRE:
    QUERIES[name] = _pre(issue)
    ORACLE_SQL[name] = f"with {RAW} select bar_id, symbol, open_ts issue_ts, '{severity}' severity, '{disposition}' disposition from ({rows})"

_ORDER = "partition by symbol order by open_ts nulls last, contract nulls last, bar_id"
_MOVE = f"""select *, case when b <> 0 then abs("close" / b - 1) when "close" <> 0 then 'infinity'::double end move from (select *, lag("close") over ({_ORDER}) b from raw)"""
_RUNS = """select *, count(*) over (partition by symbol, run) size from (select *, sum(case when new then 1 else 0 end) over ({o} rows unbounded preceding) run from (select *, coalesce({x} <> lag({x}) over ({o}), true) new from {t}))"""
_STALE = f"""select * from ({_RUNS.format(o=_ORDER, x='"close"', t='raw')}) where size >= 2 and "close" is not null"""
_ZERO = f"""select * from ({_RUNS.format(o=_ORDER, x='z', t='(select *, coalesce(volume = 0, false) z from raw)')}) where z and size >= 3"""
_POST = [
    ("q9_malformed", "missing_or_malformed_required_field", "error", f"select * from raw where {_BAD}"),
    ("q10_duplicate_identity", "duplicate_identity", "error", f"select * from ({_DUP.format(t='raw')}) where n > 1"),
    ("q11_invalid_ohlc", "invalid_ohlc", "error", f"select * from sound where {_OHLC}"),
    ("q12_zero_price", "zero_price", "error", 'select * from sound where "open" = 0 or high = 0 or low = 0 or "close" = 0'),
    ("q13_negative_price", "negative_price", "warning", 'select * from sound where least("open", high, low, "close") < 0'),
    ("q14_negative_volume", "negative_volume", "error", "select * from raw where volume < 0"),
    ("q15_interval", "unexpected_interval_length", "error", "select * from sound where close_ts - open_ts <> interval 5 minute"),
    ("q16_boundary", "inconsistent_bar_boundary", "error", "select * from raw where time_bucket(interval 5 minute, open_ts) <> open_ts"),
    ("q17_extreme_return", "extreme_return", "warning", f"select * from ({_MOVE}) where move > 0.1 and not is_roll_affected"),
    ("q18_roll_jump", "contract_roll_jump", "warning", f"select * from ({_MOVE}) where move > 0.1 and is_roll_affected"),
    ("q19_weekend", "unexpected_weekend_observation", "warning", "select * from raw where isodow(open_ts) >= 6"),
    ("q20_trading_date", "timezone_or_trading_date_mismatch", "warning", "select * from raw where cast(timezone('America/New_York', timezone('UTC', open_ts)) as date) <> trading_date"),
    ("q22_break", "timestamp_inside_scheduled_break", "error", "select * from raw where session_type = 'scheduled_break_observation'"),
    ("q23_outside", "timestamp_outside_expected_session", "warning", "select * from raw where session_type = 'outside_scheduled_market'"),
    ("q24_partial", "partial_bar", "warning", "select * from raw where is_partial"),
    ("q25_stale", "stale_repeated_price", "warning", _STALE),
    ("q26_zero_volume", "excessive_zero_volume_run", "warning", _ZERO),
    ("q27_roll_boundary", "contract_roll_boundary", "info", "select * from raw where is_roll_affected"),
]
for name, issue, severity, rows in _POST:
    QUERIES[name] = _evaluated(issue)
    ORACLE_SQL[name] = f"with {FLAT} select bar_id, symbol, open_ts issue_ts, '{severity}' severity from ({rows})"

_YIELD = [
    ("q29_malformed_yield", "malformed_yield_observation", "error", 'select * from yields where available_ts is null or published_ts is null or "value" is null'),
    ("q30_future_information", "future_information_timestamp", "error", "select * from yields where available_ts < published_ts"),
    ("q31_duplicate_vintage", "duplicate_yield_vintage", "error", "select * from (select *, count(*) over (partition by symbol, observation_date, maturity, vintage_date) n from yields) where n > 1"),
    ("q32_revised", "revised_yield_observation", "info", "select * from yields where is_revised"),
]
for name, issue, severity, rows in _YIELD:
    QUERIES[name] = _yield(issue)
    ORACLE_SQL[name] = f"with {YIELDS} select obs_id, symbol, available_ts issue_ts, '{severity}' severity from ({rows})"


def q1_reverse_order(spark, sf_dir):
    """The raw bars; those of two symbols arrive backwards."""
    backwards = F.col("symbol").isin("click", "error")
    return Q.reversed_batches(raw_bars(spark, sf_dir).withColumn("ingest_seq", F.when(backwards, -F.col("bar_id")).otherwise(F.col("bar_id"))))


QUERIES["q1_reverse_order"] = q1_reverse_order
ORACLE_SQL["q1_reverse_order"] = f"""with {RAW}, o as (select *, case when symbol in ('click', 'error') then -bar_id else bar_id end seq from raw),
  l as (select *, open_ts > lag(open_ts) over (partition by symbol order by seq) rises from o)
  select symbol, arg_min(open_ts, seq) issue_ts, 'provider_rows_reverse_order' issue_type, 'warning' severity from l group by symbol having count(*) > 1 and not bool_or(coalesce(rises, false))"""


def q21_invalid_zone(spark, sf_dir):
    from .views import read

    zone = F.when(F.col("n_nationkey") % 3 == 0, "Europe/London").when(F.col("n_nationkey") % 3 == 1, "Mars/Olympus")
    found = Q.invalid_zones(read(spark, sf_dir, "nation").select(F.col("n_name").alias("symbol"), zone.alias("exchange_timezone")))
    return found


QUERIES["q21_invalid_zone"] = q21_invalid_zone
ORACLE_SQL["q21_invalid_zone"] = "select n_name symbol, 'Mars/Olympus' exchange_timezone from nation where n_nationkey % 3 = 1"


def d3_clean_bars(spark, sf_dir):
    return Q.preinsert(raw_bars(spark, sf_dir))[0].select("bar_id", "symbol", "open_ts", "open", "high", "low", "close", "volume", "quality_status")


QUERIES["d3_clean_bars"] = d3_clean_bars
ORACLE_SQL["d3_clean_bars"] = f"""with {RAW}, kept as (select * from sound where not ({_OHLC}) and not coalesce(volume < 0, false) and close_ts - open_ts = interval 5 minute and time_bucket(interval 5 minute, open_ts) = open_ts)
  select bar_id, symbol, open_ts, "open", high, low, "close", volume, case when least("open", high, low, "close") < 0 then 'warning' else 'preinsert_pass' end quality_status
  from (select *, row_number() over (partition by symbol, open_ts, contract, is_continuous order by bar_id desc) rn from kept) where rn = 1"""


def d22_severities(spark, sf_dir):
    return Q.severity_counts(Q.evaluate(_bars(spark, sf_dir), SETTINGS, zone="America/New_York"))


QUERIES["d22_severities"] = d22_severities
ORACLE_SQL["d22_severities"] = f"with {FLAT} select severity, count(*) n from (" + " union all ".join(f"select '{s}' severity from ({rows}) x{k}" for k, (_, _, s, rows) in enumerate(_POST)) + ") group by severity"
