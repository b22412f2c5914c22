"""The test tables read as ticks, bars and yields; in Spark and, for the oracle, in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import timeops as t
from ..operators import bars as B


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    volume = F.regexp_extract("props", "(-?[0-9]+)", 1).try_cast("double")
    contract = F.concat(F.lit("C"), F.floor((F.dayofyear("ts") - 1) / 10).cast("string"))
    return read(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), F.col("event_type").alias("symbol"), "ts", F.col("value").alias("price"), volume.alias("volume"), contract.alias("contract"))


def tick_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each tick as a bar of one moment."""
    price = F.col("price")
    return ticks(spark, sf_dir).select(F.col("seq").alias("ingest_seq"), "symbol", "contract", F.col("ts").alias("open_ts"), price.alias("open"), price.alias("high"), price.alias("low"), price.alias("close"), "volume", price.alias("vwap"), F.lit(1).cast("long").alias("trade_count"))


def bars5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.resample(tick_bars(spark, sf_dir), 5, expected=2).withColumn("bar_id", F.col("ingest_seq"))


def raw_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ticks as a provider's five-minute rows, with every kind of defect at fixed places."""
    n = F.col("event_id")
    hit = lambda k: n % k == 0
    open_ts = F.when(hit(53), F.col("ts")).otherwise(t.floor_minutes(F.col("ts"), 5))
    close = F.when(hit(97), F.lit(None)).when(hit(89), F.lit(0.0)).when(hit(83), -F.col("value")).otherwise(F.col("value") + 0.25)
    df = read(spark, sf_dir, "events").withColumns({"open_ts": open_ts, "open": F.col("value"), "close": close})
    volume = F.regexp_extract("props", "(-?[0-9]+)", 1).try_cast("double")
    return df.select(
        n.alias("bar_id"),
        n.alias("ingest_seq"),
        F.col("event_type").alias("symbol"),
        "open_ts",
        t.plus_minutes(F.col("open_ts"), F.when(hit(59), 4).otherwise(5)).alias("close_ts"),
        F.concat(F.lit("C"), F.floor((F.dayofyear("ts") - 1) / 10).cast("string")).alias("contract"),
        F.lit(True).alias("is_continuous"),
        "open",
        F.when(hit(79), F.col("open") - 1).otherwise(F.greatest("open", "close")).alias("high"),
        F.least("open", "close").alias("low"),
        "close",
        F.when(hit(71), -volume - 1).when(hit(7), 0.0).otherwise(volume).alias("volume"),
        hit(101).alias("is_roll_affected"),
        hit(61).alias("is_partial"),
        F.to_date("ts").alias("trading_date"),
        F.when(hit(67), "scheduled_break_observation").when(hit(73), "outside_scheduled_market").otherwise("regular_session").alias("session_type"),
    )


def yields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as yield observations: five priorities as symbols, order keys as revisions of a date."""
    return read(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("obs_id"),
        F.col("o_orderkey").alias("ingest_seq"),
        F.element_at(F.create_map(*[F.lit(x) for x in ("1-URGENT", "US2Y", "2-HIGH", "US5Y", "3-MEDIUM", "US10Y", "4-NOT SPECIFIED", "DE2Y", "5-LOW", "DE10Y")]), F.col("o_orderpriority")).alias("symbol"),
        F.to_date("o_orderdate").alias("observation_date"),
        F.lit("nominal").alias("maturity"),
        F.date_add(F.to_date("o_orderdate"), (F.col("o_orderkey") % 3).cast("int")).alias("vintage_date"),
        F.when(F.col("o_orderkey") % 41 == 0, F.lit(None)).otherwise(F.col("o_totalprice") / 100000.0).alias("value"),
        t.plus_minutes(F.col("o_orderdate"), F.when(F.col("o_orderkey") % 37 == 0, -60).otherwise(1440)).alias("available_ts"),
        F.col("o_orderdate").alias("published_ts"),
        (F.col("o_orderkey") % 3 > 0).alias("is_revised"),
    )


VOLUME = "cast(regexp_extract(props, '(-?[0-9]+)', 1) as double)"
TICKS = f"""ticks as (select event_id seq, event_type symbol, ts, value price, {VOLUME} volume, 'C' || cast((dayofyear(ts) - 1) // 10 as varchar) contract from events)"""
BARS5 = f"""{TICKS}, bars as (
  select symbol, contract, time_bucket(interval 5 minute, ts) open_ts, time_bucket(interval 5 minute, ts) + interval 5 minute close_ts,
    arg_min(price, seq) "open", max(price) high, min(price) low, arg_max(price, seq) "close", sum(volume) volume, avg(price) vwap, count(*) trade_count, min(seq) bar_id, count(*) < 2 is_partial
  from ticks group by all)"""
RAW = f"""raw0 as (
  select event_id bar_id, event_type symbol, ts, case when event_id % 53 = 0 then ts else time_bucket(interval 5 minute, ts) end open_ts, value "open",
    case when event_id % 97 = 0 then null when event_id % 89 = 0 then 0.0 when event_id % 83 = 0 then -value else value + 0.25 end::double "close", {VOLUME} v
  from events), raw as (
  select bar_id, symbol, open_ts, open_ts + case when bar_id % 59 = 0 then interval 4 minute else interval 5 minute end close_ts, 'C' || cast((dayofyear(ts) - 1) // 10 as varchar) contract, true is_continuous,
    "open", case when bar_id % 79 = 0 then "open" - 1 else greatest("open", "close") end high, least("open", "close") low, "close",
    case when bar_id % 71 = 0 then -v - 1 when bar_id % 7 = 0 then 0.0 else v end volume, bar_id % 101 = 0 is_roll_affected, bar_id % 61 = 0 is_partial, cast(ts as date) trading_date,
    case when bar_id % 67 = 0 then 'scheduled_break_observation' when bar_id % 73 = 0 then 'outside_scheduled_market' else 'regular_session' end session_type
  from raw0), sound as (select * from raw where open_ts is not null and close_ts is not null and "open" is not null and high is not null and low is not null and "close" is not null)"""
YIELDS = """yields as (
  select o_orderkey obs_id, case o_orderpriority when '1-URGENT' then 'US2Y' when '2-HIGH' then 'US5Y' when '3-MEDIUM' then 'US10Y' when '4-NOT SPECIFIED' then 'DE2Y' when '5-LOW' then 'DE10Y' end symbol,
    cast(o_orderdate as date) observation_date, 'nominal' maturity, cast(cast(o_orderdate as date) + cast(o_orderkey % 3 as integer) as date) vintage_date,
    case when o_orderkey % 41 = 0 then null else o_totalprice / 100000.0::double end as "value", o_orderdate + case when o_orderkey % 37 = 0 then interval (-60) minute else interval 1440 minute end available_ts, o_orderdate published_ts, o_orderkey % 3 > 0 is_revised
  from orders)"""
#: New York sessions from the events' first to last day, which lie in one winter without clock changes.
SESSIONS = """sess as (
  select cast(d as date) trading_date, timezone('UTC', timezone('America/New_York', cast(d as timestamp) + interval 570 minute)) open_ts, timezone('UTC', timezone('America/New_York', cast(d as timestamp) + interval 960 minute)) close_ts
  from (select unnest(generate_series(date '2023-12-28', date '2024-03-31', interval 1 day)) d)
  where isodow(d) <= 5 and cast(d as date) not in (date '2024-01-01', date '2024-01-15', date '2024-02-19', date '2024-03-29'))"""
