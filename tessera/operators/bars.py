"""Bars: normalising, resampling without filling, raw contracts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import schema as S
from ..functions import timeops as t
from ..functions.windows import lagged


def _first(value: str, order: str) -> Column:
    return F.expr(f"min_by({value}, {order}) FILTER (WHERE {value} IS NOT NULL)")


def _last(value: str, order: str) -> Column:
    return F.expr(f"max_by({value}, {order}) FILTER (WHERE {value} IS NOT NULL)")


def normalise(df: DataFrame, minutes: int = 5) -> DataFrame:
    """Canonical bars: a table without symbols or opening times is an error, rows without an opening time go, closing time is opening time plus the interval, flags default to false."""
    flags = {c: F.coalesce(F.col(c), F.lit(False)) for c in ("is_partial", "is_roll_affected", "is_stale", "is_continuous")}
    bars = S.conform(S.require(df, ["symbol", "open_ts"]), S.BARS).dropna(subset=["open_ts"])
    return bars.withColumns(flags | {"close_ts": t.plus_minutes(F.col("open_ts"), minutes)})


def resample(df: DataFrame, minutes: int, expected: int, keys: tuple[str, ...] = ("symbol", "contract"), ts: str = "open_ts", seq: str = "ingest_seq") -> DataFrame:
    """Bars of ``minutes`` from finer ones: first and last prices that are known, extremes, sums.

    Contracts never mix, empty buckets stay absent, nothing is filled. A volume is null where no part has one. Buckets
    of fewer than ``expected`` parts are partial.
    """
    order = f"struct({ts}, {seq})"
    return (
        df.withColumn("_bucket", t.floor_minutes(F.col(ts), minutes))
        .groupBy(*keys, "_bucket")
        .agg(
            _first("open", order).alias("open"),
            F.max("high").alias("high"),
            F.min("low").alias("low"),
            _last("close", order).alias("close"),
            F.sum("volume").alias("volume"),
            F.avg("vwap").alias("vwap"),
            F.coalesce(F.sum("trade_count"), F.lit(0)).alias("trade_count"),
            F.count(F.lit(1)).alias("n_parts"),
            (F.count(F.lit(1)) < expected).alias("is_partial"),
            F.min(seq).alias("ingest_seq"),
        )
        .withColumnRenamed("_bucket", "open_ts")
        .withColumn("close_ts", t.plus_minutes(F.col("open_ts"), minutes))
    )


def observed_bars(bars: DataFrame, minutes: int = 15, part_minutes: int = 5) -> DataFrame:
    """Coarser bars over what was observed, with the return between adjacent complete ones only."""
    parts = minutes // part_minutes
    order = "struct(open_ts, ingest_seq)"
    out = (
        bars.withColumn("_bucket", t.floor_minutes(F.col("open_ts"), minutes))
        .groupBy("symbol", "_bucket")
        .agg(
            _first("open", order).alias("open"),
            F.max("high").alias("high"),
            F.min("low").alias("low"),
            _last("close", order).alias("close"),
            F.coalesce(F.sum("volume"), F.lit(0.0)).alias("volume"),
            F.coalesce(F.sum("trade_count"), F.lit(0)).alias("trade_count"),
            F.count(F.lit(1)).alias("n_observed"),
            F.min("open_ts").alias("first_ts"),
            F.max("open_ts").alias("last_ts"),
        )
        .withColumnRenamed("_bucket", "bar_ts")
        .withColumn("is_complete", F.col("n_observed") == parts)
    )
    out = lagged(out, "symbol", "bar_ts", (), {"_ts": "bar_ts", "_complete": "is_complete", "_close": "close"})
    adjacent = (t.micros(F.col("bar_ts")) - t.micros(F.col("_ts"))) == minutes * t.MINUTE
    valid = adjacent & F.col("is_complete") & F.col("_complete") & (F.col("_close") != 0)
    return out.withColumn("return", F.when(valid, F.col("close") / F.col("_close") - 1)).drop("_ts", "_complete", "_close")


def raw_contracts(bars: DataFrame) -> DataFrame:
    """A copy of a continuous series under each of its contracts' own names; bars without a contract have none."""
    safe = F.upper(F.btrim(F.regexp_replace("contract", "[^A-Za-z0-9]+", "_"), F.lit("_")))
    own = bars.filter(F.col("contract").isNotNull() & (F.trim("contract") != ""))
    return own.withColumns({"symbol": F.concat("symbol", F.lit("__RAW__"), safe), "is_continuous": F.lit(False)})


def contract_rows(bars: DataFrame, catalogue: DataFrame) -> DataFrame:
    """Catalogue rows for the contracts of continuous series: those of the parent, under the names that ``raw_contracts`` gives the bars, with the contract as what a provider is asked for and its last known expiry, if bars tell one. Required columns and names as in the catalogue; contracts of instruments that it doesn't list have none."""
    S.require(catalogue, ["symbol"])
    named = bars if "expiry" in bars.columns else bars.withColumn("expiry", F.lit(None).cast("date"))
    own = named.filter(F.coalesce(F.col("is_continuous"), F.lit(False))) if "is_continuous" in bars.columns else named
    own = own.withColumn("_code", F.col("contract")).withColumn("_parent", F.col("symbol"))
    found = raw_contracts(own).groupBy("_parent", "_code", F.col("symbol").alias("_name")).agg(_last("expiry", "struct(open_ts, ingest_seq)").alias("_expiry"))
    out = catalogue.join(found, F.col("symbol") == F.col("_parent"))
    made = {"symbol": F.col("_name"), "instrument_type": F.lit("future_contract"), "provider_symbol": F.col("_code"), "contract": F.col("_code"), "expiry": F.col("_expiry"), "is_continuous": F.lit(False), "enabled": F.lit(True), "required": F.lit(False)}
    return out.withColumns(made).drop("_parent", "_code", "_name", "_expiry")


def contract_expiry(bars: DataFrame) -> DataFrame:
    """The last known expiry of each contract."""
    return bars.groupBy("symbol", "contract").agg(_last("expiry", "struct(open_ts, ingest_seq)").alias("expiry"))


def preflight(bars: DataFrame, minutes: int = 5) -> DataFrame:
    """One row: whether there are bars, all with prices and all of the interval's length."""
    priced = F.col("open").isNotNull() & F.col("high").isNotNull() & F.col("low").isNotNull() & F.col("close").isNotNull()
    length = (t.micros(F.col("close_ts")) - t.micros(F.col("open_ts"))) == minutes * t.MINUTE
    return bars.agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.bool_and(priced), F.lit(False)).alias("priced"), F.coalesce(F.bool_and(F.coalesce(length, F.lit(False))), F.lit(False)).alias("regular")).withColumn("valid", (F.col("rows") > 0) & F.col("priced") & F.col("regular"))
