"""Canonical schemas and the projections that bring any input to them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T



def _schema(columns: str) -> T.StructType:
    out = T.StructType()
    for c in columns.split(", "):
        out.add(*c.split(" "))
    return out


BARS = _schema(
    "symbol string, open_ts timestamp_ntz, close_ts timestamp_ntz, contract string, is_continuous boolean, open double, high double, low double, close double, volume double, "
    "trade_count long, vwap double, open_interest double, bid double, ask double, source string, trading_date date, session_type string, is_regular boolean, is_extended boolean, "
    "is_partial boolean, is_roll_affected boolean, is_stale boolean, quality_status string, ingest_seq long"
)
YIELDS = _schema("symbol string, observation_date date, maturity string, vintage_date date, available_ts timestamp_ntz, published_ts timestamp_ntz, value double, is_revised boolean, source string, ingest_seq long")
ISSUES = _schema("bar_id long, symbol string, issue_ts timestamp_ntz, issue_type string, severity string, disposition string, observed_value string, expected string")
#: The columns that research exports keep.
RESEARCH = ("symbol", "open_ts", "open", "high", "low", "close", "volume", "vwap", "trade_count", "trading_date", "is_regular", "is_extended", "session_type", "is_partial", "quality_status")


def without_nan(c: Column) -> Column:
    return F.when(~F.isnan(c), c)


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """df with just the columns of schema: missing ones null, unknown ones dropped, unreadable values null, NaN null."""
    out = []
    for f in schema:
        if f.name not in df.columns:
            out.append(F.lit(None).cast(f.dataType).alias(f.name))
            continue
        c = F.col(f.name)
        if df.schema[f.name].dataType != f.dataType:
            c = c.try_cast(f.dataType)
        out.append((without_nan(c) if isinstance(f.dataType, T.DoubleType) else c).alias(f.name))
    return df.select(*out)


def require(df: DataFrame, columns: list[str]) -> DataFrame:
    if absent := sorted(set(columns) - set(df.columns)):
        raise ValueError(f"missing columns: {', '.join(absent)}")
    return df


def overlay(df: DataFrame, keys: list[str], metadata: str = "metadata_json") -> DataFrame:
    """The columns named, each replaced by the metadata's value where the JSON has one."""
    return df.withColumns({k: F.coalesce(F.get_json_object(metadata, f"$.{k}"), F.col(k).cast("string") if k in df.columns else F.lit(None).cast("string")) for k in keys})


def select_instruments(catalogue: DataFrame, symbols: list[str] | None = None, providers: list[str] | None = None, symbol: str = "symbol", provider: str = "provider") -> DataFrame:
    """Rows of the catalogue by symbol and provider, whatever their case; an unknown symbol is an error."""
    if symbols:
        wanted = sorted({s.upper() for s in symbols})
        known = {r[0] for r in catalogue.select(F.upper(symbol)).filter(F.upper(symbol).isin(wanted)).distinct().collect()}  # at most as many as were asked for
        if absent := sorted(set(wanted) - known):
            raise ValueError(f"unknown symbols: {', '.join(absent)}")
        catalogue = catalogue.filter(F.upper(symbol).isin(wanted))
    if providers:
        catalogue = catalogue.filter(F.lower(provider).isin([p.lower() for p in providers]))
    return catalogue


def record_id(*columns: str) -> Column:
    """The same id for the same key, always: SHA-256 of its values as text, held apart, nulls told from empty texts."""
    parts = [F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("~")) for c in columns]
    return F.sha2(F.concat_ws("|", *parts), 256)
