"""Market-data providers behind one registry, and one Spark data source over them: batches with pushed time filters, and a stream that goes on from its offsets."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from datetime import UTC, datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual
from pyspark.sql.types import StructType

from ..operators import bars as B
from .rest import Span, fetch_json, pages, spans

BARS = "symbol string, open_ts timestamp_ntz, open double, high double, low double, close double, volume double, trade_count bigint, vwap double"
OBSERVATIONS = "symbol string, observation_date date, vintage_date date, value double"


@dataclass(frozen=True)
class Provider:
    """How one kind of service is asked, and how its answers read. ``days`` is the longest stretch that a request may ask for."""

    name: str
    schema: str
    time: str
    days: float
    params: Callable[[str, datetime, datetime], dict[str, str]]
    rows: Callable[[str, object], Iterator[tuple]]


def _bars(symbol: str, page: dict) -> Iterator[tuple]:
    for b in page.get("bars") or []:
        yield symbol, datetime.fromisoformat(b["t"].replace("Z", "+00:00")).replace(tzinfo=None), float(b["o"]), float(b["h"]), float(b["l"]), float(b["c"]), float(b["v"]), b.get("n"), b.get("vw")


def _candles(symbol: str, page: list) -> Iterator[tuple]:
    whole = {c[0]: c for c in sorted(c[:6] for c in page if len(c) >= 6)}  # of several at one time the greatest
    for at, low, high, first, last, volume in whole.values():
        yield symbol, datetime.fromtimestamp(at, UTC).replace(tzinfo=None), float(first), float(high), float(low), float(last), float(volume), None, None


def _observations(symbol: str, page: dict) -> Iterator[tuple]:
    for o in page.get("observations") or []:
        if o.get("value") not in (None, "."):
            yield symbol, datetime.fromisoformat(o["date"]).date(), datetime.fromisoformat(o["realtime_start"]).date(), float(o["value"])


PROVIDERS = {
    p.name: p
    for p in (
        Provider("paged_bars", BARS, "open_ts", 30, lambda s, a, b: {"symbol": s, "timeframe": "5Min", "start": a.isoformat(), "end": b.isoformat()}, _bars),
        Provider("candles", BARS, "open_ts", 1, lambda s, a, b: {"granularity": "300", "start": a.isoformat(), "end": b.isoformat()}, _candles),
        Provider("observations", OBSERVATIONS, "observation_date", 3650, lambda s, a, b: {"series_id": s, "observation_start": a.date().isoformat(), "observation_end": b.date().isoformat()}, _observations),
    )
}


def provider(name: str) -> Provider:
    if name not in PROVIDERS:
        raise ValueError(f"no provider called {name!r}; there are {', '.join(sorted(PROVIDERS))}")
    return PROVIDERS[name]


def _when(value) -> datetime:
    return value if isinstance(value, datetime) else datetime(value.year, value.month, value.day)


def _read(options: dict[str, str], part: Span) -> Iterator[tuple]:
    """The rows of one request and its pages that lie in the part's half-open stretch."""
    p = provider(options["provider"])
    url = options["url"].replace("{symbol}", part.symbol)
    for page in pages(url, p.params(part.symbol, part.start, part.end), lambda u: _document(fetch_json(u))):
        for row in p.rows(part.symbol, page.get("list", page)):
            if part.start <= _when(row[1]) < part.end:
                yield row


def _document(found) -> dict:
    return {"list": found} if isinstance(found, list) else found


def _parts(options: dict[str, str], symbols: list[str], start: datetime, end: datetime) -> list[Span]:
    days = min(provider(options["provider"]).days, float(options.get("chunkdays", "30")))
    return [Span(s, a, b) for s in symbols for a, b in spans(start, end, days)]


class MarketReader(DataSourceReader):
    """Filters on the time column and on symbols cut down what is asked for; Spark applies them to the rows as well."""

    def __init__(self, options: dict[str, str]):
        self.options = options
        self.start, self.end = (datetime.fromisoformat(options[k]) for k in ("start", "end"))
        self.symbols = [s.strip() for s in options["symbols"].split(",")]

    def pushFilters(self, filters):
        time = provider(self.options["provider"]).time
        for f in filters:
            if f.attribute == (time,) and isinstance(f, (GreaterThan, GreaterThanOrEqual)):
                self.start = max(self.start, _when(f.value))
            elif f.attribute == (time,) and isinstance(f, (LessThan, LessThanOrEqual)):
                self.end = min(self.end, _when(f.value) + (timedelta(0) if isinstance(f, LessThan) else timedelta(days=1) if time.endswith("date") else timedelta(microseconds=1)))
            elif f.attribute == ("symbol",) and isinstance(f, (EqualTo, In)):
                wanted = f.value if isinstance(f, In) else (f.value,)
                self.symbols = [s for s in self.symbols if s in wanted]
            yield f

    def partitions(self) -> list[Span]:
        return _parts(self.options, self.symbols, self.start, self.end)

    def read(self, partition: Span) -> Iterator[tuple]:
        return _read(self.options, partition)


class MarketStream(DataSourceStreamReader):
    """An offset is the moment up to which bars have been asked for. Each batch begins ``overlapMinutes`` before the last one's end, so that late corrections come in; bars still open are left to the next batch."""

    def __init__(self, options: dict[str, str]):
        self.options = options
        self.start = datetime.fromisoformat(options["start"])
        self.symbols = [s.strip() for s in options["symbols"].split(",")]

    def initialOffset(self) -> dict:
        return {"until": self.start.isoformat()}

    def latestOffset(self) -> dict:
        minutes = int(self.options.get("minutes", "5"))
        now = datetime.now(UTC).replace(tzinfo=None)
        whole = now.replace(second=0, microsecond=0) - timedelta(minutes=now.minute % minutes)
        end = datetime.fromisoformat(self.options["end"]) if "end" in self.options else whole
        return {"until": max(self.start, min(end, whole)).isoformat()}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        a, b = (datetime.fromisoformat(x["until"]) for x in (start, end))
        overlap = timedelta(minutes=float(self.options.get("overlapminutes", "30")))
        return _parts(self.options, self.symbols, max(self.start, a - overlap), b) if a < b else []

    def read(self, partition: Span) -> Iterator[tuple]:
        return _read(self.options, partition)

    def commit(self, end: dict) -> None:
        pass


class MarketApi(DataSource):
    """spark.dataSource.register(MarketApi); spark.read.format("market_api").options(provider=..., url=..., symbols=..., start=..., end=...).load(); likewise spark.readStream. Names of options come in lower case, however they were written."""

    @classmethod
    def name(cls) -> str:
        return "market_api"

    def schema(self) -> str:
        return provider(self.options["provider"]).schema

    def reader(self, schema: StructType) -> MarketReader:
        return MarketReader(dict(self.options))

    def streamReader(self, schema: StructType) -> MarketStream:
        return MarketStream(dict(self.options))


def load(spark: SparkSession, name: str, url: str, symbols: list[str], start: datetime, end: datetime, **options) -> DataFrame:
    provider(name)
    spark.dataSource.register(MarketApi)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark.read.format("market_api").options(provider=name, url=url, symbols=",".join(symbols), start=start.isoformat(), end=end.isoformat(), **options).load()


def fetcher(spark: SparkSession, name: str, url: str, **options) -> Callable[[str, datetime, datetime], DataFrame]:
    """What ``collect`` takes to fetch a symbol's bars from a provider."""
    return lambda symbol, start, end: load(spark, name, url, [symbol], start, end, **options)


def preflight(spark: SparkSession, name: str, url: str, symbol: str, start: datetime, end: datetime, **options) -> dict:
    """Whether a provider gives usable rows for a symbol: ok, provider, symbol, rows, error. Nothing is stored; a failure is told, not raised."""
    out = {"ok": False, "provider": name, "symbol": symbol, "rows": 0, "error": None}
    try:
        df = load(spark, name, url, [symbol], start, end, **options)
        if provider(name).schema == BARS:
            found = B.preflight(B.normalise(df)).first()
            good, out["rows"] = found["valid"], found["rows"]
        else:
            found = df.agg(F.count("*").alias("rows"), F.count("value").alias("known")).first()
            good, out["rows"] = found["rows"] == found["known"] > 0, found["rows"]
        return out | {"ok": bool(good), "error": None if good else "no usable rows"}
    except Exception as e:  # noqa: BLE001  the caller wants to be told
        causes = re.findall(r"^\s*[\w.]*Error: .*$", str(e), re.MULTILINE)  # a task's error stands at the end of its trace
        return out | {"error": (causes[-1].strip() if causes else f"{type(e).__name__}: {e}")[:500]}
