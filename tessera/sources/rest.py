"""A Spark data source for paged REST bars: one partition for each span of time, pages followed inside the task."""

from __future__ import annotations

import json
import random
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Iterator
from datetime import datetime, timedelta

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

RETRIED = {408, 425, 429, 500, 502, 503, 504}


def spans(start: datetime, end: datetime, days: float) -> list[tuple[datetime, datetime]]:
    """Half-open pieces of [start, end), each of so many days at most."""
    out, at = [], start
    while at < end:
        out.append((at, min(at + timedelta(days=days), end)))
        at = out[-1][1]
    return out


def fetch_json(url: str, headers: dict[str, str] | None = None, retries: int = 5, wait=time.sleep) -> dict:
    """A JSON document. Passing errors are tried again after what the server asks for, or 2^n seconds and a bit, a minute at most."""
    for n in range(retries + 1):
        try:
            with urllib.request.urlopen(urllib.request.Request(url, headers=headers or {}), timeout=60) as r:
                return json.load(r)
        except urllib.error.HTTPError as e:
            if e.code not in RETRIED or n == retries:
                raise
            asked = (e.headers or {}).get("Retry-After", "")
            wait(min(60.0, float(asked)) if asked.replace(".", "", 1).isdigit() else min(60.0, 2**n + random.random()))
        except urllib.error.URLError:
            if n == retries:
                raise
            wait(min(60.0, 2**n + random.random()))
    raise RuntimeError("unreachable")


def pages(url: str, params: dict[str, str], get=fetch_json) -> Iterator[dict]:
    """Pages until one names no next; a token that comes twice is an error."""
    seen: set[str] = set()
    while True:
        query = urllib.parse.urlencode(params)
        page = get(f"{url}?{query}" if query else url)
        yield page
        token = page.get("next_page_token")
        if not token:
            return
        if token in seen:
            raise ValueError(f"page token repeated: {token}")
        seen.add(token)
        params = params | {"page_token": token}


class Span(InputPartition):
    def __init__(self, symbol: str, start: datetime, end: datetime):
        self.symbol, self.start, self.end = symbol, start, end


class PagedBarsReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.options = options

    def partitions(self) -> list[Span]:
        start, end = (datetime.fromisoformat(self.options[k]) for k in ("start", "end"))
        days = float(self.options.get("chunkdays", "30"))
        return [Span(s.strip(), a, b) for s in self.options["symbols"].split(",") for a, b in spans(start, end, days)]

    def read(self, partition: Span):
        params = {"symbol": partition.symbol, "start": partition.start.isoformat(), "end": partition.end.isoformat()}
        if self.options.get("plain"):  # a fixed document for each symbol, as tests use
            params = {}
        for page in pages(self.options["url"].replace("{symbol}", partition.symbol), params):
            for b in page.get("bars") or []:
                at = datetime.fromisoformat(b["t"].replace("Z", "+00:00")).replace(tzinfo=None)
                if partition.start <= at < partition.end:
                    yield partition.symbol, at, float(b["o"]), float(b["h"]), float(b["l"]), float(b["c"]), float(b["v"]), b.get("n"), b.get("vw")


class PagedBars(DataSource):
    """spark.dataSource.register(PagedBars); spark.read.format("paged_bars").options(url=..., symbols=..., start=..., end=...).load()"""

    @classmethod
    def name(cls) -> str:
        return "paged_bars"

    def schema(self) -> str:
        return "symbol string, open_ts timestamp_ntz, open double, high double, low double, close double, volume double, trade_count bigint, vwap double"

    def reader(self, schema: StructType) -> PagedBarsReader:
        return PagedBarsReader(dict(self.options))
