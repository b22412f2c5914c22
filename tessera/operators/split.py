"""Chronological splits without leaks."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.timeops import moment


@dataclass(frozen=True)
class Split:
    start: datetime
    cutoff: datetime
    end: datetime

    def discovery(self, df: DataFrame, ts: str = "open_ts") -> DataFrame:
        """Rows before the cutoff. Take this first, so that no window or rule sees later rows."""
        return df.filter((F.col(ts) >= moment(self.start)) & (F.col(ts) < moment(self.cutoff)))

    def untouched(self, df: DataFrame, ts: str = "open_ts") -> DataFrame:
        return df.filter((F.col(ts) >= moment(self.cutoff)) & (F.col(ts) < moment(self.end)))


def split(first: datetime, last: datetime, test_days: int = 30, least_share: float = 0.2, cutoff: datetime | None = None) -> Split:
    """The cutoff is the earlier of the end less the test days and the start plus the share left to discovery, at five minutes; both sides must be non-empty."""
    end = last + timedelta(minutes=5)
    at = cutoff or min(last - timedelta(days=test_days), first + (last - first) * (1 - least_share))
    at = at - timedelta(minutes=at.minute % 5, seconds=at.second, microseconds=at.microsecond)
    if not first < at < end:
        raise ValueError("a side of the split is empty")
    return Split(first, at, end)


def bounds(df: DataFrame, ts: str = "open_ts") -> tuple[datetime, datetime]:
    lo, hi = df.agg(F.min(ts), F.max(ts)).first()
    if lo is None:
        raise ValueError("no rows to split")
    return lo, hi


def earlier_window(first: datetime, days: int = 365) -> tuple[datetime, datetime]:
    """The window of history that ends where a data set begins."""
    return first - timedelta(days=days), first
