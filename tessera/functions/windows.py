"""Lags and running sums along a key's time axis without one task for each key.

Rows are dealt by key and day. What a day needs from the days before it is one row a key and day, combined before the
shuffle, so a key with a third of all rows is as many tasks as it has days.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import timeops as t


def _order(ts: str, ties: tuple[str, ...]) -> list[Column]:
    return [F.col(c).asc_nulls_last() for c in (ts, *ties)]


def _rank(ts: str, ties: tuple[str, ...]) -> Column:
    """A value that sorts as the order does; nulls come last in both."""
    return F.struct(*[x for c in (ts, *ties) for x in (F.col(c).isNull().alias(f"{c}_null"), F.col(c).alias(c))])


def _per_day(df: DataFrame, key: str, aggregate: Column, over_days: Column) -> DataFrame:
    return df.groupBy(key, "_day").agg(aggregate.alias("_own")).select(F.col(key).alias("_k"), F.col("_day").alias("_d"), over_days.alias("_earlier"))


def _days_before(key: str):
    return Window.partitionBy(key).orderBy(F.col("_day").asc_nulls_last())


def _joined(df: DataFrame, days: DataFrame, key: str) -> DataFrame:
    return df.join(days, F.col(key).eqNullSafe(F.col("_k")) & F.col("_day").eqNullSafe(F.col("_d")), "left").drop("_k", "_d")


def lagged(df: DataFrame, key: str, ts: str, ties: tuple[str, ...], columns: dict[str, str], piece: Column | None = None) -> DataFrame:
    """df with, for each name in ``columns``, the value of that column in the key's row before; null for the first row. ``piece`` as in ``running``."""
    df = df.withColumn("_day", F.to_date(ts) if piece is None else piece)
    values = F.struct(*[F.col(c).alias(n) for n, c in columns.items()])
    days = _per_day(df, key, F.max_by(values, _rank(ts, ties)), F.lag("_own").over(_days_before(key)))
    w = Window.partitionBy(key, "_day").orderBy(*_order(ts, ties))
    out = _joined(df.withColumns({"_n": F.row_number().over(w), "_inner": F.lag(values).over(w)}), days, key)
    return out.withColumns({n: F.when(F.col("_n") == 1, F.col("_earlier")[n]).otherwise(F.col("_inner")[n]) for n in columns}).drop("_day", "_n", "_inner", "_earlier")


#: How a running value is made of a piece's rows, of the pieces before, and of both.
_HOW = {
    "sum": (lambda c, rank: F.coalesce(F.sum(c), F.lit(0)), lambda own, w: F.coalesce(F.sum(own).over(w), F.lit(0)), lambda c, w: F.coalesce(F.sum(c).over(w), F.lit(0)), lambda now, earlier: now + earlier),
    "max": (lambda c, rank: F.max(c), lambda own, w: F.max(own).over(w), lambda c, w: F.max(c).over(w), F.greatest),
    "last": (lambda c, rank: F.max_by(c, F.when(F.col(c).isNotNull(), rank)), lambda own, w: F.last(own, ignorenulls=True).over(w), lambda c, w: F.last(c, ignorenulls=True).over(w), F.coalesce),
}


def running(df: DataFrame, key: str, ts: str, ties: tuple[str, ...], columns: dict[str, tuple[str, str]], piece: Column | None = None) -> DataFrame:
    """df with, for each name in ``columns``, the sum, max or last known value of a column over the key's rows up to this one, in order of ts and ties, nulls last.

    Rows are dealt by key and ``piece``, which must not fall along that order; it is the day if nothing else is named.
    """
    df = df.withColumn("_day", F.to_date(ts) if piece is None else piece)
    own = F.struct(*[_HOW[how][0](c, _rank(ts, ties)).alias(n) for n, (how, c) in columns.items()])
    before = _days_before(key).rowsBetween(Window.unboundedPreceding, -1)
    days = _per_day(df, key, own, F.struct(*[_HOW[how][1](F.col("_own")[n], before).alias(n) for n, (how, _) in columns.items()]))
    w = Window.partitionBy(key, "_day").orderBy(*_order(ts, ties)).rowsBetween(Window.unboundedPreceding, 0)
    out = _joined(df.withColumns({f"_in_{n}": _HOW[how][2](c, w) for n, (how, c) in columns.items()}), days, key)
    return out.withColumns({n: _HOW[how][3](F.col(f"_in_{n}"), F.col("_earlier")[n]) for n, (how, _) in columns.items()}).drop("_day", "_earlier", *[f"_in_{n}" for n in columns])


def running_sums(df: DataFrame, key: str, ts: str, ties: tuple[str, ...], columns: dict[str, str]) -> DataFrame:
    """df with, for each name in ``columns``, the sum of that integer column over the key's rows up to this one."""
    return running(df, key, ts, ties, {n: ("sum", c) for n, c in columns.items()})


def lags_and_runs(df: DataFrame, key: str, ts: str, ties: tuple[str, ...], lags: dict[str, str], runs: dict[str, str]) -> DataFrame:
    """df with, for each name in ``lags``, the value of that column in the key's row before and, for each name in ``runs``, how many rows in a row have this one's value of that column.

    A null begins and ends a run of its own. One summary a key and day serves all: its first and last values, and the
    lengths of the runs that it begins and ends with. Over these small rows, runs are carried from day to day both ways;
    a run that never ends is as many tasks as it has days.
    """
    df = df.withColumn("_day", F.to_date(ts))
    w, day = Window.partitionBy(key, "_day").orderBy(*_order(ts, ties)), Window.partitionBy(key, "_day")
    values = F.struct(*[F.col(c).alias(c) for c in dict.fromkeys([*lags.values(), *runs.values()])])
    step = df.withColumns({"_n": F.row_number().over(w), "_inner": F.lag(values).over(w)})
    step = step.withColumns({f"_id_{r}": F.sum(F.coalesce(F.col(c) != F.col("_inner")[c], F.lit(True)).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)) for r, c in runs.items()})
    step = step.withColumns({f"_len_{r}": F.count(F.lit(1)).over(Window.partitionBy(key, "_day", f"_id_{r}")) for r in runs} | {f"_top_{r}": F.max(f"_id_{r}").over(day) for r in runs})
    of = lambda r: [F.max(F.when(F.col(f"_id_{r}") == 1, F.col(f"_len_{r}"))).alias(f"_lead_{r}"), F.max(F.when(F.col(f"_id_{r}") == F.col(f"_top_{r}"), F.col(f"_len_{r}"))).alias(f"_trail_{r}"), (F.max(f"_id_{r}") == 1).alias(f"_whole_{r}")]
    rank = _rank(ts, ties)
    days = step.groupBy(F.col(key).alias("_k"), F.col("_day").alias("_d")).agg(F.min_by(values, rank).alias("_first"), F.max_by(values, rank).alias("_last"), *[x for r in runs for x in of(r)])
    along = Window.partitionBy("_k").orderBy(F.col("_d").asc_nulls_last())
    back, on = along.rowsBetween(Window.unboundedPreceding, -1), along.rowsBetween(1, Window.unboundedFollowing)
    days = days.withColumns({"_earlier": F.lag("_last").over(along), "_later": F.lead("_first").over(along)})
    for r, c in runs.items():
        joins = {"in": F.coalesce(F.col("_first")[c] == F.col("_earlier")[c], F.lit(False)), "out": F.coalesce(F.col("_last")[c] == F.col("_later")[c], F.lit(False))}
        # what all days before, and all after, would add, and what of it lies beyond the last day at which the run stops
        sums = {"in": F.coalesce(F.sum(f"_trail_{r}").over(back), F.lit(0)), "out": F.coalesce(F.sum(f"_lead_{r}").over(on), F.lit(0))}
        for side, beyond in (("in", lambda m: F.last(m, ignorenulls=True).over(back)), ("out", lambda m: F.first(m, ignorenulls=True).over(on))):
            days = days.withColumn(f"_sum_{side}", sums[side]).withColumn("_stop", F.when(~F.col(f"_whole_{r}") | ~joins[side], F.col(f"_sum_{side}")))
            days = days.withColumn(f"_{side}_{r}", F.when(joins[side], F.col(f"_sum_{side}") - beyond("_stop")).otherwise(F.lit(0)))
    carried = [f"_{side}_{r}" for r in runs for side in ("in", "out")]
    out = _joined(step, days.select("_k", "_d", "_earlier", *carried), key)
    lag = {n: F.when(F.col("_n") == 1, F.col("_earlier")[c]).otherwise(F.col("_inner")[c]) for n, c in lags.items()}
    length = {r: F.col(f"_len_{r}") + F.when(F.col(f"_id_{r}") == 1, F.col(f"_in_{r}")).otherwise(0) + F.when(F.col(f"_id_{r}") == F.col(f"_top_{r}"), F.col(f"_out_{r}")).otherwise(0) for r in runs}
    return out.withColumns(lag | length).drop("_day", "_n", "_inner", "_earlier", *carried, *[f"_{x}_{r}" for r in runs for x in ("id", "len", "top")])


def over_days(df: DataFrame, keys: tuple[str, ...], ts: str, back: int, on: int, columns) -> DataFrame:
    """df with ``columns(window)``, a window by keys and day that also sees the rows of neighbouring days which lie within ``back`` microseconds before or ``on`` after a row. A list of columns is worked out step by step.

    For frames of so many steps on a grid without holes. Only rows near midnight are copied, so a key is as many tasks
    as it has days.
    """
    day = F.to_date(ts)
    copies = F.sequence(F.to_date(t.from_micros(t.micros(F.col(ts)) - on)), F.to_date(t.from_micros(t.micros(F.col(ts)) + back)))
    seen = df.withColumn("_day", F.explode(copies)).withColumn("_own", F.col("_day") == day)
    steps = columns(Window.partitionBy(*keys, "_day").orderBy(ts))
    for step in steps if isinstance(steps, list) else [steps]:
        seen = seen.withColumns(step)
    return seen.filter("_own").drop("_day", "_own")
