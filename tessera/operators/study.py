"""Evaluation of signals: purged folds, bootstrap by day blocks, event studies, rolling correlation, session-anchored returns, same-time history."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import timeops as t
from ..functions.windows import lagged, over_days
from .sessions import by_day

#: Chances that a Poisson variable of mean 1 is at most 0, 1, 2, ...; what is left beyond is under 1e-9.
POISSON = tuple(math.exp(-1) * sum(1 / math.factorial(j) for j in range(k + 1)) for k in range(11))


DAY = 86_400_000_000

# --- folds ------------------------------------------------------------------------------------------------------------


def fold_of_days(labels: DataFrame, folds: int, ts: str = "start_ts") -> DataFrame:
    """labels with ``test_fold``: their days in order, cut into folds + 1 equal stretches, of which the first, 0, is never tested."""
    days = labels.select(F.to_date(ts).alias("_day")).distinct()
    # as many rows as there are days: the window is over these alone
    ranked = days.select("_day", (F.row_number().over(Window.orderBy("_day")) - 1).alias("_n"), F.count("*").over(Window.partitionBy()).alias("_all"))
    of = ranked.select("_day", F.floor(F.col("_n") * (folds + 1) / F.col("_all")).cast("int").alias("test_fold"))
    return labels.join(of, F.to_date(ts) == F.col("_day")).drop("_day")


def _islands(spans: DataFrame) -> DataFrame:
    """(fold, day, lo, hi): the union of spans as disjoint stretches, each day's by itself. Spans are [lo, hi) in microseconds."""
    days = spans.withColumn("day", F.explode(F.sequence(F.floor(F.col("lo") / DAY), F.floor((F.col("hi") - 1) / DAY))))
    cut = days.select("fold", "day", F.greatest("lo", F.col("day") * DAY).alias("lo"), F.least("hi", (F.col("day") + 1) * DAY).alias("hi"))
    one = cut.groupBy("fold", "day", "lo").agg(F.max("hi").alias("hi"))  # those of all symbols together, before the shuffle by day
    w = Window.partitionBy("fold", "day").orderBy("lo")
    begins = F.coalesce(F.col("lo") > F.max("hi").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(True))
    numbered = one.withColumn("_begins", begins.cast("int")).withColumn("_island", F.sum("_begins").over(w))
    return numbered.groupBy("fold", "day", "_island").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).drop("_island")


def purged_folds(labels: DataFrame, folds: int, embargo_minutes: int, forward: bool = True, start: str = "start_ts", end: str = "end_ts") -> DataFrame:
    """A row for each label and fold with ``fold`` and ``role``: test, train, purged or embargoed; with ``forward``, labels after the test stretch have none.

    A label's span is [start, end). It can't train a fold if it overlaps a test span of any symbol (purged), or one
    widened by the embargo on both sides (embargoed). Test spans are united into few stretches a day, and labels meet
    them by an equality join on fold and day, so neither all pairs nor a nested loop arise.
    """
    us = lambda c: t.micros(F.col(c))
    placed = fold_of_days(labels, folds, start)
    spans = placed.filter("test_fold > 0").select(F.col("test_fold").alias("fold"), us(start).alias("lo"), us(end).alias("hi")).distinct()
    wide = spans.select("fold", (F.col("lo") - embargo_minutes * t.MINUTE).alias("lo"), (F.col("hi") + embargo_minutes * t.MINUTE).alias("hi"))
    stretches = _islands(spans).withColumn("_kind", F.lit(0)).unionByName(_islands(wide).withColumn("_kind", F.lit(1)))
    stretches = stretches.select(F.col("fold").alias("_f"), F.col("day").alias("_d"), F.col("lo").alias("_lo"), F.col("hi").alias("_hi"), "_kind")
    each = placed.withColumn("fold", F.explode(F.sequence(F.lit(1), F.lit(folds)))).withColumns({"_a": us(start), "_b": us(end)})
    if forward:
        each = each.filter(F.col("test_fold") <= F.col("fold"))
    day = F.sequence(F.floor(F.col("_a") / DAY), F.floor((F.col("_b") - 1) / DAY))
    # what bars a label is its span alone, which those of all symbols share
    training = each.filter("test_fold <> fold").select("fold", "_a", "_b").distinct().withColumn("day", F.explode(day))
    met = training.join(stretches, (F.col("fold") == F.col("_f")) & (F.col("day") == F.col("_d")) & (F.col("_a") < F.col("_hi")) & (F.col("_b") > F.col("_lo")))
    barred = met.groupBy("fold", "_a", "_b").agg(F.min("_kind").alias("_kind"))
    out = each.join(barred, ["fold", "_a", "_b"], "left")
    role = F.when(F.col("test_fold") == F.col("fold"), "test").when(F.col("_kind") == 0, "purged").when(F.col("_kind") == 1, "embargoed").otherwise("train")
    return out.withColumn("role", role).select(*[F.col(f"`{c}`") for c in labels.columns], "fold", "role")


# --- bootstrap --------------------------------------------------------------------------------------------------------


def poisson_weight(replicate: Column, block: Column) -> Column:
    """How often a replicate draws a block: a Poisson variable of mean 1 read off a hash of both, so that anybody gets the same draws."""
    digits = F.substring(F.md5(F.concat_ws("|", replicate.cast("string"), block.cast("string"))), 1, 8)
    u = F.conv(digits, 16, 10).cast("long") / F.lit(1 << 32)
    return sum((F.when(u >= p, 1).otherwise(0) for p in POISSON), F.lit(0))


def block_bootstrap(rows: DataFrame, value: str, by: Sequence[str] = ("symbol",), ts: str = "slot_ts", block_days: int = 1, replicates: int = 200, level: float = 0.95) -> DataFrame:
    """by, n, n_blocks, mean, low, high: the mean of a value and its percentile interval over replicates that draw whole blocks of days.

    No row is copied: a block is one row of sums, each replicate weighs it, and replicates without a draw don't count.
    Blocks are the same for all groups, so that dependence across them is kept. Null values don't count.
    """
    block = F.floor(F.unix_date(F.to_date(ts)) / block_days)
    sums = rows.filter(F.col(value).isNotNull()).groupBy(*by, block.alias("_block")).agg(F.count("*").alias("_n"), F.sum(value).alias("_sum"))
    drawn = sums.withColumn("_r", F.explode(F.sequence(F.lit(1), F.lit(replicates)))).withColumn("_w", poisson_weight(F.col("_r"), F.col("_block")))
    means = drawn.groupBy(*by, "_r").agg((F.sum(F.col("_w") * F.col("_sum")) / F.nullif(F.sum(F.col("_w") * F.col("_n")), F.lit(0))).alias("_mean"))
    ends = means.groupBy(*by).agg(F.percentile("_mean", F.array(F.lit((1 - level) / 2), F.lit((1 + level) / 2))).alias("_p"))
    whole = sums.groupBy(*by).agg(F.sum("_n").alias("n"), F.count("*").alias("n_blocks"), (F.sum("_sum") / F.sum("_n")).alias("mean"))
    return whole.join(ends, list(by)).select(*by, "n", "n_blocks", "mean", F.col("_p")[0].alias("low"), F.col("_p")[1].alias("high"))


# --- event studies ----------------------------------------------------------------------------------------------------


def event_study(grid: DataFrame, event: Column, before: int = 6, after: int = 12, ts: str = "slot_ts", minutes: int = 5) -> DataFrame:
    """is_overlapping, step, n_events, n_known, mean_return, share_up, base_return, base_up, uplift: the mean path around events, slot by slot.

    An event overlaps if another of its symbol lies at most ``after`` slots before it. The base is the mean over all
    slots of the same time of day; uplift is the mean return less that of the bases of the very slots that events met.
    """
    at = grid.filter(F.coalesce(event, F.lit(False))).select("symbol", ts)
    told = lagged(at, "symbol", ts, (), {"_prior": ts})
    near = t.micros(F.col(ts)) - t.micros(F.col("_prior")) <= after * minutes * t.MINUTE
    told = told.select("symbol", F.col(ts).alias("_at"), F.coalesce(near, F.lit(False)).alias("is_overlapping"))
    steps = told.withColumn("step", F.explode(F.sequence(F.lit(-before), F.lit(after)))).withColumn("_slot", t.plus_minutes(F.col("_at"), F.col("step") * minutes))
    clock = lambda c: F.hour(c) * 60 + F.minute(c)
    base = grid.groupBy(clock(F.col(ts)).alias("_clock")).agg(F.avg("return").alias("_base"), F.avg((F.col("return") > 0).cast("double")).alias("_base_up"))
    rows = grid.select(F.col("symbol").alias("_s"), F.col(ts).alias("_t"), "return")
    met = steps.join(rows, (F.col("symbol") == F.col("_s")) & (F.col("_slot") == F.col("_t")), "left").withColumn("_c", clock(F.col("_slot")))
    met = met.join(F.broadcast(base), F.col("_c") == F.col("_clock"), "left")  # as many rows as there are slots in a day
    known = F.col("return").isNotNull()
    out = met.groupBy("is_overlapping", "step").agg(
        F.count("*").alias("n_events"),
        F.count("return").alias("n_known"),
        F.avg("return").alias("mean_return"),
        F.avg((F.col("return") > 0).cast("double")).alias("share_up"),
        F.avg(F.when(known, F.col("_base"))).alias("base_return"),
        F.avg(F.when(known, F.col("_base_up"))).alias("base_up"),
    )
    return out.withColumn("uplift", F.col("mean_return") - F.col("base_return"))


# --- correlation ------------------------------------------------------------------------------------------------------


def rolling_correlation(grid: DataFrame, symbols: Sequence[str], window: int = 48, least: int = 12, ts: str = "slot_ts", minutes: int = 5) -> DataFrame:
    """(a, b, slot, n, correlation, change) for each pair of symbols: the correlation of their returns over the last ``window`` slots, and how it differs from that of the window before.

    Moments are differences of running sums. Sums begin anew with each day's copy of the slots it needs from before, so
    nothing is lost to cancellation however long the series is, and a pair is as many tasks as it has days. Fewer than
    ``least`` slots with both returns, or no variance, give null.
    """
    names = sorted(symbols)
    wide = grid.filter(F.col("symbol").isin(*names)).groupBy(ts).pivot("symbol", names).agg(F.max("return"))
    pairs = [F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"`{a}`").alias("x"), F.col(f"`{b}`").alias("y")) for i, a in enumerate(names) for b in names[i + 1 :]]
    rows = wide.select(ts, F.explode(F.array(*pairs)).alias("p")).select("p.a", "p.b", ts, "p.x", "p.y")
    both = F.col("x").isNotNull() & F.col("y").isNotNull()
    parts = {"n": F.lit(1.0), "x": F.col("x"), "y": F.col("y"), "xx": F.col("x") * F.col("x"), "yy": F.col("y") * F.col("y"), "xy": F.col("x") * F.col("y")}

    def columns(w):
        up_to = w.rowsBetween(Window.unboundedPreceding, 0)
        total = {f"_r{k}": F.sum(F.when(both, c).otherwise(F.lit(0.0))).over(up_to) for k, c in parts.items()}
        moment = {f"_m{k}": F.col(f"_r{k}") - F.coalesce(F.lag(f"_r{k}", window).over(w), F.lit(0.0)) for k in parts}
        m = {k: F.col(f"_m{k}") for k in parts}
        vx, vy = m["n"] * m["xx"] - m["x"] * m["x"], m["n"] * m["yy"] - m["y"] * m["y"]
        r = F.when((m["n"] >= least) & (vx > 0) & (vy > 0), (m["n"] * m["xy"] - m["x"] * m["y"]) / F.sqrt(vx * vy))
        return [total, moment, {"n": m["n"].cast("long"), "correlation": r}, {"change": F.col("correlation") - F.lag("correlation", window).over(w)}]

    return over_days(rows, ("a", "b"), ts, 2 * window * minutes * t.MINUTE, 0, columns).select("a", "b", ts, "n", "correlation", "change")


# --- sessions as targets ----------------------------------------------------------------------------------------------


def session_prices(bars: DataFrame, found: DataFrame) -> DataFrame:
    """(symbol, session_open, session_close, first_open, last_close) of each session in which a symbol has a bar."""
    listed = by_day(found).select(F.col("_day").alias("_on"), F.col("open_ts").alias("session_open"), F.col("close_ts").alias("session_close"))
    inside = (F.col("open_ts") >= F.col("session_open")) & (F.col("open_ts") < F.col("session_close"))
    rows = bars.select("symbol", "open_ts", "open", "close").join(listed, (F.to_date("open_ts") == F.col("_on")) & inside)
    return rows.groupBy("symbol", "session_open", "session_close").agg(F.min_by("open", "open_ts").alias("first_open"), F.max_by("close", "open_ts").alias("last_close"))


def _ahead(prices: DataFrame, at: str, value: str, first: DataFrame, into: str) -> DataFrame:
    """For each symbol and UTC day, the values that come next, each with the stretch (_from, _to] of moments that look at it."""
    before = F.lag(at).over(Window.partitionBy("symbol").orderBy(at))  # sessions of one symbol: as many as it has days
    spans = prices.withColumn("_before", before).join(first, "symbol")
    begin = F.coalesce("_before", F.date_trunc("day", F.least("_first", at)).cast("timestamp_ntz"))
    days = F.sequence(F.to_date(begin), F.to_date(at))
    return spans.select(F.col("symbol").alias("_s"), F.explode(days).alias("_on"), F.col("_before").alias("_from"), F.col(at).alias("_to"), F.col(value).alias(into))


def session_targets(bars: DataFrame, found: DataFrame) -> DataFrame:
    """bars with to_close and to_next_open: the return from a bar's close to the last price of the first session that closes at or after the bar's end, and to the first price of the first session that opens at or after it.

    Sessions without a bar of the symbol don't count; without a later one the return is null. The search forward is an
    equality join on symbol and day: each session is listed under the days on which it is the next one.
    """
    prices = session_prices(bars, found)
    first = bars.groupBy("symbol").agg(F.min("close_ts").alias("_first"))
    out = bars.withColumn("_day", F.to_date("close_ts"))
    for at, value, into in (("session_close", "last_close", "to_close"), ("session_open", "first_open", "to_next_open")):
        next_ = _ahead(prices, at, value, first, "_value")
        moment = F.col("close_ts")
        inside = (moment > F.col("_from")) | F.col("_from").isNull()
        out = out.join(next_, (F.col("symbol") == F.col("_s")) & (F.col("_day") == F.col("_on")) & inside & (moment <= F.col("_to")), "left")
        out = out.withColumn(into, F.when(F.col("close") != 0, F.col("_value") / F.col("close") - 1)).drop("_s", "_on", "_from", "_to", "_value")
    return out.drop("_day")


# --- same time of day -------------------------------------------------------------------------------------------------


def same_time_history(grid: DataFrame, value: str = "return", days: int = 10, least: int = 3, keys: Sequence[str] = ("symbol",), ts: str = "slot_ts") -> DataFrame:
    """grid with n_history, z_score and rank: a value against those of the same time on the ``days`` days before, itself and later ones never among them.

    ``rank`` is the share of earlier values of smaller size. Fewer than ``least`` earlier values give null. The grid has a
    row for every day; a time of day's rows are as many as there are days.
    """
    w = Window.partitionBy(*keys, F.hour(ts), F.minute(ts)).orderBy(ts).rowsBetween(-days, -1)
    out = grid.withColumns({"n_history": F.count(value).over(w), "_mean": F.avg(value).over(w), "_dev": F.stddev_samp(value).over(w), "_seen": F.collect_list(F.abs(value)).over(w)})
    enough = (F.col("n_history") >= least) & F.col(value).isNotNull()
    smaller = F.size(F.filter("_seen", lambda x: x < F.abs(F.col(value))))
    return out.withColumns({
        "z_score": F.when(enough & (F.col("_dev") > 0), (F.col(value) - F.col("_mean")) / F.col("_dev")),
        "rank": F.when(enough, smaller / F.col("n_history")),
    }).drop("_mean", "_dev", "_seen")


def group_divergence(grid: DataFrame, one: Sequence[str], other: Sequence[str], ts: str = "slot_ts", **history) -> DataFrame:
    """A row a slot: how far two groups of symbols agree in sign each (1 all alike, 0 evenly split), the difference of their mean returns, and that against the same time of earlier days."""
    member = F.when(F.col("symbol").isin(*one), 1).when(F.col("symbol").isin(*other), 2)
    of = lambda k, c: F.when(F.col("_group") == k, c)
    agree = lambda k: F.abs(F.sum(of(k, F.signum("return")))) / F.nullif(F.count(of(k, F.col("return"))), F.lit(0))
    slots = grid.withColumn("_group", member).filter("_group is not null").groupBy(ts).agg(agree(1).alias("agreement"), agree(2).alias("other_agreement"), (F.avg(of(1, F.col("return"))) - F.avg(of(2, F.col("return")))).alias("difference"))
    return same_time_history(slots, "difference", keys=(), ts=ts, **history)
