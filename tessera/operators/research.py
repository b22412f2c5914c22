"""Research features over an aligned grid or bars: all look back only, but for labels, which are named forward."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import timeops as t
from ..functions.windows import lagged, over_days, running


def _steps(grid: DataFrame, ts: str, back: int, on: int, columns, minutes: int = 5) -> DataFrame:
    """Columns over a window of that many steps back and on; the grid has a row for every symbol and slot."""
    return over_days(grid, ("symbol",), ts, back * minutes * t.MINUTE, on * minutes * t.MINUTE, columns)


def forward_returns(grid: DataFrame, steps: tuple[int, ...] = (1, 3, 6, 12, 48), ts: str = "slot_ts") -> DataFrame:
    """Return to the slot that many steps on; null unless both closes are observed."""
    return _steps(grid, ts, 0, max(steps), lambda w: {f"forward_{k}": F.when(F.col("close") != 0, F.lead("close", k).over(w) / F.col("close") - 1) for k in steps})


def excursions(grid: DataFrame, steps: int = 12, ts: str = "slot_ts") -> DataFrame:
    """Largest favourable and adverse move over the next steps, against the close."""
    sound = F.col("close").isNotNull() & (F.col("close") != 0)
    return _steps(grid, ts, 0, steps, lambda w: {"mfe": F.when(sound, F.max("high").over(w.rowsBetween(1, steps)) / F.col("close") - 1), "mae": F.when(sound, F.min("low").over(w.rowsBetween(1, steps)) / F.col("close") - 1)})


def time_to_threshold(grid: DataFrame, share: float = 0.05, steps: int = 12, ts: str = "slot_ts") -> DataFrame:
    """Slots until a high first exceeds the close by a share, within the next steps; null if it doesn't."""
    return _steps(grid, ts, 0, steps, lambda w: {"steps_to_threshold": F.coalesce(*[F.when(F.lead("high", k).over(w) >= F.col("close") * (1 + share), F.lit(k)) for k in range(1, steps + 1)])})


def trailing(grid: DataFrame, n: int = 12, ts: str = "slot_ts") -> DataFrame:
    """Realised volatility of the n returns before this slot, and volume relative to the mean of the n slots before."""
    return _steps(grid, ts, n, 0, lambda w: {"realised_vol": F.stddev_samp("return").over(w.rowsBetween(-n, -1)), "relative_volume": F.try_divide(F.col("volume"), F.avg("volume").over(w.rowsBetween(-n, -1)))})


def intrabar(bars: DataFrame) -> DataFrame:
    """Range, position of the close in it, deviation from VWAP, gap against the close before."""
    return lagged(bars, "symbol", "open_ts", (), {"_before": "close"}).withColumns({
        "range_share": F.try_divide(F.col("high") - F.col("low"), F.col("close")),
        "close_position": F.try_divide(F.col("close") - F.col("low"), F.col("high") - F.col("low")),
        "vwap_deviation": F.try_divide(F.col("close"), F.col("vwap")) - 1,
        "open_gap": F.try_divide(F.col("open"), F.col("_before")) - 1,
    }).drop("_before")


def acceleration(grid: DataFrame, ts: str = "slot_ts") -> DataFrame:
    return _steps(grid, ts, 1, 0, lambda w: {"acceleration": F.col("return") - F.lag("return").over(w)})


def drawdown(bars: DataFrame) -> DataFrame:
    """Share below the highest close so far."""
    return running(bars, "symbol", "open_ts", (), {"_top": ("max", "close")}).withColumn("drawdown", F.try_divide(F.col("close"), F.col("_top")) - 1).drop("_top")


def opening_range(bars: DataFrame, minutes: int = 30) -> DataFrame:
    """High and low of the first minutes of each symbol's day."""
    day = bars.withColumn("day", F.to_date("open_ts"))
    start = F.min("open_ts").over(Window.partitionBy("symbol", "day"))
    early = day.withColumn("_start", start).filter(t.micros(F.col("open_ts")) - t.micros(F.col("_start")) < minutes * t.MINUTE)
    return early.groupBy("symbol", "day").agg(F.max("high").alias("range_high"), F.min("low").alias("range_low"))


def breadth(grid: DataFrame, ts: str = "slot_ts") -> DataFrame:
    """How many symbols rose and fell in each slot."""
    return grid.groupBy(ts).agg(F.count_if(F.col("return") > 0).alias("n_up"), F.count_if(F.col("return") < 0).alias("n_down"), F.count("return").alias("n_known"))


def differential(grid: DataFrame, a: str, b: str, ts: str = "slot_ts") -> DataFrame:
    """Return of one symbol less another's, slot by slot."""
    wide = grid.filter(F.col("symbol").isin(a, b)).groupBy(ts).pivot("symbol", [a, b]).agg(F.max("return"))
    return wide.select(ts, (F.col(f"`{a}`") - F.col(f"`{b}`")).alias("differential"))


def lagged_correlation(grid: DataFrame, leader: str, follower: str, lags: tuple[int, ...] = (0, 1, 2, 3), ts: str = "slot_ts", minutes: int = 5) -> DataFrame:
    """Correlation of a leader's return with a follower's that many slots later."""
    wide = grid.filter(F.col("symbol").isin(leader, follower)).groupBy(ts).pivot("symbol", [leader, follower]).agg(F.max("return"))
    shifted = over_days(wide, (), ts, 0, max(lags) * minutes * t.MINUTE, lambda w: {f"y{k}": F.lead(f"`{follower}`", k).over(w) for k in lags}).withColumn("x", F.col(f"`{leader}`"))
    long = shifted.select("x", F.explode(F.array(*[F.struct(F.lit(k).alias("lag"), F.col(f"y{k}").alias("y")) for k in lags])).alias("p")).select("x", "p.*")
    return long.filter("x is not null and y is not null").groupBy("lag").agg(F.count(F.lit(1)).alias("n"), F.corr("x", "y").alias("correlation"))


def conditional_probability(grid: DataFrame, steps: int = 1, ts: str = "slot_ts") -> DataFrame:
    """By sign of the return: how often the next one is positive, and its uplift over the base rate."""
    pairs = _steps(grid, ts, 0, steps, lambda w: {"next": F.lead("return", steps).over(w)}).filter("return is not null and next is not null")
    by = pairs.groupBy(F.signum("return").cast("int").alias("sign")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("next") > 0).alias("n_up"))
    base = pairs.agg(F.avg((F.col("next") > 0).cast("double")).alias("base_rate"))
    return by.join(F.broadcast(base)).withColumns({"p_up": F.col("n_up") / F.col("n"), "uplift": F.col("n_up") / F.col("n") - F.col("base_rate")})  # base is one row


def false_discovery(tests: DataFrame, p: str = "p_value", family: str = "family", pieces: int = 1024) -> DataFrame:
    """Benjamini-Hochberg adjusted values within each family, p between 0 and 1.

    Tests of equal p have equal values, so ranks and the minimum over greater p run over distinct p, counted before the
    shuffle and dealt by family and range of p.
    """
    piece = F.floor(F.col("_p") * pieces)
    by = tests.groupBy(F.col(family).alias("_family"), F.col(p).alias("_p")).agg(F.count(F.lit(1)).alias("_n"))
    total = by.groupBy(F.col("_family").alias("_f")).agg(F.sum("_n").alias("_all"))
    ranked = running(by, "_family", "_p", (), {"_rank": ("sum", "_n")}, piece).join(total, F.col("_family").eqNullSafe(F.col("_f"))).withColumns({"_down": -F.col("_p"), "_raw": -F.col("_p") * F.col("_all") / F.col("_rank")})
    least = running(ranked, "_family", "_down", (), {"_best": ("max", "_raw")}, -piece).select("_family", "_p", F.least(F.lit(1.0), -F.col("_best")).alias("q_value"))
    return tests.join(least, F.col(family).eqNullSafe(F.col("_family")) & F.col(p).eqNullSafe(F.col("_p"))).drop("_family", "_p")


def graduated(events: DataFrame, days: int = 60, n: int = 80, gross_bp: float = 10.0, cost_bp: float = 5.0) -> DataFrame:
    """Signals with enough days, events and gross return in basis points, and what is left after cost."""
    found = events.groupBy("signal").agg(F.countDistinct("day").alias("n_days"), F.count(F.lit(1)).alias("n_events"), F.avg("return_bp").alias("gross_bp"))
    return found.filter((F.col("n_days") >= days) & (F.col("n_events") >= n) & (F.col("gross_bp") >= gross_bp)).withColumn("net_bp", F.col("gross_bp") - cost_bp)
