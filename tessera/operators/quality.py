"""Quality rules over bars and yields.

All flags of a table come from one projection over shared lags and run lengths; issues fan out from it by exploding an
array of the rules that fire, so no rule scans the table again.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import timeops as t
from ..functions.windows import lagged, lags_and_runs
from .dedupe import flag_duplicates, keep_last

PRICES = ("open", "high", "low", "close")


@dataclass(frozen=True)
class Settings:
    extreme_return: float = 0.10
    stale_run: int = 12
    zero_volume_run: int = 24
    flag_weekends: bool = True


@dataclass(frozen=True)
class Rule:
    issue: str
    severity: str
    disposition: str
    when: Column
    observed: Column
    expected: str


def _json(*columns: str) -> Column:
    return F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})


def _malformed() -> Column:
    return F.col("open_ts").isNull() | F.col("close_ts").isNull() | F.col("open").isNull() | F.col("high").isNull() | F.col("low").isNull() | F.col("close").isNull()


def _structure() -> dict[str, Column]:
    sound = ~_malformed()
    top, bottom = F.greatest("open", "close", "low"), F.least("open", "close", "high")
    return {
        "malformed": _malformed(),
        "invalid": sound & ((F.col("high") < top) | (F.col("low") > bottom)),
        "negative": sound & (F.least(*PRICES) < 0),
        "zero": sound & ((F.col("open") == 0) | (F.col("high") == 0) | (F.col("low") == 0) | (F.col("close") == 0)),
        "negative_volume": F.coalesce(F.col("volume") < 0, F.lit(False)),
        "length": sound & (t.micros(F.col("close_ts")) - t.micros(F.col("open_ts")) != 5 * t.MINUTE),
        "boundary": F.coalesce(~t.on_boundary(F.col("open_ts"), 5), F.lit(False)),
    }


def issues(df: DataFrame, rules: list[Rule], key: list[str], ts: str) -> DataFrame:
    fired = F.array_compact(F.array(*[F.when(F.coalesce(r.when, F.lit(False)), F.struct(F.lit(r.issue).alias("issue_type"), F.lit(r.severity).alias("severity"), F.lit(r.disposition).alias("disposition"), r.observed.alias("observed_value"), F.lit(r.expected).alias("expected"))) for r in rules]))
    return df.select(*key, F.col(ts).alias("issue_ts"), F.explode(fired).alias("_i")).select(*key, "issue_ts", "_i.*")


def preinsert(df: DataFrame, seq: str = "ingest_seq") -> tuple[DataFrame, DataFrame]:
    """(clean, issues) of a provider's batch. Only structurally unusable rows go; the last of equal identities stays.

    Values that couldn't be read as numbers arrive as nulls and are reported as malformed.
    """
    identity = ["symbol", "open_ts", "contract", "is_continuous"]
    flagged = flag_duplicates(df, identity).withColumns({f"_{k}": c for k, c in _structure().items()})
    prices = _json(*PRICES)
    rules = [
        Rule("missing_or_malformed_required_field", "error", "excluded", F.col("_malformed"), _json("open_ts", "close_ts", *PRICES), "all required fields present"),
        Rule("invalid_ohlc", "error", "excluded", F.col("_invalid"), prices, "high and low enclose open and close"),
        Rule("negative_price", "warning", "retained", F.col("_negative"), prices, "negative prices verified for this contract"),
        Rule("negative_volume", "error", "excluded", F.col("_negative_volume"), F.col("volume").cast("string"), "volume >= 0"),
        Rule("unexpected_interval_length", "error", "excluded", F.col("_length"), _json("open_ts", "close_ts"), "exactly five minutes"),
        Rule("inconsistent_bar_boundary", "error", "excluded", ~F.col("_malformed") & F.col("_boundary"), F.col("open_ts").cast("string"), "open time on a five-minute boundary"),
        Rule("duplicated_provider_page_or_bar", "error", "deduplicated", F.col("is_duplicate"), _json("open_ts", "contract", "is_continuous"), "unique identity within a batch"),
    ]
    reject = F.col("_malformed") | F.col("_invalid") | F.col("_negative_volume") | F.col("_length") | F.col("_boundary")
    clean = keep_last(flagged.filter(~reject).withColumn("quality_status", F.when(F.col("_negative"), "warning").otherwise("preinsert_pass")).select(*[c for c in df.columns if c != "quality_status"], "quality_status"), identity, [seq])
    return clean, issues(flagged, rules, ["bar_id", "symbol"], "open_ts")


def reversed_batches(df: DataFrame, batch: str = "symbol", seq: str = "ingest_seq") -> DataFrame:
    """Batches of more than one row whose known times never rise in order of arrival; at least one time must be known.

    Rows are dealt by batch and stretches of 131072 sequence numbers, so a batch of any size is many tasks.
    """
    known = lagged(df.filter(F.col("open_ts").isNotNull()), batch, seq, (), {"_was": "open_ts"}, F.shiftright(F.col(seq).cast("long"), 17))
    falling = known.groupBy(batch).agg(F.bool_or(F.coalesce(F.col("open_ts") > F.col("_was"), F.lit(False))).alias("_any"), F.min_by("open_ts", seq).alias("issue_ts"))
    many = df.groupBy(batch).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    return falling.filter(~F.col("_any")).join(many.select(batch), batch).select(batch, "issue_ts", F.lit("provider_rows_reverse_order").alias("issue_type"), F.lit("warning").alias("severity"))


def flagged_bars(bars: DataFrame, settings: Settings = Settings(), only: tuple[str, ...] | None = None) -> DataFrame:
    """bars with a boolean column for each rule. Run lengths and returns follow time within a symbol, contracts interleaved.

    With ``only``, lags, runs and duplicates are worked out just where those rules need them; the other flags are false.
    """
    ties = ("contract", "bar_id")
    need = lambda *rules: only is None or bool(set(rules) & set(only))
    false = F.lit(False)
    roll = F.coalesce("is_roll_affected", false)
    flags = _structure() | {
        "roll": roll,
        "weekend": F.coalesce(F.weekday("open_ts") >= 5, false) & F.lit(settings.flag_weekends),
        "on_break": F.coalesce(F.col("session_type") == "scheduled_break_observation", false),
        "outside": F.coalesce(F.col("session_type") == "outside_scheduled_market", false),
        "partial": F.coalesce("is_partial", false),
        **dict.fromkeys(("extreme", "roll_jump", "stale", "zero_run", "duplicate"), false),
    }
    step = bars.withColumn("_zero", F.coalesce(F.col("volume") == 0, false))
    runs = {n: c for n, c, rule in (("_price_length", "close", "stale"), ("_zero_length", "_zero", "zero_run")) if need(rule)}
    if runs or need("extreme", "roll_jump"):
        step = lags_and_runs(step, "symbol", "open_ts", ties, {"_before": "close"}, runs)
        before = F.col("_before")
        move = F.when(before != 0, F.abs(F.try_divide("close", before) - 1)).when(F.col("close") != 0, F.lit(float("inf")))
        extreme = F.coalesce(move > settings.extreme_return, false)
        flags |= {"extreme": extreme & ~roll, "roll_jump": extreme & roll}
    if need("stale"):
        flags["stale"] = (F.col("_price_length") >= settings.stale_run) & F.col("close").isNotNull()
    if need("zero_run"):
        flags["zero_run"] = F.col("_zero") & (F.col("_zero_length") >= settings.zero_volume_run)
    if need("duplicate"):
        step = flag_duplicates(step, ["symbol", "open_ts", "contract", "is_continuous"], "duplicate")
        del flags["duplicate"]
    return step.withColumns(flags).drop("_before", "_zero", "_price_length", "_zero_length")


def evaluate(bars: DataFrame, settings: Settings = Settings(), zone: str | Column | None = None, always_open: bool | Column = False, only: tuple[str, ...] | None = None) -> DataFrame:
    """The issues of bars, one row each; with ``only``, of those types. Zone and whether the market never closes hold for all bars, or are columns."""
    prices = _json(*PRICES)
    mismatch = F.lit(False) if zone is None else F.to_date(t.local_time(F.col("open_ts"), zone)) != F.col("trading_date")
    never = always_open if isinstance(always_open, Column) else F.lit(always_open)
    rule = lambda issue, severity, when, observed, expected: Rule(issue, severity, "retained", when if isinstance(when, Column) else F.col(when), observed, expected)
    rules = [
        rule("missing_or_malformed_required_field", "error", "malformed", prices, "all required fields present"),
        rule("duplicate_identity", "error", "duplicate", _json("open_ts", "contract", "is_continuous"), "unique bar identity"),
        rule("invalid_ohlc", "error", "invalid", prices, "high and low enclose open and close"),
        rule("zero_price", "error", "zero", prices, "prices other than zero"),
        rule("negative_price", "warning", "negative", prices, "negative prices verified for this contract"),
        rule("negative_volume", "error", "negative_volume", F.col("volume").cast("string"), "volume >= 0"),
        rule("unexpected_interval_length", "error", "length", _json("open_ts", "close_ts"), "exactly five minutes"),
        rule("inconsistent_bar_boundary", "error", "boundary", F.col("open_ts").cast("string"), "open time on a five-minute boundary"),
        rule("extreme_return", "warning", "extreme", F.col("close").cast("string"), f"absolute return <= {settings.extreme_return}"),
        rule("contract_roll_jump", "warning", "roll_jump", F.col("close").cast("string"), "jump explained by a roll"),
        rule("unexpected_weekend_observation", "warning", F.col("weekend") & ~never, F.date_format("open_ts", "EEEE"), "no weekend trading"),
        rule("timezone_or_trading_date_mismatch", "warning", mismatch, F.col("trading_date").cast("string"), "local date equals trading date"),
        rule("timestamp_inside_scheduled_break", "error", "on_break", F.col("session_type"), "no bars in a break"),
        rule("timestamp_outside_expected_session", "warning", "outside", F.col("session_type"), "bars within sessions"),
        rule("partial_bar", "warning", "partial", F.lit("true"), "complete bars"),
        rule("stale_repeated_price", "warning", "stale", F.col("close").cast("string"), f"fewer than {settings.stale_run} equal closes"),
        rule("excessive_zero_volume_run", "warning", "zero_run", F.lit("0"), f"fewer than {settings.zero_volume_run} bars without volume"),
        rule("contract_roll_boundary", "info", "roll", F.col("contract"), "roll boundary noted"),
    ]
    needed = None
    if only is not None:
        rules = [r for r in rules if r.issue in only]
        needed = tuple(flag for flag, issue in _FLAG_OF.items() if issue in only)
    return issues(flagged_bars(bars, settings, needed), rules, ["bar_id", "symbol"], "open_ts")


#: Flags that take more than the row itself, and the issues they make.
_FLAG_OF = {"extreme": "extreme_return", "roll_jump": "contract_roll_jump", "stale": "stale_repeated_price", "zero_run": "excessive_zero_volume_run", "duplicate": "duplicate_identity"}


def invalid_zones(instruments: DataFrame, zone: str = "exchange_timezone") -> DataFrame:
    """Instruments whose time zone no time-zone database knows; zones are told on the driver, one by one, from the catalogue's few distinct ones."""
    from zoneinfo import available_timezones

    return instruments.filter(F.col(zone).isNotNull() & ~F.col(zone).isin(sorted(available_timezones())))


def evaluate_yields(yields: DataFrame) -> DataFrame:
    """The issues of yield observations."""
    identity = ["symbol", "observation_date", "maturity", "vintage_date"]
    f = flag_duplicates(yields, identity)
    seen = _json("available_ts", "published_ts", "value")
    rules = [
        Rule("malformed_yield_observation", "error", "retained", F.col("available_ts").isNull() | F.col("published_ts").isNull() | F.col("value").isNull(), seen, "times known and value a number"),
        Rule("future_information_timestamp", "error", "retained", F.col("available_ts") < F.col("published_ts"), seen, "not available before publication"),
        Rule("duplicate_yield_vintage", "error", "retained", F.col("is_duplicate"), _json(*identity), "unique vintage"),
        Rule("revised_yield_observation", "info", "retained", F.col("is_revised"), seen, "revision noted"),
    ]
    return issues(f, rules, ["obs_id", "symbol"], "available_ts")


def severity_counts(found: DataFrame) -> DataFrame:
    return found.groupBy("severity").agg(F.count(F.lit(1)).alias("n"))
