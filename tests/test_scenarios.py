"""Small scenarios with known answers, and properties that hold for any bars."""

from datetime import date, datetime, timedelta

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.functions import schema as S
from tessera.operators import align, bars as B, coverage as C, curve as Y, merge as M, quality as Q, research as R, rolls, sessions as X, split as P

BAR = "bar_id bigint, ingest_seq bigint, symbol string, open_ts timestamp_ntz, close_ts timestamp_ntz, contract string, is_continuous boolean, open double, high double, low double, close double, volume double, vwap double, trade_count bigint, is_roll_affected boolean, is_partial boolean, trading_date date, session_type string, is_regular boolean"
D = datetime(2024, 1, 2)


def row(n, minute, o=1.0, h=None, lo=None, c=None, volume=1.0, contract=None, symbol="A", length=5, regular=True):
    c = o if c is None else c
    at = D + timedelta(minutes=minute)
    return (n, n, symbol, at, at + timedelta(minutes=length), contract, True, o, max(o, c) if h is None else h, min(o, c) if lo is None else lo, c, volume, c, 1, False, False, at.date(), "regular_session", regular)


def frame(spark, rows):
    return spark.createDataFrame(rows, BAR)


def test_minute_bars_with_holes(spark):
    minutes = [0, 1, 4, 5, 6, 7, 8, 9]
    rows = [row(i, m, o=float(i + 1), c=float(i + 1) + 0.5, volume=10.0 if m < 5 else 6.0, length=1) for i, m in enumerate(minutes)]
    first, second = B.resample(frame(spark, rows), 5, expected=5).orderBy("open_ts").collect()
    assert (first["is_partial"], first["volume"], first["open"], first["close"]) == (True, 30.0, 1.0, 3.5)
    assert (second["is_partial"], second["volume"]) == (False, 30.0)


def test_contracts_never_mix_and_unknown_volume_stays_unknown(spark):
    rows = [row(0, 0, contract="H6", volume=None), row(1, 1, contract="M6", o=5.0, volume=None)]
    out = B.resample(frame(spark, rows), 5, expected=1).collect()
    assert sorted(r["contract"] for r in out) == ["H6", "M6"]
    assert all(r["volume"] is None for r in out)


def test_invalid_ohlc_is_excluded_and_negative_price_stays(spark):
    clean, issues = Q.preinsert(frame(spark, [row(0, 0), row(1, 5, o=100.0, h=99.0), row(2, 10, o=-1.0, h=1.0, lo=-2.0, c=-0.5)]))
    assert sorted(r["bar_id"] for r in clean.collect()) == [0, 2]
    found = {(r["bar_id"], r["issue_type"], r["disposition"]) for r in issues.collect()}
    assert found == {(1, "invalid_ohlc", "excluded"), (2, "negative_price", "retained")}


def test_grid_keeps_gaps(spark):
    out = align.aligned(frame(spark, [row(0, 0, c=1.0), row(1, 10, c=2.0)])).orderBy("slot_ts").collect()
    assert [r["is_missing"] for r in out] == [False, True, False]
    assert [r["close"] for r in out] == [1.0, None, 2.0]
    assert out[2]["return"] is None


def test_empty_inputs_have_full_schemas(spark):
    none = frame(spark, [])
    assert align.aligned(none).count() == 0 and "return" in align.aligned(none).columns
    assert B.observed_bars(none).count() == 0
    assert Q.evaluate(none).count() == 0
    assert B.preflight(none).first()["valid"] is False


def test_incomplete_quarter_hour(spark):
    (r,) = B.observed_bars(frame(spark, [row(0, 0), row(1, 10)])).collect()
    assert (r["n_observed"], r["is_complete"], r["return"]) == (2, False, None)


def test_roll(spark):
    (r,) = rolls.rolls(frame(spark, [row(0, 0, contract="H6"), row(1, 5, contract="H6"), row(2, 10, contract="M6")])).collect()
    assert (r["outgoing_contract"], r["incoming_contract"], r["adjustment"], r["roll_ts"]) == ("H6", "M6", "unadjusted", D + timedelta(minutes=10))


def test_overnight_session_and_lunch_break(spark):
    at = lambda ts: spark.createDataFrame([(ts,)], "open_ts timestamp_ntz")
    cme = X.sessions(spark, "CME_EQUITY", date(2026, 7, 6), date(2026, 7, 20))
    r = X.classify(at(datetime(2026, 7, 12, 22)), cme, "CME_EQUITY").first()
    assert (r["trading_date"], r["is_regular"], r["minutes_since_open"]) == (date(2026, 7, 13), True, 0)
    hk = X.sessions(spark, "XHKG", date(2026, 7, 6), date(2026, 7, 20))
    r = X.classify(at(datetime(2026, 7, 13, 4, 30)), hk, "XHKG").first()
    assert (r["session_type"], r["is_regular"], r["is_extended"]) == ("scheduled_break_observation", False, False)


def test_round_the_clock_sessions(spark):
    assert X.sessions(spark, "24/7", date(2024, 1, 1), date(2024, 1, 2)).count() == 2


def test_shortened_session(spark):
    out = {r["trading_date"]: r["is_shortened"] for r in X.sessions(spark, "XNYS", date(2024, 11, 18), date(2024, 12, 6)).collect()}
    assert date(2024, 11, 28) not in out and out[date(2024, 11, 29)] and not out[date(2024, 11, 27)]


def test_lunch_break_coverage_and_missing_edge(spark):
    found = X.sessions(spark, "XHKG", date(2024, 1, 2), date(2024, 1, 2))
    slots = [r["slot_ts"] for r in X.expected_slots(found, datetime(2024, 1, 2), datetime(2024, 1, 3)).orderBy("slot_ts").collect()]
    assert len(slots) == 66
    expected = X.expected_slots(found, datetime(2024, 1, 2), datetime(2024, 1, 3)).drop("calendar")
    whole = frame(spark, [row(i, int((s - D).total_seconds() // 60)) for i, s in enumerate(slots)])
    assert C.coverage(whole, expected).first()["coverage_percentage"] == 100.0
    assert C.missing_slots(whole, expected).count() == 0
    part = C.missing_slots(whole.filter("bar_id > 0"), expected).first()
    assert (part["n_missing"], part["first_missing"]) == (1, slots[0])
    absent = C.coverage(whole, expected, spark.createDataFrame([("A",), ("B",)], "symbol string")).filter("symbol = 'B'").first()
    assert (absent["n_observed"], absent["missing_expected"]) == (0, 66)


@pytest.mark.parametrize(("day", "hour"), [(date(2025, 7, 1), 13), (date(2025, 1, 7), 14)])
def test_decision_times_follow_london_clocks(spark, day, hour):
    start = datetime(day.year, day.month, day.day, 14, 30)
    bars = spark.createDataFrame([("A", start, start + timedelta(minutes=5), day, True)], "symbol string, open_ts timestamp_ntz, close_ts timestamp_ntz, trading_date date, is_regular boolean")
    r = X.decision_times(bars).filter("local_hour = 14").first()
    assert r["decision_ts"].hour == hour and r["is_before_open"]


def test_curve_spread_and_first_direction(spark):
    y = spark.createDataFrame([(D, "US2Y", 3.5, D.date(), D.date()), (D, "US10Y", 4.0, D.date(), D.date())], "available_ts timestamp_ntz, symbol string, value double, observation_date date, vintage_date date")
    r = Y.curve(y).first()
    assert (r["us_2s10s"], r["us_2s10s_change"], r["us_2s10s_direction"]) == (50.0, None, "unchanged")


def test_splits():
    start = datetime(2024, 1, 1)
    s = P.split(start, start + timedelta(days=90))
    assert (s.cutoff - s.start).days == 60
    assert (P.split(start, start + timedelta(days=60)).end - P.split(start, start + timedelta(days=60)).cutoff).days >= 12
    with pytest.raises(ValueError):
        P.split(start, start + timedelta(days=1), cutoff=start)


def test_merge_policies_and_null_keys(spark):
    schema = "k string, a int, b int, c int"
    base = spark.createDataFrame([(None, 1, 5, 1), ("x", 1, 5, 1)], schema)
    new = spark.createDataFrame([(None, 2, 9, 2), ("y", 2, 9, 2)], schema)
    out = {r["k"]: (r["a"], r["b"], r["c"]) for r in M.merge(base, new, ["k"], {"b": M.LEAST, "c": M.KEEP}).collect()}
    assert out == {None: (2, 5, 1), "x": (1, 5, 1), "y": (2, 9, 2)}
    again = M.merge(M.merge(base, new, ["k"]), new, ["k"])
    assert sorted(map(str, again.collect())) == sorted(map(str, M.merge(base, new, ["k"]).collect()))


def test_conform_reads_what_it_can(spark):
    out = S.conform(spark.createDataFrame([("A", "1.5", float("nan"), "x")], "symbol string, open string, close double, other string"), S.BARS).first()
    assert (out["symbol"], out["open"], out["close"]) == ("A", 1.5, None) and "other" not in out.asDict()
    with pytest.raises(ValueError):
        S.require(spark.range(1), ["id", "open"])
    with pytest.raises(ValueError):
        S.select_instruments(spark.createDataFrame([("A", "p")], "symbol string, provider string"), ["B"])


def test_a_null_close_begins_a_new_run(spark):
    rows = [row(i, 5 * i, c=1.0) for i in range(5)]
    rows[2] = row(2, 10)[:10] + (None,) + row(2, 10)[11:]
    stale = Q.evaluate(frame(spark, rows), Q.Settings(stale_run=2)).filter("issue_type = 'stale_repeated_price'")
    assert sorted(r["bar_id"] for r in stale.collect()) == [0, 1, 3, 4]
    assert Q.evaluate(frame(spark, rows), Q.Settings(stale_run=3)).filter("issue_type = 'stale_repeated_price'").count() == 0


def test_benjamini_hochberg(spark):
    x = spark.createDataFrame([(1, "f", 0.01), (2, "f", 0.04), (3, "f", 0.03)], "test_id int, family string, p_value double")
    out = {r["test_id"]: round(r["q_value"], 6) for r in R.false_discovery(x).collect()}
    assert out == {1: 0.03, 2: 0.04, 3: 0.04}


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.sampled_from("AB"), st.integers(0, 40), st.floats(-5, 5, allow_nan=False)), min_size=1, max_size=25))
def test_properties_of_grid_and_checks(spark, points):
    rows = [row(i, 5 * m, o=1.0, c=c, symbol=s) for i, (s, m, c) in enumerate(points)]
    df = frame(spark, rows)
    minutes = [m for _, m, _ in points]
    out = align.aligned(df).collect()
    assert len(out) == (max(minutes) - min(minutes) + 1) * len({s for s, _, _ in points})
    at = {(r["symbol"], r["slot_ts"]): r for r in out}
    for r in out:
        before = at.get((r["symbol"], r["slot_ts"] - timedelta(minutes=5)))
        if r["return"] is not None:
            assert before is not None and before["is_observed"] and r["is_observed"]
    clean, issues = Q.preinsert(df)
    kept = {r["bar_id"] for r in clean.collect()}
    named = {r["bar_id"] for r in issues.filter("disposition <> 'retained'").collect()}
    assert kept | named == set(range(len(points)))


def test_stream_is_idempotent(spark, sf_dir):
    from tessera.streaming import bars as live

    a, b = live.replay(spark, sf_dir), live.replay(spark, sf_dir)
    assert a.count() > 0 and a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_a_batch_that_comes_again_changes_nothing(spark, tmp_path):
    from tessera.sources import tables
    from tessera.streaming.bars import MergedTable

    one = spark.createDataFrame([("A", D, 1), ("A", D + timedelta(days=1), 5)], "symbol string, open_ts timestamp_ntz, n int")
    MergedTable(spark, str(tmp_path)).merge(one, 0)
    MergedTable(spark, str(tmp_path)).merge(one.withColumn("n", F.lit(9)), 0)  # by another process
    table = MergedTable(spark, str(tmp_path))
    assert sorted(r["n"] for r in table.read().collect()) == [1, 5]
    kept = tables.names(spark, str(tmp_path), "data", f"p_day={D.date() + timedelta(days=1)}")
    table.merge(one.filter("n = 1").withColumn("n", F.lit(2)), 1)
    assert sorted(r["n"] for r in table.read().collect()) == [2, 5]
    assert tables.names(spark, str(tmp_path), "data", f"p_day={D.date() + timedelta(days=1)}") == kept  # an untouched day isn't rewritten
    one.filter("n = 1").withColumns({"n": F.lit(3), "p_day": F.to_date("open_ts").cast("string")}).write.parquet(f"{tmp_path}/staged/batch-2")  # a process that ended before it published
    assert sorted(r["n"] for r in MergedTable(spark, str(tmp_path)).read().collect()) == [3, 5]


def test_a_stream_goes_on_after_a_restart(spark, sf_dir, tmp_path):
    import shutil

    from tessera.streaming import bars as live

    (tmp_path / "in").mkdir()
    shutil.copy(f"{sf_dir}/events.parquet", tmp_path / "in" / "events.parquet")
    first = live.run(spark, str(tmp_path / "in"), str(tmp_path / "out")).read().count()
    assert first == live.run(spark, str(tmp_path / "in"), str(tmp_path / "out")).read().count() == live.replay(spark, sf_dir).count()


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.sampled_from(["A", "B", None]), st.one_of(st.none(), st.integers(0, 5000)), st.one_of(st.none(), st.integers(0, 3))), max_size=25))
def test_lags_and_sums_across_days(spark, points):
    from pyspark.sql import Window

    from tessera.functions.windows import lagged, running, running_sums

    rows = [(i, s, None if m is None else D + timedelta(minutes=m), v) for i, (s, m, v) in enumerate(points)]
    df = spark.createDataFrame(rows, "n int, symbol string, ts timestamp_ntz, v int")
    w = Window.partitionBy("symbol").orderBy(F.col("ts").asc_nulls_last(), "n")
    plain = df.select("n", F.lag("v").over(w).alias("before"), F.coalesce(F.sum("v").over(w.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0)).alias("total"))
    filled = df.select("n", F.last("v", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("f"), F.max("v").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("m"))
    again = running(df, "symbol", "ts", ("n",), {"f": ("last", "v"), "m": ("max", "v")}).select("n", "f", "m")
    assert sorted(map(tuple, again.collect()), key=str) == sorted(map(tuple, filled.collect()), key=str)
    ours = running_sums(lagged(df, "symbol", "ts", ("n",), {"before": "v"}), "symbol", "ts", ("n",), {"total": "v"}).select("n", "before", "total")
    assert sorted(map(tuple, ours.collect())) == sorted(map(tuple, plain.collect()))


def test_runs_across_days_against_a_plain_loop(spark):
    """Runs inside a day, over a midnight, over whole days, broken by nulls; each key by itself."""
    import random

    from tessera.functions.windows import lags_and_runs

    rng, rows, n = random.Random(8), [], 0
    for key in ("a", "b", None):
        value, at = 1.0, datetime(2024, 1, 1)
        for _ in range(250):
            at += timedelta(hours=rng.choice([0, 1, 5, 30]))
            value = rng.choice([value] * 12 + [None, 1.0, 2.0])
            value = 1.0 if value is None and rng.random() < 0.5 else value
            rows.append((key, at if rng.random() > 0.01 else None, n, value))
            n += 1
    want = {}
    for key in ("a", "b", None):
        own = sorted((r for r in rows if r[0] == key), key=lambda r: (r[1] is None, r[1] or datetime.min, r[2]))
        start = 0
        for k in range(1, len(own) + 1):
            if k == len(own) or own[k][3] is None or own[k][3] != own[k - 1][3]:
                want |= {own[j][2]: (own[j - 1][3] if j else None, k - start) for j in range(start, k)}
                start = k
    df = spark.createDataFrame(rows, "key string, ts timestamp_ntz, n int, v double").repartition(3)
    got = lags_and_runs(df, "key", "ts", ("n",), {"before": "v"}, {"length": "v"})
    assert got.columns == ["key", "ts", "n", "v", "before", "length"]
    assert {r["n"]: (r["before"], r["length"]) for r in got.collect()} == want
    assert max(length for _, length in want.values()) > 12
