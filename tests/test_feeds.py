"""Providers over HTTP, streams with keyed state, series and frames that are discovered, instruments of many calendars, evaluation of signals."""

import json
import os
import random
import threading
import time
import uuid
import zipfile
from datetime import date, datetime, timedelta
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, urlparse

import pytest
from pyspark.sql import functions as F

from tessera.functions.text import last_json_object
from tessera.operators import align, markets, study
from tessera.sources import formats, providers, tables
from tessera.streaming import changes

BAR = "symbol string, open_ts timestamp_ntz, close double, contract string, ingest_seq long"


@pytest.fixture
def service():
    """Five-minute bars at noon of every day of January 2024 and a yield each day, with the requests it got."""
    asked = []

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):  # noqa: N802
            u = urlparse(self.path)
            q = {k: v[0] for k, v in parse_qs(u.query).items()}
            asked.append((u.path, q))
            days = [datetime(2024, 1, d, 12) for d in range(1, 32)]
            if u.path.startswith("/bars"):
                a, b = (datetime.fromisoformat(q[k]) for k in ("start", "end"))
                found = [{"t": d.isoformat() + "Z", "o": 1, "h": 99, "l": 1, "c": d.day, "v": 5, "n": 1, "vw": 1} for d in days if a <= d < b]
                half, second = len(found) // 2, q.get("page_token")
                body = {"bars": found[half:] if second else found[:half], "next_page_token": None if second or not found else "2"}
            elif u.path.startswith("/candles"):
                a, b = (datetime.fromisoformat(q[k]) for k in ("start", "end"))
                body = [[int((d - datetime(1970, 1, 1)).total_seconds()), 1, 2, 1, d.day, 5] for d in days if a <= d <= b] * 2 + [[1, 2]]
            else:
                body = {"observations": [{"date": f"2024-01-{d:02}", "realtime_start": "2024-02-01", "value": "." if d == 3 else str(d)} for d in range(1, 32)]}
            self.send_response(404 if "missing" in u.path else 200)
            self.end_headers()
            self.wfile.write(json.dumps(body).encode())

        def log_message(self, *_):
            pass

    server = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}", asked
    server.shutdown()


JAN = datetime(2024, 1, 1), datetime(2024, 2, 1)


def test_filters_cut_down_what_is_asked_for(spark, service):
    url, asked = service
    df = providers.load(spark, "paged_bars", f"{url}/bars", ["A", "B"], *JAN, chunkDays="10")
    assert df.count() == 62 and len(asked) == 2 * 4 * 2  # two symbols, four spans, two pages
    asked.clear()
    few = df.filter((F.col("symbol") == "B") & (F.col("open_ts") >= F.lit("2024-01-10").cast("timestamp_ntz")) & (F.col("open_ts") < F.lit("2024-01-12").cast("timestamp_ntz")))
    assert [r["close"] for r in few.orderBy("open_ts").collect()] == [10.0, 11.0]
    assert {q["symbol"] for _, q in asked} == {"B"} and min(q["start"] for _, q in asked) == "2024-01-10T00:00:00" and max(q["end"] for _, q in asked) == "2024-01-12T00:00:00"


def test_providers_and_preflight(spark, service):
    url, asked = service
    assert providers.load(spark, "candles", f"{url}/candles", ["X"], *JAN).count() == 31 and len(asked) == 31  # a day a request
    found = providers.load(spark, "observations", f"{url}/fred", ["Y"], *JAN).collect()
    assert len(found) == 30 and {r["vintage_date"] for r in found} == {date(2024, 2, 1)}
    with pytest.raises(ValueError, match="no provider"):
        providers.load(spark, "nobody", url, ["X"], *JAN)
    good = providers.preflight(spark, "paged_bars", f"{url}/bars", "A", *JAN)
    assert good == {"ok": True, "provider": "paged_bars", "symbol": "A", "rows": 31, "error": None}
    assert providers.preflight(spark, "observations", f"{url}/fred", "Y", *JAN)["ok"]
    none = providers.preflight(spark, "paged_bars", f"{url}/bars", "A", datetime(2025, 1, 1), datetime(2025, 1, 2))
    assert not none["ok"] and none["error"] == "no usable rows"
    assert "404" in providers.preflight(spark, "paged_bars", f"{url}/missing", "A", *JAN)["error"]


def test_a_stream_of_a_provider_goes_on_with_an_overlap(spark, service, tmp_path):
    url, asked = service
    spark.dataSource.register(providers.MarketApi)

    def run(end):
        asked.clear()
        stream = spark.readStream.format("market_api").options(provider="paged_bars", url=f"{url}/bars", symbols="A", start="2024-01-01", end=end, overlapMinutes="1440").load()
        merge = lambda b, n: tables.merge_into(spark, f"{tmp_path}/t", b, ["symbol", "open_ts"], {"p_day": F.to_date("open_ts").cast("string")}, f"b{n}")
        q = stream.writeStream.foreachBatch(merge).option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
        q.awaitTermination()
        return tables.read(spark, f"{tmp_path}/t").count(), min(q["start"] for _, q in asked) if asked else None

    assert run("2024-01-11T00:00:00") == (10, "2024-01-01T00:00:00")
    assert run("2024-01-16T00:00:00") == (15, "2024-01-10T00:00:00")


def test_collection_from_a_provider(spark, service, tmp_path):
    from tessera.plans import collect

    url, _ = service
    runs = collect.collect(spark, ["A"], *JAN, providers.fetcher(spark, "paged_bars", f"{url}/bars"), str(tmp_path), job="backfill")
    assert [(r["status"], r["inserted"]) for r in runs] == [("succeeded", 31)]


# --- keyed state ------------------------------------------------------------------------------------------------------


def _lots(spark, path, lots):
    for k, rows in enumerate(lots):
        spark.createDataFrame(rows, BAR).repartition(2).write.parquet(f"{path}/{k}")
        time.sleep(0.02)


def _row(symbol, minute, close, contract="H", seq=0, day=1):
    return symbol, datetime(2024, 1, day) + timedelta(minutes=minute), close, contract, seq


def test_returns_and_rolls_across_batches_and_a_restart(spark, tmp_path):
    root, path = f"{tmp_path}/root", f"{tmp_path}/in"
    _lots(spark, path, [[_row("A", 0, 10.0), _row("A", 5, 11.0), _row("B", 0, 5.0)]])
    changes.run(spark, path, root)
    more = [_row("A", 10, 22.0, "M"), _row("B", 10, 6.0), _row("A", 15, None, "M"), _row("A", 20, 1.0, "M"), _row("A", 10, 33.0, "M", 1), _row("A", 5, 99.0)]
    spark.createDataFrame(more, BAR).write.parquet(f"{path}/next")
    got = {(r["symbol"], r["open_ts"].minute): (r["close"], r["return"], r["is_roll"], r["outgoing_contract"]) for r in changes.run(spark, path, root).read().collect()}
    assert got == {
        ("A", 0): (10.0, None, False, None),
        ("A", 5): (11.0, 11.0 / 10.0 - 1, False, None),  # the one that came too late changes nothing
        ("A", 10): (33.0, 2.0, True, "H"),  # the later of two of one moment; both values come from the batch before
        ("A", 15): (None, None, False, None),
        ("A", 20): (1.0, None, False, None),
        ("B", 0): (5.0, None, False, None),
        ("B", 10): (6.0, None, False, None),  # a gap
    }


def test_a_silent_symbol_is_forgotten(spark, tmp_path):
    root, path = f"{tmp_path}/root", f"{tmp_path}/in"
    lots = [[_row("A", 0, 10.0)], [_row("B", 0, 1.0, day=9)], [_row("B", 0, 1.0, day=10)], [_row("A", 0, 12.0, "M", day=11), _row("B", 0, 1.0, "M", day=11)]]
    for k, rows in enumerate(lots):
        spark.createDataFrame(rows, BAR).write.parquet(f"{path}/{k}")
        table = changes.run(spark, path, root, idle_days=3)
    assert {(r["symbol"], r["is_roll"]) for r in table.read().filter("contract = 'M'").collect()} == {("A", False), ("B", True)}


def test_the_state_meets_a_row_a_part_and_runs_once_a_batch(spark, tmp_path, monkeypatch):
    """However many bars a symbol has, its state takes one row of each part; bars are compared across days, batches and nulls all the same."""
    seen = str(tmp_path / "seen")
    os.makedirs(seen)

    class Counting(changes.LastBar):
        def handleInputRows(self, key, rows, timerValues):
            rows = list(rows)
            open(f"{seen}/{key[0]}-{uuid.uuid4().hex}", "w").write(str(len(rows)))
            yield from changes.LastBar.handleInputRows(self, key, iter(rows), timerValues)

    monkeypatch.setattr(changes, "LastBar", Counting)
    rng, lots, want = random.Random(4), [[], []], {}
    for symbol in ("A", None):
        before = None
        for k in range(800):
            if rng.random() < 0.1:
                continue
            row = _row(symbol, 5 * k, rng.choice([None, 0.0, 1.0, 2.0, 4.0]), rng.choice(["H"] * 20 + ["M", "", None]), k)
            lots[k >= 500].append(row)
            gain = row[2] / before[2] - 1 if before and row[2] is not None and before[2] and row[1] - before[1] == timedelta(minutes=5) else None
            roll = bool(before and row[3] and row[3] != (before[3] or ""))
            want[symbol, row[1]] = (row[2], row[3], gain, roll, before[3] if roll else None)
            before = row
    for k, lot in enumerate(lots):
        rng.shuffle(lot)
        spark.createDataFrame(lot, BAR).repartition(2).write.parquet(f"{tmp_path}/in/{k}")
        found = changes.run(spark, f"{tmp_path}/in", f"{tmp_path}/root").read()
    assert {(r["symbol"], r["open_ts"]): (r["close"], r["contract"], r["return"], r["is_roll"], r["outgoing_contract"]) for r in found.collect()} == want
    counts = {symbol: [int(open(f"{seen}/{f}").read()) for f in os.listdir(seen) if f.startswith(symbol)] for symbol in ("A", "None")}
    assert all(len(c) == 2 and max(c) <= 2 for c in counts.values()), counts


def test_a_table_of_many_days_is_listed_by_few_tasks(spark, tmp_path):
    days = [_row("A", 0, 1.0)[:1] + (datetime(2024, 1, 1) + timedelta(days=d), float(d)) for d in range(70)]
    by = {"p_day": F.to_date("open_ts").cast("string")}
    tables.merge_into(spark, f"{tmp_path}/t", spark.createDataFrame(days, "symbol string, open_ts timestamp_ntz, close double"), ["symbol", "open_ts"], by)
    spark.sparkContext.setJobGroup("listing", "")
    try:
        assert tables.read(spark, f"{tmp_path}/t").schema["p_day"].dataType.simpleString() == "string"
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    tracker = spark.sparkContext.statusTracker()
    tasks = [tracker.getStageInfo(stage).numTasks for job in tracker.getJobIdsForGroup("listing") for stage in tracker.getJobInfo(job).stageIds]
    assert tasks and max(tasks) <= 32, tasks


def test_a_merge_into_more_days_than_are_named(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(tables, "NAMED", 2)
    by = {"p_day": F.to_date("open_ts").cast("string")}
    rows = lambda days, v: spark.createDataFrame([("A", datetime(2024, 1, d), v) for d in days], "symbol string, open_ts timestamp_ntz, close double")
    tables.merge_into(spark, f"{tmp_path}/t", rows(range(1, 9), 1.0), ["symbol", "open_ts"], by)
    assert tables.touched(spark, f"{tmp_path}/t", rows((3, 5, 6, 20), 2.0), by).count() == 3
    tables.merge_into(spark, f"{tmp_path}/t", rows((3, 5, 6, 20), 2.0), ["symbol", "open_ts"], by)
    assert {r["open_ts"].day: r["close"] for r in tables.read(spark, f"{tmp_path}/t").collect()} == {d: 2.0 if d in (3, 5, 6, 20) else 1.0 for d in (*range(1, 9), 20)}


# --- discovered layouts -----------------------------------------------------------------------------------------------


def test_series_layouts_are_found_once_a_file(spark, tmp_path):
    (tmp_path / "a.csv").write_text('note;OBS_VALUE;TIME_PERIOD\n"x;y";1.5;2024-01-02\nz;.;2024-01-03\n')
    (tmp_path / "b.csv").write_text("Date\tValue\n2024-01-02\t2\n")
    assert sorted((r["observation_date"], r["value"]) for r in formats.read_series(spark, str(tmp_path)).collect()) == [(date(2024, 1, 2), 1.5), (date(2024, 1, 2), 2.0)]
    (tmp_path / "c.csv").write_text("day,amount\n2024-01-02,2\n")
    with pytest.raises(Exception, match="no date and value columns"):
        formats.read_series(spark, str(tmp_path)).collect()


def test_the_best_frame_of_an_archive(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "x.zip", "w") as z:
        z.writestr("nominal readme.csv", "a,b,c\n1,2,3\n")  # a decoy by name
        z.writestr("real spot.csv", "date,2,5,10\n2024-01-02,9,9,9\n")
        z.writestr("GB nominal spot.csv", "date;10 years;2 years;5 years\n2024-01-02;3;1;2\n")  # swapped columns, another separator
        z.writestr("broken.csv", b"\xff\xfe\x00")
        z.writestr("few.csv", "date,2\n2024-01-02,8\n")
    out = formats.zipped_curves(spark, str(tmp_path), {"Y2": 2.0, "Y10": 10.0}).collect()
    assert sorted((r["symbol"], r["value"]) for r in out) == [("Y10", 3.0), ("Y2", 1.0)]
    with pytest.raises(ValueError, match="no table"):
        formats.best_frame({"a.csv": b"a,b,c\n1,2,3\n"})


def test_last_json_object_against_the_library(spark):
    def brute(text):
        best = None
        for i, c in enumerate(text or ""):
            if c == "{":
                try:
                    value, n = json.JSONDecoder().raw_decode(text[i:])
                except json.JSONDecodeError:
                    continue
                if isinstance(value, dict) and (best is None or (i + n, n) > best[:2]):
                    best = (i + n, n, text[i : i + n])
        return best and best[2]

    rng = random.Random(3)
    bits = ["{", "}", '"', "a", '"k": 1', '{"k": 2}', '{"x": {"y": "}"}}', " ", "\n", "[", "]", ",", '"z": {', "1", "é"]
    texts = [None, "", "no", '{"a": "}{"} x {"b": {"c": "{"}} {', '{"a":1}{"b":2}}', "{}", *["".join(rng.choice(bits) for _ in range(rng.randint(1, 14))) for _ in range(300)]]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string").withColumn("j", last_json_object(F.col("t")))
    assert {r["i"]: r["j"] for r in df.collect()} == {i: brute(t) for i, t in enumerate(texts)}


# --- many calendars ---------------------------------------------------------------------------------------------------


def test_calendars_without_rules_and_without_sessions(spark):
    listed = spark.createDataFrame([("A", "XNYS", None, False), ("B", None, None, True), ("C", None, "Asia/Tokyo", None)], "symbol string, session_calendar string, exchange_timezone string, always_open boolean")
    with pytest.raises(ValueError, match="nowhere"):
        markets.market_sessions(spark, listed.withColumn("session_calendar", F.lit("nowhere")), date(2024, 1, 1), date(2024, 1, 2))
    found = markets.market_sessions(spark, listed, date(2024, 1, 1), date(2024, 1, 8))
    at = lambda d, h, m=0: datetime(2024, 1, d, h, m)
    bars = spark.createDataFrame([(s, ts) for s in ("A", "B", "C", "unlisted") for ts in (at(2, 14, 30), at(2, 14, 35), at(2, 20, 55), at(2, 23, 0))], "symbol string, open_ts timestamp_ntz")
    rows = {(r["symbol"], r["open_ts"].hour, r["open_ts"].minute): r for r in markets.classify(bars, listed, found).collect()}
    assert rows["A", 14, 30]["minutes_since_open"] == 0 and rows["A", 23, 0]["session_type"] == "extended_session"
    assert rows["C", 23, 0]["trading_date"] == date(2024, 1, 3) and rows["unlisted", 23, 0]["session_type"] == "unclassified_no_calendar"
    cover = {r["symbol"]: r for r in markets.coverage(markets.classify(bars, listed, found), listed, found, at(2, 14, 30), at(3, 0)).collect()}
    assert (cover["A"]["n_expected"], cover["A"]["n_covering"], cover["A"]["missing_inside"]) == (78, 3, 75)
    assert cover["B"]["expected_basis"] == "always_open" and cover["B"]["n_expected"] == 103 and "unlisted" not in cover
    assert cover["C"]["expected_basis"] == "observed_envelope" and cover["C"]["n_expected"] == 2 + 26 and cover["C"]["missing_inside"] == 24  # two local dates
    none = markets.coverage(markets.classify(bars, listed, found), listed, found, at(1, 0), at(2, 0)).filter("symbol = 'A'").first()
    assert none["expected_basis"] == "observed_envelope"  # the first of January has no session


# --- evaluation -------------------------------------------------------------------------------------------------------


def _grid(spark, rng, days=6):
    start = datetime(2024, 1, 1)
    rows = [(s, start + timedelta(minutes=5 * k), "c", 1.0, 1.0, 1.0, rng.uniform(1, 2) if rng.random() < 0.8 else None, 1.0, k) for s in ("A", "B", "C") for k in range(0, 288 * days, 1 + rng.randint(0, 2))]
    bars = spark.createDataFrame(rows, "symbol string, open_ts timestamp_ntz, contract string, open double, high double, low double, close double, volume double, ingest_seq long")
    return align.aligned(bars)


def test_history_and_correlation_look_back_only(spark):
    grid = _grid(spark, random.Random(1)).cache()
    cut = datetime(2024, 1, 5, 10)
    before = grid.filter(F.col("slot_ts") < F.lit(cut).cast("timestamp_ntz"))
    for of in (lambda g: study.same_time_history(g), lambda g: study.group_divergence(g, ("A",), ("B", "C")), lambda g: study.rolling_correlation(g, ("A", "B", "C"), window=24)):
        whole = of(grid).filter(F.col("slot_ts") < F.lit(cut).cast("timestamp_ntz"))
        early = of(before)
        rounded = lambda df: sorted(str(tuple(round(x, 9) if isinstance(x, float) else x for x in r)) for r in df.collect())
        assert rounded(whole) == rounded(early)


def test_purged_folds_need_no_nested_loop(spark):
    labels = spark.range(2000).select((F.col("id") % 7).alias("symbol"), F.timestamp_micros(F.col("id") * 600_000_000).cast("timestamp_ntz").alias("start_ts"), F.timestamp_micros(F.col("id") * 600_000_000 + 7_200_000_000).cast("timestamp_ntz").alias("end_ts"))
    out = study.purged_folds(labels, 3, 60)
    assert "NestedLoop" not in out._jdf.queryExecution().toString() and "Cartesian" not in out._jdf.queryExecution().toString()
    rows = out.collect()
    for f in (1, 2, 3):
        tested = [r for r in rows if r["fold"] == f and r["role"] == "test"]
        lo, hi = min(r["start_ts"] for r in tested), max(r["end_ts"] for r in tested)
        wide = timedelta(minutes=60)
        for r in rows:
            if r["fold"] == f and r["role"] != "test":
                touches = r["start_ts"] < hi and r["end_ts"] > lo
                near = r["start_ts"] < hi + wide and r["end_ts"] > lo - wide
                assert r["role"] == ("purged" if touches else "embargoed" if near else "train")


def test_weights_are_poisson(spark):
    w = spark.range(20_000).select(study.poisson_weight(F.col("id"), F.lit(7)).alias("w"))
    mean, var = w.agg(F.avg("w"), F.var_samp("w")).first()
    assert abs(mean - 1) < 0.03 and abs(var - 1) < 0.05
