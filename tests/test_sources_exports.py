"""Provider payloads, the paged data source, and exports."""

import gzip
import hashlib
import json
import urllib.error
import zipfile
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tessera.plans import export
from tessera.sources import formats, rest


def test_pages_follow_tokens_and_refuse_repeats():
    got = []

    def get(url):
        got.append(url)
        return {"bars": [len(got)], "next_page_token": "t" if len(got) == 1 else None}

    assert [p["bars"] for p in rest.pages("http://x/bars", {"symbol": "A"}, get)] == [[1], [2]]
    assert "page_token=t" in got[1]
    with pytest.raises(ValueError):
        list(rest.pages("http://x", {}, lambda url: {"next_page_token": "same"}))


def test_passing_errors_are_tried_again(monkeypatch, tmp_path):
    (tmp_path / "x.json").write_text('{"ok": 1}')
    real, calls, waits = rest.urllib.request.urlopen, [], []

    def flaky(request, timeout):
        calls.append(1)
        if len(calls) == 1:
            raise urllib.error.HTTPError("u", 429, "busy", {"Retry-After": "7"}, None)
        return real(request, timeout=timeout)

    monkeypatch.setattr(rest.urllib.request, "urlopen", flaky)
    assert rest.fetch_json(f"file://{tmp_path}/x.json", wait=waits.append) == {"ok": 1}
    assert waits == [7.0]


def test_data_source_reads_spans(spark, tmp_path):
    for s in ("A", "B"):
        bars = [{"t": f"2024-01-0{d}T10:00:00Z", "o": 1, "h": 2, "l": 0.5, "c": d, "v": 10, "n": 3, "vw": 1.1} for d in (1, 2, 3)]
        (tmp_path / f"{s}.json").write_text(json.dumps({"bars": bars, "next_page_token": None}))
    spark.dataSource.register(rest.PagedBars)
    df = spark.read.format("paged_bars").options(url=f"file://{tmp_path}/{{symbol}}.json", symbols="A,B", start="2024-01-01", end="2024-01-03", chunkDays="1", plain="1").load()
    assert df.count() == 4
    assert {r["close"] for r in df.collect()} == {1.0, 2.0}


def test_spans_are_half_open():
    s = rest.spans(datetime(2024, 1, 1), datetime(2024, 1, 4), 2)
    assert s == [(datetime(2024, 1, 1), datetime(2024, 1, 3)), (datetime(2024, 1, 3), datetime(2024, 1, 4))]


def test_repeated_bars_across_pages(spark):
    page = lambda c: json.dumps({"bars": [{"t": "2024-01-01T00:00:00Z", "o": 1, "h": 1, "l": 1, "c": c, "v": 1, "n": 1, "vw": 1}], "next_page_token": "t"})
    pages = spark.createDataFrame([("A", 1, page(1)), ("A", 2, page(2))], "symbol string, page int, payload string")
    assert [r["close"] for r in formats.paged_bars(pages).collect()] == [2.0]
    assert formats.repeated_tokens(pages).count() == 1


def test_zipped_curves_take_the_nearest_maturity(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "curve.zip", "w") as z:
        z.writestr("spot.csv", "date,1.9,5.0,10.1\n2024-01-02,3.1,3.2,3.3\n2024-01-03,x,3.4,3.5\n")
    out = formats.zipped_curves(spark, str(tmp_path), {"GB2Y": 2.0, "GB10Y": 10.0, "GB30Y": 30.0}).collect()
    assert sorted((r["symbol"], r["value"]) for r in out) == [("GB10Y", 3.3), ("GB10Y", 3.5), ("GB2Y", 3.1)]
    assert formats.nearest_column([1.0, 3.0], 2.0) is None


def test_export_parts_inventory_and_manifest(spark, tmp_path):
    df = spark.range(25).selectExpr("id", "id % 2 = 0 AS even")
    export.write_csv_parts(df.coalesce(1), f"{tmp_path}/csv", rows=10)
    parts = sorted((tmp_path / "csv").glob("*.csv.gz"))
    assert len(parts) == 3
    assert sum(len(gzip.open(p, "rt").read().splitlines()) - 1 for p in parts) == 25
    export.write_parquet(df, f"{tmp_path}/pq")
    listed = {r["path"].rsplit("/", 1)[-1]: r["sha256"] for r in export.inventory(spark, f"{tmp_path}/csv").collect()}
    assert all(listed[p.name] == hashlib.sha256(p.read_bytes()).hexdigest() for p in parts)
    manifest = export.manifest({"rows": df}, {"note": "x"})
    assert manifest["tables"]["rows"]["n_rows"] == 25 and manifest["note"] == "x"
    export.write_csv_parts(df.filter("id < 0"), f"{tmp_path}/none", rows=10)
    assert any("id" in gzip.open(p, "rt").read() for p in (tmp_path / "none").glob("*.csv.gz"))


def test_packages_keep_the_untouched_part_apart(spark, tmp_path):
    bars = spark.createDataFrame([("A", datetime(2024, 1, d), float(d)) for d in range(1, 11)], "symbol string, open_ts timestamp_ntz, close double")
    s = export.package(bars, f"{tmp_path}/pkg", test_days=3)
    seen = spark.read.parquet(f"{tmp_path}/pkg/discovery/bars")
    assert seen.agg({"open_ts": "max"}).first()[0] < s.cutoff
    assert spark.read.parquet(f"{tmp_path}/pkg/untouched/bars").agg({"open_ts": "min"}).first()[0] >= s.cutoff


def test_packages_hold_all_tables(spark, tmp_path):
    full = spark.createDataFrame([("A", datetime(2024, 1, d), float(d), d) for d in range(1, 11)], "symbol string, open_ts timestamp_ntz, close double, ingest_seq int").withColumns({c: F.col("close") for c in ("open", "high", "low", "volume")})
    y = spark.createDataFrame([(datetime(2024, 1, d), float(d)) for d in (2, 9)] + [(None, 1.0)], "available_ts timestamp_ntz, value double")
    s = export.package(full, f"{tmp_path}/pkg", test_days=3, others={"yields": (y, "available_ts")}, derived=export.DERIVED, configuration={"a": 1})
    assert spark.read.parquet(f"{tmp_path}/pkg/discovery/aligned").agg({"slot_ts": "max"}).first()[0] < s.cutoff
    assert [spark.read.parquet(f"{tmp_path}/pkg/{p}/yields").count() for p in ("discovery", "untouched")] == [1, 1]
    told = json.loads(spark.read.text(f"{tmp_path}/pkg/manifest").first()[0])
    assert told["excluded"] == {"bars": 0, "yields": 1} and len(told["configuration_sha256"]) == 64
    assert {"discovery/heatmap", "discovery/envelope", "untouched/bars"} <= set(told["tables"])
    assert spark.read.parquet(f"{tmp_path}/pkg/inventory").filter("length(sha256) = 64").count() >= 8


def test_files_have_the_names_of_a_package(spark, tmp_path):
    from pathlib import Path

    df = spark.range(25, numPartitions=1).selectExpr("id")
    export.write_csv_parts(df, f"{tmp_path}/csv", rows=10, stem="bars")
    assert sorted(p.name for p in Path(tmp_path, "csv").iterdir() if not p.name.startswith(".")) == [f"bars_part_00{k}.csv.gz" for k in (1, 2, 3)]
    assert spark.read.option("header", True).csv(f"{tmp_path}/csv").count() == 25
    assert export.write_single(df, f"{tmp_path}/one.csv") and Path(tmp_path, "one.csv").read_text().splitlines()[:2] == ["id", "0"]
    assert not export.write_single(df, f"{tmp_path}/two.csv", rows=24) and not Path(tmp_path, "two.csv").exists()


def test_a_package_by_catalogue(spark, tmp_path, sf_dir):
    from tessera.plans import markets as q

    bars, listed, found = q.classified(spark, sf_dir)
    window = datetime(2024, 1, 2), datetime(2024, 1, 20)
    export.package(bars.withColumn("is_continuous", F.lit(True)), f"{tmp_path}/pkg", test_days=3, derived=export.derived(listed, found, *window))
    csv = lambda n: spark.read.option("header", True).csv(f"{tmp_path}/pkg/discovery-csv/{n}.csv")
    assert csv("coverage").count() == len(q.LISTED) and csv("sessions").count() > 50
    assert {"issue_type", "severity"} <= set(csv("issues").columns) and csv("decision_times").count() > 0 and csv("rolls").count() > 0


def test_bars_without_needed_columns_are_refused(spark):
    from tessera.operators import bars as B

    with pytest.raises(ValueError, match="open_ts"):
        B.normalise(spark.range(1).selectExpr("'A' symbol"))


def test_resume_only_for_the_same_request():
    a, b, c = datetime(2024, 1, 1), datetime(2024, 2, 1), datetime(2024, 1, 20)
    from tessera.plans.collect import resume_start

    same = {"job": "backfill", "start": a, "end": b, "stamp": c}
    assert resume_start(a, b, same, "backfill", minutes=30) == datetime(2024, 1, 19, 23, 30)
    assert resume_start(a, b, same, "incremental", minutes=30) == a
    assert resume_start(a, b, same | {"end": c}, "backfill", minutes=30) == a
    assert resume_start(a, b, None, "backfill", minutes=30) == a


def test_collection_isolates_failures(spark, tmp_path):
    from tessera.plans import collect as c
    from tessera.sources import tables

    calls = spark.sparkContext.accumulator(0)

    def fetch(symbol, start, end):
        if symbol == "B":
            raise OSError("down")
        schema = "symbol string, open_ts timestamp_ntz, contract string, open double, high double, low double, close double"
        rows = [(symbol, start, "H6" if start.day < 3 else "M6", 1.0, 1.0, 1.0, 1.0)]

        def counted(batches):
            calls.add(1)
            yield from batches

        return spark.createDataFrame(rows, schema).coalesce(1).mapInArrow(counted, schema)

    window = datetime(2024, 1, 1), datetime(2024, 1, 5)
    runs = c.collect(spark, ["A", "B"], *window, fetch, f"{tmp_path}/x", chunk_days=2)
    by = {r["symbol"]: r for r in runs}
    assert by["A"]["status"] == "succeeded" and by["A"]["inserted"] == 2 and by["A"]["stamp"] == window[1]
    assert by["B"]["status"] == "failed" and "down" in by["B"]["error"]
    assert calls.value == 2  # one fetch a chunk
    stored = c.audit(spark, f"{tmp_path}/x").orderBy("symbol", "chunk_start").collect()
    assert [(r["symbol"], r["status"]) for r in stored] == [("A", "succeeded")] * 2 + [("B", "failed")] * 2
    assert [(r["outgoing_contract"], r["incoming_contract"]) for r in tables.read(spark, f"{tmp_path}/x/rolls").collect()] == [("H6", "M6")]  # between two chunks
    again = c.collect(spark, ["A"], *window, fetch, f"{tmp_path}/x", chunk_days=2)
    assert (again[0]["inserted"], again[0]["updated"]) == (0, 2)
    bars = tables.read(spark, f"{tmp_path}/x/bars")
    assert bars.count() == 2 and bars.select("record_id").distinct().count() == 2 and "ingested_at" in bars.columns


def test_merges_into_a_keyed_table(spark, tmp_path):
    """Random merges against a dictionary: null and empty keys, symbols that look like numbers or like our own marks."""
    import random

    from tessera.sources import tables

    rng, path, want = random.Random(7), f"{tmp_path}/t", {}
    symbols = [None, "", "0700", "700", "9988", "AAPL", "~null", "~empty", "__HIVE_DEFAULT_PARTITION__", "a/b=c d%", "1e3"]
    by = {"p_symbol": F.col("symbol"), "p_month": F.date_format("ts", "yyyy-MM")}
    for step in range(6):
        keys = {(rng.choice(symbols), rng.choice([None, datetime(2024, rng.randint(1, 2), rng.randint(1, 3))])) for _ in range(25)}
        rows = {k: (step * 100 + n, rng.choice([None, "x"])) for n, k in enumerate(sorted(keys, key=str))}
        df = spark.createDataFrame([(*k, *v) for k, v in rows.items()], "symbol string, ts timestamp_ntz, value long, note string")
        assert tables.merge_into(spark, path, df, ["symbol", "ts"], by, f"m{step}" if step % 2 else None)
        want |= rows
        assert not step % 2 or not tables.merge_into(spark, path, df, ["symbol", "ts"], by, f"m{step}")
        got = tables.read(spark, path).collect()
        assert len(got) == len(want) and {(r["symbol"], r["ts"]): (r["value"], r["note"]) for r in got} == want
    assert tables.names(spark, path, "done") == ["m1", "m3", "m5"] and not tables.names(spark, path, "staged")
    twice = spark.createDataFrame([("AAPL", None, 1, "x"), ("AAPL", None, 2, "x")], "symbol string, ts timestamp_ntz, value long, note string")
    with pytest.raises(ValueError, match="twice"):
        tables.merge_into(spark, path, twice, ["symbol", "ts"], by)
    assert tables.read(spark, path).count() == len(want)
    one = tables.touched(spark, path, twice.withColumn("ts", F.lit(datetime(2024, 1, 1)).cast("timestamp_ntz")), by)
    assert {r["symbol"] for r in one.collect()} <= {"AAPL"} and "PartitionFilters: [p_symbol" in one._jdf.queryExecution().toString().replace("isnotnull(p_symbol", "p_symbol")


def _one_bar_a_day(spark, asked):
    def fetch(symbol, start, end):
        asked.append((symbol, start, end))
        schema = "symbol string, open_ts timestamp_ntz, contract string, open double, high double, low double, close double"
        days = [start.replace(hour=0, minute=0) + timedelta(days=n, hours=12) for n in range((end - start).days + 2)]
        return spark.createDataFrame([(symbol, d, f"C{d.day // 4}", 1.0, 1.0, 1.0, 1.0) for d in days if start <= d < end], schema)

    return fetch


def test_collection_of_symbols_that_look_like_numbers(spark, tmp_path):
    from tessera.plans import collect as c
    from tessera.sources import tables

    runs = c.collect(spark, ["0700", "9988", "AAPL"], datetime(2024, 1, 31), datetime(2024, 2, 2), _one_bar_a_day(spark, []), f"{tmp_path}/hk", chunk_days=1)
    assert [(r["symbol"], r["inserted"]) for r in runs] == [("0700", 2), ("9988", 2), ("AAPL", 2)]
    bars = tables.read(spark, f"{tmp_path}/hk/bars")
    assert bars.count() == 6 == bars.select("symbol", "open_ts").distinct().count() and {r["symbol"] for r in bars.collect()} == {"0700", "9988", "AAPL"}


def test_collection_goes_on_from_its_checkpoint(spark, tmp_path):
    from tessera.plans import collect as c
    from tessera.sources import tables

    start, end, path, asked = datetime(2024, 1, 1), datetime(2024, 1, 13), f"{tmp_path}/r", []
    fetch = _one_bar_a_day(spark, asked)

    def broken(symbol, lo, hi):
        if lo >= datetime(2024, 1, 9) and symbol == "A":
            raise OSError("down")
        return fetch(symbol, lo, hi)

    first = c.collect(spark, ["A", "B"], start, end, broken, path, chunk_days=4, job="backfill")
    assert [r["status"] for r in first] == ["failed", "succeeded"]
    kept = c.checkpoints(spark, path)
    assert kept["A"]["stamp"] == datetime(2024, 1, 8, 12, 5) and kept["B"]["stamp"] == datetime(2024, 1, 12, 12, 5)
    asked.clear()
    again = c.collect(spark, ["A", "B"], start, end, fetch, path, chunk_days=4, job="backfill")
    assert asked == [("A", datetime(2024, 1, 8, 11, 35), datetime(2024, 1, 9)), ("A", datetime(2024, 1, 9), end), ("B", datetime(2024, 1, 12, 11, 35), end)]
    assert [r["status"] for r in again] == ["succeeded", "succeeded"]
    assert tables.read(spark, f"{path}/bars").count() == 24
    whole = _one_bar_a_day(spark, [])
    c.collect(spark, ["A", "B"], start, end, whole, f"{tmp_path}/w", chunk_days=12)
    read = lambda p: sorted(tuple(r) for r in tables.read(spark, f"{p}/rolls").select("symbol", "roll_ts", "outgoing_contract", "incoming_contract").collect())
    assert read(path) == read(f"{tmp_path}/w") and len(read(path)) == 6
    asked.clear()
    c.collect(spark, ["A"], start, end, fetch, path, chunk_days=12, job="another")
    assert asked == [("A", start, end)]


def test_catalogue_keeps_extra_keys_and_refuses_repeats(spark):
    from tessera.functions.schema import overlay
    from tessera.sources.catalogue import load_catalogue

    df = load_catalogue(spark, "instruments:\n- {symbol: A, provider: p, lot: 5}\n- {symbol: B, enabled: false}\n")
    assert [(r["symbol"], r["enabled"], r["lot"]) for r in overlay(df, ["lot"]).orderBy("symbol").collect()] == [("A", True, "5"), ("B", False, None)]
    with pytest.raises(ValueError):
        load_catalogue(spark, "instruments:\n- {symbol: A}\n- {symbol: a}\n")
    assert load_catalogue(spark, "instruments: []").count() == 0
