"""Collection: chunk by chunk, all instruments in one frame, checked and merged, with stored audit rows and a resume point."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timedelta
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import schema as S
from ..operators import bars as B
from ..operators import quality as Q
from ..operators.rolls import rolls
from ..sources import tables
from ..sources.rest import spans

KEYS = ["symbol", "open_ts", "contract", "is_continuous"]


def resume_start(start: datetime, end: datetime, checkpoint: dict | None, job: str, minutes: int = 30) -> datetime:
    """Where to go on: the checkpoint less an overlap, only if it is of this very request."""
    if not checkpoint or (checkpoint["job"], checkpoint["start"], checkpoint["end"]) != (job, start, end):
        return start
    return max(start, min(checkpoint["stamp"], end) - timedelta(minutes=minutes))


def complete_only(bars: DataFrame, now: datetime, minutes: int = 5) -> DataFrame:
    """Without the bar that is still open."""
    floor = now - timedelta(minutes=now.minute % minutes, seconds=now.second, microseconds=now.microsecond)
    return bars.filter(F.col("open_ts") < F.lit(floor.isoformat(sep=" ")).cast("timestamp_ntz"))


AUDIT = "symbol string, chunk_start timestamp_ntz, chunk_end timestamp_ntz, status string, received long, inserted long, updated long, duplicates long, rejected long, error string"


#: Symbols whose requests are one plan.
TOGETHER = 50


def _fetched(spark: SparkSession, wanted: dict[str, datetime], hi: datetime, fetch: Callable, path: str) -> tuple[DataFrame | None, dict[str, str]]:
    """(rows of all symbols from each one's beginning, read back from where they were written, errors by symbol). Each symbol is fetched once, by itself only if those of its group fail together."""
    errors: dict[str, str] = {}
    names = list(wanted)
    written = False
    for g in range(0, len(names), TOGETHER):
        frames = {}
        for symbol in names[g : g + TOGETHER]:
            try:
                frames[symbol] = B.normalise(fetch(symbol, wanted[symbol], hi))
            except Exception as e:  # noqa: BLE001  one instrument's failure leaves the others running
                errors[symbol] = f"{type(e).__name__}: {e}"
        try:
            if frames:
                reduce(DataFrame.unionByName, frames.values()).write.mode("overwrite").parquet(f"{path}/{g}")
                written = True
        except Exception:  # noqa: BLE001  one of them can't be read: find out which
            tables.remove(spark, f"{path}/{g}")
            for k, (symbol, frame) in enumerate(frames.items()):
                try:
                    frame.write.mode("overwrite").parquet(f"{path}/{g}-{k}")
                    written = True
                except Exception as e:  # noqa: BLE001
                    errors[symbol] = f"{type(e).__name__}: {e}"
                    tables.remove(spark, f"{path}/{g}-{k}")
    return (spark.read.schema(S.BARS).option("recursiveFileLookup", True).parquet(path) if written else None), errors


def _at(moment: datetime) -> Column:
    return F.lit(moment.isoformat(sep=" ")).cast("timestamp_ntz")


def _last() -> Column:
    return F.max_by(F.struct("open_ts", "contract", "ingest_seq"), F.struct("open_ts", "ingest_seq")).alias("b")


def _by() -> dict[str, Column]:
    return {"p_symbol": F.col("symbol"), "p_month": tables.month()}


def _last_before(spark: SparkSession, path: str, lo: datetime) -> DataFrame | None:
    """The last bar of each symbol before a moment: from the table of months' last bars, and of that month's own partitions from the bars."""
    ends = tables.read(spark, f"{path}/ends")
    if ends is None:
        return None
    bars = tables.read(spark, f"{path}/bars").filter((F.col("p_month") == f"{lo:%Y-%m}") & (F.col("open_ts") < _at(lo)))
    columns = ["symbol", "open_ts", "contract", "ingest_seq"]
    earlier = ends.filter(F.col("month") < f"{lo:%Y-%m}").select(*columns).unionByName(bars.select(*columns))
    return earlier.groupBy("symbol").agg(_last()).select("symbol", "b.*")


def checkpoints(spark: SparkSession, path: str) -> dict[str, dict]:
    """The stored resume point of each symbol: one row a symbol reaches the driver."""
    found = tables.read(spark, f"{path}/checkpoints")
    return {} if found is None else {r["symbol"]: r.asDict() for r in found.drop("p_all").collect()}


def collect(
    spark: SparkSession,
    symbols: list[str],
    start: datetime,
    end: datetime,
    fetch: Callable[[str, datetime, datetime], DataFrame],
    path: str,
    chunk_days: float = 30,
    now: datetime | None = None,
    job: str | None = None,
    overlap: int = 30,
) -> list[dict]:
    """Collects all symbols chunk by chunk; one summary a symbol.

    A chunk of all symbols is one frame: fetched once, checked, merged into the partitions of the table at path/bars
    that it touches; no other partition is read. A failure is its symbol's alone; a rerun inserts nothing twice.
    path/audit has a row for each symbol and chunk, path/rolls the contract changes, also those between chunks. With
    ``now``, bars still open are left out. With ``job``, each symbol goes on where an earlier run of the same job and
    window ended, ``overlap`` minutes before its last bar's end; without, everything is asked for again.
    """
    known = checkpoints(spark, path)
    begin = {s: resume_start(start, end, known.get(s), job, overlap) if job else start for s in symbols}
    for lo, hi in spans(start, end, chunk_days):
        wanted = {s: max(lo, at) for s, at in begin.items() if at < hi}
        if not wanted:
            continue
        chunk = f"{lo:%Y%m%dT%H%M%S}-{hi:%Y%m%dT%H%M%S}"
        raw, errors = _fetched(spark, wanted, hi, fetch, f"{path}/fetched/{chunk}")
        audit = spark.createDataFrame([(s, lo, hi, "failed", 0, 0, 0, 0, 0, e) for s, e in errors.items()], AUDIT)
        if raw is not None:
            raw = raw if now is None else complete_only(raw, now)
            raw = raw.withColumn("bar_id", F.monotonically_increasing_id()).withColumn("ingest_seq", F.coalesce("ingest_seq", "bar_id"))
            clean, issues = Q.preinsert(raw)
            clean = clean.drop("bar_id").withColumn("record_id", S.record_id(*KEYS)).withColumn("ingested_at", _at(now or datetime.now()))
            base = tables.touched(spark, f"{path}/bars", clean, _by())
            counted = _counted(spark, list(wanted), raw, clean, issues, clean.select(*KEYS).limit(0) if base is None else base.select(*KEYS), lo, hi)
            audit = counted.join(audit.select("symbol"), "symbol", "left_anti").unionByName(audit)
            tables.merge_into(spark, f"{path}/audit", audit, ["symbol", "chunk_start", "chunk_end"], {"p_chunk": F.lit(chunk)})
            series = clean.select("symbol", "open_ts", "contract", "ingest_seq")
            starts = spark.createDataFrame(list(wanted.items()), "symbol string, begin timestamp_ntz")
            for at in sorted(set(wanted.values())):  # one unless symbols resume at different places
                before = _last_before(spark, path, at)
                if before is not None:
                    series = series.unionByName(before.join(starts.filter(F.col("begin") == _at(at)), "symbol", "left_semi"))
            tables.merge_into(spark, f"{path}/rolls", rolls(series), ["symbol", "roll_ts"], {"p_month": tables.month("roll_ts")})
            tables.merge_into(spark, f"{path}/bars", clean, KEYS, _by())
            months = tables.touched(spark, f"{path}/bars", clean, _by()).groupBy("symbol", F.col("p_month").alias("month")).agg(_last()).select("symbol", "month", "b.*")
            tables.merge_into(spark, f"{path}/ends", months, ["symbol", "month"], {"p_month": F.col("month")})
            stamps = clean.groupBy("symbol").agg(F.max("close_ts").alias("stamp")).select("symbol", F.lit(job or "incremental").alias("job"), _at(start).alias("start"), _at(end).alias("end"), "stamp")
            tables.merge_into(spark, f"{path}/checkpoints", stamps, ["symbol"], {"p_all": F.lit("all")})
        else:
            tables.merge_into(spark, f"{path}/audit", audit, ["symbol", "chunk_start", "chunk_end"], {"p_chunk": F.lit(chunk)})
        tables.remove(spark, f"{path}/fetched/{chunk}")
    return summary(spark, path, start, end)


def _counted(spark: SparkSession, symbols: list[str], raw: DataFrame, clean: DataFrame, issues: DataFrame, known: DataFrame, lo: datetime, hi: datetime) -> DataFrame:
    """A row a symbol: what came, what was new, what was known, what was there twice, what was refused."""
    on = [F.col(f"c.{k}").eqNullSafe(F.col(f"k.{k}")) for k in KEYS]
    marked = clean.alias("c").join(known.withColumn("_known", F.lit(1)).alias("k"), on, "left").groupBy("c.symbol").agg(F.count(F.lit(1)).alias("kept"), F.count("_known").alias("updated"))
    refused = issues.filter("disposition = 'excluded'").groupBy("symbol").agg(F.countDistinct("bar_id").alias("rejected"))
    out = spark.createDataFrame([(s,) for s in symbols], "symbol string")
    for part in (raw.groupBy("symbol").agg(F.count(F.lit(1)).alias("received")), marked, refused):
        out = out.join(part, "symbol", "left")
    out = out.na.fill(0)
    return out.select("symbol", _at(lo).alias("chunk_start"), _at(hi).alias("chunk_end"), F.lit("succeeded").alias("status"), "received", (F.col("kept") - F.col("updated")).alias("inserted"), "updated", (F.col("received") - F.col("kept") - F.col("rejected")).alias("duplicates"), "rejected", F.lit(None).cast("string").alias("error"))


def audit(spark: SparkSession, path: str) -> DataFrame:
    """The stored audit rows."""
    return tables.read(spark, f"{path}/audit").drop("p_chunk")


def summary(spark: SparkSession, path: str, start: datetime, end: datetime) -> list[dict]:
    """One row a symbol over the chunks of a request; a symbol without any row has failed. As many rows as there are symbols reach the driver."""
    rows = audit(spark, path).filter((F.col("chunk_start") >= _at(start)) & (F.col("chunk_end") <= _at(end)))
    bad = F.col("status") == "failed"
    out = rows.groupBy("symbol").agg(*[F.sum(c).alias(c) for c in ("received", "inserted", "updated", "duplicates", "rejected")], F.max(F.when(bad, F.col("error"))).alias("error"), F.max(F.when(~bad, F.col("chunk_end"))).alias("stamp"))
    none = F.when(F.col("received") == 0, "ValueError: no rows for a required instrument")
    out = out.withColumn("error", F.coalesce("error", none)).withColumn("status", F.when(F.col("error").isNull(), "succeeded").otherwise("failed"))
    return [r.asDict() for r in out.orderBy("symbol").collect()]
