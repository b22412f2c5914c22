"""Research packages: Parquet and chunked CSV written by Spark, inventories with hashes, a small manifest."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import schema as S
from ..operators import align, coverage, markets, sessions
from ..operators.rolls import rolls
from ..operators.split import Split, bounds, split

CSV_ROWS = 250_000


def write_parquet(df: DataFrame, path: str) -> None:
    df.write.option("compression", "zstd").parquet(path)


#: Rows up to which a table of a package is also one file.
SINGLE_ROWS = 1_000_000


def _renamed(spark: SparkSession, source: str, target: Callable[[int, int], str]) -> list[str]:
    """Moves the part files of a written folder to target(number from 1, how many there are) and drops the folder; names alone pass the driver."""
    from ..sources.tables import names, remove

    parts = [n for n in names(spark, source) if n.startswith("part-")]
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    out = [target(k, len(parts)) for k in range(1, len(parts) + 1)]
    for part, to in zip(parts, out, strict=True):
        fs = path(to).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        fs.mkdirs(path(to).getParent())
        if not fs.rename(path(f"{source}/{part}"), path(to)):
            raise OSError(f"{to} exists already")
    remove(spark, source)
    return out


def write_csv_parts(df: DataFrame, path: str, rows: int = CSV_ROWS, compressed: bool = True, stem: str | None = None) -> None:
    """CSV files with headers of so many rows at most; an empty table gives one file with the header alone. With a stem they are called stem_part_001 and so on."""
    df.write.option("maxRecordsPerFile", rows).option("header", True).option("compression", "gzip" if compressed else "none").csv(path if stem is None else f"{path}/_parts")
    if stem is not None:
        _renamed(df.sparkSession, f"{path}/_parts", lambda k, _: f"{path}/{stem}_part_{k:03d}.csv{'.gz' if compressed else ''}")


def write_single(df: DataFrame, path: str, rows: int = SINGLE_ROWS) -> bool:
    """A small table as one CSV file at path; False, and nothing written, if it has more rows than that."""
    if df.limit(rows + 1).count() > rows:
        return False
    df.coalesce(1).write.option("header", True).csv(f"{path}._parts")
    _renamed(df.sparkSession, f"{path}._parts", lambda k, _: path)
    return True


def inventory(spark: SparkSession, path: str) -> DataFrame:
    """(path, bytes, sha256) of each file below a path; files are hashed where they are read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def manifest(tables: dict[str, DataFrame], facts: dict | None = None) -> dict:
    """Rows and schema of each table, with what else is to be said. Counts alone reach the driver."""
    return {"tables": {name: {"n_rows": df.count(), "columns": {f.name: f.dataType.simpleString() for f in df.schema}} for name, df in tables.items()}} | (facts or {})


def write_json(spark: SparkSession, document: dict, path: str) -> None:
    spark.createDataFrame([(json.dumps(document, default=str, sort_keys=True),)], "value string").coalesce(1).write.text(path)


#: What a package holds beside its tables, each worked out from the discovery part alone.
DERIVED = {
    "aligned": lambda x: align.aligned(x["bars"]),
    "heatmap": lambda x: x["bars"].groupBy("symbol", F.to_date("open_ts").alias("day")).agg(F.count(F.lit(1)).alias("n")),
    "envelope": lambda x: coverage.by_envelope(x["bars"]),
}


def derived(catalogue: DataFrame, found: DataFrame, start, end) -> dict[str, Callable[[dict[str, DataFrame]], DataFrame]]:
    """``DERIVED`` and what a catalogue and a sessions table add: sessions of the window, coverage, issues, rolls and decision times, each instrument by its own calendar."""

    def classified(x: dict[str, DataFrame]) -> DataFrame:
        return markets.classify(x["bars"], catalogue, found)

    def whole(x: dict[str, DataFrame]) -> DataFrame:
        """Classified bars with every canonical column, those that they lack null."""
        bars = classified(x)
        return bars.withColumns({f.name: F.lit(None).cast(f.dataType) for f in S.BARS if f.name not in bars.columns} | {"bar_id": F.col("ingest_seq")})

    return DERIVED | {
        "sessions": lambda x: sessions.overlapping(found, start, end),
        "coverage": lambda x: markets.coverage(classified(x), catalogue, found, start, end),
        "issues": lambda x: markets.evaluate(whole(x), catalogue),
        "rolls": lambda x: rolls(x["bars"]),
        "decision_times": lambda x: sessions.decision_times(classified(x)),
    }


def package(bars: DataFrame, path: str, test_days: int = 30, ts: str = "open_ts", others: dict[str, tuple[DataFrame, str]] | None = None, derived: dict[str, Callable[[dict[str, DataFrame]], DataFrame]] | None = None, configuration: dict | None = None) -> Split:
    """Discovery and untouched parts of all tables in separate places; derived tables see the discovery part alone.

    A derived table of up to ``SINGLE_ROWS`` rows is one CSV file, others are numbered parts. ``others`` names further tables with the time column that tells their parts (a yield's is its availability). Every
    table is Parquet and chunked CSV; the manifest has rows and schemas, the cutoff, rows left out for want of a time,
    and a hash of the configuration; the inventory lists all files with their hashes.
    """
    spark = bars.sparkSession
    s = split(*bounds(bars, ts), test_days=test_days)
    tables = {"bars": (bars, ts)} | (others or {})
    parts = {name: {n: part(df, at) for n, (df, at) in tables.items()} for name, part in (("discovery", s.discovery), ("untouched", s.untouched))}
    for name, make in (derived or {}).items():
        parts["discovery"][name] = make(parts["discovery"])
    for name, part in parts.items():
        for n, df in part.items():
            write_parquet(df, f"{path}/{name}/{n}")
            written = spark.read.parquet(f"{path}/{name}/{n}")
            if n in tables or not write_single(written, f"{path}/{name}-csv/{n}.csv"):
                write_csv_parts(written, f"{path}/{name}-csv/{n}", stem=n)
    told = {f"{name}/{n}": spark.read.parquet(f"{path}/{name}/{n}") for name, part in parts.items() for n in part}
    facts = {
        "cutoff": s.cutoff,
        "excluded": {n: df.count() - sum(told[f"{name}/{n}"].count() for name in parts) for n, (df, _) in tables.items()},
        "configuration_sha256": hashlib.sha256(json.dumps(configuration or {}, sort_keys=True, default=str).encode()).hexdigest(),
    }
    write_json(spark, manifest(told, facts), f"{path}/manifest")
    files = inventory(spark, f"{path}/discovery").unionByName(inventory(spark, f"{path}/untouched")).unionByName(inventory(spark, f"{path}/discovery-csv")).unionByName(inventory(spark, f"{path}/untouched-csv"))
    write_parquet(files, f"{path}/inventory")
    return s
