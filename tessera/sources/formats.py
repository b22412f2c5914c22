"""Provider payloads read as data: JSON pages, positional candles, vintage observations, delimited official series, zipped curves."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import timeops as t

_PAGE = "struct<bars:array<struct<t:string,o:double,h:double,l:double,c:double,v:double,n:bigint,vw:double>>,next_page_token:string>"
_OBSERVATIONS = "struct<observations:array<struct<date:string,realtime_start:string,value:string>>>"


def _utc(text: Column) -> Column:
    return F.try_to_timestamp(text).cast("timestamp_ntz")


def paged_bars(pages: DataFrame, payload: str = "payload", page: str = "page") -> DataFrame:
    """Bars of JSON pages. Of a bar that several pages hold the one of the last page stays; ``repeated_tokens`` finds providers' loops."""
    parsed = pages.withColumn("_p", F.from_json(payload, _PAGE))
    rows = parsed.select("symbol", F.col(page).alias("_page"), F.posexplode("_p.bars").alias("_at", "b"))
    bars = rows.select("symbol", _utc(F.col("b.t")).alias("open_ts"), F.col("b.o").alias("open"), F.col("b.h").alias("high"), F.col("b.l").alias("low"), F.col("b.c").alias("close"), F.col("b.v").alias("volume"), F.col("b.n").alias("trade_count"), F.col("b.vw").alias("vwap"), F.struct("_page", "_at").alias("_order"))
    rest = [c for c in bars.columns if c not in ("symbol", "open_ts", "_order")]
    return bars.dropna(subset=["open_ts"]).groupBy("symbol", "open_ts").agg(F.max_by(F.struct(*rest), "_order").alias("_b")).select("symbol", "open_ts", "_b.*")


def repeated_tokens(pages: DataFrame, payload: str = "payload") -> DataFrame:
    """Symbols whose pages name the same next page twice: a provider's loop."""
    token = F.get_json_object(payload, "$.next_page_token")
    return pages.select("symbol", token.alias("token")).filter("token is not null").groupBy("symbol", "token").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def candles(chunks: DataFrame, payload: str = "payload") -> DataFrame:
    """Candles of [time, low, high, open, close, volume] with epoch seconds; short ones are left out, of several at one time the greatest stays."""
    c = F.col("c")
    at = lambda i: F.get(c, F.lit(i))
    rows = chunks.select("symbol", F.explode(F.from_json(payload, "array<array<double>>")).alias("c")).filter(F.size(c) >= 6)
    rows = rows.groupBy("symbol", F.get(c, F.lit(0)).alias("_at")).agg(F.max("c").alias("c"))
    return rows.select("symbol", F.timestamp_seconds(at(0).cast("bigint")).cast("timestamp_ntz").alias("open_ts"), at(3).alias("open"), at(2).alias("high"), at(1).alias("low"), at(4).alias("close"), at(5).alias("volume"))


def vintage_observations(payloads: DataFrame, payload: str = "payload") -> DataFrame:
    """Observations with the date from which a vintage holds; a full stop or null is no value, others are in per cent."""
    rows = payloads.select("symbol", F.explode(F.from_json(payload, _OBSERVATIONS)["observations"]).alias("o"))
    out = rows.select("symbol", F.col("o.date").try_cast("date").alias("observation_date"), F.col("o.realtime_start").try_cast("date").alias("vintage_date"), F.col("o.value").alias("_text"))
    out = out.filter(F.col("_text").isNotNull() & (F.col("_text") != "."))
    return out.select("symbol", "observation_date", "vintage_date", F.col("_text").try_cast("double").alias("value"), F.date_add("vintage_date", 1).cast("timestamp_ntz").alias("available_ts"))


def official_series(lines: DataFrame, line: str = "line") -> DataFrame:
    """``date<sep>value`` lines with a semicolon, comma or tab: the separator is found line by line, rows whose value is no number are skipped."""
    sep = F.when(F.col(line).contains(";"), ";").when(F.col(line).contains("\t"), "\t").otherwise(",")
    parts = F.when(sep == ";", F.split(line, ";")).when(sep == "\t", F.split(line, "\t")).otherwise(F.split(line, ","))
    out = lines.withColumn("_p", parts).select("symbol", F.trim(F.get("_p", F.lit(0))).try_cast("date").alias("observation_date"), F.regexp_replace(F.trim(F.get("_p", F.lit(1))), "^\"|\"$", "").try_cast("double").alias("value"))
    return out.filter(F.col("observation_date").isNotNull() & F.col("value").isNotNull())


def nearest_column(maturities: list[float], target: float, tolerance: float = 0.26) -> float | None:
    """The maturity nearest to the target within the tolerance, the shorter one of two."""
    near = [m for m in sorted(maturities) if abs(m - target) <= tolerance]
    return min(near, key=lambda m: abs(m - target)) if near else None


#: Names of the columns of an official series, in capitals.
DATE_NAMES, VALUE_NAMES = ("TIME_PERIOD", "DATE", "TIME"), ("OBS_VALUE", "VALUE")


def _fields(line: Column, sep: str) -> Column:
    """The fields of a delimited line, quotes taken off; a separator between quotes belongs to its field."""
    return F.transform(F.split(line, f'{sep}(?=(?:[^"]*"[^"]*")*[^"]*$)', -1), lambda x: F.regexp_replace(F.trim(x), '^"|"$', ""))


def discovered_series(lines: DataFrame, file: str = "file", line: str = "line") -> DataFrame:
    """(file, observation_date, value) from the lines of delimited files: each file's separator and columns are found from its header, once.

    The header is the line that names both a date and a value column, wherever they stand; a file without one is an
    error. Rows whose date or value can't be read are missing observations and left out. Lines may come in any order and
    from files of any size: a header is one small row a file, joined to the lines.
    """
    def found(sep: str) -> Column:
        names = F.transform(_fields(F.col(line), sep), F.upper)
        at = lambda wanted: F.coalesce(*[F.nullif(F.array_position(names, w), F.lit(0)) for w in wanted])
        return F.when(at(DATE_NAMES).isNotNull() & at(VALUE_NAMES).isNotNull(), F.struct(F.lit(sep).alias("sep"), at(DATE_NAMES).alias("date_at"), at(VALUE_NAMES).alias("value_at")))

    headers = lines.select(F.col(file).alias("_f"), F.coalesce(*[found(sep) for sep in (";", "\t", ",")]).alias("h")).groupBy("_f").agg(F.min("h").alias("h"))
    absent = F.raise_error(F.concat(F.lit("no date and value columns in "), F.col("_f")))
    headers = headers.select("_f", F.coalesce("h", absent.cast("struct<sep:string,date_at:bigint,value_at:bigint>")).alias("h"))
    rows = lines.join(headers, F.col(file) == F.col("_f"))
    seps = {sep: F.col("h.sep") == sep for sep in (";", "\t", ",")}
    parts = F.lit(None).cast("array<string>")
    for sep, is_it in seps.items():
        parts = F.when(is_it, _fields(F.col(line), sep)).otherwise(parts)
    out = rows.select(F.col(file), parts.alias("_p"), "h")
    out = out.select(file, F.get("_p", F.col("h.date_at") - 1).try_cast("date").alias("observation_date"), F.get("_p", F.col("h.value_at") - 1).try_cast("double").alias("value"))
    return out.filter(F.col("observation_date").isNotNull() & F.col("value").isNotNull())


def read_series(spark: SparkSession, path: str) -> DataFrame:
    """``discovered_series`` of the files at a path."""
    return discovered_series(spark.read.text(path).select(F.input_file_name().alias("file"), F.col("value").alias("line")))


def maturity_of(column: object) -> float | None:
    """The years that a column's name tells: its only number, as in ``10``, ``10.0``, ``10 years`` or ``spot 10y``."""
    found = re.findall(r"[0-9]+(?:\.[0-9]+)?", str(column))
    return float(found[0]) if len(found) == 1 else None


def best_frame(members: dict[str, bytes], least_columns: int = 3):
    """(name, table) of the CSV member of an archive with the most maturity columns; of equals the one whose name tells of nominal, then of spot curves, then the shorter name.

    Separators are found from each header. Members that can't be read or have fewer than ``least_columns`` columns don't count; none left is an error.
    """
    import io

    import pandas as pd

    rank = lambda n: ("nominal" not in n.lower(), "spot" not in n.lower(), len(n), n)
    best = None
    for name in sorted(members, key=rank):
        header = members[name].split(b"\n", 1)[0].decode("utf-8-sig", "replace")
        sep = max(";\t,", key=header.count)
        try:
            table = pd.read_csv(io.BytesIO(members[name]), sep=sep, encoding="utf-8-sig")
        except (ValueError, UnicodeDecodeError):
            continue
        score = sum(maturity_of(c) is not None for c in table.columns[1:])
        if len(table.columns) >= least_columns and score and (best is None or score > best[0]):
            best = (score, name, table)
    if best is None:
        raise ValueError("no table of maturities in the archive")
    return best[1:]


def zipped_curves(spark: SparkSession, path: str, targets: dict[str, float], member: str = ".csv") -> DataFrame:
    """Curves from ZIP archives of CSV files with a date column and one column a maturity in years: of each archive its best table (``best_frame``), for each target its nearest column.

    Archives are opened inside tasks, one row of the result for each date and target; archives must fit a task's memory.
    """

    def run(batches):
        import io
        import zipfile

        import pandas as pd

        for pdf in batches:
            for content in pdf["content"]:
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    _, table = best_frame({n: z.read(n) for n in z.namelist() if n.lower().endswith(member)})
                years = {c: y for c in table.columns[1:] if (y := maturity_of(c)) is not None}
                for symbol, target in targets.items():
                    if (best := nearest_column(list(years.values()), target)) is None:
                        continue
                    column = next(c for c, y in years.items() if y == best)
                    yield pd.DataFrame({"symbol": symbol, "observation_date": pd.to_datetime(table.iloc[:, 0], errors="coerce").dt.date, "maturity": best, "value": pd.to_numeric(table[column], errors="coerce")}).dropna()

    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInPandas(run, "symbol string, observation_date date, maturity double, value double")
