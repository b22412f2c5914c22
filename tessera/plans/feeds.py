"""Queries of sources, texts and keyed streams."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions.text import last_json_object
from ..sources import formats
from ..streaming import bars as live, changes
from .views import BARS5, bars5, read

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str):
    def add(f):
        QUERIES[name] = f
        ORACLE_SQL[name] = sql
        return f

    return add


#: For each file its separator, header, and how a row's date and value stand in it.
_LAYOUTS = {
    "1-URGENT": (";", "TIME_PERIOD;OBS_VALUE", "{d};{v}"),
    "2-HIGH": (",", 'value,"date",note', '{v},"{d}","a, ""b"" c"'),
    "3-MEDIUM": ("\t", "KEY\tTime\tobs_value", "k\t{d}\t{v}"),
    "4-NOT SPECIFIED": (",", "BBK,OBS_VALUE,TIME_PERIOD", "x;y,{v},{d}"),
    "5-LOW": (";", '"VALUE";"comment";"DATE"', '"{v}";"a;b";"{d}"'),
}


@query(
    "s5_discovered_series",
    """select o_orderpriority file, cast(o_orderdate as date) observation_date, o_custkey / 8.0::double as "value" from orders where o_orderkey % 5 <> 0""",
)
def s5_discovered(spark, sf):
    value = F.when(F.col("o_orderkey") % 5 == 0, ".").otherwise((F.col("o_custkey") / 8.0).cast("string"))
    day = F.to_date("o_orderdate").cast("string")
    line = F.lit(None).cast("string")
    for file, (_, _, row) in _LAYOUTS.items():
        line = F.when(F.col("o_orderpriority") == file, F.replace(F.replace(F.lit(row), F.lit("{d}"), day), F.lit("{v}"), value)).otherwise(line)
    rows = read(spark, sf, "orders").select(F.col("o_orderpriority").alias("file"), line.alias("line"))
    headers = spark.createDataFrame([(file, header) for file, (_, header, _) in _LAYOUTS.items()], "file string, line string")
    return formats.discovered_series(rows.unionByName(headers.join(rows.select("file").distinct(), "file", "left_semi")))


@query(
    "f13_last_json",
    """select event_id, case event_id % 5 when 0 then props when 1 then '{"last": ' || event_id || '}' when 2 then '{"in": ' || props || ', "s": "}{"}' when 3 then props else null end as "json" from events""",
)
def f13(spark, sf):
    n, props = F.col("event_id"), F.col("props")
    noisy = (
        F.when(n % 5 == 0, F.concat(F.lit("log {not json}\n"), props, F.lit("\ndone } {")))
        .when(n % 5 == 1, F.concat(props, F.lit(' then {"last": '), n.cast("string"), F.lit('} {"open": {')))
        .when(n % 5 == 2, F.concat(F.lit('{ {"a": 1} : {"in": '), props, F.lit(', "s": "}{"}')))
        .when(n % 5 == 3, F.concat(F.lit('{"cut": '), props, F.lit(" and so on")))
        .otherwise(F.lit("} nothing [1, 2] { here }"))
    )
    return read(spark, sf, "events").select("event_id", last_json_object(noisy).alias("json"))


@query(
    "t5_stream_changes",
    f"""with {BARS5}, l as (select *, lag(open_ts) over w was, lag("close") over w before, lag(contract) over w code from bars window w as (partition by symbol order by open_ts))
    select symbol, open_ts, case when open_ts - was = interval 5 minute and before <> 0 then "close" / before - 1 end "return", coalesce(contract <> code, false) is_roll, case when contract <> code then code end outgoing_contract from l""",
)
def t5(spark, sf):
    """Bars that arrive in four lots by time; each is a batch of its own, taken by a stream that goes on from the last one's checkpoint."""
    root = f"{live._shared(spark)}/changes-{uuid.uuid4().hex}"
    first, last = read(spark, sf, "events").agg(F.min(F.unix_date(F.to_date("ts"))), F.max(F.unix_date(F.to_date("ts")))).first()
    lot = F.floor((F.unix_date(F.to_date("open_ts")) - first) * 4 / (last - first + 1)).cast("int")
    bars5(spark, sf).select("symbol", "open_ts", "close", "contract", "ingest_seq", lot.alias("lot")).write.partitionBy("lot").parquet(f"{root}/bars")
    bars = spark.read.parquet(f"{root}/bars")
    for k in range(4):
        bars.filter(F.col("lot") == k).drop("lot").write.parquet(f"{root}/in/{k}")
        found = changes.run(spark, f"{root}/in", root)
    return found.read().select("symbol", "open_ts", "return", "is_roll", "outgoing_contract")
