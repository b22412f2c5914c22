"""Queries of the single operators: projections, joins, aggregates, windows, order, sets, scalars, sources."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import schema as S
from ..functions import timeops as t
from ..functions.windows import lagged, running
from ..operators import bars as B
from ..operators import dedupe
from ..sources import formats
from .views import BARS5, RAW, TICKS, bars5, raw_bars, read, ticks

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str):
    def add(f):
        QUERIES[name] = f
        ORACLE_SQL[name] = sql
        return f

    return add


# sources


@query("s1_paged_bars", f"with {TICKS}, r as (select *, row_number() over (partition by symbol, date_trunc('second', ts) order by seq desc) rn from ticks) select symbol, date_trunc('second', ts) open_ts, price \"open\", volume, 1::bigint trade_count from r where rn = 1")
def s1(spark, sf):
    """Pages of an hour's ticks by symbol, whose bars are read back; of those in one second the last stays."""
    bar = F.struct(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("t"), *[F.col("price").alias(k) for k in "ohlc"], F.col("volume").alias("v"), F.lit(1).alias("n"), F.col("price").alias("vw"))
    pages = ticks(spark, sf).groupBy("symbol", t.floor_minutes(F.col("ts"), 60).alias("page")).agg(F.sort_array(F.collect_list(F.struct("seq", bar.alias("b")))).alias("x"))
    pages = pages.select("symbol", "page", F.to_json(F.struct(F.transform("x", lambda x: x["b"]).alias("bars"), F.lit(None).cast("string").alias("next_page_token"))).alias("payload"))
    return formats.paged_bars(pages).select("symbol", "open_ts", "open", "volume", "trade_count")


@query("s2_candles", f'with {BARS5} select symbol, open_ts, "open", high, low, "close", volume from bars')
def s2(spark, sf):
    c = F.array(F.unix_seconds(F.col("open_ts").cast("timestamp")).cast("double"), *[F.col(k) for k in ("low", "high", "open", "close", "volume")])
    return formats.candles(bars5(spark, sf).groupBy("symbol", F.to_date("open_ts").alias("day")).agg(F.to_json(F.collect_list(c)).alias("payload")))


@query("s3_vintage_observations", "select o_orderpriority symbol, cast(o_orderdate as date) observation_date, cast(o_orderdate as date) vintage_date, o_totalprice \"value\", o_orderdate + interval 1 day available_ts from orders where o_orderkey % 5 <> 0")
def s3(spark, sf):
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    o = F.struct(day.alias("date"), day.alias("realtime_start"), F.when(F.col("o_orderkey") % 5 == 0, ".").otherwise(F.col("o_totalprice").cast("string")).alias("value"))
    p = read(spark, sf, "orders").groupBy(F.col("o_orderpriority").alias("symbol"), F.year("o_orderdate").alias("y"), F.month("o_orderdate").alias("m")).agg(F.to_json(F.struct(F.collect_list(o).alias("observations"))).alias("payload"))
    return formats.vintage_observations(p)


@query("s5_official_series", "select o_orderpriority symbol, cast(o_orderdate as date) observation_date, o_totalprice \"value\" from orders where o_orderkey % 4 <> 3")
def s5(spark, sf):
    n = F.col("o_orderkey") % 4
    sep = F.when(n == 0, ";").when(n == 1, ",").otherwise("\t")
    line = F.concat(F.date_format("o_orderdate", "yyyy-MM-dd"), sep, F.when(n == 3, "k.A.").otherwise(F.col("o_totalprice").cast("string")))
    return formats.official_series(read(spark, sf, "orders").select(F.col("o_orderpriority").alias("symbol"), line.alias("line")))


# projections and filters


@query("p1_conform", "select 'x' || event_type symbol, event_id ingest_seq, \"value\" \"close\", cast(null as double) bid, cast(null as date) trading_date from events")
def p1(spark, sf):
    e = read(spark, sf, "events").select(F.concat(F.lit("x"), "event_type").alias("symbol"), F.col("event_id").alias("ingest_seq"), F.col("value").cast("string").alias("close"), F.lit("?").alias("trading_date"), "props")
    return S.conform(e, S.BARS).select("symbol", "ingest_seq", "close", "bid", "trading_date")


@query("p3_range_filter", "select event_id, ts from events where ts >= timestamp '2024-01-05' and ts < timestamp '2024-01-09 12:00'")
def p3(spark, sf):
    return read(spark, sf, "events").filter((F.col("ts") >= t.moment(datetime(2024, 1, 5))) & (F.col("ts") < t.moment(datetime(2024, 1, 9, 12)))).select("event_id", "ts")


@query("p4_membership", "select c_custkey, c_mktsegment from customer where c_mktsegment in ('HOUSEHOLD', 'MACHINERY')")
def p4(spark, sf):
    return read(spark, sf, "customer").filter(F.col("c_mktsegment").isin("HOUSEHOLD", "MACHINERY")).select("c_custkey", "c_mktsegment")


@query("p5_required_fields", f"with {RAW} select bar_id from raw where \"close\" is not null and high is not null")
def p5(spark, sf):
    return raw_bars(spark, sf).dropna(subset=["close", "high"]).select("bar_id")


@query("p9_research_columns", f"with {BARS5} select symbol, open_ts, \"open\", high, low, \"close\", volume, trade_count, is_partial from bars")
def p9(spark, sf):
    b = bars5(spark, sf)
    return b.select(*[c for c in S.RESEARCH if c in b.columns and c != "vwap"])


@query("p11_select_instruments", "select n_name symbol, case when n_regionkey < 3 then 'alpha' else 'beta' end provider from nation where n_name in ('NATION_1', 'NATION_4') and n_regionkey < 3")
def p11(spark, sf):
    c = read(spark, sf, "nation").select(F.col("n_name").alias("symbol"), F.when(F.col("n_regionkey") < 3, "alpha").otherwise("beta").alias("provider"))
    return S.select_instruments(c, ["nation_1", "Nation_4"], ["ALPHA"])


@query("p12_metadata_overlay", "select n_nationkey, case when n_nationkey % 2 = 0 then 'meta' else 'row' end calendar, case when n_nationkey % 2 = 0 then cast(n_regionkey as varchar) end extra from nation")
def p12(spark, sf):
    meta = F.when(F.col("n_nationkey") % 2 == 0, F.to_json(F.struct(F.lit("meta").alias("calendar"), F.col("n_regionkey").alias("extra")))).otherwise(F.lit("{broken"))
    return S.overlay(read(spark, sf, "nation").select("n_nationkey", F.lit("row").alias("calendar"), meta.alias("metadata_json")), ["calendar", "extra"]).drop("metadata_json")


# joins


@query("j1_enrich", "select c_custkey, n_name, r_name from customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey")
def j1(spark, sf):
    n = read(spark, sf, "nation").join(read(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return read(spark, sf, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "n_name", "r_name")


@query("j3_enrich_other_key", "select s_suppkey, n_name, s_acctbal from supplier join nation on n_nationkey = s_nationkey where s_acctbal > 0")
def j3(spark, sf):
    return read(spark, sf, "supplier").filter("s_acctbal > 0").join(read(spark, sf, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", "n_name", "s_acctbal")


@query("j4_existing_null_safe", f"with {TICKS}, x as (select *, case when seq % 4 = 0 then null else contract end c from ticks) select count(*) n from x a where exists (select 1 from x b where b.price > 40 and a.symbol = b.symbol and a.c is not distinct from b.c and cast(a.ts as date) = cast(b.ts as date))")
def j4(spark, sf):
    x = ticks(spark, sf).withColumns({"c": F.when(F.col("seq") % 4 != 0, F.col("contract")), "day": F.to_date("ts")})
    a, b = x.alias("a"), x.filter("price > 40").select("symbol", "c", "day").distinct().alias("b")
    return a.join(b, (F.col("a.symbol") == F.col("b.symbol")) & F.col("a.c").eqNullSafe(F.col("b.c")) & (F.col("a.day") == F.col("b.day")), "left_semi").agg(F.count("*").alias("n"))


@query("j5_semi_two_keys", "select l_orderkey, l_linenumber, l_quantity from lineitem where (l_partkey, l_suppkey) in (select l_partkey, l_suppkey from lineitem where l_returnflag = 'R')")
def j5(spark, sf):
    li = read(spark, sf, "lineitem")
    return li.join(li.filter("l_returnflag = 'R'").select("l_partkey", "l_suppkey").distinct(), ["l_partkey", "l_suppkey"], "left_semi").select("l_orderkey", "l_linenumber", "l_quantity")


@query("j10_anti", "select c_custkey from customer where not exists (select 1 from orders where o_custkey = c_custkey)")
def j10(spark, sf):
    return read(spark, sf, "customer").join(read(spark, sf, "orders").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti").select("c_custkey")


@query("j12_lookup_missing", "select c_custkey, coalesce(n_name, 'none') n_name from customer left join (select * from nation where n_nationkey % 2 = 0) on c_nationkey = n_nationkey")
def j12(spark, sf):
    return read(spark, sf, "customer").join(read(spark, sf, "nation").filter("n_nationkey % 2 = 0"), F.col("c_nationkey") == F.col("n_nationkey"), "left").select("c_custkey", F.coalesce("n_name", F.lit("none")).alias("n_name"))


@query("j15_nearest", "select p_brand, target, arg_min(p_partkey, struct_pack(d := abs(p_size - target), k := p_partkey)) p_partkey, min(abs(p_size - target)) distance from part, (select unnest([10, 20, 30]) target) where abs(p_size - target) <= 2 group by 1, 2")
def j15(spark, sf):
    p = read(spark, sf, "part").withColumn("target", F.explode(F.array(F.lit(10), F.lit(20), F.lit(30)))).withColumn("distance", F.abs(F.col("p_size") - F.col("target"))).filter("distance <= 2")
    return p.groupBy("p_brand", "target").agg(F.min_by("p_partkey", F.struct("distance", "p_partkey")).alias("p_partkey"), F.min("distance").alias("distance"))


# aggregates


@query("a4_bounds", "select min(ts) first_ts, max(ts) last_ts, count(*) n from events")
def a4(spark, sf):
    return read(spark, sf, "events").agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.count("*").alias("n"))


@query("a5_observed_envelope", f"with {BARS5} select symbol, case when symbol <> 'click' then cast(open_ts as date) end trading_date, min(open_ts) open_ts, max(close_ts) close_ts, count(*) n from bars group by 1, 2")
def a5(spark, sf):
    return bars5(spark, sf).groupBy("symbol", F.when(F.col("symbol") != "click", F.to_date("open_ts")).alias("trading_date")).agg(F.min("open_ts").alias("open_ts"), F.max("close_ts").alias("close_ts"), F.count("*").alias("n"))


@query("a6_rows_per_symbol", "select event_type symbol, count(*) n from events group by 1")
def a6(spark, sf):
    return read(spark, sf, "events").groupBy(F.col("event_type").alias("symbol")).agg(F.count("*").alias("n"))


_PIVOT = ("click", "error", "nothing")


@query("a7_heatmap", "select cast(ts as date) \"day\", " + ", ".join(f"count(*) filter (event_type = '{s}') \"{s}\"" for s in _PIVOT) + " from events group by 1")
def a7(spark, sf):
    return read(spark, sf, "events").groupBy(F.to_date("ts").alias("day")).pivot("event_type", list(_PIVOT)).agg(F.count("event_id")).na.fill(0)


@query("a10_distinct_dates", "select event_type symbol, count(distinct case when event_id % 9 <> 0 then cast(ts as date) end) n_dates from events group by 1")
def a10(spark, sf):
    return read(spark, sf, "events").groupBy(F.col("event_type").alias("symbol")).agg(F.countDistinct(F.when(F.col("event_id") % 9 != 0, F.to_date("ts"))).alias("n_dates"))


@query("a13_revised_flag", "select o_orderkey, o_orderdate > min(o_orderdate) over (partition by o_custkey) is_revised from orders")
def a13(spark, sf):
    return dedupe.revised(read(spark, sf, "orders"), ["o_custkey"], "o_orderdate").select("o_orderkey", "is_revised")


@query("a14_contract_expiry", f"with {TICKS} select symbol, contract, arg_max(case when seq % 3 = 0 then cast(ts as date) end, seq) filter (seq % 3 = 0) expiry from ticks group by 1, 2")
def a14(spark, sf):
    x = ticks(spark, sf).select("symbol", "contract", F.col("ts").alias("open_ts"), F.col("seq").alias("ingest_seq"), F.when(F.col("seq") % 3 == 0, F.to_date("ts")).alias("expiry"))
    return B.contract_expiry(x)


@query("a15_mode", "select l_suppkey, min(l_quantity) usual from (select l_suppkey, l_quantity, count(*) n, max(count(*)) over (partition by l_suppkey) top from lineitem group by 1, 2) where n = top group by 1")
def a15(spark, sf):
    return read(spark, sf, "lineitem").groupBy("l_suppkey").agg(F.expr("mode() WITHIN GROUP (ORDER BY l_quantity)").alias("usual"))


@query("a16_sorted_sets", "select o_orderstatus, string_agg(distinct o_orderpriority, ',' order by o_orderpriority) priorities from orders group by 1")
def a16(spark, sf):
    return read(spark, sf, "orders").groupBy("o_orderstatus").agg(F.array_join(F.sort_array(F.collect_set("o_orderpriority")), ",").alias("priorities"))


@query("a17_conditional_count", "select l_returnflag, count(*) filter (l_discount > 0.05::double) n_high, count(*) n from lineitem group by 1")
def a17(spark, sf):
    return read(spark, sf, "lineitem").groupBy("l_returnflag").agg(F.count_if(F.col("l_discount") > 0.05).alias("n_high"), F.count("*").alias("n"))


@query("a1_skewed_sum", "select l_suppkey % 3 k, cast(sum(l_linenumber) as bigint) total, round(sum(l_extendedprice), 2) price from lineitem group by 1")
def a1(spark, sf):
    return read(spark, sf, "lineitem").groupBy((F.col("l_suppkey") % 3).alias("k")).agg(F.sum("l_linenumber").alias("total"), F.round(F.sum("l_extendedprice"), 2).alias("price"))


# windows


@query("w4_change", "select event_id, case when lag(\"value\") over w <> 0 then \"value\" / lag(\"value\") over w - 1 end change from events window w as (partition by event_type order by ts, event_id)")
def w4(spark, sf):
    e = lagged(read(spark, sf, "events"), "event_type", "ts", ("event_id",), {"before": "value"})
    return e.select("event_id", (F.try_divide("value", "before") - 1).alias("change"))


@query("w7_gap_in_day", "select event_id, epoch_us(ts) - epoch_us(lag(ts) over (partition by event_type, cast(ts as date) order by ts)) gap_us from events")
def w7(spark, sf):
    w = Window.partitionBy("event_type", F.to_date("ts")).orderBy("ts")
    return read(spark, sf, "events").select("event_id", (t.micros(F.col("ts")) - t.micros(F.lag("ts").over(w))).alias("gap_us"))


@query("w9_forward_fill", f"with {RAW} select bar_id, last_value(\"close\" ignore nulls) over (partition by symbol order by bar_id rows unbounded preceding) filled from raw")
def w9(spark, sf):
    return running(raw_bars(spark, sf), "symbol", "bar_id", (), {"filled": ("last", "close")}, F.floor(F.col("bar_id") / 4096)).select("bar_id", "filled")


@query("w11_duplicate_flag", "select l_orderkey, l_linenumber, l_partkey, count(*) over (partition by l_orderkey, l_linenumber) > 1 is_duplicate from lineitem")
def w11(spark, sf):
    return dedupe.flag_duplicates(read(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"]).select("l_orderkey", "l_linenumber", "l_partkey", "is_duplicate")


@query("w12_keep_last", "select l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice from (select *, row_number() over (partition by l_orderkey, l_linenumber order by l_shipdate desc, l_partkey desc, l_suppkey desc, l_extendedprice desc) rn from lineitem) where rn = 1")
def w12(spark, sf):
    li = read(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_shipdate", "l_partkey", "l_suppkey", "l_extendedprice")
    return dedupe.keep_last(li, ["l_orderkey", "l_linenumber"], ["l_shipdate", "l_partkey", "l_suppkey", "l_extendedprice"]).drop("l_shipdate")


@query("w14_group_size", "select o_orderkey, count(*) over (partition by o_custkey) n from orders")
def w14(spark, sf):
    return read(spark, sf, "orders").select("o_orderkey", F.count("*").over(Window.partitionBy("o_custkey")).alias("n"))


# order and limits: the limit is the feature


@query("o2_last_row", "select event_type symbol, max(event_id) event_id, arg_max(\"value\", event_id) last_value from events group by 1")
def o2(spark, sf):
    return read(spark, sf, "events").groupBy(F.col("event_type").alias("symbol")).agg(F.max("event_id").alias("event_id"), F.max_by("value", "event_id").alias("last_value"))


@query("o3_recent", "select event_id, ts, event_type from events order by ts desc, event_id desc limit 50")
def o3(spark, sf):
    return read(spark, sf, "events").select("event_id", "ts", "event_type").orderBy(F.desc("ts"), F.desc("event_id")).limit(50)


# sets


@query("u1_union_by_name", "select n_nationkey k, n_name name, n_regionkey region from nation union all select r_regionkey, r_name, null from region")
def u1(spark, sf):
    a = read(spark, sf, "nation").select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("name"), F.col("n_regionkey").alias("region"))
    return a.unionByName(read(spark, sf, "region").select(F.col("r_name").alias("name"), F.col("r_regionkey").alias("k")), allowMissingColumns=True)


@query("u2_difference", "select c_custkey k from customer except select o_custkey from orders where o_orderstatus = 'F'")
def u2(spark, sf):
    return read(spark, sf, "customer").select(F.col("c_custkey").alias("k")).exceptAll(read(spark, sf, "orders").filter("o_orderstatus = 'F'").select("o_custkey").distinct())


@query("u3_union_distinct", "select l_suppkey k from lineitem where l_quantity < 5 union select s_suppkey from supplier where s_acctbal < 0")
def u3(spark, sf):
    return read(spark, sf, "lineitem").filter("l_quantity < 5").select(F.col("l_suppkey").alias("k")).union(read(spark, sf, "supplier").filter("s_acctbal < 0").select("s_suppkey")).distinct()


# scalars


@query("f1_try_cast", "select event_id, try_cast(case when event_id % 3 = 0 then 'n/a' else cast(event_id as varchar) end as double) x, try_cast(case when event_id % 4 = 0 then 'never' else '2024-01-02' end as date) d from events")
def f1(spark, sf):
    n = F.col("event_id")
    return read(spark, sf, "events").select("event_id", F.when(n % 3 == 0, "n/a").otherwise(n.cast("string")).try_cast("double").alias("x"), F.when(n % 4 == 0, "never").otherwise("2024-01-02").try_cast("date").alias("d"))


@query("f2_floor_ceil", "select event_id, time_bucket(interval 5 minute, ts) f5, time_bucket(interval 15 minute, ts) f15, time_bucket(interval 5 minute, ts + interval 299999999 microsecond) c5 from events")
def f2(spark, sf):
    ts = F.col("ts")
    return read(spark, sf, "events").select("event_id", t.floor_minutes(ts, 5).alias("f5"), t.floor_minutes(ts, 15).alias("f15"), t.ceil_minutes(ts, 5).alias("c5"))


@query("f3_time_parts", "select event_id, cast(minute(ts) % 5 as integer) m5, cast(isodow(ts) - 1 as integer) dow, dayname(ts) dname, time_bucket(interval 5 minute, ts) = ts on_grid from events")
def f3(spark, sf):
    ts = F.col("ts")
    return read(spark, sf, "events").select("event_id", (F.minute(ts) % 5).alias("m5"), F.weekday(ts).alias("dow"), F.date_format(ts, "EEEE").alias("dname"), t.on_boundary(ts, 5).alias("on_grid"))


@query("f4_time_zones", "select o_orderkey, timezone('UTC', timezone('Europe/London', o_orderdate + interval 14 hour)) utc_ts, cast(timezone('America/New_York', timezone('UTC', o_orderdate)) as date) ny_date from orders")
def f4(spark, sf):
    d = F.col("o_orderdate")
    return read(spark, sf, "orders").select("o_orderkey", t.utc_time(t.plus_minutes(d, 840), "Europe/London").alias("utc_ts"), F.to_date(t.local_time(d, "America/New_York")).alias("ny_date"))


@query("f6_generated_slots", "select l_orderkey, l_linenumber, l_partkey, unnest(generate_series(l_shipdate, l_shipdate + interval 10 minute, interval 5 minute)) slot_ts from lineitem where l_quantity = 1")
def f6(spark, sf):
    li = read(spark, sf, "lineitem").filter("l_quantity = 1")
    return li.select("l_orderkey", "l_linenumber", "l_partkey", F.explode(t.grid(F.col("l_shipdate"), t.plus_minutes(F.col("l_shipdate"), 10), 5)).alias("slot_ts"))


@query("f7_across_columns", f"with {RAW} select bar_id, greatest(\"open\", \"close\", low) top, least(\"open\", \"close\", high) bottom from raw")
def f7(spark, sf):
    return raw_bars(spark, sf).select("bar_id", F.greatest("open", "close", "low").alias("top"), F.least("open", "close", "high").alias("bottom"))


@query("f11_strings", "select p_partkey, upper(trim(replace(p_name, ' ', '_'))) u, regexp_replace(p_brand, '[^0-9]+', '', 'g') num, split_part(p_type, ' ', 1) head, p_name like '%ring%' is_ring from part")
def f11(spark, sf):
    return read(spark, sf, "part").select("p_partkey", F.upper(F.trim(F.replace("p_name", F.lit(" "), F.lit("_")))).alias("u"), F.regexp_replace("p_brand", "[^0-9]+", "").alias("num"), F.split_part("p_type", F.lit(" "), F.lit(1)).alias("head"), F.col("p_name").like("%ring%").alias("is_ring"))


@query("f12_json", "select event_id, cast(regexp_extract(props, '(-?[0-9]+)', 1) as bigint) k from events")
def f12(spark, sf):
    return read(spark, sf, "events").select("event_id", F.get_json_object("props", "$.k").try_cast("bigint").alias("k"))


@query("f14_sha256", "select o_orderkey, sha256(cast(o_orderkey as varchar) || '|' || o_orderpriority) digest from orders")
def f14(spark, sf):
    return read(spark, sf, "orders").select("o_orderkey", F.sha2(F.concat_ws("|", F.col("o_orderkey").cast("string"), "o_orderpriority"), 256).alias("digest"))


@query("f16_case_least", "select o_orderkey, case when o_totalprice > 200000 then 'large' when o_totalprice > 50000 then 'mid' else 'small' end size, least(o_orderdate, timestamp '1998-01-01') d, coalesce(nullif(o_orderstatus, 'P'), 'pending') status from orders")
def f16(spark, sf):
    p = F.col("o_totalprice")
    return read(spark, sf, "orders").select("o_orderkey", F.when(p > 200000, "large").when(p > 50000, "mid").otherwise("small").alias("size"), F.least("o_orderdate", t.moment(datetime(1998, 1, 1))).alias("d"), F.coalesce(F.nullif("o_orderstatus", F.lit("P")), F.lit("pending")).alias("status"))
