"""Contract rolls."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.windows import lagged


def rolls(bars: DataFrame, seq: str = "ingest_seq") -> DataFrame:
    """A row where a series' contract changes: both contracts, the time of the incoming bar, prices unadjusted. The first bar is no roll; an empty incoming contract is none either."""
    coded = bars.withColumn("_code", F.coalesce("contract", F.lit("")))
    marked = lagged(coded, "symbol", "open_ts", (seq,), {"_before": "_code", "_outgoing": "contract"})  # a first row has no code before it
    changed = marked.filter((F.col("_code") != F.col("_before")) & (F.col("_code") != ""))
    return changed.select("symbol", F.col("open_ts").alias("roll_ts"), F.col("open_ts").alias("decision_ts"), F.col("_outgoing").alias("outgoing_contract"), F.col("contract").alias("incoming_contract"), F.lit("unadjusted").alias("adjustment"))
