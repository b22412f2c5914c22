"""Conflict-safe merges of an update into a keyed table, as one null-safe full outer join with a rule for each column."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .dedupe import keep_last

OVERWRITE, KEEP, LEAST = "overwrite", "keep", "least"

#: Column rules of the known tables; columns that aren't named are overwritten.
YIELD_POLICY = {"published_ts": LEAST, "maturity": KEEP, "source": KEEP}
ROLL_POLICY = {"incoming_oi": KEEP, "outgoing_oi": KEEP}


def latest(updates: DataFrame, keys: list[str], seq: str) -> DataFrame:
    return keep_last(updates, keys, [seq])


def merge(base: DataFrame, updates: DataFrame, keys: list[str], policy: dict[str, str] | None = None) -> DataFrame:
    """base with updates merged in; keys are unique on both sides and may be null. Columns are those of base."""
    policy = policy or {}
    b, u = base.withColumn("_in_b", F.lit(True)).alias("b"), updates.withColumn("_in_u", F.lit(True)).alias("u")
    on = [F.col(f"b.{k}").eqNullSafe(F.col(f"u.{k}")) for k in keys]
    out = []
    for c in base.columns:
        old, new = F.col(f"b.{c}"), F.col(f"u.{c}") if c in updates.columns else F.lit(None)
        if c in keys:
            value = F.when(F.col("_in_u"), new).otherwise(old)
        elif c not in updates.columns or policy.get(c) == KEEP:
            value = F.when(F.col("_in_b"), old).otherwise(new)
        elif policy.get(c) == LEAST:
            value = F.least(old, new)
        else:
            value = F.when(F.col("_in_u"), new).otherwise(old)
        out.append(value.alias(c))
    return b.join(u, on, "full_outer").select(*out)


def counters(base: DataFrame, updates: DataFrame, keys: list[str], seq: str) -> DataFrame:
    """One row: received, inserted, updated and duplicates of an update, by null-safe keys."""
    unique = latest(updates, keys, seq)
    on = [F.col(f"u.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys]
    marked = unique.alias("u").join(base.select(*keys).distinct().withColumn("_known", F.lit(True)).alias("b"), on, "left").select("_known")
    n = marked.agg(F.count(F.lit(1)).alias("affected"), F.count("_known").alias("updated"))
    return updates.agg(F.count(F.lit(1)).alias("received")).join(F.broadcast(n)).select("received", (F.col("affected") - F.col("updated")).alias("inserted"), "updated", (F.col("received") - F.col("affected")).alias("duplicates"))  # one row each
