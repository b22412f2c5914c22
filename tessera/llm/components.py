"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, mark, stored


def _forest(edges: DataFrame) -> DataFrame:
    """A spanning forest of each partition's edges, batch by batch: the same components from at most as many edges as nodes."""

    def run(batches):
        for batch in batches:
            a, b = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("a", "b"))
            nodes, at = np.unique(np.concatenate((a, b)), return_inverse=True)
            parent = list(range(len(nodes)))

            def root(x):
                while parent[x] != x:
                    parent[x] = x = parent[parent[x]]
                return x

            for x, y in zip(at[: len(a)].tolist(), at[len(a) :].tolist(), strict=True):
                if (x := root(x)) != (y := root(y)):
                    parent[max(x, y)] = min(x, y)
            roots = np.array([root(x) for x in range(len(nodes))], np.int64)
            far = roots != np.arange(len(nodes))
            yield pa.RecordBatch.from_pydict({"a": nodes[roots[far]] if len(nodes) else np.array([], np.int64), "b": nodes[far] if len(nodes) else np.array([], np.int64)})

    return edges.mapInArrow(run, "a long, b long")


#: A node with at least one in so many edges is looked up by broadcast, so there are at most twice as many such nodes.
HUB = 10_000


def _with_least(edges: DataFrame, least: DataFrame, n_edges: int) -> DataFrame:
    """edges(u, v) with m of least(u, m, n), n being the edges of u. Edges of hubs stay where they are; the rest is dealt by node."""
    hubs = F.broadcast(least.filter(F.col("n") * HUB >= n_edges).select("u", "m"))
    rest = least.filter(F.col("n") * HUB < n_edges).select("u", "m")
    return edges.join(hubs, "u").unionByName(edges.join(hubs, "u", "left_anti").join(rest, "u"))


def connected_components(edges: DataFrame, rounds: int = 100) -> DataFrame:
    """(node, root) for every node of edges(a long, b long); root is the smallest node of its component.

    Each round's edges are written to the shared folder. The least neighbour of a node is combined before the shuffle;
    the edges of nodes with very many of them are not gathered, as those nodes are few enough to be broadcast. Repeated
    edges count once, and an empty table gives an empty result.
    """
    spark, first = edges.sparkSession, mark()
    now = stored(_forest(edges.select("a", "b")).distinct(), "components")
    seen = None
    for _ in range(rounds):
        n_edges = now.count()
        # large star: neighbours above a node go to the least around it
        both = now.select(F.col("a").alias("u"), F.col("b").alias("v")).union(now.select("b", "a"))
        least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"), F.count("*").alias("n"))
        large = _with_least(both.filter("v > u"), least, n_edges).select(F.col("m").alias("a"), F.col("v").alias("b")).filter("a < b").distinct()
        large = stored(large, "components-large")
        # small star: a node and its neighbours below it go to the least of them
        low = large.groupBy(F.col("b").alias("u")).agg(F.min("a").alias("m"), F.count("*").alias("n"))
        small = _with_least(large.select(F.col("b").alias("u"), F.col("a").alias("v")), low, n_edges).withColumnRenamed("v", "a")
        now = stored(small.select(F.col("m").alias("x"), F.col("a").alias("y")).union(small.select("m", "u")).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).filter("a < b").distinct(), "components")
        discard(spark, first, mark() - 1)  # all but the newest edges
        state = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if state == seen:
            break
        seen = state
    else:
        raise RuntimeError("components: no fixed point")
    stars = now.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("root"))
    return stars.union(stars.select(F.col("root").alias("node"), "root").distinct())
