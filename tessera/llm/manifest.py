"""Merkle manifest: leaves of rows, superblocks of several levels reduced task by task, proofs joined of a lower and an upper part."""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import stored, table

FANOUT = 8
#: Levels that one task collapses: a superblock holds FANOUT ** LEVELS nodes.
LEVELS = 4
#: The columns that ``manifest`` makes besides key and group.
MADE = ("leaf", "subroot", "root", "proof")
_NODE = "tree string, index long, depth int, hash string"


def field(value: Column) -> Column:
    """A value so that no two rows run together: ``-`` for null, otherwise its length in UTF-8 bytes, a colon and the value as text."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(*values: Column) -> Column:
    """The hash of a row of values."""
    return F.sha2(F.concat(*map(field, values)), 256)


def folded(start: Column, proof: Column) -> Column:
    """The root that a leaf and its proof lead to; null without a proof."""
    inside = lambda s, h: F.concat(F.substr(s["siblings"], F.lit(1), s["place"] * 64), h, F.substr(s["siblings"], s["place"] * 64 + 1))
    return F.aggregate(proof, start, lambda h, s: F.sha2(inside(s, h), 256))


def _parent(hashes: Sequence[str]) -> str:
    return hashlib.sha256("".join(hashes).encode()).hexdigest()


def _levels(hashes: list[str], depth: int, fanout: int) -> list[list[str]]:
    """The nodes of each level, from the given ones up to ``depth`` levels above."""
    rows = [hashes]
    for _ in range(depth):
        rows.append([_parent(rows[-1][i : i + fanout]) for i in range(0, len(rows[-1]), fanout)])
    return rows


def positions(df: DataFrame, tree: str, order: list[str], name: str) -> DataFrame:
    """df with each row's ``index`` in its tree from 0, in that order, and the tree's ``total``.

    Rows are dealt by ranges of (tree, order), so a large tree is many tasks; an index is that in the range plus the
    rows of the tree in ranges before, one number a range and tree. ``order`` should tell rows apart.
    """
    ranged = stored(df.repartitionByRange(tree, *order).withColumn("_piece", F.spark_partition_id()), name)
    by_tree = Window.partitionBy(tree)
    pieces = ranged.groupBy(tree, "_piece").agg(F.count("*").alias("_n")).select(
        tree,
        "_piece",
        F.coalesce(F.sum("_n").over(by_tree.orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"),
        F.sum("_n").over(by_tree).alias("total"),
    )
    inner = F.row_number().over(Window.partitionBy(tree, "_piece").orderBy(*order))
    return ranged.withColumn("_inner", inner).join(pieces, [tree, "_piece"]).withColumn("index", F.col("_before") + F.col("_inner") - 1).drop("_piece", "_inner", "_before")


def _depth(total: Column, fanout: int) -> Column:
    """How many levels lie above so many nodes."""
    powers = [fanout**k for k in range(63) if fanout**k < 1 << 62]
    return F.size(F.filter(F.array(*[F.lit(p).cast("long") for p in powers]), lambda p: p < total))


def _reduced(nodes: DataFrame, fanout: int, levels: int, name: str) -> list[DataFrame]:
    """The nodes of a forest (tree, index, depth, hash) and, round by round, the roots of their superblocks; in the last one every tree is one node."""
    size = fanout**levels

    def collapse(pdf):
        pdf = pdf.sort_values("index")
        depth = min(levels, int(pdf["depth"].iloc[0]))
        root = _levels(pdf["hash"].tolist(), depth, fanout)[-1][0]
        return pdf.head(1)[["tree"]].assign(index=int(pdf["index"].iloc[0]) // size, depth=int(pdf["depth"].iloc[0]) - depth, hash=root)

    rounds = [nodes]
    deepest = nodes.agg(F.max("depth")).first()[0] or 0
    for _ in range(0, deepest, levels):
        blocks = rounds[-1].select("tree", "index", "depth", "hash").groupBy("tree", F.floor((F.col("index") - F.col("index") % size) / size).alias("block"))
        rounds.append(stored(blocks.applyInPandas(collapse, _NODE), name))
    return rounds


def _proved(nodes: DataFrame, above: DataFrame, fanout: int, levels: int) -> DataFrame:
    """nodes with places and siblings on the way up: those in the superblock, followed by those of its root in ``above`` (tree, index, places, siblings and what else is passed down)."""
    size = fanout**levels
    passed = [f for f in above.schema if f.name not in ("tree", "index", "places", "siblings")]
    nodes_columns = nodes.columns
    schema = T.StructType([*nodes.schema, *passed, T.StructField("places", T.ArrayType(T.IntegerType())), T.StructField("siblings", T.ArrayType(T.StringType()))])

    def prove(below: pa.Table, above: pa.Table) -> pa.Table:
        below = below.sort_by("index")
        n = below.num_rows
        top = above.slice(0, 1).to_pylist()[0]
        rows = _levels(below.column("hash").to_pylist(), min(levels, below.column("depth")[0].as_py()), fanout)[:-1]
        texts = []
        for row in rows:
            runs = [row[a : a + fanout] for a in range(0, len(row), fanout)]
            texts.append(["".join(run[:k] + run[k + 1 :]) for run in runs for k in range(len(run))])
        siblings = [[t[i // fanout**j] for j, t in enumerate(texts)] + top["siblings"] for i in range(n)]
        places = [[i // fanout**j % fanout for j in range(len(texts))] + top["places"] for i in range(n)]
        out = below.select(nodes_columns)
        for f in passed:
            out = out.append_column(f.name, pa.array([top[f.name]] * n, above.schema.field(f.name).type))
        return out.append_column("places", pa.array(places, pa.list_(pa.int32()))).append_column("siblings", pa.array(siblings, pa.list_(pa.string())))

    block = F.floor((F.col("index") - F.col("index") % size) / size)
    return nodes.groupBy("tree", block.alias("b")).cogroup(above.groupBy("tree", F.col("index").alias("b"))).applyInArrow(prove, schema)


def _down(rounds: list[DataFrame], top: DataFrame, fanout: int, levels: int) -> DataFrame:
    """The proofs of the first round's nodes, handed down from ``top``, which has one row a tree."""
    for k in range(len(rounds) - 2, -1, -1):
        passed = [c for c in top.columns if c not in ("tree", "index", "depth", "hash")]
        top = _proved(rounds[k], top.select("tree", "index", *passed), fanout, levels)
    return top


def manifest(
    df: DataFrame,
    columns: Sequence[str] = ("doc_id", "source", "lang", "n_chars", "text"),
    key: str = "doc_id",
    group: str = "lang",
    carry: Sequence[str] = (),
    fanout: int = FANOUT,
    levels: int = LEVELS,
) -> DataFrame:
    """One row for each row of df: key, group, ``leaf`` (hash of the named columns), ``subroot`` of its group, ``root`` and ``proof``, an array of (place, siblings) level by level that ``folded`` takes; and the columns to carry.

    Leaves of a group ascend by key, nulls first, equal keys by leaf; every ``fanout`` consecutive nodes become their
    hash until one is left. The groups' subroots, ordered as text in bytes with null first, become the root likewise. A
    null value is hashed as such and told from an empty one; rows that are repeated are leaves of their own. An empty
    table has no rows and no root. Of df, only the named columns are read, so others may have any name. Key and group
    must not be called like a column that is made; a column to carry that is gives way.
    """
    if {key, group} & set(MADE):
        raise ValueError(f"key and group must not be called {', '.join(MADE)}")
    carry = [c for c in carry if c not in (*MADE, key, group)]
    more = F.struct(F.col(group).alias("group"), *[F.col(c).alias(f"c{i}") for i, c in enumerate(carry)])
    tree = F.coalesce(F.concat(F.lit("1"), F.col(group).cast("string")), F.lit("0"))
    rows = df.select(tree.alias("tree"), F.col(key).alias("key"), leaf(*map(F.col, columns)).alias("hash"), more.alias("more"), F.monotonically_increasing_id().alias("tie"))
    placed = positions(stored(rows, "manifest-rows"), "tree", ["key", "hash", "tie"], "manifest-ranged")
    leaves = stored(placed.select("tree", "index", _depth(F.col("total"), fanout).alias("depth"), "hash", "key", "more"), "manifest-leaves")
    lower = _reduced(leaves, fanout, levels, "manifest-nodes")
    groups = positions(lower[-1].select(F.lit("").alias("all"), F.col("tree").alias("name"), "hash"), "all", ["name"], "manifest-groups")
    upper = _reduced(stored(groups.select(F.col("all").alias("tree"), "index", _depth(F.col("total"), fanout).alias("depth"), "hash", "name"), "manifest-subroots"), fanout, levels, "manifest-upper")
    none = [F.array().cast(f"array<{kind}>").alias(name) for name, kind in (("places", "int"), ("siblings", "string"))]
    roots = upper[-1].select("tree", "index", F.col("hash").alias("root"), *none)
    if len(upper) == 1:  # one group: its subroot is the root
        tops = upper[0].select(F.col("name").alias("tree"), F.lit(0).cast("long").alias("index"), F.col("hash").alias("subroot"), F.col("hash").alias("root"), *none)
    else:
        tops = _down(upper, roots, fanout, levels).select(F.col("name").alias("tree"), F.lit(0).cast("long").alias("index"), F.col("hash").alias("subroot"), "root", "places", "siblings")
    if len(lower) == 1:  # every group is one leaf
        proved = leaves.join(tops.drop("index"), "tree")
    else:
        proved = _down(lower, tops, fanout, levels)
    return proved.select(
        F.col("key").alias(key),
        F.col("more.group").alias(group),
        F.col("hash").alias("leaf"),
        "subroot",
        "root",
        F.zip_with("places", "siblings", lambda p, s: F.struct(p.alias("place"), s.alias("siblings"))).alias("proof"),
        *[F.col(f"more.c{i}").alias(c) for i, c in enumerate(carry)],
    )


def op12_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    lowered = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    chosen = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    tampered = F.when(chosen, leaf(*[lowered if c == "text" else F.col(c) for c in ("doc_id", "source", "lang", "n_chars", "text")]))
    listed = manifest(docs.withColumn("tampered", tampered), carry=["tampered"])
    fold = folded(F.coalesce("tampered", "leaf"), F.col("proof"))
    proof = F.sha2(F.array_join(F.transform("proof", lambda s: s["siblings"]), ""), 256)
    return listed.select("doc_id", "leaf", "subroot", "root", proof.alias("proof_sha256"), fold.alias("folded_root")).withColumn("verified", F.col("folded_root") == F.col("root"))
