"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Modulus and remainder of the held-out fold: crc32(doc_id as text) mod 3 = 1.
FOLDS, HELD_OUT = 3, 1


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % FOLDS == HELD_OUT, F.lit(False))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Only on a local master, and only where the session names none, a temporary one is set."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir names no folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="tessera-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


#: Folders that ``stored`` wrote and nobody has removed, in order.
_STORED: list[str] = []


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it again: lineage ends here, and lost executors cost no recomputation."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return listed(df.sparkSession.read.schema(df.schema).parquet(path), path)


def listed(df: DataFrame, path: str) -> DataFrame:
    """df, read from path, which ``discard`` may remove later."""
    _STORED.append(path)
    return df


def mark() -> int:
    """A place in the order of stored tables, for ``discard``."""
    return len(_STORED)


def discard(spark: SparkSession, since: int, until: int | None = None) -> None:
    """Remove the stored tables from one mark up to another; nothing may read them any more."""
    for path in _STORED[since:until]:
        folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)
    del _STORED[since:until]


def free_name(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have, for columns that come and go."""
    while name in df.columns:
        name = f"_{name}"
    return name


def _hashable(kind: T.DataType) -> bool:
    if isinstance(kind, T.StructType):
        return all(_hashable(f.dataType) for f in kind)
    return _hashable(kind.elementType) if isinstance(kind, T.ArrayType) else not isinstance(kind, (T.MapType, T.VariantType))


def row_hash(df: DataFrame) -> Column:
    """A hash of the whole row; columns with maps, which Spark doesn't hash, count by their JSON."""
    named = {f.name: F.col(f"`{f.name}`") for f in df.schema}
    return F.xxhash64(*[named[f.name] if _hashable(f.dataType) else F.to_json(F.struct(named[f.name])) for f in df.schema])


def let(value: Column, use) -> Column:
    """use(value) with value computed once a row, also where use() refers to it inside a lambda."""
    return F.transform(F.array(value), use)[0]
