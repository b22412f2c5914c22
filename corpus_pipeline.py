"""Corpus preparation: toxicity, near-duplicates, decontamination, personal data, packing.

Each stage takes what its predecessor kept as a Parquet table; its own result is written before the next begins, so a
lost executor costs one stage's tasks at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import decontaminate, packing, pii, simhash, toxicity
from tessera.llm.common import discard, held_out, mark, stored, table


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose score reaches the threshold. The model learns from these documents and the labels, both without the held-out fold."""
    model = toxicity.fit(docs.filter(~held_out()), table(spark, sf_dir, "labels").filter(~held_out()))
    return toxicity.toxicity(docs, model, into="_toxicity").filter(F.col("_toxicity") < toxicity.THRESHOLD).drop("_toxicity")


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of the smallest id of each group of near-duplicates."""
    return simhash.keep_first(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents of which a twentieth or more of the words stand in benchmark windows."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data by its kind; n_chars follows."""
    return pii.redact(docs, model=pii.fitted(docs)).withColumn("n_chars", F.coalesce(F.length("text").cast("long"), F.col("n_chars")))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into sequences."""
    return packing.pack_documents(docs)


STAGES = [
    ("toxicity", without_toxic),
    ("near_duplicates", without_copies),
    ("decontamination", without_benchmark),
    ("personal_data", without_personal_data),
    ("packing", packed),
]

#: A learned filter, graph components and a packer aren't SQL; tests/llm holds each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    first = mark()
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
        discard(spark, first, mark() - 1)  # what the stage read and wrote on its way
    return STAGES[-1][1](spark, docs, sf_dir)
