"""Token counts: pre-tokens that are whole tokens count directly, only the rest is merged."""

from __future__ import annotations

import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bpe import whole_token_counter
from .common import table

LIMIT = 1024
VOCABULARY = "byte_bpe_50k.json"
#: Texts are split and counted in groups of about this many characters.
GROUP_CHARS = 1_000_000


def token_counts(df: DataFrame, text: str = "text", into: str = "n_tokens", vocabulary: str | None = None) -> DataFrame:
    """df with the token count of each whole text in a column ``into``.

    Null and empty texts have 0 tokens. Strings of special tokens inside a text count as the library does by default:
    as that one token. Repeated rows are counted alike; an empty table stays empty; a column called ``into`` is replaced,
    others pass through.
    """
    path = vocabulary or public_tokenizers.path(VOCABULARY)
    schema = T.StructType([f for f in df.schema if f.name != into] + [T.StructField(into, T.LongType())])

    def run(batches):
        counter = whole_token_counter(path)
        for batch in batches:
            counts: list[int] = []
            group: list[str | None] = []
            chars = 0
            for t in batch.column(text).to_pylist():
                group.append(t)
                chars += len(t or "")
                if chars > GROUP_CHARS:
                    counts += counter(group)
                    group, chars = [], 0
            counts += counter(group)
            keep = [c for c in batch.schema.names if c != into]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in keep] + [pa.array(counts, pa.int64())], names=[*keep, into])

    return df.mapInArrow(run, schema)


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = token_counts(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return counted.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), "n_tokens", (F.col("n_tokens") > LIMIT).alias("over_limit"))
