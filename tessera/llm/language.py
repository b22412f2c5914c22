"""Language identification: TF-IDF vectors of letter n-grams against several clustered centroids per language, by cosine."""

from __future__ import annotations

import functools
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import held_out, stored, table

#: Hashed n-gram dimensions (a power of two), largest n, centroids per language.
DIMENSIONS, GRAMS, CENTROIDS = 2048, 3, 4
#: Documents per language from which centroids are clustered, at most. Document frequencies come from all rows.
SAMPLE = 1000
#: A document farther from its centroid than all but this share of the centroid's own sample is marked rejected.
REJECT = 0.005
UNKNOWN = "und"
_BLANK = 32


@functools.cache
def _letters() -> np.ndarray:
    """Lower-case code point of each letter of the basic plane, a blank for all else."""
    out = np.full(1 << 16, _BLANK, np.uint32)
    for c in range(1 << 16):
        if not 0xD800 <= c < 0xE000 and chr(c).isalpha():
            low = chr(c).lower()
            out[c] = ord(low) if len(low) == 1 else c
    return out


def term_counts(text: str | None) -> np.ndarray | None:
    """Hashed counts of the n-grams of letters in a whole text, runs of other characters being one blank; None without letters."""
    points = np.frombuffer((text or "").encode("utf-32-le", "surrogatepass"), np.uint32)
    if len(points) and points.max() >= 1 << 16:
        x = np.where(points < 1 << 16, _letters()[points & 0xFFFF], np.array([p if p >= 1 << 16 and chr(p).isalpha() else _BLANK for p in points.tolist()], np.uint32))
    else:
        x = _letters()[points]
    blank = x == _BLANK
    if blank.all():
        return None
    x = x[np.concatenate(([True], ~(blank[1:] & blank[:-1])))]
    shift = np.uint32(32 - DIMENSIONS.bit_length() + 1)
    hashes, h = [], x
    for n in range(GRAMS):
        if n:
            if len(x) <= n:
                break
            h = h[:-1] * np.uint32(0x01000193) + x[n:]
        hashes.append(((h + np.uint32(n)) * np.uint32(2654435761)) >> shift)
    return np.bincount(np.concatenate(hashes), minlength=DIMENSIONS)


class Model(NamedTuple):
    idf: np.ndarray
    centroids: np.ndarray
    languages: list[str]
    limits: np.ndarray


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=-1, keepdims=True), 1e-12)


def vectors(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    return _unit(np.log1p(counts) * idf)


def _clustered(x: np.ndarray, k: int, rounds: int = 15) -> np.ndarray:
    """Spherical k-means, begun from the mean and then, again and again, the vector farthest from all centroids."""
    centroids = _unit(x.mean(axis=0, keepdims=True))
    while len(centroids) < min(k, len(x)):
        centroids = np.vstack([centroids, x[(x @ centroids.T).max(axis=1).argmin()]])
    for _ in range(rounds):
        nearest = (x @ centroids.T).argmax(axis=1)
        centroids = np.vstack([_unit(x[nearest == j].mean(axis=0)) if (nearest == j).any() else centroids[j] for j in range(len(centroids))])
    return centroids


def fit(train: DataFrame, text: str = "text", label: str = "lang", key: str = "doc_id") -> Model:
    """Learn from rows of train with a label and letters. One pass counts document frequencies over all of them and takes a sample by a hash of ``key``, about ``SAMPLE`` rows a label at most."""
    rows = train.filter(F.col(label).isNotNull()).select(F.col(text).alias("text"), F.col(label).cast("string").alias("label"), F.col(key).alias("key"))
    sizes = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return Model(np.zeros(DIMENSIONS), np.zeros((0, DIMENSIONS)), [], np.zeros(0))
    spread = 1 << 30
    share = F.create_map(*[x for lang, n in sizes.items() for x in (F.lit(lang), F.lit(min(spread, int(spread * SAMPLE / n))))])
    rows = rows.withColumn("take", F.coalesce(F.pmod(F.xxhash64("key"), F.lit(spread)) < share[F.col("label")], F.lit(False))).drop("key")

    def run(batches):
        for batch in batches:
            df = np.zeros(DIMENSIONS, np.int64)
            n, langs, sample = 0, [], []
            for t, lang, take in zip(batch.column("text"), batch.column("label").to_pylist(), batch.column("take").to_pylist(), strict=True):
                if (counts := term_counts(t.as_py())) is not None:
                    n += 1
                    df += counts > 0
                    if take:
                        langs.append(lang)
                        sample.append(counts.astype(np.uint32).tobytes())
            size = DIMENSIONS + 1
            yield pa.RecordBatch.from_pydict({"dim": pa.array(np.arange(size, dtype=np.int32)), "n": pa.array(np.append(df, n)), "label": pa.nulls(size, pa.string()), "counts": pa.nulls(size, pa.binary())})
            yield pa.RecordBatch.from_pydict({"dim": pa.nulls(len(langs), pa.int32()), "n": pa.nulls(len(langs), pa.int64()), "label": pa.array(langs, pa.string()), "counts": pa.array(sample, pa.binary())})

    found = stored(rows.mapInArrow(run, "dim int, n long, label string, counts binary"), "language")
    df = np.zeros(DIMENSIONS + 1)
    for r in found.filter("dim is not null").groupBy("dim").agg(F.sum("n").alias("n")).collect():
        df[r["dim"]] = r["n"]
    idf = np.log((1 + df[-1]) / (1 + df[:-1])) + 1
    by_label: dict[str, list[np.ndarray]] = {}
    for r in found.filter("label is not null").select("label", "counts").toLocalIterator():
        by_label.setdefault(r["label"], []).append(np.frombuffer(r["counts"], np.uint32))
    centroids, languages, limits = [], [], []
    for lang in sorted(by_label):
        x = np.array(sorted(by_label[lang], key=lambda c: c.tobytes()), np.float32)
        x = vectors(x, idf)
        for c in _clustered(x, CENTROIDS):
            centroids.append(c)
            languages.append(lang)
        own = np.array(centroids[-min(CENTROIDS, len(x)) :])
        limits += [float(np.quantile((x @ own.T).max(axis=1), REJECT))] * len(own)
    return Model(idf, np.array(centroids).reshape(-1, DIMENSIONS), languages, np.array(limits))


def identify(df: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """df with lang_pred, score (cosine to the nearest centroid, 0 to 1) and rejected.

    Texts that are null or have no letters, and all texts if nothing was learned, are ``und`` with score 0 and
    rejected. A rejected text still names its nearest language. Ties go to the first language by name. Repeated rows are
    judged alike; other columns pass through, columns of these three names are replaced.
    """
    added = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("rejected", T.BooleanType())]
    names = [f.name for f in added]
    schema = T.StructType([f for f in df.schema if f.name not in names] + added)
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = shared.value
        for batch in batches:
            n = batch.num_rows
            lang, score, rejected = np.full(n, UNKNOWN, object), np.zeros(n), np.ones(n, bool)
            at, block = [], []

            def judge():
                if not at or not m.languages:
                    return
                cosine = vectors(np.array(block, np.float32), m.idf) @ m.centroids.T
                best = cosine.argmax(axis=1)
                lang[at] = np.array(m.languages, object)[best]
                score[at] = np.clip(cosine[np.arange(len(at)), best], 0, 1)
                rejected[at] = score[at] < m.limits[best]

            for k, t in enumerate(batch.column(text)):
                if (counts := term_counts(t.as_py())) is not None:
                    at.append(k)
                    block.append(counts)
                if len(at) == 512:
                    judge()
                    at, block = [], []
            judge()
            keep = [c for c in batch.schema.names if c not in names]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in keep] + [pa.array(lang, pa.string()), pa.array(score), pa.array(rejected)], names=[*keep, *names])

    return df.mapInArrow(run, schema)


def op1_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(docs.filter(~held_out()))
    return identify(docs.select("doc_id", "text"), model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "rejected")
