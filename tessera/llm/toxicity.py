"""Toxicity by non-negative positive-unlabelled learning: a linear numpy model from confirmed toxic texts and unlabelled ones."""

from __future__ import annotations

import re
from collections.abc import Iterable
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import held_out, stored, table

#: Confirmed and unlabelled rows that the weights are fitted on, at most about. Class prior: over all labelled rows of the fold.
POSITIVES, UNLABELLED = 6_000, 20_000
#: Hashed features, those that are kept, and what a kept one needs: positives that have it, and standard errors above chance.
HASHED, KEPT, SUPPORT, LIFT = 1 << 20, 4_096, 4, 4.0
#: A word's beginnings of these lengths are features beside the word.
STEMS = (4, 5, 6)
ROUNDS, RATE, DECAY = 400, 0.1, 1e-4
THRESHOLD = 0.7
WORD = re.compile(r"[^\W\d_]+")
REMEMBERED = 200_000
#: Texts whose features are counted at once.
TOGETHER = 250
#: Range of the hash that draws rows; rows of a batch that a counting task sends; ids of confirmed documents up to which they are broadcast.
SPREAD, SENT, BROADCAST_IDS = 1 << 30, 1 << 16, 1_000_000
#: Rows of the sample that are worked through at once in training.
AT_ONCE = 2_048


#: A feature also counts by how many distinct words of a text have it (at least), and by which share of them; the first level is the feature itself.
LEVELS = ((1, 0.0), (2, 0.0), (3, 0.0), (2, 0.005), (2, 0.01), (2, 0.02))


def features(word: str) -> tuple[int, ...]:
    names = [word, *[f"{word[:n]}*" for n in STEMS if len(word) > n]]
    return tuple(xxhash.xxh32_intdigest(x) % HASHED for x in names)


def words(text: str | None) -> set[str]:
    return set(WORD.findall((text or "").lower()))


class Lookup(dict):
    """Word to its features, those of ``wanted`` only where it is given; words are remembered from text to text."""

    def __init__(self, wanted: set[int] | None = None):
        super().__init__()
        self.wanted = wanted

    def __missing__(self, word: str) -> tuple[int, ...]:
        found = features(word)
        if self.wanted is not None:
            found = tuple(f for f in found if f in self.wanted)
        if len(self) < REMEMBERED:
            self[word] = found
        return found

    def levels(self, text: str | None) -> np.ndarray:
        """Feature times the number of levels plus level, for each level that the text reaches."""
        found = words(text)
        flat = [f for x in map(self.__getitem__, found) if x for f in x]
        if not flat:
            return np.array([], np.int64)
        k, n = np.unique(np.array(flat, np.int64), return_counts=True)
        return np.concatenate([k[(n >= least) & (n >= share * len(found))] * len(LEVELS) + i for i, (least, share) in enumerate(LEVELS)])


class Model(NamedTuple):
    kept: dict[int, int]
    weights: np.ndarray
    bias: float


def _sums(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    total = np.concatenate(([0.0], np.cumsum(values)))
    return total[starts[1:]] - total[starts[:-1]]


def train(rows: Iterable[tuple[bool, np.ndarray]], size: int, prior: float, rounds: int = ROUNDS) -> tuple[np.ndarray, float]:
    """Weights and bias that minimise the non-negative risk prior R_p+ + max(0, R_u- - prior R_p-), logistic loss, by Adam.

    Where the corrected negative part is below zero, the step goes up its gradient instead, as the estimator asks.
    """
    positive, features, sizes = [], [], [0]
    for p, f in rows:
        positive.append(p)
        features.append(np.asarray(f, np.int32))
        sizes.append(len(f))
    positive, starts = np.array(positive, bool), np.cumsum(sizes)
    flat = np.concatenate(features) if features else np.array([], np.int32)
    del features
    w, b = np.zeros(size), 0.0
    if not positive.any() or positive.all():
        return w, -10.0
    n_p, n_u = positive.sum(), (~positive).sum()
    blocks = [(k, min(k + AT_ONCE, len(positive))) for k in range(0, len(positive), AT_ONCE)]  # what is worked out for every feature of a row is only ever held for a block
    m, v = np.zeros(size + 1), np.zeros(size + 1)
    for step in range(1, rounds + 1):
        g = np.concatenate([_sums(w[flat[starts[i] : starts[j]]], starts[i : j + 1] - starts[i]) for i, j in blocks]) + b
        s = 1 / (1 + np.exp(-np.clip(g, -30, 30)))
        loss = np.logaddexp(0, g)  # of saying "clean"
        negative = loss[~positive].mean() - prior * loss[positive].mean()
        d_negative = np.where(positive, -prior * s / n_p, s / n_u)
        d_positive = np.where(positive, prior * (s - 1) / n_p, 0)
        d = d_positive + d_negative if negative >= 0 else -d_negative
        gradient = np.append(DECAY * w, d.sum())
        for i, j in blocks:
            gradient[:-1] += np.bincount(flat[starts[i] : starts[j]], np.repeat(d[i:j], np.diff(starts[i : j + 1])), size)
        m = 0.9 * m + 0.1 * gradient
        v = 0.999 * v + 0.001 * gradient**2
        move = RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        w, b = w - move[:-1], b - move[-1]
    return w, b


def _drawn(id: str, salt: int, share: float):
    """Whether a row is drawn, by a hash of its id; rows without an id are told apart by their place."""
    own = F.when(F.col(id).isNull(), F.monotonically_increasing_id())
    return F.pmod(F.xxhash64(id, own, F.lit(salt)), F.lit(SPREAD)) < min(SPREAD, int(SPREAD * share))


def document_frequencies(docs: DataFrame, text: str) -> DataFrame:
    """(k, n): in how many rows each feature at each level occurs, over all rows. A task counts in an array of fixed size and sends what isn't zero."""

    def count(batches):
        look, total = Lookup(), np.zeros(HASHED * len(LEVELS), np.int32)
        for batch in batches:
            column = batch.column(0)
            for at in range(0, batch.num_rows, TOGETHER):
                seen = [look.levels(t.as_py()) for t in column.slice(at, TOGETHER)]
                k, n = np.unique(np.concatenate(seen), return_counts=True)
                total[k] += n.astype(np.int32)
        k = np.flatnonzero(total)
        for at in range(0, len(k), SENT):
            part = k[at : at + SENT]
            yield pa.RecordBatch.from_pydict({"k": part, "n": total[part].astype(np.int64)})

    return docs.select(text).mapInArrow(count, "k long, n long").groupBy("k").agg(F.sum("n").alias("n"))


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", id: str = "doc_id", label: str = "toxic", positives: int = POSITIVES, unlabelled: int = UNLABELLED) -> Model:
    """Learn from docs and labels, both already without held-out rows.

    Unlabelled text is drawn from all of docs, confirmed documents included, so its share of toxic text is that of the
    corpus, which the class prior stands for. Features are chosen by their document frequencies over all confirmed and
    over all other documents. Only the rows that the weights are fitted on are samples, drawn by a hash of the id: about
    ``positives`` confirmed and ``unlabelled`` documents at most. Null labels and ids, and labels without a document,
    count for nothing; repeated labels count once, repeated documents each.
    """
    known = labels.filter(F.col(id).isNotNull() & F.col(label).isNotNull()).select(F.col(id).alias("id"), (F.col(label) == 1).alias("toxic"))
    n, n_toxic = known.agg(F.count("*"), F.coalesce(F.sum(F.col("toxic").cast("long")), F.lit(0))).first()
    none = Model({}, np.zeros(0), -10.0)
    if not n_toxic:
        return none
    prior = n_toxic / n
    rows = docs.select(F.col(id).alias("id"), F.col(text).alias("text"))
    ids = known.filter("toxic").select("id").distinct()
    confirmed = rows.join(F.broadcast(ids) if n_toxic <= BROADCAST_IDS else ids, "id", "left_semi")
    confirmed = stored(confirmed, "toxicity-confirmed")
    n_p, n_u = confirmed.count(), rows.count()
    if not n_p or not n_u:
        return none
    p, u, n_rest = F.col("p"), F.col("u"), max(1, n_u - n_p)  # the confirmed are among all; they are compared with the others
    chance = u / F.lit(n_u)
    lift = (p / F.lit(n_p) - (u - p) / F.lit(n_rest)) / F.sqrt(chance * (1 - chance) * F.lit(1 / n_p + 1 / n_rest) + 1e-12)
    counted = document_frequencies(confirmed, "text").filter(F.col("n") >= SUPPORT).withColumnRenamed("n", "p").join(document_frequencies(rows, "text").withColumnRenamed("n", "u"), "k")
    best = counted.withColumn("lift", lift).filter(F.col("lift") >= LIFT).orderBy(F.desc("lift"), "k").limit(KEPT).select("k").collect()
    kept = {r["k"]: i for i, r in enumerate(best)}

    def extract(batches):
        look = Lookup({k // len(LEVELS) for k in kept})
        for batch in batches:
            found = [np.array(sorted(kept[k] for k in look.levels(t.as_py()).tolist() if k in kept), "<u2").tobytes() for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("positive"), pa.array(found, pa.binary())], names=["positive", "f"])

    sample = confirmed.filter(_drawn("id", 0, positives / n_p)).select("text", F.lit(True).alias("positive"))
    sample = sample.unionAll(rows.filter(_drawn("id", 1, unlabelled / n_u)).select("text", F.lit(False).alias("positive")))
    drawn = sorted((r["positive"], bytes(r["f"])) for r in sample.mapInArrow(extract, "positive boolean, f binary").toLocalIterator())
    weights, bias = train(((p, np.frombuffer(f, "<u2")) for p, f in drawn), len(kept), prior)
    return Model(kept, weights, float(bias))


def toxicity(df: DataFrame, model: Model, text: str = "text", into: str = "toxicity") -> DataFrame:
    """df with the score of each whole text, 0 to 1, in ``into``.

    Null and empty texts have the score of a text without any kept feature. Repeated rows are scored alike; other
    columns pass through; a column of the name ``into`` is replaced.
    """
    schema = T.StructType([f for f in df.schema if f.name != into] + [T.StructField(into, T.DoubleType())])
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = shared.value
        look = Lookup({k // len(LEVELS) for k in m.kept})
        weight = {k: float(m.weights[i]) for k, i in m.kept.items()}
        for batch in batches:
            g = np.array([m.bias + sum(weight.get(k, 0.0) for k in look.levels(t.as_py()).tolist()) for t in batch.column(text)], np.float64)
            keep = [c for c in batch.schema.names if c != into]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in keep] + [pa.array(1 / (1 + np.exp(-np.clip(g, -30, 30))))], names=[*keep, into])

    return df.mapInArrow(run, schema)


def fitted(spark: SparkSession, sf_dir: str) -> Model:
    return fit(table(spark, sf_dir, "documents").filter(~held_out()), table(spark, sf_dir, "labels").filter(~held_out()))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = toxicity(table(spark, sf_dir, "documents").select("doc_id", "text"), fitted(spark, sf_dir), into="score")
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
