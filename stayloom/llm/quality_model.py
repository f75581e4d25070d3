"""Quality classifier: random-indexing vectors pooled per document, a two-layer network, a calibrated temperature."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stayloom.llm import textkit as K

WORD_BUCKETS, MARK_BUCKETS, DIMENSION, NONZERO = 896, 128, 32, 4
REACH = 2
TRAINING_ROWS = 20_000
HIDDEN, EPOCHS, RATE, DECAY, SEED = 24, 400, 0.02, 1e-4, 7
CUT = 0.3
BUCKETS = WORD_BUCKETS + MARK_BUCKETS
FEATURES = 2 * DIMENSION + 3


def unit_buckets(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    owner, value, mark = K.units(column)
    return owner, np.where(mark, WORD_BUCKETS + value % np.uint64(MARK_BUCKETS), value % np.uint64(WORD_BUCKETS)).astype(np.int64)


def index_vectors() -> np.ndarray:
    """The sparse random +-1 vector of each bucket; fixed by hash."""
    spots = K.mix(np.arange(BUCKETS * NONZERO, dtype=np.uint64) + np.uint64(K.GRAM_BASE)).reshape(BUCKETS, NONZERO)
    out = np.zeros((BUCKETS, DIMENSION))
    for i in range(NONZERO):
        np.add.at(out, (np.arange(BUCKETS), (spots[:, i] >> np.uint64(8)) % np.uint64(DIMENSION)), np.where(spots[:, i] & np.uint64(1), 1.0, -1.0))
    return out


def context_vectors(docs: DataFrame) -> np.ndarray:
    """Sum of the index vectors of each bucket's neighbours within two places over all texts, scaled to length 1.

    A task sums its own texts; what it hands on, and what reaches the driver, is one row per bucket.
    """
    names = [f"c{i}" for i in range(DIMENSION)]

    def count(batches):
        near = np.zeros(BUCKETS * BUCKETS, np.int64)
        for part in K.slices(batches, "text"):
            owner, bucket = unit_buckets(part.column("text"))
            for step in range(1, REACH + 1):
                both = owner[step:] == owner[:-step]
                near += np.bincount(bucket[:-step][both] * BUCKETS + bucket[step:][both], minlength=BUCKETS * BUCKETS)
        square = near.reshape(BUCKETS, BUCKETS)
        total = (square + square.T).astype(float) @ index_vectors()
        yield pa.RecordBatch.from_pydict({"bucket": np.arange(BUCKETS, dtype=np.int32), **{n: total[:, i] for i, n in enumerate(names)}})

    schema = "bucket int, " + ", ".join(f"{n} double" for n in names)
    summed = K.map_arrow(docs, count, schema).groupBy("bucket").agg(*[F.sum(n).alias(n) for n in names]).collect()
    out = np.zeros((BUCKETS, DIMENSION))
    for row in summed:
        out[row[0]] = row[1:]
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)


def pooled(column: pa.Array, vectors: np.ndarray) -> np.ndarray:
    """One row per text: mean context and index vector, log length, share of distinct buckets, share of the commonest."""
    owner, bucket = unit_buckets(column)
    n = len(column)
    out = np.zeros((n, FEATURES))
    ends = np.searchsorted(owner, np.arange(n + 1))
    for first in range(0, n, 1024):
        last = min(first + 1024, n)
        span = slice(ends[first], ends[last])
        counts = np.bincount((owner[span] - first) * BUCKETS + bucket[span], minlength=(last - first) * BUCKETS).reshape(-1, BUCKETS)
        total = counts.sum(1)
        share = counts / np.maximum(total, 1)[:, None]
        out[first:last] = np.column_stack([share @ vectors, np.log1p(total), (counts > 0).sum(1) / np.maximum(total, 1), share.max(1)])
    return out


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -50, 50)))


@dataclass
class Network:
    """Standardised inputs, one hidden layer of tanh units, one logit, and a temperature that divides it."""

    mean: np.ndarray
    scale: np.ndarray
    layers: list[np.ndarray]
    temperature: float = 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        w1, b1, w2, b2 = self.layers
        return np.tanh((x - self.mean) / self.scale @ w1 + b1) @ w2 + b2

    def score(self, x: np.ndarray) -> np.ndarray:
        return sigmoid(self.logits(x) / self.temperature)


def train(x: np.ndarray, y: np.ndarray, calibration: np.ndarray) -> Network:
    """Adam on the cross-entropy of the rows not set apart for calibration; then the temperature on those set apart."""
    rng = np.random.default_rng(SEED)
    fit = ~calibration if (~calibration).any() else np.ones(len(y), bool)
    net = Network(x[fit].mean(0), x[fit].std(0) + 1e-6, [rng.normal(0, x.shape[1] ** -0.5, (x.shape[1], HIDDEN)), np.zeros(HIDDEN),
                                                        rng.normal(0, HIDDEN ** -0.5, HIDDEN), np.zeros(1)])
    z, target = (x[fit] - net.mean) / net.scale, y[fit]
    first, second = [np.zeros_like(w) for w in net.layers], [np.zeros_like(w) for w in net.layers]
    for step in range(1, EPOCHS + 1):
        w1, b1, w2, b2 = net.layers
        hidden = np.tanh(z @ w1 + b1)
        error = (sigmoid(hidden @ w2 + b2) - target) / len(target)
        back = np.outer(error, w2) * (1 - hidden ** 2)
        slopes = [z.T @ back + DECAY * w1, back.sum(0), hidden.T @ error + DECAY * w2, error.sum(keepdims=True)]
        for w, g, m, v in zip(net.layers, slopes, first, second):
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            w -= RATE * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-8)
    if calibration.any():
        logit, truth = net.logits(x[calibration]), y[calibration]
        heat = np.geomspace(0.25, 8, 61)
        loss = [-np.mean(np.log(np.clip(np.where(truth == 1, sigmoid(logit / t), 1 - sigmoid(logit / t)), 1e-9, 1))) for t in heat]
        net.temperature = float(heat[int(np.argmin(loss))])
    return net


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))


def fit(docs: DataFrame, labels: DataFrame, rows: int = TRAINING_ROWS) -> tuple[np.ndarray, Network | float]:
    """Vectors from every text, and the network from at most ``rows`` labelled documents whose crc32 modulo 5 is not 0.

    Those with the smallest id hashes are taken, so the sample does not depend on order or partitions; rows whose crc32 modulo 5
    is 1 calibrate. Labels other than 0 and 1 are ignored; of several labels of an id the smallest counts. Without both
    labels among the rows a plain rate takes the network's place.
    """
    docs = _texts(docs)
    vectors = np.column_stack([context_vectors(docs), index_vectors() / NONZERO])
    known = labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
    known = known.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & (K.bucket_of(F.col("doc_id"), 5) != 0))
    known = known.groupBy("doc_id").agg(F.min("quality").alias("quality")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)

    def features(batches):
        for part in K.slices(batches, "text"):
            x = pooled(part.column("text"), vectors)
            yield pa.RecordBatch.from_pydict({"doc_id": part.column("doc_id"), "quality": part.column("quality"), "part": part.column("part"),
                                              "x": pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), FEATURES).cast(pa.list_(pa.float64()))})

    sample = docs.join(F.broadcast(known), "doc_id").select("doc_id", "text", "quality", K.bucket_of(F.col("doc_id"), 5).alias("part"))
    taken = K.map_arrow(sample, features, "doc_id bigint, quality int, part bigint, x array<double>").dropDuplicates(["doc_id"]).toPandas()
    taken = taken.sort_values("doc_id")
    y = taken["quality"].to_numpy(float)
    if len(set(y)) < 2:
        return vectors, float(y.mean()) if len(y) else 0.5
    return vectors, train(np.array(taken["x"].tolist()), y, taken["part"].to_numpy() == 1)


def quality_scores(docs: DataFrame, labels: DataFrame, rows: int = TRAINING_ROWS) -> DataFrame:
    """doc_id, held_out, score (0 to 1, higher: label 1 likelier) and predicted (score >= 0.3) for every row of ``docs``.

    Only the whole text is an input of the score. NULL and empty texts are scored as texts without units; rows with a NULL or
    repeated id are scored one by one; other columns are ignored.
    """
    vectors, model = fit(docs, labels, rows)

    def score(batches):
        for part in K.slices(batches, "text"):
            x = pooled(part.column("text"), vectors)
            value = np.full(len(x), model) if isinstance(model, float) else model.score(x)
            yield pa.RecordBatch.from_pydict({"doc_id": part.column("doc_id"), "held_out": part.column("held_out"), "score": value,
                                              "predicted": (value >= CUT).astype(np.int32)})

    texts = _texts(docs).withColumn("held_out", K.bucket_of(F.col("doc_id"), 5) == 0)
    return K.map_arrow(texts, score, "doc_id bigint, held_out boolean, score double, predicted int")


def keep_good(docs: DataFrame, labels: DataFrame, rows: int = TRAINING_ROWS) -> DataFrame:
    """The rows of ``docs``, all columns, whose text scores at least 0.3; same model and inputs as ``quality_scores``."""
    vectors, model = fit(docs, labels, rows)

    def choose(batches):
        for part in K.slices(batches, "doc.text"):
            x = pooled(K.field(part, "doc.text"), vectors)
            value = np.full(len(x), model) if isinstance(model, float) else model.score(x)
            yield part.filter(pa.array(value >= CUT))

    packed = docs.select(K.pack(docs))
    return K.map_arrow(packed, choose, packed.schema).select("doc.*")
