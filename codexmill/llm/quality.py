"""Quality classifier: random-indexing word vectors and a small numpy network.

Every word has a sparse random index vector of its own, drawn from its hash. Words that
make up at least SHARE of the corpus also have a context vector, the sum of the index
vectors found beside them over all texts. SHARE bounds their number by 1 / SHARE at any
size of the corpus; rarer words serve as contexts and are counted as rare. A document is
the mean and the spread of its words' context vectors. A network with one hidden layer
reads these; its logits are divided by a temperature fitted on labelled rows that the
weights were not.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_of
from .toxicity import fold, sampled_labels

DIMS, WINDOW, NONZERO = 32, 2, 2
#: Share of all words that a word with a vector of its own makes up at least; 1 / SHARE words at most do.
SHARE = 4e-6
#: Distinct words that a task counts before it hands on its counts.
COUNTED = 500_000
#: Words of one row of a task's partial sums.
CHUNK = 1024
#: Lanes that partial sums are added up in, level by level.
LANES = (1024, 32, 1)
#: Labelled documents of either class to learn from, at most.
PER_CLASS = 12_000
HIDDEN, EPOCHS = 32, 60
THRESHOLD = 0.3
#: Characters that are turned into arrays at a time.
STRIDE = 2_000_000


def index_vectors(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions and signs of the nonzero components of each word's index vector, from the bits of its hash."""
    bits = np.stack([(words >> np.uint64(24 * k)) & np.uint64(0xFFFFFF) for k in range(NONZERO)], axis=1).astype(np.int64)
    return (bits >> 1) % DIMS, 1 - 2 * (bits & 1)


def strides(texts: list[str]) -> Iterator[tuple[int, int]]:
    """Slices of the list of about STRIDE characters each."""
    start = size = 0
    for i, text in enumerate(texts):
        size += len(text)
        if size >= STRIDE:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def words_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all words in order, and how many each text has."""
    split = [t.split() for t in texts]
    words = np.array([w for ws in split for w in ws], dtype=object)
    hashed = pd.util.hash_array(words, categorize=False) if len(words) else np.zeros(0, np.uint64)
    return hashed, np.array([len(ws) for ws in split], dtype=np.int64)


def word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, n) by hash, summed within the task as far as memory goes."""
    held: list[tuple[np.ndarray, np.ndarray]] = []

    def summed() -> tuple[np.ndarray, np.ndarray]:
        words, at = np.unique(np.concatenate([w for w, _ in held]), return_inverse=True)
        return words, np.bincount(at, np.concatenate([n for _, n in held]), len(words)).astype(np.int64)

    for batch in batches:
        texts = batch["text"].to_pylist()
        for a, b in strides(texts):
            held.append(np.unique(words_of(texts[a:b])[0], return_counts=True))
            if sum(len(w) for w, _ in held) > 2 * COUNTED:
                held = [summed()]
                if len(held[0][0]) > COUNTED:
                    yield pa.RecordBatch.from_pydict({"word": held[0][0].view(np.int64), "n": held[0][1]})
                    held = []
    if held:
        words, n = summed()
        yield pa.RecordBatch.from_pydict({"word": words.view(np.int64), "n": n})


def known_words(docs: DataFrame, share: float = SHARE) -> np.ndarray:
    """The sorted hashes of the words that make up ``share`` of all words at least: 1 / share at most."""
    counts = docs.select(text_of().alias("text")).mapInArrow(word_counts, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).persist()
    total = counts.agg(F.sum("n")).first()[0] or 0
    rows = counts.filter(F.col("n") >= share * total).select("word").collect()
    counts.unpersist()
    return np.sort(np.array([r[0] for r in rows], dtype=np.int64).view(np.uint64))


def places(words: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Where each word stands among the known ones; their number for the others."""
    at = np.searchsorted(known, words)
    return np.where(known[np.minimum(at, len(known) - 1)] == words, at, len(known)) if len(known) else np.zeros(len(words), dtype=np.int64)


def contexts(batches: Iterator[pa.RecordBatch], known: np.ndarray) -> Iterator[pa.RecordBatch]:
    """This task's sums of neighbouring index vectors, a row for each chunk of known words."""
    n = -(-(len(known) + 1) // CHUNK) * CHUNK
    total = np.zeros(n * DIMS, dtype=np.int64)
    for batch in batches:
        texts = batch["text"].to_pylist()
        for a, b in strides(texts):
            words, lengths = words_of(texts[a:b])
            at, (positions, signs) = places(words, known) * DIMS, index_vectors(words)
            doc = np.repeat(np.arange(len(lengths)), lengths)
            for step in range(1, WINDOW + 1):
                same = doc[step:] == doc[:-step]
                for own, other in ((slice(None, -step), slice(step, None)), (slice(step, None), slice(None, -step))):
                    row = at[own][same]
                    for k in range(NONZERO):
                        np.add.at(total, row + positions[other, k][same], signs[other, k][same])
    total[len(known) * DIMS :] = 0
    rows = total.reshape(-1, CHUNK * DIMS)
    some = [k for k in range(len(rows)) if rows[k].any()]
    lane = TaskContext.get().partitionId()
    yield pa.RecordBatch.from_pydict({"chunk": pa.array(some, pa.int32()), "lane": pa.array([lane] * len(some), pa.int32()), "sums": pa.array([zlib.compress(rows[k].tobytes(), 1) for k in some], pa.binary())})


def added(table: pa.Table) -> pa.Table:
    total = np.zeros(CHUNK * DIMS, dtype=np.int64)
    for sums in table["sums"]:
        total += np.frombuffer(zlib.decompress(sums.as_py()), dtype=np.int64)
    return pa.table({"chunk": table["chunk"].slice(0, 1), "lane": table["lane"].slice(0, 1), "sums": pa.array([zlib.compress(total.tobytes(), 1)], pa.binary())})


def word_vectors(docs: DataFrame, known: np.ndarray) -> np.ndarray:
    """A unit vector for each known word, learned from all texts.

    Partial sums, each of a fixed size, meet in levels of fewer and fewer lanes, so no
    task adds up more than a small share of them.
    """
    sent = docs.sparkSession.sparkContext.broadcast(known)
    texts = docs.select(text_of().alias("text"))
    parts = texts.mapInArrow(lambda b: contexts(b, sent.value), "chunk int, lane int, sums binary")
    for lanes in LANES:
        parts = parts.withColumn("lane", F.col("lane") % lanes).groupBy("chunk", "lane").applyInArrow(added, "chunk int, lane int, sums binary")
    vectors = np.zeros((-(-(len(known) + 1) // CHUNK) * CHUNK, DIMS), dtype=np.float32)
    for row in parts.select("chunk", "sums").toLocalIterator():
        own = np.frombuffer(zlib.decompress(row["sums"]), dtype=np.int64).reshape(CHUNK, DIMS)
        vectors[row["chunk"] * CHUNK : (row["chunk"] + 1) * CHUNK] = np.sign(own) * np.log1p(np.abs(own))
    vectors /= np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-9)
    return vectors[: len(known) + 1].astype(np.float16)


def pooled(texts: list[str], known: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Mean, spread and length of mean of the known words' vectors, the log of the word count, the share of rare words."""
    out = np.zeros((len(texts), 2 * DIMS + 3), dtype=np.float32)
    for a, b in strides(texts):
        words, lengths = words_of(texts[a:b])
        if not len(words):
            continue
        some = np.flatnonzero(lengths)
        starts = (np.cumsum(lengths) - lengths)[some]
        n = lengths[some, None].astype(np.float32)
        at = places(words, known)
        rare = np.add.reduceat((at == len(known)).astype(np.float32), starts)[:, None]
        own, held = vectors[at].astype(np.float32), np.maximum(n - rare, 1)
        mean = np.add.reduceat(own, starts) / held
        square = np.add.reduceat(own * own, starts) / held
        out[a + some] = np.hstack([mean, np.sqrt(np.maximum(square - mean**2, 0)), np.linalg.norm(mean, axis=1, keepdims=True), np.log1p(n), rare / n])
    return out


class Network:
    """Standardised inputs, one hidden layer of tanh units, a logit over a temperature."""

    def __init__(self, x: np.ndarray, y: np.ndarray, hidden: int = HIDDEN, epochs: int = EPOCHS):
        rng = np.random.default_rng(5)
        self.mean, self.scale = x.mean(0), x.std(0) + 1e-6
        order = rng.permutation(len(x))
        cut = max(1, len(x) // 5)
        kept, fitted = order[:cut], order[cut:]
        self.w1, self.b1 = rng.normal(0, 1 / math.sqrt(x.shape[1]), (x.shape[1], hidden)), np.zeros(hidden)
        self.w2, self.b2, self.temperature = rng.normal(0, 1 / math.sqrt(hidden), hidden), np.zeros(1), 1.0
        self.fit(x[fitted], y[fitted], epochs, rng)
        self.temperature = self.calibrated(x[kept], y[kept])

    def fit(self, x: np.ndarray, y: np.ndarray, epochs: int, rng: np.random.Generator, rate: float = 3e-3, decay: float = 1e-4) -> None:
        x = (x - self.mean) / self.scale
        weights = [self.w1, self.b1, self.w2, self.b2]
        first, second = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights]
        t = 0
        for _ in range(epochs):
            for rows in np.array_split(rng.permutation(len(x)), max(1, len(x) // 256)):
                h = np.tanh(x[rows] @ self.w1 + self.b1)
                p = 1 / (1 + np.exp(-np.clip(h @ self.w2 + self.b2, -30, 30)))
                d = (p - y[rows]) / max(1, len(rows))
                back = d[:, None] * self.w2 * (1 - h * h)
                t += 1
                for w, g, m, v in zip(weights, (x[rows].T @ back + decay * self.w1, back.sum(0), h.T @ d + decay * self.w2, np.array([d.sum()])), first, second, strict=True):
                    m += 0.1 * (g - m)
                    v += 0.001 * (g * g - v)
                    w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh(((x - self.mean) / self.scale) @ self.w1 + self.b1) @ self.w2 + self.b2

    def calibrated(self, x: np.ndarray, y: np.ndarray) -> float:
        """The temperature with the least log loss on rows that were not fitted."""
        z, sign = self.logits(x), 2 * y - 1
        return min(np.geomspace(0.25, 8, 61), key=lambda t: np.logaddexp(0, -sign * z / t).mean())

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -30, 30)))


def quality(docs: DataFrame, labels: DataFrame, folds: int = 5, held_out: int = 0, threshold: float = THRESHOLD, per_class: int = PER_CLASS) -> DataFrame:
    """One row per input row: doc_id, held_out, score, predicted.

    * Labels (doc_id, quality) are learned from only where crc32(doc_id) % folds is not
      ``held_out``, from at most ``per_class`` documents of either class; word vectors come
      from all texts. The score depends on the text alone.
    * Null texts count as empty; a text without words gets the score of the zero vector.
      With fewer than 20 labelled rows or one class only, every score is the share of
      label 1, or 0.5 without labels.
    * Repeated rows are scored alike; a null doc_id is not held out; an empty table gives
      no rows; other columns play no part.
    """
    spark = docs.sparkSession
    known = known_words(docs)
    model = spark.sparkContext.broadcast((known, word_vectors(docs, known)))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    sample, sizes = sampled_labels(labels, "quality", fold(F.col("doc_id"), folds) != held_out, per_class)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_pydict({"doc_id": b["doc_id"], "label": b["label"], "x": [x.tobytes() for x in pooled(b["text"].to_pylist(), *model.value)]})

    rows = texts.join(F.broadcast(sample), "doc_id").mapInArrow(features, "doc_id long, label int, x binary").orderBy(F.xxhash64("doc_id"), "doc_id", "x").limit(2 * per_class).collect()
    network = None
    if len(rows) >= 20 and len({r["label"] for r in rows}) == 2:
        x, y = np.array([np.frombuffer(r["x"], dtype=np.float32) for r in rows], dtype=float), np.array([r["label"] for r in rows], dtype=float)
        network = Network(x, y)
        # the sample may hold less of one class than the labels do
        share = y.mean()
        network.b2 += network.temperature * (math.log(sizes[1] / sizes[0]) - math.log(share / (1 - share)))
    fallback = sizes[1] / sum(sizes) if sum(sizes) else 0.5

    def scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = network.score(pooled(b["text"].to_pylist(), *model.value).astype(float)) if network else np.full(b.num_rows, fallback)
            yield pa.RecordBatch.from_pydict({"doc_id": b["doc_id"], "score": pa.array(found, pa.float64())})

    out = texts.mapInArrow(scores, "doc_id long, score double")
    return out.select("doc_id", F.coalesce(fold(F.col("doc_id"), folds) == held_out, F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
