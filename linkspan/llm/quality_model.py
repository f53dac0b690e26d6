"""Quality classifier with supervised subword embeddings.

Words, their character n-grams and pairs of neighbouring words are hashed to rows
of an embedding table. A document is the average of its features' vectors, a
softmax over the classes reads it, and both are trained together by numpy
stochastic gradient descent on a bounded sample of labelled documents (TRAIN_ROWS
of them, by the hash of the identifier). Of these, one in CALIBRATION isn't fitted
but scales the softmax. As the averages are linear, a trained model is one number
for each feature; scoring adds up, for each distinct word, the numbers of its
features, and remembers them, so whole texts cost one look-up a word and one hash
in arrays a pair.

Edge cases: null and blank texts have no features and get the score of the bias
alone; if there are no labels, or labels of one class only, every score is the
class's share (0.5 without labels). Labels that are null teach nothing; a document
with several labels counts with each. An empty table gives no rows; extra columns
are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ship, table, text_or_empty
from .language_id import held_out

BUCKETS, DIMENSIONS = 1 << 16, 8
GRAMS = (3, 4)
TRAIN_ROWS, CALIBRATION = 3000, 5
EPOCHS, RATE, OUT_RATE = 6, 5.0, 0.05
#: Words remembered by a worker, and the longest word that is.
REMEMBERED, LONG_WORD = 500_000, 64


def word_hash(word: str) -> int:
    return zlib.crc32(f"<{word}>".encode("utf-8", "replace"))


def features(word: str) -> list[int]:
    """Buckets of the word and of the n-grams of <word>."""
    marked = f"<{word}>".encode("utf-8", "replace")
    out = [zlib.crc32(marked) % BUCKETS]
    for n in GRAMS:
        out += [zlib.crc32(marked[k : k + n], n) % BUCKETS for k in range(len(marked) - n + 1)]
    return out


def pairs(hashes: np.ndarray) -> np.ndarray:
    """Buckets of the pairs of neighbouring words; hashes: word_hash of each word. A pair
    is hashed by the difference of its words' hashes, so pairs of one word twice meet in
    one bucket whichever word it is, and what is learned of one holds for all."""
    x = hashes[1:] - hashes[:-1]
    x = (x ^ (x >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
    x = (x ^ (x >> np.uint32(12))) * np.uint32(0x297A2D39)
    return (x >> np.uint32(32 - (BUCKETS.bit_length() - 1))).astype(np.int64)


def _document_features(batches):
    """Each training document's distinct buckets and their shares."""
    memo: dict[str, tuple[list[int], int]] = {}
    for batch in batches:
        buckets, shares = [], []
        for text in batch.column("text").to_pylist():
            found: list[int] = []
            hashes: list[int] = []
            for word in text.split():
                own = memo.get(word)
                if own is None:
                    own = features(word), word_hash(word)
                    if len(memo) < REMEMBERED and len(word) <= LONG_WORD:
                        memo[word] = own
                found += own[0]
                hashes.append(own[1])
            every = np.concatenate([np.array(found, dtype=np.int64), pairs(np.array(hashes, dtype=np.uint32))])
            counts = np.bincount(every, minlength=1)
            at = np.flatnonzero(counts)
            buckets.append(at.astype("<u4").tobytes())
            shares.append((counts[at] / max(1, len(every))).astype("<f4").tobytes())
        yield pa.RecordBatch.from_arrays(
            [batch.column("_id"), batch.column("label"), pa.array(buckets, pa.binary()), pa.array(shares, pa.binary())], names=["_id", "label", "buckets", "shares"]
        )


def step(table: np.ndarray, out: np.ndarray, at: np.ndarray, p: np.ndarray, label: int, weight: float, rate: float, out_rate: float) -> None:
    """One gradient step, in place, on one document: buckets `at` with shares `p`."""
    hidden = p @ table[at]
    score = hidden @ out
    chance = np.exp(score - score.max())
    chance /= chance.sum()
    chance[label] -= 1
    error = weight * chance
    back = out @ error
    out -= out_rate * np.outer(hidden, error)
    table[at] -= rate * np.outer(p, back)


class Model:
    """logit(document) = mean of weights over its features + bias."""

    def __init__(self, weights: np.ndarray, bias: float):
        self.weights, self.bias = weights, bias

    @classmethod
    def fitted(cls, rows: list[tuple[int, np.ndarray, np.ndarray]], seed: int = 42) -> Model:
        labels = [r[0] for r in rows]
        share = (sum(labels) / len(labels)) if labels else 0.5
        if len(set(labels)) < 2:
            return cls(np.zeros(BUCKETS), {0.0: -20.0, 1.0: 20.0}.get(share, 0.0))
        draw = np.random.default_rng(seed)
        table = draw.uniform(-1, 1, (BUCKETS, DIMENSIONS)) / DIMENSIONS
        out = draw.normal(0, 0.5, (DIMENSIONS, 2))
        weight = np.array([0.5 / (1 - share), 0.5 / share])  # both classes weigh the same in all
        kept = np.arange(len(rows)) % CALIBRATION == 0
        if len({labels[k] for k in np.flatnonzero(kept)}) < 2 or len({labels[k] for k in np.flatnonzero(~kept)}) < 2:
            kept[:] = False  # too few rows to spare any
        fit = np.flatnonzero(~kept)
        steps, done = EPOCHS * len(fit), 0
        for _ in range(EPOCHS):
            for k in draw.permutation(fit):
                label, at, p = rows[k]
                step(table, out, at, p, label, weight[label], RATE * (1 - done / steps), OUT_RATE)
                done += 1
        # read the average's scale off the rows that weren't fitted, so that the softmax is calibrated
        spread = table @ (out[:, 1] - out[:, 0])
        other = np.flatnonzero(kept) if kept.any() else fit
        logits = np.array([rows[k][2] @ spread[rows[k][1]] if len(rows[k][1]) else 0.0 for k in other])
        return cls(*_calibrated(spread, logits, np.array(labels)[other]))


def _calibrated(spread: np.ndarray, logits: np.ndarray, labels: np.ndarray, steps: int = 200) -> tuple[np.ndarray, float]:
    """Scale and bias of the logits by a few Newton steps of logistic regression,
    with a small ridge, so that separable labels don't end in infinite scores."""
    x = np.stack([logits / max(1e-9, np.abs(logits).max()), np.ones(len(logits))], axis=1)
    w = np.zeros(2)
    for _ in range(steps):
        chance = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (chance - labels) + 0.01 * w
        curve = (x * (chance * (1 - chance))[:, None]).T @ x + 0.01 * np.eye(2)
        move = np.linalg.solve(curve, slope)
        w -= np.clip(move, -5, 5)
        if np.abs(move).max() < 1e-6:
            break
    return spread * (w[0] / max(1e-9, np.abs(logits).max())), float(w[1])


def train(docs: DataFrame, labels: DataFrame, text_col: str = "text", id_col: str = "doc_id", label_col: str = "quality", rows: int = TRAIN_ROWS) -> Model:
    """docs and labels are joined by identifier; at most `rows` pairs are used. The
    driver holds their distinct features: at most BUCKETS for each."""
    ship(docs.sparkSession)
    marks = labels.select(F.col(id_col).cast("bigint").alias("_id"), F.col(label_col).cast("int").alias("label")).where("label IN (0, 1)")
    chosen = marks.orderBy(F.xxhash64("_id"), "_id", "label").limit(rows)
    own = docs.select(F.col(id_col).cast("bigint").alias("_id"), text_or_empty(text_col).alias("text"))
    joined = own.join(F.broadcast(chosen), "_id").select("label", "text", "_id")
    found = joined.mapInArrow(_document_features, "_id bigint, label int, buckets binary, shares binary").orderBy("_id", "label").collect()
    return Model.fitted([(r.label, np.frombuffer(r.buckets, "<u4").astype(np.int64), np.frombuffer(r.shares, "<f4").astype(np.float64)) for r in found])


def score(docs: DataFrame, model: Model, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns `keep` of every row with score (0 to 1) and predicted."""
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast((model.weights, model.bias))

    class Words(dict):
        """word -> a place in arrays: the sum of its features' weights, their number, its hash"""

        def reset(self):
            self.clear()
            self.used, self.sums, self.numbers, self.hashes = 0, np.zeros(1 << 16), np.zeros(1 << 16, dtype=np.int64), np.zeros(1 << 16, dtype=np.uint32)

        def __missing__(self, word):
            k, at = self.used, features(word)
            if k == len(self.sums):
                self.sums, self.numbers, self.hashes = (np.concatenate([x, np.zeros_like(x)]) for x in (self.sums, self.numbers, self.hashes))
            self.sums[k], self.numbers[k], self.hashes[k] = shared.value[0][at].sum(), len(at), word_hash(word)
            self.used += 1
            if len(word) <= LONG_WORD:
                self[word] = k
            return k

    def run(batches):
        words, (weights, bias) = Words(), shared.value
        words.reset()
        for batch in batches:
            logits = []
            for text in batch.column("_text").to_pylist():
                if words.used > REMEMBERED:
                    words.reset()
                own = text.split()
                at = np.fromiter(map(words.__getitem__, own), dtype=np.int64, count=len(own))
                number = int(words.numbers[at].sum()) + max(0, len(own) - 1)
                total = words.sums[at].sum() + weights[pairs(words.hashes[at])].sum() if number else 0.0
                logits.append(total / max(1, number) + bias)
            chance = 1 / (1 + np.exp(-np.clip(np.array(logits, dtype=np.float64), -30, 30)))
            arrays = [batch.column(k) for k in range(len(keep))] + [pa.array(chance), pa.array((chance >= 0.5).astype(np.int32))]
            yield pa.RecordBatch.from_arrays(arrays, names=[*batch.schema.names[: len(keep)], "score", "predicted"])

    own = docs.select(*keep, text_or_empty(text_col).alias("_text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in own.schema.fields[: len(keep)])
    return own.mapInArrow(run, f"{schema}, score double, predicted int")


def op9_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: learned from the labels of two thirds of the documents."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text").withColumn("held_out", held_out())
    labels = table(spark, sf_dir, "labels").where(~held_out())
    return score(docs, train(docs, labels), keep=("doc_id", "held_out"))


QUERIES = {"op9_quality_model": op9_quality_model}
ORACLES: dict[str, str] = {}
