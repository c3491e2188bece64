"""Toxicity: logistic regression by FTRL-proximal over hashed word n-grams and skip-grams.

Features of a text, each present or not: its words (A-Z lower-cased, cut at all
that is neither letter, digit nor a byte above 0x7F), its word pairs, its pairs
around one skipped word, and the beginnings of its words.  FTRL-proximal keeps
per coordinate the sum of adjusted gradients and of squared gradients, hence a
learning rate of its own, and an L1 term that leaves all but few weights at zero.

Training reads a bounded sample of labelled rows (``SAMPLE``, a parameter), the
rows with the smallest hash of their number; it runs in one task.  Texts become
features where they lie, at most ``2**BITS`` numbers each; every pair of number and text counts once;
``FEATURES``, a parameter, bounds what the training task takes in.  Its result is
one row: the non-zero weights, at most ``2**BITS`` of them, which are broadcast.
Scoring is a narrow projection over all documents.

A null or empty text has no features: its score is that of the bias.  Rows whose
label is null are not learned from; of several labels of one document the
largest counts.  Without any label all scores are 0.5.  Repeated rows get equal
scores; further columns pass through, but one named like the score's is replaced;
texts of any length are scored as a whole; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dialoscope.llm import frames
from dialoscope.llm.hashing import U, Rolling, lower_table, mix, runs

#: Labelled rows to learn from, at most.
SAMPLE = 16_384
#: Features of all rows learned from, at most: 4 bytes each in the training task. Rows beyond are not learned from.
FEATURES = 64_000_000
BITS = 20
#: Bytes of a word's beginning.
STEM = 4
ALPHA, BETA, L1, L2, EPOCHS = 0.5, 1.0, 5.0, 1.0, 4


def letters() -> np.ndarray:
    mask = np.zeros(256, bool)
    mask[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
    return mask


def features(data: np.ndarray, at: np.ndarray, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (row, feature) of a slice of texts, by row."""
    data = lower_table()[data]
    start, end = runs(letters()[data], at)
    rolling = Rolling(data)
    words = rolling.ranges(start, end)
    stems = mix(rolling.ranges(start, np.minimum(start + STEM, end)) + U(1))
    row = np.searchsorted(at, start, side="right") - 1
    found = [(row, words), (row, stems)]
    for gap, salt in ((1, 2), (2, 3)):
        same = row[gap:] == row[:-gap]
        pairs = mix(words[:-gap] * U(0x9E3779B97F4A7C15) + words[gap:] + U(salt))
        found.append((row[gap:][same], pairs[same]))
    keys = np.concatenate([(r.astype(U) << U(bits)) | (h >> U(64 - bits)) for r, h in found])
    keys.sort()
    keys = keys[np.concatenate([[True], keys[1:] != keys[:-1]])] if len(keys) else keys
    return (keys >> U(bits)).astype(np.int64), (keys & U(2**bits - 1)).astype(np.int32)


class Ftrl:
    """Per-coordinate FTRL-proximal; coordinate ``2**bits`` is the bias, which has no L1 term."""

    def __init__(self, bits: int = BITS, alpha: float = ALPHA, beta: float = BETA, l1: float = L1, l2: float = L2):
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.bias = 2**bits
        self.z = np.zeros(self.bias + 1)
        self.n = np.zeros(self.bias + 1)

    def weights(self, at: np.ndarray) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        l1 = np.where(at == self.bias, 0.0, self.l1)
        return np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2))

    def learn(self, at: np.ndarray, label: int) -> None:
        at = np.append(at, self.bias)
        w = self.weights(at)
        gradient = sigmoid(w.sum()) - label
        root = np.sqrt(self.n[at])
        self.n[at] += gradient * gradient
        self.z[at] += gradient - (np.sqrt(self.n[at]) - root) / self.alpha * w


def sigmoid(x):
    return 1.0 / (1.0 + np.exp(-np.clip(x, -40.0, 40.0)))


def row_features(column: pa.Array, bits: int) -> Iterator[np.ndarray]:
    """Features of each text of a column."""
    for first, end, at, data in frames.slices(column):
        row, found = features(data, at, bits)
        yield from np.split(found, np.searchsorted(row, np.arange(1, end - first)))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, bits: int = BITS, epochs: int = EPOCHS,
          doc_id: str = "doc_id", text: str = "text", label: str = "toxic", features_most: int = FEATURES) -> tuple[np.ndarray, np.ndarray, float]:
    """Indices and values of the non-zero weights, and the bias."""
    known = labels.where(F.col(label).isNotNull() & F.col(doc_id).isNotNull()).groupBy(F.col(doc_id).cast("long").alias("doc")) \
        .agg(F.max(F.col(label).cast("int")).alias("label"))
    chosen = known.orderBy(F.xxhash64("doc"), "doc").limit(sample)  # numbers and labels only
    # the sample is bounded by its parameter, so it is broadcast and the texts stay where they are
    rows = frames.records(docs, doc_id, text).join(F.broadcast(chosen), "doc").withColumn("mark", F.xxhash64("text"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = list(row_features(batch.column(3), bits))
            sizes = np.array([len(f) for f in found])
            flat = np.concatenate(found) if found else np.zeros(0, np.int32)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], frames.lists(flat, sizes, pa.int32())], names=["doc", "mark", "label", "at"])

    # one row for each number and text, however often it occurs; of the numbers' texts again as many as the sample has rows
    read_rows = rows.select("doc", "mark", "label", "text").mapInArrow(read, "doc long, mark long, label int, at array<int>")
    one_each = read_rows.groupBy("doc", "mark").agg(F.first("label").alias("label"), F.first("at").alias("at"))
    own = frames.stored(one_each)
    first = own.select("doc", "mark").orderBy(F.xxhash64("doc"), "doc", "mark").limit(sample)
    own = own.join(F.broadcast(first), ["doc", "mark"], "left_semi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, seen, marks, held = Ftrl(bits), [], [], 0
        for batch in batches:
            for mark, at in zip(batch.column(0).to_pylist(), batch.column(1)):
                held += len(at.values)
                if held > features_most:
                    break
                seen.append(at.values.to_numpy())
                marks.append(mark)
        for epoch in range(epochs if seen else 0):
            for i in np.random.default_rng(epoch).permutation(len(seen)):
                model.learn(seen[i], marks[i])
        w = model.weights(np.arange(model.bias + 1))
        at = np.flatnonzero(w[:-1]).astype(np.int32)
        yield pa.RecordBatch.from_pydict({"at": [at.tobytes()], "w": [w[at].tobytes()], "bias": [float(w[-1])]})

    one = own.repartition(1).sortWithinPartitions(F.xxhash64("doc"), "doc", "mark").select("label", "at")
    found = one.mapInArrow(run, "at binary, w binary, bias double").collect()
    if not found:
        return np.zeros(0, np.int32), np.zeros(0), 0.0
    return np.frombuffer(found[0].at, np.int32), np.frombuffer(found[0].w), found[0].bias


def score(docs: DataFrame, model: tuple[np.ndarray, np.ndarray, float], bits: int = BITS, text: str = "text",
          column: str = "score") -> DataFrame:
    """``docs`` with the probability that the label is 1."""
    frames.bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    source = docs.drop(column).withColumn("__text", F.coalesce(F.col(text).cast("string"), F.lit("")))
    kept = source.columns[:-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, values, bias = shared.value
        weights = np.zeros(2**bits)
        weights[at] = values
        for batch in batches:
            sums = np.full(batch.num_rows, bias)
            for first, end, bounds, data in frames.slices(batch.column(len(kept))):
                row, found = features(data, bounds, bits)
                sums[first:end] += np.bincount(row, weights[found], minlength=end - first)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(sigmoid(sums))], names=[*kept, column])

    fields = [f"`{c}` {source.schema[c].dataType.simpleString()}" for c in kept]
    return source.mapInArrow(run, ", ".join([*fields, f"`{column}` double"]))


def held_out(doc_id: str = "doc_id") -> F.Column:
    """Rows that are kept from training: crc32 of the number's text divisible by 5; rows without a number are not."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))
