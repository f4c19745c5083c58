"""Quality classifier with supervised subword embeddings.

Every word, every pair of neighbouring words (a word followed by itself is one
feature whatever the word) and every 3- and 4-byte n-gram inside a word (with its
borders) is hashed to a vector; a document is the mean of its vectors; a softmax gives the
class.  Vectors and softmax are trained together by stochastic gradient descent
in numpy, on a bounded sample: labelled.SAMPLE_ROWS texts of at most labelled.SAMPLE_BYTES bytes.

The mean and the softmax input are linear, so for scoring each vector is
projected once onto the difference of the two output rows: a document's logit
is the mean of one number per n-gram.

Defined cases: a null or empty text has no n-grams and gets the score of the
bias alone; a text of any length is scored whole; equal texts get equal scores.
With no labelled rows of both classes the model is constant.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldstats.llm import labelled
from fieldstats.llm.store import fold_of
from fieldstats.llm.text import _SPACE, Texts, U, parts, slices

BUCKET_BITS = 18
DIM = 8
EPOCHS = 6
RATE = 4.0
SEED = 7
THRESHOLD = 0.3
FIT_PART = 1 << 18  # bytes of text whose n-grams are sorted at once
NGRAMS = (3, 4)
_SAME = 0x5A17_0000_0000_0000


def word_buckets(texts: Texts) -> tuple[np.ndarray, np.ndarray]:
    """Buckets and texts of the words, then of the pairs of words."""
    words = texts.words(lower=False)
    pairs, text, at = words.shingles(2, short=False)
    pairs = np.where(words.hashes[at] == words.hashes[np.minimum(at + 1, len(words.hashes) - 1)], U(_SAME), pairs) if len(at) else pairs
    return (np.concatenate([words.hashes, pairs]) >> U(64 - BUCKET_BITS)).astype(np.int32), np.concatenate([words.text, text])


def gram_buckets(texts: Texts, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of the n-gram at each byte, and whether there is one: inside one text, white space only at its ends."""
    size = len(texts.raw)
    blank = _SPACE[texts.raw]
    data = np.where(blank, np.uint8(32), texts.raw).astype(np.uint32)
    packed = np.zeros(size, np.uint32)
    valid = np.ones(size, bool)
    for i in range(n):
        packed[: size - i] |= data[i:] << np.uint32(8 * i)
        if 0 < i < n - 1:
            valid[: size - i] &= ~blank[i:]
    for i in range(1, n):
        ends = texts.offsets[1:] - i
        valid[ends[(ends >= texts.offsets[:-1])]] = False
    hashed = (packed ^ np.uint32(n * 0x3C6EF372 & 0xFFFFFFFF)) * np.uint32(0x9E3779B1)
    hashed ^= hashed >> np.uint32(15)
    hashed *= np.uint32(0x85EBCA77)
    return (hashed >> np.uint32(32 - BUCKET_BITS)).astype(np.int32), valid


@dataclass
class Model:
    table: np.ndarray
    bias: float

    def score(self, texts: Texts) -> np.ndarray:
        buckets, text = word_buckets(texts)
        total = np.bincount(text, self.table[buckets], texts.n).astype(float)
        count = np.bincount(text, minlength=texts.n)
        for n in NGRAMS:
            buckets, valid = gram_buckets(texts, n)
            values = np.concatenate([[0.0], np.cumsum(np.where(valid, self.table[buckets], 0), dtype=np.float64)])
            total += values[texts.offsets[1:]] - values[texts.offsets[:-1]]
            count += texts.sums(valid)
        return 1 / (1 + np.exp(-np.clip(self.bias + total / np.maximum(count, 1), -30, 30)))


def bags(texts: Texts) -> list[tuple[np.ndarray, np.ndarray]]:
    """Distinct buckets and their shares for each text."""
    owner = np.repeat(np.arange(texts.n), texts.sizes)
    buckets, text = word_buckets(texts)
    parts, owners = [buckets], [text]
    for n in NGRAMS:
        buckets, valid = gram_buckets(texts, n)
        parts.append(buckets[valid])
        owners.append(owner[valid])
    keys, counts = np.unique(np.concatenate(owners).astype(np.int64) << BUCKET_BITS | np.concatenate(parts), return_counts=True)
    ends = np.searchsorted(keys, np.arange(texts.n + 1, dtype=np.int64) << BUCKET_BITS)
    out = []
    for a, b in zip(ends[:-1], ends[1:], strict=True):
        out.append(((keys[a:b] & ((1 << BUCKET_BITS) - 1)).astype(np.int32), (counts[a:b] / max(1, counts[a:b].sum())).astype(np.float32)))
    return out


def train(texts: Texts, labels: np.ndarray) -> Model:
    """Stochastic gradient descent over shuffled documents with a linearly falling rate."""
    rng = np.random.default_rng(SEED)
    vectors = rng.uniform(-1 / DIM, 1 / DIM, (1 << BUCKET_BITS, DIM)).astype(np.float32)
    output, bias = np.zeros((DIM, 2), np.float32), np.zeros(2, np.float32)
    data: list[tuple[np.ndarray, np.ndarray]] = []
    for part, _ in parts(texts, FIT_PART):
        data += bags(part)
    target = np.eye(2, dtype=np.float32)[labels] if len(labels) else np.zeros((0, 2), np.float32)
    steps = EPOCHS * len(data)
    for epoch in range(EPOCHS):
        for k, i in enumerate(rng.permutation(len(data))):
            rate = RATE * (1 - (epoch * len(data) + k) / steps)
            at, share = data[i]
            rows = vectors[at]
            mean = share @ rows
            z = mean @ output + bias
            p = np.exp(z - z.max())
            error = p / p.sum() - target[i]
            step = output @ error
            output -= rate * np.outer(mean, error)
            bias -= rate * 0.01 * error
            vectors[at] = rows - rate * share[:, None] * step
    edge = output[:, 1] - output[:, 0]
    return Model((vectors @ edge).astype(np.float32), float(bias[1] - bias[0]))


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality") -> Model:
    return train(*labelled.sample(docs, labels, label))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 2**BUCKET_BITS floats

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in slices(batches):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(shared.value.score(texts))], ["doc_id", "score"])

    scored = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", F.coalesce(fold_of() == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def keep(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs that the model accepts, filtered where they are read: no join back."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in slices(batches):
            yield batch.filter(pa.array(shared.value.score(texts) >= threshold))

    return docs.mapInArrow(run, docs.schema)
