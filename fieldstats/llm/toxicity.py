"""Toxicity by multiple-instance learning.

A document is a bag of sentences.  A sentence's probability is a logistic
function of the weights of its distinct words; a document's is the noisy-or of its
sentences and of a leak, 1 - (1 - leak) * prod(1 - p).  Weights are fitted to
document labels only, by proximal gradient steps on the document likelihood
(weights are at least 0 and shrunk, so that a word is evidence or nothing); the
leak takes up labels that no sentence explains.  The fitted sentence
probabilities then locate the offending sentences.

Words are runs of letters (A-Z lower-cased, bytes from 0x80 count as letters);
sentences end at . ! ? or a line break.

Defined cases: a null or empty text has no sentence and its score is the leak;
repeated sentences each count; texts of any length are scored whole.  With no
labelled rows every score is the leak.
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
from fieldstats.llm.text import Texts, U, parts, slices, span_hashes

BUCKET_BITS = 22
MIN_DOCS, MIN_SHARE = 3, 0.002
STEPS = 400
RATE = 0.3
SHRINK = 0.02
BIAS = -5.0
THRESHOLD = 0.5

_NOT_LETTER = np.ones(256, bool)
_NOT_LETTER[ord("a") : ord("z") + 1] = False
_NOT_LETTER[0x80:] = False
_STOP = np.zeros(256, bool)
_STOP[list(b".!?\n")] = True


def sentences(texts: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Buckets and sentence numbers of the words; text number and first and last byte of each sentence."""
    data = texts.lowered()
    starts, ends, text = texts.runs(_NOT_LETTER[data])
    stops = np.concatenate([[0], np.cumsum(_STOP[data])])[starts]
    new = np.ones(len(starts), bool)
    new[1:] = (stops[1:] != stops[:-1]) | (text[1:] != text[:-1])
    at = np.flatnonzero(new)
    last = np.append(at[1:], len(starts)) - 1
    buckets = (span_hashes(data, starts, ends) >> U(64 - BUCKET_BITS)).astype(np.int32)
    return buckets, np.cumsum(new) - 1, text[at], starts[at], ends[last] if len(at) else at


def above(z: np.ndarray, bias: float) -> np.ndarray:
    """Logistic function of z less its value at the bias: a sentence without evidence has probability 0, so length alone never adds up."""
    base = 1 / (1 + np.exp(-bias))
    return np.maximum((1 / (1 + np.exp(-np.clip(z, -30, 30))) - base) / (1 - base), 0)


@dataclass
class Model:
    weights: np.ndarray
    bias: float
    leak: float

    def sentence_scores(self, buckets: np.ndarray, sentence: np.ndarray, n: int) -> np.ndarray:
        held = np.flatnonzero(self.weights[buckets])
        pairs = np.unique(sentence[held].astype(np.int64) << BUCKET_BITS | buckets[held])
        z = self.bias + np.bincount(pairs >> BUCKET_BITS, self.weights[pairs & ((1 << BUCKET_BITS) - 1)], n)
        return above(z, self.bias)

    def score(self, texts: Texts) -> np.ndarray:
        buckets, sentence, text, _, _ = sentences(texts)
        p = self.sentence_scores(buckets, sentence, len(text))
        return 1 - (1 - self.leak) * np.exp(np.bincount(text, np.log1p(-np.minimum(p, 1 - 1e-12)), texts.n))


def train(texts: Texts, labels: np.ndarray) -> Model:
    """Proximal adaptive gradient ascent of the noisy-or likelihood; words in fewer than MIN_DOCS texts, or in less than MIN_SHARE of them, have no weight, and the shrinkage is SHRINK times the root of the number of texts."""
    size = 1 << BUCKET_BITS
    held = np.zeros(size, np.int32)  # texts that hold a word of the bucket
    for part, _ in parts(texts):
        buckets, sentence, text, _, _ = sentences(part)
        held += np.bincount(np.unique(text[sentence].astype(np.int64) << BUCKET_BITS | buckets) & (size - 1), minlength=size).astype(np.int32)
    used = held >= max(MIN_DOCS, MIN_SHARE * texts.n)
    cells, owners, n = [], [], 0
    for part, first in parts(texts):
        buckets, sentence, text, _, _ = sentences(part)
        keep = used[buckets]
        cells.append(np.unique((sentence[keep].astype(np.int64) + n) << BUCKET_BITS | buckets[keep]))
        owners.append((text + first).astype(np.int32))
        n += len(text)
    cells = np.concatenate(cells) if cells else np.zeros(0, np.int64)
    text = np.concatenate(owners) if owners else np.zeros(0, np.int32)
    owner = (cells >> BUCKET_BITS).astype(np.int32)
    names, feature = np.unique((cells & (size - 1)).astype(np.int32), return_inverse=True)
    feature = feature.astype(np.int32)
    y = labels.astype(float)
    w, bias, leak_z = np.zeros(len(names)), BIAS, -3.0
    sums = np.zeros(len(names))
    shrink = SHRINK * np.sqrt(texts.n)
    for step in range(STEPS if len(y) else 0):
        z = bias + np.bincount(owner, w[feature], n)
        p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        leak = 1 / (1 + np.exp(-leak_z))
        none = (1 - leak) * np.exp(np.bincount(text, np.log1p(-np.minimum(above(z, bias), 1 - 1e-12)), texts.n))
        pull = np.where(y > 0, none / np.maximum(1 - none, 1e-9), -1.0)
        gradient = np.bincount(feature, (p * pull[text])[owner], len(names))
        sums = 0.9 * sums + 0.1 * gradient**2
        rate = RATE * (1 - step / STEPS) / np.sqrt(sums + 1e-3)
        if step < STEPS // 2:
            w = np.maximum(w + rate * (gradient - shrink), 0)
        else:  # the chosen words, without the shrinkage
            w = np.where(w > 0, np.maximum(w + rate * gradient, 1e-9), 0)
        leak_z = np.clip(leak_z + 2.0 * np.mean(leak * pull), -6, -1.5)
    out = np.zeros(size, np.float32)
    out[names] = w
    return Model(out, bias, float(1 / (1 + np.exp(-leak_z))))


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic") -> Model:
    return train(*labelled.sample(docs, labels, label))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 2**BUCKET_BITS floats

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in slices(batches):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(shared.value.score(texts))], ["doc_id", "score"])

    scored = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", F.coalesce(fold_of() == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def locate(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, sentence text and probability of each offending sentence."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in slices(batches):
            buckets, sentence, text, starts, ends = sentences(texts)
            p = shared.value.sentence_scores(buckets, sentence, len(text))
            hit = np.flatnonzero(p >= threshold)
            rows = [bytes(texts.raw[starts[i] : ends[i]]).decode() for i in hit]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(text[hit])), pa.array(rows, pa.string()), pa.array(p[hit])], ["doc_id", "sentence", "score"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, sentence string, score double")


def keep(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs scored below the threshold, filtered where they are read: no join back."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in slices(batches):
            yield batch.filter(pa.array(shared.value.score(texts) < threshold))

    return docs.mapInArrow(run, docs.schema)
