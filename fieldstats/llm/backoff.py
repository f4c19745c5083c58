"""Katz back-off of any order from stored tables, evaluated recursively for the tokens of any texts.

Order k keeps a table of grams (gram, history, suffix, n, p), keyed by 64-bit hashes of
their words, with the discounted probability p = d(n) n / C(history), and a table of back-off weights
by history:

    p(w|h) = p of the gram hw                       where hw occurs in training
    p(w|h) = a(h) p(w|h'), h' = h without its first otherwise; a(h) = 1 for a new history
    a(h)   = (1 - sum p(w|h)) / (1 - sum p(w|h')), sums over the words that follow h

A word that follows h follows h' too, so both sums are over table values, and
p(.|h) sums to 1 exactly.  C(h) counts the followers of h, plus 1 where none of them occurs once.  Texts
begin with order - 1 start marks and end with one end token.

Grams are counted by map-side sums and one exchange by gram, whatever the frequency
of a gram or history; histories and suffixes meet by joins that may be split.  Scoring sends each text's distinct grams through one join
an order: what is found is done, the rest takes the history's weight along and
goes on with one word less.

Defined cases: a null or empty text is one end token; repeated rows each count; texts of training may be scored
as any others; without training texts all mass is on the unknown word.
katz.py is the order-2 model of the same kind in packed arrays, for inputs where the exchanges of rows cost too much.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldstats.llm.katz import END, START, Discounts, K
from fieldstats.llm.store import stage
from fieldstats.llm.text import Texts, U, fold, slices

BLOCK = 1_000_000


@dataclass
class Model:
    """Staged tables of a fitted model: grams and weights by order, weights from order 2 on."""

    order: int
    grams: list[DataFrame]
    weights: list[DataFrame]
    discounts: list[Discounts]
    total: int
    unknown: float


def grams_of(texts: Texts, order: int) -> tuple[list[np.ndarray], np.ndarray]:
    """Hashes of the grams of 1 to `order` words that end at each token, and the tokens' texts."""
    words = texts.words()
    size = words.counts + order  # start marks, words and the end
    first = np.concatenate([[0], np.cumsum(size)])
    line = np.full(first[-1], START)
    text = np.repeat(np.arange(texts.n), size)
    place = np.arange(first[-1]) - first[text]
    token = place >= order - 1
    line[token & (place < size[text] - 1)] = words.hashes
    line[first[1:] - 1] = END
    at = np.flatnonzero(token)
    return [line[at]] + [fold(*(line[at - k + 1 + i] for i in range(k))) for k in range(2, order + 1)], text[at]


def _histories(texts: Texts, order: int) -> list[np.ndarray]:
    """Hashes of the histories of 1 to order - 1 words before each token."""
    grams, text = grams_of(texts, order)
    # the history of k words before a token is the gram of k words that ends at the token before; start marks before the first
    out = []
    head = np.append(True, text[1:] != text[:-1])[: len(text)]
    for k in range(1, order):
        start = START if k == 1 else fold(*(np.array([START]) for _ in range(k)))[0]
        before = np.roll(grams[k - 1], 1)
        before[head] = start
        out.append(before)
    return out


def _counted(order: int, k: int):
    """gram, history, suffix and n of the grams of k words, distinct within about BLOCK tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def flush() -> pa.RecordBatch:
            gram, history, suffix = (np.concatenate(x) for x in zip(*held, strict=True))
            _, at, n = np.unique(gram, return_index=True, return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(x[at].view(np.int64)) for x in (gram, history, suffix)] + [pa.array(n)], ["gram", "history", "suffix", "n"])

        for _, texts in slices(batches):
            grams, text = grams_of(texts, order)
            none = np.zeros(len(text), U)
            held.append((grams[k - 1], _histories(texts, order)[k - 2] if k > 1 else none, grams[k - 2] if k > 1 else none))
            size += len(text)
            if size > BLOCK:
                yield flush()
                held, size = [], 0
        if held:
            yield flush()

    return run


def fit(docs: DataFrame, order: int = 3) -> Model:
    """Count, discount and normalise all texts of docs."""
    if order < 1:
        raise ValueError("order must be at least 1")
    grams, weights, discounts, total, unknown = [], [], [], 0, 1.0
    for k in range(1, order + 1):
        counted = docs.select("text").mapInArrow(_counted(order, k), "gram long, history long, suffix long, n long")
        counted = stage(counted.groupBy("gram", "history", "suffix").agg(F.sum("n").alias("n")), f"grams-{k}")
        row = counted.agg(F.sum("n"), *[F.count_if(F.col("n") == r) for r in range(1, K + 2)]).first()
        d = Discounts.of(list(row[1:]))
        factor = F.element_at(F.array(*[F.lit(float(x)) for x in d.factor]), F.least(F.col("n"), F.lit(K + 1)).cast("int") + 1)
        if k == 1:
            total = row[0] or 0
            less = sum((1 - d.factor[r]) * r * row[r] for r in range(1, K + 1))
            unknown = less / total if total else 1.0
            unknown = unknown if unknown > 0 else 1 / (total + 1)
            table = counted.withColumn("p", factor * F.col("n") / max(1, total))
        else:
            full = counted.groupBy("history").agg((F.sum("n") + (F.count_if(F.col("n") == 1) == 0).cast("long")).alias("full"))
            table = counted.join(full, "history").withColumn("p", factor * F.col("n") / F.col("full")).drop("full")
        table = stage(table.select("gram", "history", "suffix", "n", "p"), f"model-{k}")
        if k > 1:
            lower = grams[-1].select(F.col("gram").alias("suffix"), F.col("p").alias("q"))
            sums = table.join(lower, "suffix").groupBy("history").agg(F.sum("p").alias("given"), F.sum("q").alias("mass"))
            weights.append(stage(sums.select("history", ((1 - F.col("given")) / (1 - F.col("mass"))).alias("weight")), f"weights-{k}"))
        grams.append(table)
        discounts.append(d)
    return Model(order, grams, weights, discounts, total, unknown)


def _asked(order: int):
    """Distinct grams of each text with their number, all orders and histories."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in slices(batches):
            grams, text = grams_of(texts, order)
            keys = fold(text.astype(U), grams[-1])
            _, at, n = np.unique(keys, return_index=True, return_counts=True)
            columns = [batch.column(0).take(pa.array(text[at])), batch.column(1).take(pa.array(text[at])), *(pa.array(g[at].view(np.int64)) for g in grams), *(pa.array(h[at].view(np.int64)) for h in _histories(texts, order)), pa.array(n)]
            yield pa.RecordBatch.from_arrays(columns, ["row", "doc_id", *(f"g{k}" for k in range(1, order + 1)), *(f"h{k}" for k in range(2, order + 1)), "n"])

    return run


def score(model: Model, docs: DataFrame) -> DataFrame:
    """doc_id, n_tokens and score (log10 probability of the text) of each row of docs."""
    n = model.order
    schema = ", ".join(["row long", "doc_id long", *(f"g{k} long" for k in range(1, n + 1)), *(f"h{k} long" for k in range(2, n + 1)), "n long"])
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    # written once: row numbers hold for one reading of docs only
    open_ = stage(rows.mapInArrow(_asked(n), schema), "asked").withColumn("carried", F.lit(0.0))
    done = []
    for k in range(n, 0, -1):
        table = model.grams[k - 1].select(F.col("gram").alias(f"g{k}"), "p")
        met = open_.join(table, f"g{k}", "left")
        met = stage(met, f"met-{k}") if k > 1 else met
        found = F.col("p").isNotNull() if k > 1 else F.lit(True)
        done.append(met.filter(found).select("row", "doc_id", "n", (F.col("n") * (F.col("carried") + F.log10(F.coalesce("p", F.lit(model.unknown))))).alias("score")))
        if k > 1:
            weight = model.weights[k - 2].select(F.col("history").alias(f"h{k}"), "weight")
            left = met.filter("p IS NULL").drop("p", f"g{k}").join(weight, f"h{k}", "left")
            open_ = left.withColumn("carried", F.col("carried") + F.log10(F.coalesce("weight", F.lit(1.0)))).drop("weight", f"h{k}")
    every = done[0]
    for more in done[1:]:
        every = every.unionByName(more)
    return every.groupBy("row", "doc_id").agg(F.sum("n").alias("n_tokens"), F.sum("score").alias("score")).select("doc_id", "n_tokens", "score")
