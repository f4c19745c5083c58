"""Hard-negative mining: for each anchor and positive, the best-scored rows of another label within limits of the positive's score.

Vectors are quantised to integers, floor(scale * x), and scores are integer inner
products, so ranks and limits are exact and alike on every machine.  Higher scores
come first, ties by the smaller id.

Anchors and rows are both dealt into parts by hash, and each pair of an anchor part and a
row part is one unit of work of bounded size: rows go to every anchor part, anchors to
every row part, and nothing is broadcast.  A unit makes one anchor's scores against
its rows at a time and sorts them in full by (score, id).  The first
pass reads the best rows of the anchor's own label, of which the best of all
units are its positives.  The second sorts again, finds each positive's upper limit by
binary search among the rows of other labels and reads the next `negatives` of them
down to the lower limit; what the units found is merged by rank.  A unit hands on at most
`positives` * `negatives` rows for each anchor, which is the whole answer of its part.
The scores of all anchors against all rows are the work asked for; no table of them is kept.

Defined cases: rows with a null id, label or vector, or a null or non-finite component
take no part.  Of rows that repeat an id, the one of the smallest label, then the
smallest quantised vector, takes part.  Vectors of different lengths are scored over the components
that both have; an empty one scores 0 against all.  Scores that 64 bits cannot hold
exactly raise an OverflowError.  An anchor without another row of its label, or a positive without a
row between its limits (any positive of a negative score), has no rows in the result.  Rows without anchors
give an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldstats.llm.store import stage

PART_ROWS = 65_536
PART_ANCHORS = 8_192
EXACT = 1 << 53


@dataclass(frozen=True)
class Limits:
    """Numbers of positives and negatives; the lowest and the highest share of a positive's score, in percent."""

    positives: int = 5
    negatives: int = 5
    lowest: int = 80
    highest: int = 100


def quantised(vectors: DataFrame, label: Column, scale: int = 256) -> DataFrame:
    """id, label and q (array of long) of the rows of (vec_id, embedding) that take part; one row for each id."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(math.inf)))
    # a component whose product leaves 64 bits raises in the cast (ANSI) or, as the largest long, in the scores
    q = F.transform("embedding", lambda x: F.floor(x.cast("double") * scale))
    rows = vectors.filter(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()).filter(finite)
    rows = rows.select(F.col("vec_id").cast("long").alias("id"), label.cast("long").alias("label"), q.alias("q")).filter("label is not null")
    return rows.groupBy("id").agg(F.min(F.struct("label", "q")).alias("row")).select("id", "row.*")


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows of integers padded with zeros to `width`."""
    values, sizes = column.flatten().to_numpy(), column.value_lengths().to_numpy()
    out = np.zeros((len(column), width), np.int64)
    out[np.arange(width) < sizes[:, None]] = values
    return out


class Scores:
    """Exact inner products of rows with one anchor after another."""

    def __init__(self, rows: np.ndarray, anchors: np.ndarray) -> None:
        size = lambda x: [int(v) for v in np.abs(x.astype(np.float64)).max(0, initial=0)]
        most = sum(a * b for a, b in zip(size(rows), size(anchors), strict=True))
        if most >= 1 << 62:
            raise OverflowError("scores exceed 64 bits; use a smaller scale")
        # below 2^53 every product and partial sum of doubles is exact in any order
        kind = np.float64 if most < EXACT else np.int64
        self.rows, self.anchors = rows.astype(kind), anchors.astype(kind)

    def __getitem__(self, anchor: int) -> np.ndarray:
        return (self.rows @ self.anchors[anchor]).astype(np.int64)


def first(ids: np.ndarray, scores: np.ndarray) -> np.ndarray:
    """Order by score, highest first, then by id."""
    return np.lexsort((ids, -scores))


def same_label(ids: np.ndarray, labels: np.ndarray, scores: np.ndarray, anchor: int, label: int, limits: Limits) -> list[tuple[int, int]]:
    """The best (id, score) of the anchor's label, itself left out."""
    at = np.flatnonzero((labels == label) & (ids != anchor))
    at = at[first(ids[at], scores[at])[: limits.positives]]
    return list(zip(ids[at].tolist(), scores[at].tolist(), strict=True))


def other_label(ids: np.ndarray, labels: np.ndarray, scores: np.ndarray, label: int, positives: list[tuple[int, int]], limits: Limits) -> list[tuple[int, int, int, int]]:
    """(positive, its score, negative, its score) of the first rows of other labels between each positive's limits."""
    order = first(ids, scores)
    order = order[labels[order] != label]
    falling, out = -scores[order], []
    for positive, score in positives:
        most, least = limits.highest * score // 100, -(-limits.lowest * score // 100)
        start = np.searchsorted(falling, -most, "left")
        stop = min(start + limits.negatives, np.searchsorted(falling, -least, "right"))
        out += [(positive, score, int(ids[i]), int(scores[i])) for i in order[start:stop]]
    return out


def _units(rows: DataFrame, anchors: DataFrame, slices: int, chunks: int) -> DataFrame:
    """Each row for every anchor part and each anchor for every row part, as (chunk, slice, anchor, id, label, q, positives)."""
    spread = lambda n, salt: F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    none = F.lit(None).cast("array<struct<id:bigint,score:bigint>>")
    a = rows.select(every(chunks).alias("chunk"), spread(slices, "rows").alias("slice"), F.lit(False).alias("anchor"), "id", "label", "q", none.alias("positives"))
    b = anchors.select(spread(chunks, "anchors").alias("chunk"), every(slices).alias("slice"), F.lit(True).alias("anchor"), "id", "label", "q", "positives")
    return a.unionByName(b)


def _solver(limits: Limits, second: bool) -> Callable[[pa.Table], pa.Table]:
    names = ["anchor_id", "positive_id", "positive_score"] + ["negative_id", "negative_score"] * second

    def solve(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        ids, labels = table.column("id").to_numpy(), table.column("label").to_numpy()
        column = table.column("q").combine_chunks()
        chosen = table.column("anchor").to_numpy()
        values = matrix(column, int(column.value_lengths().to_numpy().max(initial=0)))
        at = np.flatnonzero(~chosen)
        at = at[np.argsort(ids[at], kind="stable")]
        heads = np.flatnonzero(chosen)
        scores, out = Scores(values[at], values[heads]), []
        ids_of, labels_of = ids[at], labels[at]
        known = table.column("positives").take(pa.array(heads)).to_pylist() if second else None
        for k, head in enumerate(heads):
            anchor, label, found = int(ids[head]), labels[head], scores[k]
            if second:
                wanted = [(p["id"], p["score"]) for p in known[k]]
                out += [(anchor, *x) for x in other_label(ids_of, labels_of, found, label, wanted, limits)]
            else:
                out += [(anchor, *x) for x in same_label(ids_of, labels_of, found, anchor, label, limits)]
        columns = np.array(out, np.int64).reshape(-1, len(names))
        return pa.table({name: pa.array(columns[:, i]) for i, name in enumerate(names)})

    return solve


def mine(rows: DataFrame, anchors: Column, limits: Limits = Limits()) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score; `rows` has id, label and q, `anchors` says which are anchors."""
    rows = stage(rows, "quantised")
    context = rows.sparkSession.sparkContext
    counts = rows.agg(F.count("*").alias("rows"), F.count_if(anchors).alias("anchors")).first()
    # at least as many parts as there are cores to work on them; the result is the same for any number
    slices = max(context.defaultParallelism * 2, math.ceil(counts.rows / PART_ROWS))
    chunks = max(1, math.ceil(counts.anchors / PART_ANCHORS))
    heads = rows.filter(anchors)

    def pass_over(heads: DataFrame, second: bool) -> DataFrame:
        schema = "anchor_id long, positive_id long, positive_score long" + ", negative_id long, negative_score long" * second
        return _units(rows, heads, slices, chunks).groupBy("chunk", "slice").applyInArrow(_solver(limits, second), schema)

    def best(found: DataFrame, by: list[str], name: str, most: int) -> DataFrame:
        order = Window.partitionBy(*by).orderBy(F.desc(f"{name}_score"), f"{name}_id")
        return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= most)

    alike = best(pass_over(heads.withColumn("positives", F.lit(None).cast("array<struct<id:bigint,score:bigint>>")), False), ["anchor_id"], "positive", limits.positives)
    named = alike.groupBy(F.col("anchor_id").alias("id")).agg(F.collect_list(F.struct(F.col("positive_id").alias("id"), F.col("positive_score").alias("score"))).alias("positives"))
    with_positives = stage(heads.join(named, "id"), "anchors")
    found = best(pass_over(with_positives, True), ["anchor_id", "positive_id"], "negative", limits.negatives)
    return found.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
