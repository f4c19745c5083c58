"""Solves of large covariance systems by preconditioned conjugate gradients, without the matrix.

Most steps are taken with a fast product (see farfield), right to some places; products with the whole matrix
then tell what is left (`refined`). Every step of `solve` needs two products, each one Spark job whose tasks own blocks of rows:

- C v: a task makes the covariances of its rows with all samples a tile at a
  time, multiplies and forgets them; no matrix is stored anywhere.  Tiles farther apart than
  the covariance reaches are skipped, the samples being sorted along a space-filling curve.
- M r: the preconditioner is a product of sparse triangular factors.  Samples are put in a seeded
  random order, and each row of the factor is the local inverse of a sample
  and its nearest samples earlier in that order, so that early rows hold the
  large scales and late ones the small scales.  Rows are made once, in
  parallel, and stay with the executors; a lost one is made again.

The driver holds the coordinates and a few vectors of one number for each sample and
right side, which it sends to the tasks: at most MAX_GLOBAL samples, 2 MB a vector.
Work is n^2 covariances a step; the number of steps hardly depends on n.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.core.broadcast import Broadcast
from pyspark.sql import DataFrame, SparkSession

from fieldstats.functions import models
from fieldstats.operators.farfield import FarField, _correlation
from fieldstats.operators.fit import Variogram

MAX_GLOBAL = 250_000
NEIGHBORS = 40
BLOCK = 512
TILE = 2_048
ROWS, PART = 64, 512
PRODUCT = 65_536
#: Up to so many samples the whole matrix is quick enough.
FEW = 3_000
#: Numbers of an array of right sides that one task solves for.
NUMBERS = 4_000_000
#: A covariance below this share of the sill adds less than rounding does.
NEGLIGIBLE = 1e-18


def curve_order(coords: np.ndarray, bits: int = 10) -> np.ndarray:
    """Order along a Z-curve, so that runs of samples lie close together."""
    low, high = coords.min(0), coords.max(0)
    at = ((coords - low) / np.where(high > low, high - low, 1.0) * ((1 << bits) - 1)).astype(np.int64)
    key = np.zeros(len(coords), np.int64)
    for b in range(bits):
        for d in range(coords.shape[1]):
            key |= (at[:, d] >> b & 1) << (b * coords.shape[1] + d)
    return np.lexsort((*coords.T[::-1], key))


def reach(model: Variogram) -> float:
    """Distance from which on a covariance is below NEGLIGIBLE of the sill."""
    name = models.check_model(model.model)
    scale = {"spherical": 1.0, "exponential": -math.log(NEGLIGIBLE), "gaussian": math.sqrt(-math.log(NEGLIGIBLE))}
    return model.range * scale[name]


def squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of a and b."""
    h = np.zeros((len(a), len(b)))
    for d in range(a.shape[1]):
        step = np.subtract.outer(a[:, d], b[:, d])
        step *= step
        h += step
    return h


def correlation(h: np.ndarray, model: Variogram) -> np.ndarray:
    """The model without its nugget, scaled to 1 at distance 0, of squared distances, worked in place."""
    name = models.check_model(model.model)
    if name == "gaussian":
        h *= -1 / model.range**2
        return np.exp(h, out=h)
    np.sqrt(h, out=h)
    if name == "exponential":
        h *= -1 / model.range
        return np.exp(h, out=h)
    h /= model.range
    np.minimum(h, 1.0, out=h)
    return 1 - h * (1.5 - 0.5 * h * h)


def weighted_sums(targets: np.ndarray, coords: np.ndarray, model: Variogram, weights: np.ndarray) -> np.ndarray:
    """Covariances of targets with samples times the samples' weights, PRODUCT numbers at a time."""
    out = np.empty(len(targets))
    size = max(1, PRODUCT // max(1, len(coords)))
    for k in range(0, len(targets), size):
        h = squares(targets[k : k + size], coords)
        same = np.nonzero(h == 0) if model.nugget else None
        part = (model.sill - model.nugget) * (correlation(h, model) @ weights)
        if same is not None and len(same[0]):  # targets on samples have the nugget too
            part += model.nugget * np.bincount(same[0], weights[same[1]], len(part))
        out[k : k + size] = part
    return out


class Boxes:
    """Bounding boxes of tiles of consecutive samples."""

    def __init__(self, coords: np.ndarray, size: int = TILE) -> None:
        self.starts = np.arange(0, len(coords), size)
        self.low, self.high = np.minimum.reduceat(coords, self.starts), np.maximum.reduceat(coords, self.starts)
        self.ends = np.append(self.starts[1:], len(coords))

    def near(self, coords: np.ndarray, within: float) -> Iterator[slice]:
        """Tiles that are within a distance of the box of some samples."""
        gap = np.maximum(0.0, np.maximum(self.low - coords.max(0), coords.min(0) - self.high))
        for t in np.flatnonzero((gap * gap).sum(1) <= within * within):
            yield slice(self.starts[t], self.ends[t])


class Covariance:
    """The covariance matrix of samples as an operator; its vectors are arrays of one row a sample."""

    def __init__(self, spark: SparkSession, coords: np.ndarray, model: Variogram, neighbors: int = NEIGHBORS, seed: int = 0) -> None:
        if len(coords) > MAX_GLOBAL:
            raise ValueError(f"{len(coords)} samples: global kriging takes {MAX_GLOBAL}, use local kriging")
        self.spark, self.n, self.steps = spark, len(coords), 0
        self.order = curve_order(coords)
        sorted_ = np.ascontiguousarray(coords[self.order])
        rank = np.random.default_rng(seed).permutation(self.n)
        self.shared = spark.sparkContext.broadcast((sorted_, rank, model, Boxes(sorted_)))
        blocks = math.ceil(self.n / BLOCK)
        self.blocks = spark.range(blocks).repartition(min(blocks, 4 * spark.sparkContext.defaultParallelism), "id")
        self.factor = self.blocks.mapInArrow(_factor_rows(self.shared, neighbors), "row array<int>, earlier array<int>, weight array<double>").persist(StorageLevel.MEMORY_AND_DISK)

    def close(self) -> None:
        self.factor.unpersist()
        self.shared.destroy()
        if "far" in self.__dict__:
            self.far[1].destroy()

    @cached_property
    def far(self) -> tuple[FarField, Broadcast]:
        """The fast product of the samples in sorted order, with the rows of the factor, here and for tasks."""

        def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                parts = [batch.column(i).flatten().to_numpy().astype(kind).tobytes() for i, kind in enumerate((np.int32, np.int32, np.float32))]
                yield pa.RecordBatch.from_arrays([pa.array([x], pa.binary()) for x in parts], ["row", "earlier", "weight"])

        rows = self.factor.mapInArrow(packed, "row binary, earlier binary, weight binary").collect()
        entries = [np.concatenate([np.frombuffer(r[i], kind) for r in rows]) for i, kind in enumerate((np.int32, np.int32, np.float32))]
        fast = FarField(self.shared.value[0], self.shared.value[2], *entries)
        return fast, self.spark.sparkContext.broadcast(fast)

    def _fast_times(self, v: np.ndarray) -> np.ndarray:
        """About C v, a part of the tree a task."""
        shared, vector = self.far[1], self.spark.sparkContext.broadcast(v)
        parts = max(1, self.spark.sparkContext.defaultParallelism)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i in batch.column(0).to_pylist():
                    rows, some = shared.value.product(vector.value, i, parts)
                    yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in (rows.astype(np.int32), some)], ["rows", "part"])

        out = np.empty(v.shape, np.float32)
        for row in self.spark.range(0, parts, 1, parts).mapInArrow(run, "rows binary, part binary").collect():
            out[np.frombuffer(row.rows, np.int32)] = np.frombuffer(row.part, np.float32).reshape(-1, v.shape[1])
        vector.destroy()
        return out

    def refined(self, right: np.ndarray, held: np.ndarray | None = None, tolerance: float = 1e-11, most: int = 20) -> tuple[np.ndarray, np.ndarray]:
        """Solution and its product with the matrix, as solve has it but with fewer products with the whole matrix.

        Each of those gives a residual, which a solve with the fast product takes away. With `held`, 1 or 0 for
        each row and column, each column has the system of its own held rows. Where that does not get on (no nugget, very
        long ranges), and for few samples or three dimensions, the solution is left to solve.
        """
        held = np.ones(right.shape) if held is None else held
        own, back = held[self.order].astype(float), np.empty(self.n, int)
        back[self.order] = np.arange(self.n)
        b = right[self.order] * own
        size, x, r, before = np.linalg.norm(b, axis=0), np.zeros(b.shape), b, 1.0
        size = np.where(size > 0, size, 1)
        for _ in range(most if self.n > FEW and self.shared.value[0].shape[1] < 3 else 0):
            x = x + self.far[0].steer(r, min(0.1, max(1e-4, 0.3 * tolerance / before)), self._fast_times, own)
            product = self.times(x)
            r = (b - product) * own
            worst = float((np.linalg.norm(r, axis=0) / size).max())
            if worst <= tolerance:
                return x[back], product[back]
            if not worst < 0.3 * before:
                break
            before = worst
        x = self.solve(right, held=held)
        return x, self.times(x[self.order])[back]

    def _sum(self, frame: DataFrame, width: int) -> np.ndarray:
        """Sum of the partial vectors of the tasks, each a run of rows from `start` on."""
        out = np.zeros((self.n, width))
        for row in frame.toLocalIterator(prefetchPartitions=True) if self.n > MAX_GLOBAL // 5 else frame.collect():
            part = np.frombuffer(row.part, float).reshape(-1, width)
            out[row.start : row.start + len(part)] += part
        return out

    def times(self, v: np.ndarray) -> np.ndarray:
        """C v, v in the samples' sorted order."""
        shared, vector = self.shared, self.spark.sparkContext.broadcast(v)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            coords, _, model, boxes = shared.value
            v, within = vector.value, reach(model)
            name, scaled = models.check_model(model.model), coords / model.range
            for batch in batches:
                for b in batch.column(0).to_pylist():
                    rows = slice(b * BLOCK, (b + 1) * BLOCK)
                    own = scaled[rows]
                    out = np.zeros((len(own), v.shape[1]))
                    for at in boxes.near(coords[rows], within):
                        for j in range(at.start, at.stop, PART):
                            part = slice(j, min(j + PART, at.stop))
                            for k in range(0, len(own), ROWS):
                                out[k : k + ROWS] += _correlation(own[k : k + ROWS], scaled[part], name) @ v[part]
                    # all places differ, so the nugget is on the diagonal only
                    out = (model.sill - model.nugget) * out + model.nugget * v[b * BLOCK : b * BLOCK + len(own)]
                    yield pa.RecordBatch.from_arrays([pa.array([b * BLOCK]), pa.array([out.tobytes()])], ["start", "part"])

        out = self._sum(self.blocks.mapInArrow(run, "start long, part binary"), v.shape[1])
        vector.destroy()
        return out

    def precondition(self, r: np.ndarray) -> np.ndarray:
        """L' L r for the sparse factor L: each task adds up what its rows give."""
        n, vector = self.n, self.spark.sparkContext.broadcast(r)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            r = vector.value
            total = np.zeros(r.shape)
            some = False
            for batch in batches:
                row, earlier, weight = (batch.column(i).flatten().to_numpy() for i in range(3))
                if not len(row):
                    continue
                some = True
                at = np.concatenate([[0], np.cumsum(row[1:] != row[:-1])])
                for k in range(r.shape[1]):
                    s = np.bincount(at, weight * r[earlier, k])
                    total[:, k] += np.bincount(earlier, weight * s[at], n)
            if some:
                yield pa.RecordBatch.from_arrays([pa.array([0]), pa.array([total.tobytes()])], ["start", "part"])

        out = self._sum(self.factor.mapInArrow(run, "start long, part binary"), r.shape[1])
        vector.destroy()
        return out

    def solve(self, right: np.ndarray, tolerance: float = 1e-12, most: int = 500, held: np.ndarray | None = None) -> np.ndarray:
        """Solution for each column of `right`, to residuals of `tolerance` of its length; a ValueError after `most` steps without."""
        own = 1.0 if held is None else held[self.order].astype(float)
        b = right[self.order].astype(float) * own
        size = np.linalg.norm(b, axis=0)
        x, r = np.zeros_like(b), b.copy()
        z = self.precondition(r) * own
        p, rz = z.copy(), (r * z).sum(0)
        for self.steps in range(most + 1):
            left = np.linalg.norm(r, axis=0)
            if (left <= tolerance * size).all():
                out = np.empty_like(x)
                out[self.order] = x
                return out
            if not np.isfinite(left).all():
                break
            q = self.times(p) * own
            # a column that is solved already moves no further
            step = np.divide(rz, (p * q).sum(0), out=np.zeros_like(rz), where=left > tolerance * size)
            x += step * p
            r -= step * q
            z = self.precondition(r) * own
            new = (r * z).sum(0)
            p = z + np.divide(new, rz, out=np.zeros_like(rz), where=rz > 0) * p
            rz = new
        raise ValueError(f"the covariance system was not solved to {tolerance} in {most} steps; a larger nugget makes it better conditioned")


def columns(n: int) -> int:
    """Right sides that a task solves for at once."""
    return int(min(256, max(8, NUMBERS // n)))


def _factor_rows(shared, neighbors: int):
    """Rows of the factor for blocks of samples: weights of a sample and its nearest samples of lower rank."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coords, rank, model, _ = shared.value
        n = len(coords)
        by_rank = np.argsort(rank)
        ranked = coords[by_rank]
        for batch in batches:
            for b in batch.column(0).to_pylist():
                rows = np.arange(b * BLOCK, min(n, (b + 1) * BLOCK))
                rows = rows[np.argsort(rank[rows])]
                lists = []
                for part in np.array_split(rows, max(1, len(rows) // 64)):
                    before = int(rank[part].max())
                    k = min(neighbors, before)
                    places = coords[part]
                    margin = float(np.ptp(coords, axis=0).max()) * math.sqrt(max(k, 1) / max(before, 1))
                    while True:
                        # earlier samples around these; the k-th nearest within the margin are the nearest of all
                        inside = np.flatnonzero(((ranked[:before] >= places.min(0) - margin) & (ranked[:before] <= places.max(0) + margin)).all(1))
                        d = models.distances(places, ranked[inside])
                        d[inside >= rank[part][:, None]] = np.inf
                        if len(inside) == before or len(inside) > k and (np.partition(d, k - 1, axis=1)[:, k - 1] <= margin).all():
                            break
                        margin *= 2
                    near = np.argpartition(d, k - 1, axis=1)[:, :k] if 0 < k < len(inside) else np.tile(np.arange(len(inside)), (len(part), 1))
                    far = np.isinf(np.take_along_axis(d, near, 1)) if before else np.zeros((len(part), 0), bool)
                    lists += [by_rank[inside[m[~f]]] for m, f in zip(near, far, strict=True)]
                sizes = np.array([len(x) for x in lists])
                row, earlier, weight = [], [], []
                for k in np.unique(sizes):
                    chosen = np.flatnonzero(sizes == k)
                    own, others = rows[chosen], np.stack([lists[i] for i in chosen]).astype(np.int64)
                    local = np.concatenate([others, own[:, None]], axis=1)
                    places = coords[local]
                    h = np.sqrt(((places[:, :, None] - places[:, None]) ** 2).sum(3))
                    c = models.cov(h, model.model, model.nugget, model.sill, model.range)
                    # the last row of the inverse of the local Cholesky factor
                    last = np.zeros((len(own), k + 1, 1))
                    last[:, -1] = 1.0
                    # a slight ridge lets nearly equal places through; it touches the preconditioner only
                    w = np.linalg.solve(c + 1e-10 * model.sill * np.eye(k + 1), last)[:, :, 0]
                    w /= np.sqrt(np.maximum(w[:, -1:], 1e-300))
                    row.append(np.repeat(own, k + 1))
                    earlier.append(local.ravel())
                    weight.append(w.ravel())
                columns = [pa.array([np.concatenate(x)], pa.list_(kind)) for x, kind in ((row, pa.int32()), (earlier, pa.int32()), (weight, pa.float64()))]
                yield pa.RecordBatch.from_arrays(columns, ["row", "earlier", "weight"])

    return run


def inverse_diagonal(spark: SparkSession, coords: np.ndarray, model: Variogram) -> np.ndarray:
    """Diagonal of the inverse of the covariance matrix of samples; a task solves for some of them, so work is n solves."""
    operator = Covariance(spark, coords, model)
    try:
        shared, n, order = operator.far[1], operator.n, operator.order
        width = columns(n)
        blocks = math.ceil(n / width)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i in batch.column(0).to_pylist():
                    at = np.arange(i * width, min(n, (i + 1) * width))
                    b = np.zeros((n, len(at)))
                    b[at, at - at[0]] = 1.0
                    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(shared.value.functionals(b, 1 / model.sill))], ["row", "value"])

        found = spark.range(0, blocks, 1, blocks).mapInArrow(run, "row long, value double").toPandas()
    finally:
        operator.close()
    out = np.empty(n)
    out[order[found["row"].to_numpy()]] = found["value"].to_numpy()
    return out
