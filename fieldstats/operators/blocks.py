"""Pairs in numpy blocks over a broadcast of the points, for sets of at most LIMIT of them.

A task owns runs of points and meets all others a tile at a time, so memory does not grow with the number of pairs and no pair
is exchanged; each returns sums, or whole rows of weights. Points lie along a space-filling curve, so
tiles beyond the largest distance are left out. Distances are the same numbers as in the expressions of
functions.models, and bins are decided on squares by thresholds that agree with comparing the distances.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldstats.functions import models
from fieldstats.operators.conjugate import Boxes, curve_order

#: Points that may be broadcast: 32 bytes each.
LIMIT = 2_000_000
OWN, TILE = 64, 512
SLOTS = 1 << 16
#: Rows of weights that a task holds at once.
EDGES = 2_000_000


def threshold(edge: float, closed: str) -> float:
    """Smallest double whose root is at least the edge, or above it for bins closed on the right."""
    passed = (lambda s: math.sqrt(s) >= edge) if closed == "left" else (lambda s: math.sqrt(s) > edge)
    if edge <= 0:
        return 0.0 if passed(0.0) else math.ulp(0.0)
    s = edge * edge
    while passed(s):
        s = math.nextafter(s, 0.0)
    while not passed(s):
        s = math.nextafter(s, math.inf)
    return s


def arrays(points: DataFrame, columns: Sequence[str], finite: int) -> np.ndarray | None:
    """Rows of some columns as an array, if the first `finite` of them are so; None if there are more than LIMIT."""
    data = points.select(*columns).limit(LIMIT + 1).toPandas().to_numpy(float)
    return None if len(data) > LIMIT else data[np.isfinite(data[:, :finite]).all(axis=1)]


def tasks_of(points: DataFrame, rows: int, block: int = OWN) -> int:
    """Tasks for so many rows; blocks are dealt over them, so that neighbours in the order go to different ones."""
    return max(1, min(-(-rows // block), 4 * points.sparkSession.sparkContext.defaultParallelism))


def squares(a: np.ndarray, b: np.ndarray) -> list[np.ndarray]:
    """Steps from a to b by dimension, and the squared distance last."""
    steps = [np.subtract.outer(a[:, k], b[:, k]) for k in range(a.shape[1])]
    total = steps[0] * steps[0]
    for step in steps[1:]:
        total += step * step
    return [*steps, total]


def bin_sums(left: DataFrame, edges: Sequence[float], dims: Sequence[str], closed: str = "left", right: DataFrame | None = None, angles: Sequence[float] = (), tolerance: float = 90.0, bandwidth: float | None = None, skip: bool = False, block: int = OWN) -> DataFrame | None:
    """axis, bin, count, total, square: numbers and sums of semivariances (and their squares) of all pairs, or of those between two sets.

    With `angles` pairs of one place are left out, and a pair counts for each axis that it is within `tolerance` degrees of.
    None above LIMIT points, and above SLOTS sets of axes and bins. Points without finite coordinates are left out, with `skip` those without a finite value too.
    """
    if angles and (len(edges) << len(angles)) > SLOTS:
        return None
    columns = [*dims, "value"]
    sets = [arrays(x, columns, len(dims) + skip) for x in ([left] if right is None else [left, right])]
    if any(x is None for x in sets):
        return None
    spark, d = left.sparkSession, len(dims)
    sets = [x[curve_order(x[:, :d])] if len(x) else x for x in sets]
    lowest = 0.0 if closed == "right" and edges[0] <= 0 else threshold(edges[0], "left")
    inner = [threshold(e, closed) for e in edges[1:-1]]
    top = threshold(edges[-1], closed)
    axes = [(float(np.cos(np.radians(a))), float(np.sin(np.radians(a)))) for a in angles]
    cos, n_bins = float(np.cos(np.radians(tolerance))), len(edges) - 1
    shared = spark.sparkContext.broadcast((sets[0], sets[-1]))
    same, tasks = right is None, tasks_of(left, len(sets[0]), block)
    # without axes and odd values, bins are differences of what is nearer than each edge
    reach, plain = float(edges[-1]), not axes and all(np.isfinite(x[:, d]).all() for x in sets)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = shared.value
        sums, below = np.zeros((max(1, len(axes)), 3, n_bins)), np.zeros((2, n_bins + 1))
        slots = np.zeros((3, n_bins + 1 << len(axes)))
        boxes = Boxes(b[:, :d], TILE) if len(b) else None
        for batch in batches:
            for task in batch.column(0).to_pylist():
                for start in range(task * block, len(a) if boxes else 0, tasks * block):
                    own = a[start : start + block]
                    for at in boxes.near(own[:, :d], reach):
                        if same and at.stop <= start + 1:
                            continue
                        other = b[at]
                        *steps, s = squares(other[:, :d], own[:, :d])
                        if same and at.start < start + len(own):
                            s[np.arange(at.start, at.stop)[:, None] <= np.arange(start, start + len(own))] = np.inf
                        g = np.subtract.outer(other[:, d], own[:, d])
                        g *= 0.5 * g
                        if plain:
                            for k, t in enumerate([lowest, *inner, top]):
                                near = s < t
                                below[0, k] += np.count_nonzero(near)
                                below[1, k] += np.vdot(g.ravel(), near.ravel().astype(float))
                            continue
                        low = s < (max(lowest, math.ulp(0.0)) if axes else lowest)
                        if low.any():
                            s[low] = np.inf
                        key = np.zeros(s.shape, np.int32)
                        for t in [*inner, top]:
                            key += s >= t
                        least = cos * np.sqrt(s) if axes else None
                        for k, (c, si) in enumerate(axes):
                            hit = np.abs(steps[0] * c + steps[1] * si) >= least
                            if bandwidth is not None:
                                hit &= np.abs(steps[1] * c - steps[0] * si) <= bandwidth
                            key += hit * np.int32(n_bins + 1 << k)
                        key, g = key.ravel(), g.ravel()
                        # one slot for each bin, beyond the last edge too, and each set of axes
                        slots[0] += np.bincount(key, minlength=slots.shape[1])
                        slots[1] += np.bincount(key, g, slots.shape[1])
                        if axes:
                            slots[2] += np.bincount(key, g * g, slots.shape[1])
        by_axes = slots.reshape(3, -1, n_bins + 1)[:, :, :n_bins]
        chosen = np.arange(by_axes.shape[1])
        for k in range(len(sums)):
            sums[k] = by_axes[:, chosen >> k & 1 == 1 if axes else chosen == 0].sum(1)
        sums[0, :2] += np.diff(below)
        axis, bin_ = np.divmod(np.arange(sums.shape[0] * n_bins), n_bins)
        yield pa.RecordBatch.from_arrays([pa.array(axis.astype(np.int32)), pa.array(bin_.astype(np.int32)), pa.array(sums[:, 0].ravel().astype(np.int64)), pa.array(sums[:, 1].ravel()), pa.array(sums[:, 2].ravel())], ["axis", "bin", "count", "total", "square"])

    schema = "axis int, bin int, count long, total double, square double"
    found = spark.range(0, tasks, 1, tasks).mapInArrow(run, schema)
    # a few rows, made once however often they are read
    return spark.createDataFrame(found.groupBy("axis", "bin").agg(*[F.sum(c).alias(c) for c in ("count", "total", "square")]).collect(), schema)


def row_weights(points: DataFrame, radius: float, weight: Callable[[np.ndarray], np.ndarray], standardize: bool) -> DataFrame | None:
    """src, dst, w of all pairs (x, y) of different ids at most `radius` apart; rows are made whole, so their sums need no exchange.

    None above LIMIT points, or where ids are not whole numbers.
    """
    if dict(points.dtypes)["id"] not in ("int", "bigint", "smallint", "tinyint"):
        return None
    rows = points.select("id", "x", "y").limit(LIMIT + 1).toPandas()
    if len(rows) > LIMIT or rows["id"].isna().any():
        return None
    rows = rows[np.isfinite(rows[["x", "y"]].to_numpy(float)).all(axis=1)]
    ids, xy = rows["id"].to_numpy(np.int64), rows[["x", "y"]].to_numpy(float)
    if len(ids):
        order = curve_order(xy)
        ids, xy = ids[order], xy[order]
    spark, tasks = points.sparkSession, tasks_of(points, len(ids))
    shared = spark.sparkContext.broadcast((ids, xy))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, xy = shared.value
        boxes = Boxes(xy, TILE) if len(ids) else None
        size = max(1, min(OWN, EDGES // max(1, len(ids))))
        for batch in batches:
            for task in batch.column(0).to_pylist():
                for first in range(task * OWN, len(ids), tasks * OWN):
                    for start in range(first, min(first + OWN, len(ids)), size):
                        own = slice(start, min(start + size, first + OWN))
                        found = []
                        for at in boxes.near(xy[own], radius):
                            d = np.sqrt(squares(xy[own], xy[at])[-1])
                            i, j = np.nonzero((d <= radius) & (ids[own][:, None] != ids[at]))
                            found.append((i, j + at.start, weight(d[i, j])))
                        i, j, w = (np.concatenate(x) for x in zip(*found, strict=True))
                        if standardize:
                            total = np.bincount(i, w, len(ids[own]))[i]
                            w = np.divide(w, total, out=w.copy(), where=total != 0)
                        for k in range(0, len(i), EDGES):
                            part = slice(k, k + EDGES)
                            yield pa.RecordBatch.from_arrays([pa.array(ids[own][i[part]]), pa.array(ids[j[part]]), pa.array(w[part])], ["src", "dst", "w"])

    return spark.range(0, tasks, 1, tasks).mapInArrow(run, "src long, dst long, w double")


def later_sums(points: DataFrame, columns: Sequence[str], distance: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> DataFrame | None:
    """id, n, total, nearest, farthest: the distances of each point to all points of larger id, points without a larger one left out.

    `distance` gives them for all rows of two arrays of `columns`. None above LIMIT points, or where ids are not different whole numbers or a coordinate is null.
    """
    if dict(points.dtypes)["id"] not in ("int", "bigint", "smallint", "tinyint"):
        return None
    rows = points.select("id", *columns).limit(LIMIT + 1).toPandas()
    if len(rows) > LIMIT or rows.isna().any(axis=None) or rows["id"].duplicated().any():
        return None
    rows = rows.sort_values("id")
    spark, tasks = points.sparkSession, tasks_of(points, len(rows))
    shared = spark.sparkContext.broadcast((rows["id"].to_numpy(np.int64), rows[list(columns)].to_numpy(float)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, places = shared.value
        for batch in batches:
            for task in batch.column(0).to_pylist():
                for start in range(task * OWN, len(ids), tasks * OWN):
                    own = np.arange(start, min(start + OWN, len(ids)))
                    total, low, high = np.zeros(len(own)), np.full(len(own), np.inf), np.full(len(own), -np.inf)
                    for k in range(start, len(ids), max(OWN, TILE)):
                        d = distance(places[own], places[k : k + max(OWN, TILE)])
                        if k == start:  # the block's own points are in the first tile
                            later = np.arange(d.shape[1]) > np.arange(len(own))[:, None]
                            total += np.where(later, d, 0.0).sum(1)
                            low, high = np.where(later, d, np.inf).min(1), np.where(later, d, -np.inf).max(1)
                        else:
                            total += d.sum(1)
                            low, high = np.minimum(low, d.min(1)), np.maximum(high, d.max(1))
                    n = len(ids) - 1 - own
                    some = n > 0
                    yield pa.RecordBatch.from_arrays([pa.array(x[some]) for x in (ids[own], n, total, low, high)], ["id", "n", "total", "nearest", "farthest"])

    return spark.range(0, tasks, 1, tasks).mapInArrow(run, "id long, n long, total double, nearest double, farthest double")


def euclidean(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    s = squares(a, b)[-1]
    return np.sqrt(s, out=s)


def haversine(a: np.ndarray, b: np.ndarray, radius: float = models.EARTH_KM) -> np.ndarray:
    """Great-circle distances of points in degrees, latitude first; sines of half differences from those of half angles."""
    (p, u), (q, v) = np.radians(a).T, np.radians(b).T
    half = lambda x, y: np.multiply.outer(np.cos(x / 2), np.sin(y / 2)) - np.multiply.outer(np.sin(x / 2), np.cos(y / 2))
    h = half(u, v)
    h *= h
    h *= np.multiply.outer(np.cos(p), np.cos(q))
    s = half(p, q)
    s *= s
    h += s
    np.minimum(h, 1.0, out=h)
    np.sqrt(h, out=h)
    np.arcsin(h, out=h)
    h *= 2 * radius
    return h


def anisotropic(major: float, minor: float, angle: float) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    """Scaled distances with the major axis counter-clockwise at `angle` radians."""
    c, s = float(np.cos(angle)), float(np.sin(angle))

    def distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        dx, dy = (np.subtract.outer(-a[:, k], -b[:, k]) for k in range(2))
        u, v = (dx * c + dy * s) / major, (dy * c - dx * s) / minor
        u *= u
        v *= v
        u += v
        return np.sqrt(u, out=u)

    return distance
