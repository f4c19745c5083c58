"""The largest distance between two points of a set, without pairing them.

In the plane both ends are corners of the convex hull: every partition keeps the
hull of its points, hulls of groups of partitions are merged until one is left,
and its opposite corners are followed once round.  In other dimensions, extreme points in
fixed directions give a lower bound; what lies too near the centre to
take part in a longer pair is left out, and the rest is compared in blocks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldstats.sources.points import axes

FAN_IN = 16
DIRECTIONS = 32
#: Points that stay after pruning in more than two dimensions and are compared in blocks.
MOST_ENDS = 200_000


def hull(points: np.ndarray) -> np.ndarray:
    """Corners of the convex hull of plane points, counter-clockwise."""
    if len(points) > 4 * FAN_IN:
        turn = np.linspace(0, 2 * np.pi, FAN_IN, endpoint=False)
        ends = np.unique((points @ np.stack([np.cos(turn), np.sin(turn)])).argmax(0))
        ring = _chain(points[ends])
        if len(ring) > 2:
            inside = np.ones(len(points), bool)
            for a, b in zip(ring, np.roll(ring, -1, axis=0), strict=True):
                inside &= (b[0] - a[0]) * (points[:, 1] - a[1]) - (b[1] - a[1]) * (points[:, 0] - a[0]) > 0
            points = points[~inside]
    return _chain(points)


def _chain(points: np.ndarray) -> np.ndarray:
    """Andrew's monotone chain."""
    rows = np.unique(points, axis=0).tolist()
    if len(rows) < 3:
        return np.array(rows).reshape(-1, 2)
    out: list[list[float]] = []
    for side in (rows, rows[::-1]):
        start = len(out)
        for p in side:
            while len(out) - start >= 2 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(p)
        out.pop()
    return np.array(out)


def widest(corners: np.ndarray) -> float:
    """Largest distance of two corners of a convex polygon, by a walk round it with two opposite hands."""
    n = len(corners)
    if n < 2:
        return 0.0
    ring = corners.tolist()
    best, j = 0.0, 1
    for i in range(n):
        a, b = ring[i], ring[(i + 1) % n]
        ex, ey = b[0] - a[0], b[1] - a[1]
        for _ in range(n):
            # the far hand moves on as long as it gets farther from the edge
            p, q = ring[j], ring[(j + 1) % n]
            best = max(best, *((p[0] - c[0]) ** 2 + (p[1] - c[1]) ** 2 for c in (a, b)), *((q[0] - c[0]) ** 2 + (q[1] - c[1]) ** 2 for c in (a, b)))
            if ex * (q[1] - p[1]) - ey * (q[0] - p[0]) <= 0:
                break
            j = (j + 1) % n
    return math.sqrt(best)


def _hulls(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = np.zeros((0, 2))
    for batch in batches:
        held = hull(np.concatenate([held, np.stack([c.to_numpy() for c in batch.columns], axis=1)]))
    yield pa.RecordBatch.from_arrays([pa.array(held[:, 0]), pa.array(held[:, 1])], ["x", "y"])


def corners(points: DataFrame) -> np.ndarray:
    """Corners of the hull of all points; as many as the data have, usually some dozens."""
    found = points.select("x", "y").mapInArrow(_hulls, "x double, y double")
    parts = points.sparkSession.sparkContext.defaultParallelism * 4
    while parts > 1:
        parts = math.ceil(parts / FAN_IN)
        found = found.repartition(parts).mapInArrow(_hulls, "x double, y double")
    return hull(found.toPandas().to_numpy(float).reshape(-1, 2))


def _pruned(points: DataFrame, dims: list[str]) -> float:
    """Largest distance in any number of dimensions."""
    rng = np.random.default_rng(0)
    ways = np.vstack([np.eye(len(dims)), rng.normal(size=(DIRECTIONS, len(dims)))])
    along = [sum((float(w) * F.col(c) for w, c in zip(way, dims, strict=True)), F.lit(0.0)) for way in ways]
    place = F.struct(*dims)
    row = points.agg(*[f(place, a).alias(f"e{i}{n}") for i, a in enumerate(along) for f, n in ((F.max_by, "a"), (F.min_by, "b"))]).first()
    if row is None or row[0] is None:
        return 0.0
    ends = np.unique(np.array([list(r) for r in row], float), axis=0)
    least = max(float(np.sqrt(((ends - e) ** 2).sum(1)).max()) for e in ends)
    centre = (ends.max(0) + ends.min(0)) / 2
    off = F.sqrt(sum(((F.col(c) - float(m)) ** 2 for c, m in zip(dims, centre, strict=True)), F.lit(0.0)))
    reach = points.agg(F.max(off)).first()[0]
    # a pair of length `least` or more has both ends at least that less the reach from the centre; the slack is for rounding
    outer = points.filter(off >= F.lit((least - reach) * (1 - 1e-12))).select(*dims).distinct().limit(MOST_ENDS + 1).toPandas().to_numpy(float)
    if len(outer) > MOST_ENDS:
        raise ValueError(f"more than {MOST_ENDS} points may be ends of the largest distance: give max_distance or edges")
    spark, block = points.sparkSession, 2_048
    shared = spark.sparkContext.broadcast(outer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, all_ = 0.0, shared.value
        for batch in batches:
            for i in batch.column(0).to_pylist():
                for start in range(i * block, len(all_), block):
                    a, b = all_[i * block : (i + 1) * block], all_[start : start + block]
                    square = sum(np.subtract.outer(a[:, d], b[:, d]) ** 2 for d in range(a.shape[1]))
                    best = max(best, float(square.max()))
        yield pa.RecordBatch.from_arrays([pa.array([math.sqrt(best)])], ["d"])

    tasks = max(1, math.ceil(len(outer) / block))
    return float(spark.range(tasks).repartition(min(tasks, 64), "id").mapInArrow(run, "d double").agg(F.max("d")).first()[0] or 0.0)


def largest_distance(points: DataFrame) -> float:
    """Largest pair distance; no point, or a single one, gives 0."""
    dims = axes(points)
    return widest(corners(points)) if dims == ["x", "y"] else _pruned(points, dims)
