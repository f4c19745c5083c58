"""Pair generation: all pairs, radius join, k-nearest-neighbour join.

The planner picks between three shapes.  Without a radius a small set is joined
with itself by id order; with a radius, points are put into square cells of the
radius's side and an equi-join on the cell finds each pair exactly once; a large
set without a radius goes through blocks (see variogram.block_sums).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldstats.functions.models import euclidean
from fieldstats.operators import blocks
from fieldstats.session import cut
from fieldstats.sources.points import axes

#: Sets up to this size are joined by nested loop; a broadcast of that many points is a few MB.
SMALL = 20_000
MOST_TASKS = 256


def _side(points: DataFrame, prefix: str, columns: list[str] | None = None) -> DataFrame:
    return points.select(*[F.col(c).alias(f"{prefix}_{c}") for c in columns or points.columns])


def _spread(side: DataFrame) -> DataFrame:
    """A small outer side of a nested loop over enough tasks to use the cores; its file alone may be one split."""
    return side.repartition(min(MOST_TASKS, side.sparkSession.sparkContext.defaultParallelism))


def separation(points: DataFrame, left: str = "a", right: str = "b", dims: list[str] | None = None) -> Column:
    dims = dims or axes(points)
    return euclidean([F.col(f"{left}_{c}") for c in dims], [F.col(f"{right}_{c}") for c in dims])


def all_pairs(points: DataFrame) -> DataFrame:
    """a_*, b_*, d for each unordered pair, a_id < b_id."""
    a, b = _spread(_side(points, "a")), _side(points, "b")
    return a.join(b, F.col("a_id") < F.col("b_id")).withColumn("d", separation(points))


def later_sums(points: DataFrame, blockwise: Callable, column: Callable[[list[Column], list[Column]], Column], dims: list[str] | None = None) -> DataFrame:
    """id, n, total, nearest, farthest: distances of each point to all of larger id; `blockwise` gives them for arrays, `column` for columns."""
    dims = dims or axes(points)
    found = blocks.later_sums(points, dims, blockwise)
    if found is not None:
        return found
    a, b = _spread(_side(points, "a", ["id", *dims])), _side(points, "b", ["id", *dims])
    d = column(*([F.col(f"{s}_{c}") for c in dims] for s in "ab"))
    return a.join(b, F.col("a_id") < F.col("b_id")).select(F.col("a_id").alias("id"), d.alias("d")).groupBy("id").agg(F.count("*").alias("n"), F.sum("d").alias("total"), F.min("d").alias("nearest"), F.max("d").alias("farthest"))


def cross_pairs(left: DataFrame, right: DataFrame) -> DataFrame:
    """a_*, b_*, d for each pair of a left and a right point."""
    return _spread(_side(left, "a")).crossJoin(_side(right, "b")).withColumn("d", separation(left))


def radius_join(left: DataFrame, right: DataFrame, radius: float, dims: list[str] | None = None) -> DataFrame:
    """a_*, b_*, d for each left and right point at most `radius` apart, by an equi-join on grid cells."""
    if radius <= 0:
        raise ValueError("radius must be positive")
    dims = dims or axes(left)
    cells = lambda: [F.floor(F.col(c) / radius).cast("long").alias(f"cell_{c}") for c in dims]
    a = left.select("*", *cells())
    for c in dims:
        a = a.withColumn(f"cell_{c}", F.explode(F.array(*[F.col(f"cell_{c}") + k for k in (-1, 0, 1)])))
    keys = [f"cell_{c}" for c in dims]
    a = a.select(*keys, *[F.col(c).alias(f"a_{c}") for c in left.columns])
    b = right.select(*cells(), *[F.col(c).alias(f"b_{c}") for c in right.columns])
    joined = a.join(b, keys).drop(*keys).withColumn("d", separation(left, dims=dims))
    return joined.filter(F.col("d") <= radius)


def index_statistics(points: DataFrame, size: float, dims: list[str] | None = None) -> DataFrame:
    """One row about the grid that a radius join of this size searches: points, cells, and the fewest, most and mean points of a cell."""
    if size <= 0:
        raise ValueError("size must be positive")
    cells = points.groupBy(*[F.floor(F.col(c) / size).alias(f"cell_{c}") for c in dims or axes(points)]).count()
    return cells.agg(F.sum("count").alias("points"), F.count("*").alias("cells"), F.min("count").alias("fewest"), F.max("count").alias("most"), F.avg("count").alias("mean"))


def radius_pairs(points: DataFrame, radius: float, dims: list[str] | None = None) -> DataFrame:
    """Unordered pairs at most `radius` apart."""
    return radius_join(points, points, radius, dims).filter("a_id < b_id")


def pairs(points: DataFrame, radius: float | None = None, n: int | None = None) -> DataFrame:
    """Planner: grid join where a radius bounds the pairs, else nested loop."""
    if radius is not None:
        n = points.count() if n is None else n
        if n > SMALL // 4:
            return radius_pairs(points, radius)
        return all_pairs(points).filter(F.col("d") <= radius)
    return all_pairs(points)


def nearest(candidates: DataFrame, k: int, key: str = "a_id", other: str = "b_id") -> DataFrame:
    """The k nearest candidates of each key, ties broken by id."""
    order = Window.partitionBy(key).orderBy("d", other)
    return candidates.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def knn_join(queries: DataFrame, points: DataFrame, k: int, max_distance: float | None = None, same: bool = False, dims: list[str] | None = None) -> DataFrame:
    """query_id, rank, neighbor_id, distance of the k nearest points, ties broken by id.

    same=True takes queries and points as one set and leaves out each point itself.
    Up to SMALL points every query sees all points (they are broadcast).  Beyond,
    rings of grid cells are searched with doubling radius; a query is settled once
    its k-th neighbour lies within the radius, and only unsettled ones go on.
    """
    if k < 1:
        raise ValueError("k must be at least 1")
    dims = dims or axes(points)
    want = points.select("id", *dims)
    ask = queries.select("id", *dims)
    box = want.agg(F.count("*").alias("n"), *[F.min(c).alias(f"lo_{c}") for c in dims], *[F.max(c).alias(f"hi_{c}") for c in dims]).first()
    n = box.n
    if same and n <= k:
        raise ValueError("k must be smaller than the number of points")
    apart = F.col("a_id") != F.col("b_id") if same else F.lit(True)

    def final(found: DataFrame) -> DataFrame:
        return found.select(F.col("a_id").alias("query_id"), "rank", F.col("b_id").alias("neighbor_id"), F.col("d").alias("distance"))

    if max_distance is not None:
        return final(nearest(radius_join(ask, want, max_distance, dims).filter(apart), k))
    everything = lambda part: nearest(_spread(_side(part, "a")).join(F.broadcast(_side(want, "b")), apart).withColumn("d", separation(points, dims=dims)), k)
    if n <= SMALL:
        return final(everything(ask))
    volume = 1.0
    for c in dims:
        volume *= max(box[f"hi_{c}"] - box[f"lo_{c}"], 1e-12)
    radius = (volume * 2.0 * (k + 1) / n) ** (1 / len(dims))
    widest = max(box[f"hi_{c}"] - box[f"lo_{c}"] for c in dims) * len(dims) or 1.0
    out, rest = None, ask
    while True:
        found = nearest(radius_join(rest, want, radius, dims).filter(apart), k)
        full = found.groupBy("a_id").count().filter(F.col("count") >= min(k, n - same)).select("a_id")
        done = final(found.join(full, "a_id", "left_semi"))
        out = done if out is None else out.unionByName(done)
        rest = cut(rest.join(full, rest["id"] == full["a_id"], "left_anti"))
        if not rest.limit(1).count():
            return out
        radius *= 2
        if radius > 4 * widest:  # queries far outside the points' extent
            return out.unionByName(final(nearest(cross_pairs(rest, want).filter(apart), k)))


def nearest_neighbor_distances(points: DataFrame, k: int = 1) -> DataFrame:
    """id, distance and neighbor_id of each point's k-th nearest other point (first two coordinates)."""
    found = knn_join(points, points, k, same=True, dims=["x", "y"])
    return found.filter(F.col("rank") == k).select(F.col("query_id").alias("id"), "distance", "neighbor_id")


def sparse_distances(points: DataFrame, max_distance: float | None = None, max_neighbors: int | None = None) -> DataFrame:
    """src, dst, d: a k-NN graph symmetrised by the maximum, or all pairs 0 < d <= max_distance."""
    if max_neighbors:
        one = knn_join(points, points, max_neighbors, same=True).select(F.col("query_id").alias("src"), F.col("neighbor_id").alias("dst"), F.col("distance").alias("d"))
    elif max_distance is not None:
        one = radius_join(points, points, max_distance).filter("d > 0").select(F.col("a_id").alias("src"), F.col("b_id").alias("dst"), "d")
        return one
    else:
        one = all_pairs(points).select(F.col("a_id").alias("src"), F.col("b_id").alias("dst"), "d")
    both = one.unionByName(one.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "d"))
    return both.groupBy("src", "dst").agg(F.max("d").alias("d"))


def graph_neighbors(graph: DataFrame, src: int, k: int) -> DataFrame:
    return graph.filter(F.col("src") == src).orderBy("d", "dst").limit(k)


def sparsity(graph: DataFrame, n: int) -> float:
    return 1.0 - graph.count() / float(n * n)


def filter_by_distance(neighbors: DataFrame, max_distance: float) -> DataFrame:
    """Neighbours within a distance; ranks stay gapless as neighbours come nearest first."""
    return neighbors.filter(F.col("distance") <= max_distance)


def valid_neighbors(neighbors: DataFrame, query_id: int) -> DataFrame:
    return neighbors.filter(F.col("query_id") == query_id).orderBy("rank")
