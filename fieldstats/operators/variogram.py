"""Empirical variograms: cloud, lag tables, directional tables.

A lag table is (bin, lag, gamma, count).  closed='left' bins are [low, high), so
pairs at the last edge are left out; closed='right' bins are (low, high], with
the first edge in the first bin and the last edge included.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldstats.functions import models
from fieldstats.operators import blocks
from fieldstats.operators.extent import largest_distance
from fieldstats.operators.pairs import SMALL, all_pairs, pairs, radius_pairs
from fieldstats.operators.ranks import ranked
from fieldstats.sources.points import axes


def check_edges(edges: Sequence[float]) -> list[float]:
    edges = [float(e) for e in edges]
    if len(edges) < 2:
        raise ValueError("bin_edges must contain at least two values")
    if not np.all(np.isfinite(edges)):
        raise ValueError("bin_edges must be finite")
    if any(b <= a for a, b in zip(edges, edges[1:], strict=False)):
        raise ValueError("bin_edges must be strictly increasing")
    return edges


def bin_of(d: Column, edges: Sequence[float], closed: str = "left") -> Column:
    """Number of the bin that holds d, null outside; exact comparisons with the edges, no division."""
    low, high = float(edges[0]), float(edges[-1])
    passed = sum(((d >= float(e)) if closed == "left" else (d > float(e))).cast("int") for e in edges[1:-1])
    passed = passed if len(edges) > 2 else F.lit(0)
    inside = (d >= low) & (d < high) if closed == "left" else (d >= low) & (d <= high)
    return F.when(inside, passed.cast("int"))


def semivariance_column(value: str = "value") -> Column:
    step = F.col(f"a_{value}") - F.col(f"b_{value}")
    return 0.5 * step * step


def cloud(points: DataFrame) -> DataFrame:
    """a_id, b_id, d, gamma of every pair."""
    return all_pairs(points).select("a_id", "b_id", "d", semivariance_column().alias("gamma"))


def bins_frame(points: DataFrame, edges: Sequence[float]) -> DataFrame:
    rows = [(i, (a + b) / 2) for i, (a, b) in enumerate(zip(edges, edges[1:], strict=False))]
    return points.sparkSession.createDataFrame(rows, "bin int, lag double")


def lag_table(found: DataFrame, bins: DataFrame, empty: float | None = 0.0) -> DataFrame:
    """Every bin, with `empty` as gamma where there is no pair."""
    gamma = F.col("gamma") if empty is None else F.coalesce("gamma", F.lit(empty))
    return bins.join(found, "bin", "left").select("bin", "lag", gamma.alias("gamma"), F.coalesce("count", F.lit(0)).cast("long").alias("count"))


def default_edges(points: DataFrame, n_bins: int = 15, max_distance: float | None = None) -> list[float]:
    """n_bins equal bins from 0 to max_distance, by default half the largest pair distance."""
    top = largest_distance(points) / 2 if max_distance is None else float(max_distance)
    return np.linspace(0.0, top, n_bins + 1).tolist()


def empirical(points: DataFrame, edges: Sequence[float] | None = None, n_bins: int = 15, max_distance: float | None = None, closed: str = "left", n: int | None = None) -> DataFrame:
    """Lag table of half the mean squared difference; empty bins have gamma 0 and count 0."""
    if n_bins < 1:
        raise ValueError("n_bins must be at least 1")
    edges = default_edges(points, n_bins, max_distance) if edges is None else check_edges(edges)
    bins = bins_frame(points, edges)
    if edges[-1] <= edges[0]:
        return bins.select("bin", "lag", F.lit(0.0).alias("gamma"), F.lit(0).cast("long").alias("count"))
    n = points.count() if n is None else n
    if n > SMALL:
        extent = points.agg(*[(F.max(c) - F.min(c)).alias(c) for c in axes(points)]).first()
        if edges[-1] > 0.2 * max(extent):
            return lag_table(block_sums(points, edges, closed), bins)
        source = radius_pairs(points, edges[-1])
    else:
        source = all_pairs(points)
    found = source.select(bin_of(F.col("d"), edges, closed).alias("bin"), semivariance_column().alias("g")).filter(F.col("bin").isNotNull())
    return lag_table(found.groupBy("bin").agg(F.avg("g").alias("gamma"), F.count("*").alias("count")), bins)


def block_sums(points: DataFrame, edges: Sequence[float], closed: str = "left", block: int = blocks.OWN) -> DataFrame:
    """Bin means of all pairs without a join: tasks take blocks of points and return bin sums.

    The points are broadcast, which is refused above blocks.LIMIT; give a smaller
    largest edge (grid join) or a sample of points there.
    """
    found = blocks.bin_sums(points, edges, axes(points), closed, block=block)
    if found is None:
        raise ValueError(f"more than {blocks.LIMIT} points: bound the distance or sample the points")
    return found.select("bin", (F.col("total") / F.greatest("count", F.lit(1))).alias("gamma"), "count")


def sampled(points: DataFrame, max_points: int, seed: int = 0, **options) -> DataFrame:
    """Lag table of a uniform sample of about max_points points."""
    n = points.count()
    return empirical(points.sample(min(1.0, max_points / max(n, 1)), seed=seed), **options)


def sampled_pairs(points: DataFrame, n_pairs: int, seed: int = 0) -> DataFrame:
    """a_id, b_id, d, gamma of n_pairs pairs drawn with replacement from all pairs, without listing them.

    Pairs are numbered by rows of the upper triangle over the points in id order;
    numbers come from a digest of seed and draw, and are unranked to two places, which are
    looked up.  The draw depends on the ids and the seed only.
    """
    if n_pairs < 1:
        raise ValueError("n_pairs must be positive")
    dims = axes(points)
    place = ranked(points.select("id", *dims, "value"), "id", name="at").withColumn("at", F.col("at") - 1)
    n = place.count()
    if n < 2:
        raise ValueError("at least 2 points are required")
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("id").cast("string")))
    number = F.conv(F.substring(digest, 1, 15), 16, 10).cast("long") % F.lit(n * (n - 1) // 2)
    before = lambda i: F.expr(f"({i} * (2L * {n}L - {i} - 1L)) div 2")  # noqa: E731  pairs in the rows above
    guess = F.floor((F.lit(2.0 * n - 1) - F.sqrt(F.lit((2.0 * n - 1) ** 2) - 8.0 * F.col("t"))) / 2).cast("long")
    drawn = points.sparkSession.range(n_pairs).withColumn("t", number).withColumn("i", guess)
    # the root of a large number may be off by one
    drawn = drawn.withColumn("i", F.when(before("i") > F.col("t"), F.col("i") - 1).otherwise(F.col("i")))
    drawn = drawn.withColumn("i", F.when(before("(i + 1L)") <= F.col("t"), F.col("i") + 1).otherwise(F.col("i")))
    drawn = drawn.select(F.col("id").alias("draw"), F.col("i").alias("a_at"), (F.col("t") - before("i") + F.col("i") + 1).alias("b_at"))
    a, b = (place.select(*[F.col(c).alias(f"{s}_{c}") for c in place.columns]) for s in "ab")
    found = drawn.join(a, "a_at").join(b, "b_at")
    d = models.euclidean([F.col(f"a_{c}") for c in dims], [F.col(f"b_{c}") for c in dims])
    return found.select("draw", "a_id", "b_id", d.alias("d"), semivariance_column().alias("gamma"))


def sampled_variogram(points: DataFrame, n_pairs: int, edges: Sequence[float], seed: int = 0, closed: str = "left") -> DataFrame:
    """Lag table of sampled_pairs; counts are those of the draws."""
    edges = check_edges(edges)
    found = sampled_pairs(points, n_pairs, seed).select(bin_of(F.col("d"), edges, closed).alias("bin"), "gamma").filter("bin is not null")
    return lag_table(found.groupBy("bin").agg(F.avg("gamma").alias("gamma"), F.count("*").alias("count")), bins_frame(points, edges))


def check_directions(directions: Sequence[float], tolerance: float, n_bins: int) -> None:
    if not len(directions):
        raise ValueError("directions must not be empty")
    if not 0 < tolerance <= 90:
        raise ValueError("tolerance must be in (0, 90]")
    if n_bins < 1:
        raise ValueError("n_bins must be at least 1")


def directional_pairs(points: DataFrame, radius: float | None = None) -> DataFrame:
    """dx, dy, d, gamma of each pair of distinct places, within the radius if one is given."""
    if axes(points) != ["x", "y"]:
        raise ValueError("Directional variograms require 2D coordinates")
    found = all_pairs(points) if radius is None else pairs(points, radius)
    return found.filter("d > 0").select((F.col("b_x") - F.col("a_x")).alias("dx"), (F.col("b_y") - F.col("a_y")).alias("dy"), "d", semivariance_column().alias("gamma"))


def _axis_means(sums: DataFrame, directions: Sequence[float]) -> DataFrame:
    """angle, bin, gamma, count, spread of sums by number of the axis."""
    angles = F.array(*[F.lit(float(a)) for a in directions])
    n, mean = F.col("count"), F.col("total") / F.col("count")
    return sums.filter("count > 0").select(angles[F.col("axis")].alias("angle"), "bin", mean.alias("gamma"), "count", F.greatest(F.col("square") / n - mean * mean, F.lit(0.0)).alias("spread"))


def _axis_sums(points: DataFrame, directions: Sequence[float], tolerance: float, bandwidth: float | None, edges: Sequence[float]) -> DataFrame:
    """The same from a join."""
    found = directional_pairs(points, edges[-1]).withColumn("bin", bin_of(F.col("d"), edges)).filter(F.col("bin").isNotNull())
    axis = F.explode(F.array(*[F.struct(F.lit(float(a)).alias("angle"), F.lit(float(np.cos(np.radians(a)))).alias("c"), F.lit(float(np.sin(np.radians(a)))).alias("s")) for a in directions]))
    found = found.select("*", axis.alias("axis"))
    c, s = F.col("axis.c"), F.col("axis.s")
    near = F.abs(F.col("dx") * c + F.col("dy") * s) >= float(np.cos(np.radians(tolerance))) * F.col("d")
    if bandwidth is not None:
        near = near & (F.abs(F.col("dy") * c - F.col("dx") * s) <= bandwidth)
    return found.filter(near).groupBy(F.col("axis.angle").alias("angle"), "bin").agg(F.avg("gamma").alias("gamma"), F.count("*").alias("count"), F.var_pop("gamma").alias("spread"))


def directional(points: DataFrame, directions: Sequence[float] = (0.0, 45.0, 90.0, 135.0), tolerance: float = 22.5, bandwidth: float | None = None, max_distance: float | None = None, n_bins: int = 12, edges: Sequence[float] | None = None) -> DataFrame:
    """angle, bin, lag, gamma, count, ci_lower, ci_upper; empty bins have null gamma.

    Directions are axes in degrees counter-clockwise; a pair may fall in several.
    The interval is 1.96 standard errors from the population variance.
    """
    check_directions(directions, tolerance, n_bins)
    edges = default_edges(points, n_bins, max_distance) if edges is None else check_edges(edges)
    sums = blocks.bin_sums(points, edges, axes(points), angles=directions, tolerance=tolerance, bandwidth=bandwidth) if axes(points) == ["x", "y"] and points.count() > SMALL else None
    means = _axis_sums(points, directions, tolerance, bandwidth, edges) if sums is None else _axis_means(sums, directions)
    angles = points.sparkSession.createDataFrame([(float(a),) for a in directions], "angle double")
    half = 1.96 * F.sqrt(F.col("spread") / F.col("count"))
    return bins_frame(points, edges).crossJoin(angles).join(means, ["angle", "bin"], "left").select("angle", "bin", "lag", "gamma", F.coalesce("count", F.lit(0)).cast("long").alias("count"), (F.col("gamma") - half).alias("ci_lower"), (F.col("gamma") + half).alias("ci_upper"))


def summary(table: DataFrame) -> DataFrame:
    """Lags, pairs and largest semivariance of each direction."""
    held = F.col("count") > 0
    return table.groupBy("angle").agg(F.count(F.when(held, 1)).alias("lags"), F.sum("count").alias("pairs"), F.max("gamma").alias("max_gamma"))


def direction_ranges(table: DataFrame, fraction: float = 0.95, own_sill: bool = False) -> DataFrame:
    """angle and range: first lag whose gamma reaches a share of the sill (largest gamma of all or of the direction), else the last lag."""
    held = table.filter("count > 0 and gamma is not null and not isnan(gamma)")
    over = Window.partitionBy("angle") if own_sill else Window.partitionBy(F.lit(0))
    top = held.withColumn("sill", F.max("gamma").over(over))
    reached = F.min(F.when((F.col("sill") > 0) & (F.col("gamma") >= fraction * F.col("sill")), F.col("lag")))
    return top.groupBy("angle").agg(F.coalesce(reached, F.max("lag")).alias("range"), F.max("sill").alias("sill"))
