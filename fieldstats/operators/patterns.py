"""Point patterns: distance functions, density, clusters, segregation."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldstats.functions.models import cell, distances
from fieldstats.operators.graph import components
from fieldstats.operators.pairs import knn_join, nearest_neighbor_distances, pairs, radius_join
from fieldstats.operators.ranks import ranked
from fieldstats.session import cut

#: Points that may be broadcast to block tasks.
BLOCK_LIMIT = 500_000


def check_radii(radii: Sequence[float]) -> list[float]:
    radii = [float(r) for r in radii]
    if not radii or any(r < 0 or not np.isfinite(r) for r in radii):
        raise ValueError("radii must be non-negative")
    return radii


def bounding_area(points: DataFrame) -> float:
    w = points.agg((F.max("x") - F.min("x")).alias("w"), (F.max("y") - F.min("y")).alias("h")).first()
    area = float((w.w or 0) * (w.h or 0))
    if area <= 0:
        raise ValueError("area must be positive")
    return area


def radii_frame(points: DataFrame, radii: Sequence[float]) -> DataFrame:
    return points.sparkSession.createDataFrame([(i, r) for i, r in enumerate(radii)], "i int, r double")


def _unstack(row: DataFrame, radii: Sequence[float]) -> DataFrame:
    """One row of columns s0, s1, ... to rows (r, s)."""
    return row.select(F.explode(F.array(*[F.struct(F.lit(r).alias("r"), F.col(f"s{i}").alias("s")) for i, r in enumerate(radii)])).alias("x")).select("x.r", "x.s")


def ripley_k(points: DataFrame, radii: Sequence[float], area: float | None = None) -> DataFrame:
    """r, k: 2 * area / n^2 times the pairs within r, without edge correction; one join for all radii."""
    radii = check_radii(radii)
    if area is not None and area <= 0:
        raise ValueError("area must be positive")
    area = bounding_area(points) if area is None else float(area)
    n = points.count()
    flat = points.select("id", "x", "y")
    top = max(radii)
    near = pairs(flat, top, n) if top > 0 else pairs(flat).filter("d <= 0")
    counts = near.agg(*[F.count(F.when(F.col("d") <= r, 1)).alias(f"s{i}") for i, r in enumerate(radii)])
    return _unstack(counts, radii).select("r", (F.col("s") * (2.0 * area / (n * n))).alias("k"))


def ripley_l(points: DataFrame, radii: Sequence[float], area: float | None = None) -> DataFrame:
    return ripley_k(points, radii, area).select("r", F.sqrt(F.col("k") / np.pi).alias("l"))


def _cdf(distances: DataFrame, radii: Sequence[float], name: str) -> DataFrame:
    shares = distances.agg(*[F.avg(F.when(F.col("distance") <= r, 1.0).otherwise(0.0)).alias(f"s{i}") for i, r in enumerate(radii)])
    return _unstack(shares, radii).select("r", F.col("s").alias(name))


def g_function(points: DataFrame, radii: Sequence[float]) -> DataFrame:
    """r, g: share of points whose nearest neighbour is within r."""
    return _cdf(nearest_neighbor_distances(points), check_radii(radii), "g")


def probes(spark, bounds: Sequence[float], n: int, seed: int | None) -> DataFrame:
    """Uniform probes; all x are drawn before all y."""
    xmin, xmax, ymin, ymax = bounds
    if xmax <= xmin or ymax <= ymin:
        raise ValueError("bounds must satisfy xmin < xmax and ymin < ymax")
    if n < 1:
        raise ValueError("n_random must be at least 1")
    rng = np.random.default_rng(seed)
    x, y = rng.uniform(xmin, xmax, n), rng.uniform(ymin, ymax, n)
    return spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(zip(x, y, strict=True))], "id long, x double, y double")


def f_function(points: DataFrame, radii: Sequence[float], bounds: Sequence[float] | None = None, n_random: int = 2_000, seed: int | None = None, targets: DataFrame | None = None) -> DataFrame:
    """r, f: share of probe places with a point within r; probes may be given as targets."""
    radii = check_radii(radii)
    if targets is None:
        if bounds is None:
            b = points.agg(F.min("x"), F.max("x"), F.min("y"), F.max("y")).first()
            bounds = tuple(b)
        targets = probes(points.sparkSession, bounds, n_random, seed)
    near = knn_join(targets.select("id", "x", "y"), points.select("id", "x", "y"), 1)
    return _cdf(near, radii, "f")


def pair_correlation(points: DataFrame, radii: Sequence[float], area: float | None = None) -> DataFrame:
    """r, pcf: slope of K over r by second-order differences on uneven r, one-sided at the ends, over 2 pi r."""
    radii = check_radii(radii)
    if any(r <= 0 for r in radii) or len(radii) < 2:
        raise ValueError("radii must be positive, at least two")
    k = ripley_k(points, radii, area)
    w = Window.partitionBy(F.lit(0)).orderBy("r")  # a row for each radius
    h0, h1 = F.col("r") - F.lag("r").over(w), F.lead("r").over(w) - F.col("r")
    k0, k2 = F.lag("k").over(w), F.lead("k").over(w)
    inner = (h0 * h0 * k2 + (h1 * h1 - h0 * h0) * F.col("k") - h1 * h1 * k0) / (h0 * h1 * (h0 + h1))
    slope = F.when(k0.isNull(), (k2 - F.col("k")) / h1).when(k2.isNull(), (F.col("k") - k0) / h0).otherwise(inner)
    return k.select("r", (slope / (2 * np.pi * F.col("r"))).alias("pcf"))


#: Half the side of a cell of the density sum, and the reach of a point, in standard deviations of the kernel; terms of the expansion.
KDE_HALF, KDE_REACH, KDE_TERMS = 0.25, 7.0, 12


def kde(points: DataFrame, bandwidth: float | None = None, grid_size: int = 100, bounds: Sequence[float] | None = None) -> DataFrame:
    """ix, iy, x, y, density of a Gaussian kernel whose covariance is the data's times bandwidth squared.

    The default factor is n^(-1/6).  Points are summed up to moments of small cells, in
    coordinates in which the kernel is round, and each cell adds a Hermite expansion of
    its moments to the grid places in reach.  Work is linear in points and in cells.

    A point's kernel is at most 1; its error is at most exp(-KDE_REACH^2 / 2) = 2e-11 for
    places out of reach, and within reach the remainder of the expansion in two
    coordinates, below 2 * KDE_TERMS * KDE_HALF^KDE_TERMS / sqrt(KDE_TERMS!) = 7e-11.
    """
    if grid_size < 2:
        raise ValueError("grid_size must be at least 2")
    m = points.agg(F.count("*").alias("n"), F.var_samp("x").alias("xx"), F.var_samp("y").alias("yy"), F.covar_samp("x", "y").alias("xy"), F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1")).first()
    if m.n < 2:
        raise ValueError("at least 2 points are required")
    factor = m.n ** (-1 / 6) if bandwidth is None else float(bandwidth)
    if factor <= 0:
        raise ValueError("bandwidth must be positive")
    h = np.array([[m.xx, m.xy], [m.xy, m.yy]]) * factor**2
    root = np.linalg.cholesky(h)
    a, b, c = float(root[0, 0]), float(root[1, 0]), float(root[1, 1])
    x0, x1, y0, y1 = map(float, (m.x0, m.x1, m.y0, m.y1) if bounds is None else bounds)
    spark = points.sparkSession
    sx, sy = (x1 - x0) / (grid_size - 1), (y1 - y0) / (grid_size - 1)
    scale = 1.0 / (m.n * 2 * np.pi * a * c)
    # round coordinates: x = a u, y = b u + c v
    u = F.col("x") / a
    v = (F.col("y") - b * F.col("u")) / c
    wide = 2 * KDE_HALF
    held = points.select("x", "y").withColumn("u", u).withColumn("v", v).withColumns({"i": F.floor(F.col("u") / wide), "j": F.floor(F.col("v") / wide)})
    held = held.withColumns({"p": F.col("u") - (F.col("i") + 0.5) * wide, "q": F.col("v") - (F.col("j") + 0.5) * wide})
    orders = [(s, t) for s in range(KDE_TERMS) for t in range(KDE_TERMS - s)]
    power = lambda name, k: F.lit(1.0) if k == 0 else F.col(name) if k == 1 else F.pow(name, F.lit(float(k)))
    moments_ = [F.sum(power("p", s) * power("q", t) / float(factorial(s) * factorial(t))) for s, t in orders]
    cells = held.groupBy("i", "j").agg(F.array(*moments_).alias("m"))
    reach = KDE_REACH + wide

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(grid_size * grid_size)
        span = (int(2 * reach * a / sx) + 2 if sx > 0 else grid_size, int(2 * reach * np.hypot(b, c) / sy) + 2 if sy > 0 else grid_size)
        nx, ny = (min(grid_size, k) for k in span)
        for batch in batches:
            cu, cv = ((batch.column(k).to_numpy() + 0.5) * wide for k in range(2))
            m = batch.column(2).flatten().to_numpy().reshape(len(cu), len(orders))
            size = max(1, 200_000 // (nx * ny))
            for start in range(0, len(cu), size):
                own = slice(start, start + size)
                at = lambda centre, low, step, k, half: np.clip(np.ceil((centre - half - low) / step) if step > 0 else 0 * centre, 0, grid_size - k).astype(np.int64)
                fx = at(a * cu[own], x0, sx, nx, reach * a)
                fy = at(b * cu[own] + c * cv[own], y0, sy, ny, reach * np.hypot(b, c))
                gx, gy = fx[:, None] + np.arange(nx), fy[:, None] + np.arange(ny)
                px, py = (x0 + gx * sx)[:, :, None], (y0 + gy * sy)[:, None, :]
                gu = px / a
                tu, tv = gu - cu[own][:, None, None], (py - b * gu) / c - cv[own][:, None, None]
                hu, hv = [np.ones_like(tu), tu], [np.ones_like(tv), tv]
                for k in range(2, KDE_TERMS):
                    hu.append(tu * hu[-1] - (k - 1) * hu[-2])
                    hv.append(tv * hv[-1] - (k - 1) * hv[-2])
                value = np.zeros(tv.shape)
                for k, (s, t) in enumerate(orders):
                    value += m[own, k][:, None, None] * hu[s] * hv[t]
                value *= np.exp(-0.5 * (tu * tu + tv * tv))
                np.add.at(total, (gy[:, None, :] * grid_size + gx[:, :, None]).ravel(), value.ravel())
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], ["id", "s"])

    sums = cells.mapInArrow(run, "id long, s double").groupBy("id").agg(F.greatest(F.sum("s") * scale, F.lit(0.0)).alias("density"))
    ix, iy = (F.col("id") % grid_size).cast("int").alias("ix"), F.floor(F.col("id") / grid_size).cast("int").alias("iy")
    return sums.select(ix, iy, "density").select("ix", "iy", (x0 + F.col("ix") * sx).alias("x"), (y0 + F.col("iy") * sy).alias("y"), "density")


def z_score(n: Column, mean: Column, spread: Column, wx: Column, w1: Column, w2: Column) -> Column:
    """Getis-Ord z: (sum wx - mean sum w) / (s sqrt((n sum w^2 - (sum w)^2) / (n - 1))), 0 where undefined."""
    inner = F.greatest((n * w2 - w1 * w1) / (n - 1), F.lit(0.0))
    below = spread * F.sqrt(inner)
    return F.when(below > 0, F.try_divide(wx - mean * w1, below)).otherwise(0.0)


def moments(points: DataFrame) -> DataFrame:
    """n, mean and s = sqrt(mean of squares less squared mean) as one row."""
    m = points.agg(F.count("*").alias("n"), F.avg("value").alias("mean"), F.avg(F.col("value") * F.col("value")).alias("square"))
    return m.select("n", "mean", F.sqrt(F.greatest(F.col("square") - F.col("mean") * F.col("mean"), F.lit(0.0))).alias("s"))


def gi_star(points: DataFrame, threshold: float, include_self: bool = True) -> DataFrame:
    """id, z of the local Getis-Ord statistic with binary weights within the threshold."""
    if threshold <= 0:
        raise ValueError("distance_threshold must be positive")
    if points.limit(3).count() < 3:
        raise ValueError("at least 3 observations are required")
    flat = points.select("id", "x", "y", "value")
    near = radius_join(flat, flat, threshold)
    if not include_self:
        near = near.filter("a_id != b_id")
    sums = near.groupBy(F.col("a_id").alias("id")).agg(F.sum("b_value").alias("wx"), F.count("*").cast("double").alias("w"))
    all_ = points.select("id").join(sums, "id", "left").fillna(0.0, ["wx", "w"]).crossJoin(F.broadcast(moments(points)))
    return all_.select("id", z_score(F.col("n"), F.col("mean"), F.col("s"), F.col("wx"), F.col("w"), F.col("w")).alias("z"))


#: Core points of a cell that one task holds when it looks for a link between two cells; larger cells are cut into parts.
CELL_PART = 50_000


def touching(a: np.ndarray, b: np.ndarray, eps: float) -> bool:
    """Whether a point of a and a point of b are within eps, by halving both sets along their boxes.

    A pair of boxes farther apart than eps is dropped, one that lies within eps as a whole settles the answer.
    """
    todo = [(a, b)]
    while todo:
        p, q = todo.pop()
        low, high = np.stack([p.min(0), q.min(0)]), np.stack([p.max(0), q.max(0)])
        gap = np.maximum(0.0, np.maximum(low[0] - high[1], low[1] - high[0]))
        if np.sqrt((gap * gap).sum()) > eps:
            continue
        wide = np.maximum(high[0] - low[1], high[1] - low[0])
        if np.sqrt((wide * wide).sum()) <= eps:
            return True
        if len(p) * len(q) <= 4_096:
            dx, dy = np.subtract.outer(p[:, 0], q[:, 0]), np.subtract.outer(p[:, 1], q[:, 1])
            if (np.sqrt(dx * dx + dy * dy) <= eps).any():
                return True
            continue
        if len(p) < len(q):
            p, q = q, p
        along = p[:, int(np.ptp(p, axis=0).argmax())]
        order = np.argsort(along, kind="stable")
        half = len(p) // 2
        todo += [(p[order[:half]], q), (p[order[half:]], q)]
    return False


def _cell_links(core: DataFrame, cells: DataFrame, eps: float) -> DataFrame:
    """Links (a, b), by first core id, of core cells that hold two core points within eps of each other."""
    around = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in range(3) for j in range(-2, 3) if (i, j) > (0, 0)])).alias("o")
    a = cells.select(*[F.col(c).alias(f"a_{c}") for c in cells.columns], around).withColumns({"b_cx": F.col("a_cx") + F.col("o.i"), "b_cy": F.col("a_cy") + F.col("o.j")}).drop("o")
    met = a.join(cells.select(*[F.col(c).alias(f"b_{c}") for c in cells.columns]), ["b_cx", "b_cy"])
    gap = [F.greatest(F.lit(0.0), F.col(f"a_{c}0") - F.col(f"b_{c}1"), F.col(f"b_{c}0") - F.col(f"a_{c}1")) for c in "xy"]
    wide = [F.greatest(F.col(f"a_{c}1") - F.col(f"b_{c}0"), F.col(f"b_{c}1") - F.col(f"a_{c}0")) for c in "xy"]
    length = lambda d: F.sqrt(d[0] * d[0] + d[1] * d[1])
    met = cut(met.filter(length(gap) <= eps).withColumn("sure", length(wide) <= eps))
    open_ = met.filter(~F.col("sure"))
    parts = {s: F.ceil(F.col(f"{s}_n") / CELL_PART).cast("int") for s in "ab"}
    sides = []
    for own, other in ("ab", "ba"):
        pairs_of = open_.select(F.col(f"{own}_cx").alias("cx"), F.col(f"{own}_cy").alias("cy"), "a_first", "b_first", parts[own].alias("mine"), parts[other].alias("others"), *[F.col(f"{other}_{c}") for c in ("x0", "x1", "y0", "y1")])
        out = [F.greatest(F.lit(0.0), F.col(f"{other}_{c}0") - F.col(c), F.col(c) - F.col(f"{other}_{c}1")) for c in "xy"]
        near = core.join(pairs_of, ["cx", "cy"]).filter(length(out) <= eps)
        near = near.withColumns({"part": F.pmod(F.xxhash64("id"), F.col("mine")).cast("int"), "other": F.explode(F.sequence(F.lit(0), F.col("others") - 1))})
        i, j = ("part", "other") if own == "a" else ("other", "part")
        sides.append(near.select("a_first", "b_first", F.col(i).alias("i"), F.col(j).alias("j"), F.lit(own == "a").alias("left"), "x", "y"))

    def link(table: pa.Table) -> pa.Table:
        left = table.column("left").to_numpy()
        place = np.stack([table.column(c).to_numpy() for c in "xy"], axis=1)
        found = left.any() and not left.all() and touching(place[left], place[~left], eps)
        return pa.table({"a": table.column("a_first")[:1], "b": table.column("b_first")[:1]}).slice(0, int(found))

    tested = sides[0].unionByName(sides[1]).groupBy("a_first", "b_first", "i", "j").applyInArrow(link, "a long, b long")
    return met.filter("sure").select(F.col("a_first").alias("a"), F.col("b_first").alias("b")).unionByName(tested)


def dbscan(points: DataFrame, eps: float, min_samples: int = 5) -> DataFrame:
    """id, label: density clusters numbered by their smallest core id, noise -1.

    A border point joins the lowest-numbered cluster it touches.  Cells have a diagonal of eps, so
    all points of a cell with min_samples of them are core without a look at any pair,
    and only points of emptier cells count their neighbours.  Clusters are components of core
    cells; two cells are linked by their boxes where these settle it, else by a search
    that stops at the first pair.  No table of near pairs is made.
    """
    if eps <= 0:
        raise ValueError("eps must be positive")
    if min_samples < 1:
        raise ValueError("min_samples must be at least 1")
    side = eps / np.sqrt(2) * (1 - 1e-9)  # the slack keeps points of a cell within eps whatever the rounding
    number = lambda c: F.floor(F.col(c) / side).cast("long").alias(f"c{c}")
    flat = points.select("id", F.col("x").cast("double"), F.col("y").cast("double")).withColumns({"cx": number("x"), "cy": number("y")})
    full = flat.groupBy("cx", "cy").agg((F.count("*") >= min_samples).alias("full"))
    tagged = cut(flat.join(full, ["cx", "cy"]))
    around = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in range(-2, 3) for j in range(-2, 3)]))
    loose = tagged.filter(~F.col("full")).drop("full")
    visits = loose.withColumn("o", around).select(F.col("id").alias("a_id"), F.col("x").alias("a_x"), F.col("y").alias("a_y"), (F.col("cx") + F.col("o.i")).alias("cx"), (F.col("cy") + F.col("o.j")).alias("cy"))
    dx, dy = F.col("a_x") - F.col("x"), F.col("a_y") - F.col("y")
    within = F.sqrt(dx * dx + dy * dy) <= eps
    crowded = visits.join(tagged.drop("full"), ["cx", "cy"]).filter(within).groupBy(F.col("a_id").alias("id")).agg(F.count("*").alias("n")).filter(F.col("n") >= min_samples).select("id")
    core = cut(tagged.filter("full").drop("full").unionByName(loose.join(crowded, "id", "left_semi").select("cx", "cy", "id", "x", "y")))
    cells = core.groupBy("cx", "cy").agg(F.min("id").alias("first"), F.count("*").alias("n"), *[f(c).alias(f"{c}{k}") for c in "xy" for f, k in ((F.min, 0), (F.max, 1))])
    whole = components(_cell_links(core, cells, eps))
    named = cells.select("cx", "cy", F.col("first").alias("node")).join(whole, "node", "left").select("cx", "cy", F.coalesce("label", "node").alias("label"))
    labelled = cut(core.join(named, ["cx", "cy"]))
    border = visits.join(labelled.select("cx", "cy", "x", "y", "label"), ["cx", "cy"]).filter(within).groupBy(F.col("a_id").alias("id")).agg(F.min("label").alias("label"))
    own = labelled.select("id", "label").unionByName(border.join(labelled.select("id"), "id", "left_anti"))
    clusters = ranked(labelled.select("label").distinct(), "label", name="cluster").withColumn("cluster", F.col("cluster") - 1)
    return points.select("id").join(own, "id", "left").join(clusters, "label", "left").select("id", F.coalesce("cluster", F.lit(-1)).cast("int").alias("label"))


def core_counts(points: DataFrame, eps: float, min_samples: int) -> DataFrame:
    """id, n, core: points within eps, the point itself included."""
    flat = points.select("id", "x", "y")
    return radius_join(flat, flat, eps).groupBy(F.col("a_id").alias("id")).agg(F.count("*").alias("n")).withColumn("core", F.col("n") >= min_samples)


def silhouettes(points: DataFrame, block: int = 1_024) -> DataFrame:
    """id and silhouette of each point of (id, x, y, label); 0 for the only point of a cluster, null with a single cluster.

    A task takes blocks of points and adds up their distances to all points by cluster, a
    block of each at a time: no row for a pair is made.  Points are broadcast, at most BLOCK_LIMIT.
    """
    rows = points.join(_numbered(points), "label").select("id", "x", "y", "c")
    data = rows.limit(BLOCK_LIMIT + 1).toPandas()
    if len(data) > BLOCK_LIMIT:
        raise ValueError(f"silhouettes take at most {BLOCK_LIMIT} points; sample them")
    data = data.sort_values("c", kind="stable")
    spark = points.sparkSession
    n_of = np.bincount(data["c"].to_numpy(np.int64)) if len(data) else np.zeros(0, np.int64)
    shared = spark.sparkContext.broadcast((data["id"].to_numpy(), data[["x", "y"]].to_numpy(float), data["c"].to_numpy(np.int64), n_of))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, place, cluster, n_of = shared.value
        for batch in batches:
            for k in batch.column(0).to_pylist():
                own = slice(k * block, min(len(ids), (k + 1) * block))
                sums = np.zeros((own.stop - own.start, len(n_of)))
                for start in range(0, len(ids), block):
                    d = distances(place[own], place[start : start + block])
                    # points are in order of cluster, so a cluster is a run of columns
                    c = cluster[start : start + block]
                    first = np.flatnonzero(np.append(True, c[1:] != c[:-1]))
                    sums[:, c[first]] += np.add.reduceat(d, first, axis=1)
                mine = cluster[own]
                at = np.arange(len(mine))
                inner = sums[at, mine] / np.maximum(n_of[mine] - 1, 1)
                means = sums / n_of
                means[at, mine] = np.inf
                outer = means.min(1)
                top = np.maximum(inner, outer)
                s = np.divide(outer - inner, top, out=np.zeros_like(top), where=(top > 0) & (n_of[mine] > 1))
                yield pa.RecordBatch.from_arrays([pa.array(ids[own]), pa.array(np.where(np.isinf(outer), np.nan, s), mask=np.isinf(outer))], ["id", "silhouette"])

    tasks = max(1, -(-len(data) // block)) if len(data) else 0
    return spark.range(tasks).repartition(max(1, min(tasks, 4 * spark.sparkContext.defaultParallelism)), "id").mapInArrow(run, "id long, silhouette double")


def _numbered(points: DataFrame) -> DataFrame:
    """label and its number c from 0; as many rows as there are clusters."""
    return ranked(points.select("label").distinct(), "label", name="c").select("label", (F.col("c") - 1).alias("c"))


def cluster_metrics(points: DataFrame, label: str = "label") -> DataFrame:
    """n_clusters, silhouette, calinski_harabasz, davies_bouldin; null below two clusters; noise (-1) is left out."""
    held = points.filter(F.col(label).cast("string") != "-1").select("id", "x", "y", F.col(label).alias("label"))
    centres = held.groupBy("label").agg(F.count("*").alias("n"), F.avg("x").alias("cx"), F.avg("y").alias("cy"))
    total = held.agg(F.count("*").alias("total"), F.avg("x").alias("mx"), F.avg("y").alias("my"))
    k = centres.count()
    empty = points.sparkSession.createDataFrame([(k, None, None, None)], "n_clusters long, silhouette double, calinski_harabasz double, davies_bouldin double")
    n = held.count()
    if k < 2 or k >= n:
        return empty
    away = held.join(F.broadcast(centres), "label").withColumn("e", (F.col("x") - F.col("cx")) ** 2 + (F.col("y") - F.col("cy")) ** 2)
    within = away.agg(F.sum("e").alias("within"))
    between = centres.crossJoin(total).agg(F.sum(F.col("n") * ((F.col("cx") - F.col("mx")) ** 2 + (F.col("cy") - F.col("my")) ** 2)).alias("between"))
    scatter = away.groupBy("label", "cx", "cy").agg(F.avg(F.sqrt("e")).alias("s"))
    p, q = scatter.alias("p"), scatter.alias("q")
    ratio = (F.col("p.s") + F.col("q.s")) / F.sqrt((F.col("p.cx") - F.col("q.cx")) ** 2 + (F.col("p.cy") - F.col("q.cy")) ** 2)
    db = p.join(q, F.col("p.label") != F.col("q.label")).groupBy(F.col("p.label")).agg(F.max(ratio).alias("r")).agg(F.avg("r").alias("davies_bouldin"))
    silhouette = silhouettes(held).agg(F.avg("silhouette").alias("silhouette"))
    ch = within.crossJoin(between).select((F.col("between") / (k - 1) / (F.col("within") / (n - k))).alias("calinski_harabasz"))
    return silhouette.crossJoin(ch).crossJoin(db).select(F.lit(k).cast("long").alias("n_clusters"), "silhouette", "calinski_harabasz", "davies_bouldin")


def segregation(points: DataFrame, n_cells: int = 10, bounds: Sequence[float] | None = None) -> DataFrame:
    """theil_h, cell_entropy, global_entropy, dissimilarity, n_groups of marked points on a grid.

    Points outside the bounds count in the border cells; logarithms are natural;
    dissimilarity is null unless there are exactly two marks.
    """
    if bounds is None:
        bounds = tuple(points.agg(F.min("x"), F.max("x"), F.min("y"), F.max("y")).first())
    x0, x1, y0, y1 = map(float, bounds)
    if x1 <= x0 or y1 <= y0:
        raise ValueError("bounds must satisfy xmin < xmax and ymin < ymax")
    counted = points.groupBy(cell(F.col("x"), x0, x1, n_cells).alias("cx"), cell(F.col("y"), y0, y1, n_cells).alias("cy"), "mark").agg(F.count("*").alias("n"))
    marks = counted.groupBy("mark").agg(F.sum("n").alias("t"))
    totals = marks.agg(F.sum("t").alias("total"), F.count("*").alias("k"))
    share = F.col("t") / F.col("total")
    world = marks.crossJoin(totals).agg(F.sum(-share * F.log(share)).alias("e"), F.max("total").alias("total"), F.max("k").alias("k"))
    cells = counted.withColumn("c", F.sum("n").over(Window.partitionBy("cx", "cy")))
    p = F.col("n") / F.col("c")
    local = cells.groupBy("cx", "cy", "c").agg(F.sum(-p * F.log(p)).alias("h"))
    local = local.crossJoin(world).agg(F.sum(F.col("c") / F.col("total") * F.col("h")).alias("cell"), F.max("e").alias("e"), F.max("k").alias("k"))
    order = marks.withColumn("which", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("mark")))
    shares = counted.join(F.broadcast(order), "mark").withColumn("s", F.col("n") / F.col("t"))
    gap = shares.groupBy("cx", "cy").agg(F.abs(F.sum(F.when(F.col("which") == 1, F.col("s")).otherwise(0.0)) - F.sum(F.when(F.col("which") == 2, F.col("s")).otherwise(0.0))).alias("g")).agg((0.5 * F.sum("g")).alias("d"))
    theil = F.when(F.col("e") > 0, F.try_divide(F.col("e") - F.col("cell"), F.col("e"))).otherwise(0.0)
    return local.crossJoin(gap).select(theil.alias("theil_h"), F.col("cell").alias("cell_entropy"), F.col("e").alias("global_entropy"), F.when(F.col("k") == 2, F.col("d")).alias("dissimilarity"), F.col("k").cast("double").alias("n_groups"))
