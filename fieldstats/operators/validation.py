"""Cross-validation, model choice and residual diagnostics.

A fixed model needs no refits: the residuals of every fold follow from the diagonal
blocks of one inverse (or, above kriging.MAX_SAMPLES, from solves by conjugate gradients: one for
each fold, all folds at once, or for leave-one-out one for each point, some of them a task).  Where the variogram is fitted to each training set,
folds are independent refits; samples are broadcast once and Spark runs the folds as tasks.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass, replace
from statistics import NormalDist
from types import SimpleNamespace

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldstats.functions import models
from fieldstats.operators import conjugate, kriging
from fieldstats.operators.fit import Variogram, criterion
from fieldstats.operators.extent import hull, widest
from fieldstats.operators.kriging import Kriging
from fieldstats.operators.ranks import normal_quantile, ranked
from fieldstats.operators.variogram import empirical
from fieldstats.sources.points import axes

VariogramBuilder = Callable[[np.ndarray, np.ndarray], Variogram] | Variogram
PredictorBuilder = Callable[[Variogram], Kriging]
#: Points of a cross-validation with a fixed model by folds, and one by one; refits train on at most kriging.MAX_SAMPLES.
MAX_POINTS = MAX_SAMPLES = conjugate.MAX_GLOBAL
LAG_ROWS = 1_024


def lag_arrays(coords: np.ndarray, values: np.ndarray, n_bins: int, max_distance: float | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The batch lag table (left-closed bins) of an in-memory sample, LAG_ROWS rows of pairs at a time."""
    rows = range(0, len(values), LAG_ROWS)
    if max_distance is None:
        ends = hull(coords) if coords.shape[1] == 2 else coords
        top = widest(ends) if coords.shape[1] == 2 else max(float(models.distances(coords[i : i + LAG_ROWS], coords[i:]).max()) for i in rows)
        max_distance = top / 2
    edges = np.linspace(0, max_distance, n_bins + 1)
    n, total = np.zeros(n_bins, np.int64), np.zeros(n_bins)
    for start in rows:
        own = slice(start, start + LAG_ROWS)
        d = models.distances(coords[own], coords[start:])
        later = np.arange(len(values) - start) > np.arange(len(d))[:, None]
        at = np.searchsorted(edges, d[later], "right") - 1
        g = 0.5 * np.subtract.outer(values[own], values[start:])[later] ** 2
        keep = at < n_bins
        n += np.bincount(at[keep], minlength=n_bins)
        total += np.bincount(at[keep], g[keep], n_bins)
    return (edges[:-1] + edges[1:]) / 2, total / np.maximum(n, 1), n


def default_variogram_builder(model: str = "spherical") -> VariogramBuilder:
    def build(coords: np.ndarray, values: np.ndarray) -> Variogram:
        n = len(values)
        bins = min(max(6, min(20, max(n // 2, 2))), max(n - 1, 1))
        return Variogram(model).fit(lag_arrays(coords, values, bins))

    return build


def default_kriging_builder(kind: str = "ordinary", **options) -> PredictorBuilder:
    return lambda variogram: Kriging(variogram, kind, **options)


@dataclass(frozen=True)
class CrossValidation:
    """Predictions by fold: id, fold, value, prediction, residual."""

    rows: DataFrame

    def summary(self) -> dict[str, float]:
        m = self.rows.agg(F.sqrt(F.avg(F.col("residual") ** 2)).alias("rmse"), F.sum(F.col("residual") ** 2).alias("s"), (F.var_pop("value") * F.count("*")).alias("t")).first()
        return {"rmse": m.rmse, "r2": 1 - m.s / m.t if m.t else float("nan")}


ROWS = "id long, fold int, value double, prediction double, residual double"


def _run(points: DataFrame, folds: list[tuple[int, np.ndarray]], ids, coords, values, build, predictor, least: int = 1) -> DataFrame:
    """folds: number and members of the test set, all others being trained on; with fewer than `least` of those the prediction is 0."""
    if isinstance(build, Variogram):
        model = predictor(build)
        if not (model.kind == "universal" and model.trend == "auto"):
            return _fixed(points, folds, ids, coords, values, model, least)
        fixed, build = build, lambda coords, values: fixed
    most = min(MAX_SAMPLES, kriging.MAX_SAMPLES)
    if len(ids) - min(len(test) for _, test in folds) > most:
        raise ValueError(f"cross-validation with refits trains on at most {most} points")
    spark = points.sparkSession
    shared = spark.sparkContext.broadcast((coords, values, ids, folds))

    def run(frames):
        coords, values, ids, folds = shared.value
        for frame in frames:
            for i in frame["id"]:
                number, test = folds[int(i)]
                out = np.zeros(len(test))
                train = np.ones(len(ids), bool)
                train[test] = False
                if train.sum() >= least:
                    model = predictor(build(coords[train], values[train])).fit_arrays(coords[train], values[train])
                    out = model.predict_arrays(coords[test])[0]
                yield pd.DataFrame({"id": ids[test], "fold": np.int32(number), "value": values[test], "prediction": out, "residual": values[test] - out})

    tasks = spark.range(len(folds)).repartition(max(1, min(len(folds), 4 * spark.sparkContext.defaultParallelism)))
    return tasks.mapInPandas(run, ROWS)


def _fixed(points: DataFrame, folds: list[tuple[int, np.ndarray]], ids, coords, values, model: Kriging, least: int) -> DataFrame:
    """The folds of a model that no fold changes."""
    spark, n = points.sparkSession, len(ids)
    learnt = [n - len(test) >= least for _, test in folds]
    tests = [test for (_, test), good in zip(folds, learnt, strict=True) if good]
    if n > kriging.MAX_SAMPLES and all(len(test) == 1 for test in tests):
        found = _one_by_one(spark, coords, values, model, np.concatenate(tests) if tests else np.zeros(0, int))[:, None]
    elif n > kriging.MAX_SAMPLES:
        found = [values[test] - p for test, p in zip(tests, model.fold_predictions(coords, values, tests, spark), strict=True)]
    elif model.kind == "simple" and model.mean is None:
        # the known mean is that of each training set, so what it takes from the right side is too
        system = replace(model, mean=0.0).fit_arrays(coords, values).system
        ones = replace(model, mean=0.0).fit_arrays(coords, np.ones(n)).system.dual
        means = [(values.sum() - values[t].sum()) / (n - len(t)) for t in tests]
        found = system.fold_residuals(tests, [system.dual[t] - m * ones[t] for t, m in zip(tests, means, strict=True)])
    else:
        found = model.fit_arrays(coords, values).system.fold_residuals(tests)
    sizes = [len(test) for _, test in folds]
    at = np.concatenate([test for _, test in folds])
    residual, good = values[at], np.repeat(learnt, sizes)
    residual[good] = np.concatenate([np.zeros(0), *found])
    number = np.repeat(np.array([k for k, _ in folds], np.int32), sizes)
    rows = pd.DataFrame({"id": ids[at], "fold": number, "value": values[at], "prediction": values[at] - residual, "residual": residual})
    return spark.createDataFrame(rows, ROWS)


def _one_by_one(spark, coords, values, model: Kriging, tests: np.ndarray) -> np.ndarray:
    """Residuals of samples left out one at a time: dual weights over the diagonal of the inverse of the system."""
    n = len(values)
    plain = replace(model, mean=0.0) if model.kind == "simple" and model.mean is None else model
    system = plain.fit_arrays(coords, values, spark).system
    dual, diagonal = system.dual[:n], conjugate.inverse_diagonal(spark, system.coords, system.model)
    if system.trend:
        diagonal = diagonal - np.sum(system.whitened * np.linalg.solve(system.drift_gram, system.whitened.T).T, axis=1)
    if plain is not model:
        # the known mean is that of the other samples
        ones = plain.fit_arrays(coords, np.ones(n), spark).system.dual[:n]
        dual = dual - (values.sum() - values) / (n - 1) * ones
    return (dual / diagonal)[tests]


def _arrays(points: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    rows = points.select("id", *axes(points), "value").orderBy("id").limit(MAX_POINTS + 1).toPandas()
    if len(rows) > MAX_POINTS:
        raise ValueError(f"cross-validation takes at most {MAX_POINTS} points")
    return rows["id"].to_numpy(), rows[axes(points)].to_numpy(float), rows["value"].to_numpy(float)


def leave_one_out(points: DataFrame, build: VariogramBuilder | None = None, predictor: PredictorBuilder | None = None) -> CrossValidation:
    """Each point predicted from all others; a Variogram as `build` is a fixed model and takes one solve for all."""
    ids, coords, values = _arrays(points)
    n = len(ids)
    if n < 3:
        raise ValueError("leave-one-out cross-validation requires at least 3 observations")
    if n > MAX_SAMPLES:
        raise ValueError(f"leave-one-out takes at most {MAX_SAMPLES} points; use folds")
    folds = [(i, np.array([i])) for i in range(n)]
    return CrossValidation(_run(points, folds, ids, coords, values, build or default_variogram_builder(), predictor or default_kriging_builder()))


def _drawn(step: Column, seed: int, start: Column) -> Column:
    """A uniform number in (0, 1) for each id, from a digest."""
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), start.cast("string"), step.cast("string"), F.col("id").cast("string")))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)


def _square(dims: Sequence[str], centre: Column) -> Column:
    return sum(((F.col(c) - centre[c]) * (F.col(c) - centre[c]) for c in dims), F.lit(0.0))


def spatial_folds(points: DataFrame, k: int, seed: int | None = None, starts: int = 10, most: int = 300) -> DataFrame:
    """id and fold by k-means on the coordinates, the best of some starts; by rank modulo k where there are no more points than folds.

    Seeding draws each centre with a chance that grows with the squared
    distance to those before it (the smallest -log(u) / d^2 of all points wins, u
    coming from a digest of the id), and a Lloyd step is one grouped aggregate; all starts take their steps in the
    same jobs.  The driver holds the centres only.
    """
    dims, seed = axes(points), seed or 0
    spark = points.sparkSession
    n = points.count()
    if k <= 1 or n <= k:
        order = Window.partitionBy(F.lit(0)).orderBy("id")  # no more rows than folds, or one fold
        return points.select("id", F.lit(0).alias("fold")) if k <= 1 else points.select("id", ((F.row_number().over(order) - 1) % k).cast("int").alias("fold"))
    kind = "struct<" + ", ".join(f"{c}: double" for c in dims) + ">"
    rows = points.select("id", *[F.col(c).cast("double") for c in dims]).persist()

    def against(centres: dict[int, list[tuple]]) -> DataFrame:
        """Rows of each start with the squared distance to its nearest centre, and the number of that centre."""
        table = spark.createDataFrame([(s, c) for s, c in centres.items()], f"start int, centres array<{kind}>")
        each = rows.crossJoin(F.broadcast(table))  # a few starts
        near = F.array_min(F.transform("centres", lambda c, i: F.struct(_square(dims, c).alias("d"), i.alias("c"))))
        return each.withColumn("near", near).select("start", "id", *dims, "near.d", "near.c")

    first = rows.crossJoin(F.broadcast(spark.range(starts).select(F.col("id").cast("int").alias("start"))))
    place = F.struct(*dims)
    found = first.groupBy("start").agg(F.min_by(place, F.struct(-F.log(_drawn(F.lit(0), seed, F.col("start"))), "id")).alias("at")).collect()
    centres = {r.start: [tuple(r["at"])] for r in found}
    for step in range(1, k):
        u = -F.log(_drawn(F.lit(step), seed, F.col("start")))
        # points on a centre come last
        key = F.struct((F.col("d") == 0).alias("on"), F.when(F.col("d") > 0, u / F.col("d")).otherwise(u).alias("key"), "id")
        for r in against(centres).groupBy("start").agg(F.min_by(place, key).alias("at")).collect():
            centres[r.start].append(tuple(r["at"]))
    moving = dict(centres)
    for _ in range(most):
        means = against(moving).groupBy("start", "c").agg(*[F.avg(c).alias(c) for c in dims]).collect()
        new = {s: list(c) for s, c in moving.items()}
        for r in means:
            new[r.start][r.c] = tuple(r[c] for c in dims)
        moved = {s for s in new if not np.allclose(new[s], moving[s], rtol=1e-12, atol=1e-14)}
        centres |= new
        moving = {s: new[s] for s in moved}
        if not moving:
            break
    cost = {r.start: r.cost for r in against(centres).groupBy("start").agg(F.sum("d").alias("cost")).collect()}
    best = min(cost, key=lambda s: (cost[s], s))
    out = against({best: centres[best]}).select("id", F.col("c").cast("int").alias("fold"))
    rows.unpersist()
    return out


def cross_validate(points: DataFrame, folds: DataFrame, build: VariogramBuilder | None = None, predictor: PredictorBuilder | None = None, least: int = 1) -> CrossValidation:
    """Each fold of (id, fold) predicted from all points outside of it; a point in several folds keeps the prediction of its last."""
    ids, coords, values = _arrays(points)
    held = folds.select("id", "fold").toPandas()
    place = np.searchsorted(ids, held["id"].to_numpy())
    tests = [(int(f), np.sort(place[held["fold"].to_numpy() == f])) for f in np.unique(held["fold"])]
    rows = _run(points, tests, ids, coords, values, build or default_variogram_builder(), predictor or default_kriging_builder(), least)
    last = rows.groupBy("id").agg(F.max_by(F.struct("fold", "value", "prediction", "residual"), "fold").alias("r"))
    return CrossValidation(last.select("id", "r.fold", "r.value", "r.prediction", "r.residual"))


def spatial_kfold(points: DataFrame, n_splits: int = 5, seed: int | None = None, build: VariogramBuilder | None = None, predictor: PredictorBuilder | None = None) -> CrossValidation:
    least = max(n_splits, 3)
    if points.limit(least).count() < least:
        raise ValueError(f"spatial k-fold cross-validation requires at least {least} observations")
    return cross_validate(points, spatial_folds(points, n_splits, seed), build, predictor)


def block_folds(points: DataFrame, nx: int = 2, ny: int = 2) -> DataFrame:
    """id, fold of each closed grid block that holds the point; a point on a shared edge is in several."""
    b = points.agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1")).first()
    ex, ey = np.linspace(b.x0, b.x1, nx + 1), np.linspace(b.y0, b.y1, ny + 1)
    cells = [(i * ny + j, float(ex[i]), float(ex[i + 1]), float(ey[j]), float(ey[j + 1])) for i in range(nx) for j in range(ny)]
    frame = F.broadcast(points.sparkSession.createDataFrame(cells, "fold int, x0 double, x1 double, y0 double, y1 double"))
    inside = F.col("x").between(F.col("x0"), F.col("x1")) & F.col("y").between(F.col("y0"), F.col("y1"))
    return points.select("id", "x", "y").join(frame, inside).select("id", "fold")


def block_cv(points: DataFrame, grid: tuple[int, int] = (2, 2), build: VariogramBuilder | None = None, predictor: PredictorBuilder | None = None) -> CrossValidation:
    """One fold a block; a point on a shared edge keeps the prediction of its last block, blocks that leave fewer than 3 training points predict 0."""
    if points.limit(3).count() < 3:
        raise ValueError("block cross-validation requires at least 3 observations")
    return cross_validate(points, block_folds(points, *grid), build, predictor, 3)


def select_model(points: DataFrame, candidates: Sequence[str] = models.MODELS, by: str = "aic", n_bins: int = 20) -> tuple[Variogram, dict[str, float]]:
    """The candidate with the lowest aic, bic or leave-one-out rmse, fitted, and all scores."""
    if by not in ("aic", "bic", "loo"):
        raise ValueError("criterion must be one of {'aic', 'bic', 'loo'}")
    table = empirical(points, n_bins=n_bins).orderBy("bin").toPandas()
    held = table[table["count"] > 0]
    d, g, w = (held[c].to_numpy(float) for c in ("lag", "gamma", "count"))
    fits = {m: Variogram(m).fit((d, g, w)) for m in candidates}
    if by == "loo":
        scores = {m: leave_one_out(points, default_variogram_builder(m)).summary()["rmse"] for m in candidates}
    else:
        scores = {m: criterion(by, v, d, g, w) for m, v in fits.items()}
    return fits[min(scores, key=scores.get)], scores


def standardized_residuals(rows: DataFrame, column: str = "residual") -> DataFrame:
    """Residuals over their sample standard deviation; zeros where it is 0."""
    spread = rows.agg(F.stddev_samp(column).alias("_sd"))
    scaled = F.when(F.col("_sd") > 0, F.try_divide(F.col(column), F.col("_sd"))).otherwise(0.0)
    return rows.crossJoin(F.broadcast(spread)).withColumn("standardized", scaled).drop("_sd")


def _poly(coefficients: Sequence[float], x: float) -> float:
    return sum(c * x**i for i, c in enumerate(coefficients))


def _shapiro(n: int, s) -> tuple[float, float]:
    """W and p-value by Royston's approximation (1995) from sums over the ordered values.

    s: mm, the squared normal scores; mx, scores times values between the tails; ss, the values'
    squares about their mean; x1, x2, y2, y1, the lowest and highest values; m1, m2, the highest scores.
    """
    if s.x1 == s.y1:
        return 1.0, 1.0
    if n == 3:
        top = np.sqrt(0.5) * (s.y1 - s.x1)
    else:
        u, norm = 1 / np.sqrt(n), np.sqrt(s.mm)
        # fixed values: Royston's polynomial coefficients
        an = _poly((s.m1 / norm, 0.221157, -0.147981, -2.071190, 4.434685, -2.706056), u)
        top = an * (s.y1 - s.x1)
        if n > 5:
            an1 = _poly((s.m2 / norm, 0.042981, -0.293762, -1.752461, 5.682633, -3.582633), u)
            phi = (s.mm - 2 * s.m1**2 - 2 * s.m2**2) / (1 - 2 * an**2 - 2 * an1**2)
            top += an1 * (s.y2 - s.x2)
        else:
            phi = (s.mm - 2 * s.m1**2) / (1 - 2 * an**2)
        top += s.mx / np.sqrt(phi)
    w = float(min(1.0, top**2 / s.ss))
    if n == 3:
        return w, max(0.0, 6 / np.pi * (np.arcsin(np.sqrt(w)) - np.arcsin(np.sqrt(0.75))))
    y = np.log(max(1 - w, 1e-300))
    if n <= 11:
        g = -2.273 + 0.459 * n
        if y >= g:
            return w, 1e-99
        y, mean, sd = -np.log(g - y), _poly((0.5440, -0.39978, 0.025054, -6.714e-4), n), np.exp(_poly((1.3822, -0.77857, 0.062767, -0.0020322), n))
    else:
        ln = np.log(n)
        mean, sd = _poly((-1.5861, -0.31082, -0.083751, 0.0038915), ln), np.exp(_poly((-0.4803, -0.082676, 0.0030302), ln))
    return w, float(0.5 * math.erfc((y - mean) / sd / math.sqrt(2)))


def shapiro_wilk(values: Sequence[float]) -> tuple[float, float]:
    """W and p-value of values in memory; NaN below three of them."""
    x = np.sort(np.asarray(values, float))
    n = len(x)
    if n < 3:
        return float("nan"), float("nan")
    m = np.array([NormalDist().inv_cdf((i - 0.375) / (n + 0.25)) for i in range(1, n + 1)])
    tail = 2 if n > 5 else 1
    held = slice(tail, n - tail)
    return _shapiro(n, SimpleNamespace(mm=m @ m, mx=m[held] @ x[held], ss=((x - x.mean()) ** 2).sum(), x1=x[0], x2=x[1], y2=x[-2], y1=x[-1], m1=m[-1], m2=m[-2]))


def shapiro_wilk_of(rows: DataFrame, column: str = "value", tie: str = "id") -> tuple[float, float]:
    """W and p-value of a column of any length, by one aggregate over distributed ranks; NaN below three values.

    Equal values are ranked by the column `tie`.  Royston checked the p-value up to 5,000 values.
    """
    held = rows.select(F.col(column).cast("double").alias("x"), F.col(tie).alias("_tie")).filter("x is not null")
    n = held.count()
    if n < 3:
        return float("nan"), float("nan")
    at = lambda r, c: F.max(F.when(F.col("rank") == r, F.col(c)))
    tail = 2 if n > 5 else 1
    middle = F.when(F.col("rank").between(tail + 1, n - tail), F.col("m") * F.col("x")).otherwise(0.0)
    sums = ranked(held, "x", "_tie").withColumn("m", normal_quantile((F.col("rank") - 0.375) / (n + 0.25))).agg(
        F.sum(F.col("m") * F.col("m")).alias("mm"), F.sum(middle).alias("mx"), (F.var_pop("x") * n).alias("ss"),
        at(1, "x").alias("x1"), at(2, "x").alias("x2"), at(n - 1, "x").alias("y2"), at(n, "x").alias("y1"), at(n, "m").alias("m1"), at(n - 1, "m").alias("m2"),
    )
    return _shapiro(n, sums.first())


def normality(rows: DataFrame, column: str = "residual", tie: str = "id") -> dict[str, float]:
    """Shapiro-Wilk test of a column; equal values are ranked by the column `tie`."""
    w, p = shapiro_wilk_of(rows, column, tie)
    return {"statistic": w, "p_value": p}


@dataclass
class Progress:
    """Stop rule of an iterative computation: iterations, patience on a falling score, checkpoint interval."""

    max_iterations: int = 100
    tolerance: float = 1e-6
    patience: int = 5
    interval: int = 10
    iteration: int = 0
    best: float = math.inf
    stale: int = 0

    def go_on(self, score: float) -> bool:
        self.iteration += 1
        better = score < self.best - self.tolerance
        self.best, self.stale = (score, 0) if better else (self.best, self.stale + 1)
        return self.iteration < self.max_iterations and self.stale < self.patience

    def checkpoint_due(self) -> bool:
        return self.iteration % self.interval == 0


def refit(variogram: Variogram, **parameters: float) -> Variogram:
    return replace(variogram, **parameters)
