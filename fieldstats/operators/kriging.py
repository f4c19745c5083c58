"""Kriging: fit solves one system, predict is a map over targets.

Up to MAX_SAMPLES samples are solved densely on the driver (a 512 MB matrix), more of them, up
to conjugate.MAX_GLOBAL, by conjugate gradients over Spark tasks that never hold
the matrix; targets are not collected.  Predictions use dual weights; variances
use the inverse Cholesky factor, or the bordered system where the covariance
matrix is not positive definite.  Local kriging joins each target to its
neighbours and has no limit.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldstats.functions import models
from fieldstats.operators import conjugate
from fieldstats.operators.fit import Variogram
from fieldstats.operators.pairs import knn_join
from fieldstats.sources.points import axes

MAX_SAMPLES = 8_000
#: Targets whose variance is asked of a system without a factorisation.
MAX_SOLVED_TARGETS = 1_000_000
SINGULAR = "Singular covariance matrix - check for duplicate points or poor conditioning"


def lower_inverse(lower: np.ndarray, block: int = 128) -> np.ndarray:
    """Inverse of a lower triangular matrix by halves, so that nearly all work is matrix products."""
    n = len(lower)
    if n <= block:
        return np.tril(np.linalg.inv(lower))
    h = n // 2
    out = np.zeros_like(lower)
    out[:h, :h], out[h:, h:] = lower_inverse(lower[:h, :h], block), lower_inverse(lower[h:, h:], block)
    out[h:, :h] = -out[h:, h:] @ (lower[h:, :h] @ out[:h, :h])
    return out


@dataclass(frozen=True)
class System:
    """A factorised kriging system."""

    coords: np.ndarray
    model: Variogram
    trend: str | None
    mean: float
    dual: np.ndarray
    inverse: np.ndarray | None
    whitened: np.ndarray | None
    drift_gram: np.ndarray | None
    bordered: np.ndarray | None

    @classmethod
    def build(cls, coords: np.ndarray, values: np.ndarray, model: Variogram, trend: str | None = "constant", mean: float = 0.0, solve: Callable[[np.ndarray], np.ndarray] | None = None) -> System:
        """trend None is simple kriging with a known mean, 'constant' ordinary, 'linear' or 'quadratic' universal.

        `solve` gives the covariance matrix's solution for each column of an array;
        without it the matrix is made and factorised here.
        """
        if not model.fitted:
            raise ValueError("Variogram must be fitted before kriging")
        if len(coords) != len(values):
            raise ValueError("Coordinates and values must have same length")
        if solve is None and len(coords) > MAX_SAMPLES:
            raise ValueError(f"{len(coords)} samples: a dense solve takes {MAX_SAMPLES}, fit a DataFrame or use local kriging")
        if len(np.unique(coords, axis=0)) < len(coords):
            raise ValueError(SINGULAR)
        drift = models.design(coords, trend) if trend else np.zeros((len(coords), 0))
        m = drift.shape[1]
        if solve is not None:
            solved = solve(np.column_stack([values - mean, drift]))
            alone, whitened = solved[:, 0], solved[:, 1:]
            gram = drift.T @ whitened
            mu = np.linalg.solve(gram, drift.T @ alone) if m else np.zeros(0)
            return cls(coords, model, trend, mean, np.concatenate([alone - whitened @ mu, mu]), None, whitened, gram, None)
        c = models.cov(models.distances(coords, coords), model.model, model.nugget, model.sill, model.range)
        try:
            inverse = lower_inverse(np.linalg.cholesky(c))
        except np.linalg.LinAlgError:
            whole = np.block([[c, drift], [drift.T, np.zeros((m, m))]])
            try:
                dual = np.linalg.solve(whole, np.concatenate([values - mean, np.zeros(m)]))
            except np.linalg.LinAlgError:
                raise ValueError(SINGULAR) from None
            if not np.isfinite(dual).all():
                raise ValueError(SINGULAR) from None
            return cls(coords, model, trend, mean, dual, None, None, None, whole)
        whitened, z = inverse @ drift, inverse @ (values - mean)
        gram = whitened.T @ whitened
        mu = np.linalg.solve(gram, whitened.T @ z) if m else np.zeros(0)
        dual = np.concatenate([inverse.T @ (z - whitened @ mu), mu])
        if not np.isfinite(dual).all():
            raise ValueError(SINGULAR)
        return cls(coords, model, trend, mean, dual, inverse, whitened, gram, None)

    def predict(self, targets: np.ndarray, variance: bool) -> tuple[np.ndarray, np.ndarray | None]:
        v, n = self.model, len(self.coords)
        f = models.design(targets, self.trend) if self.trend else np.zeros((len(targets), 0))
        prediction = conjugate.weighted_sums(targets, self.coords, v, self.dual[:n]) + f @ self.dual[n:] + self.mean
        if not variance:
            return prediction, None
        c = models.cov(models.distances(targets, self.coords), v.model, v.nugget, v.sill, v.range)
        if self.bordered is not None:
            right = np.concatenate([c, f], axis=1).T
            left = np.sum(right * np.linalg.solve(self.bordered, right), axis=0)
            return prediction, np.maximum(v.sill - left, 0)
        if self.inverse is None:
            raise ValueError("a system solved by conjugate gradients has variances for targets in a DataFrame only")
        u = self.inverse @ c.T
        left = v.sill - np.sum(u * u, axis=0)
        if self.trend:
            q = f.T - self.whitened.T @ u
            left += np.sum(q * np.linalg.solve(self.drift_gram, q), axis=0)
        return prediction, np.maximum(left, 0)

    def variances(self, targets: np.ndarray, solve: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
        """Variances of a few targets; `whitened` holds the solution for the drift.

        `solve` gives for each column of covariances either its solution or at once the two's product. A target on a sample
        needs neither: its covariances are a column of the matrix, so it has that sample's value for certain.
        """
        v, out = self.model, np.zeros(len(targets))
        width = conjugate.columns(len(self.coords))
        for start in range(0, len(targets), width):
            some = targets[start : start + width]
            h = models.distances(self.coords, some)
            at = np.flatnonzero((h > 0).all(axis=0))
            if not len(at):
                continue
            c = models.cov(h[:, at], v.model, v.nugget, v.sill, v.range)
            found = solve(c)
            left = v.sill - (found if found.ndim == 1 else np.sum(c * found, axis=0))
            if self.trend:
                q = models.design(some[at], self.trend).T - self.whitened.T @ c
                left += np.sum(q * np.linalg.solve(self.drift_gram, q), axis=0)
            out[start + at] = np.maximum(left, 0)
        return out

    def fold_residuals(self, folds: Sequence[np.ndarray], right: Sequence[np.ndarray] | None = None) -> list[np.ndarray]:
        """Observed less predicted in each fold, had its samples been left out; from this one factorisation.

        With P the inverse of the system (its samples' rows and columns), the
        residuals of the samples S are the solution of P[S, S] e = (P z)[S]; the right
        sides are the dual weights unless given.
        """
        n, whole = len(self.coords), None
        if self.bordered is not None:
            whole = np.linalg.inv(self.bordered)[:n, :n]
        elif self.inverse is None:
            raise ValueError("a system solved by conjugate gradients has no inverse to take residuals from")
        out = []
        for k, fold in enumerate(folds):
            if whole is not None:
                p = whole[np.ix_(fold, fold)]
            else:
                a = self.inverse[:, fold]
                p = a.T @ a
                if self.trend:
                    b = self.whitened.T @ a
                    p = p - b.T @ np.linalg.solve(self.drift_gram, b)
            try:
                out.append(np.linalg.solve(p, self.dual[fold] if right is None else right[k]))
            except np.linalg.LinAlgError:
                raise ValueError(SINGULAR) from None
        return out


@dataclass(frozen=True)
class Kriging:
    """A kriging estimator; fit() takes a point set with values and returns a fitted one."""

    variogram: Variogram
    kind: str = "ordinary"
    mean: float | None = None
    trend: str = "auto"
    angle: float = 0.0
    range_minor: float | None = None
    solver: str = "auto"
    system: System | None = None

    def __post_init__(self) -> None:
        if self.solver not in ("auto", "dense", "iterative"):
            raise ValueError("solver must be one of {'auto', 'dense', 'iterative'}")
        if self.kind == "universal" and self.trend not in ("auto", "linear", "quadratic"):
            raise ValueError("trend must be one of {'auto', 'linear', 'quadratic'}")
        if self.kind == "anisotropic" and (self.range_minor is None or not self.variogram.fitted):
            raise ValueError("Anisotropic kriging requires 5 variogram parameters: nugget, sill, range_major, range_minor, angle")

    def shape(self, coords: np.ndarray) -> np.ndarray:
        """Coordinates as the system sees them: for anisotropic models those in which the range is 1."""
        if self.kind != "anisotropic":
            return coords
        return np.stack(models.to_isotropic(coords[:, 0], coords[:, 1], self.variogram.range, self.range_minor, self.angle), axis=1)

    def fit(self, samples: DataFrame) -> Kriging:
        dims = axes(samples)
        if self.kind == "anisotropic" and dims != ["x", "y"]:
            raise ValueError("Anisotropic kriging requires 2D coordinates")
        most = MAX_SAMPLES if self.solver == "dense" else conjugate.MAX_GLOBAL
        data = samples.select(*dims, "value").limit(most + 1).toPandas().to_numpy(float)
        return self.fit_arrays(data[:, :-1], data[:, -1], samples.sparkSession)

    def fit_arrays(self, coords: np.ndarray, values: np.ndarray, spark: SparkSession | None = None) -> Kriging:
        """Fit samples in memory; with a session, more than MAX_SAMPLES of them by conjugate gradients over its tasks."""
        if not (np.isfinite(coords).all() and np.isfinite(values).all()):
            raise ValueError("Coordinates must not contain NaN or infinite values")
        model = replace(self.variogram, range=1.0) if self.kind == "anisotropic" else self.variogram
        trend = {"simple": None, "universal": self.trend}.get(self.kind, "constant")
        if trend == "auto":
            trend = choose_trend(coords, values)
        mean = 0.0
        if self.kind == "simple":
            mean = float(np.mean(values)) if self.mean is None else float(self.mean)
        shaped = self.shape(coords)
        if self.solver == "dense" or spark is None or self.solver == "auto" and len(coords) <= MAX_SAMPLES:
            return replace(self, system=System.build(shaped, values, model, trend, mean))
        operator = conjugate.Covariance(spark, shaped, model)
        try:
            return replace(self, system=System.build(shaped, values, model, trend, mean, lambda right: operator.refined(right)[0]))
        finally:
            operator.close()

    def fold_predictions(self, coords: np.ndarray, values: np.ndarray, folds: Sequence[np.ndarray], spark: SparkSession) -> list[np.ndarray]:
        """Predictions of the samples of each fold from all others, for more than MAX_SAMPLES of them.

        The systems of some folds are solved together: a column belongs to a fold and is 0 at its
        samples, so all share the products, and the last product has the predictions.
        """
        model = replace(self.variogram, range=1.0) if self.kind == "anisotropic" else self.variogram
        trend = {"simple": None, "universal": self.trend}.get(self.kind, "constant")
        shaped, n = self.shape(coords), len(values)
        if len(np.unique(shaped, axis=0)) < n:  # equal places may be in different folds
            trains = [np.setdiff1d(np.arange(n), test) for test in folds]
            return [np.concatenate([np.zeros(0), *(fitted.predict_arrays(coords[test[i : i + 256]])[0] for i in range(0, len(test), 256))]) for train, test in zip(trains, folds, strict=True) for fitted in [self.fit_arrays(coords[train], values[train], spark)]]
        drift = models.design(shaped, trend) if trend else np.zeros((n, 0))
        wide = 1 + drift.shape[1]
        each, out = max(1, conjugate.columns(n) // wide), []
        operator = conjugate.Covariance(spark, shaped, model)
        try:
            for start in range(0, len(folds), each):
                some = folds[start : start + each]
                held, right, means = np.ones((n, wide * len(some))), [], []
                for k, test in enumerate(some):
                    held[test, k * wide : (k + 1) * wide] = 0
                    means.append(0.0 if trend else float((values.sum() - values[test].sum()) / (n - len(test))) if self.mean is None else float(self.mean))
                    right += [values - means[-1], *drift.T]
                solved, product = operator.refined(np.stack(right, axis=1), held)
                for k, test in enumerate(some):
                    own = slice(k * wide, (k + 1) * wide)
                    gram = drift.T @ solved[:, own]  # the fold's rows of the solution are 0
                    mu = np.linalg.solve(gram[:, 1:], gram[:, 0])
                    there = product[test, own]
                    out.append(means[k] + there[:, 0] - there[:, 1:] @ mu + drift[test] @ mu)
        finally:
            operator.close()
        return out

    def predict_arrays(self, coords: np.ndarray, variance: bool = False):
        if self.system is None:
            raise ValueError("Model must be fitted before prediction")
        return self.system.predict(self.shape(coords), variance)

    def predict(self, targets: DataFrame, variance: bool = False, batch: int = 8_192) -> DataFrame:
        """id, prediction and, if asked for, variance of each target, in a map without a shuffle."""
        if self.system is None:
            raise ValueError("Model must be fitted before prediction")
        dims = axes(targets)
        if variance and self.system.inverse is None and self.system.bordered is None:
            return self._with_solved_variance(targets, batch)
        model = self if variance else replace(self, system=replace(self.system, inverse=None, whitened=None, bordered=None))
        shared = targets.sparkSession.sparkContext.broadcast(model)
        size = max(64, min(batch, 8_000_000 // max(1, len(self.system.coords))))

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                for start in range(0, len(frame), size):
                    part = frame.iloc[start : start + size]
                    p, v = shared.value.predict_arrays(part[dims].to_numpy(float), variance)
                    yield pd.DataFrame({"id": part["id"].to_numpy(), "prediction": p} | ({"variance": v} if variance else {}))

        return targets.select("id", *dims).mapInPandas(run, "id long, prediction double" + ", variance double" * variance)

    def _with_solved_variance(self, targets: DataFrame, batch: int) -> DataFrame:
        """Predictions, and variances by solving for each target, some of them a task; for at most MAX_SOLVED_TARGETS of them."""
        spark, dims, system = targets.sparkSession, axes(targets), self.system
        count = targets.select("id").limit(MAX_SOLVED_TARGETS + 1).count()
        if count > MAX_SOLVED_TARGETS:
            raise ValueError(f"variances of more than {MAX_SAMPLES} samples are solved for at most {MAX_SOLVED_TARGETS} targets; use local kriging")
        operator = conjugate.Covariance(spark, system.coords, system.model)
        try:
            if system.coords.shape[1] > 2:
                rows = targets.select("id", *dims).toPandas()
                rows["variance"] = system.variances(self.shape(rows[dims].to_numpy(float)), operator.solve)
                found = spark.createDataFrame(rows[["id", "variance"]], "id long, variance double")
                return self.predict(targets, False, batch).join(F.broadcast(found), "id")
            # samples and their solutions in the order of the fast product
            sorted_ = replace(system, coords=system.coords[operator.order], dual=np.concatenate([system.dual[: operator.n][operator.order], system.dual[operator.n :]]), whitened=system.whitened[operator.order])
            shared = spark.sparkContext.broadcast((replace(self, system=sorted_), operator.far[0]))
        finally:
            operator.close()
        width = conjugate.columns(operator.n)

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            model, fast = shared.value
            for frame in frames:
                for start in range(0, len(frame), width):
                    part = frame.iloc[start : start + width]
                    coords = part[dims].to_numpy(float)
                    yield pd.DataFrame({"id": part["id"].to_numpy(), "prediction": model.predict_arrays(coords)[0], "variance": model.system.variances(model.shape(coords), fast.functionals)})

        tasks = max(spark.sparkContext.defaultParallelism, -(-count // width))
        return targets.select("id", *dims).repartition(tasks).mapInPandas(run, "id long, prediction double, variance double")

    def residuals(self, points: DataFrame) -> DataFrame:
        """id, value, prediction and residual (observed less predicted)."""
        return points.select("id", "value").join(self.predict(points), "id").withColumn("residual", F.col("value") - F.col("prediction"))

    def score(self, points: DataFrame) -> float:
        return r_squared(self.residuals(points))

    def anisotropy(self) -> dict[str, float | bool]:
        ratio = self.variogram.range / self.range_minor
        return {"range_major": self.variogram.range, "range_minor": self.range_minor, "ratio": ratio, "angle": self.angle, "angle_deg": float(np.degrees(self.angle)), "is_anisotropic": ratio > 1.2}


def r_squared(residuals: DataFrame) -> float:
    """1 - sum of squared residuals over the variation of the values, in one aggregate."""
    row = residuals.agg(F.sum(F.col("residual") ** 2).alias("s"), (F.var_pop("value") * F.count("*")).alias("t")).first()
    return float(1 - row.s / row.t) if row.t else float("nan")


def choose_trend(coords: np.ndarray, values: np.ndarray) -> str:
    """Linear or quadratic drift by AIC of least squares; linear on ties."""

    def aic(trend: str) -> float:
        f = models.design(coords, trend)
        left = values - f @ np.linalg.lstsq(f, values, rcond=None)[0]
        return len(values) * np.log(max(float(left @ left), 1e-12) / len(values)) + 2 * f.shape[1]

    return "quadratic" if len(values) > models.design(coords[:1], "quadratic").shape[1] and aic("quadratic") < aic("linear") else "linear"


def ordinary(variogram: Variogram) -> Kriging:
    return Kriging(variogram)


def simple(variogram: Variogram, mean: float | None = None) -> Kriging:
    return Kriging(variogram, "simple", mean)


def universal(variogram: Variogram, trend: str = "auto") -> Kriging:
    return Kriging(variogram, "universal", trend=trend)


def anisotropic(variogram: Variogram, range_minor: float, angle: float) -> Kriging:
    """Major axis `angle` radians clockwise of the x axis (see functions.models.to_isotropic)."""
    return Kriging(variogram, "anisotropic", angle=angle, range_minor=range_minor)


def anisotropic_from_directional(points: DataFrame, table: DataFrame, model: str = "spherical") -> Kriging:
    """An anisotropic estimator from a directional table, by a five-parameter fit from the ensemble's start."""
    from fieldstats.operators.anisotropy import ensemble
    from fieldstats.operators.fit import fit_anisotropic

    start = ensemble(points, table)
    rows = table.filter("count > 0 and gamma is not null").select("lag", "gamma", "angle", "count").toPandas()
    found = fit_anisotropic(rows["lag"], rows["gamma"], rows["angle"], model, (start.start.nugget, start.start.sill, start.start.major / 3, start.start.minor / 3, np.radians(start.angle_deg)), rows["count"].to_numpy(float), degrees=True)
    n, s, major, minor, angle = found.parameters
    return anisotropic(Variogram(model, n, s, major, found), minor, -angle)  # fitted angles are counter-clockwise


def grid(low: tuple[float, float], high: tuple[float, float], nx: int, ny: int, spark) -> DataFrame:
    """Targets id, ix, iy, x, y on a regular grid, ends included."""
    step = lambda lo, hi, n: (hi - lo) / (n - 1) if n > 1 else 0.0
    ix, iy = F.col("id") % nx, F.floor(F.col("id") / nx)
    return spark.range(nx * ny).select("id", ix.cast("int").alias("ix"), iy.cast("int").alias("iy"), (low[0] + ix * step(low[0], high[0], nx)).alias("x"), (low[1] + iy * step(low[1], high[1], ny)).alias("y"))


def local(targets: DataFrame, samples: DataFrame, variogram: Variogram, max_neighbors: int = 64, min_neighbors: int = 4, max_distance: float | None = None, kind: str = "ordinary", mean: float | None = None) -> DataFrame:
    """id, prediction, variance from each target's nearest samples.

    Fewer than min_neighbors give their mean and the variance of all values; none
    gives NaN.  A system that cannot be solved is tried again with a ridge of 1e-6
    and then replaced by inverse-distance weights.
    """
    if not variogram.fitted:
        raise ValueError("Variogram must be fitted before kriging")
    dims = axes(samples)
    found = knn_join(targets, samples, max_neighbors, max_distance)
    spread, centre = samples.agg(F.var_pop("value"), F.avg("value")).first()
    known = centre if mean is None else mean
    held = found.join(samples.select(F.col("id").alias("neighbor_id"), *dims, "value"), "neighbor_id")
    packed = held.groupBy(F.col("query_id").alias("id")).agg(F.sort_array(F.collect_list(F.struct("rank", "distance", "value", *dims))).alias("near"))
    packed = targets.select("id").join(packed, "id", "left").select("id", *[F.col(f"near.{c}").alias(c) for c in ("distance", "value", *dims)])
    v = variogram

    def solve(d: np.ndarray, z: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        b, k = d.shape
        square = np.zeros((b, k, k))
        for c in range(x.shape[2]):
            square += (x[:, :, None, c] - x[:, None, :, c]) ** 2
        left = models.cov(np.sqrt(square), v.model, v.nugget, v.sill, v.range)
        c0 = models.cov(d, v.model, v.nugget, v.sill, v.range)
        m = int(kind == "ordinary")
        whole, right = np.zeros((b, k + m, k + m)), np.ones((b, k + m))
        whole[:, :k, :k], right[:, :k] = left, c0
        if m:
            whole[:, :k, k] = whole[:, k, :k] = 1
        weights = None
        for ridge in (0.0, 1e-6):
            try:
                weights = np.linalg.solve(whole + ridge * np.diag([1.0] * k + [0.0] * m), right[:, :, None])[:, :, 0]
                if np.isfinite(weights).all():
                    break
            except np.linalg.LinAlgError:
                weights = None
        if weights is None or not np.isfinite(weights).all():
            if b > 1:
                parts = [solve(d[i : i + 1], z[i : i + 1], x[i : i + 1]) for i in range(b)]
                return np.concatenate([p for p, _ in parts]), np.concatenate([q for _, q in parts])
            w = 1 / (d + 1e-10)
            w /= w.sum(1, keepdims=True)
            return (w * z).sum(1), np.full(b, v.sill)
        base = 0.0 if m else known
        return base + (weights[:, :k] * (z - base)).sum(1), np.maximum(v.sill - (weights * right).sum(1), 0)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            sizes = np.array([0 if s is None else len(s) for s in frame["value"]])
            p, q = np.full(len(frame), np.nan), np.full(len(frame), np.nan)
            for k in np.unique(sizes[sizes > 0]):
                for at in np.array_split(np.flatnonzero(sizes == k), max(1, int((sizes == k).sum() * k * k // 2_000_000))):
                    part = frame.iloc[at]
                    z, d = np.stack(part["value"].to_numpy()), np.stack(part["distance"].to_numpy())
                    if k < min_neighbors:
                        p[at], q[at] = z.mean(1), spread
                    else:
                        p[at], q[at] = solve(d, z, np.stack([np.stack(part[c].to_numpy()) for c in dims], axis=2))
            yield pd.DataFrame({"id": frame["id"], "prediction": p, "variance": q})

    return packed.mapInPandas(run, "id long, prediction double, variance double")


def inverse_distance(targets: DataFrame, samples: DataFrame, k: int, power: float = 1.0) -> DataFrame:
    """id, prediction by weights 1 / (distance + 1e-10) ** power of the k nearest samples."""
    near = knn_join(targets, samples, k).join(samples.select(F.col("id").alias("neighbor_id"), "value"), "neighbor_id")
    w = F.pow(F.col("distance") + 1e-10, F.lit(-power))
    return near.groupBy(F.col("query_id").alias("id")).agg((F.sum(w * F.col("value")) / F.sum(w)).alias("prediction"))


def tiles(spark, bounds: Sequence[float], size: float | tuple[float, float], overlap: float = 0.1) -> DataFrame:
    """Overlapping tiles of (xmin, ymin, xmax, ymax), clipped to it: ix, iy and their bounds."""
    xmin, ymin, xmax, ymax = map(float, bounds)
    wx, wy = (size, size) if np.isscalar(size) else size
    if wx <= 0 or wy <= 0:
        raise ValueError("tile size must be positive")
    nx, ny = (max(1, int(np.ceil((hi - lo) / w - 1e-12))) for lo, hi, w in ((xmin, xmax, wx), (ymin, ymax, wy)))
    cells = spark.range(nx * ny).select((F.col("id") % nx).cast("int").alias("ix"), F.floor(F.col("id") / nx).cast("int").alias("iy"))
    edge = lambda lo, hi, w, i, a: F.least(F.greatest(F.lit(lo) + F.col(i) * w + a, F.lit(lo)), F.lit(hi))
    return cells.select("ix", "iy", edge(xmin, xmax, wx, "ix", -overlap * wx).alias("xmin"), edge(ymin, ymax, wy, "iy", -overlap * wy).alias("ymin"), edge(xmin, xmax, wx, "ix", wx + overlap * wx).alias("xmax"), edge(ymin, ymax, wy, "iy", wy + overlap * wy).alias("ymax"))


def tile_members(points: DataFrame, size: float | tuple[float, float], overlap: float = 0.1) -> DataFrame:
    """A row for each point and overlapping tile (ix, iy) that holds it, borders included; tiles as of `tiles` over all points.

    The tiles of a point follow from its place, so nothing is joined; a share of points near
    borders, which `overlap` sets, is repeated. The division only says which tiles may hold a point; the tiles' own
    edges decide. A point without a finite coordinate is in no tile.
    """
    wx, wy = (size, size) if np.isscalar(size) else size
    if wx <= 0 or wy <= 0:
        raise ValueError("tile size must be positive")
    points = points.filter("abs(x) < double('infinity') AND abs(y) < double('infinity')")  # NaN is above infinity
    x0, x1, y0, y1 = points.agg(F.min("x"), F.max("x"), F.min("y"), F.max("y")).first()
    if x0 is None:
        return points.select("*", F.lit(0).alias("ix"), F.lit(0).alias("iy"))
    for axis, c, lo, hi, w in (("ix", "x", x0, x1, wx), ("iy", "y", y0, y1, wy)):
        last = max(1, int(np.ceil((hi - lo) / w - 1e-12))) - 1
        at = (F.col(c) - lo) / w
        first, final = F.ceil(at - 1 - overlap) - 1, F.floor(at + overlap) + 1
        within = lambda i: F.least(F.greatest(i, F.lit(0)), F.lit(last)).cast("int")
        start = F.lit(float(lo)) + F.col(axis) * float(w)
        points = points.withColumn(axis, F.explode(F.sequence(within(first), within(final))))
        points = points.filter((F.col(c) >= start - float(overlap * w)) & (F.col(c) <= start + float(w + overlap * w)))
    return points


def tile_of(targets: DataFrame, per_tile: int = 10_000) -> DataFrame:
    """Targets with the square tile (tx, ty) that holds them, about per_tile to a tile."""
    box = targets.agg(F.min("x"), F.max("x"), F.min("y"), F.max("y"), F.count("*")).first()
    x0, x1, y0, y1, n = box
    wide, high = max(x1 - x0, 0.0), max(y1 - y0, 0.0)
    count = max(1.0, n / per_tile)
    side = np.sqrt(wide * high / count) if wide > 0 and high > 0 else max(wide, high) / count or 1.0
    return targets.withColumns({"tx": F.floor((F.col("x") - x0) / side).cast("int"), "ty": F.floor((F.col("y") - y0) / side).cast("int")})


def predict_parallel(model: Kriging, targets: DataFrame, variance: bool = False, strategy: str = "adaptive", partitions: int | None = None) -> DataFrame:
    """Predictions with targets laid out by chunk or by tile; 'adaptive' takes tiles for large two-dimensional sets."""
    if strategy not in ("chunk", "spatial", "adaptive"):
        raise ValueError("strategy must be one of {'chunk', 'spatial', 'adaptive'}")
    flat = axes(targets) == ["x", "y"]
    if strategy == "spatial" or (strategy == "adaptive" and flat and targets.count() > 10_000):
        targets = tile_of(targets).repartition(*([partitions] if partitions else []), "tx", "ty").drop("tx", "ty")
    elif partitions:
        targets = targets.repartition(partitions)
    return model.predict(targets, variance)


def predict_progressive(model: Kriging, targets: DataFrame, path: str, block: int = 1_000, variance: bool = False, max_blocks: int | None = None) -> DataFrame:
    """Predictions written block by block; a rerun skips the blocks already there.

    Blocks are id ranges; one write covers all blocks still open (or max_blocks of
    them), so restarts cost one anti-join on block numbers.
    """
    spark = targets.sparkSession
    numbered = targets.withColumn("block", F.floor(F.col("id") / block).cast("long"))
    done = finished_blocks(spark, path)
    open_ = numbered if done is None else numbered.join(F.broadcast(done), "block", "left_anti")
    if max_blocks is not None:
        some = open_.select("block").distinct().orderBy("block").limit(max_blocks)
        open_ = open_.join(F.broadcast(some), "block", "left_semi")
    if open_.limit(1).count():
        out = model.predict(open_, variance).withColumn("block", F.floor(F.col("id") / block).cast("long"))
        out.write.mode("append").partitionBy("block").parquet(path)
    return spark.read.parquet(path).drop("block")


def finished_blocks(spark, path: str) -> DataFrame | None:
    from pyspark.errors import AnalysisException

    try:
        return spark.read.parquet(path).select(F.col("block").cast("long")).distinct()
    except AnalysisException:
        return None


def memory_estimate(samples: int, targets: int, batch: int = 8_192) -> dict[str, float]:
    """MB of the covariance matrix, of one batch and of the predictions, for plan choice."""
    mb = 8 / 1e6
    return {"system_mb": mb * (samples + 1) ** 2, "batch_mb": mb * min(batch, targets) * samples, "result_mb": 2 * mb * targets}


def optimal_float(points: DataFrame, column: str, precision: float) -> str:
    """float32 where its step over the column's span keeps the wanted precision, else float64."""
    low, high = points.agg(F.min(column), F.max(column)).first()
    return "float32" if (high - low) * np.finfo(np.float32).eps <= precision else "float64"


def closed_form_ok2(d1: Column, d2: Column, d12: Column, v1: Column, v2: Column, model: Variogram) -> tuple[Column, Column]:
    """Prediction and variance of ordinary kriging from two samples, as expressions."""
    c1, c2, c12 = model.covariance(d1), model.covariance(d2), model.covariance(d12)
    w = F.lit(0.5) + (c1 - c2) / (2 * (F.lit(model.sill) - c12))
    mu = c1 - model.sill * w - c12 * (1 - w)
    return w * v1 + (1 - w) * v2, F.greatest(model.sill - w * c1 - (1 - w) * c2 - mu, F.lit(0.0))
