"""Fitting variogram models to lag tables by bounded Levenberg-Marquardt, on the driver.

A lag table has at most some hundred rows, so the fit itself is numpy; the table
comes from a Spark plan.  Parameters are nugget, sill, range, or with directions
nugget, sill, log range of the major axis, log range of the minor axis, angle.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field, replace

import numpy as np
from pyspark.sql import Column, DataFrame

from fieldstats.functions import models

LAMBDA, LOWER, RAISE, SINGULAR, NON_FINITE, CAP = 1e-3, 0.3, 4.0, 10.0, 6.0, 1e12
MAX_STEPS, TRACE = 250, 64


@dataclass(frozen=True)
class FitResult:
    parameters: tuple[float, ...]
    r2: float
    rmse: float
    converged: bool
    iterations: int
    status: str
    message: str = ""
    std: tuple[float, ...] = ()
    diagnostics: dict[str, float] = field(default_factory=dict)
    trace: tuple[dict, ...] = ()
    fallback_used: bool = False
    warnings: tuple[str, ...] = ()


#: Largest logarithm of a range that a fit tries.
LOG_RANGE = 150.0


def scaled_lag(p: np.ndarray, d: np.ndarray, theta: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Lag over range, and its derivatives by the range parameters (one row each)."""
    if theta is None:
        return d / p[2], (-d / p[2] ** 2)[None]
    # a step may throw a range out of all bounds; within these its square stays finite
    major, minor, turn = np.exp(np.clip(p[2], -LOG_RANGE, LOG_RANGE)), np.exp(np.clip(p[3], -LOG_RANGE, LOG_RANGE)), theta - p[4]
    u, v = d * np.cos(turn) / major, d * np.sin(turn) / minor
    h = np.hypot(u, v)
    safe = np.where(h > 0, h, 1.0)
    # by log major, log minor, angle
    by_angle = u * v * (minor / major - major / minor)
    return h, np.stack([-u * u / safe, -v * v / safe, np.where(h > 0, by_angle / safe, 0.0)])


def curve(p: np.ndarray, d: np.ndarray, theta: np.ndarray | None, model: str) -> tuple[np.ndarray, np.ndarray]:
    """Fitted semivariance (the nugget at lag 0) and its Jacobian."""
    h, dh = scaled_lag(p, d, theta)
    part = p[1] - p[0]
    if model == "exponential":
        rise, slope = -np.expm1(-h), np.exp(-h)
    elif model == "gaussian":
        rise, slope = -np.expm1(-h * h), 2 * h * np.exp(-h * h)
    else:
        inside = h < 1
        rise, slope = np.where(inside, 1.5 * h - 0.5 * h**3, 1.0), np.where(inside, 1.5 - 1.5 * h * h, 0.0)
    return p[0] + part * rise, np.concatenate([[1 - rise, rise], part * slope * dh])


def levenberg_marquardt(d, gamma, weights, model: str, start: Sequence[float], fixed: Sequence[bool] | None = None, theta=None) -> FitResult:
    """Bounded weighted least squares from one start."""
    model = models.check_model(model) if model != "matern" else (_ for _ in ()).throw(ValueError("matern cannot be fitted"))
    d, gamma = np.asarray(d, float), np.asarray(gamma, float)
    w = np.ones_like(d) if weights is None else np.asarray(weights, float)
    if not (w > 0).any():
        w = np.ones_like(d)
    if len(d) == 0 or not (np.isfinite(d).all() and np.isfinite(gamma).all()):
        return FitResult(tuple(start), np.nan, np.nan, False, 0, "invalid_parameters", "lags and semivariances must be finite")
    p = np.array(start, float)
    p[0] = max(p[0], 0.0)
    p[1] = max(p[1], p[0] + 1e-9)
    if theta is None:
        p[2] = max(p[2], 1e-6)
    else:
        theta = np.asarray(theta, float)
        p[2:4] = np.log(np.maximum(p[2:4], 1e-6))
    fixed = np.zeros(len(p), bool) if fixed is None else np.asarray(fixed, bool)

    # a free sill is stepped as partial sill, so that all bounds are on single parameters
    partial = not fixed[1]

    def natural(q: np.ndarray) -> np.ndarray:
        return np.concatenate([[q[0], q[0] + q[1]], q[2:]]) if partial else q

    low = np.full(len(p), -np.inf)
    low[0] = 0.0
    if partial:
        low[1] = 1e-9
    if theta is None:
        low[2] = 1e-6
    high = np.full(len(p), np.inf)
    if not partial:
        high[0] = p[1] - 1e-9

    def model_at(q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        fitted, jacobian = curve(natural(q), d, theta, model)
        if partial:
            jacobian[0] += jacobian[1]
        return fitted, jacobian

    def cost_of(q: np.ndarray) -> float:
        return 0.5 * float(np.sum(w * (model_at(q)[0] - gamma) ** 2))

    def pinned(q: np.ndarray, gradient: np.ndarray) -> np.ndarray:
        return ((q <= low) & (gradient > 0)) | ((q >= high) & (gradient < 0))

    if partial:
        p[1] -= p[0]
    p = np.where(fixed, p, np.clip(p, low, high))
    cost, damping, status, steps, trace = cost_of(p), LAMBDA, "max_iterations", 0, []
    if fixed.all():
        status = "succeeded"
    while status == "max_iterations" and steps < MAX_STEPS:
        steps += 1
        fitted, jacobian = model_at(p)
        gradient = jacobian @ (w * (fitted - gamma))
        free = ~fixed & ~pinned(p, gradient)
        flat = bool(np.all(np.abs(gradient[free]) <= 1e-6 * max(cost, 1.0)))
        if not free.any():
            status = "succeeded"
            break
        normal = (jacobian[free] * w) @ jacobian[free].T
        scale = np.abs(np.diag(normal))
        scale = np.where(scale < 1e-12, 1.0, scale)
        try:
            step = np.linalg.solve(normal + damping * np.diag(scale), -gradient[free])
        except np.linalg.LinAlgError:
            damping *= SINGULAR
            status = "singular_matrix" if damping > CAP else status
            continue
        q = p.copy()
        q[free] += step
        q = np.where(fixed, p, np.clip(q, low, high))
        new = cost_of(q) if np.isfinite(q).all() else np.inf
        moved = float(np.linalg.norm(q - p))
        trace = [*trace[1 - TRACE :], {"iteration": steps, "cost": cost, "lambda": damping, "step": moved, "gradient": float(np.abs(gradient[free]).max())}]
        if not np.isfinite(new):
            damping *= NON_FINITE
        elif new < cost:
            gain, p, cost, damping = cost - new, q, new, max(damping * LOWER, 1e-9)
            if moved < 1e-6 or gain <= 1e-9 * max(cost, 1.0):
                fitted, jacobian = model_at(p)
                gradient = jacobian @ (w * (fitted - gamma))
                free = ~fixed & ~pinned(p, gradient)
                if np.all(np.abs(gradient[free]) <= 1e-6 * max(cost, 1.0)):
                    status = "succeeded"
        else:
            if flat and moved < 1e-6:
                status = "succeeded"
                break
            damping *= RAISE
        if damping > CAP:
            if flat:
                status = "succeeded"
            break
    return _report(natural(p), d, gamma, w, theta, model, fixed, status, steps, cost, trace)


def _report(p, d, gamma, w, theta, model, fixed, status, steps, cost, trace) -> FitResult:
    fitted, jacobian = curve(p, d, theta, model)
    mean = np.sum(w * gamma) / w.sum()
    spread = float(np.sum(w * (gamma - mean) ** 2))
    r2 = 1 - 2 * cost / spread if spread > 0 else (1.0 if cost <= 1e-18 else 0.0)
    free = ~fixed
    std = np.zeros(len(p))
    if free.any():
        normal = (jacobian[free] * w) @ jacobian[free].T
        try:
            std[free] = np.sqrt(np.maximum(np.diag(np.linalg.inv(normal)) * 2 * cost / max(1, free.sum()), 0))
        except np.linalg.LinAlgError:
            std[free] = np.nan
    warnings = []
    if theta is None:
        out = p.copy()
        if free[2] and out[2] <= 2e-6:
            status = "invalid_parameters"
            warnings.append("range collapsed to its lower bound")
    else:
        if np.ptp(fitted) < 1e-3 * max(abs(gamma).max(), 1e-12):
            status = "invalid_parameters"
            warnings.append("fitted shape is flat")
        out = np.array([p[0], p[1], *np.exp(np.clip(p[2:4], -LOG_RANGE, LOG_RANGE)), p[4]])
        if out[2] < out[3]:
            out[2], out[3], out[4] = out[3], out[2], out[4] + np.pi / 2
        out[4] %= np.pi
        if out[2] / max(out[3], 1e-12) > 50:
            warnings.append("anisotropy ratio above 50")
    diagnostics = {"cost": cost, "sse": 2 * cost, "shape_spread": float(np.ptp(fitted)) if len(fitted) else 0.0}
    return FitResult(tuple(map(float, out)), r2, float(np.sqrt(2 * cost / w.sum())), status == "succeeded", steps, status, "", tuple(map(float, std)), diagnostics, tuple(trace), False, tuple(warnings))


def fit_anisotropic(d, gamma, directions, model: str, start: Sequence[float], weights=None, degrees: bool = False) -> FitResult:
    """Five-parameter fit; directions are radians unless degrees=True.  An unusable fit is replaced by an isotropic one."""
    theta = np.radians(directions) if degrees else np.asarray(directions, float)
    best = min((levenberg_marquardt(d, gamma, weights, model, [*start[:4], start[4] + turn], None, theta) for turn in (0.0, np.pi / 4, np.pi / 2, 3 * np.pi / 4)), key=lambda r: (r.status == "invalid_parameters", r.diagnostics.get("cost", np.inf)))
    if best.status != "invalid_parameters":
        return best
    tops = np.max(d)
    flat = min((levenberg_marquardt(d, gamma, weights, model, [start[0], start[1], tops * s]) for s in (0.05, 0.1, 0.2, 0.35, 0.5, 1.0, 2.0)), key=lambda r: r.diagnostics.get("cost", np.inf))
    n, s, r = flat.parameters
    return replace(flat, parameters=(n, s, r, r, 0.0), fallback_used=True, status="fallback_to_isotropic", converged=False, warnings=(*best.warnings, "isotropic fallback"))


_REACH = {"exponential": 3.0, "gaussian": np.sqrt(3.0), "spherical": 0.811}


@dataclass(frozen=True)
class Variogram:
    """A model with parameters; fit() returns a new one with a report."""

    model: str = "spherical"
    nugget: float = 0.0
    sill: float | None = None
    range: float | None = None
    report: FitResult | None = None

    def __post_init__(self) -> None:
        models.check_model(self.model)

    @property
    def fitted(self) -> bool:
        return self.sill is not None and self.range is not None

    def _need(self) -> None:
        if not self.fitted:
            raise ValueError("Model must be fitted before prediction")

    def gamma(self, h: Column) -> Column:
        self._need()
        return models.semivariance(h, self.model, self.nugget, self.sill, self.range)

    def covariance(self, h: Column) -> Column:
        self._need()
        return models.covariance(h, self.model, self.nugget, self.sill, self.range)

    def predict(self, h: np.ndarray) -> np.ndarray:
        self._need()
        return models.gamma(h, self.model, self.nugget, self.sill, self.range)

    def fit(self, table: DataFrame | Sequence, fix: dict[str, float] | None = None) -> Variogram:
        """Best admissible fit of several starts; table is a lag table or (distances, gamma, weights)."""
        d, g, w = usable(table)
        unknown = set(fix or {}) - {"nugget", "sill", "range"}
        if unknown:
            raise ValueError(f"Unknown fixed parameter keys: {sorted(unknown)}")
        fixed = [k in (fix or {}) for k in ("nugget", "sill", "range")]
        sill = 1.1 * g.max()
        at = int(np.argmin(np.abs(g - 0.95 * sill)))
        reach = d[at] if at else d[-1] / 3
        base = reach / _REACH[models.check_model(self.model)]
        tries = []
        for r in (base, 2 * d.min(), d.max() / 8, d.max() / 4, d.max() / 2, d.max()):
            start = [(fix or {}).get(k, v) for k, v in (("nugget", self.nugget), ("sill", sill), ("range", r))]
            tries.append(levenberg_marquardt(d, g, w, self.model, start, fixed))
            if fixed[2]:
                break

        def admissible(r: FitResult) -> bool:
            return 0.05 * d.min() <= r.parameters[2] <= 2 * d.max() and r.parameters[1] <= 10 * g.max()

        good = [r for r in tries if admissible(r) or all(fixed)]
        best = min(good or tries, key=lambda r: r.diagnostics.get("sse", np.inf))
        if not good:
            best = replace(best, converged=False, warnings=(*best.warnings, "no start gave admissible parameters"))
        n, s, r = best.parameters
        return replace(self, nugget=n, sill=s, range=r, report=best)


def usable(table: DataFrame | Sequence) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Finite lags with pairs; single-pair lags only where there is nothing better."""
    if isinstance(table, DataFrame):
        rows = table.select("lag", "gamma", "count").orderBy("lag").toPandas()
        d, g, w = rows["lag"].to_numpy(float), rows["gamma"].to_numpy(float), rows["count"].to_numpy(float)
    else:
        d, g = np.asarray(table[0], float), np.asarray(table[1], float)
        w = np.ones_like(d) if len(table) < 3 or table[2] is None else np.asarray(table[2], float)
    keep = np.isfinite(d) & np.isfinite(g) & (w > 0)
    if (keep & (w > 1)).any():
        keep &= w > 1
    if not keep.any():
        raise ValueError("No valid empirical variogram bins available for fitting")
    return d[keep], g[keep], w[keep]


def criterion(kind: str, variogram: Variogram, d, gamma, weights=None) -> float:
    """aic or bic of a fitted model: n ln(rss/n) plus 2k or k ln n, k = 3; gamma(0) is the nugget here."""
    d, gamma = np.asarray(d, float), np.asarray(gamma, float)
    w = np.ones_like(d) if weights is None else np.asarray(weights, float)
    fitted = curve(np.array([variogram.nugget, variogram.sill, variogram.range]), d, None, models.check_model(variogram.model))[0]
    rss, n = max(float(np.sum(w * (gamma - fitted) ** 2)), 1e-12), len(d)
    return n * np.log(rss / n) + {"aic": 2 * 3, "bic": 3 * np.log(n)}[kind]
