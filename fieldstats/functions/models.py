"""Closed-form expressions: distances, variogram models, covariances, drift terms.

Every function comes as a Column expression for Spark plans and, where kernels
need it, as numpy.  Sill includes the nugget; gamma(0) = 0 and C(0) = sill.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

MODELS = ("exponential", "spherical", "gaussian")
EARTH_KM = 6371.0


def euclidean(a: list[Column], b: list[Column]) -> Column:
    total = None
    for p, q in zip(a, b, strict=True):
        square = (p - q) * (p - q)
        total = square if total is None else total + square
    return F.sqrt(total)


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column, radius: float = EARTH_KM) -> Column:
    """Great-circle distance of points in degrees, latitude first."""
    p, q = F.radians(lat1), F.radians(lat2)
    s, t = F.sin((q - p) / 2), F.sin((F.radians(lon2) - F.radians(lon1)) / 2)
    return F.lit(2 * radius) * F.asin(F.sqrt(s * s + F.cos(p) * F.cos(q) * t * t))


def anisotropic(dx: Column, dy: Column, major: float, minor: float, angle: float) -> Column:
    """Scaled distance with the major axis counter-clockwise at `angle` radians."""
    if major <= 0 or minor <= 0:
        raise ValueError("ranges must be positive")
    c, s = float(np.cos(angle)), float(np.sin(angle))
    u, v = (dx * c + dy * s) / major, (dy * c - dx * s) / minor
    return F.sqrt(u * u + v * v)


def to_isotropic(x, y, major: float, minor: float, angle: float):
    """Coordinates in which the model is isotropic with range 1; Columns or arrays.

    The major axis lies clockwise at `angle`, the sign that anisotropic kriging uses.
    """
    c, s = float(np.cos(angle)), float(np.sin(angle))
    return (x * c - y * s) / major, (x * s + y * c) / minor


def check_model(model: str) -> str:
    if model not in (*MODELS, "matern"):
        raise ValueError(f"Model must be one of {', '.join((*MODELS, 'matern'))}")
    return "exponential" if model == "matern" else model


def semivariance(h: Column, model: str, nugget: float, sill: float, range_: float) -> Column:
    """Model semivariance at lag h."""
    r = h / F.lit(float(range_))
    rise = {
        "exponential": 1 - F.exp(-r),
        "gaussian": 1 - F.exp(-r * r),
        "spherical": F.when(r < 1, 1.5 * r - 0.5 * r * r * r).otherwise(1.0),
    }[check_model(model)]
    return F.when(h == 0, 0.0).otherwise(nugget + (sill - nugget) * rise)


def covariance(h: Column, model: str, nugget: float, sill: float, range_: float) -> Column:
    return F.lit(float(sill)) - semivariance(h, model, nugget, sill, range_)


def rise(h: np.ndarray, model: str) -> np.ndarray:
    """Share of the partial sill reached at the scaled lag h."""
    model = check_model(model)
    if model == "exponential":
        return -np.expm1(-h)
    if model == "gaussian":
        return -np.expm1(-h * h)
    return np.where(h < 1, h * (1.5 - 0.5 * h * h), 1.0)


def gamma(h: np.ndarray, model: str, nugget: float, sill: float, range_: float) -> np.ndarray:
    h = np.asarray(h, float)
    return np.where(h == 0, 0.0, nugget + (sill - nugget) * rise(h / range_, model))


def cov(h: np.ndarray, model: str, nugget: float, sill: float, range_: float) -> np.ndarray:
    return sill - gamma(h, model, nugget, sill, range_)


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact differences, not the expanded square, so equal places are at distance 0."""
    total = np.zeros((len(a), len(b)))
    for d in range(a.shape[1]):
        step = a[:, d][:, None] - b[:, d][None, :]
        total += step * step
    return np.sqrt(total)


def design(coords: np.ndarray, trend: str) -> np.ndarray:
    """1, coordinates, then for a quadratic trend squares and pairwise products."""
    n, d = coords.shape
    columns = [np.ones(n), *coords.T]
    if trend == "quadratic":
        columns += [c * c for c in coords.T] + [coords[:, i] * coords[:, j] for i, j in combinations(range(d), 2)]
    elif trend not in ("linear", "constant"):
        raise ValueError("trend must be one of {'auto', 'linear', 'quadratic'}")
    return np.stack(columns[:1] if trend == "constant" else columns, axis=1)


def design_columns(cols: list[Column], trend: str) -> list[Column]:
    out = [F.lit(1.0), *cols]
    if trend == "quadratic":
        out += [c * c for c in cols] + [a * b for a, b in combinations(cols, 2)]
    return out


def cell(value: Column, low: float, high: float, n: int) -> Column:
    """Number of the grid cell, points outside put into the border cells."""
    return F.least(F.greatest(F.floor((value - low) / (high - low) * n), F.lit(0)), F.lit(n - 1)).cast("int")
