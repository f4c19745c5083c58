"""Reading, validating, writing and simulating point sets.

A point set is a DataFrame with an explicit `id`, coordinates `x`, `y` (and
optionally `z`), and optionally `value` and `mark`.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldstats.sources.raw import read_raw_array, write_raw_array  # noqa: F401  part of this module's interface

AXES = ("x", "y", "z")


def axes(points: DataFrame) -> list[str]:
    """Coordinate columns present, in order."""
    return [c for c in AXES if c in points.columns]


def _bad(c: str) -> Column:
    value = F.col(c).cast("double")
    return value.isNull() | F.isnan(value) | (F.abs(value) == float("inf"))


def validate(points: DataFrame, columns: Sequence[str], message: str) -> DataFrame:
    """Check in one aggregate that all columns are finite numbers; ValueError otherwise."""
    bad = points.agg(*[F.count(F.when(_bad(c), 1)).alias(c) for c in columns]).first()
    if any(bad):
        raise ValueError(message)
    return points


def validate_coordinates(points: DataFrame, columns: Sequence[str] = ("x", "y")) -> DataFrame:
    """Coordinates as doubles; null, NaN and infinity are refused."""
    if len(columns) < 2:
        raise ValueError("Coordinates must have at least 2 dimensions")
    validate(points, columns, "Coordinates must not contain NaN or infinite values")
    return points.withColumns({c: F.col(c).cast("double") for c in columns})


def validate_values(points: DataFrame, column: str = "value") -> DataFrame:
    validate(points, [column], "Values must not contain NaN or infinite values")
    return points.withColumn(column, F.col(column).cast("double"))


def validate_array(points: DataFrame, column: str, name: str = "array") -> DataFrame:
    return validate(points, [column], f"{name} must not contain NaN or infinite values")


def points(source: DataFrame, id: str, x: str, y: str, z: str | None = None, value: str | None = None, mark: str | None = None) -> DataFrame:
    """Project a table to a point set; nothing else is read from it."""
    picked = [F.col(id).cast("long").alias("id"), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")]
    picked += [F.col(c).cast(t).alias(a) for c, t, a in ((z, "double", "z"), (value, "double", "value"), (mark, "string", "mark")) if c]
    return source.select(*picked)


def points_from_geometry(source: DataFrame, id: str, geometry: str, value: str | None = None) -> DataFrame:
    """Point set from a struct<x, y> or WKB point column; every row is checked."""
    kind = source.schema[geometry].dataType
    if isinstance(kind, T.StructType):
        x, y, wrong = F.col(geometry)["x"], F.col(geometry)["y"], F.col(geometry).isNull()
    else:
        raw = F.hex(geometry)
        wrong = F.col(geometry).isNull() | ~F.coalesce(raw.rlike("^(0101000000|0000000001)[0-9A-F]{32}$"), F.lit(False))
        x, y = _wkb_double(raw, 11), _wkb_double(raw, 27)
    if source.filter(wrong).limit(1).count():
        raise ValueError("Geometry must contain only non-null points")
    out = source.select(F.col(id).cast("long").alias("id"), x.cast("double").alias("x"), y.cast("double").alias("y"), *([F.col(value).cast("double").alias("value")] if value else []))
    return validate_coordinates(out)


def _wkb_double(raw: Column, start: int) -> Column:
    """Double at a hex offset of a WKB text, either byte order."""

    @F.pandas_udf("double")
    def decode(text):
        return text.map(lambda t: np.frombuffer(bytes.fromhex(t[start - 1 : start + 15]), "<f8" if t.startswith("01") else ">f8")[0])

    return decode(raw)


def read_points(spark: SparkSession, path: str, fmt: str = "parquet", **columns: str) -> DataFrame:
    """Point set from any Spark source; see points() for the column arguments."""
    return points(spark.read.format(fmt).load(path), **columns)


def write_points(frame: DataFrame, path: str, fmt: str = "parquet", mode: str = "error") -> None:
    frame.write.format(fmt).mode(mode).save(path)


def _check_bounds(bounds: tuple[float, float, float, float]) -> None:
    xmin, xmax, ymin, ymax = bounds
    if not (xmax > xmin and ymax > ymin):
        raise ValueError("bounds must satisfy xmin < xmax and ymin < ymax")


def simulate_poisson(spark: SparkSession, intensity: float, bounds=(0.0, 1.0, 0.0, 1.0), seed: int | None = None, distributed: bool = False) -> DataFrame:
    """Homogeneous Poisson process: n ~ Poisson(intensity * area), uniform places.

    With distributed=True places come from Spark's rand and only n is drawn on the driver.
    """
    _check_bounds(bounds)
    if intensity <= 0:
        raise ValueError("intensity must be positive")
    xmin, xmax, ymin, ymax = bounds
    rng = np.random.default_rng(seed)
    n = int(rng.poisson(intensity * (xmax - xmin) * (ymax - ymin)))
    if distributed:
        s = int(rng.integers(1 << 31))
        return spark.range(n).select("id", (xmin + (xmax - xmin) * F.rand(s)).alias("x"), (ymin + (ymax - ymin) * F.rand(s + 1)).alias("y"))
    x, y = rng.uniform(xmin, xmax, n), rng.uniform(ymin, ymax, n)
    return _frame(spark, x, y)


def _frame(spark: SparkSession, x: np.ndarray, y: np.ndarray, mark: np.ndarray | None = None) -> DataFrame:
    import pandas as pd

    data = {"id": np.arange(len(x), dtype=np.int64), "x": x.astype(float), "y": y.astype(float)}
    schema = "id long, x double, y double"
    if mark is not None:
        data["mark"], schema = mark.astype(str), schema + ", mark string"
    return spark.createDataFrame(pd.DataFrame(data), schema)


def simulate_marked_poisson(spark: SparkSession, intensity: float, marks: Sequence[str], probabilities: Sequence[float] | None = None, bounds=(0.0, 1.0, 0.0, 1.0), seed: int | None = None) -> DataFrame:
    """Poisson process with independent categorical marks; probabilities are normalised."""
    _check_bounds(bounds)
    p = np.ones(len(marks)) if probabilities is None else np.asarray(probabilities, float)
    if len(p) != len(marks) or (p < 0).any() or p.sum() <= 0:
        raise ValueError("mark probabilities must be non-negative, one for each mark")
    xmin, xmax, ymin, ymax = bounds
    rng = np.random.default_rng(seed)
    n = int(rng.poisson(intensity * (xmax - xmin) * (ymax - ymin)))
    x, y = rng.uniform(xmin, xmax, n), rng.uniform(ymin, ymax, n)
    return _frame(spark, x, y, rng.choice(np.asarray(marks, dtype=str), size=n, p=p / p.sum()))


def gaussian_smooth(field: np.ndarray, sigma: float) -> np.ndarray:
    """Separable Gaussian filter cut at four sigma, edges mirrored."""
    if sigma <= 0:
        return field
    reach = int(4 * sigma + 0.5)
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    kernel /= kernel.sum()
    for axis in (0, 1):
        padded = np.pad(field, [(reach, reach) if a == axis else (0, 0) for a in (0, 1)], mode="symmetric")
        field = np.apply_along_axis(np.convolve, axis, padded, kernel, "valid")
    return field


def simulate_cox(spark: SparkSession, mean_intensity: float, bounds=(0.0, 1.0, 0.0, 1.0), grid_size: int = 50, sigma: float = 1.0, smoothing: float = 3.0, seed: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Log-Gaussian Cox process: points, and the intensity of each grid cell.

    Cell counts are drawn on the driver (grid_size**2 numbers); places inside the
    cells are drawn by Spark, so the points never pass through the driver.
    """
    _check_bounds(bounds)
    xmin, xmax, ymin, ymax = bounds
    rng = np.random.default_rng(seed)
    noise = gaussian_smooth(rng.standard_normal((grid_size, grid_size)), smoothing)
    spread = noise.std()
    noise = (noise - noise.mean()) / (spread if spread > 0 else 1)
    intensity = np.exp(sigma * noise)
    intensity *= mean_intensity / intensity.mean()
    dx, dy = (xmax - xmin) / grid_size, (ymax - ymin) / grid_size
    counts = rng.poisson(intensity * dx * dy)
    cells = spark.createDataFrame([(int(i), int(j), float(intensity[j, i]), int(counts[j, i])) for j in range(grid_size) for i in range(grid_size)], "ix int, iy int, intensity double, n int")
    s = int(rng.integers(1 << 31))
    made = cells.filter("n > 0").select("ix", "iy", F.explode(F.sequence(F.lit(1), "n")).alias("k"))
    made = made.select((xmin + (F.col("ix") + F.rand(s)) * dx).alias("x"), (ymin + (F.col("iy") + F.rand(s + 1)) * dy).alias("y"))
    return made.withColumn("id", F.monotonically_increasing_id()).select("id", "x", "y"), cells.drop("n")
