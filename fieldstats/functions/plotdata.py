"""The small tables behind the plots; nothing is drawn here."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fieldstats.operators.fit import Variogram
from fieldstats.operators.ranks import normal_quantile, ranked
from fieldstats.operators.variogram import cloud, direction_ranges


def variogram(table: DataFrame, model: Variogram | None = None) -> DataFrame:
    """Populated lags with the model curve."""
    held = table.filter("count > 0 and gamma is not null and not isnan(gamma)").select("lag", "gamma", "count")
    curve = model.gamma(F.col("lag")) if model else F.lit(None).cast("double")
    return held.withColumn("model", curve).orderBy("lag")


def directional(table: DataFrame) -> DataFrame:
    return table.filter("count > 0").select("angle", "lag", "gamma", "count", "ci_lower", "ci_upper").orderBy("angle", "lag")


def rose(table: DataFrame, fraction: float = 0.95) -> DataFrame:
    """Range by azimuth, both ways round."""
    ranges = direction_ranges(table, fraction)
    turned = ranges.select((F.col("angle") + 180).alias("angle"), "range")
    return ranges.select("angle", "range").unionByName(turned).orderBy("angle")


def surface(predictions: DataFrame, targets: DataFrame, column: str = "prediction") -> DataFrame:
    """Grid values of kriging results or of their variance."""
    return targets.select("id", "ix", "iy", "x", "y").join(predictions.select("id", column), "id").orderBy("iy", "ix")


def cross_section(predictions: DataFrame, targets: DataFrame) -> DataFrame:
    """Values by distance along a line of targets in id order."""
    order = Window.partitionBy(F.lit(0)).orderBy("id")  # one line of targets
    step = F.sqrt((F.col("x") - F.lag("x").over(order)) ** 2 + (F.col("y") - F.lag("y").over(order)) ** 2)
    stepped = targets.withColumn("_step", F.coalesce(step, F.lit(0.0)))
    return stepped.withColumn("along", F.sum("_step").over(order)).drop("_step").join(predictions, "id").orderBy("along")


def comparison(residuals: DataFrame) -> DataFrame:
    return residuals.select("id", F.col("value").alias("observed"), F.col("prediction").alias("predicted"))


def residuals_qq(rows: DataFrame, column: str = "residual", tie: str = "id") -> DataFrame:
    """rank, probability, theoretical and sample quantile of at least three residuals; equal ones are ranked by the column `tie`."""
    n = rows.count()
    if n < 3:
        raise ValueError("at least 3 residuals are required")
    found = ranked(rows.select(F.col(column).alias("sample"), F.col(tie).alias("_tie")), "sample", "_tie").drop("_tie")
    return found.withColumn("probability", (F.col("rank") - 0.5) / n).withColumn("theoretical", normal_quantile(F.col("probability")))


def variogram_cloud(points: DataFrame) -> DataFrame:
    return cloud(points)


def correlogram(table: DataFrame, sill: float) -> DataFrame:
    """lag and correlation 1 - gamma / sill."""
    return table.filter("count > 0").select("lag", (1 - F.col("gamma") / sill).alias("correlation")).orderBy("lag")


def ellipse(spark, major: float, minor: float, angle: float, centre=(0.0, 0.0), scale: float = 1.0, n: int = 100) -> DataFrame:
    """Outline of an anisotropy ellipse, angle in radians counter-clockwise."""
    t = np.linspace(0, 2 * np.pi, n)
    u, v = scale * major * np.cos(t), scale * minor * np.sin(t)
    x, y = centre[0] + u * np.cos(angle) - v * np.sin(angle), centre[1] + u * np.sin(angle) + v * np.cos(angle)
    return spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(zip(x, y, strict=True))], "i int, x double, y double")
