"""Ranks over all rows without a window over one partition, and what is computed from them.

Rows are range-partitioned by their order and sorted within each partition, that layout is
checkpointed, and the sizes of the partitions before its own are added to each row's place.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldstats.session import cut

# fixed values: the rational approximations of algorithm AS 241 (Wichura 1988), by rising powers
CENTRE = (3.3871328727963666080e0, 1.3314166789178437745e2, 1.9715909503065514427e3, 1.3731693765509461125e4, 4.5921953931549871457e4, 6.7265770927008700853e4, 3.3430575583588128105e4, 2.5090809287301226727e3)
CENTRE_BELOW = (1.0, 4.2313330701600911252e1, 6.8718700749205790830e2, 5.3941960214247511077e3, 2.1213794301586595867e4, 3.9307895800092710610e4, 2.8729085735721942674e4, 5.2264952788528545610e3)
TAIL = (1.42343711074968357734e0, 4.63033784615654529590e0, 5.76949722146069140550e0, 3.64784832476320460504e0, 1.27045825245236838258e0, 2.41780725177450611770e-1, 2.27238449892691845833e-2, 7.74545014278341407640e-4)
TAIL_BELOW = (1.0, 2.05319162663775882187e0, 1.67638483018380384940e0, 6.89767334985100004550e-1, 1.48103976427480074590e-1, 1.51986665636164571966e-2, 5.47593808499534494600e-4, 1.05075007164441684324e-9)
FAR = (6.65790464350110377720e0, 5.46378491116411436990e0, 1.78482653991729133580e0, 2.96560571828504891230e-1, 2.65321895265761230930e-2, 1.24266094738807843860e-3, 2.71155556874348757815e-5, 2.01033439929228813265e-7)
FAR_BELOW = (1.0, 5.99832206555887937690e-1, 1.36929880922735805310e-1, 1.48753612908506148525e-2, 7.86869131145613259100e-4, 1.84631831751005468180e-5, 1.42151175831644588870e-7, 2.04426310338993978564e-15)


def ranked(rows: DataFrame, *by: str, name: str = "rank") -> DataFrame:
    """rows with their rank from 1 on in the order of the columns `by`, which should tell all rows apart; ties are ranked in some order.

    Rows that are equal in all of `by` share a partition, so a column with many
    equal values needs another one after it, such as an id.
    """
    spread = rows.repartitionByRange(rows.sparkSession.sparkContext.defaultParallelism * 4, *by).sortWithinPartitions(*by)
    # the sampled borders differ from run to run; the checkpoint makes both jobs below see one layout
    laid = cut(spread.withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))))
    counts = {r["_part"]: r["count"] for r in laid.groupBy("_part").count().collect()}  # one row for each partition
    parts = sorted(counts)
    before = [total - counts[p] for p, total in zip(parts, accumulate(counts[p] for p in parts), strict=True)]
    offsets = laid.sparkSession.createDataFrame(list(zip(parts, before, strict=True)), "_part int, _before long")
    return laid.join(F.broadcast(offsets), "_part").withColumn(name, F.col("_before") + F.col("_at") + 1).drop("_part", "_at", "_before")


def polynomial(coefficients: Sequence[float], x: Column) -> Column:
    out = F.lit(float(coefficients[-1]))
    for c in reversed(coefficients[:-1]):
        out = out * x + F.lit(float(c))
    return out


def normal_quantile(p: Column) -> Column:
    """Inverse of the normal distribution function to double precision, as an expression; null outside of (0, 1)."""
    q = p - 0.5
    s = F.lit(0.180625) - q * q
    r = F.sqrt(-F.log(F.least(p, 1 - p)))
    ratio = lambda over, under, x: polynomial(over, x) / polynomial(under, x)
    tail = F.when(r <= 5, ratio(TAIL, TAIL_BELOW, r - 1.6)).otherwise(ratio(FAR, FAR_BELOW, r - 5.0))
    inside = F.when(F.abs(q) <= 0.425, q * ratio(CENTRE, CENTRE_BELOW, s)).otherwise(F.signum(q) * tail)
    return F.when((p > 0) & (p < 1), inside)
