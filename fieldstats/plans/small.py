"""Queries of operators that others only use on the way: plot tables, chunks, accumulator state, index statistics, fit bins."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from fieldstats.functions import models, plotdata
from fieldstats.operators import anisotropy, pairs, variogram
from fieldstats.operators.fit import usable
from fieldstats.plans.queries import _BIN_RIGHT, _BINS, _DIRS, _FOUND, DIST, EDGES, EVT, MODEL, PAIRS, PTS, events, pts, query, r6, rounded
from fieldstats.streaming import accumulator


def _table(spark, sf_dir):
    return variogram.directional(pts(spark, sf_dir), _DIRS, 22.5, edges=EDGES)


@query("plot_directional", f"WITH {_FOUND}), {_BINS} SELECT h.angle, round(any_value(b.lag), 6)+0.0 AS lag, round(avg(g), 6)+0.0 AS gamma, count(*)::BIGINT AS count, round(avg(g) - 1.96*sqrt(var_pop(g)/count(g)), 6)+0.0 AS ci_lower, round(avg(g) + 1.96*sqrt(var_pop(g)/count(g)), 6)+0.0 AS ci_upper FROM hit h JOIN bins b USING (bin) GROUP BY h.angle, h.bin")
def _(spark, sf_dir):
    return rounded(plotdata.directional(_table(spark, sf_dir)), "lag", "gamma", "ci_lower", "ci_upper")


_RANGES = f"{_FOUND}), {_BINS}, m AS (SELECT angle, bin, lag, avg(g) AS gamma FROM hit JOIN bins USING (bin) GROUP BY 1, 2, 3), t AS (SELECT *, max(gamma) OVER () AS sill FROM m), rg AS (SELECT angle, coalesce(min(CASE WHEN gamma >= 0.7*sill THEN lag END), max(lag)) AS range FROM t GROUP BY 1)"


@query("variogram_rose", f"WITH {_RANGES} SELECT angle, round(range, 6)+0.0 AS range FROM rg UNION ALL SELECT angle + 180, round(range, 6)+0.0 FROM rg")
def _(spark, sf_dir):
    return rounded(plotdata.rose(_table(spark, sf_dir), 0.7), "range")


@query("automatic_directions", f"WITH {PTS}, m AS (SELECT degrees(0.5*atan2(2*covar_samp(x, y), var_samp(x)-var_samp(y))) AS a FROM pts) SELECT i::INT AS i, round((a + 360 + i*30.0) % 180, 5)+0.0 AS angle FROM m, (SELECT unnest(range(0, 6)) AS i)")
def _(spark, sf_dir):
    found = anisotropy.automatic_directions(pts(spark, sf_dir), 6)
    return spark.createDataFrame([(i, round(a, 5)) for i, a in enumerate(found)], "i int, angle double")


@query("chunks", f"WITH {EVT} SELECT (id // 700)::BIGINT AS chunk, count(*)::BIGINT AS n, min(id) AS first, max(id) AS last FROM evt GROUP BY 1")
def _(spark, sf_dir):
    return accumulator.chunks(events(spark, sf_dir), 700).groupBy("chunk").agg(F.count("*").alias("n"), F.min("id").alias("first"), F.max("id").alias("last"))


@query("accumulator_state", f"WITH {PAIRS}, m AS (SELECT ({_BIN_RIGHT})::INT AS bin, g, ai, bi FROM pairs WHERE d <= {EDGES[-1]!r}) SELECT bin, count(*)::DOUBLE AS weight, round(sum(g), 5)+0.0 AS total, (SELECT count(*) FROM m)::DOUBLE AS all_weight FROM m GROUP BY 1")
def _(spark, sf_dir):
    """Reset forgets what was added before; chunks of even and odd ids and their cross pairs then add up to all pairs."""
    p = pts(spark, sf_dir)
    even, odd = p.filter("id % 2 = 0"), p.filter("id % 2 = 1")
    used = accumulator.Accumulator(spark, EDGES).add_chunk(even).reset()
    both = used.add_chunk(even).merge(used.add_chunk(odd)).add_cross(even, odd)
    return both.state.select("bin", "weight", (F.round("total", 5) + F.lit(0.0)).alias("total"), F.lit(float(both.total_weight())).alias("all_weight"))


@query("index_statistics", f"WITH {EVT}, c AS (SELECT floor(x/0.5) AS cx, floor(y/0.5) AS cy, count(*) AS n FROM evt GROUP BY 1, 2) SELECT sum(n)::BIGINT AS points, count(*)::BIGINT AS cells, min(n)::BIGINT AS fewest, max(n)::BIGINT AS most, round(avg(n), 6)+0.0 AS mean FROM c")
def _(spark, sf_dir):
    return rounded(pairs.index_statistics(events(spark, sf_dir), 0.5), "mean")


@query("covariance_between", f"WITH {PAIRS} SELECT ai AS a_id, bi AS b_id, round({MODEL.sill} - CASE WHEN d = 0 THEN 0 ELSE {MODEL.nugget} + {MODEL.sill - MODEL.nugget!r}*(1 - exp(-d/{MODEL.range})) END, 6)+0.0 AS c FROM pairs WHERE d <= 0.05")
def _(spark, sf_dir):
    p = pts(spark, sf_dir)
    near = pairs.radius_pairs(p, 0.05)
    c = models.covariance(F.col("d"), MODEL.model, MODEL.nugget, MODEL.sill, MODEL.range)
    return near.select("a_id", "b_id", r6(c).alias("c"))


@query("fit_bins", "WITH t AS (SELECT p_partkey AS k, p_size::DOUBLE AS lag, CASE WHEN p_partkey % 7 = 0 THEN NULL ELSE p_retailprice END AS gamma, p_partkey % 4 AS n FROM part) SELECT lag, round(gamma, 6)+0.0 AS gamma, n::DOUBLE AS count FROM t WHERE gamma IS NOT NULL AND n > (SELECT CASE WHEN max(n) > 1 THEN 1 ELSE 0 END FROM t WHERE gamma IS NOT NULL)")
def _(spark, sf_dir):
    """Lags with pairs only; those of one pair give way to better ones."""
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    gamma = F.when(F.col("p_partkey") % 7 != 0, F.col("p_retailprice"))
    d, g, w = usable(part.select(F.col("p_size").cast("double").alias("lag"), gamma.alias("gamma"), (F.col("p_partkey") % 4).alias("count")))
    return rounded(spark.createDataFrame(list(zip(d.tolist(), g.tolist(), w.tolist(), strict=True)), "lag double, gamma double, count double"), "gamma")


@query("kriging_anisotropy_info", "SELECT round(max(p_size)::DOUBLE, 6)+0.0 AS range_major, round(min(p_size)::DOUBLE, 6)+0.0 AS range_minor, round(max(p_size)/min(p_size)::DOUBLE, 6)+0.0 AS ratio, round(degrees(0.4), 6)+0.0 AS angle_deg, max(p_size) > 1.2*min(p_size) AS is_anisotropic FROM part")
def _(spark, sf_dir):
    """Report of an anisotropic estimator whose ranges are the largest and the smallest part size."""
    from fieldstats.operators import kriging
    from fieldstats.operators.fit import Variogram

    high, low = spark.read.parquet(f"{sf_dir}/part.parquet").agg(F.max("p_size"), F.min("p_size")).first()
    found = kriging.anisotropic(Variogram("spherical", 0.1, 1.0, float(high)), float(low), 0.4).anisotropy()
    assert math.isclose(found["angle"], 0.4)
    row = tuple(found[k] for k in ("range_major", "range_minor", "ratio", "angle_deg", "is_anisotropic"))
    return rounded(spark.createDataFrame([row], "range_major double, range_minor double, ratio double, angle_deg double, is_anisotropic boolean"), "range_major", "range_minor", "ratio", "angle_deg")


_SPLIT = f"{PTS}, l AS (SELECT * FROM pts WHERE mark < '5'), k AS (SELECT * FROM pts WHERE mark >= '5')"


@query("cross_block_pairs", f"WITH {_SPLIT}, p AS (SELECT {DIST} AS d, 0.5*(a.value-b.value)*(a.value-b.value) AS g FROM l a, k b), m AS (SELECT ({_BIN_RIGHT})::INT AS bin, g FROM p WHERE d <= {EDGES[-1]!r}) SELECT bin, count(*)::DOUBLE AS weight, round(avg(g), 6)+0.0 AS gamma FROM m GROUP BY 1")
def _(spark, sf_dir):
    p = pts(spark, sf_dir)
    out = accumulator.Accumulator(spark, EDGES).add_cross(p.filter("mark < '5'"), p.filter("mark >= '5'")).finalize(sparse=True)
    return rounded(out, "gamma").select("bin", "weight", "gamma")
