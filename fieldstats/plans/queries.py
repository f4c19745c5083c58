"""Registered spatial queries and their SQL twins.

The tables have no coordinates, so point sets are projected from them: `pts` from
the first components of the embeddings.  Floats are rounded to six places on both
sides, since sums over partitions have no fixed order.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldstats.functions import models, plotdata
from fieldstats.operators import anisotropy, autocorr, blocks, kriging, patterns, ranks, validation, variogram
from fieldstats.operators import pairs as pairing
from fieldstats.operators.fit import Variogram, criterion
from fieldstats.session import shared_folder
from fieldstats.sources import points as source
from fieldstats.streaming import accumulator

EDGES = [0.05 * i for i in range(9)]
RADII = [0.05, 0.1, 0.2, 0.3]
MODEL = Variogram("exponential", 0.001, 0.02, 0.15)

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}

PTS = "pts AS (SELECT vec_id::BIGINT AS id, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y, embedding[3]::DOUBLE AS value, label::VARCHAR AS mark FROM embeddings)"
DIST = "sqrt((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y))"
PAIRS = f"{PTS}, pairs AS (SELECT a.id AS ai, b.id AS bi, b.x-a.x AS dx, b.y-a.y AS dy, {DIST} AS d, 0.5*(a.value-b.value)*(a.value-b.value) AS g, a.value AS va, b.value AS vb FROM pts a JOIN pts b ON a.id < b.id)"
NEAR = f"{PTS}, near AS (SELECT a.id AS src, b.id AS dst, {DIST} AS d FROM pts a JOIN pts b ON a.id <> b.id)"
KNN = f"{NEAR}, knn AS (SELECT src, dst, d, r FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY d, dst) AS r FROM near) WHERE r <= 6)"
EDGE = f"{KNN}, e AS (SELECT src, dst, 1.0/6.0 AS w FROM knn), z AS (SELECT id, value, value - avg(value) OVER () AS z FROM pts), j AS (SELECT e.*, p.value AS xi, p.z AS zi, q.value AS xj, q.z AS zj FROM e JOIN z p ON p.id = e.src JOIN z q ON q.id = e.dst)"


def pts(spark: SparkSession, sf_dir: str, shift: float = 0.0) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    at = lambda i: F.element_at("embedding", i).cast("double")
    return e.select(F.col("vec_id").cast("long").alias("id"), at(1).alias("x"), at(2).alias("y"), (at(3) + shift).alias("value"), F.col("label").cast("string").alias("mark"))


def pts3(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    at = lambda i: F.element_at("embedding", i).cast("double")
    return e.select(F.col("vec_id").cast("long").alias("id"), at(1).alias("x"), at(2).alias("y"), at(3).alias("z"), at(4).alias("value"))


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    day = (F.col("ts").cast("timestamp").cast("double") - F.lit(1704067200.0)) / 86400.0
    return e.select(F.col("event_id").cast("long").alias("id"), day.alias("x"), (F.col("value") / 16.0).alias("y"), F.col("value").alias("value"), F.col("event_type").alias("mark"))


EVT = "evt AS (SELECT event_id::BIGINT AS id, (epoch_us(ts)/1000000.0 - 1704067200.0)/86400.0 AS x, value/16.0 AS y, value, event_type AS mark FROM events)"


def r6(c: Column | str) -> Column:
    """Six places, without negative zero."""
    return F.round(F.col(c) if isinstance(c, str) else c, 6) + F.lit(0.0)


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: r6(c) for c in columns})


def quantile_sql(p: str) -> str:
    """The normal quantile of a column, in SQL."""

    def poly(coefficients, x: str) -> str:
        out = repr(coefficients[-1])
        for c in reversed(coefficients[:-1]):
            out = f"({out}*{x} + {c!r}::DOUBLE)"
        return out

    ratio = lambda over, under, x: f"{poly(over, x)}/{poly(under, x)}"
    q, r = f"({p}-0.5)", f"sqrt(-ln(least({p}, 1-{p})))"
    tail = f"CASE WHEN {r} <= 5 THEN {ratio(ranks.TAIL, ranks.TAIL_BELOW, f'({r}-1.6)')} ELSE {ratio(ranks.FAR, ranks.FAR_BELOW, f'({r}-5.0)')} END"
    return f"(CASE WHEN abs({q}) <= 0.425 THEN {q}*{ratio(ranks.CENTRE, ranks.CENTRE_BELOW, f'(0.180625-{q}*{q})')} ELSE sign({q})*{tail} END)"


def query(name: str, sql: str | None = None):
    def add(f):
        _QUERIES[name] = f
        if sql is not None:
            _SQL[name] = sql
        return f

    return add


def grid_targets(spark: SparkSession, n: int = 12) -> DataFrame:
    return kriging.grid((-0.4, -0.4), (0.4, 0.4), n, n, spark)


def knn6(p: DataFrame) -> DataFrame:
    return autocorr.weights_knn(p, 6)


# -- variograms -------------------------------------------------------------

_BIN = " + ".join(f"(d >= {e!r})::INT" for e in EDGES[1:-1])
_BIN_RIGHT = _BIN.replace(">=", ">")
_BINS = f"bins AS (SELECT i::INT AS bin, (e[i+1]+e[i+2])/2 AS lag FROM (SELECT unnest(range(0, {len(EDGES) - 1})) AS i, {EDGES!r}::DOUBLE[] AS e))"


@query("variogram_empirical_fixed", f"WITH {PAIRS}, {_BINS}, m AS (SELECT ({_BIN})::INT AS bin, avg(g) AS gamma, count(*) AS n FROM pairs WHERE d >= {EDGES[0]!r} AND d < {EDGES[-1]!r} GROUP BY 1) SELECT b.bin, round(lag, 6)+0.0 AS lag, round(coalesce(gamma, 0), 6)+0.0 AS gamma, coalesce(n, 0)::BIGINT AS count FROM bins b LEFT JOIN m USING (bin)")
def _(spark, sf_dir):
    return rounded(variogram.empirical(pts(spark, sf_dir), EDGES), "lag", "gamma")


@query("variogram_empirical_default", f"WITH {PAIRS}, top AS (SELECT max(d)/2 AS m FROM pairs), bins AS (SELECT i::INT AS bin, i*(m/15) AS lo, CASE WHEN i = 14 THEN m ELSE (i+1)*(m/15) END AS hi FROM top, (SELECT unnest(range(0, 15)) AS i)) SELECT bin, round(any_value((lo+hi)/2), 6)+0.0 AS lag, round(coalesce(avg(g), 0), 6)+0.0 AS gamma, count(g)::BIGINT AS count FROM bins LEFT JOIN pairs ON d >= lo AND d < hi GROUP BY bin")
def _(spark, sf_dir):
    return rounded(variogram.empirical(pts(spark, sf_dir)), "lag", "gamma")


@query("variogram_empirical_3d", "WITH p3 AS (SELECT vec_id AS id, embedding[1]::DOUBLE x, embedding[2]::DOUBLE y, embedding[3]::DOUBLE z, embedding[4]::DOUBLE v FROM embeddings), pairs AS (SELECT sqrt((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)+(a.z-b.z)*(a.z-b.z)) AS d, 0.5*(a.v-b.v)*(a.v-b.v) AS g FROM p3 a JOIN p3 b ON a.id < b.id), " + f"{_BINS} SELECT b.bin, round(any_value(lag), 6)+0.0 AS lag, round(coalesce(avg(g), 0), 6)+0.0 AS gamma, count(g)::BIGINT AS count FROM bins b LEFT JOIN (SELECT ({_BIN})::INT AS bin, g FROM pairs WHERE d >= 0 AND d < {EDGES[-1]!r}) USING (bin) GROUP BY b.bin")
def _(spark, sf_dir):
    return rounded(variogram.empirical(pts3(spark, sf_dir), EDGES), "lag", "gamma")


@query("variogram_grid_join", f"WITH {EVT}, c AS (SELECT *, floor(x/0.25)::BIGINT AS cx, floor(y/0.25)::BIGINT AS cy FROM evt), o AS (SELECT unnest([-1,0,1]) AS k), pairs AS (SELECT {DIST} AS d, 0.5*(a.value-b.value)*(a.value-b.value) AS g FROM c a CROSS JOIN o ox CROSS JOIN o oy JOIN c b ON b.cx = a.cx + ox.k AND b.cy = a.cy + oy.k WHERE a.id < b.id) SELECT ((d >= 0.1)::INT + (d >= 0.2)::INT)::INT AS bin, round(avg(g), 5)+0.0 AS gamma, count(*)::BIGINT AS count FROM pairs WHERE d < 0.25 GROUP BY 1")
def _(spark, sf_dir):
    found = pairing.radius_pairs(events(spark, sf_dir), 0.25)
    binned = found.select(variogram.bin_of(F.col("d"), [0.0, 0.1, 0.2, 0.25]).alias("bin"), variogram.semivariance_column().alias("g")).filter(F.col("bin").isNotNull())
    return binned.groupBy("bin").agg((F.round(F.avg("g"), 5) + F.lit(0.0)).alias("gamma"), F.count("*").alias("count"))


@query("variogram_blocks", f"WITH {PAIRS}, {_BINS} SELECT b.bin, round(avg(g), 6)+0.0 AS gamma, count(*)::BIGINT AS count FROM bins b JOIN (SELECT ({_BIN})::INT AS bin, g FROM pairs WHERE d >= 0 AND d < {EDGES[-1]!r}) USING (bin) GROUP BY b.bin")
def _(spark, sf_dir):
    return rounded(variogram.block_sums(pts(spark, sf_dir), EDGES).filter("count > 0"), "gamma")


@query("variogram_streaming", f"WITH {PAIRS}, {_BINS}, m AS (SELECT ({_BIN_RIGHT})::INT AS bin, avg(g) AS gamma, count(*) AS n FROM pairs WHERE d >= {EDGES[0]!r} AND d <= {EDGES[-1]!r} GROUP BY 1) SELECT b.bin, round(lag, 6)+0.0 AS lag, round(coalesce(gamma, 0), 6)+0.0 AS gamma, coalesce(n, 0)::DOUBLE AS weight FROM bins b LEFT JOIN m USING (bin)")
def _(spark, sf_dir):
    p = accumulator.chunks(pts(spark, sf_dir), 10**9)
    even, odd = p.filter("id % 2 = 0").drop("chunk"), p.filter("id % 2 = 1").drop("chunk")
    start = accumulator.Accumulator(spark, EDGES)
    merged = start.add_chunk(even).merge(start.add_chunk(odd)).add_cross(even, odd)
    return rounded(merged.finalize(), "lag", "gamma")


@query("variogram_stream_query", _SQL["variogram_streaming"])
def _(spark, sf_dir):
    base = f"{shared_folder(spark)}/stream-{np.random.default_rng().integers(1 << 62)}"
    pts(spark, sf_dir).drop("mark").repartition(3).write.parquet(f"{base}/in")
    stream = spark.readStream.schema("id long, x double, y double, value double").option("maxFilesPerTrigger", 1).parquet(f"{base}/in")
    accumulator.accumulate_points(stream, EDGES, f"{base}/state", f"{base}/history", f"{base}/checkpoint").awaitTermination()
    return rounded(accumulator.stored(spark, f"{base}/state", EDGES).finalize(), "lag", "gamma")


@query("variogram_sparse_coo", f"WITH {PAIRS} SELECT ({_BIN_RIGHT})::INT AS row, 0 AS col, round(avg(g), 6)+0.0 AS value FROM pairs WHERE d <= {EDGES[-1]!r} GROUP BY 1")
def _(spark, sf_dir):
    return rounded(accumulator.Accumulator(spark, EDGES).add_chunk(pts(spark, sf_dir)).coo(), "value")


@query("variogram_add_pairs", f"WITH {PAIRS} SELECT ({_BIN_RIGHT})::INT AS bin, round(sum(d*g)/sum(d), 6)+0.0 AS gamma, round(sum(d), 4)+0.0 AS weight FROM pairs WHERE d <= {EDGES[-1]!r} GROUP BY 1")
def _(spark, sf_dir):
    found = variogram.cloud(pts(spark, sf_dir)).select("d", "gamma", F.col("d").alias("weight"))
    out = accumulator.Accumulator(spark, EDGES).add_pairs(found).finalize(sparse=True)
    return rounded(out, "gamma").select("bin", "gamma", (F.round("weight", 4) + F.lit(0.0)).alias("weight"))


_DIRS = [0.0, 45.0, 90.0, 135.0]
_AXES = "axes AS (SELECT unnest([0.0, 45.0, 90.0, 135.0])::DOUBLE AS angle)"
_TOL = float(np.cos(np.radians(22.5)))
_FOUND = f"{PAIRS}, {_AXES}, hit AS (SELECT angle, ({_BIN})::INT AS bin, g FROM pairs, axes WHERE d > 0 AND d < {EDGES[-1]!r} AND abs(dx*cos(radians(angle)) + dy*sin(radians(angle))) >= {_TOL!r} * d"


@query("variogram_directional", f"WITH {_FOUND}), {_BINS} SELECT a.angle, b.bin, round(any_value(b.lag), 6)+0.0 AS lag, round(avg(g), 6)+0.0 AS gamma, count(g)::BIGINT AS count, round(avg(g) - 1.96*sqrt(var_pop(g)/count(g)), 6)+0.0 AS ci_lower, round(avg(g) + 1.96*sqrt(var_pop(g)/count(g)), 6)+0.0 AS ci_upper FROM axes a CROSS JOIN bins b LEFT JOIN hit h ON h.angle = a.angle AND h.bin = b.bin GROUP BY 1, 2")
def _(spark, sf_dir):
    return rounded(variogram.directional(pts(spark, sf_dir), _DIRS, 22.5, edges=EDGES), "lag", "gamma", "ci_lower", "ci_upper")


@query("variogram_directional_bandwidth", f"WITH {_FOUND} AND abs(dy*cos(radians(angle)) - dx*sin(radians(angle))) <= 0.05) SELECT angle, bin, round(avg(g), 6)+0.0 AS gamma, count(*)::BIGINT AS count FROM hit GROUP BY 1, 2")
def _(spark, sf_dir):
    out = variogram.directional(pts(spark, sf_dir), _DIRS, 22.5, bandwidth=0.05, edges=EDGES).filter("count > 0")
    return rounded(out, "gamma").select("angle", "bin", "gamma", "count")


@query("directional_summary", f"WITH {_FOUND}), m AS (SELECT angle, bin, avg(g) AS gamma, count(*) AS n FROM hit GROUP BY 1, 2) SELECT angle, count(*)::BIGINT AS lags, sum(n)::BIGINT AS pairs, round(max(gamma), 6)+0.0 AS max_gamma FROM m GROUP BY 1")
def _(spark, sf_dir):
    return rounded(variogram.summary(variogram.directional(pts(spark, sf_dir), _DIRS, 22.5, edges=EDGES)), "max_gamma")


@query("directional_ranges", f"WITH {_FOUND}), {_BINS}, m AS (SELECT angle, bin, lag, avg(g) AS gamma FROM hit JOIN bins USING (bin) GROUP BY 1, 2, 3), t AS (SELECT *, max(gamma) OVER () AS sill FROM m) SELECT angle, round(coalesce(min(CASE WHEN gamma >= 0.95*sill THEN lag END), max(lag)), 6)+0.0 AS range FROM t GROUP BY 1")
def _(spark, sf_dir):
    return rounded(variogram.direction_ranges(variogram.directional(pts(spark, sf_dir), _DIRS, 22.5, edges=EDGES)), "range").select("angle", "range")


@query("variogram_cloud_summary", f"WITH {PAIRS} SELECT count(*)::BIGINT AS n, round(avg(d), 6)+0.0 AS mean_d, round(avg(g), 6)+0.0 AS mean_gamma, round(max(d), 6)+0.0 AS max_d, round(max(g), 6)+0.0 AS max_gamma FROM pairs")
def _(spark, sf_dir):
    return variogram.cloud(pts(spark, sf_dir)).agg(F.count("*").alias("n"), r6(F.avg("d")).alias("mean_d"), r6(F.avg("gamma")).alias("mean_gamma"), r6(F.max("d")).alias("max_d"), r6(F.max("gamma")).alias("max_gamma"))


@query("variogram_model_eval", "WITH h AS (SELECT p_partkey::BIGINT AS id, (p_size - 1) / 25.0 AS h FROM part) SELECT id, round(CASE WHEN h = 0 THEN 0 ELSE 0.1 + 0.9*(1-exp(-h/0.5)) END, 6)+0.0 AS exponential, round(CASE WHEN h = 0 THEN 0 WHEN h/0.5 < 1 THEN 0.1 + 0.9*(1.5*(h/0.5) - 0.5*(h/0.5)*(h/0.5)*(h/0.5)) ELSE 1.0 END, 6)+0.0 AS spherical, round(CASE WHEN h = 0 THEN 0 ELSE 0.1 + 0.9*(1-exp(-(h/0.5)*(h/0.5))) END, 6)+0.0 AS gaussian, round(1.0 - CASE WHEN h = 0 THEN 0 ELSE 0.1 + 0.9*(1-exp(-h/0.5)) END, 6)+0.0 AS covariance FROM h")
def _(spark, sf_dir):
    h = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").cast("long").alias("id"), ((F.col("p_size") - 1) / 25.0).alias("h"))
    return h.select("id", *[r6(models.semivariance(F.col("h"), m, 0.1, 1.0, 0.5)).alias(m) for m in models.MODELS], r6(models.covariance(F.col("h"), "exponential", 0.1, 1.0, 0.5)).alias("covariance"))


@query("variogram_aic_bic", f"WITH {PAIRS}, {_BINS}, m AS (SELECT ({_BIN})::INT AS bin, avg(g) AS gamma, count(*) AS n FROM pairs WHERE d < {EDGES[-1]!r} GROUP BY 1), s AS (SELECT count(*) AS k, greatest(sum(n*(gamma - (0.001 + 0.019*(1-exp(-lag/0.15))))*(gamma - (0.001 + 0.019*(1-exp(-lag/0.15))))), 1e-12) AS rss FROM m JOIN bins USING (bin)) SELECT round(k*ln(rss/k) + 6, 5)+0.0 AS aic, round(k*ln(rss/k) + 3*ln(k), 5)+0.0 AS bic FROM s")
def _(spark, sf_dir):
    table = variogram.empirical(pts(spark, sf_dir), EDGES).filter("count > 0").orderBy("bin").toPandas()
    return spark.createDataFrame([tuple(round(float(criterion(kind, MODEL, table["lag"], table["gamma"], table["count"])), 5) for kind in ("aic", "bic"))], "aic double, bic double")


# -- distances and joins ----------------------------------------------------


@query("dist_euclidean", f"WITH {PAIRS} SELECT ai AS id, count(*)::BIGINT AS n, round(sum(d), 5)+0.0 AS total, round(min(d), 6)+0.0 AS nearest FROM pairs GROUP BY 1")
def _(spark, sf_dir):
    out = pairing.later_sums(pts(spark, sf_dir), blocks.euclidean, lambda a, b: models.euclidean(a, b))
    return out.select("id", "n", (F.round("total", 5) + F.lit(0.0)).alias("total"), r6("nearest").alias("nearest"))


@query("dist_haversine", f"WITH {PTS}, g AS (SELECT id, 90*x AS lat, 180*y AS lon FROM pts), p AS (SELECT a.id, 2*6371.0*asin(sqrt(sin((radians(b.lat)-radians(a.lat))/2)*sin((radians(b.lat)-radians(a.lat))/2) + cos(radians(a.lat))*cos(radians(b.lat))*sin((radians(b.lon)-radians(a.lon))/2)*sin((radians(b.lon)-radians(a.lon))/2))) AS d FROM g a JOIN g b ON a.id < b.id) SELECT id, round(sum(d), 2)+0.0 AS total, round(max(d), 4)+0.0 AS farthest FROM p GROUP BY 1")
def _(spark, sf_dir):
    p = pts(spark, sf_dir).select("id", (90 * F.col("x")).alias("lat"), (180 * F.col("y")).alias("lon"))
    out = pairing.later_sums(p, blocks.haversine, lambda a, b: models.haversine(*a, *b), ["lat", "lon"])
    return out.select("id", (F.round("total", 2) + F.lit(0.0)).alias("total"), (F.round("farthest", 4) + F.lit(0.0)).alias("farthest"))


_C, _S = float(np.cos(0.6)), float(np.sin(0.6))


@query("dist_anisotropic", f"WITH {PAIRS}, s AS (SELECT ai, sqrt(((dx*{_C!r}+dy*{_S!r})/0.3)*((dx*{_C!r}+dy*{_S!r})/0.3) + ((dy*{_C!r}-dx*{_S!r})/0.1)*((dy*{_C!r}-dx*{_S!r})/0.1)) AS d FROM pairs) SELECT ai AS id, round(sum(d), 4)+0.0 AS total, round(min(d), 6)+0.0 AS nearest FROM s GROUP BY 1")
def _(spark, sf_dir):
    shape = (0.3, 0.1, 0.6)
    out = pairing.later_sums(pts(spark, sf_dir), blocks.anisotropic(*shape), lambda a, b: models.anisotropic(b[0] - a[0], b[1] - a[1], *shape))
    return out.select("id", (F.round("total", 4) + F.lit(0.0)).alias("total"), r6("nearest").alias("nearest"))


@query("rotate_isotropic", f"WITH {PTS} SELECT id, round((x*{_C!r} - y*{_S!r})/0.3, 6)+0.0 AS u, round((x*{_S!r} + y*{_C!r})/0.1, 6)+0.0 AS v FROM pts")
def _(spark, sf_dir):
    u, v = models.to_isotropic(F.col("x"), F.col("y"), 0.3, 0.1, 0.6)
    return pts(spark, sf_dir).select("id", r6(u).alias("u"), r6(v).alias("v"))


@query("design_matrix", f"WITH {PTS} SELECT id, 1.0::DOUBLE AS c0, round(x, 6)+0.0 AS c1, round(y, 6)+0.0 AS c2, round(x*x, 6)+0.0 AS c3, round(y*y, 6)+0.0 AS c4, round(x*y, 6)+0.0 AS c5 FROM pts")
def _(spark, sf_dir):
    columns = models.design_columns([F.col("x"), F.col("y")], "quadratic")
    return pts(spark, sf_dir).select("id", *[r6(c).alias(f"c{i}") for i, c in enumerate(columns)])


@query("nn_kth", f"WITH {NEAR} SELECT src AS id, round(d, 6)+0.0 AS distance, dst AS neighbor_id FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY d, dst) AS r FROM near) WHERE r = 3")
def _(spark, sf_dir):
    return rounded(pairing.nearest_neighbor_distances(pts(spark, sf_dir), 3), "distance")


@query("knn_join", f"WITH {PTS}, t AS (SELECT i::BIGINT AS id, -0.4 + 0.8*(i % 12)/11.0 AS x, -0.4 + 0.8*floor(i/12)/11.0 AS y FROM (SELECT unnest(range(0, 144)) AS i)), n AS (SELECT a.id AS query_id, b.id AS neighbor_id, {DIST} AS distance FROM t a CROSS JOIN pts b) SELECT query_id, r::INT AS rank, neighbor_id, round(distance, 6)+0.0 AS distance FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, neighbor_id) AS r FROM n) WHERE r <= 5")
def _(spark, sf_dir):
    return rounded(pairing.knn_join(grid_targets(spark), pts(spark, sf_dir), 5), "distance")


@query("radius_join", f"WITH {PAIRS} SELECT ai AS src, bi AS dst, round(d, 6)+0.0 AS d FROM pairs WHERE d <= 0.1")
def _(spark, sf_dir):
    return rounded(pairing.radius_pairs(pts(spark, sf_dir), 0.1).select(F.col("a_id").alias("src"), F.col("b_id").alias("dst"), "d"), "d")


@query("sparse_distance_knn", f"WITH {KNN}, u AS (SELECT src, dst, d FROM knn UNION ALL SELECT dst, src, d FROM knn) SELECT src, dst, round(max(d), 6)+0.0 AS d FROM u GROUP BY 1, 2")
def _(spark, sf_dir):
    return rounded(pairing.sparse_distances(pts(spark, sf_dir), max_neighbors=6), "d")


@query("sparse_distance_radius", f"WITH {NEAR} SELECT src, dst, round(d, 6)+0.0 AS d FROM near WHERE d > 0 AND d <= 0.1")
def _(spark, sf_dir):
    return rounded(pairing.sparse_distances(pts(spark, sf_dir), max_distance=0.1), "d")


@query("filter_by_distance", f"WITH {KNN} SELECT src AS query_id, r::INT AS rank, dst AS neighbor_id, round(d, 6)+0.0 AS distance FROM knn WHERE d <= 0.05")
def _(spark, sf_dir):
    p = pts(spark, sf_dir)
    return rounded(pairing.filter_by_distance(pairing.knn_join(p, p, 6, same=True), 0.05), "distance")


@query("validate_points", f"WITH {PTS} SELECT count(*)::BIGINT AS n, round(min(x), 6)+0.0 AS xmin, round(max(y), 6)+0.0 AS ymax FROM pts")
def _(spark, sf_dir):
    p = source.validate_values(source.validate_coordinates(pts(spark, sf_dir)))
    return p.agg(F.count("*").alias("n"), r6(F.min("x")).alias("xmin"), r6(F.max("y")).alias("ymax"))


_REFUSALS = "SELECT mark, bool_or(abs(x) < 0.001) AS coordinates, bool_or(abs(value) < 0.002) AS values_, bool_or(abs(y) < 0.003) AS array_ FROM pts GROUP BY 1"


@query("validate_refusals", f"WITH {PTS} {_REFUSALS}")
def _(spark, sf_dir):
    """Which checks refuse the points of each mark once values near zero are NaN, infinite or null."""
    bad = {"x": (0.001, float("nan")), "value": (0.002, float("inf")), "y": (0.003, None)}
    p = pts(spark, sf_dir)
    p = p.select("id", "mark", *[F.when(F.abs(c) < low, F.lit(to).cast("double")).otherwise(F.col(c)).alias(c) for c, (low, to) in bad.items()])
    rows = []
    for (mark,) in p.select("mark").distinct().collect():
        own = p.filter(F.col("mark").eqNullSafe(mark))
        rows.append((mark, *[_refused(check, own, arg) for check, arg in ((source.validate_coordinates, ["x", "x"]), (source.validate_values, "value"), (source.validate_array, "y"))]))
    return spark.createDataFrame(rows, "mark string, coordinates boolean, values_ boolean, array_ boolean")


def _refused(check: Callable, points: DataFrame, columns: list[str] | str) -> bool:
    try:
        check(points, columns)
    except ValueError:
        return True
    return False


# -- point patterns ---------------------------------------------------------

_K = f"{PAIRS}, n AS (SELECT count(*) AS n FROM pts), rs AS (SELECT unnest({RADII!r}::DOUBLE[]) AS r), k AS (SELECT r, 2.0*1.0/(any_value(n)*any_value(n))*count(d) AS k FROM rs CROSS JOIN n LEFT JOIN pairs ON d <= r GROUP BY r)"


@query("ripley_k", f"WITH {_K} SELECT r, round(k, 6)+0.0 AS k FROM k")
def _(spark, sf_dir):
    return rounded(patterns.ripley_k(pts(spark, sf_dir), RADII, 1.0), "k")


@query("ripley_l", f"WITH {_K} SELECT r, round(sqrt(k/pi()), 6)+0.0 AS l FROM k")
def _(spark, sf_dir):
    return rounded(patterns.ripley_l(pts(spark, sf_dir), RADII, 1.0), "l")


@query("pair_correlation", f"WITH {_K}, s AS (SELECT r, k, r-lag(r) OVER w AS h0, lead(r) OVER w - r AS h1, lag(k) OVER w AS k0, lead(k) OVER w AS k2 FROM k WINDOW w AS (ORDER BY r)) SELECT r, round(CASE WHEN k0 IS NULL THEN (k2-k)/h1 WHEN k2 IS NULL THEN (k-k0)/h0 ELSE (h0*h0*k2+(h1*h1-h0*h0)*k-h1*h1*k0)/(h0*h1*(h0+h1)) END / (2*pi()*r), 6)+0.0 AS pcf FROM s")
def _(spark, sf_dir):
    return rounded(patterns.pair_correlation(pts(spark, sf_dir), RADII, 1.0), "pcf")


@query("g_function", f"WITH {NEAR}, m AS (SELECT src, min(d) AS d FROM near GROUP BY 1), rs AS (SELECT unnest([0.01, 0.02, 0.05, 0.1]) AS r) SELECT r::DOUBLE AS r, round(avg((d <= r)::INT), 6)+0.0 AS g FROM rs CROSS JOIN m GROUP BY r")
def _(spark, sf_dir):
    return rounded(patterns.g_function(pts(spark, sf_dir), [0.01, 0.02, 0.05, 0.1]), "g")


@query("f_function_grid", f"WITH {PTS}, t AS (SELECT i AS id, -0.4 + 0.8*(i % 12)/11.0 AS x, -0.4 + 0.8*floor(i/12)/11.0 AS y FROM (SELECT unnest(range(0, 144)) AS i)), m AS (SELECT a.id, min({DIST}) AS d FROM t a CROSS JOIN pts b GROUP BY 1), rs AS (SELECT unnest([0.01, 0.02, 0.05, 0.1]) AS r) SELECT r::DOUBLE AS r, round(avg((d <= r)::INT), 6)+0.0 AS f FROM rs CROSS JOIN m GROUP BY r")
def _(spark, sf_dir):
    return rounded(patterns.f_function(pts(spark, sf_dir), [0.01, 0.02, 0.05, 0.1], targets=grid_targets(spark)), "f")


@query("segregation", "WITH c AS (SELECT least(greatest(floor((c_nationkey::DOUBLE - 0.0)/24.0*5), 0), 4)::INT AS cx, least(greatest(floor((c_acctbal/1000.0 + 1.0)/11.0*5), 0), 4)::INT AS cy, c_mktsegment AS mark FROM customer), n AS (SELECT cx, cy, mark, count(*) AS n FROM c GROUP BY ALL), t AS (SELECT mark, sum(n) AS t FROM n GROUP BY 1), w AS (SELECT sum(t) AS total, count(*) AS k FROM t), e AS (SELECT -sum(t/total*ln(t/total)) AS e FROM t, w), q AS (SELECT *, sum(n) OVER (PARTITION BY cx, cy) AS s FROM n), h AS (SELECT cx, cy, s, -sum(n/s*ln(n/s)) AS h FROM q GROUP BY 1, 2, 3), l AS (SELECT sum(s/total*h) AS l FROM h, w) SELECT round((e-l)/e, 6)+0.0 AS theil_h, round(l, 6)+0.0 AS cell_entropy, round(e, 6)+0.0 AS global_entropy, NULL::DOUBLE AS dissimilarity, k::DOUBLE AS n_groups FROM e, l, w")
def _(spark, sf_dir):
    c = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").cast("double").alias("x"), (F.col("c_acctbal") / 1000.0).alias("y"), F.col("c_mktsegment").alias("mark"))
    return rounded(patterns.segregation(c, 5, (0.0, 24.0, -1.0, 10.0)), "theil_h", "cell_entropy", "global_entropy")


@query("kde_grid", f"WITH {PTS}, m AS (SELECT count(*) AS n, var_samp(x) AS xx, var_samp(y) AS yy, covar_samp(x, y) AS xy FROM pts), h AS (SELECT n, xx*pow(n, -1.0/3) AS a, yy*pow(n, -1.0/3) AS c, xy*pow(n, -1.0/3) AS b FROM m), g AS (SELECT (i % 8)::INT AS ix, (i // 8)::INT AS iy, -0.4 + 0.8/7*(i % 8) AS gx, -0.4 + 0.8/7*(i // 8) AS gy FROM (SELECT unnest(range(0, 64)) AS i)) SELECT ix, iy, round(gx, 6)+0.0 AS x, round(gy, 6)+0.0 AS y, round(sum(exp(-0.5*((gx-x)*(gx-x)*c - 2*(gx-x)*(gy-y)*b + (gy-y)*(gy-y)*a)/(a*c-b*b)))/(any_value(n)*2*pi()*sqrt(any_value(a*c-b*b))), 5)+0.0 AS density FROM g CROSS JOIN pts CROSS JOIN h GROUP BY ix, iy, gx, gy")
def _(spark, sf_dir):
    out = patterns.kde(pts(spark, sf_dir), grid_size=8, bounds=(-0.4, 0.4, -0.4, 0.4))
    return rounded(out, "x", "y").withColumn("density", F.round("density", 5) + F.lit(0.0))


_GI = "{0}, m AS (SELECT count(*) AS n, avg(value) AS mean, sqrt(greatest(avg(value*value) - avg(value)*avg(value), 0)) AS s FROM pts)"


@query("gi_star", f"WITH {_GI.format(PTS)}, w AS (SELECT a.id, sum(b.value) AS wx, count(*) AS w FROM pts a JOIN pts b ON {DIST} <= 0.1 GROUP BY 1) SELECT id, round(CASE WHEN s*sqrt((n*w-w*w)/(n-1)) > 0 THEN (wx - mean*w)/(s*sqrt((n*w-w*w)/(n-1))) ELSE 0 END, 6)+0.0 AS z FROM w, m")
def _(spark, sf_dir):
    return rounded(patterns.gi_star(pts(spark, sf_dir), 0.1), "z")


@query("dbscan_core_counts", f"WITH {PTS} SELECT a.id, count(*)::BIGINT AS n, count(*) >= 8 AS core FROM pts a JOIN pts b ON {DIST} <= 0.03 GROUP BY 1")
def _(spark, sf_dir):
    return patterns.core_counts(pts(spark, sf_dir), 0.03, 8)


@query("dbscan", f"WITH RECURSIVE {PTS}, near AS (SELECT a.id AS ai, b.id AS bi FROM pts a JOIN pts b ON {DIST} <= 0.03), core AS (SELECT ai AS id FROM near GROUP BY 1 HAVING count(*) >= 8), ce AS (SELECT ai, bi FROM near WHERE ai IN (SELECT id FROM core) AND bi IN (SELECT id FROM core)), reach(id, label) AS (SELECT id, id FROM core UNION SELECT ce.bi, reach.label FROM reach JOIN ce ON ce.ai = reach.id WHERE reach.label < ce.bi), lab AS (SELECT id, min(label) AS label FROM reach GROUP BY 1), num AS (SELECT label, row_number() OVER (ORDER BY label) - 1 AS c FROM (SELECT DISTINCT label FROM lab)), own AS (SELECT * FROM lab UNION ALL SELECT ai, min(label) FROM near JOIN lab ON lab.id = near.bi WHERE ai NOT IN (SELECT id FROM core) GROUP BY 1) SELECT p.id, coalesce(c, -1)::INT AS label FROM pts p LEFT JOIN own USING (id) LEFT JOIN num USING (label)")
def _(spark, sf_dir):
    return patterns.dbscan(pts(spark, sf_dir), 0.03, 8)


@query("cluster_metrics", f"WITH {PTS}, c AS (SELECT mark, count(*) AS n, avg(x) AS cx, avg(y) AS cy FROM pts GROUP BY 1), t AS (SELECT count(*) AS n, avg(x) AS mx, avg(y) AS my FROM pts), k AS (SELECT count(*) AS k FROM c), w AS (SELECT sum((x-cx)*(x-cx)+(y-cy)*(y-cy)) AS w FROM pts JOIN c USING (mark)), b AS (SELECT sum(c.n*((cx-mx)*(cx-mx)+(cy-my)*(cy-my))) AS b FROM c, t), s AS (SELECT mark, cx, cy, avg(sqrt((x-cx)*(x-cx)+(y-cy)*(y-cy))) AS s FROM pts JOIN c USING (mark) GROUP BY 1, 2, 3), db AS (SELECT avg(r) AS db FROM (SELECT p.mark, max((p.s+q.s)/sqrt((p.cx-q.cx)*(p.cx-q.cx)+(p.cy-q.cy)*(p.cy-q.cy))) AS r FROM s p JOIN s q ON p.mark <> q.mark GROUP BY 1)), pm AS (SELECT a.id, a.mark AS am, b.mark AS bm, avg({DIST}) AS m FROM pts a JOIN pts b ON a.id <> b.id GROUP BY 1, 2, 3), sd AS (SELECT id, max(CASE WHEN am = bm THEN m END) AS a, min(CASE WHEN am <> bm THEN m END) AS b FROM pm GROUP BY 1) SELECT any_value(k)::BIGINT AS n_clusters, round(avg(CASE WHEN a IS NULL THEN 0 ELSE (sd.b-a)/greatest(a, sd.b) END), 6)+0.0 AS silhouette, round(any_value((b.b/(k-1))/(w/(t.n-k))), 5)+0.0 AS calinski_harabasz, round(any_value(db), 5)+0.0 AS davies_bouldin FROM sd, k, w, b, t, db")
def _(spark, sf_dir):
    out = patterns.cluster_metrics(pts(spark, sf_dir), "mark")
    five = lambda c: (F.round(c, 5) + F.lit(0.0)).alias(c)
    return out.select("n_clusters", r6("silhouette").alias("silhouette"), five("calinski_harabasz"), five("davies_bouldin"))


# -- weights and autocorrelation --------------------------------------------


@query("weights_knn", f"WITH {EDGE} SELECT src, dst, round(w, 6)+0.0 AS w FROM e")
def _(spark, sf_dir):
    return rounded(knn6(pts(spark, sf_dir)), "w")


@query("weights_band", f"WITH {NEAR} SELECT src, dst, round(1.0/count(*) OVER (PARTITION BY src), 6)+0.0 AS w FROM near WHERE d <= 0.1")
def _(spark, sf_dir):
    return rounded(autocorr.weights_band(pts(spark, sf_dir), 0.1), "w")


@query("weights_idw", f"WITH {NEAR} SELECT src, dst, round(pow(d, -2.0)/sum(pow(d, -2.0)) OVER (PARTITION BY src), 6)+0.0 AS w FROM near WHERE d <= 0.2")
def _(spark, sf_dir):
    return rounded(autocorr.weights_idw(pts(spark, sf_dir), 2.0, 0.2), "w")


@query("row_standardize", f"WITH {NEAR} SELECT src, dst, round((1/d)/sum(1/d) OVER (PARTITION BY src), 6)+0.0 AS w FROM near WHERE d <= 0.1")
def _(spark, sf_dir):
    return rounded(autocorr.row_standardize(autocorr.weights_band(pts(spark, sf_dir), 0.1, binary=False, standardize=False)), "w")


@query("morans_i", f"WITH {EDGE}, t AS (SELECT count(*) AS n, sum(z*z) AS ss FROM z) SELECT any_value(n)::BIGINT AS n, round(sum(w), 5)+0.0 AS s0, round(any_value(n)*sum(w*zi*zj)/(sum(w)*any_value(ss)), 6)+0.0 AS i FROM j, t")
def _(spark, sf_dir):
    p = pts(spark, sf_dir)
    return rounded(autocorr.morans_i_frame(p, knn6(p)), "i").withColumn("s0", F.round("s0", 5) + F.lit(0.0))


@query("gearys_c", f"WITH {EDGE}, t AS (SELECT count(*) AS n, sum(z*z) AS ss FROM z) SELECT any_value(n)::BIGINT AS n, round(sum(w), 5)+0.0 AS s0, round((any_value(n)-1)*sum(w*(xi-xj)*(xi-xj))/(2*sum(w)*any_value(ss)), 6)+0.0 AS c FROM j, t")
def _(spark, sf_dir):
    p = pts(spark, sf_dir)
    return rounded(autocorr.gearys_c_frame(p, knn6(p)), "c").withColumn("s0", F.round("s0", 5) + F.lit(0.0))


@query("global_g", f"WITH {EDGE.replace('embedding[3]::DOUBLE AS value', 'embedding[3]::DOUBLE + 1 AS value')}, t AS (SELECT count(*) AS n, sum(value)*sum(value) - sum(value*value) AS below FROM z) SELECT any_value(n)::BIGINT AS n, round(sum(w*xi*xj)/any_value(below), 8)+0.0 AS g FROM j, t")
def _(spark, sf_dir):
    p = pts(spark, sf_dir, 1.0)
    return autocorr.global_g_frame(p, knn6(p)).withColumn("g", F.round("g", 8) + F.lit(0.0))


@query("local_morans_i", f"WITH {EDGE}, t AS (SELECT avg(z*z) AS m2 FROM z) SELECT src AS id, round(any_value(zi)*sum(w*zj)/any_value(m2), 6)+0.0 AS i FROM j, t GROUP BY 1")
def _(spark, sf_dir):
    p = pts(spark, sf_dir)
    return rounded(autocorr.local_morans_i(p, knn6(p)), "i")


@query("local_gearys_c", f"WITH {EDGE}, t AS (SELECT avg(z*z) AS m2 FROM z) SELECT src AS id, round(sum(w*(xi-xj)*(xi-xj))/any_value(m2), 6)+0.0 AS c FROM j, t GROUP BY 1")
def _(spark, sf_dir):
    p = pts(spark, sf_dir)
    return rounded(autocorr.local_gearys_c(p, knn6(p)), "c")


@query("local_g", f"WITH {_GI.format(EDGE)}, s AS (SELECT src AS id, sum(w*xj) AS wx, sum(w) AS w1, sum(w*w) AS w2 FROM j GROUP BY 1) SELECT id, round((wx - mean*w1)/(m.s*sqrt((n*w2-w1*w1)/(n-1))), 6)+0.0 AS z FROM s, m")
def _(spark, sf_dir):
    p = pts(spark, sf_dir)
    return rounded(autocorr.local_g(p, knn6(p)), "z").select("id", "z")


_DRAWS = """b AS (SELECT id, value, row_number() OVER (ORDER BY id) AS r FROM pts),
o AS (SELECT p, id, row_number() OVER (PARTITION BY p ORDER BY md5('7:' || p || ':' || id), id) AS r FROM pts, (SELECT unnest(range(0, 99)) AS p)),
v AS (SELECT o.p, o.id, b.value AS x, b.value - (SELECT avg(value) FROM pts) AS z FROM o JOIN b USING (r)),
t AS (SELECT count(*) AS n, var_pop(value)*count(*) AS ss, sum(value) AS sx, sum(value*value) AS sxx FROM pts),
d AS (SELECT p, {0} AS s FROM (SELECT a.p, sum(w) AS s0, sum(w*{1}) AS c FROM e JOIN v a ON a.id = e.src JOIN v b ON b.id = e.dst AND b.p = a.p GROUP BY 1), t),
seen AS (SELECT {0} AS s FROM (SELECT sum(w) AS s0, sum(w*{2}) AS c FROM j), t), c AS (SELECT {3} AS c)"""
_TEST = {
    "moran": ("n*c/(s0*ss)", "a.z*b.z", "zi*zj", "0.0", "i", "(SELECT -1.0/(n-1) FROM t)"),
    "geary": ("(n-1)*c/(2*s0*ss)", "(a.x-b.x)*(a.x-b.x)", "(xi-xj)*(xi-xj)", "1.0", "c", "1.0"),
    "g": ("c/(sx*sx-sxx)", "a.x*b.x", "xi*xj", "(SELECT avg(s) FROM d)", "g", "(SELECT avg(s) FROM d)"),
}


def permutation_sql(kind: str) -> str:
    *draws, name, expected = _TEST[kind]
    shifted = EDGE.replace("embedding[3]::DOUBLE AS value", "embedding[3]::DOUBLE + 1 AS value") if kind == "g" else EDGE
    return (
        f"WITH {shifted}, {_DRAWS.format(*draws)} SELECT '{name}' AS name, round(s, 6)+0.0 AS value FROM seen UNION ALL SELECT 'expected', round({expected}, 6)+0.0 "
        "UNION ALL SELECT 'p_value', round(((SELECT count(*) FROM d, c, seen WHERE abs(d.s - c.c) >= abs(seen.s - c.c)) + 1)/100.0, 6)+0.0"
    )


def _permutations(test: Callable[..., dict[str, float]], shift: float = 0.0):
    def run(spark, sf_dir):
        p = pts(spark, sf_dir, shift)
        found = test(p, knn6(p), 99, 7)
        return rounded(spark.createDataFrame([(k, float(v)) for k, v in found.items()], "name string, value double"), "value")

    return run


query("moran_permutations", permutation_sql("moran"))(_permutations(autocorr.morans_i))
query("geary_permutations", permutation_sql("geary"))(_permutations(autocorr.gearys_c))
query("global_g_permutations", permutation_sql("g"))(_permutations(autocorr.global_getis_ord_g, 1.0))


# -- axes -------------------------------------------------------------------


@query("axial_mean", f"WITH {PTS}, a AS (SELECT degrees(atan2(y, x)) AS angle, sqrt(x*x+y*y) AS weight FROM pts), m AS (SELECT degrees(atan2(sum(weight*sin(2*radians(angle))), sum(weight*cos(2*radians(angle)))))/2 AS m FROM a) SELECT round(CASE WHEN m < 0 THEN m+180 ELSE m END, 5)+0.0 AS axial_mean FROM m")
def _(spark, sf_dir):
    a = pts(spark, sf_dir).select(F.degrees(F.atan2("y", "x")).alias("angle"), F.sqrt(F.col("x") * F.col("x") + F.col("y") * F.col("y")).alias("weight"))
    return anisotropy.axial_mean_frame(a).select((F.round("axial_mean", 5) + F.lit(0.0)).alias("axial_mean"))


@query("pca_axis", f"WITH {PTS}, m AS (SELECT degrees(0.5*atan2(2*covar_samp(x, y), var_samp(x)-var_samp(y))) AS a FROM pts) SELECT round(CASE WHEN a < 0 THEN a+180 ELSE a END, 5)+0.0 AS angle FROM m")
def _(spark, sf_dir):
    angle, _ = anisotropy.principal_axis(pts(spark, sf_dir))
    return spark.createDataFrame([(round(angle, 5),)], "angle double")


# -- fitting and kriging ----------------------------------------------------


@query("variogram_fit")
def _(spark, sf_dir):
    table = variogram.empirical(pts(spark, sf_dir), EDGES)
    rows = []
    for m in models.MODELS:
        v = Variogram(m).fit(table)
        rows.append((m, v.nugget, v.sill, v.range, v.report.converged, v.report.status))
    return spark.createDataFrame(rows, "model string, nugget double, sill double, range double, converged boolean, status string")


@query("model_selection")
def _(spark, sf_dir):
    best, scores = validation.select_model(pts(spark, sf_dir))
    return spark.createDataFrame([(m, float(s), m == best.model) for m, s in scores.items()], "model string, score double, best boolean")


_T = "t AS (SELECT i::BIGINT AS id, -0.4 + 0.8*(i % 12)/11.0 AS x, -0.4 + 0.8*floor(i/12)/11.0 AS y FROM (SELECT unnest(range(0, 144)) AS i))"


def _krige(kind: str):
    def run(spark, sf_dir):
        p = pts(spark, sf_dir)
        model = kriging.anisotropic(MODEL, 0.05, 0.6) if kind == "anisotropic" else kriging.Kriging(MODEL, kind)
        return rounded(model.fit(p).predict(grid_targets(spark), variance=True), "prediction", "variance")

    return run


def gradient_sql(kind: str) -> str:
    """Global kriging of all points in SQL: covariance systems of the targets and drift terms by conjugate gradients, one list a right side."""
    turned = "(x*cos(0.6) - y*sin(0.6))/0.15 AS p, (x*sin(0.6) + y*cos(0.6))/0.05 AS q" if kind == "anisotropic" else "x/0.15 AS p, y/0.15 AS q"
    cov = "CASE WHEN a.p = b.p AND a.q = b.q THEN 0.02 ELSE 0.019*exp(-sqrt((a.p-b.p)*(a.p-b.p)+(a.q-b.q)*(a.q-b.q))) END"
    solved = (
        f"WITH RECURSIVE {PTS}, {_T}, s AS (SELECT row_number() OVER (ORDER BY id) AS i, value AS v, x, y, {turned} FROM pts), u AS (SELECT id, {turned} FROM t), "
        f"k AS MATERIALIZED (SELECT list(l ORDER BY i) AS k FROM (SELECT a.i, list(({cov})::DOUBLE ORDER BY b.i) AS l FROM s a CROSS JOIN s b GROUP BY 1)), "
        "l AS MATERIALIZED (SELECT list(1.0::DOUBLE ORDER BY i) AS one, list(x ORDER BY i) AS xs, list(y ORDER BY i) AS ys, list(v ORDER BY i) AS v, avg(v) AS m FROM s), "
        f"c AS MATERIALIZED (SELECT a.id, list(({cov})::DOUBLE ORDER BY b.i) AS c FROM u a CROSS JOIN s b GROUP BY 1 UNION ALL SELECT -1, one FROM l UNION ALL SELECT -2, xs FROM l UNION ALL SELECT -3, ys FROM l), "
        "g(id, w, r, d, rr) USING KEY (id) AS (SELECT id, list_transform(c, lambda x: 0.0::DOUBLE), c, c, list_dot_product(c, c) FROM c UNION SELECT id, w, r, list_transform(r, lambda x, i: x + d[i]*new/rr), new FROM (SELECT *, list_dot_product(r, r) AS new FROM "
        "(SELECT id, d, rr, list_transform(w, lambda x, i: x + al*d[i]) AS w, list_transform(r, lambda x, i: x - al*kd[i]) AS r FROM (SELECT *, rr/list_dot_product(d, kd) AS al FROM (SELECT g.*, list_transform(k, lambda row: list_dot_product(row, d)) AS kd FROM g, k WHERE rr > 1e-22))))), "
        "w AS (SELECT id, w, list_dot_product(w, v) AS wv, list_dot_product(w, c) AS wc, 1 - list_sum(w) AS e1, t.x - list_dot_product(w, xs) AS e2, t.y - list_dot_product(w, ys) AS e3, v, m, one, xs, ys FROM g JOIN c USING (id) LEFT JOIN t USING (id), l)"
    )
    if kind == "simple":
        prediction, variance, drift = "wv + m*e1", "0.02 - wc", ""
    elif kind == "universal":
        product = lambda a, b: f"list_dot_product({a}.w, {a}.{b})"
        drift = (
            f", f AS (SELECT {product('a', 'one')} AS aa, {product('a', 'xs')} AS ab, {product('a', 'ys')} AS ac, {product('b', 'xs')} AS bb, {product('b', 'ys')} AS bc, {product('c', 'ys')} AS cc, a.wv AS va, b.wv AS vb, c.wv AS vc FROM w a, w b, w c WHERE a.id = -1 AND b.id = -2 AND c.id = -3), "
            "h AS (SELECT *, aa*(bb*cc-bc*bc) - ab*(ab*cc-bc*ac) + ac*(ab*bc-bb*ac) AS det FROM f), "
            "z AS (SELECT w.id, wv, wc, e1, e2, e3, va, vb, vc, (e1*(bb*cc-bc*bc) + e2*(ac*bc-ab*cc) + e3*(ab*bc-ac*bb))/det AS z1, (e1*(ac*bc-ab*cc) + e2*(aa*cc-ac*ac) + e3*(ab*ac-aa*bc))/det AS z2, (e1*(ab*bc-ac*bb) + e2*(ab*ac-aa*bc) + e3*(aa*bb-ab*ab))/det AS z3 FROM w, h)"
        )
        prediction, variance = "wv + z1*va + z2*vb + z3*vc", "0.02 - wc + e1*z1 + e2*z2 + e3*z3"
    else:
        drift = ", z AS (SELECT w.*, e1/u AS z1, va FROM w, (SELECT list_sum(w) AS u, wv AS va FROM w WHERE id = -1))"
        prediction, variance = "wv + z1*va", "0.02 - wc + e1*z1"
    return f"{solved}{drift} SELECT id, round({prediction}, 6)+0.0 AS prediction, round(greatest({variance}, 0), 6)+0.0 AS variance FROM {'z' if drift else 'w'} WHERE id >= 0"


for _kind in ("ordinary", "simple", "universal", "anisotropic"):
    query(f"krige_{_kind}", gradient_sql(_kind))(_krige(_kind))


@query("krige_exact", f"WITH {PTS} SELECT id, round(value, 5)+0.0 AS prediction, 0.0::DOUBLE AS variance FROM pts")
def _(spark, sf_dir):
    p = pts(spark, sf_dir)
    out = kriging.ordinary(MODEL).fit(p).predict(p, variance=True)
    return out.select("id", *[(F.round(c, 5) + F.lit(0.0)).alias(c) for c in ("prediction", "variance")])


_TN = f"{PTS}, {_T}, n AS (SELECT a.id, b.x, b.y, b.value AS v, {DIST} AS d, row_number() OVER (PARTITION BY a.id ORDER BY {DIST}, b.id) AS r FROM t a CROSS JOIN pts b)"
_COV = lambda d: f"(CASE WHEN {d} = 0 THEN 0.02 ELSE 0.019*exp(-({d})/0.15) END)"


@query("krige_k2", f"WITH {_TN}, p AS (SELECT p.id, p.v AS v1, q.v AS v2, {_COV('p.d')} AS c1, {_COV('q.d')} AS c2, {_COV('sqrt((p.x-q.x)*(p.x-q.x)+(p.y-q.y)*(p.y-q.y))')} AS c12 FROM n p JOIN n q ON p.id = q.id AND p.r = 1 AND q.r = 2), w AS (SELECT *, 0.5+(c1-c2)/(2*(0.02-c12)) AS w FROM p) SELECT id, round(w*v1+(1-w)*v2, 6)+0.0 AS prediction, round(greatest(0.02 - w*c1 - (1-w)*c2 - (c1 - 0.02*w - c12*(1-w)), 0), 6)+0.0 AS variance FROM w")
def _(spark, sf_dir):
    out = kriging.local(grid_targets(spark), pts(spark, sf_dir), MODEL, max_neighbors=2, min_neighbors=2)
    return rounded(out, "prediction", "variance")


@query("krige_k1", f"WITH {_TN}, m AS (SELECT avg(value) AS m FROM pts) SELECT id, round(m + {_COV('d')}/0.02*(v-m), 6)+0.0 AS prediction, round(0.02 - {_COV('d')}*{_COV('d')}/0.02, 6)+0.0 AS variance FROM n, m WHERE r = 1")
def _(spark, sf_dir):
    out = kriging.local(grid_targets(spark), pts(spark, sf_dir), MODEL, max_neighbors=1, min_neighbors=1, kind="simple")
    return rounded(out, "prediction", "variance")


#: Ordinary kriging from the 16 nearest samples of each target, each system eliminated by itself.
_LOCAL = (
    f"WITH RECURSIVE {_TN}, nb AS (SELECT * FROM n WHERE r <= 16), "
    f"k AS (SELECT a.id, a.r AS i, b.r AS j, ({_COV(DIST)})::DOUBLE AS c FROM nb a JOIN nb b USING (id) UNION ALL SELECT id, r, 17, 1.0 FROM nb UNION ALL SELECT id, 17, r, 1.0 FROM nb UNION ALL SELECT id, 17, 17, 0.0 FROM t UNION ALL SELECT id, r, 18, {_COV('d')} FROM nb UNION ALL SELECT id, 17, 18, 1.0 FROM t), "
    "m0 AS (SELECT id, list(l ORDER BY i) AS m FROM (SELECT id, i, list(c ORDER BY j) AS l FROM k GROUP BY id, i) GROUP BY id), "
    "g(id, p, m) AS (SELECT id, 1::BIGINT, m FROM m0 UNION ALL SELECT id, p+1, list_transform(m, lambda l, i: CASE WHEN i = p THEN list_transform(l, lambda c: c / l[p]) ELSE list_transform(l, lambda c, j: c - l[p]*m[p][j]/m[p][p]) END) FROM g WHERE p <= 17), "
    "w AS (SELECT id, i, m[i][18] AS w FROM (SELECT id, m, unnest(range(1, 18)) AS i FROM g WHERE p = 18)) "
    f"SELECT w.id, round(sum(w*v), 6)+0.0 AS prediction, round(greatest(0.02 - sum(w * CASE WHEN w.i = 17 THEN 1.0 ELSE {_COV('d')} END), 0), 6)+0.0 AS variance FROM w LEFT JOIN nb ON nb.id = w.id AND nb.r = w.i GROUP BY 1"
)


@query("krige_local", _LOCAL)
def _(spark, sf_dir):
    return rounded(kriging.local(grid_targets(spark), pts(spark, sf_dir), MODEL, max_neighbors=16), "prediction", "variance")


@query("idw_fallback", f"WITH {_TN} SELECT id, round(sum(v/(d+1e-10))/sum(1/(d+1e-10)), 6)+0.0 AS prediction FROM n WHERE r <= 4 GROUP BY 1")
def _(spark, sf_dir):
    return rounded(kriging.inverse_distance(grid_targets(spark), pts(spark, sf_dir), 4), "prediction")


_TILED = "b AS (SELECT min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM evt), c AS (SELECT b.*, i, j FROM b, (SELECT unnest(range(0, 40)) AS i), (SELECT unnest(range(0, 40)) AS j) WHERE i < greatest(1, ceil((x1-x0)/10.0)) AND j < greatest(1, ceil((y1-y0)/10.0)))"


@query("tiles", f"WITH {EVT}, {_TILED} SELECT i::INT AS ix, j::INT AS iy, count(*)::BIGINT AS n FROM c JOIN evt ON x BETWEEN x0 + i*10.0 - 1 AND x0 + i*10.0 + 11 AND y BETWEEN y0 + j*10.0 - 1 AND y0 + j*10.0 + 11 GROUP BY 1, 2")
def _(spark, sf_dir):
    """Events of each overlapping tile."""
    return kriging.tile_members(events(spark, sf_dir), 10.0, 0.1).groupBy("ix", "iy").agg(F.count("*").alias("n"))


@query("tile_bounds", f"WITH {EVT}, {_TILED} SELECT i::INT AS ix, j::INT AS iy, round(greatest(x0, x0 + i*10.0 - 1), 6)+0.0 AS xmin, round(greatest(y0, y0 + j*10.0 - 1), 6)+0.0 AS ymin, round(least(x1, x0 + i*10.0 + 11), 6)+0.0 AS xmax, round(least(y1, y0 + j*10.0 + 11), 6)+0.0 AS ymax FROM c")
def _(spark, sf_dir):
    """Tiles over the extent of all events."""
    b = events(spark, sf_dir).agg(F.min("x"), F.min("y"), F.max("x"), F.max("y")).first()
    return rounded(kriging.tiles(spark, tuple(b), 10.0, 0.1), "xmin", "ymin", "xmax", "ymax")


@query("krige_score", f"WITH {PTS}, q AS (SELECT 0.01*(id % 7) AS e, value + 0.01*(id % 7) AS v FROM pts) SELECT round(1 - sum(e*e)/(var_pop(v)*count(*)), 6)+0.0 AS r2 FROM q")
def _(spark, sf_dir):
    """At the samples predictions are the values, so points moved by known amounts have a known score."""
    p = pts(spark, sf_dir)
    moved = p.withColumn("value", F.col("value") + 0.01 * (F.col("id") % 7))
    return spark.createDataFrame([(kriging.ordinary(MODEL).fit(p).score(moved),)], "r2 double").select(r6("r2").alias("r2"))


@query("krige_parallel_tiles")
def _(spark, sf_dir):
    model = kriging.ordinary(MODEL).fit(pts(spark, sf_dir))
    return rounded(kriging.predict_parallel(model, kriging.grid((-0.4, -0.4), (0.4, 0.4), 60, 60, spark), True, "spatial"), "prediction", "variance")


@query("krige_anisotropic_fitted")
def _(spark, sf_dir):
    p = pts(spark, sf_dir)
    table = variogram.directional(p, [0.0, 30.0, 60.0, 90.0, 120.0, 150.0], 22.5, edges=EDGES)
    model = kriging.anisotropic_from_directional(p, table, "exponential")
    return rounded(model.fit(p).predict(grid_targets(spark), True), "prediction", "variance")


@query("graph_sparsity", f"WITH {NEAR} SELECT round(1.0 - count(*)/(SELECT count(*)*count(*) FROM pts)::DOUBLE, 6)+0.0 AS sparsity FROM near WHERE d > 0 AND d <= 0.1")
def _(spark, sf_dir):
    p = pts(spark, sf_dir)
    return spark.createDataFrame([(round(pairing.sparsity(pairing.sparse_distances(p, max_distance=0.1), p.count()), 6),)], "sparsity double")


# -- validation -------------------------------------------------------------


@query("block_folds", f"WITH {PTS}, b AS (SELECT min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM pts) SELECT id, (CASE WHEN x > (x0+x1)/2 THEN 2 ELSE 0 END + CASE WHEN y > (y0+y1)/2 THEN 1 ELSE 0 END)::INT AS fold FROM pts, b")
def _(spark, sf_dir):
    return validation.block_folds(pts(spark, sf_dir), 2, 2)


@query("block_cross_validation")
def _(spark, sf_dir):
    return rounded(validation.block_cv(pts(spark, sf_dir), (2, 2), MODEL).rows, "value", "prediction", "residual")


@query("leave_one_out")
def _(spark, sf_dir):
    return rounded(validation.leave_one_out(pts(spark, sf_dir), MODEL).rows, "value", "prediction", "residual")


@query("spatial_kfold")
def _(spark, sf_dir):
    return rounded(validation.spatial_kfold(pts(spark, sf_dir), 5, 3, MODEL).rows, "value", "prediction", "residual")


@query("standardized_residuals", f"WITH {PTS} SELECT id, round((value - avg(value) OVER ())/stddev_samp(value - m) OVER (), 6)+0.0 AS standardized FROM (SELECT *, avg(value) OVER () AS m FROM pts)")
def _(spark, sf_dir):
    p = pts(spark, sf_dir)
    mean = p.agg(F.avg("value").alias("m"))
    rows = p.crossJoin(F.broadcast(mean)).select("id", (F.col("value") - F.col("m")).alias("residual"))
    return rounded(validation.standardized_residuals(rows), "standardized").select("id", "standardized")


@query("residual_qq", f"WITH {PTS}, q AS (SELECT row_number() OVER (ORDER BY value, id) AS rank, value, (row_number() OVER (ORDER BY value, id) - 0.5)/count(*) OVER () AS p FROM pts) SELECT rank::INT AS rank, round(value, 6)+0.0 AS sample, round(p, 6)+0.0 AS probability, round({quantile_sql('p')}, 6)+0.0 AS theoretical FROM q")
def _(spark, sf_dir):
    out = plotdata.residuals_qq(pts(spark, sf_dir), "value")
    return rounded(out, "sample", "probability", "theoretical").select(F.col("rank").cast("int").alias("rank"), "sample", "probability", "theoretical")


def _density(points: DataFrame) -> tuple[float, tuple[float, float, float, float]]:
    """Points for each unit of area, and bounds, of a pattern that a simulation is to resemble."""
    b = points.agg(F.count("*"), F.min("x"), F.max("x"), F.min("y"), F.max("y")).first()
    return b[0] / ((b[2] - b[1]) * (b[4] - b[3])), tuple(b[1:])


@query("simulate_poisson")
def _(spark, sf_dir):
    """A random pattern as dense as the embeddings."""
    return source.simulate_poisson(spark, *_density(pts(spark, sf_dir)), seed=3)


@query("simulate_cox")
def _(spark, sf_dir):
    return source.simulate_cox(spark, *_density(pts(spark, sf_dir)), seed=3)[0]


@query("simulate_marked")
def _(spark, sf_dir):
    """Marks as frequent as those of the embeddings."""
    p = pts(spark, sf_dir)
    marks = p.groupBy("mark").count().orderBy("mark").collect()
    intensity, bounds = _density(p)
    return source.simulate_marked_poisson(spark, intensity, [r["mark"] for r in marks], [float(r["count"]) for r in marks], bounds, seed=3)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from fieldstats.plans import closed_forms, scale, small  # noqa: F401  register their queries

    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    from fieldstats.plans import closed_forms, scale, small  # noqa: F401

    return dict(_SQL)
