"""Queries of the operators that work without a driver loop or an all-pairs join: large solves, folds from one factorisation, ranks, extents."""

from __future__ import annotations

import uuid
from dataclasses import replace

import numpy as np
from pyspark.sql import functions as F

from fieldstats.functions import models
from fieldstats.operators import anisotropy, extent, validation, variogram
from fieldstats.operators.fit import fit_anisotropic
from fieldstats.plans.closed_forms import _S, MINOR, NATIONS, NUGGET, RANGE, SILL, TURN, estimator, grid_sql, krige_sql, nations, targets
from fieldstats.plans.queries import _BIN, _BINS, _SQL, DIST, EDGES, EVT, MODEL, PAIRS, PTS, events, kriging, pts, quantile_sql, query, r6, rounded
from fieldstats.session import shared_folder
from fieldstats.sources import points as source
from fieldstats.streaming import accumulator


def _iterative(kind: str):
    def run(spark, sf_dir):
        model = replace(estimator(kind), solver="iterative")
        return rounded(model.fit(nations(spark, sf_dir)).predict(targets(spark), variance=True), "prediction", "variance")

    return run


for _kind in ("ordinary", "universal", "anisotropic"):
    query(f"krige_iterative_{_kind}", krige_sql(_kind, grid_sql()))(_iterative(_kind))


@query("krige_iterative_exact", f"WITH {PTS} SELECT id, round(value, 6)+0.0 AS prediction FROM pts")
def _(spark, sf_dir):
    """A system of all embeddings solved by conjugate gradients gives each sample its own value."""
    p = pts(spark, sf_dir)
    return rounded(replace(kriging.ordinary(MODEL), solver="iterative").fit(p).predict(p), "prediction")


def fold_sql(labels: str) -> str:
    """Ordinary kriging of each fold from a system of all other samples, each eliminated by itself; `labels` makes lab (id, fold)."""
    cov = lambda a, b: f"CASE WHEN {a}.x = {b}.x AND {a}.y = {b}.y THEN {SILL} ELSE {SILL - NUGGET}*exp(-sqrt(({a}.x-{b}.x)*({a}.x-{b}.x)+({a}.y-{b}.y)*({a}.y-{b}.y))/{RANGE}) END"
    return (
        f"WITH RECURSIVE {_S}, {labels}, tr AS (SELECT f.fold, s.*, row_number() OVER (PARTITION BY f.fold ORDER BY s.i) AS r FROM (SELECT DISTINCT fold FROM lab) f, s WHERE NOT EXISTS (SELECT 1 FROM lab l WHERE l.fold = f.fold AND l.id = s.id)), "
        "n AS (SELECT fold, count(*) AS n FROM tr GROUP BY 1), "
        f"k AS (SELECT a.fold, a.r AS i, b.r AS j, ({cov('a', 'b')})::DOUBLE AS c FROM tr a JOIN tr b USING (fold) UNION ALL SELECT fold, r, n+1, 1.0 FROM tr JOIN n USING (fold) UNION ALL SELECT fold, n+1, r, 1.0 FROM tr JOIN n USING (fold) "
        "UNION ALL SELECT fold, n+1, n+1, 0.0 FROM n UNION ALL SELECT fold, r, n+2, v FROM tr JOIN n USING (fold) UNION ALL SELECT fold, n+1, n+2, 0.0 FROM n), "
        "m0 AS (SELECT fold, list(l ORDER BY i) AS m FROM (SELECT fold, i, list(c ORDER BY j) AS l FROM k GROUP BY fold, i) GROUP BY fold), "
        "g(fold, p, m) AS (SELECT fold, 1::BIGINT, m FROM m0 UNION ALL SELECT fold, p+1, list_transform(m, lambda l, i: CASE WHEN i = p THEN list_transform(l, lambda c: c / l[p]) ELSE list_transform(l, lambda c, j: c - l[p]*m[p][j]/m[p][p]) END) FROM g WHERE p <= len(m)), "
        "w AS (SELECT fold, i, m[i][len(m)+1] AS w, i = len(m) AS mu FROM (SELECT fold, m, unnest(range(1, len(m)+1)) AS i FROM g WHERE p = len(m)+1)), "
        f"pr AS (SELECT l.fold, t.id, any_value(t.v) AS v, sum(w.w * CASE WHEN w.mu THEN 1.0 ELSE ({cov('t', 'tr')}) END) AS prediction FROM lab l JOIN s t ON t.id = l.id JOIN w ON w.fold = l.fold LEFT JOIN tr ON tr.fold = w.fold AND tr.r = w.i GROUP BY 1, 2) "
        "SELECT id, fold::INT AS fold, v AS value, round(prediction, 6)+0.0 AS prediction, round(v - prediction, 6)+0.0 AS residual FROM pr QUALIFY fold = max(fold) OVER (PARTITION BY id)"
    )


def means_sql(source: str, k: int, seed: int, steps: int) -> str:
    """k-means of `source` (id, x, y) from one start, step by step, as lab (id, fold)."""
    draw = lambda step: f"-ln((('0x' || substr(md5('{seed}:0:{step}:' || id), 1, 13))::BIGINT + 0.5)/{1 << 52})"
    out = [f"c1 AS MATERIALIZED (SELECT 0 AS c, x, y FROM {source} ORDER BY {draw(0)}, id LIMIT 1)"]
    for step in range(1, k):
        near = f"(SELECT id, p.x, p.y, min((p.x-q.x)*(p.x-q.x)+(p.y-q.y)*(p.y-q.y)) AS d FROM {source} p, c{step} q GROUP BY ALL)"
        out.append(f"c{step + 1} AS MATERIALIZED (SELECT * FROM c{step} UNION ALL (SELECT {step}, x, y FROM {near} WHERE d > 0 ORDER BY {draw(step)}/d, id LIMIT 1))")
    last = f"c{k}"
    nearest = lambda centres: f"(SELECT id, x, y, arg_min(c, (d, c)) AS c FROM (SELECT id, p.x, p.y, c, (p.x-q.x)*(p.x-q.x)+(p.y-q.y)*(p.y-q.y) AS d FROM {source} p, {centres} q) GROUP BY ALL)"
    for step in range(steps):
        out.append(f"lloyd{step} AS MATERIALIZED (SELECT q.c, coalesce(n.x, q.x) AS x, coalesce(n.y, q.y) AS y FROM {last} q LEFT JOIN (SELECT c, avg(x) AS x, avg(y) AS y FROM {nearest(last)} GROUP BY 1) n ON n.c = q.c)")
        last = f"lloyd{step}"
    return ", ".join(out) + f", lab AS MATERIALIZED (SELECT id, c AS fold FROM {nearest(last)})"


@query("kmeans_folds", f"WITH {PTS}, {means_sql('pts', 5, 3, 60)} SELECT id, fold::INT AS fold FROM lab")
def _(spark, sf_dir):
    """One start and, as the twin states, 60 Lloyd steps; large sets may take more of them until nothing moves."""
    return validation.spatial_folds(pts(spark, sf_dir), 5, 3, starts=1, most=60)


@query("kfold_clusters_solved", fold_sql(means_sql("s", 4, 5, 12)))
def _(spark, sf_dir):
    """Folds of one k-means start, all from one factorisation."""
    n = nations(spark, sf_dir)
    folds = validation.spatial_folds(n, 4, 5, starts=1)
    return rounded(validation.cross_validate(n, folds, NATIONS).rows, "prediction", "residual")


_BLOCKS = "b AS (SELECT min(x) AS x0, (max(x)-min(x))/2 AS w, min(y) AS y0, (max(y)-min(y))/2 AS h FROM s), lab AS (SELECT id, bi*2+bj AS fold FROM s, b, (SELECT unnest([0, 1]) AS bi), (SELECT unnest([0, 1]) AS bj) WHERE x BETWEEN x0+bi*w AND x0+(bi+1)*w AND y BETWEEN y0+bj*h AND y0+(bj+1)*h)"


@query("block_cv_solved", fold_sql(_BLOCKS))
def _(spark, sf_dir):
    """Closed blocks: points on a shared edge are left out of several folds and keep the last."""
    return rounded(validation.block_cv(nations(spark, sf_dir), (2, 2), NATIONS).rows, "prediction", "residual")


@query("largest_distance", f"WITH {EVT}, pts AS (SELECT * FROM evt) SELECT round(max({DIST}), 6)+0.0 AS d FROM pts a, pts b")
def _(spark, sf_dir):
    found = extent.largest_distance(events(spark, sf_dir))
    return spark.createDataFrame([(found,)], "d double").select(r6("d").alias("d"))


_W = (
    f"WITH {PTS}, o AS (SELECT value AS x, row_number() OVER (ORDER BY value, id) AS r, count(*) OVER () AS n FROM pts), m AS (SELECT *, {quantile_sql('((r-0.375)/(n+0.25))')} AS m FROM o), "
    "t AS (SELECT any_value(n)::DOUBLE AS n, sum(m*m) AS mm, var_pop(x)*count(*) AS ss, max(m) AS m1, max(m) FILTER (r = n - 1) AS m2, max(x)-min(x) AS d1, max(x) FILTER (r = n - 1) - max(x) FILTER (r = 2) AS d2, sum(m*x) FILTER (r BETWEEN 3 AND n - 2) AS mx FROM m), "
    "a AS (SELECT *, 1/sqrt(n) AS u FROM t), b AS (SELECT *, m1/sqrt(mm)+0.221157*u-0.147981*u^2-2.071190*u^3+4.434685*u^4-2.706056*u^5 AS a1, m2/sqrt(mm)+0.042981*u-0.293762*u^2-1.752461*u^3+5.682633*u^4-3.582633*u^5 AS a2 FROM a), "
    "w AS (SELECT n, (a1*d1 + a2*d2 + mx/sqrt((mm-2*m1*m1-2*m2*m2)/(1-2*a1*a1-2*a2*a2)))^2/ss AS w FROM b) "
)
#: The p-value of twelve values or more, as Simpson's sum over the upper tail of the normal density.
_P = (
    "z AS (SELECT w, (ln(1-w) - (-1.5861-0.31082*ln(n)-0.083751*ln(n)^2+0.0038915*ln(n)^3))/exp(-0.4803-0.082676*ln(n)+0.0030302*ln(n)^2) AS z FROM w), "
    "f AS (SELECT w, CASE WHEN i IN (0, 20000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END * exp(-0.5*(z+i/1000.0)^2) AS f FROM z, (SELECT unnest(range(0, 20001)) AS i)) "
    "SELECT round(any_value(w), 6)+0.0 AS statistic, round(sum(f)/3000/sqrt(2*pi()), 6)+0.0 AS p_value FROM f"
)


@query("shapiro_wilk", f"{_W}SELECT round(w, 6)+0.0 AS w FROM w")
def _(spark, sf_dir):
    w, _ = validation.shapiro_wilk_of(pts(spark, sf_dir))
    return spark.createDataFrame([(w,)], "w double").select(r6("w").alias("w"))


@query("normality", f"{_W.removesuffix(' ')}, {_P}")
def _(spark, sf_dir):
    found = validation.normality(pts(spark, sf_dir), "value")
    return rounded(spark.createDataFrame([tuple(found.values())], "statistic double, p_value double"), "statistic", "p_value")


def raw_folder(spark, name: str) -> str:
    """A new folder for raw files in the folder that driver and executors share."""
    return f"{shared_folder(spark).removeprefix('file://')}/{name}-{uuid.uuid4().hex[:12]}"


@query("raw_array_round_trip", f"WITH {EVT} SELECT row_number() OVER (ORDER BY id) - 1 AS id, round(x, 6)+0.0 AS c0, round(y, 6)+0.0 AS c1 FROM evt")
def _(spark, sf_dir):
    """Coordinates of all events through raw files, in tasks of 700 rows."""
    path = raw_folder(spark, "events")
    source.write_raw_array(events(spark, sf_dir), ["x", "y"], path)
    return rounded(source.read_raw_array(spark, path, 2, rows_per_slice=700), "c0", "c1")


@query("variogram_memmap", _SQL["variogram_streaming"])
def _(spark, sf_dir):
    p, folder = pts(spark, sf_dir), raw_folder(spark, "pts")
    source.write_raw_array(p, ["x", "y"], f"{folder}/coords")
    source.write_raw_array(p, ["value"], f"{folder}/values")
    out = accumulator.streaming_variogram_memmap(spark, f"{folder}/coords", f"{folder}/values", EDGES, rows_per_slice=150)
    return rounded(out, "lag", "gamma")


_DRAWN = f"""WITH {PTS}, r AS (SELECT *, row_number() OVER (ORDER BY id) - 1 AS i, count(*) OVER () AS n FROM pts),
f AS (SELECT i, sum(n - 1 - i) OVER (ORDER BY i) - (n - 1 - i) AS before, n FROM r),
t AS (SELECT k, ('0x' || substr(md5('4:' || k), 1, 15))::BIGINT % (SELECT any_value(n*(n-1)//2) FROM r) AS t FROM (SELECT unnest(range(0, 3000)) AS k)),
u AS (SELECT k, f.i, t - f.before + f.i + 1 AS j FROM t ASOF JOIN f ON t.t >= f.before),
p AS (SELECT {DIST} AS d, 0.5*(a.value-b.value)*(a.value-b.value) AS g FROM u JOIN r a ON a.i = u.i JOIN r b ON b.i = u.j)"""


@query("variogram_sampled_pairs", f"{_DRAWN}, {_BINS} SELECT b.bin, round(any_value(lag), 6)+0.0 AS lag, round(coalesce(avg(g), 0), 6)+0.0 AS gamma, count(g)::BIGINT AS count FROM bins b LEFT JOIN (SELECT ({_BIN})::INT AS bin, g FROM p WHERE d < {EDGES[-1]!r}) USING (bin) GROUP BY b.bin")
def _(spark, sf_dir):
    return rounded(variogram.sampled_variogram(pts(spark, sf_dir), 3_000, EDGES, 4), "lag", "gamma")


_SIX = [30.0 * i for i in range(6)]
_COS = float(np.cos(np.radians(22.5)))
#: Directional ranges at a share of the sill, and the ellipses through them every half degree.
_ELLIPSE = """{lags}, mt AS (SELECT *, max(gamma) OVER ({over}) AS sill FROM m), rg AS (SELECT angle, coalesce(min(CASE WHEN gamma >= {share}*sill THEN lag END), max(lag)) AS r, max(sill) AS sill FROM mt GROUP BY 1),
tr AS (SELECT phi, r, cos(radians(angle - phi))^2 AS c, sin(radians(angle - phi))^2 AS s, 1/(r*r) AS f FROM rg, (SELECT unnest(range(0, 360))*0.5 AS phi)),
ne AS (SELECT phi, sum(c*c) AS cc, sum(c*s) AS cs, sum(s*s) AS ss, sum(c*f) AS cf, sum(s*f) AS sf FROM tr GROUP BY 1),
ab AS (SELECT phi, (ss*cf - cs*sf)/(cc*ss - cs*cs) AS a, (cc*sf - cs*cf)/(cc*ss - cs*cs) AS b FROM ne),
el AS (SELECT phi, any_value(a) AS a, any_value(b) AS b, sum((1/sqrt(a*c + b*s) - r)^2) AS sse FROM tr JOIN ab USING (phi) WHERE a > 0 AND b > 0 GROUP BY 1),
be AS (SELECT CASE WHEN a <= b THEN phi ELSE (phi + 90) % 180 END AS axis, 1/sqrt(least(a, b)) AS major, 1/sqrt(greatest(a, b)) AS minor, sse FROM el ORDER BY round(sse, 9), 1 LIMIT 1)"""
_MEASURED = f"{PAIRS}, {_BINS}, axes AS (SELECT unnest({_SIX})::DOUBLE AS angle), m AS (SELECT angle, bin, lag, avg(g) AS gamma FROM (SELECT angle, ({_BIN})::INT AS bin, g FROM pairs, axes WHERE d > 0 AND d < {EDGES[-1]!r} AND abs(dx*cos(radians(angle)) + dy*sin(radians(angle))) >= {_COS!r} * d) JOIN bins USING (bin) GROUP BY 1, 2, 3)"
#: A directional table on an ellipse of ranges 0.3 and 0.1, its axis at 40 degrees; lags from the rows of nation.
_EXACT = f"{PTS}, m AS (SELECT angle, n_nationkey AS bin, lag, 0.05 + 0.95*(1 - exp(-lag*sqrt((cos(radians(angle - 40))/0.3)^2 + (sin(radians(angle - 40))/0.1)^2))) AS gamma FROM (SELECT n_nationkey, (n_nationkey + 1)/25.0::DOUBLE AS lag FROM nation), (SELECT unnest(range(0, 12))*15.0::DOUBLE AS angle))"
_ellipse = lambda lags, share, over: _ELLIPSE.format(lags=lags, share=share, over=over)


def exact_directions(spark, sf_dir):
    lags = spark.read.parquet(f"{sf_dir}/nation.parquet").select(F.col("n_nationkey").alias("bin"), ((F.col("n_nationkey") + 1) / 25.0).alias("lag"))
    turn = F.radians(F.col("angle") - 40)
    h = F.col("lag") * F.sqrt((F.cos(turn) / 0.3) ** 2 + (F.sin(turn) / 0.1) ** 2)
    table = lags.crossJoin(F.broadcast(spark.range(12).select((F.col("id") * 15.0).alias("angle"))))
    return table.select("angle", "bin", "lag", models.semivariance(h, "exponential", 0.05, 1.0, 1.0).alias("gamma"), F.lit(10).cast("long").alias("count"))


def _six_directions(spark, sf_dir):
    return variogram.directional(pts(spark, sf_dir), _SIX, 22.5, edges=EDGES)


@query("anisotropy_detection", f"WITH {_ellipse(_MEASURED, 0.95, '')} SELECT major/minor >= 1.2 AS is_anisotropic, round(axis::DOUBLE, 6)+0.0 AS major, round(((axis + 90) % 180)::DOUBLE, 6)+0.0 AS minor, round(major/minor, 6)+0.0 AS ratio, round((SELECT max(sill) FROM rg), 6)+0.0 AS sill FROM be")
def _(spark, sf_dir):
    found = anisotropy.detect(_six_directions(spark, sf_dir))
    row = (found.is_anisotropic, found.major_direction, found.minor_direction, found.ratio, found.sill)
    return rounded(spark.createDataFrame([row], "is_anisotropic boolean, major double, minor double, ratio double, sill double"), "major", "minor", "ratio", "sill")


@query("axis_fits", f"WITH {_ellipse(_EXACT, 0.9, 'PARTITION BY angle')} SELECT phi::DOUBLE AS axis, round((CASE WHEN a <= b THEN phi ELSE (phi + 90) % 180 END)::DOUBLE, 6)+0.0 AS major_axis, round(1/sqrt(least(a, b)), 6)+0.0 AS major, round(1/sqrt(greatest(a, b)), 6)+0.0 AS minor, round(sse, 6)+0.0 AS sse FROM el WHERE phi % 15 = 0")
def _(spark, sf_dir):
    ranges = variogram.direction_ranges(exact_directions(spark, sf_dir), 0.9, own_sill=True)
    return rounded(anisotropy.axis_fits(ranges), "major_axis", "major", "minor", "sse")


_AGREED = (
    "st AS (SELECT max(r) AS hi, min(r) AS lo, stddev_samp(r)/sqrt(count(*)) AS se, stddev_samp(r) AS sd, stddev_pop(r)/avg(r) AS v FROM rg), pc AS (SELECT var_samp(x) AS xx, var_samp(y) AS yy, covar_samp(x, y) AS xy FROM pts), "
    "pe AS (SELECT degrees(0.5*atan2(2*xy, xx-yy)) AS t, ((xx+yy)/2 + sqrt(((xx-yy)/2)^2 + xy*xy))/((xx+yy)/2 - sqrt(((xx-yy)/2)^2 + xy*xy)) AS long FROM pc), "
    "lg AS (SELECT angle FROM rg WHERE sill > 0 ORDER BY r DESC, angle LIMIT 1), "
    "ge AS (SELECT long, degrees(atan2(sin(radians(2*t)) + sin(radians(2*angle)), cos(radians(2*t)) + cos(radians(2*angle))))/2 AS p, hi/lo AS ratio, CASE WHEN hi/lo >= 3 THEN 'strong' WHEN hi/lo >= 2 THEN 'moderate' WHEN hi/lo < 1.5 OR v <= 0.1 THEN 'isotropic' ELSE 'weak' END AS strength, hi/lo/(1+se) AS rq, hi > lo AND (hi-lo)/(sd+1e-12) > 1.5 AS sure FROM pe, lg, st), "
    "co AS (SELECT ge.*, be.axis, CASE WHEN major/minor > 1.5 AND sure THEN 'high' WHEN major/minor > 1.2 AND sure THEN 'medium' ELSE 'low' END AS confidence FROM ge, be), "
    "sc AS (SELECT *, CASE confidence WHEN 'high' THEN 2.0 WHEN 'medium' THEN 1.2 ELSE 0.7 END AS w1, CASE strength WHEN 'strong' THEN 2.0 WHEN 'moderate' THEN 1.3 WHEN 'weak' THEN 0.8 ELSE 0.4 END AS w2, "
    "CASE confidence WHEN 'high' THEN 1.0 WHEN 'medium' THEN 0.7 ELSE 0.4 END AS q1, CASE strength WHEN 'strong' THEN 1.0 WHEN 'moderate' THEN 0.8 WHEN 'weak' THEN 0.6 ELSE 0.3 END AS q2 FROM co), "
    "ev AS (SELECT axis AS angle, w1 AS w, 0 AS o FROM sc UNION ALL SELECT (p + 180) % 180, w2, 1 FROM sc UNION ALL SELECT (p + 180) % 180, greatest(0.5, long), 2 FROM sc), "
    "bl AS (SELECT (degrees(atan2(sum(w*sin(radians(2*angle))), sum(w*cos(radians(2*angle)))))/2 + 180) % 180 AS b FROM ev), "
    "vo AS (SELECT s FROM (SELECT round_even(angle/15, 0)*15 % 180 AS s, count(*) AS n, min(o) AS o FROM ev GROUP BY 1), bl ORDER BY n DESC, abs(s - b), o LIMIT 1), "
    "nd AS (SELECT min(sqrt((a.x-b.x)^2 + (a.y-b.y)^2)) AS d FROM (SELECT DISTINCT x, y FROM pts) a JOIN (SELECT DISTINCT x, y FROM pts) b ON a.x <> b.x OR a.y <> b.y GROUP BY a.x, a.y) "
    "SELECT round((degrees(atan2(0.6*sin(radians(2*b)) + 0.4*sin(radians(2*s)), 0.6*cos(radians(2*b)) + 0.4*cos(radians(2*s))))/2 + 180) % 180, 6)+0.0 AS angle, confidence, round(0.4*q1 + 0.3*q2 + 0.3*rq, 6)+0.0 AS quality, strength, "
    "(SELECT CASE WHEN stddev_pop(d)/avg(d) < 0.15 THEN 'regular' WHEN stddev_pop(d)/avg(d) < 0.35 THEN 'quasi-regular' ELSE 'irregular' END FROM nd) AS pattern FROM sc, bl, vo"
)


@query("anisotropy_ensemble", f"WITH {_ellipse(_EXACT, 0.9, 'PARTITION BY angle')}, {_AGREED}")
def _(spark, sf_dir):
    found = anisotropy.ensemble(pts(spark, sf_dir), exact_directions(spark, sf_dir))
    row = (found.angle_deg, found.confidence, found.quality, found.geometry.strength, found.geometry.pattern)
    return rounded(spark.createDataFrame([row], "angle double, confidence string, quality double, strength string, pattern string"), "angle", "quality")


@query("variogram_stream_cells", _SQL["variogram_streaming"])
def _(spark, sf_dir):
    """All embeddings as a stream of files, three a batch, their pairs met through the state of grid cells."""
    folder = raw_folder(spark, "stream")
    p = pts(spark, sf_dir).select("id", "x", "y", "value")
    p.repartition(9, "id").write.parquet(f"{folder}/points")
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        stream = spark.readStream.schema(p.schema).option("maxFilesPerTrigger", 3).parquet(f"{folder}/points")
        accumulator.accumulate_cells(stream, EDGES, f"{folder}/state", f"{folder}/checkpoint", salts=2).awaitTermination()
    finally:
        spark.conf.set(name, before) if before else spark.conf.unset(name)
    return rounded(accumulator.stored(spark, f"{folder}/state", EDGES).finalize(), "lag", "gamma")


def exact_table(spark, sf_dir, angle: float):
    """Lags of nation in twelve directions on the anisotropic model of closed_forms, the axis `angle` radians counter-clockwise."""
    lags = spark.read.parquet(f"{sf_dir}/nation.parquet").select(F.col("n_nationkey").alias("bin"), ((F.col("n_nationkey") + 1) / 25.0).alias("lag"))
    table = lags.crossJoin(F.broadcast(spark.range(12).select((F.col("id") * 15.0).alias("angle"))))
    turn = F.radians("angle") - angle
    h = F.col("lag") * F.sqrt((F.cos(turn) / RANGE) ** 2 + (F.sin(turn) / MINOR) ** 2)
    return table.select("angle", "bin", "lag", models.semivariance(h, "exponential", NUGGET, SILL, 1.0).alias("gamma"), F.lit(10).cast("long").alias("count"))


@query("variogram_fit_anisotropic", f"SELECT {NUGGET}::DOUBLE AS nugget, {SILL}::DOUBLE AS sill, {RANGE}::DOUBLE AS major, {MINOR}::DOUBLE AS minor, round((pi() - {TURN})::DOUBLE, 4)+0.0 AS angle, count(*)*12 AS rows, 'succeeded' AS status, 0.0::DOUBLE AS sse FROM nation")
def _(spark, sf_dir):
    """Five parameters from a table that lies on the model, from the ensemble's start; the axis is clockwise, so the table has it at pi - TURN."""
    table = exact_table(spark, sf_dir, -TURN)
    rows = table.toPandas()
    found = fit_anisotropic(rows["lag"], rows["gamma"], rows["angle"], "exponential", (0.1, 5.0, 0.3, 0.2, 2.0), rows["count"].to_numpy(float), degrees=True)
    row = (*(round(x, 4) for x in found.parameters), len(rows), found.status, round(found.diagnostics["sse"], 4))
    return spark.createDataFrame([row], "nugget double, sill double, major double, minor double, angle double, rows long, status string, sse double")


@query("krige_anisotropic_from_table", krige_sql("anisotropic", grid_sql()).replace(", 6)+0.0", ", 3)+0.0"))
def _(spark, sf_dir):
    """Directional table to fit to kriging in one chain; the twin solves with the parameters that the table was made of."""
    n = nations(spark, sf_dir)
    model = kriging.anisotropic_from_directional(n, exact_table(spark, sf_dir, -TURN), "exponential")
    out = model.fit(n).predict(targets(spark), variance=True)
    return out.select("id", *[(F.round(c, 3) + F.lit(0.0)).alias(c) for c in ("prediction", "variance")])
