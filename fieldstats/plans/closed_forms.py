"""Queries of small whole tables whose results SQL can solve for in closed form.

The 25 rows of `nation` are samples; their kriging system is inverted in SQL by
Gauss-Jordan elimination over lists, so the twins share nothing with the operators
but the model.  Leave-one-out residuals follow from the inverse as well: they are
(inverse z) / diagonal.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldstats.functions import models, plotdata
from fieldstats.operators import kriging, pairs, validation
from fieldstats.operators.fit import Variogram
from fieldstats.plans.queries import MODEL, events, pts, query, r6, rounded

NUGGET, SILL, RANGE, MINOR, TURN = 0.25, 6.0, 0.4, 0.15, 0.6
NATIONS = Variogram("exponential", NUGGET, SILL, RANGE)
COS, SIN = 0.8253356149096783, 0.5646424733950354  # of TURN

_S = "s AS (SELECT n_nationkey::BIGINT AS id, row_number() OVER (ORDER BY n_nationkey) AS i, n_nationkey/25.0::DOUBLE AS x, ((n_nationkey*7)%25)/25.0::DOUBLE AS y, (length(n_name)+n_regionkey)::DOUBLE AS v FROM nation)"
_REGIONS = "(SELECT r_regionkey::BIGINT AS id, r_regionkey/5.0::DOUBLE + 0.03 AS x, (4 - r_regionkey)/5.0::DOUBLE + 0.01 AS y, length(r_name)::DOUBLE AS v FROM region)"


def nations(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = spark.read.parquet(f"{sf_dir}/nation.parquet")
    key = F.col("n_nationkey")
    return n.select(key.cast("long").alias("id"), (key / 25.0).alias("x"), ((key * 7) % 25 / 25.0).alias("y"), (F.length("n_name") + F.col("n_regionkey")).cast("double").alias("value"))


def regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = spark.read.parquet(f"{sf_dir}/region.parquet")
    key = F.col("r_regionkey")
    return r.select(key.cast("long").alias("id"), (key / 5.0 + 0.03).alias("x"), ((4 - key) / 5.0 + 0.01).alias("y"), F.length("r_name").cast("double").alias("value"))


def targets(spark: SparkSession, n: int = 12) -> DataFrame:
    return kriging.grid((0.0, 0.0), (1.0, 1.0), n, n, spark)


def grid_sql(n: int = 12) -> str:
    return f"(SELECT i::BIGINT AS id, (i % {n})/{n - 1}.0::DOUBLE AS x, (i // {n})/{n - 1}.0::DOUBLE AS y FROM (SELECT unnest(range(0, {n * n})) AS i))"


def system(kind: str, at: str) -> str:
    """Common table expressions: samples s, targets t, inverse inv (i, j, c), right sides r (id, i, c) and weights w (id, i, c, r)."""
    drift = {"ordinary": ["1.0"], "simple": [], "universal": ["1.0", "x", "y"], "anisotropic": ["1.0"]}[kind]
    turn = f"(x*{COS!r} - y*{SIN!r})/{RANGE} AS p, (x*{SIN!r} + y*{COS!r})/{MINOR} AS q" if kind == "anisotropic" else f"x/{RANGE} AS p, y/{RANGE} AS q"
    d = "sqrt((a.p-b.p)*(a.p-b.p)+(a.q-b.q)*(a.q-b.q))"
    cov = f"CASE WHEN a.p = b.p AND a.q = b.q THEN {SILL} ELSE {SILL - NUGGET}*exp(-{d}) END"
    borders = "".join(f" UNION ALL SELECT i, n+{k}, ({f})::DOUBLE FROM u, n UNION ALL SELECT n+{k}, i, ({f})::DOUBLE FROM u, n" for k, f in enumerate(drift, 1))
    corner = "".join(f" UNION ALL SELECT n+{k}, n+{m}, 0.0 FROM n" for k in range(1, len(drift) + 1) for m in range(1, len(drift) + 1))
    right = "".join(f" UNION ALL SELECT id, n+{k}, ({f})::DOUBLE FROM t, n" for k, f in enumerate(drift, 1))
    return (
        f"RECURSIVE {_S}, n AS (SELECT count(*)::BIGINT AS n FROM s), u AS (SELECT *, {turn} FROM s), t AS (SELECT *, {turn} FROM {at}), "
        f"k AS (SELECT a.i AS i, b.i AS j, ({cov})::DOUBLE AS c FROM u a CROSS JOIN u b{borders}{corner}), "
        f"wide AS (SELECT i, j, c FROM k UNION ALL SELECT a.i, b.i + (SELECT max(i) FROM k), (a.i = b.i)::INT::DOUBLE FROM (SELECT DISTINCT i FROM k) a CROSS JOIN (SELECT DISTINCT i FROM k) b), "
        "m0 AS (SELECT list(l ORDER BY i) AS m FROM (SELECT i, list(c ORDER BY j) AS l FROM wide GROUP BY i)), "
        "g(p, m) AS (SELECT 1::BIGINT, m FROM m0 UNION ALL SELECT p+1, list_transform(m, lambda l, i: CASE WHEN i = p THEN list_transform(l, lambda c: c / l[p]) ELSE list_transform(l, lambda c, j: c - l[p]*m[p][j]/m[p][p]) END) FROM g WHERE p <= len(m)), "
        "z AS (SELECT m, len(m) AS n FROM g WHERE p = len(m)+1), "
        "inv AS (SELECT i, j, m[i][n+j] AS c FROM (SELECT m, n, i, unnest(range(1, n+1)) AS j FROM (SELECT m, n, unnest(range(1, n+1)) AS i FROM z))), "
        f"r AS (SELECT a.id, b.i, ({cov})::DOUBLE AS c FROM t a CROSS JOIN u b{right}), "
        "w AS (SELECT r.id, inv.j AS i, sum(r.c*inv.c) AS c FROM r JOIN inv ON inv.i = r.i GROUP BY 1, 2)"
    )


def predicted(kind: str, at: str) -> str:
    mean = "(SELECT avg(v) FROM s)" if kind == "simple" else "0"
    return f"p AS (SELECT w.id, {mean} + sum(CASE WHEN s.v IS NULL THEN 0 ELSE w.c*(s.v - {mean}) END) AS prediction, greatest({SILL} - sum(w.c*r.c), 0) AS variance FROM w JOIN r ON r.id = w.id AND r.i = w.i LEFT JOIN s ON s.i = w.i GROUP BY 1)"


def krige_sql(kind: str, at: str) -> str:
    return f"WITH {system(kind, at)}, {predicted(kind, at)} SELECT id, round(prediction, 6)+0.0 AS prediction, round(variance, 6)+0.0 AS variance FROM p"


def estimator(kind: str) -> kriging.Kriging:
    if kind == "anisotropic":
        return kriging.anisotropic(NATIONS, MINOR, TURN)
    return kriging.universal(NATIONS, "linear") if kind == "universal" else kriging.Kriging(NATIONS, kind)


def _solved(kind: str):
    def run(spark, sf_dir):
        return rounded(estimator(kind).fit(nations(spark, sf_dir)).predict(targets(spark), variance=True), "prediction", "variance")

    return run


for _kind in ("ordinary", "simple", "universal", "anisotropic"):
    query(f"krige_{_kind}_solved", krige_sql(_kind, grid_sql()))(_solved(_kind))


@query("krige_local_solved", krige_sql("ordinary", grid_sql()))
def _(spark, sf_dir):
    """Local kriging whose neighbourhood is all samples."""
    return rounded(kriging.local(targets(spark), nations(spark, sf_dir), NATIONS, max_neighbors=25), "prediction", "variance")


@query("krige_tiles_solved", krige_sql("ordinary", grid_sql(40)))
def _(spark, sf_dir):
    return rounded(kriging.predict_parallel(estimator("ordinary").fit(nations(spark, sf_dir)), targets(spark, 40), True, "spatial"), "prediction", "variance")


@query("krige_batches_solved", krige_sql("ordinary", grid_sql()))
def _(spark, sf_dir):
    return rounded(estimator("ordinary").fit(nations(spark, sf_dir)).predict(targets(spark), True, batch=64), "prediction", "variance")


@query("krige_residuals", f"WITH {system('ordinary', _REGIONS)}, {predicted('ordinary', _REGIONS)} SELECT id, v AS value, round(prediction, 6)+0.0 AS prediction, round(v - prediction, 6)+0.0 AS residual FROM p JOIN t USING (id)")
def _(spark, sf_dir):
    return rounded(estimator("ordinary").fit(nations(spark, sf_dir)).residuals(regions(spark, sf_dir)), "prediction", "residual")


@query("krige_score_solved", f"WITH {system('ordinary', _REGIONS)}, {predicted('ordinary', _REGIONS)} SELECT round(1 - sum((v - prediction)*(v - prediction))/(var_pop(v)*count(*)), 6)+0.0 AS r2 FROM p JOIN t USING (id)")
def _(spark, sf_dir):
    r2 = estimator("ordinary").fit(nations(spark, sf_dir)).score(regions(spark, sf_dir))
    return spark.createDataFrame([(r2,)], "r2 double").select(r6("r2").alias("r2"))


_LOO = f"WITH {system('ordinary', grid_sql())}, a AS (SELECT inv.i, sum(inv.c*s.v) AS c FROM inv JOIN s ON s.i = inv.j GROUP BY 1), e AS (SELECT s.id, s.i, s.v, a.c/inv.c AS e FROM s JOIN a ON a.i = s.i JOIN inv ON inv.i = s.i AND inv.j = s.i)"
_fixed = lambda coords, values: NATIONS


@query("leave_one_out_solved", f"{_LOO} SELECT id, (i - 1)::INT AS fold, v AS value, round(v - e, 6)+0.0 AS prediction, round(e, 6)+0.0 AS residual FROM e")
def _(spark, sf_dir):
    return rounded(validation.leave_one_out(nations(spark, sf_dir), _fixed).rows, "prediction", "residual")


@query("kfold_solved", f"{_LOO} SELECT id, (i - 1)::INT AS fold, v AS value, round(v - e, 6)+0.0 AS prediction, round(e, 6)+0.0 AS residual FROM e")
def _(spark, sf_dir):
    """As many folds as points: each is a fold of its own."""
    return rounded(validation.spatial_kfold(nations(spark, sf_dir), 25, 3, _fixed).rows, "prediction", "residual")


@query("cross_validation_summary", f"{_LOO} SELECT round(sqrt(avg(e*e)), 6)+0.0 AS rmse, round(1 - sum(e*e)/(var_pop(v)*count(*)), 6)+0.0 AS r2 FROM e")
def _(spark, sf_dir):
    found = validation.leave_one_out(nations(spark, sf_dir), _fixed).summary()
    return rounded(spark.createDataFrame([(found["rmse"], found["r2"])], "rmse double, r2 double"), "rmse", "r2")


def curve(spark: SparkSession, sf_dir: str, model: str) -> DataFrame:
    """A lag table that lies on a model with nugget 0.1, sill 1.3 and range 0.35."""
    n = spark.read.parquet(f"{sf_dir}/nation.parquet")
    lag = (F.col("n_nationkey") + 1) / 25.0
    return n.select(lag.alias("lag"), models.semivariance(lag, model, 0.1, 1.3, 0.35).alias("gamma"), F.lit(10).cast("long").alias("count"))


@query("variogram_fit_exact", "SELECT * FROM (VALUES ('exponential', 0.1::DOUBLE, 1.3::DOUBLE, 0.35::DOUBLE), ('gaussian', 0.1, 1.3, 0.35), ('spherical', 0.1, 1.3, 0.35)) AS v(model, nugget, sill, range)")
def _(spark, sf_dir):
    found = [(m, Variogram(m).fit(curve(spark, sf_dir, m))) for m in models.MODELS]
    return spark.createDataFrame([(m, round(v.nugget, 4), round(v.sill, 4), round(v.range, 4)) for m, v in found], "model string, nugget double, sill double, range double")


@query("variogram_fit_fixed", "SELECT * FROM (VALUES ('nugget', 0.1::DOUBLE, 1.3::DOUBLE, 0.35::DOUBLE), ('sill', 0.1, 1.3, 0.35), ('range', 0.1, 1.3, 0.35)) AS v(held, nugget, sill, range)")
def _(spark, sf_dir):
    """One parameter held at its value, the others found."""
    table = curve(spark, sf_dir, "spherical")
    found = [(k, Variogram("spherical").fit(table, {k: x})) for k, x in (("nugget", 0.1), ("sill", 1.3), ("range", 0.35))]
    return spark.createDataFrame([(k, round(v.nugget, 4), round(v.sill, 4), round(v.range, 4)) for k, v in found], "held string, nugget double, sill double, range double")


_EVT = "evt AS (SELECT event_id::BIGINT AS id, (epoch_us(ts)/1000000.0 - 1704067200.0)/86400.0 AS x, value/16.0 AS y FROM events)"


@query("tile_of", f"WITH {_EVT}, b AS (SELECT min(x) AS x0, min(y) AS y0, sqrt((max(x)-min(x))*(max(y)-min(y))/greatest(1.0, count(*)/100.0)) AS side FROM evt) SELECT floor((x-x0)/side)::INT AS tx, floor((y-y0)/side)::INT AS ty, count(*)::BIGINT AS n FROM evt, b GROUP BY 1, 2")
def _(spark, sf_dir):
    return kriging.tile_of(events(spark, sf_dir), 100).groupBy("tx", "ty").agg(F.count("*").alias("n"))


@query("memory_estimate", "SELECT round((8.0*(count(*)+1)*(count(*)+1)/1000000)::DOUBLE, 6)+0.0 AS system_mb, round((8.0*8192*count(*)/1000000)::DOUBLE, 6)+0.0 AS batch_mb, 0.16::DOUBLE AS result_mb FROM nation")
def _(spark, sf_dir):
    found = kriging.memory_estimate(nations(spark, sf_dir).count(), 10_000)
    return rounded(spark.createDataFrame([tuple(found.values())], ", ".join(f"{k} double" for k in found)), *found)


@query("anisotropy_ellipse", f"WITH {_S}, c AS (SELECT avg(x) AS cx, avg(y) AS cy FROM s) SELECT i::INT AS i, round(cx + 2*3.0*cos(2*pi()*i/99)*{COS!r} - 2*1.0*sin(2*pi()*i/99)*{SIN!r}, 6)+0.0 AS x, round(cy + 2*3.0*cos(2*pi()*i/99)*{SIN!r} + 2*1.0*sin(2*pi()*i/99)*{COS!r}, 6)+0.0 AS y FROM (SELECT unnest(range(0, 100)) AS i), c")
def _(spark, sf_dir):
    """An ellipse round the centre of the samples."""
    centre = nations(spark, sf_dir).agg(F.avg("x"), F.avg("y")).first()
    return rounded(plotdata.ellipse(spark, 3.0, 1.0, TURN, tuple(centre), 2.0), "x", "y")


@query("plot_variogram", "SELECT round((n_nationkey+1)/25.0, 6)+0.0 AS lag, 10::BIGINT AS count, round(0.1+1.2*(1-exp(-((n_nationkey+1)/25.0)/0.35)), 6)+0.0 AS gamma, round(0.001+0.019*(1-exp(-((n_nationkey+1)/25.0)/0.15)), 6)+0.0 AS model FROM nation")
def _(spark, sf_dir):
    return rounded(plotdata.variogram(curve(spark, sf_dir, "exponential"), MODEL), "lag", "gamma", "model")


@query("correlogram", "SELECT round((n_nationkey+1)/25.0, 6)+0.0 AS lag, round(1-(0.1+1.2*(1-exp(-((n_nationkey+1)/25.0)/0.35)))/1.3, 6)+0.0 AS correlation FROM nation")
def _(spark, sf_dir):
    return rounded(plotdata.correlogram(curve(spark, sf_dir, "exponential"), 1.3), "lag", "correlation")


@query("prediction_comparison", f"WITH {system('ordinary', _REGIONS)}, {predicted('ordinary', _REGIONS)} SELECT id, v AS observed, round(prediction, 6)+0.0 AS predicted FROM p JOIN t USING (id)")
def _(spark, sf_dir):
    return rounded(plotdata.comparison(estimator("ordinary").fit(nations(spark, sf_dir)).residuals(regions(spark, sf_dir))), "predicted")


_SURFACE = f"WITH {system('ordinary', grid_sql())}, {predicted('ordinary', grid_sql())} SELECT id, (id % 12)::INT AS ix, (id // 12)::INT AS iy, round(x, 6)+0.0 AS x, round(y, 6)+0.0 AS y, round({{0}}, 6)+0.0 AS {{0}} FROM p JOIN t USING (id)"


def _surface(column: str):
    def run(spark, sf_dir):
        out = estimator("ordinary").fit(nations(spark, sf_dir)).predict(targets(spark), True)
        return rounded(plotdata.surface(out, targets(spark), column), "x", "y", column)

    return run


for _name, _column in (("plot_kriging", "prediction"), ("plot_uncertainty", "variance")):
    query(_name, _SURFACE.format(_column))(_surface(_column))


@query("kriging_cross_section", f"WITH {system('ordinary', _REGIONS)}, {predicted('ordinary', _REGIONS)} SELECT id, round(x, 6)+0.0 AS x, round(y, 6)+0.0 AS y, round(coalesce(sum(st) OVER (ORDER BY id), 0), 6)+0.0 AS along, round(prediction, 6)+0.0 AS prediction FROM (SELECT id, x, y, prediction, sqrt((x - lag(x) OVER (ORDER BY id))*(x - lag(x) OVER (ORDER BY id)) + (y - lag(y) OVER (ORDER BY id))*(y - lag(y) OVER (ORDER BY id))) AS st FROM p JOIN t USING (id))")
def _(spark, sf_dir):
    line = regions(spark, sf_dir).drop("value")
    out = plotdata.cross_section(estimator("ordinary").fit(nations(spark, sf_dir)).predict(line), line)
    return rounded(out, "x", "y", "along", "prediction").select("id", "x", "y", "along", "prediction")


@query("valid_neighbors", f"WITH {_S} SELECT b.id AS neighbor_id, row_number() OVER (ORDER BY sqrt((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)), b.id)::INT AS rank FROM s a JOIN s b ON a.id = 7 AND b.id <> 7 QUALIFY rank <= 5")
def _(spark, sf_dir):
    n = nations(spark, sf_dir)
    found = pairs.valid_neighbors(pairs.knn_join(n, n, 5, same=True), 7)
    return found.select("neighbor_id", F.col("rank").cast("int").alias("rank"))
