"""Operators without a driver loop, against plain versions: large solves, folds, ranks, permutations, extents."""

import hashlib
from statistics import NormalDist

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldstats.operators import autocorr, conjugate, extent, kriging, ranks, validation
from fieldstats.operators.fit import Variogram


def sample(n, seed, d=2):
    rng = np.random.default_rng(seed)
    c = rng.uniform(size=(n, d))
    return c, np.sin(5 * c[:, 0]) + c[:, 1] ** 2 + 0.1 * rng.normal(size=n)


@pytest.mark.parametrize("model", ["exponential", "spherical", "gaussian"])
def test_conjugate_gradients_equal_the_dense_solve(spark, monkeypatch, model):
    monkeypatch.setattr(conjugate, "BLOCK", 100)
    monkeypatch.setattr(conjugate, "TILE", 70)
    c, v = sample(700, 1)
    operator = conjugate.Covariance(spark, c, Variogram(model, 0.05, 1.1, 0.2))
    right = np.column_stack([v, np.ones(len(c))])
    dense = kriging.models.cov(kriging.models.distances(c, c), model, 0.05, 1.1, 0.2)
    found = operator.solve(right)
    assert np.abs(dense @ found - right).max() < 1e-8
    assert operator.steps < 40
    with pytest.raises(ValueError, match="not solved"):
        operator.solve(right, 1e-14, most=1)
    operator.close()


@pytest.mark.parametrize("kind", ["ordinary", "simple", "universal", "anisotropic"])
def test_iterative_kriging_equals_dense(spark, make_points, kind):
    c, v = sample(300, 2)
    shape = {"anisotropic": {"range_minor": 0.1, "angle": 0.4}, "universal": {"trend": "quadratic"}}.get(kind, {})
    targets = make_points(sample(90, 3)[0])
    got = [kriging.Kriging(Variogram("spherical", 0.02, 0.8, 0.3), kind, solver=s, **shape).fit(make_points(c, v)).predict(targets, variance=True).orderBy("id").toPandas() for s in ("dense", "iterative")]
    assert np.allclose(got[0][["prediction", "variance"]], got[1][["prediction", "variance"]], atol=1e-7)


def test_more_samples_than_the_dense_limit(spark, make_points, monkeypatch):
    monkeypatch.setattr(kriging, "MAX_SAMPLES", 100)
    c, v = sample(150, 4)
    p = make_points(c, v)
    fitted = kriging.ordinary(Variogram("exponential", 0.0, 1.0, 0.3)).fit(p)
    assert np.allclose(fitted.predict(p).orderBy("id").toPandas()["prediction"], v, atol=1e-7)
    with pytest.raises(ValueError, match="a dense solve takes 100"):
        kriging.ordinary(Variogram("exponential", 0.0, 1.0, 0.3)).fit_arrays(c, v)
    monkeypatch.setattr(kriging, "MAX_SOLVED_TARGETS", 5)
    with pytest.raises(ValueError, match="at most 5 targets"):
        fitted.predict(p, variance=True)


@pytest.mark.parametrize("predictor", [{}, {"kind": "simple"}, {"kind": "simple", "mean": 0.7}, {"kind": "universal", "trend": "linear"}, {"kind": "universal", "trend": "auto"}])
def test_fold_residuals_equal_refits(spark, make_points, predictor):
    c, v = sample(60, 5)
    p, model = make_points(c, v), Variogram("exponential", 0.05, 1.0, 0.3)
    build = validation.default_kriging_builder(**predictor)
    refit = lambda coords, values: model
    for run in (validation.leave_one_out, lambda *a: validation.spatial_kfold(p, 4, 1, *a[1:]), lambda *a: validation.block_cv(p, (2, 3), *a[1:])):
        got, wanted = (run(p, b, build).rows.orderBy("id").toPandas() for b in (model, refit))
        assert np.allclose(got, wanted, atol=1e-8)


def test_folds_above_the_dense_limit(spark, make_points, monkeypatch):
    c, v = sample(90, 6)
    p, model = make_points(c, v), Variogram("exponential", 0.05, 1.0, 0.3)
    wanted = validation.spatial_kfold(p, 3, 2, model).rows.orderBy("id").toPandas()
    monkeypatch.setattr(validation, "MAX_SAMPLES", 50)
    monkeypatch.setattr(kriging, "MAX_SAMPLES", 50)
    assert np.allclose(validation.spatial_kfold(p, 3, 2, model).rows.orderBy("id").toPandas(), wanted, atol=1e-7)
    with pytest.raises(ValueError, match="at most 50 points"):
        validation.leave_one_out(p, model)
    with pytest.raises(ValueError, match="trains on at most 50"):
        validation.spatial_kfold(p, 3, 2)


def test_lag_table_in_blocks(monkeypatch):
    c, v = sample(83, 7)
    whole = validation.lag_arrays(c, v, 9)
    monkeypatch.setattr(validation, "LAG_ROWS", 10)
    assert all(np.allclose(a, b) for a, b in zip(whole, validation.lag_arrays(c, v, 9), strict=True))
    i, j = np.triu_indices(83, 1)
    assert whole[2].sum() == (np.sqrt(((c[i] - c[j]) ** 2).sum(1)) < np.sqrt(((c[i] - c[j]) ** 2).sum(1)).max() / 2).sum()


def u(seed, start, step, i):
    return (int(hashlib.md5(f"{seed}:{start}:{step}:{i}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52


def plain_folds(c, k, seed, starts):
    best = None
    for s in range(starts):
        ids = range(len(c))
        centres = [c[min(ids, key=lambda i: -np.log(u(seed, s, 0, i)))]]
        while len(centres) < k:
            d = np.array([min(((p - q) ** 2).sum() for q in centres) for p in c])
            centres.append(c[min((i for i in ids if d[i] > 0), key=lambda i: -np.log(u(seed, s, len(centres), i)) / d[i])])
        centres = np.array(centres)
        for _ in range(300):
            label = ((c[:, None] - centres[None]) ** 2).sum(2).argmin(1)
            new = np.array([c[label == j].mean(0) if (label == j).any() else centres[j] for j in range(k)])
            if np.allclose(new, centres, rtol=1e-12, atol=1e-14):
                break
            centres = new
        cost = ((c - centres[label]) ** 2).sum()
        if best is None or cost < best[0]:
            best = cost, label
    return best[1]


def test_folds_are_plain_k_means(spark, make_points):
    c, v = sample(120, 8)
    found = validation.spatial_folds(make_points(c, v).repartition(5), 4, 3, starts=3).orderBy("id").toPandas()["fold"]
    assert found.tolist() == plain_folds(c, 4, 3, 3).tolist()
    few = make_points(c[:3], v[:3])
    assert [r.fold for r in validation.spatial_folds(few, 5).orderBy("id").collect()] == [0, 1, 2]
    same = make_points([(0.5, 0.5)] * 6, [1] * 6)
    assert validation.spatial_folds(same, 3).count() == 6


def test_ranks_over_partitions(spark):
    rng = np.random.default_rng(9)
    values = rng.integers(0, 50, 1_000)
    df = spark.createDataFrame([(int(i), int(v)) for i, v in enumerate(values)], "id long, v int").repartition(7)
    found = {r.id: r.rank for r in ranks.ranked(df, "v", "id").collect()}
    assert [i for i, _ in sorted(found.items(), key=lambda x: x[1])] == sorted(range(1_000), key=lambda i: (values[i], i))
    assert sorted(found.values()) == list(range(1, 1_001))
    assert ranks.ranked(df.filter("false"), "v").count() == 0


def test_normal_quantile(spark):
    p = [1e-300, 1e-20, 1e-9, 0.01, 0.07, 0.3, 0.5, 0.500001, 0.9, 0.999, 1 - 1e-12]
    got = spark.createDataFrame([(x,) for x in p], "p double").select(ranks.normal_quantile(F.col("p"))).collect()
    assert np.allclose([r[0] for r in got], [NormalDist().inv_cdf(x) for x in p], rtol=1e-13, atol=1e-15)
    assert spark.range(1).select(ranks.normal_quantile(F.lit(1.0))).first()[0] is None


@pytest.mark.parametrize("n", [2, 3, 4, 5, 6, 11, 12, 500, 6_000])
def test_shapiro_wilk_of_a_column(spark, n):
    x = np.random.default_rng(n).gumbel(size=n)
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(x)], "id long, value double")
    assert np.allclose(validation.shapiro_wilk_of(df), validation.shapiro_wilk(x), rtol=1e-9, equal_nan=True)
    assert n < 500 or validation.normality(df, "value")["p_value"] < 1e-6


def plain_order(ids, seed, p):
    return sorted(ids, key=lambda i: (hashlib.md5(f"{seed}:{p}:{i}".encode()).hexdigest(), i))


@pytest.mark.parametrize("kind,name", [("moran", "morans_i"), ("geary", "gearys_c"), ("g", "global_getis_ord_g")])
def test_permutations(spark, make_points, kind, name):
    c, v = sample(40, 10)
    v = v + 3
    p = make_points(c, v)
    edges = autocorr.weights_knn(p, 4).unionByName(spark.createDataFrame([(3, 3, 0.5)], "src long, dst long, w double"))
    e = edges.toPandas()
    draws = []
    for k in range(30):
        x = np.empty(40)
        x[plain_order(range(40), 5, k)] = v
        z, w = x - x.mean(), e["w"].to_numpy()
        s, d = e["src"].to_numpy(), e["dst"].to_numpy()
        draws.append({"moran": 40 * (w * z[s] * z[d]).sum() / (w.sum() * (z @ z)), "geary": 39 * (w * (x[s] - x[d]) ** 2).sum() / (2 * w.sum() * (z @ z)), "g": (w * x[s] * x[d])[s != d].sum() / (x.sum() ** 2 - x @ x)}[kind])
    found = [r.s for r in autocorr.permuted(p.repartition(3), edges, kind, 30, 5).orderBy("p").collect()]
    assert np.allclose(found, draws, rtol=1e-10)
    out = getattr(autocorr, name)(p, edges, 30, 5)
    centre = {"moran": 0.0, "geary": 1.0}.get(kind, np.mean(draws))
    observed = next(iter(out.values()))
    assert out["p_value"] == (sum(abs(x - centre) >= abs(observed - centre) for x in draws) + 1) / 31
    assert autocorr.permuted(p, edges.filter("false"), kind, 3, 1).count() == 3


@pytest.mark.parametrize("shape", ["uniform", "circle", "line", "grid", "same", "few"])
def test_largest_distance(spark, make_points, shape):
    rng = np.random.default_rng(11)
    t = rng.uniform(0, 2 * np.pi, 400)
    c = {"uniform": rng.normal(size=(500, 2)), "circle": np.stack([np.cos(t), np.sin(t)], 1), "line": np.stack([t, 2 * t + 1], 1), "grid": np.array([(i, j) for i in range(12) for j in range(9)], float), "same": np.ones((9, 2)), "few": np.array([(0, 0), (3, 4.0)])}[shape]
    wanted = max(np.sqrt(((c - p) ** 2).sum(1)).max() for p in c)
    assert extent.largest_distance(make_points(c.tolist()).repartition(6)) == pytest.approx(wanted, rel=1e-14)
    assert extent.widest(extent.hull(c)) == pytest.approx(wanted, rel=1e-14)


def test_largest_distance_in_space_and_of_no_points(spark, make_points, monkeypatch):
    rng = np.random.default_rng(12)
    for c in (rng.uniform(size=(400, 3)), rng.normal(size=(300, 3)), np.ones((5, 3))):
        wanted = max(np.sqrt(((c - p) ** 2).sum(1)).max() for p in c)
        assert extent.largest_distance(make_points(c.tolist())) == pytest.approx(wanted, rel=1e-14)
    assert extent.largest_distance(make_points([(1, 2, 3)]).filter("false")) == 0.0
    assert extent.largest_distance(make_points([(1, 2)]).filter("false")) == 0.0
    monkeypatch.setattr(extent, "MOST_ENDS", 10)
    sphere = rng.normal(size=(200, 3))
    with pytest.raises(ValueError, match="give max_distance"):
        extent.largest_distance(make_points((sphere / np.linalg.norm(sphere, axis=1)[:, None]).tolist()))
