import numpy as np
import pytest

from fieldstats.operators import autocorr, patterns, validation
from fieldstats.operators.fit import Variogram


def test_distance_functions_are_monotone(make_points):
    p = make_points(np.random.default_rng(42).uniform(size=(200, 2)))
    radii = [0.02, 0.05, 0.1, 0.2]
    for table, c in ((patterns.ripley_k(p, radii, 1.0), "k"), (patterns.g_function(p, radii), "g"), (patterns.f_function(p, radii, (0, 1, 0, 1), 300, 1), "f")):
        got = [r[c] for r in table.orderBy("r").collect()]
        assert got == sorted(got) and (c == "k" or 0 <= got[0] <= got[-1] <= 1)
    pcf = patterns.pair_correlation(p, [0.05, 0.1, 0.15, 0.2], 1.0).orderBy("r").toPandas()
    k = patterns.ripley_k(p, [0.05, 0.1, 0.15, 0.2], 1.0).orderBy("r").toPandas()
    assert np.allclose(pcf["pcf"], np.gradient(k["k"], k["r"]) / (2 * np.pi * k["r"]))
    for bad in ([-1.0], []):
        with pytest.raises(ValueError):
            patterns.ripley_k(p, bad, 1.0)
    with pytest.raises(ValueError, match="area"):
        patterns.ripley_k(p, radii, 0.0)


def clusters(n=60):
    rng = np.random.default_rng(7)
    return np.vstack([rng.normal(0, 0.08, (n, 2)), rng.normal(1, 0.08, (n, 2))])


def dbscan(c, eps, m):
    """Plain density clustering with the same numbering."""
    near = [np.flatnonzero(np.sqrt(((c - x) ** 2).sum(1)) <= eps) for x in c]
    core = [len(n) >= m for n in near]
    label = np.full(len(c), -1)
    now = 0
    for i in range(len(c)):
        if core[i] and label[i] < 0:
            todo = [i]
            label[i] = now
            while todo:
                for k in near[todo.pop()]:
                    if core[k] and label[k] < 0:
                        label[k] = now
                        todo.append(k)
            now += 1
    for i in range(len(c)):
        if not core[i] and (touch := [label[k] for k in near[i] if core[k]]):
            label[i] = min(touch)
    return label


@pytest.mark.parametrize("eps", [0.05, 0.1, 0.2])
def test_dbscan(make_points, eps):
    c = np.vstack([clusters(), [(5, 5)]])
    got = patterns.dbscan(make_points(c), eps, 5).orderBy("id").toPandas()["label"].to_numpy()
    assert (got == dbscan(c, eps, 5)).all()


def test_clusters_gi_star_and_density(make_points):
    c = clusters()
    p = make_points(c, [10] * 60 + [1] * 60, [0] * 60 + [1] * 60)
    m = patterns.cluster_metrics(p, "mark").first()
    assert m.n_clusters == 2 and m.silhouette > 0.8
    assert patterns.cluster_metrics(p.filter("mark = '0'"), "mark").first().silhouette is None
    z = patterns.gi_star(p, 0.3).orderBy("id").toPandas()["z"]
    assert z[:60].mean() > 2 and z[60:].mean() < -2
    d = patterns.kde(p, grid_size=40, bounds=(-1, 2, -1, 2)).toPandas()["density"]
    assert d.sum() * (3 / 39) ** 2 == pytest.approx(1, abs=0.02)
    with pytest.raises(ValueError):
        patterns.kde(p, grid_size=1)


def test_segregation(make_points):
    c = np.random.default_rng(0).uniform(size=(400, 2))
    split = patterns.segregation(make_points(c, marks=np.where(c[:, 0] < 0.5, "A", "B")), 4, (0, 1, 0, 1)).first()
    assert split.theil_h == pytest.approx(1) and split.dissimilarity == pytest.approx(1) and split.n_groups == 2
    mixed = patterns.segregation(make_points(c, marks=np.random.default_rng(1).choice(["A", "B", "C"], 400)), 4, (0, 1, 0, 1)).first()
    assert mixed.theil_h < 0.2 and mixed.dissimilarity is None


def lattice(make_points, n, f):
    g = np.linspace(0, 1, n)
    c = np.array([(a, b) for a in g for b in g])
    return make_points(c, f(c)), c


def test_autocorrelation_of_a_smooth_field(make_points):
    p, c = lattice(make_points, 8, lambda c: c.sum(1))
    w = autocorr.weights_knn(p, 4)
    found = autocorr.morans_i(p, w, 99, 1)
    assert found["i"] > 0.5 and found["p_value"] <= 0.05
    assert autocorr.gearys_c(p, w)["c"] < 0.5
    assert autocorr.morans_i(p, w)["z_score"] > 3
    assert autocorr.global_getis_ord_g(p, w, 19, 0)["p_value"] <= 1
    dense = np.zeros((64, 64))
    for r in w.collect():
        dense[r.src, r.dst] = r.w
    v = c.sum(1)
    z = v - v.mean()
    assert found["i"] == pytest.approx(64 / dense.sum() * (z @ dense @ z) / (z @ z))
    local = autocorr.local_morans_i(p, w).orderBy("id").toPandas()["i"]
    assert np.allclose(local, z / (z @ z / 64) * (dense @ z))


def test_constant_values_and_no_weights(make_points, spark):
    p, _ = lattice(make_points, 4, lambda c: np.ones(16))
    w = autocorr.weights_knn(p, 3)
    assert autocorr.morans_i_frame(p, w).first().i == 0 and autocorr.gearys_c_frame(p, w).first().c == 0
    none = spark.createDataFrame([], "src long, dst long, w double")
    q, _ = lattice(make_points, 4, lambda c: c[:, 0])
    assert autocorr.morans_i_frame(q, none).first().i == 0 and autocorr.gearys_c_frame(q, none).first().c == 1
    assert all(r.z == 0 for r in autocorr.local_g(p, w).collect())


def test_weights(make_points, spark):
    e = spark.createDataFrame([(0, 1, 2.0), (2, 0, 1.0), (2, 1, 1.0)], "src long, dst long, w double")
    sums = {r.src: r["sum(w)"] for r in autocorr.row_standardize(e).groupBy("src").sum("w").collect()}
    assert sums == {0: 1.0, 2: 1.0}
    twice = make_points([(0, 0), (0, 0), (1, 0)], [1, 2, 3])
    with pytest.raises(ValueError):
        autocorr.weights_idw(twice)
    with pytest.raises(ValueError, match="1 <= k < n"):
        autocorr.weights_knn(twice, 3)
    with pytest.raises(ValueError):
        autocorr.weights_band(twice, 0.0)


def test_cross_validation(make_points):
    rng = np.random.default_rng(1)
    c = rng.uniform(size=(30, 2))
    p = make_points(c, c.sum(1) + rng.normal(0, 0.01, 30))
    fixed = lambda coords, values: Variogram("exponential", 0.001, 1.0, 1.0)
    loo = validation.leave_one_out(p, fixed)
    assert loo.rows.count() == 30 and loo.summary()["r2"] > 0.9
    assert validation.spatial_kfold(p, 3, 0, fixed).rows.count() == 30
    assert validation.block_cv(p, (2, 2), fixed).rows.count() == 30
    assert validation.leave_one_out(p).rows.count() == 30
    with pytest.raises(ValueError, match="at least 3"):
        validation.leave_one_out(p.limit(2), fixed)
    best, scores = validation.select_model(p)
    assert scores[best.model] == min(scores.values())
    with pytest.raises(ValueError, match="criterion must be one of"):
        validation.select_model(p, by="cv")


def test_block_edges_are_shared(make_points):
    p = make_points([(0, 0), (1, 1), (2, 2)], [1, 2, 3])
    assert sorted((r.id, r.fold) for r in validation.block_folds(p, 2, 2).collect()) == [(0, 0), (1, 0), (1, 1), (1, 2), (1, 3), (2, 3)]


def test_shapiro_wilk():
    x = [148, 154, 158, 160, 161, 162, 166, 170, 182, 195, 236]
    w, p = validation.shapiro_wilk(x)
    assert w == pytest.approx(0.79, abs=0.005) and p < 0.01
    assert validation.shapiro_wilk(np.random.default_rng(0).normal(size=200))[1] > 0.01
    assert np.isnan(validation.shapiro_wilk([1, 2])[0])
