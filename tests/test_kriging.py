import numpy as np
import pytest

from fieldstats.functions import models
from fieldstats.operators import kriging
from fieldstats.operators.fit import Variogram

RNG = np.random.default_rng(11)
C = RNG.uniform(0, 10, (80, 2))
V = np.sin(C[:, 0] / 2) + 0.3 * C[:, 1] + RNG.normal(0, 0.1, 80)
T = np.vstack([RNG.uniform(-1, 11, (60, 2)), C[:5]])


def solve(model, coords, values, targets, trend, mean=0.0):
    """One dense bordered solve for each target."""
    f, g = (models.design(x, trend) if trend else np.zeros((len(x), 0)) for x in (coords, targets))
    m = f.shape[1]
    cov = lambda a, b: models.cov(models.distances(a, b), model.model, model.nugget, model.sill, model.range)
    whole = np.block([[cov(coords, coords), f], [f.T, np.zeros((m, m))]])
    out = []
    for i in range(len(targets)):
        right = np.concatenate([cov(targets[i : i + 1], coords)[0], g[i]])
        w = np.linalg.solve(whole, right)
        out.append((mean + w[: len(values)] @ (values - mean), max(model.sill - w @ right, 0)))
    return np.array(out)


@pytest.mark.parametrize("model", ["exponential", "spherical", "gaussian"])
@pytest.mark.parametrize(("kind", "trend"), [("ordinary", "constant"), ("simple", None), ("universal", "linear"), ("universal", "quadratic")])
def test_equals_the_dense_solve(model, kind, trend):
    v = Variogram(model, 0.1, 1.3, 3.0)
    k = kriging.Kriging(v, kind, trend=trend if kind == "universal" else "auto").fit_arrays(C, V)
    p, q = k.predict_arrays(T, True)
    wanted = solve(v, C, V, T, trend, V.mean() if kind == "simple" else 0.0)
    assert np.allclose(p, wanted[:, 0], rtol=1e-7, atol=1e-8) and np.allclose(q, wanted[:, 1], rtol=1e-6, atol=1e-7)
    assert np.allclose(p[-5:], V[:5]) and np.allclose(q[-5:], 0, atol=1e-8)


def test_anisotropic_is_isotropic_in_its_own_coordinates():
    v = Variogram("exponential", 0.1, 1.0, 3.0)
    k = kriging.anisotropic(v, 1.0, np.pi / 4).fit_arrays(C, V)
    c, t = (np.stack(models.to_isotropic(x[:, 0], x[:, 1], 3.0, 1.0, np.pi / 4), axis=1) for x in (C, T))
    assert np.allclose(k.predict_arrays(T)[0], solve(Variogram("exponential", 0.1, 1.0, 1.0), c, V, t, "constant")[:, 0])
    assert k.anisotropy()["is_anisotropic"]


def test_spark_predictions_do_not_depend_on_the_partitions(make_points):
    k = kriging.ordinary(Variogram("spherical", 0.1, 1.3, 3.0)).fit(make_points(C, V))
    targets = make_points(T)
    wanted = k.predict_arrays(T, True)
    for n in (1, 4, 16):
        got = k.predict(targets.repartition(n), True).orderBy("id").toPandas()
        assert np.allclose(got["prediction"], wanted[0], rtol=1e-10) and np.allclose(got["variance"], wanted[1], atol=1e-10)
    for how in ("chunk", "spatial", "adaptive"):
        got = kriging.predict_parallel(k, targets, strategy=how).orderBy("id").toPandas()
        assert np.allclose(got["prediction"], wanted[0], rtol=1e-10)


def test_errors(make_points):
    v = Variogram("exponential", 0.1, 1.0, 2.0)
    with pytest.raises(ValueError, match="Singular covariance matrix"):
        kriging.ordinary(v).fit(make_points([(0, 0), (0, 0), (1, 1)], [1, 2, 3]))
    with pytest.raises(ValueError, match="must be fitted before kriging"):
        kriging.ordinary(Variogram()).fit(make_points(C, V))
    with pytest.raises(ValueError, match="must be fitted before prediction"):
        kriging.ordinary(v).predict(make_points(T))
    with pytest.raises(ValueError, match="trend must be one of"):
        kriging.universal(v, "cubic")
    with pytest.raises(ValueError, match="5 variogram parameters"):
        kriging.Kriging(v, "anisotropic")
    with pytest.raises(ValueError, match="tile size"):
        kriging.tiles(make_points(T).sparkSession, (0, 0, 1, 1), 0)


def test_local_kriging(make_points):
    v = Variogram("exponential", 0.1, 1.3, 3.0)
    got = kriging.local(make_points(T), make_points(C, V), v, max_neighbors=12).orderBy("id").toPandas()
    d = models.distances(T, C)
    for i in (0, 7, 33):
        near = np.argsort(d[i], kind="stable")[:12]
        wanted = solve(v, C[near], V[near], T[i : i + 1], "constant")[0]
        assert (got["prediction"][i], got["variance"][i]) == pytest.approx(tuple(wanted), rel=1e-7)
    few = kriging.local(make_points(T[:3]), make_points(C, V), v, 12, 4, max_distance=1e-6).toPandas()
    assert few["prediction"].isna().all()


def test_progressive_resumes(make_points, tmp_path):
    k = kriging.ordinary(Variogram("spherical", 0.1, 1.3, 3.0)).fit(make_points(C, V))
    targets, path = make_points(T), str(tmp_path / "out")
    assert kriging.predict_progressive(k, targets, path, block=20, max_blocks=2).count() == 40
    got = kriging.predict_progressive(k, targets, path, block=20).orderBy("id").toPandas()
    assert np.allclose(got["prediction"], k.predict_arrays(T)[0])
    assert kriging.predict_progressive(k, targets, path, block=20).count() == len(T)


def test_score_and_trend():
    assert kriging.choose_trend(C, 1 + C[:, 0] - 2 * C[:, 1]) == "linear"
    assert kriging.choose_trend(C, C[:, 0] ** 2 + RNG.normal(0, 0.1, 80)) == "quadratic"


def test_tile_members_equal_the_bounds_of_tiles(make_points):
    p = make_points(C)
    b = (C[:, 0].min(), C[:, 1].min(), C[:, 0].max(), C[:, 1].max())
    for size, overlap in ((1.5, 0.2), ((2.0, 100.0), 0.0), (1.0, 1.4)):
        got = {(r.id, r.ix, r.iy) for r in kriging.tile_members(p, size, overlap).collect()}
        tiles = kriging.tiles(p.sparkSession, b, size, overlap).collect()
        assert got == {(i, t.ix, t.iy) for i, (x, y) in enumerate(C) for t in tiles if t.xmin <= x <= t.xmax and t.ymin <= y <= t.ymax}
    assert kriging.tile_members(p.limit(0), 1.0).count() == 0
    assert kriging.tile_members(make_points([(1, 1), (1, 1)]), 1.0).count() == 2
    lost = p.selectExpr("id", "CASE id WHEN 3 THEN NULL WHEN 4 THEN double('nan') ELSE x END AS x", "y")
    assert {r.id for r in kriging.tile_members(lost, 1.0, 0.0).collect()} == set(range(len(C))) - {3, 4}
    with pytest.raises(ValueError, match="tile size"):
        kriging.tile_members(p, 0)
