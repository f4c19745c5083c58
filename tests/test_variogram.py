import numpy as np
import pytest

from fieldstats.operators import anisotropy, fit, variogram
from fieldstats.operators.fit import Variogram
from fieldstats.streaming.accumulator import Accumulator, accumulate_pairs, stored, streaming_variogram


def rows(table):
    return [(r.bin, round(r.gamma, 12) if r.gamma is not None else None, r["count"]) for r in table.orderBy("bin").collect()]


def test_edge_rules(make_points):
    line = make_points([(0, 0), (1, 0), (2, 0)], [0, 1, 3])
    left = variogram.empirical(line, [0, 1, 2])
    assert [c for _, _, c in rows(left)] == [0, 2]
    right = streaming_variogram(line, [0, 1, 2]).orderBy("bin").collect()
    assert [r.weight for r in right] == [2, 1]


def test_single_point_and_duplicates(make_points):
    assert rows(variogram.empirical(make_points([(0, 0)], [1]), n_bins=2)) == [(0, 0, 0), (1, 0, 0)]
    table = rows(variogram.empirical(make_points([(0, 0), (0, 0), (0.5, 0)], [1, 1, 2]), n_bins=4, max_distance=0.6))
    assert table[0] == (0, 0, 1)


def test_edges_are_checked(make_points):
    p = make_points([(0, 0), (1, 1)], [0, 1])
    for bad in ([1.0], [0, float("nan")], [0, 0]):
        with pytest.raises(ValueError):
            variogram.empirical(p, bad)


@pytest.mark.parametrize("closed", ["left", "right"])
def test_blocks_equal_the_join(make_points, closed):
    c = np.random.default_rng(0).integers(0, 6, (60, 2))  # a lattice: distances on the edges
    v = np.random.default_rng(1).normal(size=60)
    p = make_points(c, v)
    edges = [0, 1, 2, 3.5]
    a = rows(variogram.empirical(p, edges, closed=closed))
    b = {r.bin: (round(r.gamma, 12), r["count"]) for r in variogram.block_sums(p, edges, closed, block=17).collect()}
    assert {i: (g, n) for i, g, n in a} == b


def test_bandwidth_example(make_points):
    p = make_points([(0, 0), (1, 0.1), (1, -0.3), (0, 2)], [0, 1, 3, 10])
    for width, pairs, gamma in ((None, 2, 2.5), (0.2, 1, 0.5), (0.05, 0, None)):
        t = variogram.directional(p, [0.0], 20, width, max_distance=2, n_bins=4).filter("count > 0").collect()
        assert sum(r["count"] for r in t) == pairs
        if pairs:
            assert sum(r.gamma * r["count"] for r in t) / pairs == pytest.approx(gamma)


def test_direction_without_pairs(make_points):
    p = make_points([(i, 0) for i in range(4)], [0, 1, 0, 2])
    t = variogram.directional(p, [0.0, 90.0], 10, max_distance=5, n_bins=3)
    assert t.filter("angle = 90").agg({"count": "sum"}).first()[0] == 0
    with pytest.raises(ValueError):
        variogram.directional(p, [], 10)


def test_accumulator_example(spark):
    found = spark.createDataFrame([(0.5, 0.1), (0.7, 0.3), (2.2, 0.8), (4.9, 1.2)], "d double, gamma double")
    acc = Accumulator(spark, range(6)).add_pairs(found)
    out = acc.finalize().orderBy("bin").collect()
    assert [r.weight for r in out] == [2, 0, 1, 0, 1]
    assert out[0].gamma == pytest.approx(0.2)
    assert acc.total_weight() == 4 and acc.reset().total_weight() == 0
    assert acc.merge(acc).total_weight() == 8
    assert acc.coo().count() == 3
    with pytest.raises(ValueError):
        acc.merge(Accumulator(spark, [0, 1]))


def test_pair_stream_restarts(spark, tmp_path):
    schema = "d double, gamma double"
    for i in range(2):
        spark.createDataFrame([(0.5 + i, 1.0 + i)], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        accumulate_pairs(stream, [0, 1, 2], str(tmp_path / "state"), str(tmp_path / "check")).awaitTermination()
    out = stored(spark, str(tmp_path / "state"), [0, 1, 2]).finalize().orderBy("bin").collect()
    assert [(r.gamma, r.weight) for r in out] == [(1.0, 1.0), (2.0, 1.0)]


@pytest.mark.parametrize("model", ["exponential", "gaussian", "spherical"])
def test_fit_recovers_parameters(model):
    d = np.linspace(0.1, 6, 20)
    v = Variogram(model).fit((d, fit.models.gamma(d, model, 0.1, 1.2, 1.5)))
    assert (v.nugget, v.sill, v.range) == pytest.approx((0.1, 1.2, 1.5), abs=1e-6)
    assert v.report.converged and v.report.r2 > 0.999999


@pytest.mark.parametrize("model", ["exponential", "gaussian", "spherical"])
def test_anisotropic_fit_recovers_parameters(model):
    theta = np.radians(np.tile(np.arange(0, 180, 15), 18))
    d = np.repeat(np.linspace(0.25, 9, 18), 12)
    g = fit.curve(np.array([0.1, 1.0, np.log(3), 0.0, 0.6]), d, theta, model)[0]
    r = fit.fit_anisotropic(d, g, theta, model, (0.05, 0.9, 2.0, 1.5, 0.2))
    assert r.parameters == pytest.approx((0.1, 1, 3, 1, 0.6), abs=1e-5)


def test_fit_near_the_optimum_of_a_grid(make_points):
    rng = np.random.default_rng(2)
    d = np.linspace(0.15, 3, 20)
    g = fit.models.gamma(d, "exponential", 0.1, 1.0, 0.6) + rng.normal(0, 0.05, 20)
    w = rng.integers(5, 60, 20).astype(float)
    v = Variogram("exponential").fit((d, g, w))
    best = np.inf
    for r in np.geomspace(0.01, 6, 400):
        a = np.stack([np.exp(-d / r), 1 - np.exp(-d / r)], axis=1) * np.sqrt(w)[:, None]
        n, s = np.linalg.lstsq(a, g * np.sqrt(w), rcond=None)[0]
        if 0 <= n <= s:
            best = min(best, np.sum((a @ [n, s] - g * np.sqrt(w)) ** 2))
    assert v.report.diagnostics["sse"] <= 1.001 * best


def test_fit_errors_and_fixed():
    d = np.linspace(0.1, 2, 10)
    with pytest.raises(ValueError, match="Model must be one of"):
        Variogram("cubic")
    with pytest.raises(ValueError, match="Unknown fixed parameter keys"):
        Variogram().fit((d, d), {"slope": 1})
    with pytest.raises(ValueError, match="No valid empirical"):
        Variogram().fit((d, d, np.zeros(10)))
    with pytest.raises(ValueError, match="must be fitted"):
        Variogram().predict(d)
    assert Variogram().fit((d, d), {"nugget": 0.2}).nugget == 0.2


def test_axial_mean():
    assert anisotropy.axial_mean([(178, 0.6), (0, 0.4)]) == pytest.approx(178.8, abs=0.01)
    assert anisotropy.axial_mean([(0, 1), (90, 1)]) == 0


def test_ellipse_angle():
    a = np.arange(0, 180, 30.0)
    turn = np.radians(a - 60)
    r = 1 / np.sqrt((np.cos(turn) / 3) ** 2 + np.sin(turn) ** 2)
    found = anisotropy.estimate_angle(a, r)
    assert found.angle_deg == pytest.approx(60) and found.ratio == pytest.approx(3) and found.confidence == "high"


def test_anisotropic_field_is_detected(make_points):
    rng = np.random.default_rng(5)
    c = rng.uniform(size=(150, 2))
    lag = np.sqrt(((c[:, None] - c[None]) ** 2).sum(-1))
    v = np.linalg.cholesky(fit.models.cov(lag, "exponential", 0.02, 1.0, 0.25) + 1e-9 * np.eye(150)) @ rng.normal(size=150)
    c[:, 1] *= 0.35
    p = make_points(c, v)
    t = variogram.directional(p, list(range(0, 180, 15)), 15, n_bins=10)
    found = anisotropy.detect(t)
    assert min(found.major_direction, 180 - found.major_direction) < 40
    assert anisotropy.range_start(t).major >= anisotropy.range_start(t).minor
    assert anisotropy.ensemble(p, t).confidence in ("high", "medium", "low")


def test_sampling_patterns(make_points):
    grid = [(i, j) for i in range(8) for j in range(8)]
    assert anisotropy.sampling_pattern(make_points(grid)) == "regular"
    assert anisotropy.sampling_pattern(make_points([(0, 0), (0, 0)])) == "insufficient"
    assert anisotropy.sampling_pattern(make_points(np.random.default_rng(0).uniform(size=(64, 2)))) == "irregular"
