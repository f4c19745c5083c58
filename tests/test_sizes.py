"""Cases that only larger tables showed: ties, borders, systems above the dense limit, pairs that are not kept."""

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from fieldstats.functions import models
from fieldstats.operators import anisotropy, autocorr, blocks, conjugate, kriging, validation, variogram
from fieldstats.operators.fit import Variogram
from fieldstats.plans import queries as plans
from fieldstats.streaming import accumulator


def embeddings(folder, columns):
    """A table `embeddings` whose vectors are the given columns."""
    n = len(columns[0])
    vectors = pa.array(np.stack(columns, 1).astype(np.float32).tolist(), pa.list_(pa.float32()))
    pq.write_table(pa.table({"vec_id": pa.array(range(n), pa.int64()), "embedding": vectors, "label": pa.array([i % 3 for i in range(n)], pa.int32())}), f"{folder}/embeddings.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{folder}/embeddings.parquet'")
    return str(folder), con


def same(found, wanted, key):
    found, wanted = (x[list(wanted.columns)].sort_values(key).reset_index(drop=True) for x in (found.toPandas(), wanted))
    return len(found) == len(wanted) and all(found[c].equals(wanted[c].astype(found[c].dtype)) for c in wanted.columns)


def test_points_on_a_tile_border_are_in_the_tiles_whose_edges_hold_them(make_points):
    """The quotient rounds across a border where the sum of edge and step does not."""
    for low in (0.1, 0.7, 0.0001293104749034952):
        edges = [low + i * 10.0 + a for i in range(4) for a in (-1.0, 11.0)]
        x = [low, low + 39.0] + [v for e in edges for v in (e, np.nextafter(e, -1e9), np.nextafter(e, 1e9)) if low <= v <= low + 39.0]
        p = make_points([(v, 0.0) for v in x])
        got = {(r.id, r.ix) for r in kriging.tile_members(p, 10.0, 0.1).collect()}
        assert got == {(i, k) for i, v in enumerate(x) for k in range(4) if low + k * 10.0 - 1.0 <= v <= low + k * 10.0 + 11.0}


def test_fold_query_takes_the_steps_of_its_twin(spark, tmp_path):
    """Points whose clusters still move after 60 steps."""
    p = np.round(np.random.default_rng(1).normal(0, 0.125, (6_000, 2)), 4)
    folder, con = embeddings(tmp_path, [p[:, 0], p[:, 1], p[:, 0]])
    assert same(plans.queries()["kmeans_folds"](spark, folder), con.execute(plans.oracle_sql()["kmeans_folds"]).df(), "id")


@pytest.mark.parametrize("ranges", [[0.025] * 6, [0.125] * 6, [0.075, 0.025] * 3, [0.075, 0.025, 0.025] * 2, [1000.0] * 6, [1e-6] * 6])
def test_the_smallest_of_equal_axes_is_taken(ranges):
    found = anisotropy.estimate_angle(anisotropy.REQUIRED, ranges)
    assert (found.angle_deg, round(found.ratio, 9)) == (0.0, 1.0)
    assert anisotropy.estimate_angle(anisotropy.REQUIRED, np.array([2.0, 3.0, 3.0, 2.0, 2.0, 2.0]) * ranges[1]).angle_deg == 45.0


def sample(n, seed, d=2):
    rng = np.random.default_rng(seed)
    c = rng.uniform(size=(n, d))
    return c, np.sin(5 * c[:, 0]) + c[:, 1] ** 2 + 0.1 * rng.normal(size=n)


@pytest.mark.parametrize("model", ["exponential", "spherical", "gaussian"])
def test_fast_products_and_their_solves_equal_dense_ones(spark, monkeypatch, model):
    monkeypatch.setattr(conjugate, "FEW", 100)
    c, v = sample(1_500, 7)
    m = Variogram(model, 0.05, 1.1, 0.2)
    dense = models.cov(models.distances(c, c), model, 0.05, 1.1, 0.2)
    operator = conjugate.Covariance(spark, c, m)
    fast, order = operator.far[0], operator.order
    fast.tree = fast.tree  # made here as in a task
    got = np.empty_like(c)
    for part in range(3):
        rows, some = fast.product(c[order], part, 3)
        got[order[rows]] = some
    assert np.abs(got - dense @ c).max() < 1e-5 * np.abs(dense @ c).max()
    assert np.abs(fast.residual(v[order][:, None], c[order][:, :1])[:, 0] - (v - dense @ c[:, 0])[order]).max() < 1e-9
    held = np.ones((len(c), 3))
    held[:400, 1] = held[300:, 2] = 0
    right = np.column_stack([v, np.ones(len(c)), v])
    monkeypatch.setattr(conjugate.Covariance, "solve", None)  # not left to it
    found, product = operator.refined(right, held)
    assert np.abs((right - dense @ found) * held).max() < 1e-8 and np.abs(product - dense @ found).max() < 1e-8
    assert not found[held == 0].any()
    operator.close()
    assert np.allclose(conjugate.inverse_diagonal(spark, c, m), np.diag(np.linalg.inv(dense)), rtol=1e-6)


@pytest.mark.parametrize("predictor", [{}, {"kind": "simple"}, {"kind": "simple", "mean": 0.7}, {"kind": "universal", "trend": "linear"}, {"kind": "anisotropic", "angle": 0.4, "range_minor": 0.1}])
def test_variances_and_points_left_out_above_the_dense_limit(spark, make_points, monkeypatch, predictor):
    c, v = sample(120, 8)
    p, model = make_points(c, v), Variogram("exponential", 0.05, 1.0, 0.3)
    targets = make_points(np.vstack([sample(40, 9)[0], c[:10]]))
    build = validation.default_kriging_builder(**predictor)

    def run():
        out = [build(model).fit(p).predict(targets, variance=True)]
        out += [validation.leave_one_out(p, model, build).rows, validation.spatial_kfold(p, 3, 2, model, build).rows]
        return [x.orderBy("id").toPandas() for x in out]

    wanted = run()
    monkeypatch.setattr(kriging, "MAX_SAMPLES", 50)
    monkeypatch.setattr(conjugate, "FEW", 60)
    monkeypatch.setattr(conjugate, "NUMBERS", 2_400)
    for got, dense in zip(run(), wanted, strict=True):
        assert np.allclose(got, dense, atol=1e-6)


@pytest.fixture
def crowd(tmp_path):
    """600 points on a coarse lattice, so that many distances are equal and lie on bin edges."""
    rng = np.random.default_rng(3)
    p = np.array([(x, y) for x in range(30) for y in range(20)])[rng.permutation(600)] / 64.0
    return embeddings(tmp_path, [p[:, 0], p[:, 1], rng.normal(size=600), rng.normal(size=600)])


@pytest.mark.parametrize("name", ["variogram_empirical_fixed", "variogram_blocks", "variogram_directional", "variogram_directional_bandwidth", "variogram_rose", "variogram_streaming", "variogram_stream_query", "variogram_stream_cells", "dist_euclidean", "dist_haversine", "dist_anisotropic", "weights_band", "weights_idw", "row_standardize"])
def test_pairs_in_blocks_equal_the_twin(spark, monkeypatch, crowd, name):
    """All pair queries by blocks, with no join or window left that would exchange pairs."""
    monkeypatch.setattr(variogram, "SMALL", 50)
    monkeypatch.setattr(accumulator, "SMALL", 50)
    monkeypatch.setattr(blocks, "TILE", 37)
    for module, made in ((accumulator, "radius_join"), (variogram, "radius_pairs"), (autocorr, "radius_join")):
        monkeypatch.setattr(module, made, None)
    folder, con = crowd
    found, wanted = plans.queries()[name](spark, folder), con.execute(plans.oracle_sql()[name]).df()
    if name.startswith(("weights", "row")):
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "Window" not in plan and "hashpartitioning" not in plan
    assert same(found, wanted, [c for c in ("angle", "bin", "id", "src", "dst") if c in wanted])


def test_bins_are_decided_as_by_distances():
    for edge in (0.05, 0.1, 0.15000000000000002, 0.3, 1e-9, 7.0, 0.0):
        for closed, passed in (("left", np.greater_equal), ("right", np.greater)):
            t = blocks.threshold(edge, closed)
            assert passed(np.sqrt(t), edge) and (t == 0 or not passed(np.sqrt(np.nextafter(t, -1)), edge))
