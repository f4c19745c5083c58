import numpy as np
import pytest

from fieldstats.operators import pairs


def brute(coords):
    d = np.sqrt(((coords[:, None] - coords[None]) ** 2).sum(-1))
    return d


@pytest.mark.parametrize("radius", [0.03, 0.2, 3.0])
def test_radius_pairs_equal_brute_force(make_points, radius):
    c = np.random.default_rng(1).uniform(-1, 1, (150, 2))
    found = {(r.a_id, r.b_id) for r in pairs.radius_pairs(make_points(c), radius).collect()}
    d = brute(c)
    assert found == {(i, j) for i in range(150) for j in range(i + 1, 150) if d[i, j] <= radius}


def test_radius_pairs_in_three_dimensions(make_points):
    c = np.random.default_rng(2).uniform(-1, 1, (80, 3))
    d = brute(c)
    assert pairs.radius_pairs(make_points(c), 0.5).count() == (np.triu(d <= 0.5, 1)).sum()


@pytest.mark.parametrize("small", [10_000, 10])
def test_knn_by_broadcast_and_by_rings(make_points, monkeypatch, small):
    monkeypatch.setattr(pairs, "SMALL", small)
    c = np.random.default_rng(3).normal(size=(120, 2))
    c[5] = (40, 40)  # far from all others
    p = make_points(c)
    found = {(r.query_id, r.rank): r.neighbor_id for r in pairs.knn_join(p, p, 4, same=True).collect()}
    d = brute(c)
    np.fill_diagonal(d, np.inf)
    order = np.argsort(d, axis=1, kind="stable")[:, :4]
    assert found == {(i, r + 1): order[i, r] for i in range(120) for r in range(4)}


def test_knn_errors_and_ties(make_points):
    p = make_points([(0, 0), (1, 0), (-1, 0), (0, 1)])
    with pytest.raises(ValueError):
        pairs.knn_join(p, p, 4, same=True)
    first = pairs.knn_join(p.filter("id = 0"), p.filter("id > 0"), 2).orderBy("rank").collect()
    assert [r.neighbor_id for r in first] == [1, 2]


def test_sparse_graphs(make_points):
    c = np.random.default_rng(4).uniform(size=(40, 2))
    c[1] = c[0]
    p = make_points(c)
    d = brute(c)
    graph = {(r.src, r.dst): r.d for r in pairs.sparse_distances(p, max_distance=0.3).collect()}
    assert set(graph) == {(i, j) for i in range(40) for j in range(40) if 0 < d[i, j] <= 0.3}
    near = pairs.sparse_distances(p, max_neighbors=3)
    rows = {(r.src, r.dst) for r in near.collect()}
    assert rows == {(j, i) for i, j in rows}
    assert pairs.sparsity(near, 40) == 1 - len(rows) / 1600
    assert [r.dst for r in pairs.graph_neighbors(near, 0, 1).collect()] == [1]
