"""Operators on cells (DBSCAN, silhouettes, density sums, streams) against all pairs."""

import numpy as np
import pytest

from fieldstats.operators import graph, patterns
from fieldstats.streaming import accumulator


def plain_dbscan(c, eps, least):
    d = np.sqrt(((c[:, None] - c[None]) ** 2).sum(2)) <= eps
    core = d.sum(1) >= least
    label = np.full(len(c), -1)
    for i in np.flatnonzero(core):
        if label[i] >= 0:
            continue
        number, todo = label.max() + 1, [i]
        while todo:
            j = todo.pop()
            if core[j] and label[j] < 0:
                label[j] = number
                todo += np.flatnonzero(d[j] & core & (label < 0)).tolist()
    for i in np.flatnonzero(~core):
        near = label[d[i] & core]
        label[i] = near.min() if len(near) else -1
    return label


@pytest.mark.parametrize("seed,eps,least", [(1, 0.05, 4), (2, 0.08, 6), (3, 0.02, 1), (4, 0.3, 30)])
def test_dbscan_equals_all_pairs(spark, make_points, monkeypatch, seed, eps, least):
    monkeypatch.setattr(patterns, "CELL_PART", 20)
    rng = np.random.default_rng(seed)
    c = np.concatenate([rng.uniform(-1, 1, (150, 2)), rng.normal((0.3, 0.2), 0.05, (120, 2)), np.stack([np.linspace(-1, 1, 60), np.full(60, -0.5)], 1), np.zeros((9, 2))])
    found = patterns.dbscan(make_points(c.tolist()).repartition(5), eps, least).orderBy("id").toPandas()["label"]
    assert found.tolist() == plain_dbscan(c, eps, least).tolist()


def test_dbscan_of_a_crowded_cell(spark):
    """50,000 points in one cell: pairs of them would be 2.5 * 10^9."""
    rng = np.random.default_rng(5)
    c = np.concatenate([rng.uniform(0, 0.05, (50_000, 2)), [(0.12, 0.02), (5, 5)]])
    df = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(c)], "id long, x double, y double")
    found = dict(patterns.dbscan(df, 0.1, 10).groupBy("label").count().collect())
    assert found == {0: 50_001, -1: 1}


def test_no_points_and_no_cores(spark, make_points):
    p = make_points([(0, 0), (9, 9)])
    assert patterns.dbscan(p.filter("false"), 1.0).count() == 0
    assert {r.label for r in patterns.dbscan(p, 1.0, 2).collect()} == {-1}


def test_touching_sets():
    rng = np.random.default_rng(6)
    for _ in range(60):
        a, b = rng.uniform(0, 1, (rng.integers(1, 200), 2)), rng.uniform(0, 1, (rng.integers(1, 200), 2)) + [rng.uniform(0.8, 1.4), 0]
        d = np.sqrt(((a[:, None] - b[None]) ** 2).sum(2)).min()
        for eps in (d, np.nextafter(d, 0), 0.1):
            assert patterns.touching(a, b, eps) == (d <= eps)


def test_components(spark):
    rng = np.random.default_rng(7)
    edges = rng.integers(0, 300, (220, 2)).tolist() + [[1000 + i, 1001 + i] for i in range(40)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    found = {r.node: r.label for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {x: find(x) for x in list(root) if find(x) != x}


def test_silhouettes(spark):
    rng = np.random.default_rng(8)
    c, label = rng.normal(size=(90, 2)), rng.integers(0, 4, 90)
    label[0] = 7
    df = spark.createDataFrame([(i, float(x), float(y), int(k)) for i, ((x, y), k) in enumerate(zip(c, label))], "id long, x double, y double, label int")
    d = np.sqrt(((c[:, None] - c[None]) ** 2).sum(2))
    wanted = []
    for i in range(90):
        own = (label == label[i]) & (np.arange(90) != i)
        if not own.any():
            wanted.append(0.0)
            continue
        a, b = d[i][own].mean(), min(d[i][label == k].mean() for k in set(label) - {label[i]})
        wanted.append((b - a) / max(a, b))
    got = patterns.silhouettes(df, block=16).orderBy("id").toPandas()["silhouette"]
    assert np.allclose(got, wanted, atol=1e-12)
    one = patterns.silhouettes(df.filter("label = 1")).select("silhouette").distinct().collect()
    assert [r[0] for r in one] == [None]


@pytest.mark.parametrize("n,size,bandwidth", [(400, 25, None), (3_000, 12, 0.08), (50, 30, 2.0)])
def test_density_sum_equals_the_full_one(spark, n, size, bandwidth):
    rng = np.random.default_rng(n)
    c = rng.normal(size=(n, 2)) @ np.array([[1.0, 0.4], [0.0, 0.5]]) + [3, -2]
    c[0] = 40, 40  # far from all
    df = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(c)], "id long, x double, y double")
    got = patterns.kde(df.repartition(3), bandwidth, size, (0.0, 6.0, -4.0, 0.0)).orderBy("ix", "iy").toPandas()
    h = np.cov(c.T) * (n ** (-1 / 6) if bandwidth is None else bandwidth) ** 2
    g = got[["x", "y"]].to_numpy()
    step = g[:, None] - c[None]
    full = np.exp(-0.5 * np.einsum("gni,ij,gnj->gn", step, np.linalg.inv(h), step)).sum(1) / (n * 2 * np.pi * np.sqrt(np.linalg.det(h)))
    peak = 1 / (2 * np.pi * np.sqrt(np.linalg.det(h)))
    assert len(got) == size * size and np.abs(got["density"] - full).max() < 1e-9 * peak


@pytest.mark.parametrize("salts", [1, 3])
def test_stream_by_cells(spark, make_points, tmp_path, salts):
    rng = np.random.default_rng(9)
    c, v = rng.uniform(0, 2, (160, 2)), rng.normal(size=160)
    p = make_points(c.tolist(), v)
    p.repartition(4, "id").write.parquet(str(tmp_path / "points"))
    name = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    edges = [0.0, 0.1, 0.25, 0.5]
    stream = spark.readStream.schema(p.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "points"))
    accumulator.accumulate_cells(stream, edges, str(tmp_path / "state"), str(tmp_path / "checkpoint"), salts).awaitTermination()
    spark.conf.unset(name)
    got = accumulator.stored(spark, str(tmp_path / "state"), edges).finalize().orderBy("bin").toPandas()
    assert np.allclose(got, accumulator.streaming_variogram(p, edges).orderBy("bin").toPandas())
    assert len(list((tmp_path / "state").glob("batch=*"))) == 4
