"""Raw files by byte ranges, and sampled pairs."""

import numpy as np
import pytest

from fieldstats.operators import variogram
from fieldstats.sources import raw
from fieldstats.streaming import accumulator


def test_ranges_cross_files_and_ids_are_global(spark, tmp_path):
    data = np.random.default_rng(0).normal(size=(1_000, 3)).astype("<f4")
    for name, part in zip(("a.bin", "b.bin", "c.bin"), np.split(data, [10, 700]), strict=True):
        (tmp_path / name).write_bytes(part.tobytes())
    (tmp_path / "_hidden").write_bytes(b"x")
    found = raw.read_raw_array(spark, str(tmp_path), 3, "<f4", 64)
    assert found.rdd.getNumPartitions() == 16
    rows = found.orderBy("id").toPandas()
    assert rows["id"].tolist() == list(range(1_000))
    assert np.array_equal(rows[["c0", "c1", "c2"]].to_numpy(np.float32), data)
    assert raw.read_raw_array(spark, f"file://{tmp_path}", 3, "<f4").count() == 1_000
    with pytest.raises(Exception, match="does not hold rows"):
        raw.read_raw_array(spark, str(tmp_path), 7, "<f4").count()
    with pytest.raises(Exception, match="FileNotFoundError"):
        raw.read_raw_array(spark, str(tmp_path / "none"), 3).count()


def test_one_file_is_read_by_many_tasks(spark, tmp_path):
    data = np.arange(200_000.0)
    (tmp_path / "one.bin").write_bytes(data.tobytes())
    found = raw.read_raw_array(spark, str(tmp_path / "one.bin"), 2, rows_per_slice=10_000)
    assert found.rdd.getNumPartitions() == 10
    assert found.selectExpr("sum(c0) + sum(c1) AS s", "max(id) AS m").first() == (data.sum(), 99_999)
    (tmp_path / "empty.bin").write_bytes(b"")
    assert raw.read_raw_array(spark, str(tmp_path / "empty.bin"), 2).count() == 0


def test_written_parts_keep_the_order(spark, make_points, tmp_path):
    c = np.random.default_rng(1).normal(size=(500, 2))
    p = make_points(c.tolist(), range(500))
    path = str(tmp_path / "deep" / "raw")
    assert raw.write_raw_array(p.repartition(5), ["x", "y"], path) == 500
    assert len(raw.files(path)) > 1
    back = raw.read_raw_array(spark, path, 2).orderBy("id").toPandas()
    assert np.array_equal(back[["c0", "c1"]], c)
    assert raw.write_raw_array(p.limit(3), ["value"], path, dtype="<f4") == 3


def test_variogram_of_two_files_in_step(spark, make_points, tmp_path):
    rng = np.random.default_rng(2)
    c, v = rng.uniform(size=(200, 2)), rng.normal(size=200)
    (tmp_path / "coords").write_bytes(c.tobytes())
    (tmp_path / "values").write_bytes(v.tobytes())
    edges = [0.0, 0.1, 0.2, 0.5]
    got = accumulator.streaming_variogram_memmap(spark, str(tmp_path / "coords"), str(tmp_path / "values"), edges, rows_per_slice=30)
    wanted = accumulator.streaming_variogram(make_points(c.tolist(), v), edges)
    assert np.allclose(got.orderBy("bin").toPandas(), wanted.orderBy("bin").toPandas())
    (tmp_path / "values").write_bytes(v[1:].tobytes())
    with pytest.raises(Exception, match="same number of rows"):
        raw.read_raw_points(spark, str(tmp_path / "coords"), str(tmp_path / "values")).count()


def test_sampled_pairs(spark, make_points):
    rng = np.random.default_rng(3)
    c, v = rng.uniform(size=(60, 2)), rng.normal(size=60)
    p = make_points(c.tolist(), v)
    found = variogram.sampled_pairs(p, 4_000, 1).orderBy("draw").toPandas()
    assert found.equals(variogram.sampled_pairs(p.repartition(7), 4_000, 1).orderBy("draw").toPandas())
    assert (found["a_id"] < found["b_id"]).all() and len(found) == 4_000
    i, j = np.triu_indices(60, 1)
    assert len(found[["a_id", "b_id"]].drop_duplicates()) > 0.8 * len(i)
    gamma = 0.5 * (v[i] - v[j]) ** 2
    assert abs(found["gamma"].mean() - gamma.mean()) < 3 * gamma.std() / np.sqrt(4_000)
    d = {(a, b): np.sqrt(((c[a] - c[b]) ** 2).sum()) for a, b in zip(i, j, strict=True)}
    assert all(r.d == pytest.approx(d[r.a_id, r.b_id]) for r in found.itertuples())
    two = variogram.sampled_pairs(p.filter("id < 2"), 5).collect()
    assert {(r.a_id, r.b_id) for r in two} == {(0, 1)}
    with pytest.raises(ValueError):
        variogram.sampled_pairs(p.limit(1), 5)
