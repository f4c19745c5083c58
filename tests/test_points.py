import struct

import numpy as np
import pytest

from fieldstats.functions import models, plotdata
from fieldstats.operators import kriging, variogram
from fieldstats.operators.fit import Variogram
from fieldstats.sources import points as source
from pyspark.sql import functions as F


def test_validation_messages(make_points, spark):
    bad = spark.createDataFrame([(0, 0.0, float("nan"), None)], "id long, x double, y double, value double")
    with pytest.raises(ValueError, match="Coordinates must not contain NaN or infinite values"):
        source.validate_coordinates(bad)
    with pytest.raises(ValueError, match="Values must not"):
        source.validate_values(bad)
    with pytest.raises(ValueError, match="speed must not"):
        source.validate_array(bad, "value", "speed")
    with pytest.raises(ValueError, match="at least 2 dimensions"):
        source.validate_coordinates(bad, ["x"])


def test_geometry(spark):
    wkb = [struct.pack("<BIdd", 1, 1, 1.5, -2.0), struct.pack(">BIdd", 0, 1, 3.0, 4.0)]
    frame = spark.createDataFrame([(i, bytearray(w)) for i, w in enumerate(wkb)], "id long, g binary")
    assert [(r.x, r.y) for r in source.points_from_geometry(frame, "id", "g").orderBy("id").collect()] == [(1.5, -2.0), (3.0, 4.0)]
    line = spark.createDataFrame([(0, bytearray(struct.pack("<BI", 1, 2) + b"\0" * 16))], "id long, g binary")
    with pytest.raises(ValueError, match="points"):
        source.points_from_geometry(line, "id", "g")
    nested = frame.select("id", F.struct(F.lit(1.0).alias("x"), F.lit(2.0).alias("y")).alias("g"))
    assert source.points_from_geometry(nested, "id", "g").count() == 2


def test_files(spark, make_points, tmp_path):
    p = make_points(np.arange(20.0).reshape(10, 2), range(10))
    source.write_points(p, str(tmp_path / "p"))
    assert source.read_points(spark, str(tmp_path / "p"), id="id", x="x", y="y", value="value").count() == 10
    raw = str(tmp_path / "deep" / "raw.bin")
    assert source.write_raw_array(p, ["x", "y"], raw) == 10
    got = source.read_raw_array(spark, raw, 2).orderBy("id").collect()
    assert [(r.c0, r.c1) for r in got] == [(2.0 * i, 2.0 * i + 1) for i in range(10)]


def test_simulations_repeat(spark):
    a, b = (source.simulate_poisson(spark, 100.0, (0, 2, 0, 1), seed=5).collect() for _ in range(2))
    assert a == b and all(0 <= r.x <= 2 and 0 <= r.y <= 1 for r in a)
    cox, cells = source.simulate_cox(spark, 100.0, grid_size=20, seed=5)
    assert cells.count() == 400 and cox.count() > 20
    assert cells.agg(F.avg("intensity")).first()[0] == pytest.approx(100)
    marks = source.simulate_marked_poisson(spark, 200.0, ["a", "b"], [0, 2], seed=1)
    assert {r.mark for r in marks.collect()} == {"b"}
    with pytest.raises(ValueError):
        source.simulate_poisson(spark, -1.0)


def test_models(spark):
    h = spark.createDataFrame([(0.0,), (1e-12,), (0.3,), (5.0,)], "h double")
    for m in models.MODELS:
        got = np.array([r[0] for r in h.select(models.semivariance(F.col("h"), m, 0.124, 0.736, 0.3)).collect()])
        assert np.allclose(got, models.gamma(np.array([0, 1e-12, 0.3, 5.0]), m, 0.124, 0.736, 0.3))
        assert got[0] == 0 and got[1] == pytest.approx(0.124)
    d = spark.range(1).select(models.haversine(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(1.0))).first()[0]
    assert d == pytest.approx(6371 * np.pi / 180)
    with pytest.raises(ValueError):
        models.anisotropic(F.lit(0.0), F.lit(0.0), 0, 1, 0)


def test_plot_tables(spark, make_points):
    rng = np.random.default_rng(0)
    c = rng.uniform(size=(40, 2))
    p = make_points(c, rng.normal(size=40))
    v = Variogram("exponential", 0.0, 1.0, 0.3)
    assert plotdata.variogram(variogram.empirical(p, n_bins=5), v).count() > 0
    t = variogram.directional(p, [0.0, 60.0, 120.0], 30, n_bins=4)
    assert plotdata.directional(t).count() > 0 and plotdata.rose(t).count() == 6
    k = kriging.ordinary(v).fit(p)
    targets = kriging.grid((0, 0), (1, 1), 4, 3, spark)
    assert plotdata.surface(k.predict(targets), targets).count() == 12
    assert plotdata.cross_section(k.predict(targets), targets).agg(F.max("along")).first()[0] > 0
    assert plotdata.comparison(k.residuals(p)).count() == 40 and k.score(p) == pytest.approx(1)
    assert plotdata.residuals_qq(p, "value").filter("theoretical < 0").count() == 20
    assert plotdata.correlogram(variogram.empirical(p, n_bins=5), 1.0).count() > 0
    assert plotdata.ellipse(spark, 2.0, 1.0, 0.3).count() == 100
    assert plotdata.variogram_cloud(p).count() == 780
