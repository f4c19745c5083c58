"""Hard negatives against a nested loop over Python integers."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldstats.llm import negatives


def plain(rows, scale=256, every=100, limits=negatives.Limits()):
    held = {}
    for i, v, label in rows:
        if i is None or v is None or label is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        row = (label, [math.floor(scale * x) for x in v])
        held[i] = min(held.get(i, row), row)
    out = []
    for a in sorted(held):
        if a % every:
            continue
        dot = {i: sum(x * y for x, y in zip(held[a][1], q)) for i, (_, q) in held.items() if i != a}
        order = sorted(dot, key=lambda i: (-dot[i], i))
        for p in [i for i in order if held[i][0] == held[a][0]][: limits.positives]:
            fit = [i for i in order if held[i][0] != held[a][0] and limits.lowest * dot[p] <= 100 * dot[i] <= limits.highest * dot[p]]
            out += [(a, p, k + 1, i, dot[p], dot[i]) for k, i in enumerate(fit[: limits.negatives])]
    return sorted(out)


def mined(spark, rows, every=100, **kind):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").selectExpr("*", "1 AS id", "2 AS q", "3 AS chunk", "true AS anchor").repartition(3)
    found = negatives.mine(negatives.quantised(df, F.col("label")), F.col("id") % every == 0, **kind)
    return sorted((r.anchor_id, r.positive_id, r["rank"], r.negative_id, r.positive_score, r.negative_score) for r in found.collect())


def vectors(n, seed, width=6, labels=3):
    rng = np.random.default_rng(seed)
    return [(i, rng.normal(size=width).astype(np.float32).tolist(), int(rng.integers(labels))) for i in range(n)]


@pytest.mark.parametrize("parts", [(65_536, 8_192), (40, 3)])
def test_equals_the_nested_loop(spark, monkeypatch, parts):
    monkeypatch.setattr(negatives, "PART_ROWS", parts[0])
    monkeypatch.setattr(negatives, "PART_ANCHORS", parts[1])
    rows = vectors(600, 1)
    assert mined(spark, rows, 50) == plain(rows, every=50)


def test_ties_repeats_and_other_limits(spark):
    rng = np.random.default_rng(2)
    rows = [(i, [float(x) for x in rng.integers(-1, 3, 3)], int(rng.integers(2))) for i in range(200)]
    rows += rows[:20] + [(5, [9.0, 9.0, 9.0], 0), (5, [9.0, 9.0, 9.0], 9)]
    limits = negatives.Limits(3, 4, 50, 120)
    assert mined(spark, rows, 10, limits=limits) == plain(rows, every=10, limits=limits)


def test_rows_that_take_no_part_and_ragged_vectors(spark):
    rows = vectors(120, 3)
    rows += [(None, [1.0] * 6, 1), (200, None, 1), (300, [1.0, None, 0.0], 1), (400, [float("nan")], 1), (500, [float("-inf")], 0), (600, [1.0], None)]
    rows += [(700, [], 0), (701, [3.0], 1), (800, [1.0] * 9, 2)]
    assert mined(spark, rows) == plain(rows)


def test_no_rows_no_anchors_no_partners(spark):
    assert mined(spark, []) == []
    assert mined(spark, [(1, [1.0], 0), (2, [1.0], 1)]) == []
    assert mined(spark, [(0, [1.0], 0)]) == []
    assert mined(spark, [(0, [1.0], 0), (1, [-1.0], 0), (2, [-1.0], 1)]) == plain([(0, [1.0], 0), (1, [-1.0], 0), (2, [-1.0], 1)]) == []


def test_large_integers_are_exact_or_refused(spark):
    rows = [(i, [float(1 << 20), float((1 << 20) + i)], i % 2) for i in range(0, 8)]
    assert mined(spark, rows, every=4) == plain(rows, every=4)
    with pytest.raises(Exception, match="OverflowError|OVERFLOW"):
        mined(spark, [(i, [3e30], i % 2) for i in range(4)])
