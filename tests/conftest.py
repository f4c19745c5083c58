import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = f"{ROOT}{os.pathsep}{os.environ.get('PYTHONPATH', '')}"


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.driver.memory", "4g")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def make_points(spark):
    """Point set from coordinates, values and marks."""

    def make(coords, values=None, marks=None):
        dims = ["x", "y", "z"][: len(coords[0])]
        rows = []
        for i, c in enumerate(coords):
            row = [i, *map(float, c)]
            if values is not None:
                row.append(float(values[i]))
            if marks is not None:
                row.append(str(marks[i]))
            rows.append(tuple(row))
        schema = "id long, " + ", ".join(f"{d} double" for d in dims)
        schema += ", value double" if values is not None else ""
        schema += ", mark string" if marks is not None else ""
        return spark.createDataFrame(rows, schema)

    return make
