"""Session facts shared by the operators."""

from __future__ import annotations

import os
import shutil
import sys
import tempfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

ROOT = Path(__file__).resolve().parent.parent
_shipped: set[str] = set()


def shared_folder(spark: SparkSession) -> str:
    """Folder that driver and executors share, `spark.checkpoint.dir`; only in local mode, as in tests, a local one stands in."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return found or tempfile.mkdtemp(prefix="fieldstats-")


def cut(df: DataFrame) -> DataFrame:
    """Checkpoint df, in the cluster's folder; only where none is set, as in tests, in a local one."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors where their path does not hold it already."""
    context = spark.sparkContext
    paths = [os.getcwd(), *os.environ.get("PYTHONPATH", "").split(os.pathsep)]
    if context.applicationId in _shipped or any(p and Path(p).resolve() == ROOT for p in paths):
        return
    folder = tempfile.mkdtemp(prefix="fieldstats-ship-")
    made = shutil.make_archive(f"{folder}/fieldstats", "zip", ROOT, "fieldstats")
    context.addPyFile(made)
    if folder in sys.path:
        sys.path.remove(folder)
    _shipped.add(context.applicationId)
