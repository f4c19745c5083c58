"""Tables in the shared folder of the cluster, and the session's other fixed facts."""

from __future__ import annotations

import atexit
import gc
import tempfile
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

HOT_KEYS = 256
_made: dict[str, SparkSession] = {}


def shared_folder(spark: SparkSession) -> str:
    """`spark.checkpoint.dir` of the session; only where it is unset in local mode, as in tests, a local folder."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="fieldstats-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_folder(spark)}/fieldstats-{uuid.uuid4().hex[:12]}-{name}"
    if not _made:
        atexit.register(_drop_all)
    _made[path] = spark
    return path


def stage(df: DataFrame, name: str, *by: str) -> DataFrame:
    """Write a table once and read it back, so that later jobs neither recompute nor depend on one executor."""
    spark = df.sparkSession
    path = new_path(spark, name)
    writer = df.write.option("compression", "zstd")
    (writer.partitionBy(*by) if by else writer).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.staged_at = path
    return out


def drop(table: DataFrame) -> None:
    """Delete a table that stage() returned, once nothing that is yet to run reads it."""
    _delete(table.sparkSession, table.staged_at)
    del _made[table.staged_at]


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def _drop_all() -> None:
    for path, spark in _made.items():
        try:
            _delete(spark, path)
        except Exception:  # the session has ended; the folder's owner clears it
            return


def join_keyed(rows: DataFrame, table: DataFrame, key: str, held: str) -> DataFrame:
    """Left join of a staged table with one row for each key; `held` says how many of `rows` have it, and is dropped.

    Keys with more than 1/HOT_KEYS of them, fewer than HOT_KEYS by count, are
    broadcast; rows already served are spread over the tasks of the other join.
    """
    most = (table.agg(F.sum(held)).first()[0] or 0) / HOT_KEYS
    values = [c for c in table.columns if c not in (key, held)]
    hot = table.filter(F.col(held) > most).select(F.col(key).alias("_hot"), *[F.col(c).alias(f"_hot_{c}") for c in values])
    cold = table.filter(F.col(held) <= most).select(F.col(key).alias("_cold"), *[F.col(c).alias(f"_cold_{c}") for c in values])
    out = rows.join(F.broadcast(hot), F.col(key) == F.col("_hot"), "left")
    at = F.when(F.col("_hot").isNull(), F.col(key)).otherwise(F.xxhash64(*rows.columns).cast(rows.schema[key].dataType))
    out = out.withColumn("_at", at).join(cold, F.col("_at") == F.col("_cold"), "left")
    return out.select(*rows.columns, *[F.when(F.col("_hot").isNull(), F.col(f"_cold_{c}")).otherwise(F.col(f"_hot_{c}")).alias(c) for c in values])


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def fold_of(doc_id: str = "doc_id", folds: int = 5):
    """crc32 of the id as text, modulo the number of folds."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % folds


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of finished steps, whose DataFrames are out of use.

    The cleaner follows the driver's garbage collection and works on its own
    thread; the second round catches what the first one only unlinked.
    """
    for _ in range(2):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(1)
