"""Sharding by longest-processing-time scheduling.

Groups that must stay together go, largest first, to the shard with the least
load, taken from a heap.  Every group is scheduled by its own size.  Groups of
equal size are alike to the heap, so the driver holds only how many groups there
are of each size, and places a run of equal ones in one step: what the heap
would give each shard is counted from the loads.  k different sizes
add up to k * (k + 1) / 2 bytes at least, so there are fewer than sqrt(2 * bytes) of
them whatever the input.  Groups are numbered within their size by ranges, and
each shard takes the next numbers of the run, so that no task needs a whole size.

Nulls and ties: a null text counts as an empty one; equal texts are one group;
ties in size are broken by a hash of the group's key, then the key, so a rerun
gives the same shards.  An empty table gives an empty result.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fieldstats.llm.store import join_keyed, stage

ROWS_PER_SLOT_RANGE = 20_000


def place(sizes: np.ndarray, counts: np.ndarray, shards: int) -> np.ndarray:
    """Groups of each size that go to each shard: largest size first, always to the least-loaded shard, ties to the lowest.

    Of a long run, shard i is given all its turns that come before load `level`, the highest
    level for which the run is long enough; the heap deals out the rest.
    """
    out = np.zeros((len(sizes), shards), np.int64)
    load = np.zeros(shards, np.int64)
    for at in np.argsort(-sizes, kind="stable"):
        size, left = int(sizes[at]), int(counts[at])
        if left > shards:
            low, high = int(load.min()), int(load.min()) + size * (left + 1)
            while high - low > 1:
                level = (low + high) // 2
                if int(turns(load, level, size).sum()) <= left:
                    low = level
                else:
                    high = level
            out[at] = turns(load, low, size)
            left -= int(out[at].sum())
            load += out[at] * size
        heap = [(int(x), i) for i, x in enumerate(load)]
        heapq.heapify(heap)
        for _ in range(left):
            least, i = heap[0]
            heapq.heapreplace(heap, (least + size, i))
            out[at, i] += 1
            load[i] += size
    return out


def turns(load: np.ndarray, level: int, size: int) -> np.ndarray:
    """How often each shard is filled with `size` while its load is below level."""
    return np.maximum(0, -(-(level - load) // size))


def shard(rows: DataFrame, key: str, size: str, shards: int) -> DataFrame:
    """Add column `shard` to rows; rows with an equal `key` get the same one; sizes are above 0."""
    spark = rows.sparkSession
    groups = stage(rows.groupBy(key).agg(F.sum(size).alias("_size"), F.count("*").alias("_rows")), "groups")
    found = groups.groupBy("_size").count().toArrow()  # fewer than sqrt(2 * bytes) rows
    sizes, counts = (found.column(i).to_numpy() for i in (0, 1))
    ends = np.cumsum(place(sizes, counts, shards), axis=1)
    ends = pa.ListArray.from_arrays(pa.array(np.arange(len(sizes) + 1, dtype=np.int32) * shards), pa.array(ends.ravel()))
    dealt = spark.createDataFrame(pa.table({"_size": sizes, "_held": counts, "_ends": ends}))
    numbered = join_keyed(slots(groups, key, shard="_size"), stage(dealt, "dealt"), "_size", "_held")
    place_of = F.size(F.filter("_ends", lambda end: end <= F.col("slot"))).alias("shard")
    return join_keyed(rows, stage(numbered.select(key, "_rows", place_of), "placed"), key, "_rows")


def slots(rows: DataFrame, *order: str, shard: str = "shard") -> DataFrame:
    """Add column `slot`, gapless from 0 in each shard.

    Rows equal in all columns of `order` may trade places.  A shard is cut into ranges by a
    hash of `order`, in numbers that grow with
    the rows, so no task sorts a whole shard; range totals give the offsets.
    """
    n = rows.count()
    ranges = max(1, n // ROWS_PER_SLOT_RANGE)
    cut = rows.withColumn("_range", F.pmod(F.xxhash64(*order), F.lit(ranges)).cast("int"))
    totals = cut.groupBy(shard, "_range").count()
    before = Window.partitionBy(shard).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(shard, "_range", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_start"))
    inside = Window.partitionBy(shard, "_range").orderBy(*order)
    placed = cut.withColumn("_n", F.row_number().over(inside))
    return placed.join(starts, [shard, "_range"]).withColumn("slot", F.col("_start") + F.col("_n") - 1).drop("_range", "_n", "_start")


def shard_documents(docs: DataFrame, shards: int = 24) -> DataFrame:
    """doc_id, size, text_crc32, group, shard and slot of each document."""
    text = F.coalesce("text", F.lit("")).cast("binary")
    rows = stage(docs.select("doc_id", (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.md5(text).alias("group")), "sizes")
    return slots(shard(rows, "group", "size", shards), "doc_id", "text_crc32", "group")
