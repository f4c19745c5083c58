"""Bounded samples of labelled texts for fitting classifiers on the driver."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldstats.llm.store import fold_of
from fieldstats.llm.text import Texts, texts_of

#: A fit takes at most so many labelled texts, of at most so many bytes each.
SAMPLE_ROWS = 6_000
SAMPLE_BYTES = 32_768
#: Labels looked up in docs are broadcast up to this number, counted before.
BROADCAST_ROWS = 50_000


def sample(docs: DataFrame, labels: DataFrame, label: str, held_out: int = 0, rows: int = SAMPLE_ROWS, most_bytes: int = SAMPLE_BYTES) -> tuple[Texts, np.ndarray]:
    """Texts and 0/1 labels of a fixed pseudo-random choice of labelled rows outside the held-out fold.

    Null labels and texts are left out; a doc_id labelled more than once counts
    as 1 if any of its labels is.  Only distinct texts of docs of at most `most_bytes` take up
    places: of equal texts the one with the smallest doc_id stays, and of several
    texts of one doc_id the first in order, so that what is collected stays bounded.
    The choice follows a hash of doc_id.  Labels below a cut of that hash are looked up
    in docs first; where they give too few texts, the cut is raised.
    """
    ids = labels.filter(F.col(label).isNotNull() & (fold_of() != held_out)).groupBy("doc_id").agg(F.max(label).cast("int").alias("label"))
    texts = docs.select("doc_id", "text").filter(F.octet_length("text") <= most_bytes)
    order = F.xxhash64("doc_id")
    labelled = ids.count()
    wanted = 2 * rows
    while True:
        every = wanted >= labelled
        below = F.lit(True) if every else order < int(wanted / labelled * (1 << 64)) - (1 << 63)
        near = ids.filter(below)
        if near.count() <= BROADCAST_ROWS:
            near = F.broadcast(near)
        found = texts.filter(below).join(near, "doc_id").groupBy("text").agg(F.min_by("label", "doc_id").alias("label"), F.min("doc_id").alias("doc_id"))
        found = found.groupBy("doc_id", "label").agg(F.min("text").alias("text"))
        found = found.orderBy(order, "doc_id").limit(rows).toArrow()
        if every or found.num_rows == rows:
            break
        wanted *= 8
    found = found.combine_chunks().sort_by("doc_id")
    return texts_of(found.column("text")) if found.num_rows else texts_of(pa.array([], pa.string())), np.asarray(found.column("label").to_numpy(), dtype=np.int64)
