"""Token counts with a whole-token shortcut.

Before the scan every vocabulary string is merged alone; those proved to encode
as one token make a table, and a pre-token found there counts 1 without further
work.  Only other pre-tokens are merged, and their counts are kept per worker
process, up to MEMO of them.

Defined cases: a null or empty text has 0 bytes and 0 tokens; special strings
inside a text count as one token, as in the library's default.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldstats.llm.bpe import Vocabulary, read_vocabulary, vocabulary
from fieldstats.llm.text import slices

MEMO = 600_000
LIMIT = 512


class Counts(dict):
    """Token count by pre-token: 1 for whole tokens and special strings, merged on demand for others."""

    def __init__(self, vocab: Vocabulary, whole: list[str]) -> None:
        self.fixed = dict.fromkeys([*whole, *vocab.special], 1)
        self.merge = vocab.merge
        super().__init__(self.fixed)

    def __missing__(self, piece: str) -> int:
        if len(self) > MEMO:
            self.clear()
            self.update(self.fixed)
        n = self[piece] = len(self.merge(piece.encode()))
        return n


_counts: dict[int, Counts] = {}


def count(docs: DataFrame, path: str, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit of each document."""
    data = read_vocabulary(path)
    shared = docs.sparkSession.sparkContext.broadcast((data, vocabulary(data).whole_tokens()))  # as large as the vocabulary

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        data, whole = shared.value
        vocab = vocabulary(data)
        if id(vocab) not in _counts:
            _counts.clear()
            _counts[id(vocab)] = Counts(vocab, whole)
        of = _counts[id(vocab)].__getitem__
        for batch, texts in slices(batches):
            n = [sum(map(of, vocab.pieces(t or ""))) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts.sizes, pa.int64()), pa.array(n, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    counted = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
