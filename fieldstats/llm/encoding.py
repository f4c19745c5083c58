"""BPE encoding and decoding of whole texts over a prefix-sharing trie of their distinct words.

Encodings of words already met by this worker process are kept, up to MEMO of
them, so a frequent word is encoded once; words are independent of each other,
so the memo changes no result.

Defined cases: a null text encodes as an empty one (no ids); special strings
inside a text become their special id, as in the library's default; repeated
rows are encoded alike; a word of any length takes one linear walk.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldstats.llm.bpe import Vocabulary, read_vocabulary, vocabulary
from fieldstats.llm.text import slices

MEMO = 400_000


class Encoder:
    """Encodes and decodes texts; ids are little-endian unsigned 32-bit integers."""

    def __init__(self, vocab: Vocabulary) -> None:
        self.vocab = vocab
        self.memo: dict[str, bytes] = {}
        self.special = {s: np.array([i], "<u4").tobytes() for s, i in vocab.special.items()}

    def encode(self, texts: list[str]) -> list[bytes]:
        pieces = [self.vocab.pieces(t) for t in texts]
        memo = self.memo
        new = set().union(*pieces) - memo.keys() - self.special.keys() if pieces else set()
        if len(memo) + len(new) > MEMO:
            memo.clear()
            new = set().union(*pieces) - self.special.keys()
        for word, ids in self.vocab.encode_words(p.encode() for p in new).items():
            memo[word.decode()] = np.array(ids, "<u4").tobytes()
        memo |= self.special
        return [b"".join(map(memo.__getitem__, p)) for p in pieces]

    def decode(self, ids: bytes) -> str:
        return b"".join(map(self.vocab.bytes.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")


_encoders: dict[int, Encoder] = {}


def encoder(data: bytes) -> Encoder:
    vocab = vocabulary(data)
    if id(vocab) not in _encoders:
        _encoders.clear()
        _encoders[id(vocab)] = Encoder(vocab)
    return _encoders[id(vocab)]


def encode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id and ids (array of int) of each document."""
    shared = docs.sparkSession.sparkContext.broadcast(read_vocabulary(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = encoder(shared.value)
        for batch, _ in slices(batches):
            found = [np.frombuffer(x, "<u4").astype(np.int32) for x in made.encode([t or "" for t in batch.column(1).to_pylist()])]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.int32()))], ["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id and text of rows with ids."""
    shared = encoded.sparkSession.sparkContext.broadcast(read_vocabulary(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = encoder(shared.value)
        for batch in batches:
            texts = [made.decode(np.asarray(x or [], "<u4").tobytes()) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select(F.col("doc_id").cast("long"), "ids").mapInArrow(run, "doc_id long, text string")


def digests(docs: DataFrame, path: str) -> DataFrame:
    """Encode and decode each document and return digests of both."""
    shared = docs.sparkSession.sparkContext.broadcast(read_vocabulary(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = encoder(shared.value)
        for batch, _ in slices(batches):
            encoded = made.encode([t or "" for t in batch.column(1).to_pylist()])
            hexes = [hashlib.sha256(x).hexdigest() for x in encoded]
            back = [hashlib.sha256(made.decode(x).encode()).hexdigest() for x in encoded]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(x) // 4 for x in encoded], pa.int64()), pa.array(hexes), pa.array(back)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
