"""Benchmark decontamination with SimHash over item-sized windows.

For each benchmark item a window of as many words as the item has is moved over
a text word by word.  A window and an item are held against each other by

1. a 64-bit SimHash of their five-word shingles, weighted by how often each
   occurs.  Items stand in a multi-index: the fingerprint is cut into BLOCKS
   blocks, and every item is entered under each block's value and each value one
   bit away.  Two fingerprints within RADIUS < 2 * BLOCKS bits differ in some
   block by at most one bit, so the index returns all items within the radius;
2. for those within the radius the exact weighted Jaccard similarity,
   sum(min) / sum(max) of the shingle counts, which must reach THRESHOLD.

A window that shares no shingle with an item has similarity 0, so windows are
only taken around shingles that some item of that length holds; this loses none.

Items are collected in chunks of about CHUNK_BYTES of text, each broadcast in its own
pass over the texts; the results of a pass are written before the next one, so what
is held at a time does not grow with the benchmark.  Window sums are taken SPAN words
at a time.

Defined cases: null or empty texts and items match nothing; an item, or a text,
of fewer than five words is one shingle, its whole word sequence; a text shorter
than an item is one window; of windows that match the same item the most similar
is returned, of equal ones the first.  Words are lower-cased (A-Z) and split at
white space.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldstats.llm.store import drop, stage
from fieldstats.llm.text import Texts, U, Words, fold, mix, slices, texts_of

SHINGLE = 5
THRESHOLD = 0.8
RADIUS = 19
BLOCKS = 10
CHUNK_BYTES = 16_000_000
SPAN = 65_536
NO_ID = -(1 << 63)

_WIDTHS = [64 // BLOCKS + (i < 64 % BLOCKS) for i in range(BLOCKS)]
_STARTS = np.cumsum([0, *_WIDTHS[:-1]])


def bits(hashes: np.ndarray) -> np.ndarray:
    """Each hash as a row of 64 signs."""
    return (np.unpackbits(mix(hashes).view(np.uint8).reshape(-1, 8), axis=1).astype(np.int8) << 1) - 1


def fingerprints(sums: np.ndarray) -> np.ndarray:
    """SimHash of rows of 64 sign sums."""
    return np.packbits(sums > 0, axis=1).view(U).ravel()


class Items:
    """Benchmark items with their shingles, lengths, fingerprints and multi-index."""

    def __init__(self, ids: list[int], texts: pa.Array) -> None:
        words = texts_of(texts).words()
        self.ids, self.length = np.array(ids, np.int64), words.counts
        hashes, item, _ = words.shingles(SHINGLE)
        order = np.lexsort((hashes, item))
        hashes, item = hashes[order], item[order]
        self.counts: list[tuple[np.ndarray, np.ndarray]] = []
        prints = np.zeros(len(ids), U)
        for i in range(len(ids)):
            a, b = np.searchsorted(item, [i, i + 1])
            self.counts.append(np.unique(hashes[a:b], return_counts=True))
            if b > a:
                prints[i] = fingerprints(bits(hashes[a:b]).sum(0, dtype=np.int64)[None])[0]
        self.prints = prints
        pairs = np.unique(np.stack([hashes.view(np.int64), self.length[item]]), axis=1)
        self.shingles, self.shingle_length = pairs[0].view(U), pairs[1]
        order = np.argsort(self.shingles, kind="stable")
        self.shingles, self.shingle_length = self.shingles[order], self.shingle_length[order]
        self.seen = np.zeros(1 << 20, bool)
        self.seen[self.shingles >> U(44)] = True
        keys, owners = [], []
        some = np.flatnonzero(self.length > 0)
        for j, (start, width) in enumerate(zip(_STARTS, _WIDTHS, strict=True)):
            value = (prints[some] >> U(start)) & U((1 << width) - 1)
            for flip in [0, *(1 << b for b in range(width))]:
                keys.append(self.keys(self.length[some], j, value ^ U(flip)))
                owners.append(some)
        keys, owners = (np.concatenate(x) if x else np.zeros(0) for x in (keys, owners))
        order = np.argsort(keys, kind="stable")
        self.index, self.owner = keys[order], owners[order]

    @staticmethod
    def keys(length: np.ndarray, block: int, value: np.ndarray) -> np.ndarray:
        return (length.astype(np.int64) * BLOCKS + block) << 8 | value.astype(np.int64)

    def within(self, length: int, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (window, item) of equal length whose fingerprints differ in at most RADIUS bits."""
        windows, items = [], []
        for j, (start, width) in enumerate(zip(_STARTS, _WIDTHS, strict=True)):
            key = self.keys(np.full(len(prints), length), j, (prints >> U(start)) & U((1 << width) - 1))
            a, b = np.searchsorted(self.index, key, "left"), np.searchsorted(self.index, key, "right")
            n = b - a
            windows.append(np.repeat(np.arange(len(prints)), n))
            items.append(self.owner[np.repeat(a - np.cumsum(n) + n, n) + np.arange(n.sum())])
        pairs = np.unique(np.concatenate(windows) * np.int64(len(self.ids)) + np.concatenate(items))
        window, item = pairs // max(1, len(self.ids)), pairs % max(1, len(self.ids))
        near = np.bitwise_count(prints[window] ^ self.prints[item]) <= RADIUS
        return window[near], item[near]

    def similarity(self, item: int, hashes: np.ndarray) -> float:
        names, counts = np.unique(hashes, return_counts=True)
        own, own_counts = self.counts[item]
        _, a, b = np.intersect1d(names, own, assume_unique=True, return_indices=True)
        common = np.minimum(counts[a], own_counts[b]).sum()
        return common / (counts.sum() + own_counts.sum() - common)

    def matches(self, texts: Texts) -> list[tuple[int, int, int, float]]:
        """(text, item number, first word, similarity) of the best window for each pair above the threshold."""
        words = texts.words()
        hashes, text, at = words.shingles(SHINGLE)
        found = np.flatnonzero(self.seen[hashes >> U(44)])
        a, b = np.searchsorted(self.shingles, hashes[found], "left"), np.searchsorted(self.shingles, hashes[found], "right")
        spans: dict[tuple[int, int], list[int]] = defaultdict(list)
        for i in np.flatnonzero(b > a):
            for length in self.shingle_length[a[i] : b[i]]:
                spans[int(text[found[i]]), int(length)].append(int(at[found[i]]))
        for i, t, s in self._short(words):
            spans[t, i].append(s)
        best: dict[tuple[int, int], tuple[float, int]] = {}
        first = np.searchsorted(text, np.arange(texts.n + 1))
        for (t, length), hits in spans.items():
            self._slide(words, hashes[first[t] : first[t + 1]], t, length, np.unique(hits) - words.first[t], best)
        return [(t, i, s, x) for (t, i), (x, s) in best.items()]

    def _short(self, words: Words) -> Iterator[tuple[int, int, int]]:
        """(length, text, word) where an item of fewer than SHINGLE words occurs."""
        for length in np.unique(self.length[(self.length > 0) & (self.length < SHINGLE)]):
            hashes, text, at = words.shingles(int(length), short=False)
            own = np.concatenate([self.counts[i][0] for i in np.flatnonzero(self.length == length)])
            for k in np.flatnonzero(np.isin(hashes, own)):
                yield int(length), int(text[k]), int(at[k])

    def _slide(self, words: Words, hashes: np.ndarray, t: int, length: int, hits: np.ndarray, best: dict) -> None:
        n = int(words.counts[t])
        size = max(1, length - SHINGLE + 1)
        reach = np.unique((hits[:, None] - np.arange(size)).ravel())
        starts = np.unique(np.clip(reach, 0, max(0, n - length)))
        if length < SHINGLE and n > length:
            grams = {int(s): words.hashes[words.first[t] + s : words.first[t] + s + length] for s in starts}
            rows = {s: fold(*(g[i : i + 1] for i in range(length))) for s, g in grams.items()}
            sums = np.stack([bits(rows[int(s)])[0].astype(np.int64) for s in starts])
        else:
            for some in np.split(starts, np.searchsorted(starts, np.arange(int(starts[0]), int(starts[-1]), SPAN)[1:])):
                if len(some):
                    low, high = int(some[0]), min(int(some[-1]) + size, len(hashes))
                    total = np.concatenate([np.zeros((1, 64), np.int64), np.cumsum(bits(hashes[low:high]), axis=0, dtype=np.int64)])
                    sums = total[np.minimum(some + size, len(hashes)) - low] - total[some - low]
                    self._verify(t, length, some, sums, lambda s: hashes[s : s + size], best)
            return
        self._verify(t, length, starts, sums, lambda s: rows[int(s)], best)

    def _verify(self, t: int, length: int, starts: np.ndarray, sums: np.ndarray, window_of, best: dict) -> None:
        for w, i in zip(*self.within(length, fingerprints(sums)), strict=True):
            s = int(starts[w])
            x = float(self.similarity(int(i), window_of(s)))
            if x >= THRESHOLD and x > best.get((t, int(i)), (0.0, 0))[0]:
                best[t, int(i)] = (x, s)  # windows come in order, so the first of equals stays


def chunks(benchmark: DataFrame) -> Iterator[tuple[Items, bool]]:
    """The benchmark in chunks of bounded size, one at a time on the driver, and whether there is but one."""
    rows = benchmark.select(F.coalesce(F.col("item_id").cast("long"), F.lit(NO_ID)).alias("item_id"), "text").filter(F.col("text").isNotNull())
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, math.ceil(size / CHUNK_BYTES))
    for i in range(n):
        part = rows.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == i).orderBy("item_id", "text").collect()
        yield Items([r.item_id for r in part], pa.array([r.text for r in part], pa.string())), n == 1


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, first_word and similarity of every text that holds an item."""
    context = docs.sparkSession.sparkContext
    rows = docs.select(F.col("doc_id").cast("long"), "text")
    out = None
    for items, only in chunks(benchmark):
        shared = context.broadcast(items)
        found = rows.mapInArrow(_finder(shared), "doc_id long, item_id long, first_word long, similarity double")
        if not only:  # one chunk at a time is held by the tasks
            found = stage(found, "matches")
            shared.destroy()
        out = found if out is None else out.unionByName(found)
    return out


def _finder(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in slices(batches):
            found = sorted(shared.value.matches(texts))
            ids = batch.column(0).to_pylist()
            yield pa.RecordBatch.from_arrays([pa.array([ids[t] for t, _, _, _ in found], pa.int64()), pa.array([None if shared.value.ids[i] == NO_ID else int(shared.value.ids[i]) for _, i, _, _ in found], pa.int64()), pa.array([s for _, _, s, _ in found], pa.int64()), pa.array([x for _, _, _, x in found], pa.float64())], ["doc_id", "item_id", "first_word", "similarity"])

    return run


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs that hold no item, filtered where they are read: no join back."""

    def keeper(shared):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch, texts in slices(batches):
                good = np.ones(texts.n, bool)
                good[[t for t, _, _, _ in shared.value.matches(texts)]] = False
                yield batch.filter(pa.array(good))

        return run

    before = None
    for items, only in chunks(benchmark):
        shared = docs.sparkSession.sparkContext.broadcast(items)
        docs = docs.mapInArrow(keeper(shared), docs.schema)
        if not only:
            docs = stage(docs, "clean")
            shared.destroy()
            if before is not None:
                drop(before)
            before = docs
    return docs
