"""Near duplicates by SimHash: components of fingerprints within a Hamming radius, found with vantage-point trees.

A text's fingerprint has a bit for each bit position that is set in more than half
of the 64-bit hashes (XXH64) of its word shingles, repeats included.  Equal fingerprints are one node
from the start, so exact copies are never paired with each other.

A vantage-point tree parts fingerprints by their Hamming distance to a vantage
point: those within its limit lie inside, the others outside.  By the triangle
inequality, a fingerprint at distance d has neighbours within the radius r inside only if
d <= limit + r, and outside only if d > limit - r; other branches are pruned.

1. Shards.  A tree over a bounded sample of the fingerprints is cut at a depth of
   about log2(sqrt(N) / SHARD_SCALE), so that the leaves are shards of about
   SHARD_SCALE * sqrt(N) fingerprints: 4,000 of 250,000, or 1.8 million (14 MB in a
   task) of 5 * 10^10.  Every fingerprint is owned by one shard.  Of two neighbours that a vantage point parts, the outer one
   also visits the inner side as a guest, and further on both sides wherever the
   bounds ask for it; so every pair within the radius meets where the inner one
   is owned.  The sample steers how even shards are, never what is found.
2. Links.  A task reads the owners of a shard, builds their tree (the pairs among
   them come from the same rule) and then streams the guests through it.  Out go
   links to the smallest fingerprint of each local component, not pairs: at most one
   for each owner and one for each guest and component.
3. Components.  Star contraction over staged tables, then the smallest doc_id of each.

Each vantage point parts off a band of guests (at random 64-bit fingerprints and
radius 2 about 0.4 of a node visits both sides), so comparisons grow as N^1.5 and
guests as N^0.24 for each fingerprint of 8 bytes, texts being some thousand.

Defined cases: a text without words, empty or null, has the fingerprint zero and is linked like
any other; fewer words than a shingle are one shingle; a null doc_id is a document
of its component but never its smallest id, which is null only where all are; rows
repeated, or with one doc_id and different texts, are judged row by row; a
text of any length is hashed whole, a megabyte at a time; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldstats.llm.jaccard import components
from fieldstats.llm.store import drop, join_keyed, stage
from fieldstats.llm.text import U, slices, trim

SEED = 42
LEAF = 128
SAMPLE = 65_536
SHARD_SCALE = 8
CANDIDATES = 12
BLOCK = 8_192
PIECE = 1 << 20
_BLANK = re.compile(rb"[\x20\x09-\x0D]")


def pieces(text: bytes) -> Iterator[bytes]:
    """A text in pieces of about PIECE bytes that end between words."""
    start = 0
    while start < len(text):
        cut = _BLANK.search(text, start + PIECE)
        end = cut.start() if cut else len(text)
        yield text[start:end]
        start = end


def shingle_hashes(text: bytes, k: int) -> Iterator[np.ndarray]:
    """XXH64 of each run of k lower-cased words joined by single spaces, a piece of the text at a time; fewer words are one run."""
    digest, words, some = xxhash.xxh64_intdigest, [], False
    for piece in pieces(text):
        words += piece.lower().split()
        if len(words) < k:
            continue
        joined = memoryview(b" ".join(words))
        ends = np.cumsum([len(w) + 1 for w in words]) - 1
        starts = np.concatenate([[0], ends[:-1] + 1]).tolist()
        yield np.array([digest(joined[a:b], SEED) for a, b in zip(starts, ends[k - 1 :].tolist())], U)
        words, some = words[len(words) - k + 1 :], True
    if words and not some:
        yield np.array([digest(b" ".join(words), SEED)], U)


def fingerprint(hashes: Iterator[np.ndarray]) -> int:
    """Bits set in more than half of the hashes; counted BLOCK hashes at a time, so that memory does not follow the text."""
    total, n = np.zeros(64, np.int64), 0
    for part in hashes:
        n += len(part)
        for at in range(0, len(part), BLOCK):
            some = np.unpackbits(part[at : at + BLOCK].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            total += some.sum(0, dtype=np.int64)
    return int(np.packbits(2 * total > n, bitorder="little").view(U)[0])


def fingerprints(docs: DataFrame, k: int = 3) -> DataFrame:
    """doc_id and fingerprint (its 64 bits as a long) of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in slices(batches):
            raw = texts.raw.tobytes()
            found = [fingerprint(shingle_hashes(raw[a:b], k)) for a, b in zip(texts.offsets[:-1], texts.offsets[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.array(found, U).view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, fp long")


def distances(points: np.ndarray, vantage: np.uint64) -> np.ndarray:
    return np.bitwise_count(points ^ vantage).astype(np.int16)


class Tree:
    """Vantage-point tree of distinct fingerprints; `down` levels at most, leaves of at most `leaf` points where there are more levels.

    A node is (vantage, limit, inside, outside); a leaf is its number, counted
    from the inside out.
    """

    def __init__(self, points: np.ndarray, radius: int, leaf: int = LEAF, down: int = 10_000) -> None:
        self.radius, self.leaf = radius, leaf
        self.leaves: list[np.ndarray] = []
        self.root = self._build(np.arange(len(points)), points, down)

    def _build(self, at: np.ndarray, points: np.ndarray, down: int):
        if len(at) <= self.leaf or not down:
            self.leaves.append(at)
            return len(self.leaves) - 1
        vantage, limit = self._vantage(points[at])
        inner = distances(points[at], vantage) <= limit
        return vantage, limit, self._build(at[inner], points, down - 1), self._build(at[~inner], points, down - 1)

    def _vantage(self, points: np.ndarray) -> tuple[np.uint64, int]:
        """Of a few points, that whose middle limit sends fewest to both sides; both sides hold some."""
        best = None
        for v in points[np.unique(np.linspace(0, len(points) - 1, CANDIDATES).astype(np.int64))]:
            d = distances(points, v)
            limit = min(int(np.median(d)), int(d.max()) - 1)
            both = np.count_nonzero((d > limit - self.radius) & (d <= limit + self.radius))
            # an uneven cut saves little: what it leaves on the larger side is cut again
            cost = both + 2 * abs(np.count_nonzero(d <= limit) - len(d) / 2)
            if best is None or cost < best[0]:
                best = cost, v, limit
        return best[1], best[2]

    def visits(self, points: np.ndarray, own: bool) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """For each leaf the points that it owns (none unless `own`), and those that visit it as guests, by number."""
        every, none = np.arange(len(points)), np.zeros(0, np.int64)
        todo = [(self.root, every, none) if own else (self.root, none, every)]
        while todo:
            node, owners, guests = todo.pop()
            if not len(owners) and not len(guests):
                continue
            if isinstance(node, int):
                yield node, owners, guests
                continue
            vantage, limit, inside, outside = node
            d, e = distances(points[owners], vantage), distances(points[guests], vantage)
            near = owners[(d > limit) & (d <= limit + self.radius)]
            todo.append((outside, owners[d > limit], guests[e > limit - self.radius]))
            todo.append((inside, owners[d <= limit], np.concatenate([guests[e <= limit + self.radius], near])))


def near(points: np.ndarray, others: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the pairs (point, other) within the radius."""
    found = []
    for at in range(0, len(points), BLOCK):
        a, b = np.nonzero(np.bitwise_count(points[at : at + BLOCK, None] ^ others[None]) <= radius)
        found.append((a + at, b))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 2


def joined(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels after joining the components of each a with that of its b; a label is the smallest number in its component."""
    while True:
        while (up := label[label]).tobytes() != label.tobytes():
            label = up
        x, y = label[a], label[b]
        if (x == y).all():
            return label
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))


class Shard:
    """Owners of a shard, their tree and their components."""

    def __init__(self, owners: np.ndarray, radius: int) -> None:
        self.owners, self.radius = np.sort(owners), radius
        self.tree = Tree(self.owners, radius)
        self.label = np.arange(len(owners))
        pairs, held = [], 0
        for leaf, own, guests in self.tree.visits(self.owners, own=True):
            here, one = self.tree.leaves[leaf], np.concatenate([own, guests])
            a, b = near(self.owners[one], self.owners[here], radius)
            a, b = one[a], here[b]
            pairs.append((a[a != b], b[a != b]))
            held += len(pairs[-1][0])
            if held > len(owners) + BLOCK:
                self._join(pairs)
                pairs, held = [], 0
        self._join(pairs)

    def _join(self, pairs: list[tuple[np.ndarray, np.ndarray]]) -> None:
        if pairs:
            self.label = joined(self.label, *(np.concatenate(x) for x in zip(*pairs, strict=True)))

    def own(self) -> tuple[np.ndarray, np.ndarray]:
        """Owners that are not the smallest of their component, and the smallest."""
        at = np.flatnonzero(self.label != np.arange(len(self.label)))
        return self.owners[at], self.owners[self.label[at]]

    def answers(self, guests: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Guests that have an owner within the radius, and the smallest owner of each component that they touch."""
        found = [np.zeros((0, 2), np.int64)]
        for leaf, _, visiting in self.tree.visits(guests, own=False):
            here = self.tree.leaves[leaf]
            a, b = near(guests[visiting], self.owners[here], self.radius)
            found.append(np.unique(np.stack([visiting[a], self.label[here[b]]], 1), axis=0))
        pairs = np.unique(np.concatenate(found), axis=0)
        return guests[pairs[:, 0]], self.owners[pairs[:, 1]]


def _solve(radius: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows (shard, guest, fp) in that order; the guests of a shard stream through the tree of its owners."""

    def edges(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, owners, built = None, [], None
        for batch in batches:
            ids = batch.column(0).to_numpy()
            visiting = batch.column(1).to_numpy(zero_copy_only=False)
            points = batch.column(2).to_numpy().view(U)
            cuts = np.flatnonzero((ids[1:] != ids[:-1]) | (visiting[1:] != visiting[:-1])) + 1
            for start, end in zip([0, *cuts], [*cuts, len(ids)], strict=True):
                if start == end:
                    continue
                if ids[start] != shard:
                    if owners:
                        yield edges(*Shard(np.concatenate(owners), radius).own())
                    shard, owners, built = ids[start], [], None
                if not visiting[start]:
                    owners.append(points[start:end])
                    continue
                if owners:
                    built, owners = Shard(np.concatenate(owners), radius), []
                    yield edges(*built.own())
                if built is not None:
                    yield edges(*built.answers(points[start:end]))
        if owners:
            yield edges(*Shard(np.concatenate(owners), radius).own())
        trim()

    return run


def links(distinct: DataFrame, radius: int) -> DataFrame:
    """Links (a, b) that join distinct fingerprints (column fp) into the components of the radius; `distinct` is a staged table."""
    context = distinct.sparkSession.sparkContext
    n = distinct.count()
    share = min(1.0, SAMPLE / max(1, n))
    hashed = F.pmod(F.xxhash64("fp", F.lit("sample")), F.lit(1 << 30))
    # a share of the hash range: about SAMPLE rows, and the same ones in every run
    sample = distinct.filter(hashed < math.ceil(share * (1 << 30))).sort("fp").toArrow().column("fp").to_numpy().view(U)
    depth = max(0, round(math.log2(max(1.0, math.sqrt(n) / SHARD_SCALE))))
    tree = context.broadcast(Tree(sample, radius, leaf=1, down=depth))  # SAMPLE points at most

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            points = batch.column(0).to_numpy().view(U)
            for leaf, owners, guests in tree.value.visits(points, own=True):
                at = np.concatenate([owners, guests])
                kind = np.arange(len(at)) >= len(owners)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), leaf, np.int32)), pa.array(kind), pa.array(points[at].view(np.int64))], ["shard", "guest", "fp"])

    routed = distinct.select("fp").mapInArrow(route, "shard int, guest boolean, fp long")
    return routed.repartition("shard").sortWithinPartitions("shard", "guest", "fp").mapInArrow(_solve(radius), "a long, b long")


def join(docs: DataFrame, k: int = 3, radius: int = 2) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id of every document."""
    rows = stage(fingerprints(docs, k), "fingerprints")
    own = stage(rows.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count("*").alias("rows")), "distinct-fingerprints")
    whole = components(links(own, radius)).withColumnRenamed("class", "fp")
    labels = stage(own.join(whole, "fp", "left").withColumn("label", F.coalesce("label", "fp")), "fingerprint-labels")
    smallest = stage(labels.groupBy("label").agg(F.min("first").alias("component_id"), F.count("*").alias("held")).filter("held > 1"), "simhash-components")
    named = join_keyed(labels, smallest, "label", "held").withColumn("component_id", F.coalesce("component_id", "first"))
    table = stage(named.select("fp", "component_id", "rows"), "fingerprint-components")
    for used in (own, labels, smallest):
        drop(used)
    out = join_keyed(rows, table, "fp", "rows")
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
