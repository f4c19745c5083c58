"""Exact n-gram Jaccard self-join with set-relation skipping, and its components.

A text's set is its distinct word shingles; two sets link when
100 * |intersection| >= percent * |union|.  Copies are handled once: equal sets
form a class, and only classes are joined.

1. Index lists.  Linked sets differ in at most
   D = (100 - percent) / (100 + percent) * (|x| + |y|) shingles, so of more than
   D blocks that cut the hash range into positions, one block at least has equal
   content in both.  A set is entered in one list per position, named by the
   block's content; positions whose content differs are skipped unread.  The
   number of positions follows from the set's size range; a set near the upper
   end of its range is also entered in the next one.  Blocks are made of the rare
   shingles only, so that shared passages bring no sets together: leaving the same
   shingles out of both sets adds no difference.  Empty blocks are not entered;
   there are more blocks by the number of empty ones to expect, and of any linked
   pair of which one set has no more than that an equal block is not empty.  Sets
   with more empty blocks (their shingles are nearly all common) are entered a
   second time with all their shingles, and under empty blocks too if there are
   still as many.  Which shingles count as common changes the work, not the result.
   An entry also carries, for each of the CHAIN blocks after its own, PARITY bits of
   parities and whether it is filled.  Parities of two sets differ in at most as many
   bits as their blocks do in shingles, and of any linked pair with at most d differences
   some equal block is such that, for every l, the l blocks from it on differ in at most
   l * d / m shingles together, m being the number of blocks: a cycle of numbers has a
   start from which no sum exceeds its share of the whole.  Blocks empty in both sets
   count as one difference, and raise d by their most, where they are not entered.
   Sets that share a passage and little else fail this; hardly any list ties them.
2. Groups.  In a list of at most LIST_PAIRS sets all pairs are held against the limits,
   and what hangs together is tied to its first set.  A longer list has leaders: its first set, and each set that is not within the
   limits above of a leader before it.  A set is tied to the leaders that are near
   enough for some third set to be linked with it and within the limits of the leader
   (differences add up at most; a block empty in leader and member stands for one
   difference of each from a third set).  Of a linked pair, the set that first finds a
   leader within the limits so has the other tied to it, and every linked pair has a
   common leader, its anchor; pairs (anchor, member) are made distinct, so lists that bring the same sets together cost one entry.  A list with
   more than MAX_LEADERS leaders ties what is left to one more.  Sets of a list that ties
   connect have one anchor, so a list makes no more ties than it has members.
   Near copies meet in most of their lists, and each list would tie them anew.  So the lists
   of HOMES positions (all shingles in their blocks) are read first: what they tie into a component
   that stays small is a known group, and all of it is tied to its smallest class.  A list
   that ties sets of a known group then takes that group's anchor for them and ties only the
   others to it.  Which groups are known changes the work, not the result; the largest
   of them, KNOWN_MOST classes at most, are sent to all tasks.  Groups that
   overlap are one group if they stay small together; else each anchor's group
   stands for itself.  Groups above GROUP_SETS sets or GROUP_SHINGLES shingles are cut into parts, and each
   pair of parts is a unit of work of bounded size.
3. Answers.  In a unit the sets stand in order of size.  The overlaps of a set
   with all others are derived from those of the most similar set before it: the
   index lists of the shingles that one has and the other lacks are added or
   subtracted, all others are skipped.
4. Components of the links, by star contraction over staged tables.
5. Link counts, where asked for.  A linked pair of classes may meet under several
   anchors and in several units; it is counted under the smallest common anchor
   only, and there in the one unit of its two parts, so that counts add up without
   a table of pairs.  Each set counts the copies of the other, and a document the
   other copies of its own class.

Defined cases: a null, empty or blank text has an empty set, links with nothing
and is its own component; a text of fewer than k words is one shingle; ties and
repeated rows are one class; a text of any length is taken whole.  For counts, rows
of one doc_id and text are one document, and each row without doc_id is one.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldstats.llm.store import drop, join_keyed, stage
from fieldstats.llm.text import Texts, U, distinct, fold, lists, mix, runs, slices, trim

RANGE = 1.5
GROUP_SETS = 2_048
GROUP_SHINGLES = 500_000
FILTER_BITS = 27
ENTRY = ["key", "class", "n", "sizes", "chain"]
COMMON_DOCS = 8
COMMON_MOST = 1 << 19
CHAIN = 8
PARITY = 7
FILLED = np.uint8(1 << PARITY)
MAX_LEADERS = 1_000
LIST_ROWS = 500_000
LIST_PAIRS = 64
HOMES = 8
KNOWN_MOST = 1 << 20
TIES = "anchor long, anchor_n int, class long, n int"


def size_starts(percent: int, up_to: int) -> np.ndarray:
    """First size of each size range; linked sizes lie in the same range or in neighbouring ones."""
    starts = [1]
    while starts[-1] <= up_to:
        s = starts[-1]
        starts.append(max(s + 1, -(-s * 100 // percent), int(s * RANGE)))
    return np.array(starts)


def differences(range_end: np.ndarray, percent: int) -> np.ndarray:
    """Most shingles in which linked sets below range_end can differ."""
    return (100 - percent) * 2 * (range_end - 1) // (100 + percent)


def positions(first: np.ndarray, range_end: np.ndarray, percent: int) -> np.ndarray:
    """Blocks for a size range: the fewest of which, in its smallest sets, more are filled than can differ.

    Filled blocks are counted two deviations below their mean; where no number will do, that with most to spare.
    """
    spoilt = differences(range_end, percent)[:, None]
    smallest = np.maximum(1, first * percent // 100)[:, None]
    blocks = np.ceil((spoilt + 1) * np.linspace(1, 4, 61))
    empty = np.exp(-smallest / blocks)
    spread = np.sqrt(np.maximum(0, blocks * empty * (1 - (1 + smallest / blocks) * empty)))
    spare = blocks * (1 - empty) - 2 * spread - spoilt - 1
    spare[:, 0] = np.where(spoilt[:, 0] == 0, 0, spare[:, 0])
    at = np.where((spare >= 0).any(1), (spare >= 0).argmax(1), spare.argmax(1))
    return blocks[np.arange(len(at)), at].astype(np.int64)


def ranges(percent: int, up_to: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First size, number of blocks and most differences of each size range."""
    starts = size_starts(percent, up_to)
    ends = np.append(starts[1:], starts[-1])
    return starts, positions(starts, ends, percent), differences(ends, percent)


class Sets:
    """Distinct shingles of each text, ordered by hash."""

    def __init__(self, texts: Texts, k: int) -> None:
        hashes, text, _ = texts.words().shingles(k)
        self.text, self.hashes = distinct(text, hashes)
        self.sizes = np.bincount(self.text, minlength=texts.n)
        self.first = np.concatenate([[0], np.cumsum(self.sizes)])
        with np.errstate(over="ignore"):
            total = np.concatenate([np.zeros(1, U), np.cumsum(mix(self.hashes ^ U(0xA5A5A5A5)))])
            self.classes = fold(total[self.first[1:]] - total[self.first[:-1]], self.sizes.astype(U))

    def entries(self, percent: int, chosen: np.ndarray, common: np.ndarray | None = None, homes: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Key, text, size range and parities of each index list that the chosen texts are entered in; `common` holds frequent shingles in order.

        With homes, those lists of the first HOMES positions only that are named by filled blocks.
        """
        if not len(chosen):
            return np.zeros(0, U), np.zeros(0, np.int64), np.zeros(0, np.int16), np.zeros(0, U)
        starts, blocks, most = ranges(percent, int(self.sizes[chosen].max()) * 3)
        own = np.searchsorted(starts, self.sizes[chosen], "right") - 1
        also = self.sizes[chosen] * 100 // percent >= starts[own + 1]
        texts = np.concatenate([chosen, chosen[also]])
        sizes = np.concatenate([own, own[also] + 1])
        count = blocks[sizes]
        sure = count - most[sizes]  # so many blocks of linked sets are equal
        used = np.minimum(count, HOMES + CHAIN) if homes else count
        base = np.concatenate([[0], np.cumsum(used)])
        n = self.sizes[texts]
        row = np.repeat(np.arange(len(texts)), n)
        at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(self.first[texts], n)
        hashes = self.hashes[at]
        block = ((hashes >> U(32)) * count[row].astype(U) >> U(32)).astype(np.int64)
        if homes:
            near = block < used[row]
            hashes, row, block = hashes[near], row[near], block[near]
        block += base[row]
        owner = np.repeat(np.arange(len(texts)), used)
        place = np.arange(base[-1]) - base[owner]
        name = fold(place.astype(U), sizes[owner].astype(U))

        one = np.uint8(1) << (hashes % U(PARITY)).astype(np.uint8)

        def listed(keep: np.ndarray, space: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
            """Keys, sizes and parities of all blocks, and the number of empty ones of each text."""
            ends = np.searchsorted(block[keep], np.arange(base[-1] + 1))
            with np.errstate(over="ignore"):
                total = np.concatenate([np.zeros(1, U), np.cumsum(mix(hashes[keep] + U(0x51ED2701)))])
                content = total[ends[1:]] - total[ends[:-1]]
            odd = np.concatenate([np.zeros(1, np.uint8), np.bitwise_xor.accumulate(one[keep])])
            held = np.diff(ends)
            parity = (odd[ends[1:]] ^ odd[ends[:-1]]) | np.where(held > 0, FILLED, 0).astype(np.uint8)
            return fold(content, name, held.astype(U) + U(space << 32)), held, parity, np.bincount(owner, held == 0, len(texts))

        def chains(parity: np.ndarray, at: np.ndarray) -> np.ndarray:
            """Parities of the blocks after each of `at`, in a ring, one byte each; none comes twice, what is missing differs in nothing."""
            out = np.empty((len(at), CHAIN), np.uint8)
            mine, first, ring = place[at], base[owner[at]], used[owner[at]]
            for t in range(1, CHAIN + 1):
                follows = mine + t
                out[:, t - 1] = np.where(t < ring, parity[first + np.where(follows >= ring, np.maximum(follows - ring, 0) % ring, follows)], FILLED)
            return out.view(U).ravel()

        rare = np.ones(len(hashes), bool)
        if common is not None and len(common):
            rare = common[np.minimum(np.searchsorted(common, hashes), len(common) - 1)] != hashes
        keys, held, parity, empty = listed(rare, 0)
        kept = np.flatnonzero((held > 0) & (place < HOMES) if homes else held > 0)
        out = [(keys[kept], owner[kept], chains(parity, kept))]
        thin = empty >= sure
        if thin.any() and not homes:
            keys, held, parity, empty = listed(np.ones(len(hashes), bool), 1)
            bare = (empty >= sure)[owner]
            kept = np.flatnonzero(thin[owner] & ((held > 0) | bare))
            parity = np.where(bare, parity | FILLED, parity)  # empty blocks of these are entered, so they do not count
            out.append((keys[kept], owner[kept], chains(parity, kept)))
        keys, owner, chain = (np.concatenate(x) for x in zip(*out, strict=True))
        return keys, texts[owner], sizes[owner].astype(np.int16), chain


def unsent(sets: Sets, sent: set[int]) -> np.ndarray:
    """Texts whose set is not empty and of a class not sent before, one of each class."""
    chosen = []
    for t in np.flatnonzero(sets.sizes):
        if (c := int(sets.classes[t])) not in sent:
            sent.add(c)
            chosen.append(t)
    return np.array(chosen, np.int64)


def classes(docs: DataFrame, k: int, percent: int) -> DataFrame:
    """doc_id, n_shingles and class of each document, and of one document of each class in a task the home lists: key, sizes and chain of each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent: set[int] = set()
        for batch, texts in slices(batches):
            sets = Sets(texts, k)
            keys, owner, sizes, chain = sets.entries(percent, unsent(sets, sent), homes=True)
            order = np.argsort(owner, kind="stable")
            homes = [lists(x[order], owner[order], texts.n, kind) for x, kind in ((keys, pa.int64()), (sizes, pa.int16()), (chain, pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets.sizes, pa.int64()), pa.array(sets.classes.view(np.int64)), *homes], ["doc_id", "n_shingles", "class", "key", "sizes", "chain"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_shingles long, class long, key array<long>, sizes array<smallint>, chain array<long>")


def common_shingles(texts: DataFrame, k: int) -> np.ndarray:
    """Shingles in at least COMMON_DOCS texts, the most frequent COMMON_MOST at most; each task counts its own, rare ones fall out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts = np.zeros(0, U), np.zeros(0, np.int64)
        for _, part in slices(batches):
            new, n = np.unique(Sets(part, k).hashes, return_counts=True)
            good = (n > 1) | np.isin(new, keys)
            both, count = np.concatenate([keys, new[good]]), np.concatenate([counts, n[good]])
            order = np.argsort(both, kind="stable")
            both, count = both[order], count[order]
            first = np.flatnonzero(np.append(True, both[1:] != both[:-1])) if len(both) else np.zeros(0, np.int64)
            keys, counts = both[first], np.add.reduceat(count, first) if len(first) else count
            if len(keys) > COMMON_MOST:
                top = np.sort(np.argpartition(counts, -COMMON_MOST)[-COMMON_MOST:])
                keys, counts = keys[top], counts[top]
        good = counts > 1
        yield pa.RecordBatch.from_arrays([pa.array(keys[good].view(np.int64)), pa.array(counts[good])], ["shingle", "n"])

    found = texts.mapInArrow(run, "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("n")).filter(F.col("n") >= COMMON_DOCS)
    rows = found.orderBy(F.desc("n"), "shingle").limit(COMMON_MOST).select("shingle").toArrow()
    return np.sort(rows.column("shingle").to_numpy().view(U)) if rows.num_rows else np.zeros(0, U)


def _entries(k: int, percent: int, common):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent: set[int] = set()
        for _, texts in slices(batches):
            sets = Sets(texts, k)
            keys, owner, sizes, chain = sets.entries(percent, unsent(sets, sent), common.value)
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(sets.classes[owner].view(np.int64)), pa.array(sets.sizes[owner].astype(np.int32)), pa.array(sizes), pa.array(chain.view(np.int64))], ENTRY)

    return run


@dataclass
class Known:
    """Classes in order, each tied to the anchor of its group, and the anchor's size."""

    classes: np.ndarray
    anchors: np.ndarray
    sizes: np.ndarray

    def of(self, classes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Anchor of each class and its size, which is 0 where none is known."""
        if not len(self.classes):
            return np.zeros(len(classes), np.int64), np.zeros(len(classes), np.int32)
        at = np.minimum(np.searchsorted(self.classes, classes), len(self.classes) - 1)
        found = self.classes[at] == classes
        return np.where(found, self.anchors[at], 0), np.where(found, self.sizes[at], 0)


@dataclass
class Entries:
    """Rows of index lists, in the order of their keys; those with an anchor were leaders among the rows before."""

    key: np.ndarray
    classes: np.ndarray
    n: np.ndarray
    sizes: np.ndarray
    chain: np.ndarray
    anchor: np.ndarray | None = None
    anchor_n: np.ndarray | None = None

    def __post_init__(self) -> None:
        if self.anchor is None:
            self.anchor, self.anchor_n = np.zeros(len(self.key), np.int64), np.zeros(len(self.key), np.int32)

    def columns(self, rows=slice(None)) -> list[np.ndarray]:
        return [x[rows] for x in (self.key, self.classes, self.n, self.sizes, self.chain, self.anchor, self.anchor_n)]

    def near(self, rows: np.ndarray, leaders: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
        """Which rows are within the limits of their leader, and which may be linked with a row that is."""
        _, blocks, most = ranges(percent, int(self.n.max(initial=1)) * 3)
        one, two = (self.chain[x].view(np.uint8).reshape(-1, CHAIN) for x in (rows, leaders))
        differ = np.maximum(np.bitwise_count((one ^ two) & ~FILLED), (one ^ two) >> PARITY)
        empty = (~(one | two)) >> PARITY
        small, large = (f(self.n[rows], self.n[leaders]).astype(np.int64) for f in (np.minimum, np.maximum))
        m = blocks[self.sizes[rows]]
        spare = m - most[self.sizes[rows]] - 1  # most blocks that are empty in both
        length = np.arange(2, CHAIN + 2)
        limit = length * ((100 - percent) * (small + large) // (100 + percent) + spare)[:, None] // m[:, None]
        within = (np.cumsum(differ + empty, axis=1) <= limit).all(1) & (100 * small >= percent * large)
        third = small * 100 // percent  # the largest set linked with both
        limit = length * ((100 - percent) * (small + large + 2 * third) // (100 + percent) + 2 * spare)[:, None] // m[:, None]
        return within, (np.cumsum(differ + 2 * empty, axis=1) <= limit).all(1) & (10_000 * small >= percent**2 * large)

    def ties(self, percent: int, goes_on: tuple[bool, bool] = (False, False), known: Known | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Rows of anchor and member of each tie; goes_on: whether the first list has rows before these, the last one rows after them.

        What hangs together among these rows is tied to its first row.  A row that is tied
        to leaders of before has their anchors too: `anchor` is set in those leaders and
        in the new ones.  If a row of them is in a known group, that group's anchor stands
        for the first row, and only the rows of other groups are tied to it.
        """
        first = runs(self.key)
        length = np.diff(np.append(first, len(self.key)))
        long = length > LIST_PAIRS
        long[:1] |= goes_on[0]
        long[-1:] |= goes_on[1]
        one, other, leads = self.led(np.flatnonzero(np.repeat(long, length)), percent)
        old = self.anchor_n[one] > 0
        before = one[old], other[old]
        new_one, new_other = self.alike(first[~long], length[~long], percent, known)
        root = connected(np.append(one[~old], new_one), np.append(other[~old], new_other), len(self.key))
        tied = np.flatnonzero(root != np.arange(len(root)))
        new = np.flatnonzero(leads & (self.anchor_n == 0))
        name, name_n = self.classes.copy(), self.n.copy()
        if known is not None:
            rows = np.concatenate([np.unique(np.append(root[tied], root[new])), tied])
            group, group_n = known.of(self.classes[rows])
            rows, group, group_n = (x[group_n > 0] for x in (rows, group, group_n))
            firsts, at = np.unique(root[rows], return_index=True)
            name[firsts], name_n[firsts] = group[at], group_n[at]
        firsts = np.unique(root[tied])
        new = np.append(new, firsts)
        self.anchor[new], self.anchor_n[new] = name[root[new]], name_n[root[new]]
        renamed = firsts[name[firsts] != self.classes[firsts]]
        anchors, members = np.concatenate([before[0], root[tied], renamed]), np.concatenate([before[1], tied, renamed])
        self.leads = leads
        return anchors, members

    def named(self, anchors: np.ndarray, members: np.ndarray, known: Known | None = None) -> list[np.ndarray]:
        """anchor, anchor_n, class and n of ties, each once and none of a class to itself or, as that is known, to the anchor of its group."""
        begun = self.anchor_n[anchors] > 0
        anchor = np.where(begun, self.anchor[anchors], self.classes[anchors])
        anchor_n = np.where(begun, self.anchor_n[anchors], self.n[anchors])
        member = self.classes[members]
        at = np.flatnonzero(anchor != member)
        if known is not None:
            group, group_n = known.of(member[at])
            at = at[(group_n == 0) | (group != anchor[at])]
        at = at[np.unique(fold(anchor[at].view(U), member[at].view(U)), return_index=True)[1]]
        return [anchor[at], anchor_n[at], member[at], self.n[members][at]]

    def alike(self, first: np.ndarray, length: np.ndarray, percent: int, known: Known | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of rows within the limits and not of one known group, of whole lists of which all pairs are held against them."""
        ones, others = [first[:0]], [first[:0]]
        for n in np.unique(length[length > 1]):
            i, j = np.triu_indices(n, 1)
            at = first[length == n]
            for part in np.array_split(at, len(at) * len(i) // LIST_ROWS + 1):
                one, other = ((part[:, None] + x).ravel() for x in (i, j))
                within = (self.classes[one] == self.classes[other]) | self.near(one, other, percent)[0]
                one, other = one[within], other[within]
                if known is not None:
                    (group, group_n), (group_2, group_n2) = known.of(self.classes[one]), known.of(self.classes[other])
                    new = (group_n == 0) | (group_n2 == 0) | (group != group_2)
                    one, other = one[new], other[new]
                ones.append(one)
                others.append(other)
        return np.concatenate(ones), np.concatenate(others)

    def led(self, left: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ties to leaders.  One of every list is taken at a time, the first that no leader covers yet, and held against the others not yet covered."""
        leads = np.zeros(len(self.key), bool)
        anchors, members = [left[:0]], [left[:0]]
        for turn in range(MAX_LEADERS + 1):
            first = runs(self.key[left])
            leads[left[first]] = True
            of = np.repeat(left[first], np.diff(np.append(first, len(left))))
            rest = of != left
            member, leader = left[rest], of[rest]
            if not len(member):
                break
            covered, tied = self.near(member, leader, percent) if turn < MAX_LEADERS else (np.ones(len(member), bool),) * 2
            same = self.classes[member] == self.classes[leader]
            anchors.append(leader[tied | same])
            members.append(member[tied | same])
            left = member[~(covered | same)]
        return np.concatenate(anchors), np.concatenate(members), leads


def connected(one: np.ndarray, other: np.ndarray, n: int) -> np.ndarray:
    """Smallest number reachable from each of 0 to n-1 by the pairs."""
    root, before = np.arange(n), None
    while before is None or (root != before).any():
        before = root.copy()
        least = np.minimum(root[one], root[other])
        np.minimum.at(root, root[one], least)
        np.minimum.at(root, root[other], least)
        np.minimum.at(root, one, least)
        np.minimum.at(root, other, least)
        root = root[root]
    return root


def _anchor(percent: int, known=None):
    """Ties of entries that come ordered by key, `known` being a broadcast of groups.  A short list waits until it is whole; of a long one its leaders are kept."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = Entries(*(np.zeros(0, t) for t in (np.int64, np.int64, np.int32, np.int16, np.int64)))
        led = False

        def step(held: list[list[np.ndarray]], last: bool) -> pa.RecordBatch:
            nonlocal kept, led
            new = [np.concatenate(x) for x in zip(*held, strict=True)] if held else kept.columns(slice(0, 0))[:5]
            rows = Entries(*(np.concatenate(x) for x in zip(kept.columns(), Entries(*new).columns(), strict=True)))
            begun, goes_on = led, np.zeros(len(rows.key), bool) if last or not len(rows.key) else rows.key == rows.key[-1]
            waits = goes_on.any() and goes_on.sum() <= LIST_PAIRS and not (begun and goes_on.all())
            if waits:
                kept, rows = Entries(*rows.columns(goes_on)), Entries(*rows.columns(~goes_on))
            anchors, members = rows.ties(percent, (begun, bool(goes_on.any()) and not waits), known and known.value)
            named = rows.named(anchors, members, known and known.value)
            if not waits:
                kept = Entries(*rows.columns(rows.leads & goes_on))
            led = not waits
            return pa.RecordBatch.from_arrays([pa.array(x) for x in named], ["anchor", "anchor_n", "class", "n"])

        held: list[list[np.ndarray]] = []
        rows = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append([batch.column(i).to_numpy() for i in range(5)])
            rows += batch.num_rows
            if rows >= LIST_ROWS:
                yield step(held, False)
                held, rows = [], 0
        yield step(held, True)
        trim()

    return run


def _bitmap(ids: DataFrame) -> np.ndarray:
    """Bit table of the ids, of 8 slots or more for each up to 2**FILTER_BITS; a slot may be shared, so it lets some others through and drops none."""
    ids = ids.distinct()
    bits = min(FILTER_BITS, max(16, (8 * ids.count()).bit_length()))
    slot = F.pmod(F.col("class"), F.lit(1 << bits))
    words = ids.groupBy((slot / 32).cast("int").alias("word")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(pmod(class, {1 << bits}) % 32 as int))")).alias("bits")).toArrow()
    out = np.zeros(1 << (bits - 5), np.uint32)
    out[words.column("word").to_numpy()] = words.column("bits").to_numpy()
    return out


def _sets(k: int, shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent: set[int] = set()
        for _, texts in slices(batches):
            sets = Sets(texts, k)
            slot = np.mod(sets.classes.view(np.int64), 32 * len(shared.value))
            wanted = (shared.value[slot // 32] >> (slot % 32)) & 1
            chosen = [t for t in np.flatnonzero((wanted > 0) & (sets.sizes > 0)) if int(sets.classes[t]) not in sent]
            chosen = list({int(sets.classes[t]): t for t in chosen}.values())
            sent.update(int(sets.classes[t]) for t in chosen)
            values = [sets.hashes[sets.first[t] : sets.first[t + 1]] for t in chosen]
            owner = np.repeat(np.arange(len(chosen)), [len(v) for v in values]) if chosen else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(sets.classes[chosen].view(np.int64) if chosen else np.zeros(0, np.int64)), lists(np.concatenate(values) if chosen else np.zeros(0, U), owner, len(chosen), pa.int64())], ["class", "shingles"])

    return run


def overlaps(sets: list[np.ndarray]) -> Iterator[tuple[int, np.ndarray]]:
    """For each set in turn its overlap with all sets, derived from the most similar set before it."""
    names, coded = np.unique(np.concatenate(sets), return_inverse=True)
    sizes = np.array([len(s) for s in sets])
    cuts = np.cumsum(sizes)[:-1]
    own = np.split(coded, cuts)
    member = np.repeat(np.arange(len(sets)), sizes)
    order = np.argsort(coded, kind="stable")
    member = member[order].astype(np.int32)
    start = np.searchsorted(coded[order], np.arange(len(names) + 1))
    rows = np.zeros((len(sets), len(sets)), np.int32)

    def read(tokens: np.ndarray) -> np.ndarray:
        n = start[tokens + 1] - start[tokens]
        at = np.repeat(start[tokens] - np.cumsum(n) + n, n) + np.arange(n.sum())
        return np.bincount(member[at], minlength=len(sets))

    for y, tokens in enumerate(own):
        x = int(rows[:y, y].argmax()) if y else -1
        if x >= 0 and 2 * rows[x, y] > sizes[y]:
            rows[y] = rows[x] + read(np.setdiff1d(tokens, own[x], assume_unique=True)) - read(np.setdiff1d(own[x], tokens, assume_unique=True))
        else:
            rows[y] = read(tokens)
        yield y, rows[y]


class Owner:
    """Which pairs a unit counts: those without a smaller common anchor and, where two parts meet, those across them."""

    def __init__(self, anchor: int, anchors: np.ndarray, sizes: np.ndarray, part: np.ndarray, across: bool) -> None:
        earlier = anchors < anchor
        member = np.repeat(np.arange(len(sizes)), sizes)[earlier]
        names, code = np.unique(anchors[earlier], return_inverse=True)
        several = np.bincount(code, minlength=len(names)) > 1
        member, code = member[several[code]], (np.cumsum(several) - 1)[code[several[code]]]
        self.bits = np.zeros((len(sizes), (int(several.sum()) + 7) // 8), np.uint8)
        np.bitwise_or.at(self.bits, (member, code >> 3), (1 << (code & 7)).astype(np.uint8))
        self.part, self.across = part, across

    def __call__(self, one: int, others: np.ndarray) -> np.ndarray:
        own = ~(self.bits[others] & self.bits[one]).any(1)
        return own & (self.part[others] != self.part[one]) if self.across else own


def links(ids: np.ndarray, sets: list[np.ndarray], percent: int, copies: np.ndarray | None = None, owner: Owner | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Smallest id of each set's component here, and its number of linked copies over the pairs that `owner` leaves to count."""
    order = np.argsort([len(s) for s in sets], kind="stable")
    sets = [sets[i] for i in order]
    sizes = np.array([len(s) for s in sets])
    root = np.arange(len(sets))
    copies = np.ones(len(sets), np.int64) if copies is None else copies
    degree = np.zeros(len(sets), np.int64)
    for y, common in overlaps(sets):
        linked = np.flatnonzero(100 * common[:y] >= percent * (sizes[:y] + sizes[y] - common[:y]))
        if len(linked):
            one, others = order[y], order[linked]
            if owner is not None:
                others = others[owner(one, others)]
            degree[one] += copies[others].sum()
            degree[others] += copies[one]
            joined = np.unique(np.append(root[linked], root[y]))
            root[np.isin(root, joined)] = joined[0]
    best = np.full(len(sets), np.iinfo(np.int64).max)
    np.minimum.at(best, root, ids[order])
    label = np.empty(len(sets), np.int64)
    label[order] = best[root]
    return label, degree


def components(edges: DataFrame) -> DataFrame:
    """class and label (smallest class of its component) by alternating large-star and small-star rounds."""
    edges = stage(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a != b").distinct(), "edges")
    while not _stars(edges):
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a != b").distinct()
        large = stage(large, "large")
        drop(edges)
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a")
        small = small.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b"))).filter("a != b").distinct()
        edges = stage(small, "small")
        drop(large)
    return edges.select(F.col("a").alias("class"), F.col("b").alias("label"))


def _stars(edges: DataFrame) -> bool:
    """Whether each a has one b, and no b is an a."""
    several = edges.groupBy("a").count().filter("count > 1").limit(1).count()
    return not several and not edges.join(edges.select(F.col("b").alias("a")), "a", "left_semi").limit(1).count()


def tied(entries: DataFrame, percent: int, known=None) -> DataFrame:
    """anchor, anchor_n, class and n of the ties of index lists."""
    pairs = entries.repartition("key").sortWithinPartitions("key", "class").mapInArrow(_anchor(percent, known), TIES)
    return pairs.distinct()


def small_groups(ties: DataFrame) -> DataFrame:
    """label, class, n and number of sets of the tied classes whose component stays small; the label is its smallest class."""
    whole = components(ties.select(F.col("anchor").alias("a"), F.col("class").alias("b")))
    found = ties.select("class", "n").unionByName(ties.select(F.col("anchor").alias("class"), F.col("anchor_n").alias("n"))).distinct()
    members_of = found.join(whole, "class", "left").select(F.coalesce("label", "class").alias("label"), "class", "n")
    small = members_of.groupBy("label").agg(F.count("*").alias("sets"), F.sum("n").alias("size")).filter((F.col("sets") <= GROUP_SETS) & (F.col("size") <= GROUP_SHINGLES)).select("label", "sets")
    return members_of.join(small, "label")


def home_groups(members: DataFrame, percent: int) -> tuple[DataFrame, Known]:
    """Ties of each class of a small group found in the home lists to the group's smallest class, and the groups themselves, the largest first, KNOWN_MOST classes at most."""
    homes = members.select("class", F.col("n_shingles").cast("int").alias("n"), F.inline(F.arrays_zip("key", "sizes", "chain"))).select(*ENTRY).distinct()
    first = stage(tied(homes, percent), "home-ties")
    groups = small_groups(first)
    heads = groups.filter("class = label").select("label", F.col("n").alias("anchor_n"))
    stars = stage(groups.join(heads, "label").select(F.col("label").alias("anchor"), "anchor_n", "class", "n", "sets"), "home-groups")
    drop(first)
    known = stars.orderBy(F.desc("sets"), "anchor").limit(KNOWN_MOST).select("class", "anchor", "anchor_n").toArrow()
    columns = [column.to_numpy() for column in known.columns]
    order = np.argsort(columns[0])
    return stars.filter("class != anchor").drop("sets"), Known(*(x[order] for x in columns))


def join(docs: DataFrame, k: int = 5, percent: int = 80, counts: bool = False) -> DataFrame:
    """doc_id, n_shingles, component_id of every document; with counts also n_links, the number of documents linked to it."""
    context = docs.sparkSession.sparkContext
    texts = docs.select(F.col("doc_id").cast("long"), "text")
    members = stage(classes(docs, k, percent), "classes")
    some = F.col("n_shingles") > 0
    copies = F.countDistinct("doc_id") + F.count_if(F.col("doc_id").isNull()) if counts else F.lit(1)
    own = members.filter(some).groupBy("class").agg(F.min("doc_id").alias("first"), F.count("*").alias("rows"), copies.alias("copies"))
    common = context.broadcast(common_shingles(texts, k))  # at most COMMON_MOST numbers
    stars, known = home_groups(members, percent)
    entries = texts.mapInArrow(_entries(k, percent, common), "key long, class long, n int, sizes smallint, chain long")
    ties = stage(tied(entries, percent, context.broadcast(known)).unionByName(stars).distinct(), "anchors")
    found = ties.select("anchor", "class", "n").unionByName(ties.select("anchor", F.col("anchor").alias("class"), F.col("anchor_n").alias("n")).distinct())
    as_one = stage(small_groups(ties).select(F.col("label").alias("anchor"), "class", "n"), "small-groups")
    groups = stage(as_one.unionByName(found.join(as_one.select("class"), "class", "left_anti").select("anchor", "class", "n")), "groups")
    parts = groups.groupBy("anchor").agg(F.greatest(F.ceil(F.count("*") / GROUP_SETS), F.ceil(F.sum("n") / GROUP_SHINGLES)).cast("int").alias("parts"))
    part = F.pmod(F.xxhash64("class", "anchor"), F.col("parts")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    units = groups.join(parts, "anchor").withColumn("part", part).withColumn("other", other)
    units = units.select("anchor", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"), "class", *(["part"] if counts else []))
    wanted = context.broadcast(_bitmap(groups.select("class")))
    sets = texts.mapInArrow(_sets(k, wanted), "class long, shingles array<long>").dropDuplicates(["class"])
    if counts:
        own = stage(own, "copies")
        sets = sets.join(groups.groupBy("class").agg(F.collect_set("anchor").alias("anchors")), "class").join(own.select("class", "copies"), "class")

    def solve(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        column = table.column("shingles").combine_chunks()
        flat = column.flatten().to_numpy()
        sizes = column.value_lengths().to_numpy()
        values = np.split(flat, np.cumsum(sizes)[:-1])
        ids = table.column("class").to_numpy()
        weights = owner = None
        if counts:
            weights, anchors = table.column("copies").to_numpy(), table.column("anchors").combine_chunks()
            i, j, anchor = (table.column(name)[0].as_py() for name in ("i", "j", "anchor"))
            owner = Owner(anchor, anchors.flatten().to_numpy(), anchors.value_lengths().to_numpy(), table.column("part").to_numpy(), i != j)
        label, degree = links(ids, values, percent, weights, owner)
        if len(flat) > 100_000:
            trim()
        kept = (label != ids) | (degree > 0) if counts else label != ids
        columns = {"a": ids, "b": label} | ({"n": degree} if counts else {})
        return pa.table({name: pa.array(x[kept], pa.int64()) for name, x in columns.items()})

    schema = "a long, b long, n long" if counts else "a long, b long"
    edges = stage(units.join(sets, "class").groupBy("anchor", "i", "j").applyInArrow(solve, schema), "links")
    for table in (ties, as_one, groups):
        drop(table)
    # one row for each class from here on, so that large classes weigh no more than others
    own = own.join(components(edges), "class", "left").withColumn("label", F.coalesce("label", "class"))
    if counts:
        degrees = edges.groupBy(F.col("a").alias("class")).agg(F.sum("n").alias("n"))
        own = own.join(degrees, "class", "left").withColumn("n_links", F.coalesce("n", F.lit(0)) + F.col("copies") - 1)
    linked = ["n_links"] if counts else []
    own = stage(own.select("class", "label", "first", "rows", *linked), "labels")
    smallest = stage(own.groupBy("label").agg(F.min("first").alias("component_id"), F.count("*").alias("held")).filter("held > 1"), "components")
    own = join_keyed(own, smallest, "label", "held").withColumn("component_id", F.coalesce("component_id", "first"))
    out = join_keyed(members.filter(some), stage(own.select("class", "component_id", "rows", *linked), "class-components"), "class", "rows")
    alone = [F.lit(0).cast("long").alias("n_links")] if counts else []
    return out.select("doc_id", "n_shingles", "component_id", *linked).unionByName(members.filter(~some).select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"), *alone))


def dedupe(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """docs with one document, that of the smallest doc_id, of each component.

    Rows without doc_id cannot be told apart and stay; a row given twice under one
    doc_id stays or goes as one document.
    """
    kept = join(docs, k, percent).filter("doc_id = component_id").select("doc_id")
    return docs.join(kept, "doc_id", "left_semi").select(*docs.columns).unionByName(docs.filter("doc_id is null"))
