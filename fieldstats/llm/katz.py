"""Language-model scoring with Katz back-off.

p(w)   = d(c(w)) c(w) / N                              for words of the training texts
p(unk) = what the discounts leave                      for all other words together
p(w|h) = d(c(hw)) c(hw) / C(h)                         if the pair occurs in training
p(w|h) = a(h) p(w)                                     otherwise; a(h) = 1 for a new history

d are Good-Turing discounts for counts up to K, from the counts of counts of the
order concerned.  C(h) is the history's count, plus 1 where the history occurs OFTEN
times or has no follower that occurs once, so that every history leaves mass; this
does not depend on the size of the corpus.  a(h)
divides what a history leaves by the mass of the words it was not followed by,
so that p(.|h) sums to 1 exactly.  A text is its words and one end token; the
history of its first token is a start mark.

Work is in three exchanges of packed numpy arrays rather than rows of single
n-grams (a row of three longs costs four times the bytes):

A. Blocks of texts send, for each history, its followers with training counts
   and the texts they occur in to the history's part.  A part knows all counts
   of its histories, so it adds up the share of each text that occurs in it there
   and then; only unseen pairs of held-out texts are left over.  Shares are at most
   as many as tokens, however many parts there are; ids go one way once a block.  Histories with more than
   1/HOT of all tokens and more than OFTEN, at most HOT by count, the start mark
   among them, are spread over several parts by their follower; their counts come
   with the broadcast list of them.  Pairs above the same limits are counted in a pass
   of their own, at most HOT of them: blocks know their counts, so they add up such
   pairs' shares themselves and send none of their occurrences.
B. Parts ask the unigram table for the counts of the words they hold.
C. Parts add up the followers' unigram mass for a(h), and finish the left-over
   pairs.

Tables kept: unigrams (word, n), bigrams by part, back-off weights by history.

Defined cases: a null or empty text is one end token; repeated rows each count;
a word of any length is one word; without training texts all mass is on the
unknown word; a row without doc_id is scored but not learnt from.  Words are told apart by 64-bit hashes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldstats.llm.store import release, stage
from fieldstats.llm.text import U, mix, runs, slices, trim

K = 5
HOT = 1_000
OFTEN = 1_000
BLOCK_TOKENS = 1_000_000
BLOCK_TEXTS = 20_000
PART_TOKENS = 2_000_000
SLICE = 65_536
START = U(0x9D5B_31C7_04E2_A6F1)
END = U(0x3E0F_7AC5_9912_D84B)
NO_ID = -(1 << 63)

PACKED = "part int, kind int, block long, a binary, b binary, c binary, d binary, e binary, f binary, counts array<long>"
_NAMES = ["part", "kind", "block", "a", "b", "c", "d", "e", "f", "counts"]
_TYPES = [pa.int32(), pa.int32(), pa.int64(), *[pa.binary()] * 6, pa.list_(pa.int64())]


def planes(values: np.ndarray) -> bytes:
    """Bytes of an integer array, all lowest bytes first: high zero bytes then compress away."""
    return values.view(np.uint8).reshape(len(values), values.itemsize).T.tobytes()


def unplanes(data: bytes, kind) -> np.ndarray:
    kind = np.dtype(kind)
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(kind.itemsize, -1).T).view(kind).ravel()


def packed(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True) if rows else [()] * 10, _TYPES, strict=True)], _NAMES)


def sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    return np.add.reduceat(values, first) if len(first) else values[:0]


@dataclass
class Discounts:
    """Good-Turing discounts d(1..K) and the mass left to the unknown word."""

    factor: np.ndarray

    @classmethod
    def of(cls, counts: list[int]) -> Discounts:
        """From n(1..K+1); with fewer usable counts a smaller K, with none d(1) = 1/2."""
        for k in range(K, 0, -1):
            n = [float(x) for x in counts[: k + 1]]
            if min(n) <= 0:
                continue
            common = (k + 1) * n[k] / n[0]
            d = [((r + 1) * n[r] / n[r - 1] / r - common) / (1 - common) if common < 1 else 2 for r in range(1, k + 1)]
            if all(0 < x < 1 for x in d):
                return cls(np.array([1.0, *d, *[1.0] * (K - k + 1)]))
        return cls(np.array([1.0, 0.5, *[1.0] * K]))

    def __call__(self, counts: np.ndarray) -> np.ndarray:
        return self.factor[np.minimum(counts, K + 1)]


def places(keys: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Where each value stands in sorted keys, or -1."""
    if not len(keys):
        return np.full(len(values), -1)
    at = np.minimum(np.searchsorted(keys, values), len(keys) - 1)
    return np.where(keys[at] == values, at, -1)


def tokens(sizes: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """History and word of each token of texts with so many words."""
    ends = np.cumsum(sizes + 1) - 1
    w = np.empty(len(words) + len(sizes), U)
    inner = np.ones(len(w), bool)
    inner[ends] = False
    w[inner], w[ends] = words, END
    h = np.empty(len(w), U)
    h[1:], h[:1] = w[:-1], START
    h[ends[:-1] + 1] = START
    return h, w


@dataclass
class Shape:
    """What every task needs to know; hot and pairs have at most HOT entries each."""

    parts: int
    hot: np.ndarray
    hot_counts: np.ndarray
    total: int
    pairs: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    pair_counts: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))

    def hot_at(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = places(self.hot, h)
        return at >= 0, np.where(at >= 0, self.hot_counts[at], 0) if len(self.hot) else np.zeros(len(h), np.int64)

    def code(self, h: np.ndarray, w: np.ndarray) -> np.ndarray:
        """Number of a pair of two hot words, -1 for all others; the end follows as often as the start leads."""
        out = np.full(len(h), -1, np.int64)
        first = places(self.hot, h)
        some = np.flatnonzero(first >= 0)
        second = places(self.hot, np.where(w[some] == END, START, w[some]))
        out[some[second >= 0]] = (first[some] * len(self.hot) + second)[second >= 0]
        return out

    def pair_table(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """History, follower and total of the history for each hot pair."""
        n = max(1, len(self.hot))
        w = self.hot[self.pairs % n]
        return self.hot[self.pairs // n], np.where(w == START, END, w), self.hot_counts[self.pairs // n] + 1

    def route(self, h: np.ndarray, w: np.ndarray) -> np.ndarray:
        """Where a pair goes: by its history, for hot ones by history and a share of the followers."""
        is_hot, count = self.hot_at(h)
        ways = np.maximum(1, 4 * count * self.parts // max(1, self.total)).astype(U)
        with np.errstate(over="ignore"):
            return np.where(is_hot, mix(h + U(0x9E3779B97F4A7C15) * (U(1) + mix(w) % ways)), mix(h))

    def part(self, route: np.ndarray) -> np.ndarray:
        return ((route >> U(32)) * U(self.parts) >> U(32)).astype(np.int64)


def trained(folds: int, held_out: int) -> Column:
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds != held_out


def unigrams(docs: DataFrame) -> DataFrame:
    """word and n of the training texts, end tokens included; each task sends its own sums."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts = np.zeros(0, U), np.zeros(0, np.int64)
        held: list[np.ndarray] = []
        size = texts_seen = 0

        def merged() -> tuple[np.ndarray, np.ndarray]:
            new, n = np.unique(np.concatenate(held), return_counts=True) if held else (keys[:0], counts[:0])
            k, c = np.concatenate([keys, new]), np.concatenate([counts, n])
            order = np.argsort(k)
            k, c = k[order], c[order]
            first = runs(k)
            return k[first], sums(c, first)

        for _, texts in slices(batches):
            held.append(texts.words().hashes)
            size += len(held[-1])
            texts_seen += texts.n
            if size > 2_000_000:
                keys, counts = merged()
                held, size = [], 0
                if len(keys) > 1_000_000:
                    yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(counts)], ["word", "n"])
                    keys, counts = keys[:0], counts[:0]
        keys, counts = merged()
        if texts_seen:
            keys, counts = np.append(keys, END), np.append(counts, texts_seen)
        yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(counts)], ["word", "n"])

    return docs.filter("train").select("text").mapInArrow(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _hot_pairs(shape: Shape):
    """code and n of the pairs of hot words in a task's texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(len(shape.hot) ** 2, np.int64)
        for _, texts in slices(batches):
            words = texts.words()
            code = shape.code(*tokens(words.counts, words.hashes))
            counts += np.bincount(code[code >= 0], minlength=len(counts))
        found = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(counts[found])], ["code", "n"])
        del counts
        trim()

    return run


def _blocks(shape: Shape):
    """Exchange A, sending side."""
    pair_history, _, pair_full = shape.pair_table()
    pair_seen = np.log10(np.maximum(1, shape.pair_counts)) - np.log10(pair_full)
    pair_real = pair_history != START
    pair_base = np.where(pair_real, np.log10(pair_full - 0.5), 0)

    def flush(block: int, ids: np.ndarray, train: np.ndarray, sizes: np.ndarray, words: np.ndarray) -> pa.RecordBatch:
        h, w = tokens(sizes, words)
        doc = np.repeat(np.arange(len(ids), dtype=np.uint16), sizes + 1)
        hot = np.empty(len(h), np.int32)
        for a in range(0, len(h), SLICE):  # the temporary arrays of a block stay small
            hot[a : a + SLICE] = places(shape.pairs, shape.code(h[a : a + SLICE], w[a : a + SLICE]))
        cold = hot < 0
        doc_hot, hot = doc[~cold], hot[~cold]
        shares = [np.bincount(doc_hot, x[hot], len(ids)) for x in (pair_base, pair_seen, pair_real)]
        h, w, doc = h[cold], w[cold], doc[cold]
        del hot, cold, doc_hot
        n = len(h)
        route = shape.route(h, w)
        order = np.lexsort((w, route))
        h, w, doc, route = h[order], w[order], doc[order], route[order]
        pair = runs(h, w)
        occurs = np.diff(np.append(pair, n)).astype(np.uint32)
        count = sums(train[doc].astype(np.int64), pair).astype(np.uint32)
        part = shape.part(route[pair])
        cuts = np.searchsorted(part, np.arange(shape.parts + 1))
        rows = [(block % shape.parts, 6, block, ids.tobytes(), train.tobytes(), shares[0].tobytes(), shares[1].tobytes(), planes(shares[2].astype(np.uint32)), None, None)]
        for p in np.flatnonzero(np.diff(cuts)):
            a, b = cuts[p], cuts[p + 1]
            at = pair[a:b]
            history = runs(h[at])
            length = np.diff(np.append(history, len(at))).astype(np.uint32)
            stop = pair[b] if b < len(pair) else n
            names, local = np.unique(doc[at[0] : stop], return_inverse=True)
            rows.append((int(p), 0, block, planes(names), h[at[history]].tobytes() + planes(length), w[at].tobytes(), planes(count[a:b]), planes(occurs[a:b]), planes(local.astype(np.uint16)), None))
        return packed(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 24
        held: list[tuple] = []
        size = texts_held = 0
        for batch, texts in slices(batches):
            words = texts.words()
            for a in range(0, texts.n, BLOCK_TEXTS):
                b = min(a + BLOCK_TEXTS, texts.n)
                if held and texts_held + b - a > BLOCK_TEXTS:  # numbers of texts fit into 16 bits
                    yield flush(block, *(np.concatenate(x) for x in zip(*held, strict=True)))
                    held, size, texts_held, block = [], 0, 0, block + 1
                hashes = words.hashes[words.first[a] : words.first[b]]
                held.append((batch.column(0).to_numpy()[a:b], batch.column(2).to_numpy(zero_copy_only=False)[a:b], words.counts[a:b], hashes))
                size += len(hashes)
                texts_held += b - a
            if size > BLOCK_TOKENS:
                yield flush(block, *(np.concatenate(x) for x in zip(*held, strict=True)))
                held, size, texts_held, block = [], 0, 0, block + 1
        if held:
            yield flush(block, *(np.concatenate(x) for x in zip(*held, strict=True)))
        del held
        trim()

    return run


def _counted(shape: Shape):
    """Exchange A, receiving side: kinds 0 sums of the texts that occur in the part, 1 bigram table, 2 left-over pairs; 6 is handed on."""

    def run(table: pa.Table) -> pa.Table:
        part = table.column("part")[0].as_py()
        kind = table.column("kind").to_numpy()
        named = table.take(np.flatnonzero(kind == 6)).cast(packed([]).schema)
        at = np.flatnonzero(kind == 0)
        if not len(at):
            return named
        blocks = [table.column("block")[i].as_py() for i in at]
        rows = [{name: table.column(name)[i].as_buffer() for name in "abcdef"} for i in at]  # views, not copies
        lens = [r["c"].size // 8 for r in rows]
        hs, ws, cs = [], [], []
        for r in rows:
            m = r["b"].size // 12
            hs.append(np.repeat(np.frombuffer(r["b"], U, m), unplanes(r["b"][8 * m :], np.uint32)))
            ws.append(np.frombuffer(r["c"], U))
            cs.append(unplanes(r["d"], np.uint32))
        h, w, c = np.concatenate(hs), np.concatenate(ws), np.concatenate(cs)
        del hs, ws, cs
        order = np.lexsort((w, h))
        h, w, c = h[order], w[order], c[order]
        pair = runs(h, w)
        ph, pw, pc = h[pair], w[pair], sums(c.astype(np.int64), pair)
        history = runs(ph)
        length = np.diff(np.append(history, len(ph)))
        is_hot, hot_count = shape.hot_at(ph[history])
        ch = np.where(is_hot, hot_count, sums(pc, history))
        ones = sums((pc == 1).astype(np.int64), history)
        full = ch + ((ch >= OFTEN) | (ones == 0))
        of_pair = np.repeat(np.arange(len(history)), length)
        base = np.where(ph[history] == START, 0, np.log10(ch + 0.5))
        known = (ch > 0) & (ph[history] != START)
        with np.errstate(divide="ignore"):
            seen = np.where(pc > 0, np.log10(pc) - np.log10(full[of_pair]), 0)
        back = np.empty(len(order), np.int32)
        back[order] = np.repeat(np.arange(len(pair), dtype=np.int32), np.diff(np.append(pair, len(order))))
        del h, w, c, order
        out, left, start = [], [], 0
        for block, r, n in zip(blocks, rows, lens, strict=True):
            docs = r["a"].size // 2
            names = unplanes(r["a"], np.uint16)
            mine = np.repeat(back[start : start + n], unplanes(r["e"], np.uint32))
            start += n
            doc = unplanes(r["f"], np.uint16)
            hist = of_pair[mine]
            total = lambda x, doc=doc, docs=docs: np.bincount(doc, x, docs)
            by_count = np.bincount(doc.astype(np.int64) * (K + 2) + np.minimum(pc[mine], K + 1), minlength=docs * (K + 2)).astype(np.uint32)
            real = (ph[history] != START)[hist]
            out.append((part, 0, block, r["a"].to_pybytes(), total(base[hist]).tobytes(), total(seen[mine]).tobytes(), planes(total(known[hist]).astype(np.uint32)), planes(by_count), planes(total(real).astype(np.uint32)), None))
            new = np.flatnonzero(pc[mine] == 0)
            left.append((mine[new], (block << 16) + names[doc[new]].astype(np.int64)))
        held = np.flatnonzero(pc > 0)
        hh = runs(ph[held])
        n_of = np.bincount(np.minimum(pc[held], K + 2), minlength=K + 3)[1 : K + 2]
        out.append((part, 1, 0, ph[held][hh].tobytes(), planes(np.diff(np.append(hh, len(held))).astype(np.uint32)), pw[held].tobytes(), planes(pc[held].astype(np.uint64)), planes(full[of_pair[held][hh]].astype(np.uint64)), None, n_of.tolist()))
        mine, ids = (np.concatenate(x) for x in zip(*left, strict=True))
        order = np.argsort(mine, kind="stable")
        mine, ids = mine[order], ids[order]
        # the weight of a history without training counts is 1; such pairs are marked by the start mark
        out.append((part, 2, 0, np.where(ch[of_pair[mine]] > 0, ph[mine], START ^ U(1)).tobytes(), pw[mine].tobytes(), ids.tobytes(), None, None, None, None))
        done = pa.concat_tables([pa.Table.from_batches([packed(out)]), named])
        del rows, out, ph, pw, pc, back, mine, ids
        trim()
        return done

    return run


def _pair_row(shape: Shape) -> pa.Table:
    """The hot pairs as one more row of the bigram table, in part 0; none of them counts K + 1 or less."""
    h, w, full = shape.pair_table()
    first = runs(h)
    length = np.diff(np.append(first, len(h))).astype(np.uint32)
    row = (0, 1, 0, h[first].tobytes(), planes(length), w.tobytes(), planes(shape.pair_counts.astype(np.uint64)), planes(full[first].astype(np.uint64)), None, [0] * (K + 1))
    return pa.Table.from_batches([packed([row])])


def _wanted(parts: int):
    """Exchange B, sending side: distinct words of a part by the word's part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                words = np.unique(np.frombuffer(r["c"] if r["kind"] == 1 else r["b"], U))
                to = ((mix(words) >> U(32)) * U(parts) >> U(32)).astype(np.int64)
                order = np.argsort(to, kind="stable")
                cuts = np.searchsorted(to[order], np.arange(parts + 1))
                yield packed([(int(p), 3, r["part"] * 4 + r["kind"], words[order[cuts[p] : cuts[p + 1]]].tobytes(), *[None] * 6) for p in np.flatnonzero(np.diff(cuts))])

    return run


def _answer(asked: pa.Table, found: pa.Table) -> pa.Table:
    """Exchange B, answering side; kind tells for which of the part's rows."""
    words = found.column("word").to_numpy().view(U)
    counts = found.column("n").to_numpy()
    order = np.argsort(words)
    words, counts = words[order], counts[order]
    out = []
    for r in asked.select(["block", "a"]).to_pylist():
        want = np.frombuffer(r["a"], U)
        at = np.minimum(np.searchsorted(words, want), max(0, len(words) - 1))
        n = np.where(words[at] == want, counts[at], 0) if len(words) else np.zeros(len(want), np.int64)
        out.append((r["block"] // 4, r["block"] % 4 + 10, 0, r["a"], planes(n.astype(np.uint64)), *[None] * 5))
    return pa.Table.from_batches([packed(out)])


def _finish(total: int, unknown: float, uni: Discounts, bi: Discounts):
    """Exchange C: kinds 4 sums by history, 5 left-over pairs by text."""

    def probability(words: np.ndarray, answers: list[dict]) -> np.ndarray:
        if not answers:
            return np.full(len(words), unknown)
        keys = np.concatenate([np.frombuffer(r["a"], U) for r in answers])
        counts = np.concatenate([unplanes(r["b"], np.uint64) for r in answers]).astype(np.int64)
        order = np.argsort(keys)
        keys, counts = keys[order], counts[order]
        n = counts[np.searchsorted(keys, words)]
        return np.where(n > 0, uni(n) * n / max(1, total), unknown)

    def run(table: pa.Table) -> pa.Table:
        part = table.column("part")[0].as_py()
        rows = table.to_pylist()
        out = []
        for r in rows:
            if r["kind"] == 1:
                h, length = np.frombuffer(r["a"], U), unplanes(r["b"], np.uint32).astype(np.int64)
                p = probability(np.frombuffer(r["c"], U), [x for x in rows if x["kind"] == 11])
                c, full = unplanes(r["d"], np.uint64).astype(np.int64), unplanes(r["e"], np.uint64).astype(np.int64)
                first = np.cumsum(length) - length
                given = sums(bi(c) * c, first) / full
                out.append((part, 4, 0, h.tobytes(), given.tobytes(), sums(p, first).tobytes(), *[None] * 4))
            if r["kind"] == 2:
                h, w, ids = (np.frombuffer(r[x], k) for x, k in (("a", U), ("b", U), ("c", np.int64)))
                p = np.log10(probability(w, [x for x in rows if x["kind"] == 12]))
                out.append((part, 5, 0, h.tobytes(), p.tobytes(), ids.tobytes(), *[None] * 4))
        return pa.Table.from_batches([packed(out)])

    return run


def _weights(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for r in batch.to_pylist():
            yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(r["a"], np.int64)), pa.array(np.frombuffer(r["b"], np.float64)), pa.array(np.frombuffer(r["c"], np.float64))], ["history", "given", "mass"])


def _left_histories(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each part and history: texts with their number of left-over pairs and sums."""
    for batch in batches:
        for r in batch.to_pylist():
            h, p, ids = np.frombuffer(r["a"], U), np.frombuffer(r["b"], np.float64), np.frombuffer(r["c"], np.int64)
            order = np.lexsort((ids, h))
            h, p, ids = h[order], p[order], ids[order]
            cell = runs(h, ids)
            n, p = np.diff(np.append(cell, len(h))), sums(p, cell)
            h, ids = h[cell], ids[cell]
            cuts = np.arange(0, len(h), 5_000)  # rows of bounded length, whatever the history
            first = np.unique(np.concatenate([runs(h), cuts])) if len(h) else cuts
            ends = np.append(first, len(h)).astype(np.int32)
            make = lambda x, ends=ends: pa.ListArray.from_arrays(pa.array(ends), pa.array(x))
            yield pa.RecordBatch.from_arrays([pa.array(h[first].view(np.int64)), make(ids), make(n.astype(np.int64)), make(p)], ["history", "ids", "n", "p"])


def _left_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lens = batch.column(1).value_lengths().to_numpy()
        ids, n, p = (batch.column(i).flatten().to_numpy() for i in (1, 2, 3))
        value = p + n * np.repeat(batch.column(0).to_numpy(), lens)
        names, at = np.unique(ids, return_inverse=True)
        yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(np.bincount(at, value, len(names)))], ["text", "left"])


def _text_sums(table: pa.Table) -> pa.Table:
    """Sums over all parts for the texts of one block."""
    rows = table.to_pylist()
    name = next(r for r in rows if r["kind"] == 6)
    ids, train = np.frombuffer(name["a"], np.int64), np.frombuffer(name["b"], np.uint8).astype(bool)
    docs = len(ids)
    base, seen = np.frombuffer(name["c"], np.float64).copy(), np.frombuffer(name["d"], np.float64).copy()
    real = unplanes(name["e"], np.uint32).astype(np.int64)
    known = real.copy()
    by_count = np.zeros((docs, K + 2), np.int64)
    for r in rows:
        if r["kind"] == 0:
            at = unplanes(r["a"], np.uint16)  # each text once
            base[at] += np.frombuffer(r["b"], np.float64)
            seen[at] += np.frombuffer(r["c"], np.float64)
            known[at] += unplanes(r["d"], np.uint32)
            by_count[at] += unplanes(r["e"], np.uint32).reshape(-1, K + 2)
            real[at] += unplanes(r["f"], np.uint32)
    counts = pa.ListArray.from_arrays(pa.array(np.arange(docs + 1, dtype=np.int32) * (K + 2)), pa.array(by_count.ravel()))
    return pa.table({"text": pa.array((name["block"] << 16) + np.arange(docs)), "doc_id": pa.array(ids), "train": pa.array(train), "base": pa.array(base), "seen": pa.array(seen), "known": pa.array(known), "words": pa.array(real), "by_count": counts})


@dataclass
class Model:
    """Discounts, sizes and the staged tables of a fitted model."""

    unigrams: DataFrame
    counted: DataFrame
    bigrams: DataFrame
    backoff: DataFrame
    uni: Discounts
    bi: Discounts
    total: int
    types: int
    unknown: float


def fit_and_score(docs: DataFrame, folds: int = 5, held_out: int = 1) -> tuple[Model, DataFrame]:
    """Learn from the texts outside the held-out fold and score all texts."""
    spark = docs.sparkSession
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id"), "text", F.coalesce(trained(folds, held_out), F.lit(False)).alias("train"))
    words = stage(unigrams(rows), "unigrams")
    figures = words.agg(F.sum("n"), F.count("*"), *[F.count(F.when(F.col("n") == r, 1)) for r in range(1, K + 2)]).first()
    total, types = figures[0] or 0, figures[1]
    uni = Discounts.of(list(figures[2:]))
    less = sum((1 - uni.factor[r]) * r * figures[1 + r] for r in range(1, K + 1))
    unknown = less / total if total else 1.0
    if not unknown > 0:  # no word occurs at most K times
        unknown = 1 / (total + 1)
    hot = words.filter(F.col("n") > max(total / HOT, OFTEN)).collect()  # each follower of the start mark begins a text, so it is as frequent as END
    hot = sorted((int(START) if r.word == int(END.view(np.int64)) else int(np.int64(r.word).view(U)), r.n) for r in hot)
    shape = Shape(max(8, math.ceil(total / PART_TOKENS)), np.array([h for h, _ in hot], U), np.array([n for _, n in hot], np.int64), total)
    pairs = rows.filter("train").select("text").mapInArrow(_hot_pairs(shape), "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))
    pairs = sorted((r.code, r.n) for r in pairs.filter(F.col("n") > max(total / HOT, OFTEN)).collect()) if hot else []
    shape = replace(shape, pairs=np.array([x for x, _ in pairs], np.int64), pair_counts=np.array([n for _, n in pairs], np.int64))
    release(spark)
    counted = rows.select("doc_id", "text", F.col("train").cast("byte").alias("train")).mapInArrow(_blocks(shape), PACKED)
    counted = stage(counted.groupBy("part").applyInArrow(_counted(shape), PACKED), "bigrams", "kind")
    release(spark)
    bigrams, left = (counted.filter(x).select(*_NAMES) for x in ("kind = 1", "kind in (1, 2)"))
    if pairs:
        hot_pairs = spark.createDataFrame(_pair_row(shape), PACKED)
        bigrams, left = bigrams.unionByName(hot_pairs), left.unionByName(hot_pairs)
    n_of = bigrams.select(*[F.sum(F.element_at("counts", r)) for r in range(1, K + 2)]).first()
    bi = Discounts.of([x or 0 for x in n_of])
    asked = left.mapInArrow(_wanted(shape.parts), PACKED)
    found = words.mapInArrow(_word_parts(shape.parts), "part int, word long, n long")
    answers = asked.groupBy("part").cogroup(found.groupBy("part")).applyInArrow(_answer, PACKED)
    merged = left.unionByName(answers)
    finished = stage(merged.groupBy("part").applyInArrow(_finish(total, unknown, uni, bi), PACKED), "finished", "kind")
    release(spark)
    sums_of = finished.filter("kind = 4").mapInArrow(_weights, "history long, given double, mass double").groupBy("history").agg(F.sum("given").alias("given"), F.sum("mass").alias("mass"))
    backoff = stage(sums_of.select("history", ((1 - F.col("given")) / (1 - F.col("mass"))).alias("weight")), "backoff")
    over = finished.filter("kind = 5").mapInArrow(_left_histories, "history long, ids array<long>, n array<long>, p array<double>")
    over = over.join(backoff, "history", "left").select(F.coalesce(F.log10("weight"), F.lit(0.0)).alias("weight"), "ids", "n", "p")
    over = over.mapInArrow(_left_texts, "text long, left double").groupBy("text").agg(F.sum("left").alias("left"))
    texts = counted.filter("kind in (0, 6)").groupBy("block").applyInArrow(_text_sums, "text long, doc_id long, train boolean, base double, seen double, known long, words long, by_count array<long>")
    ends = words.filter(F.col("word") == int(END.view(np.int64))).first()
    ends = ends.n if ends else 0
    scale = math.log10(total + 0.5 * (types + 1))
    discount = sum((F.element_at("by_count", r + 1) * float(np.log10(bi.factor[r])) for r in range(1, K + 1)), F.lit(0.0))
    n = F.col("words") + 1
    shares = texts.join(over, "text", "left")
    scored = shares.select(F.when(F.col("doc_id") != NO_ID, F.col("doc_id")).alias("doc_id"), (~F.col("train")).alias("held_out"), n.alias("n_tokens"), (F.col("known") + int(ends > 0)).alias("n_known"), F.lit(total).cast("long").alias("train_tokens"), (F.col("base") + math.log10(ends + 0.5) - n * scale).alias("base_score"), (F.col("seen") + discount + F.coalesce("left", F.lit(0.0))).alias("score"))
    return Model(words, counted, bigrams, backoff, uni, bi, total, types, unknown), scored


def _word_parts(parts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = batch.column(0).to_numpy().view(U)
            part = ((mix(words) >> U(32)) * U(parts) >> U(32)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(part), batch.column(0), batch.column(1)], ["part", "word", "n"])

    return run


def score(docs: DataFrame, folds: int = 5, held_out: int = 1) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of each document."""
    return fit_and_score(docs, folds, held_out)[1]
