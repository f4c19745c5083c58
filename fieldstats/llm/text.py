"""Vectorised tokenising of Arrow string batches.

A batch of texts is one byte buffer plus offsets, so words, lines and n-grams
of all its texts are found with a handful of numpy passes instead of a Python
loop.  Words are runs of bytes outside space and \\x09-\\x0D; UTF-8 keeps those
byte values for ASCII only, so byte runs equal code-point runs.

Hashes are 64-bit polynomial hashes of the bytes, finalised by a multiply-xor
mix.  They depend on nothing but the bytes: no process seed, no batch borders.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BATCH_BYTES = 1_000_000

_libc = ctypes.CDLL(None)

U = np.uint64
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_BYTES = np.random.Generator(np.random.PCG64(20240607)).integers(1, 1 << 63, 256).astype(U) * U(2) + U(1)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_powers: list[np.ndarray] = [np.ones(1, U), np.ones(1, U)]


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash base and of its inverse, at least n of them."""
    if len(_powers[0]) < n:
        size = 1 << int(n - 1).bit_length()
        with np.errstate(over="ignore"):
            for i, base in enumerate((_BASE, _INVERSE)):
                steps = np.full(size, base, U)
                steps[0] = 1
                _powers[i] = np.multiply.accumulate(steps)
    return _powers[0], _powers[1]


def mix(x: np.ndarray) -> np.ndarray:
    """Spread every input bit over all 64 output bits."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> U(31))) * U(0xD6E8FEB86659FD93)
        x = (x ^ (x >> U(29))) * U(0xC2B2AE3D27D4EB4F)
        return x ^ (x >> U(32))


def fold(*parts: np.ndarray) -> np.ndarray:
    """Hash of a sequence of hashes; the order of the parts counts."""
    with np.errstate(over="ignore"):
        out = np.full(len(parts[0]), len(parts), U)
        for p in parts:
            out = mix(out * U(_BASE) + p)
        return out


class Texts:
    """Texts of one batch: `raw` bytes and `offsets` (one more than texts)."""

    def __init__(self, raw: np.ndarray, offsets: np.ndarray) -> None:
        self.raw, self.offsets, self.n = raw, offsets, len(offsets) - 1
        self.sizes = np.diff(offsets)

    def lowered(self) -> np.ndarray:
        return _LOWER[self.raw]

    def sums(self, per_byte: np.ndarray) -> np.ndarray:
        """Sum of a per-byte count for each text."""
        total = np.zeros(len(per_byte) + 1, np.int64)
        np.cumsum(per_byte, out=total[1:])
        return total[self.offsets[1:]] - total[self.offsets[:-1]]

    def runs(self, separator: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts, ends and text numbers of maximal runs without a separator byte."""
        inside = ~separator
        if not len(inside):
            return (np.zeros(0, np.int64),) * 3
        before = np.empty(len(inside), bool)
        before[0], before[1:] = False, inside[:-1]
        cuts = self.offsets[:-1][self.sizes > 0]
        before[cuts] = False
        starts = np.flatnonzero(inside & ~before)
        after = np.empty(len(inside), bool)
        after[-1], after[:-1] = False, inside[1:]
        after[cuts[1:] - 1] = False
        ends = np.flatnonzero(inside & ~after) + 1
        return starts, ends, np.searchsorted(self.offsets, starts, "right") - 1

    def words(self, lower: bool = True) -> Words:
        data = self.lowered() if lower else self.raw
        starts, ends, text = self.runs(_SPACE[data])
        return Words(self, starts, ends, text, span_hashes(data, starts, ends))


class Words:
    """Words of a batch in text order."""

    def __init__(self, texts: Texts, starts: np.ndarray, ends: np.ndarray, text: np.ndarray, hashes: np.ndarray) -> None:
        self.texts, self.starts, self.ends, self.text, self.hashes = texts, starts, ends, text, hashes
        self.counts = np.bincount(text, minlength=texts.n)
        self.first = np.concatenate([[0], np.cumsum(self.counts)])

    def shingles(self, k: int, short: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Hash, text and first word of each run of k words; with `short`, a text of 1 to k-1 words is one shingle."""
        n = len(self.hashes)
        at = np.arange(max(0, n - k + 1))
        at = at[self.text[at] == self.text[at + k - 1]] if len(at) else at
        hashes = fold(*(self.hashes[at + i] for i in range(k))) if len(at) else np.zeros(0, U)
        text = self.text[at]
        if short and (few := np.flatnonzero((self.counts > 0) & (self.counts < k))).size:
            tails = np.array([fold(*(self.hashes[self.first[t] + i : self.first[t] + i + 1] for i in range(self.counts[t])))[0] for t in few], U)
            order = np.argsort(np.concatenate([text, few]), kind="stable")
            hashes, text, at = (np.concatenate(x)[order] for x in ((hashes, tails), (text, few), (at, self.first[few])))
        return hashes, text, at


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of the byte spans [start, end)."""
    if not len(starts):
        return np.zeros(0, U)
    up, down = _power_tables(len(data) + 1)
    with np.errstate(over="ignore"):
        total = np.zeros(len(data) + 1, U)
        np.cumsum(_BYTES[data] * up[: len(data)], out=total[1:])
        return mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(U))


def texts_of(column: pa.Array) -> Texts:
    """View of an Arrow string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if offsets is not None and len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return Texts(raw[offsets[0] : offsets[-1]], offsets - offsets[0])


def parts(texts: Texts, size: int = BATCH_BYTES) -> Iterator[tuple[Texts, int]]:
    """Runs of whole texts of about `size` bytes, with the number of their first text."""
    start = 0
    while start < texts.n:
        end = int(np.searchsorted(texts.offsets, texts.offsets[start] + size, "right")) - 1
        end = min(max(end, start + 1), texts.n)
        at = texts.offsets[start : end + 1]
        yield Texts(texts.raw[at[0] : at[-1]], at - at[0]), start
        start = end


def slices(batches: Iterator[pa.RecordBatch], text: str = "text", size: int = BATCH_BYTES) -> Iterator[tuple[pa.RecordBatch, Texts]]:
    """Cut record batches so that each holds about `size` bytes of text; a longer single text stays whole."""
    for batch in batches:
        column = batch.column(batch.schema.get_field_index(text))
        for part, start in parts(texts_of(column), size):
            yield batch.slice(start, part.n), part
    trim()


def trim() -> None:
    """Give freed work arrays back to the system; workers live on between tasks."""
    pa.default_memory_pool().release_unused()
    if hasattr(_libc, "malloc_trim"):
        _libc.malloc_trim(0)


def runs(*keys: np.ndarray) -> np.ndarray:
    """First places of runs of equal keys."""
    new = np.ones(len(keys[0]), bool)
    if len(new):
        new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    return np.flatnonzero(new)


def distinct(text: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (text, hash) pairs, sorted by text, then hash."""
    order = np.lexsort((hashes, text))
    text, hashes = text[order], hashes[order]
    keep = np.ones(len(text), bool)
    keep[1:] = (text[1:] != text[:-1]) | (hashes[1:] != hashes[:-1])
    return text[keep], hashes[keep]


def lists(values: np.ndarray, text: np.ndarray, n: int, kind: pa.DataType) -> pa.Array:
    """List column of n rows from values that are ordered by their row number."""
    ends = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=n))]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values.view(np.int64) if values.dtype == U else values, kind))
