"""Byte-level BPE vocabularies and encoding of distinct words over a prefix trie.

The file is read on the driver and its bytes are broadcast (a vocabulary is a
few MB at most, see MAX_FILE); workers build the tables once per process.

Encoding rests on two facts of BPE.  A token sequence is an encoding exactly if
each neighbouring pair is one, so the encoding of a prefix is known from its last
token: dropping that token leaves the encoding of the shorter prefix.  And among
the tokens that end a prefix exactly one fits after the last token of what is
left.  So the distinct words of a batch are put in sorted order, which is the
depth-first order of their trie, and one last-token state is kept per trie node
on the current path: a prefix that words share is encoded once.

Supported files: BPE models with the byte-level pre-tokeniser and decoder, without
normaliser, prefix space or dropout; others raise ValueError.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterable
from pathlib import Path

import regex

#: The published split pattern of byte-level BPE.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
MAX_FILE = 64_000_000


def read_vocabulary(path: str) -> bytes:
    data = Path(path).read_bytes()
    if len(data) > MAX_FILE:
        raise ValueError(f"vocabulary of {len(data)} bytes; at most {MAX_FILE} are broadcast")
    return data


def byte_letters() -> dict[str, int]:
    """The letter by which vocabulary files write each byte: itself if printable Latin-1, else the next from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Vocabulary:
    """Tables of one vocabulary file."""

    def __init__(self, data: bytes) -> None:
        file = json.loads(data)
        model, before = file["model"], file.get("pre_tokenizer") or {}
        if model.get("type") != "BPE" or before.get("type") != "ByteLevel" or before.get("add_prefix_space") or file.get("normalizer") or model.get("dropout") or model.get("ignore_merges") or not before.get("use_regex", True):
            raise ValueError("only plain byte-level BPE files are supported")
        if any(t["normalized"] or t["lstrip"] or t["rstrip"] or t["single_word"] for t in file["added_tokens"]):
            raise ValueError("added tokens with stripping, normalising or word rules are not supported")
        letters = byte_letters()
        to_bytes = lambda token: b"".join(bytes([letters[c]]) if c in letters else c.encode() for c in token)
        self.special = {t["content"]: t["id"] for t in file["added_tokens"]}
        self.ids = {to_bytes(t): i for t, i in model["vocab"].items() if t not in self.special}
        self.bytes = [b""] * (1 + max(max(self.ids.values()), *self.special.values(), 0))
        for b, i in self.ids.items():
            self.bytes[i] = b
        for t, i in self.special.items():
            self.bytes[i] = to_bytes(t)
        self.single = [self.ids[bytes([b])] for b in range(256)]
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        self.parts: dict[int, tuple[int, int]] = {}
        self.rank = {}
        for n, pair in enumerate(model["merges"]):
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            left, right = self.ids[to_bytes(left)], self.ids[to_bytes(right)]
            made = self.ids[self.bytes[left] + self.bytes[right]]
            self.merges[left, right] = (n, made)
            if made not in self.parts:
                self.parts[made], self.rank[made] = (left, right), n
        self.split = regex.compile(PATTERN).findall
        self.special_split = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")").split if self.special else None
        self.longest: dict[bytes, int] = {}
        for b in self.ids:
            if len(b) > 1:
                self.longest[b[-2:]] = max(self.longest.get(b[-2:], 0), len(b))
        self.fits: dict[int, bool] = {}

    def pieces(self, text: str) -> list[str]:
        """Pre-tokens of a text; special strings are pieces of their own."""
        if self.special_split and any(s in text for s in self.special):
            out = []
            for i, part in enumerate(self.special_split(text)):
                out += [part] if i % 2 else self.split(part)
            return out
        return self.split(text)

    def merge(self, word: bytes) -> list[int]:
        """Encoding by merging the lowest-ranked pair, leftmost first, from a heap."""
        ids = [self.single[b] for b in word]
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        merges = self.merges
        heap = [(*m, i) for i in range(n - 1) if (m := merges.get((ids[i], ids[i + 1])))]
        heap = [(rank, i, made) for rank, made, i in heap]
        heapq.heapify(heap)
        while heap:
            rank, i, made = heapq.heappop(heap)
            j = after[i]
            if ids[i] < 0 or j >= n or merges.get((ids[i], ids[j]), (-1,))[0] != rank:
                continue
            ids[i], ids[j] = made, -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if m := merges.get((made, ids[k])):
                    heapq.heappush(heap, (m[0], i, m[1]))
            if (h := before[i]) >= 0 and (m := merges.get((ids[h], made))):
                heapq.heappush(heap, (m[0], h, m[1]))
        return [t for t in ids if t >= 0]

    def whole_tokens(self) -> list[str]:
        """Strings that are proved, by merging them, to encode alone as one token."""
        out = []
        for b, i in self.ids.items():
            if self.merge(b) == [i]:
                try:
                    out.append(b.decode())
                except UnicodeDecodeError:
                    pass
        return out

    def fit(self, left: int, right: int) -> bool:
        """Whether left, right is the encoding of their joint bytes.

        Undo the merges of both tokens from the latest on; a merge across the
        border that comes before the one undone last would have been made.
        """
        merges, parts, rank = self.merges, self.parts, self.rank
        a, b, never = left, right, 1 << 60
        limit = never
        while True:
            across = merges.get((a, b))
            if across is not None and across[0] < limit:
                return False
            rank_a, rank_b = rank.get(a, -1), rank.get(b, -1)
            if rank_a < 0 and rank_b < 0:
                return True
            if rank_a > rank_b:
                limit, a = rank_a, parts[a][1]
            else:
                limit, b = rank_b + 1, parts[b][0]

    def encode_words(self, words: Iterable[bytes]) -> dict[bytes, list[int]]:
        """Encodings of distinct words by one depth-first walk over their trie."""
        ids, fits, longest, size = self.ids, self.fits, self.longest, len(self.bytes)
        single, lengths = self.single, [len(b) for b in self.bytes]
        out: dict[bytes, list[int]] = {}
        last = [-1]  # last[d]: last token of the encoding of the path's first d bytes
        path = b""
        if len(fits) > 2_000_000:
            fits.clear()
        for word in sorted(words):
            shared, most = 0, min(len(path), len(word))
            if path[:most] == word[:most]:
                shared = most
            else:
                while path[shared] == word[shared]:
                    shared += 1
            del last[shared + 1 :]
            for d in range(shared + 1, len(word) + 1):
                n = longest.get(word[d - 2 : d], 1) if d > 1 else 1
                n = min(n, d)
                while True:
                    token = ids.get(word[d - n : d], -1) if n > 1 else single[word[d - 1]]
                    if token >= 0:
                        left = last[d - n]
                        if left < 0:
                            if d == n and (self.fits_alone(token)):
                                break
                        else:
                            key = left * size + token
                            ok = fits.get(key)
                            if ok is None:
                                ok = fits[key] = self.fit(left, token)
                            if ok:
                                break
                    n -= 1
                    if not n:
                        raise AssertionError(f"no token ends {word[:d]!r}")
                last.append(token)
            path = word
            d, tokens = len(word), []
            while d:
                tokens.append(last[d])
                d -= lengths[last[d]]
            tokens.reverse()
            out[word] = tokens
        return out

    def fits_alone(self, token: int) -> bool:
        """Whether the token's own bytes encode to it."""
        key = -1 - token
        ok = self.fits.get(key)
        if ok is None:
            ok = self.fits[key] = self.merge(self.bytes[token]) == [token]
        return ok


_loaded: dict[bytes, Vocabulary] = {}


def vocabulary(data: bytes) -> Vocabulary:
    """Tables for the file's bytes, built once per process."""
    key = data
    if key not in _loaded:
        _loaded.clear()
        _loaded[key] = Vocabulary(data)
    return _loaded[key]
