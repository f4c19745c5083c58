import random
import re

import numpy as np
import pyarrow as pa

from fieldstats.llm.text import parts, texts_of

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SAMPLES = ["", None, " ", "a", "A b\tc", "été  Été", "x" * 5000, "a\x0bb\x0cc\rd\n", "　wide　space", "\x00\x1f odd", "ß ẞ I İ"]


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)


def test_words_equal_the_pattern():
    rng = random.Random(1)
    texts = SAMPLES + ["".join(rng.choice("aB é\n\t.0漢") for _ in range(rng.randrange(40))) for _ in range(300)]
    batch = texts_of(pa.array(texts))
    words = batch.words()
    seen = {}
    at = 0
    for t, n in zip(texts, words.counts, strict=True):
        want = WORD.findall(lower(t or ""))
        assert len(want) == n
        for w in want:
            seen.setdefault(w, set()).add(int(words.hashes[at]))
            at += 1
    assert all(len(h) == 1 for h in seen.values()) and len(set.union(*seen.values())) == len(seen)


def test_hashes_do_not_depend_on_the_batch():
    whole = texts_of(pa.array(["one two", "three one"])).words().hashes
    assert (whole[:2] == texts_of(pa.array(["one two"])).words().hashes).all()
    assert (whole[2:] == texts_of(pa.array([None, "three one"])).words().hashes).all()
    sliced = texts_of(pa.array(["zero", "one two", "three one"]).slice(1))
    assert (sliced.words().hashes == whole).all()


def test_shingles_and_short_texts():
    batch = texts_of(pa.array(["a b c d", "a b", "", "a b c", "b c d"]))
    hashes, text, _ = batch.words().shingles(3)
    assert text.tolist() == [0, 0, 1, 3, 4]
    assert hashes[0] == hashes[3] and hashes[1] == hashes[4] and hashes[2] not in hashes[[0, 1]]


def test_parts_keep_texts_whole():
    batch = texts_of(pa.array(["a" * n for n in (5, 50, 0, 7, 100)]))
    found = list(parts(batch, 20))
    assert sum(p.n for p, _ in found) == 5 and [s for _, s in found] == sorted(s for _, s in found)
    assert np.concatenate([p.sizes for p, _ in found]).tolist() == [5, 50, 0, 7, 100]
