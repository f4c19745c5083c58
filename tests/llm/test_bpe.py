import hashlib
import random

import numpy as np
import pytest

tokenizers = pytest.importorskip("tokenizers")
P = pytest.importorskip("public_tokenizers")

from fieldstats.llm import bpe, encoding, token_counts  # noqa: E402

PATH = P.path("byte_bpe_50k.json")
PIECES = ["a", "e", "the", "ing", " ", "  ", "\n", "é", "ü", "1", "23", "!", "--", "===", "Ã", "　", "漢", "🙂", "\x00", "'s", "'ll", "tion", "<|endoftext|>", "A", "\t", "_"]


@pytest.fixture(scope="module")
def library():
    return tokenizers.Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(3)
    made = ["".join(rng.choice(PIECES) for _ in range(rng.randrange(60))) for _ in range(400)]
    return [*made, "", "a" * 4000, "ab" * 2000, "=" * 3000, "<|endoftext|>", "<|endoftext|", made[0]]


def test_trie_and_merges_equal_the_library(library, texts):
    vocab = bpe.vocabulary(bpe.read_vocabulary(PATH))
    encoder = encoding.Encoder(vocab)
    got = encoder.encode(texts)
    for t, ids, e in zip(texts, got, library.encode_batch(texts, add_special_tokens=False), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == e.ids
        assert encoder.decode(ids) == library.decode(e.ids, skip_special_tokens=False) == t
    counts = token_counts.Counts(vocab, vocab.whole_tokens())
    assert [sum(map(counts.__getitem__, vocab.pieces(t))) for t in texts] == [len(g) // 4 for g in got]


def test_memo_limit_changes_nothing(monkeypatch, texts):
    vocab = bpe.vocabulary(bpe.read_vocabulary(PATH))
    whole = encoding.Encoder(vocab).encode(texts)
    monkeypatch.setattr(encoding, "MEMO", 20)
    small = encoding.Encoder(vocab)
    assert [small.encode([t])[0] for t in texts] == whole


def test_whole_tokens_are_proved():
    vocab = bpe.vocabulary(bpe.read_vocabulary(PATH))
    whole = vocab.whole_tokens()
    assert len(whole) > 40_000
    assert all(len(vocab.merge(w.encode())) == 1 for w in random.Random(0).sample(whole, 500))


def test_other_files_are_refused():
    with pytest.raises(ValueError):
        bpe.Vocabulary(open(P.path("word_bpe_49k.json"), "rb").read())


def test_operators(spark, make_docs, library, texts):
    docs = make_docs([None, *texts[:60], *texts[-6:]])
    plain = {r.doc_id: r.text or "" for r in docs.collect()}
    ids = {i: library.encode(t, add_special_tokens=False).ids for i, t in plain.items()}
    for r in encoding.digests(docs, PATH).collect():
        assert r.n_tokens == len(ids[r.doc_id])
        assert r.ids_sha256 == hashlib.sha256(np.array(ids[r.doc_id], "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(plain[r.doc_id].encode()).hexdigest()
    encoded = encoding.encode(docs, PATH)
    assert {r.doc_id: r.ids for r in encoded.collect()} == ids
    assert {r.doc_id: r.text for r in encoding.decode(encoded, PATH).collect()} == plain
    for r in token_counts.count(docs, PATH, 10).collect():
        assert (r.n_tokens, r.n_bytes, r.over_limit) == (len(ids[r.doc_id]), len(plain[r.doc_id].encode()), len(ids[r.doc_id]) > 10)
    assert encoding.digests(docs.limit(0), PATH).count() == 0 and token_counts.count(docs.limit(0), PATH).count() == 0
