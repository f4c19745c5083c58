"""Back-off of any order against the model written down in dictionaries."""

import math
import random
from collections import Counter, defaultdict

import pytest

from fieldstats.llm import backoff, katz
from tests.llm.test_katz import corpus, discounts

END, START = "\n", "\n\n"


class Plain:
    def __init__(self, texts, order):
        self.order, self.c = order, [Counter() for _ in range(order)]
        for w in texts:
            line = [START] * (order - 1) + w + [END]
            for i in range(order - 1, len(line)):
                for k in range(1, order + 1):
                    self.c[k - 1][tuple(line[i - k + 1 : i + 1])] += 1
        self.d = [discounts(Counter(c.values())) for c in self.c]
        self.n = sum(self.c[0].values())
        self.unknown = sum((1 - self.d[0].get(c, 1)) * c for c in self.c[0].values()) / self.n if self.n else 1.0
        self.unknown = self.unknown if self.unknown > 0 else 1 / (self.n + 1)
        self.after = defaultdict(list)
        for c in self.c[1:]:
            for g in c:
                self.after[g[:-1]].append(g[-1])

    def full(self, h):
        n = [self.c[len(h)][(*h, w)] for w in self.after[h]]
        return sum(n) + (1 not in n)

    def p(self, h, w):
        n = self.c[len(h)].get((*h, w), 0)
        if not h:
            return self.d[0].get(n, 1) * n / self.n if n else self.unknown
        if n:
            return self.d[len(h)].get(n, 1) * n / self.full(h)
        if h not in self.after:
            return self.p(h[1:], w)
        given, mass = (sum(self.p(g, v) for v in self.after[h]) for g in (h, h[1:]))
        return (1 - given) / (1 - mass) * self.p(h[1:], w)

    def score(self, w):
        line = [START] * (self.order - 1) + w + [END]
        return sum(math.log10(self.p(tuple(line[i - self.order + 1 : i]), line[i])) for i in range(self.order - 1, len(line)))


@pytest.mark.parametrize("order", [1, 2, 3, 4])
def test_scores_of_other_texts_equal_the_plain_model(make_docs, monkeypatch, order):
    monkeypatch.setattr(backoff, "BLOCK", 300)
    train, other = corpus(1), [*corpus(2, 40), "w0 w1 w2", "unseen W0 w1", None, ""]
    split = lambda t: (t or "").lower().split()
    plain = Plain([split(t) for t in train], order)
    model = backoff.fit(make_docs(train).repartition(3), order)
    assert model.total == plain.n and model.unknown == pytest.approx(plain.unknown, rel=1e-12)
    for texts in (other, train[:30]):
        got = {r.doc_id: r for r in backoff.score(model, make_docs(texts).repartition(2)).collect()}
        assert len(got) == len(texts)
        for i, t in enumerate(texts):
            assert got[i].n_tokens == len(split(t)) + 1
            assert got[i].score == pytest.approx(plain.score(split(t)), abs=1e-8)


def test_probabilities_sum_to_one():
    plain = Plain([t.split() for t in corpus(3, 30) if t], 3)
    words = [g[0] for g in plain.c[0]]
    for h in [*list(plain.after)[:60], ("never", "seen"), ("w0", "seen")]:
        unseen = plain.p(h, "no such word")
        assert sum(plain.p(h, w) for w in words) + unseen == pytest.approx(1, abs=1e-9)


def test_order_two_is_the_packed_model(make_docs, monkeypatch):
    """Where no history is frequent enough for another total, both models give one score."""
    monkeypatch.setattr(katz, "OFTEN", 10**9)
    docs = make_docs(corpus(4))
    model = backoff.fit(docs.filter("crc32(cast(cast(doc_id AS string) AS binary)) % 5 != 1"), 2)
    mine = {r.doc_id: r.score for r in backoff.score(model, docs).collect()}
    packed = {r.doc_id: r.score for r in katz.score(docs).collect()}
    assert mine == pytest.approx(packed, abs=1e-8)


def test_hot_pairs_repeats_and_no_texts(make_docs):
    rng = random.Random(5)
    rows = [(i % 40, "every text begins so " + " ".join(rng.choices("abcdef", k=6))) for i in range(120)] + [(None, None)]
    model = backoff.fit(make_docs(rows), 3)
    got = backoff.score(model, make_docs(rows)).collect()
    assert len(got) == 121 and sum(r.doc_id is None for r in got) == 1
    empty = backoff.fit(make_docs(["x"]).filter("false"), 3)
    found = backoff.score(empty, make_docs(["one two"])).first()
    assert found.n_tokens == 3 and found.score == 0.0
    assert backoff.score(model, make_docs(["x"]).filter("false")).count() == 0
    with pytest.raises(ValueError):
        backoff.fit(make_docs(["x"]), 0)
