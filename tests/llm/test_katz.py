import math
import random
import zlib
from collections import Counter, defaultdict

import pytest

from fieldstats.llm import katz

END, START = b"\n", b"\n\n"


def discounts(n):
    for k in range(katz.K, 0, -1):
        m = [n[r] for r in range(1, k + 2)]
        if min(m) <= 0:
            continue
        common = (k + 1) * m[k] / m[0]
        if common >= 1:
            continue
        d = [((r + 1) * m[r] / m[r - 1] / r - common) / (1 - common) for r in range(1, k + 1)]
        if all(0 < x < 1 for x in d):
            return dict(enumerate(d, 1))
    return {1: 0.5}


class Plain:
    """The model, written down directly."""

    def __init__(self, rows):
        train = [w for d, w in rows if zlib.crc32(str(d).encode()) % 5 != 1]
        self.c, self.pairs, self.after = Counter(), Counter(), defaultdict(list)
        for w in train:
            self.c.update([*w, END])
            self.pairs.update(zip([START, *w], [*w, END], strict=True))
        self.n = sum(self.c.values())
        self.du, self.db = discounts(Counter(self.c.values())), discounts(Counter(self.pairs.values()))
        self.unknown = sum((1 - self.du.get(c, 1)) * c for c in self.c.values()) / self.n if self.n else 1.0
        if not self.unknown > 0:
            self.unknown = 1 / (self.n + 1)
        history, ones = Counter(), Counter()
        for (h, w), c in self.pairs.items():
            history[h] += c
            ones[h] += c == 1
            self.after[h].append((w, c))
        self.full = {h: n + (n >= katz.OFTEN or not ones[h]) for h, n in history.items()}
        self.alpha = {h: (1 - sum(self.db.get(c, 1) * c for _, c in f) / self.full[h]) / (1 - sum(self.p1(w) for w, _ in f)) for h, f in self.after.items()}

    def p1(self, w):
        c = self.c.get(w, 0)
        return self.du.get(c, 1) * c / self.n if c else self.unknown

    def p(self, h, w):
        c = self.pairs.get((h, w), 0)
        return self.db.get(c, 1) * c / self.full[h] if c else self.alpha.get(h, 1.0) * self.p1(w)

    def score(self, words):
        return sum(math.log10(self.p(h, w)) for h, w in zip([START, *words], [*words, END], strict=True))

    def base(self, words):
        return sum(math.log10((self.c.get(w, 0) + 0.5) / (self.n + 0.5 * (len(self.c) + 1))) for w in [*words, END])


def corpus(seed, n=120):
    rng = random.Random(seed)
    vocabulary = ["w%d" % i for i in range(60)]
    weights = [1 / (i + 1) for i in range(60)]
    texts = [" ".join(rng.choices(vocabulary, weights, k=rng.randrange(40))) for _ in range(n)]
    return [*texts, None, "", "new words only here", texts[0], texts[0], "W0 W1\tw2", "hot pair " * 50]


@pytest.mark.parametrize(("block", "often"), [(50, 60), (1_000_000, 60), (1_000_000, 1_000)])
def test_scores_equal_the_plain_model(make_docs, monkeypatch, block, often):
    monkeypatch.setattr(katz, "HOT", 20)  # some words and the start mark count as hot and are spread over parts
    monkeypatch.setattr(katz, "OFTEN", often)
    docs = make_docs(corpus(1)).repartition(3)
    rows = [(r.doc_id, (r.text or "").encode().lower().split()) for r in docs.collect()]
    plain = Plain(rows)
    monkeypatch.setattr(katz, "BLOCK_TOKENS", block)
    model, scored = katz.fit_and_score(docs)
    got = {r.doc_id: r for r in scored.collect()}
    assert len(got) == len(rows)
    for d, w in rows:
        r = got[d]
        assert r.held_out == (zlib.crc32(str(d).encode()) % 5 == 1)
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(w) + 1, sum(x in plain.c for x in [*w, END]), plain.n)
        assert r.base_score == pytest.approx(plain.base(w), abs=1e-8)
        assert r.score == pytest.approx(plain.score(w), abs=1e-8)
    assert model.types == len(plain.c)


def test_shares_are_no_more_than_tokens(make_docs, monkeypatch):
    """However many parts the histories are dealt over, a part answers only for texts that occur in it."""
    docs = make_docs(corpus(3))
    texts = [(r.doc_id, (r.text or "").split()) for r in docs.collect()]
    found = {}
    for tokens in (2_000_000, 10):
        monkeypatch.setattr(katz, "PART_TOKENS", tokens)
        model, scored = katz.fit_and_score(docs)
        shares = model.counted.filter("kind = 0").selectExpr("sum(length(a)) / 2 AS n", "count(DISTINCT part) AS parts").first()
        assert shares.n <= sum(len(w) + 1 for _, w in texts)
        found[shares.parts] = {r.doc_id: (r.base_score, r.score) for r in scored.collect()}
    (few, one), (many, two) = sorted(found.items())
    assert few <= 8 < 30 < many
    assert all(one[d] == pytest.approx(two[d], abs=1e-8) for d in one)


def test_probabilities_sum_to_one():
    plain = Plain([(i, (t or "").encode().lower().split()) for i, t in enumerate(corpus(2))])
    for h in plain.alpha:
        assert sum(plain.p(h, w) for w in plain.c) + plain.alpha[h] * plain.unknown == pytest.approx(1, abs=1e-12)


def test_repeated_rows_and_empty_tables(make_docs):
    docs = make_docs([(1, "a b c"), (1, "a b c"), (2, "a x"), (3, None)])
    got = katz.score(docs).collect()
    assert len(got) == 4 and len({r.score for r in got if r.doc_id == 1}) == 1
    assert katz.score(docs.limit(0)).count() == 0


def test_discounts():
    assert katz.Discounts.of([0] * 6).factor[1] == 0.5
    d = katz.Discounts.of([1000, 300, 150, 90, 60, 40]).factor
    assert all(0 < x < 1 for x in d[1:6]) and d[6] == 1


def test_pairs_that_all_texts_share_are_not_sent(make_docs, monkeypatch):
    """Blocks add up the shares of hot pairs themselves; each such pair stands once in the bigram table."""
    monkeypatch.setattr(katz, "HOT", 20)
    monkeypatch.setattr(katz, "OFTEN", 60)
    monkeypatch.setattr(katz, "BLOCK_TOKENS", 300)
    docs = make_docs(["see also " * 30 + (t or "") for t in corpus(4)]).repartition(3)
    rows = [(r.doc_id, r.text.encode().lower().split()) for r in docs.collect()]
    plain = Plain(rows)
    model, scored = katz.fit_and_score(docs)
    for r in scored.collect():
        words = dict(rows)[r.doc_id]
        assert (r.n_tokens, r.n_known) == (len(words) + 1, sum(x in plain.c for x in [*words, END]))
        assert r.base_score == pytest.approx(plain.base(words), abs=1e-8)
        assert r.score == pytest.approx(plain.score(words), abs=1e-8)
    assert sum(len(r.c) // 8 for r in model.bigrams.collect()) == len(plain.pairs)
    sent = sum(int(katz.unplanes(r.f, "u4").sum()) for r in model.counted.filter("kind = 0").collect())
    hot = sum(c for (h, w), c in plain.pairs.items() if h != START and c > max(plain.n / 20, 60))
    assert hot > plain.n / 3
    assert sent <= sum(len(w) for _, w in rows) - hot
