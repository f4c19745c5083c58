import random
from collections import Counter, defaultdict
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest

from fieldstats.llm import jaccard
from fieldstats.llm.text import texts_of


def plain(rows, k, percent):
    """Smallest reachable id of each document, over all pairs."""
    sets = {}
    for d, t in rows:
        w = (t or "").encode().lower().split()
        sets[d] = frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) or (frozenset([tuple(w)]) if w else frozenset())
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    held = defaultdict(list)
    for d in sorted(sets):
        common = Counter(e for g in sets[d] for e in held[g])
        for g in sets[d]:
            held[g].append(d)
        for e, o in common.items():
            if 100 * o >= percent * (len(sets[d]) + len(sets[e]) - o):
                a, b = find(d), find(e)
                root[max(a, b)] = min(a, b)
    return {d: (len(sets[d]), find(d)) for d in sets}


def near_copies(rng, n, words, edits):
    base = ["b%d" % rng.randrange(10**6) for _ in range(words)]
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(rng.randrange(edits + 1)):
            at = rng.randrange(len(w))
            if rng.random() < 0.3:
                del w[at]
            else:
                w[at] = "e%d" % rng.randrange(10**6)
        out.append(" ".join(w))
    return out


def corpus(seed):
    rng = random.Random(seed)
    passage = " ".join("p%d" % i for i in range(60))
    texts = near_copies(rng, 60, 150, 6) + near_copies(rng, 40, 40, 2) + near_copies(rng, 20, 400, 12)
    texts += [passage + " " + " ".join("u%d" % rng.randrange(10**6) for _ in range(rng.randrange(80))) for _ in range(40)]
    texts += [" ".join("abcdefg"[: rng.randrange(1, 8)]) for _ in range(20)]
    texts += [None, "", " \n ", "one", "one", "One", "one two", passage, passage.upper()]
    rng.shuffle(texts)
    return list(enumerate(texts))


@pytest.mark.parametrize(("k", "percent", "small"), [(3, 90, False), (5, 80, False), (3, 90, True)])
def test_components_equal_all_pairs(make_docs, monkeypatch, k, percent, small):
    monkeypatch.setattr(jaccard, "COMMON_DOCS", 5 if k == 3 else 10**9)
    if small:  # groups are cut into parts
        monkeypatch.setattr(jaccard, "GROUP_SETS", 8)
    rows = corpus(7)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.join(make_docs(rows), k, percent).collect()}
    assert got == plain(rows, k, percent)


def entered(own, percent, common):
    """Index entries of one set."""
    sets = jaccard.Sets.__new__(jaccard.Sets)
    sets.hashes, sets.text = np.sort(own), np.zeros(len(own), np.int64)
    sets.sizes, sets.first = np.array([len(own)]), np.array([0, len(own)])
    keys, _, sizes, chain = sets.entries(percent, np.array([0]), common)
    order = np.argsort(keys)
    return jaccard.Entries(keys[order].view(np.int64), np.full(len(keys), id(own)), np.full(len(keys), len(own), np.int32), sizes[order], chain[order].view(np.int64))


def test_linked_sets_share_a_list():
    """Any two sets at the threshold meet in at least one index list, within the limits of its parities."""
    rng = np.random.default_rng(1)
    for percent in (80, 90):
        for _ in range(400):
            union = int(rng.integers(1, 600))
            inter = -(-percent * union // 100)
            tokens = rng.integers(0, 1 << 63, union, dtype=np.uint64)
            left = int(rng.integers(0, union - inter + 1))
            common = np.sort(rng.choice(tokens, int(rng.integers(0, union + 1)), replace=False))
            one, two = (entered(x, percent, common) for x in (tokens[: inter + left], np.concatenate([tokens[:inter], tokens[inter + left :]])))
            _, a, b = np.intersect1d(one.key, two.key, return_indices=True)
            both = jaccard.Entries(*(np.concatenate(x) for x in zip(one.columns(a)[:5], two.columns(b)[:5], strict=True)))
            within, tied = both.near(np.arange(len(a)), np.arange(len(a)) + len(a), percent)
            assert within.any() and tied[within].all()


def test_ties_lose_no_near_pair():
    """Two entries of a list within the limits are both tied to one leader, however the list is cut into batches."""
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 64, 12, dtype=np.uint64) & rng.integers(0, 1 << 64, 12, dtype=np.uint64)
    flips = np.uint64(1) << rng.integers(0, 63, (400, 4)).astype(np.uint64)
    chain = (base[rng.integers(0, 12, 400)] ^ np.bitwise_xor.reduce(np.where(rng.random((400, 4)) < 0.5, flips, np.uint64(0)), axis=1)).view(np.int64)
    blocks = chain.view(np.uint8)
    blocks[blocks < jaccard.FILLED] = 0  # an empty block has no parities
    n = rng.integers(80, 100, 400).astype(np.int32)
    sizes = np.full(400, np.searchsorted(jaccard.size_starts(80, 300), 80, "right") - 1, np.int16)
    rows = jaccard.Entries(np.sort(rng.integers(0, 5, 400)), np.arange(400), n, sizes, chain)
    table = pa.table(dict(zip(jaccard.ENTRY, rows.columns(), strict=False)))
    for most, held, short in ((1_000, 1_000, 0), (1_000, 37, 0), (2, 1_000, 0), (2, 37, 0), (1_000, 1_000, 400), (1_000, 37, 400), (1_000, 37, 70), (2, 9, 12)):
        with pytest.MonkeyPatch.context() as patch:
            patch.setattr(jaccard, "LIST_PAIRS", short)
            patch.setattr(jaccard, "MAX_LEADERS", most)
            patch.setattr(jaccard, "LIST_ROWS", held)
            leaders, made = defaultdict(set), 0
            for batch in jaccard._anchor(80)(iter(table.to_batches(max_chunksize=held))):
                made += batch.num_rows
                for r in batch.to_pylist():
                    leaders[r["class"]].add(r["anchor"])
                    leaders[r["anchor"]].add(r["anchor"])
            pairs = 0
            for x in range(400):
                others = np.flatnonzero((rows.key == rows.key[x]) & (rows.classes != x))
                within, _ = rows.near(others, np.full(len(others), x), 80)
                pairs += within.sum()
                assert all(leaders[x] & leaders[y] for y in others[within])
            assert pairs > 100 and (held < 400 or made < 400)


def test_known_groups_lose_no_near_pair():
    """Where groups with an anchor of their own are known, two entries within the limits still have a common anchor."""
    rng = np.random.default_rng(4)
    base = rng.integers(0, 1 << 64, 9, dtype=np.uint64) & rng.integers(0, 1 << 64, 9, dtype=np.uint64)
    flips = np.uint64(1) << rng.integers(0, 63, (400, 4)).astype(np.uint64)
    chain = (base[rng.integers(0, 9, 400)] ^ np.bitwise_xor.reduce(np.where(rng.random((400, 4)) < 0.5, flips, np.uint64(0)), axis=1)).view(np.int64)
    blocks = chain.view(np.uint8)
    blocks[blocks < jaccard.FILLED] = 0
    n = rng.integers(80, 100, 400).astype(np.int32)
    sizes = np.full(400, np.searchsorted(jaccard.size_starts(80, 300), 80, "right") - 1, np.int16)
    rows = jaccard.Entries(np.sort(rng.integers(0, 5, 400)), np.arange(400), n, sizes, chain)
    table = pa.table(dict(zip(jaccard.ENTRY, rows.columns(), strict=False)))
    for share in (0.0, 0.3, 0.9):
        classes = np.flatnonzero(rng.random(400) < share)
        group = rng.integers(0, 7, len(classes))
        heads = np.array([classes[group == g].min(initial=400) for g in range(7)])
        known = SimpleNamespace(value=jaccard.Known(classes, heads[group], n[np.minimum(heads, 399)[group]]))
        for held, short in ((1_000, 0), (37, 0), (1_000, 400), (37, 400), (37, 70), (9, 12)):
            with pytest.MonkeyPatch.context() as patch:
                patch.setattr(jaccard, "LIST_PAIRS", short)
                patch.setattr(jaccard, "LIST_ROWS", held)
                leaders = defaultdict(set)
                for c, a in zip(classes, heads[group], strict=True):
                    leaders[c].add(a)
                for batch in jaccard._anchor(80, known)(iter(table.to_batches(max_chunksize=held))):
                    for r in batch.to_pylist():
                        assert r["anchor_n"] == n[r["anchor"]] and r["n"] == n[r["class"]]
                        leaders[r["class"]].add(r["anchor"])
                        leaders[r["anchor"]].add(r["anchor"])
                for x in range(400):
                    others = np.flatnonzero((rows.key == rows.key[x]) & (rows.classes != x))
                    within, _ = rows.near(others, np.full(len(others), x), 80)
                    assert all(leaders[x] & leaders[y] for y in others[within])


def test_a_cluster_is_tied_once(make_docs, monkeypatch):
    """Near copies meet in a hundred lists and more; ties are as many as the copies all the same, in however many tasks and batches the lists are read."""
    counts, stage = {}, jaccard.stage
    monkeypatch.setattr(jaccard, "stage", lambda table, name, *by: counts.update({name: (out := stage(table, name, *by)).count()}) or out)
    rng = random.Random(9)
    texts = [t for n in (150, 30, 5) for t in near_copies(rng, n, 400, 6)]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.join(make_docs(texts), 5, 80).collect()}
    assert got == plain(list(enumerate(texts)), 5, 80)
    assert counts["anchors"] <= 1.2 * len(texts)

    sets = jaccard.Sets(texts_of(pa.array(texts)), 5)
    groups = np.minimum(np.arange(len(texts)), 179) // 150 + (np.arange(len(texts)) >= 180)
    heads = np.array([sets.classes[groups == g].view(np.int64).min() for g in range(3)])[groups]
    order = np.argsort(sets.classes.view(np.int64))
    known = jaccard.Known(sets.classes.view(np.int64)[order], heads[order], np.ones(len(texts), np.int32))
    keys, owner, sizes, chain = sets.entries(80, np.arange(len(texts)))
    order = np.argsort(keys.view(np.int64), kind="stable")
    columns = [keys[order].view(np.int64), sets.classes[owner[order]].view(np.int64), sets.sizes[owner[order]].astype(np.int32), sizes[order], chain[order].view(np.int64)]
    table = pa.table(dict(zip(jaccard.ENTRY, columns, strict=True)))
    monkeypatch.setattr(jaccard, "LIST_ROWS", 2_000)
    made = [sum(b.num_rows for b in jaccard._anchor(80, k)(iter(table.to_batches(max_chunksize=1_000)))) for k in (None, SimpleNamespace(value=known))]
    assert made[0] > 10 * len(texts) and not made[1]


def test_ties_of_unlike_sets_are_few():
    """Texts of few words share many shingles by chance; their lists meet, but hardly any tie comes of it."""
    rng = random.Random(5)
    words = ["w%d" % i for i in range(40)]
    texts = pa.array([" ".join(rng.choices(words, k=rng.randrange(40, 160))) for _ in range(10_000)])
    sets = jaccard.Sets(texts_of(texts), 3)
    names, counts = np.unique(sets.hashes, return_counts=True)
    for least in (8, 16, 1 << 30):
        keys, owner, sizes, chain = sets.entries(80, np.arange(10_000), names[counts >= least])
        order = np.argsort(keys, kind="stable")
        rows = jaccard.Entries(keys[order], owner[order], sets.sizes[owner[order]].astype(np.int32), sizes[order], chain[order])
        met = len(order) - len(jaccard.runs(rows.key))
        assert met > 1_000 and len(rows.ties(80)[0]) <= 0.05 * met


def test_overlaps_equal_intersections():
    rng = np.random.default_rng(2)
    base = rng.integers(0, 500, 80)
    sets = [np.unique(np.where(rng.random(80) < 0.1, rng.integers(0, 500, 80), base)) for _ in range(25)]
    for y, row in jaccard.overlaps(sets):
        assert row.tolist() == [len(np.intersect1d(sets[y], s)) for s in sets]


def test_dedupe_and_empty_tables(make_docs):
    docs = make_docs(["a b c d e f g", "a b c d e f g", "other words are here now", None])
    assert sorted(r.doc_id for r in jaccard.dedupe(docs).collect()) == [0, 2, 3]
    assert jaccard.dedupe(docs).columns == docs.columns
    assert jaccard.join(docs.limit(0)).count() == 0


def linked_documents(rows, k, percent):
    """Number of documents linked to each document, over all pairs."""
    sets = {}
    for d, t in rows:
        w = (t or "").encode().lower().split()
        sets[d] = frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) or (frozenset([tuple(w)]) if w else frozenset())
    out = Counter(dict.fromkeys(sets, 0))
    for x in sets:
        for y in sets:
            if x < y and sets[x] and 100 * len(sets[x] & sets[y]) >= percent * len(sets[x] | sets[y]):
                out.update([x, y])
    return out


@pytest.mark.parametrize("small", [2048, 8, 3])
def test_link_counts_equal_all_pairs(make_docs, monkeypatch, small):
    """Pairs that meet under several anchors and in several parts count once; copies count each."""
    monkeypatch.setattr(jaccard, "COMMON_DOCS", 5)
    monkeypatch.setattr(jaccard, "GROUP_SETS", small)
    rows = corpus(11)
    rows += [(len(rows) + i, t) for i, (_, t) in enumerate(rows[:60])]
    got = {r.doc_id: r for r in jaccard.join(make_docs(rows), 3, 90, counts=True).collect()}
    assert {d: (r.n_shingles, r.component_id) for d, r in got.items()} == plain(rows, 3, 90)
    wanted = linked_documents(rows, 3, 90)
    assert max(wanted.values()) > 20 and {d: r.n_links for d, r in got.items()} == wanted
    twice = jaccard.join(make_docs([(1, "a b c d"), (1, "a b c d"), (2, "a b c d"), (None, "a b c d"), (3, None)]), 3, 90, counts=True)
    assert {(r.doc_id, r.n_links) for r in twice.collect()} == {(1, 2), (2, 2), (None, 2), (3, 0)}
