import random
from collections import Counter

import numpy as np
import pyarrow as pa

from fieldstats.llm import decontaminate as dc


def shingles(words):
    return [tuple(words[i : i + 5]) for i in range(len(words) - 4)] or ([tuple(words)] if words else [])


def plain(docs, items):
    """Best similarity of any item-sized window, over all windows."""
    out = {}
    for d, t in docs:
        w = (t or "").lower().split()
        for i, s in items:
            q = (s or "").lower().split()
            own = Counter(shingles(q))
            best = 0.0
            for a in range(max(1, len(w) - len(q) + 1)):
                c = Counter(shingles(w[a : a + len(q)]))
                if sum((c | own).values()):
                    best = max(best, sum((c & own).values()) / sum((c | own).values()))
            if best >= dc.THRESHOLD:
                out[d, i] = best
    return out


def test_matches_equal_all_windows(spark, make_docs):
    rng = random.Random(5)
    word = lambda: "w%d" % rng.randrange(400)
    items = [(i, " ".join(word() for _ in range(n))) for i, n in enumerate([12, 20, 20, 35, 50, 3, 5, 1])] + [(8, None), (9, "")]
    docs = [(0, None), (1, ""), (2, items[1][1]), (3, "w1"), (4, items[5][1] + " tail words")]
    for d in range(5, 80):
        q = rng.choice(items[:6])[1].split()
        for _ in range(rng.randrange(4)):
            q[rng.randrange(len(q))] = word()
        docs.append((d, " ".join([word() for _ in range(rng.randrange(30))] + q + [word() for _ in range(rng.randrange(30))])))
    docs.append((80, " ".join([items[3][1]] * 3)))
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = {(r.doc_id, r.item_id): r.similarity for r in dc.contaminated(make_docs(docs), bench).collect()}
    wanted = plain(docs, items)
    assert found.keys() <= wanted.keys() and len(found) >= 0.98 * len(wanted)
    assert all(abs(found[k] - wanted[k]) < 1e-9 for k in found)
    assert {(2, 1), (4, 5), (80, 3)} <= found.keys()
    kept = {r.doc_id for r in dc.clean(make_docs(docs), bench).collect()}
    assert kept == {d for d, _ in docs} - {d for d, _ in found}


def test_benchmark_in_chunks(spark, make_docs, monkeypatch):
    items = spark.createDataFrame([(i, " ".join(f"q{i}x{j}" for j in range(12))) for i in range(9)], "item_id long, text string")
    docs = make_docs([r.text for r in items.collect()])
    whole = dc.contaminated(docs, items).count()
    monkeypatch.setattr(dc, "CHUNK_BYTES", 100)
    assert dc.contaminated(docs, items).count() == whole == 9
    assert dc.clean(docs, items).count() == 0
    assert dc.contaminated(docs, items.limit(0)).count() == 0 and dc.contaminated(docs.limit(0), items).count() == 0


def test_index_returns_all_within_the_radius():
    import numpy as np
    import pyarrow as pa

    rng = random.Random(0)
    items = dc.Items(list(range(50)), pa.array([" ".join("w%d" % rng.randrange(99) for _ in range(20)) for _ in range(50)]))
    g = np.random.default_rng(0)
    prints = []
    for i in range(50):
        flips = g.choice(64, g.integers(0, 30), replace=False)
        prints.append(int(items.prints[i]) ^ sum(1 << int(b) for b in flips))
    prints = np.array(prints, np.uint64)
    near = set(zip(*(x.tolist() for x in items.within(20, prints)), strict=True))
    assert near == {(a, b) for a in range(50) for b in range(50) if bin(int(prints[a]) ^ int(items.prints[b])).count("1") <= dc.RADIUS}


def test_similar_windows_lie_within_the_radius():
    """Of windows at the smallest similarity that counts, how many lie within the radius: the recall of the first stage."""
    rng = random.Random(8)
    pairs = []
    for _ in range(3_000):
        n = rng.randrange(50, 300)
        words = ["v%d" % rng.randrange(5_000) for _ in range(n)]
        changed, at = list(words), rng.randrange(n)
        # m words in a row change at most m + 4 shingles of n - 4 on either side
        most = (n - 4) // 9 - 4
        for i in range(at, min(n, at + max(1, most))):
            changed[i] = "other%d" % i
        a, b = Counter(shingles(words)), Counter(shingles(changed))
        if sum((a & b).values()) / sum((a | b).values()) >= dc.THRESHOLD:
            pairs.append((" ".join(words), " ".join(changed)))
    prints = [dc.Items(list(range(len(pairs))), pa.array(side)).prints for side in zip(*pairs, strict=True)]
    within = np.bitwise_count(prints[0] ^ prints[1]) <= dc.RADIUS
    assert len(pairs) > 2_500 and within.mean() >= 0.999
