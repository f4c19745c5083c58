"""SimHash components against all pairs of fingerprints, and the vantage-point tree by itself."""

import numpy as np
import pytest
import xxhash

from fieldstats.llm import simhash


def plain_print(text, k=3):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    runs = [" ".join(words[i : i + k]) for i in range(len(words) - k + 1)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64(r.encode(), 42).intdigest() for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(prints, ids, radius):
    label = list(range(len(prints)))
    changed = True
    while changed:
        changed = False
        for i, a in enumerate(prints):
            for j, b in enumerate(prints):
                if (a ^ b).bit_count() <= radius and label[j] > label[i]:
                    label[j], changed = label[i], True
    least = {r: min((ids[i] for i in range(len(ids)) if label[i] == r and ids[i] is not None), default=None) for r in set(label)}
    return [least[r] for r in label]


def near_texts(rng, n):
    base = [" ".join(f"w{x}" for x in rng.integers(0, 900, 120)) for _ in range(n)]
    out = []
    for t in base:
        out += [t, t.upper()]
        words = t.split()
        for _ in range(3):
            words[int(rng.integers(len(words)))] = "Other"
            out.append("  ".join(words))
    return out


def test_components_against_all_pairs(spark, make_docs):
    rng = np.random.default_rng(4)
    texts = near_texts(rng, 40) + [None, "", " \n", "one", "One", "two words", "a b c", "é\xa0è ü"]
    rows = [(1000 - i, t) for i, t in enumerate(texts)] + [(None, texts[0]), (None, "alone without an id"), (3, "a b c"), (3, "other words than those")]
    prints = [plain_print(t) for _, t in rows]
    wanted = plain_components(prints, [i for i, _ in rows], 2)
    docs = make_docs(rows).selectExpr("*", "1 AS fp", "2 AS shard", "3 AS label", "4 AS rows", "5 AS first")
    found = sorted(((r.doc_id, r.fingerprint, r.component_id) for r in simhash.join(docs).collect()), key=str)
    assert found == sorted(((i, f"{p:016x}", c) for (i, _), p, c in zip(rows, prints, wanted, strict=True)), key=str)
    assert len({c for _, _, c in found}) < len(set(prints))


def test_spark_and_the_library_hash_alike(spark):
    text = "three plain words"
    one = spark.createDataFrame([(text,)], "t string").selectExpr("xxhash64(t) AS h").first().h
    assert one % (1 << 64) == xxhash.xxh64_intdigest(text, 42)


def test_empty_table_and_long_text(spark, make_docs):
    assert simhash.join(make_docs(["a"]).filter("false")).count() == 0
    long = " ".join(f"w{i % 977}" for i in range(60_000))
    found = simhash.join(make_docs([long, "b"])).collect()
    assert {r.fingerprint for r in found if r.doc_id == 0} == {f"{plain_print(long):016x}"}


@pytest.mark.parametrize("piece", [1, 7, 100])
def test_pieces_change_nothing(monkeypatch, piece):
    monkeypatch.setattr(simhash, "PIECE", piece)
    rng = np.random.default_rng(piece)
    for text in ["", " ", "a", "a b", "a b c", "  lead and trail  ", "x" * 300, "é\tü\n漢 字 " * 20, " ".join("w" * int(n) for n in rng.integers(1, 12, 200))]:
        for k in (1, 2, 3, 5):
            assert simhash.fingerprint(simhash.shingle_hashes(text.encode(), k)) == plain_print(text, k)


def clustered(rng, n):
    """Distinct fingerprints, many of them a few bits from another."""
    heads = rng.integers(0, 1 << 63, n // 4, dtype=np.uint64)
    out = [heads]
    for _ in range(3):
        bits = [np.uint64(1) << rng.integers(0, 64, len(heads), dtype=np.uint64) for _ in range(3)]
        out.append(heads ^ bits[0] ^ (bits[1] * (rng.random(len(heads)) < 0.7)) ^ (bits[2] * (rng.random(len(heads)) < 0.3)))
    return np.unique(np.concatenate(out))


@pytest.mark.parametrize("leaf,radius", [(1, 2), (16, 2), (16, 5), (16, 0)])
def test_every_near_pair_meets_in_a_leaf(leaf, radius):
    points = clustered(np.random.default_rng(leaf), 800)
    tree = simhash.Tree(points, radius, leaf)
    owner, met = np.full(len(points), -1), set()
    for number, owners, guests in tree.visits(points, own=True):
        assert (owner[owners] == -1).all()
        owner[owners] = number
        here = tree.leaves[number]
        assert sorted(here) == sorted(owners)
        a, b = simhash.near(points[np.concatenate([owners, guests])], points[here], radius)
        met |= {frozenset((int(np.concatenate([owners, guests])[i]), int(here[j]))) for i, j in zip(a, b, strict=True)}
    a, b = simhash.near(points, points, radius)
    assert met == {frozenset((int(i), int(j))) for i, j in zip(a, b, strict=True)}
    assert (owner >= 0).all()


def test_many_shards_find_what_one_finds(spark, monkeypatch):
    """A dense ball (all fingerprints two bits from one) and clusters, through a deep tree over a small sample."""
    rng = np.random.default_rng(9)
    centre = int(rng.integers(0, 1 << 62))
    ball = [centre ^ 1 << i ^ 1 << j for i in range(64) for j in range(i)][::2]
    points = np.unique(np.concatenate([clustered(rng, 1_500), np.array(ball, np.uint64)]))
    frame = spark.createDataFrame([(int(p),) for p in points.view(np.int64)], "fp long").repartition(3)
    a, b = simhash.near(points, points, 2)
    whole = simhash.joined(np.arange(len(points)), a, b)
    wanted = {int(p): int(points[r]) for p, r in zip(points, whole, strict=True)}
    for scale, sample in ((1_000, 65_536), (1, 500)):
        monkeypatch.setattr(simhash, "SHARD_SCALE", scale)
        monkeypatch.setattr(simhash, "SAMPLE", sample)
        edges = simhash.links(frame, 2).toPandas()
        at = {int(p): i for i, p in enumerate(points)}
        ends = [np.array([at[v % (1 << 64)] for v in edges[c]], np.int64) for c in ("a", "b")]
        label = simhash.joined(np.arange(len(points)), *ends)
        assert {int(p): int(points[r]) for p, r in zip(points, label, strict=True)} == wanted
        assert len(edges) < len(a) / 4
