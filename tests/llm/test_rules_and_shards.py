import heapq
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np

from fieldstats.llm import quality_rules as rules
from fieldstats.llm import shards

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def base(t):
    t = t or ""
    w = WORD.findall(t)
    seen, dup, marked = set(), 0, set()
    for line in t.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    grams = Counter(zip(w, w[1:], w[2:], strict=False))
    for i in range(len(w) - 2):
        if grams[tuple(w[i : i + 3])] > 1:
            marked |= {i, i + 1, i + 2}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), dup, len(marked)


def corpus():
    rng = random.Random(4)
    line = lambda n: " ".join("v%d" % rng.randrange(5000) for _ in range(n))
    texts, hosts = [], []
    for i in range(150):
        lines = [line(rng.randrange(1, 12)) for _ in range(rng.randrange(1, 12))]
        if i % 3 == 0:
            lines += ["Read MORE  here now"] * 2
        if i % 10 == 0:
            lines = ["all rights are reserved by us alone " * 9] + lines[:1]
        texts.append("\n".join(lines))
        hosts.append("abc"[i % 3] if i % 7 else None)
    return [*texts, None, "", "\n\n", "# $ %", "é ü\né ü", "word " * 100], [*hosts, "a", "b", None, "a", "a", "a"]


def test_rules_equal_a_plain_version(make_docs):
    texts, hosts = corpus()
    got = {r.doc_id: r for r in rules.judge(make_docs(texts, hosts), min_docs=5, max_share=0.05).collect()}
    held, size = defaultdict(set), Counter(hosts)
    norm = lambda line: " ".join(WORD.findall(line)).lower()
    for i, (t, h) in enumerate(zip(texts, hosts, strict=True)):
        for line in (t or "").split("\n"):
            if norm(line):
                held[h, norm(line)].add(i)
    often = {k for k, d in held.items() if len(d) > 5 and len(d) > 0.05 * size[k[0]]}
    assert often
    for i, (t, h) in enumerate(zip(texts, hosts, strict=True)):
        r = got[i]
        counts = base(t)
        assert counts == (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words)
        gone = sum(len(WORD.findall(x)) for x in (t or "").split("\n") if (h, norm(x)) in often)
        failed = counts[0] < 50 or 100 * counts[4] > 50 * counts[0]
        assert (r.removed_words, r.base_failed) == (gone, failed)
        assert r.kept == (not failed and counts[0] - gone >= 0.5 * counts[0])


def test_lines_are_taken_out(make_docs):
    texts, hosts = corpus()
    docs = make_docs(texts, hosts)
    kept = rules.clean(docs, min_docs=5, max_share=0.05)
    assert kept.columns == docs.columns
    rows = kept.collect()
    wanted = {r.doc_id for r in rules.judge(docs, min_docs=5, max_share=0.05).filter("kept").collect()}
    assert {r.doc_id for r in rows} == wanted
    assert not any("Read MORE" in r.text for r in rows if r.source == "a")
    assert rules.judge(docs.limit(0)).count() == 0


def test_an_absolute_count_is_enough_on_a_large_host(make_docs):
    """11 documents of 2,400 hold the line: more than 10, less than half a percent."""
    texts = [" ".join("x%d_%d" % (i, j) for j in range(60)) for i in range(2400)]
    for i in range(11):
        texts[i] += "\n" + "shared passage of the host " * 20
    got = {r.doc_id: r for r in rules.judge(make_docs(texts)).collect()}
    assert {i for i in got if got[i].removed_words} == set(range(11))
    assert all(got[i].removed_words == 100 and not got[i].kept for i in range(11)) and got[11].kept


def test_repeated_rows_and_rows_without_an_id(make_docs):
    own = lambda i: " ".join("x%d_%d" % (i, j) for j in range(60))
    line = "passage of many documents " * 20
    rows = [(0, own(0))] * 11  # one document, given eleven times
    rows += [(i, own(i) + "\n" + line) for i in range(1, 10)] + [(None, own(10) + "\n" + line), (None, own(11) + "\n" + line)]
    rows += [(20, own(20) + "\nshort one")] * 4 + [(i, own(i) + "\nshort one") for i in range(21, 35)]
    got = rules.judge(make_docs(rows)).collect()
    assert len(got) == len(rows)
    assert {(r.removed_words, r.kept) for r in got if r.doc_id == 0} == {(0, True)}
    assert [(r.removed_words, r.kept) for r in got if r.doc_id is None] == [(80, False)] * 2
    assert {(r.removed_words, r.kept) for r in got if r.doc_id is not None and 0 < r.doc_id < 10} == {(80, False)}
    assert {(r.removed_words, r.kept) for r in got if r.doc_id is not None and r.doc_id >= 20} == {(2, True)}


def plain_loads(sizes, n):
    """Largest first to the least-loaded shard, one item at a time."""
    heap = [(0, i) for i in range(n)]
    for size in sorted(sizes, reverse=True):
        load, i = heapq.heappop(heap)
        heapq.heappush(heap, (load + size, i))
    return {i: load for load, i in heap}


def test_runs_of_equal_sizes_are_placed_as_by_a_plain_heap():
    rng = random.Random(5)
    for trial in range(200):
        n = rng.randrange(1, 9)
        held = {rng.choice([rng.randrange(1, 30), rng.randrange(1, 5000)]): rng.choice([1, 2, rng.randrange(1, 400)]) for _ in range(rng.randrange(1, 12))}
        sizes, counts = (np.array(x, np.int64) for x in zip(*held.items(), strict=True))
        dealt = shards.place(sizes, counts, n)
        assert (dealt.sum(1) == counts).all() and (dealt >= 0).all()
        assert dict(enumerate(sizes @ dealt)) == plain_loads(np.repeat(sizes, counts).tolist(), n), trial
    assert shards.place(np.array([5, 4, 3]), np.array([1, 1, 2]), 2).tolist() == [[1, 0], [0, 1], [1, 1]]
    many = shards.place(np.array([10**9, 8]), np.array([1, 3 * 10**8]), 24)
    assert many[0].tolist() == [1] + [0] * 23 and np.ptp(many[1][1:]) <= 1 and many[1].sum() == 3 * 10**8


def test_shards(make_docs):
    rng = random.Random(9)
    texts = ["t" * rng.randrange(1, 4000) + str(i) for i in range(400)] + ["copy " * 40] * 90 + [None, "", None]
    got = shards.shard_documents(make_docs(texts), 6).collect()
    by, load, where = defaultdict(list), Counter(), defaultdict(set)
    for r in got:
        t = (texts[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32) == (len(t) + 8, zlib.crc32(t))
        by[r.shard].append(r.slot)
        load[r.shard] += r.size
        where[t].add(r.shard)
    assert len(got) == len(texts) and set(by) == set(range(6))
    assert all(sorted(s) == list(range(len(s))) for s in by.values()) and all(len(s) == 1 for s in where.values())
    groups = Counter((t or "").encode() for t in texts)
    assert load == plain_loads([(len(t) + 8) * n for t, n in groups.items()], 6)
    again = {r.doc_id: (r.shard, r.slot) for r in shards.shard_documents(make_docs(texts).repartition(7), 6).collect()}
    assert again == {r.doc_id: (r.shard, r.slot) for r in got}
    assert shards.shard_documents(make_docs([None]).limit(0), 6).count() == 0
