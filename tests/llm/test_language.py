"""Language fusion against a plain posterior in dictionaries, and markup against backtracking patterns."""

import math
import random
import re
import time
from collections import Counter, defaultdict

import pytest

from fieldstats.llm import language

STEMS = {"en": ["the", "and", "thing"], "de": ["der", "und", "sch"], "fr": ["le", "et", "que"]}


def plain_buckets(text):
    """Buckets of byte trigrams: letters kept, runs of other bytes one blank, none with a blank in the middle."""
    data = bytearray()
    for b in (text or "").encode():
        b = b + 32 if 65 <= b <= 90 else b
        if 97 <= b <= 122 or b >= 128:
            data.append(b)
        elif not data or data[-1] != 32:
            data.append(32)
    out = []
    for a, b, c in zip(data, data[1:], data[2:]):
        if b != 32:
            h = (a | b << 8 | c << 16) * 0x9E3779B1 & 0xFFFFFFFF
            h ^= h >> 15
            out.append((h * 0x85EBCA77 & 0xFFFFFFFF) >> 16)
    return out


def soft(x):
    top = max(x.values())
    e = {k: math.exp(v - top) for k, v in x.items()}
    return {k: v / sum(e.values()) for k, v in e.items()}


def plain_identify(records, train):
    names = sorted({lang for _, lang in train})
    counts = {n: Counter() for n in names}
    for text, lang in train:
        counts[lang].update(plain_buckets(text))
    total = {n: sum(counts[n].values()) + 0.5 * 65_536 for n in names}
    rows = []
    for key, host, said, text in records:
        b = plain_buckets(text)
        scale = min(1, 200 / max(len(b), 1))
        like = {n: scale * sum(math.log((counts[n][x] + 0.5) / total[n]) for x in b) for n in names}
        p = soft(like) if b else dict.fromkeys(names, 0.0)
        parts = host.split(".")
        keys = {"host": host, "domain": ".".join(parts[-2:]), "suffix": parts[-1] if "." in host else "", "said": said or ""}
        rows.append((key, keys, like, {n: v if v >= 1e-9 else 0.0 for n, v in p.items()}))
    votes = defaultdict(lambda: dict.fromkeys(names, 0.0))
    every = dict.fromkeys(names, 0.0)
    for _, keys, _, p in rows:
        for n in names:
            every[n] += p[n]
            for kind, value in keys.items():
                votes[kind, value][n] += p[n]
    out = {}
    for key, keys, like, p in rows:
        others = {kind: {n: max(votes[kind, v][n] - p[n], 0) for n in names} for kind, v in keys.items()}
        prior = {n: (every[n] + 1) / (sum(every.values()) + len(names)) for n in names}
        domain = {n: (others["domain"][n] + 20 * prior[n]) / (sum(others["domain"].values()) + 20) for n in names}
        host = {n: (others["host"][n] + 5 * domain[n]) / (sum(others["host"].values()) + 5) for n in names}
        joint = {n: like[n] + math.log(host[n] if keys["host"] else prior[n]) for n in names}
        for kind in ("suffix", "said"):
            if keys[kind]:
                for n in names:
                    joint[n] += math.log((others[kind][n] + 1) / (every[n] + len(names)))
        found = soft(joint)
        best = max(names, key=lambda n: (found[n], -names.index(n)))
        out[key] = best, found[best]
    return out


def test_posterior_against_a_plain_one(spark):
    rng = random.Random(3)
    text = lambda lang, n: " ".join("".join(rng.choice(STEMS[lang]) for _ in range(rng.randrange(1, 4))) for _ in range(n))
    train = [(i, text(lang, 12), lang) for i in range(120) for lang in [list(STEMS)[i % 3]]]
    docs = spark.createDataFrame([(i, t, lang, "s", 0) for i, t, lang in train], "doc_id long, text string, lang string, source string, n_chars long")
    model = language.fit_text(docs, held_out=9)
    records = []
    for i in range(80):
        lang = list(STEMS)[i % 3]
        host = rng.choice([f"a.{lang}site.{lang}", "mixed.com", f"www.big.{lang}", "localhost", ""])
        body = rng.choice([text(lang, 5), text(lang, 300), "", "12 34", text("en", 1) + text("de", 1)])
        records.append((i, host, rng.choice([lang, None, "xx"]), body))
    pages = [(i, f"http://{h}/p" if h else None, (f'<html lang="{said}">' if said else "<html>") + f"<p>{body}</p>") for i, h, said, body in records]
    frame = spark.createDataFrame(pages, "page_id long, url string, html string").repartition(3)
    wanted = plain_identify([(i, h, s, " " + " " + body + " ") for i, h, s, body in records], [(t, lang) for _, t, lang in train])
    got = {r.id: (r.lang, r.probability) for r in language.identify(language.page_records(frame, model), model).collect()}
    for i in got:
        assert got[i][1] == pytest.approx(wanted[i][1], rel=1e-5), i
        assert got[i][0] == wanted[i][0]


#: The markup rules as backtracking patterns.
SKIP = re.compile(r"<(script|style)\b.*?</\1\s*>|<!--.*?-->|<[^>]*>", re.S | re.I)
DECLARED = re.compile(r"<html\b[^>]*?\b(?:xml:)?lang\s*=\s*[\"']?\s*([a-z]{2,3})|<meta\b[^>]*content-language[^>]*content\s*=\s*[\"']?\s*([a-z]{2,3})", re.I)


def test_markup_equals_the_patterns():
    rng = random.Random(4)
    pieces = ["<", ">", "<script", "</script>", "</SCRIPT >", "<style ", "</style>", "<!--", "-->", "--", "<html", " lang=", "xml:lang = 'de", "'en'", "fr", "<meta", " content-language", " content=", "x", " ", "&lt;", "<p>", "scriptx", "\n", '"', "hreflang=it"]
    for _ in range(4_000):
        page = "".join(rng.choice(pieces) for _ in range(rng.randrange(14)))
        found = DECLARED.search(page)
        assert language.declared(page) == ((found[1] or found[2]).lower() if found else None), page
        assert language.visible(page) == language.entities.unescape(SKIP.sub(" ", page)), page


@pytest.mark.parametrize("piece", ["<script>", "<!--", "<html ", "<meta content-language ", "<style", "</script ", "<", "<html lang= ", "lang" + " " * 50, "<meta content-language content=" + " " * 50])
def test_hostile_pages_take_linear_time(piece):
    page = piece * (1_000_000 // len(piece))
    start = time.perf_counter()
    language.visible(page)
    language.declared(page)
    assert time.perf_counter() - start < 3


def test_many_languages_stay_small(spark):
    own = lambda k: "".join("abcdefgh"[k // 8**j % 8] for j in range(4)) + " "
    rows = [(i, own(i % 2_000) * 10, f"l{i % 2_000:04d}", "s", 0) for i in range(6_000)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    model = language.fit_text(frame, held_out=9)
    assert len(model.languages) == 2_000
    assert sum(x.nbytes for x in (model.base, model.first, model.owner, model.gain)) < 50_000_000
    found = language.identify(language.document_records(frame.limit(300), model), model).select("lang").count()
    assert found == 300
