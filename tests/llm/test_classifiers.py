import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from fieldstats.llm import language, quality_model, toxicity
from fieldstats.llm.text import U, fold, span_hashes, texts_of

BAD = ["vile", "rotten", "awful"]


@pytest.fixture(scope="module")
def labelled(spark):
    rng = random.Random(1)
    words = ["alpha", "beta", "gamma", "delta", "omega", "sigma", "kappa", "theta"]
    rows, labels = [], []
    for i in range(600):
        w = [rng.choice(words) for _ in range(rng.randrange(10, 60))]
        toxic, poor = i % 4 == 0, i % 5 == 2
        if toxic:
            for _ in range(2):
                w.insert(rng.randrange(len(w)), rng.choice(BAD))
        t = " ".join(x + rng.choice(["", "", "."]) for x in w)
        if poor:
            t = rng.choice([t.upper().replace(" ", "!! "), " ".join(x for x in w[:6] for _ in range(12)), t.replace(" ", " | ")])
        rows.append((i, t, "en", "s0", len(t)))
        labels.append((i, int(not poor), int(toxic)))
    rows += [(600, None, "en", "s0", None), (601, "", "en", None, 0), (602, "alpha " * 30_000, "en", "s0", 180_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    marks = spark.createDataFrame([*labels, (0, 0, 1), (700, None, None)], "doc_id long, quality int, toxic int")
    return docs, marks


@pytest.mark.parametrize(("module", "label"), [(toxicity, "toxic"), (quality_model, "quality")])
def test_held_out_accuracy(labelled, module, label):
    docs, marks = labelled
    truth = {r.doc_id: r[label] for r in marks.filter("doc_id > 0 and doc_id < 600").collect()}
    got = {r.doc_id: r for r in module.score(docs, module.fit(docs, marks)).collect()}
    assert len(got) == 603 and all(0 <= r.score <= 1 for r in got.values())
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got.values())
    held = [(r.predicted, truth[d]) for d, r in got.items() if r.held_out and d in truth]
    assert np.mean([a == b for a, b in held]) > 0.9
    assert got[600].score == got[601].score
    assert got[602].predicted == (0 if label == "toxic" else got[602].predicted)


def test_sentences_are_located(labelled, spark):
    docs, marks = labelled
    model = toxicity.fit(docs, marks)
    one = spark.createDataFrame([(1, "Alpha beta. Gamma vile awful delta! Omega."), (2, "Alpha.")], "doc_id long, text string")
    found = toxicity.locate(one, model).collect()
    assert [(r.doc_id, r.sentence) for r in found] == [(1, "Gamma vile awful delta")]
    kept = toxicity.keep(docs, model)
    assert kept.columns == docs.columns and 0 < kept.count() < docs.count()


def test_no_labels_and_empty_tables(labelled):
    docs, marks = labelled
    for module in (toxicity, quality_model):
        model = module.fit(docs, marks.limit(0))
        assert len({r.score for r in module.score(docs, model).collect()}) == 1
        assert module.score(docs.limit(0), model).count() == 0
        assert module.keep(docs, model).count() in (0, docs.count())


def test_length_alone_is_not_toxic(labelled):
    docs, marks = labelled
    model = toxicity.fit(docs, marks)
    one, many = model.score(texts_of(pa.array(["Unseen words here.", "Unseen words here. " * 5000])))
    assert one == pytest.approx(many)


def test_language_fusion(spark):
    rng = random.Random(2)
    stems = {"en": ["the", "and", "thing", "with"], "de": ["der", "und", "sch", "ein"], "fr": ["le", "et", "que", "oui"]}
    text = lambda lang, n: " ".join("".join(rng.choice(stems[lang]) for _ in range(rng.randrange(1, 4))) for _ in range(n))
    docs = spark.createDataFrame([(i, text(lang, 40), lang, lang, 0) for i in range(300) for lang in [list(stems)[i % 3]]], "doc_id long, text string, lang string, source string, n_chars long")
    model = language.fit_text(docs)
    assert model.languages == ["de", "en", "fr"]
    pages = []
    for i in range(90):
        lang = list(stems)[i % 3]
        pages.append((i, f"http://{lang}.site.{lang}/p{i}", f'<html lang="{lang}"><script>var der;</script><p>{text(lang, 30)}</p></html>'))
    pages += [(90, "http://de.site.de/x", None), (91, None, "<html lang=fr><p></p></html>"), (92, "not an address", ""), (93, "http://en.site.en/y", "<p>" + text("en", 20) + "</p>")]
    frame = spark.createDataFrame(pages, "page_id long, url string, html string")
    got = {r.id: r for r in language.identify(language.page_records(frame, model), model).collect()}
    assert len(got) == 94 and all(got[i].lang == list(stems)[i % 3] for i in range(90))
    assert got[90].lang == "de" and got[91].lang == "fr" and got[93].lang == "en"
    assert all(0 < r.probability <= 1 for r in got.values())
    assert language.identify(language.page_records(frame.limit(0), model), model).count() == 0
    none = language.fit_text(docs.limit(0))
    assert {r.lang for r in language.identify(language.page_records(frame, none), none).collect()} == {None}


def test_rare_languages_are_learnt(spark):
    rows = [(i, "word %d of the common language" % i, "en") for i in range(4000)] + [(i, "zyx qvw jkl " * 5, "xx") for i in range(4000, 4008)]
    schema = "doc_id long, text string, lang string"
    model = language.fit_text(spark.createDataFrame(rows, schema), rows=100)
    assert model.languages == ["en", "xx"]
    assert model.log_likelihood(texts_of(pa.array(["qvw jkl zyx", "the common word"]))).argmax(1).tolist() == [1, 0]
    own = lambda k: "".join("abcdef"[k // 6**j % 6] for j in range(3)) + " "
    many = [(i, own(i % 210) * 20, "l%03d" % (i % 210)) for i in range(2100)]
    frame = spark.createDataFrame(many, schema).withColumn("source", F.col("lang"))
    model = language.fit_text(frame)
    assert len(model.languages) == 210
    some = frame.filter("doc_id < 420")
    assert {(r.id, r.lang) for r in language.identify(language.document_records(some, model), model).collect()} >= {(0, "l000"), (209, "l209")}
    assert language.quotas({"a": 3, "b": 1000, "c": 70}, 100) == {"a": 3, "c": 48, "b": 49}


def test_markup():
    assert language.declared('<html class=x lang="EN-gb">') == "en"
    assert language.declared('<meta http-equiv="content-language" content="de">') == "de"
    assert language.declared("<p lang=fr>") is None
    assert language.visible("<style>a{}</style>x<!-- y --><b>z</b>&amp;").split() == ["x", "z", "&"]


def plain_sentences(text):
    """Words of letters by sentence, A-Z lower-cased; sentences end at . ! ? and line ends."""
    out = []
    for part in text.replace("!", ".").replace("?", ".").replace("\n", ".").split("."):
        words, word = [], bytearray()
        for b in [*part.encode(), 0]:
            b = b + 32 if 65 <= b <= 90 else b
            if 97 <= b <= 122 or b >= 128:
                word.append(b)
            elif word:
                words.append(bytes(word))
                word = bytearray()
        if words:
            out.append(words)
    return out


def bucket_of(word, bits):
    texts = texts_of(pa.array([word.decode()]))
    return int(span_hashes(texts.raw, np.array([0]), np.array([len(texts.raw)]))[0] >> U(64 - bits))


def test_toxicity_scores_are_the_noisy_or(labelled):
    docs, marks = labelled
    model = toxicity.fit(docs, marks)
    bad = [["fine words. VILE and vile rotten!\nawful?"], [""], ["alpha vile. beta rotten vile? " * 40]]
    for (text,) in bad:
        left = 1 - model.leak
        base = 1 / (1 + math.exp(-model.bias))
        for words in plain_sentences(text):
            z = model.bias + sum(float(model.weights[b]) for b in {bucket_of(w, toxicity.BUCKET_BITS) for w in words})
            left *= 1 - min(1 - 1e-12, max(0, (1 / (1 + math.exp(-max(-30, min(30, z)))) - base) / (1 - base)))
        assert model.score(texts_of(pa.array([text])))[0] == pytest.approx(1 - left, rel=1e-6)
    assert model.score(texts_of(pa.array([bad[0][0]])))[0] > 0.5


def test_toxicity_training_is_plain_gradient_ascent(monkeypatch):
    monkeypatch.setattr(toxicity, "STEPS", 6)
    rng = random.Random(5)
    texts = [". ".join(" ".join(rng.choice(["a", "b", "c", "vile", "rotten"]) for _ in range(4)) for _ in range(3)) for _ in range(40)]
    labels = [int("vile" in t) for t in texts]
    found = toxicity.train(texts_of(pa.array(texts)), np.array(labels))
    bags = [[set(s) for s in plain_sentences(t)] for t in texts]
    names = sorted({w for bag in bags for s in bag for w in s})
    w, sums, bias, leak_z = dict.fromkeys(names, 0.0), dict.fromkeys(names, 0.0), toxicity.BIAS, -3.0
    sigmoid = lambda x: 1 / (1 + math.exp(-max(-30, min(30, x))))
    for step in range(6):
        base, leak, gradient, pulls = sigmoid(bias), sigmoid(leak_z), dict.fromkeys(names, 0.0), []
        for bag, y in zip(bags, labels, strict=True):
            p = [sigmoid(bias + sum(w[x] for x in s)) for s in bag]
            none = 1 - leak
            for v in p:
                none *= 1 - min(1 - 1e-12, max(0, (v - base) / (1 - base)))
            pulls.append(none / max(1 - none, 1e-9) if y else -1.0)
            for s, v in zip(bag, p, strict=True):
                for x in s:
                    gradient[x] += v * pulls[-1]
        for x in names:
            sums[x] = 0.9 * sums[x] + 0.1 * gradient[x] ** 2
            rate = toxicity.RATE * (1 - step / 6) / math.sqrt(sums[x] + 1e-3)
            if step < 3:
                w[x] = max(w[x] + rate * (gradient[x] - toxicity.SHRINK * math.sqrt(40)), 0)
            elif w[x] > 0:
                w[x] = max(w[x] + rate * gradient[x], 1e-9)
        leak_z = max(-6, min(-1.5, leak_z + 2.0 * leak * sum(pulls) / len(pulls)))
    assert found.leak == pytest.approx(sigmoid(leak_z), rel=1e-9)
    for x in names:
        assert found.weights[bucket_of(x, toxicity.BUCKET_BITS)] == pytest.approx(w[x], rel=1e-5, abs=1e-9), x


def plain_features(text):
    """Buckets of words, word pairs and byte n-grams of a text, each as often as it occurs."""
    raw = text.encode()
    words = [w for w in re.split(rb"[\x20\x09-\x0D]+", raw) if w]
    h = [int(span_hashes(np.frombuffer(w, np.uint8), np.array([0]), np.array([len(w)]))[0]) for w in words]
    pair = lambda a, b: quality_model._SAME if a == b else int(fold(np.array([a], U), np.array([b], U))[0])
    out = [x >> 64 - quality_model.BUCKET_BITS for x in [*h, *(pair(a, b) for a, b in zip(h, h[1:]))]]
    blank = lambda b: b == 32 or 9 <= b <= 13
    for n in quality_model.NGRAMS:
        for i in range(len(raw) - n + 1):
            gram = raw[i : i + n]
            if any(blank(b) for b in gram[1:-1]):
                continue
            x = sum((32 if blank(b) else b) << 8 * k for k, b in enumerate(gram)) & 0xFFFFFFFF
            x = (x ^ n * 0x3C6EF372 & 0xFFFFFFFF) * 0x9E3779B1 & 0xFFFFFFFF
            x = (x ^ x >> 15) * 0x85EBCA77 & 0xFFFFFFFF
            out.append(x >> 32 - quality_model.BUCKET_BITS)
    return out


def test_quality_scores_are_means_of_plain_features(labelled):
    docs, marks = labelled
    model = quality_model.fit(docs, marks)
    for text in ("alpha beta  gamma\nalpha alpha", "x", "", "é ü 漢字 words", "one " * 300):
        f = plain_features(text)
        z = model.bias + sum(float(model.table[b]) for b in f) / max(1, len(f))
        assert model.score(texts_of(pa.array([text])))[0] == pytest.approx(1 / (1 + math.exp(-z)), rel=1e-5)


def test_quality_training_is_plain_gradient_descent(monkeypatch):
    monkeypatch.setattr(quality_model, "EPOCHS", 2)
    texts, labels = ["alpha beta gamma", "beta | beta", "gamma delta alpha", "x | y"], [1, 0, 1, 0]
    found = quality_model.train(texts_of(pa.array(texts)), np.array(labels))
    rng = np.random.default_rng(quality_model.SEED)
    start = rng.uniform(-1 / quality_model.DIM, 1 / quality_model.DIM, (1 << quality_model.BUCKET_BITS, quality_model.DIM))
    bags = [Counter(plain_features(t)) for t in texts]
    v = {b: [float(x) for x in start[b]] for bag in bags for b in bag}
    out, bias, dims, step = [[0.0, 0.0] for _ in range(quality_model.DIM)], [0.0, 0.0], range(quality_model.DIM), 0
    for _ in range(2):
        for i in rng.permutation(4):
            rate, step = quality_model.RATE * (1 - step / 8), step + 1
            total = sum(bags[i].values())
            mean = [sum(n * v[b][d] for b, n in bags[i].items()) / total for d in dims]
            z = [sum(mean[d] * out[d][c] for d in dims) + bias[c] for c in (0, 1)]
            e = [math.exp(x - max(z)) for x in z]
            error = [e[c] / sum(e) - (labels[i] == c) for c in (0, 1)]
            pull = [sum(out[d][c] * error[c] for c in (0, 1)) for d in dims]
            for d in dims:
                for c in (0, 1):
                    out[d][c] -= rate * mean[d] * error[c]
            bias = [bias[c] - rate * 0.01 * error[c] for c in (0, 1)]
            for b, n in bags[i].items():
                v[b] = [v[b][d] - rate * n / total * pull[d] for d in dims]
    assert found.bias == pytest.approx(bias[1] - bias[0], rel=1e-4)
    for b in v:
        assert found.table[b] == pytest.approx(sum(v[b][d] * (out[d][1] - out[d][0]) for d in dims), rel=1e-3, abs=1e-5)
