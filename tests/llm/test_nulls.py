"""Rows without an id, clashing column names and repeated rows in every operator."""

import hashlib
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from fieldstats.llm import decontaminate, encoding, jaccard, katz, labelled, language, quality_model, quality_rules, shards, token_counts, toxicity
from fieldstats.llm.queries import vocabulary_path
from fieldstats.llm.text import texts_of

CLASHES = ["1 as label", "'x' as `class`", "2 as shingles", "3 as train", "4 as n", "'h' as host", "5 as lines", "6 as size", "7 as shard", "8 as id", "9 as kept", "10 as score"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(1, "a b c d e f", None, None, 0), (None, "a b c d e f", None, None, 0), (2, None, "en", "s", None), (2, None, "en", "s", None), (None, None, None, None, None), (3, "x " * 40_000, "en", "s", 1), (4, "", "de", "s", 0)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").selectExpr("*", *CLASHES)


def test_every_operator_returns_every_row(spark, docs):
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 1), (None, 1, 1)], "doc_id long, quality int, toxic int")
    bench = spark.createDataFrame([(1, "a b c d e f"), (None, "q"), (3, None)], "item_id long, text string")
    assert katz.score(docs).count() == 7
    assert {r.doc_id for r in katz.score(docs).collect()} == {1, 2, 3, 4, None}
    joined = {(r.doc_id, r.n_shingles, r.component_id) for r in jaccard.join(docs, 3, 90).collect()}
    assert (1, 4, 1) in joined and (None, 4, 1) in joined and (2, 0, 2) in joined
    assert jaccard.dedupe(docs).columns == docs.columns and jaccard.dedupe(docs).filter("doc_id is null").count() == 2
    assert quality_rules.judge(docs).count() == 7 and quality_rules.clean(docs).columns == docs.columns
    assert shards.shard_documents(docs, 3).count() == 7
    for module in (toxicity, quality_model):
        model = module.fit(docs, labels)
        plain = {t: float(model.score(texts_of(pa.array([t])))[0]) for t in ("a b c d e f", "", "x " * 40_000)}
        scored = module.score(docs, model).collect()
        wanted = [(r.doc_id, plain[r.text or ""], r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in docs.collect()]
        assert sorted(map(str, ((r.doc_id, r.held_out) for r in scored))) == sorted(map(str, ((i, h) for i, _, h in wanted)))
        assert sorted(r.score for r in scored) == pytest.approx(sorted(p for _, p, _ in wanted), rel=1e-6)
        assert all(r.predicted == (r.score >= module.THRESHOLD) for r in scored)
        stays = (lambda p: p < module.THRESHOLD) if module is toxicity else (lambda p: p >= module.THRESHOLD)
        kept = module.keep(docs, model)
        assert kept.columns == docs.columns and kept.count() == sum(stays(p) for _, p, _ in wanted)
    found = decontaminate.contaminated(docs, bench).collect()
    assert {(r.doc_id, r.item_id) for r in found} == {(1, 1), (None, 1)}
    assert decontaminate.clean(docs, bench).count() == 5
    model = language.fit_text(docs)
    found = language.identify(language.document_records(docs, model), model).collect()
    assert sorted(map(str, (r.id for r in found))) == sorted(map(str, (r.doc_id for r in docs.collect())))
    # no labelled text is short enough to learn from and not empty
    assert {(r.lang, r.probability) for r in found} == {(None, None)}
    short = docs.withColumn("lang", F.when(F.col("doc_id") == 1, "de").when(F.col("doc_id") == 2, "en").otherwise(F.col("lang"))).withColumn("text", F.when(F.col("doc_id") == 2, "the other words").otherwise(F.col("text")))
    model = language.fit_text(short, held_out=9)
    found = {(r.id, r.lang) for r in language.identify(language.document_records(short, model), model).collect()}
    assert model.languages == ["de", "en"] and {(1, "de"), (None, "de"), (2, "en")} <= found and {lang for _, lang in found} == {"de", "en"}


def test_encodings_of_missing_and_repeated_rows(docs):
    path = vocabulary_path()
    tokens = Tokenizer.from_file(path)
    tokens.no_truncation()
    tokens.no_padding()
    wanted = []
    for r in docs.collect():
        ids = tokens.encode(r.text or "", add_special_tokens=False).ids
        sha = lambda b: hashlib.sha256(b).hexdigest()
        wanted.append((r.doc_id, len((r.text or "").encode()), len(ids), sha(np.array(ids, "<u4").tobytes()), sha(tokens.decode(ids, skip_special_tokens=False).encode())))
    coded = {str((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256)) for r in encoding.digests(docs, path).collect()}
    assert coded == {str((w[0], *w[2:])) for w in wanted}
    counted = sorted(str((r.doc_id, r.n_bytes, r.n_tokens, r.over_limit)) for r in token_counts.count(docs, path).collect())
    assert counted == sorted(str((*w[:3], w[2] > 512)) for w in wanted)
    assert encoding.digests(docs, path).count() == 7


def test_rows_are_judged_and_cut_by_themselves(spark):
    """Repeated and missing ids: removed words are those of the row, and no kept row or line is lost."""
    frequent = "the same line of twenty words " + " ".join(f"w{i}" for i in range(14))
    own = lambda i: " ".join(f"own{i}x{j}" for j in range(60))
    rows = [(i, f"{own(i)}\n{frequent}", "h") for i in range(12)]
    rows += [(100, f"{own(100 + i)}\n{frequent}", "h") for i in range(4)] + [(None, f"{own(200)}\n{frequent}", "h"), (None, own(201), "h")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    judged = quality_rules.judge(docs).collect()
    assert sorted((r.doc_id is None, r.removed_words) for r in judged) == sorted([(False, 20)] * 16 + [(True, 20), (True, 0)])
    assert all(r.kept for r in judged)
    kept = quality_rules.clean(docs)
    assert kept.schema == docs.schema
    assert sorted(r.text for r in kept.collect()) == sorted(t.split("\n")[0] for _, t, _ in rows)


def test_slots_do_not_follow_the_order_of_rows(spark):
    rows = [(1, "a"), (1, "b"), (1, "c"), (None, "d"), (None, "e"), (2, "a")] * 3
    placed = [sorted(map(str, shards.shard_documents(spark.createDataFrame(r, "doc_id long, text string").repartition(n), 2).collect())) for r, n in ((rows, 1), (rows[::-1], 4))]
    assert placed[0] == placed[1]


def test_repeated_rows_of_one_label_are_collected_once(spark):
    docs = spark.createDataFrame([(1, f"text {i}") for i in range(50)] + [(2, "other")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, toxic int")
    texts, found = labelled.sample(docs, labels, "toxic", held_out=9)
    assert texts.n == 2 and sorted(found.tolist()) == [0, 1]


def test_labels_without_a_usable_text_take_up_no_place(spark):
    labels = spark.range(20_000).selectExpr("id AS doc_id", "cast(id % 2 AS int) AS toxic")
    docs = spark.range(0, 20_000, 40).selectExpr("id AS doc_id", "CASE WHEN id % 80 = 0 THEN repeat('long ', 9000) WHEN id % 400 = 40 THEN 'a copy' ELSE concat('text ', id) END AS text")
    texts, found = labelled.sample(docs, labels, "toxic", rows=60)
    held = [i for i in range(0, 20_000, 40) if i % 80 and zlib.crc32(str(i).encode()) % 5]
    usable = len([i for i in held if i % 400 != 40]) + 1
    assert texts.n == len(found) == 60 < usable
    every, _ = labelled.sample(docs, labels, "toxic")
    assert every.n == usable
    again, _ = labelled.sample(docs.repartition(5), labels.repartition(3), "toxic", rows=60)
    assert (again.raw == texts.raw).all()
