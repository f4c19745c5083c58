import os

import pytest

pytest.importorskip("public_tokenizers")
import __spark_entry__ as entry  # noqa: E402
import corpus_pipeline  # noqa: E402
from fieldstats.llm import decontaminate, quality_model, store, toxicity  # noqa: E402
from tests.llm.test_decontaminate import plain as windows  # noqa: E402
from tests.llm.test_jaccard import plain as components  # noqa: E402

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="driver tables not present")


def test_queries_are_registered():
    names = entry.queries()
    assert "pipeline" in names and all(any(n.startswith(f"op{i}_") for n in names) for i in range(1, 11))


def test_each_stage_against_a_plain_version(spark):
    docs = store.load(spark, DATA, "documents")
    labels, bench = store.load(spark, DATA, "labels"), store.load(spark, DATA, "benchmark")
    for name, f in corpus_pipeline.STAGES:
        before = {r.doc_id: r.text for r in docs.collect()}
        out = store.stage(f(spark, docs, DATA), name.replace(" ", "-"))
        after = {r.doc_id for r in out.collect()}
        if name == "quality classifier":
            wanted = {r.doc_id for r in quality_model.score(docs, quality_model.fit(docs, labels)).filter("predicted = 1").collect()}
        elif name == "toxicity":
            wanted = {r.doc_id for r in toxicity.score(docs, toxicity.fit(docs, labels)).filter("predicted = 0").collect()}
        elif name == "n-gram Jaccard join":
            wanted = {d for d, (_, c) in components(list(before.items()), 5, 80).items() if c == d}
        elif name == "benchmark decontamination":
            wanted = set(before) - {d for d, _ in windows(list(before.items()), [(r.item_id, r.text) for r in bench.collect()])}
        else:
            wanted = set(before)
        assert after == wanted, name
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.schema == docs.schema
        docs = out
    assert {r.doc_id for r in corpus_pipeline.run(spark, DATA).collect()} == after


def test_stages_take_extra_columns_and_empty_tables(spark):
    docs = store.load(spark, DATA, "documents").selectExpr("*", "1 as label", "'x' as kept", "doc_id as item_id", "2 as n", "'k' as `class`")
    for _, f in corpus_pipeline.STAGES[:-1]:
        assert f(spark, docs, DATA).columns == docs.columns
        assert f(spark, docs.limit(0), DATA).count() == 0
    assert decontaminate.contaminated(docs, store.load(spark, DATA, "benchmark")).count() >= 0
