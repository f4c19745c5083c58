"""SQL twins against the operators on tables that the driver's small ones do not have: large hosts, repeated and missing ids."""

import duckdb
import pytest

from fieldstats.llm import fim, oracles, quality_rules


def twin(docs, sql):
    con = duckdb.connect()
    con.register("documents", docs.toArrow())
    rows = con.sql(sql)
    return rows.columns, rows.fetchall()


def same(found, docs, sql):
    columns, rows = twin(docs, sql)
    assert sorted(columns) == sorted(found.columns)
    assert sorted(map(str, (tuple(r[c] for c in columns) for r in found.collect()))) == sorted(map(str, rows))


def words(tag, n):
    return " ".join(f"{tag}x{j}" for j in range(n))


@pytest.mark.parametrize("partitions", [1, 7])
def test_op8_on_a_large_host_and_repeated_ids(spark, partitions):
    passage, rare = words("shared", 30), words("rare", 30)
    rows = [(i, words(f"own{i}", 55) + (f"\n{passage}" if i % 200 == 0 else "") + (f"\n{rare}" if i in (3, 5) else ""), "big") for i in range(2_400)]
    rows += [(i, f"{words(f'own{i}', 40)}\nSHARED line  of all\n{passage}", None) for i in range(3_000, 3_015)]
    rows += [(3_100, f"{words('again', 60)}\n{rare}", "big")] * 3 + [(3_101, f"{words('two', 55)}\n{passage}", "big"), (3_101, words("other", 60), "big")]
    rows += [(None, f"{words(f'nameless{k}', 55)}\nnameless line of words", "big") for k in range(12)] + [(3_200, None, "big"), (3_201, "a line\na line\n\na line", "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(partitions)
    judged = quality_rules.judge(docs).drop("host")
    same(judged, docs, oracles.OP8)
    by = {(r.doc_id, r.removed_words) for r in judged.collect()}
    assert (0, 30) in by and (3, 0) in by and (3_100, 0) in by and (3_101, 30) in by and (None, 4) in by


def test_op12_with_sentinels_and_missing_values(spark):
    rows = [(i, t) for i, t in enumerate([None, "", "<P> inside", "a<S>", "é漢 words\tand\nlines 12", "x" * 3_000] * 20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    same(fim.digests(docs), docs, oracles.OP12)
