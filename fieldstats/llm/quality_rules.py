"""Quality rules by cross-document line frequency.

Lines are normalised (A-Z lower-cased, white space squeezed, as their word
sequence) and hashed.  For each host the documents that hold a line are counted;
a line is frequent when more than `min_docs` of them hold it, however large the
host.  A caller may ask for more than `max_share` of the host's documents besides;
no share is asked for by default.  Frequent lines are removed, and a document with
less than `min_left` of its words left is depleted.  Base rules on the text itself
are computed in the same pass.

Defined cases: a null or empty text has no lines and fails the base rules; a
null host is a host of its own; a line repeated within one document counts once
for the limits and is removed every time.  Rows of one doc_id count as one document
for the limits and are judged each by itself; a row without doc_id is a document of
its own.  Empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldstats.llm.store import join_keyed, stage
from fieldstats.llm.text import Texts, U, fold, lists, mix, slices, span_hashes, texts_of

MIN_DOCS = 10
MIN_LEFT = 0.5
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_NEWLINE = np.zeros(256, bool)
_NEWLINE[0x0A] = True

SCHEMA = "row long, doc_id long, host string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, lines array<long>, line_words array<int>"


def line_words(texts: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, hash and word count of each line with a word; the hash is that of its lower-case word sequence."""
    words = texts.words(lower=True)
    breaks = np.concatenate([[0], np.cumsum(_NEWLINE[texts.raw])])
    line = breaks[words.starts]
    new = np.ones(len(line), bool)
    new[1:] = (line[1:] != line[:-1]) | (words.text[1:] != words.text[:-1])
    first = np.flatnonzero(new)
    n = np.diff(np.append(first, len(line)))
    with np.errstate(over="ignore"):
        place = (np.arange(len(line)) - np.repeat(first, n)).astype(U)
        each = mix(words.hashes + mix(place + U(1)))
        total = np.concatenate([np.zeros(1, U), np.cumsum(each)])
        hashes = mix(total[first + n] - total[first] + n.astype(U)) if len(first) else np.zeros(0, U)
    return words.text[first], hashes, n


def base_counts(texts: Texts) -> dict[str, np.ndarray]:
    """Counts of the base rules for each text."""
    words = texts.words(lower=False)
    continued = (texts.raw & 0xC0) == 0x80
    inside = np.concatenate([[0], np.cumsum(~continued)])
    chars = np.bincount(words.text, inside[words.ends] - inside[words.starts], texts.n).astype(np.int64)
    starts, ends, text = texts.runs(_NEWLINE[texts.raw])
    held = np.searchsorted(words.starts, starts) < np.searchsorted(words.starts, ends)
    starts, ends, text = starts[held], ends[held], text[held]
    where = np.unique(fold(text.astype(U), span_hashes(texts.raw, starts, ends)), return_index=True)[1]
    dup = np.bincount(text, minlength=texts.n) - np.bincount(text[where], minlength=texts.n)
    grams, owner, at = words.shingles(3, short=False)
    repeated = np.zeros(len(words.starts) + 2, bool)
    if len(grams):
        keys = fold(owner.astype(U), grams)
        order = np.argsort(keys, kind="stable")
        same = np.zeros(len(keys) + 1, bool)
        same[1:-1] = keys[order][1:] == keys[order][:-1]
        hit = at[order][same[1:] | same[:-1]]
        for i in range(3):
            repeated[hit + i] = True
    repeats = np.bincount(words.text[repeated[: len(words.starts)]], minlength=texts.n)
    return {"n_words": words.counts, "word_chars": chars, "n_symbols": texts.sums(_SYMBOL[texts.raw]), "n_dup_lines": dup, "n_repeat_words": repeats}


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch, texts in slices(batches):
        base = base_counts(texts)
        text, hashes, n = line_words(texts)
        order = np.lexsort((hashes, text))
        text, hashes, n = text[order], hashes[order], n[order]
        new = np.ones(len(text), bool)
        new[1:] = (text[1:] != text[:-1]) | (hashes[1:] != hashes[:-1])
        at = np.flatnonzero(new)
        n = np.add.reduceat(n, at) if len(at) else n
        columns = [batch.column(0), batch.column(1).cast(pa.int64()), batch.column(2).cast(pa.string()), *(pa.array(base[c].astype(np.int64)) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")), lists(hashes[at], text[at], texts.n, pa.int64()), lists(n.astype(np.int32), text[at], texts.n, pa.int32())]
        yield pa.RecordBatch.from_arrays(columns, ["row", "doc_id", "host", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "lines", "line_words"])


def measure(docs: DataFrame, host: str = "source", row: str | None = None) -> DataFrame:
    """Base counts and the distinct line hashes of each row; `row` is that column or else a number for as long as the table is not read again."""
    return docs.select((F.col(row) if row else F.monotonically_increasing_id()).alias("row"), "doc_id", F.col(host).cast("string").alias("host"), "text").mapInArrow(_measure, SCHEMA)


def frequent_lines(measured: DataFrame, min_docs: int = MIN_DOCS, max_share: float | None = None) -> DataFrame:
    """host, line, n_docs and n_rows (rows that hold it) of lines in more than min_docs documents of a host, and above the share if one is given."""
    lines = measured.select("host", F.coalesce("doc_id", "row").alias("document"), F.col("doc_id").isNull().alias("nameless"), F.explode("lines").alias("line"))
    lines = lines.groupBy("host", "line").agg(F.countDistinct("document", "nameless").alias("n_docs"), F.count("*").alias("n_rows")).filter(F.col("n_docs") > min_docs)
    if max_share is None:
        return lines
    hosts = measured.groupBy("host").agg((F.countDistinct("doc_id") + F.count_if(F.col("doc_id").isNull())).alias("n_host"))
    same = lines["host"].eqNullSafe(hosts["host"])
    return lines.join(hosts, same).filter(F.col("n_docs") > max_share * F.col("n_host")).select(lines["host"], "line", "n_docs", "n_rows")


def judge(docs: DataFrame, host: str = "source", min_docs: int = MIN_DOCS, max_share: float | None = None, min_left: float = MIN_LEFT, row: str | None = None) -> DataFrame:
    """Counts, words in removed lines, base verdict and final verdict of each document; with `row` also that column and the hashes of its removed lines."""
    measured = stage(measure(docs, host, row), "lines")
    # a line that every document of a host has would bring them all to one task: such keys are broadcast
    key = F.xxhash64(F.col("host").isNull(), F.coalesce("host", F.lit("")), "line").alias("key")
    frequent = stage(frequent_lines(measured, min_docs, max_share).select(key, F.col("host").alias("at_host"), F.col("line").alias("at_line"), "n_rows"), "frequent-lines")
    held = measured.select("row", "host", F.explode(F.arrays_zip("lines", "line_words")).alias("x")).select("row", "host", F.col("x.lines").alias("line"), F.col("x.line_words").alias("n")).select("row", "host", "line", "n", key)
    found = join_keyed(held, frequent, "key", "n_rows").filter(F.col("host").eqNullSafe(F.col("at_host")) & (F.col("line") == F.col("at_line")))
    removed = found.groupBy("row").agg(F.sum("n").alias("removed"), *([F.collect_set("line").alias("removed_lines")] if row else []))
    base = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    out = measured.drop("lines", "line_words").join(removed, "row", "left").withColumn("removed_words", F.coalesce("removed", F.lit(0))).drop("removed", *([] if row else ["row"]))
    left = F.col("n_words") - F.col("removed_words")
    return out.withColumn("base_failed", base).withColumn("kept", ~base & (left >= min_left * F.col("n_words")))


def clean(docs: DataFrame, host: str = "source", **limits) -> DataFrame:
    """docs without the rejected rows, and with frequent lines taken out of `text`; every row is judged and cut by itself."""
    rows = stage(docs.withColumn("_row", F.monotonically_increasing_id()), "rows")
    kept = judge(rows, host, **limits, row="_row").filter("kept").select(F.col("row").alias("_row"), F.coalesce("removed_lines", F.array().cast("array<long>")).alias("_gone"))
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            gone = batch.column(len(docs_columns)).to_pylist()
            texts = [_without(t, set(g)) if g else t for t, g in zip(batch.column(at).to_pylist(), gone, strict=True)]
            columns = [pa.array(texts, batch.schema.types[i]) if i == at else batch.column(i) for i in range(len(docs_columns))]
            yield pa.RecordBatch.from_arrays(columns, docs_columns)

    docs_columns = docs.columns
    return rows.join(kept, "_row").select(*docs_columns, "_gone").mapInArrow(run, docs.schema)


def _without(text: str, gone: set[int]) -> str:
    """The text without the lines of these hashes."""
    rows = text.split("\n")
    at, hashes, _ = line_words(texts_of(pa.array(rows, pa.string())))
    out = {int(i) for i, h in zip(at, hashes.view(np.int64), strict=True) if int(h) in gone}
    return "\n".join(r for i, r in enumerate(rows) if i not in out)
