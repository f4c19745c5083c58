"""Language identification by fusing evidence with Bayes' rule.

Evidence of a record: its text, the language its markup declares, the suffix of
its address, and its host.

- Text: naive Bayes over hashed byte trigrams (letters only, A-Z lower-cased),
  fitted on a bounded sample of labelled documents: the languages are those of all
  labelled documents, however many, and each has an equal share of the sample and
  one document at least, what it cannot fill going to the others.  The log likelihood is
  tempered to EVIDENCE trigrams at most, as neighbouring trigrams overlap.
- Declared language and suffix: P(value | language), from the text posteriors
  of all records summed by a grouped aggregation, smoothed.
- Host: a prior smoothed hierarchically, host to registered domain to all
  records, again from grouped sums; a record's own share is taken out first, so
  that it does not confirm itself.

The posterior is the normalised product.  Sums are DataFrame aggregations of small
rows (key, language), pre-aggregated before shuffles, and joined back by their key.

Tables are sparse, so that many languages cost what the sample holds and no more: the text model
keeps the trigrams that a language has; a record keeps what they add to a
baseline, and its votes of at least LEAST_VOTE.  A record without trigrams has no vote.

Defined cases: a null or empty text has a flat likelihood, so declaration,
suffix and host decide; a null address, a host of no name and a missing
declaration are values of their own that say nothing; ties go to the language
first in alphabetical order.  Repeated rows are scored alike.  Markup is read in one pass forward, so that
a page of unclosed tags, comments or scripts of any length takes linear time: what
is never closed is text, as is a tag without an end.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fieldstats.llm.labelled import SAMPLE_BYTES, SAMPLE_ROWS
from fieldstats.llm.store import fold_of, stage
from fieldstats.llm.text import _LOWER, Texts, lists, parts, slices, texts_of, trim

BITS = 16
EVIDENCE = 200
HOST_WEIGHT = 5.0
DOMAIN_WEIGHT = 20.0
SMOOTH = 1.0
HOT_KEYS = 256
LEAST_VOTE = 1e-9
#: Numbers of a dense block of records by languages.
CELLS = 2_000_000

_LETTER = np.zeros(256, bool)
_LETTER[ord("a") : ord("z") + 1] = True
_LETTER[0x80:] = True


@dataclass
class TextModel:
    """log P(trigram bucket | language): `base` for buckets that a language lacks, and for those it has, by bucket, what they add to that."""

    languages: list[str]
    base: np.ndarray
    first: np.ndarray  # entries of bucket b: first[b] to first[b + 1]
    owner: np.ndarray
    gain: np.ndarray

    @classmethod
    def of(cls, languages: list[str], keys: np.ndarray, n: np.ndarray) -> TextModel:
        """From distinct keys (bucket * languages + language), in order, and how often each occurs; each bucket counts half an occurrence more."""
        k = max(1, len(languages))
        bucket, owner = keys // k, keys % k
        total = np.bincount(owner, n, len(languages)) + 0.5 * (1 << BITS)
        first = np.searchsorted(bucket, np.arange((1 << BITS) + 1))
        return cls(languages, np.log(0.5 / total), first, owner.astype(np.int32), np.log((n + 0.5) / 0.5).astype(np.float32))

    def evidence(self, texts: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Tempered trigrams of each text; text, language and tempered gain of the languages that share a trigram with it, in order."""
        k = max(1, len(self.languages))
        buckets, text = trigrams(texts)
        n = np.bincount(text, minlength=texts.n)
        scale = np.minimum(1, EVIDENCE / np.maximum(n, 1))
        buckets, counts = np.unique(text * np.int64(1 << BITS) + buckets, return_counts=True)
        text, buckets = buckets >> BITS, buckets & ((1 << BITS) - 1)
        held = self.first[buckets + 1] - self.first[buckets]
        at = np.arange(held.sum()) - np.repeat(np.cumsum(held) - held - self.first[buckets], held)
        names, where = np.unique(np.repeat(text, held) * np.int64(k) + self.owner[at], return_inverse=True)
        gain = np.bincount(where, np.repeat(counts, held) * self.gain[at], len(names))
        return n * scale, names // k, names % k, gain * scale[names // k]

    def log_likelihood(self, texts: Texts) -> np.ndarray:
        """Tempered log likelihood of each text under each language."""
        length, text, owner, gain = self.evidence(texts)
        out = length[:, None] * self.base
        out[text, owner] += gain
        return out


def trigrams(texts: Texts) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and text of each byte trigram; runs of other bytes count as one blank, trigrams of no letter are left out."""
    data = _LOWER[texts.raw]
    data = np.where(_LETTER[data], data, np.uint8(32)).astype(np.uint32)
    first = np.concatenate([[True], data[:-1] != 32])[: len(data)]
    first[texts.offsets[:-1][texts.sizes > 0]] = True  # a text's first blank counts, whatever text stands before it
    at = np.flatnonzero((data != 32) | first)
    owner = np.repeat(np.arange(texts.n), texts.sizes)[at]
    data = data[at]
    if len(data) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    same = (owner[2:] == owner[:-2]) & (data[1:-1] != 32)
    packed = data[:-2] | data[1:-1] << np.uint32(8) | data[2:] << np.uint32(16)
    hashed = packed[same] * np.uint32(0x9E3779B1)
    hashed ^= hashed >> np.uint32(15)
    return (hashed * np.uint32(0x85EBCA77) >> np.uint32(32 - BITS)).astype(np.int64), owner[2:][same]


def quotas(held: dict[str, int], rows: int) -> dict[str, int]:
    """Rows to take of each language: equal shares, what small languages leave going to larger ones; one row at least."""
    out, left = {}, rows
    for i, (name, n) in enumerate(sorted(held.items(), key=lambda x: (x[1], x[0]))):
        out[name] = min(n, max(1, left // (len(held) - i)))
        left -= out[name]
    return out


def choose(usable: DataFrame, rows: int) -> tuple[DataFrame, list[str]]:
    """The rows of smallest id hash of each label, by its quota, and all labels.

    Rows far above their label's quota are left out by hash before they are ranked, so
    that no task sees all rows of a label.
    """
    found = usable.groupBy("label").count().collect()
    held = {r["label"]: r["count"] for r in found}
    take = quotas(held, rows)
    most = {name: (1 << 63) - 1 if 2 * q + 50 >= held[name] else int((2 * q + 50) / held[name] * (1 << 64)) - (1 << 63) for name, q in take.items()}
    if not held:
        return usable, []
    of = lambda values: F.create_map(*(F.lit(x) for pair in values.items() for x in pair))[F.col("label")]
    near = usable.withColumn("_hash", F.xxhash64("doc_id")).filter(F.col("_hash") <= of(most))
    rank = F.row_number().over(Window.partitionBy("label").orderBy("_hash", "doc_id"))
    return near.withColumn("_rank", rank).filter(F.col("_rank") <= of(take)).drop("_hash", "_rank"), sorted(held)


def fit_text(docs: DataFrame, language: str = "lang", held_out: int = 0, rows: int = SAMPLE_ROWS) -> TextModel:
    """Trigram tables from at most `rows` labelled texts of at most SAMPLE_BYTES bytes outside the held-out fold."""
    usable = docs.filter(F.col(language).isNotNull() & (fold_of() != held_out) & (F.octet_length("text").between(1, SAMPLE_BYTES)))
    chosen, names = choose(usable.select("doc_id", "text", F.col(language).cast("string").alias("label")), rows)
    found = chosen.toArrow().combine_chunks()
    labels = np.searchsorted(names, found.column("label").to_pylist()).astype(np.int64) if names else np.zeros(0, np.int64)
    keys, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for part, first in parts(texts_of(found.column("text"))) if names else ():
        buckets, text = trigrams(part)
        new, n = np.unique(buckets * np.int64(len(names)) + labels[text + first], return_counts=True)
        keys, at = np.unique(np.concatenate([keys, new]), return_inverse=True)
        counts = np.bincount(at, np.concatenate([counts, n]), len(keys)).astype(np.int64)
    trim()
    return TextModel.of(names, keys, counts)


_KIND = re.compile(r"(script|style)\b|!--", re.I)
_CLOSE = {"script": re.compile(r"</script\s*+>", re.I), "style": re.compile(r"</style\s*+>", re.I), "!--": re.compile("-->")}
_HTML, _META = re.compile(r"<html\b", re.I), re.compile(r"<meta\b", re.I)
_LANG = re.compile(r"\b(?:xml:)?lang\s*+=\s*+[\"']?+\s*+([a-z]{2,3})", re.I)
_NAMED = re.compile("content-language", re.I)
_CONTENT = re.compile(r"content\s*+=\s*+[\"']?+\s*+([a-z]{2,3})", re.I)


def visible(page: str) -> str:
    """The text of a page: tags, comments, scripts and styles become a blank, entities their characters."""
    out, at, unclosed = [], 0, set()
    while (start := page.find("<", at)) >= 0:
        end, kind = -1, _KIND.match(page, start + 1)
        name = kind and (kind[1] or "!--").lower()
        if name and name not in unclosed:
            closed = _CLOSE[name].search(page, kind.end())
            if closed:
                end = closed.end()
            else:
                unclosed.add(name)  # nor is a later one closed
        if end < 0:
            end = page.find(">", start) + 1
            if not end:
                break
        out += [page[at:start], " "]
        at = end
    return entities.unescape("".join([*out, page[at:]]))


def declared(page: str) -> str | None:
    """Language of the first html tag with a lang attribute, or content-language tag, that has one.

    A tag ends at the next `>`, so each piece up to one is searched once.
    """
    start = 0
    while start < len(page):
        end = page.find(">", start)
        end = len(page) if end < 0 else end
        found = []
        if tag := _HTML.search(page, start, end):
            if said := _LANG.search(page, tag.end(), end):
                found.append((tag.start(), said[1]))
        if tag := _META.search(page, start, end):
            named = _NAMED.search(page, tag.end(), end)
            said = [m[1] for m in _CONTENT.finditer(page, named.end(), end)] if named else []
            if said:
                found.append((tag.start(), said[-1]))
        if found:
            return min(found)[1].lower()
        start = end + 1
    return None


_FIELDS = ["id", "host", "declared", "length", "seen", "gain", "voted", "p"]
RECORD = "id long, host string, declared string, length double, seen array<int>, gain array<double>, voted array<int>, p array<double>"


def blocks(n: int, k: int) -> Iterator[slice]:
    """Runs of records whose dense rows hold about CELLS numbers."""
    size = max(1, CELLS // max(1, k))
    for start in range(0, n, size):
        yield slice(start, min(n, start + size))


def dense(values: np.ndarray, owner: np.ndarray, column: np.ndarray, rows: slice, k: int) -> np.ndarray:
    """Rows of a sparse table as an array."""
    a, b = np.searchsorted(owner, [rows.start, rows.stop])
    out = np.zeros((rows.stop - rows.start, k))
    out[owner[a:b] - rows.start, column[a:b]] = values[a:b]
    return out


def record_columns(model: TextModel, texts: Texts) -> list[pa.Array]:
    """length, seen, gain, voted and p of each text."""
    k, n = len(model.languages), texts.n
    length, text, owner, gain = model.evidence(texts)
    voters, voted, p = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]
    for rows in blocks(n, k) if k else ():
        share = softmax(length[rows, None] * model.base + dense(gain, text, owner, rows, k))
        share[length[rows] == 0] = 0
        at, which = np.nonzero(share >= LEAST_VOTE)
        voters.append(at + rows.start)
        voted.append(which)
        p.append(share[at, which])
    voters = np.concatenate(voters)
    sparse = lambda values, owner, kind: lists(values, owner, n, kind)
    return [pa.array(length), sparse(owner.astype(np.int32), text, pa.int32()), sparse(gain, text, pa.float64()), sparse(np.concatenate(voted).astype(np.int32), voters, pa.int32()), sparse(np.concatenate(p), voters, pa.float64())]


def page_records(pages: DataFrame, model: TextModel) -> DataFrame:
    """id, host, declared and text evidence of raw web pages."""
    shared = pages.sparkSession.sparkContext.broadcast(model)  # as large as the trigrams of the sample

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, _ in slices(batches, "html"):
            raw = [x or "" for x in batch.column(2).to_pylist()]
            texts = texts_of(pa.array([visible(x) for x in raw], pa.string()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([declared(x) for x in raw], pa.string()), *record_columns(shared.value, texts)], _FIELDS)

    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#]*@)?([^/?#:]*)", 1))
    return pages.select(F.col("page_id").cast("long").alias("id"), host.alias("host"), "html").mapInArrow(run, RECORD)


def document_records(docs: DataFrame, model: TextModel, host: str = "source") -> DataFrame:
    """id, host, declared (none) and text evidence of plain documents."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in slices(batches):
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([None] * texts.n, pa.string()), *record_columns(shared.value, texts)], _FIELDS)

    return docs.select(F.col("doc_id").cast("long").alias("id"), F.coalesce(F.lower(F.col(host).cast("string")), F.lit("")).alias("host"), "text").mapInArrow(run, RECORD)


def softmax(values: np.ndarray) -> np.ndarray:
    raised = np.exp(values - values.max(1, keepdims=True))
    return raised / raised.sum(1, keepdims=True)


def table(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Values of a list column and the row of each."""
    held = np.nan_to_num(column.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64)
    return column.flatten().to_numpy(zero_copy_only=False), np.repeat(np.arange(len(column)), held)


@dataclass
class Evidence:
    """Fusion of one batch: own votes are taken out of every sum first."""

    total: np.ndarray

    def posterior(self, likelihood: np.ndarray, p: np.ndarray, sums: dict[str, np.ndarray], known: dict[str, np.ndarray]) -> np.ndarray:
        k = len(self.total)
        prior = (self.total + SMOOTH) / (self.total.sum() + SMOOTH * k)
        others = {name: np.maximum(s - p, 0) for name, s in sums.items()}
        domain = self.shrunk(others["domain"], prior, DOMAIN_WEIGHT)
        host = np.where(known["host"][:, None], self.shrunk(others["host"], domain, HOST_WEIGHT), prior)
        joint = likelihood + np.log(host)
        for name in ("suffix", "said"):
            joint += np.where(known[name][:, None], np.log((others[name] + SMOOTH) / (self.total + SMOOTH * k)), 0)
        return softmax(joint)

    @staticmethod
    def shrunk(counts: np.ndarray, above: np.ndarray, weight: float) -> np.ndarray:
        return (counts + weight * above) / (counts.sum(1, keepdims=True) + weight)


def join_votes(rows: DataFrame, name: str, votes: DataFrame, total: float) -> DataFrame:
    """Add the votes for the row's key as by_<name>.

    Keys with more than 1/HOT_KEYS of all rows, fewer than HOT_KEYS by count,
    are broadcast; the rest are joined by key, and rows already served are spread.
    """
    hot = votes.filter(F.col("rows") > total / HOT_KEYS).select(F.col("key").alias("hot_key"), F.col("votes").alias("hot"))
    cold = votes.filter(F.col("rows") <= total / HOT_KEYS).select("key", F.col("votes").alias("cold"))
    rows = rows.join(F.broadcast(hot), F.col(name) == F.col("hot_key"), "left").drop("hot_key")
    spread = F.concat(F.lit("\x00"), F.xxhash64("id").cast("string"))
    rows = rows.withColumn("join_key", F.when(F.col("hot").isNull(), F.col(name)).otherwise(spread))
    rows = rows.join(cold, F.col("join_key") == F.col("key"), "left")
    return rows.withColumn(f"by_{name}", F.coalesce("hot", "cold")).drop("join_key", "key", "hot", "cold")


def identify(records: DataFrame, model: TextModel) -> DataFrame:
    """lang, probability and text_lang of records; other columns stay."""
    languages = model.languages
    k = len(languages)
    kept = [c for c in records.columns if c not in ("length", "seen", "gain", "voted", "p", "host")]
    if not k:
        return records.select(*kept, F.lit(None).cast("string").alias("lang"), F.lit(None).cast("double").alias("probability"), F.lit(None).cast("string").alias("text_lang"))
    suffix = F.when(F.col("host").contains("."), F.regexp_extract("host", r"([^.]*)$", 1)).otherwise("")
    read = stage(records.withColumns({"domain": F.regexp_extract("host", r"([^.]*\.[^.]*|[^.]*)$", 1), "suffix": suffix, "said": F.coalesce("declared", F.lit(""))}), "language")
    keys = ("host", "domain", "suffix", "said")
    each = read.select(*keys, F.explode(F.arrays_zip("voted", "p")).alias("v")).select(*keys, F.col("v.voted").alias("language"), F.col("v.p").alias("p"))
    total = np.zeros(k)
    for r in each.groupBy("language").agg(F.sum("p").alias("s")).collect():  # a row for each language
        total[r.language] = r.s
    n = read.count()
    out = read
    for name in keys:
        sums = each.groupBy(name, "language").agg(F.sum("p").alias("s")).groupBy(name).agg(F.collect_list(F.struct("language", "s")).alias("votes"))
        rows = read.groupBy(name).agg(F.count("*").alias("rows"))
        votes = stage(sums.join(rows, name).withColumnRenamed(name, "key"), f"votes-{name}")
        out = join_votes(out, name, votes, n)
    names = pa.array(languages)
    shared = records.sparkSession.sparkContext.broadcast((model.base, total))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, total = shared.value
        for batch in batches:
            at = {f: batch.column(i) for i, f in enumerate(batch.schema.names)}
            length = at["length"].to_numpy()
            sparse = {"gain": (at["gain"], at["seen"]), "p": (at["p"], at["voted"])}
            sparse |= {n: (pa.ListArray.from_arrays(v.offsets, v.values.field("s"), mask=v.is_null()), pa.ListArray.from_arrays(v.offsets, v.values.field("language"), mask=v.is_null())) for n in keys for v in [at[f"by_{n}"]]}
            sparse = {n: (*table(v), table(c)[0]) for n, (v, c) in sparse.items()}
            known = {n: np.array([x != "" for x in at[n].to_pylist()], bool) for n in ("host", "suffix", "said")}
            best, share, text = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows), np.zeros(batch.num_rows, np.int64)
            for rows in blocks(batch.num_rows, k):
                full = {n: dense(v, o, c, rows, k) for n, (v, o, c) in sparse.items()}
                likelihood = length[rows, None] * base + full.pop("gain")
                p = full.pop("p")
                posterior = Evidence(total).posterior(likelihood, p, full, {n: x[rows] for n, x in known.items()})
                best[rows], share[rows], text[rows] = posterior.argmax(1), posterior.max(1), likelihood.argmax(1)
            columns = [*(at[c] for c in kept), names.take(pa.array(best)), pa.array(share), names.take(pa.array(text))]
            yield pa.RecordBatch.from_arrays(columns, [*kept, "lang", "probability", "text_lang"])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in records.schema if f.name in kept), "lang string, probability double, text_lang string"])
    return out.mapInArrow(run, schema)
