"""Fill-in-middle transformation of whole texts at seeded unit borders.

A text is cut into units, the matches of a pattern from left to right.  Two of
its n + 1 borders, both drawn from a digest of the row's id, part it into prefix,
middle and suffix; the pieces are written out of order between sentinels, so that
a model reads both sides before it writes the middle.  Another draw leaves a share
of the texts plain, and another chooses between the two orders:

    psm   <P>prefix<S>suffix<M>middle
    spm   <S>suffix<P>prefix<M>middle

One Arrow-batched pandas UDF does a batch: unit ends of a text go into one compact
array, so a border is one lookup and a piece one slice, and the work of a text of any
length is a single pass over it.  Draws come from the id alone: a row gets the same
form in any partitioning and after any retry.

Defined cases: a null text is an empty one, and an empty text stays plain; so does
a text that holds a sentinel, since its output could be read in two ways.
A null id draws as an empty one.  Rows are transformed each by itself, so repeated
rows come out alike.  Characters that no unit covers belong to the piece in which
they end up: pieces always add up to the text.
"""

from __future__ import annotations

import hashlib
from array import array
from dataclasses import dataclass

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

PIECES = "n long, form string, prefix string, middle string, suffix string, output string"
DIGESTS = "n long, form string, prefix_chars long, middle_chars long, output_sha256 string, restored_sha256 string"


@dataclass(frozen=True)
class Scheme:
    """Unit pattern, sentinels and shares in percent; `spm` is the share of the transformed texts with the suffix first."""

    unit: str = r"[A-Za-z]+|[^A-Za-z]"
    prefix: str = "<P>"
    suffix: str = "<S>"
    middle: str = "<M>"
    transformed: int = 90
    spm: int = 20
    salt: str = "1:"

    def __post_init__(self) -> None:
        marks = self.marks
        if not all(marks) or len(set(marks)) < 3:
            raise ValueError("three different sentinels are needed")
        for a in marks:
            for b in marks:
                if a != b and a in b or any(a.endswith(b[:k]) for k in range(1, len(b))):
                    raise ValueError(f"sentinel {b!r} could begin inside {a!r}, so that outputs could not be read back")

    @property
    def marks(self) -> tuple[str, str, str]:
        return self.prefix, self.suffix, self.middle

    def draws(self, doc_id: str) -> tuple[int, int, int, int]:
        """Four numbers below 2^32 for an id."""
        digest = hashlib.sha256((self.salt + doc_id).encode()).hexdigest()
        return tuple(int(digest[8 * k : 8 * k + 8], 16) for k in range(4))

    def apply(self, doc_id: str, text: str, unit: regex.Pattern) -> tuple[int, str, str | None, str | None, str | None, str]:
        """Number of units, form, the three pieces (None if plain) and the output."""
        ends = array("I", (m.end() for m in unit.finditer(text)))  # 4 bytes a unit
        n = len(ends)
        one, two, keep, order = self.draws(doc_id)
        if not text or keep % 100 >= self.transformed or any(m in text for m in self.marks):
            return n, "plain", None, None, None, text
        first, last = sorted((one % (n + 1), two % (n + 1)))
        start = ends[first - 1] if first else 0
        stop = ends[last - 1] if last else 0
        prefix, middle, suffix = text[:start], text[start:stop], text[stop:]
        if order % 100 < self.spm:
            return n, "spm", prefix, middle, suffix, f"{self.suffix}{suffix}{self.prefix}{prefix}{self.middle}{middle}"
        return n, "psm", prefix, middle, suffix, f"{self.prefix}{prefix}{self.suffix}{suffix}{self.middle}{middle}"

    def restore(self, output: str, form: str) -> str:
        """The text that an output was made of."""
        if form == "plain":
            return output
        head, second = (self.prefix, self.suffix) if form == "psm" else (self.suffix, self.prefix)
        if not output.startswith(head):
            raise ValueError(f"not an output of form {form}")
        one, _, rest = output.removeprefix(head).partition(second)
        two, _, middle = rest.partition(self.middle)
        return one + middle + two if form == "psm" else two + middle + one


def _texts(ids: pd.Series, texts: pd.Series):
    """Pairs of id and text as strings, missing ones empty."""
    return zip(ids.fillna(""), texts.fillna(""), strict=True)


def transform(docs: DataFrame, scheme: Scheme = Scheme()) -> DataFrame:
    """doc_id, n (units), form, prefix, middle, suffix (null if plain) and output of each document."""

    @pandas_udf(PIECES)
    def cut(ids: pd.Series, texts: pd.Series) -> pd.DataFrame:
        unit = regex.compile(scheme.unit)
        rows = [scheme.apply(i, t, unit) for i, t in _texts(ids, texts)]
        return pd.DataFrame(rows, columns=["n", "form", "prefix", "middle", "suffix", "output"])

    return _with(docs, cut)


def restore(outputs: DataFrame, scheme: Scheme = Scheme()) -> DataFrame:
    """doc_id and text of rows with `output` and `form`."""

    @pandas_udf("string")
    def back(outputs: pd.Series, forms: pd.Series) -> pd.Series:
        return pd.Series([scheme.restore(o, f) for o, f in zip(outputs, forms, strict=True)], dtype=object)

    return outputs.select("doc_id", back("output", "form").alias("text"))


def digests(docs: DataFrame, scheme: Scheme = Scheme()) -> DataFrame:
    """doc_id, n, form, lengths of prefix and middle in code points, and digests of the output and of the text rebuilt from it."""

    def sha(text: str) -> str:
        return hashlib.sha256(text.encode()).hexdigest()

    @pandas_udf(DIGESTS)
    def cut(ids: pd.Series, texts: pd.Series) -> pd.DataFrame:
        unit = regex.compile(scheme.unit)
        rows = []
        for i, t in _texts(ids, texts):
            n, form, prefix, middle, _, output = scheme.apply(i, t, unit)
            lengths = (None, None) if form == "plain" else (len(prefix), len(middle))
            rows.append((n, form, *lengths, sha(output), sha(scheme.restore(output, form))))
        out = pd.DataFrame(rows, columns=["n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256"])
        return out.astype({"prefix_chars": "Int64", "middle_chars": "Int64"})

    return _with(docs, cut)


def _with(docs: DataFrame, cut) -> DataFrame:
    made = docs.select(F.col("doc_id").cast("long"), cut(F.col("doc_id").cast("long").cast("string"), F.col("text")).alias("_made"))
    return made.select("doc_id", "_made.*")
