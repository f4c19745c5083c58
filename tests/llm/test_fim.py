"""Fill-in-middle against a character-by-character version, and its round trip."""

import hashlib

import pytest

from fieldstats.llm import fim


def plain_units(text):
    out = []
    for c in text:
        if out and c.isascii() and c.isalpha() and out[-1].isascii() and out[-1].isalpha():
            out[-1] += c
        else:
            out.append(c)
    return out


def plain(doc_id, text):
    text = text or ""
    units = plain_units(text)
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[i : i + 8], 16) for i in (0, 8, 16, 24)]
    a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    pre, mid, suf = ("".join(u) for u in (units[:a], units[a:b], units[b:]))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return len(units), "plain", None, None, None, text
    if h[3] % 100 < 20:
        return len(units), "spm", pre, mid, suf, f"<S>{suf}<P>{pre}<M>{mid}"
    return len(units), "psm", pre, mid, suf, f"<P>{pre}<S>{suf}<M>{mid}"


TEXTS = ["", None, " ", "word", "two words", "a<b", "<P", "has <M> inside", "ünï côdé 漢字\n\ttabs\r\n", "é combining", "x" * 5_000, "ab1 " * 4_000, "<S>", "S>P>", "\x00\x1f nul", "😀 emoji😀"]


def test_pieces_and_outputs(spark, make_docs):
    rows = [(i, TEXTS[i % len(TEXTS)]) for i in range(300)] + [(None, "no id here"), (7, "again"), (7, "again")]
    found = fim.transform(make_docs(rows))
    got = sorted(((r.doc_id, r.n, r.form, r.prefix, r.middle, r.suffix, r.output) for r in found.collect()), key=str)
    assert got == sorted(((i, *plain(i, t)) for i, t in rows), key=str)
    assert {r[2] for r in got} == {"plain", "psm", "spm"}
    back = fim.restore(found)
    assert sorted((str(r.doc_id), r.text) for r in back.collect()) == sorted((str(i), t or "") for i, t in rows)


def test_digests(spark, make_docs):
    rows = [(i, TEXTS[i % len(TEXTS)]) for i in range(100)]
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for r in fim.digests(make_docs(rows).selectExpr("*", "1 AS n", "'x' AS form", "2 AS output")).collect():
        n, form, pre, mid, _, output = plain(r.doc_id, rows[r.doc_id][1])
        lengths = (None, None) if form == "plain" else (len(pre), len(mid))
        assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.output_sha256, r.restored_sha256) == (n, form, *lengths, sha(output), sha(rows[r.doc_id][1] or ""))


def test_empty_table_and_any_partitioning(spark, make_docs):
    assert fim.digests(make_docs([(1, "x")]).filter("false")).count() == 0
    docs = make_docs([f"text number {i} with words" for i in range(50)])
    assert sorted(fim.digests(docs.repartition(7)).collect()) == sorted(fim.digests(docs.coalesce(1)).collect())


def test_other_schemes_and_sentinels_that_could_be_misread():
    lines = fim.Scheme(unit=r"[^\n]*\n?", prefix="[pre]", suffix="[suf]", middle="[mid]", transformed=100, spm=50)
    import regex

    unit = regex.compile(lines.unit)
    for i in range(200):
        text = "\n".join(f"line {j} of {i}" for j in range(i % 9)) + "[pr[su[mi"
        _, form, pre, mid, suf, output = lines.apply(str(i), text, unit)
        assert form != "plain" and pre + mid + suf == text and lines.restore(output, form) == text
    for marks in (("a", "a", "b"), ("", "x", "y"), ("aba", "x", "y"), ("<P", "P>", "x"), ("abc", "b", "x")):
        with pytest.raises(ValueError):
            fim.Scheme(prefix=marks[0], suffix=marks[1], middle=marks[2])
    with pytest.raises(ValueError):
        lines.restore("[mid]", "psm")
