"""Fill-in-middle: a plain version line by line, and exact round trips."""

import hashlib
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from errata.llm import fim

TEXTS = ["", "one line", "one\n", "a\nb\nc\nd", "\n", "\n\n\n", "é\U0001F600\nnaïve\n\U00010000x\n", "has <P> inside\nb",
         "<M>\n", "half a sign <S\n> and <\nP>", "x" * 5000, "y\n" * 3000, "\r\n a\x0bb\n", "ends with <\n<", " \n \n"]


def plain(doc_id, text):
    lines = re.findall(r"[^\n]*\n|[^\n]+", text)
    n = len(lines)
    digest = hashlib.sha256(f"7:{doc_id}".encode()).hexdigest()
    h = [int(digest[8 * k:8 * k + 8], 16) for k in range(4)]
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    pre, mid, suf = "".join(lines[:a]), "".join(lines[a:b]), "".join(lines[b:])
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")):
        return n, "plain", None, None, text
    if h[3] % 100 < 50:
        return n, "spm", len(pre), len(mid), f"<S>{suf}<P>{pre}<M>{mid}"
    return n, "psm", len(pre), len(mid), f"<P>{pre}<S>{suf}<M>{mid}"


def test_against_the_plain_version(spark):
    rows = [(k * 31 + r, t, "x", 1) for r in range(12) for k, t in enumerate(TEXTS)]
    docs = spark.createDataFrame(rows + rows[:3], "doc_id long, text string, output string, n int")
    found = fim.fill_in_middle(docs).select("row.doc_id", "row.text", "row.output", "row.n", F.struct("n", "form", "prefix_chars",
                                            "middle_chars", "output").alias("f"), fim.restored().alias("back")).collect()
    assert len(found) == len(rows) + 3
    for r in found:
        assert tuple(r.f) == plain(r.doc_id, r.text)
        assert r.back == r.text and r[2] == "x" and r[3] == 1
    assert {r.f.form for r in found} == {"plain", "psm", "spm"}


def test_nulls_and_empty(spark):
    docs = spark.createDataFrame([(None, "a\nb\n"), (1, None), (None, None)], "doc_id long, text string")
    found = fim.fill_in_middle(docs).select("row.doc_id", "n", "form", "output", fim.restored().alias("back")).collect()
    assert sorted((r.n, r.form == "plain", r.back) for r in found) == [(0, True, ""), (0, True, ""), (2, False, "a\nb\n")]
    assert fim.fill_in_middle(docs.limit(0)).count() == 0
    assert fim.fill_in_middle(docs.select("doc_id")).where("form <> 'plain'").count() == 0


@pytest.mark.parametrize("unit, pattern", [("line", r"[^\n]*\n|[^\n]+"), ("word", r"[^\n \t]*[\n \t]|[^\n \t]+"),
                                           ("sentence", r"[^\n.!?]*[\n.!?]|[^\n.!?]+")])
def test_units(unit, pattern):
    texts = TEXTS + ["Go on. Stop! Why?\nSo it is.  Yes", "a b\tc"]
    sizes = np.array([len(t) for t in texts])
    ends = np.cumsum(sizes)
    codes = np.frombuffer("".join(texts).encode("utf-32-le"), dtype=np.uint32)
    index = fim.UnitIndex(codes, ends - sizes, ends, unit)
    cut = [re.findall(pattern, t) for t in texts]
    assert index.counts.tolist() == [len(c) for c in cut]
    for k in range(6):
        units = np.minimum(k, index.counts)
        assert index.after(units).tolist() == [len("".join(c[:u])) for c, u in zip(cut, units.tolist())]


def test_wavelet_ranks():
    rng = np.random.default_rng(1)
    symbols = rng.integers(0, 8, 1000).astype(np.uint8)
    matrix = fim.WaveletMatrix(symbols, 3)
    at = np.arange(1001)
    for c in range(8):
        assert matrix.rank(c, at).tolist() == [0, *np.cumsum(symbols == c).tolist()]


def test_long_text_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(fim, "BLOCK", 100)
    texts = ["line\n" * 40, "z" * 500, "q\nr"] * 5
    found = list(fim.transform(list(range(len(texts))), texts))
    assert found == [plain(k, t) for k, t in enumerate(texts)]
    rates = list(fim.transform(list(range(len(texts))), texts, rate=0))
    assert {r[1] for r in rates} == {"plain"}
