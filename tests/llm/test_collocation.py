"""Phrase collocations against a plain count of all phrases."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from errata.llm import collocation as co


def plain(rows, least, max_words=5, top=2000):
    f, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            words = [w for w in re.split(r"[\x20\x09]+", piece) if w]
            n[lang] += len(words)
            for k in range(1, max_words + 1):
                for i in range(len(words) - k + 1):
                    f[lang][tuple(words[i:i + k])] += 1
    out = []
    for lang, counts in f.items():
        cand = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        gone = set()
        for p, a in cand.items():
            for k in range(2, len(p)):
                for i in range(len(p) - k + 1):
                    if 100 * a >= 100 * counts[p[i:i + k]]:
                        gone.add(p[i:i + k])
        rows_of = []
        for p, a in cand.items():
            if p in gone:
                continue
            score, k, l, r = min((1000 * a * n[lang] // (counts[p[:k]] * counts[p[k:]]), k, counts[p[:k]], counts[p[k:]])
                                 for k in range(1, len(p)))
            rows_of.append((-score, -a, " ".join(p).encode(), l, r))
        rows_of.sort()
        out += [(lang, i + 1, p.decode(), -a, l, r, n[lang], -s) for i, (s, a, p, l, r) in enumerate(rows_of[:top])]
    return sorted(out)


def rows_of(df):
    return sorted(tuple(r) for r in df.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())


def corpus(seed, n=300, vocabulary=30):
    rnd = random.Random(seed)
    words = ["a", "b.c", "Der", "é", "\U0001F600x", "x\x00y", "no-one", "the"] + [f"w{i}" for i in range(vocabulary)]
    fixed = ["new york city hall", "the the the", "of the of the", "Der é b"]
    docs = []
    for _ in range(n):
        parts = [rnd.choice(words) if rnd.random() < 0.8 else rnd.choice(fixed) for _ in range(rnd.randint(0, 60))]
        docs.append((rnd.choice(["en", "de", None, ""]), "".join(p + rnd.choice([" ", " ", " ", "\t ", ", ", ".", "\n"]) for p in parts)))
    return docs


@pytest.mark.parametrize("seed, block", [(1, 1 << 22), (2, 500)])
def test_against_plain_counts(spark, monkeypatch, seed, block):
    monkeypatch.setattr(co, "BLOCK", block)
    rows = corpus(seed) + [("en", None), (None, ""), ("xx", "only once")]
    docs = spark.createDataFrame(rows, "lang string, text string").withColumn("next", F.lit(1)).repartition(3)
    for least, top in ((4, 2000), (20, 7)):
        want = plain(rows, least, top=top)
        assert want and rows_of(co.collocations(docs, least, top=top)) == want


def test_hot_word_and_repeats(spark):
    rows = [("en", "hot " * 400)] * 5 + [("en", f"hot pair w{i}") for i in range(50)]
    docs = spark.createDataFrame(rows, "lang string, text string")
    assert rows_of(co.collocations(docs, 10)) == plain(rows, 10)


def test_stripe_totals_are_prefix_counts(spark):
    rows = corpus(3)
    levels = co.phrase_levels(spark.createDataFrame(rows, "lang string, text string"), 5)
    assert len(levels) > 2
    for k in range(1, len(levels)):
        total = levels[k].groupBy("lang", "prefix").agg(F.sum("total").alias("t"))
        both = co.extensions(levels[k - 1], k).join(total.withColumnRenamed("prefix", "phrase"), ["lang", "phrase"], "left")
        assert both.count() and both.where("t IS NULL OR t <> f").count() == 0


def test_exact_beyond_64_bits(spark):
    big = 3_000_000_000_000
    one = spark.createDataFrame([("", [("x", big)], big * 4), ("", [("y", big)], 0)], "prefix string, stripe array<struct<next:string,n:long>>, total long")
    two = spark.createDataFrame([("x", [("y", big - 7)], big, big - 7)], "prefix string, stripe array<struct<next:string,n:long>>, total long, best long")
    levels = [one.withColumn("lang", F.lit("l")).withColumn("best", F.lit(big)), two.withColumn("lang", F.lit("l"))]
    r = co.scored(levels).collect()[0]
    assert (r.a, r.l, r.r, r.n) == (big - 7, big, big, 4 * big) and r.score == 1000 * (big - 7) * 4 * big // (big * big)


def test_few_bits_lose_nothing(spark, monkeypatch):
    """With a table so small that most phrases look frequent the result is the same."""
    monkeypatch.setattr(co, "MIN_BITS", 6)
    monkeypatch.setattr(co, "MAX_BITS", 6)
    rows = corpus(4)
    docs = spark.createDataFrame(rows, "lang string, text string")
    assert rows_of(co.collocations(docs, 4)) == plain(rows, 4)


def test_empty(spark):
    docs = spark.createDataFrame([], "lang string, text string")
    assert co.collocations(docs).count() == 0
    assert co.collocations(spark.createDataFrame([(1,)], "doc_id long")).count() == 0


def test_positions_agree():
    words = co.Words("en")
    words.add(b"new york city")
    t, h = words.chunks[0], np.array(words.hashes, dtype=np.uint64)
    step = np.full(1, co._STEP)
    rolled = (np.full(1, words.seed) * step + h[t[:1]]) * step + h[t[1:2]]
    at = co._mixed(rolled) & np.uint64((1 << 20) - 1)
    assert int(at[0]) == co.phrase_positions(["en"], ["new york"], 20)[0]
