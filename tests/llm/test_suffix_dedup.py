"""Substring dedup against a direct implementation of its rule."""

import hashlib
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from errata.llm import suffix_dedup as sd

SF = "/root/testdata/sf0.001"


def brute(rows):
    raw = [(d, (t or "").encode()) for d, t in rows]
    big = float("inf")
    least = {}
    for d, b in raw:
        for i in range(len(b) - sd.LENGTH + 1):
            s = b[i:i + sd.LENGTH]
            least[s] = min(least.get(s, big), big if d is None else d)
    out = []
    for d, b in raw:
        off = np.zeros(len(b) + 1, dtype=bool)
        for i in range(len(b) - sd.LENGTH + 1):
            if least[b[i:i + sd.LENGTH]] < (big if d is None else d):
                off[i:i + sd.LENGTH] = True
        off = off[:len(b)]
        spans = sum(1 for i in range(len(b)) if off[i] and (i == 0 or not off[i - 1]))
        kept = bytes(c for c, o in zip(b, off) if not o)
        out.append((d, len(b), int(off.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def result(df, **kw):
    return sorted((tuple(r) for r in sd.removed_repeats(df, **kw).collect()), key=repr)


def random_rows(seed, n=60):
    """Texts that share passages, with some bytes changed, over a small alphabet."""
    rnd = random.Random(seed)
    text = lambda k: "".join(rnd.choice("ab é") for _ in range(k))
    pool = [text(rnd.choice([40, 50, 60, 120, 300])) for _ in range(8)]
    rows = []
    for _ in range(n):
        parts = [rnd.choice(pool) if rnd.random() < 0.5 else text(rnd.randint(0, 80)) for _ in range(rnd.randint(0, 5))]
        t = "".join(parts)
        if t and rnd.random() < 0.3:
            k = rnd.randrange(len(t))
            t = t[:k] + "x" + t[k + 1:]
        rows.append((rnd.choice([None, *range(40)]), rnd.choice([t, t, t, None])))
    return rows


@pytest.mark.parametrize("seed,chunk", [(1, 1 << 20), (2, 2000), (3, 600)])
def test_random_texts(spark, seed, chunk):
    rows = random_rows(seed)
    df = spark.createDataFrame([(d, t, 1, "c") for d, t in rows], "doc_id long, text string, chunk int, sort string")
    assert result(df, chunk_bytes=chunk) == brute(rows)


def test_blocks_do_not_change_the_result(spark, monkeypatch):
    rows = random_rows(7)
    for size in (64, 257):
        monkeypatch.setattr(sd, "BLOCK", size)
        import pandas as pd
        chunk = sd.Chunk(pd.DataFrame(rows, columns=["doc_id", "text"]))
        monkeypatch.setattr(sd, "BLOCK", 1 << 19)
        whole = sd.Chunk(pd.DataFrame(rows, columns=["doc_id", "text"]))
        # Where a run of strings with one anchor is cut does not matter.
        spread = lambda c: [(s + k, g) for s, n, g in zip(c.start, c.count, c.gram) for k in range(n)]
        assert spread(chunk) == spread(whole)


def test_hot_passage_in_every_document(spark):
    passage = "A passage of well over fifty bytes that every single document holds. "
    rows = [(k, f"{k} own words {k * k}. " + passage * (1 + k % 2) + f"tail {k}") for k in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert result(df, chunk_bytes=1500) == brute(rows)


def test_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert result(docs, chunk_bytes=40_000) == brute([(r.doc_id, r.text) for r in docs.collect()])


def test_empty_table(spark):
    assert result(spark.createDataFrame([], "doc_id long, text string")) == []


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=200), st.sampled_from([2, 3, 24, 50]))
def test_identifiers_tell_strings_apart(data, n):
    x = np.frombuffer(data, dtype=np.uint8)
    got = sd._identifiers(x, n, 1)
    assert len(got) == max(0, len(data) - n + 1)
    seen = {}
    for i, g in enumerate(got.tolist()):
        assert seen.setdefault(g, data[i:i + n]) == data[i:i + n]
    assert len(seen) == len({data[i:i + n] for i in range(len(got))})


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2**64 - 1), max_size=50))
def test_pack_round_trip(values):
    a = np.array(values, dtype=np.uint64)
    b = (a % 7).astype(np.uint8)
    x, y = sd._unpack(sd._pack(a, b), "u8", "u1")
    assert (x == a).all() and (y == b).all()
