"""SimHash near-duplicates against a brute-force version."""

import re

import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from errata.llm import simhash

SF = "/root/testdata/sf0.001"


def slow_fingerprint(text):
    t = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", t)
    if not words:
        return 0
    grams = [" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))]
    hs = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute(rows):
    """doc_id -> (fingerprint, component id) by comparing all pairs."""
    fps = [(d, slow_fingerprint(t)) for d, t in rows]
    least = list(range(len(fps)))

    def find(i):
        while least[i] != i:
            i = least[i]
        return i
    for i in range(len(fps)):
        for j in range(i):
            if bin(fps[i][1] ^ fps[j][1]).count("1") <= 3:
                a, b = find(i), find(j)
                least[max(a, b)] = min(a, b)
    comp = {}
    for i, (d, _) in enumerate(fps):
        if d is not None:
            r = find(i)
            comp[r] = min(comp.get(r, d), d)
    return sorted(((d, f"{f:016x}", comp.get(find(i))) for i, (d, f) in enumerate(fps)), key=repr)


def result(df):
    found = simhash.near_duplicates(df)
    return sorted(((r.doc_id, f"{r.fp % 2**64:016x}", r.component_id) for r in found.collect()), key=repr)


@settings(max_examples=200, deadline=None)
@given(st.one_of(st.none(), st.text(alphabet="abA Zz\t\x0b\n\u00a0\u0130\x1c", max_size=60)))
def test_fingerprint(text):
    assert simhash.fingerprint(text) == slow_fingerprint(text)


def test_blocks_do_not_change_a_fingerprint(monkeypatch):
    text = " ".join(str(i * i % 97) for i in range(1000))
    monkeypatch.setattr(simhash, "BLOCK", 64)
    assert simhash.fingerprint(text) == slow_fingerprint(text)


def test_table_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    assert result(docs) == brute(rows)


def test_edge_rows(spark):
    base = " ".join(f"w{i}" for i in range(400))
    near = base.replace("w7 ", "w8 ")
    rows = [(3, base), (1, near), (None, base), (9, None), (9, None), (4, ""), (5, " \t"), (6, "One"), (2, "one")]
    df = spark.createDataFrame([(d, t, "x", 0) for d, t in rows], "doc_id long, text string, fp string, key int")
    assert result(df) == brute(rows)


def test_chains_of_many_fingerprints(spark):
    """Fingerprints that hang together only through long chains inside full buckets."""
    import random
    rnd = random.Random(5)
    values = {0}
    v = 0
    for _ in range(60):
        for b in rnd.sample(range(20), 3):
            v ^= 1 << b
        values.add(v)
    values |= {x ^ (0xFFFF << 40) for x in list(values)[:10]}
    df = spark.createDataFrame([(x,) for x in values], "id long")
    got = {r.node: r.root for r in simhash.fingerprint_components(df).collect()}
    want = {x: x for x in values}
    for _ in values:
        for a in values:
            for b in values:
                if bin(a ^ b).count("1") <= 3:
                    want[a] = want[b] = min(want[a], want[b])
    assert {x: got.get(x, x) for x in values} == want


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.near_duplicates(df).count() == 0


def test_more_bits_than_wildcards_is_an_error(spark):
    with pytest.raises(ValueError):
        simhash.variants(spark.createDataFrame([(1,)], "id long"), 4)
