"""Embedding near-duplicates against all pairs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from errata.llm import embed_dedup as ed

SCHEMA = "vec_id long, embedding array<double>, label int"


def brute(rows, least=0.95):
    def usable(v):
        return v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(x != 0 for x in v)
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    links = [0] * len(rows)
    unit = [np.array(v) / np.abs(v).max() if usable(v) else None for _, v, *_ in rows]
    unit = [None if u is None else u / np.linalg.norm(u) for u in unit]
    for i in range(len(rows)):
        for j in range(i):
            if unit[i] is not None and unit[j] is not None and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= least:
                links[i] += 1
                links[j] += 1
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    name = {}
    for i, (vec_id, *_) in enumerate(rows):
        if vec_id is not None:
            name[find(i)] = min(name.get(find(i), vec_id), vec_id)
    return sorted(((r[0], links[i], name.get(find(i)), r[0] is not None and r[0] == name.get(find(i))) for i, r in enumerate(rows)), key=repr)


def found(spark, rows, least=0.95):
    table = spark.createDataFrame(rows, SCHEMA)
    return sorted((tuple(r) for r in ed.near_duplicates(table, least).select("vec_id", "n_links", "component_id", "kept").collect()), key=repr)


def clusters(seed, dims=16):
    """Groups of every tightness: copies, near copies, groups whose members are at the bound."""
    rng = np.random.default_rng(seed)
    out = [rng.standard_normal(dims) for _ in range(300)]
    for size, noise in ((40, 0.02), (60, 0.15), (60, 0.22), (50, 0.3), (3, 0.1), (2, 0.05), (2, 0.2)):
        base = rng.standard_normal(dims)
        base /= np.linalg.norm(base)
        out += [base + noise * rng.standard_normal(dims) / np.sqrt(dims) for _ in range(size)]
        out += [base * 3] * 2
    line = np.linspace(0, 2, 40)  # a chain: neighbours link, ends are far apart
    out += [np.cos(t) * np.eye(dims)[0] + np.sin(t) * np.eye(dims)[1] for t in line]
    return [(int(i), [float(x) for x in v], 1) for i, v in zip(rng.permutation(10 * len(out))[:len(out)], out)]


@pytest.mark.parametrize("seed", [1, 2])
def test_against_all_pairs(spark, seed):
    rows = clusters(seed)
    assert found(spark, rows) == brute(rows)


def test_saturated_lists_grow(spark, monkeypatch):
    """Many balls near each other: more neighbours that matter than a list starts with."""
    monkeypatch.setattr(ed, "NEIGHBOURS", 3)
    rng = np.random.default_rng(5)
    base = np.eye(24)[0]
    rows = [(k, [float(x) for x in base + 0.24 * rng.standard_normal(24) / np.sqrt(24) * (1 + k % 2)], 1) for k in range(120)]
    want = brute(rows)
    assert max(r[1] for r in want) > 50 and found(spark, rows) == want


def test_edge_cases(spark):
    v, w = [1.0, 2.0, 3.0], [3.0, -1.0, 0.5]
    rows = [(1, v, 0), (1, v, 0), (2, [x * 1e200 for x in v], 0), (3, [x * 1e-200 for x in v], 0), (None, v, 0), (4, None, 0), (5, [0.0, 0.0, 0.0], 0),
            (6, [float("nan"), 1.0, 2.0], 0), (7, [None, 1.0, 2.0], 0), (8, [], 0), (9, w, 0), (10, v[:2], 0), (11, [2.0, 4.0], 0),
            (12, [float("inf"), 1.0, 2.0], 0), (None, None, 0), (None, [5.0, -5.0, 5.0], 0)]
    assert found(spark, rows) == brute(rows)
    assert found(spark, rows[:0]) == [] and found(spark, rows[5:9]) == brute(rows[5:9])
    extra = spark.createDataFrame(rows, SCHEMA).withColumn("node", F.lit(1)).withColumn("u", F.lit("x"))
    assert ed.near_duplicates(extra).count() == len(rows)


def test_whole_table(spark):
    table = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    rows = [(r.vec_id, r.embedding, r.label) for r in table.collect()]
    near = [(i + 10_000, [x + 0.001 * (j % 3) for j, x in enumerate(v)], n) for i, v, n in rows[::7] if v]
    assert found(spark, rows + near) == brute(rows + near)
