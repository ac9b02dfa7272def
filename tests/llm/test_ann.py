"""Neighbours: recall against brute force; exact scores and ties; edge rows."""

import math

import numpy as np

from errata.llm import ann

SF = "/root/testdata/sf0.01"


def brute(rows, step, top):
    good = {}
    for i, v in rows:
        if i is not None and v and all(c is not None and math.isfinite(c) for c in v) and any(v):
            good.setdefault(i, []).append(np.array(v, dtype=float))
    out = {}
    for q in sorted(good):
        if q % step == 0:
            a = good[q][0]
            scored = [(-float((a * b).sum() / (np.sqrt((b * b).sum()) * np.sqrt((a * a).sum()))), i)
                      for i, vs in good.items() if i != q for b in vs]
            out[q] = [(i, -s) for s, i in sorted(scored)[:top]]
    return out


def result(df, **kw):
    out = {}
    for r in sorted(ann.nearest(df, **kw).collect(), key=lambda r: (r.query_id, r.rank)):
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r.rank == len(out[r.query_id])
    return out


def test_recall_on_the_table(spark):
    table = spark.read.parquet(f"{SF}/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in table.collect()]
    want, got = brute(rows, ann.QUERY_STEP, ann.TOP), result(table)
    assert set(got) == set(want)
    hits = sum(len({i for i, _ in want[q]} & {i for i, _ in got[q]}) for q in want)
    assert hits >= 0.9 * sum(map(len, want.values()))


def test_routing_saves_work_where_there_is_structure():
    rng = np.random.default_rng(1)
    x = rng.standard_normal((40, 32))[rng.integers(0, 40, 3000)] + 0.15 * rng.standard_normal((3000, 32))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    model = ann.fit_router(x[:2000])
    part, p = model(x).argmax(axis=1), model(x[2000:])
    order = np.argsort(-p, axis=1)
    s = x[2000:] @ x.T
    near = np.argsort(-s, axis=1)[:, 1:6]
    hit = np.mean([[part[j] in set(order[i][:ann.MIN_PARTS]) for j in near[i]] for i in range(len(p))])
    assert hit >= 0.9


def test_parts_are_balanced():
    rng = np.random.default_rng(2)
    x = rng.standard_normal((1000, 8))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    sizes = np.bincount(ann.partition_graph(ann.neighbour_graph(x), 16), minlength=16)
    assert sizes.max() <= np.ceil(1000 / 16 * 1.05) and sizes.min() >= int(1000 / 16 * 0.94)


def test_exact_scores_ties_and_edge_rows(spark):
    rng = np.random.default_rng(3)
    rows = [(i, rng.standard_normal(4).tolist()) for i in range(30)]
    rows += [(100 + i, rows[0][1]) for i in range(9)]  # copies: ties go to the smaller id
    rows += [(200, None), (201, [0.0] * 4), (202, [1.0, None, 0.0, 0.0]), (203, [1.0, float("nan"), 0.0, 0.0]),
             (204, [float("inf"), 0.0, 0.0, 0.0]), (None, rows[1][1]), (205, [1.0, 2.0]), (210, [])]
    df = spark.createDataFrame([(i, v, 1, "p") for i, v in rows], "vec_id long, embedding array<double>, part int, v string")
    want = brute([(i, v) for i, v in rows if i != 205], 10, 5)
    assert result(df, query_step=10, cover=1.0) == want


def test_slices_and_large_values(spark, monkeypatch):
    monkeypatch.setattr(ann, "SLICE_ROWS", 7)
    monkeypatch.setattr(ann, "SLICE_QUERIES", 2)
    rng = np.random.default_rng(4)
    rows = [(i, (rng.standard_normal(3) * 10.0 ** rng.integers(-100, 100)).tolist()) for i in range(60)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got, want = result(df, query_step=10, cover=1.0, parts=2), brute(rows, 10, 5)
    assert {q: [i for i, _ in v] for q, v in got.items()} == {q: [i for i, _ in v] for q, v in want.items()}


def test_scores_of_extreme_values(spark):
    """Squares of these over- or underflow; scores do not."""
    big, small = 1e200, 1e-200
    rows = [(0, [big, big]), (1, [1.0, 2.0]), (2, [big, 2 * big]), (3, [small, -2 * small])]
    got = result(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), query_step=10)
    assert [i for i, _ in got[0]] == [1, 2, 3]
    assert np.allclose([s for _, s in got[0]], [3 / np.sqrt(10), 3 / np.sqrt(10), -1 / np.sqrt(10)], rtol=1e-14, atol=0)


def test_few_and_no_rows(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0])], "vec_id long, embedding array<float>")
    assert result(df) == {0: [(1, 0.0)]}
    assert result(df.where("vec_id = 0")) == {}
    assert result(df.limit(0)) == {}
