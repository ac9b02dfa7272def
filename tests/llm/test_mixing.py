"""Mixing: targets are met, the classifier holds out, and edge rows are defined."""

import numpy as np

from errata.llm import mixing

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    model = mixing.fit_classifier(docs, labels.where("doc_id % 4 <> 0"))
    rows = docs.join(labels.where("doc_id % 4 = 0"), "doc_id").select("text", "quality").collect()
    right = sum((sum(p for p, (q, _) in zip(model(r.text)[1], mixing.DOMAINS) if q) > 0.5) == bool(r.quality) for r in rows)
    assert right >= 0.9 * len(rows)


def test_rates_meet_reachable_targets(spark):
    rng = np.random.default_rng(1)
    p = rng.dirichlet([0.4] * 4, 500)
    n = rng.integers(1, 900, 500)
    truth = rng.uniform(0, 2, 500)
    targets = (p * (n * truth)[:, None]).sum(axis=0)
    df = spark.createDataFrame([(int(a), [float(x) for x in b]) for a, b in zip(n, p)], "n long, p array<double>")
    history = mixing.fit_rates(df, targets)
    assert len(history) < mixing.MAX_STEPS
    rows = df.select("n", "p", mixing._rate(history).alias("r")).collect()
    got = sum(np.array(r.p) * r.n * r.r for r in rows)
    assert np.abs(got - targets).max() <= mixing.TOLERANCE * targets.sum()
    assert min(r.r for r in rows) >= 0
    # The rates are those of the plain iteration, step by step.
    r = np.ones(500)
    for u in history:
        r = np.maximum(0, r - p @ np.array(u))
    assert np.allclose(sorted(r), sorted(x.r for x in rows))


def test_many_rates_at_zero(spark):
    """A domain to be left out altogether, and one to be doubled."""
    rng = np.random.default_rng(2)
    p = rng.dirichlet([0.05] * 4, 800)
    n = rng.integers(1, 900, 800)
    natural = (p * n[:, None]).sum(axis=0)
    targets = natural * np.array([2, 1, 0.1, 0.05])
    df = spark.createDataFrame([(int(a), [float(x) for x in b]) for a, b in zip(n, p)], "n long, p array<double>")
    history = mixing.fit_rates(df, targets)
    rows = df.select("n", "p", mixing._rate(history).alias("r")).collect()
    got = sum(np.array(x.p) * x.n * x.r for x in rows)
    assert np.abs(got - targets).max() <= 1e-3 * targets.sum()
    assert len(history) <= 25


def test_unreachable_targets_leave_the_least_squares(spark):
    df = spark.createDataFrame([(10, [1.0, 0.0, 0.0, 0.0])] * 3, "n long, p array<double>")
    history = mixing.fit_rates(df, np.array([60.0, 5.0, 0.0, 0.0]))
    assert abs(df.select(mixing._rate(history).alias("r")).first().r - 2) < 1e-3


def test_mix_keeps_columns_and_follows_rates(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    from errata.llm.common import written
    rated = {r.row.doc_id: r.rate for r in mixing.rated(docs, labels, ["doc_id"]).collect()}
    out = written(mixing.mix(docs, labels), "test")
    assert out.columns == docs.columns
    counts = {r.doc_id: r["count"] for r in out.groupBy("doc_id").count().collect()}
    for d, rate in rated.items():
        assert counts.get(d, 0) in (int(rate), int(rate) + 1)
    assert abs(sum(counts.values()) - sum(rated.values())) < 0.05 * sum(rated.values())


def test_edge_rows(spark):
    docs = spark.createDataFrame([(1, "a b", 0, "x"), (None, None, 1, "y"), (1, "a b", 2, None), (3, "", None, None)],
                                 "doc_id long, text string, n int, p string")
    labels = spark.createDataFrame([(1, 1, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    rows = mixing.rated(docs, labels, docs.columns).collect()
    assert len(rows) == 4 and all(r.rate >= 0 and abs(sum(r.p) - 1) < 1e-9 for r in rows)
    assert sorted(r.n for r in rows) == [0, 0, 2, 2]
    assert mixing.mix(docs, labels).columns == docs.columns
    assert mixing.mix(docs.limit(0), labels.limit(0)).count() == 0
