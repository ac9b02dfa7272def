"""Mixing domains to target weights by soft membership (operator 8).

Domains are the label classes (quality, toxic). A linear classifier, trained on
a bounded sample of the labelled rows, gives every document a posterior over
the domains. Document rates r >= 0 (expected copies) are then fitted by
projected-gradient least squares, so that the expected tokens of each domain,
sum of r * tokens * posterior, match the targets.

The gradient of a rate needs only the four domain residuals. Each iteration is
one distributed sum over (tokens, posterior); a rate is recomputed from the
short list of past residuals, so no per-document state is kept or lost. The
residuals are scaled by the inverse 4 x 4 Gram matrix of the documents not held
at zero, which makes their curvature 1: a few steps are enough.

Defined results: null and empty texts have zero tokens, the classifier's base
rate as posterior, and a rate like any other; label rows with a null are not
used, of several labels of a document the worst counts; without usable labels,
posteriors are uniform; repeated rows each get their rate; an empty table gives
an empty result. Input columns travel in one struct, so names never clash.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from errata.llm.common import read_table, with_default, written

#: Labelled documents the classifier is fitted on, at most (smallest hashes).
TRAIN_DOCS = 10_000
#: Words kept per label, at most, and the fewest training documents of each.
MAX_WORDS = 400
MIN_DOCS = 5
#: (quality, toxic) of each domain, in the order of all vectors.
DOMAINS = [(1, 0), (0, 0), (1, 1), (0, 1)]
#: Target share of each domain. The first takes what the others cannot fill.
TARGET_WEIGHTS = [0.955, 0.03, 0.01, 0.005]
#: Target tokens of the first domain, as a multiple of what is there.
KEEP = 1.1
MAX_STEPS = 40
TOLERANCE = 1e-4
SYMBOLS = re.compile(r"[#*$%&|<>]")


def _words(text: str | None) -> list[str]:
    """Lower-cased words, and marks for which symbols a text has and how many."""
    text = text or ""
    words = text.lower().split()
    found = SYMBOLS.findall(text)
    if found:
        level = min(9, 10 * len(found) // max(1, len(words)))
        words += [f"\x01{c}" for c in set(found)] + [f"\x02{k}" for k in range(level + 1)]
    return words


def _sample(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(text, quality, toxic) of up to TRAIN_DOCS labelled documents."""
    usable = (labels.where("doc_id IS NOT NULL AND quality IS NOT NULL AND toxic IS NOT NULL")
              .groupBy("doc_id").agg(F.min(F.col("quality").cast("int")).alias("quality"),
                                     F.max(F.col("toxic").cast("int")).alias("toxic")))
    chosen = usable.orderBy(F.xxhash64("doc_id"), "doc_id").limit(TRAIN_DOCS)
    chosen = written(chosen, "mixing-labels")
    # One text per labelled id, whichever of repeated rows.
    texts = docs.select("doc_id", "text").join(chosen, "doc_id")
    return texts.dropDuplicates(["doc_id"]).select("text", "quality", "toxic")


def _features(sample: DataFrame) -> list[str]:
    """The words that tell most about either label, by a log-likelihood score."""
    def split(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for k in range(0, len(f), 200):
                part = f.iloc[k:k + 200]
                rows = [(w, q, t) for x, q, t in zip(part["text"], part["quality"], part["toxic"])
                        for w in set(_words(x))]
                yield pd.DataFrame(rows, columns=["w", "quality", "toxic"])
    df = (sample.mapInPandas(split, "w string, quality int, toxic int").groupBy("w")
          .agg(F.count("*").alias("n"), F.sum("quality").alias("quality"), F.sum("toxic").alias("toxic"))
          .where(F.col("n") >= MIN_DOCS))
    df = written(df, "mixing-words")
    total = sample.agg(F.count("*").alias("n"), F.sum("quality").alias("quality"), F.sum("toxic").alias("toxic")).first()
    words: set[str] = set()
    for label in ("quality", "toxic"):
        base = min(max((total[label] or 0) / max(1, total.n), 1e-6), 1 - 1e-6)
        # How far the label's share among texts with the word is from usual.
        share = (F.col(label) + base) / (F.col("n") + 1)
        score = F.col("n") * (share * F.log(share / base) + (1 - share) * F.log((1 - share) / (1 - base)))
        words |= {r.w for r in df.orderBy(score.desc(), "w").limit(MAX_WORDS).collect()}
    return sorted(words)


def _logistic(rows: list[list[int]], width: int, y: np.ndarray, l2: float = 1e-3, steps: int = 300) -> np.ndarray:
    """Weights (bias last) of a ridge-penalised logistic regression, by accelerated
    gradient. ``rows`` list the features that are one; the bias is one more."""
    at = np.concatenate([[*r, width] for r in rows]).astype(int)
    row = np.repeat(np.arange(len(rows)), [len(r) + 1 for r in rows])
    first = np.flatnonzero(np.diff(row, prepend=-1))

    def out(v: np.ndarray) -> np.ndarray:
        return np.add.reduceat(v[at], first)

    def back(r: np.ndarray) -> np.ndarray:
        return np.bincount(at, r[row], width + 1)

    base = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    w = np.zeros(width + 1)
    w[-1] = np.log(base / (1 - base))
    v, prev = w.copy(), w.copy()
    top = np.ones(width + 1)  # power iteration for the largest curvature
    for _ in range(30):
        top = back(out(top / np.linalg.norm(top)))
    rate = 4.0 / (1.05 * np.linalg.norm(top) / len(rows) + 4 * l2)
    for k in range(steps):
        p = 1 / (1 + np.exp(-np.clip(out(v), -30, 30)))
        g = back(p - y) / len(rows)
        g[:-1] += l2 * v[:-1]
        w = v - rate * g
        v = w + k / (k + 3) * (w - prev)
        prev = w
    return w


class Classifier:
    """Posterior over DOMAINS from which of a few hundred words a text has."""

    def __init__(self, words: list[str], quality: np.ndarray, toxic: np.ndarray):
        self.at = {w: k for k, w in enumerate(words)}
        self.heads = np.stack([quality, toxic], axis=1) if len(quality) else None

    def __call__(self, text: str | None) -> tuple[int, list[float]]:
        words = _words(text)
        n = sum(1 for w in words if w[0] > "\x02")
        if self.heads is None:
            return n, [1 / len(DOMAINS)] * len(DOMAINS)
        has = [self.at[w] for w in self.at.keys() & set(words)]
        z = self.heads[-1] + self.heads[has].sum(axis=0)
        q, t = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        return n, [float((q if a else 1 - q) * (t if b else 1 - t)) for a, b in DOMAINS]


def fit_classifier(docs: DataFrame, labels: DataFrame) -> Classifier:
    """Fits on the driver: at most TRAIN_DOCS rows of at most 2 * MAX_WORDS word numbers."""
    sample = written(_sample(docs, labels), "mixing-sample")
    words = _features(sample)
    at = {w: k for k, w in enumerate(words)}

    def present(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            has = [[at[w] for w in at.keys() & set(_words(x))] for x in f["text"]]
            yield pd.DataFrame({"has": has, "quality": f["quality"], "toxic": f["toxic"]})
    rows = sample.mapInPandas(present, "has array<int>, quality int, toxic int").collect()
    if not rows:
        return Classifier([], np.array([]), np.array([]))
    y = np.array([(r.quality, r.toxic) for r in rows], dtype=float)
    has = [r.has for r in rows]
    return Classifier(words, _logistic(has, len(words), y[:, 0]), _logistic(has, len(words), y[:, 1]))


def posterior(model: Classifier, text: Column) -> Column:
    """Column: struct(n tokens, p posterior over DOMAINS)."""
    @F.pandas_udf("n long, p array<double>")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            rows = [model(t) for t in texts]
            yield pd.DataFrame({"n": [r[0] for r in rows], "p": [r[1] for r in rows]}, columns=["n", "p"])
    return scored(text)


def _rate(history: list[list[float]]) -> Column:
    """The rate after the given scaled residuals: r <- max(0, r - p . u), from r = 1."""
    if not history:
        return F.lit(1.0)
    us = ", ".join("array(" + ", ".join(f"{x!r}D" for x in u) + ")" for u in history)
    dot = " + ".join(f"p[{k}] * u[{k}]" for k in range(len(DOMAINS)))
    return F.expr(f"aggregate(array({us}), 1D, (r, u) -> greatest(0D, r - ({dot})))")


def natural_tokens(scored: DataFrame) -> np.ndarray:
    """Expected tokens of each domain at rate 1."""
    row = scored.agg(*[F.coalesce(F.sum(F.col("n") * F.col("p")[k]), F.lit(0.0)) for k in range(len(DOMAINS))]).first()
    return np.array(row, dtype=float)


def default_targets(natural: np.ndarray) -> np.ndarray:
    """Target tokens by TARGET_WEIGHTS; no domain but the first is repeated to fill its share."""
    w = np.array(TARGET_WEIGHTS)
    budget = KEEP * natural[0] / w[0]
    targets = np.minimum(w * budget, natural)
    targets[0] = budget * w[0]
    return targets


def fit_rates(scored: DataFrame, targets: np.ndarray) -> list[list[float]]:
    """The residuals that define the rates (see ``_rate``) of ``scored(n, p)``.

    One pass gives the domain totals at the present rates, and the Gram matrix
    of the documents whose rate is not held at zero.
    """
    kk = range(len(DOMAINS))
    n, p, r = F.col("n"), F.col("p"), F.col("r")
    free = n * (r > 0).cast("double")
    sums = [n * r * p[k] for k in kk] + [free * p[a] * p[b] for a in kk for b in kk]
    history: list[list[float]] = []
    best = np.inf
    step = 1.0
    for _ in range(MAX_STEPS):
        now = scored.select("n", "p", _rate(history).alias("r"))
        got = np.array(now.agg(*[F.coalesce(F.sum(x), F.lit(0.0)) for x in sums]).first(), dtype=float)
        gap = got[:len(DOMAINS)] - targets
        size = np.abs(gap).max()
        if size <= TOLERANCE * max(1.0, targets.sum()):
            break
        # A step that did not help was too long for the documents it held at zero.
        step = min(1.0, 2 * step) if size < best else step / 2
        if step < 1 / 64:
            break
        best = min(best, size)
        gram = got[len(DOMAINS):].reshape(len(DOMAINS), -1)
        move = step * (np.linalg.pinv(gram, rcond=1e-9, hermitian=True) @ gap)
        if np.abs(move).max() <= 1e-9:
            break
        history.append([float(x) for x in move])
    return history


def rated(docs: DataFrame, labels: DataFrame, carry: list[str]) -> DataFrame:
    """``row`` (a struct of the columns ``carry``), ``n``, ``p`` and ``rate``."""
    model = fit_classifier(docs, labels)
    scored = docs.select(F.struct(*carry).alias("row"), posterior(model, F.col("text")).alias("s"))
    scored = written(scored.select("row", "s.n", "s.p"), "mixing-posteriors")
    history = fit_rates(scored.select("n", "p"), default_targets(natural_tokens(scored)))
    return scored.withColumn("rate", _rate(history))


def mix(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` with each row repeated: the whole part of its rate, and once more
    with the rest as chance (a fixed hash of the row's id and text decides)."""
    have = docs.columns
    full = with_default(docs, "doc_id", "long")
    drawn = rated(full, labels, full.columns)
    chance = F.expr("pmod(xxhash64(row.doc_id, row.text, 8), 1000000) / 1000000D")
    copies = (F.floor("rate") + (chance < F.col("rate") - F.floor("rate")).cast("int")).cast("int")
    drawn = drawn.withColumn("copies", copies).where("copies > 0")
    return (drawn.withColumn("copy", F.explode(F.expr("sequence(1, copies)")))
            .select(*[F.col("row")[c].alias(c) for c in have]))


def op8_mix_to_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")
    found = rated(docs, labels, ["doc_id"])
    names = [f"p_quality{q}_toxic{t}" for q, t in DOMAINS]
    return found.select("row.doc_id", F.col("n").alias("n_tokens"),
                        *[F.col("p")[k].alias(x) for k, x in enumerate(names)], "rate")
