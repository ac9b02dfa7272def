"""How often each (token, part of speech) pair is revised."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from errata.constants import FIELD_SEP, LABEL_FALSE, LABEL_TRUE


def word_counts(features: DataFrame, count: str | None = None) -> DataFrame:
    """A1 + A2 in one partial/final hash aggregate (hot words combine map-side). A
    row stands for one token, or for as many as its ``count`` says."""
    f = features.filter(F.col("label").isin(LABEL_TRUE, LABEL_FALSE))
    if count:
        sums = (F.sum(count).alias("n_seen"), F.sum(F.when(F.col("label") == LABEL_TRUE, F.col(count)).otherwise(0)).alias("n_true"))
    else:
        sums = (F.count(F.lit(1)).alias("n_seen"), F.count_if(F.col("label") == LABEL_TRUE).alias("n_true"))
    return f.groupBy("token", "pos").agg(*sums)


def word_scores(features: DataFrame, count: str | None = None) -> DataFrame:
    """A3: ratio true / seen, only for pairs revised at least once."""
    c = word_counts(features, count).filter(F.col("n_true") > 0)
    return c.withColumn("score", F.col("n_true") / F.col("n_seen"))


def word_scores_ordered(features: DataFrame, order_cols: list[str]) -> DataFrame:
    """Scores in the order each pair is first seen.

    The first-seen position is the smallest ``order_cols`` tuple of the pair,
    taken in the same aggregate; output carries it as ``first_seen`` (a
    struct) and is sorted by it.
    """
    f = features.filter(F.col("label").isin(LABEL_TRUE, LABEL_FALSE))
    c = (f.groupBy("token", "pos")
          .agg(F.count(F.lit(1)).alias("n_seen"),
               F.count_if(F.col("label") == LABEL_TRUE).alias("n_true"),
               F.min(F.struct(*order_cols)).alias("first_seen"))
          .filter(F.col("n_true") > 0)
          .withColumn("score", F.col("n_true") / F.col("n_seen")))
    return c.orderBy("first_seen")


def score_map_rows(scores: DataFrame) -> DataFrame:
    """S11 rows: key ``token|||pos`` and the ratio."""
    return scores.select(F.concat_ws(FIELD_SEP, "token", "pos").alias("key"),
                         F.col("score"))
