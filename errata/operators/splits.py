"""Train / test splits of exact size, and the grouped split.

Rows are ordered by ``md5(seed || '_' || salt || id)``; the first
``ceil(share * n)`` go to test. The last test key is found by radix selection,
without a sort: a histogram over the first four hex digits tells the bucket it
lies in and how many rows come before, a histogram over the next four digits
of that bucket's rows narrows it down, and the few keys left are looked at
whole. Every step is one aggregate to a single row, a scalar of the one lazy
plan; rows are placed by comparing their key with the last test key.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from errata.constants import SPLIT_SEED, TEST_SHARE

#: Hex digits of the key that one histogram covers (65,536 buckets), and histograms before whole keys.
DIGITS = 4
LEVELS = 2


def _order_key(idcol: Column, seed: int, salt: str) -> Column:
    """32 hex digits; a null id is a value of its own."""
    return F.md5(F.concat(F.lit(f"{seed}_{salt}"), F.coalesce(idcol.cast("string"), F.lit("\0"))))


def _bucket_of(rows: DataFrame, part: Column, share: float) -> DataFrame:
    """One row (cut, over, k): the bucket of ``part`` that holds the k-th row's key.

    ``rows`` has k, else k is ``ceil(share * n)`` over all rows. The k of the
    result counts from the bucket's start, ``over`` says whether the bucket
    holds more than that.
    """
    given = "k" in rows.columns
    counts = rows.groupBy(part.alias("b")).agg(F.count(F.lit(1)).alias("n"), *([F.first("k").alias("k")] if given else []))
    # A float product, as the reference computes it.
    k = F.max("k") if given else F.ceil(F.lit(float(share)) * F.sum("n"))
    one = counts.agg(F.array_sort(F.collect_list(F.struct("b", "n"))).alias("h"), k.cast("bigint").alias("k"))
    fold = ("aggregate(h, named_struct('cut', CAST(NULL AS STRING), 'before', 0L, 'upto', 0L), (acc, x) -> "
            "IF(acc.cut IS NULL AND acc.upto + x.n >= k, named_struct('cut', x.b, 'before', acc.upto, 'upto', acc.upto + x.n), "
            "IF(acc.cut IS NULL, named_struct('cut', acc.cut, 'before', acc.before, 'upto', acc.upto + x.n), acc)))")
    found = one.select(F.expr(fold).alias("f"), "k")
    return found.select("f.cut", (F.col("f.upto") > F.col("k")).alias("over"), (F.col("k") - F.col("f.before")).alias("k"))


def last_key(keys: DataFrame, share: float) -> Column:
    """Scalar: the ``ceil(share * n)``-th smallest of ``keys`` (_h); null without rows.

    Each level joins the keys with the one row of the level before.
    """
    found = _bucket_of(keys, F.substring("_h", 1, DIGITS), share)
    for level in range(LEVELS):
        rows = keys.join(F.broadcast(found), F.substring("_h", level * DIGITS + 1, DIGITS) == F.col("cut")).select("_h", "k")
        part = F.substring("_h", (level + 1) * DIGITS + 1, DIGITS) if level + 1 < LEVELS else F.col("_h")
        # Digits before those of this level are equal in all rows that are left.
        keys = rows.select("_h")
        found = _bucket_of(rows, part, share)
    return found.select(F.when(F.col("over"), F.raise_error(F.lit(
        "the split falls between rows of one id: ids must be unique")).cast("string")).otherwise(F.col("cut"))).scalar()


def split_exact(df: DataFrame, idcol: str, share: float = TEST_SHARE, seed: int = SPLIT_SEED,
                salt: str = "", left: str = "train", right: str = "test", ids: DataFrame | None = None) -> DataFrame:
    """Add ``split`` = right for the first ceil(share * n) rows by key.

    Ids must tell rows apart: if rows of one id lie on both sides of the cut,
    no split of exact size follows from the ids, and the query fails. ``ids``,
    if given, has the same ids as ``df`` and is cheaper to read.
    """
    key = _order_key(F.col(idcol), seed, salt)
    cut = last_key((df if ids is None else ids).select(key.alias("_h")), share)
    return df.withColumn("split", F.when(F.coalesce(key <= cut, F.lit(False)), right).otherwise(left))


def split_rows(df: DataFrame, idcol: str, create_dev: bool = False, share: float = TEST_SHARE,
               seed: int = SPLIT_SEED, ids: DataFrame | None = None) -> DataFrame:
    """U2 + U4: train / test, and optionally dev carved from train the same way."""
    if not create_dev:
        return split_exact(df, idcol, share, seed, ids=ids)
    small = (df if ids is None else ids).select(idcol)
    test_key, dev_key = _order_key(F.col(idcol), seed, ""), _order_key(F.col(idcol), seed, "dev")
    test_cut = last_key(small.select(test_key.alias("_h")), share)
    in_test = F.coalesce(test_key <= test_cut, F.lit(False))
    dev_cut = last_key(small.filter(~in_test).select(dev_key.alias("_h")), share)
    in_dev = F.coalesce(dev_key <= dev_cut, F.lit(False))
    return df.withColumn("split", F.when(in_test, "test").when(in_dev, "dev").otherwise("train"))


def split_grouped(df: DataFrame, column: str, share: float = TEST_SHARE,
                  seed: int = SPLIT_SEED) -> DataFrame:
    """U3 + A4 + J8: split the distinct values of ``column``; rows follow.

    A row's side follows from its own value's key, without a join.
    """
    return split_exact(df, column, share, seed, ids=df.select(column).distinct())


def test_size(n: int, share: float = TEST_SHARE) -> int:
    return math.ceil(share * n)
