"""Connected components of links, and links of candidate buckets (native).

Both work on DataFrames only. Every round writes its small state to the shared
folder, so plans stay short and a lost executor costs one round at most.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from errata.llm.common import written

#: The pairs left in all buckets are tested together once they are at most so
#: many for each row, or so many in all.
FEW_PAIRS = 4
LEAST_PAIRS = 20_000
#: Rounds of pivots, at most.
ROUNDS = 4


def components(links: DataFrame) -> DataFrame:
    """(node, root) of every node of ``links(a, b)``; root is the smallest node reachable.

    Distributed union-find: every root takes the smallest root beside it, one
    more hop shortens the chains, and links are rewritten to the new roots.
    Links inside one component vanish, so the state shrinks each round and a
    star of any size collapses in one. Needs O(log n) rounds.
    """
    links = written(links.where("a <> b").select("a", "b").distinct(), "links")
    nodes = links.select(F.col("a").alias("node")).union(links.select("b")).distinct()
    labels = nodes.withColumn("root", F.col("node"))
    while not links.isEmpty():
        both = links.union(links.select("b", "a"))
        least = both.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m"))
        least = written(least.select("u", F.least("u", "m").alias("m")), "parents")
        up = least.select(F.col("u").alias("m"), F.col("m").alias("m2"))
        jump = written(least.join(up, "m", "left").select("u", F.coalesce("m2", "m").alias("r")), "jumps")
        labels = written(
            labels.join(jump, labels["root"] == jump["u"], "left")
            .select("node", F.coalesce("r", "root").alias("root")), "labels")
        ja = jump.select(F.col("u").alias("a"), F.col("r").alias("ra"))
        jb = jump.select(F.col("u").alias("b"), F.col("r").alias("rb"))
        links = written(
            links.join(ja, "a").join(jb, "b").where("ra <> rb")
            .select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct(), "links")
    return labels


def live_buckets(members: DataFrame) -> DataFrame:
    """Rows (key, id, prev) of buckets with two ids or more, in one shuffle.

    ``prev`` is the next smaller id of the bucket. Rows must be distinct. Each
    bucket is a sorted run that is only streamed past its neighbours; nothing
    is gathered.
    """
    w = W.partitionBy("key").orderBy("id")
    seen = members.select("key", "id", F.lag("id").over(w).alias("prev"), F.lead("id").over(w).alias("n"))
    return seen.where("prev IS NOT NULL OR n IS NOT NULL").select("key", "id", "prev")


def bucket_components(live: DataFrame, verify: Callable[[DataFrame], DataFrame], cheap: bool = False,
                      narrow: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """(node, root) over every true link between ids that share a bucket.

    ``verify`` keeps the true links of candidate pairs (a, b). In each round
    a bucket's smallest untested ids, the pivots, meet the bucket's ids of other
    components, which settles all pairs of those pivots; their number doubles
    from round to round. Buckets whose ids have come together in one component
    need no more tests. Once the pairs that are left are few beside the rows, or
    after ``ROUNDS``, what is left is tested at once, across components only.
    That last step grows with the square of what a bucket still holds, unless
    ``narrow`` is given: it makes the pairs (a, b) to be tested of rows
    (key, id, root) without listing them all, and what it leaves out must connect
    nothing that the tested pairs and the roots don't. If a test is
    ``cheap``, the first round also tests neighbours in the bucket's order, and
    half the rounds do. The result is exact: a pair is skipped only when it is
    already connected.
    """
    live = written(live.withColumn("root", F.col("id")), "buckets")
    beside = live.where("prev IS NOT NULL").select(F.col("prev").alias("a"), F.col("id").alias("b"))
    links, count = None, 1
    for turns in itertools.count():
        left = live.groupBy("key").agg(F.count("*").alias("m")).agg(
            F.sum("m").alias("rows"), F.sum(F.col("m") * F.col("m")).alias("pairs")).first()
        few = (left.pairs or 0) <= max(FEW_PAIRS * (left.rows or 0), LEAST_PAIRS)
        last = turns > 0 and (few or turns >= (ROUNDS // 2 if cheap else ROUNDS))
        turn = F.row_number().over(W.partitionBy("key").orderBy("id"))
        pivots = live if last else live.withColumn("turn", turn).where(F.col("turn") <= count)
        pivots = pivots.select("key", F.col("id").alias("a"), F.col("root").alias("ra"))
        if last and narrow and not few:
            return components(links.union(written(verify(narrow(live)).select("a", "b"), "verified")))
        pairs = (live.select("key", "id", "root").join(pivots, "key")
                 .where("id <> a AND root <> ra" + " AND a < id" * last)
                 .select(F.least("a", "id").alias("a"), F.greatest("a", "id").alias("b")))
        pairs = pairs.union(beside) if cheap and links is None else pairs
        found = written(verify(pairs.distinct()).select("a", "b"), "verified")
        links = found if links is None else links.union(found)
        roots = components(links)
        if last:
            return roots
        rest = live.select("key", "id").join(pivots.select("key", F.col("a").alias("id")), ["key", "id"], "left_anti")
        rest = (rest.join(roots.withColumnRenamed("node", "id"), "id", "left")
                .select("key", "id", F.coalesce("root", "id").alias("root")))
        rest = written(rest, "rest")
        open_keys = (rest.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi"))
                     .where("lo <> hi").select("key"))
        live = written(rest.join(open_keys, "key", "left_semi"), "buckets")
        if live.isEmpty():
            return roots
        count *= 2
