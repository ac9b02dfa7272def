"""Dense numbers in a global order, without a task that sees all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from errata.session import materialise


def dense_numbers(df: DataFrame, order: list[str], out: str = "row_i", partitions: int | None = None) -> DataFrame:
    """``out`` counts the rows 0, 1, ... in the order of ``order``.

    In two passes: rows are range-partitioned and sorted once, and written with
    their partition and place in it; a table with one row per partition counts
    them, its running sum is where each partition starts. ``order`` should tell
    rows apart; ties are numbered in any order. Nulls come first.
    """
    if partitions:
        placed = df.repartitionByRange(partitions, *order)
    else:
        placed = df.repartitionByRange(*order)
    placed = placed.sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id())
    # Spark's ids count the rows of a partition in their lower 33 bits.
    placed = placed.withColumn("_place", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))
    placed = materialise(placed, "dense-rows")
    counts = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    w = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("_part", F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_start"))
    numbered = placed.join(F.broadcast(starts), "_part")
    return numbered.withColumn(out, F.col("_start") + F.col("_place")).drop("_part", "_place", "_start")
