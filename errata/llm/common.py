"""Helpers shared by the operators: written tables and row packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from errata.session import release, scratch_path, table_path  # noqa: F401

#: White space that separates words: space and the controls 09 to 0D.
SPACE = r"[\x20\x09-\x0D]"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(table_path(sf_dir, name))


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Cuts the lineage: later steps, and retries after a lost executor, start
    from files that every executor sees. The planner also knows the table's
    real size from then on, so that it broadcasts by its own threshold.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def with_default(df: DataFrame, name: str, kind: str) -> DataFrame:
    """``df`` with column ``name`` of SQL type ``kind``, null where it is missing."""
    if name in df.columns:
        return df
    return df.withColumn(name, F.lit(None).cast(kind))
