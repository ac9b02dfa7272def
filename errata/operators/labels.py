"""Token labels: which tokens an edit of a selected type covers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from errata.constants import (CONTENT_TAGS, LABEL_FALSE, LABEL_NONE, LABEL_TRUE,
                              SELECTED_LABELS)


def covered_by_spans(tokens: DataFrame, spans: DataFrame, keys: list[str]) -> DataFrame:
    """Flag tokens ``[cs, ce)`` that overlap any span ``[s, e)`` with ``s < e``.

    A range join written as one sorted pass per key: spans and token ends are
    merged in position order, and a token is covered when the largest span
    end among spans starting before the token's end lies past its start.
    No pair of rows is formed.
    """
    tok = tokens.select(*keys, F.col("ce").alias("_pos"), F.lit(0).alias("_k"),
                        F.col("cs").alias("_cs"), F.lit(None).cast("long").alias("_e"),
                        F.struct(*[c for c in tokens.columns]).alias("_row"))
    sp = (spans.filter(F.col("s") < F.col("e"))
          .select(*keys, F.col("s").alias("_pos"), F.lit(1).alias("_k"),
                  F.lit(None).cast("long").alias("_cs"), F.col("e").cast("long").alias("_e"),
                  F.lit(None).cast(tok.schema["_row"].dataType).alias("_row")))
    w = (Window.partitionBy(*keys).orderBy("_pos", "_k")
         .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    merged = tok.unionByName(sp).withColumn("_reach", F.max("_e").over(w))
    out = merged.filter(F.col("_k") == 0).select(
        "_row.*", F.coalesce(F.col("_reach") > F.col("_cs"), F.lit(False)).alias("covered"))
    return out


def selected_type(cat: Column) -> Column:
    """Only replacements of the four content types label a token."""
    return cat.isin(*SELECTED_LABELS)


def label_value(covered: Column) -> Column:
    return F.when(covered, F.lit(LABEL_TRUE)).otherwise(F.lit(LABEL_FALSE))


def mask_label(label: Column, pos: Column) -> Column:
    """Tokens outside the four content parts of speech are ``NONE``."""
    return F.when(pos.isin(*CONTENT_TAGS), label).otherwise(F.lit(LABEL_NONE))
