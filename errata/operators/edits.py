"""Character edits: kind, paragraph assignment and covered detections."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F

from errata.functions.letbind import let
from errata.functions.text import normalise_punct
from errata.operators.paragraphs import paragraphs_sql


def edit_kinds(edits: DataFrame) -> DataFrame:
    """P3 + P1: ``kind`` D for a null correction (a detection), else C.

    A correction keeps its given type in ``cat`` (``C`` when none is given)
    and its text is normalised; a detection has neither.
    """
    is_det = F.col("cor").isNull()
    return (edits
            .withColumn("kind", F.when(is_det, "D").otherwise("C"))
            .withColumn("cat", F.when(is_det, F.lit(None).cast("string"))
                        .otherwise(F.coalesce(F.col("cat"), F.lit("C"))))
            .withColumn("cor", normalise_punct(F.col("cor"))))


def paragraph_bounds(essays: DataFrame, text: str = "text") -> DataFrame:
    """Per essay, the sorted paragraph starts and ends (one small row)."""
    p = essays.select("essay_id", F.expr(paragraphs_sql(text, with_text=False)).alias("paras"))
    return p.select("essay_id",
                    F.expr("transform(paras, x -> x.p_start)").alias("pstarts"),
                    F.expr("transform(paras, x -> x.p_end)").alias("pends"))


def assign_paragraphs(edits: DataFrame, bounds: DataFrame, seen: Observation | None = None) -> DataFrame:
    """J1 + P4: the paragraph(s) holding each edit, offsets rebased.

    The holding paragraph is the last one starting at or before ``s`` (an
    as-of lookup in the essay's start array); the edit is kept when it also
    ends inside it. An insertion exactly on a boundary belongs to both
    paragraphs. Edits crossing a boundary vanish; ``seen`` counts them
    (``edits``, ``crossing``) in the same job.
    """
    j = edits.join(bounds, "essay_id")
    # The holding paragraph is bound: written out in the filter, it would be looked for at each mention.
    held = ("filter(array(v.k, v.k - 1), q -> q >= 0 AND ((q = v.k AND v.e <= v.pends[q]) OR "
            "(q = v.k - 1 AND v.s = v.e AND v.s = v.pstarts[q + 1] AND v.s = v.pends[q])))")
    cands = let([("k", "size(filter(pstarts, x -> x <= s)) - 1"), ("s", "s"), ("e", "e"),
                 ("pstarts", "pstarts"), ("pends", "pends")], held)
    j = j.withColumn("_paras", F.expr(cands))
    if seen is not None:
        j = j.observe(seen, F.count(F.lit(1)).alias("edits"), F.count_if(F.size("_paras") == 0).alias("crossing"))
    j = j.withColumn("para_no", F.explode("_paras")).drop("_paras")
    return (j.withColumn("s", F.col("s") - F.expr("pstarts[para_no]"))
             .withColumn("e", F.col("e") - F.expr("pstarts[para_no]"))
             .drop("pstarts", "pends"))


def drop_covered_detections(edits: DataFrame, keys: list[str]) -> DataFrame:
    """Drop a detection that holds a correction of the same paragraph.

    A detection [s, e] is dropped when some correction span [cs, ce] with
    cs < ce has cs >= s and ce <= e, or some insertion at x has s < x < e.
    Both tests are running minimums in one pass ordered by position
    descending: the smallest ce among corrections starting at or after s,
    and the smallest insertion point after s. No pairs are formed.
    """
    is_c, is_d = F.col("kind") == "C", F.col("kind") == "D"
    order_t = (F.when(is_c & (F.col("s") < F.col("e")), 0)
               .when(is_d, 1).when(is_c & (F.col("s") == F.col("e")), 2).otherwise(3))
    x = edits.withColumn("_t", order_t)
    w = (Window.partitionBy(*keys).orderBy(F.col("s").desc(), F.col("_t"))
         .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    x = (x.withColumn("_min_ce", F.min(F.when(F.col("_t") == 0, F.col("e"))).over(w))
          .withColumn("_min_ins", F.min(F.when(F.col("_t") == 2, F.col("s"))).over(w)))
    covered = is_d & ((F.col("_min_ce") <= F.col("e")) | (F.col("_min_ins") < F.col("e")))
    return x.filter(~F.coalesce(covered, F.lit(False))).drop("_t", "_min_ce", "_min_ins")
