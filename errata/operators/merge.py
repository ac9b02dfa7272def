"""Merge strategies over the edit-operation sequence of a sentence.

Re-aimed onto given edits: each token edit becomes one operation per token
(``S`` for min(|orig|, |cor|) substitutions, then ``D`` deletions or ``I``
insertions) and the orig tokens between edits are matches ``M``. Then
  all-split  every non-match operation is an edit,
  all-merge  each run of adjacent non-matches is one edit,
  all-equal  each run of adjacent operations of the same kind is one edit.
A row's operations are one string; its runs are found in numbers, over Arrow
batches of whole rows (see ``replay.merged_runs``), so no operation is a row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from errata.functions.letbind import let
from errata.functions.replay import merged_runs, reached_before

KEY = ["essay_id", "coder", "para_no"]


def edit_operations(sents: DataFrame) -> DataFrame:
    """Keys and ``ops``: each row's operations in order, a letter each."""
    srt = ("array_sort(tok_edits, (p, q) -> CASE WHEN p.ts <> q.ts THEN IF(p.ts < q.ts, -1, 1) "
           "WHEN p.te <> q.te THEN IF(p.te < q.te, -1, 1) "
           "WHEN p.edit_no <> q.edit_no THEN IF(p.edit_no < q.edit_no, -1, 1) ELSE 0 END)")
    edit_ops = ("concat(repeat('S', least(z.te - z.ts, size(z.cor_toks))), "
                "repeat(IF(z.te - z.ts > size(z.cor_toks), 'D', 'I'), abs(z.te - z.ts - size(z.cor_toks))))")
    x = sents.withColumn("_s", F.expr(srt))
    x = x.withColumn("_before", reached_before("transform(_s, z -> z.te)"))
    each = f"concat(repeat('M', greatest(z.ts - v.before[i], 0)), {edit_ops})"
    rest = "repeat('M', greatest(size(orig) - greatest(coalesce(array_max(transform(_s, z -> z.te)), 0), 0), 0))"
    ops = F.expr(f"concat({let([('s', '_s'), ('before', '_before')], f"array_join(transform(v.s, (z, i) -> {each}), '')")}, {rest})")
    return x.select(*KEY, ops.alias("ops"))


def merge_ops(sents: DataFrame) -> DataFrame:
    """Merged edits per strategy: keys, strategy, o_start, o_end, c_start, c_end, ops.

    Rows that repeat a key are one sequence, their operations taken in turn.
    """
    rows = edit_operations(sents).groupBy(*KEY).agg(F.collect_list("ops").alias("_ops"))
    rows = rows.withColumn("_runs", merged_runs("_ops"))
    return rows.select(*KEY, F.inline("_runs"))
