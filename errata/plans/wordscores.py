"""The minimum end-to-end slice and the labelled sequences it yields.

words of each essay -> labels from coder-0 edits of the four content types
(char spans) -> part of speech from the lexicon -> mask -> counts and ratio
per (token, pos).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from errata.constants import CONTENT_TAGS, FIELD_SEP, LABEL_FALSE, LABEL_NONE, LABEL_TRUE
from errata.functions import words as wd
from errata.operators import chunks
from errata.operators.lookup import unique_words
from errata.operators.labels import covered_by_spans, label_value, mask_label, selected_type
from errata.operators.scores import word_scores
from errata.operators.tagging import tag_tokens
from errata.sources import fixtures as fx


def words(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = fx.fx_toks(spark, sf_dir).filter(F.length("w") > 0)
    return t.select("essay_id", "i", "w", "cs", (F.col("cs") + F.length("w")).alias("ce"))


def word_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    edits = (fx.fx_edits(spark, sf_dir)
             .filter((F.col("coder") == 0) & selected_type(F.col("cat")))
             .select("essay_id", "s", "e"))
    lab = covered_by_spans(words(spark, sf_dir), edits, ["essay_id"])
    return lab.withColumn("label", label_value(F.col("covered"))).drop("covered")


def masked_word_labels(spark: SparkSession, sf_dir: str, lexicon: DataFrame | None = None) -> DataFrame:
    """``lexicon``: unique and written; made from the corpus if not given."""
    lexicon = lexicon or unique_words(fx.fx_lexicon(spark, sf_dir))
    lab = tag_tokens(word_labels(spark, sf_dir), "w", lexicon)
    return lab.withColumn("label", mask_label(F.col("label"), F.col("pos")))


def word_scores_e2e(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = masked_word_labels(spark, sf_dir).select(F.col("w").alias("token"), "pos", "label")
    return word_scores(m)


def sequence_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(seq_id) of ``labelled_sequences``, from the essays alone: those with a word."""
    e = fx.fx_essays(spark, sf_dir).filter(F.col("text").rlike("[^ \n]"))
    return e.select(F.concat(F.lit("fx_"), F.col("essay_id").cast("string")).alias("seq_id"))


def label_essays(essays: pa.Table, side: pa.Table) -> pa.Table:
    """The labelled sequences of a chunk's ``essays`` (essay_id, text, cefr).

    ``side`` holds the chunk's spans (essay_id, s, e) and, where ``word`` is given,
    its dictionary (word, pos). Texts that share an id are one essay: each of its
    rows gets the words of all, as the essay's spans refer to all.
    """
    ids = wd.one(essays["essay_id"]).dictionary_encode()
    essay = ids.indices.to_numpy()
    counts, words = wd.split_words(wd.one(essays["text"]))
    row, place, length = np.repeat(essay, counts), wd.places(counts), pc.utf8_length(words).to_numpy()
    start = wd.word_starts(row, place, length)
    real = length > 0
    row, place, words, start, end = row[real], place[real], words.filter(pa.array(real)), start[real], (start + length)[real]

    is_word = pc.is_valid(side["word"])
    table, spans = side.filter(is_word), side.filter(pc.invert(is_word))
    span_row = pc.fill_null(pc.index_in(wd.one(spans["essay_id"]), value_set=ids.dictionary), -1).to_numpy()
    covered = wd.overlapped(row, start, end, span_row, wd.one(spans["s"]).to_numpy(), wd.one(spans["e"]).to_numpy())
    content = pc.is_in(wd.one(table["pos"]), value_set=pa.array(CONTENT_TAGS)).to_numpy(zero_copy_only=False)
    masked = ~content[pc.index_in(words, value_set=wd.one(table["word"])).to_numpy()]
    labels = pa.array([LABEL_TRUE, LABEL_FALSE, LABEL_NONE]).take(pa.array(np.where(masked, 2, np.where(covered, 0, 1))))

    if (np.bincount(essay, minlength=1) > 1).any() or (np.diff(essay) < 0).any():
        t = pa.table({"row": row, "place": place, "word": words, "label": labels})
        order = pc.sort_indices(t, sort_keys=[(c, "ascending") for c in t.column_names])
        row, words, labels = row[order.to_numpy()], words.take(order), labels.take(order)
    n = np.bincount(row, minlength=len(ids.dictionary)).astype(np.int64)
    has = n[essay] > 0
    pick = pa.array(essay[has])
    return pa.Table.from_arrays([wd.one(essays["essay_id"]).filter(pa.array(has)), wd.join(n, words, FIELD_SEP).take(pick),
                                 wd.join(n, labels, FIELD_SEP).take(pick), wd.one(essays["cefr"]).filter(pa.array(has))],
                                names=["essay_id", "token_seq", "label_seq", "cefr"])


def labelled_sequences(spark: SparkSession, sf_dir: str, lexicon: DataFrame | None = None) -> DataFrame:
    """One labelled sequence per essay: seq_id, token_seq, label_seq, cefr, row_i.

    The steps of ``masked_word_labels`` over whole texts: a chunk's essays meet their
    spans and the tags of the chunk's distinct words (see ``operators.chunks``).
    """
    lexicon = lexicon or unique_words(fx.fx_lexicon(spark, sf_dir))
    ess = fx.fx_essays(spark, sf_dir).where("essay_id IS NOT NULL").select("essay_id", "text", F.left(F.col("cefr"), F.lit(2)).alias("cefr"))
    n = chunks.chunk_count(ess, F.length("text"))
    essays = chunks.by_chunk(ess, "essay_id", n)
    words = chunks.chunk_words(essays, "text", wd.split_words).where("word <> ''")
    tags = tag_tokens(words, "word", lexicon, even=True).select("_chunk", "word", "pos")
    spans = (fx.fx_edits(spark, sf_dir)
             .filter((F.col("coder") == 0) & selected_type(F.col("cat")) & (F.col("s") < F.col("e")))
             .select(chunks.chunk_of("essay_id", n).alias("_chunk"), "essay_id", "s", "e"))
    side = spans.unionByName(tags, allowMissingColumns=True)
    kind = ess.schema["essay_id"].dataType.simpleString()
    made = chunks.with_side(essays, side, label_essays, f"essay_id {kind}, token_seq string, label_seq string, cefr string")
    return made.select(F.concat(F.lit("fx_"), F.col("essay_id").cast("string")).alias("seq_id"),
                       "token_seq", "label_seq", "cefr", F.col("essay_id").cast("bigint").alias("row_i"))
