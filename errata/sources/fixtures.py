"""Test inputs derived from the driver's ``documents`` table.

Each fixture is a pure function of ``documents`` (FIXTURES.md section 3), so
every query grows with the table it reads.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from errata.functions.words import places, split_words, word_starts
from errata.session import table_path

ESSAYS_A_FILE = 256
_CEFR6 = ["A1", "A2", "B1", "B2", "C1", "C2"]


def _pick(c, values):
    expr = None
    for i, v in enumerate(values):
        expr = F.when(c == i, v) if expr is None else expr.when(c == i, v)
    return expr


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(table_path(sf_dir, "documents"))


def fx_essays(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = documents(spark, sf_dir)
    cefr = F.concat(_pick(F.col("n_chars") % 6, _CEFR6), F.lit("."), F.col("source"))
    return d.select(F.col("doc_id").alias("essay_id"), "text", "n_chars",
                    cefr.alias("cefr"))


def fx_dirty(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = fx_essays(spark, sf_dir)
    k = F.col("essay_id") % 5
    t = F.col("text")
    text = (F.when(k == 0, F.replace(t, F.lit(","), F.lit("，")))
            .when(k == 1, F.replace(t, F.lit(" the "), F.lit("  “the”   ")))
            .when(k == 2, F.concat(F.lit("   "), F.replace(t, F.lit(". "), F.lit(" —  "))))
            .when(k == 3, F.concat(F.lit("Hi\n\nall\n"), t, F.lit("\nBye\n")))
            .otherwise(t))
    return e.select("essay_id", "cefr", text.alias("text"))


def fx_toks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blank/newline separated words with their start offset ``cs``.

    A running sum of lengths over each essay's words: one shuffle by essay,
    which Spark reuses across the fixtures built on these words. Texts are dealt
    by essay before they are split, as words with their keys are larger.
    """
    e = fx_essays(spark, sf_dir).select("essay_id", "text").repartition("essay_id")
    w = Window.partitionBy("essay_id").orderBy("i")
    x = e.select("essay_id", F.posexplode(F.split("text", "[ \n]")).alias("i", "w"))
    cs = (F.sum(F.length("w") + 1).over(w) - F.length("w") - 1).cast("bigint")
    return x.select("essay_id", "i", "w", cs.alias("cs"))


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        found = pc.value_counts(split_words(b.column(0))[1])
        yield pa.RecordBatch.from_arrays([found.field("values"), found.field("counts")], names=["w", "n"])


def fx_word_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words of ``fx_toks``, counted by parts of the table: (w, n), a word once in each part."""
    return fx_essays(spark, sf_dir).select("text").mapInArrow(_counted, "w string, n bigint")


def _placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        texts = b.column(1)
        counts, words = split_words(pc.list_flatten(texts))
        row = np.repeat(pc.list_parent_indices(texts).to_numpy(), counts)
        place, length = places(counts), pc.utf8_length(words).to_numpy()
        starts = word_starts(row, place, length)
        yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row)), pa.array(place, pa.int32()), words, pa.array(starts, pa.int64())],
                                         names=["essay_id", "i", "w", "cs"])


def fx_placed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of ``fx_toks``, worked out text by text over Arrow batches, so that no word is sorted."""
    e = fx_essays(spark, sf_dir).select("essay_id", "text").repartition("essay_id")
    e = e.groupBy("essay_id").agg(F.collect_list("text").alias("texts"))
    return e.mapInArrow(_placed, f"essay_id {e.schema['essay_id'].dataType.simpleString()}, i int, w string, cs bigint")


def fx_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = fx_placed(spark, sf_dir).filter(F.length("w") > 0)
    t = t.withColumn("coder", F.explode(F.array(F.lit(0), F.lit(1))))
    i, eid, w, cs = F.col("i"), F.col("essay_id"), F.col("w"), F.col("cs")
    mix = eid * 31 + i * 17
    t = t.filter(((F.col("coder") == 0) & (mix % 23).isin(0, 17))
                 | ((F.col("coder") == 1) & (eid % 10 == 0) & (mix % 29).isin(0, 17)))
    inside = F.when((i % 6 == 5) & (F.length(w) >= 3), 1).otherwise(0)
    s = cs + inside
    e = (F.when(i % 4 == 2, s)
         .when((i % 5).isin(0, 3), cs + F.length(w) + 6)
         .otherwise(cs + F.length(w)))
    cor = (F.when(i % 5 == 0, F.lit(None).cast("string")).when(i % 4 == 2, "the")
           .when(i % 4 == 3, "").otherwise(F.concat(w, F.lit(" x"))))
    cat = (F.when(i % 5 == 0, F.lit(None).cast("string")).when(i % 4 == 2, "M:DET")
           .when(i % 4 == 3, "U:ADV").when(i % 7 == 0, "R:VERB").when(i % 7 == 1, "R:NOUN")
           .when(i % 7 == 2, "R:ADJ").when(i % 7 == 3, "R:ADV").otherwise("R:SPELL"))
    return t.select("essay_id", "coder", F.col("i").alias("edit_no"),
                    s.cast("bigint").alias("s"), e.cast("bigint").alias("e"),
                    cor.alias("cor"), cat.alias("cat"))


def fx_coders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Who looked at each essay: coder 0 at all, coder 1 at every tenth, with
    or without edits of theirs."""
    e = fx_essays(spark, sf_dir).select("essay_id", F.explode(F.array(F.lit(0), F.lit(1))).alias("coder"))
    return e.filter((F.col("coder") == 0) | (F.col("essay_id") % 10 == 0))


_LEX_PUNCT = "!\"#$%&()*+,-./:;<=>?@[]^_`{|}~"


def fx_lexicon(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = fx_word_counts(spark, sf_dir).select(F.trim("w", F.lit(_LEX_PUNCT)).alias("word"), "n")
    counts = words.filter(F.length("word") > 0).groupBy("word").agg(F.sum("n").alias("n"))
    pos = _pick(F.length("word") % 5, ["NOUN", "VERB", "ADJ", "ADV"]).otherwise("DET")
    return counts.select("word", pos.alias("pos"), F.lower("word").alias("lemma"), "n")


def fx_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Essays dealt to named files of at most ``ESSAYS_A_FILE`` each: their number grows with the table."""
    e = fx_essays(spark, sf_dir)
    number = F.floor(F.col("essay_id") / ESSAYS_A_FILE).cast("bigint")
    return e.withColumn("file", F.concat(F.lit("g"), number.cast("string")))


def fx_psy(spark: SparkSession, sf_dir: str, lexicon: DataFrame | None = None) -> DataFrame:
    lx = (lexicon or fx_lexicon(spark, sf_dir)).filter((F.col("word") == F.col("lemma")) & (F.col("n") % 3 != 0))
    dom = (F.when(F.col("pos") == "NOUN", "Noun").when(F.col("pos") == "VERB", "Verb")
           .when(F.col("pos") == "ADJ", "Adjective").when(F.col("pos") == "ADV", "Adverb")
           .otherwise("Article"))
    return lx.select(F.col("word").alias("Word"), dom.alias("Dom_PoS_SUBTLEX"),
                     F.col("n").cast("string").alias("Freq_pm"),
                     (F.length("word") % 12 + 3).cast("string").alias("AoA_Kup_lem"))


def fx_cefr_vocab(spark: SparkSession, sf_dir: str, lexicon: DataFrame | None = None) -> DataFrame:
    lx = (lexicon or fx_lexicon(spark, sf_dir)).filter(F.col("n") % 2 == 0)
    p, n = F.col("pos"), F.col("n")
    pos = (F.when((p == "VERB") & (n % 4 == 0), "be-verb").when(p == "NOUN", "noun")
           .when(p == "VERB", "verb").when(p == "ADJ", "adjective")
           .when(p == "ADV", "adverb").otherwise("determiner"))
    return lx.select("word", pos.alias("pos"),
                     _pick(F.length("word") % 6, _CEFR6).alias("cefr_j"))
