"""Token features (one row per token) and the lexicons they use."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from errata.constants import CEFR_J_POS_MAP, CEFR_LEVELS, PSY_POS_MAP
from errata.functions.text import strip_ascii_punct
from errata.operators.chunks import rows_with_words
from errata.operators.lookup import lookup_join, two_step_lookup
from errata.operators.tagging import tag_tokens
from errata.session import materialise

SEP_RE = r"\|\|\|"


def _map(d: dict) -> Column:
    return F.create_map(*[F.lit(x) for kv in d.items() for x in kv])


def last_per_key(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The last row per key wins, ``order`` giving the row order."""
    others = [c for c in df.columns if c not in keys]
    best = F.max_by(F.struct(*others), F.col(order)).alias("_last")
    return df.groupBy(*keys).agg(best).select(*keys, "_last.*")


def psy_lexicon(raw: DataFrame, order: str) -> DataFrame:
    """(Word, pos) -> freq_pm, aoa; four parts of speech kept. The last
    row by ``order`` wins."""
    df = raw.withColumn("pos", _map(PSY_POS_MAP)[F.col("Dom_PoS_SUBTLEX")]).filter(F.col("pos").isNotNull())
    df = df.select(F.col("Word").alias("word"), "pos",
                   F.expr("try_cast(Freq_pm AS double)").alias("freq_pm"),
                   F.expr("try_cast(AoA_Kup_lem AS double)").alias("aoa"),
                   F.col(order).alias("_row_no"))
    return last_per_key(df, ["word", "pos"], "_row_no").drop("_row_no")


def cefr_lexicon(raw: DataFrame, order: str) -> DataFrame:
    """(word, pos) -> level 0..5; an unknown level is an error. The last
    row by ``order`` wins."""
    df = raw.withColumn("_pos", _map(CEFR_J_POS_MAP)[F.col("pos")]).filter(F.col("_pos").isNotNull())
    level = _map(CEFR_LEVELS)[F.col("cefr_j")]
    level = F.when(level.isNull(), F.raise_error(F.concat(F.lit("unknown CEFR level: "),
                                                           F.coalesce(F.col("cefr_j"), F.lit("null")))))\
             .otherwise(level)
    df = df.select("word", F.col("_pos").alias("pos"), level.cast("int").alias("cefr_j"),
                   F.col(order).alias("_row_no"))
    return last_per_key(df, ["word", "pos"], "_row_no").drop("_row_no")


def zipf_table(tokens: DataFrame, token: str = "token", count: str | None = None) -> DataFrame:
    """A9 (re-aimed): corpus frequency on the Zipf scale.

    Words are the stripped, lower-cased tokens; ``zipf = round(log10(count /
    total) + 9, 2)``, floored at 0. The total is a one-row aggregate. A row
    stands for one token, or for as many as its ``count`` says.
    """
    words = (tokens.select(F.lower(strip_ascii_punct(F.col(token))).alias("word"),
                           (F.col(count) if count else F.lit(1)).cast("bigint").alias("_n"))
             .filter(F.length("word") > 0))
    counts = words.groupBy("word").agg(F.sum("_n").alias("n"))
    total = counts.select(F.sum("n")).scalar()  # scalar subquery, one value
    z = F.greatest(F.round(F.log10(F.col("n") / total) + 9, 2), F.lit(0.0))
    return counts.select("word", "n", z.alias("zipf"))


def token_scalar_features(token: Column) -> list[Column]:
    """X1-X4."""
    stripped = strip_ascii_punct(token)
    nonempty = F.length(stripped) > 0
    first_upper = nonempty & stripped.rlike(r"^\p{Lu}")
    all_upper = nonempty & stripped.rlike(r"\p{Lu}") & ~stripped.rlike(r"[\p{Ll}\p{Lt}]")
    return [F.length(token).cast("int").alias("character_length"),
            stripped.alias("stripped"),
            first_upper.alias("first_upper"), all_upper.alias("all_upper")]


def pos_flags(pos: Column) -> list[Column]:
    """X5."""
    return [(pos == "NOUN").alias("is_noun"), (pos == "VERB").alias("is_verb"),
            (pos == "ADJ").alias("is_adjective"), (pos == "ADV").alias("is_adverb")]


def token_rows(seqs: DataFrame) -> DataFrame:
    """E11 + A7: sequence rows -> one row per token position.

    Tokens and labels are split on ``|||``; rows stop at the shorter of the
    two (tags and lemmas come one per token). ``seqs`` has seq_id,
    token_seq, label_seq, cefr, row_i.
    """
    toks = F.split(F.col("token_seq"), SEP_RE, -1)
    labs = F.split(F.col("label_seq"), SEP_RE, -1)
    x = seqs.select("row_i", "seq_id", "cefr", toks.alias("_toks"), labs.alias("_labs"))
    x = x.select("row_i", "seq_id", "cefr", F.size("_toks").cast("int").alias("sequence_length"),
                 "_labs", F.posexplode("_toks").alias("feature_i", "token"))
    return (x.filter(F.col("feature_i") < F.size("_labs"))
             .withColumn("label", F.get(F.col("_labs"), F.col("feature_i")))
             .drop("_labs"))


# The output columns and their order.
FEATURE_COLUMNS = ["character_length", "frequency", "first_upper", "all_upper",
                   "sequence_length", "sequence_id", "token", "pos", "cefr", "cefr_j",
                   "freq_pm", "aoa", "is_noun", "is_verb", "is_adjective", "is_adverb",
                   "label", "row_i", "feature_i"]


def with_word_features(rows: DataFrame, tag_lexicon: DataFrame, psy: DataFrame, cefr_j: DataFrame,
                       zipf: DataFrame, even: bool = False) -> DataFrame:
    """What follows from ``token`` alone. The four lookup
    tables are written and unique on their keys. ``even``: tokens don't repeat."""
    rows = tag_tokens(rows, "token", tag_lexicon, even=even)
    rows = rows.select("*", *token_scalar_features(F.col("token")))
    z = zipf.select(F.col("word").alias("_zw"), F.col("zipf").alias("_zipf"))
    rows = lookup_join(rows, z, [(F.lower(F.col("stripped")), "_zw")], even=even)
    rows = rows.withColumn("frequency", F.coalesce(F.col("_zipf"), F.lit(0.0))).drop("_zw", "_zipf")
    rows = two_step_lookup(rows, psy, [F.col("token"), F.col("pos")],
                           [F.col("lemma"), F.col("pos")], ["word", "pos"],
                           ["freq_pm", "aoa"], "_psy", even)
    rows = two_step_lookup(rows, cefr_j, [F.col("token"), F.col("pos")],
                           [F.col("lemma"), F.col("pos")], ["word", "pos"],
                           ["cefr_j"], "_cj", even)
    return rows


def word_dictionary(rows: DataFrame, *tables: DataFrame) -> DataFrame:
    """Every distinct token of ``rows`` with its word features, written: the
    lexicons are looked up once for each word, not for each of its places."""
    return materialise(with_word_features(rows.select("token").distinct(), *tables, even=True), "word-dictionary")


def with_dictionary(words: DataFrame, *tables: DataFrame) -> DataFrame:
    """The distinct tokens of each chunk (_chunk, token) with their word features.

    A token that many chunks share is looked up in the lexicons once.
    """
    words = materialise(words, "chunk-words")
    table = word_dictionary(words, *tables).withColumnRenamed("token", "_word")
    return lookup_join(words, table, [(F.col("token"), "_word")], even=True).drop("_word")


def tagged_rows(seqs: DataFrame, tag_lexicon: DataFrame) -> DataFrame:
    """``token_rows`` with ``pos`` and ``lemma``; ``seqs`` and the lexicon are written."""
    return rows_with_words(seqs, lambda words: tag_tokens(words, "token", tag_lexicon, even=True))


def featurise(seqs: DataFrame, tag_lexicon: DataFrame, psy: DataFrame, cefr_j: DataFrame,
              zipf: DataFrame, keep: tuple[str, ...] = (), ordered: bool = False) -> DataFrame:
    """The 19-column token feature rows (unsorted unless ``ordered``), and the
    columns ``keep`` (lemma, stripped).

    Sequences stay whole until they meet the dictionary of their chunk
    (``operators.chunks``); ``seqs`` is written, as it is read several times.
    """
    rows = rows_with_words(seqs, lambda words: with_dictionary(words, tag_lexicon, psy, cefr_j, zipf), ordered)
    return rows.select(
        "character_length", "frequency", "first_upper", "all_upper",
        "sequence_length", F.col("seq_id").alias("sequence_id"), "token", "pos", "cefr",
        F.col("_cj_cefr_j").cast("double").alias("cefr_j"),
        F.col("_psy_freq_pm").alias("freq_pm"), F.col("_psy_aoa").alias("aoa"),
        *pos_flags(F.col("pos")), "label",
        F.col("row_i").cast("bigint").alias("row_i"), F.col("feature_i").cast("int").alias("feature_i"), *keep)


def sort_features(seqs: DataFrame, *tables: DataFrame) -> DataFrame:
    """O2: the features of ``seqs`` in the order of row_i, feature_i (range-partitioned,
    sorted as sequences, which are fewer and smaller than their tokens' rows)."""
    return featurise(seqs, *tables, ordered=True)
