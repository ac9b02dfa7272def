"""Part of speech and lemma per token from a lexicon.

Re-aimed: a statistical tagger is replaced by a lexicon join. The token is
looked up as it is, then in lower case; a miss is tagged ``X`` and its lemma
is the token itself.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from errata.constants import UNKNOWN_TAG
from errata.operators.lookup import fits, lookup_join


def tag_tokens(df: DataFrame, token: str, lexicon: DataFrame, pos_col: str = "pos", lemma_col: str = "lemma",
               even: bool = False) -> DataFrame:
    """Add ``pos_col`` and ``lemma_col``; ``lexicon`` has one row per word
    (word, pos, lemma) and is written (see ``lookup.unique_words``).

    One join for both steps: the words that are alike in lower case are one row
    of the table, in which the token is looked up, then its lower case. ``even``:
    see ``lookup_join``.
    """
    t = F.col(token)
    entries = F.collect_list(F.struct("word", "pos", "lemma")).alias("_tg_words")
    table = lexicon.where("word IS NOT NULL").groupBy(F.lower("word").alias("_tg_key")).agg(entries)
    out = lookup_join(df, table, [(F.lower(t), "_tg_key")], fits(lexicon), even)
    entry = lambda w: F.get(F.filter("_tg_words", lambda x: x["word"] == w), F.lit(0))
    out = out.withColumn("_tg", F.coalesce(entry(t), entry(F.lower(t))))
    return (out.withColumn(pos_col, F.coalesce(F.col("_tg.pos"), F.lit(UNKNOWN_TAG)))
               .withColumn(lemma_col, F.coalesce(F.col("_tg.lemma"), t))
               .drop("_tg", "_tg_key", "_tg_words"))
