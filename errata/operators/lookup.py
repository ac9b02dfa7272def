"""Joins against lexicons and other lookup tables.

A lookup side is written once and measured; up to a limit it is broadcast. A
broadcast passes through the driver, which holds its rows, a hash table of twice
to four times their size and the blocks made of that, so the limit is small. Beyond it the join is a shuffle join in which the most frequent
keys ("the", ",") are salted: their rows spread over many tasks, and only their
table rows are copied.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from errata.session import materialise

#: Measured bytes up to which a lookup table is broadcast
#: (``errata.broadcast.maxBytes``); beyond that, the keys that are salted and the
#: parts of each. A stream's frequent keys aren't known before it is read: there
#: every key has a few parts.
MAX_BROADCAST = 1 << 20
HOT_KEYS = 100
SALTS = 32
STREAM_SALTS = 4


def measured_bytes(table: DataFrame) -> int:
    """Bytes of the values of a written ``table``, with what a row costs in memory."""
    text = [F.coalesce(F.octet_length(c), F.lit(0)) for c, t in table.dtypes if t == "string"]
    row = sum(text, F.lit(40 + 16 * len(table.columns)))
    return table.agg(F.coalesce(F.sum(row.cast("long")), F.lit(0))).first()[0]


def fits(table: DataFrame) -> bool:
    """Whether a written table is small enough to be broadcast; counts it."""
    limit = table.sparkSession.conf.get("errata.broadcast.maxBytes", None)
    return measured_bytes(table) <= (int(limit) if limit else MAX_BROADCAST)


def frequent(df: DataFrame, keys: list[Column]) -> list[int]:
    """Hashes of the most frequent keys of ``df``, by a sketch of one pass. They
    only decide how rows are dealt to tasks, so an approximate answer will do."""
    top = df.agg(F.call_function("approx_top_k", F.xxhash64(*keys), F.lit(HOT_KEYS), F.lit(100 * HOT_KEYS))).first()[0]
    return [r["item"] for r in top or []]


def _salted(df: DataFrame, table: DataFrame, on: list[tuple[Column, str]]) -> tuple[DataFrame, DataFrame]:
    """``df`` with ``_ds`` and ``table`` with ``_ts``: parts of the keys that many rows share."""
    part = lambda n: F.pmod(F.xxhash64(*df.columns), F.lit(n)).cast("int")
    parts = lambda n: F.sequence(F.lit(0), F.lit(n - 1))
    if df.isStreaming:
        return df.withColumn("_ds", part(STREAM_SALTS)), table.withColumn("_ts", F.explode(parts(STREAM_SALTS)))
    hot = frequent(df, [e for e, _ in on])
    spread = F.when(F.xxhash64(*[e for e, _ in on]).isin(hot), part(SALTS)).otherwise(0)
    copies = F.when(F.xxhash64(*[table[k] for _, k in on]).isin(hot), parts(SALTS)).otherwise(F.array(F.lit(0)))
    return df.withColumn("_ds", spread), table.withColumn("_ts", F.explode(copies))


def lookup_join(df: DataFrame, table: DataFrame, on: list[tuple[Column, str]], small: bool | None = None,
                even: bool = False) -> DataFrame:
    """Left join of ``df`` to the written ``table`` on pairs (expression, key
    column). ``small``: whether it fits a broadcast, if that is known. ``even``:
    no key is in a large share of the rows, so none needs salts. Beyond the limit
    the join is asked for by name: Spark goes by the files' size, far less than
    what the driver would hold, and might still broadcast."""
    cond = [e == table[k] for e, k in on]
    if fits(table) if small is None else small:
        return df.join(F.broadcast(table), cond, "left")
    if even:
        return df.join(table.hint("merge"), cond, "left")
    spread, salted = _salted(df, table, on)
    cond = [e == salted[k] for e, k in on] + [F.col("_ds") == F.col("_ts")]
    return spread.join(salted.hint("merge"), cond, "left").drop("_ts", "_ds")


def two_step_lookup(df: DataFrame, table: DataFrame, first: list, second: list,
                    table_keys: list[str], values: list[str], prefix: str, even: bool = False) -> DataFrame:
    """Look up the written ``table`` on ``first`` key columns, else on ``second``.

    The second key is used only when the first finds **no row**; a found row
    with null values does not fall through. ``table`` must be unique on
    ``table_keys``.
    """
    t = table.select(*table_keys, *values, F.lit(True).alias("_hit"))
    out, found, small = df, {}, fits(t)
    for side, keys in (("a", first), ("b", second)):
        named = t.select(*[F.col(c).alias(f"{prefix}_{side}_{c}") for c in t.columns])
        out = lookup_join(out, named, [(e, f"{prefix}_{side}_{k}") for e, k in zip(keys, table_keys)], small, even)
        found[side] = named.columns
    hit = F.col(f"{prefix}_a__hit").isNotNull()
    for v in values:
        out = out.withColumn(f"{prefix}_{v}", F.when(hit, F.col(f"{prefix}_a_{v}"))
                             .otherwise(F.col(f"{prefix}_b_{v}")))
    return out.drop(*found["a"], *found["b"])


def unique_words(lexicon: DataFrame) -> DataFrame:
    """(word, pos, lemma), written: of several entries of a word the smallest (pos, lemma)."""
    one = lexicon.groupBy("word").agg(F.min(F.struct("pos", "lemma")).alias("_e"))
    return materialise(one.select("word", "_e.pos", "_e.lemma"), "lexicon")
