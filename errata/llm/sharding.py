"""Sharding by a permutation-filled lookup table (operator 4, native).

Each shard has a permutation of the slots of a prime-sized table (an offset and
a step from a hash of its name). Shards take turns; each claims the first slot
in its order that is still free, until all are taken. So slots are shared out
evenly (to one slot, times a shard's weight), and taking a shard away moves
little besides its own slots.

The table has ``TABLE_SIZE`` rows whatever the data's size, which bounds the
broadcast; a document's slot is a hash of its id, so placement is one lookup.
Documents are spread by id, never by source or length: a hot source or group of
copies is spread like any other rows.

Defined results: rows with a null id are placed by their text, and those with
neither go to the slot of the empty text; repeated rows go to one shard; an
empty table gives an empty result; extra columns are ignored by the query and
kept by ``place`` (the input row travels in a struct).
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from errata.llm.common import read_table, with_default

#: Prime, and over 100 times the number of shards: shares differ by under 1 %.
TABLE_SIZE = 4099
SHARDS = [f"shard-{k:02d}" for k in range(40)]
#: Hex digits of the md5 that make a slot's hash: 60 bits.
HEX = 15


def _hash(text: str) -> int:
    return int(hashlib.md5(text.encode()).hexdigest()[:HEX], 16)


def fill(shards: list[str], size: int = TABLE_SIZE, weights: list[int] | None = None) -> list[int]:
    """Slot -> number of the shard that claimed it.

    A shard of weight w claims w slots per turn. Work is bounded by the
    table: each shard walks its permutation once.
    """
    if size < 2 or any(size % d == 0 for d in range(2, int(size ** 0.5) + 1)):
        raise ValueError("the table's size must be a prime")
    if not shards or len(set(shards)) != len(shards):
        raise ValueError("shards need distinct names")
    weights = weights or [1] * len(shards)
    if len(weights) != len(shards) or min(weights) < 0 or max(weights) < 1:
        raise ValueError("each shard needs a weight, and one a positive one")
    at = [_hash(f"offset:{s}") % size for s in shards]
    step = [1 + _hash(f"step:{s}") % (size - 1) for s in shards]
    table = [-1] * size
    left = size
    while left:
        for k, turns in enumerate(weights):
            for _ in range(min(turns, left)):
                while table[at[k]] >= 0:
                    at[k] = (at[k] + step[k]) % size
                table[at[k]] = k
                left -= 1
    return table


def lookup(spark: SparkSession, shards: list[str], size: int = TABLE_SIZE,
           weights: list[int] | None = None) -> DataFrame:
    """(slot, shard): the filled table as ``size`` rows."""
    listed = ",".join(map(str, fill(shards, size, weights)))
    table = spark.range(1).select(F.posexplode(F.split(F.lit(listed), ",")).alias("slot", "k"))
    names = F.split(F.lit("\n".join(shards)), "\n")
    return table.select("slot", F.get(names, F.col("k").cast("int")).alias("shard"))


def slot_of(key: Column, size: int = TABLE_SIZE) -> Column:
    h = F.conv(F.substring(F.md5(key), 1, HEX), 16, 10).cast("long")
    return F.pmod(h, F.lit(size)).cast("int")


def place(docs: DataFrame, shards: list[str], size: int = TABLE_SIZE,
          weights: list[int] | None = None) -> DataFrame:
    """``row`` (the input row as a struct), ``slot`` and ``shard``."""
    full = with_default(with_default(docs, "doc_id", "long"), "text", "string")
    key = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("text:"), F.coalesce("text", F.lit(""))))
    keyed = full.select(F.struct(*docs.columns).alias("row"), slot_of(key, size).alias("at"))
    table = F.broadcast(lookup(docs.sparkSession, shards, size, weights))
    return keyed.join(table, F.col("at") == F.col("slot")).select("row", "slot", "shard")


def op4_shard_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    full = place(docs.withColumn("text", F.when(F.col("doc_id").isNull(), F.col("text"))), SHARDS)
    return full.select("row.doc_id", "slot", "shard")


_NAMES = ", ".join(f"'{s}'" for s in SHARDS)
ORACLE_SQL = f"""
WITH RECURSIVE s AS (SELECT k, n, ('0x' || substr(md5('offset:' || n), 1, {HEX}))::BIGINT % {TABLE_SIZE} AS a,
    1 + ('0x' || substr(md5('step:' || n), 1, {HEX}))::BIGINT % {TABLE_SIZE - 1} AS st
  FROM (SELECT unnest(range(0, {len(SHARDS)})) AS k, unnest([{_NAMES}]) AS n)),
orders AS (SELECT list([(a + j * st) % {TABLE_SIZE} FOR j IN range(0, {TABLE_SIZE})] ORDER BY k) AS o FROM s),
fill AS (SELECT 0 AS turn, [0 for x in range(0, {TABLE_SIZE})] AS taken, -1::BIGINT AS slot
  UNION ALL
  SELECT turn + 1, list_transform(taken, lambda x, i: CASE WHEN i = c + 1 THEN 1 ELSE x END), c FROM
    (SELECT turn, taken, list_filter(o[1 + turn % {len(SHARDS)}], lambda x: taken[x + 1] = 0)[1] AS c FROM fill, orders)
  WHERE turn < {TABLE_SIZE}),
look AS (SELECT slot, ([{_NAMES}])[1 + (turn - 1) % {len(SHARDS)}] AS shard FROM fill WHERE turn > 0)
SELECT doc_id, slot::INT AS slot, shard FROM
  (SELECT doc_id, ('0x' || substr(md5(coalesce(doc_id::VARCHAR, 'text:' || coalesce(text, ''))), 1, {HEX}))::BIGINT % {TABLE_SIZE} AS at FROM documents) d
  JOIN look ON d.at = look.slot
"""
