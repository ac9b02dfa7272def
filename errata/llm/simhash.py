r"""SimHash near-duplicates by deletion-variant signatures (operator 7).

A fingerprint has 64 bits. Cut into ``SEGMENTS`` = 2 halves, two fingerprints
that differ in at most 3 bits have a half that differs in at most one bit, and
then both halves agree once that bit is blanked out. So each distinct
fingerprint is indexed under 2 x 32 one-wildcard variants, equal keys meet in
an equality join, and every candidate is verified by its bit distance.

Copies share a fingerprint and are one node, so groups of copies of any size
cost one row; documents join back by fingerprint at the end.

Defined results: null and word-less texts have fingerprint zero and link like
any other; a null ``doc_id`` keeps its row and is never a component's id unless
no other is there; repeated rows each give a row; an empty table gives an empty
result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from errata.llm.common import read_table, with_default, written
from errata.llm.components import bucket_components, live_buckets

SEED = 42
SHINGLE = 3
MAX_BITS = 3
SEGMENTS = 2
#: Shingles whose bits are counted at a time: bounds memory for very long texts.
BLOCK = 1 << 16


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The fingerprint as an unsigned number; zero for a text without words."""
    # A-Z are the only letters bytes.lower() changes, and bytes.split() cuts
    # at exactly the white space 09-0D and 20.
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    n = max(1, len(words) - shingle + 1)
    stops = (ends[-n:] - 1).tolist()
    starts = [0, *ends[: n - 1].tolist()]
    digest = xxhash.xxh64_intdigest
    ones = np.zeros(64, dtype=np.int64)
    for k in range(0, n, BLOCK):
        h = [digest(joined[a:b], SEED) for a, b in zip(starts[k:k + BLOCK], stops[k:k + BLOCK])]
        bits = np.unpackbits(np.array(h, dtype=">u8").view(np.uint8).reshape(-1, 8), axis=1)
        ones += bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> Column:
    """Column: the fingerprint of ``text`` as a (signed) long."""
    @F.pandas_udf("long")
    def prints(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            values = np.array([fingerprint(t, shingle) for t in texts], dtype=np.uint64)
            yield pd.Series(values.view(np.int64))
    return prints(docs["text"])


def variants(prints: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """(key, id): every half of the fingerprint with one bit blanked out.

    A pair within ``max_bits`` has a half within ``max_bits // SEGMENTS`` bits,
    which one wildcard covers.
    """
    if max_bits // SEGMENTS > 1:
        raise ValueError("one wildcard a segment covers at most 3 differing bits")
    half = 64 // SEGMENTS
    key = (f"transform(sequence(0, {64 - 1}), i -> (i * {1 << half}L) | "
           f"(shiftrightunsigned(id, {half} * (i DIV {half})) & {(1 << half) - 1}L "
           f"& ~shiftleft(1L, i % {half})))")
    return prints.select(F.explode(F.expr(key)).alias("key"), "id")


def fingerprint_components(prints: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """(node, root) of distinct fingerprints ``prints(id)`` that have a neighbour."""
    def verify(pairs: DataFrame) -> DataFrame:
        return pairs.where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= max_bits)
    return bucket_components(live_buckets(variants(prints, max_bits)), verify, cheap=True)


def _rooted(prints: DataFrame, max_bits: int) -> DataFrame:
    """(fp, first, root) of every distinct fingerprint of ``prints(fp, at)``;
    ``first`` is the least ``at`` of its rows."""
    ids = written(prints.groupBy("fp").agg(F.min("at").alias("first")), "simhash-ids")
    roots = fingerprint_components(ids.select(F.col("fp").alias("id")), max_bits)
    return (ids.join(roots, ids["fp"] == roots["node"], "left")
            .select("fp", "first", F.coalesce("root", "fp").alias("root")))


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, max_bits: int = MAX_BITS) -> DataFrame:
    """(doc_id, fp, component_id) for each row; component_id is the smallest doc_id reachable."""
    prints = written(docs.select("doc_id", fingerprints(docs, shingle).alias("fp")), "simhash")
    rooted = _rooted(prints.withColumn("at", F.col("doc_id")), max_bits)
    named = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    table = written(rooted.join(named, "root").select("fp", "component_id"), "simhash-components")
    return prints.join(table, "fp")


def keep_first(docs: DataFrame, shingle: int = SHINGLE, max_bits: int = MAX_BITS) -> DataFrame:
    """One row of each component of ``docs``: the one with the smallest doc_id
    (null last), of repeated rows any one. All columns stay as they are."""
    have = docs.columns
    full = with_default(docs, "doc_id", "long")
    rows = full.select(F.struct(*full.columns).alias("row"), fingerprints(full, shingle).alias("fp"))
    rows = written(rows.withColumn("rid", F.monotonically_increasing_id()), "simhash-rows")
    at = F.struct(F.col("row.doc_id").isNull().alias("no_id"), F.col("row.doc_id").alias("doc_id"), "rid")
    rooted = _rooted(rows.select("fp", at.alias("at")), max_bits)
    stay = written(rooted.groupBy("root").agg(F.min("first").alias("first")).select("first.rid"), "simhash-stay")
    return rows.join(stay, "rid", "left_semi").select(*[F.col("row")[c].alias(c) for c in have])


def op7_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
