"""Lookups by word in texts that stay whole.

Texts are dealt to chunks of some size by a hash. The distinct words of a chunk,
a fraction of its words, are looked up as rows; the chunk's texts then meet the
chunk's own dictionary in one task, over Arrow. So no place of a word becomes a
row that is shuffled or sorted, and no table is held whole anywhere.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from errata.constants import FIELD_SEP
from errata.functions import words as wd
from errata.session import materialise

#: Code points of the texts of one chunk, about: what a task holds at once.
CHUNK = 4_000_000

#: Rows of one batch that goes back to Spark.
ROWS_OUT = 50_000

Split = Callable[[pa.Array], tuple[np.ndarray, pa.Array]]


def chunk_count(texts: DataFrame, size: Column) -> int:
    """Chunks for the given texts; reads their sizes, in code points."""
    return max(1, math.ceil((texts.agg(F.sum(size.cast("long"))).first()[0] or 0) / CHUNK))


def chunk_of(key: str | Column, n: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(n)).cast("int")


def by_chunk(rows: DataFrame, key: str, n: int) -> DataFrame:
    """``rows`` dealt by ``_chunk``, which follows from ``key``."""
    return rows.withColumn("_chunk", chunk_of(key, n)).repartition("_chunk")


def chunk_words(chunked: DataFrame, text: str, split: Split, word: str = "word") -> DataFrame:
    """(_chunk, ``word``): the distinct words of each chunk's texts.

    All columns of ``chunked`` are read, so that a plan which needs them again
    shares the shuffle.
    """
    at, chunk_at = chunked.columns.index(text), chunked.columns.index("_chunk")

    def distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            counts, words = split(b.column(at))
            coded = words.dictionary_encode()
            width = max(1, len(coded.dictionary))
            chunk = np.repeat(b.column(chunk_at).to_numpy().astype(np.int64), counts)
            pairs = np.unique(chunk * width + coded.indices.to_numpy())
            yield pa.RecordBatch.from_arrays([pa.array(pairs // width, pa.int32()), coded.dictionary.take(pa.array(pairs % width))],
                                             names=["_chunk", word])

    return chunked.mapInArrow(distinct, f"_chunk int, {word} string").distinct()


def with_side(chunked: DataFrame, side: DataFrame, work: Callable[[pa.Table, pa.Table], pa.Table], schema: str) -> DataFrame:
    """``work`` over each chunk's rows and its rows of ``side``."""
    return chunked.groupBy("_chunk").cogroup(side.groupBy("_chunk")).applyInArrow(work, schema)


def listed(lists: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """(items of each list, the items laid end to end)."""
    return pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64), pc.list_flatten(lists)


def token_pieces(texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Tokens of joined sequences."""
    return wd.split(texts, FIELD_SEP)


def labelled_tokens(token_seqs: pa.Array, label_seqs: pa.Array) -> tuple[pa.Array, pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """Every labelled token of joined sequences: itself, its label, its sequence's
    number and its place there; and how many tokens each sequence has. Sequences
    stop at the shorter of the two."""
    counts, tokens = token_pieces(token_seqs)
    labelled, labels = token_pieces(label_seqs)
    n = np.minimum(counts, labelled)
    feature, row = wd.places(n), np.repeat(np.arange(len(n)), n)
    at = lambda c: pa.array(feature + (np.cumsum(c) - c)[row])
    return tokens.take(at(counts)), labels.take(at(labelled)), row, feature, counts


def in_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of each chunk as a table, from batches sorted by their column ``_chunk``."""
    held, now = [], None
    for b in batches:
        chunk = b.column("_chunk").to_numpy()
        edges = [0, *(np.flatnonzero(np.diff(chunk)) + 1).tolist(), len(chunk)]
        for start, end in zip(edges, edges[1:]):
            if start == end:
                continue
            if held and chunk[start] != now:
                yield pa.Table.from_batches(held)
                held = []
            now = chunk[start]
            held.append(b.slice(start, end - start))
    if held:
        yield pa.Table.from_batches(held)


def by_range(rows: DataFrame, key: str, n: int) -> DataFrame:
    """``rows`` written by ranges of ``key``, numbered in ``_chunk``; equal keys are in one chunk."""
    return materialise(rows.repartitionByRange(n, key).withColumn("_chunk", F.spark_partition_id()), "ranges")


def rows_with_words(seqs: DataFrame, look_up: Callable[[DataFrame], DataFrame], ordered: bool = False) -> DataFrame:
    """E11 + A7 with what ``look_up`` adds to the distinct tokens (_chunk, token).

    The rows of ``features.token_rows`` and the added columns. ``seqs`` is written:
    it is read several times. ``ordered`` (O2): the rows come in the order of
    (row_i, feature_i). For that sequences are dealt to chunks by ranges of row_i,
    and chunks go through their tasks in turn: sequences are sorted, not tokens.
    """
    seqs = seqs.select("row_i", "seq_id", "cefr", "token_seq", "label_seq")
    n = chunk_count(seqs, F.length("token_seq"))
    chunked = by_range(seqs, "row_i", n) if ordered else by_chunk(seqs, "seq_id", n)
    words = look_up(chunk_words(chunked, "token_seq", token_pieces, "token"))
    words = words.select("_chunk", "token", *[c for c in words.columns if c not in ("_chunk", "token")])
    added = words.columns[2:]

    def place(rows: pa.Table, table: pa.Table) -> pa.Table:
        token, label, row, feature, counts = labelled_tokens(wd.one(rows["token_seq"]), wd.one(rows["label_seq"]))
        if ordered:
            # Sequences that share a number give their tokens in turn.
            number = pc.rank(rows["row_i"], null_placement="at_start", tiebreaker="dense").to_numpy()
            if len(np.unique(number)) < len(number):
                order = np.lexsort((feature, number[row]))
                token, label, row, feature = token.take(pa.array(order)), label.take(pa.array(order)), row[order], feature[order]
        found = pc.index_in(token, value_set=wd.one(table["token"]))
        cols = [wd.one(rows[c]).take(pa.array(row)) for c in ("row_i", "seq_id", "cefr")]
        cols += [pa.array(counts[row], pa.int32()), pa.array(feature, pa.int32()), token, label]
        out = pa.Table.from_arrays(cols + [wd.one(table[c]).take(found) for c in added], names=names)
        return pa.Table.from_batches(out.to_batches(max_chunksize=ROWS_OUT), out.schema)

    names = ["row_i", "seq_id", "cefr", "sequence_length", "feature_i", "token", "label", *added]
    kinds = dict(seqs.dtypes) | dict(words.dtypes) | {"sequence_length": "int", "feature_i": "int", "label": "string"}
    schema = ", ".join(f"{c} {kinds[c]}" for c in names)
    if not ordered:
        return with_side(chunked, words, place, schema)

    def place_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in in_chunks(batches):
            is_word = t["_word"]
            yield from place(t.filter(pc.invert(is_word)), t.filter(is_word)).to_batches()

    both = chunked.withColumn("_word", F.lit(False)).unionByName(
        materialise(words, "chunk-dictionary").withColumn("_word", F.lit(True)), allowMissingColumns=True)
    both = both.repartitionByRange("_chunk").sortWithinPartitions("_chunk", "_word", "row_i")
    return both.mapInArrow(place_all, schema)
