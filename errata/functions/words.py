"""Words of whole texts over Arrow batches, as flat arrays with their texts' numbers.

What was a row for every word (splitting, offsets, spans, labels) is worked out
for all words of a batch together; strings are cut and joined by Arrow.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def one(column: pa.Array | pa.ChunkedArray) -> pa.Array:
    """The column in one piece."""
    if not isinstance(column, pa.ChunkedArray):
        return column
    made = column.combine_chunks()
    return made if not isinstance(made, pa.ChunkedArray) else pa.concat_arrays(made.chunks)


def split(texts: pa.Array, sep: str) -> tuple[np.ndarray, pa.Array]:
    """(pieces of each text, the pieces laid end to end); a null text has none."""
    lists = pc.split_pattern(texts, sep)
    return pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64), pc.list_flatten(lists)


def split_words(texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """(words of each text, the words): what stands between blanks and line feeds, empty words included."""
    return split(pc.replace_substring(texts, "\n", " "), " ")


def join(counts: np.ndarray, pieces: pa.Array, sep: str) -> pa.Array:
    """The inverse of ``split``."""
    edges = np.concatenate([[0], np.cumsum(counts)])
    return pc.binary_join(pa.LargeListArray.from_arrays(pa.array(edges, pa.int64()), pieces), sep)


def places(counts: np.ndarray) -> np.ndarray:
    """0, 1, ... within each of the rows that have ``counts``."""
    return np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)


def word_starts(row: np.ndarray, place: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Where each word starts in its row: the lengths up to its place, each with the
    blank after it, less its own. A row of several texts counts the words of all."""
    if not len(row):
        return np.zeros(0, dtype=np.int64)
    ahead = (row[1:] > row[:-1]) | ((row[1:] == row[:-1]) & (place[1:] > place[:-1]))
    order = np.arange(len(row)) if ahead.all() else np.lexsort((place, row))
    r, p, size = row[order], place[order], length[order].astype(np.int64) + 1
    sums = np.cumsum(size)
    # Words of one place count each other.
    last = np.append((r[1:] != r[:-1]) | (p[1:] != p[:-1]), True)
    upto = sums[np.flatnonzero(last)][np.cumsum(last) - last]
    first = np.concatenate([[True], r[1:] != r[:-1]])
    before = (sums - size)[np.flatnonzero(first)][np.cumsum(first) - 1]
    out = np.empty(len(row), dtype=np.int64)
    out[order] = upto - before - size
    return out


def overlapped(row: np.ndarray, start: np.ndarray, end: np.ndarray, span_row: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    """Whether each token [start, end) overlaps any span [s, e) with s < e of its row.

    Spans are sorted by their starts; the largest end among those that start
    before the token's end lies past its start.
    """
    top = int(end.max(initial=0)) + 2
    real = s < e
    span_row, s, e = span_row[real], np.clip(s[real], -1, top - 1), np.clip(e[real], -1, top - 1)
    if not len(s) or not len(row):
        return np.zeros(len(row), dtype=bool)
    order = np.lexsort((s, span_row))
    span_row, s, e = span_row[order].astype(np.int64), s[order], e[order]
    width = top + 2
    reach = np.maximum.accumulate(span_row * width + e + 1)
    n = np.searchsorted(span_row * width + s + 1, row.astype(np.int64) * width + end + 1, side="left")
    # A reach that an earlier row left behind lies below this row's.
    return (n > 0) & (reach[np.maximum(n - 1, 0)] > row.astype(np.int64) * width + start + 1)
