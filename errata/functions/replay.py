"""Edits replayed in list order, over Arrow batches of whole rows.

Token positions only cross the boundary: a result refers to tokens by number,
and the strings are picked in the JVM. All rows of a batch are worked on
together, as flat arrays with the rows' offsets, so a row costs time in
proportion to its tokens and edits. Only rows whose edits overlap or go back
are replayed one edit at a time, in a piece table.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from errata.constants import STRATEGIES

#: Pieces of a block of the piece table before it is split.
BLOCK = 128


class PieceTable:
    """A sequence of numbers under edits, as pieces (first, length) in blocks.

    Fenwick sums of the blocks' lengths find a position in logarithmic time,
    so no edit copies the sequence.
    """

    def __init__(self, n: int):
        self.blocks: list[list[tuple[int, int]]] = [[(0, n)] if n else []]
        self.size = n
        self._sum()

    def _sum(self) -> None:
        m = len(self.blocks)
        self.tree = [0] * (m + 1)
        for i, block in enumerate(self.blocks, 1):
            self.tree[i] += sum(length for _, length in block)
            if i + (i & -i) <= m:
                self.tree[i + (i & -i)] += self.tree[i]

    def _grow(self, block: int, by: int) -> None:
        self.size += by
        i = block + 1
        while i < len(self.tree):
            self.tree[i] += by
            i += i & -i

    def _find(self, at: int) -> tuple[int, int]:
        """(block, place in it) of position ``at``, before it a boundary of pieces."""
        i, step, m = 0, 1 << (len(self.blocks)).bit_length(), len(self.blocks)
        while step:
            if i + step <= m and self.tree[i + step] < at:
                i += step
                at -= self.tree[i]
            step >>= 1
        i = min(i, m - 1)
        block = self.blocks[i]
        for j, (first, length) in enumerate(block):
            if at == 0:
                return i, j
            if at < length:
                block[j:j + 1] = [(first, at), (first + at, length - at)]
                return i, j + 1
            at -= length
        return i, len(block)

    def replace(self, a: int, b: int, first: int, length: int) -> list[tuple[int, int]]:
        """Put a piece in the place of positions a to b; returns the pieces that were there."""
        i, j = self._find(a)
        start, gone, left = (i, j), [], b - a
        while left:
            block = self.blocks[i]
            if j == len(block):
                i, j = i + 1, 0
                continue
            piece = block[j]
            if piece[1] > left:
                block[j] = (piece[0] + left, piece[1] - left)
                piece = (piece[0], left)
            else:
                del block[j]
            gone.append(piece)
            left -= piece[1]
            self._grow(i, -piece[1])
        if length:
            i, j = start
            self.blocks[i].insert(j, (first, length))
            self._grow(i, length)
            if len(self.blocks[i]) > BLOCK:
                half = len(self.blocks[i]) // 2
                self.blocks[i:i + 1] = [self.blocks[i][:half], self.blocks[i][half:]]
                self._sum()
        return gone

    def pieces(self) -> list[tuple[int, int]]:
        return [p for block in self.blocks for p in block]


def spread(firsts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The numbers of pieces (first, length), laid end to end."""
    before = np.cumsum(lengths) - lengths
    return np.repeat(firsts - before, lengths) + np.arange(lengths.sum())


def _laid(pieces: list[tuple[int, int]]) -> np.ndarray:
    p = np.array(pieces, dtype=np.int64).reshape(-1, 2)
    return spread(p[:, 0], p[:, 1])


def _slice_bounds(start: int, end: int, size: int) -> tuple[int, int]:
    """How a slice assignment clamps its bounds: negative ones count from the end."""
    a = min(max(start + size if start < 0 else start, 0), size)
    return a, max(min(max(end + size if end < 0 else end, 0), size), a)


def in_turn(n: int, starts: list[int], ends: list[int], sizes: list[int]) -> tuple[np.ndarray, list[np.ndarray]]:
    """(token numbers, numbers each edit replaced) of one row, one edit after the other."""
    table, off, base, gone = PieceTable(n), 0, n, []
    for s, e, size in zip(starts, ends, sizes):
        a, b = _slice_bounds(s + off, e + off, table.size)
        gone.append(_laid(table.replace(a, b, base, size)))
        off += size - (e - s)
        base += size
    return _laid(table.pieces()), gone


def replayed(n: np.ndarray, edges: np.ndarray, start: np.ndarray, end: np.ndarray, size: np.ndarray) -> tuple:
    """Every row's edits applied: (take, take_edges, at, gone, gone_edges).

    Row r has ``n[r]`` tokens and the edits ``edges[r]`` to ``edges[r + 1]``.
    ``take`` numbers the resulting tokens: below ``n[r]`` the row's own, from
    there on the corrections' tokens in list order. ``at`` is where each edit
    starts by the running offset, ``gone`` what it replaced.
    """
    rows, count = len(n), np.diff(edges)
    row = np.repeat(np.arange(rows), count)
    total = np.concatenate([[0], np.cumsum(size - (end - start))])
    at = start + total[:-1] - total[edges[:-1]][row]
    sums = np.concatenate([[0], np.cumsum(size)])
    base = n[row] + sums[:-1] - sums[edges[:-1]][row]
    # Apart: in order, within the row, none before the end of an earlier one. Edits that change nothing don't count.
    idle = (start == end) & (size == 0)
    reach = np.where(idle, 0, end) + row * (1 << 32)
    reach = np.maximum.accumulate(reach) - row * (1 << 32) if len(row) else reach
    first = np.zeros(len(row), dtype=bool)
    first[edges[:-1][count > 0]] = True
    prev = np.where(first, 0, np.concatenate([[0], reach[:-1]])) if len(row) else reach
    prev = np.maximum(prev, 0)
    bad = ~idle & ((start < prev) | (end < start) | (end > n[row]))
    mixed = np.zeros(rows, dtype=bool)
    mixed[row[bad]] = True
    # Two pieces for each edit, what lies before it and its own, and the row's rest.
    calm = ~mixed[row]
    lead = np.where(idle, prev, start)
    order = np.concatenate([2 * np.arange(len(row)), 2 * np.arange(len(row)) + 1, 2 * edges[1:] - 0.5])
    tail = np.zeros(rows, dtype=np.int64)
    tail[count > 0] = np.maximum(reach[edges[1:][count > 0] - 1], 0)
    firsts = np.concatenate([prev, base, tail])
    lengths = np.concatenate([np.where(calm, np.maximum(lead - prev, 0), 0), np.where(calm, size, 0), np.where(mixed, 0, n - tail)])
    owner = np.concatenate([row, row, np.arange(rows)])
    by = np.lexsort((order, owner))
    take = spread(firsts[by], lengths[by])
    take_count = np.bincount(owner, weights=lengths, minlength=rows).astype(np.int64)
    gone_count = np.where(calm, end - start, 0)
    gone_count = np.where(gone_count < 0, 0, gone_count)
    gone = spread(start, gone_count)
    if mixed.any():
        takes = np.split(take, np.cumsum(take_count)[:-1])
        parts = np.split(gone, np.cumsum(gone_count)[:-1]) if len(row) else []
        for r in np.nonzero(mixed)[0].tolist():
            a, b = edges[r], edges[r + 1]
            takes[r], parts[a:b] = in_turn(int(n[r]), start[a:b].tolist(), end[a:b].tolist(), size[a:b].tolist())
            take_count[r] = len(takes[r])
            gone_count[a:b] = [len(p) for p in parts[a:b]]
        take, gone = np.concatenate(takes), np.concatenate(parts)
    edge = lambda c: np.concatenate([[0], np.cumsum(c)])
    return take, edge(take_count), at, gone, edge(gone_count)


def _flat(listed: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    edges = listed.offsets.to_numpy().astype(np.int64)
    return edges - edges[0], listed.flatten().to_numpy(zero_copy_only=False).astype(np.int64)


def _lists(edges: np.ndarray, values: pa.Array) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(edges, pa.int32()), values)


def replay(n: str, start: str, end: str, size: str) -> Column:
    """Column: struct(take, at, gone) of a row's edits applied in list order (see ``replayed``).

    ``n`` counts the row's tokens; the arrays give each edit's token span and
    the number of tokens of its correction. Bounds are clamped as in a slice
    assignment.
    """
    @F.arrow_udf("take array<int>, at array<int>, gone array<array<int>>")
    def run(n: pa.Array, start: pa.Array, end: pa.Array, size: pa.Array) -> pa.Array:
        edges, s = _flat(start)
        take, take_edges, at, gone, gone_edges = replayed(n.to_numpy(zero_copy_only=False).astype(np.int64), edges, s, _flat(end)[1], _flat(size)[1])
        ints = lambda v: pa.array(v, pa.int32())
        return pa.StructArray.from_arrays([_lists(take_edges, ints(take)), _lists(edges, ints(at)),
                                           _lists(edges, _lists(gone_edges, ints(gone)))], names=["take", "at", "gone"])
    return run(F.expr(n), F.expr(start), F.expr(end), F.expr(size))


def covered(n: np.ndarray, edges: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """For each token of each row, whether a span [start, end) holds it.

    A difference array: one up at each start, one down at each end, summed once.
    """
    row = np.repeat(np.arange(len(n)), np.diff(edges))
    base = np.cumsum(n) - n
    a = np.clip(start, 0, n[row])
    b = np.maximum(np.clip(end, 0, n[row]), a)
    steps = np.zeros(int(n.sum()) + 1, dtype=np.int64)
    np.add.at(steps, base[row] + a, 1)
    np.add.at(steps, base[row] + b, -1)
    return np.cumsum(steps)[:-1] > 0


def coverage(n: str, start: str, end: str) -> Column:
    """Column: array<boolean> over a row's ``n`` tokens, true inside any of its spans."""
    @F.arrow_udf("array<boolean>")
    def run(n: pa.Array, start: pa.Array, end: pa.Array) -> pa.Array:
        sizes = n.to_numpy(zero_copy_only=False).astype(np.int64)
        edges, s = _flat(start)
        marks = covered(sizes, edges, s, _flat(end)[1])
        return _lists(np.concatenate([[0], np.cumsum(sizes)]), pa.array(marks))
    return run(F.expr(n), F.expr(start), F.expr(end))


def overlap_drops(edges: np.ndarray, start: np.ndarray, end: np.ndarray, loose: np.ndarray) -> np.ndarray:
    """A loose edit that starts before the end of the last kept one goes."""
    gone = np.zeros(len(start), dtype=bool)
    if not loose.any():
        return gone
    has = np.add.reduceat(np.concatenate([loose, [False]]).astype(int), edges[:-1]) * (np.diff(edges) > 0) > 0
    for r in np.nonzero(has)[0].tolist():
        a, b = int(edges[r]), int(edges[r + 1])
        last, out = 0, []
        for s, e, free in zip(start[a:b].tolist(), end[a:b].tolist(), loose[a:b].tolist()):
            drop = free and s < last
            out.append(drop)
            last = last if drop else e
        gone[a:b] = out
    return gone


def drop_overlaps(start: str, end: str, loose: str) -> Column:
    """Column: array<boolean>, which edits of a row go (see ``overlap_drops``)."""
    @F.arrow_udf("array<boolean>")
    def run(start: pa.Array, end: pa.Array, loose: pa.Array) -> pa.Array:
        edges, s = _flat(start)
        return _lists(edges, pa.array(overlap_drops(edges, s, _flat(end)[1], _flat(loose)[1].astype(bool))))
    return run(F.expr(start), F.expr(end), F.expr(loose))


def reached_before(end: str) -> Column:
    """Column: for each edit of a row, the largest end among the earlier ones (0 for the first)."""
    @F.arrow_udf("array<int>")
    def run(end: pa.Array) -> pa.Array:
        edges, e = _flat(end)
        if not len(e):
            return _lists(edges, pa.array(e, pa.int32()))
        row = np.repeat(np.arange(len(edges) - 1), np.diff(edges)) * (1 << 32)
        reach = np.maximum.accumulate(np.maximum(e, 0) + row) - row
        before = np.concatenate([[0], reach[:-1]])
        before[edges[:-1][np.diff(edges) > 0]] = 0
        return _lists(edges, pa.array(before, pa.int32()))
    return run(F.expr(end))


def runs(flat: np.ndarray, row: np.ndarray, k: np.ndarray) -> tuple:
    """(letters, {strategy: (first, last, columns)}): the runs of changes of each row.

    ``flat`` has the operations' letters, ordered by ``row`` and place ``k``.
    ``first`` and ``last`` bound each run within ``letters``, the changes alone;
    ``columns`` are its row, o_start, o_end, c_start and c_end.
    """
    new = np.diff(row, prepend=-1) != 0
    base = np.maximum.accumulate(np.where(new, np.arange(len(row)), 0))
    reach = {}
    for side, none in (("o", b"I"), ("c", b"D")):
        steps = (flat != ord(none)).astype(np.int64)
        total = np.cumsum(steps)
        before = total - steps
        reach[side] = before - before[base], total - before[base]
    turned = np.cumsum(new | (np.diff(flat.astype(np.int64), prepend=-1) != 0))
    live = flat != ord(b"M")
    r, found = row[live], {}
    for strategy, group in zip(STRATEGIES, (k, np.cumsum(~live), turned)):
        g = group[live]
        first = np.flatnonzero((np.diff(r, prepend=-1) != 0) | (np.diff(g, prepend=-1) != 0))
        last = np.append(first[1:], len(r)) - 1 if len(r) else first
        found[strategy] = first, last, [r[first], *(reach[s][j][live][(first, last)[j]] for s in "oc" for j in (0, 1))]
    return flat[live], found


RUN_T = "array<struct<strategy:string,o_start:bigint,o_end:bigint,c_start:bigint,c_end:bigint,ops:string>>"


def merged_runs(ops: str) -> Column:
    """Column: the runs of changes in a row's operations, an array of strings (see ``runs``).

    Several strings are one sequence: operations with one place follow each
    other, by their letters.
    """
    @F.arrow_udf(RUN_T)
    def run(ops: pa.Array) -> pa.Array:
        edges, copies = ops.offsets.to_numpy().astype(np.int64), [c.encode() for c in ops.flatten().to_pylist()]
        size = np.array([len(c) for c in copies], dtype=np.int64)
        flat = np.frombuffer(b"".join(copies), dtype=np.uint8)
        row = np.repeat(np.repeat(np.arange(len(ops)), np.diff(edges)), size)
        k = np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)
        if (np.diff(edges) > 1).any():
            by = np.lexsort((flat, k, row))
            flat, row, k = flat[by], row[by], k[by]
        letters, found = runs(flat, row, k)
        letters, columns, texts, names = pa.py_buffer(letters.tobytes()), [], [], []
        for strategy, (first, last, values) in found.items():
            ends = np.append(first, last[-1:] + 1).astype(np.int32) if len(first) else np.zeros(1, np.int32)
            texts.append(pa.StringArray.from_buffers(len(first), pa.py_buffer(ends.tobytes()), letters))
            names += [strategy] * len(first)
            columns.append(np.array(values, dtype=np.int64))
        row, *places = np.concatenate(columns, axis=1)
        by = np.argsort(row, kind="stable")
        fields = [pa.array(names, pa.string()).take(pa.array(by)), *[pa.array(p[by]) for p in places],
                  pa.concat_arrays(texts).take(pa.array(by))]
        made = pa.StructArray.from_arrays(fields, names=["strategy", "o_start", "o_end", "c_start", "c_end", "ops"])
        return _lists(np.concatenate([[0], np.cumsum(np.bincount(row, minlength=len(ops)))]), made)
    return run(F.expr(ops))
