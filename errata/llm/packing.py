"""Best-fit packing of token sequences by swap-based local search (operator 3).

Every document becomes its token ids plus an end id. One longer than the
capacity is cut into full pieces and a rest; full pieces are sequences of their
own. All other pieces are dealt by hash into groups of about ``GROUP_PIECES``.
Within a group, best-fit decreasing gives a first packing; local search then
exchanges pieces one-for-one, two-for-one or moves them between any two underfull
bins. Every step increases the sum of squared fills, so it ends, and bins that
run empty are gone. The pieces of bins that stay underfull are dealt anew, level
by level, until one group holds them all; so a group is bounded while the
packing is global. Two kinds of bins stay out of further levels: pieces over
half the capacity beyond the smallest ones that all smaller pieces could join
(no packing needs them as hosts), and the fuller bins of a level that leaves
more than half of its pieces underfull.

Defined results: a null text is the empty text and gives the end id alone;
repeated rows and equal ids are packed separately; an empty table gives an
empty result; extra columns are ignored. Ties go to the smaller piece number.
"""

from __future__ import annotations

import heapq
import itertools
import json
import re
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from errata.llm.common import read_table, written

CAPACITY = 4096
END_ID = 1
TOKENIZER = "word_bpe_49k.json"
GROUP_PIECES = 40_000
#: Bins at least this full are not packed again at the next level.
FULL_ENOUGH = 0.98
#: More than any rest of a bin.
NEVER = 1 << 40
#: Pieces kept in a worker's memo, and the longest piece it keeps.
MEMO_PIECES = 600_000
MEMO_CHARS = 64


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


def _byte_letters() -> dict[int, str]:
    """How byte-level vocabularies write each byte: printable ones as they are, the rest from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {**{b: chr(b) for b in plain}, **{b: chr(256 + k) for k, b in enumerate(rest)}}


class Encoder:
    """Token ids as little-endian 32-bit bytes, with a bounded memo of pieces.

    The vocabulary's normalizer and pre-tokenizer are spelled out here for the
    characters of Latin-1, on which they only lower letters and cut the text
    into runs; each run is then encoded by the library's model, once. Texts
    with any other character go through the library whole, as do all texts if
    the vocabulary file has other rules.
    """

    # Fixed value: the pre-tokenizer's pattern in the vocabulary file.
    PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
    LETTERS = "a-z\xaa\xb5\xba\xdf-\xf6\xf8-\xff"
    NUMBERS = "0-9\xb2\xb3\xb9\xbc-\xbe"
    OTHER = re.compile("[^\t\n\x0b\x0c\r -~\xa1-\xac\xae-\xff]|<[|]")

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        self.tok = Tokenizer.from_file(path)
        self.model = self.tok.model
        self.memo: dict[str, bytes] = {}
        rules = json.loads(self.tok.to_str())
        kinds = [n.get("type") for n in (rules.get("normalizer") or {}).get("normalizers", [])]
        steps = (rules.get("pre_tokenizer") or {}).get("pretokenizers", [{}])
        self.known = kinds == ["NFC", "Replace", "Lowercase"] and len(steps) == 2 and \
            steps[0].get("pattern") == {"Regex": self.PATTERN} and steps[1].get("type") == "ByteLevel"
        self.cut = re.compile(self.PATTERN.replace(r"\p{L}", self.LETTERS).replace(r"\p{N}", self.NUMBERS)).findall
        self.letters = str.maketrans({chr(b): c for b, c in _byte_letters().items()})

    def _run(self, piece: str) -> bytes:
        """Ids of one run; the memo keeps what came first, which holds the frequent runs."""
        found = self.model.tokenize(piece.encode().decode("latin-1").translate(self.letters))
        ids = np.array([t.id for t in found], dtype="<u4").tobytes()
        if len(self.memo) < MEMO_PIECES and len(piece) <= MEMO_CHARS:
            self.memo[piece] = ids
        return ids

    def __call__(self, text: str) -> bytes:
        if not self.known or self.OTHER.search(text):
            return np.array(self.tok.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()
        pieces = self.cut(text.lower())
        parts = list(map(self.memo.get, pieces))
        if None in parts:
            parts = [self.memo.get(w) or self._run(w) if p is None else p for w, p in zip(pieces, parts)]
        return b"".join(parts)


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """This worker's encoder of ``path``."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def pieces(docs: DataFrame, capacity: int = CAPACITY, end_id: int = END_ID,
           path: str | None = None, with_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]) of every row of ``docs``."""
    where = path or tokenizer_path()
    end = np.array([end_id], dtype="<u4").tobytes()
    names = ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids

    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = encoder(where)
        for f in frames:
            rows = []
            for doc_id, text in zip(f["doc_id"], f["text"]):
                ids = encode(text or "") + end
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at:at + 4 * capacity]
                    row = (doc_id, k, at // 4, len(part) // 4, zlib.crc32(part))
                    rows.append((*row, np.frombuffer(part, "<u4").astype("<i4")) if with_ids else row)
            yield pd.DataFrame(rows, columns=names).astype({"doc_id": "Int64"})

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(cut, schema)


def best_fit(lengths: list[int], capacity: int) -> list[list[int]]:
    """Best-fit decreasing: bins of item numbers; ties to the earlier item."""
    room: dict[int, list[list[int]]] = defaultdict(list)
    open_rooms = 0  # bit r is set while a bin has exactly r left
    bins: list[list[int]] = []
    for k in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        s = lengths[k]
        fits = open_rooms >> s
        if fits:
            r = s + (fits & -fits).bit_length() - 1
            b = room[r].pop()
            if not room[r]:
                open_rooms &= ~(1 << r)
        else:
            r, b = capacity, []
            bins.append(b)
        b.append(k)
        if r > s:
            room[r - s].append(b)
            open_rooms |= 1 << (r - s)
    return bins


class _Givers:
    """The pieces and pairs of pieces of underfull bins, by size.

    ``least[n][g]`` is the least rest a bin has without some ``n`` pieces of
    ``g`` tokens. Bins' entries stand in heaps and are dropped when outdated.
    """

    def __init__(self, bins: list[list[int]], size: list[int], capacity: int):
        self.bins, self.size, self.version = bins, size, [0] * len(bins)
        self.heaps = {n: defaultdict(list) for n in (1, 2)}
        self.least = {n: np.full(capacity + 1, NEVER) for n in (1, 2)}

    def parts(self, b: int, n: int) -> dict[int, tuple[int, ...]]:
        """Sizes of ``n`` pieces of the bin, each with the pieces."""
        return {sum(self.size[i] for i in p): p for p in itertools.combinations(self.bins[b], n)}

    def _top(self, n: int, g: int) -> None:
        heap = self.heaps[n][g]
        while heap and heap[0][2] != self.version[heap[0][1]]:
            heapq.heappop(heap)
        self.least[n][g] = heap[0][0] if heap else NEVER

    def add(self, b: int, fill: int) -> None:
        for n in (1, 2):
            for g in self.parts(b, n):
                heapq.heappush(self.heaps[n][g], (fill - g, b, self.version[b]))
                self._top(n, g)

    def remove(self, b: int) -> None:
        self.version[b] += 1
        for n in (1, 2):
            for g in self.parts(b, n):
                self._top(n, g)

    def find(self, taker: int, fill: int, room: int):
        """The exchange that fills ``taker`` most: (tokens won, giver, pieces in, pieces out).

        Moves, one-for-one, two-for-one and one-for-two. The sum of squared
        fills rises if the giver's rest is less than the taker's.
        """
        best = None
        asked = [(0, ()), *self.parts(taker, 1).items(), *self.parts(taker, 2).items()]
        for t, take in asked:
            for n in (1, 2) if len(take) == 1 else (1,):
                low = t + (best[0] if best else 0) + 1
                hits = np.flatnonzero(self.least[n][low:t + room + 1] < fill - t)
                if len(hits):
                    g = low + int(hits[-1])
                    best = (g - t, n, g, take)
        if best:
            won, n, g, take = best
            giver = self.heaps[n][g][0][1]
            return won, giver, self.parts(giver, n)[g], take
        return None


def local_search(bins: list[list[int]], size: list[int], capacity: int) -> list[list[int]]:
    """Swap-based local search among all underfull bins.

    Each bin in turn, the fullest first, looks for the exchange with any other
    that fills it most. Ends when no exchange between any two bins raises the
    sum of squared fills, or when no packing has fewer bins: one for every
    piece over half the capacity, and as many as the tokens need.
    """
    fill = [sum(size[i] for i in b) for b in bins]
    fewest = max(-(-sum(fill) // capacity), sum(2 * s > capacity for s in size))
    count = len(bins)
    under = [k for k in range(len(bins)) if fill[k] < capacity]
    givers, moved = _Givers(bins, size, capacity), count > fewest
    for k in under if moved else ():
        givers.add(k, fill[k])
    while moved:
        moved = False
        under = sorted((k for k in under if bins[k] and fill[k] < capacity), key=lambda k: (-fill[k], k))
        for a in under:
            if not bins[a]:
                continue
            givers.remove(a)
            while fill[a] < capacity and (found := givers.find(a, fill[a], capacity - fill[a])):
                won, d, give, take = found
                givers.remove(d)
                bins[a] = [i for i in bins[a] if i not in take] + list(give)
                bins[d] = [i for i in bins[d] if i not in give] + list(take)
                fill[a] += won
                fill[d] -= won
                count -= not bins[d]
                moved = True
                if count == fewest:
                    return [b for b in bins if b]
                givers.add(d, fill[d])
            if fill[a] < capacity:
                givers.add(a, fill[a])
    return [b for b in bins if b]


def pack(lengths: list[int], capacity: int = CAPACITY) -> list[list[int]]:
    """Bins of item numbers: best-fit decreasing, then local search."""
    return local_search(best_fit(lengths, capacity), lengths, capacity)


def _least(rows: DataFrame, value: str, by: str, want: int, level: int) -> Column:
    """Whether a row is among the about ``want`` rows of least ``value``; of equal ones, by a hash of ``by`` and ``level``."""
    seen = 0
    for r in rows.groupBy(value).count().orderBy(value).collect():  # at most one row a fill or length
        if seen + r["count"] > want:
            share = (want - seen) * 1000 // r["count"]
            return (F.col(value) < r[value]) | ((F.col(value) == r[value]) & (F.pmod(F.xxhash64(by, F.lit(value), F.lit(level)), F.lit(1000)) < share))
        seen += r["count"]
    return F.lit(True)


def _without_lone(rest: DataFrame, capacity: int, level: int) -> tuple[DataFrame, DataFrame | None, int]:
    """``rest`` less the large pieces that need no company, those, placed, and about how many stay.

    A bin holds at most one piece over half the capacity. If company for some
    is all there is, the smallest ones can have it: at most one for each
    smaller piece.
    """
    large = 2 * F.col("length") > capacity
    n = rest.agg(F.count(F.when(large, 1)).alias("large"), F.count(F.when(~large, 1)).alias("small")).first()
    want = n.small + n.small // 10 + 1000
    if n.large <= want:
        return rest, None, n.large + n.small
    stay = ~large | _least(rest.where(large), "length", "pid", want, level)
    alone = rest.where(~stay).select("pid", F.col("pid").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return rest.where(stay), alone, want + n.small


def assign(items: DataFrame, capacity: int = CAPACITY, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """(pid, sequence_id, offset) for ``items(pid, length)`` with distinct pid."""
    def packed(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values("pid")
        pid, length = f["pid"].tolist(), f["length"].tolist()
        rows = []
        for b in pack(length, capacity):
            fill = sum(length[i] for i in b)
            at = 0
            for i in b:
                rows.append((pid[i], length[i], pid[min(b)], at, fill))
                at += length[i]
        return pd.DataFrame(rows, columns=["pid", "length", "sequence_id", "offset", "fill"])

    schema = "pid long, length long, sequence_id long, offset long, fill long"
    full = items.where(F.col("length") >= capacity)
    done = full.select("pid", F.col("pid").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    rest = items.where(F.col("length") < capacity)
    for level in itertools.count():
        rest, alone, count = _without_lone(rest, capacity, level)
        done = done.union(alone) if alone is not None else done
        groups = max(1, -(-count // group_pieces))
        dealt = rest.withColumn("g", F.expr(f"pmod(xxhash64(pid, {level}), {groups})"))
        placed = written(dealt.groupBy("g").applyInPandas(lambda f: packed(f), schema), "packing")
        if groups == 1:
            return done.union(placed.select("pid", "sequence_id", "offset"))
        again = F.col("fill") < FULL_ENOUGH * capacity
        again &= _least(placed.where(again), "fill", "sequence_id", count // 2, level)
        done = done.union(placed.where(~again).select("pid", "sequence_id", "offset"))
        rest = placed.where(again).select("pid", "length")


def packed_documents(docs: DataFrame, capacity: int = CAPACITY, end_id: int = END_ID,
                     path: str | None = None, with_ids: bool = False) -> DataFrame:
    """Every piece with its place: ``sequence_id`` and ``offset`` beside what ``pieces`` gives."""
    cut = pieces(docs, capacity, end_id, path, with_ids).withColumn("pid", F.monotonically_increasing_id())
    cut = written(cut, "pieces")
    return cut.join(assign(cut.select("pid", "length"), capacity), "pid").drop("pid")


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed_documents(read_table(spark, sf_dir, "documents"))
