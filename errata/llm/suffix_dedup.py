"""Exact substring dedup by bucket-pointer refinement (operator 9).

A byte goes when it lies in a ``LENGTH``-byte string that also starts in a
document with a smaller id. Positions are put into buckets by the string that
starts there, first by few bytes, then ever finer, and only positions in
buckets that span documents go on:

1. Every ``LENGTH``-byte string contains one anchor: of the ``GRAM``-byte grams
   in it, the one with the least hash, leftmost if equal. Equal strings have
   equal anchors at equal places, so the anchors' grams are the initial
   buckets, though only one position in about fourteen is an anchor.
2. Grams found in one document only leave the sort. For the others the bucket
   is refined by what stands at the later (and earlier) offsets, up to the
   length asked for: each anchor's context, at most ``2 * LENGTH - GRAM`` bytes,
   holds all strings it is the anchor of. They are sorted by 128-bit
   identifiers, made of the buckets at their start and at later offsets.
3. The least document id of each final bucket decides. The verdicts, a bit per
   string, travel back in the order the strings were sent.

Documents are dealt by id into chunks of about ``CHUNK_BYTES``, kept as a table
bucketed by chunk: each round reads it in place and shuffles only the packed
buckets. Before a shuffle a chunk sends each gram and each context once, with
its least document id, so a passage held by a third of all documents costs one
entry per chunk. Whole-text copies within a chunk are one text.

Defined results: a null text has no bytes; a null ``doc_id`` counts as larger
than all others; rows of one id are one document as far as "smaller" goes, each
with its own result; an empty table gives an empty result; extra columns are
ignored. Texts of any length are worked in blocks of ``BLOCK`` bytes.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from errata.llm.common import read_table, written
from errata.session import scratch_path

LENGTH = 50
GRAM = 24
CHUNK_BYTES = 6 << 20
#: Chunks whose packed buckets one sorting task takes, about.
CHUNKS_PER_SORT = 2
BLOCK = 1 << 19
NO_ID = np.iinfo(np.int64).max
#: Bits of a gram's hash that are sent: a filter, so equal bits are enough.
SENT_BITS = 48


def _joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Identifiers of pairs of identifiers."""
    v = a * np.uint64(0xD6E8FEB86659FD93)
    v += b
    v ^= v >> np.uint64(29)
    v *= np.uint64(0xBF58476D1CE4E5B9)
    v ^= v >> np.uint64(32)
    return v


def _identifiers(x: np.ndarray, n: int, seed: int) -> np.ndarray:
    """64-bit identifiers of all ``n``-byte strings in the bytes ``x``.

    Buckets of 1, 2, 4, ... bytes are refined by those at the later offset;
    two overlapping ones make up the length asked for.
    """
    v = (x.astype(np.uint64) + np.uint64(seed)) * np.uint64(0x9E3779B97F4A7C15)
    size, width = max(0, len(x) - n + 1), 1
    while 2 * width <= n:
        v = _joined(v[:max(0, len(v) - width)], v[width:])
        width *= 2
    return _joined(v[:size], v[n - width:n - width + size]) if width < n else v


def _strings(gram: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two identifiers of the ``LENGTH``-byte strings at the places ``at``: the
    buckets of their first bytes, refined by those at the later offsets."""
    a, b, c = gram[at], gram[at + GRAM], gram[at + LENGTH - GRAM]
    return _joined(_joined(a, b), c), _joined(_joined(c, a), b)


def _pack(*arrays: np.ndarray) -> bytes:
    """Arrays as compressed byte planes, which sorted numbers shrink well in."""
    out = []
    for a in arrays:
        planes = np.ascontiguousarray(a.view(np.uint8).reshape(len(a), a.itemsize).T).tobytes()
        raw = zstandard.compress(planes, 1)
        out.append(len(raw).to_bytes(8, "little") + raw)
    return b"".join(out)


def _unpack(data: bytes, *kinds: str) -> list[np.ndarray]:
    out, at = [], 0
    for kind in kinds:
        size = int.from_bytes(data[at:at + 8], "little")
        raw = np.frombuffer(zstandard.decompress(data[at + 8:at + 8 + size]), dtype=np.uint8)
        at += 8 + size
        width = np.dtype(kind).itemsize
        out.append(np.ascontiguousarray(raw.reshape(width, -1).T).view(kind).reshape(-1))
    return out


class Chunk:
    """The distinct texts of one chunk, end to end, in the order of (id, text)."""

    def __init__(self, frame: pd.DataFrame):
        ids = [NO_ID if d is None or d != d else int(d) for d in frame["doc_id"].astype(object)]
        raw = [(t or "").encode() for t in frame["text"]]
        order = sorted(range(len(raw)), key=lambda i: (ids[i], raw[i]))
        self.rows = [(ids[i], raw[i]) for i in order]
        self.first: dict[bytes, int] = {}  # text -> number of its first holder
        for d, t in self.rows:
            if len(t) >= LENGTH and t not in self.first:
                self.first[t] = len(self.first)
        self.ids = np.full(len(self.first), NO_ID, dtype=np.int64)
        for d, t in reversed(self.rows):
            if t in self.first:
                self.ids[self.first[t]] = d
        self.bytes = np.frombuffer(b"".join(self.first), dtype=np.uint8)
        self.ends = np.cumsum([len(t) for t in self.first], dtype=np.int64)
        self._anchors()

    def _anchors(self) -> None:
        """For each run of strings with one anchor: start, count, document, gram,
        and identifiers of its first and its last string."""
        total, span = len(self.bytes), LENGTH - GRAM + 1
        low = np.uint64((1 << 21) - 1)
        whole = np.zeros(total + 1, dtype=np.int8)  # 1 where a string lies in one text
        begins = np.r_[0, self.ends[:-1]] if len(self.ends) else self.ends
        whole[begins] += 1
        whole[self.ends - LENGTH + 1] -= 1
        whole = np.cumsum(whole, dtype=np.int8).astype(bool)
        found: list[list[np.ndarray]] = []
        for at in range(0, max(0, total - LENGTH + 1), BLOCK):
            gram = _identifiers(self.bytes[at:at + BLOCK + LENGTH - 1], GRAM, 1)
            # Hash above, place below: the least is the leftmost of equal hashes.
            m = (gram & ~low) | np.arange(len(gram), dtype=np.uint64)
            width = 1
            while width < span:
                step = min(width, span - width)
                m = np.minimum(m[:len(m) - step], m[step:])
                width += step
            ok = np.flatnonzero(whole[at:at + len(m)])
            if not len(ok):
                continue
            p = (m[ok] & low).astype(np.int64)
            # Between texts, the strings that cross the border make a gap.
            new = np.flatnonzero(np.r_[True, (p[1:] != p[:-1]) | (ok[1:] != ok[:-1] + 1)])
            count = np.diff(np.r_[new, len(p)])
            first = ok[new]
            found.append([first + at, count, np.searchsorted(self.ends, first + at, side="right"),
                          # Least hashes are small ones: mixed again, they spread evenly over the sorts.
                          (gram[p[new]] * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - SENT_BITS),
                          _strings(gram, first)[0], _strings(gram, first + count - 1)[1]])
        none = [np.zeros(0, dtype=k) for k in "qqqQQQ"]
        self.start, self.count, self.doc, self.gram, self.head, self.tail = (
            np.concatenate(v) for v in (zip(*found) if found else ([x] for x in none)))

    def grams(self) -> tuple[np.ndarray, np.ndarray]:
        """Distinct grams in order, and whether several of the chunk's documents have them."""
        order = np.lexsort((self.ids[self.doc], self.gram)) if len(self.gram) else np.zeros(0, dtype=int)
        g, d = self.gram[order], self.ids[self.doc[order]]
        new = np.flatnonzero(np.r_[True, g[1:] != g[:-1]]) if len(g) else np.zeros(0, dtype=int)
        last = np.r_[new[1:], len(g)] - 1 if len(g) else new
        return g[new], d[new] != d[last]

    def contexts(self, live: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Runs whose gram is in ``live``: their numbers, the number of the first
        of equal contexts (least document id) for each, and those firsts in
        the order they are sent."""
        at = np.searchsorted(live, self.gram)
        runs = np.flatnonzero(live[np.minimum(at, len(live) - 1)] == self.gram) if len(live) else np.zeros(0, dtype=int)
        if not len(runs):
            return runs, runs, runs
        a, b = self.head[runs], self.tail[runs]
        order = np.lexsort((self.ids[self.doc[runs]], self.count[runs], b, a))
        same = (a[order][1:] == a[order][:-1]) & (b[order][1:] == b[order][:-1]) & \
            (self.count[runs[order]][1:] == self.count[runs[order]][:-1])
        group = np.cumsum(np.r_[True, ~same]) - 1
        firsts = runs[order[np.flatnonzero(np.r_[True, ~same])]]
        owner = np.empty(len(runs), dtype=np.int64)
        owner[order] = firsts[group]
        return runs, owner, firsts[np.lexsort((firsts, self.gram[firsts]))]

    def cut(self, gone: np.ndarray) -> list[tuple]:
        """Result rows, given the starts of strings that go (in any order)."""
        step = np.zeros(len(self.bytes) + 1, dtype=np.int32)
        np.add.at(step, gone, 1)
        np.add.at(step, gone + LENGTH, -1)
        off = np.cumsum(step[:-1]) > 0
        begins = np.r_[0, self.ends[:-1]] if len(self.ends) else self.ends
        done: dict[bytes, tuple] = {}
        for (t, k) in self.first.items():
            f = off[begins[k]:self.ends[k]]
            n = int(f.sum())
            spans = int(f[0]) + int((f[1:] & ~f[:-1]).sum())
            kept = self.bytes[begins[k]:self.ends[k]][~f].tobytes() if n else t
            done[t] = (len(t), n, spans, hashlib.sha256(kept).hexdigest())
        empty = hashlib.sha256(b"").hexdigest()
        out = []
        for d, t in self.rows:
            if t not in done:
                row = (len(t), 0, 0, hashlib.sha256(t).hexdigest())
            elif d > self.ids[self.first[t]]:
                row = (len(t), len(t), 1, empty)  # a copy of a smaller document's text
            else:
                row = done[t]
            out.append((None if d == NO_ID else d, *row))
        return out


def _dealt(gram: np.ndarray, sorts: int) -> np.ndarray:
    """First entry of each sorting task's range in ascending grams."""
    cuts = [(k << SENT_BITS) // sorts for k in range(sorts + 1)]
    return np.searchsorted(gram, np.array(cuts, dtype=np.uint64))


def _sent_grams(chunk: Chunk, number: int, sorts: int) -> Iterator[tuple]:
    g, many = chunk.grams()
    at = _dealt(g, sorts)
    for r in range(sorts):
        part = g[at[r]:at[r + 1]]
        if len(part):
            steps = np.diff(part, prepend=np.uint64(0))
            yield r, number, _pack(steps, many[at[r]:at[r + 1]].view(np.uint8))


def _live_grams(chunk: Chunk, verdicts: dict[int, bytes], sorts: int) -> np.ndarray:
    g, _ = chunk.grams()
    at = _dealt(g, sorts)
    live = np.zeros(len(g), dtype=bool)
    for r, data in verdicts.items():
        live[at[r]:at[r + 1]] = _unpack(data, "u1")[0].astype(bool)
    return g[live]


def _sent_contexts(chunk: Chunk, number: int, live: np.ndarray, sorts: int) -> Iterator[tuple]:
    _, _, firsts = chunk.contexts(live)
    at = _dealt(chunk.gram[firsts], sorts)
    for r in range(sorts):
        part = firsts[at[r]:at[r + 1]]
        if len(part):
            size = chunk.count[part] + LENGTH - 1
            place = np.repeat(chunk.start[part] - np.cumsum(size) + size, size) + np.arange(size.sum())
            yield r, number, _pack(chunk.ids[chunk.doc[part]], chunk.count[part].astype(np.uint8), chunk.bytes[place])


def _gone(chunk: Chunk, live: np.ndarray, verdicts: dict[int, bytes], sorts: int) -> np.ndarray:
    """Starts of the chunk's strings that go."""
    runs, owner, firsts = chunk.contexts(live)
    if not len(runs):
        return runs
    at = _dealt(chunk.gram[firsts], sorts)
    bits = np.zeros(len(firsts), dtype=np.uint32)
    for r, data in verdicts.items():
        bits[at[r]:at[r + 1]] = _unpack(data, "u4")[0]
    by_run = np.zeros(len(chunk.start), dtype=np.uint32)
    by_run[firsts] = bits
    own = by_run[owner]
    # A context that a smaller document of the same chunk has goes altogether.
    later = chunk.ids[chunk.doc[runs]] > chunk.ids[chunk.doc[owner]]
    own = np.where(later, np.uint32(0xFFFFFFFF), own)
    count = chunk.count[runs]
    k = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    goes = (np.repeat(own, count) >> k.astype(np.uint32)) & np.uint32(1)
    return (np.repeat(chunk.start[runs], count) + k)[goes.astype(bool)]


def _sort_grams(parts: list[bytes]) -> list[bytes]:
    """For each chunk's grams: which are found in several documents."""
    unpacked = [_unpack(p, "u8", "u1") for p in parts]
    grams = [np.cumsum(s, dtype=np.uint64) for s, _ in unpacked]
    every = np.concatenate(grams)
    order = np.argsort(every, kind="stable")
    s = every[order]
    new = np.r_[True, s[1:] != s[:-1]]
    group = np.cumsum(new) - 1
    count = np.bincount(group) + np.bincount(group, weights=np.concatenate([m for _, m in unpacked])[order]).astype(int)
    live = np.empty(len(every), dtype=np.uint8)
    live[order] = (count > 1)[group]
    return [_pack(v) for v in np.split(live, np.cumsum([len(g) for g in grams])[:-1])]


def _sort_contexts(parts: list[bytes]) -> list[bytes]:
    """For each chunk's contexts: a bit per string that starts in a smaller document."""
    unpacked = [_unpack(p, "i8", "u1", "u1") for p in parts]
    doc = np.concatenate([u[0] for u in unpacked])
    count = np.concatenate([u[1] for u in unpacked]).astype(np.int64)
    data = np.concatenate([u[2] for u in unpacked])
    sent = [len(u[0]) for u in unpacked]
    del unpacked
    size = count + LENGTH - 1
    inside = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    at = np.repeat(np.cumsum(size) - size, count) + inside
    one, two = np.empty(len(at), dtype=np.uint64), np.empty(len(at), dtype=np.uint64)
    for s in range(0, len(data), BLOCK):
        lo, hi = np.searchsorted(at, [s, s + BLOCK])
        one[lo:hi], two[lo:hi] = _strings(_identifiers(data[s:s + BLOCK + LENGTH - 1], GRAM, 1), at[lo:hi] - s)
    held = np.repeat(doc, count)
    order = np.argsort(one)
    same = one[order][1:] == one[order][:-1]
    if (same & (two[order][1:] != two[order][:-1])).any():  # a first identifier stands for two strings
        order = np.lexsort((two, one))
        same = (one[order][1:] == one[order][:-1]) & (two[order][1:] == two[order][:-1])
    new = np.r_[True, ~same]
    least = np.minimum.reduceat(held[order], np.flatnonzero(new))
    goes = np.empty(len(at), dtype=bool)
    goes[order] = held[order] > least[np.cumsum(new) - 1]
    bits = np.bitwise_or.reduceat(goes.astype(np.uint32) << inside.astype(np.uint32), np.cumsum(count) - count)
    return [_pack(v) for v in np.split(bits, np.cumsum(sent)[:-1])]


PACKED = "sort int, chunk int, data binary"


def _sorted(packed: DataFrame, sort, name: str) -> DataFrame:
    """The verdicts of each (sort, chunk): one sorting task per range of grams."""
    def each(f: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"sort": f["sort"], "chunk": f["chunk"], "data": sort(list(f["data"]))})
    return written(packed.groupBy("sort").applyInPandas(each, PACKED), name)


def _by_sort(f: pd.DataFrame) -> dict[int, bytes]:
    return dict(zip(f["sort"], f["data"]))


def chunked(docs: DataFrame, chunk_bytes: int) -> tuple[DataFrame, int]:
    """(chunk, doc_id, text) as a table bucketed by chunk, and the number of chunks."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    chunks = max(1, -(-size // chunk_bytes))
    key = F.coalesce(F.xxhash64("doc_id", F.lit(9)), F.lit(0))
    key = F.when(F.col("doc_id").isNull(), F.xxhash64("text")).otherwise(key)
    table = f"errata_suffix_{uuid.uuid4().hex[:12]}"
    (rows.withColumn("chunk", F.pmod(key, F.lit(chunks)).cast("int")).repartition(chunks, "chunk")
     .write.bucketBy(chunks, "chunk").option("path", scratch_path(spark, "suffix-chunks")).saveAsTable(table))
    return spark.table(table), chunks


def removed_repeats(docs: DataFrame, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of every row of ``docs``."""
    table, chunks = chunked(docs, chunk_bytes)
    sorts = max(1, chunks // CHUNKS_PER_SORT)

    def send_grams(key: tuple, f: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame(list(_sent_grams(Chunk(f), key[0], sorts)), columns=["sort", "chunk", "data"])

    def send_contexts(key: tuple, f: pd.DataFrame, grams: pd.DataFrame) -> pd.DataFrame:
        chunk = Chunk(f)
        live = _live_grams(chunk, _by_sort(grams), sorts)
        return pd.DataFrame(list(_sent_contexts(chunk, key[0], live, sorts)), columns=["sort", "chunk", "data"])

    def finish(key: tuple, f: pd.DataFrame, verdicts: pd.DataFrame) -> pd.DataFrame:
        chunk = Chunk(f)
        live = _live_grams(chunk, _by_sort(verdicts[verdicts["kind"] == 0]), sorts)
        gone = _gone(chunk, live, _by_sort(verdicts[verdicts["kind"] == 1]), sorts)
        out = pd.DataFrame(chunk.cut(gone), columns=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])
        return out.astype({"doc_id": "Int64"})

    grams = _sorted(table.groupBy("chunk").applyInPandas(send_grams, PACKED), _sort_grams, "suffix-grams")
    contexts = table.groupBy("chunk").cogroup(grams.groupBy("chunk")).applyInPandas(send_contexts, PACKED)
    contexts = _sorted(contexts, _sort_contexts, "suffix-contexts")
    verdicts = grams.withColumn("kind", F.lit(0)).union(contexts.withColumn("kind", F.lit(1)))
    return table.groupBy("chunk").cogroup(verdicts.groupBy("chunk")).applyInPandas(
        finish, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return removed_repeats(read_table(spark, sf_dir, "documents"))


ORACLE_SQL = f"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT doc_id, unnest(range(0, length(h) // 2 - {LENGTH - 1})) AS i, h FROM d WHERE length(h) >= {2 * LENGTH}),
k AS (SELECT doc_id, i, substr(h, 2 * i + 1, {2 * LENGTH}) AS s FROM w),
m AS (SELECT s, min(doc_id) AS f FROM k GROUP BY s HAVING min(doc_id) < max(doc_id)),
r AS (SELECT DISTINCT doc_id, i FROM k JOIN m USING (s) WHERE doc_id > f),
g AS (SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS g FROM
  (SELECT doc_id, i, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + {LENGTH} THEN 0 ELSE 1 END AS new FROM r)),
sp AS (SELECT doc_id, min(i) AS a, max(i) + {LENGTH} AS b FROM g GROUP BY doc_id, g.g),
gaps AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS pb FROM sp),
cut AS (SELECT doc_id, sum(b - a)::BIGINT AS n_removed, count(*) AS n_spans, max(b) AS e,
  string_agg(substr(h, 2 * pb + 1, 2 * (a - pb)), '' ORDER BY a) AS kept FROM gaps JOIN d USING (doc_id) GROUP BY doc_id)
SELECT d.doc_id, (length(h) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
  sha256(unhex(CASE WHEN e IS NULL THEN h ELSE kept || substr(h, 2 * e + 1) END)) AS kept_sha256
FROM d LEFT JOIN cut ON cut.doc_id = d.doc_id
"""
