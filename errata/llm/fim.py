r"""Fill-in-middle transformation by wavelet-matrix cuts (operator 13).

Every text is cut into units (lines by default) at two places that its id
picks, and its middle part is moved to the end, behind sentinels, in one of two
orders (psm, spm), or the text stays as it is (plain).

Units end after the characters of some classes (``UNITS``). A wavelet matrix
over the character classes of a block of texts answers how many characters of
a class stand before any place; ranks of a unit's classes add up to its
boundary count, and bisection on that count finds a cut. One matrix serves all
texts of a block (``BLOCK`` code points, or one longer text), and all their
cuts are searched together.

Defined results: a null text is empty, and an empty text is plain with n = 0; a
null ``doc_id`` is hashed as the empty word; repeated rows each give a row; an
empty table gives none; extra columns stay in ``row`` and never clash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from errata.llm.common import read_table, with_default

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SEED = 7
#: Texts out of a hundred that are transformed, and those of them in suffix-first order.
RATE = 100
SPM_RATE = 50
#: Code points that share one wavelet matrix.
BLOCK = 1 << 21

OTHER, NEWLINE, BLANK, STOP = range(4)
CLASS_BITS = 2
#: unit -> classes of the characters that end it.
UNITS = {"line": (NEWLINE,), "word": (NEWLINE, BLANK), "sentence": (NEWLINE, STOP)}
_CLASS = np.zeros(128, dtype=np.uint8)
for _chars, _kind in (("\n", NEWLINE), (" \t", BLANK), (".!?", STOP)):
    _CLASS[[ord(c) for c in _chars]] = _kind


class BitPlane:
    """Bits with the number of ones before any place."""

    def __init__(self, bits: np.ndarray):
        packed = np.packbits(bits, bitorder="little")
        self.words = np.zeros(len(bits) // 64 + 1, dtype=np.uint64)
        self.words.view(np.uint8)[:len(packed)] = packed
        self.before = np.zeros(len(self.words) + 1, dtype=np.int64)
        np.cumsum(np.bitwise_count(self.words), out=self.before[1:])

    def ones(self, at: np.ndarray) -> np.ndarray:
        word = at >> 6
        low = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[word] + np.bitwise_count(self.words[word] & low)


class WaveletMatrix:
    """Ranks over a sequence of small numbers: one bit plane per binary digit,
    each level sorted stably by the digits above it."""

    def __init__(self, symbols: np.ndarray, bits: int):
        self.levels: list[tuple[int, BitPlane, int]] = []
        for digit in range(bits - 1, -1, -1):
            ones = (symbols >> digit & 1).astype(bool)
            self.levels.append((digit, BitPlane(ones), int(len(ones) - ones.sum())))
            symbols = np.concatenate([symbols[~ones], symbols[ones]])

    def rank(self, symbol: int, at: np.ndarray) -> np.ndarray:
        """How many of ``symbol`` stand before each place of ``at``."""
        lo, hi = np.zeros(1, dtype=np.int64), at
        for digit, plane, zeros in self.levels:
            if symbol >> digit & 1:
                lo, hi = zeros + plane.ones(lo), zeros + plane.ones(hi)
            else:
                lo, hi = lo - plane.ones(lo), hi - plane.ones(hi)
        return hi - lo


class UnitIndex:
    """Units of the texts that lie end to end in ``codes``, from ``starts`` to ``ends``."""

    def __init__(self, codes: np.ndarray, starts: np.ndarray, ends: np.ndarray, unit: str = "line"):
        classes = _CLASS[np.minimum(codes, 127)]
        self.matrix = WaveletMatrix(classes, CLASS_BITS)
        self.ending, self.starts, self.ends = UNITS[unit], starts, ends
        self.first = self.boundaries(starts)
        self.closed = self.boundaries(ends) - self.first
        last = self.boundaries(np.maximum(ends - 1, starts)) - self.first
        # What follows the last boundary, if anything, is a unit too.
        self.counts = self.closed + ((ends > starts) & (last == self.closed))

    def boundaries(self, at: np.ndarray) -> np.ndarray:
        return sum(self.matrix.rank(c, at) for c in self.ending)

    def after(self, units: np.ndarray) -> np.ndarray:
        """Places, within each text, after its first ``units`` units."""
        lo, hi = self.starts.copy(), self.ends.copy()
        while (lo < hi).any():  # the least place with that many boundaries before it
            mid = (lo + hi) >> 1
            enough = self.boundaries(mid) - self.first >= units
            hi = np.where(enough, mid, hi)
            lo = np.where(enough | (lo >= hi), lo, mid + 1)
        at = np.where(units > self.closed, self.ends, lo)
        return at - self.starts


def draws(doc_id: object, seed: int = SEED) -> tuple[int, ...]:
    """The four numbers that decide a document's cuts and form."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return tuple(int(digest[k:k + 8], 16) for k in (0, 8, 16, 24))


def _blocks(texts: list[str]) -> Iterator[tuple[int, int]]:
    at = size = 0
    for k, t in enumerate(texts):
        if k > at and size + len(t) > BLOCK:
            yield at, k
            at, size = k, 0
        size += len(t)
    if at < len(texts):
        yield at, len(texts)


def transform(ids: list, texts: list[str], unit: str = "line", seed: int = SEED, rate: int = RATE,
              spm_rate: int = SPM_RATE) -> Iterator[tuple]:
    """(n, form, prefix_chars, middle_chars, output) of each text."""
    for a, b in _blocks(texts):
        part = texts[a:b]
        sizes = np.array([len(t) for t in part], dtype=np.int64)
        ends = np.cumsum(sizes)
        codes = np.frombuffer("".join(part).encode("utf-32-le"), dtype=np.uint32)
        index = UnitIndex(codes, ends - sizes, ends, unit)
        h = np.array([draws(i, seed) for i in ids[a:b]], dtype=np.int64).reshape(-1, 4)
        one, two = h[:, 0] % (index.counts + 1), h[:, 1] % (index.counts + 1)
        left, right = index.after(np.minimum(one, two)), index.after(np.maximum(one, two))
        for t, n, (_, _, h3, h4), p, q in zip(part, index.counts.tolist(), h.tolist(), left.tolist(), right.tolist()):
            if not t or h3 % 100 >= rate or any(s in t for s in (PREFIX, SUFFIX, MIDDLE)):
                yield n, "plain", None, None, t
                continue
            before, middle, after = t[:p], t[p:q], t[q:]
            if h4 % 100 < spm_rate:
                yield n, "spm", p, q - p, f"{SUFFIX}{after}{PREFIX}{before}{MIDDLE}{middle}"
            else:
                yield n, "psm", p, q - p, f"{PREFIX}{before}{SUFFIX}{after}{MIDDLE}{middle}"


def fill_in_middle(docs: DataFrame, unit: str = "line", seed: int = SEED, rate: int = RATE,
                   spm_rate: int = SPM_RATE) -> DataFrame:
    """``row`` (the columns of ``docs`` as a struct), n, form, prefix_chars, middle_chars, output."""
    full = with_default(with_default(docs, "doc_id", "long"), "text", "string")

    @F.pandas_udf("n long, form string, prefix_chars long, middle_chars long, output string")
    def cut(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for ids, texts in batches:
            rows = list(transform(ids.tolist(), [t or "" for t in texts], unit, seed, rate, spm_rate))
            out = pd.DataFrame(rows, columns=["n", "form", "prefix_chars", "middle_chars", "output"])
            yield out.astype({"prefix_chars": "Int64", "middle_chars": "Int64"})

    # The id as text: pandas would turn whole numbers beside nulls into floats.
    found = full.select(F.struct(*full.columns).alias("row"), cut(F.col("doc_id").cast("string"), "text").alias("f"))
    return found.select("row", "f.*")


def restored(output: str = "output", form: str = "form") -> Column:
    """The text that an output was made from; null for a null output.

    A sentinel cannot overlap another one or itself, and no transformed text
    holds one, so an output splits at exactly its own three.
    """
    parts = F.split(F.col(output), f"{PREFIX}|{SUFFIX}|{MIDDLE}", -1)
    return (F.when(F.col(form) == "psm", F.concat(F.get(parts, F.lit(1)), F.get(parts, F.lit(3)), F.get(parts, F.lit(2))))
            .when(F.col(form) == "spm", F.concat(F.get(parts, F.lit(2)), F.get(parts, F.lit(3)), F.get(parts, F.lit(1))))
            .otherwise(F.col(output)))


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = fill_in_middle(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("row.doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"),
                        F.sha2(restored(), 256).alias("restored_sha256"))


ORACLE_SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('{SEED}:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
u AS (SELECT *, regexp_extract_all(t, '[^\\n]*\\n|[^\\n]+') AS l,
  [('0x' || h[1:8])::BIGINT, ('0x' || h[9:16])::BIGINT, ('0x' || h[17:24])::BIGINT, ('0x' || h[25:32])::BIGINT] AS r FROM d),
c AS (SELECT *, len(l) AS n, least(r[1] % (len(l) + 1), r[2] % (len(l) + 1)) AS a,
  greatest(r[1] % (len(l) + 1), r[2] % (len(l) + 1)) AS b FROM u),
p AS (SELECT *, array_to_string(l[1:a], '') AS pre, array_to_string(l[a + 1:b], '') AS mid, array_to_string(l[b + 1:], '') AS suf,
  CASE WHEN t = '' OR contains(t, '{PREFIX}') OR contains(t, '{SUFFIX}') OR contains(t, '{MIDDLE}') OR r[3] % 100 >= {RATE} THEN 'plain'
       WHEN r[4] % 100 < {SPM_RATE} THEN 'spm' ELSE 'psm' END AS form FROM c)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(pre)::BIGINT END AS prefix_chars,
  CASE WHEN form <> 'plain' THEN length(mid)::BIGINT END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '{PREFIX}' || pre || '{SUFFIX}' || suf || '{MIDDLE}' || mid
         ELSE '{SUFFIX}' || suf || '{PREFIX}' || pre || '{MIDDLE}' || mid END) AS output_sha256,
  sha256(t) AS restored_sha256 FROM p
"""
