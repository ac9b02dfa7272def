r"""Phrase collocation mining by stripes (operator 11).

A phrase is 1 to ``MAX_WORDS`` words in a row within a piece of text; pieces
are what ``[.,;:!?\x0A-\x0D]`` separates, words what blanks and tabs separate.
Level k counts the phrases of k words in *stripes*: the first k - 1 words, the
prefix, key a counter of next words. A task counts a block of texts at a time
and sends one stripe for each prefix; stripes of a prefix merge element by
element. The stripe of a hot prefix (more than ``1 / HOT`` of all words; so
there are fewer than ``HOT`` of each length) is cut into segments by a hash of
the next word, and so is that of the empty prefix. From a merged stripe come

* its extensions: the phrases of k words found often enough, with their counts;
* its total, next words missing included: the count of the prefix;
* its largest element: whether some longer phrase subsumes the prefix.

A prefix is counted only if it was itself frequent one level before. Tasks know
that from a table of hash bits (a Bloom filter with one hash), made of as many
bits as the frequent phrases need, of at most ``MAX_BITS`` = 128 MB: a false
positive costs work and is dropped when counts are known, and nothing is lost.

A phrase is subsumed only by phrases exactly as frequent, and then also by one
of them with a single word more, before or after it: all in between are as
frequent. So the largest element of its stripe, and the counts of the
extensions that end in it, decide.

Defined results: null texts are empty; a null ``lang`` is ``und``; repeated
rows count each; an empty table gives no rows; extra columns are ignored.
Letters other than A-Z keep their case. Scores are computed with 38 digits.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from errata.llm.common import read_table, with_default, written

MAX_WORDS = 5
LEAST = 100
TOP = 2000
UNKNOWN = "und"
#: Words counted together in a task before stripes are sent.
BLOCK = 1 << 22
#: Segments of the empty prefix's stripe, which holds all words, and of a hot prefix's; what makes a prefix hot.
FIRST_SEGMENTS, SEGMENTS, HOT = 1024, 64, 4096
#: Bits for each frequent phrase, and bits in all as powers of two, at least and at most.
BITS_EACH, MIN_BITS, MAX_BITS = 16, 20, 30
#: Rows of one output batch.
ROWS = 1 << 14
#: Parts of a language in the first of the two steps that rank its phrases.
PARTS = 64

# Upper case to lower case; every separator of pieces to a full stop.
_LETTERS = bytes(range(65, 91)), bytes(range(97, 123))
_PIECE = bytes.maketrans(_LETTERS[0] + b",;:!?\n\x0b\x0c\r", _LETTERS[1] + b"." * 9)
_STEP = np.uint64(0x9E3779B97F4A7C15)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * _STEP
    return h ^ (h >> np.uint64(29))


def word_hash(word: bytes) -> int:
    return xxhash.xxh64_intdigest(word)


def phrase_hashes(langs: list[str], phrases: list[str]) -> np.ndarray:
    hashes = []
    for lang, phrase in zip(langs, phrases):
        h = word_hash(lang.encode())
        for w in phrase.encode().split(b" "):
            h = (h * int(_STEP) + word_hash(w)) & 0xFFFFFFFFFFFFFFFF
        hashes.append(h)
    return np.array(hashes, dtype=np.uint64)


def phrase_positions(langs: list[str], phrases: list[str], bits: int) -> np.ndarray:
    """The bit of each phrase."""
    return (_mixed(phrase_hashes(langs, phrases)) & np.uint64((1 << bits) - 1)).astype(np.int64)


class Bits:
    """Which phrases may be frequent, and the hashes of those that are hot."""

    def __init__(self, data: np.ndarray, bits: int, hot: np.ndarray):
        self.data, self.mask, self.hot = data, np.uint64((1 << bits) - 1), hot

    def __call__(self, hashes: np.ndarray) -> np.ndarray:
        at = _mixed(hashes) & self.mask
        return (self.data[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8) & 1).astype(bool)


class Words(dict):
    """Numbers of one language's words in a block; -1 ends a piece."""

    def __init__(self, lang: str):
        super().__init__({b".": -1})
        self.names: list[bytes] = []
        self.hashes: list[int] = []
        self.seed = np.uint64(word_hash(lang.encode()))
        self.chunks: list[np.ndarray] = []

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self.names)
        self.names.append(word)
        self.hashes.append(word_hash(word))
        return n

    def add(self, text: bytes) -> int:
        words = text.translate(_PIECE).replace(b".", b" . ").split()
        words.append(b".")
        self.chunks.append(np.fromiter(map(self.__getitem__, words), dtype=np.int64, count=len(words)))
        return len(words)


def stripes(words: Words, k: int, frequent: Bits | None) -> Iterator[tuple]:
    """(prefixes, segments, next words, counts) of one language's block, as Arrow arrays.

    The next words of a stripe are joined by blanks. One is empty where a
    prefix is followed by the end of its piece, or by a word with which it is
    not counted.
    """
    t = np.concatenate([*words.chunks, np.full(k, -1)])
    hashes = np.array(words.hashes, dtype=np.uint64)
    if not len(hashes):
        return
    here = len(t) - k
    known = t >= 0
    prefix = np.ones(len(t), dtype=bool)  # a counted prefix starts here
    if k > 1:
        h = np.full(len(t), words.seed)
        for j in range(k - 1):
            after = np.roll(t, -j)
            prefix &= after >= 0
            h = h * _STEP + hashes[after]
        at = np.nonzero(prefix)[0]
        prefix[at] = frequent(h[at])
    extended = known[k - 1:k - 1 + here].copy()
    if k > 1:
        extended &= prefix[1:here + 1]
    at = np.nonzero(prefix[:here] & (extended if k == 1 else True))[0]
    if not len(at):
        return
    count = len(words.names)
    key = t[at] if k > 1 else np.zeros(len(at), dtype=np.int64)
    for j in range(1, k - 1):
        key = np.unique(key * count + t[at + j], return_inverse=True)[1]
    after = np.where(extended[at], t[at + k - 1], -1)
    segments = SEGMENTS if k > 1 else FIRST_SEGMENTS
    cut = np.isin(h[at], frequent.hot) if k > 1 else np.ones(len(at), dtype=bool)
    segment = np.where(cut & (after >= 0), hashes[after] % np.uint64(segments), 0).astype(np.int64)
    key = (key * segments + segment) * (count + 1) + after + 1
    if k > 2:
        key, first, times = np.unique(key, return_index=True, return_counts=True)
    else:  # the key tells the prefix
        key, times = np.unique(key, return_counts=True)
    row, after = key // (count + 1), key % (count + 1) - 1
    starts = np.nonzero(np.concatenate([[True], row[1:] != row[:-1]]))[0]
    names = pa.array([*words.names, b""], pa.binary()).cast(pa.string())  # number -1 is empty
    after = np.where(after < 0, count, after)
    if k == 1:
        prefixes = names.take(pa.array(np.full(len(starts), count)))
    elif k == 2:
        prefixes = names.take(pa.array(row[starts] // segments))
    else:
        heads = at[first[starts]]
        prefixes = pc.binary_join_element_wise(*[names.take(pa.array(t[heads + j])) for j in range(k - 1)], " ")
    ends = np.append(starts[1:], len(key))
    for a in range(0, len(starts), ROWS):
        b = min(a + ROWS, len(starts))
        lo, hi = starts[a], ends[b - 1]
        offsets = pa.array(np.append(starts[a:b], hi) - lo, pa.int32())
        next_words = pa.ListArray.from_arrays(offsets, names.take(pa.array(after[lo:hi])))
        yield (prefixes.slice(a, b - a), pa.array(row[starts[a:b]] % segments, pa.int32()), pc.binary_join(next_words, " "),
               pa.ListArray.from_arrays(offsets, pa.array(times[lo:hi], pa.int32())))


def block_stripes(docs: DataFrame, k: int, frequent=None) -> DataFrame:
    """(lang, prefix, seg, next, n): stripes of blocks of texts; ``frequent`` is a broadcast (bytes, bits, hot hashes)."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Bits(np.frombuffer(frequent.value[0], dtype=np.uint8), *frequent.value[1:]) if frequent else None
        block: dict[str, Words] = {}
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            for lang, words in block.items():
                for part in stripes(words, k, known):
                    langs = pa.array([lang] * len(part[0]), pa.string())
                    yield pa.RecordBatch.from_arrays([langs, *part], names=["lang", "prefix", "seg", "next", "n"])
            block.clear()

        for batch in batches:
            langs = batch.column(0).to_pylist()
            texts = batch.column(1).cast(pa.binary())
            for lang, text in zip(langs, texts):
                words = block.get(lang)
                if words is None:
                    words = block[lang] = Words(lang)
                size += words.add(text.as_py())
                if size >= BLOCK:
                    yield from flush()
                    size = 0
        yield from flush()

    return docs.mapInArrow(count, "lang string, prefix string, seg int, next string, n array<int>")


def merged_stripes(parts: DataFrame, least: int) -> DataFrame:
    """(lang, prefix, seg, total, best, stripe): the stripes of each key added up.

    ``stripe`` keeps the elements of ``least`` or more, ``total`` and ``best``
    cover all. One shuffle, of whole stripes by key; taking them apart and
    adding up stays within the partitions that it makes.
    """
    key = ["lang", "prefix", "seg"]
    dealt = parts.repartition(*key)
    pairs = F.arrays_zip(F.split("next", " ", -1).alias("next"), F.col("n"))
    each = dealt.select(*key, F.inline(pairs)).groupBy(*key, "next").agg(F.sum("n").alias("n"))
    real = F.col("next") != ""
    often = real & (F.col("n") >= least)
    return each.groupBy(*key).agg(F.sum("n").alias("total"), F.max(F.when(real, F.col("n"))).alias("best"),
                                  F.collect_list(F.when(often, F.struct("next", "n"))).alias("stripe"))


def extensions(level: DataFrame, k: int) -> DataFrame:
    """(lang, phrase, f): the frequent phrases of a level."""
    each = level.select("lang", "prefix", F.inline("stripe"))
    phrase = F.col("next") if k == 1 else F.concat_ws(" ", "prefix", "next")
    return each.select("lang", phrase.alias("phrase"), F.col("n").alias("f"))


def frequent_bits(phrases: DataFrame, words: int):
    """The bit table of ``phrases(lang, phrase, f)``, and the hot ones' hashes, broadcast to the tasks.

    It is put together from chunks of 128 KB, each made by one task, so at
    most ``2 ** MAX_BITS`` bits reach the driver, and fewer than ``HOT`` phrases
    of each length.
    """
    count = phrases.count()
    often = phrases.where(F.col("f") * HOT > words).collect()
    hot = phrase_hashes([r.lang for r in often], [r.phrase for r in often])
    bits = min(MAX_BITS, max(MIN_BITS, int(np.ceil(np.log2(max(1, BITS_EACH * count))))))

    def positions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = phrase_positions(batch.column(0).to_pylist(), batch.column(1).to_pylist(), bits)
            at = np.unique(at)
            yield pa.RecordBatch.from_arrays([pa.array(at >> MIN_BITS, pa.int32()), pa.array(at & ((1 << MIN_BITS) - 1), pa.int32())],
                                             names=["chunk", "place"])

    def packed(frame):
        data = np.zeros(1 << MIN_BITS, dtype=bool)
        data[frame["place"].to_numpy()] = True
        return frame.head(1).assign(data=np.packbits(data, bitorder="little").tobytes())[["chunk", "data"]]

    places = phrases.select("lang", "phrase").mapInArrow(positions, "chunk int, place int").distinct()
    table = np.zeros(1 << (bits - 3), dtype=np.uint8)
    each = 1 << (MIN_BITS - 3)
    for r in places.groupBy("chunk").applyInPandas(packed, "chunk int, data binary").collect():
        table[r.chunk * each:(r.chunk + 1) * each] = np.frombuffer(r.data, dtype=np.uint8)
    return phrases.sparkSession.sparkContext.broadcast((table.tobytes(), bits, hot))


def phrase_levels(docs: DataFrame, least: int = LEAST, max_words: int = MAX_WORDS) -> list[DataFrame]:
    """The merged stripes of each level, written, up to the first level without a frequent phrase."""
    texts = with_default(with_default(docs, "lang", "string"), "text", "string").select(
        F.coalesce("lang", F.lit(UNKNOWN)).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    levels: list[DataFrame] = []
    known, frequent, words = None, None, 0
    for k in range(1, max_words + 1):
        level = written(merged_stripes(block_stripes(texts, k, frequent), least), f"stripes-{k}")
        if frequent:
            frequent.destroy()
        levels.append(level)
        found = extensions(level, k)
        known = found if known is None else known.union(found)
        if k == max_words or found.isEmpty():
            break
        words = words or level.agg(F.sum("total")).first()[0]
        frequent = frequent_bits(known, words)
    return levels


def candidates(levels: list[DataFrame]) -> DataFrame:
    """(lang, phrase, a) of the frequent phrases of two words or more that nothing subsumes."""
    out = []
    for k in range(2, len(levels) + 1):
        here = extensions(levels[k - 1], k).select("lang", "phrase", F.col("f").alias("a"))
        if k < len(levels):
            after = levels[k].select("lang", F.col("prefix").alias("phrase"), F.col("best").alias("f"))
            longer = extensions(levels[k], k + 1)
            before = longer.select("lang", F.expr("substring(phrase, instr(phrase, ' ') + 1)").alias("phrase"), "f")
            most = after.union(before).groupBy("lang", "phrase").agg(F.max("f").alias("most"))
            here = here.join(most, ["lang", "phrase"], "left").where("most IS NULL OR 100 * most < 100 * a").drop("most")
        out.append(here)
    return reduce(DataFrame.union, out)


def scored(levels: list[DataFrame]) -> DataFrame:
    """(lang, phrase, a, l, r, n, score): each candidate with its lowest-scoring cut.

    Counts of first parts are stripe totals, counts of the rest extensions.
    """
    sizes = levels[0].groupBy("lang").agg(F.sum("total").alias("n"))
    totals = reduce(DataFrame.union, [v.groupBy("lang", "prefix").agg(F.sum("total").alias("l")) for v in levels[1:]])
    counts = reduce(DataFrame.union, [extensions(v, k + 1) for k, v in enumerate(levels)])
    cuts = candidates(levels).withColumn("k", F.explode(F.expr("sequence(1, size(split(phrase, ' ')) - 1)")))
    cuts = (cuts.withColumn("prefix", F.expr("substring_index(phrase, ' ', k)"))
            .withColumn("rest", F.expr("substring(phrase, length(prefix) + 2)")))
    cuts = (cuts.join(totals, ["lang", "prefix"])
            .join(counts.select("lang", F.col("phrase").alias("rest"), F.col("f").alias("r")), ["lang", "rest"])
            .join(sizes, "lang"))
    wide = lambda c: f"CAST({c} AS DECIMAL(38,0))"
    score = F.expr(f"({wide('1000 * CAST(a AS DECIMAL(20,0))')} * {wide('n')}) DIV ({wide('l')} * {wide('r')})")
    best = cuts.withColumn("score", score).groupBy("lang", "phrase").agg(
        F.min(F.struct("score", "k", "l", "r", "n", "a")).alias("c"))
    return best.select("lang", "phrase", "c.a", "c.l", "c.r", "c.n", "c.score")


def collocations(docs: DataFrame, least: int = LEAST, max_words: int = MAX_WORDS, top: int = TOP) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the ``top`` phrases of each language.

    Ranked in parts of each language first, so that no task gets more than the
    best of ``PARTS`` parts.
    """
    levels = phrase_levels(docs, least, max_words)
    if len(levels) < 2:
        return docs.sparkSession.createDataFrame([], "lang string, rank int, phrase string, a long, l long, r long, n long, score long")
    order = [F.desc("score"), F.desc("a"), "phrase"]
    part = F.pmod(F.xxhash64("phrase"), F.lit(PARTS))
    found = scored(levels).withColumn("rank", F.row_number().over(W.partitionBy("lang", part).orderBy(*order))).where(F.col("rank") <= top)
    found = found.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)
    return found.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op11_phrase_collocation(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = collocations(read_table(spark, sf_dir, "documents").select("lang", "text"))
    return found.withColumn("rank", F.col("rank").cast("long"))


_GRAMS = " UNION ALL ".join(
    f"SELECT lang, {k} AS k, array_to_string(w[i:i + {k - 1}], ' ') AS p FROM (SELECT lang, w, unnest(generate_series(1, len(w) - {k - 1})) AS i FROM w)"
    for k in range(1, MAX_WORDS + 1))
ORACLE_SQL = rf"""
WITH t AS (SELECT coalesce(lang, '{UNKNOWN}') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
s AS (SELECT lang, unnest(string_split_regex(t, '[.,;:!?\x0A-\x0D]')) AS s FROM t),
w AS (SELECT lang, w FROM (SELECT lang, list_filter(string_split_regex(s, '[\x20\x09]+'), lambda x: x <> '') AS w FROM s) WHERE len(w) > 0),
f AS (SELECT lang, k, p, count(*) AS f FROM ({_GRAMS}) GROUP BY ALL HAVING count(*) >= {LEAST}),
n AS (SELECT lang, sum(len(w))::HUGEINT AS n FROM w GROUP BY lang),
c AS (SELECT lang, k, p, f AS a FROM f WHERE k > 1),
gone AS (SELECT DISTINCT c.lang, c.p FROM c JOIN c AS d ON c.lang = d.lang AND d.k > c.k AND d.a >= c.a AND contains(' ' || d.p || ' ', ' ' || c.p || ' ')),
cut AS (SELECT lang, k, p, a, string_split(p, ' ') AS ws, unnest(generate_series(1, k - 1)) AS j FROM c ANTI JOIN gone USING (lang, p)),
sc AS (SELECT cut.lang, cut.p, a, j, x.f AS l, y.f AS r, n, ((1000::HUGEINT * a * n) // (x.f::HUGEINT * y.f)) AS score
  FROM cut JOIN f x ON x.lang = cut.lang AND x.p = array_to_string(ws[1:j], ' ') JOIN f y ON y.lang = cut.lang AND y.p = array_to_string(ws[j + 1:], ' ')
  JOIN n ON n.lang = cut.lang),
b AS (SELECT * FROM sc QUALIFY row_number() OVER (PARTITION BY lang, p ORDER BY score, j) = 1)
SELECT lang, rank, p AS phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score FROM
  (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, p) AS rank FROM b) WHERE rank <= {TOP}
"""
