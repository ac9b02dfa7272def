r"""Quality rules with adaptive thresholds (operator 5, native).

Base counts come from the words ``[^\x20\x09-\x0D]+`` of the whole text. Two
rules are fixed: a text of fewer than ``MIN_WORDS`` words, or one where more
than half of the words lie in repeated 3-word windows, fails. All other cutoffs
adapt: every (lang, source) group has a quantile sketch per feature, and a
text is rejected when a feature lies far above an upper quantile of its group,
measured by the distance between two of the group's quantiles. A group's sketch
is blended with the sketch of all documents, which counts as ``PRIOR`` documents:
a small group goes by the whole corpus, and the larger it is the less it does.

The sketch is a log-linear histogram: whole numbers below ``2**(SKETCH_BITS+1)``
have a bucket each, larger ones keep their ``SKETCH_BITS + 1`` leading bits, so
a quantile is at most ``2**-SKETCH_BITS`` (relative) too low. Sketches merge by
adding counts: partial counts are summed before and after the shuffle, and a
hot source costs each task no more than its few hundred buckets.

Defined results: a null text has no words; null ``lang`` or ``source`` is a
group of its own; repeated rows are each judged (and counted); an empty table
gives an empty result. Input columns travel in one struct, so extra columns
never clash with the computed ones.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from errata.functions.letbind import let
from errata.llm.common import SPACE, read_table, with_default, written

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
SKETCH_BITS = 5
#: Documents that the sketch of all documents counts for in each group's.
PRIOR = 50
#: Copies of a group's thresholds, over which a hot group's documents spread
#: when the table is too large to broadcast.
SALTS = 16
#: feature -> (expression, upper and lower quantile, spreads allowed beyond
#: them, least spread, low side too). Features are whole numbers per 10,000, so
#: that no result depends on rounding. A spread is the distance of the two
#: quantiles. Quartiles stay put until a quarter of a group is junk; repetition
#: is usual in some good texts, and its limits go by the hundredth beyond which it is rare.
RULES = {
    "symbols": ("10000 * n_symbols DIV n_words", 75, 25, 4, 10, False),
    "dup_lines": ("10000 * n_dup_lines DIV n_lines", 99, 50, 2, 250, False),
    "repeats": ("10000 * n_repeat_words DIV n_words", 99, 50, 2, 100, False),
    "word_len": ("10000 * word_chars DIV n_words", 75, 25, 6, 1024, True),
}
QUANTILES = sorted({x for _, upper, lower, *_ in RULES.values() for x in (upper, lower)})
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
GROUP = ["lang", "source"]


def _sql_space() -> str:
    return SPACE.replace("\\", "\\\\")


def _repeat_words() -> str:
    """Words that lie in a 3-word window found at least twice in ``w``.

    Windows are sorted by hash, equal neighbours mark their starts, and the
    sorted starts give the size of the union of [start, start + 3).
    Windows are told apart by a 64-bit hash within one text.
    """
    windows = ("sort_array(transform(sequence(0, size(w) - 3), "
               "i -> struct(xxhash64(w[i], w[i + 1], w[i + 2]) AS g, i AS i)))")
    starts = ("sort_array(transform(filter(v.s, (x, k) -> x.g <=> get(v.s, k - 1).g "
              "OR x.g <=> get(v.s, k + 1).g), x -> x.i))")
    union = ("aggregate(transform(u.p, (x, k) -> least(3L, coalesce(get(u.p, k + 1) - x, 3L))), "
             "0L, (a, x) -> a + x)")
    inner = let([("p", starts)], union, "u")
    return f"CASE WHEN size(w) < 3 THEN 0L ELSE {let([('s', windows)], inner)} END"


def base_counts(docs: DataFrame, carry: list[str]) -> DataFrame:
    """``row`` (a struct of the columns ``carry``), the counts as longs, ``base_failed``."""
    sp = _sql_space()
    wordy = f"filter(split(t, '\\n'), x -> x RLIKE '{sp.replace('[', '[^')}')"
    body = docs.select(F.struct(*carry).alias("row"), F.coalesce(F.col("text"), F.lit("")).alias("t"))
    words = body.withColumn("w", F.expr(f"array_remove(split(t, '{sp}+'), '')"))
    counts = words.select(
        "row",
        F.size("w").cast("long").alias("n_words"),
        F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        F.expr("CAST(regexp_count(t, '[#*$%&|<>]') AS BIGINT)").alias("n_symbols"),
        F.expr(let([("l", wordy)], "struct(CAST(size(v.l) AS BIGINT) AS n_lines, "
                   "CAST(size(v.l) - size(array_distinct(v.l)) AS BIGINT) AS n_dup_lines)")).alias("l"),
        F.expr(_repeat_words()).alias("n_repeat_words"))
    return counts.select(
        "row", *[c for c in COUNTS if c != "n_dup_lines"], "l.n_lines", "l.n_dup_lines",
        F.expr(f"n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words")
         .alias("base_failed"))


def sketches(counts: DataFrame) -> DataFrame:
    """One row per (lang, source, feature, bucket): ``low`` and its count."""
    feats = F.array(*[F.struct(F.lit(f).alias("feature"), F.expr(e).alias("v"))
                      for f, (e, *_) in RULES.items()])
    each = (counts.where("NOT base_failed")
            .select(*[F.col(f"row.{g}").alias(g) for g in GROUP], F.explode(feats).alias("f"))
            .select(*GROUP, "f.feature", F.col("f.v").alias("v")))
    shift = f"greatest(0, length(bin(v)) - {SKETCH_BITS + 1})"
    low = F.expr(f"shiftleft(shiftright(v, {shift}), {shift})")
    return each.groupBy(*GROUP, "feature", low.alias("low")).agg(F.count("*").alias("n"))


def blended(sketch: DataFrame) -> DataFrame:
    """(lang, source, feature, low, n): every group's sketch with that of all
    documents, as exact whole weights: a group's document weighs as many as
    there are documents, those of the others ``PRIOR`` together."""
    overall = sketch.groupBy("feature", "low").agg(F.sum("n").alias("n"))  # a few hundred buckets a feature
    totals = overall.groupBy("feature").agg(F.sum("n").alias("t"))
    wide = lambda c: F.col(c).cast("decimal(19,0)")
    own = sketch.join(F.broadcast(totals), "feature").select(*GROUP, "feature", "low", (wide("n") * wide("t")).alias("n"))
    groups = sketch.select(*GROUP, "feature").distinct()
    whole = groups.join(F.broadcast(overall), "feature").select(*GROUP, "feature", "low", (F.lit(PRIOR).cast("decimal(19,0)") * wide("n")).alias("n"))
    return own.union(whole).groupBy(*GROUP, "feature", "low").agg(F.sum("n").cast("decimal(36,0)").alias("n"))


def quantiles(sketch: DataFrame, keys: list[str]) -> DataFrame:
    """One row per key with the quantiles ``q<percent>`` of its sketch."""
    by = W.partitionBy(*keys)
    cum = sketch.select(*keys, "low", F.sum("n").over(by.orderBy("low")).cast("decimal(36,0)").alias("cum"),
                        F.sum("n").over(by).cast("decimal(36,0)").alias("total"))
    return cum.groupBy(*keys).agg(
        *[F.min(F.when(F.col("cum") * 100 >= F.col("total") * q, F.col("low"))).alias(f"q{q}") for q in QUANTILES])


def thresholds(sketch: DataFrame) -> DataFrame:
    """One row per (lang, source): ``lo_<feature>`` and ``hi_<feature>``."""
    found = quantiles(blended(sketch), [*GROUP, "feature"])
    aggs = []
    for f, (_, upper, lower, k, least, low_side) in RULES.items():
        spread = F.greatest(F.col(f"q{upper}") - F.col(f"q{lower}"), F.lit(least))
        here = F.col("feature") == f
        aggs.append(F.max(F.when(here, F.col(f"q{upper}") + k * spread)).alias(f"hi_{f}"))
        aggs.append(F.max(F.when(here, F.col(f"q{lower}") - k * spread if low_side else F.lit(-1))).cast("long").alias(f"lo_{f}"))
    return found.groupBy(*GROUP).agg(*aggs)


def judged(docs: DataFrame, carry: list[str]) -> DataFrame:
    """``row``, counts, ``base_failed`` and ``kept`` for every row of ``docs``.

    The counts are written once to the shared folder: thresholds need all of
    them before the first verdict. The threshold table is written too, so the
    planner sees its size; when too large to broadcast, each of its rows meets
    its documents in ``SALTS`` partitions.
    """
    counts = written(base_counts(docs, carry), "quality-counts")
    table = written(thresholds(written(sketches(counts), "quality-sketch")), "quality-limits")
    table = table.select(F.struct("*").alias("lim"),
                         F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    salted = counts.withColumn("salt", F.expr(
        f"CAST(pmod(xxhash64(row.doc_id, n_words, word_chars), {SALTS}) AS INT)"))
    on = [salted["salt"] == table["salt"]]
    on += [F.col(f"row.{g}").eqNullSafe(F.col(f"lim.{g}")) for g in GROUP]
    usual = F.lit(True)
    for f, (e, *_) in RULES.items():
        usual &= F.expr(f"coalesce({e} BETWEEN lim.lo_{f} AND lim.hi_{f}, false)")
    kept = F.when(F.col("base_failed"), False).otherwise(usual)
    return salted.join(table, on, "left").select("row", *COUNTS, "base_failed", kept.alias("kept"))


def quality_filter(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that keep to the rules, with all their columns."""
    have = docs.columns
    full = docs
    for c, kind in (("lang", "string"), ("source", "string"), ("doc_id", "long")):
        full = with_default(full, c, kind)
    return judged(full, full.columns).where("kept").select(*[F.col("row")[c].alias(c) for c in have])


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return judged(docs, ["doc_id", *GROUP]).select("row.doc_id", *COUNTS, "base_failed", "kept")


def _oracle() -> str:
    feats = {f: e.replace(" DIV ", " // ") for f, (e, *_) in RULES.items()}
    each = " UNION ALL ".join(
        f"SELECT lang, source, '{f}' AS feature, {e} AS v FROM c WHERE NOT base_failed" for f, e in feats.items())
    lims = []
    for f, (_, upper, lower, k, least, low_side) in RULES.items():
        spread = f"{k} * greatest(q{upper} - q{lower}, {least})"
        lims.append((f"WHEN '{f}' THEN " + (f"q{lower} - {spread}" if low_side else "-1"), f"WHEN '{f}' THEN q{upper} + {spread}"))
    lo = "CASE feature " + " ".join(a for a, _ in lims) + " END"
    hi = "CASE feature " + " ".join(b for _, b in lims) + " END"
    qs = ", ".join(f"min(low) FILTER (cum * 100 >= total * {q}) AS q{q}" for q in QUANTILES)
    return rf"""
WITH d AS (SELECT doc_id, lang, source, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, list_filter(string_split_regex(t, '[ 	-
]+'), lambda x: x <> '') AS w,
        list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^ 	-
]')) AS l FROM d),
g AS (SELECT doc_id, unnest(range(1, len(w) - 1)) AS i, w FROM w WHERE len(w) >= 3),
gs AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS s FROM g),
rep AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, s) AS n FROM gs) WHERE n > 1),
nrep AS (SELECT doc_id, sum(least(3, coalesce(nx - i, 3)))::BIGINT AS n_repeat_words FROM
  (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS nx FROM rep) GROUP BY doc_id),
b AS (SELECT w.doc_id, lang, source, len(w)::BIGINT AS n_words, length(list_aggregate(w, 'string_agg', ''))::BIGINT AS wc,
        (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
        len(l)::BIGINT AS n_lines, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines,
        coalesce(n_repeat_words, 0) AS n_repeat_words FROM w LEFT JOIN nrep USING (doc_id)),
c AS (SELECT * EXCLUDE wc, coalesce(wc, 0) AS word_chars,
        n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed FROM b),
e AS ({each}),
s AS (SELECT lang, source, feature, (v >> greatest(0, length(bin(v)) - {SKETCH_BITS + 1})) << greatest(0, length(bin(v)) - {SKETCH_BITS + 1}) AS low,
        count(*) AS n FROM e GROUP BY ALL),
sa AS (SELECT feature, low, sum(n) AS n FROM s GROUP BY ALL),
ta AS (SELECT feature, sum(n) AS t FROM sa GROUP BY ALL),
m AS (SELECT lang, source, feature, low, sum(n) AS n FROM (
  SELECT lang, source, feature, low, n::HUGEINT * t AS n FROM s JOIN ta USING (feature) UNION ALL
  SELECT lang, source, feature, low, {PRIOR}::HUGEINT * n FROM (SELECT DISTINCT lang, source, feature FROM s) g JOIN sa USING (feature)) GROUP BY ALL),
q AS (SELECT lang, source, feature, {qs} FROM (SELECT *, sum(n) OVER (PARTITION BY lang, source, feature ORDER BY low) AS cum,
        sum(n) OVER (PARTITION BY lang, source, feature) AS total FROM m) GROUP BY ALL),
lim AS (SELECT *, {lo} AS lo, {hi} AS hi FROM q),
bad AS (SELECT DISTINCT doc_id FROM (
  SELECT doc_id, lang, source, feature, v FROM ({each.replace("SELECT lang", "SELECT doc_id, lang")})) x
  JOIN lim USING (feature) WHERE x.lang IS NOT DISTINCT FROM lim.lang AND x.source IS NOT DISTINCT FROM lim.source AND NOT v BETWEEN lo AND hi)
SELECT c.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND bad.doc_id IS NULL AS kept FROM c LEFT JOIN bad ON bad.doc_id = c.doc_id
"""


ORACLE_SQL = _oracle()
