"""Paragraphs, whitespace cleaning, offset remapping and tokens.

Everything here works inside one row (one essay or one paragraph) with
linear array expressions, so no shuffle is needed and a long text costs
time in proportion to its length.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from errata.constants import LONG_PARAGRAPH_LIMIT, MAX_LEADING_SHORT, PY_WS, SHORT_LINE_MAX
from errata.functions.letbind import let, sql_str
from errata.functions.text import STRIP_RE, TOKEN_RE

PARA_TYPE = "array<struct<para_no:int,p_start:int,p_end:int,para:string>>"


def line_ends_sql(lines: str) -> str:
    """Running sums of the lines' lengths, each with its line feed: where the next line starts.

    In doubling steps: after step p each element holds the sum of up to 2 ** (p + 1)
    lengths, so the work follows the number of lines, not of code points.
    """
    steps = f"sequence(0, CAST(floor(log2(greatest(size({lines}), 1))) AS INT))"
    return (f"aggregate({steps}, transform({lines}, l -> length(l) + 1), (s, p) -> IF(size(s) > shiftleft(1, p), "
            "transform(s, (x, i) -> x + IF(i >= shiftleft(1, p), s[i - shiftleft(1, p)], 0)), s))")


def paragraphs_sql(text: str, with_text: bool = True) -> str:
    """W2 + W1: ``text`` -> array of struct(para_no, p_start, p_end, para).

    A line (split on newline) is long when its stripped length is over 25,
    short when 1-25, blank otherwise. Every long line starts a paragraph,
    except that up to 5 short lines before the first long line join it;
    with more than 5 they form a paragraph of their own. Paragraphs run to
    the next one's first line, so they tile the text. A text with no
    non-blank line has none.
    """
    strip = sql_str(STRIP_RE)
    # Only a line with a blank at an end is searched for more.
    stripped = f"IF(concat(left(l, 1), right(l, 1)) RLIKE {sql_str(PY_WS)}, regexp_replace(l, {strip}, ''), l)"
    kind = (f"transform(transform(v0.lines, l -> length({stripped})), "
            f"x -> CASE WHEN x > {SHORT_LINE_MAX} THEN 2 WHEN x > 0 THEN 1 ELSE 0 END)")
    longs = "filter(sequence(0, size(v1.kind) - 1), k -> v1.kind[k] = 2)"
    kshort = "size(filter(IF(size(v2.longs) = 0, v1.kind, slice(v1.kind, 1, v2.longs[0])), x -> x = 1))"
    starts = ("CASE WHEN size(v2.longs) = 0 THEN IF(v3.kshort > 0, array(0), CAST(array() AS array<int>)) "
              f"WHEN v3.kshort <= {MAX_LEADING_SHORT} THEN concat(array(0), slice(v2.longs, 2, size(v2.longs))) "
              "ELSE concat(array(0), v2.longs) END")
    lstart = "IF({k} = 0, 0, v1.lends[{k} - 1])"
    a, b = "v4.starts[j]", "coalesce(get(v4.starts, j + 1), size(v0.lines))"
    item = ("named_struct('para_no', j, "
            f"'p_start', {lstart.format(k=a)}, "
            f"'p_end', IF(j + 1 < size(v4.starts), {lstart.format(k='v4.starts[j + 1]')}, v0.n), "
            + (f"'para', concat(array_join(slice(v0.lines, {a} + 1, {b} - {a}), '\\n'), "
               "IF(j + 1 < size(v4.starts), '\\n', '')))" if with_text else "'para', CAST(NULL AS STRING))"))
    body = (f"IF(size(v4.starts) = 0, CAST(array() AS {PARA_TYPE}), "
            f"transform(sequence(0, size(v4.starts) - 1), j -> {item}))")
    e = let([("starts", starts)], body, "v4")
    e = let([("kshort", kshort)], e, "v3")
    e = let([("longs", longs)], e, "v2")
    e = let([("kind", kind), ("lends", line_ends_sql("v0.lines"))], e, "v1")
    return let([("lines", f"split({text}, '\\n', -1)"), ("n", f"length({text})")], e, "v0")


def with_paragraphs(df: DataFrame, text: str = "text", out: str = "paras") -> DataFrame:
    return df.withColumn(out, F.expr(paragraphs_sql(text)))


def with_line_offsets(df: DataFrame, text: str = "text", out: str = "lines") -> DataFrame:
    """Start offset and length of every line."""
    body = ("transform(v0.lines, (l, k) -> named_struct('line_no', k, "
            "'l_start', IF(k = 0, 0, v1.lends[k - 1]), 'l_len', length(l)))")
    e = let([("lends", line_ends_sql("v0.lines"))], body, "v1")
    e = let([("lines", f"split({text}, '\\n', -1)")], e, "v0")
    return df.withColumn(out, F.expr(e))


def max_paragraph_length(paras: str = "paras") -> Column:
    """A5: longest paragraph of an essay; null for an essay without any."""
    return F.expr(f"array_max(transform({paras}, p -> p.p_end - p.p_start))")


def paragraph_rows(df: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """One row per paragraph: keys, para_no, p_start, p_end, para (raw)."""
    # inline() emits the struct fields as columns, so no field is extracted
    # after the generator (extraction lets the optimiser copy the producer).
    return df.select(*keys, F.inline(F.expr(paragraphs_sql(text))))


def cleaning_sql(para: str) -> str:
    """P5 inputs for one paragraph, as struct(para_ws, clean, lead, wcl,
    before): each whitespace a blank; runs collapsed and one leading blank
    dropped; whether a blank was dropped; the blank mask as an array; for each
    offset, how many places with two blanks lie before it. The arrays are
    built only when the paragraph has two blanks in a row (otherwise no
    offset moves but for the leading blank)."""
    ws = f"regexp_replace({para}, {sql_str(PY_WS)}, ' ')"
    clean = "regexp_replace(regexp_replace(c0.para_ws, ' {2,}', ' '), '^ ', '')"
    mask = "regexp_replace(c0.para_ws, '[^ ]', '.')"
    empty = "CAST(array() AS array<string>)"
    # Cut between the two blanks of each pair: as many pairs lie before a piece's places as pieces.
    laid = "flatten(transform(c2.p, (x, k) -> array_repeat(k, length(x) + IF(k + 1 = size(c2.p), 1, 0))))"
    pieces = "split(c0.para_ws, '(?<= )(?= )', -1)"
    before = f"IF(c1.has2, {let([('p', pieces)], laid, 'c2')}, CAST(array() AS array<int>))"
    body = ("named_struct('para_ws', c0.para_ws, 'clean', c1.clean, "
            f"'lead', coalesce(left(c0.para_ws, 1) = ' ', false), 'wcl', c1.wcl, 'before', {before})")
    e = let([("clean", clean), ("has2", "instr(c0.para_ws, '  ') > 0"),
             ("wcl", f"IF(instr(c0.para_ws, '  ') > 0, split({mask}, ''), {empty})")], body, "c1")
    return let([("para_ws", ws)], e, "c0")


def with_clean(df: DataFrame, para: str = "para") -> DataFrame:
    """P5 + P8 inputs as columns ``para_ws``, ``clean``, ``lead``, ``wcl``,
    ``before`` (see ``cleaning_sql``)."""
    return df.select("*", F.inline(F.array(F.expr(cleaning_sql(para)))))


def remap_sql(o: str, c: str = "") -> str:
    """An offset in the raw paragraph -> offset in the cleaned one.

    Each run of L blanks loses L - 1; an offset strictly inside a run moves to
    the run's start; then the dropped leading blank shifts all by one,
    floored at 0. ``c`` prefixes the fields wcl, before and lead (a let
    variable such as ``v.``); use it whenever this sits inside a lambda.
    """
    inside = (f"IF({o} > 0 AND get({c}wcl, {o} - 1) = ' ' AND get({c}wcl, {o}) = ' ', 1, 0)")
    return (f"greatest({o} - coalesce(get({c}before, {o} - 1), 0) - {inside} "
            f"- IF({c}lead, 1, 0), 0)")


def trim_start_sql(s: str, e: str, mask: str = "split(clean, '')") -> str:
    """A non-insertion span starting on a blank loses it; ``mask`` has the
    blanks by offset (bind one for many spans of a text)."""
    return f"IF({s} <> {e} AND get({mask}, {s}) = ' ', {s} + 1, {s})"


def trim_end_sql(s: str, e: str, mask: str = "split(clean, '')") -> str:
    """A non-insertion span ending on a blank loses it."""
    return f"IF({s} <> {e} AND {e} > 0 AND get({mask}, {e} - 1) = ' ', {e} - 1, {e})"


def long_essays(essays: DataFrame, limit: int = LONG_PARAGRAPH_LIMIT, text: str = "text") -> DataFrame:
    """``essays`` with ``max_len``, those whose longest paragraph has more than ``limit`` code points."""
    bounds = F.expr(paragraphs_sql(text, with_text=False))
    found = essays.withColumn("max_len", F.array_max(F.transform(bounds, lambda p: p["p_end"] - p["p_start"])))
    return found.filter(F.col("max_len") > limit)


# The same pattern as the regex module writes it: \\x{h} is \\uhhhh there.
_TOKEN_PATTERN = regex.sub(r"\\x\{(\w+)\}", lambda m: f"\\u{int(m[1], 16):04x}", TOKEN_RE)


def _tokens(texts: pa.Array) -> pa.Array:
    find = regex.compile(_TOKEN_PATTERN).finditer
    toks, spans, edges = [], [], [0]
    for t in texts.to_pylist():
        for m in find(t or ""):
            toks.append(m[0])
            spans.append(m.span())
        edges.append(len(toks))
    places, edges = np.array(spans, dtype=np.int32).reshape(-1, 2), pa.array(edges, pa.int32())
    listed = [pa.array(toks, pa.string()), pa.array(places[:, 0].copy()), pa.array(places[:, 1].copy())]
    return pa.StructArray.from_arrays([pa.ListArray.from_arrays(edges, v) for v in listed], names=["toks", "starts", "ends"])


def with_tokens(df: DataFrame, text: str = "clean") -> DataFrame:
    """E5: ``toks`` (strings), ``starts`` and ``ends`` (code point offsets).

    One pass of the token pattern over Arrow batches. Built-in functions give
    strings but no offsets; finding those with rewrites and per-code-point
    arrays took five times as long (README, "Measured").
    """
    spans = F.arrow_udf(_tokens, "toks array<string>, starts array<int>, ends array<int>")
    df = df.withColumn("_tok", spans(F.col(text)))
    # A generator, so that the optimiser doesn't merge this call of Python into a later one's arguments.
    return df.select(*[c for c in df.columns if c != "_tok"], F.inline(F.array("_tok")))
