"""Sentence rows: one row per (essay, coder, paragraph) with its tokens and
token edits, built from essays and character edits.

All per-paragraph work (offset remap, char -> token spans, corrections) is
expressions over the row's arrays; what needs a running state (overlap drop,
applying the edits) is worked out in numbers over Arrow batches;
the only shuffles are the joins that bring edits to their paragraph.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from errata.functions.letbind import let, sql_str
from errata.functions.replay import drop_overlaps, replay
from errata.functions.text import STRIP_RE, TOKEN_RE, normalise_punct
from errata.operators import edits as ed
from errata.operators import paragraphs as pg

KEYS = ["essay_id", "coder", "para_no"]
EDIT_T = "array<struct<edit_no:int,s:int,e:int,kind:string,cat:string,cor:string>>"


def essay_paragraphs(essays: DataFrame) -> DataFrame:
    """Raw paragraphs."""
    ess = essays.select("essay_id", normalise_punct(F.col("text")).alias("text"))
    return pg.paragraph_rows(ess, ["essay_id"])


def paragraph_tokens(paras: DataFrame) -> DataFrame:
    """Cleaned, non-empty paragraphs with tokens."""
    return pg.with_tokens(pg.with_clean(paras).filter(F.col("clean") != ""), "clean")


def paragraph_edits(essays: DataFrame, edits: DataFrame, seen: Observation | None = None) -> DataFrame:
    """Edits per (essay, coder, paragraph) in list order.
    ``seen`` counts the edits that no paragraph holds (see ``assign_paragraphs``)."""
    ess = essays.select("essay_id", normalise_punct(F.col("text")).alias("text"))
    e = ed.edit_kinds(edits)
    e = ed.assign_paragraphs(e, ed.paragraph_bounds(ess), seen)
    e = ed.drop_covered_detections(e, KEYS)
    item = F.struct(F.col("edit_no").cast("int").alias("edit_no"), F.col("s").cast("int").alias("s"),
                    F.col("e").cast("int").alias("e"), "kind", "cat", "cor")
    return e.groupBy(*KEYS).agg(F.array_sort(F.collect_list(item)).alias("edits"))


def coders_of(edits: DataFrame) -> DataFrame:
    return edits.select("essay_id", F.col("coder").cast("int").alias("coder")).distinct()


def _token_edit_sql() -> str:
    """Per row: remap + trim (P6, P7) and char -> token spans."""
    # Lambdas refer to the row's arrays as r.<name>, to earlier steps as a.<name>.
    rm = lambda o: pg.remap_sql(o, "r.")
    # P6 + P7
    step1 = (f"transform(r.edits, x -> named_struct('edit_no', x.edit_no, 'kind', x.kind, "
             f"'cat', x.cat, 'cor', x.cor, 's0', {rm('x.s')}, 'e0', {rm('x.e')}))")
    trim = ("transform(a.e1, x -> named_struct('edit_no', x.edit_no, 'kind', x.kind, 'cat', x.cat, 'cor', x.cor, "
            f"'s', {pg.trim_start_sql('x.s0', 'x.e0', 'r.ccl')}, 'e', {pg.trim_end_sql('x.s0', 'x.e0', 'r.ccl')}))")
    # ``at`` gives the last token that starts at or before an offset, so
    # every lookup is one array access. is: that token for the span's start; ie:
    # the first token that ends after the span's end.
    n = "size(r.starts)"
    near_s, near_e = f"IF(q.is >= 0, q.is, {n} - 1)", f"least(q.ie, {n} - 1)"

    def span(ts: str, te: str, xp: str, cs: str = "x.s", ce: str = "x.e") -> str:
        return f"named_struct('ts', CAST({ts} AS INT), 'te', CAST({te} AS INT), 'xp', {xp}, 'cs', {cs}, 'ce', {ce})"
    tokspan = (
        "CASE WHEN x.s = x.e THEN CASE "
        f"WHEN x.s = 0 OR x.s <= r.starts[0] THEN {span('0', '0', 'false')} "
        f"WHEN x.s >= r.ends[{n} - 1] THEN {span(n, n, 'false')} "
        f"WHEN q.ps > 0 THEN {span('q.ps - 1', 'q.ps - 1', 'false')} "
        f"WHEN q.pe > 0 THEN {span('q.pe', 'q.pe', 'false')} "
        f"ELSE {span('q.is', 'q.ie + 1', 'true', 'r.starts[q.is]', 'r.ends[q.ie]')} END "
        f"WHEN q.ps > 0 AND q.pe > 0 THEN {span('q.ps - 1', 'q.pe', 'false')} "
        "ELSE " + span(f"IF(q.ps > 0, q.ps - 1, {near_s})", f"IF(q.pe > 0, q.pe, {near_e} + 1)", "true",
                       f"IF(q.ps > 0, x.s, r.starts[{near_s}])", f"IF(q.pe > 0, x.e, r.ends[{near_e}])") + " END")
    last = lambda o: f"coalesce(get(r.at, {o}), IF({o} < 0, -1, {n} - 1))"
    lookups = [("is", "p.is"), ("ie", "IF(p.ie >= 0 AND r.ends[p.ie] > x.e, p.ie, p.ie + 1)"),
               ("ps", "IF(p.is >= 0 AND get(r.starts, p.is) = x.s, p.is + 1, 0)"),
               ("pe", "IF(p.il >= 0 AND get(r.ends, p.il) = x.e, p.il + 1, 0)")]
    step3 = ("transform(a.e2, x -> "
             + let([("is", last("x.s")), ("ie", last("x.e")), ("il", last("(x.e - 1)"))],
                   let(lookups, f"named_struct('x', x, 'k', {tokspan})", "q"), "p") + ")")
    return _chain([("e1", step1), ("e2", trim), ("e3", step3)], "named_struct('e2', a.e2, 'e3', a.e3)")


def _kept_edits_sql() -> str:
    """Per row: the edits that stay, with their corrections."""
    strip, tok = sql_str(STRIP_RE), sql_str(TOKEN_RE)
    # A place in a string is found by counting from its start, which costs an edit the whole text before it.
    part = lambda a, b: f"array_join(slice(r.chars, {a} + 1, IF({b} < {a}, 0, {b} - {a})), '')"
    # E3, E4, E5
    cor_text = f"coalesce(y.x.cor, {part('y.x.s', 'y.x.e')})"
    expanded = f"regexp_replace(concat({part('y.k.cs', 'y.x.s')}, {cor_text}, {part('y.x.e', 'y.k.ce')}), {strip}, '')"
    full = f"IF(y.k.xp, {expanded}, {cor_text})"
    cor_toks = (f"IF(y.x.kind = 'D', slice(r.toks, greatest(y.k.ts, 0) + 1, greatest(y.k.te - greatest(y.k.ts, 0), 0)), "
                f"regexp_extract_all(regexp_replace({full}, {strip}, ''), {tok}, 0))")
    return ("transform(filter(r.e3, (y, i) -> NOT r.gone[i]), y -> named_struct("
             "'edit_no', y.x.edit_no, 'kind', y.x.kind, 'cat', y.x.cat, 's', y.x.s, 'e', y.x.e, "
             "'ts', y.k.ts, 'te', y.k.te, 'expanded', y.k.xp, 'cor_text', " + full + ", "
             "'cor_toks', " + cor_toks + "))")


def _applied_sql() -> str:
    """Per row: the corrected sentence (E1), its edits' places (W3) and the dropped ones."""
    return ("named_struct('tok_edits', transform(r.e5, (z, i) -> named_struct('edit_no', z.edit_no, "
            "'kind', z.kind, 'cat', z.cat, 's', z.s, 'e', z.e, 'ts', z.ts, 'te', z.te, "
            "'expanded', z.expanded, 'cor_text', z.cor_text, 'cor_toks', z.cor_toks, "
            "'c_start', r.at[i], 'c_end', r.at[i] + size(z.cor_toks))), "
            "'cor', transform(r.take, i -> r.all[i]), "
            "'dropped', transform(filter(r.e3, (y, i) -> r.gone[i]), y -> y.x.edit_no), "
            "'spans_all', transform(r.e3, y -> named_struct('edit_no', y.x.edit_no, 'kind', y.x.kind, "
            "'s', y.x.s, 'e', y.x.e, 'ts', y.k.ts, 'te', y.k.te, 'expanded', y.k.xp)))")


def _chain(steps: list[tuple[str, str]], body: str) -> str:
    """Nest lets so that step i sees all earlier steps as ``a.<name>``.

    Each level re-binds the earlier names, so every lambda refers to ``a``.
    """
    expr = body
    # Build from the innermost level outwards.
    for i in range(len(steps) - 1, -1, -1):
        name, sql = steps[i]
        carried = [(p, f"a.{p}") for p in names_before(steps, i)]
        expr = let(carried + [(name, sql)], expr, "a")
    return expr


def names_before(steps, i):
    return [n for n, _ in steps[:i]]


ROW_BINDS = [("edits", "edits"), ("clean", "clean"), ("toks", "toks"), ("starts", "starts"),
             ("ends", "ends"), ("wcl", "wcl"), ("before", "before"), ("lead", "lead"),
             ("at", "flatten(concat(array(array_repeat(-1, starts[0])), transform(starts, (x, k) -> "
                    "array_repeat(k, coalesce(get(starts, k + 1), length(clean) + 1) - x))))"),
             ("ccl", "split(regexp_replace(clean, '[^ ]', '.'), '')")]


def sentences(essays: DataFrame, edits: DataFrame, coders: DataFrame | None = None,
              seen: Observation | None = None) -> DataFrame:
    """E9/E10 + token edits: essay_id, coder, para_no, orig (tokens), cor,
    tok_edits (list order), dropped edit numbers, and the paragraph text.
    ``seen`` counts the edits that are lost at paragraph bounds.

    Paragraphs meet their coders and edits as raw text; what is derived from
    it, several arrays as long as the paragraph, is made after the joins.
    """
    paras = essay_paragraphs(essays).select("essay_id", "para_no", "p_start", "para")
    pe = paragraph_edits(essays, edits, seen)
    coders = coders if coders is not None else coders_of(edits)
    s = paragraph_tokens(paras.join(coders, "essay_id").join(pe, KEYS, "left"))
    s = s.withColumn("edits", F.coalesce(F.col("edits"), F.expr(f"CAST(array() AS {EDIT_T})")))
    s = s.withColumn("_a", F.expr(let(ROW_BINDS, _token_edit_sql(), "r")))
    each = lambda f: f"transform(_a.e3, y -> y.k.{f})"
    s = s.withColumn("_gone", drop_overlaps(each("ts"), each("te"), each("xp")))
    kept = F.expr(let([("chars", "split(clean, '')"), ("toks", "toks"), ("e3", "_a.e3"), ("gone", "_gone")], _kept_edits_sql(), "r"))
    # Generators stand between calls of Python: the optimiser would merge one into the next one's arguments.
    s = s.select("*", F.inline(F.array(F.struct(kept.alias("_e5")))))
    each = lambda f: f"transform(_e5, z -> {f})"
    s = s.withColumn("_re", replay("size(toks)", each("z.ts"), each("z.te"), each("size(z.cor_toks)")))
    binds = [("e3", "_a.e3"), ("gone", "_gone"), ("e5", "_e5"), ("at", "_re.at"), ("take", "_re.take"), ("all", f"concat(toks, flatten({each('z.cor_toks')}))")]
    s = s.drop("edits").select("*", F.inline(F.array(F.expr(let(binds, _applied_sql(), "r")))))
    return s.select("essay_id", "coder", "para_no", "p_start", "clean",
                    F.col("toks").alias("orig"), "starts", "ends",
                    "cor", "tok_edits", "dropped", F.col("_a.e2").alias("edits_rt"), "spans_all")
