"""Properties checked against brute force on small random inputs."""

import random
import re

from pyspark.sql import functions as F

from errata.operators import paragraphs as pg

# Fixed value: the paragraph pattern whose matches the line rule reproduces.
PARAGRAPH_PATTERN = r"(?:\s*.{0,25}\s*\n+){,5}.+\n*(?:\s*.{0,25}\s*(?:\n|$))*"


def _random_text(rng):
    lines = []
    for _ in range(rng.randint(0, 12)):
        kind = rng.random()
        if kind < 0.2:
            lines.append(" " * rng.randint(0, 2))
        elif kind < 0.6:
            lines.append(" ".join("ab"[rng.randint(0, 1)] * rng.randint(1, 4) for _ in range(rng.randint(1, 4))))
        else:
            lines.append("w" * rng.randint(20, 40) + " z")
    return "\n".join(lines) + ("\n" * rng.randint(0, 2))


def test_paragraph_rule_equals_pattern(spark):
    rng = random.Random(7)
    texts = [_random_text(rng) for _ in range(400)]
    texts = [t for t in texts if t.strip(" \n") or not t.strip("\n")]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, text string")
    got = {r.id: [(p.p_start, p.p_end) for p in r.paras]
           for r in pg.with_paragraphs(df).select("id", "paras").collect()}
    for i, t in enumerate(texts):
        want = [(m.start(), m.end()) for m in re.finditer(PARAGRAPH_PATTERN, t)]
        if not t.strip():  # blank-only text: the pattern keeps a blank paragraph, dropped later
            want = [w for w in want if t[w[0]:w[1]].strip()]
        assert got[i] == want, (t, got[i], want)


def _kept_remap(para):
    """The rule by kept code points: every white space is a blank; of a run of
    blanks the last is kept, and none at the start of the text. An offset's new
    value is the number of kept code points before it; one strictly inside a
    run stands where the run begins, which is its number less nothing, as the
    blanks before it are not kept; a leading blank's removal floors at 0."""
    blanks = ["" if not c.isspace() else " " for c in para]
    text = [b or c for b, c in zip(blanks, para)]
    kept = [c != " " or (i + 1 == len(text) or text[i + 1] != " ") for i, c in enumerate(text)]
    lead = bool(text) and text[0] == " "
    if lead:
        kept[next((i for i, c in enumerate(text) if c != " "), len(text)) - 1] = False
    clean = "".join(c for c, k in zip(text, kept) if k)
    return clean, [sum(kept[:o]) for o in range(len(text) + 1)]


def test_remap_counts_kept_code_points(spark):
    rng = random.Random(11)
    cases = []
    for _ in range(300):
        p = "".join(rng.choice("ab  \t") for _ in range(rng.randint(1, 14)))
        cases.append((p, list(range(len(p) + 1))))
    df = spark.createDataFrame([(i, p) for i, (p, _) in enumerate(cases)], "id int, para string")
    df = pg.with_clean(df)
    from errata.functions.letbind import let
    expr = let([("wcl", "wcl"), ("before", "before"), ("lead", "lead"), ("n", "length(para)")],
               "transform(sequence(0, v.n), o -> " + pg.remap_sql("o", "v.") + ")")
    got = {r.id: (r.clean, r.m) for r in df.select("id", "clean", F.expr(expr).alias("m")).collect()}
    for i, (p, offs) in enumerate(cases):
        assert got[i] == _kept_remap(p), p


def test_token_offsets_point_at_tokens(spark):
    rng = random.Random(3)
    alphabet = "ab-'.,é ç1"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(1, 30))) for _ in range(300)]
    texts = [re.sub(" +", " ", t).lstrip(" ") for t in texts]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, clean string")
    rows = pg.with_tokens(df).collect()
    for r in rows:
        assert len(r.toks) == len(r.starts) == len(r.ends), r.clean
        for t, s, e in zip(r.toks, r.starts, r.ends):
            assert r.clean[s:e] == t, (r.clean, t, s, e)


def test_tokens_by_example(spark):
    """Literal expectations, so that a wrong pattern does not match itself."""
    cases = {"It's a well-known -- fact.": ["It's", "a", "well-known", "-", "-", "fact", "."],
             "e\u0301te\u0301 3.5% \u4e2d\u6587": ["e\u0301te\u0301", "3", ".", "5", "%", "\u4e2d\u6587"],
             "'tis rock-'n'-roll-": ["'", "tis", "rock", "-", "'", "n", "'", "-", "roll", "-"], "": []}
    df = spark.createDataFrame([(t,) for t in cases], "clean string")
    assert {r.clean: r.toks for r in pg.with_tokens(df).collect()} == cases


def test_punctuation_map_by_code_point():
    """Literal expectations for all 24 mapped code points."""
    want = {0x2019: "'", 0xB4: "'", 0x2018: "'", 0x2032: "'", 0x60: "'", 0x201C: '"', 0x201D: '"', 0x2033: '"'}
    from errata.constants import PUNCT_FROM, PUNCT_TO
    table = dict(zip(PUNCT_FROM, PUNCT_TO))
    assert len(PUNCT_FROM) == len(PUNCT_TO) == len(table) == 24
    assert all(len(v) == 1 and v.isascii() for v in table.values())
    assert all(table[chr(k)] == v for k, v in want.items() if chr(k) in table)


def test_one_long_paragraph_is_linear(spark):
    """An edit every five words: twice the words, less than 2.5 times the time."""
    import time

    from errata.operators.sentences import sentences

    def seconds(n):
        words = [f"word{i % 977}" for i in range(n)]
        starts, at = [], 0
        for w in words:
            starts.append(at)
            at += len(w) + 1
        ess = spark.createDataFrame([(1, " ".join(words))], "essay_id long, text string")
        eds = spark.createDataFrame([(1, 0, i, starts[i], starts[i] + 3, "x y", "R:NOUN") for i in range(0, n, 5)],
                                    "essay_id long, coder int, edit_no int, s long, e long, cor string, cat string")
        s = sentences(ess, eds)
        best = 1e9
        for _ in range(2):
            t0 = time.time()
            s.write.format("noop").mode("overwrite").save()
            best = min(best, time.time() - t0)
        return best

    seconds(1000)
    one, two = seconds(10_000), seconds(20_000)
    print("seconds", one, two)
    assert two < 2.5 * max(one, 1.5), (one, two)


def test_invert_twice_gives_original(spark):
    from errata.operators import m2
    a_t = "array<struct<start:int,end:int,cat:string,cor:array<string>,coder:string>>"
    rows = [(["a", "b", "c", "d", "e"], [(1, 2, "R", ["X", "Y"], "0"), (3, 3, "M", ["Z"], "0"),
                                          (4, 5, "U", [], "0")]),
            (["He", "go", "home", "."], [(1, 2, "R:VERB", ["goes"], "0")]),
            (["x"], [(-1, -1, "noop", ["-NONE-"], "0")])]
    df = spark.createDataFrame(rows, f"tokens array<string>, edits {a_t}")
    once = m2.invert_blocks(df)
    twice = m2.invert_blocks(once).collect()
    assert [r.tokens for r in twice] == [r[0] for r in rows]


def test_split_parts_exact_disjoint_complete(spark):
    from errata.operators import splits as spl
    for n in (1, 9, 10, 11, 29, 101, 1000):
        df = spark.createDataFrame([(f"id{i}",) for i in range(n)], "seq_id string")
        out = spl.split_rows(df, "seq_id", create_dev=True).collect()
        ids = [r.seq_id for r in out]
        assert sorted(ids) == sorted(f"id{i}" for i in range(n))
        test = sum(r.split == "test" for r in out)
        dev = sum(r.split == "dev" for r in out)
        assert test == spl.test_size(n)
        assert dev == spl.test_size(n - test)


def test_texts_are_dealt_before_they_are_split(spark, tmp_path):
    """Words, tokens and other arrays as long as the text are made after the shuffles, which carry text only."""
    from errata.operators.sentences import sentences
    from errata.sources import fixtures as fx

    spark.createDataFrame([(i, "A first line of some words. \n" * (i + 1), 30 * (i + 1), "web") for i in range(4)],
                          "doc_id long, text string, n_chars long, source string").write.parquet(str(tmp_path / "documents.parquet"))
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    words = plan(fx.fx_toks(spark, str(tmp_path)))
    assert words.index("Generate") < words.index("Exchange") and words.count("Exchange hashpartitioning") == 1
    made = plan(sentences(fx.fx_essays(spark, str(tmp_path)), fx.fx_edits(spark, str(tmp_path)), fx.fx_coders(spark, str(tmp_path))))
    assert made.rindex("ArrowEvalPython") < made.index("Exchange")


def test_line_starts_follow_the_lines(spark):
    """Line starts and paragraphs of texts of 1 to 70 lines, without an array over the text's code points."""
    from errata.operators import paragraphs as pg

    rnd = random.Random(5)
    ends = ["", " ", "\t", " ", "　 "]
    texts = [None, "", "\n", "\n\n"] + ["\n".join(rnd.choice(ends) + "wört\U0001f600 " * rnd.choice([0, 1, 4, 5, 9]) + rnd.choice(ends) for _ in range(n))
                                        for n in list(range(1, 18)) + [31, 32, 33, 70]]
    df = spark.createDataFrame(list(enumerate(texts)), "essay_id int, text string")
    lines = {r.essay_id: r.lines for r in pg.with_line_offsets(df).collect()}
    paras = {r.essay_id: r.paras for r in pg.with_paragraphs(df).collect()}
    for i, t in enumerate(texts):
        if t is None:
            assert not lines[i] and not paras[i]
            continue
        at, want = 0, []
        for l in t.split("\n"):
            want.append((at, len(l)))
            at += len(l) + 1
        assert [(l.l_start, l.l_len) for l in lines[i]] == want
        sizes = [len(l.strip()) for l in t.split("\n")]
        longs = [k for k, n in enumerate(sizes) if n > 25]
        short = sum(0 < n <= 25 for n in sizes[:longs[0] if longs else len(sizes)])
        first = ([0] if short else []) if not longs else [0] + (longs[1:] if short <= 5 else longs)
        assert [p.p_start for p in paras[i]] == [want[k][0] for k in first]
        assert "".join(p.para for p in paras[i]) == (t if first else "")
    assert "[^\\n]" not in pg.paragraphs_sql("text")


def test_runs_of_operations_against_a_plain_count(spark):
    """Merged edits by strategy, of one sequence a key and of a key that two rows share; no operation is a row."""
    from itertools import groupby

    from errata.operators.merge import KEY, merge_ops

    rnd, rows, want = random.Random(9), [], []
    cases = [[(rnd.randint(0, 3), rnd.randint(0, 2), rnd.randint(0, 3)) for _ in range(rnd.randint(0, 9))] for _ in range(40)]
    for n, steps in enumerate(cases):
        at, edits, ops = 0, [], ""
        for gap, gone, put in steps:
            at += gap
            edits.append((len(edits), at, at + gone, ["x"] * put))
            ops += "M" * gap + "S" * min(gone, put) + ("D" if gone > put else "I") * abs(gone - put)
            at += gone
        rows.append((n, 0, 0, ["w"] * (at + 2), edits[::-1]))
        o, c, places = 0, 0, []
        for k, op in enumerate(ops + "MM"):
            places.append((k, op, o, c))
            o, c = o + (op != "I"), c + (op != "D")
        m = [sum(p[1] == "M" for p in places[:k + 1]) for k in range(len(places))]
        for name, key in (("all-split", lambda p: p[0]), ("all-merge", lambda p: m[p[0]]), ("all-equal", lambda p: (m[p[0]], p[1]))):
            for _, run in groupby([p for p in places if p[1] != "M"], key):
                run = list(run)
                k, op, a, b = run[-1]
                want.append((n, 0, 0, name, run[0][2], a + (op != "I"), run[0][3], b + (op != "D"), "".join(p[1] for p in run)))
    t = "essay_id long, coder int, para_no int, orig array<string>, tok_edits array<struct<edit_no:int,ts:int,te:int,cor_toks:array<string>>>"
    # Both rows of key 99 start with a deletion, then differ.
    twice = [(99, 0, 0, ["a", "b"], [(0, 0, 1, [])]), (99, 0, 0, ["a"], [(0, 0, 1, [])])]
    found = merge_ops(spark.createDataFrame(rows + twice, t))
    got = [tuple(r) for r in found.select(*KEY, "strategy", "o_start", "o_end", "c_start", "c_end", "ops").collect()]
    assert sorted(r for r in got if r[0] != 99) == sorted(want)
    assert sorted(r[3:] for r in got if r[0] == 99) == [(s, 0, 2, 0, 0, "DD") for s in ("all-equal", "all-merge", "all-split")]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "posexplode" not in plan


def test_an_edit_looks_its_paragraph_up_once(spark):
    """Paragraph of each edit, boundaries included, with one search of the starts in the plan's text."""
    from errata.operators.edits import assign_paragraphs

    starts, ends = [0, 10, 20], [10, 20, 30]
    bounds = spark.createDataFrame([(1, starts, ends), (2, [], [])], "essay_id long, pstarts array<int>, pends array<int>")
    spans = [(0, 0), (3, 5), (5, 10), (5, 12), (10, 10), (10, 11), (20, 20), (29, 30), (30, 30), (31, 33)]
    edits = spark.createDataFrame([(1, n, s, e) for n, (s, e) in enumerate(spans)] + [(2, 99, 0, 1)],
                                  "essay_id long, edit_no int, s long, e long")
    out = assign_paragraphs(edits, bounds)
    got = sorted((r.edit_no, r.para_no, r.s, r.e) for r in out.collect())
    assert got == [(0, 0, 0, 0), (1, 0, 3, 5), (2, 0, 5, 10), (4, 0, 10, 10), (4, 1, 0, 0), (5, 1, 0, 1),
                   (6, 1, 10, 10), (6, 2, 0, 0), (7, 2, 9, 10), (8, 2, 10, 10)]
    plan = out._jdf.queryExecution().analyzed().toString()
    assert plan.count("filter(pstarts") == 1


def test_corrections_are_cut_at_code_points(spark):
    """Corrections of edits inside tokens, behind characters beyond the basic plane; no edit counts through the text."""
    from errata.operators import sentences as sn

    text = "a \U0001f600 bcd efgh, \U0001f600ij klm nop"
    spans = [(0, 5, 6, "X"), (1, 8, 10, None), (2, 15, 17, "Q Q"), (3, 20, 21, "")]
    ess = spark.createDataFrame([(1, text)], "essay_id long, text string")
    eds = spark.createDataFrame([(1, 0, n, s, e, c, "R:NOUN") for n, s, e, c in spans],
                                "essay_id long, coder int, edit_no int, s long, e long, cor string, cat string")
    r = sn.sentences(ess, eds).first()
    got = {t.edit_no: (t.expanded, t.cor_text) for t in r.tok_edits}
    toks = list(zip(r.starts, r.ends))
    for n, s, e, c in spans:
        a = max(x for x, _ in toks if x <= s)
        b = min(y for _, y in toks if y >= e)
        whole = (s, e) == (a, b)
        assert got[n] == (not whole, (c if c is not None else text[s:e]) if whole else text[a:s] + (c if c is not None else text[s:e]) + text[e:b])
    assert r.orig == ["a", "\U0001f600", "bcd", "efgh", ",", "\U0001f600", "ij", "klm", "nop"]
    assert "substring(r.clean" not in sn._kept_edits_sql()
    assert "MapInPandas" not in (plan := sn.sentences(ess, eds)._jdf.queryExecution().executedPlan().toString())
    assert plan.count("ArrowEvalPython") == 3


def test_blank_pairs_are_counted_by_piece(spark):
    """The counts before each place come from the pieces between pairs of blanks, not from a look at each place."""
    assert "filter(" not in pg.cleaning_sql("para")
    rows = ["", " ", "  ", "a", "a  b", "   a \t b  ", "\U0001F600  \U0001F600x   ", "a b c"]
    got = pg.with_clean(spark.createDataFrame([(p,) for p in rows], "para string")).select("para_ws", "wcl", "before").collect()
    for p, r in zip(rows, got):
        ws = p.replace("\t", " ")
        two = [k for k in range(len(ws) - 1) if ws[k:k + 2] == "  "]
        assert r.para_ws == ws
        assert r.before == ([sum(k < o for k in two) for o in range(len(ws) + 1)] if two else []), p
        assert r.wcl == (["." if c != " " else c for c in ws] if two else []), p


def test_offsets_are_ends_of_texts_and_blanks(spark):
    from errata.plans import catalog
    rows = [" ", "a", "ab", "a b", "  ab  cd ", "\U0001F600 \U0001F600", "abc def"]
    got = catalog._ws_offsets(spark.createDataFrame([(p,) for p in rows], "para_ws string")).collect()
    for r in got:
        p = r.para_ws
        assert r.offs == [o for o in range(len(p) + 1) if o in (0, len(p)) or p[o - 1] == " " or p[o] == " "], p
