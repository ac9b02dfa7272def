"""Hand-made micro fixtures M1-M13 with literal expectations."""

from pyspark.sql import functions as F

from errata.functions.letbind import let
from errata.operators import edits as ed
from errata.operators import m2
from errata.operators import paragraphs as pg
from errata.operators import scores as sc
from errata.operators import splits as spl

A_T = "array<struct<start:int,end:int,cat:string,cor:array<string>,coder:string>>"


def _block(spark, tokens, edits):
    df = spark.createDataFrame([(tokens, edits)], f"tokens array<string>, edits {A_T}")
    return m2.invert_blocks(df).collect()[0]


def test_m1_invert_single(spark):
    r = _block(spark, ["He", "go", "home", "."], [(1, 2, "R:VERB", ["goes"], "0")])
    assert r.tokens == ["He", "goes", "home", "."]
    assert (r.edits[0].start, r.edits[0].end, r.edits[0].cor) == (1, 2, ["go"])


def test_m2_running_offset(spark):
    r = _block(spark, ["a", "b", "c", "d"], [(1, 2, "R", ["X", "Y"], "0"), (2, 2, "M", ["Z"], "0"),
                                             (3, 4, "U", [], "0")])
    assert r.tokens == ["a", "X", "Y", "Z", "c"]
    assert [(e.start, e.end) for e in r.edits] == [(1, 3), (3, 4), (5, 5)]


def test_m3_noop(spark):
    r = _block(spark, ["a", "b"], [(-1, -1, "noop", ["-NONE-"], "0")])
    assert r.tokens == ["a", "b"]
    assert (r.edits[0].start, r.edits[0].end, r.edits[0].cat) == (-1, -1, "noop")


def _remap(spark, para, offsets):
    df = spark.createDataFrame([(para,)], "para string")
    df = pg.with_clean(df)
    expr = let([("wcl", "wcl"), ("before", "before"), ("lead", "lead")],
               "transform(array(" + ",".join(map(str, offsets)) + "), o -> " + pg.remap_sql("o", "v.") + ")")
    r = df.select("clean", F.expr(expr).alias("m")).collect()[0]
    return r.clean, r.m


def test_m4_double_blank(spark):
    assert _remap(spark, "a  b", [3, 4]) == ("a b", [2, 3])


def test_m5_leading_blank(spark):
    assert _remap(spark, " ab", [1, 3]) == ("ab", [0, 2])


def test_m6_span_on_blank_inverts(spark):
    clean, (s, e) = _remap(spark, "a b", [1, 2])
    df = spark.createDataFrame([(clean, s, e)], "clean string, s int, e int")
    r = df.select(F.expr(pg.trim_start_sql("s", "e")).alias("s"),
                  F.expr(pg.trim_end_sql("s", "e")).alias("e")).collect()[0]
    assert (r.s, r.e) == (2, 1)


def test_m7_detection_around_correction_dropped(spark):
    df = spark.createDataFrame([(1, 0, 0, 0, 0, 5, "D"), (1, 0, 0, 1, 1, 3, "C")],
                               "essay_id long, coder int, para_no int, edit_no int, s int, e int, kind string")
    kept = ed.drop_covered_detections(df, ["essay_id", "coder", "para_no"]).select("edit_no").collect()
    assert [r.edit_no for r in kept] == [1]


def test_m8_insertion_on_boundary_in_both(spark):
    text = "x" * 30 + "\n" + "y" * 30
    ess = spark.createDataFrame([(1, text)], "essay_id long, text string")
    edits = spark.createDataFrame([(1, 0, 0, 31, 31, "z", None)],
                                  "essay_id long, coder int, edit_no int, s long, e long, cor string, cat string")
    got = ed.assign_paragraphs(edits, ed.paragraph_bounds(ess)).select("para_no", "s").collect()
    assert sorted((r.para_no, r.s) for r in got) == [(0, 31), (1, 0)]


def _n_paras(spark, text):
    df = spark.createDataFrame([(text,)], "text string")
    return pg.with_paragraphs(df).select(F.size("paras").alias("n")).collect()[0].n


def test_m9_leading_short_lines(spark):
    long = "L" * 40
    assert _n_paras(spark, "a\nb\nc\nd\ne\n" + long) == 1
    assert _n_paras(spark, "a\nb\nc\nd\ne\nf\n" + long) == 2


def test_m10_newlines_only(spark):
    assert _n_paras(spark, "\n\n\n") == 0


def test_m11_m12_scores(spark):
    df = spark.createDataFrame([("x", "NOUN", "true"), ("x", "NOUN", "false"), ("x", "NOUN", "NONE"),
                                ("y", "NOUN", "false")], "token string, pos string, label string")
    rows = {(r.token, r.pos): r.score for r in sc.word_scores(df).collect()}
    assert rows == {("x", "NOUN"): 0.5}


def test_m13_split_size(spark):
    df = spark.createDataFrame([(str(i),) for i in range(11)], "seq_id string")
    out = spl.split_rows(df, "seq_id").groupBy("split").count().collect()
    assert {r.split: r["count"] for r in out} == {"test": 2, "train": 9}
    assert spl.test_size(11) == 2
