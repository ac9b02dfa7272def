"""Faults of the M2 chain, its sources and lookups: one test each."""

import pytest
from pyspark.sql import functions as F

from errata.operators import features as ft
from errata.operators import m2
from errata.operators import splits as spl
from errata.operators.lookup import unique_words
from errata.operators.sentences import sentences
from errata.operators.tagging import tag_tokens
from errata.plans import dataset as dsp
from errata.session import scratch_path
from errata.sources import files as io

TEXT = "He go to school every day and likes it very much."
EDIT_T = "essay_id long, coder int, edit_no int, s long, e long, cor string, cat string"


def _lexicon(spark):
    return unique_words(_entries(spark))


def _entries(spark):
    return spark.createDataFrame([("go", "VERB", "go"), ("goes", "VERB", "go"), ("day", "NOUN", "day"),
                                  ("days", "NOUN", "day"), ("very", "ADV", "very"), ("much", "ADV", "much")],
                                 "word string, pos string, lemma string")


def _essays(spark, *texts):
    return spark.createDataFrame([(i, t, "B2.x") for i, t in enumerate(texts, 1)], "essay_id long, text string, cefr string")


def _blocks(spark, essays, edits, coders, **kw):
    out = dsp.m2_from_essays(essays, spark.createDataFrame(edits, EDIT_T), _lexicon(spark),
                             spark.createDataFrame(coders, "essay_id long, coder int"), **kw)
    return {r.essay_id: [(a.start, a.end, a.cat, " ".join(a.cor), a.coder) for a in r.edits]
            for r in out.collect()}


def test_zero_width_detection_is_kept(spark):
    got = _blocks(spark, _essays(spark, TEXT), [(1, 0, 0, 3, 3, None, None)], [(1, 0)])
    assert len(got[1]) == 1 and got[1][0][2] != "noop"


def test_correction_minimised_to_nothing_is_dropped(spark):
    got = _blocks(spark, _essays(spark, TEXT), [(1, 0, 0, 3, 5, "go", "R:VERB")], [(1, 0)])
    assert got[1] == [(-1, -1, "noop", "-NONE-", "0")]


def test_minimised_and_not(spark):
    edits = [(1, 0, 0, 0, 5, "He goes", "R:VERB")]
    assert _blocks(spark, _essays(spark, TEXT), edits, [(1, 0)])[1] == [(1, 2, "R:VERB", "goes", "0")]
    assert _blocks(spark, _essays(spark, TEXT), edits, [(1, 0)], no_min=True)[1] == [(0, 2, "R:OTHER", "He goes", "0")]


def test_essays_and_coders_without_edits_are_kept(spark):
    essays = _essays(spark, TEXT, TEXT)
    got = _blocks(spark, essays, [(1, 0, 0, 3, 5, "goes", "R:VERB")], [(1, 0), (1, 1), (2, 0)])
    assert got == {1: [(1, 2, "R:VERB", "goes", "0"), (-1, -1, "noop", "-NONE-", "1")], 2: [(-1, -1, "noop", "-NONE-", "0")]}


def test_two_coders_invert_in_turn(spark):
    """All coders' edits of a block apply to one sentence, in the order they stand."""
    got = dsp.m2_from_essays(_essays(spark, TEXT), spark.createDataFrame(
        [(1, 0, 0, 3, 5, "goes", "R:VERB"), (1, 1, 0, 22, 25, "days", "R:NOUN")], EDIT_T), _lexicon(spark),
        spark.createDataFrame([(1, 0), (1, 1)], "essay_id long, coder int"))
    r = m2.invert_blocks(got).first()
    assert " ".join(r.tokens) == "He goes to school every days and likes it very much ."
    assert [(a.start, a.end, a.cor, a.coder) for a in r.edits] == [(1, 2, ["go"], "0"), (5, 6, ["day"], "1")]


def test_json_round_trip_with_clean_essays_and_files(spark):
    essays = _essays(spark, TEXT, TEXT + "\n" + TEXT, TEXT, "Short.").withColumn("file", F.expr("concat('f', essay_id % 2)"))
    edits = spark.createDataFrame([(1, 0, 0, 3, 5, "goes", "R:VERB"), (2, 1, 0, 3, 5, None, None), (3, 0, 0, 0, 2, 'S"he\t', None)], EDIT_T)
    coders = spark.createDataFrame([(1, 0), (1, 1), (2, 0), (2, 1), (3, 0), (4, 0)], "essay_id long, coder int")
    path = scratch_path(spark, "t-essays")
    io.write_essays_json(essays, edits, coders, path)
    e, c, x = io.read_essays_json(spark, path)
    assert sorted((r.file, r.line_no, r.text) for r in e.collect()) == [
        ("f0", 0, TEXT + "\n" + TEXT), ("f0", 1, "Short."), ("f1", 0, TEXT), ("f1", 1, TEXT)]
    assert c.count() == 6 and e.select("essay_id").distinct().count() == 4
    assert sorted((r.coder, r.edit_no, r.s, r.e, r.cor) for r in x.collect()) == sorted(
        [(0, 0, 3, 5, "goes"), (1, 0, 3, 5, None), (0, 0, 0, 2, 'S"he\t')], key=str)
    out = dsp.dataset_from_files(spark, path, _lexicon(spark), scratch_path(spark, "t-m2"), scratch_path(spark, "t-cefr"),
                                 scratch_path(spark, "t-inv"))
    ids = sorted(r.seq_id for r in out.collect())
    assert ids == ["f0_0", "f0_1", "f0_2", "f1_0", "f1_1"]


def test_m2_separators_of_white_space(spark, tmp_path):
    (tmp_path / "a.m2").write_text("S a b\nA 0 1|||R|||x|||REQUIRED|||-NONE-|||0\n \t\nS c\n\n\n\nS d e\nA -1 -1|||noop|||-NONE-|||REQUIRED|||-NONE-|||0\n\r\nS f")
    (tmp_path / "b.m2").write_text("S z\n\n")
    rows = sorted((r.file, r.block_no, " ".join(r.tokens), len(r.edits)) for r in io.read_m2(spark, str(tmp_path)).collect())
    assert rows == [("a.m2", 0, "a b", 1), ("a.m2", 1, "c", 0), ("a.m2", 2, "d e", 1), ("a.m2", 3, "f", 0), ("b.m2", 0, "z", 0)]


def test_cefr_goes_by_file_and_block(spark):
    rows = [(f"f{k}", i, [f"t{k}{i}"], [], lev) for k, levels in enumerate(["ABC", "XYZ"]) for i, lev in enumerate(levels)]
    df = spark.createDataFrame(rows, f"file string, block_no int, tokens array<string>, edits array<{m2.A_T}>, cefr string")
    m2_path, cefr_path = scratch_path(spark, "t-m2"), scratch_path(spark, "t-cefr")
    io.write_m2(df.repartition(4), m2_path, ["block_no"])
    io.write_cefr_list(df, cefr_path, ["block_no"])
    got = io.attach_cefr(io.read_m2(spark, m2_path), spark, cefr_path).collect()
    assert sorted((r.file, r.block_no, r.tokens[0], r.cefr) for r in got) == [(f, i, t[0], c) for f, i, t, _, c in rows]


def test_split_with_repeated_ids_fails_rather_than_being_inexact(spark):
    df = spark.createDataFrame([(f"id{i % 5}",) for i in range(100)], "seq_id string")
    with pytest.raises(Exception, match="ids must be unique"):
        spl.split_exact(df, "seq_id").collect()


def test_grouped_split_keeps_groups_and_nulls(spark):
    df = spark.createDataFrame([(i, [None, "a", "b", "c"][i % 4]) for i in range(40)], "i int, g string")
    got = spl.split_grouped(df, "g").collect()
    assert len(got) == 40
    sides = {}
    for r in got:
        sides.setdefault(r.g, set()).add(r.split)
    assert all(len(v) == 1 for v in sides.values()) and len({*map(tuple, sides.values())}) == 2


def test_two_tags_of_a_word_leave_one_row(spark):
    lex = spark.createDataFrame([("run", "VERB", "run"), ("run", "NOUN", "run")], "word string, pos string, lemma string")
    got = tag_tokens(spark.createDataFrame([("run",)], "t string"), "t", unique_words(lex)).collect()
    assert [(r.t, r.pos) for r in got] == [("run", "NOUN")]


def test_lexicon_files(spark, tmp_path):
    (tmp_path / "psy.tsv").write_text("Word\tDom_PoS_SUBTLEX\tFreq_pm\tAoA_Kup_lem\nday\tNoun\t1\t3\nday\tNoun\t2\tNA\nthe\tArticle\t9\t1\n")
    (tmp_path / "cefr.tsv").write_text("word\tpos\tCefr-j\nbe\tbe-verb\tA1\nbe\tverb\tB1\nof\tpreposition\tA1\n")
    assert [tuple(r) for r in io.read_psy_lexicon(spark, str(tmp_path / "psy.tsv")).collect()] == [("day", "NOUN", 2.0, None)]
    assert [tuple(r) for r in io.read_cefr_lexicon(spark, str(tmp_path / "cefr.tsv")).collect()] == [("be", "VERB", 2)]


def test_unknown_level_is_an_error(spark):
    raw = spark.createDataFrame([("a", "noun", "D9", 1)], "word string, pos string, cefr_j string, n int")
    with pytest.raises(Exception, match="unknown CEFR level"):
        ft.cefr_lexicon(raw, "n").collect()


def test_sentences_without_coders_frame(spark):
    s = sentences(_essays(spark, TEXT, TEXT), spark.createDataFrame([(1, 0, 0, 3, 5, "goes", "R:VERB")], EDIT_T))
    assert [r.essay_id for r in s.collect()] == [1]


def test_lookup_without_broadcast_spreads_a_frequent_word(spark):
    """With the limit at zero the join is salted: no partition holds one word's rows."""
    lex = unique_words(spark.createDataFrame([("the", "DET", "the"), ("The", "DET", "the")], "word string, pos string, lemma string"))
    df = spark.range(4000).selectExpr("id", "IF(id % 10 = 0, concat('w', id), 'the') AS t")
    want = sorted(tuple(r) for r in tag_tokens(df, "t", lex).collect())
    spark.conf.set("errata.broadcast.maxBytes", "0")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        out = tag_tokens(df, "t", lex)
        sizes = [r["count"] for r in out.groupBy(F.spark_partition_id()).count().collect()]
        assert sorted(tuple(r) for r in out.collect()) == want
    finally:
        spark.conf.unset("errata.broadcast.maxBytes")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert max(sizes) <= 0.6 * sum(sizes)


def test_lookup_copies_frequent_words_only(spark):
    """Beyond the broadcast limit the table has one row a word, but for the frequent words; 50,000 words are beyond it."""
    from errata.operators import lookup
    lex = unique_words(spark.range(50_000).selectExpr("concat('Word', id, '-', sha2(CAST(id AS STRING), 256)) AS word", "'NOUN' AS pos", "lower(word) AS lemma"))
    assert not lookup.fits(lex)
    df = spark.range(20_000).selectExpr("IF(id % 10 = 0, concat('w', id), 'the') AS t")
    spread, salted = lookup._salted(df, lex, [(F.col("t"), "word")])
    assert salted.count() == 50_000
    assert spread.where("t = 'the'").select("_ds").distinct().count() == 1  # equal rows go together
    spread, salted = lookup._salted(df.withColumn("i", F.monotonically_increasing_id()), lex.union(spark.createDataFrame([("the", "DET", "the")], lex.schema)), [(F.col("t"), "word")])
    assert salted.count() == 50_000 + lookup.SALTS
    assert spread.where("t = 'the'").select("_ds").distinct().count() == lookup.SALTS


def test_tag_of_words_that_differ_in_case(spark):
    """The word itself comes first, then its lower case; a found word without a tag does not fall through."""
    lex = unique_words(spark.createDataFrame([("It", "A", "it"), ("it", "B", "it"), ("NO", None, None), ("no", "C", "no"), (None, "D", "d")],
                                             "word string, pos string, lemma string"))
    df = spark.createDataFrame([("It",), ("it",), ("IT",), ("NO",), ("No",), ("zz",), (None,)], "t string")
    want = [("It", "A", "it"), ("it", "B", "it"), ("IT", "B", "it"), ("NO", "X", "NO"), ("No", "C", "no"), ("zz", "X", "zz"), (None, "X", None)]
    for limit in (None, "0"):
        if limit:
            spark.conf.set("errata.broadcast.maxBytes", limit)
        try:
            assert sorted(map(str, map(tuple, tag_tokens(df, "t", lex).collect()))) == sorted(map(str, want))
        finally:
            spark.conf.unset("errata.broadcast.maxBytes")


def test_lookup_beyond_the_limit_is_never_broadcast(spark):
    """The files of 50,000 words are below Spark's own broadcast limit, their rows are beyond this package's."""
    from errata.operators import lookup
    lex = unique_words(spark.range(50_000).selectExpr("concat('Word', id, repeat('-', 100)) AS word", "'NOUN' AS pos", "lower(word) AS lemma"))
    assert not lookup.fits(lex)
    df = spark.range(2000).selectExpr("concat('Word', id, repeat('-', 100)) AS t", "id")
    for even in (True, False):
        out = lookup.lookup_join(df, lex, [(F.col("t"), "word")], even=even)
        assert out.where("pos = 'NOUN'").count() == 2000
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan


def test_lookup_of_some_megabytes_does_not_pass_the_driver(spark):
    """20,000 words are some 2 MB of values; as a broadcast the driver would hold several times that."""
    from errata.operators import lookup
    lex = unique_words(spark.range(20_000).selectExpr("concat('Word', id) AS word", "'NOUN' AS pos", "lower(word) AS lemma"))
    assert 1 << 20 < lookup.measured_bytes(lex) < 4 << 20 and not lookup.fits(lex)
    df = spark.range(3000).selectExpr("concat('Word', id) AS t", "id")
    out = tag_tokens(df, "t", lex, even=True)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" not in plan and out.where("pos = 'NOUN'").count() == 3000


def test_written_tables_release_what_made_them(spark, monkeypatch):
    """The driver's garbage holds shuffle files and broadcasts: it goes once a table is written."""
    from errata import session
    released = []
    monkeypatch.setattr(session, "release", lambda s: released.append(s))
    assert session.materialise(spark.range(5), "five").count() == 5 and released == [spark]
