"""Dense numbers, streaming scores across a restart, counts of what is lost, bars in corrections."""

import random

import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from errata.operators import m2, scores, splits
from errata.operators import paragraphs as pg
from errata.operators.lookup import unique_words
from errata.operators.features import token_rows
from errata.operators.numbering import dense_numbers
from errata.operators.sentences import sentences
from errata.operators.tagging import tag_tokens
from errata.session import scratch_path
from errata.sources import files as io
from errata.streaming import features as stream


@pytest.mark.parametrize("partitions", [1, 7, 64])
def test_dense_numbers(spark, partitions):
    rnd = random.Random(partitions)
    keys = rnd.sample(range(100_000), 3000) + [None]
    df = spark.createDataFrame([(k, str(k)) for k in keys], "k long, v string").repartition(5)
    got = {r.k: r.n for r in dense_numbers(df, ["k"], "n", partitions).collect()}
    want = sorted(keys, key=lambda k: (k is not None, k or 0))
    assert got == {k: i for i, k in enumerate(want)}
    assert dense_numbers(df.limit(0), ["k"]).count() == 0


def _sequences(spark, n, seed):
    rnd = random.Random(seed)
    words = ["go", "Go", "day", "very", "qq", "", "a,b", '"x"']
    rows = []
    for i in range(n):
        toks = [rnd.choice(words) or "w" for _ in range(rnd.randint(1, 9))]
        labs = [rnd.choice(["true", "false", "NONE"]) for _ in toks]
        rows.append((f"s{seed}_{i}", "|||".join(toks), "|||".join(labs), "B1", i))
    return spark.createDataFrame(rows, stream.SEQ_SCHEMA)


def test_stream_scores_survive_a_restart(spark):
    lexicon = unique_words(spark.createDataFrame([("go", "VERB", "go"), ("day", "NOUN", "day"), ("very", "ADV", "very")],
                                                 "word string, pos string, lemma string"))
    src, out, ck = (scratch_path(spark, n) for n in ("t-in", "t-out", "t-ckpt"))
    everything = None
    for k in range(3):
        seqs = _sequences(spark, 40, k)
        everything = seqs if everything is None else everything.union(seqs)
        io.write_tsv(seqs, f"{src}/part{k}")
        stream.run_scores(stream.score_stream(spark, src + "/*", lexicon, max_files=1), out, ck)
        want = scores.word_scores(tag_tokens(token_rows(everything), "token", lexicon))
        got = stream.latest_scores(spark, out)
        assert sorted(map(tuple, got.select(*want.columns).collect())) == sorted(map(tuple, want.collect()))
    assert spark.read.parquet(out).select("batch").distinct().count() >= 3


def test_lost_edits_and_paragraphs_are_counted(spark):
    one, two = "The first paragraph of this essay is long.", "The second paragraph of it is long, too."
    essays = spark.createDataFrame([(1, one + "\n" + two), (2, two)], "essay_id long, text string")
    edits = spark.createDataFrame([(1, 0, 0, 4, 9, "x", "R:ADJ"), (1, 0, 1, 36, 50, "y", "R:NOUN"), (2, 1, 0, 0, 3, "z", "R:DET")],
                                  "essay_id long, coder int, edit_no int, s long, e long, cor string, cat string")
    coders = spark.createDataFrame([(1, 0), (2, 1)], "essay_id long, coder int")
    lost, blocks = Observation(), Observation()
    rows = m2.with_lines(sentences(essays, edits, coders, lost))
    out = m2.m2_blocks(m2.classify_edits(rows, None, old_cats=True), blocks).collect()
    assert len(out) == 2 and lost.get == {"edits": 3, "crossing": 1}
    assert blocks.get == {"paragraphs": 3, "without_coder_0": 1}


@pytest.mark.parametrize("cor", [["For", "|"], ["|"], ["|", "|"], ["a", "|", "b"], [], ["x|||y"], ["REQUIRED"]])
def test_corrections_keep_their_bars(spark, cor):
    df = spark.createDataFrame([(["t"], [(0, 1, "R:OTHER", cor, "0")])],
                               "tokens array<string>, edits array<struct<start:int,end:int,cat:string,cor:array<string>,coder:string>>")
    back = m2.parse_blocks(m2.block_text(df).select("value")).first()
    assert [tuple(e) for e in back.edits] == [(0, 1, "R:OTHER", cor, "0")]


def test_long_essays_by_limit(spark):
    df = spark.createDataFrame([(1, "short"), (2, "x" * 30 + "\n" + "y" * 60), (3, "z" * 200), (4, "")], "essay_id long, text string")
    assert {(r.essay_id, r.max_len) for r in pg.long_essays(df, 50).collect()} == {(2, 60), (3, 200)}


def test_split_of_null_and_repeated_ids(spark):
    df = spark.createDataFrame([(None, 1), ("a", 1), ("b", 2), ("c", 3)], "g string, x int")
    out = splits.split_grouped(df.union(df), "g").collect()
    assert len(out) == 8 and len({(r.g, r.split) for r in out}) == 4 and sum(r.split == "test" for r in out) == 2
    with pytest.raises(Exception, match="ids must be unique"):
        splits.split_rows(df.union(df).withColumn("g", F.lit("same")), "g").collect()
    assert splits.split_rows(df.limit(0), "g", create_dev=True).count() == 0
