"""Labelled sequences and token rows by chunks, against the same steps over rows of words."""

import random

import pytest
from pyspark.sql import functions as F

from errata.constants import FIELD_SEP
from errata.operators import chunks
from errata.operators import features as ft
from errata.operators.lookup import unique_words
from errata.operators.tagging import tag_tokens
from errata.plans import wordscores as ws
from errata.session import materialise
from errata.sources import fixtures as fx

WORDS = ["go", "Go", "day", "Very", "", "qq", "x|", "wört", "\U0001f600a", "a,b", "THE", "ß.", "longer-word"]


@pytest.fixture(scope="module")
def docs(spark, tmp_path_factory):
    """Documents with repeated ids (equal texts, other texts, null texts), a null id and empty texts."""
    rnd = random.Random(3)
    text = lambda n: "".join(rnd.choice(WORDS) + rnd.choice(" \n ") for _ in range(n))[:-1]
    rows = [(i, text(rnd.randint(1, 120)), rnd.randint(0, 50), "web") for i in range(60)]
    rows += [rows[7], rows[11], (11, text(30), 4, "web"), (13, None, 1, None), (14, text(9), None, "web"), (None, text(20), 3, "web"),
             (100, "", 2, "web"), (101, None, 2, "web"), (102, " \n ", 2, "web")]
    path = tmp_path_factory.mktemp("docs")
    df = spark.createDataFrame(rows, "doc_id long, text string, n_chars long, source string")
    df.repartition(3).write.parquet(str(path / "documents.parquet"))
    return str(path)


def _rows(df):
    return sorted(map(str, map(tuple, df.collect())))


def _by_rows(spark, docs):
    m = ws.masked_word_labels(spark, docs)
    g = m.groupBy("essay_id").agg(F.array_sort(F.collect_list(F.struct("i", "w", "label"))).alias("_t"))
    ess = fx.fx_essays(spark, docs).select("essay_id", F.left("cefr", F.lit(2)).alias("cefr"))
    return g.join(ess, "essay_id").select(
        F.concat(F.lit("fx_"), F.col("essay_id").cast("string")).alias("seq_id"),
        F.array_join(F.transform("_t", lambda x: x["w"]), FIELD_SEP).alias("token_seq"),
        F.array_join(F.transform("_t", lambda x: x["label"]), FIELD_SEP).alias("label_seq"), "cefr", F.col("essay_id").alias("row_i"))


def test_placed_words_are_those_of_the_window(spark, docs):
    assert _rows(fx.fx_placed(spark, docs)) == _rows(fx.fx_toks(spark, docs))
    counts = fx.fx_word_counts(spark, docs).groupBy("w").agg(F.sum("n").alias("n"))
    assert _rows(counts) == _rows(fx.fx_toks(spark, docs).groupBy("w").agg(F.count(F.lit(1)).alias("n")))


@pytest.mark.parametrize("chunk", [50, 1000, 1 << 30])
def test_labelled_sequences_by_chunks(spark, docs, monkeypatch, chunk):
    monkeypatch.setattr(chunks, "CHUNK", chunk)
    want = _rows(_by_rows(spark, docs))
    assert len(want) > 60 and _rows(ws.labelled_sequences(spark, docs)) == want


def test_no_place_of_a_word_is_sorted_or_shuffled(spark, docs):
    """12 times the input was on disk, as words were rows in four shuffles and three sorts."""
    plan = ws.labelled_sequences(spark, docs)._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "posexplode" not in plan and "split(" not in plan


def _sequences(spark):
    rnd = random.Random(9)
    rows = [(f"s{i}", FIELD_SEP.join(rnd.choice(WORDS) for _ in range(rnd.randint(1, 40))), None, "B1", i) for i in range(50)]
    rows = [(s, t, FIELD_SEP.join(rnd.choice(["true", "false", "NONE"]) for _ in range(t.count(FIELD_SEP) + rnd.choice([0, 1, 1, 3]))), c, i)
            for s, t, _, c, i in rows]
    rows += [("n", "a|||b", None, "B1", 90), (None, "go||||day", "true|||false", None, 91), ("e", "", "", "A1", None), ("z", None, "true", "A1", 3),
             rows[5], ("twice", "x|||y|||go", "true|||true|||NONE", "C1", 5)]
    return materialise(spark.createDataFrame(rows, "seq_id string, token_seq string, label_seq string, cefr string, row_i long").repartition(3), "t-seqs")


def _lexicon(spark):
    return unique_words(spark.createDataFrame([("go", "VERB", "go"), ("day", "NOUN", "day"), ("very", "ADV", "very"), ("the", "DET", "the")],
                                              "word string, pos string, lemma string"))


@pytest.mark.parametrize("chunk", [40, 1 << 30])
def test_tagged_rows_by_chunks(spark, monkeypatch, chunk):
    monkeypatch.setattr(chunks, "CHUNK", chunk)
    seqs, lexicon = _sequences(spark), _lexicon(spark)
    got, want = ft.tagged_rows(seqs, lexicon), tag_tokens(ft.token_rows(seqs), "token", lexicon)
    assert _rows(got.select(want.columns)) == _rows(want)
    assert [got.schema[c].dataType for c in want.columns] == [f.dataType for f in want.schema]


def _tables(spark):
    psy = spark.createDataFrame([("go", "VERB", 2.5, 3.0), ("very", "ADV", None, 4.0)], "word string, pos string, freq_pm double, aoa double")
    cefr = spark.createDataFrame([("day", "NOUN", 1), ("qq", "X", 5)], "word string, pos string, cefr_j int")
    zipf = spark.createDataFrame([("go", 9, 4.5), ("ab", 1, 1.0)], "word string, n long, zipf double")
    return _lexicon(spark), *[materialise(t, "t-table") for t in (psy, cefr, zipf)]


@pytest.mark.parametrize("chunk", [40, 1 << 30])
def test_features_come_in_order(spark, monkeypatch, chunk):
    """Sorted as sequences; ties of row_i (two sequences of one number) are ordered by feature_i."""
    monkeypatch.setattr(chunks, "CHUNK", chunk)
    seqs, tables = _sequences(spark), _tables(spark)
    out = ft.sort_features(seqs, *tables)
    got = out.collect()
    place = [(r.row_i is not None, r.row_i or 0, r.feature_i) for r in got]
    assert place == sorted(place) and out.columns == ft.FEATURE_COLUMNS
    rows = ft.with_word_features(ft.token_rows(seqs), *tables)
    want = rows.select("character_length", "frequency", "first_upper", "all_upper", "sequence_length", F.col("seq_id").alias("sequence_id"),
                       "token", "pos", "cefr", F.col("_cj_cefr_j").cast("double").alias("cefr_j"), F.col("_psy_freq_pm").alias("freq_pm"),
                       F.col("_psy_aoa").alias("aoa"), *ft.pos_flags(F.col("pos")), "label", F.col("row_i").cast("bigint"),
                       F.col("feature_i").cast("int"))
    assert sorted(map(str, map(tuple, got))) == _rows(want)
    assert _rows(ft.featurise(seqs, *tables)) == _rows(want)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.index("MapInArrow") < plan.index("Exchange")


def test_streamed_features_are_those_of_a_batch(spark):
    """Micro-batches of one file each; a second run adds the files that came since."""
    from errata.session import scratch_path
    from errata.sources import files as io
    from errata.streaming import features as stream

    seqs, tables = _sequences(spark).where("seq_id IS NOT NULL AND label_seq IS NOT NULL AND token_seq IS NOT NULL"), _tables(spark)
    src, out, ck = (scratch_path(spark, f"t-features-{n}") for n in ("in", "out", "ckpt"))
    parts = [F.col("row_i") % 3 == 0, F.col("row_i") % 3 == 1, (F.col("row_i") % 3 == 2) | F.col("row_i").isNull()]
    for k, part in enumerate(parts):
        io.write_tsv(seqs.where(part).select(*stream.SEQ_SCHEMA.replace(" string", "").replace(" bigint", "").split(", ")).coalesce(1), f"{src}/part{k}")
        if k:
            stream.run_features(spark, src + "/*", out, ck, *tables, max_files=1)
    assert spark.read.parquet(out).select("batch").distinct().count() == 3
    got = stream.read_features(spark, out)
    assert got.columns == ft.FEATURE_COLUMNS and _rows(got) == _rows(ft.featurise(materialise(seqs, "t-seqs"), *tables))


def test_streams_count_tokens_before_they_are_looked_up(spark):
    """every place of a word was a row of the join, next to four copies of the lexicon."""
    from errata.session import scratch_path
    from errata.sources import files as io
    from errata.streaming import features as stream

    src = scratch_path(spark, "t-scores-in")
    io.write_tsv(_sequences(spark).select("seq_id", "token_seq", "label_seq", "cefr", "row_i"), src)
    plan = stream.score_stream(spark, src, _lexicon(spark))._jdf.queryExecution().analyzed().toString()
    assert "posexplode" not in plan and "_ts" not in plan
    assert plan.index("Join") < plan.index("MapInArrow")


def _mask_by_rows(blocks, lexicon, key):
    from errata.operators.labels import mask_label
    x = blocks.select(*key, F.posexplode(F.arrays_zip("tokens", "labels")).alias("i", "t"))
    x = tag_tokens(x.select(*key, "i", F.col("t.tokens").alias("tok"), F.col("t.labels").alias("label")), "tok", lexicon)
    x = x.withColumn("label", mask_label(F.col("label"), F.col("pos")))
    g = x.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("i", "label"))).alias("_l"))
    return blocks.drop("labels").join(g.select(*key, F.transform("_l", lambda r: r["label"]).alias("labels")), key, "left")


@pytest.mark.parametrize("chunk", [60, 1 << 30])
def test_block_labels_are_masked_by_chunks(spark, monkeypatch, chunk):
    """blocks of a key of their own, repeated keys and null keys; no token becomes a row of a shuffle."""
    from errata.plans import dataset as dsp
    monkeypatch.setattr(chunks, "CHUNK", chunk)
    rnd = random.Random(2)
    toks = [[rnd.choice(WORDS[:4] + WORDS[5:]) for _ in range(rnd.randint(1, 20))] for _ in range(40)]
    rows = [(f"f{i % 3}", i, t, [rnd.choice(["true", "false"]) for _ in t], "B1") for i, t in enumerate(toks)]
    rows += [rows[4], ("f1", 7, ["go", "day"], ["true", "true"], None), (None, 3, ["go"], ["true"], "A1"), ("f0", None, ["day"], ["false"], "A1")]
    blocks = materialise(spark.createDataFrame(rows, "file string, block_no int, tokens array<string>, labels array<string>, cefr string").repartition(3), "t-blocks")
    got, want = dsp.mask_block_labels(blocks, _lexicon(spark), ["file", "block_no"]), _mask_by_rows(blocks, _lexicon(spark), ["file", "block_no"])
    assert got.columns == blocks.columns and _rows(got.select(want.columns)) == _rows(want)
    assert "posexplode" not in got._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("line, want", [
    ("A 0 1|||R:VERB|||x y|||REQUIRED|||-NONE-|||0", (0, 1, "R:VERB", ["x", "y"], "0")),
    ("A  3\t4 |||U||||||REQUIRED|||-NONE-|||12", (3, 4, "U", [], "12")),
    ("A 3 4|||U||||x|||REQUIRED|||-NONE-|||1", (3, 4, "U", ["|x"], "1")),
    ("A 3 4|||U|||x|||y|||REQUIRED|||-NONE-|||1", (3, 4, "U", ["x|||y"], "1")),
    ("A 3 4|||U|||x ||||REQUIRED|||-NONE-|||1", (3, 4, "U", ["x", "|"], "1")),
    ("A 3 4|||U|||x|||REQUIRED|||-NONE-|||1|", (3, 4, "U", ["x"], "1|")),
    ("A 3 4|||U|||x　\x85 y|||other|||7", (3, 4, "U", ["x", "y"], "7")),
    ("A 3 4", (3, 4, None, [], "A 3 4")),
])
def test_edit_lines_in_every_form(spark, line, want):
    from errata.operators import m2
    r = spark.createDataFrame([(line,)], "line string").select(F.expr(m2.parse_edit_sql("line")).alias("p")).first().p
    assert (r.start, r.end, r.cat, r.cor, r.coder) == want


def test_block_lines_are_made_once(spark):
    """Lines were cut again for the filter, and each line's patterns compiled at every split."""
    from errata.operators import m2
    parsed = m2.parse_blocks(spark.createDataFrame([("S a  b \n\n A 0 1|||R|||x|||REQUIRED|||-NONE-|||0 \n",), (" \n",)], "value string"))
    assert [(r.tokens, len(r.edits), r.edits[0].coder) for r in parsed.collect()] == [(["a", "b"], 1, "0")]
    plan = parsed._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(value") == 1
