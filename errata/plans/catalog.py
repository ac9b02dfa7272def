"""Every registered query. Output columns are flat and aliased so that the
Spark result and the oracle SQL compare column by column."""

from __future__ import annotations

from pyspark.sql import functions as F

from errata.operators import features as ft
from errata.operators import scores as sc
from errata.operators.lookup import unique_words
from errata.plans import wordscores as ws
from errata.plans.registry import query
from errata.session import materialise
from errata.sources import fixtures as fx


@query("word_scores_e2e")
def q_word_scores_e2e(spark, sf_dir):
    return ws.word_scores_e2e(spark, sf_dir).select(
        "token", "pos", "n_seen", "n_true", "score")


def _zipf(spark, sf_dir):
    """A9 over the corpus words (the same words the sequences hold), read
    straight from the documents instead of re-deriving the sequences."""
    words = fx.fx_word_counts(spark, sf_dir).filter(F.length("w") > 0).select(F.col("w").alias("token"), "n")
    return ft.zipf_table(words, count="n")


def _lexicon(spark, sf_dir):
    return unique_words(fx.fx_lexicon(spark, sf_dir))


def _sequences(spark, sf_dir, lexicon=None):
    """The labelled sequences, written: they are read several times."""
    return materialise(ws.labelled_sequences(spark, sf_dir, lexicon), "sequences")


def _lookups(spark, sf_dir):
    """The four lookup tables, each written once; one pass counts the lexicon's words."""
    counted = materialise(fx.fx_lexicon(spark, sf_dir), "lexicon-counts")
    psy = ft.psy_lexicon(fx.fx_psy(spark, sf_dir, counted), "Word")
    cj = ft.cefr_lexicon(fx.fx_cefr_vocab(spark, sf_dir, counted), "word")
    return (unique_words(counted), materialise(psy, "lexicon-psy"), materialise(cj, "lexicon-cefr"),
            materialise(_zipf(spark, sf_dir), "lexicon-zipf"))


def _features(spark, sf_dir):
    """Feature rows, with lemma and stripped token for the narrow keys."""
    tables = _lookups(spark, sf_dir)
    return ft.featurise(_sequences(spark, sf_dir, tables[0]), *tables, keep=("lemma", "stripped"))


@query("features")
def q_features(spark, sf_dir):
    tables = _lookups(spark, sf_dir)
    return ft.sort_features(_sequences(spark, sf_dir, tables[0]), *tables)


@query("feat_token")
def q_feat_token(spark, sf_dir):
    return _features(spark, sf_dir).select("sequence_id", "feature_i", "token", "character_length",
                                           "stripped", "first_upper", "all_upper")


@query("feat_pos")
def q_feat_pos(spark, sf_dir):
    return _features(spark, sf_dir).select("sequence_id", "feature_i", "pos", "is_noun", "is_verb",
                                           "is_adjective", "is_adverb")


@query("feat_psy")
def q_feat_psy(spark, sf_dir):
    return _features(spark, sf_dir).select("sequence_id", "feature_i", "token", "lemma", "pos",
                                           "freq_pm", "aoa")


@query("feat_cefr")
def q_feat_cefr(spark, sf_dir):
    return _features(spark, sf_dir).select("sequence_id", "feature_i", "token", "lemma", "pos", "cefr_j")


@query("feat_zipf")
def q_feat_zipf(spark, sf_dir):
    return _features(spark, sf_dir).select("sequence_id", "feature_i", "token", "frequency")


@query("feat_seq_len")
def q_feat_seq_len(spark, sf_dir):
    return ft.token_rows(ws.labelled_sequences(spark, sf_dir)).select(
        F.col("seq_id").alias("sequence_id"), "sequence_length").distinct()


@query("token_rows")
def q_token_rows(spark, sf_dir):
    return ft.token_rows(ws.labelled_sequences(spark, sf_dir)).select(
        F.col("seq_id").alias("sequence_id"), F.col("feature_i").cast("int").alias("feature_i"),
        "token", "label")


@query("tag_tokens")
def q_tag_tokens(spark, sf_dir):
    return _tagged(spark, sf_dir).select(
        F.col("seq_id").alias("sequence_id"), F.col("feature_i").cast("int").alias("feature_i"),
        "token", "pos", "lemma")


@query("zipf_table")
def q_zipf_table(spark, sf_dir):
    return _zipf(spark, sf_dir)


@query("lex_psy")
def q_lex_psy(spark, sf_dir):
    return ft.psy_lexicon(fx.fx_psy(spark, sf_dir), "Word")


@query("lex_cefr")
def q_lex_cefr(spark, sf_dir):
    return ft.cefr_lexicon(fx.fx_cefr_vocab(spark, sf_dir), "word")


@query("lex_dedupe")
def q_lex_dedupe(spark, sf_dir):
    cj = ft.cefr_lexicon(fx.fx_cefr_vocab(spark, sf_dir), "word")
    keyed = cj.select(F.lower("word").alias("key"), "pos", "cefr_j", F.col("word").alias("source_word"))
    out = ft.last_per_key(keyed, ["key", "pos"], "source_word")
    return out.select(F.col("key").alias("word"), "pos", "cefr_j", "source_word")


def _tagged(spark, sf_dir):
    """Token rows with part of speech and lemma: all that a word score is made of."""
    lexicon = _lexicon(spark, sf_dir)
    return ft.tagged_rows(_sequences(spark, sf_dir, lexicon), lexicon)


@query("word_counts")
def q_word_counts(spark, sf_dir):
    return sc.word_counts(_tagged(spark, sf_dir))


@query("word_scores")
def q_word_scores(spark, sf_dir):
    return sc.word_scores(_tagged(spark, sf_dir))


@query("word_scores_ordered")
def q_word_scores_ordered(spark, sf_dir):
    rows = _tagged(spark, sf_dir).withColumn("feature_i", F.col("feature_i").cast("int"))
    s = sc.word_scores_ordered(rows, ["row_i", "feature_i"])
    return s.select("token", "pos", "n_seen", "n_true", "score",
                    F.col("first_seen.row_i").alias("first_row_i"),
                    F.col("first_seen.feature_i").alias("first_feature_i"))


@query("seq_rows")
def q_seq_rows(spark, sf_dir):
    return ws.labelled_sequences(spark, sf_dir)


@query("mask_labels")
def q_mask_labels(spark, sf_dir):
    return ws.masked_word_labels(spark, sf_dir).select(
        "essay_id", F.col("i").cast("bigint").alias("i"), F.col("w").alias("token"), "pos", "label")


@query("cefr_level")
def q_cefr_level(spark, sf_dir):
    return fx.fx_essays(spark, sf_dir).select("essay_id", F.left(F.col("cefr"), F.lit(2)).alias("cefr"))


# ---------------------------------------------------------------- text layer
from errata.functions.text import normalise_punct  # noqa: E402
from errata.operators import edits as ed  # noqa: E402
from errata.operators import paragraphs as pg  # noqa: E402


def _norm(df):
    return df.withColumn("text", normalise_punct(F.col("text")))


def _dirty_paras(spark, sf_dir, normalise=True):
    d = fx.fx_dirty(spark, sf_dir)
    return pg.paragraph_rows(_norm(d) if normalise else d, ["essay_id"])


@query("norm_punct")
def q_norm_punct(spark, sf_dir):
    return _norm(fx.fx_dirty(spark, sf_dir)).select("essay_id", "text")


@query("paragraphs")
def q_paragraphs(spark, sf_dir):
    return _dirty_paras(spark, sf_dir)


@query("line_offsets")
def q_line_offsets(spark, sf_dir):
    d = pg.with_line_offsets(_norm(fx.fx_dirty(spark, sf_dir)))
    return d.select("essay_id", F.explode("lines").alias("l")).select("essay_id", "l.*")


@query("max_para_len")
def q_max_para_len(spark, sf_dir):
    d = pg.with_paragraphs(fx.fx_dirty(spark, sf_dir))
    return d.select("essay_id", pg.max_paragraph_length().alias("max_len"))


@query("long_essays")
def q_long_essays(spark, sf_dir):
    return pg.long_essays(fx.fx_dirty(spark, sf_dir)).select("essay_id", "max_len")


def _dirty_clean(spark, sf_dir):
    return pg.with_clean(_dirty_paras(spark, sf_dir))


@query("clean_para")
def q_clean_para(spark, sf_dir):
    return (_dirty_clean(spark, sf_dir).filter(F.col("clean") != "")
            .select("essay_id", "para_no", F.col("clean").alias("para"), "lead"))


def _ws_offsets(df):
    """``offs``: both ends of the text and of every blank, in order."""
    from errata.functions.letbind import let
    # A blank, and what follows one, becomes a B: an offset costs one comparison.
    marks = "split(regexp_replace(regexp_replace(para_ws, '[^ ]', '.'), ' |(?<= )[.]', 'B'), '')"
    inner = "IF(size(v.bl) > 1, filter(sequence(1, size(v.bl) - 1), o -> v.bl[o] = 'B'), CAST(array() AS array<int>))"
    offs = let([("bl", marks)], f"IF(v.bl IS NULL, NULL, concat(array(0), {inner}, array(size(v.bl))))")
    return df.withColumn("offs", F.expr(offs))


@query("remap_offsets")
def q_remap_offsets(spark, sf_dir):
    d = _ws_offsets(_dirty_clean(spark, sf_dir))
    d = d.withColumn("o", F.explode("offs"))
    return d.select("essay_id", "para_no", "o", F.expr(pg.remap_sql("o")).alias("o_clean"))


@query("trim_spans")
def q_trim_spans(spark, sf_dir):
    d = _ws_offsets(_dirty_clean(spark, sf_dir))
    d = d.withColumn("blanks", F.split(F.regexp_replace("clean", "[^ ]", "."), ""))
    d = d.withColumn("k", F.explode(F.expr("sequence(0, size(offs) - 2)")))
    d = d.filter((F.col("k") >= 0) & (F.col("k") < F.size("offs") - 1))
    d = d.withColumn("o_start", F.expr("offs[k]")).withColumn("o_end", F.expr("offs[k + 1]"))
    d = d.withColumn("s", F.expr(pg.remap_sql("o_start"))).withColumn("e", F.expr(pg.remap_sql("o_end")))
    d = d.withColumn("s", F.col("s").cast("int")).withColumn("e", F.col("e").cast("int"))
    return d.select("essay_id", "para_no", "o_start", "o_end", "s", "e",
                    F.expr(pg.trim_start_sql("s", "e", "blanks")).alias("s_trim"),
                    F.expr(pg.trim_end_sql("s", "e", "blanks")).alias("e_trim"))


@query("tokenise")
def q_tokenise(spark, sf_dir):
    d = pg.with_tokens(_dirty_clean(spark, sf_dir).filter(F.col("clean") != ""))
    z = F.arrays_zip(F.col("toks").alias("tok"), F.col("starts").alias("cs"), F.col("ends").alias("ce"))
    d = d.select("essay_id", "para_no", F.posexplode(z).alias("tok_i", "t"))
    return d.select("essay_id", "para_no", "tok_i", "t.tok", "t.cs", "t.ce")


@query("para_rows")
def q_para_rows(spark, sf_dir):
    return _sents(spark, sf_dir).select("essay_id", "coder", "para_no")


@query("edit_kind")
def q_edit_kind(spark, sf_dir):
    e = ed.edit_kinds(fx.fx_edits(spark, sf_dir))
    return e.select("essay_id", "coder", F.col("edit_no").cast("bigint").alias("edit_no"),
                    "kind", "cat", "cor")


def _edits_in_paras(spark, sf_dir):
    bounds = ed.paragraph_bounds(_norm(fx.fx_essays(spark, sf_dir)))
    e = ed.edit_kinds(fx.fx_edits(spark, sf_dir))
    return ed.assign_paragraphs(e, bounds)


@query("edit_in_para")
def q_edit_in_para(spark, sf_dir):
    return _edits_in_paras(spark, sf_dir).select(
        "essay_id", "coder", F.col("edit_no").cast("bigint").alias("edit_no"), "para_no",
        F.col("s").cast("bigint").alias("s"), F.col("e").cast("bigint").alias("e"))


@query("drop_covered_detections")
def q_drop_covered_detections(spark, sf_dir):
    e = ed.drop_covered_detections(_edits_in_paras(spark, sf_dir), ["essay_id", "coder", "para_no"])
    return e.select("essay_id", "coder", "para_no",
                    F.col("edit_no").cast("bigint").alias("edit_no"), "kind")


# ---------------------------------------------------------------- edit layer
from errata.operators import m2 as m2op  # noqa: E402
from errata.operators.sentences import sentences as _sentences  # noqa: E402
from errata.plans import dataset as dsp  # noqa: E402


def _sents(spark, sf_dir):
    return _sentences(fx.fx_essays(spark, sf_dir), fx.fx_edits(spark, sf_dir), fx.fx_coders(spark, sf_dir))


def _spans(spark, sf_dir):
    s = _sents(spark, sf_dir)
    x = s.select("essay_id", "coder", "para_no", F.explode("spans_all").alias("x"))
    return x.select("essay_id", "coder", "para_no", F.col("x.edit_no").cast("bigint").alias("edit_no"),
                    F.col("x.kind").alias("kind"), F.col("x.s").alias("s"), F.col("x.e").alias("e"),
                    F.col("x.ts").alias("ts"), F.col("x.te").alias("te"), F.col("x.expanded").alias("expanded"))


@query("char_to_tok")
def q_char_to_tok(spark, sf_dir):
    return _spans(spark, sf_dir)


@query("edit_order")
def q_edit_order(spark, sf_dir):
    l = m2op.edit_lines(m2op.with_lines(_sents(spark, sf_dir), no_min=True))
    return l.select("essay_id", "coder", "para_no", F.col("edit_no").cast("bigint").alias("edit_no"),
                    F.col("rank").alias("m2_rank"))


def _tok_edits(spark, sf_dir):
    s = _sents(spark, sf_dir)
    x = s.select("essay_id", "coder", "para_no", F.explode("tok_edits").alias("t"))
    return x.select("essay_id", "coder", "para_no", "t.*").withColumn("edit_no", F.col("edit_no").cast("bigint"))


@query("drop_overlaps")
def q_drop_overlaps(spark, sf_dir):
    s = _sents(spark, sf_dir)
    x = s.select("essay_id", "coder", "para_no", F.explode("dropped").alias("edit_no"))
    return x.withColumn("edit_no", F.col("edit_no").cast("bigint"))


@query("fill_detection")
def q_fill_detection(spark, sf_dir):
    t = _tok_edits(spark, sf_dir).filter(F.col("kind") == "D")
    return t.select("essay_id", "coder", "para_no", "edit_no", "ts", "te",
                    F.array_join("cor_toks", " ").alias("cor"))


@query("expand_cor")
def q_expand_cor(spark, sf_dir):
    t = _tok_edits(spark, sf_dir).filter(F.col("expanded"))
    return t.select("essay_id", "coder", "para_no", "edit_no", "cor_text")


@query("cor_spans")
def q_cor_spans(spark, sf_dir):
    return _tok_edits(spark, sf_dir).select("essay_id", "coder", "para_no", "edit_no", "ts", "te",
                                            "c_start", "c_end")


@query("apply_edits")
def q_apply_edits(spark, sf_dir):
    s = _sents(spark, sf_dir)
    return s.select("essay_id", "coder", "para_no", F.array_join("orig", " ").alias("orig"),
                    F.array_join("cor", " ").alias("cor"))


@query("apply_counts")
def q_apply_counts(spark, sf_dir):
    s = _sents(spark, sf_dir)
    delta = F.aggregate("tok_edits", F.lit(0), lambda acc, t: acc + F.size(t["cor_toks"]) - (t["te"] - t["ts"]))
    return s.select("essay_id", "coder", "para_no", F.size("orig").alias("n_orig"),
                    F.size("cor").alias("n_cor"), delta.alias("delta"))


def _lines(spark, sf_dir):
    """Sentence rows with classified lines."""
    rows = materialise(m2op.with_lines(_sents(spark, sf_dir)), "sentence-lines")
    return m2op.classify_edits(rows, _lexicon(spark, sf_dir))


@query("minimise")
def q_minimise(spark, sf_dir):
    l = m2op.edit_lines(m2op.with_lines(_sents(spark, sf_dir)))
    return l.select("essay_id", "para_no", "coder", "rank", F.col("edit_no").cast("bigint").alias("edit_no"), "kind",
                    "o_start", "o_end", "c_start", "c_end", F.array_join("o_toks", " ").alias("o_str"),
                    F.array_join("c_toks", " ").alias("c_str"))


@query("classify_edits")
def q_classify_edits(spark, sf_dir):
    return m2op.edit_lines(_lines(spark, sf_dir)).select(
        "essay_id", "para_no", "coder", "rank", F.col("edit_no").cast("bigint").alias("edit_no"), "type")


def _blocks(spark, sf_dir):
    return m2op.m2_blocks(_lines(spark, sf_dir))


@query("noop_rows")
def q_noop_rows(spark, sf_dir):
    b = _blocks(spark, sf_dir)
    x = b.select("essay_id", "para_no", F.explode("edits").alias("a")).filter(F.col("a.cat") == "noop")
    return x.select("essay_id", "para_no", F.col("a.coder").alias("coder"))


@query("coder0_sents")
def q_coder0_sents(spark, sf_dir):
    b = _blocks(spark, sf_dir)
    return b.select("essay_id", "para_no", F.concat_ws(" ", F.lit("S"), F.array_join("tokens", " ")).alias("s_line"))


@query("coder_align")
def q_coder_align(spark, sf_dir):
    """Coders of each block, as the blocks list them."""
    b = _blocks(spark, sf_dir).select("essay_id", "para_no", F.explode(F.array_distinct(
        F.transform("edits", lambda a: a["coder"].cast("int")))).alias("coder"))
    return b


@query("m2_text")
def q_m2_text(spark, sf_dir):
    return m2op.block_text(_blocks(spark, sf_dir)).select("essay_id", "para_no", "value")


@query("invert")
def q_invert(spark, sf_dir):
    inv = m2op.invert_blocks(_blocks(spark, sf_dir))
    return m2op.block_text(inv).select("essay_id", "para_no", "value")


@query("label_tokens")
def q_label_tokens(spark, sf_dir):
    inv = m2op.block_labels(m2op.invert_blocks(_blocks(spark, sf_dir)))
    return inv.select("essay_id", "para_no", F.array_join("tokens", "|||").alias("token_seq"),
                      F.array_join("labels", "|||").alias("label_seq"))


@query("dataset_e2e")
def q_dataset_e2e(spark, sf_dir):
    return dsp.dataset_from_essays(fx.fx_essays(spark, sf_dir), fx.fx_edits(spark, sf_dir),
                                   _lexicon(spark, sf_dir), fx.fx_coders(spark, sf_dir))


def _edit_rows_from_fixture(spark, sf_dir):
    e = fx.fx_edits(spark, sf_dir)
    cor = F.filter(F.split(F.coalesce("cor", F.lit("")), " +"), lambda t: t != "")
    return e.select("essay_id", "coder", F.col("edit_no").cast("bigint").alias("edit_no"), F.struct(
        F.col("s").cast("int").alias("start"), F.col("e").cast("int").alias("end"),
        F.coalesce("cat", F.lit("D")).alias("cat"), cor.alias("cor"),
        F.col("coder").cast("string").alias("coder")).alias("a"))


@query("fmt_edit")
def q_fmt_edit(spark, sf_dir):
    x = _edit_rows_from_fixture(spark, sf_dir)
    return x.select("essay_id", "coder", "edit_no", F.expr(m2op.format_edit_sql("a")).alias("line"))


@query("parse_edit")
def q_parse_edit(spark, sf_dir):
    x = _edit_rows_from_fixture(spark, sf_dir)
    x = x.withColumn("line", F.expr(m2op.format_edit_sql("a")))
    p = x.withColumn("p", F.expr(m2op.parse_edit_sql("line")))
    return p.select("essay_id", "coder", "edit_no", F.col("p.start").alias("start"), F.col("p.end").alias("end"),
                    F.col("p.cat").alias("cat"), F.array_join("p.cor", " ").alias("cor"),
                    F.col("p.coder").alias("coder_field"))


@query("parse_sent")
def q_parse_sent(spark, sf_dir):
    e = fx.fx_essays(spark, sf_dir).select("essay_id", F.concat(F.lit("S "), F.col("text")).alias("value"))
    p = m2op.parse_blocks(e.withColumn("value", F.regexp_replace("value", "\n", " ")))
    return p.select("essay_id", F.size("tokens").cast("int").alias("n_tokens"),
                    F.array_join("tokens", " ").alias("tokens"))


@query("edits_by_coder")
def q_edits_by_coder(spark, sf_dir):
    e = ed.edit_kinds(fx.fx_edits(spark, sf_dir))
    g = e.groupBy("essay_id", "coder").agg(F.count(F.lit(1)).alias("n_edits"),
                                           F.array_sort(F.collect_list("edit_no")).alias("_l"))
    return g.select("essay_id", "coder", "n_edits",
                    F.array_join(F.transform("_l", lambda v: v.cast("string")), ",").alias("edit_nos"))


# ---------------------------------------------------------------- files, splits, stream
from errata.operators import splits as spl  # noqa: E402
from errata.session import release, scratch_path  # noqa: E402
from errata.sources import files as io  # noqa: E402

SEQ_SCHEMA = "seq_id string, token_seq string, label_seq string, cefr string, row_i bigint"


def _essay_files(spark, sf_dir):
    path = scratch_path(spark, "essays-json")
    io.write_essays_json(fx.fx_files(spark, sf_dir), fx.fx_edits(spark, sf_dir), fx.fx_coders(spark, sf_dir), path)
    return path


@query("src_essays")
def q_src_essays(spark, sf_dir):
    essays, coders, edits = io.read_essays_json(spark, _essay_files(spark, sf_dir))
    x = essays.join(coders, "essay_id").join(edits, ["essay_id", "coder"], "left")
    return x.select("file", "line_no", "coder", F.col("edit_no").cast("bigint").alias("edit_no"), "s", "e", "cor", "cat")


@query("src_glob")
def q_src_glob(spark, sf_dir):
    essays, _, _ = io.read_essays_json(spark, _essay_files(spark, sf_dir) + "/file=g*[0-9]/part-*")
    return essays.groupBy("file").agg(F.count(F.lit(1)).alias("n_essays"))


def _file_blocks(spark, sf_dir):
    of = fx.fx_files(spark, sf_dir).select("essay_id", "file", F.left("cefr", F.lit(2)).alias("cefr"))
    return materialise(_blocks(spark, sf_dir).join(of, "essay_id"), "file-blocks")


def _m2_files(spark, sf_dir):
    path = scratch_path(spark, "m2")
    io.write_m2(_file_blocks(spark, sf_dir), path, ["essay_id", "para_no"])
    return path


@query("snk_m2")
def q_snk_m2(spark, sf_dir):
    return spark.read.option("lineSep", "\n\n").text(_m2_files(spark, sf_dir)).select("file", "value")


@query("src_m2")
def q_src_m2(spark, sf_dir):
    b = io.read_m2(spark, _m2_files(spark, sf_dir))
    return b.select("file", "block_no", F.array_join("tokens", " ").alias("tokens"), F.size("edits").alias("n_edits"))


@query("block_no")
def q_block_no(spark, sf_dir):
    inv = m2op.invert_blocks(io.read_m2(spark, _m2_files(spark, sf_dir)))
    return inv.select("file", "block_no", (F.size("tokens") > 0).alias("kept"))


@query("cefr_attach")
def q_cefr_attach(spark, sf_dir):
    blocks = _file_blocks(spark, sf_dir)
    m2path, cpath = scratch_path(spark, "m2"), scratch_path(spark, "cefr")
    io.write_m2(blocks, m2path, ["essay_id", "para_no"])
    io.write_cefr_list(blocks, cpath, ["essay_id", "para_no"])
    b = io.attach_cefr(io.read_m2(spark, m2path), spark, cpath)
    return b.select("file", "block_no", F.array_join("tokens", " ").alias("tokens"), "cefr")


@query("dataset_files")
def q_dataset_files(spark, sf_dir):
    """Essay files to labelled sequences, by way of M2 and CEFR files."""
    out = dsp.dataset_from_files(spark, _essay_files(spark, sf_dir), _lexicon(spark, sf_dir), scratch_path(spark, "m2"),
                                 scratch_path(spark, "cefr"), scratch_path(spark, "m2-inverted"))
    return out.select("seq_id", "token_seq", "label_seq", "cefr")


def _seqs_tsv(spark, sf_dir, name="seqs", lexicon=None):
    path = scratch_path(spark, name)
    # Written before: sorting by ranges looks at its rows twice.
    io.write_tsv(_sequences(spark, sf_dir, lexicon), path, ["row_i"])
    release(spark)
    return path


@query("snk_tsv")
def q_snk_tsv(spark, sf_dir):
    """The written lines; every part file starts with the header."""
    lines = spark.read.text(_seqs_tsv(spark, sf_dir))
    return lines.filter(F.col("value") != "\t".join(c.split()[0] for c in SEQ_SCHEMA.split(", ")))


@query("src_tsv")
def q_src_tsv(spark, sf_dir):
    return io.read_tsv(spark, _seqs_tsv(spark, sf_dir), SEQ_SCHEMA)


@query("src_tsv_nohdr")
def q_src_tsv_nohdr(spark, sf_dir):
    path = scratch_path(spark, "seqs-nohdr")
    io.write_tsv(ws.labelled_sequences(spark, sf_dir), path, header=False)
    return io.read_tsv(spark, path, header=False)


@query("combine")
def q_combine(spark, sf_dir):
    """Two TSV sets (the train and test parts) read back as one."""
    seqs = spl.split_rows(_sequences(spark, sf_dir), "seq_id", ids=ws.sequence_ids(spark, sf_dir))
    a, b = scratch_path(spark, "part-train"), scratch_path(spark, "part-test")
    io.write_tsv(seqs.filter(F.col("split") == "train").drop("split"), a)
    io.write_tsv(seqs.filter(F.col("split") == "test").drop("split").drop("cefr"), b)
    out = io.combine_tsv(spark, [a, b], [SEQ_SCHEMA, "seq_id string, token_seq string, label_seq string, row_i bigint"])
    return out.select("seq_id", "token_seq", "label_seq", "cefr", "row_i")


@query("split_rows")
def q_split_rows(spark, sf_dir):
    return spl.split_rows(ws.sequence_ids(spark, sf_dir), "seq_id")


@query("split_dev")
def q_split_dev(spark, sf_dir):
    return spl.split_rows(ws.sequence_ids(spark, sf_dir), "seq_id", create_dev=True)


@query("split_grouped")
def q_split_grouped(spark, sf_dir):
    seqs = fx.fx_essays(spark, sf_dir).select(F.col("essay_id").cast("string").alias("seq_id"), "cefr")
    return spl.split_grouped(seqs, "cefr").select("seq_id", "cefr", "split")


@query("snk_scores")
def q_snk_scores(spark, sf_dir):
    path = scratch_path(spark, "scores")
    io.write_scores(sc.word_scores(_tagged(spark, sf_dir)), path)
    return spark.read.schema("key string, score double").json(path)


@query("stream_features")
def q_stream_features(spark, sf_dir):
    from errata.streaming.features import read_features, run_features
    tables = _lookups(spark, sf_dir)
    src = _seqs_tsv(spark, sf_dir, "stream-in", tables[0])
    out, ck = scratch_path(spark, "stream-out"), scratch_path(spark, "stream-ckpt")
    run_features(spark, src, out, ck, *tables)
    return read_features(spark, out)


@query("stream_word_scores")
def q_stream_word_scores(spark, sf_dir):
    """Two halves of the sequences arrive one after the other; the query stops between them."""
    from errata.streaming.features import latest_scores, run_scores, score_stream
    lexicon = _lexicon(spark, sf_dir)
    seqs = materialise(ws.labelled_sequences(spark, sf_dir, lexicon), "stream-seqs")
    src, out, ck = (scratch_path(spark, f"scores-{n}") for n in ("in", "out", "ckpt"))
    for half in (0, 1):
        io.write_tsv(seqs.filter(F.pmod(F.xxhash64("seq_id"), F.lit(2)) == half), f"{src}/half{half}")
        run_scores(score_stream(spark, src + "/*", lexicon), out, ck)
    return latest_scores(spark, out).select("token", "pos", "n_seen", "n_true", "score")


@query("word_scores_files")
def q_word_scores_files(spark, sf_dir):
    """U1 + A3: scores over several feature files (the train and test parts)."""
    tables = _lookups(spark, sf_dir)
    ids = ws.sequence_ids(spark, sf_dir)
    # A sequence for every row of its id, as ids may repeat.
    seqs = materialise(_sequences(spark, sf_dir, tables[0]).join(ids, "seq_id"), "sequences")
    feats = materialise(ft.featurise(seqs, *tables), "feature-rows")
    # The side follows from the id: no row of features is shuffled for it.
    parts = spl.split_rows(feats, "sequence_id", ids=ids.withColumnRenamed("seq_id", "sequence_id"))
    paths = {side: scratch_path(spark, f"features-{side}") for side in ("train", "test")}
    for side, path in paths.items():
        io.write_tsv(parts.filter(F.col("split") == side).drop("split"), path, compression="gzip")
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in feats.schema)
    return sc.word_scores(io.combine_tsv(spark, list(paths.values()), [schema] * 2)).select("token", "pos", "n_seen", "n_true", "score")


@query("dense_rows")
def q_dense_rows(spark, sf_dir):
    """Sequences numbered 0, 1, ... in the order of their ids."""
    from errata.operators.numbering import dense_numbers
    return dense_numbers(ws.sequence_ids(spark, sf_dir), ["seq_id"])


@query("lost_counts")
def q_lost_counts(spark, sf_dir):
    """What the way to M2 blocks loses, observed in the job that makes them:
    edits across paragraph bounds, and paragraphs without coder 0 (every
    twentieth essay is taken from that coder here)."""
    from pyspark.sql import Observation
    coders = fx.fx_coders(spark, sf_dir).filter((F.col("coder") != 0) | (F.col("essay_id") % 20 != 0))
    edits, blocks = Observation(), Observation()
    rows = m2op.with_lines(_sentences(fx.fx_essays(spark, sf_dir), fx.fx_edits(spark, sf_dir), coders, edits))
    made = m2op.m2_blocks(m2op.classify_edits(rows, None, old_cats=True), blocks)
    made.write.format("noop").mode("overwrite").save()
    seen = {**edits.get, **blocks.get}
    return spark.createDataFrame([(k, int(seen[k])) for k in sorted(seen)], "what string, n long")


@query("long_essay_report")
def q_long_essay_report(spark, sf_dir):
    """P18 from files: where the essays stand that have a paragraph over 1,000 code points."""
    essays, _, _ = io.read_essays_json(spark, _essay_files(spark, sf_dir))
    return pg.long_essays(essays, limit=1000).select("file", "line_no", "max_len")


@query("merge_ops")
def q_merge_ops(spark, sf_dir):
    from errata.operators.merge import merge_ops
    m = merge_ops(_sents(spark, sf_dir))
    return m.select("essay_id", "coder", "para_no", "strategy", F.col("o_start").cast("bigint").alias("o_start"),
                    F.col("o_end").cast("bigint").alias("o_end"), F.col("c_start").cast("bigint").alias("c_start"),
                    F.col("c_end").cast("bigint").alias("c_end"), "ops")
