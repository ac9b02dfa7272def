"""A sample of registered queries against their DuckDB oracle at sf0.001."""

import os
import sys

import duckdb
import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

SF = "/root/testdata/sf0.001"
SAMPLE = ["word_scores_e2e", "features", "paragraphs", "clean_para", "tokenise", "edit_in_para",
          "drop_covered_detections", "char_to_tok", "drop_overlaps", "cor_spans", "split_rows",
          "lex_psy", "fmt_edit", "parse_edit", "minimise", "classify_edits", "noop_rows", "m2_text", "invert",
          "label_tokens", "dataset_e2e", "dataset_files", "src_essays", "cefr_attach", "stream_features",
          "stream_word_scores", "dense_rows", "lost_counts", "long_essay_report", "split_dev", "snk_tsv", "merge_ops", "tag_tokens"]


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in ["documents"]:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", SAMPLE)
def test_query_matches_oracle(spark, con, name):
    import __spark_entry__ as entry
    from check_oracle import rows_of
    df = entry.queries()[name](spark, SF)
    res = con.execute(entry.oracle_sql()[name])
    dcols = [d[0] for d in res.description]
    assert sorted(df.columns) == sorted(dcols)
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == rows_of(dcols, res.fetchall())


def test_entry_runs(spark):
    import __spark_entry__ as entry
    df = entry.entry(spark)
    assert df.columns == ["token", "pos", "n_seen", "n_true", "score"]
    assert df.filter("n_true > n_seen OR n_true = 0 OR score <> n_true / n_seen").count() == 0
    assert df.count() > 100
