"""The pipeline's stages hand on what they should."""

import corpus_pipeline as cp

SF = "/root/testdata/sf0.001"


def test_stages_and_columns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    have, counts = docs.columns, [docs.count()]
    from errata.llm.common import written
    for k, (name, stage) in enumerate(cp.STAGES):
        out = written(stage(spark, docs, SF), "test")
        if k < len(cp.STAGES) - 1:
            assert out.columns == have, name
            assert dict(out.dtypes) == dict(docs.dtypes), name
            counts.append(out.count())
        before, docs = docs, out
    assert counts[1] < counts[0] and counts[2] <= counts[1] and counts[3] <= counts[2]
    # Every document of the mixed corpus is packed, whole.
    pieces = docs.groupBy("doc_id").count().count()
    assert pieces == before.select("doc_id").distinct().count()


def test_near_dedup_keeps_one_of_each_group(spark):
    from errata.llm import simhash
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    docs = docs.union(docs.where("doc_id % 3 = 0"))  # repeated rows
    groups = {r.component_id for r in simhash.near_duplicates(docs).collect()}
    kept = sorted(r.doc_id for r in simhash.keep_first(docs).collect())
    assert kept == sorted(groups)


def test_quality_keeps_clean_documents(spark):
    from errata.llm import quality
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    kept = quality.quality_filter(docs).select("doc_id").withColumnRenamed("doc_id", "k")
    judged = labels.join(docs.selectExpr("doc_id", "size(split(text, ' ')) AS words"), "doc_id")
    judged = judged.join(kept, judged["doc_id"] == kept["k"], "left").where("words >= 60")
    good = judged.where("quality = 1")
    bad = judged.where("quality = 0")
    assert good.where("k IS NULL").count() == 0
    assert bad.where("k IS NOT NULL").count() <= 0.02 * bad.count()


def test_empty_corpus(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in cp.STAGES:
        docs = stage(spark, docs, SF)
        assert docs.count() == 0
