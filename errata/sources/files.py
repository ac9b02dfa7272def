"""File sources and sinks: essays JSON, M2 text, TSV, CEFR lists, scores.

Written tables go to the shared folder named by ``spark.checkpoint.dir``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from errata.constants import PY_WS, PY_WS_BODY
from errata.functions.letbind import sql_str
from errata.operators import features
from errata.operators import m2 as m2op

ESSAY_SCHEMA = "text string, cefr string, edits array<array<string>>"
TSV_OPTS = {"sep": "\t", "header": "true", "quote": '"', "escape": '"', "emptyValue": ""}


# ------------------------------------------------------------------ file names
# A set of named files is a folder with one sub-folder ``file=<name>`` each, as
# Spark's writer lays out a partition column: the names are stable, and what is
# numbered within a file does not depend on how many tasks wrote it.
def _write_files(rows: DataFrame, path: str, order: list[str], line_sep: str = "\n") -> None:
    """``value`` of the rows, by ``file`` and in ``order`` within each."""
    (rows.repartition("file").sortWithinPartitions("file", *order).select("file", "value")
     .write.mode("overwrite").partitionBy("file").option("lineSep", line_sep).text(path))


def _numbered(raw: DataFrame, number: str) -> DataFrame:
    """S12 + W5: ``file`` (its name) and the row's number within it."""
    raw = m2op.number_in_file(raw.drop("file"), "_path", number)
    name = F.coalesce(F.nullif(F.regexp_extract("_path", "/file=([^/]+)/[^/]*$", 1), F.lit("")),
                      F.element_at(F.split("_path", "/"), -1))
    return raw.withColumn("file", name)


# ------------------------------------------------------------------ essays
def write_essays_json(essays: DataFrame, edits: DataFrame, coders: DataFrame, path: str) -> None:
    """Essays in the input format: text, cefr, edits = [[coder, [[s, e, cor, type]...]]...].

    ``essays`` has ``file``; ``coders`` names each essay's coders, those without
    edits included. One line per essay, in id order within a file.
    """
    e = edits.select("essay_id", F.col("coder").cast("int").alias("coder"), "edit_no", F.to_json(F.array(
        F.col("s").cast("string"), F.col("e").cast("string"), F.col("cor"), F.col("cat"))).alias("_j"))
    e = coders.select("essay_id", F.col("coder").cast("int").alias("coder")).join(e, ["essay_id", "coder"], "left")
    item = F.when(F.col("_j").isNotNull(), F.struct("edit_no", "_j"))
    per_coder = (e.groupBy("essay_id", "coder").agg(F.array_sort(F.collect_list(item)).alias("_l"))
                 .select("essay_id", F.struct("coder", F.concat(F.lit("["), F.array_join(
                     F.transform("_l", lambda r: r["_j"]), ","), F.lit("]")).alias("lst")).alias("c")))
    listed = (per_coder.groupBy("essay_id").agg(F.array_sort(F.collect_list("c")).alias("_c"))
              .select("essay_id", F.concat(F.lit("["), F.array_join(F.transform(
                  "_c", lambda c: F.concat(F.lit("["), c["coder"].cast("string"), F.lit(","), c["lst"],
                                           F.lit("]"))), ","), F.lit("]")).alias("edits_json")))
    quoted = lambda c: F.to_json(F.array(c)).substr(F.lit(2), F.length(F.to_json(F.array(c))) - 2)
    out = essays.join(listed, "essay_id", "left").select(
        "file", "essay_id", F.concat(F.lit('{"text":'), quoted("text"), F.lit(',"cefr":'), quoted("cefr"),
                                     F.lit(',"edits":'), F.coalesce("edits_json", F.lit("[]")), F.lit("}")).alias("value"))
    _write_files(out, path, ["essay_id"])


def read_essays_json(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """S1 + S2 + S12: (essays, coders, edits) from JSON lines.

    Blank lines are skipped by the reader. ``essay_id`` is a 128-bit digest of
    the file's name and the line's number within it; ``coders`` keeps coders
    whose edit list is empty. Each edit is [start, end, correction or null,
    optional type].
    """
    raw = _numbered(spark.read.schema(ESSAY_SCHEMA).json(path).select("*", "_metadata"), "line_no")
    raw = raw.withColumn("essay_id", F.md5(F.concat_ws("\n", "_path", F.col("line_no").cast("string"))))
    essays = raw.select("essay_id", "file", "line_no", "text", "cefr")
    c = raw.select("essay_id", F.posexplode("edits").alias("_ci", "_c"))
    c = c.select("essay_id", F.col("_c")[0].cast("int").alias("coder"),
                 F.from_json(F.col("_c")[1], "array<array<string>>").alias("_e"))
    coders = c.select("essay_id", "coder").distinct()
    e = c.select("essay_id", "coder", F.posexplode("_e").alias("edit_no", "_x"))
    edits = e.select("essay_id", "coder", "edit_no", F.col("_x")[0].cast("bigint").alias("s"),
                     F.col("_x")[1].cast("bigint").alias("e"), F.get(F.col("_x"), 2).alias("cor"),
                     F.get(F.col("_x"), 3).alias("cat"))
    return essays, coders, edits


# ------------------------------------------------------------------ M2
def write_m2(blocks: DataFrame, path: str, order: list[str]) -> None:
    """One block per record, blocks ended by a blank line, in ``order`` within each ``file``."""
    _write_files(m2op.block_text(blocks), path, order, "\n\n")


def read_m2(spark: SparkSession, path: str) -> DataFrame:
    """S3: blocks (file, block_no, tokens, edits); block numbers count from 0
    per file, in file order, including blocks later dropped as empty.

    A line of white space alone ends a block as an empty line does: records
    are cut at empty lines by the reader, and again at such lines.
    """
    raw = _numbered(spark.read.option("lineSep", "\n\n").text(path).select("value", "_metadata"), "_record")
    blank = sql_str(r"\n(?:" + PY_WS + r"*\n)+")
    parts = F.expr(f"filter(split(concat('\\n', value, '\\n'), {blank}, -1), b -> b RLIKE {sql_str('[^' + PY_WS_BODY + ']')})")
    # Numbers within a file: blocks of its earlier records, then place in the record.
    raw = raw.withColumn("_parts", parts).withColumn("_n", F.size("_parts"))
    more = raw.filter(F.col("_n") != 1).select(F.col("_path").alias("_p"), F.col("_record").alias("_r"),
                                               (F.col("_n") - 1).alias("_d"))
    # Only records that are not exactly one block shift the numbers after them.
    w = Window.partitionBy("_p").orderBy("_r")
    more = more.withColumn("_sum", F.sum("_d").over(w)).withColumn("_next", F.lead("_r").over(w))
    x = raw.join(more, (F.col("_path") == F.col("_p")) & (F.col("_record") > F.col("_r"))
                 & (F.col("_next").isNull() | (F.col("_record") <= F.col("_next"))), "left")
    x = x.select("file", (F.col("_record") + F.coalesce("_sum", F.lit(0))).alias("_first"), F.posexplode("_parts").alias("_k", "value"))
    x = x.withColumn("block_no", (F.col("_first") + F.col("_k")).cast("int"))
    return m2op.parse_blocks(x).select("file", "block_no", "tokens", "edits")


def write_cefr_list(blocks: DataFrame, path: str, order: list[str]) -> None:
    """S5 sink: the CEFR level of each block, as one JSON list per ``file`` (the
    format's own unit: a file's list is made by one task)."""
    g = blocks.groupBy("file").agg(F.array_sort(F.collect_list(F.struct(*order, "cefr"))).alias("_l"))
    out = g.select("file", F.to_json(F.transform("_l", lambda r: r["cefr"])).alias("value"))
    out.write.mode("overwrite").partitionBy("file").text(path)


def attach_cefr(blocks: DataFrame, spark: SparkSession, path: str) -> DataFrame:
    """S5 source: each file's list read back, joined to its blocks by number."""
    lst = _numbered(spark.read.option("wholetext", True).text(path).select("value", "_metadata"), "_n")
    lst = lst.select("file", F.posexplode(F.from_json("value", "array<string>")).alias("block_no", "cefr"))
    return blocks.join(lst, ["file", "block_no"], "left")


# ------------------------------------------------------------------ lexicons
def read_psy_lexicon(spark: SparkSession, path: str) -> DataFrame:
    """The age-of-acquisition file (tab separated, its own header)."""
    raw = _numbered(spark.read.options(**TSV_OPTS).csv(path).select("*", "_metadata"), "_row")
    return features.psy_lexicon(raw, "_row")


def read_cefr_lexicon(spark: SparkSession, path: str) -> DataFrame:
    """The level file (tab separated; the level's column is ``Cefr-j``)."""
    raw = _numbered(spark.read.options(**TSV_OPTS).csv(path).select("*", "_metadata"), "_row")
    return features.cefr_lexicon(raw.withColumnRenamed("Cefr-j", "cefr_j"), "_row")


# ------------------------------------------------------------------ TSV
def write_tsv(df: DataFrame, path: str, order: list[str] | None = None, header: bool = True,
              compression: str | None = None) -> None:
    """Header, tab separated, minimal quoting; plain text unless ``compression`` (``gzip``) is given."""
    out = df.orderBy(*order) if order else df
    out.write.mode("overwrite").options(**{**TSV_OPTS, "header": str(header).lower()}).csv(path, compression=compression or "none")


def combine_tsv(spark: SparkSession, paths: list[str], schemas: list[str | None], header: bool = True) -> DataFrame:
    """Several TSV sets as one table; columns a set lacks are null."""
    sets = [read_tsv(spark, p, s, header) for p, s in zip(paths, schemas)]
    out = sets[0]
    for other in sets[1:]:
        out = out.unionByName(other, allowMissingColumns=True)
    return out


def read_tsv(spark: SparkSession, path: str, schema: str | None = None,
             header: bool = True) -> DataFrame:
    """Strings stay strings (``NA``, ``None``); empty -> ''.

    Without a header the columns are named by position 0..n-1.
    """
    r = spark.read.options(**{**TSV_OPTS, "header": str(header).lower()})
    df = r.schema(schema).csv(path) if schema else r.csv(path)
    if not header:
        df = df.toDF(*[str(i) for i in range(len(df.columns))])
    return df.select(*[F.coalesce(F.col(c), F.lit("")).alias(c) if t == "string" else F.col(c)
                       for c, t in df.dtypes])


def write_scores(scores: DataFrame, path: str) -> None:
    """One JSON object per line, {"key": "token|||pos", "score": x}."""
    scores.select(F.concat_ws("|||", "token", "pos").alias("key"), "score") \
          .write.mode("overwrite").json(path)
