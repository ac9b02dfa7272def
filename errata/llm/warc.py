r"""WARC archives and their index, merged from sorted runs (operator 2).

Pages are written as WARC/1.1 records by Spark's text writer: record separators
are the four bytes that end every WARC record, so each part file is a valid
archive. Equal payloads are stored once: the record with the smallest page id
is the ``response``, the others are ``revisit`` records that refer to it.

The archives are read back as bytes and parsed by their Content-Length. Each
archive yields one run of index lines (CDX style) sorted by URL key and capture
time. The external merge deals the runs into key ranges, cut at quantiles of
all runs' keys; in a range, the runs are merged by a loser tree. Ranges follow
each other, so the whole index is one ordered list of capture histories. Cuts
are on (URL key, time, page id), so a hot URL spreads over several ranges.

Pages carry no capture time; ``date`` names a column for it, else a page is
taken ``page_id`` seconds after ``EPOCH``.

Defined results: a null html is an empty payload; a null url has the key of the
empty URL; null page ids count as largest and have an empty id header; rows
that repeat page id and payload are all responses where they are the first; an
empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from errata.llm.common import read_table, written
from errata.session import scratch_path

EPOCH = 1577836800  # 2020-01-01T00:00:00Z
END = "\r\n\r\n"
#: Equal payloads shorter than this are all stored.
MIN_REVISIT_BYTES = 0
#: Records in one archive file, at most.
ARCHIVE_RECORDS = 20_000
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Index rows of one key range, about.
RANGE_ROWS = 200_000
KEY = ["url_key", "captured", "page_id"]
# Digits of base 32 as Spark's conv() writes them, and RFC 4648's.
CONV_DIGITS = "0123456789ABCDEFGHIJKLMNOPQRSTUV"
BASE32_DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def sha1_base32(payload: Column) -> Column:
    """Bare upper-case base-32 SHA-1: 160 bits are four groups of eight digits."""
    h = F.sha1(payload)
    parts = [F.lpad(F.conv(F.substring(h, k, 10), 16, 32), 8, "0") for k in (1, 11, 21, 31)]
    return F.translate(F.concat(*parts), CONV_DIGITS, BASE32_DIGITS)


def url_key(url: Column) -> Column:
    """Sort key of a URL: host labels reversed and joined by commas, ``)``, the rest as is."""
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))
    rest = F.regexp_replace(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*", "")
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), F.lit(")"), rest)


def records(pages: DataFrame, min_revisit: int = MIN_REVISIT_BYTES, date: str | None = None) -> DataFrame:
    """One column ``value``: the WARC record of every row, without the final line ends."""
    payload = F.coalesce(F.col("html"), F.lit(""))
    when = F.col(date).cast("timestamp") if date else F.timestamp_seconds(F.lit(EPOCH) + F.coalesce("page_id", F.lit(0)))
    flat = pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.coalesce(F.col("url"), F.lit("")).alias("url"),
        payload.alias("payload"), when.alias("at"), F.octet_length(payload).alias("size"),
        sha1_base32(payload).alias("digest"))
    seen = flat.select("digest", "size", "page_id").where(F.col("size") >= min_revisit)
    first = (seen.groupBy("digest", "size").agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
             .where("n > 1").select(F.col("digest").alias("d"), F.col("size").alias("z"), "first"))
    first = written(first, "warc-first")
    full = flat.join(first, (F.col("digest") == F.col("d")) & (F.col("size") == F.col("z")), "left")
    revisit = F.col("first").isNotNull() & ~F.col("first").eqNullSafe(F.col("page_id"))
    # Ids and URLs stand in header lines: line ends in a URL are escaped.
    uri = F.regexp_replace(F.regexp_replace("url", "\r", "%0D"), "\n", "%0A")
    block = F.when(revisit, F.lit("")).otherwise(F.col("payload"))
    head = F.concat_ws(
        "\r\n", F.lit("WARC/1.1"),
        F.concat(F.lit("WARC-Type: "), F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))),
        F.concat(F.lit("WARC-Record-ID: <urn:page:"), F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.lit(">")),
        F.concat(F.lit("WARC-Target-URI: "), uri),
        F.concat(F.lit("WARC-Date: "), F.date_format(F.to_utc_timestamp("at", F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'")),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.col("digest")),
        F.when(revisit, F.concat(F.lit("WARC-Refers-To: <urn:page:"), F.col("first").cast("string"), F.lit(">"))),
        F.when(revisit, F.lit(f"WARC-Profile: {PROFILE}")),
        F.lit("Content-Type: text/html"),
        F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string")))
    return full.select(F.concat(head, F.lit(END), block).alias("value"))


def write_archives(pages: DataFrame, path: str, min_revisit: int = MIN_REVISIT_BYTES, date: str | None = None) -> None:
    """Archives under ``path``, one file per task and ARCHIVE_RECORDS records."""
    (records(pages, min_revisit, date).write.option("lineSep", END)
     .option("maxRecordsPerFile", ARCHIVE_RECORDS).text(path))


HEADER = re.compile(rb"([^:\r\n]+):[ \t]*([^\r\n]*)")


def parse(data: bytes) -> Iterator[tuple[int, dict[bytes, bytes], int, int]]:
    """(offset, headers, block start, block end) of each record of one archive."""
    at = 0
    while at < len(data):
        split = data.index(b"\r\n\r\n", at)
        if not data.startswith(b"WARC/", at):
            raise ValueError(f"no WARC record at byte {at}")
        head = dict(HEADER.findall(data, data.index(b"\r\n", at) + 2, split))
        start = split + 4
        end = start + int(head[b"Content-Length"])
        if data[end:end + 4] != b"\r\n\r\n":
            raise ValueError(f"the record at byte {at} does not end where its length says")
        yield at, head, start, end
        at = end + 4


def _page(value: bytes | None) -> int | None:
    digits = (value or b"").removeprefix(b"<urn:page:").removesuffix(b">")
    return int(digits) if digits else None


RUN_COLUMNS = ["archive", "position", "length", "page_id", "url", "captured", "payload_digest",
               "record_type", "refers_to", "block_bytes"]
RUN_SCHEMA = ("archive string, position long, length long, page_id long, url string, captured string, "
              "payload_digest string, record_type string, refers_to long, block_bytes long")


def runs(spark: SparkSession, path: str) -> DataFrame:
    """Index lines of all archives under ``path``; stored payloads are digested again."""
    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for name, data in zip(f["path"], f["content"]):
                rows = []
                for at, head, start, end in parse(data):
                    kind = head[b"WARC-Type"].decode()
                    said = head[b"WARC-Payload-Digest"].decode().removeprefix("sha1:")
                    digest = said if kind == "revisit" else base64.b32encode(hashlib.sha1(data[start:end]).digest()).decode()
                    if digest != said:
                        raise ValueError(f"damaged payload in {name} at byte {at}")
                    rows.append((name, at, end + 4 - at, _page(head[b"WARC-Record-ID"]),
                                 head[b"WARC-Target-URI"].decode(), head[b"WARC-Date"].decode(), digest,
                                 kind, _page(head.get(b"WARC-Refers-To")), end - start))
                out = pd.DataFrame(rows, columns=RUN_COLUMNS)
                yield out.astype({"page_id": "Int64", "refers_to": "Int64"})
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    found = files.select("path", "content").mapInPandas(read, RUN_SCHEMA)
    return found.withColumn("url_key", url_key(F.col("url"))).sortWithinPartitions("archive", *KEY)


def loser_tree_merge(parts: list[list[tuple]]) -> Iterator[tuple]:
    """Merge sorted lists by a loser tree.

    Leaves are the lists' heads; each inner node keeps the loser of its match
    and passes the winner up, so the next item costs one comparison a level.
    Ties go to the earlier list.
    """
    k = len(parts)
    if k == 0:
        return
    cursors = [iter(p) for p in parts]
    heads: list[tuple | None] = [next(c, None) for c in cursors]

    def wins(a: int, b: int) -> bool:
        x, y = heads[a], heads[b]
        if x is None or y is None:
            return y is None and (x is not None or a < b)
        return (x, a) < (y, b)

    loser = [0] * k  # loser[0] holds the overall winner

    def play(node: int) -> int:
        if node >= k:
            return node - k
        a, b = play(2 * node), play(2 * node + 1)
        win, lose = (a, b) if wins(a, b) else (b, a)
        loser[node] = lose
        return win

    winner = play(1) if k > 1 else 0
    while heads[winner] is not None:
        yield heads[winner]
        heads[winner] = next(cursors[winner], None)
        node = (winner + k) // 2
        while node >= 1 and k > 1:
            if wins(loser[node], winner):
                loser[node], winner = winner, loser[node]
            node //= 2


MERGE_COLUMNS = ["url_key", "captured", "page_id", "archive", "position", "length", "payload_digest",
                 "record_type", "refers_to", "block_bytes"]
MERGE_SCHEMA = ("url_key string, captured string, page_id long, archive string, position long, length long, "
                "payload_digest string, record_type string, refers_to long, block_bytes long")


def _order(row: tuple) -> tuple:
    """Sort key of an index line: URL key (by bytes), time, page id (null last), place."""
    return (row[0].encode(), row[1], row[2] is None, row[2] or 0, row[3], row[4])


def merged_index(index: DataFrame) -> DataFrame:
    """The runs merged into one ordered index: partition by partition, line by line."""
    index = written(index.select(*MERGE_COLUMNS), "warc-runs")
    ranges = max(1, -(-index.count() // RANGE_ROWS))
    spread = max(ranges, min(32, int(index.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    # Range partitioning samples the sorted runs for the cuts, and sorts what a
    # range gets by run, so each run's share is read in its own order.
    dealt = index.repartitionByRange(spread, "url_key", "captured", F.col("page_id").asc_nulls_last(), "archive", "position")
    dealt = dealt.sortWithinPartitions("archive", *KEY[:2], F.col("page_id").asc_nulls_last(), "position")

    def merge(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts: dict[str, list[tuple]] = {}
        for f in frames:
            f = f.astype({"page_id": "Int64", "refers_to": "Int64"}).astype(object).where(lambda x: x.notna(), None)
            for row in f[MERGE_COLUMNS].itertuples(index=False, name=None):
                parts.setdefault(row[3], []).append((_order(row), row))
        out: list[tuple] = []
        for _, row in loser_tree_merge(list(parts.values())):
            out.append(row)
            if len(out) == 10_000:
                yield pd.DataFrame(out, columns=MERGE_COLUMNS).astype({"page_id": "Int64", "refers_to": "Int64"})
                out = []
        yield pd.DataFrame(out, columns=MERGE_COLUMNS).astype({"page_id": "Int64", "refers_to": "Int64"})
    return dealt.mapInPandas(merge, MERGE_SCHEMA)


def archived(pages: DataFrame, path: str, min_revisit: int = MIN_REVISIT_BYTES, date: str | None = None) -> DataFrame:
    """Write ``pages`` to archives under ``path``, read them back, merge the index.

    Adds ``payload_bytes``; a revisit's are those of the response it refers to.
    """
    write_archives(pages, path, min_revisit, date)
    index = written(merged_index(runs(pages.sparkSession, path)), "warc-index")
    sizes = (index.where("record_type = 'response'").join(
        index.where("record_type = 'revisit'").select("payload_digest").distinct(), "payload_digest", "left_semi")
        .groupBy(F.col("payload_digest").alias("d")).agg(F.max("block_bytes").alias("bytes")))
    stored = index.where("record_type = 'response'").withColumn("payload_bytes", F.col("block_bytes"))
    again = (index.where("record_type = 'revisit'").join(sizes, F.col("payload_digest") == F.col("d"))
             .withColumn("payload_bytes", F.col("bytes")).select(*stored.columns))
    return stored.unionByName(again)


def op2_warc_index_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = archived(read_table(spark, sf_dir, "pages"), scratch_path(spark, "warc"))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url_key")


ORACLE_SQL = rf"""
WITH p AS (SELECT page_id, coalesce(url, '') AS url, encode(coalesce(html, '')) AS b FROM pages),
h AS (SELECT page_id, url, octet_length(b) AS n, sha1(b) AS h FROM p),
g AS (SELECT page_id, url, n, h, min(page_id) OVER (PARTITION BY h, n) AS first,
  [('0x' || substr(h, k, 10))::BIGINT for k in [1, 11, 21, 31]] AS v FROM h)
SELECT page_id, n::BIGINT AS payload_bytes,
  list_aggregate(flatten([[substr('{BASE32_DIGITS}', 1 + ((x >> s) & 31)::INT, 1) for s in [35, 30, 25, 20, 15, 10, 5, 0]] for x in v]), 'string_agg', '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first THEN first END AS refers_to,
  array_to_string(list_reverse(string_split(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)), '.')), ',') || ')'
    || regexp_replace(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*', '') AS url_key
FROM g
"""
