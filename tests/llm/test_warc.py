"""Archives: exact round trip; the loser tree against sorting; the merged index's order."""

import base64
import hashlib

from hypothesis import given, settings
from hypothesis import strategies as st

from errata.llm import warc
from errata.session import scratch_path

SF = "/root/testdata/sf0.001"


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.tuples(st.integers(0, 9), st.integers(0, 9)), max_size=8), max_size=9))
def test_loser_tree(parts):
    parts = [sorted(p) for p in parts]
    assert list(warc.loser_tree_merge(parts)) == sorted(x for p in parts for x in p)


def brute(rows, least=0):
    first = {}
    for p, _, h in rows:
        b = (h or "").encode()
        if p is not None and len(b) >= least:
            first[b] = min(first.get(b, p), p)
    out = []
    for p, _, h in rows:
        b = (h or "").encode()
        digest = base64.b32encode(hashlib.sha1(b).digest()).decode()
        again = b in first and first[b] != p
        out.append((p, len(b), digest, "revisit" if again else "response", first[b] if again else None))
    return sorted(out, key=repr)


def result(found):
    return sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in found.collect()), key=repr)


def test_round_trip_with_edge_rows(spark):
    rows = [(3, "http://b.org/x", "same"), (1, "http://A.org/x?q=1", "same"), (9, None, None), (4, "http://a.org/", ""),
            (None, "ftp://c.d.e", "same"), (7, "no url\r\nX: y", "a\r\n\r\nWARC/1.1\r\nContent-Length: 3\r\n\r\nb"),
            (8, "http://é.fr/ü", "é\n" * 1000), (5, "http://b.org/x", "same"), (5, "http://b.org/x", "same")]
    df = spark.createDataFrame([(p, u, h, "k", 1) for p, u, h in rows], "page_id long, url string, html string, digest string, size int")
    found = warc.archived(df.repartition(3), scratch_path(spark, "test-warc"))
    assert result(found) == brute(rows)
    assert result(warc.archived(df, scratch_path(spark, "test-warc"), min_revisit=5)) == brute(rows, 5)


def test_table_and_payloads(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    rows = [(r.page_id, r.url, r.html) for r in pages.collect()]
    path = scratch_path(spark, "test-warc")
    found = warc.archived(pages.union(pages.selectExpr("page_id + 100000", "url", "html")).repartition(4), path)
    assert result(found) == brute(rows + [(p + 100000, u, h) for p, u, h in rows])
    stored = {}
    for f in spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).collect():
        for _, head, start, end in warc.parse(bytes(f.content)):
            if head[b"WARC-Type"] == b"response":
                stored[warc._page(head[b"WARC-Record-ID"])] = bytes(f.content)[start:end].decode()
    assert stored == {p: h for p, _, h in rows}


def test_index_is_globally_ordered(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet").unionAll(
        spark.read.parquet(f"{SF}/pages.parquet").selectExpr("page_id + 1000", "url", "concat(html, 'x')"))
    path = scratch_path(spark, "test-warc")
    warc.write_archives(pages.repartition(5), path)
    rows = [tuple(r)[:5] for r in warc.merged_index(warc.runs(spark, path)).collect()]
    assert rows == sorted(rows, key=lambda r: (r[0].encode(), r[1], r[2], r[3], r[4]))
    assert len(rows) == 100


def test_date_column_and_url_key(spark):
    df = spark.sql("SELECT 1L AS page_id, 'https://www.Example.org:8080/a?b' AS url, 'x' AS html, TIMESTAMP '2024-02-03 04:05:06' AS seen")
    path = scratch_path(spark, "test-warc")
    warc.write_archives(df, path, date="seen")
    r = warc.merged_index(warc.runs(spark, path)).first()
    assert (r.url_key, r.captured) == ("org:8080,example,www)/a?b", "2024-02-03T04:05:06Z")


def test_empty_table(spark):
    df = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.archived(df, scratch_path(spark, "test-warc")).count() == 0
