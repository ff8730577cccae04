import hashlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F
from xylem.llm import urls, warc
from xylem.llm.queries import QUERIES, SQL


@pytest.mark.parametrize("name", ["op7_urls", "op9_warc"])
def test_query_equals_sql(spark, sf, name):
    got = QUERIES[name](spark, sf)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{sf}/pages.parquet'")
    found = con.execute(SQL[name])
    names = [c[0] for c in found.description]
    want, cols = [dict(zip(names, r)) for r in found.fetchall()], sorted(names)
    assert sorted(got.columns) == cols
    key = lambda r: tuple(str(r[c]) for c in cols)
    assert sorted(map(key, (r.asDict() for r in got.collect()))) == sorted(map(key, want))


def test_bloom_has_no_false_negatives():
    x = np.arange(5000, dtype=np.int64) * 977
    block, masks = urls.slots(x, 200)
    table = np.zeros((200, urls.WORDS), np.uint64)
    np.bitwise_or.at(table, block, masks)
    assert ((table[block] & masks) == masks).all()
    b2, m2 = urls.slots(-1 - np.arange(20000, dtype=np.int64), 200)
    assert ((table[b2] & m2) == m2).all(axis=1).mean() < 0.1


def test_url_edges(spark):
    rows = [(1, None, "z"), (2, "nothing", "z"), (3, "http://WWW.Example.com/en/x?b=2&a=1&utm_x=3#f", "z"), (4, "https://m.example.com/en/", "z"), (5, "ftp://a.net/es/q/", "z"), (6, "http://a.org/p//", "z"), (6, "http://a.org/p//", "z"), (7, "x://a.org/p#://b", "z"), (8, "http://example.com?x", "z")]
    df = spark.createDataFrame(rows, "page_id long, url string, verdict string")
    listed = spark.createDataFrame([("a.org/p",)], "canonical string")
    got = {(r.page_id, r.host, r.path, r.rule, r.verdict) for r in urls.url_filter(df, listed).collect()}
    assert got == {(1, "", "", None, "allow"), (2, "", "", None, "allow"), (3, "www.example.com", "/en/x", "www.example.com/en/", "allow"), (4, "m.example.com", "/en/", "example.com/en/", "block"), (5, "a.net", "/es/q/", "net/es/", "block"), (6, "a.org", "/p//", None, "block"), (7, "a.org", "/p", None, "block"), (8, "example.com", "", None, "allow")}
    assert urls.url_filter(df, listed).count() == len(rows)
    assert urls.url_filter(df.limit(0), listed.limit(0)).count() == 0


def test_warc_round_trip(spark, tmp_path):
    long = "<p>é\r\n\r\n日本</p>" * 3000
    rows = [(3, "http://a/\r\nx y", long, 1), (1, None, long, 1), (2, "u", "short", 1), (4, "u", "short", 1), (5, "u", None, 1), (6, "u", "", 1), (None, "u", long, 1), (7, "WARC/1.1", "WARC/1.1\r\n" * 20, 1), (7, "WARC/1.1", "WARC/1.1\r\n" * 20, 1)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, type int")
    warc.write_archives(df, f"file://{tmp_path}/w")
    read = warc.read_archives(spark, f"file://{tmp_path}/w")
    back = warc.resolve_revisits(read).collect()
    want = Counter((str(r[0]) if r[0] is not None else None, (r[2] or "").encode()) for r in rows)
    assert Counter((r.page_id, bytes(r.payload)) for r in back) == want
    kinds = Counter((r.page_id, r.type, r.refers_to_page) for r in back)
    assert kinds == Counter({("1", "response", None): 1, ("3", "revisit", "1"): 1, (None, "revisit", "1"): 1, ("2", "response", None): 1, ("4", "response", None): 1, ("5", "response", None): 1, ("6", "response", None): 1, ("7", "response", None): 2})
    for r in back:
        assert r.payload_sha256 == hashlib.sha256(r.payload).hexdigest() and r.length == len(r.payload)
    warc.write_archives(df.limit(0), f"file://{tmp_path}/e")
    assert warc.read_archives(spark, f"file://{tmp_path}/e").count() == 0
