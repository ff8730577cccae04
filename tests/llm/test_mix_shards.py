import re
from collections import Counter, defaultdict

import pytest
from xylem.llm import mixing, shards
from xylem.llm.queries import op4_mix, op8_shards


def test_targets_reshare():
    got = mixing.targets([10, 100, 100], [5, 2, 1], 315.0, 2.0)
    assert got[0] == 20 and sum(got) == pytest.approx(315.0) and got[1] == pytest.approx(2 * got[2], rel=1e-9) or got[1] == 200
    assert mixing.targets([], [], 0.0, 2.0) == []


def test_mix_query(spark, sf):
    rows = op4_mix(spark, sf).collect()
    docs = {r.doc_id: r for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert sorted(r.doc_id for r in rows) == sorted(docs)
    by = defaultdict(list)
    for r in rows:
        d = docs[r.doc_id]
        assert r.size == len(re.findall(mixing.WORD, d.text or "")) and r.taken in (0, r.size, 2 * r.size)
        by[d.source].append(r)
    want = mixing.targets([sum(r.size for r in by[s]) for s in sorted(by)], [(5, 2, 1)[i % 3] for i in range(len(by))], 1.5 * sum(r.size for r in rows), 2.0)
    for s, t in zip(sorted(by), want):
        assert all(r.target == pytest.approx(t) and r.source_size == sum(x.size for x in by[s]) for r in by[s])
        assert abs(sum(r.taken for r in by[s]) - t) <= max(r.size for r in by[s])
    assert sorted(rows) == sorted(op4_mix(spark, sf).collect())


EDGES = [(1, None, "a", 9), (1, None, "a", 9), (2, "", None, 8), (None, "x y", None, 7), (3, "w " * 50_000, "b", 6), (4, "x", "b", 5)]


def test_mix_edges(spark):
    df = spark.createDataFrame(EDGES, "doc_id long, text string, source string, copies int")
    got = mixing.mix(df)
    assert got.columns == df.columns
    n = Counter(got.collect())
    assert all(v <= 2 * Counter(df.collect())[k] for k, v in n.items())
    assert mixing.mix(df.limit(0)).count() == 0


def test_shards_query(spark, sf):
    rows = op8_shards(spark, sf).collect()
    _check(rows, spark.read.parquet(f"{sf}/documents.parquet").count())


def _check(rows, n):
    import math

    assert len(rows) == n
    by = defaultdict(list)
    for r in rows:
        by[r.shard].append(r)
    assert {math.floor(n / 16), math.ceil(n / 16)} >= {len(by[s]) for s in range(16)}
    total = Counter(r.source for r in rows)
    for s, mine in by.items():
        assert sorted(r.slot for r in mine) == list(range(len(mine)))
        for source, m in Counter(r.source for r in mine).items():
            assert abs(m - total[source] / 16) < 2


def test_shards_edges(spark):
    df = spark.createDataFrame(EDGES * 10, "doc_id long, text string, source string, shard int")
    got = shards.shard(df)
    assert Counter(got.drop("shard", "slot").collect()) == Counter(df.drop("shard").collect())
    _check(got.collect(), 60)
    assert shards.shard(df.limit(0)).count() == 0


def test_columns_of_any_name(spark):
    from xylem.llm import neardup, urls

    df = spark.createDataFrame([(1, "a b c", "s", 5, 6, 7), (2, None, None, 5, 6, None), (3, "d e f", "s", 5, 6, 7)], "doc_id long, text string, source string, _rid int, _copies int, _RID1 int")
    for got in (mixing.mix(df), neardup.drop_near_duplicates(df), shards.shard(df).drop("shard", "slot")):
        assert got.columns == df.columns and set(got.collect()) <= set(df.collect())
    pages = spark.createDataFrame([(1, "http://a.org/p", "mine", "too", "x")], "page_id long, url string, _block string, _maybe string, _rule string")
    row = urls.url_filter(pages, spark.createDataFrame([("a.org/p",)], "canonical string")).first()
    assert (row["_block"], row["_maybe"], row["_rule"], row["verdict"]) == ("mine", "too", "x", "block")
