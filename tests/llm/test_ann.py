import math
import random
import tracemalloc

import numpy as np
from xylem.llm import ann
from xylem.llm.queries import op6_ann


def brute(rows, every, k):
    out = {}
    for i, q in rows:
        if i % every == 0:
            near = sorted((-sum(a * b for a, b in zip(q, v)), j) for j, v in rows if j != i)
            out[i] = near[:k]
    return out


def check(got, rows, want, least):
    vec, hits = dict(rows), 0
    by = {}
    for r in sorted(got, key=lambda r: (r.query_id, r.rank)):
        by.setdefault(r.query_id, []).append(r)
        assert math.isclose(r.score, float(np.dot(vec[r.query_id], vec[r.vec_id])), rel_tol=1e-12, abs_tol=1e-12)
    assert sorted(by) == sorted(want)
    for q, mine in by.items():
        assert [r.rank for r in mine] == list(range(1, len(want[q]) + 1)) and len({r.vec_id for r in mine}) == len(mine)
        assert all(r.vec_id != q for r in mine)
        assert [(-r.score, r.vec_id) for r in mine] == sorted((-r.score, r.vec_id) for r in mine)
        hits += len({r.vec_id for r in mine} & {j for _, j in want[q]})
    assert hits >= least * sum(map(len, want.values()))


def test_query_recall(spark):
    sf = "/root/testdata/sf0.01"
    rows = [(r.vec_id, [float(x) for x in r.embedding]) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    check(op6_ann(spark, sf).collect(), rows, brute(rows, 20, 20), 0.9)


def test_inner_products_of_unequal_lengths_in_blocks(spark):
    rng = random.Random(3)
    rows = [(i, [rng.gauss(0, 1) * (1 + i % 5) for _ in range(12)]) for i in range(600)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    check(ann.search(df, base_rows=150, query_rows=10).collect(), rows, brute(rows, 20, 20), 0.9)


def test_products_where_probing_costs_more_and_probing_where_it_does_not():
    rng = np.random.default_rng(5)
    even = rng.normal(size=(6000, 32))
    apart = rng.normal(size=(250, 256))[rng.integers(0, 250, 20_000)] + 0.05 * rng.normal(size=(20_000, 256))
    apart /= np.linalg.norm(apart, axis=1)[:, None]
    for x, probing, least in ((even, False, 1.0), (apart, True, 0.9)):
        index, ids = ann.Index(ann.learn(x[:2000], float((x * x).sum(axis=1).max())), np.arange(len(x)), x), np.arange(150)
        query, row, score = index.search(x[:150], ids, 20, 1.28)
        assert (index.radius >= 0) == probing and index.met >= probing * 0.8 * len(ids)
        assert (np.bincount(query) == 20).all() and (row != ids[query]).all()
        products = x[:150] @ x.T
        products[ids, ids] = -np.inf
        best = np.argsort(-products, axis=1)[:, :20]
        assert sum(len(set(best[q]) & set(row[query == q])) for q in ids) >= least * 20 * len(ids)
        assert np.allclose(score, products[query, row])


def test_many_equal_vectors_are_not_gathered_at_once():
    x = np.ones((40_000, 64))
    index = ann.Index(ann.learn(x[:500], 64.0), np.arange(len(x)), x)
    tracemalloc.start()
    query, row, _ = index.search(x[:64], np.arange(64), 20, 1.28)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 500 << 20
    assert all(row[query == q].tolist() == [r for r in range(21) if r != q][:20] for q in range(64))


def test_pigeonhole_finds_every_code(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(3000, 16))
    coder = ann.learn(x[:500], float((x * x).sum(axis=1).max()))
    index = ann.Index(coder, np.arange(3000), x)
    for q in range(20):
        code = coder.codes(coder.lift(x[q][None]))[0]
        apart = [np.bitwise_count(v ^ code[s]) for s, v in enumerate(index.values)]
        far = np.bitwise_count(index.wide ^ np.ascontiguousarray(code).view(np.uint64)).sum(axis=1)
        for radius in (0, 7, 30, 41, 64, 128):
            assert (index.within(code, apart, radius) == np.flatnonzero(far <= radius)).all()


def test_edges(spark):
    v = [1.0, 0.0, 0.0]
    rows = [(0, v, 1), (20, v, 1), (3, v, 1), (2, v, 1), (40, None, 1), (4, [], 1), (5, [0.0, 0.0, 0.0], 1), (6, [1.0, None, 1.0], 1), (7, [float("nan"), 1.0, 1.0], 1), (8, [float("inf"), 1.0, 1.0], 1), (None, v, 1), (3, v, 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, rank int")
    got = sorted((r.query_id, r.rank, r.vec_id, r.score) for r in ann.search(df).collect())
    assert got == [(0, 1, 2, 1.0), (0, 2, 3, 1.0), (0, 3, 3, 1.0), (0, 4, 20, 1.0), (20, 1, 0, 1.0), (20, 2, 2, 1.0), (20, 3, 3, 1.0), (20, 4, 3, 1.0)]
    assert ann.search(df.limit(0)).count() == 0
