import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from xylem.llm import lm
from xylem.llm.queries import op5_lm

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def brute(docs, mass, held):
    low = {i: [w.lower() for w in WORD.findall((t or "").encode())] + ["</s>"] for i, t in docs}
    order = len(mass) + 1
    counts, n = Counter(), 0
    padded = {i: ["<s>"] * (order - 1) + w for i, w in low.items()}
    for i, w in padded.items():
        if not held(i):
            n += len(low[i])
            for k in range(1, order + 1):
                counts.update(tuple(w[j - k + 1 : j + 1]) for j in range(k - 1, len(w)))
    v = sum(len(g) == 1 and g != ("<s>",) for g in counts)

    def p(w, h):
        if not h:
            return (counts[w,] + 1) / (n + v + 1)
        m = mass[len(h) - 1]
        return (counts[*h, w] + m * p(w, h[1:])) / (counts[h] + m)

    out = {}
    for i, w in padded.items():
        at = range(order - 1, len(w))
        out[i] = (held(i), len(at), sum(counts[w[j],] > 0 for j in at), n, sum(math.log10((counts[w[j],] + 1) / (n + v + 1)) for j in at), sum(math.log10(p(w[j], tuple(w[j - order + 1 : j]))) for j in at))
    return out


def equal(rows, want):
    assert sorted(r.doc_id for r in rows) == sorted(want)
    for r in rows:
        w = want[r.doc_id]
        assert tuple(r)[1:5] == w[:4] and r.base_score == pytest.approx(w[4], rel=1e-9) and r.score == pytest.approx(w[5], rel=1e-9)


def test_query(spark, sf):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    held = lambda i: zlib.crc32(str(i).encode()) % 7 == 2
    want = {m: brute(docs, m, held) for m in lm.MASSES}
    best = max(lm.MASSES, key=lambda m: sum(w[5] for w in want[m].values() if w[0]))
    rows = op5_lm(spark, sf).collect()
    equal(rows, want[best])
    assert {r.mass for r in rows} == {",".join(map(str, best))}
    assert sum(r.score for r in rows if r.held_out) > sum(r.base_score for r in rows if r.held_out)


@pytest.mark.parametrize("mass", [(), (3.0,), (3.0, 1.5), (5.0, 2.0, 1.0)])
def test_small_blocks_buckets_and_long_lanes(spark, mass):
    rng = random.Random(1)
    docs = [(i, " ".join(rng.choice(["A", "a", "b", "cc", "d,", "é"]) for _ in range(rng.choice([0, 1, 3, 40, 700])))) for i in range(60)] + [(100, None), (101, "")]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    equal(lm.score_texts(df, masses=(mass,), block_bytes=3000, bucket_grams=900, most_parts=7).collect(), brute(docs, mass, lambda i: zlib.crc32(str(i).encode()) % 7 == 2))


def test_hash_table():
    rng = np.random.default_rng(2)
    keys = rng.permutation(np.unique(rng.integers(0, 1 << 40, 5000)))
    arcs = lm.Arcs(keys)
    assert (arcs.find(keys) == np.arange(len(keys))).all()
    assert (lm.Arcs(keys[:0]).find(keys) == -1).all() and (arcs.find(keys + (1 << 41)) == -1).all()


def test_edges(spark):
    df = spark.createDataFrame([(1, "a b", 1.0), (1, "a b", 1.0), (None, "a", 1.0)], "doc_id long, text string, score double")
    rows = lm.score_texts(df).collect()
    assert len(rows) == 3 and all(r.score < 0 for r in rows)
    assert lm.score_texts(df.limit(0)).count() == 0
