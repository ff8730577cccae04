from collections import Counter, defaultdict

import numpy as np
import pytest

import corpus_pipeline as cp
from xylem.llm import decontam, mixing, quality, shards
from xylem.llm.util import keep, table

from .test_mix_shards import _check
from .test_neardup import brute
from .test_quality_decontam import edit_distance_in


@pytest.fixture(scope="module")
def outs(spark, sf):
    docs, out = table(spark, sf, "documents"), [table(spark, sf, "documents").collect()]
    for name, stage in cp.STAGES:
        docs = keep(stage(spark, docs, sf), name)
        out.append(docs.collect())
    return out


def test_columns_and_order():
    assert [n for n, _ in cp.STAGES] == ["quality", "near_duplicates", "decontamination", "mixing", "sharding"]
    assert cp.ORACLE_SQL is None


def test_quality(spark, sf, outs):
    docs = table(spark, sf, "documents")
    net = quality.fit(docs, table(spark, sf, "labels"))
    at = lambda t: np.array([0, len(t)])
    text = lambda r: (r.text or "").encode()
    want = [r for r in outs[0] if quality.score(net, np.frombuffer(text(r), np.uint8), at(text(r)))[0] >= 0.3]
    assert Counter(want) == Counter(outs[1]) and len(want) < len(outs[0])


def test_near_duplicates(outs):
    cls, _ = brute([r.text or "" for r in outs[1]])
    assert len(outs[2]) == len(set(cls.values())) == len({cls[r.text or ""] for r in outs[2]}) and set(outs[2]) <= set(outs[1])


def test_decontamination(spark, sf, outs):
    bench = sorted(r.text.encode() for r in table(spark, sf, "benchmark").collect())
    pats = decontam.index(bench)
    patterns = [(pats.body[a : a + m].tobytes(), e) for kind in pats.kinds for a, m, e in zip(kind.start, kind.size, kind.edits)]
    gone = set(outs[2]) - set(outs[3])
    assert set(outs[3]) <= set(outs[2])
    fold = lambda r: decontam._fold(np.frombuffer((r.text or "").encode(), np.uint8)).tobytes()
    hit = lambda r: any(p in fold(r) for p, _ in patterns)
    assert not any(hit(r) for r in outs[3])
    for r in gone:
        t = fold(r)
        assert hit(r) or any(edit_distance_in(p, t) <= e for p, e in patterns)


def test_mixing(outs):
    n, have = Counter(outs[4]), Counter(outs[3])
    assert set(n) <= set(have) and all(v <= 2 * have[k] for k, v in n.items())
    size, taken, most = defaultdict(int), defaultdict(int), defaultdict(int)
    import re

    words = lambda r: len(re.findall(mixing.WORD, r.text or ""))
    for r in outs[3]:
        size[r.source] += words(r)
        most[r.source] = max(most[r.source], words(r))
    for r in outs[4]:
        taken[r.source] += words(r)
    names = sorted(size)
    want = mixing.targets([size[s] for s in names], [(5, 2, 1)[i % 3] for i in range(len(names))], 1.5 * sum(size.values()), 2.0)
    for s, t in zip(names, want):
        assert abs(taken[s] - t) <= most[s]


def test_sharding(outs):
    _check(outs[5], len(outs[4]))
    assert Counter((r.doc_id, r.text) for r in outs[5]) == Counter((r.doc_id, r.text) for r in outs[4])
