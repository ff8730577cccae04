import random
from collections import defaultdict

import numpy as np
from xylem.llm import neardup as nd
from xylem.llm.queries import op2_neardup


def brute(texts):
    """Classes and links by comparing all pairs of different texts."""
    uniq = sorted(set(texts))
    raw = [t.encode() for t in uniq]
    at = np.cumsum([0, *map(len, raw)]).astype(np.int64)
    code = nd.codes(np.frombuffer(b"".join(raw), np.uint8), at)
    x, root, links = code.view(np.uint64), list(range(len(uniq))), defaultdict(set)

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(uniq)):
        for j in range(i + 1, len(uniq)):
            d = [int(np.bitwise_count(x[i, k] ^ x[j, k])) for k in range(4)]
            if d[0] + d[1] <= 28 and d[2] + d[3] <= 36:
                links[uniq[i]].add(j)
                links[uniq[j]].add(i)
                root[find(i)] = find(j)
    return {t: find(i) for i, t in enumerate(uniq)}, links


def same_classes(got, want):
    return len(set(got.values())) == len({(got[k], want[k]) for k in got}) == len(set(want.values()))


def test_query(spark, sf):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = op2_neardup(spark, sf).collect()
    assert sorted(r.doc_id for r in rows) == sorted(docs)
    cls, links = brute(list(docs.values()))
    assert same_classes({r.doc_id: r.class_id for r in rows}, {i: cls[t] for i, t in docs.items()})
    for r in rows:
        assert r.n_links == len(links[docs[r.doc_id]])
        assert r.n_copies == sum(t == docs[r.doc_id] for t in docs.values()) - 1 and r.class_id <= r.doc_id


def family(rng, n, words=120):
    base = [f"w{rng.randrange(10**6)}" for _ in range(words)]
    out = []
    for _ in range(n):
        t = list(base)
        for _ in range(rng.randrange(4)):
            t[rng.randrange(words)] = f"x{rng.randrange(10**6)}"
        out.append(" ".join(t))
    return out


def test_deep_forest_dense_and_hot_subtrees(spark):
    rng = random.Random(2)
    texts = [t for _ in range(150) for t in family(rng, rng.choice([1, 1, 2, 3]))] + family(rng, 160)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    cls, links = brute(texts)
    deep = nd.Forest(nd.plan(10**7).order[:44], 8)
    for how in ({"forest": deep, "leaf": 4}, {"chunk": 20}):
        rows = nd.near_duplicates(df, **how).collect()
        assert same_classes({r.doc_id: r.class_id for r in rows}, {i: cls[t] for i, t in enumerate(texts)})
        found, all_ = sum(r.n_links for r in rows), sum(len(links[t]) for t in texts)
        assert 0.98 * all_ <= found <= all_


def test_dense_subtree_finds_pairs_once():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2, (3000, 256), dtype=np.uint8)
    for i in range(0, 3000, 3):  # pairs at the accepted distances
        base[i + 1] = base[i]
        base[i + 1, rng.permutation(128)[:28]] ^= 1
    x = np.packbits(base, axis=1).view(np.uint64).reshape(-1, 4)
    i, j = nd.dense(np.full(3000, -1), x, np.zeros(128, bool), 28, 36, 0.99, 1, leaf=64)
    found = {tuple(sorted(p)) for p in zip(i.tolist(), j.tolist())}
    assert len(found) == len(i) and sum((k, k + 1) in found for k in range(0, 3000, 3)) > 970
    leaf = nd.leaves_of(rng.integers(0, 1 << 12, 5000), 12, 40)
    assert np.unique(leaf, return_counts=True)[1].max() <= 40


def test_crowded_codes_are_compared_once_and_in_parts(monkeypatch):
    """Tries can't part many near copies of one text: all pairs are then compared, once, and never all held."""
    rng = np.random.default_rng(4)
    bits = np.tile(rng.integers(0, 2, 256, dtype=np.uint8), (9000, 1))
    for row in bits:
        row[rng.permutation(128)[:3]] ^= 1
    code = np.column_stack([np.packbits(bits, axis=1).view(np.int64), np.zeros(9000, np.int64)])
    work, together = [], nd.together

    def counted(group, *rest):
        work.append(int((np.unique(group, return_counts=True)[1].astype(np.int64) ** 2).sum()))
        return together(group, *rest)

    monkeypatch.setattr(nd, "together", counted)
    forest = nd.Forest(np.array([np.arange(128)]), 0)
    parts = [len(p[0]) for p in nd.links(np.zeros(9000, np.int64), np.full(9000, -1), code, forest, 28, 36, 0.99)]
    assert sum(parts) == 9000 * 8999 // 2 and max(parts) < 1 << 20
    assert sum(work) <= 9000**2


def test_work_grows_less_than_the_table():
    work = []
    for count in (10**5, 10**6, 10**7, 10**9):
        forest = nd.plan(count)
        work.append(forest.trees * nd.descent(count / 2**forest.depth, 28, 0.99, 128 - forest.depth)[0])
    assert work[1] < 3 * work[0] and work[2] < 3 * work[1] and work[3] < 9 * work[2]


def test_forest_recall_at_the_accepted_distance():
    rng = np.random.default_rng(7)
    bits = rng.integers(0, 2, (3000, 128), dtype=np.uint8)
    far = bits.copy()
    for row in far:
        row[rng.permutation(128)[:28]] ^= 1
    one, two = (np.packbits(b, axis=1).view(np.int64) for b in (bits, far))
    for count in (10_000, 200_000, 12_000_000):
        forest = nd.plan(count)
        assert (forest.keys(one) == forest.keys(two)).any(axis=1).mean() > 0.98
    assert nd.plan(10**6, near=0).trees == 1 and nd.plan(10**6, near=120).depth < 5


def test_recall_of_shingle_jaccard(spark):
    """Pairs of texts that share their five-word shingles, counted without any code of the operator."""
    texts = sorted({r.text or "" for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()})
    sets, by = [], defaultdict(list)
    for i, t in enumerate(texts):
        w = t.lower().split()
        sets.append({" ".join(w[k : k + 5]) for k in range(max(1, len(w) - 4))})
        for s in sets[-1]:
            by[s].append(i)
    pairs = {(i, j) for group in by.values() if len(group) < 40 for i in group for j in group if i < j}
    near = [(i, j) for i, j in pairs if len(sets[i] & sets[j]) >= 0.5 * len(sets[i] | sets[j])]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    cls = {r.doc_id: r.class_id for r in nd.near_duplicates(df).collect()}
    assert len(near) > 20 and sum(cls[i] == cls[j] for i, j in near) >= 0.97 * len(near)


def test_near_copies_of_other_lengths(spark):
    rng = random.Random(9)
    texts, pairs = [], set()
    while len(pairs) < 8:
        base = [f"w{rng.randrange(10**6)}" for _ in range(47)]
        both = [" ".join(base), " ".join(base[:34])]
        raw = [t.encode() for t in both]
        x = nd.codes(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)])).view(np.uint64)
        d = [int(np.bitwise_count(x[0, k] ^ x[1, k])) for k in range(4)]
        if d[0] + d[1] <= 28 and d[2] + d[3] <= 36:
            pairs.add((len(texts), len(texts) + 1))
            texts += both
    rows = nd.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert all(r.n_links == 1 for r in rows) and {(r.class_id, r.doc_id) for r in rows if r.class_id != r.doc_id} == pairs


def test_edges(spark):
    rows = [(1, None, 5), (2, "", 5), (3, "a b", 5), (3, "a b", 5), (None, "A  B", 5), (4, "q " * 100_000, 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, class_id int")
    got = sorted((tuple(r) for r in nd.near_duplicates(df).collect()), key=str)
    assert got == sorted([(1, 1, 0, 1), (2, 1, 0, 1), (3, 3, 1, 1), (3, 3, 1, 1), (None, 3, 1, 0), (4, 4, 0, 0)], key=str)
    assert nd.near_duplicates(df.limit(0)).count() == 0
    kept = nd.drop_near_duplicates(df)
    assert kept.columns == df.columns and kept.count() == 3
