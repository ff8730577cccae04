"""Near-duplicate classes by SimHash and an LSH forest.

A text has two SimHash codes of 128 bits: of its distinct words, which the forest searches, and of its distinct word pairs,
which verifies. Each tree of the forest is a trie over the words' code with its bits in another random order. Subtrees (codes
that agree in a prefix) are spread over the tasks. Within a subtree the search adapts to the density found there: few codes are
compared as they are; many have a forest of their own over the bits left, whose tries split only where more than a leaf's
codes are. Splitting stops, and the search climbs back to shorter prefixes, where the number of tries that the target recall
at the farthest accepted distance, `near`, then needs would cost more than the comparisons that it saves.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from xylem.llm.util import join_uneven, keep, lower, mix64, pieces, span_hashes, utf8, with_row_id, words

BITS = 128
CODE = ["c0", "c1", "c2", "c3", "len"]
_LANES = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).view(np.uint64).reshape(-1)


def simhash(features: np.ndarray, row: np.ndarray, n: int) -> np.ndarray:
    """(n, 2) longs: each bit is the majority of the row's features' hash bits. Rows ascend; a row without features is 0."""
    out = np.zeros((n, 2), np.int64)
    if not len(features):
        return out
    first = np.flatnonzero(np.diff(row, prepend=-1))
    place = np.arange(len(row)) - np.repeat(first, np.diff(np.append(first, len(row))))
    cut = np.flatnonzero(place % 255 == 0)  # 8-bit counters side by side hold 255 features
    both = np.column_stack([mix64(features ^ np.uint64(0x9AE16A3B2F90404F)), mix64(features ^ np.uint64(0xC949D7C7509E6557))])
    sums = np.add.reduceat(_LANES[both.view(np.uint8)], cut, axis=0).view(np.uint8)
    owner = row[cut]
    start = np.flatnonzero(np.diff(owner, prepend=-1))
    votes = np.add.reduceat(sums.astype(np.int32), start, axis=0)
    size = np.diff(np.append(first, len(row)))
    out[owner[start]] = np.packbits(2 * votes > size[:, None], axis=1).view("<i8")
    return out


def distinct(features: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((features, row))
    f, r = features[order], row[order]
    new = np.ones(len(f), bool)
    new[1:] = (f[1:] != f[:-1]) | (r[1:] != r[:-1])
    return f[new], r[new]


def codes(buf: np.ndarray, at: np.ndarray) -> np.ndarray:
    """(rows, 5) longs: the code of the distinct lower-case words, that of their distinct pairs (a lone word: itself), and the
    number of words."""
    low, n = lower(buf), len(at) - 1
    starts, ends, row = words(low, at)
    h = span_hashes(low, starts, ends)
    with np.errstate(over="ignore"):
        pair = mix64(h[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:]) if len(h) > 1 else h[:0]
    same = row[1:] == row[:-1]
    alone = np.bincount(row, minlength=n)[row] == 1 if len(row) else np.zeros(0, bool)
    two, two_row = np.concatenate([pair[same], h[alone]]), np.concatenate([row[1:][same], row[alone]])
    return np.hstack([simhash(*distinct(h, row), n), simhash(*distinct(two, two_row), n), np.bincount(row, minlength=n)[:, None]])


def node_ids(code: np.ndarray) -> np.ndarray:
    x = code.view(np.uint64)
    out = np.zeros(len(x), np.uint64)
    for i in range(5):
        out = mix64(out ^ x[:, i] ^ np.uint64(i + 1))
    return out.view(np.int64)


@dataclass(frozen=True)
class Forest:
    order: np.ndarray
    depth: int

    @property
    def trees(self) -> int:
        return len(self.order)

    def keys(self, code: np.ndarray) -> np.ndarray:
        """(codes, trees): the tree and the prefix of its bits."""
        bits = np.unpackbits(np.ascontiguousarray(code[:, :2]).view(np.uint8).reshape(len(code), 16), axis=1)
        weight = np.int64(1) << np.arange(self.depth, dtype=np.int64)
        return np.column_stack([bits[:, o[: self.depth]].astype(np.int64) @ weight | np.int64(t) << 48 for t, o in enumerate(self.order)])

    def masks(self) -> np.ndarray:
        """(trees, 2) words: the bits that must agree."""
        out = np.zeros((self.trees, BITS), np.uint8)
        for t, o in enumerate(self.order):
            out[t, o[: self.depth]] = 1
        return np.packbits(out, axis=1).view("<u8")


#: Microseconds that moving a code to one more tree, and comparing it with one more code, roughly take; codes that subtrees
#: should have at most on average, so that a task's share stays small; codes of a leaf within a task.
MOVE, COMPARE, ROOM, LEAF = 7.0, 0.005, 4096, 256
#: Groups of more codes are compared in tiles of so many comparisons; pairs that are
#: gathered before they are filtered or counted.
SMALL, _TILE, _PAIRS = 48, 1 << 16, 1 << 18


def meeting(depth: int, near: int, bits: int = BITS) -> float:
    """The probability that `depth` bits of `bits`, drawn without replacement, miss all `near` differing ones."""
    return math.comb(bits - near, depth) / math.comb(bits, depth) if bits - near >= depth else 0.0


def tries(depth: int, near: int, recall: float, bits: int = BITS) -> float:
    """How many tries of a depth find a pair at distance `near` with the target probability."""
    p = meeting(depth, near, bits)
    return math.ceil(math.log(1 - recall) / math.log1p(-p)) if 0 < p < 1 else 1 if p else math.inf


def descent(count: float, near: int, recall: float, bits: int) -> tuple[float, int, int]:
    """Comparisons a code among `count` codes, and the depth and number of the tries to make them in; depth 0: all pairs.

    A try costs about 100 comparisons a code besides its own."""
    best = (count / 2, 0, 1)
    for depth in range(1, min(24, bits)):
        if (n := tries(depth, near, recall, bits)) < math.inf:
            best = min(best, (n * (count / 2**depth / 2 + 100), depth, n))
    return best


def plan(count: int, near: int = 28, recall: float = 0.99, seed: int = 5) -> Forest:
    """The depth, from one that leaves about ROOM codes on, whose tries cost least: each moves every code, and its subtrees are
    searched as descent() says. So trees are added as count ** 0.36 or so, and neither they nor the comparisons a code ever grow in proportion to the table."""
    cost = lambda d: tries(d, near, recall) * (MOVE + COMPARE * descent(count / 2**d, near, recall, BITS - d)[0])
    least = max(0, math.ceil(math.log2(max(1, count) / ROOM)))
    while least and tries(least, near, recall) > 1 << 14:  # climb: subtrees of more codes are searched by several tasks
        least -= 1
    depth = min([d for d in range(least, 41) if tries(d, near, recall) <= 1 << 14], key=cost)
    rng = np.random.default_rng(seed)
    return Forest(np.array([rng.permutation(BITS) for _ in range(int(tries(depth, near, recall)))]), depth)


def together(group: np.ndarray, side: np.ndarray, x: np.ndarray, near: int, verify: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Verified pairs (i, j) of rows of one group, in parts; rows are sorted by group. side: rows of one side aren't compared
    with each other unless it is -1. Large groups are compared in tiles that fit a cache, small ones all at once."""
    x0, x1, x2, x3 = (np.ascontiguousarray(x[:, k]) for k in range(4))

    def verified(i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        d = np.bitwise_count(x2[i] ^ x2[j]).astype(np.int64) + np.bitwise_count(x3[i] ^ x3[j])
        ok = (d <= verify) & ((side[i] != side[j]) | (side[i] < 0))
        return i[ok], j[ok]

    first = np.flatnonzero(np.append(True, np.diff(group) != 0)) if len(group) else np.zeros(0, np.int64)
    size = np.diff(np.append(first, len(group)))
    for lo, n in zip(first[size > SMALL].tolist(), size[size > SMALL].tolist()):
        hi, a = lo + n, lo
        while a < hi - 1:
            b = min(hi, a + max(1, _TILE // (hi - a)))
            d = np.bitwise_count(x0[a:b, None] ^ x0[a:hi]) + np.bitwise_count(x1[a:b, None] ^ x1[a:hi])
            i, j = np.divmod(np.flatnonzero(d <= near), hi - a)
            later = j > i
            if later.any():
                yield verified(i[later] + a, j[later] + a)
            a = b
    left = np.repeat(np.where(size > SMALL, 0, first + size), size) - np.arange(len(group))
    a = np.arange(len(group))
    for k in range(1, int(left.max(initial=1))):
        a = a[left[a] > k]
        b = a + k
        hit = np.flatnonzero(np.bitwise_count(x0[a] ^ x0[b]) + np.bitwise_count(x1[a] ^ x1[b]) <= near)
        if len(hit):
            yield verified(a[hit], b[hit])


def gathered(pairs: Iterator[tuple[np.ndarray, np.ndarray]], least: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The same pairs in parts of `least` or more, but for the last; no empty ones."""
    held, n = [], 0
    for part in itertools.chain(pairs, [None]):
        if part is not None and len(part[0]):
            held.append(part)
            n += len(part[0])
        if held and (part is None or n >= least):
            i, j = (np.concatenate(v) for v in zip(*held))
            held, n = [], 0
            yield i, j


def leaves_of(key: np.ndarray, depth: int, leaf: int) -> np.ndarray:
    """A trie over keys of `depth` bits: each key's leaf, the shortest prefix that at most `leaf` keys have, or all its bits."""
    order = np.argsort(key)
    by, out, todo = key[order], np.zeros(len(key), np.int64), np.ones(len(key), bool)
    for d in range(depth + 1):
        prefix = by >> (depth - d)
        new = np.append(True, prefix[1:] != prefix[:-1])
        first = np.flatnonzero(new)
        size = np.diff(np.append(first, len(by)))
        small = np.repeat((size <= leaf) | (d == depth), size) & todo
        out[order[small]] = (prefix[small] << 6) | d
        todo &= ~small
        if not todo.any():
            break
    return out


def tried(side: np.ndarray, x: np.ndarray, used: np.ndarray, near: int, verify: int, recall: float, seed: int, leaf: int = LEAF) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Verified pairs of one subtree's rows, by tries over the bits that aren't used; each pair once, in parts.

    Codes that crowd together share their leaves too: where the tries would compare more than all pairs are, all are compared."""
    free = np.flatnonzero(~used)
    _, depth, many = descent(len(x), near, recall, len(free))
    bits = np.unpackbits(np.ascontiguousarray(x[:, :2]).view(np.uint8).reshape(len(x), 16), axis=1)
    rng = np.random.default_rng(seed)
    groups = []
    for _ in range(int(many)):
        key = bits[:, rng.permutation(free)[:depth]].astype(np.int64) @ (np.int64(1) << np.arange(depth, dtype=np.int64)[::-1])
        groups.append(leaves_of(key, depth, leaf))
        if int((np.unique(groups[-1], return_counts=True)[1] ** 2).sum()) * many >= len(x) ** 2:
            yield from together(np.zeros(len(x), np.int64), side, x, near, verify)
            return
    for t, group in enumerate(groups):
        order = np.argsort(group, kind="stable")
        for i, j in gathered(together(group[order], side[order], x[order], near, verify), _PAIRS):
            i, j = order[i], order[j]
            for other in groups[:t]:
                new = other[i] != other[j]
                i, j = i[new], j[new]
            yield i, j


def dense(side: np.ndarray, x: np.ndarray, used: np.ndarray, near: int, verify: int, recall: float, seed: int, leaf: int = LEAF) -> tuple[np.ndarray, np.ndarray]:
    """What tried() finds, at once."""
    return next(gathered(tried(side, x, used, near, verify, recall, seed, leaf), 1 << 62), (np.zeros(0, np.int64),) * 2)


def links(key: np.ndarray, side: np.ndarray, code: np.ndarray, forest: Forest, near: int, verify: int, recall: float, leaf: int = LEAF) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Verified pairs (i, j) of rows of equal keys, in parts; a pair that an earlier tree brings together is left to that tree.

    Rows are sorted by key, which has the tree on top. Where a forest of its own saves comparisons, a key's rows have one."""
    x, masks, tree = code.view(np.uint64), forest.masks(), key >> 48
    first = np.flatnonzero(np.append(True, np.diff(key) != 0)) if len(key) else np.zeros(0, np.int64)
    size = np.diff(np.append(first, len(key)))
    deep = np.array([n > 2 * leaf and descent(n, near, recall, BITS - forest.depth)[1] > 0 for n in size], bool)

    def all_() -> Iterator[tuple[np.ndarray, np.ndarray]]:
        plain = np.flatnonzero(np.repeat(~deep, size))
        for i, j in together(key[plain], side[plain], x[plain], near, verify):
            yield plain[i], plain[j]
        for a, n in zip(first[deep], size[deep]):
            used = np.zeros(BITS, bool)
            used[forest.order[tree[a]][: forest.depth]] = True
            for i, j in tried(side[a : a + n], x[a : a + n], used, near, verify, recall, int(tree[a]), leaf):
                yield i + a, j + a

    for i, j in gathered(all_(), _PAIRS):
        one, two = x[i, 0] ^ x[j, 0], x[i, 1] ^ x[j, 1]
        for t in range(int(tree[i].max(initial=0))):  # near pairs, which are met again and again, drop out at the first few
            new = np.flatnonzero(((one & masks[t, 0]) | (two & masks[t, 1]) != 0) | (tree[i] <= t))
            if len(new) < len(i):
                i, j, one, two = i[new], j[new], one[new], two[new]
            if not len(i):
                break
        if len(i):
            yield i, j


def spanning(i: np.ndarray, j: np.ndarray, n: int) -> np.ndarray:
    """Each row's smallest row that it is connected with."""
    label = np.arange(n)
    while len(i):
        low = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    return label


def components(edges: DataFrame) -> DataFrame:
    """u and root, the smallest vertex of its component, for every vertex but the roots; by large-star and small-star.

    Neighbours are never gathered: each round takes minima (pre-aggregated) and joins them back, and is written out."""
    e, seen = keep(edges.filter("u <> v").distinct(), "edges"), None
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        m = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("deg"))
        large = keep(join_uneven(both, m, ["u"], "deg").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct(), "large")
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        m = down.groupBy("u").agg(F.min("v").alias("m"))
        e = keep(down.join(m, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(m.select("u", F.col("m").alias("v"))).filter("u <> v").distinct(), "small")
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == seen:
            return e.select("u", F.col("v").alias("root"))
        seen = now


def signatures(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    kind = docs.schema[id_col].dataType.simpleString()
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, at = utf8(batch.column(2))
            parts = [codes(buf[at[a] : at[b]], at[a : b + 1] - at[a]) for a, b in pieces(at, 1 << 20)]
            code = np.concatenate(parts) if parts else np.zeros((0, 5), np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(node_ids(code)), *[pa.array(np.ascontiguousarray(code[:, i])) for i in range(5)]], ["id", "text_hash", "node", *CODE])

    cols = docs.select(F.col(f"`{id_col}`").alias("id"), F.xxhash64(text).alias("text_hash"), text.alias("text"))
    return keep(cols.mapInArrow(sign, f"id {kind}, text_hash long, node long, c0 long, c1 long, c2 long, c3 long, len long"), "signatures")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", near: int = 28, verify: int = 36, recall: float = 0.99, chunk: int = 50_000, leaf: int = LEAF, forest: Forest | None = None) -> DataFrame:
    """One row for each document: id, class_id (the smallest id of its class), n_links (how many different texts its text is
    linked with) and n_copies (other documents of the same text).

    Two texts are linked if their words' codes differ in at most `near` bits and their pairs' codes in at most `verify`,
    whatever their lengths; classes are what links and equal texts connect. A pair at the bound of `near` bits is found with
    probability `recall` (and, where a subtree has a forest of its own, that once more), nearer ones likelier; `forest`
    replaces the planned one. Equal texts, and texts of equal codes and lengths, are one vertex, so their pairs are counted, not
    listed. Null and empty texts are copies of each other. A subtree of more than `chunk` vertices is searched in pairs of
    blocks, each a task's share; only counts and a spanning forest leave a task. Null ids take part; a class of null ids
    alone has a null class_id. Repeated rows each return. Other columns are not read. An empty table gives no rows."""
    spark = docs.sparkSession
    sig = signatures(docs, id_col, text_col)
    texts = keep(sig.groupBy("node", "text_hash", *CODE).agg(F.min("id").alias("low"), F.count("*").alias("n")), "texts")
    nodes = keep(texts.groupBy("node", *CODE).agg(F.min("low").alias("low"), F.count("*").alias("w")), "nodes")
    forest = forest or plan(nodes.count(), near, recall)
    vertices = nodes.select("w", *CODE)

    def matrix(batch: pa.RecordBatch) -> np.ndarray:
        return np.column_stack([batch.column(i).to_numpy(zero_copy_only=False) for i in range(1, 6)])

    def leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key, n = np.unique(forest.keys(matrix(batch)), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(n)], ["key", "n"])

    def plant(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 4096):
                part = batch.slice(a, 4096)
                keys = forest.keys(matrix(part)).T
                for t in range(forest.trees):
                    yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(keys[t])), *part.columns], ["key", "w", *CODE])

    hot = keep(vertices.mapInArrow(leaves, "key long, n long").groupBy(F.col("key").alias("_key")).agg(F.sum("n").alias("_n")).filter(F.col("_n") > chunk), "hot")
    rows = vertices.mapInArrow(plant, "key long, w long, c0 long, c1 long, c2 long, c3 long, len long").join(hot, F.col("key") == F.col("_key"), "left")
    k = F.ceil(F.col("_n") / chunk).cast("int")
    own = F.pmod(F.xxhash64(*CODE), F.coalesce(k, F.lit(1))).cast("int")
    rows = rows.withColumn("own", own).withColumn("other", F.explode(F.when(k.isNull(), F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), k - 1))))
    rows = rows.select("key", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), F.when(F.col("own") == F.col("other"), -1).otherwise(F.col("own")).alias("side"), "w", *CODE)
    # in block (x, y), x < y, rows of both sides meet; in (x, x) those of one chunk do
    rows = rows.withColumn("side", F.when(F.col("x") == F.col("y"), -1).otherwise(F.col("side")))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in batches:
            part = np.column_stack([c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns])
            part = part if rest is None else np.concatenate([rest, part])
            new = np.flatnonzero((part[1:, :3] != part[:-1, :3]).any(axis=1))
            if not len(new):
                rest = part
                continue
            rest = part[new[-1] + 1 :]
            yield from found(part[: new[-1] + 1])
        if rest is not None and len(rest):
            yield from found(rest)

    def found(part: np.ndarray) -> Iterator[pa.RecordBatch]:
        block = np.append(0, np.cumsum((part[1:, :3] != part[:-1, :3]).any(axis=1)))
        key = (part[:, 0] >> 48 << 48) | block  # one key a block, the tree on top
        code = np.ascontiguousarray(part[:, 5:10])
        label, degree = np.arange(len(part)), np.zeros(len(part))
        pairs = links(key, part[:, 3], code, forest, near, verify, recall, leaf)
        for i, j in gathered(pairs, _PAIRS):  # counted and dropped
            degree += np.bincount(i, part[j, 4], len(part)) + np.bincount(j, part[i, 4], len(part))
            label = spanning(label[i], label[j], len(part))[label]
        some = np.flatnonzero(degree)
        if not len(some):
            return
        ids = node_ids(code)
        yield pa.RecordBatch.from_arrays([pa.array(ids[some]), pa.array(ids[label[some]]), pa.array(degree[some].astype(np.int64))], ["u", "v", "n"])

    keys = ["key", "x", "y"]
    met = keep(rows.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(search, "u long, v long, n long"), "links")
    roots = components(met.select("u", "v"))
    degree = met.groupBy("u").agg(F.sum("n").alias("degree"))
    named = nodes.select("node", "low", "w").join(degree.withColumnRenamed("u", "node"), "node", "left").join(roots.withColumnRenamed("u", "node"), "node", "left").withColumn("root", F.coalesce("root", "node"))
    named = keep(named, "named")
    classes = named.groupBy("root").agg(F.min("low").alias("class_id"), F.count("*").alias("members"))
    known = join_uneven(named, classes, ["root"], "members").select("node", "class_id", (F.col("w") - 1 + F.coalesce("degree", F.lit(0))).alias("n_links"))
    known = keep(texts.select("node", "text_hash", "n").join(known, "node"), "known")
    out = join_uneven(sig.select("id", "node", "text_hash"), known, ["node", "text_hash"], "n")
    return out.select(F.col("id").alias(id_col), "class_id", "n_links", (F.col("n") - 1).alias("n_copies"))


def drop_near_duplicates(docs: DataFrame, text_col: str = "text", **how) -> DataFrame:
    """The first row of each class of docs, with all columns; which row is first follows the order of the input."""
    rows, rid = with_row_id(docs)
    stay = near_duplicates(rows.select(F.col(rid).alias("_rid"), F.col(f"`{text_col}`").alias("_text")), "_rid", "_text", **how).filter(F.col("_rid") == F.col("class_id")).select(F.col("_rid").alias(rid))
    return rows.join(stay, rid, "left_semi").drop(rid)


def digest(docs: DataFrame) -> DataFrame:
    return near_duplicates(docs)
