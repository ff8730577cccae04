"""Nearest neighbours by multi-index hashing.

Vectors are given one more component that makes their lengths equal, which turns the largest inner product into the smallest
angle, and are turned by rotations learned from a sample (iterative quantisation). The signs are binary codes, cut into
substrings, each with an index of its own. Codes within a Hamming radius of m * r + a agree with the query within r bits in one
of the first a + 1 substrings, or within r - 1 in another: probing these finds them all. What is
found is reranked by the vectors; it suffices if a vector as near as the k-th best found lies within the radius with probability
`recall`. Queries for which that takes a radius that costs more to probe than the products with the whole block, as all do where
vectors have no clusters, have those products instead, many queries at once; these miss nothing.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from xylem.llm.util import keep

SUB = 16
#: Rows of a block that bound its k-th best; queries and rows of one product; what probing costs besides, comparing an occurring
#: value and visiting a row, in products of 64 components; and fetching a row for the rerank, in products of its own components.
HEAD, QUERIES, ROWS, CALL, VALUE, VISIT, FETCH = 4096, 64, 4096, 25_000, 0.25, 4.0, 50.0


@dataclass(frozen=True)
class Coder:
    """rotations: (dims + 1, bits); top: the largest squared length."""

    rotations: np.ndarray
    top: float

    @property
    def bits(self) -> int:
        return self.rotations.shape[1]

    def lift(self, x: np.ndarray) -> np.ndarray:
        rest = np.sqrt(np.maximum(0, self.top - (x * x).sum(axis=1)))
        return np.column_stack([x, rest])

    def codes(self, lifted: np.ndarray) -> np.ndarray:
        """(rows, substrings): 16 bits each."""
        return np.packbits(lifted @ self.rotations > 0, axis=1).view("<u2")


def learn(sample: np.ndarray, top: float, bits: int = 128, rounds: int = 15, seed: int = 9) -> Coder:
    """As many learned rotations as the bits need; each turns the sample towards the corners of its cube."""
    rng = np.random.default_rng(seed)
    dims = sample.shape[1] + 1
    lifted = Coder(np.zeros((dims, 0)), top).lift(sample)
    parts: list[np.ndarray] = []
    while sum(p.shape[1] for p in parts) < bits:
        turn = np.linalg.qr(rng.normal(size=(dims, dims)))[0]
        for _ in range(rounds if len(lifted) else 0):
            u, _, w = np.linalg.svd(lifted.T @ np.where(lifted @ turn > 0, 1.0, -1.0))
            turn = u @ w
        parts.append(turn)
    return Coder(np.hstack(parts)[:, :bits], top)


class Index:
    """The substrings' indexes over one block of vectors: the values that occur, and the rows of each."""

    def __init__(self, coder: Coder, ids: np.ndarray, vectors: np.ndarray) -> None:
        self.coder, self.ids, self.vectors = coder, ids, vectors
        code = coder.codes(coder.lift(vectors))
        self.wide = np.ascontiguousarray(code).view(np.uint64)
        self.order = [np.argsort(code[:, s], kind="stable") for s in range(code.shape[1])]
        self.values, self.first = [], []
        for s, o in enumerate(self.order):
            value, first = np.unique(code[o, s], return_index=True)
            self.values.append(value)
            self.first.append(np.append(first, len(o)))
        self.radius, self.tried, self.met = self.affordable(), 0, 0

    def within(self, code: np.ndarray, apart: list[np.ndarray], radius: int) -> np.ndarray:
        """Rows whose codes lie within the radius, by the pigeonhole principle: with radius = m * r + a, some substring among
        the first a + 1 is within r bits of the query's, or another within r - 1. Occurring values are fewer than those
        of such a ball, so the buckets are chosen from them."""
        m, some = len(code), np.zeros(len(self.ids), bool)
        for s in range(m):
            level = radius // m - (s > radius % m)
            bucket = np.flatnonzero(apart[s] <= level) if level >= 0 else np.zeros(0, np.int64)
            a = self.first[s][bucket]
            n = self.first[s][bucket + 1] - a
            at = np.repeat(a - np.append(0, np.cumsum(n)[:-1]), n) + np.arange(int(n.sum())) if len(a) else a
            some[self.order[s][at]] = True
        rows = np.flatnonzero(some)
        far = np.bitwise_count(self.wide[rows] ^ np.ascontiguousarray(code).view(np.uint64)).sum(axis=1, dtype=np.int64)
        return rows[far <= radius]

    def affordable(self) -> int:
        """The largest radius that costs half as much to probe as the products with all rows do, for codes spread evenly; or -1."""
        m, rows = len(self.order), len(self.ids)
        ball = np.cumsum([0, *(math.comb(SUB, d) for d in range(SUB + 1))]) / 2**SUB
        radius = np.arange(SUB * m + 1)[:, None]
        visited = ball[np.minimum(radius // m - (np.arange(m) > radius % m), SUB) + 1].sum(axis=1)
        within = np.cumsum([math.comb(SUB * m, d) / 2 ** (SUB * m) for d in range(SUB * m + 1)])
        cost = (CALL + VALUE * sum(map(len, self.values)) + VISIT * visited * rows) * 64 / self.vectors.shape[1] + FETCH * within * rows
        return int((2 * cost < rows).sum()) - 1

    def probed(self, query: np.ndarray, own: int, code: np.ndarray, length: float, k: int, z: float) -> np.ndarray | None:
        """Rows within the affordable radius, if the k-th best of them is met there by z deviations."""
        bits = self.coder.bits
        rows = self.within(code, [np.bitwise_count(v ^ code[s]) for s, v in enumerate(self.values)], self.radius)
        rows = rows[self.ids[rows] != own]
        if len(rows) < k:
            return None
        best = np.partition(self.vectors[rows] @ query, -k)[-k]
        p = np.arccos(np.clip(best / max(length, 1e-300), -1, 1)) / np.pi
        return rows if np.ceil(bits * p + z * np.sqrt(bits * p * (1 - p))) <= self.radius else None

    def search(self, queries: np.ndarray, own: np.ndarray, k: int, z: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, row, inner product) of the k best rows found for each query but those of its own id, best first."""
        found = [self._some(queries[a : a + QUERIES], own[a : a + QUERIES], k, z, a) for a in range(0, len(queries), QUERIES)]
        return tuple(np.concatenate(v) for v in zip(*found))  # type: ignore[return-value]

    def _some(self, queries: np.ndarray, own: np.ndarray, k: int, z: float, at: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        lifted = self.coder.lift(queries)
        length = np.sqrt((lifted * lifted).sum(axis=1) * self.coder.top)
        one, two, rest = [], [], np.ones(len(queries), bool)
        if self.radius >= 0 and 2 * self.met >= self.tried:
            for q, code in enumerate(self.coder.codes(lifted)):
                if (rows := self.probed(queries[q], own[q], code, length[q], k, z)) is not None:
                    one.append(np.full(len(rows), q))
                    two.append(rows)
                    rest[q] = False
            self.tried += len(queries)
            self.met += int((~rest).sum())
        left = np.flatnonzero(rest)
        floor = np.full(len(left), -np.inf)
        if len(left) and min(HEAD, len(self.ids)) > k:
            head = queries[left] @ self.vectors[:HEAD].T
            head[own[left, None] == self.ids[None, :HEAD]] = -np.inf
            floor = np.partition(head, -k, axis=1)[:, -k] - 1e-15 * queries.shape[1] * length[left]  # sums round in other ways elsewhere
        for a in range(0, len(self.ids) if len(left) else 0, ROWS):
            q, rows = np.nonzero(queries[left] @ self.vectors[a : a + ROWS].T >= floor[:, None])
            one.append(left[q])
            two.append(rows + a)
        q, rows = np.concatenate(one), np.concatenate(two)
        other = self.ids[rows] != own[q]
        q, rows = q[other], rows[other]
        part = max(1, (1 << 22) // queries.shape[1])  # many vectors may be equally near
        # row by row, as a matrix product's order of additions depends on how many rows it is given
        product = np.concatenate([np.einsum("ij,ij->i", self.vectors[rows[a : a + part]], queries[q[a : a + part]]) for a in range(0, max(1, len(q)), part)])
        order = np.lexsort((self.ids[rows], -product, q))
        q, rows, product = q[order], rows[order], product[order]
        best = np.arange(len(q)) - np.searchsorted(q, q, "left") < k
        return q[best] + at, rows[best], product[best]


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """_id and _v (floats if they are given as such, else doubles) of the rows that take part: vectors without null or non-finite components that aren't zero."""
    if not isinstance(vectors.schema[vector_col].dataType, ArrayType):
        raise TypeError(f"{vector_col} is no array")
    kind = "array<float>" if isinstance(vectors.schema[vector_col].dataType.elementType, FloatType) else "array<double>"
    v = F.col("_v")
    good = v.isNotNull() & (F.size(v) > 0) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = vectors.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{vector_col}`").cast(kind).alias("_v"))
    return rows.filter(F.col("_id").isNotNull() & good)


def search(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", every: int = 20, k: int = 20, bits: int = 128, sample_rows: int = 4096, recall: float = 0.9, base_rows: int = 49_152, query_rows: int = 16_384) -> DataFrame:
    """query_id, rank (from 1), the id and score (inner product in double precision) of each query's k nearest rows.

    Queries: rows whose id is divisible by `every`; candidates: all rows but those with the query's own id. Vectors that are
    null, empty, zero, or hold null or non-finite components take no part, nor do null ids; vectors of different numbers
    of components are an error. Ties go to the smaller id; rows that repeat an id are a candidate each, but one query, by the
    least of their vectors. With no query there are no rows; other columns are not read. Rotations are learned from the sample_rows of least hash;
    every row is indexed. Blocks of rows (base_rows) meet blocks of queries (query_rows) task by task."""
    spark = vectors.sparkSession
    kind = vectors.schema[id_col].dataType.simpleString()
    rows = keep(usable(vectors, id_col, vector_col), "vectors")
    facts = rows.agg(F.max(F.aggregate("_v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))), F.count("*"), F.min(F.size("_v")), F.max(F.size("_v"))).first()
    schema = f"query_id {kind}, {id_col} {kind}, score double"
    if not facts[1]:
        return spark.createDataFrame([], f"query_id {kind}, rank int, {id_col} {kind}, score double")
    if facts[2] != facts[3]:
        raise ValueError("vectors of different numbers of components")
    chosen = rows.select("_v", F.xxhash64("_id", "_v").alias("_h")).orderBy("_h").limit(sample_rows)
    coder = learn(np.array([r[0] for r in chosen.select("_v").collect()]), float(facts[0]), bits)
    held = spark.sparkContext.broadcast(coder)
    asked = rows.filter(F.col("_id") % every == 0).groupBy("_id").agg(F.min("_v").alias("_v"))
    bases, groups = max(1, -(-facts[1] // base_rows)), max(1, -(-asked.count() // query_rows))
    salt = lambda n, seed: F.pmod(F.xxhash64("_id", "_v", F.lit(seed), F.monotonically_increasing_id()), F.lit(n)).cast("int")
    left = rows.withColumn("base", salt(bases, 1)).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    right = asked.withColumn("part", salt(groups, 2)).withColumn("base", F.explode(F.sequence(F.lit(0), F.lit(bases - 1))))
    z = _normal(recall)

    def meet(one: pa.Table, two: pa.Table) -> pa.Table:
        own, other, score = (np.zeros(0) for _ in range(3))
        if one.num_rows and two.num_rows:
            read = lambda t: (t.column("_id").to_numpy(), t.column("_v").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(t.num_rows, -1))
            index, (ids, queries) = Index(held.value, *read(one)), read(two)
            ids, queries = ids[by := np.argsort(ids)], queries[by]  # so that reruns try probing for the same ones
            query, row, score = index.search(queries, ids, k, z)
            own, other = ids[query], index.ids[row]
        types = [one.schema.field("_id").type] * 2 + [pa.float64()]
        return pa.table([pa.array(c).cast(t) for c, t in zip((own, other, score), types)], names=["query_id", id_col, "score"])

    found = left.select("base", "part", "_id", "_v").groupBy("base", "part").cogroup(right.select("base", "part", "_id", "_v").groupBy("base", "part")).applyInArrow(meet, schema)
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col(id_col))
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", id_col, "score")


def _normal(p: float) -> float:
    from statistics import NormalDist

    return NormalDist().inv_cdf(p)


def digest(vectors: DataFrame) -> DataFrame:
    return search(vectors)
