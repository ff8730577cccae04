"""Quality classifier: a convolutional network over bytes, trained and run in numpy.

Bytes have learned vectors, another one where the last 8 bytes repeat those a short lag before; filters slide over chunks of `width` bytes, `stride` apart, over the whole text; each filter keeps
its largest value, and a last layer combines these into one probability. Only the chunk that gave a maximum has a gradient,
so training costs little more than scoring.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from xylem.llm.util import keep, pieces, utf8

PAD, ECHO, LAGS = 256, 257, range(2, 25)


@dataclass
class Net:
    embed: np.ndarray
    filters: np.ndarray
    bias: np.ndarray
    out: np.ndarray
    shift: float
    width: int
    stride: int


def fresh(seed: int, width: int = 16, stride: int = 4, dims: int = 8, filters: int = 32) -> Net:
    rng = np.random.default_rng(seed)
    embed = rng.normal(0, 0.5, (2 * ECHO, dims)).astype(np.float32)
    embed[PAD] = 0
    return Net(embed, rng.normal(0, (2 / (width * dims)) ** 0.5, (width * dims, filters)).astype(np.float32), np.zeros(filters, np.float32), rng.normal(0, 0.1, filters).astype(np.float32), 0.0, width, stride)


def symbols(buf: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Each byte, plus ECHO where the 8 bytes up to it repeat those of its row a lag before."""
    n = len(buf)
    echo, place = np.zeros(n, bool), np.arange(n) - np.repeat(at[:-1], np.diff(at))
    for lag in LAGS:
        if n < lag + 8:
            break
        same = buf[lag:] == buf[:-lag]
        for k in (1, 2, 4):
            same = same[k:] & same[:-k]
        echo[lag + 7 :] |= same & (place[lag + 7 :] >= lag + 7)
    return buf.astype(np.int64) + ECHO * echo


def pooled(net: Net, buf: np.ndarray, at: np.ndarray, track: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Each row's largest value of every filter and, if tracked, the byte offset of the chunk that gave it."""
    buf = symbols(buf, at)
    n, size = len(at) - 1, np.diff(at)
    chunks = np.maximum(1, -(-size // net.stride))
    room = chunks * net.stride
    begin = np.append(0, np.cumsum(room))
    best = np.full((n, net.filters.shape[1]), -np.inf, np.float32)
    arg = np.zeros((n, net.filters.shape[1]), np.int64)
    for a, b in pieces(begin, 1 << 16):
        rows = np.arange(a, b)
        gap = room[a:b] + net.width
        start = np.append(0, np.cumsum(gap))
        flat = np.full(int(start[-1]), PAD, np.int64)
        lens = size[a:b]
        to = np.repeat(start[:-1] - (at[a:b] - at[a]), lens) + np.arange(int(lens.sum()))
        flat[to] = buf[at[a] : at[b]]
        first = np.append(0, np.cumsum(chunks[a:b]))
        pos = np.repeat(start[:-1] - first[:-1] * net.stride, chunks[a:b]) + np.arange(int(first[-1])) * net.stride
        for lo in range(0, len(pos), 1 << 14):  # a long row is handled in parts
            part = pos[lo : lo + (1 << 14)]
            x = net.embed[flat[part[:, None] + np.arange(net.width)]].reshape(len(part), -1)
            y = x @ net.filters
            owner = np.searchsorted(first, np.arange(lo, lo + len(part)), "right") - 1
            cut = np.flatnonzero(np.diff(owner, prepend=-1))
            top = np.maximum.reduceat(y, cut, axis=0)
            for i, (c, r) in enumerate(zip(cut, rows[owner[cut]])):
                better = top[i] > best[r]
                if better.any():
                    e = cut[i + 1] if i + 1 < len(cut) else len(part)
                    best[r, better] = top[i][better]
                    if track:
                        arg[r, better] = part[c + y[c:e][:, better].argmax(axis=0)] - start[r - a]
    return np.maximum(best + net.bias, 0), arg


def score(net: Net, buf: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Probability that each row has label 1; an empty row is one chunk of padding."""
    tops = [pooled(net, buf[at[a] : at[b]], at[a : b + 1] - at[a])[0] for a, b in pieces(at, 1 << 20)]
    top = np.concatenate(tops) if tops else np.zeros((0, len(net.out)), np.float32)
    return 1 / (1 + np.exp(-(top.astype(np.float64) @ net.out + net.shift)))


def train(texts: list[bytes], labels: np.ndarray, weights: np.ndarray, seed: int = 3, epochs: int = 8, least_steps: int = 300, batch: int = 32, rate: float = 0.01) -> Net:
    """Adam over the weighted log loss, with more epochs where the texts are few. Texts are used whole."""
    epochs = max(epochs, -(-least_steps // -(-len(texts) // batch)))
    net, rng = fresh(seed), np.random.default_rng(seed)
    params = [net.embed, net.filters, net.bias, net.out, np.zeros(1, np.float32)]
    m, v = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    arrays = [np.frombuffer(t, np.uint8) for t in texts]
    step = 0
    for epoch in range(epochs):
        order = rng.permutation(len(arrays))
        for lo in range(0, len(order), batch):
            ids = order[lo : lo + batch]
            at = np.append(0, np.cumsum([len(arrays[i]) for i in ids])).astype(np.int64)
            buf = np.concatenate([arrays[i] for i in ids]) if at[-1] else np.zeros(0, np.uint8)
            top, arg = pooled(net, buf, at, True)
            seen = symbols(buf, at)
            p = 1 / (1 + np.exp(-(top @ net.out + params[4][0])))
            d = ((p - labels[ids]) * weights[ids]).astype(np.float32) / len(ids)
            grads = [np.zeros_like(net.embed), np.zeros_like(net.filters), None, top.T @ d, np.array([d.sum()], np.float32)]
            dtop = d[:, None] * net.out[None, :] * (top > 0)
            grads[2] = dtop.sum(axis=0)
            r, f = np.nonzero(dtop)
            where = arg[r, f][:, None] + np.arange(net.width)
            lens = np.diff(at)[r][:, None]
            codes = np.where(where < lens, seen[np.minimum(at[r][:, None] + where, max(0, len(buf) - 1))] if len(buf) else PAD, PAD)
            x, g = net.embed[codes].reshape(len(r), -1), dtop[r, f]
            np.add.at(grads[1].T, f, g[:, None] * x)
            np.add.at(grads[0], codes, (g[:, None] * net.filters.T[f]).reshape(*codes.shape, -1))
            grads[0][PAD] = 0
            step += 1
            lr = rate * (1 - epoch / epochs) + 1e-4
            for k, gr in enumerate(grads):
                m[k] = 0.9 * m[k] + 0.1 * gr
                v[k] = 0.999 * v[k] + 0.001 * gr * gr
                params[k] -= lr * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
            net.shift = float(params[4][0])
    return net


def sample(docs: DataFrame, key: DataFrame, per_class: int, max_bytes: int) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """Texts, labels and weights of at most per_class rows of each label and about max_bytes of their texts.

    The ids of least hash are chosen from the labels alone, twice as many as needed (some may have no document); so few are
    broadcast, and no text is shuffled. Weights restore the labels' true shares, and so the scale of the score."""
    spark = docs.sparkSession
    key = keep(key, "labels")
    total = {r[0]: r[1] for r in key.groupBy("_label").count().collect()}
    ids = [r for label in (0, 1) for r in key.filter(F.col("_label") == label).orderBy(F.xxhash64("_key"), "_key").limit(2 * per_class).collect()]
    chosen = F.broadcast(spark.createDataFrame(ids, key.schema))  # 4 * per_class rows at most
    rows = docs.join(chosen, F.col("_id") == F.col("_key")).select("_text", "_label", F.xxhash64("_id", "_text").alias("_h"), F.octet_length("_text").alias("_n"))
    rows = keep(rows, "sample")
    texts, labels, weights = [], [], []
    for label in (0, 1):
        heads = rows.filter(F.col("_label") == label).select("_h", "_n").orderBy("_h").limit(per_class).collect()
        fits, used = [], 0
        for h, n in heads:  # a text that doesn't fit is passed over, but each label has one at least
            if not fits or used + n <= max_bytes:
                fits.append(h)
                used += n
        if not fits:
            continue
        got = rows.filter((F.col("_label") == label) & F.col("_h").isin(fits)).orderBy("_h").limit(per_class).select("_text").collect()
        texts += [r[0].encode() for r in got]
        labels += [label] * len(got)
        weights += [total[label] / len(got)] * len(got)
    w = np.array(weights)
    return texts, np.array(labels, np.float64), w / w.mean() if len(w) else w


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", folds: int | None = 5, per_class: int = 1500, max_bytes: int = 6 << 20, seed: int = 3) -> Net:
    """The network, from a bounded sample of labelled rows; with folds, never from ids whose crc32 is 0 modulo folds.

    Labels other than 0 and 1 and labels without a document teach nothing; an id labelled twice counts with its smallest
    label, documents that repeat an id each count. Without any labelled row the network is untrained: every score is near 0.5."""
    key = labels.filter(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("_key")).agg(F.min(label_col).alias("_label"))
    rows = docs.select(F.col(f"`{id_col}`").alias("_id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("_text"))
    if folds:
        rows = rows.filter(remainder("_id", folds) != 0)
        key = key.filter(remainder("_key", folds) != 0)
    texts, y, w = sample(rows, key, per_class, max_bytes)
    return train(texts, y, w, seed) if len(texts) else fresh(seed)


def remainder(col: str, of: int) -> F.Column:
    """crc32 of the id as text, modulo `of`; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(col).cast("string"), F.lit("")).cast("binary")) % of


def score_texts(docs: DataFrame, net: Net, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and score of each row, from its whole text and nothing else. Null and empty texts get the score of no text."""
    kind = docs.schema[id_col].dataType.simpleString()
    held = docs.sparkSession.sparkContext.broadcast(net)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score(held.value, *utf8(batch.column(1))), pa.float64())], ["id", "score"])

    return docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text")).mapInArrow(run, f"id {kind}, score double").withColumnRenamed("id", id_col)


def keep_good(docs: DataFrame, net: Net, text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """The rows of docs that score the threshold or more, with all their columns. No shuffle."""
    held, at_col = docs.sparkSession.sparkContext.broadcast(net), docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(score(held.value, *utf8(batch.column(at_col))) >= threshold))

    return docs.mapInArrow(run, docs.schema)


def digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    got = score_texts(docs, fit(docs, labels))
    return got.select("doc_id", (remainder("doc_id", 5) == 0).alias("held_out"), "score", F.when(F.col("score") >= 0.3, 1).otherwise(0).alias("predicted"))
