"""Language-model scores by a weighted backoff automaton over word n-grams.

Texts are packed into blocks. A block asks for the corpus counts of just the n-grams that occur in it; the n-grams go, hashed and
packed, to buckets by ranges of their keys, which add the blocks' training counts up and answer. So no table of the whole vocabulary
is ever in one place, and a bucket holds about as many n-grams whatever the corpus. From the answers a block builds its part of
the automaton: a state for each context that the training texts hold, arcs for its known continuations, and a failure arc to the
context without its first word. One traversal from left to right, in many lanes at once, carries the state and adds the arcs'
log-probabilities, for each of several weightings; the one that gives the held-out texts the highest probability is kept.

Of order 1, p(w) = (c(w) + 1) / (N + V + 1); of order k, p(w | h) = (c(hw) + mass p(w | h')) / (c(h) + mass), which sums to 1.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from xylem.llm.util import keep, lower, mix64, span_hashes, utf8, words

END, PAD = np.uint64(0x2545F4914F6CDD1D), np.uint64(0x61C8864680B583EB)
_MUL, _ONE = np.uint64(0x9E3779B97F4A7C15), np.uint64(1)


def pack(numbers: np.ndarray) -> bytes:
    """Whole numbers of 8 bytes, their equal-ranking bytes side by side, compressed."""
    raw = np.ascontiguousarray(numbers.astype("<u8").view(np.uint8).reshape(-1, 8).T).tobytes()
    return len(raw).to_bytes(8, "little") + pa.compress(raw, "zstd", asbytes=True)


def unpack(data: bytes) -> np.ndarray:
    size = int.from_bytes(data[:8], "little")
    raw = pa.decompress(data[8:], size, "zstd", asbytes=True)
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(8, -1).T).view("<u8").reshape(-1)


@dataclass
class Grams:
    """Tokens of some rows, each row after order - 1 pads; keys[k - 1][i]: of the k tokens up to i, where there are as many."""

    row: np.ndarray
    place: np.ndarray
    keys: list[np.ndarray]
    order: int

    @property
    def predicted(self) -> np.ndarray:
        return self.place >= self.order - 1


WORD_BITS = 62


def tokens(buf: np.ndarray, at: np.ndarray, order: int, bits: int = WORD_BITS) -> Grams:
    """bits: of the keys of two tokens and more."""
    low, n = lower(buf), len(at) - 1
    starts, ends, row = words(low, at)
    count = np.bincount(row, minlength=n) if len(row) else np.zeros(n, np.int64)
    size = count + order
    first = np.append(0, np.cumsum(size))
    token = np.full(int(first[-1]), PAD, np.uint64)
    token[first[1:] - 1] = END
    before = np.append(0, np.cumsum(count)[:-1]) if n else np.zeros(0, np.int64)
    if len(row):
        token[first[row] + order - 1 + np.arange(len(row)) - before[row]] = span_hashes(low, starts, ends)
    rows = np.repeat(np.arange(n), size)
    place = np.arange(len(token)) - first[rows]
    full = mix64(token)
    word = full >> np.uint64(64 - WORD_BITS) | _ONE  # odd keys are of words and ends, not of pads
    word[token == PAD] &= ~_ONE
    keys = [word]
    for _ in range(2, order + 1):
        longer = np.zeros(len(token), np.uint64)
        with np.errstate(over="ignore"):
            longer[1:] = mix64(full[:-1] * _MUL + word[1:])
        full = longer
        keys.append(full >> np.uint64(64 - bits))
    return Grams(rows, place, keys, order)


def requests(g: Grams, train: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each order the different keys of the rows, ascending, and how often the training ones among them hold each."""
    mine, out = train[g.row].astype(np.uint64), []
    for k, key in enumerate(g.keys):
        valid = g.place >= k
        x = np.sort(key[valid] << _ONE | mine[valid])
        first = np.flatnonzero(np.append(True, x[1:] >> _ONE != x[:-1] >> _ONE)) if len(x) else np.zeros(0, np.int64)
        out.append((x[first] >> _ONE, np.add.reduceat((x & _ONE).astype(np.int64), first) if len(x) else first))
    return out


def bounds(buckets: int, bits: int) -> np.ndarray:
    """The least key of each bucket but the first."""
    return np.array([(b << bits) // buckets for b in range(1, buckets)], np.uint64)


class Arcs:
    """A hash table of whole numbers, filled and asked many at a time."""

    def __init__(self, keys: np.ndarray) -> None:
        self.keys = keys
        self.shift = np.uint64(64 - max(4, (2 * len(keys)).bit_length()))
        self.slots = np.full(1 << (64 - int(self.shift)), -1, np.int32)
        todo, at = np.arange(len(keys), dtype=np.int32), self._slot(keys)
        while len(todo):
            free = self.slots[at] < 0
            self.slots[at[free]] = todo[free]
            lost = self.slots[at] != todo
            todo, at = todo[lost], (at[lost] + 1) % len(self.slots)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (mix64(keys.view(np.uint64)) >> self.shift).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Each key's place among the table's keys, or -1."""
        at = self._slot(keys)
        out = self.slots[at]
        todo = np.flatnonzero((out >= 0) & (self.keys[out] != keys)) if len(self.keys) else np.zeros(0, np.int64)
        while len(todo):
            at[todo] = (at[todo] + 1) % len(self.slots)
            out[todo] = self.slots[at[todo]]
            todo = todo[(out[todo] >= 0) & (self.keys[out[todo]] != keys[todo])]
        return out


@dataclass
class Automaton:
    """Arcs by state << 32 | token; state 0 is the root, where a token without an arc weighs `unseen`. Weights have a column for
    each weighting."""

    arcs: Arcs
    target: np.ndarray
    weight: np.ndarray
    fail: np.ndarray
    fail_weight: np.ndarray
    unseen: float
    start: int


def numbers(g: Grams) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each order, every place's number among the different keys (as requests has them; -1 where there is none), and a place
    of each key."""
    out = []
    for k, key in enumerate(g.keys):
        where = np.flatnonzero(g.place >= k)
        order = np.argsort(key[where])
        by = key[where][order]
        new = np.append(True, by[1:] != by[:-1]) if len(by) else np.zeros(0, bool)
        number = np.full(len(key), -1, np.int64)
        number[where[order]] = np.cumsum(new) - 1
        out.append((number, where[order[new]]))
    return out


def build(g: Grams, ids: list[tuple[np.ndarray, np.ndarray]], total: list[np.ndarray], n: int, v: int, masses: list[tuple[float, ...]]) -> Automaton:
    """The automaton of the rows' n-grams, whose training counts are total, by order and number. masses: a weighting each."""
    states, fails, fail_weights = 1, [np.zeros(1, np.int64)], [np.zeros((1, len(masses)))]
    arcs, target, weight = [], [], []
    state_of = [np.zeros(1, np.int64)]
    for k in range(1, g.order + 1):
        number, at = ids[k - 1]
        c = total[k - 1]
        seen = c > 0
        if k == 1:
            p = np.repeat(((c + 1) / (n + v + 1))[:, None], len(masses), axis=1)
            source = shorter = np.zeros(len(at), np.int64)
        else:
            context, suffix = ids[k - 2][0][at - 1], ids[k - 2][0][at]
            mass = np.array([m[k - 2] for m in masses])
            p = (c[:, None] + mass * p[suffix]) / (total[k - 2][context][:, None] + mass)
            source, shorter = state_of[k - 1][context], state_of[k - 1][suffix]
        own = shorter
        if k < g.order:
            own = shorter.copy()
            own[seen] = states + np.arange(int(seen.sum()))
            states += int(seen.sum())
            fails.append(shorter[seen])
            mass = np.array([m[k - 1] for m in masses])
            fail_weights.append(np.log10(mass / (c[seen][:, None] + mass)))
            state_of.append(own)
        use = seen & (g.place[at] >= g.order - 1)
        arcs.append(source[use] << 32 | ids[0][0][at[use]])
        target.append(own[use])
        weight.append(np.log10(p[use]))
    pads = np.flatnonzero(g.place == g.order - 2)[:1]
    start = int(state_of[-1][ids[g.order - 2][0][pads[0]]]) if g.order > 1 and len(pads) else 0
    return Automaton(Arcs(np.concatenate(arcs)), np.concatenate(target), np.concatenate(weight), np.concatenate(fails), np.concatenate(fail_weights), float(np.log10(1 / (n + v + 1))), start)


def traverse(a: Automaton, g: Grams, token: np.ndarray, rows: int, lane: int = 256) -> np.ndarray:
    """Each row's log10 probability by each weighting. A lane begins order - 1 tokens early, without weight, and so in the
    right state."""
    many = a.weight.shape[1]
    out = np.zeros((rows, many))
    where = np.flatnonzero(g.predicted)
    if not len(where):
        return out
    place = g.place[where] - (g.order - 1)
    heads = where[place % lane == 0]
    row, inside = g.row[heads], g.place[heads] - (g.order - 1)
    end = np.append(heads[1:], len(token))
    last = np.flatnonzero(np.diff(g.row, append=-1)) + 1
    end = np.minimum(end, last[row])
    warm = np.where(inside > 0, np.minimum(inside, g.order - 1), 0)
    at, state, total = heads - warm, np.where(inside > 0, 0, a.start), np.zeros((len(heads), many))
    live = np.argsort(-(end - at), kind="stable")
    while len(live):
        here, s = token[at[live]], state[live]
        w, todo = np.zeros((len(live), many)), np.arange(len(live))
        while len(todo):
            i = a.arcs.find(s[todo] << 32 | here[todo])
            hit, miss = i >= 0, todo[i < 0]
            w[todo[hit]] += a.weight[i[hit]]
            s[todo[hit]] = a.target[i[hit]]
            lost = s[miss] == 0
            w[miss[lost]] += a.unseen
            todo = miss[~lost]
            w[todo] += a.fail_weight[s[todo]]
            s[todo] = a.fail[s[todo]]
        w[at[live] < heads[live]] = 0
        total[live] += w
        state[live] = s
        at[live] += 1
        live = live[at[live] < end[live]]
    for m in range(many):
        out[:, m] = np.bincount(row, total[:, m], rows)
    return out


def by_key(batches: Iterator[pa.RecordBatch], column: int = 0) -> Iterator[list[tuple]]:
    """Rows with one value in a column; they come sorted by it."""
    held: list[tuple] = []
    for batch in batches:
        columns = batch.columns
        for i in range(batch.num_rows):
            row = tuple(c[i] for c in columns)
            if held and held[0][column].as_py() != row[column].as_py():
                yield held
                held = []
            held.append(row)
    if held:
        yield held


def pack_blocks(docs: DataFrame, id_col: str, text_col: str, held_out: F.Column, block_bytes: int) -> DataFrame:
    """The rows, in blocks of about block_bytes of text (a longer text is a block by itself), written out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held, size = TaskContext.get().partitionId() << 32, [], 0

        def close() -> pa.RecordBatch:
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, held[0].schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                out.write_table(pa.Table.from_batches(held).combine_chunks())
            return pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([size], pa.int64()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["block", "size", "docs"])

        for batch in batches:
            at = utf8(batch.column(1))[1]
            a = 0
            while a < batch.num_rows:
                b = max(a + 1, int(np.searchsorted(at, at[a] + block_bytes - size, "right")) - 1)
                b = min(b, batch.num_rows)
                held.append(batch.slice(a, b - a))
                size += int(at[b] - at[a])
                a = b
                if size >= block_bytes or a < batch.num_rows:
                    yield close()
                    number, held, size = number + 1, [], 0
        if held:
            yield close()

    cols = docs.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"), held_out.alias("held_out"))
    return keep(cols.mapInArrow(run, "block long, size long, docs binary"), "blocks")


def open_block(data: pa.Scalar, order: int, bits: int) -> tuple[pa.Table, Grams, np.ndarray]:
    rows = pa.ipc.open_stream(data.as_buffer()).read_all().combine_chunks()
    return rows, tokens(*utf8(rows.column(1)), order, bits), ~rows.column(2).to_numpy().astype(bool)


#: Weightings among which the held-out texts choose: the mass of the lower order, for orders 2 and 3.
MASSES = ((1000.0, 30.0), (1000.0, 10.0), (1000.0, 3.0), (4000.0, 10.0))


def score_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = 7, fold: int = 2, masses: Sequence[tuple[float, ...]] = MASSES, block_bytes: int = 4 << 20, bucket_grams: int = 6_000_000, most_parts: int = 20_000) -> DataFrame:
    """id, held_out, n_tokens, n_known, train_tokens, base_score and score of each row.

    masses: one or more weightings, each the weights of the lower order for orders 2 and up; their length sets the automaton's
    order. Of several, the one is taken by which all held-out rows together are likeliest (the first of equal ones, and where
    nothing is held out). Rows whose id's crc32 is `fold` modulo `folds` are held out, the others are learnt from, each as often
    as it occurs. Null and empty texts are one end token; a null id counts as the empty text in the fold. Other columns are not
    read. An empty table gives no rows.

    The counts are those of all training rows, with no cap: what is shuffled grows with the texts. Words have keys of 62 bits;
    those of longer n-grams have 20 bits more than would number all n-grams, so that about one n-gram in a million shares its
    key. A bucket is asked for about bucket_grams n-grams, and has a partition of its own up to most_parts of them."""
    order = len(masses[0]) + 1
    if any(len(m) + 1 != order for m in masses):
        raise ValueError("weightings of different orders")
    kind = docs.schema[id_col].dataType.simpleString()
    crc = F.crc32(F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("")).cast("binary"))
    blocks = pack_blocks(docs, id_col, text_col, crc % folds == fold, block_bytes)
    facts = blocks.agg(F.count("*"), F.sum("size")).first()
    grams = order * (int(facts[1] or 0) // 4 + 1)  # about four bytes a token
    buckets, parts = -(-grams // bucket_grams), max(1, min(facts[0], most_parts))
    bits = min(WORD_BITS, grams.bit_length() + 20)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cuts = [bounds(buckets, WORD_BITS)] + [bounds(buckets, bits)] * (order - 1)
        for batch in batches:
            for number, data in zip(batch.column(0), batch.column(1)):
                _, g, train = open_block(data, order, bits)
                own = requests(g, train)
                ends = [np.concatenate([[0], np.searchsorted(key, cut), [len(key)]]) for (key, _), cut in zip(own, cuts)]
                for lo in range(0, buckets, 256):
                    some = range(lo, min(lo + 256, buckets))
                    packed = []
                    for b in some:
                        spans = [slice(e[b], e[b + 1]) for e in ends]
                        packed.append(pack(np.concatenate([np.array([s.stop - s.start for s in spans], np.uint64), *[np.diff(key[s], prepend=np.uint64(0)) for (key, _), s in zip(own, spans)], *[c[s].view(np.uint64) for (_, c), s in zip(own, spans)]])))
                    yield pa.RecordBatch.from_arrays([pa.array(list(some), pa.int64()), pa.array([number.as_py()] * len(some), pa.int64()), pa.array(packed, pa.binary())], ["bucket", "block", "data"])

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in by_key(batches):
            asked = [unpack(r[2].as_buffer().to_pybytes()) for r in rows]
            sizes = np.array([x[:order] for x in asked], np.int64)
            answers: list[list[np.ndarray]] = [[] for _ in rows]
            n = v = 0
            for k in range(order):
                before, all_ = sizes[:, :k].sum(axis=1) + order, sizes.sum(axis=1)
                key = np.concatenate([np.cumsum(x[a : a + m], dtype=np.uint64) for x, a, m in zip(asked, before, sizes[:, k])])
                count = np.concatenate([x[a : a + m] for x, a, m in zip(asked, before + all_, sizes[:, k])]).astype(np.int64)
                by = np.argsort(key)
                new = np.append(True, key[by[1:]] != key[by[:-1]]) if len(key) else np.zeros(0, bool)
                number = np.cumsum(new) - 1
                total = np.add.reduceat(count[by], np.flatnonzero(new)) if len(key) else count
                back = np.empty(len(key), np.int64)
                back[by] = total[number] if len(key) else total
                for out, part in zip(answers, np.split(back, np.cumsum(sizes[:-1, k]))):
                    out.append(part)
                if not k:
                    single = (key[by[new]] & _ONE).astype(bool) & (total > 0)
                    n, v = int(total[single].sum()), int(single.sum())
            bucket = rows[0][0].as_py()
            out_rows = [(r[1].as_py(), bucket, pack(np.concatenate([s, *x])), 0, 0) for r, s, x in zip(rows, sizes, answers)]
            out_rows.append((-1, bucket, b"", n, v))
            for a in range(0, len(out_rows), 256):
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out_rows[a : a + 256]), [pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64()])], ["block", "bucket", "data", "n", "v"])

    asked = blocks.select("block", "docs").mapInArrow(ask, "bucket long, block long, data binary")
    to = F.pmod(F.col("bucket"), F.lit(min(buckets, most_parts))).cast("int")
    answered = keep(asked.repartitionById(min(buckets, most_parts), to).sortWithinPartitions("bucket", "block").mapInArrow(answer, "block long, bucket long, data binary, n long, v long"), "answers")
    sums = answered.filter("block = -1").agg(F.sum("n"), F.sum("v")).first()
    n, v = int(sums[0] or 0), int(sums[1] or 0)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in by_key(batches):
            docs_, g, train = open_block(rows[0][2], order, bits)
            parts: list[list[np.ndarray]] = [[] for _ in range(order)]
            for r in rows[1:]:
                x = unpack(r[2].as_buffer().to_pybytes()).astype(np.int64)
                for own, part in zip(parts, np.split(x[order:], np.cumsum(x[: order - 1]))):
                    own.append(part)
            total, ids = [np.concatenate(p) for p in parts], numbers(g)
            if [len(t) for t in total] != [len(at) for _, at in ids]:
                raise RuntimeError("the answers don't fit the block's n-grams")
            a = build(g, ids, total, n, v, masses)
            p, many = g.predicted, docs_.num_rows
            c = total[0][ids[0][0][p]]
            row = g.row[p]
            base = np.bincount(row, np.log10((c + 1) / (n + v + 1)), many)
            got = traverse(a, g, ids[0][0], many)
            cols = [docs_.column(0).combine_chunks(), pa.array(~train), pa.array(np.bincount(row, minlength=many).astype(np.int64)), pa.array(np.bincount(row, c > 0, many).astype(np.int64)), pa.array(np.full(many, n, np.int64)), pa.array(base), pa.FixedSizeListArray.from_arrays(pa.array(got.reshape(-1)), got.shape[1]).cast(pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays([x.chunk(0) if isinstance(x, pa.ChunkedArray) else x for x in cols], ["id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "scores"])

    both = blocks.select("block", F.lit(-1).cast("long").alias("bucket"), F.col("docs").alias("data")).unionByName(answered.filter("block >= 0").select("block", "bucket", "data"))
    scored = both.repartition(parts, "block").sortWithinPartitions("block", "bucket").mapInArrow(score, f"id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, scores array<double>")
    best = 0
    if len(masses) > 1:
        scored = keep(scored, "scores")
        likely = scored.filter("held_out").agg(*[F.sum(F.col("scores")[m]) for m in range(len(masses))]).first()
        if likely[0] is not None:
            best = max(range(len(masses)), key=lambda m: likely[m])
    return scored.select(F.col("id").alias(id_col), "held_out", "n_tokens", "n_known", "train_tokens", "base_score", F.col("scores")[best].alias("score"), F.lit(",".join(map(str, masses[best]))).alias("mass"))


def digest(docs: DataFrame) -> DataFrame:
    return score_texts(docs)
