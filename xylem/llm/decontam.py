"""Benchmark decontamination by the q-gram lemma.

A benchmark item is cut into overlapping patterns: long ones with a wide budget of edits, and short ones, close together and
with a narrow one, for excerpts. Within e edits of a pattern of m bytes, a region of a text shares at least
m - q + 1 - e * q of its q-grams with it, all on e + 1 neighbouring diagonals. Shared q-grams are therefore counted in bands
of 2 (e + 1) diagonals that overlap by half, so that one band holds them all; bands that meet the bound are aligned, within
their own diagonals and e more on either side.
"""

from __future__ import annotations

import bisect
import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType

from xylem.llm.util import SPACE, distinct, lower, pieces, utf8

Q = 8
_MUL = np.uint64(0x9E3779B97F4A7C15)
#: Shared q-grams that are laid out at once.
_ROOM = 1 << 21


def _fold(buf: np.ndarray) -> np.ndarray:
    """Lower case; any white space is a blank."""
    return np.where(SPACE[buf], np.uint8(32), lower(buf))


def grams(buf: np.ndarray) -> np.ndarray:
    """Each Q bytes from every offset on, as one number."""
    if len(buf) < Q:
        return np.zeros(0, np.uint64)
    return np.ndarray((len(buf) - Q + 1,), "<u8", np.ascontiguousarray(buf).data, strides=(1,)).astype(np.uint64)


@dataclass
class Kind:
    """Patterns of one kind by ascending start, a place in the items' bytes end to end: where each starts, its bytes, edits and
    the shared q-grams that it asks for; edits_at: the budget at each place; alike: equal for patterns of equal bytes. A region of a text within the budget of any of
    them has `least` hits or more in at most `widest` bytes."""

    start: np.ndarray
    size: np.ndarray
    edits: np.ndarray
    bound: np.ndarray
    edits_at: np.ndarray
    alike: np.ndarray

    @property
    def least(self) -> int:
        return int(self.bound.min())

    @property
    def widest(self) -> int:
        return int((self.size + 2 * self.edits).max())


@dataclass
class Patterns:
    """body: the different items' folded bytes, end to end, item k from first[k] on; owners: the given items of each.

    keys: the q-grams that occur in them, ascending; entries: key's number * len(body) + place, ascending."""

    body: np.ndarray
    first: np.ndarray
    owners: list[list[int]]
    keys: np.ndarray
    entries: np.ndarray
    filter: np.ndarray
    kinds: list[Kind]

    def item(self, place: int) -> int:
        return int(np.searchsorted(self.first, place, "right")) - 1


def index(items: list[bytes], length: int = 120, rate: float = 0.1, short: int = 60, stride: int = 10, short_rate: float = 0.05) -> Patterns:
    """Patterns of up to `length` bytes, from every half of it on; items shorter than that are one pattern each. Items longer
    than short + stride are also cut into patterns of `short` bytes, from every `stride` bytes on.

    The budget is rate * m edits (short_rate * m for the short ones), less if the lemma would then ask for no q-gram (very
    short items). A verbatim excerpt of short + stride - 1 - 2 * int(short_rate * short) bytes, 63, lacks no more bytes of
    some pattern than its budget, and so is surely found."""
    owners: dict[bytes, list[int]] = {}
    for k, raw in enumerate(items):
        body = _fold(np.frombuffer(raw, np.uint8)).tobytes()
        if len(body.strip()) >= Q:
            owners.setdefault(body, []).append(k)
    first = np.append(0, np.cumsum([len(b) for b in owners])).astype(np.int64)
    all_ = np.frombuffer(b"".join(owners), np.uint8)
    cuts: tuple[list, list] = ([], [])
    step = length // 2
    for at, body in zip(first.tolist(), owners):
        n = len(body)
        cuts[0].extend([(at, n)] if n <= length + step // 2 else [(at + s, length) for s in dict.fromkeys((*range(0, n - length, step), n - length))])
        if n > short + stride:
            cuts[1].extend((at + s, short) for s in dict.fromkeys((*range(0, n - short, stride), n - short)))
    kinds = []
    for own, of in zip(cuts, (rate, short_rate)):
        own = [(s, m) for s, m in own if len(all_[s : s + m].tobytes().strip()) >= Q]
        if own:
            start, size = np.array(own, np.int64).T
            edits = np.maximum(0, np.minimum((size * of).astype(np.int64), (size - Q) // Q))
            edits_at = np.zeros(len(all_), np.int64)
            for s, m, e in zip(start, size, edits):
                edits_at[s : s + m] = e  # the same for all patterns of an item
            seen: dict[bytes, int] = {}
            alike = np.array([seen.setdefault(all_[s : s + m].tobytes(), len(seen)) for s, m in own])
            kinds.append(Kind(start, size, edits, np.maximum(1, size - Q + 1 - edits * Q), edits_at, alike))
    g = grams(all_)
    place = np.flatnonzero(np.arange(len(g)) + Q <= first[np.searchsorted(first, np.arange(len(g)), "right")]) if len(g) else np.zeros(0, np.int64)
    keys, number = np.unique(g[place], return_inverse=True)
    bits = np.zeros(1 << max(20, (8 * len(keys)).bit_length()), bool)
    bits[_slot(keys, bits)] = True
    return Patterns(all_, first, list(owners.values()), keys, np.sort(number.reshape(-1) * max(1, len(all_)) + place), bits, kinds)


def _slot(key: np.ndarray, bits: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return (key * _MUL) >> np.uint64(65 - len(bits).bit_length())


def banded(patterns: np.ndarray, windows: np.ndarray, valid: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Fewest edits that make each pattern (rows of n x m) a piece of its window along the band's diagonals, and the diagonals
    on which that piece starts and ends.

    windows: n x (m + diagonals - 1) bytes, the first one that of the pattern's first byte on diagonal 0; valid: n x (m +
    diagonals), whether a place, before that byte, lies in the text. Only cells of the band are computed, for all n at once;
    a cell holds its cost and, below it, the diagonal on which its path began."""
    n, m = patterns.shape
    wide = windows.shape[1] - m + 1
    far, one = np.int32(1 << 29), np.int32(1 << 16)
    step = np.arange(wide, dtype=np.int32) * one
    cell = np.where(valid[:, :wide], np.arange(wide, dtype=np.int32), far)
    for i in range(m):
        new = cell + one * (windows[:, i : i + wide] != patterns[:, i : i + 1])
        np.minimum(new[:, :-1], cell[:, 1:] + one, out=new[:, :-1])
        new = np.minimum.accumulate(new - step, axis=1) + step  # bytes of the text alone
        cell = np.where(valid[:, i + 1 : i + 1 + wide], new, far)
    end = cell.argmin(axis=1)
    best = cell[np.arange(n), end]
    return best >> 16, best & 0xFFFF, end


def regions(pats: Patterns, buf: np.ndarray, at: np.ndarray) -> list[tuple[int, int, int, int, int, int]]:
    """(row, item, pattern's start in the item, start, end, edits) of the rows' regions that lie within a pattern's budget;
    byte offsets in the row. Regions of one pattern don't overlap."""
    if not len(pats.keys) or len(buf) < Q:
        return []
    text = _fold(buf)
    g = grams(text)
    where = np.flatnonzero(pats.filter[_slot(g, pats.filter)])
    k = np.searchsorted(pats.keys, g[where])
    k[k == len(pats.keys)] = 0
    same = pats.keys[k] == g[where]
    where, k = where[same], k[same]
    row = np.searchsorted(at, where, "right") - 1
    inside = where + Q <= at[row + 1]
    where, k, row = where[inside], k[inside], row[inside]
    out: list[tuple[int, int, int, int, int, int]] = []
    for kind in pats.kinds if len(where) else []:
        found = sorted(set(_dense(pats, kind, text, at, where, k, row)))
        for _, same in itertools.groupby(sorted(found, key=lambda x: (x[0], x[1], x[4], x[2])), key=lambda x: x[:2]):
            taken: list[tuple[int, int]] = []
            for r, p, lo, hi, e in same:  # fewest edits first; those taken don't overlap, so two neighbours tell
                i = bisect.bisect(taken, (lo, hi))
                if (i and taken[i - 1][1] > lo) or (i < len(taken) and taken[i][0] < hi):
                    continue
                taken.insert(i, (lo, hi))
                item = pats.item(int(kind.start[p]))
                out += [(r, owner, int(kind.start[p] - pats.first[item]), lo, hi, e) for owner in pats.owners[item]]
    return sorted(out)


def _dense(pats: Patterns, kind: Kind, text: np.ndarray, at: np.ndarray, where: np.ndarray, k: np.ndarray, row: np.ndarray) -> Iterator[tuple[int, int, int, int, int]]:
    # a region holds `least` hits or more, so it lies where that many hits are within its width
    left = np.arange(len(where)) - np.searchsorted(where, where - kind.widest, "left") + 1
    right = np.searchsorted(where, where + kind.widest, "right") - np.arange(len(where))
    dense = left + right - 1 >= kind.least
    where, k, row = where[dense], k[dense], row[dense]
    if not len(where):
        return
    # where a q-gram repeats byte by byte, hits a band's half apart, and the ends, meet the same bands as all of them
    new = np.append(True, (np.diff(where) != 1) | (np.diff(k) != 0) | (np.diff(row) != 0))
    head = np.flatnonzero(new)
    off = np.arange(len(where)) - np.repeat(head, np.diff(np.append(head, len(where))))
    some = (off % (int(kind.edits.min()) + 1) == 0) | np.append(new[1:], True)
    where, k, row = where[some], k[some], row[some]
    places = max(1, len(pats.body))
    each = np.searchsorted(pats.entries, (k + 1) * places) - np.searchsorted(pats.entries, k * places)
    total = np.append(0, np.cumsum(each))
    a = 0
    while a < len(where):  # the bands of a run of hits; runs overlap by one region's width
        b = max(a + 1, int(np.searchsorted(total, total[a] + _ROOM, "right")) - 1)
        b2 = int(np.searchsorted(where, where[b - 1] + 2 * kind.widest, "right"))
        yield from _bands(pats, kind, text, at, where[a:b2], k[a:b2], row[a:b2], 0, len(kind.start))
        a = b


def _bands(pats: Patterns, kind: Kind, text: np.ndarray, at: np.ndarray, where: np.ndarray, k: np.ndarray, row: np.ndarray, lo: int, hi: int) -> Iterator[tuple[int, int, int, int, int]]:
    """Regions of the patterns lo to hi. Where these share too many q-grams with the hits, each half is taken by itself."""
    places = len(pats.body)
    low, high = int(kind.start[lo]), int((kind.start[lo:hi] + kind.size[lo:hi]).max()) - Q + 1
    head = np.searchsorted(pats.entries, k * places + low)
    count = np.searchsorted(pats.entries, k * places + high) - head
    many = int(count.sum())
    if not many:
        return
    if many > 2 * _ROOM and hi - lo > 1:
        for x, y in ((lo, (lo + hi) // 2), ((lo + hi) // 2, hi)):
            yield from _bands(pats, kind, text, at, where, k, row, x, y)
        return
    hit = np.repeat(np.arange(len(where)), count)
    place = pats.entries[np.repeat(head - np.append(0, np.cumsum(count)[:-1]), count) + np.arange(many)] - np.repeat(k, count) * places
    width = kind.edits_at[place] + 1
    band = np.floor_divide(where[hit] - place, width)
    rows, of = np.unique(row, return_inverse=True)
    least = int(band.min()) - 1
    bands = int(band.max()) - least + 1
    group = of.reshape(-1)[hit] * bands + band - least
    if len(rows) * bands * places >= 1 << 62:
        raise OverflowError("too many bands at once")
    shared = distinct(np.concatenate([group, group - 1]) * places + np.concatenate([place, place]))
    # enough different places of a pattern, in one band
    need, size = kind.least, int(kind.size.max())
    if len(shared) < need:
        return
    run = np.flatnonzero(shared[need - 1 :] - shared[: len(shared) - need + 1] <= size - Q)
    group, place = np.divmod(shared[run], places)
    first = np.searchsorted(kind.start[lo:hi], place - size + Q, "left") + lo
    last = np.searchsorted(kind.start[lo:hi], place, "right") + lo
    # a pattern's first shared place starts such a run, so only patterns that hold the place are candidates
    n = last - first
    p = np.repeat(first - np.append(0, np.cumsum(n)[:-1]), n) + np.arange(int(n.sum()))
    pairs = distinct(np.repeat(group, n) * len(kind.start) + p)
    group, p = np.divmod(pairs, len(kind.start))
    base = group * places + kind.start[p]
    n = np.searchsorted(shared, base + kind.size[p] - Q, "right") - np.searchsorted(shared, base, "left")
    enough = n >= kind.bound[p]
    group, p = group[enough], p[enough]
    which, band = np.divmod(group, bands)
    yield from _align(pats, kind, text, at, rows[which], p, (band + least) * (kind.edits[p] + 1))


def _align(pats: Patterns, kind: Kind, text: np.ndarray, at: np.ndarray, row: np.ndarray, p: np.ndarray, diag: np.ndarray) -> Iterator[tuple[int, int, int, int, int]]:
    """Alignments of patterns p in bands that begin on the diagonals diag."""
    begin = diag - kind.edits[p] + kind.start[p]  # text place of the pattern's first byte on the first diagonal
    _, one, all_ = np.unique(np.column_stack([row, begin, kind.alike[p]]), axis=0, return_index=True, return_inverse=True)
    cost, x, y = (np.zeros(len(one), np.int64) for _ in range(3))
    m, e = kind.size[p[one]], kind.edits[p[one]]
    for size, edits in np.unique(np.column_stack([m, e]), axis=0).tolist():
        mine = np.flatnonzero((m == size) & (e == edits))
        for a in range(0, len(mine), 4096):
            j = mine[a : a + 4096]
            i = one[j]
            spot = begin[i, None] + np.arange(size + 4 * edits + 2)
            lo, hi = at[row[i], None], at[row[i] + 1, None]
            window = text[np.clip(spot[:, :-1], 0, len(text) - 1)].astype(np.int16)
            window[(spot[:, :-1] < lo) | (spot[:, :-1] >= hi)] = 256
            cost[j], x[j], y[j] = banded(pats.body[kind.start[p[i], None] + np.arange(size)].astype(np.int16), window, (spot >= lo) & (spot <= hi))
    all_ = all_.reshape(-1)
    good = np.flatnonzero(cost[all_] <= kind.edits[p])
    of = all_[good]
    start = begin[good] - at[row[good]]
    yield from zip(row[good].tolist(), p[good].tolist(), (start + x[of]).tolist(), (start + y[of] + kind.size[p[good]]).tolist(), cost[of].tolist())


def load_benchmark(bench: DataFrame, id_col: str, text_col: str, max_bytes: int) -> Iterator[tuple[list, Patterns]]:
    """Ids and patterns of the benchmark, in parts of about max_bytes of text: each is broadcast by itself, so no broadcast
    grows with the benchmark. An item longer than max_bytes is a part of its own."""
    ids, texts, held = [], [], 0
    rows = bench.select(F.col(id_col), F.coalesce(F.col(text_col), F.lit(""))).distinct().orderBy(F.col(id_col).asc_nulls_last(), text_col)
    for r in rows.toLocalIterator():
        raw = r[1].encode()
        if held and held + len(raw) > max_bytes:
            yield ids, index(texts)
            ids, texts, held = [], [], 0
        ids.append(r[0])
        texts.append(raw)
        held += len(raw)
    if ids:
        yield ids, index(texts)


def find_leaks(docs: DataFrame, bench: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", max_bytes: int = 4 << 20) -> DataFrame:
    """One row for each region of a text within the edit budget of a pattern of an item: id, item_id, pattern_start (in the
    item), start, end (bytes in the text) and edits.

    Texts are searched whole, in pieces of whole texts; where a q-gram is frequent on both sides, its hits are laid out in parts. Null and empty texts and items have no regions, nor have items of
    fewer than 8 bytes. Repeated rows each have theirs; other columns are not read. An empty benchmark or table gives no rows.
    No shuffle: the benchmark's index goes to the tasks, in parts of max_bytes of text, one pass over the texts each."""
    spark = docs.sparkSession
    item_type = pa.int64() if isinstance(bench.schema[item_id].dataType, LongType) else pa.int32() if isinstance(bench.schema[item_id].dataType, IntegerType) else pa.string()
    kind, item_kind = docs.schema[id_col].dataType.simpleString(), bench.schema[item_id].dataType.simpleString()
    cols = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    out = None
    for part in load_benchmark(bench, item_id, item_text, max_bytes):
        held = spark.sparkContext.broadcast(part)

        def search(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            ids, pats = held.value
            for batch in batches:
                buf, at = utf8(batch.column(1))
                found = []
                for a, b in pieces(at, 4 << 20):
                    found += [(a + r, *x) for r, *x in regions(pats, buf[at[a] : at[b]], at[a : b + 1] - at[a])]
                cols = list(zip(*found)) or [[]] * 6
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(cols[0], pa.int64())), pa.array([ids[i] for i in cols[1]], item_type), *[pa.array(c, pa.int64()) for c in cols[2:]]], ["id", "item_id", "pattern_start", "start", "end", "edits"])

        one = cols.mapInArrow(search, f"id {kind}, item_id {item_kind}, pattern_start long, start long, end long, edits long")
        out = one if out is None else out.unionByName(one)
    if out is None:
        out = spark.createDataFrame([], f"id {kind}, item_id {item_kind}, pattern_start long, start long, end long, edits long")
    return out.withColumnRenamed("id", id_col)


def drop_leaks(docs: DataFrame, bench: DataFrame, text_col: str = "text", item_id: str = "item_id", item_text: str = "text", max_bytes: int = 4 << 20) -> DataFrame:
    """The rows of docs whose text holds no region within the budget of any pattern, with all their columns. No shuffle."""
    spark, at_col = docs.sparkSession, docs.columns.index(text_col)
    out = docs
    for part in load_benchmark(bench, item_id, item_text, max_bytes):
        held = spark.sparkContext.broadcast(part)

        def keep_clean(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            _, pats = held.value
            for batch in batches:
                buf, at = utf8(batch.column(at_col))
                clean = np.ones(batch.num_rows, bool)
                for a, b in pieces(at, 4 << 20):
                    for r, *_ in regions(pats, buf[at[a] : at[b]], at[a : b + 1] - at[a]):
                        clean[a + r] = False
                yield batch.filter(pa.array(clean))

        out = out.mapInArrow(keep_clean, docs.schema)
    return out


def digest(docs: DataFrame, bench: DataFrame) -> DataFrame:
    """Contaminated documents: each item that a document holds a passage of, with the regions' number and fewest edits."""
    found = find_leaks(docs, bench)
    return found.groupBy("doc_id", "item_id").agg(F.count("*").alias("n_regions"), F.min("edits").alias("least_edits"), F.min("start").alias("first_byte"), F.max("end").alias("end_byte"))
