"""Secret scans by one combined deterministic automaton.

The rules' regular expressions become one nondeterministic automaton, by subset construction one deterministic
automaton over classes of bytes, and by partition refinement the smallest such automaton: flat transition arrays. One
pass over the bytes reports where any rule accepts. The bytes are stepped through in many lanes at once; a lane starts
at a document or behind a byte that takes every state to the start state, so lanes never need to know of each other.
Only where a rule accepted, its own small backward and forward automata find the match's start and longest end.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from xylem.llm.util import pieces, utf8


@dataclass(frozen=True)
class Rule:
    """least: bytes that a match needs from its first accepting byte on (a test of the last group's length).

    Of matches that overlap, the one that begins first must also be the first to accept; all rules here are so."""

    kind: str
    regex: str
    least: int = 0


#: The base kinds, then those that are added.
RULES = (
    Rule("assign", r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]+""", 12),
    Rule("access", r"AKIA[A-Z0-9]+", 14),
    Rule("hex", r"[0-9a-f]{16,}"),
    Rule("private_key", r"-----BEGIN (?:RSA |EC |DSA |OPENSSH |ENCRYPTED )?PRIVATE KEY-----"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]+", 36),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]+", 10),
)
BASE = ("assign", "access", "hex")


class _Parser:
    """A regular expression over bytes as a tree: ("set", mask), ("cat", [..]), ("alt", [..]), ("rep", t, lo, hi)."""

    def __init__(self, source: str) -> None:
        self.s, self.i, self.fold = source.encode(), 0, False

    def peek(self) -> int:
        return self.s[self.i] if self.i < len(self.s) else -1

    def take(self) -> int:
        self.i += 1
        return self.s[self.i - 1]

    def parse(self) -> tuple:
        tree = self.alt()
        if self.i < len(self.s):
            raise ValueError(f"unbalanced ) at {self.i}")
        return tree

    def alt(self) -> tuple:
        parts = [self.cat()]
        while self.peek() == ord("|"):
            self.take()
            parts.append(self.cat())
        return parts[0] if len(parts) == 1 else ("alt", parts)

    def cat(self) -> tuple:
        parts = []
        while self.peek() not in (-1, ord("|"), ord(")")):
            parts.append(self.rep())
        return ("cat", parts)

    def rep(self) -> tuple:
        tree = self.atom()
        while (c := self.peek()) != -1 and c in b"?*+{":
            self.take()
            if c == ord("{"):
                end = self.s.index(b"}", self.i)
                lo, _, hi = self.s[self.i : end].partition(b",")
                tree = ("rep", tree, int(lo), (int(hi) if hi else None) if b"," in self.s[self.i : end] else int(lo))
                self.i = end + 1
            else:
                tree = ("rep", tree, int(c == ord("+")), 1 if c == ord("?") else None)
        return tree

    def escape(self) -> int:
        c = self.take()
        if c == ord("x"):
            self.i += 2
            return int(self.s[self.i - 2 : self.i], 16)
        return {ord("n"): 10, ord("r"): 13, ord("t"): 9}.get(c, c)

    def atom(self) -> tuple:
        c, mask = self.take(), np.zeros(256, bool)
        if c == ord("("):
            was = self.fold
            if self.s.startswith(b"?i:", self.i):
                self.i, self.fold = self.i + 3, True
            elif self.s.startswith(b"?:", self.i):
                self.i += 2
            tree = self.alt()
            if self.peek() != ord(")"):
                raise ValueError("missing )")
            self.take()
            self.fold = was
            return tree
        if c == ord("["):
            negate = self.peek() == ord("^")
            self.i += negate
            first = True
            while first or self.peek() != ord("]"):
                first = False
                lo = self.take()
                lo = self.escape() if lo == ord("\\") else lo
                hi = lo
                if self.peek() == ord("-") and self.s[self.i + 1 : self.i + 2] != b"]":
                    self.take()
                    hi = self.take()
                    hi = self.escape() if hi == ord("\\") else hi
                mask[lo : hi + 1] = True
            self.take()
            mask = ~mask if negate else mask
        elif c == ord("."):
            mask[:] = True
            mask[10] = False
        else:
            mask[self.escape() if c == ord("\\") else c] = True
        if self.fold:
            low, up = mask[97:123].copy(), mask[65:91].copy()
            mask[65:91] |= low
            mask[97:123] |= up
        return ("set", mask)


class _Nfa:
    """Thompson's construction."""

    def __init__(self) -> None:
        self.eps: list[list[int]] = []
        self.go: list[tuple[np.ndarray, int] | None] = []

    def state(self) -> int:
        self.eps.append([])
        self.go.append(None)
        return len(self.eps) - 1

    def add(self, tree: tuple, back: bool) -> tuple[int, int]:
        kind = tree[0]
        a, b = self.state(), self.state()
        if kind == "set":
            self.go[a] = (tree[1], b)
        elif kind == "alt":
            for t in tree[1]:
                x, y = self.add(t, back)
                self.eps[a].append(x)
                self.eps[y].append(b)
        elif kind == "cat":
            at = a
            for t in reversed(tree[1]) if back else tree[1]:
                x, y = self.add(t, back)
                self.eps[at].append(x)
                at = y
            self.eps[at].append(b)
        else:
            _, t, lo, hi = tree
            at = a
            for _ in range(lo):
                x, y = self.add(t, back)
                self.eps[at].append(x)
                at = y
            if hi is None:
                x, y = self.add(t, back)
                self.eps[at] += [x, b]
                self.eps[y] += [x, b]
            else:
                for _ in range(hi - lo):
                    x, y = self.add(t, back)
                    self.eps[at] += [x, b]
                    at = y
                self.eps[at].append(b)
        return a, b

    def closure(self, states: frozenset[int]) -> frozenset[int]:
        seen, todo = set(states), list(states)
        while todo:
            for x in self.eps[todo.pop()]:
                if x not in seen:
                    seen.add(x)
                    todo.append(x)
        return frozenset(x for x in seen if self.go[x] is not None or not self.eps[x])


@dataclass(frozen=True)
class Dfa:
    """table[state * classes + class] is the next state times `classes`; state 0 is the start. accept: bits of rules."""

    byte_class: np.ndarray
    classes: int
    table: np.ndarray
    accept: np.ndarray
    first_accepting: int
    resets: np.ndarray
    dead: int


def determinise(trees: list[tuple], search: bool, back: bool = False) -> Dfa:
    """Subset construction, then the smallest automaton. search: a match may start at any byte."""
    nfa = _Nfa()
    ends, starts = {}, []
    for i, t in enumerate(trees):
        a, b = nfa.add(t, back)
        starts.append(a)
        ends[b] = i
    masks = np.array([g[0] for g in nfa.go if g is not None])
    _, byte_class = np.unique(masks, axis=1, return_inverse=True)
    byte_class = byte_class.reshape(-1)
    classes = int(byte_class.max()) + 1
    sample = [int(np.flatnonzero(byte_class == c)[0]) for c in range(classes)]
    start = nfa.closure(frozenset(starts))
    moves: dict[int, list[bool]] = {i: [bool(g[0][x]) for x in sample] for i, g in enumerate(nfa.go) if g is not None}
    close_one = {g[1]: nfa.closure(frozenset([g[1]])) for g in nfa.go if g is not None}
    index, todo, rows = {start: 0}, [start], []
    while todo:
        here, row = todo, []
        todo = []
        for states in here:
            row = []
            for c in range(classes):
                to: set[int] = set(start) if search else set()
                for s in states:
                    if s in moves and moves[s][c]:
                        to |= close_one[nfa.go[s][1]]
                key = frozenset(to)
                if key not in index:
                    index[key] = len(index)
                    todo.append(key)
                row.append(index[key])
            rows.append(row)
    go = np.array(rows, np.int64)
    accept = np.zeros(len(index), np.int64)
    for states, i in index.items():
        for s in states:
            if s in ends:
                accept[i] |= 1 << ends[s]
    label = np.unique(accept, return_inverse=True)[1].reshape(-1)
    while True:  # Moore's refinement
        new = np.unique(np.column_stack([label, label[go]]), axis=0, return_inverse=True)[1].reshape(-1)
        if new.max() == label.max():
            break
        label = new
    count = int(label.max()) + 1
    one = np.zeros(count, np.int64)
    one[label] = np.arange(len(label))
    acc = accept[one]
    order = np.lexsort((np.arange(count) != label[0], acc != 0))  # start first, accepting states last
    rank = np.empty(count, np.int64)
    rank[order] = np.arange(count)
    table, acc = rank[label[go[one[order]]]], acc[order]
    quiet = int((acc == 0).sum())
    dead = next((i for i in range(count) if acc[i] == 0 and (table[i] == i).all() and not search), -1)
    return Dfa(byte_class.astype(np.uint8), classes, (table * classes).astype(np.int32).reshape(-1), acc, quiet * classes, (table == 0).all(axis=0), dead)


@dataclass(frozen=True)
class Scanner:
    rules: tuple[Rule, ...]
    all: Dfa
    ahead: tuple[Dfa, ...]
    behind: tuple[Dfa, ...]


@lru_cache(maxsize=8)
def compile_rules(rules: tuple[Rule, ...] = RULES) -> Scanner:
    trees = [_Parser(r.regex).parse() for r in rules]
    return Scanner(rules, determinise(trees, True), tuple(determinise([t], False) for t in trees), tuple(determinise([t], False, True) for t in trees))


def accepts(dfa: Dfa, buf: np.ndarray, at: np.ndarray, lane: int = 512) -> tuple[np.ndarray, np.ndarray]:
    """Positions behind which the searching automaton accepts, ascending, and the bits of the rules."""
    n = len(buf)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    cls = dfa.byte_class[buf]
    reset = np.flatnonzero(dfa.resets[cls])
    grid = np.searchsorted(reset, np.arange(lane, n, lane))
    starts = np.unique(np.concatenate([at[:-1], reset[grid[grid < len(reset)]] + 1]))
    starts = starts[starts < n]
    length = np.diff(np.append(starts, n))
    order = np.argsort(-length, kind="stable")
    starts, length = starts[order], length[order]
    alive = len(length) - np.searchsorted(length[::-1], np.arange(int(length[0]) if len(length) else 0), "right")
    table, where, what = dfa.table, [], []
    state, t = np.zeros(len(starts), np.int32), 0
    while t < len(alive) and alive[t] >= 8:
        k = alive[t]
        state = table[state[:k] + cls[starts[:k] + t]]
        hit = np.flatnonzero(state >= dfa.first_accepting)
        if len(hit):
            where.append(starts[hit] + t + 1)
            what.append(state[hit].copy())
        t += 1
    if t < len(alive):  # a few long lanes without a byte to cut at
        steps, first, ends, states = _lists(dfa)[0], dfa.first_accepting, [], []
        for i in range(int(alive[t])):
            s, lo = int(state[i]), int(starts[i])
            for p, c in enumerate(cls[lo + t : lo + int(length[i])].tobytes(), lo + t + 1):
                s = steps[s + c]
                if s >= first:
                    ends.append(p)
                    states.append(s)
        where.append(np.array(ends, np.int64))
        what.append(np.array(states, np.int32))
    if not where:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    where_, what_ = np.concatenate(where), np.concatenate(what)
    order = np.argsort(where_, kind="stable")
    return where_[order], dfa.accept[what_[order] // dfa.classes]


def _walk(dfa: Dfa, data: bytes, start: int, stop: int, step: int = 1) -> tuple[int, int]:
    """Lengths of the shortest and the longest run of bytes from start on (stop: exclusive; step -1: backwards) that the
    automaton accepts (-1: none). It reads no further than the automaton lives, and copies nothing."""
    table, cls = _lists(dfa)
    s, short, long, first, dead = 0, -1, -1, dfa.first_accepting, dfa.dead * dfa.classes
    for n, i in enumerate(range(start, stop, step), 1):
        s = table[s + cls[data[i]]]
        if s >= first:
            long = n
            if short < 0:
                short = n
        elif s == dead:
            break
    return short, long


_LISTS: dict[int, tuple[Dfa, list[int], list[int]]] = {}


def _lists(dfa: Dfa) -> tuple[list[int], list[int]]:
    """The transitions and the bytes' classes as lists, which are faster one by one."""
    if id(dfa) not in _LISTS:
        _LISTS[id(dfa)] = (dfa, dfa.table.tolist(), dfa.byte_class.tolist())
    return _LISTS[id(dfa)][1:]


def find(scanner: Scanner, buf: np.ndarray, at: np.ndarray) -> dict[int, list[tuple[int, int, int]]]:
    """Row to its matches (start, rule's index, end), as byte offsets within the row, in that order."""
    where, bits = accepts(scanner.all, buf, at)
    data = buf.tobytes() if len(where) else b""
    out: dict[int, list[tuple[int, int, int]]] = {}
    row = np.searchsorted(at, where - 1, "right") - 1
    for k, rule in enumerate(scanner.rules):
        mine = np.flatnonzero(bits >> k & 1)
        ends, rows = where[mine], row[mine]
        i, done, last_row = 0, 0, -1
        while i < len(ends):
            r, e = int(rows[i]), int(ends[i])
            if r != last_row:
                done, last_row = int(at[r]), r
            if e <= done:
                i = max(i + 1, int(np.searchsorted(ends, done, "right")))
                continue
            _, length = _walk(scanner.behind[k], data, e - 1, done - 1, -1)
            if length < 0:
                i += 1
                continue
            start = e - length
            short, long = _walk(scanner.ahead[k], data, start, int(at[r + 1]))
            done = start + long
            if long - short + 1 >= rule.least:
                out.setdefault(r, []).append((start - int(at[r]), k, done - int(at[r])))
            i += 1
    for spans in out.values():
        spans.sort()
    return out


_SPAN = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Each row's secrets: id and spans, an array of (kind, start, end) in code points, end exclusive.

    Spans of one kind are leftmost, longest and don't overlap; those of different kinds may. They go by start, then by the
    rules' order. A null or empty text has no spans; texts of any length are scanned whole, in one pass. Repeated rows each
    keep theirs; other columns, whatever their names, are not read. No shuffle."""
    scanner = compile_rules(rules)
    kinds = [r.kind for r in rules]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, at = utf8(batch.column(1))
            rows: list[list[dict]] = [[] for _ in range(batch.num_rows)]
            for a, b in pieces(at, 4 << 20):
                part, off = buf[at[a] : at[b]], at[a : b + 1] - at[a]
                for r, spans in find(scanner, part, off).items():
                    points = np.cumsum(np.append(0, (part[off[r] : off[r + 1]] & 0xC0) != 0x80))
                    rows[a + r] = [{"kind": kinds[k], "start": int(points[s]), "end": int(points[e])} for s, k, e in spans]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, _SPAN)], ["id", "spans"])

    kind = docs.schema[id_col].dataType.simpleString()
    cols = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return cols.mapInArrow(scan, f"id {kind}, spans array<struct<kind: string, start: bigint, end: bigint>>").withColumnRenamed("id", id_col)


def digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts of the base kinds, the SHA-256 of the base spans, and all spans, as text."""
    text = lambda a: F.array_join(F.transform(a, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
    of = lambda k: F.size(F.filter("spans", lambda x: x["kind"] == k)).cast("long").alias(f"n_{k}")
    base = F.filter("spans", lambda x: x["kind"].isin(*BASE))
    return found.select(id_col, *[of(k) for k in BASE], F.sha2(text(base).cast("binary"), 256).alias("base_sha256"), text(F.col("spans")).alias("spans"), *[of(r.kind) for r in RULES if r.kind not in BASE])
