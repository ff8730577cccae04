"""A schema over documents where they lie: each is parsed, validated and let go in one pass of mapInArrow.

Nothing is exchanged or kept, so time grows with the documents and memory with the largest of them. What doesn't depend on the
document (tests, ids, flags) is added by the plan, from the number of an assertion or a rule."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from xylem.plans.direct import _NONE, Firing, Scope, Val, compile_, matches, new_slot, node_set, shown_name, to_bool, to_str
from xylem.plans.schema import Assertion, Rule, Schema, SchemaError
from xylem.sources.shred import DocumentError
from xylem.sources.tree import Node, Tree, place, read

_SPACES = re.compile(r"\s+", re.ASCII)
#: Rows to a batch, roughly.
ROWS = 10_000
NOTE = "array<struct<id:string,text:string>>"
PROPERTY = "array<struct<id:string,role:string,scheme:string,text:string>>"
FOUND = f"n int, pre int, location string, text string, diagnostics {NOTE}, properties {PROPERTY}"
_STRUCT = lambda *names: pa.list_(pa.struct([(n, pa.string()) for n in names]))
_FOUND = [pa.int32(), pa.int32(), pa.string(), pa.string(), _STRUCT("id", "text"), _STRUCT("id", "role", "scheme", "text")]


def remembered(v: Val, outer: bool) -> Val:
    """A variable's value, found once where it is asked for: at the document's root for outer ones, else at the rule's node."""

    def once(fn: Callable | None) -> Callable | None:
        if fn is None:
            return None
        slot = new_slot()

        def get(c):
            memo = c.fire.outer if outer else c.fire.memo
            if slot not in memo:
                memo[slot] = fn(memo[None] if outer else c.fire.top)
            return memo[slot]

        return get

    name = v.name
    if v.kind == "if":
        name = tuple(remembered(x, outer) for x in name)
    elif v.kind == "attr":
        name = (name[0], remembered(name[1], outer), name[2])
    return Val(v.kind, once(v.fn), name, once(v.texts))


def bound(lets: list, f: Scope, schema: Schema, outer: bool) -> Scope:
    for let in lets:
        f = f.having(let.name, remembered(compile_(schema.trees[let.value], f), outer))
    return f


def message(parts: list, f: Scope, schema: Schema) -> Callable:
    fns = []
    for kind, value in parts:
        if kind == "text":
            fns.append(lambda c, value=value: value)
        else:
            v = compile_(schema.trees[value], f)
            fns.append(to_str(v) if kind == "value-of" else shown_name(v))
    if all(kind == "text" for kind, _ in parts):
        said = _SPACES.sub(" ", "".join(value for _, value in parts)).strip(" ")
        return lambda c: said
    return lambda c: _SPACES.sub(" ", "".join([fn(c) for fn in fns])).strip(" ")


class Check:
    """An assertion's test and report, its rule's scope given."""

    def __init__(self, n: int, a: Assertion, rule: Rule, f: Scope, schema: Schema) -> None:
        self.n, self.fails = n, a.kind == "assert"
        self.ok, self.say = to_bool(compile_(schema.trees[a.test], f)), message(a.content, f, schema)
        subject = a.subject or rule.subject
        self.where = node_set(compile_(schema.trees[subject], f)) if subject else None
        self.notes = [(d, message(schema.diagnostics[d], f, schema)) for d in a.diagnostics]
        self.properties = [(p, *schema.properties[p][:2], message(schema.properties[p][2], f, schema)) for p in a.properties]

    def found(self, c) -> tuple:
        there = self.where(c) if self.where else None
        notes = [{"id": i, "text": say(c)} for i, say in self.notes]
        properties = [{"id": i, "role": r, "scheme": s, "text": say(c)} for i, r, s, say in self.properties]
        return self.n, c.node.pre, place(there[0] if there else c.node), self.say(c), notes, properties


class Program:
    """A schema's active patterns, compiled. rules and checks: what the numbers of rows stand for."""

    def __init__(self, schema: Schema, chosen: list[int], phase_lets: list, now: float, timezone: int, most: int | None) -> None:
        self.most = None if most is None else max(1, most)
        self.rules: list[tuple[int, int, Rule]] = []
        self.checks: list[tuple[int, int, int, Rule, Assertion]] = []
        self.patterns: list[tuple[bool, list]] = []
        env = Scope(schema.namespaces, {k.name: [(schema.trees[k.match], schema.trees[k.use])] for k in schema.keys}, schema.binding == 2, now, timezone)
        top = schema.lets + phase_lets
        for ix in chosen:
            pattern = schema.patterns[ix]
            if pattern.documents is not None:
                raise SchemaError("pattern/@documents is not supported")
            outer = [*top, *pattern.lets]
            f, made = bound(outer, env, schema, True), []
            for rx, rule in enumerate(pattern.rules):
                g, checks = bound(rule.lets, f, schema, False), []
                for ax, a in enumerate(rule.assertions):
                    checks.append(Check(len(self.checks), a, rule, g, schema))
                    self.checks.append((ix, rx, ax, rule, a))
                made.append((matches(schema.trees[rule.context], env), len(self.rules), checks))
                self.rules.append((ix, rx, rule))
            self.patterns.append((bool(outer), made))

    def fired(self, tree: Tree) -> Iterator[tuple[bool, Iterable[tuple[Node, int, list]]]]:
        """For each pattern the nodes that a rule matches, in document order, with the number and checks of the first such rule."""
        for outer, rules in self.patterns:
            if len(rules) == 1:
                [(select, n, checks)] = rules
                yield outer, ((node, n, checks) for node in select(tree))
                continue
            claimed: dict[int, tuple] = {}
            for select, n, checks in rules:
                for node in select(tree):
                    claimed.setdefault(node.pre, (node, n, checks))
            yield outer, [claimed[k] for k in sorted(claimed)]

    def findings(self, tree: Tree, fired: Iterator) -> Iterator[tuple]:
        failed, most = 0, self.most
        for outer, hits in fired:
            shared = _NONE
            if outer:
                shared = {}
                shared[None] = Firing(tree, tree.root, shared).top
            for node, _, checks in hits:
                c = Firing(tree, node, shared).top
                for check in checks:
                    if check.ok(c) is not check.fails:
                        yield check.found(c)
                        failed += check.fails
                        if most is not None and failed >= most:
                            return


def rows(docs: DataFrame, id_col: str, xml_col: str, columns: str, types: list[pa.DataType], make: Callable) -> DataFrame:
    """doc_id and columns: the tuples that make() gives of each document's bytes."""
    kind = docs.schema[id_col].dataType.simpleString()
    names = ["doc_id", *[x.name for x in docs.sparkSession.createDataFrame([], columns).schema]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        each = make()

        def close(ids: pa.Array, at: list, out: list) -> pa.RecordBatch:
            cols = [pa.array(c, t) for c, t in zip(zip(*out), types)]
            return pa.RecordBatch.from_arrays([ids.take(pa.array(at, pa.int32())), *cols], names)

        for batch in batches:
            ids, at, out = batch.column(0), [], []
            for i, xml in enumerate(batch.column(1)):
                for row in each(xml.as_buffer() if xml.is_valid else b""):
                    at.append(i)
                    out.append(row)
                    if len(out) >= ROWS:
                        yield close(ids, at, out)
                        at, out = [], []
            if out:
                yield close(ids, at, out)

    return docs.select(F.col(id_col).alias("doc_id"), F.col(xml_col)).mapInArrow(run, f"doc_id {kind}, {columns}")


def text(x) -> Column:
    return F.lit(x).cast("string")


def known(entries: list[Column]) -> Callable[[Column], Column]:
    """The entry of a number, as a column."""
    all_ = F.array(*entries)
    return lambda n: F.get(all_, n)


def tables(docs: DataFrame, id_col: str, xml_col: str, schema: Schema, chosen: list[int], phase_lets: list, now: float, timezone: int, most: int | None) -> tuple[DataFrame | None, DataFrame | None, DataFrame, DataFrame | None]:
    """findings, fired rules, errors, and documents with both as arrays (a fired rule's findings are many from first); None where
    the schema can't give any."""
    build = lambda: Program(schema, chosen, phase_lets, now, timezone, most)
    program = build()  # what is wrong with the schema is found before anything runs

    def each(use: Callable) -> Callable:
        def make() -> Callable:
            program = build()

            def go(xml) -> Iterator[tuple]:
                try:
                    tree = read(xml)
                except DocumentError:
                    return
                yield from use(program, tree)
                tree.drop()

            return go

        return make

    def errors() -> Callable:
        def go(xml) -> Iterator[tuple]:
            try:
                read(xml)
            except DocumentError as e:
                yield e.line, e.column, e.message

        return go

    def both(p: Program, tree: Tree) -> Iterator[tuple]:
        fired, counts, at, rules = [(outer, list(hits)) for outer, hits in p.fired(tree)], Counter(), 0, []
        found = list(p.findings(tree, iter(fired)))
        for n, pre, *_ in found:
            counts[p.checks[n][0], pre] += 1
        for _, hits in fired:
            for node, n, _ in hits:
                many = counts[p.rules[n][0], node.pre]
                rules.append((n, node.pre, place(node), at, many))
                at += many
        yield [dict(zip(("n", "pre", "location", "first", "many"), x)) for x in rules], [dict(zip(names, x)) for x in found]

    names = [x.split(" ")[0] for x in ("n", "pre", "location", "text", "diagnostics", "properties")]
    bad = rows(docs, id_col, xml_col, "line int, column int, message string", [pa.int32(), pa.int32(), pa.string()], errors)
    if not program.rules:
        return None, None, bad, None
    rule = known([F.struct(F.lit(ix).alias("pattern_ix"), text(schema.patterns[ix].id).alias("pattern_id"), F.lit(rx).alias("rule_ix"), text(r.id).alias("rule_id"), text(r.context).alias("context"), text(r.role).alias("role"), text(r.flag).alias("flag")) for ix, rx, r in program.rules])
    fire = lambda x, at: [at(x, k).alias(k) for k in ("pattern_ix", "pattern_id", "pre", "rule_ix", "rule_id", "context", "role", "flag", "location")]
    fired = rows(docs, id_col, xml_col, "n int, pre int, location string", [pa.int32(), pa.int32(), pa.string()], each(lambda p, tree: ((n, node.pre, place(node)) for _, hits in p.fired(tree) for node, n, _ in hits)))
    fired = fired.select("doc_id", *fire(None, lambda x, k: F.col(k) if k in ("pre", "location") else rule(F.col("n"))[k]))
    if not program.checks:
        return None, fired, bad, None
    check = known([F.struct(F.lit(ix).alias("pattern_ix"), text(schema.patterns[ix].id).alias("pattern_id"), F.lit(rx).alias("rule_ix"), F.lit(ax).alias("assert_ix"), text(a.kind).alias("kind"), text(a.test).alias("test"), text(a.id).alias("id"), text(a.role or r.role).alias("role"), text(a.flag or r.flag).alias("flag"), text(a.see).alias("see"), text(a.icon).alias("icon"), text(a.fpi).alias("fpi")) for ix, rx, ax, r, a in program.checks])
    own = ("pre", "location", "text", "diagnostics", "properties")
    find = lambda x, at: [at(x, k).alias(k) for k in ("pattern_ix", "pattern_id", "pre", "rule_ix", "assert_ix", "kind", "test", "location", "text", "id", "role", "flag", "see", "icon", "fpi", "diagnostics", "properties")]
    found = rows(docs, id_col, xml_col, FOUND, _FOUND, each(lambda p, tree: p.findings(tree, p.fired(tree))))
    found = found.select("doc_id", *find(None, lambda x, k: F.col(k) if k in own else check(F.col("n"))[k]))
    fields = [(n, t) for n, t in zip(names, _FOUND)]
    kinds = [pa.list_(pa.struct([*fields[:3], ("first", pa.int32()), ("many", pa.int32())])), pa.list_(pa.struct(fields))]
    whole = rows(docs, id_col, xml_col, f"fired_rules array<struct<n:int,pre:int,location:string,first:int,many:int>>, findings array<struct<n:int,pre:int,location:string,text:string,diagnostics:{NOTE},properties:{PROPERTY}>>", kinds, each(both))
    whole = whole.select(
        "doc_id",
        F.transform("fired_rules", lambda x: F.struct(*fire(x, lambda x, k: x[k] if k in ("pre", "location") else rule(x["n"])[k]), x["first"].alias("first"), x["many"].alias("many"))).alias("fired_rules"),
        F.transform("findings", lambda x: F.struct(*find(x, lambda x, k: x[k] if k in own else check(x["n"])[k]))).alias("findings"),
    )
    return found, fired, bad, whole
