"""Validation: a schema over a table of documents to tables of findings, fired rules and parse errors."""

from __future__ import annotations

import contextlib
import functools
import time
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.errors import utils as pyspark_errors
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from xylem.operators.inplace import tables
from xylem.plans.calls import first
from xylem.plans.direct import Elsewhere
from xylem.plans.lift import KEY, NODE, Env, Frame, Val, compile_, frame, fresh, gather, matches, node_set, to_bool, to_str
from xylem.plans.schema import Assertion, Rule, Schema, SchemaError
from xylem.sources.shred import nodes as shred_nodes

#: Joins that the tests of one plan may need, roughly.
JOINS = 4
ORDER = ["doc_id", "pattern_ix", "pre", "assert_ix"]
FINDING = "doc_id {id}, pattern_ix int, pattern_id string, pre int, rule_ix int, assert_ix int, kind string, test string, location string, text string, id string, role string, flag string, see string, icon string, fpi string, diagnostics array<struct<id:string,text:string>>, properties array<struct<id:string,role:string,scheme:string,text:string>>"
FIRED = "doc_id {id}, pattern_ix int, pattern_id string, pre int, rule_ix int, rule_id string, context string, role string, flag string, location string"


@dataclass
class Report:
    """findings, fired_rules and errors as DataFrames; patterns: (index, id, name) of the active ones; phase: its id or None."""

    findings: DataFrame
    fired_rules: DataFrame
    errors: DataFrame
    patterns: list[tuple[int, str | None, str | None]]
    phase: str | None
    schema: Schema
    #: doc_id, fired_rules and findings of each document that could be read, as arrays in the report's order; None from node tables.
    documents: DataFrame | None = None

    def failures(self) -> DataFrame:
        return self.findings.filter("kind = 'assert'")

    def reports(self) -> DataFrame:
        return self.findings.filter("kind = 'report'")

    def with_flag(self, *flags: str) -> DataFrame:
        return self.findings.filter(F.col("flag").isin(*flags))

    def is_valid(self) -> bool:
        return not self.failures().limit(1).count()


def active(schema: Schema, phase: str | None) -> tuple[list[int], list, str | None]:
    """Indexes of the phase's patterns in the schema's order, the phase's lets, and its id."""
    name = phase if phase not in (None, "#DEFAULT") else schema.default_phase
    if name in (None, "#ALL"):
        return list(range(len(schema.patterns))), [], None
    if name not in schema.phases:
        raise SchemaError(f"unknown phase {name}")
    p = schema.phases[name]
    return [i for i, x in enumerate(schema.patterns) if x.id in p.active], p.lets, name


def prepare(nodes: DataFrame) -> DataFrame:
    """The node table placed once by document, so that the plans' joins and windows need no exchange of their own."""
    nodes.sparkSession.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
    return nodes.repartition("doc_id").persist()


def validate(docs: DataFrame, schema: Schema, phase: str | None = None, id_col: str = "doc_id", xml_col: str = "xml", max_failures: int | None = None, now: float | None = None, timezone: int = 0) -> Report:
    """Validates each document where it lies. Documents that can't be parsed are rows of errors and have no findings.

    now: the run's instant (seconds from 1970, UTC; the present if None); timezone: minutes, for times without an offset."""
    now = time.time() if now is None else now
    with contextlib.suppress(Elsewhere), unmarked():
        return in_place(docs, schema, phase, id_col, xml_col, max_failures, now, timezone)
    spaces = any("namespace::" in source for source in schema.trees)
    return validate_nodes(prepare(shred_nodes(docs, id_col, xml_col, spaces)), schema, phase, max_failures, now, timezone)


def in_place(docs: DataFrame, schema: Schema, phase: str | None, id_col: str, xml_col: str, max_failures: int | None, now: float, timezone: int) -> Report:
    chosen, phase_lets, name = active(schema, phase)
    found, fired, errors, documents = tables(docs, id_col, xml_col, schema, chosen, phase_lets, now, timezone, max_failures)
    kind, spark = docs.schema[id_col].dataType.simpleString(), docs.sparkSession
    none = lambda columns: spark.createDataFrame([], columns.format(id=kind))
    return Report(none(FINDING) if found is None else found, none(FIRED) if fired is None else fired, errors, [(i, schema.patterns[i].id, schema.patterns[i].name) for i in chosen], name, schema, documents)


@contextlib.contextmanager
def unmarked() -> Iterator[None]:
    """Columns made meanwhile don't note the lines of Python that made them, which takes most of the time of a large plan."""
    was = getattr(pyspark_errors, "_enable_debugging_cache", None)
    pyspark_errors._enable_debugging_cache = False
    try:
        yield
    finally:
        pyspark_errors._enable_debugging_cache = was


def validate_nodes(nodes: DataFrame, schema: Schema, phase: str | None = None, max_failures: int | None = None, now: float | None = None, timezone: int = 0) -> Report:
    """The report of a node table, as prepare() places it."""
    with unmarked():
        return planned(nodes, schema, phase, max_failures, now, timezone)


def planned(nodes: DataFrame, schema: Schema, phase: str | None = None, max_failures: int | None = None, now: float | None = None, timezone: int = 0) -> Report:
    errors = nodes.filter("kind = 'error'").select("doc_id", F.col("pre").alias("line"), F.col("end").alias("column"), F.col("value").alias("message"))
    chosen, phase_lets, name = active(schema, phase)
    env = Env(nodes.filter("kind <> 'error'"), schema.namespaces, {k.name: [(schema.trees[k.match], schema.trees[k.use])] for k in schema.keys}, schema.binding == 2, time.time() if now is None else now, timezone)
    kind = nodes.schema["doc_id"].dataType.simpleString()
    spark = nodes.sparkSession
    if any(mark in source for source in schema.trees for mark in ("xs:", "-from-", " to ", "current-", " eq ", " ne ", " lt ", " le ", " gt ", " ge ")):
        # such expressions may raise, and shared subexpressions are computed even for nodes that the context leaves out
        spark.conf.set("spark.sql.subexpressionElimination.enabled", "false")
    fired, found = spark.createDataFrame([], FIRED.format(id=kind)), spark.createDataFrame([], FINDING.format(id=kind))
    top = schema.lets + phase_lets
    for ix in chosen:
        pattern = schema.patterns[ix]
        if pattern.documents is not None:
            raise SchemaError("pattern/@documents is not supported")
        outer = [*top, *pattern.lets]
        hits = claims(pattern.rules, schema, env)
        if hits is None:
            continue
        for rx, rule in enumerate(pattern.rules):
            mine = hits.filter(F.col("rule_ix") == rx).drop("rule_ix")
            one, all_ = fire(mine, ix, pattern.id, rx, rule, schema, env, outer)
            fired = fired.unionByName(one)
            for a in all_:
                found = found.unionByName(a)
    if max_failures is not None:
        before = F.sum(F.when(F.col("kind") == "assert", 1).otherwise(0)).over(Window.partitionBy("doc_id").orderBy("pattern_ix", "pre", "assert_ix").rowsBetween(Window.unboundedPreceding, -1))
        found = found.withColumn("_before", F.coalesce(before, F.lit(0))).filter(F.col("_before") < max(1, max_failures)).drop("_before")
    return Report(found, fired, errors, [(i, schema.patterns[i].id, schema.patterns[i].name) for i in chosen], name, schema)


def claims(rules: list[Rule], schema: Schema, env: Env) -> DataFrame | None:
    """(doc_id, c_*, rule_ix): each matched node with the first rule that matches it."""
    parts = [matches(schema.trees[r.context], env).withColumn("rule_ix", F.lit(i)) for i, r in enumerate(rules)]
    if not parts:
        return None
    if len(parts) == 1:
        return parts[0]
    both = parts[0]
    for p in parts[1:]:
        both = both.unionByName(p)
    first_ = Window.partitionBy("doc_id", "c_pre").orderBy("rule_ix")
    return both.withColumn("_n", F.row_number().over(first_)).filter("_n = 1").drop("_n")


def settled(v: Val, f: Frame) -> tuple[Val, list[Column]]:
    """A value whose columns are computed in the frame, and those columns."""
    if v.kind == "if":
        c, parts = f.column(v.col, "let"), [settled(x, f) for x in v.name]
        return Val("if", c, name=tuple(x for x, _ in parts)), [c, *(y for _, cols in parts for y in cols)]
    if v.kind in ("ns", "one", "attr"):
        return v, []
    c = f.column(v.col, "let")
    return Val(v.kind, c, name=v.name), [c]


def bind(f: Frame, lets: list, schema: Schema) -> list[Column]:
    used = []
    for let in lets:
        v, cols = settled(compile_(schema.trees[let.value], f), f)
        used += cols
        f.vars = f.vars | {let.name: v}
    f.base = f.df
    return used


def detached(v: Val, root: Frame) -> Val:
    """A value of the root's frame for use in frames of other nodes: its nodes are keyed by the document alone."""
    if v.kind == "if":
        return Val("if", v.col, name=tuple(detached(x, root) for x in v.name))
    if v.kind in ("ns", "one", "attr"):
        return Val("ns", df=node_set(v, root), depth=-1)
    return v


def scoped(hits: DataFrame, outer: list, rule: Rule, schema: Schema, env: Env) -> Frame:
    """The rule's frame with its variables: those of schema, phase and pattern are bound at the document's root."""
    f = frame(hits, env)
    if outer:
        root = frame(env.table(F.col("kind") == "root").withColumnRenamed("n_doc", "doc_id"), env)
        used = bind(root, outer, schema)
        names = {name: detached(v, root) for name, v in root.vars.items()}
        if used:
            f.df = f.base = f.df.join(root.df.select("doc_id", *used), "doc_id")
        f.vars = names
    bind(f, rule.lets, schema)
    return f


def message(parts: list, f: Frame, schema: Schema) -> Column:
    out = []
    for kind, value in parts:
        if kind == "text":
            out.append(F.lit(value))
            continue
        v = compile_(schema.trees[value], f)
        if kind == "value-of":
            out.append(to_str(v, f))
        else:
            prefix, local = first(v, f, "prefix"), first(v, f, "local")
            out.append(F.when(prefix == "", local).otherwise(F.concat(prefix, F.lit(":"), local)))
    return F.trim(F.regexp_replace(F.concat(*out), r"\s+", " ")) if out else F.lit("")


def fire(hits: DataFrame, ix: int, pattern_id: str | None, rx: int, rule: Rule, schema: Schema, env: Env, outer: list) -> tuple[DataFrame, list[DataFrame]]:
    text = lambda x: F.lit(x).cast("string")
    fired = hits.select("doc_id", F.lit(ix).alias("pattern_ix"), text(pattern_id).alias("pattern_id"), F.col("c_pre").alias("pre"), F.lit(rx).alias("rule_ix"), text(rule.id).alias("rule_id"), text(rule.context).alias("context"), text(rule.role).alias("role"), text(rule.flag).alias("flag"), F.col("c_loc").alias("location"))
    if not rule.assertions:
        return fired, []
    out, todo = [], list(enumerate(rule.assertions))
    while todo:
        # tests are columns of one plan, as many as a task's memory has room for the joins of; messages are built for nodes of
        # which something is reported, each where it is
        f, says, asked = scoped(hits, outer, rule, schema, env), [], []
        while todo and (not says or f.attached < JOINS):
            ax, a = todo.pop(0)
            ok = to_bool(compile_(schema.trees[a.test], f), f)
            says.append(f.column(~ok if a.kind == "assert" else ok, "says"))
            asked.append((ax, a))
        f.df = f.df.filter(functools.reduce(Column.__or__, says))
        if f.attached < 2 and sum(k != "text" and not v.startswith("@") for _, a in asked for k, v in a.content) <= 3:
            f.base = f.df  # few nodes are sought: only from where something is reported
        rows = [F.when(x, finding(f, ix, pattern_id, rx, ax, rule, a, schema)) for (ax, a), x in zip(asked, says)]
        keep = fresh("found")
        f.df = f.df.withColumn(keep, F.array_compact(F.array(*rows)))
        out.append(f.df.select("doc_id", F.explode(keep).alias("_x")).select("doc_id", "_x.*"))
    return fired, out


def finding(f: Frame, ix: int, pattern_id: str | None, rx: int, ax: int, rule: Rule, a: Assertion, schema: Schema) -> Column:
    text = lambda x: F.lit(x).cast("string")
    body = message(a.content, f, schema)
    subject = a.subject or rule.subject
    where = F.col("c_loc")
    if subject:
        v = compile_(schema.trees[subject], f)
        where = F.coalesce(F.col(f"{v.prefix}loc") if v.kind == "one" and v.col is None else gather(v, f, None, F.min_by("c_loc", "c_pre")), where)
    diagnostics = [F.struct(text(d).alias("id"), message(schema.diagnostics[d], f, schema).alias("text")) for d in a.diagnostics]
    properties = [F.struct(text(p).alias("id"), text(schema.properties[p][0]).alias("role"), text(schema.properties[p][1]).alias("scheme"), message(schema.properties[p][2], f, schema).alias("text")) for p in a.properties]
    empty = lambda cols, kind: F.array(*cols).cast(kind)
    return F.struct(
        F.lit(ix).alias("pattern_ix"), text(pattern_id).alias("pattern_id"), F.col("c_pre").alias("pre"), F.lit(rx).alias("rule_ix"), F.lit(ax).alias("assert_ix"), text(a.kind).alias("kind"), text(a.test).alias("test"), where.alias("location"), body.alias("text"), text(a.id).alias("id"), text(a.role or rule.role).alias("role"), text(a.flag or rule.flag).alias("flag"), text(a.see).alias("see"), text(a.icon).alias("icon"), text(a.fpi).alias("fpi"),
        empty(diagnostics, "array<struct<id:string,text:string>>").alias("diagnostics"), empty(properties, "array<struct<id:string,role:string,scheme:string,text:string>>").alias("properties"),
    )


__all__ = ["KEY", "NODE", "Report", "validate", "validate_nodes", "prepare", "active"]
