"""Validation of documents where they lie: the same findings as the plans over node tables, and nothing moved."""

import pytest

from tests.test_engine import CASES, rule, schema
from xylem import coverage, queries
from xylem.operators.validate import prepare, validate, validate_nodes
from xylem.plans.direct import Elsewhere
from xylem.plans.schema import parse_schema
from xylem.sources.shred import nodes, shred
from xylem.sources.tree import attributes, place, read, value

HEAD = '<schema xmlns="http://purl.oclc.org/dsdl/schematron" queryBinding="xslt2">'


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def moved(df):
    return [w for w in ("Exchange", "Join", "Window", "Aggregate", "InMemory") if w in plan(df)]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, f"<o id='{i}' date='1996-02-{i + 1:02d}'>" + "".join(f"<l n='{k}' q='{(7 * k + i) % 50}' f='{'RAN'[k % 3]}'/>" for k in range(i % 5)) + "</o>") for i in range(20)]
    return spark.createDataFrame([*rows, (99, "<o")], "doc_id long, xml string")


def both(docs, body, binding="xslt2", **how):
    s = parse_schema(queries.schema(body, binding))
    reports = validate(docs, s, now=0.0, **how), validate_nodes(prepare(nodes(docs)), s, now=0.0, **how)
    return [[sorted(map(str, df.select(*sorted(df.columns)).collect())) for df in (r.findings, r.fired_rules, r.errors)] for r in reports]


BODIES = {
    "sums and siblings": rule("l", '<report test="@q + 3 &lt; following-sibling::l[1]/@q">next <value-of select="count(preceding-sibling::l)"/></report>') + rule("o", '<report test="sum(l/@q) &gt; 20" diagnostics="d"><value-of select="sum(l/@q)"/></report>'),
    "rules and variables": '<let name="all" value="count(//l)"/><pattern><let name="two" value="$all * 2"/><rule context="l[@f = \'R\']"><let name="q" value="number(@q)"/><assert test="$q &gt; $two"><value-of select="$two"/> of <value-of select="$q"/></assert></rule><rule context="l | o"><assert test="@id">none</assert></rule></pattern>',
    "keys": '<key name="f" match="l" use="@f"/>' + rule("l", "<report test=\"count(key('f', @f)) &gt; 1\"><value-of select=\"count(key('f', current()/@f)[@q &gt; 20])\"/></report>"),
    "dates": rule("o", "<report test=\"xs:date(@date) gt xs:date('1996-02-05')\"><value-of select=\"string(xs:date(@date) + xs:yearMonthDuration('P1M'))\"/> <value-of select=\"string(xs:date(@date) - xs:date('1996-01-01'))\"/></report>"),
    "sequences": rule("o[l]", "<report test=\"max(l/@q) gt 9\"><value-of select=\"string-join(distinct-values(l/@f), ',')\"/> <value-of select=\"sum(for $i in 1 to 3 return count(l[position() &lt;= $i]))\"/> <value-of select=\"replace(@date, '(\\d+)-(\\d+)', '$2/$1')\"/></report>"),
}


@pytest.mark.parametrize("name", BODIES)
def test_same_as_plans(docs, name):
    body = BODIES[name]
    body = '<diagnostics><diagnostic id="d"><value-of select="name()"/></diagnostic></diagnostics>' + body if "diagnostics=" in body else body
    direct, lifted = both(docs, body)
    assert direct == lifted and direct[0]


def test_most_failures(docs):
    direct, lifted = both(docs, rule("l", '<assert test="@q &lt; 20">a</assert><report test="@q &gt; 5">r</report>'), max_failures=1)
    assert direct == lifted and direct[0]


@pytest.mark.parametrize("xml", [CASES[k][0] for k in ("namespaced siblings", "node kinds", "ancestors and ids", "namespaces")])
def test_trees_equal_node_tables(xml):
    tree = read(xml.encode())
    got = {n.pre: (n.pre, n.end, n.kind, n.prefix, n.local, n.uri, value(n), place(n)) for e in tree.nodes for n in (e, *attributes(e))}
    assert got == {r[0]: (r[0], r[1], *r[4:9], r[11]) for r in shred(xml) if r[4] != "namespace"}


def test_nothing_is_moved(docs):
    r = validate(docs, schema(rule("o[l]", '<assert test="count(l) &lt; 3 and l[1]/@q = l[last()]/@q" subject="l[1]">of <value-of select="@id"/></assert>')))
    for df in (r.findings, r.fired_rules, r.errors):
        assert moved(df) == []


def test_parts_are_spread(spark, sf):
    assert "Exchange hashpartitioning" in plan(coverage.item_docs(spark, sf))


def test_patterns_that_python_reads_otherwise_take_the_plan(spark, docs):
    s = parse_schema(HEAD + rule("o", "<report test=\"matches(@date, '^\\p{Nd}+-0')\">yes</report>") + "</schema>")
    r = validate(docs, s)
    assert r.documents is None and r.findings.count() == 20
    from xylem.plans.direct import regex

    with pytest.raises(Elsewhere):
        regex([("str", ""), ("str", "\\w+")], 1, 2)


def test_a_read_document_is_freed_at_once():
    import gc

    from xylem.sources.tree import Node

    gc.collect()
    gc.disable()
    try:
        tree = read(b"<o>" + b"<l n='1'>x</l>" * 500 + b"</o>")
        tree.drop()
        del tree
        assert sum(isinstance(x, Node) for x in gc.get_objects()) == 0
    finally:
        gc.enable()
