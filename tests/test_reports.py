"""Reports of documents validated where they lie: as those made from node tables, and nothing moved."""

from tests.test_engine import NO, rule, schema
from tests.test_inplace import docs, moved, plan  # noqa: F401
from xylem import coverage
from xylem.operators.render import from_svrl, to_json, to_svrl, to_text
from xylem.operators.validate import prepare, validate, validate_nodes
from xylem.sources.shred import nodes


def test_reports_move_nothing(docs):  # noqa: F811
    r = validate(docs, schema(rule("o[l]", '<assert test="count(l) &lt; 3" subject="l[1]">of <value-of select="@id"/></assert>')))
    for df in (to_text(r), to_json(r), to_svrl(r), from_svrl(to_svrl(r))):
        assert moved(df) == []


def test_reports_from_node_tables_are_the_same(docs):  # noqa: F811
    s = schema('<title>T</title>' + rule("l[@f = 'R']", '<assert test="@q &lt; 20" flag="x">a &lt;<value-of select="@q"/></assert><report test="@n = 0">r</report>') + rule("zzz", NO.format("x")))
    one, two = validate(docs, s), validate_nodes(prepare(nodes(docs)), s)
    for make in (to_text, to_json, to_svrl, lambda r: to_text(r, docs), lambda r: to_svrl(r, docs, fired_rules=False, successful_reports=False, indent=False)):
        a, b = (sorted(map(tuple, make(r).collect())) for r in (one, two))
        assert a == b and a


