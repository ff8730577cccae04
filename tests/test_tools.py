from xylem.cli import main
from xylem.plans.lint import lint
from xylem.plans.schema import parse_schema
from xylem.streaming.stream import validate_stream

HEAD = '<schema xmlns="http://purl.oclc.org/dsdl/schematron">'


def kinds(body):
    return [k for k, _ in lint(parse_schema(f"{HEAD}{body}</schema>"))]


def rule(context, body='<assert test="@x">m</assert>'):
    return f'<rule context="{context}">{body}</rule>'


def test_lints():
    assert kinds('<pattern id="p"/>') == ["pattern-with-no-rules"]
    assert kinds(f"<pattern>{rule('a')}{rule('a')}</pattern>") == ["duplicate-rule-context"]
    assert kinds(f"<pattern>{rule('*')}{rule('b/a')}</pattern>") == ["unreachable-rule"]
    assert kinds(f"<pattern>{rule('a[1]')}{rule('a')}</pattern>") == []
    assert kinds(f"<pattern>{rule('a', '')}</pattern>") == ["rule-with-no-assertions"]
    assert kinds(f"<pattern>{rule('a', '<assert test=' + chr(34) + '@x' + chr(34) + '>m</assert>' * 1 + '<assert test=' + chr(34) + '@x' + chr(34) + '/>')}</pattern>") == ["duplicate-assertion-test", "empty-message"]
    assert kinds(f"<pattern>{rule('a', '<assert test=' + chr(34) + 'true()' + chr(34) + '>m</assert>')}</pattern>") == ["constant-test"]
    assert kinds(f'<ns prefix="p" uri="u"/><pattern>{rule("a")}</pattern>') == ["unprefixed-name"]
    assert kinds(f'<phase id="f"/><let name="v" value="1"/><key name="k" match="a" use="@i"/><diagnostics><diagnostic id="d">x</diagnostic></diagnostics><properties><property id="q">x</property></properties><pattern id="p">{rule("a")}</pattern>') == ["pattern-in-no-phase", "phase-with-no-patterns", "unreferenced-variable", "unreferenced-diagnostic", "unreferenced-property", "unreferenced-key"]


def test_command_line(spark, tmp_path, capsys):
    s, good, bad, broken = (tmp_path / n for n in ("s.sch", "good.xml", "bad.xml", "broken.xml"))
    s.write_text(f'{HEAD}<phase id="f"><active pattern="p"/></phase><pattern id="p">{rule("a")}</pattern></schema>')
    good.write_text("<a x='1'/>")
    bad.write_text("<a/>")
    broken.write_text("<a")
    go = lambda *a: main(["-s", str(s), *map(str, a)], spark)
    assert go(good) == 0 and go(good, bad) == 1 and go(broken) == 4 and go(tmp_path / "none") == 4
    assert go() == 2 and go("--lint") == 0 and go("--list-phases") == 0 and go("--explain") == 0 and go("-p", "zz", good) == 3
    assert go("-f", "svrl", bad) == 1
    assert "svrl:failed-assert" in capsys.readouterr().out


def test_stream(spark, tmp_path):
    docs = spark.createDataFrame([(i, "<a/>" if i % 2 else "<a x='1'/>") for i in range(6)], "doc_id long, xml string")
    docs.write.parquet(f"{tmp_path}/in")
    seen = []
    s = parse_schema(f"{HEAD}<pattern>{rule('a')}</pattern></schema>")
    stream = spark.readStream.schema(docs.schema).parquet(f"{tmp_path}/in")
    q = validate_stream(stream, s, lambda r, n: seen.extend(x.doc_id for x in r.findings.collect()), f"{tmp_path}/check", once=True)
    q.awaitTermination(120)
    assert sorted(seen) == [1, 3, 5]
