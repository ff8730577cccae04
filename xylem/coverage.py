"""More queries of the engine, so that every group of functions, axes and report parts is held against SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from xylem.operators.render import from_svrl, to_json, to_svrl, to_text
from xylem.operators.validate import validate
from xylem.plans.lint import lint
from xylem.plans.schema import MemoryResolver, parse_schema
from xylem.queries import AT, LINES, QUERIES, SQL, docs_of, findings, rules, schema
from xylem.sources import tables
from xylem.sources.shred import nodes as shred


def says(*parts: str) -> str:
    """A message of several values, in bars."""
    return "|".join(f'<value-of select="{p}"/>' for p in parts)


def bars(*parts: str) -> str:
    return " || '|' || ".join(f"({p})" for p in parts)


def yes(cond: str) -> str:
    return f"CASE WHEN {cond} THEN 'true' ELSE 'false' END"


def shown(context: str, *parts: str, head: str = "") -> str:
    return f'{head}<pattern><rule context="{context}"><report test="not(false()) and boolean(.)">{says(*parts)}</report></rule></pattern>'


def sliced(context: str, values: tuple[str, ...], head: str = "", most: int = 3) -> str:
    """shown() of a few values at a time, a pattern each: a task's memory has room for a few joins."""
    return head + "".join(shown(context, *values[i : i + most]) for i in range(0, len(values), most))


def sliced_sql(select: str, values: tuple[str, ...], table: str, most: int = 3) -> str:
    return " UNION ALL ".join(f"{select}, {bars(*values[i : i + most])} AS text FROM {table}" for i in range(0, len(values), most))


ORDER = "(SELECT *, CAST(o_totalprice AS DECIMAL(18, 2))::DOUBLE AS t, o_orderdate::DATE AS d, (SELECT count(*) FROM lineitem WHERE l_orderkey = o_orderkey) AS n FROM orders)"
ROW = "SELECT o_orderkey AS doc_id, 'report' AS kind, '/order[1]' AS location, {} AS text FROM {}"

parts = ("floor(@total)", "ceiling(@total)", "round(@total)", "-count(line)", "contains(@priority, 'NOT')", "substring-after(@priority, '-')", "normalize-space(concat('  ', @priority, '   x '))", "string(@status)", "local-name()", "name(@id)", "local-name(line)", "number(@status)", "boolean(line)", "lang('en')", "@id mod 7")
findings("order_functions", "order", shown("*[self::order]", *parts),
         ROW.format(bars("floor(t)::BIGINT", "ceil(t)::BIGINT", "floor(t + 0.5)::BIGINT", "-n", yes("contains(o_orderpriority, 'NOT')"), "substr(o_orderpriority, instr(o_orderpriority, '-') + 1)", "o_orderpriority || ' x'", "o_orderstatus", "'order'", "'id'", "CASE WHEN n > 0 THEN 'line' ELSE '' END", "'NaN'", yes("n > 0"), "'false'", "o_orderkey % 7"), ORDER))

NATIONS = "(SELECT *, row_number() OVER w AS k, count(*) OVER (PARTITION BY n_regionkey) AS many, coalesce(sum(c + s + 1) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before, coalesce(sum(c + s + 1) OVER (w ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), 0)::BIGINT AS after, sum(c) OVER (PARTITION BY n_regionkey)::BIGINT AS customers FROM (SELECT *, (SELECT count(*) FROM customer WHERE c_nationkey = n_nationkey) AS c, (SELECT max(c_custkey) FROM customer WHERE c_nationkey = n_nationkey) AS last_c, (SELECT count(*) FROM supplier WHERE s_nationkey = n_nationkey) AS s, (SELECT max(s_suppkey) FROM supplier WHERE s_nationkey = n_nationkey) AS last_s FROM nation) WINDOW w AS (PARTITION BY n_regionkey ORDER BY n_nationkey))"
parts = ("count(ancestor-or-self::*)", "count(ancestor-or-self::node())", "count(descendant-or-self::*)", "count(self::nation)", "count(self::customer)", "count(following::nation)", "count(following::*)", "count(preceding::*)", "count(*)", "count(node())", "count(@*)", "count(following-sibling::*[1])", "name(..)", "count(/descendant::customer)", "(descendant::customer | descendant::supplier)[last()]/@key", "count(.. | .)", "preceding-sibling::nation[2]/@key", "count(preceding-sibling::nation)")
findings("world_axes", "world", sliced("nation", parts),
         sliced_sql("SELECT n_regionkey::BIGINT AS doc_id, 'report' AS kind, '/region[1]/nation[' || k || ']' AS location", ("2", "3", "1 + c + s", "1", "0", "many - k", "after", "before", "c + s", "c + s", "2", "CASE WHEN k < many THEN 1 ELSE 0 END", "'region'", "customers", "coalesce(last_s, last_c)::VARCHAR", "2", "coalesce(lag(n_nationkey, 2) OVER (PARTITION BY n_regionkey ORDER BY k)::VARCHAR, '')", "k - 1"), NATIONS))


def item_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One document a part, with namespaces, a comment and a processing instruction; spread, as few files hold many parts."""
    c, e = F.col, tables.escape
    xml = F.concat(F.lit('<item xmlns="urn:item" xmlns:p="urn:part" xml:lang="en-US" key="'), c("p_partkey").cast("string"), F.lit('"><!--'), c("p_brand"), F.lit("--><?size "), c("p_size").cast("string"), F.lit("?><p:name>"), e(c("p_name")), F.lit("</p:name>"), e(c("p_type")), F.lit("<p:kind/></item>"))
    return tables.read(spark, sf_dir, "part").repartition("p_partkey").select(c("p_partkey").alias("doc_id"), xml.alias("xml"))


def item_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = ("count(*)", "count(q:*)", "count(i:*)", "count(node())", "count(text())", "comment()", "processing-instruction('size')", "namespace-uri()", "namespace-uri(*[1])", "local-name(*[1])", "name(*[1])", "lang('en')", "lang('de')", "count(namespace::*)", "string(.)", "count(descendant-or-self::node())", "count(.//text())", "name(@xml:lang)", "string-length()")
    s = parse_schema(schema(sliced("i:item", parts, head='<ns prefix="i" uri="urn:item"/><ns prefix="q" uri="urn:part"/>')))
    return validate(item_docs(spark, sf_dir), s).findings.select("doc_id", "location", "text")


QUERIES["item_nodes"] = item_nodes
SQL["item_nodes"] = sliced_sql("SELECT p_partkey AS doc_id, '/*[local-name()=''item'' and namespace-uri()=''urn:item''][1]' AS location", ("2", "2", "0", "5", "1", "p_brand", "p_size", "'urn:item'", "'urn:part'", "'name'", "'p:name'", "'true'", "'false'", "3", "p_name || p_type", "7", "2", "'xml:lang'", "length(p_name || p_type)"), "part")

SEQUENCES = f"(SELECT l_orderkey, count(*) AS n, min(l_quantity)::BIGINT AS low, max(l_quantity)::BIGINT AS high, floor(avg(l_quantity))::BIGINT AS mid, coalesce(string_agg(i::VARCHAR, ' ' ORDER BY i) FILTER (l_returnflag = 'R'), '') AS at_r, max(l_linenumber) FILTER (i = 1) AS first_n, bool_or(l_quantity > 49) AS big, bool_or(l_returnflag = 'A') AS a, string_agg(l_quantity::BIGINT::VARCHAR, '+' ORDER BY i) AS all_q FROM {LINES} GROUP BY l_orderkey)"
FLAGS = f"(SELECT l_orderkey AS k, string_agg(l_returnflag, ',' ORDER BY lo) AS flags FROM (SELECT l_orderkey, l_returnflag, min(i) AS lo FROM {LINES} GROUP BY ALL) GROUP BY l_orderkey)"
parts = ("string-join(distinct-values(line/@flag), ',')", "min(line/@qty)", "max(line/@qty)", "floor(avg(line/@qty))", "abs(-count(line))", "string-join(for $i in index-of(line/@flag, 'R') return string($i), ' ')", "empty(line[@qty &gt; 49])", "exists(line[@flag = 'A'])", "lower-case(@priority)", "ends-with(@priority, 'T')", "replace(@priority, '[0-9]-', '')", "count(tokenize(@priority, '[- ]'))", "sum(1 to count(line))", "count((line/@qty, 1, 'x'))", "if (count(line) gt 3) then 'many' else count(line)", "count(line) instance of xs:integer", "(line[1] treat as element())/@n", "@id cast as xs:integer", "line instance of element()+", "string-join(line/@qty, '+')", "count(for $k in ('A', 'N') return line[@flag = $k])", "every $q in line/@qty satisfies $q &gt; 10")
values = ("flags", "low", "high", "mid", "n", "at_r", yes("NOT big"), yes("a"), "lower(o_orderpriority)", yes("ends_with(o_orderpriority, 'T')"), "regexp_replace(o_orderpriority, '[0-9]-', '', 'g')", "len(string_split_regex(o_orderpriority, '[- ]'))", "n * (n + 1) // 2", "n + 2", "CASE WHEN n > 3 THEN 'many' ELSE n::VARCHAR END", "'true'", "first_n", "o_orderkey", "'true'", "all_q", "(SELECT count(*) FROM lineitem l WHERE l.l_orderkey = o_orderkey AND l_returnflag IN ('A', 'N'))", yes("low > 10"))
for k, (some, want) in enumerate(zip((parts[:5], parts[5:12], parts[12:17], parts[17:]), (values[:5], values[5:12], values[12:17], values[17:])), 1):  # a task's memory has room for a few joins
    findings(f"order_sequences_{k}", "order", shown("order[line]", *some),
             "SELECT o_orderkey AS doc_id, 'report' AS kind, '/order[1]' AS location, " + bars(*want) + f" AS text FROM orders JOIN {SEQUENCES} s ON s.l_orderkey = o_orderkey JOIN {FLAGS} ON k = o_orderkey", binding="xslt2")

parts = ("string(xs:date(@date) + xs:dayTimeDuration('P30D'))", "string(xs:date(@date) + xs:yearMonthDuration('P1M'))", "string(xs:date(@date) - xs:yearMonthDuration('P1Y'))", "days-from-duration(xs:date(@date) - xs:date('1992-01-01'))", "year-from-date(@date)", "month-from-date(@date)", "day-from-date(@date)", "string(timezone-from-date(concat(@date, '+05:30')))", "string(xs:dayTimeDuration('P3D') * 2)", "xs:dayTimeDuration('P3D') div xs:dayTimeDuration('PT12H')", "xs:date(@date) lt xs:date('1997-01-01')", "@date &gt; xs:date('1997-01-01')", "xs:date(@date) eq xs:date(@date)", "string(xs:yearMonthDuration('P30M'))", "years-from-duration(xs:yearMonthDuration('P30M'))", "months-from-duration(xs:yearMonthDuration('P30M'))", "@date castable as xs:date", "(@date cast as xs:date) instance of xs:date", "string(xs:dayTimeDuration('P1D') + xs:dayTimeDuration('PT1H') - xs:dayTimeDuration('PT2H'))")
findings("order_dates", "order", shown("order", *parts),
         ROW.format(bars("(d + 30)::VARCHAR", "(d + INTERVAL 1 MONTH)::DATE::VARCHAR", "(d - INTERVAL 1 YEAR)::DATE::VARCHAR", "(d - DATE '1992-01-01')::BIGINT", "year(d)", "month(d)", "day(d)", "'PT5H30M'", "'P6D'", "6", yes("d < DATE '1997-01-01'"), yes("d > DATE '1997-01-01'"), "'true'", "'P2Y6M'", "2", "6", "'true'", "'true'", "'PT23H'"), ORDER), binding="xslt2")

parts = ("hours-from-dateTime(@ts)", "minutes-from-dateTime(@ts)", "seconds-from-dateTime(@ts)", "year-from-dateTime(@ts)", "month-from-dateTime(@ts)", "day-from-dateTime(@ts)", "string(xs:dateTime(@ts) + xs:dayTimeDuration('PT36H'))", "hours-from-time(substring-after(@ts, 'T'))", "minutes-from-time(substring-after(@ts, 'T'))", "seconds-from-time(substring-after(@ts, 'T'))", "string(implicit-timezone())", "string(timezone-from-dateTime(concat(@ts, 'Z')))", "string(timezone-from-time(concat(substring-after(@ts, 'T'), '-03:00')))", "days-from-duration(xs:dateTime(@ts) - xs:dateTime('2020-01-01T00:00:00'))", "hours-from-duration(xs:dateTime(@ts) - xs:dateTime('2020-01-01T00:00:00'))", "minutes-from-duration(xs:dateTime(@ts) - xs:dateTime('2020-01-01T00:00:00'))", "seconds-from-duration(xs:dateTime(@ts) - xs:dateTime('2020-01-01T00:00:00'))", "string(current-date())", "string(current-dateTime())", "string(current-time())", "xs:dateTime(@ts) lt current-dateTime()", "xs:time(substring-after(@ts, 'T')) lt xs:time('12:00:00')")
findings("event_times", "event", shown("event", *parts),
         "SELECT user_id AS doc_id, 'report' AS kind, '/events[1]/event[' || row_number() OVER (PARTITION BY user_id ORDER BY event_id) || ']' AS location, " + bars("hour(t)", "minute(t)", "second(t)", "year(t)", "month(t)", "day(t)", "strftime(t + INTERVAL 36 HOUR, '%Y-%m-%dT%H:%M:%S')", "hour(t)", "minute(t)", "second(t)", "'PT0S'", "'PT0S'", "'-PT3H'", "e // 86400", "e % 86400 // 3600", "e % 3600 // 60", "e % 60", "'2024-03-01Z'", "'2024-03-01T12:00:00Z'", "'12:00:00Z'", yes("t < TIMESTAMP '2024-03-01 12:00:00'"), yes("hour(t) < 12")) + " AS text FROM (SELECT *, date_diff('second', TIMESTAMP '2020-01-01', t) AS e FROM (SELECT *, date_trunc('second', ts) AS t FROM events))", binding="xslt2", now=1709294400.0)

TESTS = {
    "line/@qty = line/@n": ("pair", f"o_orderkey IN (SELECT a.l_orderkey FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_quantity = b.l_linenumber)"),  # noqa: F541
    "line = true()": ("some", "n > 0"),
    "line/@flag = ('R', 'X')": ("listed", "o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')"),
    "line[1] is line[last()]": ("alone", "n = 1"),
    "line[1] &lt;&lt; line[2] and line[2] &gt;&gt; line[1]": ("placed", "n > 1"),
    "@status eq 'O'": ("open", "o_orderstatus = 'O'"),
    "@status ne 'F' and @status ge 'O'": ("later", "o_orderstatus <> 'F' AND o_orderstatus >= 'O'"),
    "count(line) ge 6 and count(line) le 7": ("long", "n BETWEEN 6 AND 7"),
    "not(line/@none eq 'x') and count(line) gt 8": ("longer", "n > 8"),
    "(line/@qty)[last()] = 50 or (line/@qty)[1] &lt; 2": ("edges", f"o_orderkey IN (SELECT l_orderkey FROM {LINES} WHERE (i = n AND l_quantity = 50) OR (i = 1 AND l_quantity < 2))"),
    "string-length(if (line) then @status else 12) = 2": ("typed", "n = 0"),
    "line/@qty != line/@qty": ("differ", "o_orderkey IN (SELECT l_orderkey FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_quantity) > 1)"),
}
findings("order_comparisons", "order", '<pattern><rule context="order">' + "".join(f'<report test="{t}">{text}</report>' for t, (text, _) in TESTS.items()) + "</rule></pattern>",
         " UNION ALL ".join(f"SELECT o_orderkey AS doc_id, 'report' AS kind, '/order[1]' AS location, '{text}' AS text FROM {ORDER} WHERE {cond}" for text, cond in TESTS.values()), binding="xslt2")

findings("sequence_lets", "order", """<let name="flags" value="distinct-values(//line/@flag)"/><let name="end" value="xs:date('1998-06-30')"/><let name="span" value="xs:dayTimeDuration('P10D')"/><let name="word">it's</let><pattern><rule context="order[line]"><let name="mine" value="line/@qty"/><report test="count($flags) = 3 and xs:date(@date) lt $end">"""
         + says("count($flags)", "string($end + $span)", "count($mine)", "string-join(for $f in $flags return $f, '')", "$word") + "</report></rule></pattern>",
         "SELECT o_orderkey AS doc_id, 'report' AS kind, '/order[1]' AS location, " + bars("3", "'1998-07-10'", "n", "replace(flags, ',', '')", "'it''s'") + f" AS text FROM {ORDER} JOIN {FLAGS} ON k = o_orderkey WHERE len(flags) = 5 AND d < DATE '1998-06-30'", binding="xslt2")

findings("keys_and_current", "order", '<key name="by" match="line" use="@part"/><pattern><rule context="line"><report test="count(key(\'by\', @part)) &gt; 1"><value-of select="count(../line[@part = current()/@part])"/> of <value-of select="count(key(\'by\', current()/@part)[@flag = \'N\'])"/></report></rule></pattern>',
         f"SELECT l_orderkey AS doc_id, 'report' AS kind, {AT} AS location, count(*) OVER w || ' of ' || count(*) FILTER (l_returnflag = 'N') OVER w AS text FROM {LINES} WINDOW w AS (PARTITION BY l_orderkey, l_partkey) QUALIFY count(*) OVER w > 1")

MARKED = '<diagnostics><diagnostic id="d1">total <value-of select="@total"/></diagnostic></diagnostics><properties><property id="p1" role="unit" scheme="s">of <name/></property></properties><pattern id="pat"><rule context="order" role="base" flag="minor" subject="line[1]"><assert test="count(line) &lt; 6" id="a1" flag="major" diagnostics="d1" properties="p1" see="urn:see" icon="i" fpi="f">many</assert><report test="@status = \'P\'" subject="." role="own">pending</report></rule></pattern>'


def marked_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = rules("order", MARKED)(spark, sf_dir).with_flag("major", "minor")
    return got.select("doc_id", "pattern_id", "kind", "location", "text", "id", "role", "flag", "see", "icon", "fpi", F.array_join(F.transform("diagnostics", lambda d: F.concat(d["id"], F.lit("="), d["text"])), ",").alias("diagnostics"), F.array_join(F.transform("properties", lambda d: F.concat_ws(":", d["id"], d["role"], d["scheme"], d["text"])), ",").alias("properties"))


QUERIES["marked_findings"] = marked_findings
SQL["marked_findings"] = f"SELECT o_orderkey AS doc_id, 'pat' AS pattern_id, 'assert' AS kind, '/order[1]/line[1]' AS location, 'many' AS text, 'a1' AS id, 'base' AS role, 'major' AS flag, 'urn:see' AS see, 'i' AS icon, 'f' AS fpi, 'd1=total ' || CAST(o_totalprice AS DECIMAL(18, 2)) AS diagnostics, 'p1:unit:s:of order' AS properties FROM {ORDER} WHERE n >= 6 UNION ALL SELECT o_orderkey, 'pat', 'report', '/order[1]', 'pending', NULL, 'own', 'minor', NULL, NULL, NULL, '', '' FROM orders WHERE o_orderstatus = 'P'"

HEAVY = '<title>Heavy lines</title><pattern id="heavy"><rule context="line[@flag = \'R\']" id="r"><assert test="@qty &lt; 40" id="q" flag="f">a &lt;heavy&gt; &amp; "returned" <value-of select="@qty"/></assert></rule></pattern><pattern id="none"><rule context="zzz"><assert test="@a"/></rule></pattern>'
FOUND = f"(SELECT l_orderkey AS doc_id, i, {AT} AS location, 'a <heavy> & \"returned\" ' || l_quantity::BIGINT AS text, l_quantity >= 40 AS bad FROM {LINES} WHERE l_returnflag = 'R')"


def svrl_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return from_svrl(to_svrl(rules("order", HEAVY)(spark, sf_dir))).select("doc_id", "pattern_ix", "kind", "rule", "test", "location", "text", "id", "flag")


def report_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return to_text(rules("order", HEAVY)(spark, sf_dir))


def report_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = lambda p: F.coalesce(F.get_json_object("json", f"$.{p}"), F.lit(""))
    return to_json(rules("order", HEAVY)(spark, sf_dir)).select("doc_id", at("title").alias("title"), at("patterns[1].pattern_id").alias("second"), at("patterns[0].rules[0].location").alias("first_rule"), at("patterns[0].rules[0].assertions[0].text").alias("first_text"))


QUERIES |= {"svrl_round_trip": svrl_round_trip, "report_text": report_text, "report_json": report_json}
SQL["svrl_round_trip"] = f"SELECT doc_id, 0::BIGINT AS pattern_ix, 'assert' AS kind, 'line[@flag = ''R'']' AS rule, '@qty < 40' AS test, location, text, 'q' AS id, 'f' AS flag FROM {FOUND} WHERE bad"
SQL["report_text"] = f"SELECT doc_id, coalesce(string_agg('FAIL ' || location || ': ' || text || ' [f]' || chr(10), '' ORDER BY i) FILTER (bad), '') || CASE WHEN bool_or(bad) THEN count(*) FILTER (bad) || ' failed' ELSE 'valid' END AS text FROM {FOUND} GROUP BY doc_id"
SQL["report_json"] = f"SELECT doc_id, 'Heavy lines' AS title, 'none' AS second, min_by(location, i) AS first_rule, coalesce(min_by(CASE WHEN bad THEN text END, i), '') AS first_text FROM (SELECT * FROM {FOUND} QUALIFY i = min(i) OVER (PARTITION BY doc_id)) GROUP BY doc_id"

LIBRARY = {"lib": '<pattern xmlns="http://purl.oclc.org/dsdl/schematron" id="inc"><rule abstract="true" id="base"><report test="@qty = 50">fifty</report></rule><rule context="line[@flag = \'A\']"><extends rule="base"/><report test="@qty = 1">one</report></rule></pattern>'}
TEMPLATE = '<phase id="both"><active pattern="inc"/><active pattern="most"/></phase><include href="lib#inc"/><pattern abstract="true" id="over"><rule context="$what"><report test="$field &gt; $limit"><value-of select="$field"/> over <value-of select="$limit"/></report></rule></pattern><pattern is-a="over" id="most"><param name="what" value="line"/><param name="field" value="@qty"/><param name="limit" value="49"/></pattern><pattern is-a="over" id="idle"><param name="what" value="order"/><param name="field" value="@id"/><param name="limit" value="-1"/></pattern>'


def templates_and_includes(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = parse_schema(schema(TEMPLATE), MemoryResolver(LIBRARY))
    return validate(docs_of(spark, sf_dir, "order"), s, "both").findings.select("doc_id", "pattern_id", "location", "text")


def lints(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = '<ns prefix="p" uri="u"/><phase id="f"/><let name="v" value="1"/><key name="k" match="a" use="@i"/><diagnostics><diagnostic id="d">x</diagnostic></diagnostics><properties><property id="q">x</property></properties><pattern id="p"><rule context="a"><assert test="@x"/><assert test="@x">m</assert><report test="true()">t</report></rule><rule context="a"><assert test="@y">m</assert></rule><rule context="b"/></pattern><pattern id="e"/><pattern id="g"><rule context="*"><assert test="@z">z</assert></rule><rule context="c/d"><assert test="@z">z</assert></rule></pattern>'
    return spark.createDataFrame([(k,) for k, _ in lint(parse_schema(schema(body)))], "lint string").groupBy("lint").agg(F.count("*").alias("n"))


def shred_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = tables.order_docs(spark, sf_dir).withColumn("xml", F.when(F.col("doc_id") % 2 == 0, F.encode("xml", "UTF-8")).otherwise(F.encode("xml", "UTF-16")))
    return shred(docs).groupBy("kind").agg(F.count("*").alias("n"), F.sum("depth").cast("long").alias("depths"))


QUERIES |= {"templates_and_includes": templates_and_includes, "lints": lints, "shred_bytes": shred_bytes}
SQL["templates_and_includes"] = f"SELECT l_orderkey AS doc_id, 'inc' AS pattern_id, {AT} AS location, CASE WHEN l_quantity = 50 THEN 'fifty' ELSE 'one' END AS text FROM {LINES} WHERE l_returnflag = 'A' AND l_quantity IN (1, 50) UNION ALL SELECT l_orderkey, 'most', {AT}, l_quantity::BIGINT || ' over 49' FROM {LINES} WHERE l_quantity > 49"
SQL["lints"] = "SELECT * FROM (VALUES ('constant-test', 1::BIGINT), ('duplicate-assertion-test', 1), ('duplicate-rule-context', 1), ('empty-message', 1), ('pattern-in-no-phase', 3), ('pattern-with-no-rules', 1), ('phase-with-no-patterns', 1), ('rule-with-no-assertions', 1), ('unprefixed-name', 4), ('unreachable-rule', 1), ('unreferenced-diagnostic', 1), ('unreferenced-key', 1), ('unreferenced-property', 1), ('unreferenced-variable', 1)) AS v(lint, n)"
SQL["shred_bytes"] = SQL["nodes_by_kind"]
