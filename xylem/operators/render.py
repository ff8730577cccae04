"""Reports as the standard validation report XML, as JSON and as text, one string a document; and the XML read back."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from xylem.operators.validate import Report
from xylem.plans.lift import fresh
from xylem.sources.shred import DocumentError
from xylem.sources.tree import read, value

SVRL = "http://purl.oclc.org/dsdl/svrl"


def escape(c: Column, attribute: bool = False) -> Column:
    marks = [("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")] + ([('"', "&quot;"), ("\n", "&#10;"), ("\r", "&#13;"), ("\t", "&#9;")] if attribute else [])
    for a, b in marks:
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def attrs(**cols: Column) -> Column:
    parts = [F.when(c.isNotNull(), F.concat(F.lit(f' {k.replace("_", "-")}="'), escape(c.cast("string"), True), F.lit('"'))).otherwise("") for k, c in cols.items()]
    return F.concat(F.lit(""), *parts)


def ids(report: Report) -> DataFrame:
    """Every document that was read: those with fired rules; documents in which nothing fired come from the caller's list."""
    return report.fired_rules.select("doc_id").distinct()


def collected(rows: DataFrame, order: list[str], value: str) -> DataFrame:
    """doc_id and the values of its rows in order, as an array."""
    name = fresh("r")
    return rows.groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct(*order, value))), lambda r: r[value]).alias(name)).withColumnRenamed(name, "parts")


def svrl_finding(c: Callable[[str], Column]) -> Column:
    text = lambda k: F.concat(F.lit("<svrl:text>"), escape(k), F.lit("</svrl:text>"))
    more = F.concat(
        F.array_join(F.transform(c("diagnostics"), lambda d: F.concat(F.lit('<svrl:diagnostic-reference diagnostic="'), escape(d["id"], True), F.lit('">'), text(d["text"]), F.lit("</svrl:diagnostic-reference>"))), ""),
        F.array_join(F.transform(c("properties"), lambda p: F.concat(F.lit("<svrl:property-reference"), attrs(property=p["id"], role=p["role"], scheme=p["scheme"]), F.lit(">"), text(p["text"]), F.lit("</svrl:property-reference>"))), ""),
    )
    tag = F.when(c("kind") == "assert", "svrl:failed-assert").otherwise("svrl:successful-report")
    return F.concat(F.lit("<"), tag, attrs(test=c("test"), location=c("location"), id=c("id"), role=c("role"), flag=c("flag"), see=c("see"), icon=c("icon"), fpi=c("fpi")), F.lit(">"), more, text(c("text")), F.lit("</"), tag, F.lit(">"))


def svrl_rule(c: Callable[[str], Column]) -> Column:
    return F.concat(F.lit("<svrl:fired-rule"), attrs(context=c("context"), id=c("rule_id"), role=c("role"), flag=c("flag")), F.lit("/>"))


def documents(report: Report, docs: DataFrame | None) -> DataFrame:
    """The report's documents: of the given ones all, else those with fired rules."""
    if docs is None:
        return report.documents.filter(F.size("fired_rules") > 0)
    kept = docs.select("doc_id").distinct().join(report.documents, "doc_id", "left")
    return kept.select("doc_id", *[F.coalesce(k, F.array().cast(report.documents.schema[k].dataType)).alias(k) for k in ("fired_rules", "findings")])


def to_svrl(report: Report, docs: DataFrame | None = None, fired_rules: bool = True, successful_reports: bool = True, indent: bool = True) -> DataFrame:
    """doc_id and svrl: active patterns, fired rules, failed asserts and successful reports in the report's order.

    docs: the documents to render (column doc_id), so that those without findings get a report, too."""
    s = report.schema
    c = F.col
    gap = "\n  " if indent else ""
    spaces = "".join(f'{gap}<svrl:ns-prefix-in-attribute-values prefix="{p}" uri="{u}"/>' for p, u in s.namespaces.items())
    begin = F.concat(F.lit(f'<svrl:schematron-output xmlns:svrl="{SVRL}"'), attrs(title=F.lit(s.title).cast("string"), phase=F.lit(report.phase).cast("string"), schemaVersion=F.lit(s.version).cast("string")), F.lit(f">{spaces}"))
    if report.documents is not None:
        entry = lambda x, n, line: F.struct(x["pattern_ix"].alias("pattern_ix"), x["pre"].alias("pre"), n.alias("n"), line.alias("x"))
        found = F.filter("findings", lambda x: F.lit(successful_reports) | (x["kind"] == "assert"))
        events = [F.transform(found, lambda x: entry(x, x["assert_ix"] + 1, svrl_finding(lambda k: x[k])))]
        if fired_rules:
            events.append(F.transform("fired_rules", lambda x: entry(x, F.lit(0), svrl_rule(lambda k: x[k]))))
        if report.patterns:
            heads = [F.struct(F.lit(i).alias("pattern_ix"), F.lit(-1).alias("pre"), F.lit(0).alias("n"), F.concat(F.lit("<svrl:active-pattern"), attrs(id=F.lit(a).cast("string"), name=F.lit(b).cast("string")), F.lit("/>")).alias("x")) for i, a, b in report.patterns]
            events.append(F.array(*heads))
        parts = documents(report, docs).select("doc_id", F.transform(F.array_sort(F.concat(*events)), lambda x: x["x"]).alias("parts"))
    else:
        found = report.findings if successful_reports else report.failures()
        events = found.select("doc_id", "pattern_ix", "pre", (c("assert_ix") + 1).alias("n"), svrl_finding(c).alias("x"))
        if fired_rules:
            events = events.unionByName(report.fired_rules.select("doc_id", "pattern_ix", "pre", F.lit(0).alias("n"), svrl_rule(c).alias("x")))
        base = (docs if docs is not None else ids(report)).select("doc_id").distinct()
        if report.patterns:
            active = base.sparkSession.createDataFrame([(i, a, b) for i, a, b in report.patterns], "pattern_ix int, pid string, pname string")
            heads = base.join(F.broadcast(active)).select("doc_id", "pattern_ix", F.lit(-1).alias("pre"), F.lit(0).alias("n"), F.concat(F.lit("<svrl:active-pattern"), attrs(id=c("pid"), name=c("pname")), F.lit("/>")).alias("x"))
            events = events.unionByName(heads)
        parts = base.join(collected(events, ["pattern_ix", "pre", "n"], "x"), "doc_id", "left")
    body = F.array_join(F.transform(F.coalesce("parts", F.array().cast("array<string>")), lambda x: F.concat(F.lit(gap), x)), "")
    return parts.select("doc_id", F.concat(begin, body, F.lit("\n" if indent else ""), F.lit("</svrl:schematron-output>")).alias("svrl"))


def text_finding(c: Callable[[str], Column]) -> Column:
    extra = F.array_join(F.transform(c("diagnostics"), lambda d: F.concat(F.lit("\n    "), d["id"], F.lit(": "), d["text"])), "")
    return F.concat(F.when(c("kind") == "assert", "FAIL ").otherwise("NOTE "), c("location"), F.lit(": "), c("text"), F.when(c("flag").isNotNull(), F.concat(F.lit(" ["), c("flag"), F.lit("]"))).otherwise(""), extra)


def to_text(report: Report, docs: DataFrame | None = None) -> DataFrame:
    """doc_id and text: a line a finding, then its diagnostics, then the number of failures."""
    c = F.col
    if report.documents is not None:
        rows = documents(report, docs).select("doc_id", F.transform("findings", lambda x: text_finding(lambda k: x[k])).alias("parts"), F.size(F.filter("findings", lambda x: x["kind"] == "assert")).alias("n"))
    else:
        parts = collected(report.findings.withColumn("x", text_finding(c)), ["pattern_ix", "pre", "assert_ix"], "x")
        n = report.failures().groupBy("doc_id").agg(F.count("*").alias("n"))
        rows = (docs if docs is not None else ids(report)).select("doc_id").distinct().join(parts, "doc_id", "left").join(n, "doc_id", "left")
    total = F.coalesce(c("n"), F.lit(0))
    end = F.when(total == 0, "valid").otherwise(F.concat(total.cast("string"), F.lit(" failed")))
    return rows.select("doc_id", F.concat(F.array_join(F.transform(F.coalesce("parts", F.array().cast("array<string>")), lambda x: F.concat(x, F.lit("\n"))), ""), end).alias("text"))


def to_json(report: Report, docs: DataFrame | None = None) -> DataFrame:
    """doc_id and json: the findings as a tree of all active patterns, fired rules and assertions.

    docs: the documents to render (column doc_id), so that those in which nothing fired get a report, too."""
    if report.documents is not None:
        return json_in_place(report, documents(report, docs))
    found = report.findings.groupBy("doc_id", "pattern_ix", "pre", "rule_ix").agg(F.array_sort(F.collect_list(F.struct("assert_ix", "kind", "test", "location", "text", "id", "role", "flag", "see", "icon", "fpi", "diagnostics", "properties"))).alias("assertions"))
    fired = report.fired_rules.join(found, ["doc_id", "pattern_ix", "pre", "rule_ix"], "left")
    fired = fired.withColumn("assertions", F.coalesce("assertions", F.array().cast(found.schema["assertions"].dataType)))
    rules = fired.groupBy("doc_id", "pattern_ix").agg(F.array_sort(F.collect_list(F.struct("pre", "rule_id", "context", "role", "flag", "location", "assertions"))).alias("rules"))
    base = (docs if docs is not None else ids(report)).select("doc_id").distinct()
    heads = base.sparkSession.createDataFrame(report.patterns, "pattern_ix int, pattern_id string, name string")
    all_ = base.select("doc_id", F.explode(F.array(*[F.lit(i) for i, _, _ in report.patterns]) if report.patterns else F.array().cast("array<int>")).alias("pattern_ix")).join(F.broadcast(heads), "pattern_ix")
    all_ = all_.join(rules, ["doc_id", "pattern_ix"], "left").withColumn("rules", F.coalesce("rules", F.array().cast(rules.schema["rules"].dataType)))
    patterns = all_.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("pattern_ix", "pattern_id", "name", "rules"))).alias("patterns"))
    patterns = base.join(patterns, "doc_id", "left").withColumn("patterns", F.coalesce("patterns", F.array().cast(patterns.schema["patterns"].dataType)))
    return patterns.select("doc_id", F.to_json(F.struct(F.lit(report.schema.title).cast("string").alias("title"), F.lit(report.phase).cast("string").alias("phase"), "patterns")).alias("json"))


def json_in_place(report: Report, docs: DataFrame) -> DataFrame:
    """to_json() of documents with their fired rules and findings as arrays."""
    some = lambda x, *names: F.struct(*[x[n].alias(n) for n in names])
    of = lambda x: F.transform(F.slice("findings", x["first"] + 1, x["many"]), lambda y: some(y, "assert_ix", "kind", "test", "location", "text", "id", "role", "flag", "see", "icon", "fpi", "diagnostics", "properties"))
    rule = lambda x: F.struct(*[x[n].alias(n) for n in ("pre", "rule_id", "context", "role", "flag", "location")], of(x).alias("assertions"))
    heads = F.array(*[F.struct(F.lit(i).alias("pattern_ix"), F.lit(a).cast("string").alias("pattern_id"), F.lit(b).cast("string").alias("name")) for i, a, b in report.patterns])
    rules = lambda p: F.transform(F.filter("fired_rules", lambda x: x["pattern_ix"] == p["pattern_ix"]), rule)
    patterns = F.transform(heads, lambda p: F.struct(p["pattern_ix"].alias("pattern_ix"), p["pattern_id"].alias("pattern_id"), p["name"].alias("name"), rules(p).alias("rules")))
    return docs.select("doc_id", F.to_json(F.struct(F.lit(report.schema.title).cast("string").alias("title"), F.lit(report.phase).cast("string").alias("phase"), patterns.alias("patterns"))).alias("json"))


def from_svrl(docs: DataFrame, id_col: str = "doc_id", xml_col: str = "svrl") -> DataFrame:
    """Findings from validation reports: kind, pattern_ix, rule (its context), test, location, text, id, role and flag, in order.

    The report's elements are flat siblings; each finding belongs to the last pattern and fired rule before it."""
    from xylem.operators.inplace import rows

    kinds = {"failed-assert": "assert", "successful-report": "report"}
    keys = ("test", "location", "id", "role", "flag")

    def make() -> Callable:
        def go(xml) -> Iterator[tuple]:
            try:
                root = read(xml).root
            except DocumentError:
                return
            pattern, rule = -1, None
            for e in [k for top in root.kids or () for k in top.kids or ()]:
                if e.kind != "element" or e.uri != SVRL:
                    continue
                pattern += e.local == "active-pattern"
                if e.local == "fired-rule":
                    rule = e.attrs.get("context", rule)
                elif e.local in kinds:
                    said = [value(t) for t in e.kids or () if t.kind == "element" and t.local == "text"]
                    for x in said or [None]:
                        yield pattern, e.pre, kinds[e.local], rule, *[e.attrs.get(k) for k in keys], x

        return go

    columns = "pattern_ix long, pre int, kind string, rule string, " + ", ".join(f"{k} string" for k in (*keys, "text"))
    return rows(docs, id_col, xml_col, columns, [pa.int64(), pa.int32(), *[pa.string()] * 8], make)
