"""XML documents to a table of nodes in document order.

One row a node: pre numbers the nodes, end is the last pre of the subtree, so that every axis is an equality or a range. The
only stage that isn't a Catalyst plan: expat parses each document in an Arrow batch.
"""

from __future__ import annotations

import xml.parsers.expat as expat
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

XML_NS = "http://www.w3.org/XML/1998/namespace"
MAX_DEPTH = 1024
FIELDS = [("pre", "int"), ("end", "int"), ("parent", "int"), ("depth", "int"), ("kind", "string"), ("prefix", "string"), ("local", "string"), ("uri", "string"), ("value", "string"), ("child_ix", "int"), ("sib_pos", "int"), ("loc", "string"), ("lang", "string"), ("attrs", "map<string,string>")]
_ARROW = {"int": pa.int32(), "string": pa.string(), "map<string,string>": pa.map_(pa.string(), pa.string())}


class DocumentError(ValueError):
    def __init__(self, message: str, line: int, column: int) -> None:
        super().__init__(f"{message} at {line}:{column}")
        self.message, self.line, self.column = message, line, column


class _Shredder:
    """Collects rows as lists in the order of FIELDS, with string values filled in at closing tags."""

    def __init__(self) -> None:
        self.rows: list[list] = []
        self.text: list[str] = []
        self.size = 0
        self.open: list[dict] = []
        self.entities: set[str] = set()
        self.run: list[str] = []
        p = self.p = expat.ParserCreate()
        p.ordered_attributes, p.buffer_text, p.namespace_prefixes = True, True, False
        p.StartElementHandler, p.EndElementHandler = self.start, self.finish
        p.CharacterDataHandler, p.CommentHandler, p.ProcessingInstructionHandler = self.chars, self.comment, self.pi
        p.EntityDeclHandler = lambda name, *_: self.entities.add(name)
        p.DefaultHandler = self.other
        self.add("root", None, None, None, "", {}, "/")
        self.open.append({"row": self.rows[0], "at": 0, "children": 0, "counts": {}, "ns": {"xml": XML_NS}, "loc": "", "lang": None})

    def fail(self, message: str) -> None:
        raise DocumentError(message, self.p.CurrentLineNumber, self.p.CurrentColumnNumber + 1)

    def other(self, data: str) -> None:
        if data.startswith("&") and data.endswith(";"):
            self.fail(f"unknown entity {data}")

    def add(self, kind, prefix, local, uri, value, counts, loc, child=True) -> list:
        top = self.open[-1] if self.open else None
        ix = sib = None
        if top is not None and child:
            ix = top["children"]
            top["children"] += 1
            key = (kind, uri, local) if kind == "element" else (kind,)
            sib = top["counts"][key] = top["counts"].get(key, 0) + 1
            loc = top["loc"] + "/" + loc + f"[{sib}]"
        pre = len(self.rows)
        row = [pre, pre, top["row"][0] if top else None, len(self.open), kind, prefix, local, uri, value, ix, sib, loc, top["lang"] if top else None, None]
        self.rows.append(row)
        return row

    def flush(self) -> None:
        if self.run:
            value = "".join(self.run)
            self.run = []
            if len(self.open) == 1:
                if value.strip(" \t\r\n"):
                    self.fail("text outside the document element")
                return
            self.add("text", None, None, None, value, None, "text()")
            self.text.append(value)
            self.size += len(value)

    def name(self, raw: str, scope: dict, attribute: bool) -> tuple[str | None, str, str | None]:
        prefix, colon, local = raw.partition(":")
        if not colon:
            return None, raw, None if attribute else scope.get("", None)
        if prefix not in scope:
            self.fail(f"undeclared prefix {prefix}")
        return prefix, local, scope[prefix]

    def start(self, raw: str, flat: list[str]) -> None:
        self.flush()
        if len(self.open) > MAX_DEPTH:
            self.fail("nested too deeply")
        pairs = list(zip(flat[::2], flat[1::2]))
        top = self.open[-1]
        scope = top["ns"]
        declared = {k[6:] if k != "xmlns" else "": v for k, v in pairs if k == "xmlns" or k.startswith("xmlns:")}
        if declared:
            scope = {k: v for k, v in (scope | declared).items() if v or k}
            if not scope.get("", "x"):
                scope.pop("")
        prefix, local, uri = self.name(raw, scope, False)
        step = local if not uri else f"*[local-name()='{local}' and namespace-uri()='{uri}']"
        row = self.add("element", prefix, local, uri, "", None, step)
        attrs, lang = {}, top["lang"]
        here = {"row": row, "at": len(self.text), "children": 0, "counts": {}, "ns": scope, "loc": row[11], "lang": lang}
        self.open.append(here)
        for p in sorted(scope):
            self.add("namespace", None, p, None, scope[p], None, f"{row[11]}/namespace::{p or '*'}", child=False)
        for k, v in pairs:
            if k == "xmlns" or k.startswith("xmlns:"):
                continue
            p, name, u = self.name(k, scope, True)
            if u == XML_NS and name == "lang":
                lang = v
            attrs["{%s}%s" % (u, name) if u else name] = v
            at = f"@{name}" if not u else f"@*[local-name()='{name}' and namespace-uri()='{u}']"
            self.add("attribute", p, name, u, v, None, f"{row[11]}/{at}", child=False)
        row[13], row[12], here["lang"] = list(attrs.items()), lang, lang

    def finish(self, raw: str) -> None:
        self.flush()
        top = self.open.pop()
        top["row"][1] = len(self.rows) - 1
        top["row"][8] = "".join(self.text[top["at"] :])

    def chars(self, data: str) -> None:
        self.run.append(data)

    def comment(self, data: str) -> None:
        self.flush()
        self.add("comment", None, None, None, data, None, "comment()")

    def pi(self, target: str, data: str) -> None:
        self.flush()
        self.add("processing-instruction", None, target, None, data, None, "processing-instruction()")


def shred(xml: str | bytes) -> list[list]:
    """Rows of FIELDS for each node, or a DocumentError. Entities that a document declares are errors where used."""
    s = _Shredder()
    try:
        s.p.Parse(xml if isinstance(xml, bytes) else xml.encode(), True)
    except expat.ExpatError as e:
        raise DocumentError(expat.ErrorString(e.code), e.lineno, e.offset + 1) from None
    s.flush()
    s.rows[0][1] = len(s.rows) - 1
    s.rows[0][8] = "".join(s.text)
    return s.rows


def nodes(docs: DataFrame, id_col: str = "doc_id", xml_col: str = "xml", namespaces: bool = False) -> DataFrame:
    """doc_id and FIELDS for every node of every document; a document that can't be parsed is one row of kind 'error', whose
    value is the message and whose pre and end are line and column. Null documents are errors, too. Rows of namespace nodes,
    one for each binding on every element, are left out unless asked for (only the namespace axis sees them)."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, rows = [], []
        for batch in batches:
            for i, xml in zip(batch.column(0).to_pylist(), batch.column(1)):
                try:
                    got = shred(xml.as_py() or "")
                except DocumentError as e:
                    got = [[e.line, e.column, None, 0, "error", None, None, None, e.message, None, None, None, None, None]]
                if not namespaces:
                    got = [r for r in got if r[4] != "namespace"]
                ids += [i] * len(got)
                rows += got
                if len(rows) > 50_000:
                    yield close(batch.column(0).type, ids, rows)
                    ids, rows = [], []
            if rows:
                yield close(batch.column(0).type, ids, rows)
                ids, rows = [], []

    def close(id_type: pa.DataType, ids: list, rows: list) -> pa.RecordBatch:
        cols = list(zip(*rows))
        return pa.RecordBatch.from_arrays([pa.array(ids, id_type), *[pa.array(c, _ARROW[t]) for c, (_, t) in zip(cols, FIELDS)]], ["doc_id", *[n for n, _ in FIELDS]])

    return docs.select(F.col(id_col).alias("doc_id"), F.col(xml_col)).mapInArrow(run, f"doc_id {kind}, " + ", ".join(f"`{n}` {t}" for n, t in FIELDS))


def read_documents(spark, path: str) -> DataFrame:
    """doc_id (the file's URI) and xml (bytes) of XML files; a byte-order mark chooses UTF-8 or UTF-16."""
    return spark.read.format("binaryFile").load(path).select(F.col("path").alias("doc_id"), F.col("content").alias("xml"))
