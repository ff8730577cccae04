"""XML documents to trees in memory, one at a time, with the numbering, locations and errors of shred.py's node table.

Only nodes of the tree are objects; attributes and namespaces become some where an expression asks for them as nodes."""

from __future__ import annotations

import xml.parsers.expat as expat
from bisect import bisect_right

from xylem.sources.shred import MAX_DEPTH, XML_NS, DocumentError

#: Names of attributes that have no colon and aren't xmlns, as far as met.
_plain: set[str] = set()
_KEEP = 10_000


class Node:
    """text: of a text, comment, instruction, attribute or namespace its value; of other nodes the document's texts, theirs being
    t0 to t1. more: (prefix, local, uri, value) of the attributes where one has a namespace. spaces: prefixes in scope."""

    __slots__ = ("pre", "end", "up", "kind", "prefix", "local", "uri", "text", "t0", "t1", "ix", "attrs", "more", "kids", "lang", "spaces", "sib")

    def __init__(self, pre: int, up: Node | None, kind: str, prefix: str | None, local: str | None, uri: str | None, text, lang: str | None, spaces: dict | None = None) -> None:
        self.pre = self.end = pre
        self.up = up
        self.kind = kind
        self.prefix = prefix
        self.local = local
        self.uri = uri
        self.text = text
        self.lang = lang
        self.spaces = spaces
        self.t0 = self.t1 = 0
        self.ix = self.attrs = self.more = self.kids = self.sib = None


class Tree:
    """root, and all nodes but attributes and namespaces in document order; what is found once a document is kept here."""

    def __init__(self, root: Node, nodes: list[Node]) -> None:
        self.root, self.nodes = root, nodes
        self.named: dict[str, list[Node]] | None = None
        self.pres: list[int] | None = None
        self.keys: dict[str, dict[str, list[Node]]] = {}
        self.ids: dict[str, list[Node]] | None = None

    def elements(self, local: str) -> list[Node]:
        if self.named is None:
            self.named = {}
            for n in self.nodes:
                if n.kind == "element":
                    self.named.setdefault(n.local, []).append(n)
        return self.named.get(local, [])

    def drop(self) -> None:
        """Nodes no longer hold each other, so that a large document's memory is free before the next is read."""
        for n in self.nodes:
            n.kids = None

    def after(self, pre: int) -> int:
        """How many nodes are at pre or before."""
        if self.pres is None:
            self.pres = [n.pre for n in self.nodes]
        return bisect_right(self.pres, pre)

    def with_id(self, value: str) -> list[Node]:
        if self.ids is None:
            self.ids = {}
            for n in self.nodes:
                for key in ("id", "{%s}id" % XML_NS) if n.attrs else ():
                    if key in n.attrs:
                        self.ids.setdefault(n.attrs[key], []).append(n)
        return self.ids.get(value, [])


class _Builder:
    def __init__(self) -> None:
        self.texts: list[str] = []
        self.run: list[str] = []
        root = Node(0, None, "root", None, None, None, self.texts, None, {"xml": XML_NS})
        self.n, self.open, self.nodes = 1, [root], [root]
        p = self.p = expat.ParserCreate()
        p.buffer_text = True
        p.StartElementHandler, p.EndElementHandler, p.CharacterDataHandler = self.start, self.finish, self.run.append
        p.CommentHandler, p.ProcessingInstructionHandler, p.DefaultHandler = self.comment, self.pi, self.other

    def fail(self, message: str) -> None:
        raise DocumentError(message, self.p.CurrentLineNumber, self.p.CurrentColumnNumber + 1)

    def other(self, data: str) -> None:
        if data.startswith("&") and data.endswith(";"):
            self.fail(f"unknown entity {data}")

    def add(self, n: Node) -> Node:
        kids = n.up.kids
        if kids is None:
            n.up.kids = [n]
            n.ix = 0
        else:
            n.ix = len(kids)
            kids.append(n)
        self.nodes.append(n)
        return n

    def leaf(self, kind: str, local: str | None, value: str) -> None:
        top = self.open[-1]
        self.add(Node(self.n, top, kind, None, local, None, value, top.lang))
        self.n += 1

    def flush(self) -> None:
        value = "".join(self.run)
        self.run.clear()
        if len(self.open) == 1:
            if value.strip(" \t\r\n"):
                self.fail("text outside the document element")
            return
        self.leaf("text", None, value)
        self.texts.append(value)

    def name(self, raw: str, scope: dict, attribute: bool) -> tuple[str | None, str, str | None]:
        prefix, colon, local = raw.partition(":")
        if not colon:
            return None, raw, None if attribute else scope.get("", None)
        if prefix not in scope:
            self.fail(f"undeclared prefix {prefix}")
        return prefix, local, scope[prefix]

    def start(self, raw: str, attrs: dict[str, str]) -> None:
        if self.run:
            self.flush()
        if len(self.open) > MAX_DEPTH:
            self.fail("nested too deeply")
        top = self.open[-1]
        scope, lang, more, size = top.spaces, top.lang, None, len(attrs)
        if ":" not in raw and (attrs.keys() <= _plain or self.learn(attrs)):
            prefix, local, uri = None, raw, scope.get("")
        else:
            declared = {k[6:] if k != "xmlns" else "": v for k, v in attrs.items() if k == "xmlns" or k.startswith("xmlns:")}
            if declared:
                scope = {k: v for k, v in (scope | declared).items() if v or k}
                if not scope.get("", "x"):
                    scope.pop("")
            prefix, local, uri = self.name(raw, scope, False)
            more = []
            for k, v in attrs.items():
                if k != "xmlns" and not k.startswith("xmlns:"):
                    p, name, u = self.name(k, scope, True)
                    if u == XML_NS and name == "lang":
                        lang = v
                    more.append((p, name, u, v))
            attrs, size = {"{%s}%s" % (u, name) if u else name: v for _, name, u, v in more}, len(more)
        texts, kids = self.texts, top.kids
        here = Node(self.n, top, "element", prefix, local, uri, texts, lang, scope)
        here.attrs, here.more, here.t0 = attrs, more, len(texts)
        if kids is None:
            top.kids, here.ix = [here], 0
        else:
            here.ix = len(kids)
            kids.append(here)
        self.nodes.append(here)
        self.n += 1 + len(scope) + size
        self.open.append(here)

    def learn(self, attrs: dict[str, str]) -> bool:
        if any(":" in k or k == "xmlns" for k in attrs):
            return False
        if len(_plain) > _KEEP:
            _plain.clear()
        _plain.update(attrs)
        return True

    def finish(self, raw: str) -> None:
        if self.run:
            self.flush()
        top = self.open.pop()
        top.end, top.t1 = self.n - 1, len(self.texts)

    def comment(self, data: str) -> None:
        if self.run:
            self.flush()
        self.leaf("comment", None, data)

    def pi(self, target: str, data: str) -> None:
        if self.run:
            self.flush()
        self.leaf("processing-instruction", target, data)


def read(xml) -> Tree:
    """The tree of a document in bytes, or a DocumentError. Entities that a document declares are errors where used."""
    b = _Builder()
    try:
        b.p.Parse(xml, True)
        if b.run:
            b.flush()
    except expat.ExpatError as e:
        raise DocumentError(expat.ErrorString(e.code), e.lineno, e.offset + 1) from None
    finally:
        b.p = None  # the parser's handlers hold the builder
    root = b.nodes[0]
    root.end, root.t1 = b.n - 1, len(b.texts)
    return Tree(root, b.nodes)


def value(n: Node) -> str:
    t = n.text
    if t.__class__ is str:
        return t
    return "" if n.t0 == n.t1 else "".join(t[n.t0 : n.t1])


def attributes(n: Node) -> list[Node]:
    if not n.attrs:
        return []
    at = n.pre + 1 + len(n.spaces)
    every = n.more if n.more is not None else [(None, k, None, v) for k, v in n.attrs.items()]
    return [Node(at + i, n, "attribute", p, name, u, v, n.lang) for i, (p, name, u, v) in enumerate(every)]


def namespaces(n: Node) -> list[Node]:
    if n.kind != "element":
        return []
    return [Node(n.pre + 1 + i, n, "namespace", None, p, None, n.spaces[p], n.lang) for i, p in enumerate(sorted(n.spaces))]


def place(n: Node) -> str:
    """A node's location, which finds it again as an XPath."""
    kind = n.kind
    if kind == "root":
        return "/"
    up = "" if n.up.kind == "root" else place(n.up)
    if kind == "attribute":
        return f"{up}/@{n.local}" if not n.uri else f"{up}/@*[local-name()='{n.local}' and namespace-uri()='{n.uri}']"
    if kind == "namespace":
        return f"{up}/namespace::{n.local or '*'}"
    if n.sib is None:
        counts: dict[tuple, int] = {}
        for k in n.up.kids:
            key = (k.kind, k.uri, k.local) if k.kind == "element" else (k.kind,)
            k.sib = counts[key] = counts.get(key, 0) + 1
    if kind == "element":
        step = n.local if not n.uri else f"*[local-name()='{n.local}' and namespace-uri()='{n.uri}']"
    else:
        step = f"{kind}()"
    return f"{up}/{step}[{n.sib}]"
