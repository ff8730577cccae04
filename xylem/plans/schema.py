"""Rule schemas: XML to dataclasses, includes and abstractions expanded, every expression parsed and checked. Driver side."""

from __future__ import annotations

import os
import re
import xml.etree.ElementTree as ET
from copy import deepcopy
from dataclasses import dataclass, field

from xylem.plans import calls
from xylem.plans.xpath import XPathError, parse

NS = ("http://purl.oclc.org/dsdl/schematron", "http://www.ascc.net/xml/schematron")
BINDINGS = {"": 1, "xslt": 1, "xpath": 1, "xslt1": 1, "xslt2": 2, "xpath2": 2, "xslt3": 0, "xpath3": 0}
MAX_DEPTH = 64


class SchemaError(ValueError):
    pass


@dataclass
class Let:
    name: str
    value: str


@dataclass
class Assertion:
    kind: str
    test: str
    content: list
    id: str | None = None
    role: str | None = None
    flag: str | None = None
    see: str | None = None
    icon: str | None = None
    fpi: str | None = None
    subject: str | None = None
    diagnostics: list[str] = field(default_factory=list)
    properties: list[str] = field(default_factory=list)


@dataclass
class Rule:
    context: str | None
    children: list
    lets: list[Let]
    id: str | None = None
    role: str | None = None
    flag: str | None = None
    subject: str | None = None
    abstract: bool = False

    @property
    def assertions(self) -> list[Assertion]:
        return [c for c in self.children if isinstance(c, Assertion)]


@dataclass
class Pattern:
    id: str | None
    name: str | None
    rules: list[Rule]
    lets: list[Let]
    documents: str | None = None


@dataclass
class Phase:
    id: str
    active: list[str]
    lets: list[Let]


@dataclass
class Key:
    name: str
    match: str
    use: str


@dataclass
class Schema:
    title: str | None
    id: str | None
    version: str | None
    binding: int
    default_phase: str | None
    namespaces: dict[str, str]
    lets: list[Let]
    phases: dict[str, Phase]
    patterns: list[Pattern]
    keys: list[Key]
    diagnostics: dict[str, list]
    properties: dict[str, tuple]
    trees: dict[str, tuple] = field(default_factory=dict)


class FileResolver:
    """Local files; network addresses are refused."""

    def resolve(self, href: str, base: str | None) -> tuple[str, str]:
        if re.match(r"https?://", href):
            raise SchemaError(f"network address refused: {href}")
        path = href.removeprefix("file://")
        if base and not os.path.isabs(path):
            path = os.path.join(os.path.dirname(base.removeprefix("file://")), path)
        with open(path, encoding="utf-8") as f:
            return f.read(), path


class MemoryResolver:
    def __init__(self, files: dict[str, str]) -> None:
        self.files = files

    def resolve(self, href: str, base: str | None) -> tuple[str, str]:
        if href not in self.files:
            raise SchemaError(f"nothing at {href}")
        return self.files[href], href


def local(e: ET.Element) -> str | None:
    """The local name of an element of the schema language, else None."""
    if not isinstance(e.tag, str):
        return None
    uri, _, name = e.tag[1:].rpartition("}") if e.tag[0] == "{" else ("", "", e.tag)
    return name if uri in NS else None


def need(e: ET.Element, name: str) -> str:
    if e.get(name) is None:
        raise SchemaError(f"{local(e)} needs the attribute {name}")
    return e.get(name)


def include(e: ET.Element, resolver, base: str | None, trail: tuple) -> None:
    """Puts included elements, and the children that an extends with href names, in place."""
    if len(trail) > MAX_DEPTH:
        raise SchemaError("includes nest too deeply")
    out = []
    for child in list(e):
        name = local(child)
        if name == "include" or (name == "extends" and child.get("href")):
            href, _, fragment = need(child, "href").partition("#")
            text, where = resolver.resolve(href, base) if href else (None, base)
            if (where, fragment) in trail:
                raise SchemaError(f"include cycle at {href}#{fragment}")
            root = ET.fromstring(text) if text is not None else None
            if root is None:
                raise SchemaError("an include needs a document")
            if fragment:
                root = next((x for x in root.iter() if x.get("id") == fragment or x.get("{http://www.w3.org/XML/1998/namespace}id") == fragment), None)
                if root is None:
                    raise SchemaError(f"no fragment {fragment} in {href}")
            holder = ET.Element("holder")
            holder.extend([root] if name == "include" else list(root))
            include(holder, resolver, where, (*trail, (where, fragment)))
            out += list(holder)
        else:
            include(child, resolver, base, trail)
            out.append(child)
    for child in list(e):
        e.remove(child)
    e.extend(out)


def content(e: ET.Element) -> list:
    """("text", s), ("value-of", select), ("name", path) and, for emph, span and dir, what they hold."""
    out = [("text", e.text)] if e.text else []
    for child in e:
        name = local(child)
        if name == "value-of":
            out.append(("value-of", need(child, "select")))
        elif name == "name":
            out.append(("name", child.get("path") or "."))
        else:
            out += content(child)
        if child.tail:
            out.append(("text", child.tail))
    return out


def quoted(text: str) -> str:
    """The text as an expression."""
    if "'" not in text:
        return f"'{text}'"
    if '"' not in text:
        return f'"{text}"'
    return "concat(%s, '')" % ", \"'\", ".join(f"'{part}'" for part in text.split("'"))


def lets(e: ET.Element) -> list[Let]:
    out = []
    for c in e:
        if local(c) == "let":
            value = c.get("value")
            if value is None:
                value = quoted("".join(c.itertext()))
            out.append(Let(need(c, "name"), value))
    return out


def assertion(e: ET.Element) -> Assertion:
    get = e.get
    return Assertion(local(e), need(e, "test"), content(e), get("id"), get("role"), get("flag"), get("see"), get("icon"), get("fpi"), get("subject"), (get("diagnostics") or "").split(), (get("properties") or "").split())


def rule(e: ET.Element) -> Rule:
    children = []
    for c in e:
        name = local(c)
        if name in ("assert", "report"):
            children.append(assertion(c))
        elif name == "extends":
            children.append(need(c, "rule"))
        elif name not in (None, "let", "p", "title"):
            raise SchemaError(f"{name} is not allowed in a rule")
    abstract = e.get("abstract") == "true"
    if abstract and (e.get("context") or not e.get("id")):
        raise SchemaError("an abstract rule has an id and no context")
    return Rule(None if abstract else need(e, "context"), children, lets(e), e.get("id"), e.get("role"), e.get("flag"), e.get("subject"), abstract)


def spread(r: Rule, named: dict[str, Rule], trail: tuple = ()) -> tuple[list, list]:
    """A rule's children and lets with those of the rules it extends in place."""
    if len(trail) > MAX_DEPTH:
        raise SchemaError("rules extend too deeply")
    children, own = [], []
    for c in r.children:
        if isinstance(c, str):
            if c not in named or c in trail:
                raise SchemaError(f"rule {c} extends itself" if c in trail else f"no abstract rule {c} in this pattern")
            more, inner = spread(named[c], named, (*trail, c))
            children += more
            own += inner
        else:
            children.append(c)
    return children, own + r.lets


def instantiate(e: ET.Element, template: ET.Element) -> ET.Element:
    """An is-a pattern: the template with $names replaced in attributes, in one pass, longest name first."""
    params = {c.get("name"): c.get("value") for c in e if local(c) == "param"}
    names = sorted(params, key=len, reverse=True)
    rx = re.compile("|".join(rf"\${re.escape(n)}(?![\w.-])" for n in names)) if names else None
    out = deepcopy(template)
    out.attrib.pop("abstract", None)
    out.attrib.pop("id", None)
    if e.get("id"):
        out.set("id", e.get("id"))
    if rx:
        for x in out.iter():
            for k, v in x.attrib.items():
                x.set(k, rx.sub(lambda m: params[m[0][1:]], v))
    return out


def parse_schema(source: str | bytes, resolver=None, base: str | None = None) -> Schema:
    root = ET.fromstring(source, ET.XMLParser(target=ET.TreeBuilder(insert_comments=False)))
    if local(root) != "schema":
        raise SchemaError("not a schema")
    include(root, resolver or FileResolver(), base, ())
    binding = (root.get("queryBinding") or "").lower()
    if not BINDINGS.get(binding):
        raise SchemaError(f"query binding {binding} is not supported")
    templates = {e.get("id"): e for e in root if local(e) == "pattern" and e.get("abstract") == "true"}
    namespaces, phases, patterns, keys, diagnostics, properties = {}, {}, [], [], {}, {}
    title = None
    for e in root:
        name = local(e)
        if name == "ns":
            namespaces[need(e, "prefix")] = need(e, "uri")
        elif name == "title":
            title = " ".join("".join(e.itertext()).split())
        elif name == "phase":
            phases[need(e, "id")] = Phase(e.get("id"), [need(a, "pattern") for a in e if local(a) == "active"], lets(e))
        elif name == "key":
            keys.append(Key(need(e, "name"), need(e, "match"), need(e, "use")))
        elif name == "diagnostics":
            diagnostics |= {need(d, "id"): content(d) for d in e if local(d) == "diagnostic"}
        elif name == "properties":
            properties |= {need(d, "id"): (d.get("role"), d.get("scheme"), content(d)) for d in e if local(d) == "property"}
        elif name == "pattern" and e.get("abstract") != "true":
            if e.get("is-a"):
                if e.get("is-a") not in templates:
                    raise SchemaError(f"no abstract pattern {e.get('is-a')}")
                e = instantiate(e, templates[e.get("is-a")])
            rules = [rule(r) for r in e if local(r) == "rule"]
            named = {r.id: r for r in rules if r.abstract}
            full = []
            for r in rules:
                children, own = spread(r, named, (r.id,) if r.abstract else ())
                if not r.abstract:
                    full.append(Rule(r.context, children, own, r.id, r.role, r.flag, r.subject))
            head = next((" ".join("".join(t.itertext()).split()) for t in e if local(t) == "title"), None)
            patterns.append(Pattern(e.get("id"), e.get("name") or head, full, lets(e), e.get("documents")))
        elif name not in (None, "pattern", "let", "p", "include"):
            raise SchemaError(f"{name} is not allowed in a schema")
    if not patterns:
        raise SchemaError("a schema needs a pattern")
    s = Schema(title, root.get("id"), root.get("schemaVersion"), BINDINGS[binding], root.get("defaultPhase"), namespaces, lets(root), phases, patterns, keys, diagnostics, properties)
    check(s)
    return s


def expressions(s: Schema):
    """(source, variables in scope) of every expression."""
    names = {x.name for x in s.lets}
    for p in s.phases.values():
        names |= {x.name for x in p.lets}
    yield from ((x.value, names) for x in s.lets)
    for p in s.phases.values():
        yield from ((x.value, names) for x in p.lets)
    for k in s.keys:
        yield k.match, set()
        yield k.use, set()
    every = set(names)
    for p in s.patterns:
        own = names | {x.name for x in p.lets}
        yield from ((x.value, own) for x in p.lets)
        for r in p.rules:
            here = own | {x.name for x in r.lets}
            every |= here
            yield r.context, own
            yield from ((x.value, here) for x in r.lets)
            if r.subject:
                yield r.subject, here
            for a in r.assertions:
                yield a.test, here
                if a.subject:
                    yield a.subject, here
                yield from ((v, here) for k, v in a.content if k != "text")
    for body in [*s.diagnostics.values(), *(c for _, _, c in s.properties.values())]:
        yield from ((v, every) for k, v in body if k != "text")


def check(s: Schema) -> None:
    """Parses every expression once; functions, arities, prefixes, variables and references must be known."""
    for source, scope in expressions(s):
        try:
            if source not in s.trees:
                s.trees[source] = parse(source)
            walk(s.trees[source], s, scope)
        except XPathError as e:
            raise SchemaError(f"{e} in {source!r}") from None
    if len({k.name for k in s.keys}) < len(s.keys):
        raise SchemaError("two keys have one name")
    ids = {p.id for p in s.patterns if p.id}
    for p in s.phases.values():
        for a in p.active:
            if a not in ids:
                raise SchemaError(f"phase {p.id} names no pattern {a}")
    if s.default_phase and s.default_phase not in s.phases and s.default_phase != "#ALL":
        raise SchemaError(f"no default phase {s.default_phase}")
    for p in s.patterns:
        for r in p.rules:
            for a in r.assertions:
                for kind, names, known in (("diagnostic", a.diagnostics, s.diagnostics), ("property", a.properties, s.properties)):
                    for n in names:
                        if n not in known:
                            raise SchemaError(f"no {kind} {n}")


def walk(e, s: Schema, scope: set[str]) -> None:
    if isinstance(e, list):
        for x in e:
            walk(x, s, scope)
        return
    if not isinstance(e, tuple) or not e:
        return
    if e[0] == "call":
        calls.check(e[1], len(e[2]), s.binding == 2)
    elif e[0] == "var" and e[1] not in scope:
        raise XPathError(f"unbound variable ${e[1]}")
    elif e[0] in ("name", "in") and len(e) in (2, 3) and isinstance(e[1], str) and e[1] != "xml" and e[1] not in s.namespaces:
        raise XPathError(f"undeclared prefix {e[1]}")
    if e[0] in ("for", "some", "every"):
        for name, source in e[1]:
            walk(source, s, scope)
            scope = scope | {name}
        walk(e[2], s, scope)
        return
    for x in e[1:]:
        walk(x, s, scope)
