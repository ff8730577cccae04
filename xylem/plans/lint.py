"""Lints: what a schema says that can't be meant. No document is needed."""

from __future__ import annotations

from collections import Counter

from xylem.plans.schema import Schema, expressions


def lint(s: Schema) -> list[tuple[str, str]]:
    """(kind, message), by pattern and rule, then for the schema as a whole."""
    out: list[tuple[str, str]] = []
    add = lambda kind, text: out.append((kind, text))
    for n, p in enumerate(s.patterns, 1):
        name = p.id or f"pattern {n}"
        if not p.rules:
            add("pattern-with-no-rules", f"{name} has no rules")
        for i, r in enumerate(p.rules):
            same = next((k for k in range(i) if p.rules[k].context == r.context), None)
            if same is not None:
                add("duplicate-rule-context", f"{name}: rule {i + 1} repeats the context {r.context!r} of rule {same + 1}")
            elif (by := next((k for k in range(i) if covers(s.trees[p.rules[k].context], s.trees[r.context])), None)) is not None:
                add("unreachable-rule", f"{name}: rule {by + 1} takes every node of rule {i + 1} ({r.context!r})")
            if not r.assertions:
                add("rule-with-no-assertions", f"{name}: rule {r.context!r} asserts nothing")
            for (kind, test), k in Counter((a.kind, a.test) for a in r.assertions).items():
                if k > 1:
                    add("duplicate-assertion-test", f"{name}: rule {r.context!r} has {kind} {test!r} {k} times")
            for a in r.assertions:
                if not any(k != "text" or v.strip() for k, v in a.content):
                    add("empty-message", f"{name}: {a.kind} {a.test!r} says nothing")
                if constant(s.trees[a.test]):
                    add("constant-test", f"{name}: {a.kind} {a.test!r} has the same result everywhere")
            if s.namespaces and not any(True for _ in prefixed(s.trees[r.context])) and any(True for _ in plain(s.trees[r.context])):
                add("unprefixed-name", f"{name}: {r.context!r} names elements of no namespace")
    if s.phases:
        used = {a for ph in s.phases.values() for a in ph.active}
        for n, p in enumerate(s.patterns, 1):
            if p.id not in used:
                add("pattern-in-no-phase", f"{p.id or f'pattern {n}'} is in no phase")
        for ph in s.phases.values():
            if not ph.active:
                add("phase-with-no-patterns", f"phase {ph.id} has no patterns")
    seen = Counter(v for source, _ in expressions(s) for v in variables(s.trees[source]))
    lets = [*s.lets, *(x for ph in s.phases.values() for x in ph.lets), *(x for p in s.patterns for x in [*p.lets, *(y for r in p.rules for y in r.lets)])]
    for let in lets:
        if not seen[let.name]:
            add("unreferenced-variable", f"${let.name} is never used")
    assertions = [a for p in s.patterns for r in p.rules for a in r.assertions]
    for kind, known, used in (("diagnostic", s.diagnostics, {d for a in assertions for d in a.diagnostics}), ("property", s.properties, {x for a in assertions for x in a.properties})):
        for k in known:
            if k not in used:
                add(f"unreferenced-{kind}", f"{kind} {k} is never referred to")
    keys = {name for source, _ in expressions(s) for name in key_names(s.trees[source])}
    for k in s.keys:
        if k.name not in keys and None not in keys:
            add("unreferenced-key", f"key {k.name} is never looked up")
    return out


def walk(e):
    if isinstance(e, (tuple, list)):
        if isinstance(e, tuple) and e and isinstance(e[0], str):
            yield e
        for x in e:
            yield from walk(x)


def variables(e):
    return (x[1] for x in walk(e) if x[0] == "var" and len(x) == 2)


def key_names(e):
    """Names of the keys looked up; None where a name isn't a literal."""
    return (x[2][0][1] if x[2] and x[2][0][0] == "str" else None for x in walk(e) if x[0] == "call" and x[1] == "key")


def prefixed(e):
    return (x for x in walk(e) if x[0] in ("name", "in") and len(x) in (2, 3) and x[1])


def plain(e):
    return (x for x in walk(e) if x[0] in ("child", "descendant") and len(x) == 3 and x[1][0] == "name" and x[1][1] is None)


def constant(e) -> bool:
    """Whether nothing in the expression depends on a document."""
    return not any(x[0] in ("path", "var") or (x[0] == "call" and x[1] not in ("true", "false", "not", "boolean", "concat", "contains", "starts-with")) for x in walk(e))


def covers(a, b) -> bool:
    """Whether the pattern a surely matches every node that b matches: a's steps without predicates end b's steps."""
    if a[0] == "union":
        return any(covers(x, b) for x in a[1:])
    if b[0] == "union":
        return all(covers(a, x) for x in b[1:])
    if a[0] != "path" or b[0] != "path" or a[1] is not None or not a[2] or len(a[2]) > len(b[2]):
        return False
    for (ax, at, ap), (bx, bt, _) in zip(a[2][::-1], b[2][::-1]):
        kind = ("attribute", "child")[ax != "attribute"] if ax in ("attribute", "child", "descendant") else None
        other = ("attribute", "child")[bx != "attribute"] if bx in ("attribute", "child", "descendant") else None
        wide = at == bt or at == ("kind", "node", None) or (at == ("any",) and bt[0] in ("name", "in", "any"))
        if ap or kind is None or kind != other or not wide:
            return False
    return True
