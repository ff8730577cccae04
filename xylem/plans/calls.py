"""The function library: XPath 1.0 and XSLT's, and the row-local part of 2.0's."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from xylem.functions import scalars as S
from xylem.functions import temporal as T
from xylem.plans.lift import KEY, NODE, SCALAR, SEQUENCE, Frame, Unsupported, Val, choose, compile_, fresh, frame, gather, matches, node_set, numbers, sequence, texts, to_bool, to_num, to_str
from xylem.plans.xpath import XPathError

ANY = 99
ARITY = {
    "last": (0, 0), "position": (0, 0), "count": (1, 1), "id": (1, 1), "local-name": (0, 1), "namespace-uri": (0, 1), "name": (0, 1), "string": (0, 1),
    "concat": (2, ANY), "starts-with": (2, 2), "contains": (2, 2), "substring-before": (2, 2), "substring-after": (2, 2), "substring": (2, 3), "string-length": (0, 1),
    "normalize-space": (0, 1), "translate": (3, 3), "boolean": (1, 1), "not": (1, 1), "true": (0, 0), "false": (0, 0), "lang": (1, 1), "number": (0, 1), "sum": (1, 1),
    "floor": (1, 1), "ceiling": (1, 1), "round": (1, 1), "current": (0, 0), "key": (2, 2),
}
ARITY_2 = {
    "matches": (2, 3), "replace": (3, 4), "upper-case": (1, 1), "lower-case": (1, 1), "ends-with": (2, 2), "abs": (1, 1), "min": (1, 1), "max": (1, 1), "avg": (1, 1),
    "exists": (1, 1), "empty": (1, 1), "string-join": (2, 2), "tokenize": (2, 3), "distinct-values": (1, 1), "index-of": (2, 2),
}
PARTS = {f"{p}-from-{t}": (p, t) for t, ps in (("date", ("year", "month", "day")), ("dateTime", ("year", "month", "day", "hours", "minutes", "seconds")), ("time", ("hours", "minutes", "seconds"))) for p in ps}
ZONES = {f"timezone-from-{t}": t for t in ("date", "dateTime", "time")}
SPANS = {f"{p}-from-duration": p for p in ("years", "months", "days", "hours", "minutes", "seconds")}
NOW = {"current-date": "date", "current-dateTime": "dateTime", "current-time": "time"}
MAKE = {f"xs:{t}": t for t in ("date", "dateTime", "time", "dayTimeDuration", "yearMonthDuration")}
ARITY_2 |= {k: (1, 1) for k in (*PARTS, *ZONES, *SPANS, *MAKE)} | {k: (0, 0) for k in (*NOW, "implicit-timezone")}


#: Functions of XPath 2.0 that are refused, and why.
REFUSED = dict.fromkeys(("subsequence", "insert-before", "remove", "reverse", "unordered", "for-each"), "it returns a changed sequence of items, which plans don't carry") | dict.fromkeys(("duration", "adjust-date-to-timezone", "adjust-dateTime-to-timezone", "adjust-time-to-timezone"), "it needs parts of the date and time types that aren't kept") | dict.fromkeys(("data", "deep-equal", "trace", "resolve-uri"), "it isn't implemented")


def check(name: str, n: int, two: bool) -> None:
    known = ARITY.get(name) or (ARITY_2.get(name) if two else None)
    if not known and name in REFUSED:
        raise XPathError(f"{name}() is a function of XPath 2.0 that is refused: {REFUSED[name]}")
    if not known and name in ARITY_2:
        raise XPathError(f"{name}() needs the XPath 2.0 binding")
    if not known:
        raise XPathError(f"unknown function {name}()")
    if not known[0] <= n <= known[1]:
        raise XPathError(f"{name}() called with {n} arguments")


def literal(e: tuple, what: str) -> str:
    if e[0] != "str":
        raise Unsupported(f"{what} must be a literal")
    return e[1]


def first(v: Val, f: Frame, field: str, default: str = "") -> Column:
    """A field of the first node."""
    if v.kind == "one":
        col = F.coalesce(F.col(f"{v.prefix}{field}"), F.lit(default))
        return col if v.col is None else F.when(v.col, col).otherwise(default)
    if v.kind in SCALAR:
        raise XPathError("a node-set is needed")
    return gather(v, f, default, F.min_by(f"c_{field}", "c_pre"))


def call(name: str, args: list, f: Frame) -> Val:
    check(name, len(args), f.env.two)
    if name == "position":
        return Val("n", F.col("pos"))
    if name == "last":
        return Val("n", F.col("size"))
    if name in ("true", "false"):
        return Val("b", F.lit(name == "true"))
    if name == "current":
        return Val("one", prefix="cur_")
    return apply(name, args, [compile_(a, f) for a in args], f)


def apply(name: str, args: list, v: list[Val], f: Frame) -> Val:
    for i, x in enumerate(v):
        if x.kind == "if":
            return choose(x.col, *(apply(name, args, [*v[:i], y, *v[i + 1 :]], f) for y in x.name), f)
    here = v[0] if v else Val("one", prefix="c_")
    text = lambda i: to_str(v[i], f)
    num = lambda i: to_num(v[i], f)
    if name in NOW:
        if f.env.now is None:
            raise XPathError(f"{name}() needs the run's clock")
        return Val("t", T.write(F.lit(float(f.env.now)), NOW[name], F.lit("Z")), name=NOW[name])
    if name == "implicit-timezone":
        return Val("u", F.lit(f.env.implicit * 60.0), name="dayTimeDuration")
    if name in MAKE:
        kind = MAKE[name]
        return Val("u", T.duration(text(0), kind), name=kind) if kind.endswith("Duration") else Val("t", T.checked(text(0), kind), name=kind)
    if name in PARTS:
        return Val("n", T.part(T.checked(text(0), PARTS[name][1]), PARTS[name][1], PARTS[name][0]))
    if name in ZONES:
        off = T.offset(T.checked(text(0), ZONES[name]))
        return Val("qs", F.when(off.isNull(), F.array().cast("array<string>")).otherwise(F.array(T.write_duration(off * 60.0, "dayTimeDuration"))))
    if name in SPANS:
        kind = "yearMonthDuration" if SPANS[name] in ("years", "months") else "dayTimeDuration"
        if here.kind == "u" and here.name != kind:
            raise XPathError(f"{name}() needs an xs:{kind}")
        return Val("n", T.duration_part(here.col if here.kind == "u" else T.duration(text(0), kind), SPANS[name]))
    if name == "tokenize":
        return Val("qs", F.split(text(0), S.regex(literal(args[1], "a pattern"), literal(args[2], "flags") if len(v) > 2 else ""), -1))
    if name == "distinct-values":
        return Val("qs", F.array_distinct(texts(sequence(here, f))))
    if name == "index-of":
        items, want = texts(sequence(here, f)), text(1)
        return Val("qn", F.filter(F.transform(items, lambda x, i: F.when(x == want, (i + 1).cast("double"))), lambda x: x.isNotNull()))
    if here.kind in SEQUENCE and name in ("count", "exists", "empty", "sum", "min", "max", "avg", "string-join"):
        return over_sequence(name, here, v, f)
    if name in ("count", "exists", "empty"):
        if here.kind in SCALAR:
            if not f.env.two:
                raise XPathError("count() needs a node-set")
            n = F.lit(1.0)
        elif here.kind in ("one", "attr"):
            n = F.when(to_bool(here, f), 1.0).otherwise(0.0)
        else:
            n = gather(here, f, 0, F.count("*")).cast("double")
        return Val("n", n) if name == "count" else Val("b", n > 0 if name == "exists" else n == 0)
    if name == "sum":
        if here.kind in ("one", "attr"):
            return Val("n", F.when(to_bool(here, f), num(0)).otherwise(0.0))
        if here.kind in SCALAR:
            raise XPathError("sum() needs a node-set")
        # in document order, so that equal documents have equal sums
        items = F.transform(F.array_sort(F.collect_list(F.struct("c_pre", S.parse_number(F.col("c_value")).alias("x")))), lambda p: p["x"])
        return Val("n", gather(here, f, 0.0, F.aggregate(items, F.lit(0.0), lambda a, x: a + x)))
    if name in ("min", "max", "avg"):
        if here.kind in SCALAR | {"one", "attr"}:
            return Val("n", num(0))
        x = S.parse_number(F.col("c_value"))
        bad = F.max(F.isnan(x))
        return Val("n", gather(here, f, S.NAN, F.when(bad, S.nan()).otherwise({"min": F.min, "max": F.max, "avg": F.avg}[name](x))))
    if name == "local-name":
        return Val("s", first(here, f, "local") if here.kind != "attr" else attr_name(here))
    if name == "namespace-uri":
        return Val("s", first(here, f, "uri") if here.kind != "attr" else first(Val("ns", df=node_set(here, f), depth=f.depth), f, "uri"))
    if name == "name":
        if here.kind == "attr" and not here.name[0][1]:
            return Val("s", attr_name(here))
        if here.kind == "attr":  # the document's prefix, which needn't be the schema's
            here = Val("ns", df=node_set(here, f), depth=f.depth)
        prefix, local = first(here, f, "prefix"), first(here, f, "local")
        return Val("s", F.when(prefix == "", local).otherwise(F.concat(prefix, F.lit(":"), local)))
    if name == "string":
        return Val("s", to_str(here, f))
    if name == "number":
        return Val("n", to_num(here, f))
    if name == "string-length":
        return Val("n", F.length(to_str(here, f)).cast("double"))
    if name == "normalize-space":
        return Val("s", S.normalize_space(to_str(here, f)))
    if name == "concat":
        return Val("s", F.concat(*[text(i) for i in range(len(v))]))
    if name in ("starts-with", "contains", "ends-with"):
        return Val("b", {"starts-with": F.startswith, "contains": F.contains, "ends-with": F.endswith}[name](text(0), text(1)))
    if name == "substring-before":
        return Val("s", S.substring_before(text(0), text(1)))
    if name == "substring-after":
        return Val("s", S.substring_after(text(0), text(1)))
    if name == "substring":
        return Val("s", S.substring(text(0), num(1), num(2) if len(v) > 2 else None))
    if name == "translate":
        return Val("s", S.translate(text(0), text(1), text(2)))
    if name in ("boolean", "not"):
        b = to_bool(here, f)
        return Val("b", b if name == "boolean" else ~b)
    if name in ("floor", "ceiling", "round", "abs"):
        return Val("n", {"floor": S.floor, "ceiling": S.ceiling, "round": S.round_, "abs": F.abs}[name](num(0)))
    if name in ("upper-case", "lower-case"):
        return Val("s", (F.upper if name == "upper-case" else F.lower)(text(0)))
    if name == "matches":
        return Val("b", F.rlike(text(0), F.lit(S.regex(literal(args[1], "a pattern"), literal(args[2], "flags") if len(v) > 2 else ""))))
    if name == "replace":
        return Val("s", F.regexp_replace(text(0), F.lit(S.regex(literal(args[1], "a pattern"), literal(args[3], "flags") if len(v) > 3 else "")), text(2)))
    if name == "string-join":
        if here.kind in SCALAR | {"one", "attr"}:
            return Val("s", text(0))
        items = F.transform(F.array_sort(F.collect_list(F.struct("c_pre", "c_value"))), lambda p: p["c_value"])
        out = fresh("j")
        f.attach(node_set(here, f).groupBy(*KEY).agg(items.alias(out)))
        return Val("s", F.coalesce(F.array_join(F.col(out), text(1)) if args[1][0] != "str" else F.array_join(out, args[1][1]), F.lit("")))
    if name == "lang":
        lang = F.lower(F.coalesce(F.col("c_lang"), F.lit("")))
        want = F.lower(text(0))
        return Val("b", (lang == want) & (lang != "") | F.startswith(lang, F.concat(want, F.lit("-"))))
    if name == "id":
        return by_id(here, f)
    if name == "key":
        return by_key(literal(args[0], "a key's name"), v[1], f)
    raise Unsupported(f"{name}() is not supported")


def over_sequence(name: str, here: Val, v: list[Val], f: Frame) -> Val:
    n, x = F.size(here.col), numbers(here)
    if name == "string-join":
        return Val("s", F.concat_ws("", F.transform(texts(here), lambda t, i: F.when(i == 0, t).otherwise(F.concat(to_str(v[1], f), t)))))
    if name in ("exists", "empty"):
        return Val("b", n > 0 if name == "exists" else n == 0)
    if name == "count":
        return Val("n", n.cast("double"))
    total = F.aggregate(x, F.lit(0.0), lambda a, y: a + y)
    if name == "sum":
        return Val("n", total)
    bad = (n == 0) | F.exists(x, F.isnan)
    value = {"min": F.array_min(x), "max": F.array_max(x), "avg": total / F.when(n == 0, 1).otherwise(n)}[name]
    return Val("n", F.when(bad, S.nan()).otherwise(value))


def attr_name(v: Val) -> Column:
    return F.when(v.col.isNotNull(), v.name[0][2]).otherwise("")


def wanted(v: Val, f: Frame) -> "object":
    """(doc_id, it, w): the texts that a key() or id() asks for in each iteration."""
    if v.kind == "ns":
        return node_set(v, f).select(*KEY, F.col("c_value").alias("w"))
    there = to_bool(v, f) if v.kind in ("one", "attr") else F.lit(True)
    text = to_str(v, f)
    return f.rows(lambda df: df.filter(there).select(*KEY, text.alias("w")))


def joined(found, f: Frame) -> Val:
    carry = [c for c in f.base.columns if not c.startswith(("c_", "s_"))]
    rows = f.base.select(*[F.col(f"`{c}`") for c in carry]).join(found.dropDuplicates([*KEY, "c_pre"]), KEY)
    return Val("ns", df=rows, depth=f.depth)


def by_id(v: Val, f: Frame) -> Val:
    tokens = wanted(v, f).select(*KEY, F.explode(F.split(F.trim("w"), r"\s+")).alias("w"))
    ids = f.env.nodes.filter((F.col("kind") == "attribute") & (F.col("local") == "id") & (F.col("uri").isNull() | (F.col("uri") == "http://www.w3.org/XML/1998/namespace"))).select(F.col("doc_id").alias("i_doc"), F.col("value").alias("i_value"), F.col("parent").alias("i_parent"))
    at = tokens.join(ids, (F.col("doc_id") == F.col("i_doc")) & (F.col("w") == F.col("i_value"))).select(*KEY, "i_parent").distinct()
    return joined(at.join(f.env.table(F.col("kind") == "element"), (F.col("doc_id") == F.col("n_doc")) & (F.col("i_parent") == F.col("c_pre"))).drop("n_doc", "i_parent"), f)


def by_key(name: str, v: Val, f: Frame) -> Val:
    """An equality join with the key's index of (document, value); an undeclared key is an error."""
    env = f.env
    if name not in env.keys:
        raise XPathError(f"undeclared key {name}")
    if name not in env.built:
        parts = []
        for match, use in env.keys[name]:
            g = frame(matches(match, env), type(env)(env.nodes, env.namespaces, two=env.two))
            values = wanted(compile_(use, g), g)
            parts.append(values.join(g.df.select(*KEY, *[f"c_{c}" for c in NODE]), KEY).drop("it"))
        index = parts[0]
        for p in parts[1:]:
            index = index.unionByName(p)
        env.built[name] = index.withColumnRenamed("doc_id", "k_doc").withColumnRenamed("w", "k_value").dropDuplicates(["k_doc", "k_value", "c_pre"])
    found = wanted(v, f).join(env.built[name], (F.col("doc_id") == F.col("k_doc")) & (F.col("w") == F.col("k_value"))).drop("k_doc", "k_value", "w")
    return joined(found, f)
