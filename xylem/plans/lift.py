"""XPath to DataFrames by loop lifting.

An expression is compiled for all iterations of a frame at once: a DataFrame with one row an iteration, keyed by (doc_id, it),
and its context node in columns c_*. Scalars become columns of the frame. Node-sets become DataFrames of (doc_id, it, node);
axis steps are equality or range joins within a document, existence tests and counts are aggregates joined back, positional
predicates are windows. A predicate opens a frame of its own, whose iterations are the candidate nodes.
"""

from __future__ import annotations

import functools
import itertools
from dataclasses import dataclass, field, replace

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from xylem.functions import scalars as S
from xylem.functions import temporal as T
from xylem.plans.xpath import REVERSE, XPathError, numeric, uses

NODE = ["pre", "end", "parent", "kind", "prefix", "local", "uri", "value", "child_ix", "attrs", "loc", "lang"]
KEY = ["doc_id", "it"]
SCALAR = {"b", "n", "s"}
SEQUENCE = {"qn", "qs"}
TEMPORAL = {"t", "u"}
_count = itertools.count()


def fresh(stem: str = "x") -> str:
    return f"_{stem}{next(_count)}"


class Unsupported(XPathError):
    pass


@dataclass
class Val:
    """kind: b, n, s (column), if (one of the two values in name, by a boolean column), ns (df), one (a node in columns prefix + NODE, where present), attr (an attribute's value or null),
    qn and qs (sequences: columns of arrays of numbers and of texts), t (a date or time: its text) and u (a duration: seconds
    or months), both with the type's local name in name.

    depth: for ns, how much of a deeper frame's `it` keys it; -1: the document alone."""

    kind: str
    col: Column | None = None
    df: DataFrame | None = None
    prefix: str = ""
    depth: int = 0
    name: tuple | None = None


@dataclass
class Frame:
    df: DataFrame
    depth: int
    env: "Env"
    vars: dict[str, Val] = field(default_factory=dict)
    base: DataFrame | None = None
    attached: int = 0

    def __post_init__(self) -> None:
        self.base = self.df

    def rows(self, use):
        """use(rows) for the iterations without what has been attached since; with it, where a column of that is needed.

        Node-sets start from these rows, so that a plan grows by what each expression adds, and never holds itself."""
        try:
            return use(self.base)
        except AnalysisException:
            return use(self.df)

    def attach(self, other: DataFrame) -> None:
        self.attached += 1
        self.df = self.df.join(other, KEY, "left")

    def column(self, col: Column, stem: str = "v") -> Column:
        name = fresh(stem)
        self.df = self.df.withColumn(name, col)
        return F.col(name)


@dataclass
class Env:
    """nodes: the node table; namespaces: prefix to URI; keys: name to (match, use) trees; two: XPath 2.0's functions are known."""

    nodes: DataFrame
    namespaces: dict[str, str] = field(default_factory=dict)
    keys: dict[str, list] = field(default_factory=dict)
    two: bool = False
    now: float | None = None
    implicit: int = 0
    built: dict[str, DataFrame] = field(default_factory=dict)

    def table(self, cond: Column | None = None) -> DataFrame:
        n = self.nodes if cond is None else self.nodes.filter(cond)
        return n.select(F.col("doc_id").alias("n_doc"), *[F.col(f"`{c}`").alias(f"c_{c}") for c in NODE])


def uri_of(env: Env, prefix: str) -> str:
    if prefix == "xml":
        return "http://www.w3.org/XML/1998/namespace"
    if prefix not in env.namespaces:
        raise XPathError(f"undeclared prefix {prefix}")
    return env.namespaces[prefix]


def test_column(env: Env, axis: str, test: tuple, at: str = "") -> Column:
    col = lambda c: F.col(f"{at}{c}" if at else f"`{c}`")
    principal = {"attribute": "attribute", "namespace": "namespace"}.get(axis, "element")
    if test[0] == "kind":
        if test[1] == "node":
            return F.lit(True)
        cond = col("kind") == test[1]
        return cond & (col("local") == test[2]) if test[2] is not None else cond
    cond = col("kind") == principal
    if test[0] == "any":
        return cond
    if test[0] == "in":
        return cond & col("uri").eqNullSafe(F.lit(uri_of(env, test[1])))
    cond = cond & (col("local") == test[2])
    if axis == "namespace":
        return cond
    return cond & (col("uri").eqNullSafe(F.lit(uri_of(env, test[1]))) if test[1] else col("uri").isNull())


def axis_join(axis: str) -> Column:
    c, s = (lambda x: F.col(f"c_{x}")), (lambda x: F.col(f"s_{x}"))
    tree = ~c("kind").isin("attribute", "namespace")
    return {
        "child": (c("parent") == s("pre")) & c("child_ix").isNotNull(),
        "attribute": (c("parent") == s("pre")) & (c("kind") == "attribute"),
        "namespace": (c("parent") == s("pre")) & (c("kind") == "namespace"),
        "parent": c("pre") == s("parent"),
        "ancestor": (c("pre") < s("pre")) & (c("end") >= s("pre")) & c("kind").isin("root", "element"),
        "ancestor-or-self": ((c("pre") < s("pre")) & (c("end") >= s("pre")) & c("kind").isin("root", "element")) | (c("pre") == s("pre")),
        "descendant": (c("pre") > s("pre")) & (c("pre") <= s("end")) & tree,
        "descendant-or-self": ((c("pre") > s("pre")) & (c("pre") <= s("end")) & tree) | (c("pre") == s("pre")),
        "following-sibling": (c("parent") == s("parent")) & (c("child_ix") > s("child_ix")),
        "preceding-sibling": (c("parent") == s("parent")) & (c("child_ix") < s("child_ix")),
        "following": (c("pre") > s("end")) & tree,
        "preceding": (c("end") < s("pre")) & tree,
    }[axis]


def take(f: Frame, prefix: str, present: Column | None = None) -> DataFrame:
    """The node in columns prefix + NODE of each iteration, as a node-set."""

    def use(df: DataFrame) -> DataFrame:
        carry = [c for c in df.columns if not c.startswith("c_") and not c.startswith("s_")]
        df = df if present is None else df.filter(present)
        return df.select(*[F.col(f"`{c}`") for c in carry], *[F.col(f"{prefix}{c}").alias(f"c_{c}") for c in NODE])

    return f.rows(use)


def step(df: DataFrame, one: bool, axis: str, test: tuple, preds: list, f: Frame) -> tuple[DataFrame, bool]:
    """Nodes that a step leads to from those of df. one: each iteration has at most one node (so none comes twice)."""
    env = f.env
    if axis == "self":
        out = df.filter(test_column(env, axis, test, "c_")).withColumn("s_pre", F.col("c_pre"))
    else:
        left = df.drop("s_pre", "s_end", "s_parent", "s_child_ix").withColumnsRenamed({f"c_{c}": f"s_{c}" for c in ("pre", "end", "parent", "child_ix")}).drop(*[f"c_{c}" for c in NODE])
        out = left.join(env.table(test_column(env, axis, test)), (F.col("doc_id") == F.col("n_doc")) & axis_join(axis)).drop("n_doc", "s_end", "s_parent", "s_child_ix")
    order = F.col("c_pre").desc() if axis in REVERSE else F.col("c_pre")
    for p in preds:
        out = predicate(out, Window.partitionBy(*KEY, "s_pre"), order, p, f)
    kept = one and axis in ("self", "parent")
    if not (one or axis in ("child", "attribute", "namespace", "self")):
        out = out.dropDuplicates([*KEY, "c_pre"])
    return out.drop("s_pre"), kept


def predicate(df: DataFrame, window, order: Column, p: tuple, f: Frame) -> DataFrame:
    counts = numeric(p) or p[0] == "var" or uses(p, {"position", "last"})
    df = df.drop("pos", "size")
    if counts:
        df = df.withColumn("pos", F.row_number().over(window.orderBy(order)).cast("double")).withColumn("size", F.count("*").over(window).cast("double"))
    else:
        df = df.withColumn("pos", F.lit(1.0)).withColumn("size", F.lit(1.0))
    columns = df.columns
    g = Frame(df.withColumn("it", F.concat("it", F.array("s_pre", "c_pre"))), f.depth + 2, f.env, f.vars)
    v = compile_(p, g)
    ok = F.abs(v.col - F.col("pos")) < 1e-9 if v.kind == "n" else to_bool(v, g)
    got = g.df.filter(ok).withColumn("it", F.slice("it", 1, f.depth))
    return got.select(*[F.col(f"`{c}`") for c in columns])


def node_set(v: Val, f: Frame) -> DataFrame:
    """A value that holds nodes as (doc_id, it, c_*) of this frame."""
    if v.kind == "one":
        return take(f, v.prefix, v.col)
    if v.kind == "attr":
        return step(node_set(v.name[1], f), True, "attribute", v.name[0], [], f)[0]
    if v.kind != "ns":
        raise XPathError("a node-set is needed")
    if v.depth == f.depth:
        return v.df
    carry = [c for c in f.base.columns if not c.startswith(("c_", "s_"))]
    here = f.base.select(*[F.col(f"`{c}`") for c in carry], *([F.slice("it", 1, v.depth).alias("o_it")] if v.depth >= 0 else []))
    there = v.df.select(F.col("doc_id").alias("o_doc"), F.col("it").alias("o_key"), *[f"c_{c}" for c in NODE])
    on = F.col("doc_id") == F.col("o_doc")
    if v.depth >= 0:
        on = on & (F.col("o_it") == F.col("o_key"))
    return here.join(there, on).drop("o_doc", "o_key", "o_it")


def gather(v: Val, f: Frame, default, agg: Column) -> Column:
    """An aggregate of a node-set as a column of the frame."""
    name = fresh("a")
    f.attach(node_set(v, f).groupBy(*KEY).agg(agg.alias(name)))
    return F.coalesce(F.col(name), F.lit(default))


def either(v: Val, use) -> Column:
    return F.when(v.col, use(v.name[0])).otherwise(use(v.name[1]))


def to_bool(v: Val, f: Frame) -> Column:
    if v.kind == "if":
        return either(v, lambda x: to_bool(x, f))
    if v.kind == "b":
        return v.col
    if v.kind == "n":
        return S.number_true(v.col)
    if v.kind == "s":
        return v.col != ""
    if v.kind == "attr":
        return v.col.isNotNull()
    if v.kind in TEMPORAL:
        return F.lit(True)
    if v.kind in SEQUENCE:
        only = item(v)
        return F.when(F.size(v.col) == 1, S.number_true(only) if v.kind == "qn" else only != "").otherwise(F.size(v.col) > 0)
    if v.kind == "one":
        return F.lit(True) if v.col is None else v.col
    return gather(v, f, False, F.max(F.lit(True)))


def to_str(v: Val, f: Frame) -> Column:
    if v.kind == "if":
        return either(v, lambda x: to_str(x, f))
    if v.kind == "s":
        return v.col
    if v.kind == "b":
        return F.when(v.col, "true").otherwise("false")
    if v.kind == "n":
        return S.format_number(v.col)
    if v.kind == "attr":
        return F.coalesce(v.col, F.lit(""))
    if v.kind in TEMPORAL:
        return v.col if v.kind == "t" else T.write_duration(v.col, v.name)
    if v.kind in SEQUENCE:
        return F.when(F.size(v.col) == 0, "").otherwise(item(v) if v.kind == "qs" else S.format_number(item(v)))
    if v.kind == "one":
        text = F.col(f"{v.prefix}value")
        return text if v.col is None else F.when(v.col, text).otherwise("")
    return gather(v, f, "", F.min_by("c_value", "c_pre"))


def item(v: Val) -> Column:
    """The first item, or an empty text or NaN."""
    return F.coalesce(F.try_element_at(v.col, F.lit(1)), F.lit(S.NAN if v.kind == "qn" else ""))


def sequence(v: Val, f: Frame) -> Val:
    """Any value as a sequence of numbers or texts, nodes in document order."""
    if v.kind in SEQUENCE:
        return v
    if v.kind == "if":
        one, two_ = (sequence(x, f) for x in v.name)
        if one.kind == two_.kind:
            return Val(one.kind, F.when(v.col, one.col).otherwise(two_.col))
        return Val("qs", F.when(v.col, texts(one)).otherwise(texts(two_)))
    if v.kind == "n":
        return Val("qn", F.array(v.col))
    if v.kind in SCALAR | TEMPORAL:
        return Val("qs", F.array(to_str(v, f)))
    if v.kind in ("one", "attr"):
        return Val("qs", F.when(to_bool(v, f), F.array(to_str(v, f))).otherwise(F.array().cast("array<string>")))
    name = fresh("q")
    items = F.transform(F.array_sort(F.collect_list(F.struct("c_pre", "c_value"))), lambda p: p["c_value"])
    f.attach(node_set(v, f).groupBy(*KEY).agg(items.alias(name)))
    return Val("qs", F.coalesce(F.col(name), F.array().cast("array<string>")))


def texts(v: Val) -> Column:
    return v.col if v.kind == "qs" else F.transform(v.col, S.format_number)


def numbers(v: Val) -> Column:
    return v.col if v.kind == "qn" else F.transform(v.col, S.parse_number)


def inside(v: Val, f: Frame, name: str, body: tuple, use) -> Column:
    """A function of array elements whose body is compiled with the element as a variable; it may not need joins."""
    was = f.df

    def each(x: Column) -> Column:
        out = use(compile_(body, replace_vars(f, {name: Val("n" if v.kind == "qn" else "s", x)})))
        if f.df is not was:
            raise Unsupported("a body over a sequence may not look at other nodes")
        return out

    return each


def replace_vars(f: Frame, more: dict[str, Val]) -> Frame:
    return Frame(f.df, f.depth, f.env, f.vars | more)


def to_num(v: Val, f: Frame) -> Column:
    if v.kind == "if":
        return either(v, lambda x: to_num(x, f))
    if v.kind == "n":
        return v.col
    if v.kind == "qn":
        return item(v)
    if v.kind in TEMPORAL:
        return S.nan()
    if v.kind == "b":
        return F.when(v.col, 1.0).otherwise(0.0)
    return S.parse_number(to_str(v, f))


def compile_(e: tuple, f: Frame) -> Val:
    kind = e[0]
    if kind == "num":
        return Val("n", F.lit(e[1]))
    if kind == "str":
        return Val("s", F.lit(e[1]))
    if kind == "var":
        if e[1] not in f.vars:
            raise XPathError(f"unbound variable ${e[1]}")
        return f.vars[e[1]]
    if kind == "neg":
        return Val("n", -to_num(compile_(e[1], f), f))
    if kind == "op":
        return operator(e[1], e[2], e[3], f)
    if kind == "union":
        parts = [node_set(compile_(x, f), f).select(*KEY, *[f"c_{c}" for c in NODE]) for x in e[1:]]
        return Val("ns", df=parts[0].unionByName(parts[1]).dropDuplicates([*KEY, "c_pre"]), depth=f.depth)
    if kind == "path":
        return path(e, f)
    if kind == "filter":
        base = compile_(e[1], f)
        if base.kind in SCALAR | SEQUENCE:
            base = sequence(base, f)
            for p in e[2]:
                if p[0] != "num":
                    raise Unsupported("items that aren't nodes are chosen by number")
                base = Val(base.kind, F.slice(base.col, int(p[1]), 1) if p[1] >= 1 and p[1] == int(p[1]) else F.slice(base.col, 1, 0))
            return base
        df = node_set(base, f)
        for p in e[2]:
            df = predicate(df.withColumn("s_pre", F.lit(-1)), Window.partitionBy(*KEY), F.col("c_pre"), p, f).drop("s_pre")
        return Val("ns", df=df, depth=f.depth)
    if kind == "call":
        from xylem.plans.calls import call

        return call(e[1], e[2], f)
    if kind in ("if", "some", "every", "castable", "cast", "seq", "range", "for", "instance", "treat"):
        return two(e, f)
    raise Unsupported(f"{kind} is not supported")


def two(e: tuple, f: Frame) -> Val:
    """What XPath 2.0 adds, where types are known by form."""
    kind = e[0]
    if not f.env.two:
        raise XPathError(f"{kind} needs the XPath 2.0 binding")
    if kind == "if":
        c, a, b = to_bool(compile_(e[1], f), f), compile_(e[2], f), compile_(e[3], f)
        return choose(c, a, b, f)
    if kind in ("some", "every"):
        return quantified(kind, e[1], e[2], f)
    if kind in ("castable", "cast"):
        v = compile_(e[1], f)
        text, some = to_str(v, f), to_bool(Val("b", F.lit(True)) if v.kind in SCALAR else v, f)
        ok = S.castable(text, e[2])
        if kind == "castable":
            return Val("b", F.when(some, ok).otherwise(F.lit(e[3] == "?")))
        bad = F.raise_error(F.concat(F.lit("cannot cast "), text, F.lit(f" as {e[2]}")))
        if e[2] in ("xs:double", "xs:float", "xs:decimal", "xs:integer", "xs:int", "xs:long", "xs:short", "xs:byte"):
            return Val("n", F.when(ok, F.trim(text).try_cast("double")).otherwise(bad.cast("double")))
        if e[2] == "xs:boolean":
            return Val("b", F.when(ok, F.trim(text).isin("true", "1")).otherwise(bad.cast("boolean")))
        if e[2] in ("xs:date", "xs:dateTime", "xs:time"):
            return Val("t", T.checked(text, e[2][3:]), name=e[2][3:])
        if e[2] in ("xs:dayTimeDuration", "xs:yearMonthDuration"):
            return Val("u", T.duration(text, e[2][3:]), name=e[2][3:])
        return Val("s", F.when(ok, text).otherwise(bad.cast("string")))
    if kind == "seq":
        if not e[1]:
            return Val("qs", F.array().cast("array<string>"))
        parts = [sequence(compile_(x, f), f) for x in e[1]]
        if all(p.kind == "qn" for p in parts):
            return Val("qn", F.concat(*[p.col for p in parts]))
        return Val("qs", F.concat(*[texts(p) for p in parts]))
    if kind == "range":
        a, b = (to_num(compile_(x, f), f) for x in e[1:])
        bad = F.isnan(a) | F.isnan(b) | (b - a >= 1_000_000)
        low, high = (F.when(bad | (a > b), 0.0).otherwise(x).cast("long") for x in (a, b))
        whole = F.when(bad, F.raise_error(F.lit("a range needs bounds, and at most 1000000 items")).cast("array<double>")).when(a > b, F.array().cast("array<double>"))
        return Val("qn", whole.otherwise(F.transform(F.sequence(low, high), lambda x: x.cast("double"))))
    if kind == "for":
        return loop(e[1], e[2], f)
    if kind in ("instance", "treat"):
        v = compile_(e[1], f)
        ok = instance(v, e[2], e[3], f)
        if kind == "instance":
            return Val("b", ok)
        bad = F.raise_error(F.lit(f"the value is no {e[2]}{e[3]}"))
        if v.kind == "ns":
            return Val("ns", df=node_set(v, f).join(f.df.filter(F.when(ok, True).otherwise(bad.cast("boolean"))).select(*KEY), KEY, "left_semi"), depth=f.depth)
        if v.col is None or v.kind in ("one", "attr"):
            return v
        return replace(v, col=F.when(ok, v.col).otherwise(bad))
    raise Unsupported(f"{kind} is not supported here")


NODE_TYPES = {"node()": None, "element()": "element", "attribute()": "attribute", "text()": "text", "comment()": "comment", "processing-instruction()": "processing-instruction", "document-node()": "root"}


def instance(v: Val, kind: str, mark: str, f: Frame) -> Column:
    """Whether a value has a sequence type, by its kind and its number of items."""
    if v.kind in SEQUENCE:
        n = F.size(v.col).cast("double")
    elif v.kind in ("one", "attr"):
        n = F.when(to_bool(v, f), 1.0).otherwise(0.0)
    elif v.kind == "ns":
        n = gather(v, f, 0, F.count("*")).cast("double")
    else:
        n = F.lit(1.0)
    many = {"": n == 1, "?": n <= 1, "+": n >= 1, "*": F.lit(True)}[mark]
    nodes_ = v.kind in ("one", "attr", "ns")
    if kind == "item()":
        return many
    if kind in NODE_TYPES:
        if not nodes_:
            return many & (n == 0)
        if NODE_TYPES[kind] is None:
            return many
        if v.kind == "attr":
            return many & ((n == 0) | F.lit(kind == "attribute()"))
        if v.kind == "one":
            return many & ((n == 0) | (F.col(f"{v.prefix}kind") == NODE_TYPES[kind]))
        return many & ~gather(v, f, False, F.max(F.col("c_kind") != NODE_TYPES[kind]))
    if nodes_:
        return many & (n == 0)
    own = {"b": {"boolean"}, "s": {"string"}, "qs": {"string"}, "n": {"double", "float", "decimal"}, "qn": {"double", "float", "decimal"}, "t": {v.name}, "u": {v.name, "duration"}}[v.kind] | {"anyAtomicType"}
    if kind[3:] in ("integer", "int", "long", "short", "byte") and v.kind in ("n", "qn"):
        return many & (F.forall(v.col, lambda x: x == F.floor(x)) if v.kind == "qn" else v.col == F.floor(v.col))
    return many & ((n == 0) | F.lit(kind[3:] in own))


def loop(binds: list, body: tuple, f: Frame) -> Val:
    """for: the body's values in the items' order."""
    (name, source), rest = binds[0], binds[1:]
    inner = ("for", rest, body) if rest else body
    v = compile_(source, f)
    if v.kind in SCALAR | SEQUENCE | {"if"}:
        v = sequence(v, f)
        if looks(inner):
            return gathered(inner, f, *over_items(v, name, f))
        kinds: list[str] = []

        def use(x: Val) -> Column:
            x = sequence(x, f)
            kinds.append(x.kind)
            return x.col

        out = F.flatten(F.transform(v.col, inside(v, f, name, inner, use)))
        return Val(kinds[-1], out)
    prefix = fresh("i") + "_"
    items = node_set(v, f).select(*KEY, *[F.col(f"c_{c}").alias(f"{prefix}{c}") for c in NODE])
    g = Frame(f.base.join(items, KEY).withColumn("it", F.concat("it", F.array(F.col(f"{prefix}pre")))), f.depth + 1, f.env, f.vars | {name: Val("one", prefix=prefix)})
    return gathered(inner, f, g, f"{prefix}pre")


def looks(body) -> bool:
    """Whether an expression holds a path, a function that finds nodes, or a loop of its own."""
    if isinstance(body, (list, tuple)):
        if len(body) and body[0] in ("path", "filter", "union", "for", "some", "every") or len(body) > 1 and body[0] == "call" and body[1] in ("key", "id", "current"):
            return True
        return any(looks(x) for x in body)
    return False


def over_items(v: Val, name: str, f: Frame) -> tuple[Frame, str]:
    """A frame with an iteration for each item of a sequence, and the column of the item's place."""
    at, what = fresh("i"), fresh("i")
    rows = f.rows(lambda df: df.select("*", F.posexplode(v.col).alias(at, what))).withColumn("it", F.concat("it", F.array(at)))
    return Frame(rows, f.depth + 1, f.env, f.vars | {name: Val("n" if v.kind == "qn" else "s", F.col(what))}), at


def gathered(inner: tuple, f: Frame, g: Frame, place: str) -> Val:
    """The values of an inner frame's iterations, as sequences of the outer one's, by the column `place`."""
    got = sequence(compile_(inner, g), g)
    out = fresh("l")
    all_ = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct(F.col(place).alias("p"), F.col("_got").alias("x")))), lambda r: r["x"]))
    f.attach(g.df.withColumn("_got", got.col).withColumn("it", F.slice("it", 1, f.depth)).groupBy(*KEY).agg(all_.alias(out)))
    return Val(got.kind, F.coalesce(F.col(out), F.array().cast("array<double>" if got.kind == "qn" else "array<string>")))


def quantified(kind: str, binds: list, body: tuple, f: Frame) -> Val:
    (name, source), rest = binds[0], binds[1:]
    v = compile_(source, f)
    if v.kind in SCALAR | SEQUENCE | {"if"}:
        v = sequence(v, f)
        if looks([rest, body]):
            g = over_items(v, name, f)[0]
            return counted(kind, to_bool(quantified(kind, rest, body, g) if rest else compile_(body, g), g), f, g)
        each = inside(v, f, name, (kind, rest, body) if rest else body, lambda x: to_bool(x, f))
        return Val("b", F.exists(v.col, each) if kind == "some" else F.forall(v.col, each))
    prefix = fresh("i") + "_"
    items = node_set(v, f).select(*KEY, *[F.col(f"c_{c}").alias(f"{prefix}{c}") for c in NODE])
    inner = f.base.join(items, KEY).withColumn("it", F.concat("it", F.array(F.col(f"{prefix}pre"))))
    g = Frame(inner, f.depth + 1, f.env, f.vars | {name: Val("one", prefix=prefix)})
    return counted(kind, to_bool(quantified(kind, rest, body, g) if rest else compile_(body, g), g), f, g)


def counted(kind: str, ok: Column, f: Frame, g: Frame) -> Val:
    out = fresh("q")
    f.attach(g.df.withColumn("_ok", ok).withColumn("it", F.slice("it", 1, f.depth)).groupBy(*KEY).agg((F.max if kind == "some" else F.min)("_ok").alias(out)))
    return Val("b", F.coalesce(F.col(out), F.lit(kind == "every")))


def together(e: tuple, f: Frame) -> Val:
    """The nodes of a sequence of paths, each once."""
    parts = [compile_(x, f) for x in e[1]]
    if any(p.kind not in ("ns", "one", "attr") for p in parts):
        raise XPathError("a path must begin with nodes")
    dfs = [node_set(p, f).select(*KEY, *[f"c_{c}" for c in NODE]) for p in parts]
    return Val("ns", df=functools.reduce(DataFrame.unionByName, dfs).dropDuplicates([*KEY, "c_pre"]), depth=f.depth)


def path(e: tuple, f: Frame) -> Val:
    start, steps = e[1], list(e[2])
    node = Val("one", prefix="c_")
    if start not in (None, "root"):
        node = together(start, f) if start[0] == "seq" and start[1] else compile_(start, f)
        if node.kind not in ("ns", "one", "attr"):
            raise XPathError("a path must begin with nodes")
    if start == "root":
        roots = f.base.drop(*[f"c_{c}" for c in NODE]).join(f.env.table(F.col("kind") == "root"), F.col("doc_id") == F.col("n_doc")).drop("n_doc")
        node = Val("ns", df=roots, depth=f.depth)
    if node.kind == "one" and len(steps) == 1:
        axis, test, preds = steps[0]
        if axis == "attribute" and test[0] == "name" and not preds:
            key = "{%s}%s" % (uri_of(f.env, test[1]), test[2]) if test[1] else test[2]
            value = F.try_element_at(F.col(f"{node.prefix}attrs"), F.lit(key))
            return Val("attr", value if node.col is None else F.when(node.col, value), name=(test, node))
        if axis == "self" and test == ("kind", "node", None) and not preds:
            return node
        if axis == "self" and not preds and start is None:
            return Val("one", test_column(f.env, axis, test, node.prefix), prefix=node.prefix)
    df, one = node_set(node, f), node.kind in ("one", "attr") or start == "root"
    for axis, test, preds in steps:
        df, one = step(df, one, axis, test, preds, f)
    return Val("ns", df=df, depth=f.depth)


FLIP = {"<": ">", "<=": ">=", ">": "<", ">=": "<="}
VALUE = {"eq": "=", "ne": "!=", "lt": "<", "le": "<=", "gt": ">", "ge": ">="}


def operator(op: str, left: tuple, right: tuple, f: Frame) -> Val:
    if op in ("and", "or"):
        a, b = to_bool(compile_(left, f), f), to_bool(compile_(right, f), f)
        return Val("b", F.when(a, b).otherwise(False) if op == "and" else F.when(a, True).otherwise(b))
    return operate(op, compile_(left, f), compile_(right, f), f)


def choose(c: Column, a: Val, b: Val, f: Frame) -> Val:
    """Either of two values; of different kinds, they stay apart until they are used."""
    if a.kind == b.kind and a.kind in SCALAR | SEQUENCE | TEMPORAL and a.name == b.name:
        return Val(a.kind, F.when(c, a.col).otherwise(b.col), name=a.name)
    nodes = ("ns", "one", "attr")
    if a.kind in nodes and b.kind in nodes:
        flag = f.column(c, "c")
        parts = [node_set(x, f).join(f.df.filter(flag if y else ~flag).select(*KEY), KEY, "left_semi") for x, y in ((a, True), (b, False))]
        return Val("ns", df=parts[0].unionByName(parts[1], allowMissingColumns=True), depth=f.depth)
    return Val("if", c, name=(a, b))


def single(v: Val, f: Frame) -> tuple[Column, Column, str]:
    """The number of a value's items, the only one's value, and its type; nodes count as the texts they hold."""
    if v.kind in TEMPORAL:
        return F.lit(1), v.col, v.name
    if v.kind in SEQUENCE:
        return F.size(v.col), item(v), "number" if v.kind == "qn" else "string"
    if v.kind == "ns":
        return gather(v, f, 0, F.count("*")), to_str(v, f), "string"
    if v.kind in ("one", "attr"):
        return F.when(to_bool(v, f), 1).otherwise(0), to_str(v, f), "string"
    return F.lit(1), v.col, {"b": "boolean", "n": "number", "s": "string"}[v.kind]


def by_value(op: str, a: Val, b: Val, f: Frame) -> Val:
    """eq and its like: false where a side is empty; more than one item, or other types on either side, are an error."""
    (n, x, one), (m, y, two_) = single(a, f), single(b, f)
    sign = VALUE[op]
    fail = lambda text: F.raise_error(F.lit(text)).cast("boolean")
    if one != two_:
        same = fail(f"{op} compares a {one} with a {two_}; cast one, or use {sign}")
    elif one in ("date", "dateTime", "time"):
        same = S.compare(sign, instant(a, one, f), instant(b, one, f))
    elif one == "string":
        same = {"eq": x == y, "ne": x != y, "lt": x < y, "le": x <= y, "gt": x > y, "ge": x >= y}[op]
    else:
        same = S.compare(sign, x.cast("double"), y.cast("double"))
    many = fail(f"an operand of {op} has more than one item; {sign} compares any of them")
    return Val("b", F.when((n == 0) | (m == 0), False).when((n > 1) | (m > 1), many).otherwise(same))


def operate(op: str, a: Val, b: Val, f: Frame) -> Val:
    if a.kind == "if":
        return choose(a.col, *(operate(op, x, b, f) for x in a.name), f)
    if b.kind == "if":
        return choose(b.col, *(operate(op, a, x, f) for x in b.name), f)
    if op in VALUE:
        if not f.env.two:
            raise XPathError(f"{op} needs the XPath 2.0 binding")
        return by_value(op, a, b, f)
    if TEMPORAL & {a.kind, b.kind}:
        return temporal(op, a, b, f)
    if op in ("+", "-", "*", "div", "mod"):
        return Val("n", S.arithmetic(op, to_num(a, f), to_num(b, f)))
    if op in ("is", "<<", ">>"):
        x, y = (gather(v, f, -1, F.min("c_pre")) if v.kind != "one" else F.col(f"{v.prefix}pre") for v in (a, b))
        return Val("b", {"is": x == y, "<<": x < y, ">>": x > y}[op] & (x >= 0) & (y >= 0))
    nodes = {"ns", "one", "attr", *SEQUENCE}
    if op in ("=", "!="):
        return Val("b", equality(op, a, b, f))
    if a.kind not in nodes and b.kind not in nodes:
        return Val("b", S.compare(op, to_num(a, f), to_num(b, f)))
    if "b" in (a.kind, b.kind):
        return Val("b", S.compare(op, *(F.when(to_bool(v, f), 1.0).otherwise(0.0) for v in (a, b))))
    least = lambda v: extreme(v, f, F.min)
    most = lambda v: extreme(v, f, F.max)
    return Val("b", S.compare(op, least(a), most(b)) if op in ("<", "<=") else S.compare(op, most(a), least(b)))


def instant(v: Val, kind: str, f: Frame) -> Column:
    return T.seconds(v.col if v.kind == "t" else T.checked(to_str(v, f), kind), v.name if v.kind == "t" else kind, f.env.implicit)


def temporal(op: str, a: Val, b: Val, f: Frame) -> Val:
    """Comparisons of instants and of durations, and their arithmetic; other operands are read as the same type."""
    sign = VALUE.get(op, op)
    if sign in ("=", "!=", *FLIP):
        if "t" in (a.kind, b.kind):
            if "u" in (a.kind, b.kind):
                raise XPathError("a date and a duration can't be compared")
            kind = a.name if a.kind == "t" else b.name
            return Val("b", S.compare(sign, instant(a, kind, f), instant(b, kind, f)))
        kind = a.name if a.kind == "u" else b.name
        x, y = (v.col if v.kind == "u" else T.duration(to_str(v, f), kind) for v in (a, b))
        if a.kind == b.kind == "u" and a.name != b.name:
            raise XPathError("durations of different types can't be compared")
        return Val("b", S.compare(sign, x, y))
    if op == "+" and a.kind == "u" and b.kind == "t":
        a, b = b, a
    if a.kind == b.kind == "t" and op == "-" and a.name == b.name:
        zoned = f.env.implicit if a.name != "date" else 0
        return Val("u", T.seconds(a.col, a.name, zoned) - T.seconds(b.col, b.name, zoned), name="dayTimeDuration")
    if a.kind == "t" and b.kind == "u" and op in "+-" and not (a.name == "time" and b.name == "yearMonthDuration"):
        amount = b.col if op == "+" else -b.col
        add = T.add_seconds if b.name == "dayTimeDuration" else T.add_months
        return Val("t", add(a.col, a.name, amount), name=a.name)
    if a.kind == b.kind == "u" and a.name == b.name and op in ("+", "-", "div"):
        value = S.arithmetic(op, a.col, b.col)
        return Val("n", value) if op == "div" else Val("u", value, name=a.name)
    if op == "*" and b.kind == "u" and a.kind != "u":
        a, b = b, a
    if op in ("*", "div") and a.kind == "u" and b.kind not in TEMPORAL:
        value = S.arithmetic(op, a.col, to_num(b, f))
        if a.name == "yearMonthDuration":
            value = F.when(value < 0, -S.floor(-value + 0.5)).otherwise(S.floor(value + 0.5))
        return Val("u", value, name=a.name)
    raise XPathError(f"{op} isn't defined for these dates and durations")


def extreme(v: Val, f: Frame, agg) -> Column:
    """The least or largest number of a node-set without its NaNs (NaN if there is none)."""
    if v.kind in SCALAR:
        return to_num(v, f)
    if v.kind in SEQUENCE:
        some = F.filter(numbers(v), lambda x: ~F.isnan(x))
        return F.coalesce((F.array_min if agg is F.min else F.array_max)(some), S.nan())
    if v.kind in ("one", "attr"):
        text = to_str(v, f)
        return S.parse_number(text)
    x = S.parse_number(F.col("c_value"))
    return gather(v, f, S.NAN, agg(F.when(~F.isnan(x), x)))


def equality(op: str, a: Val, b: Val, f: Frame) -> Column:
    if SEQUENCE & {a.kind, b.kind}:
        a, b = sequence(a, f), sequence(b, f)
        if a.kind == b.kind == "qn":
            return F.exists(a.col, lambda x: F.exists(b.col, lambda y: S.compare(op, x, y)))
        one, two_ = texts(a), texts(b)
        return F.exists(one, lambda x: F.exists(two_, (lambda y: x == y) if op == "=" else (lambda y: x != y)))
    if b.kind == "ns" and a.kind != "ns" or b.kind in ("one", "attr") and a.kind in SCALAR:
        a, b = b, a
    if a.kind in SCALAR:
        if "b" in (a.kind, b.kind):
            x, y = to_bool(a, f), to_bool(b, f)
            return x == y if op == "=" else x != y
        if "n" in (a.kind, b.kind):
            return S.compare(op, to_num(a, f), to_num(b, f))
        return to_str(a, f) == to_str(b, f) if op == "=" else to_str(a, f) != to_str(b, f)
    if b.kind == "b":
        x = to_bool(a, f)
        return x == b.col if op == "=" else x != b.col
    if a.kind in ("one", "attr"):
        there = to_bool(a, f)
        if b.kind == "n":
            return there & S.compare(op, to_num(a, f), b.col)
        both = there & to_bool(b, f) if b.kind in ("one", "attr") else there
        same = to_str(a, f) == to_str(b, f)
        return both & (same if op == "=" else ~same)
    if b.kind == "ns":
        if op == "=":
            one, two_, name = node_set(a, f).select(*KEY, "c_value"), node_set(b, f).select(*KEY, "c_value"), fresh("e")
            f.attach(one.join(two_, [*KEY, "c_value"], "left_semi").select(*KEY).distinct().withColumn(name, F.lit(True)))
            return F.coalesce(F.col(name), F.lit(False))
        lo, hi = zip(*[(gather(v, f, None, F.min("c_value")), gather(v, f, None, F.max("c_value"))) for v in (a, b)])
        return F.coalesce(~((lo[0] == hi[0]) & (lo[1] == hi[1]) & (lo[0] == lo[1])), F.lit(False))
    other, name = fresh("o"), fresh("e")
    there = to_bool(b, f) if b.kind in ("one", "attr") else F.lit(True)
    value = to_num(b, f) if b.kind == "n" else to_str(b, f)
    mine = f.rows(lambda df: df.filter(there).select(*KEY, value.alias(other)))
    pairs = node_set(a, f).select(*KEY, "c_value").join(mine, KEY)
    if b.kind == "n":
        hit = S.compare(op, S.parse_number(F.col("c_value")), F.col(other))
    else:
        hit = F.col("c_value") == F.col(other) if op == "=" else F.col("c_value") != F.col(other)
    f.attach(pairs.groupBy(*KEY).agg(F.max(hit).alias(name)))
    return F.coalesce(F.col(name), F.lit(False))


def matches(e: tuple, env: Env) -> DataFrame:
    """(doc_id, c_*) of all nodes that a match pattern selects: a path or a union of paths over child, attribute, self and
    descendant-or-self. The last step's test filters the node table; nothing starts from the roots unless the path does."""
    if e[0] == "union":
        return matches(e[1], env).unionByName(matches(e[2], env)).dropDuplicates(["doc_id", "c_pre"])
    if e[0] != "path" or e[1] not in (None, "root"):
        raise XPathError("a context must be a path or a union of paths")
    for axis, _, _ in e[2]:
        if axis not in ("child", "attribute", "descendant-or-self", "self"):
            raise XPathError(f"axis {axis} is not allowed in a context")
    table = lambda cond: env.table(cond).withColumnRenamed("n_doc", "doc_id").withColumn("it", F.array().cast("array<int>"))
    steps = list(e[2])
    if e[1] == "root":
        df, one = table(F.col("kind") == "root"), True
    else:
        axis, test, preds = steps.pop(0)
        cond = test_column(env, axis, test)
        if axis == "child" or axis == "descendant":
            cond = cond & F.col("child_ix").isNotNull()
        elif axis == "attribute":
            cond = cond & (F.col("kind") == "attribute")
        df, one = table(cond).withColumn("s_pre", F.col("c_parent") if axis != "self" else F.col("c_pre")), False
        f = Frame(df, 0, env)
        for p in preds:
            df = predicate(df, Window.partitionBy("doc_id", "s_pre"), F.col("c_pre"), p, f)
        df = df.drop("s_pre")
    f = Frame(df, 0, env)
    for axis, test, preds in steps:
        df, one = step(df, one, axis, test, preds, f)
    return df.select("doc_id", *[f"c_{c}" for c in NODE])


def frame(df: DataFrame, env: Env, vars_: dict[str, Val] | None = None) -> Frame:
    """A frame with an iteration for each node in c_*, which is also what current() is."""
    df = df.withColumn("it", F.array("c_pre")).withColumns({f"cur_{c}": F.col(f"c_{c}") for c in NODE})
    return Frame(df.withColumn("pos", F.lit(1.0)).withColumn("size", F.lit(1.0)), 1, env, vars_ or {})


def evaluate(nodes: DataFrame, source: tuple, namespaces: dict[str, str] | None = None, two_: bool = False) -> Val:
    """An expression at the root of every document: for the bare-XPath entry point."""
    env = Env(nodes, namespaces or {}, two=two_)
    f = frame(env.table(F.col("kind") == "root").withColumnRenamed("n_doc", "doc_id"), env)
    v = compile_(source, f)
    return replace(v, df=node_set(v, f) if v.kind in ("ns", "one", "attr") else f.df)
