"""XML documents made from relational tables, so that the engine can be held against SQL over the same tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def escape(c: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("\n", "&#10;"), ("\t", "&#9;"), ("\r", "&#13;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return F.regexp_replace(c, "[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\uFFFE\\uFFFF]", "")


def plain(c: str, digits: int = 2) -> Column:
    """Doubles in plain decimal form; decimals have no negative zero."""
    return F.col(c).cast(f"decimal(18,{digits})").cast("string")


def tag(name: str, attrs: dict[str, Column], body: Column | None = None) -> Column:
    parts = [F.lit(f"<{name}")]
    for k, v in attrs.items():
        parts += [F.lit(f' {k}="'), F.coalesce(v.cast("string"), F.lit("")), F.lit('"')]
    return F.concat(*parts, F.lit("/>")) if body is None else F.concat(*parts, F.lit(">"), body, F.lit(f"</{name}>"))


def nested(df: DataFrame, key: str, order: list[str], element: Column, name: str) -> DataFrame:
    """key and the elements of its rows, concatenated in a total order (sort_array compares without an expression a pair)."""
    return df.groupBy(key).agg(F.array_join(F.sort_array(F.collect_list(F.struct(*order, element.alias("_x"))))["_x"], "").alias(name))


LINE_ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]


def order_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One document an order, its lines in the order of all their columns."""
    line = tag("line", {"n": F.col("l_linenumber"), "part": F.col("l_partkey"), "qty": plain("l_quantity", 0), "price": plain("l_extendedprice"), "flag": F.col("l_returnflag")})
    lines = nested(read(spark, sf_dir, "lineitem"), "l_orderkey", LINE_ORDER, line, "lines")
    orders = read(spark, sf_dir, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    attrs = {"id": F.col("o_orderkey"), "status": F.col("o_orderstatus"), "total": plain("o_totalprice"), "date": F.date_format("o_orderdate", "yyyy-MM-dd"), "priority": escape(F.col("o_orderpriority"))}
    return orders.select(F.col("o_orderkey").alias("doc_id"), tag("order", attrs, F.coalesce("lines", F.lit(""))).alias("xml"))


def catalog_docs(spark: SparkSession, sf_dir: str, buckets: int = 200) -> DataFrame:
    """One document for each bucket of parts: those of size above 10, and a reference for every line that names one of its parts."""
    part = read(spark, sf_dir, "part").filter("p_size > 10").withColumn("_b", F.col("p_partkey") % buckets)
    parts = nested(part, "_b", ["p_partkey"], tag("part", {"id": F.col("p_partkey"), "brand": escape(F.col("p_brand"))}), "parts")
    line = read(spark, sf_dir, "lineitem").withColumn("_c", F.col("l_partkey") % buckets)
    refs = nested(line, "_c", ["l_orderkey", *LINE_ORDER], tag("line", {"ref": F.col("l_partkey"), "order": F.col("l_orderkey"), "n": F.col("l_linenumber")}), "refs")
    both = refs.join(parts, F.col("_b") == F.col("_c"), "left")
    return both.select(F.col("_c").alias("doc_id"), tag("catalog", {}, F.concat(tag("parts", {}, F.coalesce("parts", F.lit(""))), "refs")).alias("xml"))


def world_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One document a region, with its nations and their customers and suppliers."""
    customer = nested(read(spark, sf_dir, "customer"), "c_nationkey", ["c_custkey"], tag("customer", {"key": F.col("c_custkey"), "bal": plain("c_acctbal"), "segment": F.col("c_mktsegment")}), "customers")
    supplier = nested(read(spark, sf_dir, "supplier"), "s_nationkey", ["s_suppkey"], tag("supplier", {"key": F.col("s_suppkey"), "bal": plain("s_acctbal")}), "suppliers")
    n = read(spark, sf_dir, "nation").join(customer, F.col("n_nationkey") == F.col("c_nationkey"), "left").join(supplier, F.col("n_nationkey") == F.col("s_nationkey"), "left")
    nation = tag("nation", {"key": F.col("n_nationkey"), "name": escape(F.col("n_name"))}, F.concat(F.coalesce("customers", F.lit("")), F.coalesce("suppliers", F.lit(""))))
    nations = nested(n, "n_regionkey", ["n_nationkey"], nation, "nations")
    r = read(spark, sf_dir, "region").join(nations, F.col("r_regionkey") == F.col("n_regionkey"), "left")
    return r.select(F.col("r_regionkey").cast("long").alias("doc_id"), tag("region", {"name": escape(F.col("r_name"))}, F.coalesce("nations", F.lit(""))).alias("xml"))


def conversation_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    turn = tag("turn", {"n": F.col("turn"), "role": escape(F.coalesce("role", F.lit("")))}, escape(F.coalesce("text", F.lit(""))))
    turns = nested(read(spark, sf_dir, "conversations"), "conv_id", ["turn", "role", "text"], turn, "turns")
    return turns.select(F.col("conv_id").alias("doc_id"), tag("conversation", {"id": F.col("conv_id")}, F.col("turns")).alias("xml"))


def event_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    event = tag("event", {"id": F.col("event_id"), "ts": F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), "type": escape(F.col("event_type")), "value": F.floor(F.col("value"))})
    events = nested(read(spark, sf_dir, "events"), "user_id", ["event_id"], event, "events")
    return events.select(F.col("user_id").alias("doc_id"), tag("events", {"user": F.col("user_id")}, F.col("events")).alias("xml"))
