"""Sharding by proportional stratified interleaving."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from xylem.llm.util import numbered, with_row_id


def place(rows: DataFrame, source_col: str, tie_cols: list[str], shards: int = 16, seed: int = 11) -> DataFrame:
    """rows with shard and slot (from 0 within the shard).

    Rows are shuffled within each source by a seeded hash of tie_cols, and ranked. Sorted by the fraction of their source
    that lies before them, then by source, they are cut into shards whose numbers of rows differ by one at most; each
    shard has its share of every source but for about one row. Both sorts are spread by ranges, whatever the sources."""
    one = numbered(rows.withColumn("_hash", F.xxhash64(F.lit(seed), *[F.col(c) for c in tie_cols])), source_col, ["_hash", *tie_cols], "_rank", "_of")
    two = numbered(one.withColumn("_fraction", (F.col("_rank") + 0.5) / F.col("_of")), None, ["_fraction", source_col, "_rank"], "_place", "_total")
    shard = F.expr(f"_place * {shards} div _total")
    first = F.expr(f"(_shard * _total + {shards - 1}) div {shards}")
    out = two.withColumn("_shard", shard).withColumn("slot", F.col("_place") - first).withColumn("shard", F.col("_shard").cast("int"))
    return out.drop("_hash", "_rank", "_of", "_fraction", "_place", "_total", "_shard")


def shard(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", shards: int = 16, seed: int = 11) -> DataFrame:
    """docs with shard and slot (columns of these names are replaced).

    Null is a source of its own; repeated rows are placed one by one; an empty table gives an empty one."""
    rows, rid = with_row_id(docs.drop("shard", "slot"))
    small = rows.select(F.col(rid).alias("_rid"), F.col(f"`{source_col}`").alias("_src"), F.col(f"`{id_col}`").alias("_id"), F.xxhash64(F.col(f"`{text_col}`")).alias("_text"))
    return rows.join(place(small, "_src", ["_id", "_text"], shards, seed).select(F.col("_rid").alias(rid), "shard", "slot"), rid).drop(rid)


def digest(docs: DataFrame) -> DataFrame:
    text = F.col("text").cast("binary")
    small = docs.select("doc_id", "source", (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"), F.crc32(F.coalesce(text, F.lit(b""))).alias("text_crc32"))
    return place(small, "source", ["doc_id", "text_crc32"]).select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "source")
