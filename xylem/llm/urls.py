"""URL filters: rules by host and path, then a blocked Bloom filter in front of an exact join with the listed URLs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from xylem.llm.util import keep, mix64, unused

#: (verdict, rule): the rule's host, then its path from the first slash on.
RULES = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"))
UP, LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Words of 64 bits in a block, and bits that each URL sets in its block.
WORDS, BITS = 8, 8


def _rest(url: Column) -> Column:
    """What follows the first ://, else empty."""
    return F.when(F.instr(url, "://") > 0, F.regexp_replace(url, r"(?s)^.*?://", "")).otherwise("")


def host(url: Column) -> Column:
    return F.translate(F.regexp_extract(_rest(url), r"^([^/?#]*)", 1), UP, LOW)


def path(url: Column) -> Column:
    return F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1)


def canonical(url: Column) -> Column:
    """Host, path without closing slashes, and the query's parts in order, without utm_ ones; no scheme, no fragment."""
    query = F.regexp_extract(_rest(url), r"^[^?#]*\?([^#]*)", 1)
    parts = F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.startswith("utm_")))
    return F.concat(host(url), F.rtrim(path(url), F.lit("/")), F.when(F.size(parts) > 0, F.concat(F.lit("?"), F.array_join(parts, "&"))).otherwise(""))


def longest_rule(host_: Column, path_: Column, rules: tuple[tuple[str, str], ...] = RULES) -> Column:
    """struct(verdict, rule) of the longest rule that fits, else null. Ties go to the first in code-point order."""
    out = F.lit(None).cast("struct<verdict: string, rule: string>")
    for verdict, rule in sorted(rules, key=lambda r: (len(r[1]), [-ord(c) for c in r[1]])):
        h, _, p = rule.partition("/")
        fits = ((host_ == h) | host_.endswith(f".{h}")) & path_.startswith(f"/{p}")
        out = F.when(fits, F.struct(F.lit(verdict).alias("verdict"), F.lit(rule).alias("rule"))).otherwise(out)
    return out


def slots(hashes: np.ndarray, blocks: int) -> tuple[np.ndarray, np.ndarray]:
    """The block of each hash, and its 8 words' masks: BITS bits, all within one block of 64 bytes."""
    x = mix64(hashes.astype(np.int64).view(np.uint64))
    block = (x >> np.uint64(32)) % np.uint64(blocks)
    y, masks = mix64(x ^ np.uint64(0x5851F42D4C957F2D)), np.zeros((len(x), WORDS), np.uint64)
    row = np.arange(len(x))
    for i in range(BITS):
        bit = y >> np.uint64(7 * i) & np.uint64(0x1FF if 7 * i + 9 <= 64 else 0x7F)
        masks[row, (bit >> np.uint64(6)).astype(np.int64)] |= np.uint64(1) << (bit & np.uint64(63))
    return block.astype(np.int64), masks


def bloom(listed: DataFrame, hash_col: str, count: int, bits_each: int = 16, max_bytes: int = 32 << 20) -> np.ndarray:
    """The filter, blocks x WORDS. It never has more than max_bytes, so it may be broadcast whatever the list; a list too long
    for that only makes more hits false, and the exact join behind it takes all of them."""
    blocks = max(1, min(max_bytes // (8 * WORDS), -(-count * bits_each // (64 * WORDS))))

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            block, masks = slots(batch.column(0).to_numpy(zero_copy_only=False), blocks)
            order = np.argsort(block, kind="stable")
            first = np.flatnonzero(np.diff(block[order], prepend=-1))
            merged = np.bitwise_or.reduceat(masks[order], first, axis=0) if len(first) else masks
            yield pa.RecordBatch.from_arrays([pa.array(block[order][first])] + [pa.array(merged[:, i].view(np.int64)) for i in range(WORDS)], ["block", *[f"w{i}" for i in range(WORDS)]])

    part = listed.select(hash_col).mapInArrow(fill, "block long, " + ", ".join(f"w{i} long" for i in range(WORDS)))
    got = part.groupBy("block").agg(*[F.bit_or(f"w{i}").alias(f"w{i}") for i in range(WORDS)]).toArrow()
    out = np.zeros((blocks, WORDS), np.uint64)
    if got.num_rows:
        out[got.column("block").to_numpy()] = np.column_stack([got.column(f"w{i}").to_numpy() for i in range(WORDS)]).view(np.uint64)
    return out


def url_filter(pages: DataFrame, listed: DataFrame, url_col: str = "url", rules: tuple[tuple[str, str], ...] = RULES, max_bytes: int = 32 << 20) -> DataFrame:
    """pages with host, path, rule, canonical and verdict (columns of these names are replaced).

    listed: distinct canonical URLs in column canonical. The verdict is the longest fitting rule's; without one, block if the
    page's canonical URL is listed, else allow. A null or malformed URL has empty parts, no rule, and is allowed unless
    the empty canonical URL is listed. Repeated pages are judged one by one. Only pages that the filter lets through are
    shuffled, for an exact join; where one URL is hot, the adaptive skew join splits it."""
    spark = pages.sparkSession
    listed = keep(listed.select("canonical", F.xxhash64("canonical").alias("_hash")), "listed")
    held = spark.sparkContext.broadcast(bloom(listed, "_hash", listed.count(), max_bytes=max_bytes))

    @F.pandas_udf("boolean")
    def maybe(hashes: pd.Series) -> pd.Series:
        table = held.value
        block, masks = slots(hashes.to_numpy(), len(table))
        return pd.Series(((table[block] & masks) == masks).all(axis=1))

    url = F.coalesce(F.col(f"`{url_col}`"), F.lit(""))
    base = pages.drop("host", "path", "rule", "canonical", "verdict")
    named, probe, block, other = (unused(base, x) for x in ("rule", "maybe", "block", "listed"))
    judged = base.withColumns({"host": host(url), "path": path(url), "canonical": canonical(url)}).withColumn(named, longest_rule(F.col("host"), F.col("path"), rules)).withColumn(probe, F.col(named).isNull() & maybe(F.xxhash64("canonical")))
    on = listed.select(F.col("canonical").alias(other))
    hits = judged.filter(F.col(probe)).join(on, F.col("canonical") == F.col(other), "left").withColumn(block, F.col(other).isNotNull()).drop(other)
    rest = judged.filter(~F.col(probe)).withColumn(block, F.lit(False))
    both = hits.unionByName(rest)
    return both.select(*[F.col(f"`{c}`") for c in base.columns], "host", "path", F.col(f"{named}.rule").alias("rule"), "canonical", F.coalesce(F.col(f"{named}.verdict"), F.when(F.col(block), "block").otherwise("allow")).alias("verdict"))


def repeated(pages: DataFrame, url_col: str = "url") -> DataFrame:
    """The query's list: canonical URLs of more than one page, so that crawls of a page under several addresses are blocked."""
    return pages.select(canonical(F.coalesce(F.col(url_col), F.lit(""))).alias("canonical")).filter("canonical <> ''").groupBy("canonical").count().filter("count > 1").select("canonical")


def digest(pages: DataFrame) -> DataFrame:
    small = pages.select("page_id", "url")
    return url_filter(small, repeated(small)).select("page_id", "host", "path", "rule", "verdict", "canonical")


SQL = """
WITH a AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS r FROM pages),
b AS (SELECT page_id, translate(regexp_extract(r, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(r, '^[^/?#]*([^?#]*)', 1) AS path,
  list_sort(list_filter(string_split(regexp_extract(r, '^[^?#]*\\?([^#]*)', 1), '&'), lambda x: x <> '' AND NOT starts_with(x, 'utm_'))) AS q FROM a),
c AS (SELECT *, host || rtrim(path, '/') || CASE WHEN len(q) > 0 THEN '?' || array_to_string(q, '&') ELSE '' END AS canonical FROM b),
l AS (SELECT canonical FROM c WHERE canonical <> '' GROUP BY canonical HAVING count(*) > 1),
m AS (SELECT *, CASE
  WHEN (host = 'www.example.com' OR ends_with(host, '.www.example.com')) AND starts_with(path, '/en/') THEN 'www.example.com/en/'
  WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/en/') THEN 'example.com/en/'
  WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/es/') THEN 'net/es/'
  WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/fr/') THEN 'net/fr/'
  WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/') THEN 'com/' END AS rule FROM c)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('com/', 'www.example.com/en/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
  WHEN canonical IN (SELECT canonical FROM l) THEN 'block' ELSE 'allow' END AS verdict, canonical FROM m"""
