"""What several operators share: shared-folder tables, UTF-8 buffers of Arrow columns, hashing."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SPACE = np.zeros(256, bool)
SPACE[[0x20, 9, 10, 11, 12, 13]] = True


def work_dir(spark: SparkSession) -> str:
    """A new folder below the one that the session names in spark.checkpoint.dir.

    Only a local session without that setting gets a temporary folder."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.conf.get("spark.master", "").startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        base = f"file://{tempfile.mkdtemp(prefix='xylem-')}"
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/xylem-{uuid.uuid4().hex}"


def keep(df: DataFrame, name: str = "t") -> DataFrame:
    """df, computed once, written to the shared folder and read again: its lineage ends there."""
    spark = df.sparkSession
    path = f"{work_dir(spark)}/{name}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string column's values end to end, and the n + 1 offsets; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    if column.null_count:
        column = column.fill_null("")
    n, wide = len(column), pa.types.is_large_string(column.type)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    if data is None:
        return np.zeros(0, np.uint8), at - at[0]
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]], at - at[0]


def pieces(at: np.ndarray, most: int) -> list[tuple[int, int]]:
    """Ranges of rows with about `most` bytes each; a longer row has a range of its own."""
    out, i, n = [], 0, len(at) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(at, at[i] + most, "right")) - 1)
        out.append((i, min(j, n)))
        i = min(j, n)
    return out


def mix64(x: np.ndarray) -> np.ndarray:
    """A finaliser that spreads 64-bit values (Stafford's variant 13)."""
    x = x.astype(np.uint64, copy=True)
    with np.errstate(over="ignore"):
        x ^= x >> np.uint64(30)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(27)
        x *= np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
    return x


def distinct(x: np.ndarray) -> np.ndarray:
    """The different values, ascending; by sorting, which for whole numbers is several times faster than hashing them."""
    x = np.sort(x)
    return x[np.append(True, x[1:] != x[:-1])] if len(x) else x


_P = 0x9E3779B97F4A7C15
_PI = pow(_P, -1, 1 << 64)
_BYTE = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    if n:
        out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def span_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit polynomial hashes of buf[start:end], equal for equal bytes; starts ascend and spans don't overlap.

    Prefix sums modulo 2**64 give every span in a few passes; spans are handled in runs of about 1 MB."""
    out, i, n = np.empty(len(starts), np.uint64), 0, len(starts)
    while i < n:
        lo = int(starts[i])
        j = max(i + 1, int(np.searchsorted(ends, lo + (1 << 20), "right")))
        hi = int(ends[j - 1])
        part = np.empty(hi - lo + 1, np.uint64)
        part[0] = 0
        with np.errstate(over="ignore"):
            np.cumsum(_BYTE[buf[lo:hi]] * _powers(_P, hi - lo), out=part[1:], dtype=np.uint64)
            a, b = starts[i:j] - lo, ends[i:j] - lo
            h = (part[b] - part[a]) * _powers(_PI, hi - lo + 1)[a]
            out[i:j] = mix64(h + (b - a).astype(np.uint64) * np.uint64(_P))
        i = j
    return out


def runs(mask: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of True; rows (offsets at) part runs."""
    if not len(mask):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    rise = np.empty(len(mask), bool)
    rise[0], rise[1:] = mask[0], mask[1:] & ~mask[:-1]
    inner = at[(at > 0) & (at < len(mask))]
    cut = np.zeros(len(mask) + 1, bool)
    cut[inner] = True
    rise |= cut[:-1] & mask
    fall = np.empty(len(mask), bool)
    fall[-1], fall[:-1] = mask[-1], mask[:-1] & (~mask[1:] | cut[1:-1])
    return np.flatnonzero(rise), np.flatnonzero(fall) + 1


def lower(buf: np.ndarray) -> np.ndarray:
    """A-Z to a-z."""
    return _LOWER[buf]


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def words(buf: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words, and the row of each."""
    starts, ends = runs(~SPACE[buf], at)
    return starts, ends, np.searchsorted(at, starts, "right") - 1


def numbered(df: DataFrame, group: str | None, order: list[str], rank: str = "rank", size: str = "group_size") -> DataFrame:
    """df with each row's place from 0 in its group (of all rows if None), by the columns of order, and the group's size.

    Rows are ranged over partitions by (group, order), so a group of any size is spread; each partition numbers its own and
    adds what the earlier ones hold. The result is a table in the shared folder. Equal rows go by their place in the input."""
    keys = [*([group] if group else []), *order, "_tie"]
    at = F.monotonically_increasing_id()
    low = (1 << 33) - 1
    sorted_ = df.withColumn("_tie", at).repartitionByRange(*keys).sortWithinPartitions(*keys).drop("_tie")
    kept = keep(sorted_.withColumn("_at", at).withColumn("_part", F.shiftright("_at", 33)).withColumn("_at", F.col("_at").bitwiseAND(low)), "numbered")
    g = F.col(group) if group else F.lit(0)
    parts = kept.groupBy(g.alias("_g"), F.col("_part").alias("_p")).agg(F.min("_at").alias("_from"), F.count("*").alias("_n"))
    parts = keep(parts, "parts")
    earlier = Window.partitionBy("_g").orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0))).withColumn("_all", F.sum("_n").over(Window.partitionBy("_g")))
    joined = kept.withColumn("_k", g).join(parts, F.col("_k").eqNullSafe(F.col("_g")) & (F.col("_part") == F.col("_p")))
    return joined.select(*[F.col(f"`{c}`") for c in df.columns], (F.col("_before") + F.col("_at") - F.col("_from")).alias(rank), F.col("_all").alias(size))


def join_uneven(left: DataFrame, right: DataFrame, on: list[str], weight: str, parts: int = 1000) -> DataFrame:
    """Inner join of left with right, whose keys are distinct and not null; weight: how many rows of left have each key.

    Keys of more than 1 / parts of all rows are fewer than parts, so they are broadcast, and their rows of left stay where
    they are; all others are small enough to be shuffled by key."""
    total = right.agg(F.sum(weight)).first()[0] or 0
    hot = F.broadcast(right.filter(F.col(weight) > total / parts))
    rest = left.join(hot.select(*on), on, "left_anti")
    return left.join(hot, on).unionByName(rest.join(right.filter(F.col(weight) <= total / parts), on))


def unused(df: DataFrame, stem: str) -> str:
    """A column name that df hasn't, whatever the case of its letters."""
    taken = {c.lower() for c in df.columns}
    return next(name for i in range(len(taken) + 1) if (name := f"_{stem}{i or ''}") not in taken)


def with_row_id(df: DataFrame) -> tuple[DataFrame, str]:
    """df written once to the shared folder with a number that tells its rows apart, and that column's name, which df hasn't."""
    name = unused(df, "rid")
    return keep(df.withColumn(name, F.monotonically_increasing_id()), "rows"), name


def sources(rows: DataFrame, source: str, size: str, most: int) -> list[tuple[str | None, int, int]]:
    """(source, sum of sizes, rows) by code point, null last. At most `most` sources come to the driver; more is an error."""
    got = rows.groupBy(source).agg(F.sum(size).alias("s"), F.count("*").alias("n")).limit(most + 1).collect()
    if len(got) > most:
        raise ValueError(f"more than {most} sources")
    return sorted(((r[0], int(r[1] or 0), int(r[2])) for r in got), key=lambda r: (r[0] is None, r[0] or ""))
