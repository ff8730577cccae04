"""Mixing sources to target weights by systematic sampling."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from xylem.llm.util import keep, numbered, sources, with_row_id

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5.0, 2.0, 1.0)


def n_words(text: str) -> F.Column:
    return F.coalesce(F.regexp_count(F.col(f"`{text}`"), F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: list[int], weights: list[float], total: float, cap: float) -> list[float]:
    """Shares of total by weight, none above cap times its size; what is cut goes to the others by weight, again and again."""
    out, free = [0.0] * len(sizes), set(range(len(sizes)))
    while free:
        rest = total - sum(out[i] for i in range(len(sizes)) if i not in free)
        w = sum(weights[i] for i in sorted(free))
        over = [i for i in sorted(free) if rest * weights[i] / w > cap * sizes[i]]
        if not over:
            for i in free:
                out[i] = rest * weights[i] / w
            break
        for i in over:
            out[i] = cap * sizes[i]
            free.discard(i)
    return out


def copies(rows: DataFrame, id_col: str, source_col: str, size_col: str, share: float = 1.5, weights: tuple[float, ...] = WEIGHTS, cap: float = 2.0, seed: int = 7, max_sources: int = 100_000) -> DataFrame:
    """rows with source_size, target and copies: how often the mix takes each row.

    Every row of a source has the same expected copies, target / source_size. Within the source the rows go by falling size,
    then by a seeded hash of the id (so what is taken lies within about the largest size of the target); the prefix sums
    of expected copies plus one random offset cross copies whole numbers at each row. A source whose size is 0 has target 0
    and takes nothing. Null is a source of its own. Up to max_sources totals come to the driver; more is an error."""
    spark = rows.sparkSession
    total = sources(rows, source_col, size_col, max_sources)
    goal = targets([s for _, s, _ in total], [weights[i % len(weights)] for i in range(len(total))], share * sum(s for _, s, _ in total), cap)
    table = spark.createDataFrame([(name, s, float(t), float(t) / s if s else 0.0) for (name, s, _), t in zip(total, goal)], "_source string, source_size long, target double, _rate double")
    offset = F.lit(_uniform(seed))
    ranked = numbered(rows.withColumn("_fall", -F.col(size_col)).withColumn("_hash", F.xxhash64(F.lit(seed), F.col(id_col))), source_col, ["_fall", "_hash"], "_rank", "_group")
    up_to = lambda n: F.floor(n * F.col("_rate") + offset)
    joined = ranked.join(table, F.col(source_col).cast("string").eqNullSafe(F.col("_source")))
    return joined.withColumn("copies", up_to(F.col("_rank") + 1) - up_to(F.col("_rank"))).drop("_fall", "_hash", "_rank", "_group", "_source", "_rate")


def _uniform(seed: int) -> float:
    """A dyadic number in [0, 1), so that sums with whole rates stay exact."""
    return ((seed * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) % (1 << 64) >> 44) / (1 << 20)


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **how) -> DataFrame:
    """The rows of docs, each as often as the mix takes it, with all their columns and no others.

    Nulls in any column, repeated rows and ties are rows like others; rows without words are taken at their source's rate,
    as they don't count. An empty table gives an empty one."""
    rows, rid = with_row_id(docs)
    small = rows.select(F.col(rid).alias("_rid"), F.col(f"`{id_col}`").alias("_id"), F.col(f"`{source_col}`").alias("_src"), n_words(text_col).alias("_size"))
    small = keep(small, "sizes")  # the words are counted once
    taken = copies(small, "_id", "_src", "_size", **how).filter("copies > 0").select(F.col("_rid").alias(rid), F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select(rid)
    return rows.join(taken, rid).select(*[F.col(f"`{c}`") for c in docs.columns])


def digest(docs: DataFrame) -> DataFrame:
    small = keep(docs.select("doc_id", "source", n_words("text").alias("size")), "sizes")  # the words are counted once
    return copies(small, "doc_id", "source", "size").select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies")
