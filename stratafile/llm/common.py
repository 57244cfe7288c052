"""What several operators of this subpackage share: tables, written intermediates, prefix sums, components."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..scratch import BROADCAST_ROWS as BROADCAST_IDS
from ..scratch import few, forget, made, scratch, shared_dir, written

__all__ = ["BROADCAST_IDS", "SPACE", "WORD", "components", "few", "forget", "made", "normal_spaces", "own_prefix", "scratch", "shared_dir", "table", "values", "with_before", "written"]

#: A word: a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: ASCII white space.
SPACE = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def own_prefix(columns: list[str]) -> str:
    """A prefix that no column has, for names that are added to a caller's table."""
    prefix = "_own_"
    while any(c.lower().startswith(prefix) for c in columns):
        prefix = "_" + prefix
    return prefix


def values(column: pa.Array, n: int = 256) -> Iterator:
    """The column's values, a few at a time as Python objects, so that a worker doesn't hold a whole batch of texts twice."""
    for i in range(0, len(column), n):
        yield from column.slice(i, n).to_pylist()


def normal_spaces(text: Column) -> Column:
    """Each run of ASCII white space as one space; null as the empty text."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, " ")


def with_before(df: DataFrame, group: list[str], h: str, ties: list[str], weights: dict[str, Column], rows: int, per_bucket: int = 20_000) -> DataFrame:
    """Adds, for each (name, weight) of weights, the sum of weight over the rows of the same group that come before in the order of (h, ties).

    A group of any size is spread: rows fall into buckets by the leading bits of h, a uniform hash from 0 to 2^63 - 1, so that about per_bucket of the
    `rows` rows share one; buckets are summed before anything is ordered, the sums run over the buckets of a group, and only the
    rows of one bucket meet in a task. group columns must not be null."""
    bits = max(0, (max(rows, 1) // per_bucket).bit_length())
    bucket = F.shiftright(F.col(h), 63 - bits).cast("long") if bits else F.lit(0).cast("long")
    cut = df.withColumn("_b", bucket)
    keys = [*group, "_b"]
    sums = cut.groupBy(*keys).agg(*[F.sum(w).alias(f"_s_{k}") for k, w in weights.items()])
    over = Window.partitionBy(*group).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(*keys, *[F.coalesce(F.sum(f"_s_{k}").over(over), F.lit(0)).alias(f"_o_{k}") for k in weights])
    inside = Window.partitionBy(*keys).orderBy(h, *ties).rowsBetween(Window.unboundedPreceding, -1)
    out = cut.join(starts, keys)
    for k, w in weights.items():
        out = out.withColumn(k, F.col(f"_o_{k}") + F.coalesce(F.sum(w).over(inside), F.lit(0)))
    return out.drop("_b", *[f"_o_{k}" for k in weights])


def components(links: DataFrame, name: str, rounds: int = 60) -> DataFrame:
    """(node, root) for every node of links (a, b: long): root is the smallest node that is reachable.

    Alternating large-star and small-star steps, each an aggregation and a join on node ids; every step's links are written to the
    shared folder. Hubs are summed up by partial aggregation; nothing is collected but a count and a checksum a round."""
    edges = written(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), name)
    # links lessen from round to round, so few are written as few files
    seen, parts = None, edges.count() // 200_000 + 1
    for _ in range(rounds):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.where("m < u").select("u", F.col("m").alias("v"))).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        edges = written(small.coalesce(parts), name)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if now == seen:
            roots = edges.groupBy("u").agg(F.min("v").alias("root")).withColumnRenamed("u", "node")
            return roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())
        seen = now
    raise RuntimeError(f"components did not settle in {rounds} rounds")
