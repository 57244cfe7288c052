"""An index for substring searches: which rows hold which three characters in a row, so that a search reads the postings of a few rare trigrams and the rows they name, not the table.

Postings are rows (bucket, gram, id), a row for each distinct trigram of a lower-cased text, in folders by bucket and sorted by gram within a file, so that a search opens one folder for each trigram
and Parquet's statistics skip the rest. A trigram of any frequency is many rows, in no list; how often each occurs is a sorted table of its own.

A pattern's literal stretches between its wildcards give the trigrams that a match must hold. The rarest MOST of them are looked up, rows that have all of these are candidates, and the pattern itself decides. Patterns without a
stretch of three characters, or whose rarest trigram is in a large part of the rows, scan."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.formats import contains_like
from ..scratch import few

BUCKETS = 64
#: Trigrams that are looked up for a pattern, at most.
MOST = 4
#: A pattern whose rarest trigram is in more than one in COMMON rows scans.
COMMON = 8


def grams(text: Column) -> Column:
    """The distinct trigrams of a lower-cased text. Arrays of characters are zipped, as an expression within a lambda would be computed again for each element."""
    chars = F.split(F.lower(text), "")
    later = lambda n: F.slice(chars, F.lit(n), F.greatest(F.size(chars), F.lit(1)))
    join = lambda x, y: F.concat(x, y)
    return F.array_distinct(F.filter(F.zip_with(F.zip_with(chars, later(2), join), later(3), join), lambda g: F.length(g) == 3))


def bucket(gram: Column) -> Column:
    return F.pmod(F.xxhash64(gram), F.lit(BUCKETS)).cast("int")


def build(rows: DataFrame, column: str, path: str, id_: str = "id") -> None:
    """Writes the index of a column below path."""
    postings = rows.select(F.col(id_).cast("long").alias("id"), F.explode(grams(F.col(column))).alias("gram")).withColumn("bucket", bucket(F.col("gram")))
    # a bucket's rows go to several tasks, so that a frequent trigram is no single task's
    postings.repartition("bucket", F.pmod("id", F.lit(8))).sortWithinPartitions("bucket", "gram", "id").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/postings")
    read(rows.sparkSession, path).groupBy("gram").agg(F.count("*").alias("n")).orderBy("gram").write.mode("overwrite").parquet(f"{path}/counts")
    rows.agg(F.count("*").alias("rows")).write.mode("overwrite").parquet(f"{path}/size")


def read(spark: SparkSession, path: str) -> DataFrame:
    """The postings."""
    return spark.read.schema("id long, gram string, bucket int").parquet(f"{path}/postings")


def wanted(spark: SparkSession, pattern: str) -> list[str]:
    """The trigrams that a text must hold to match the pattern; % and _ are wildcards."""
    low = spark.range(1).select(F.lower(F.lit(pattern))).first()[0]
    return sorted({piece[i : i + 3] for piece in re.split("[%_]", low) for i in range(len(piece) - 2)})


def candidates(spark: SparkSession, path: str, pattern: str) -> DataFrame | None:
    """(id) of the rows that hold the pattern's rarest trigrams; null if the pattern has to scan."""
    need = wanted(spark, pattern)
    if not need:
        return None
    counts = {r["gram"]: r["n"] for r in spark.read.parquet(f"{path}/counts").where(F.col("gram").isin(need)).collect()}  # as many rows as the pattern has trigrams
    if len(counts) < len(need):
        return spark.createDataFrame([], "id long")  # one of them is nowhere
    rows = spark.read.parquet(f"{path}/size").first()["rows"]
    rarest = sorted(need, key=lambda g: (counts[g], g))[:MOST]
    if counts[rarest[0]] * COMMON > rows:
        return None
    at = [r[0] for r in spark.createDataFrame([(g,) for g in rarest], "gram string").select(bucket(F.col("gram"))).distinct().collect()]
    found = read(spark, path).where(F.col("bucket").isin(at) & F.col("gram").isin(rarest)).groupBy("id").agg(F.count_distinct("gram").alias("n"))
    return found.where(F.col("n") == len(rarest)).select("id")


def search(rows: DataFrame, column: str, path: str, pattern: str, id_: str = "id") -> DataFrame:
    """The rows whose column holds the pattern, letters in either case, as contains_like gives them."""
    found = candidates(rows.sparkSession, path, pattern)
    if found is not None:
        rows = rows.join(few(found.withColumnRenamed("id", id_)), id_, "left_semi").select(*rows.columns)
    return rows.where(contains_like(F.col(column), pattern))
