"""Findings of an external lint tool: one JSON object a line."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "type string, path string, size bigint, checksum string, is_original boolean, depth int, inode bigint, disk_id bigint, mtime double"
#: The types that the tool's output may name; any other is `other`.
TYPES = ("duplicate_file", "emptyfile", "emptydir", "badlink", "badids", "nonstripped", "duplicate_dir", "part_of_directory")


def known_type(value: Column) -> Column:
    return F.when(value.isin(*TYPES), value).otherwise("other")


def parse(lines: DataFrame, value: str = "value", lenient: bool = True) -> DataFrame:
    """lines (value) as typed lints. Blank lines and comments (//) are skipped, and lines that aren't an object with type, path and size are dropped.

    lenient: lines of an array ([ and , before, , and ] behind an object) count as objects."""
    text = F.regexp_replace(F.col(value), r"^\s+|\s+$", "")
    text = F.regexp_replace(text, r"^[\[,\s]+|[\],\s]+$", "") if lenient else text
    kept = lines.select(text.alias("_t")).where(F.rlike("_t", F.lit(r"(?s)^\{.*\}$")))
    # inline is a generator: conditions on its columns stay above it, so that each line is parsed once
    parsed = kept.select(F.inline(F.array(F.from_json("_t", SCHEMA)))).where("type is not null and path is not null and size is not null")
    return parsed.withColumn("type", known_type(F.col("type"))).withColumn("is_original", F.coalesce("is_original", F.lit(False)))


def read(spark: SparkSession, path: str, lenient: bool = True) -> DataFrame:
    """The lints of a file in its order, numbered by `ordinal`."""
    lines = spark.read.text(path)
    return parse(lines, lenient=lenient).withColumn("ordinal", F.monotonically_increasing_id())
