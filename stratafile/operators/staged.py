"""Duplicates found in stages, so that few files are read: files of a size that no other has can't be copies; of the others the first and last blocks are read; only those that still
collide are hashed whole; and their members can be compared byte by byte with the original.

Each stage is an aggregation of keys and a semi-join with those that occur twice, and is written before the next one reads files. Keys that many files share, such as the size 0, are summed up where the rows are; the
join keeps rows only, so Spark may split such a key."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import written


def colliding(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The rows that share all keys with another row; null keys collide with nothing."""
    shared = rows.groupBy(*keys).agg(F.count("*").alias("_n")).where("_n > 1").select(*keys)
    return rows.join(shared, keys, "left_semi").select(*rows.columns)


@dataclass
class Stages:
    """What each stage let through; read_bytes is what it read of each file."""

    by_size: DataFrame
    by_ends: DataFrame
    by_hash: DataFrame

    def counts(self) -> DataFrame:
        """(stage, files, read_bytes): the files that were looked at in a stage and the bytes that were read for it."""
        one = lambda name, rows, read: rows.agg(F.lit(name).alias("stage"), F.count("*").alias("files"), F.coalesce(F.sum(read), F.lit(0)).cast("long").alias("read_bytes"))
        fresh = self.by_hash.where("_fresh")
        return one("size", self.by_size, F.lit(0)).unionByName(one("ends", self.by_ends, F.col("read_bytes"))).unionByName(one("hash", fresh, F.col("size_bytes")))


def staged(files: DataFrame, hash_column: str, ends: Callable[[DataFrame], DataFrame], full: Callable[[DataFrame], DataFrame]) -> Stages:
    """The stages over files (size_bytes, hash_column, ...). ends: adds `ends`, a digest of the first and last blocks, null if the file can't be read, and `read_bytes`;
    full: fills hash_column. Files that have a hash go through the first two stages too, as others may be their copies, but are not hashed again."""
    by_size = written(colliding(files, ["size_bytes"]), "staged-size")
    by_ends = written(ends(by_size), "staged-ends")
    left = colliding(by_ends.where("ends is not null"), ["size_bytes", "ends"])
    known = left.where(F.col(hash_column).isNotNull()).withColumn("_fresh", F.lit(False))
    fresh = full(left.where(F.col(hash_column).isNull())).select(*left.columns).withColumn("_fresh", F.lit(True))
    return Stages(by_size, by_ends, written(known.unionByName(fresh), "staged-hash"))


def with_staged_hashes(files: DataFrame, hash_column: str, ends: Callable[[DataFrame], DataFrame], full: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """files with hash_column filled where a file may have a copy; the others keep what they have. Links are not read."""
    link = F.coalesce(F.col("is_symlink"), F.lit(False))
    found = staged(files.where(~link), hash_column, ends, full).by_hash.where("_fresh")
    fresh = found.select("id", F.col(hash_column).alias("_hash"))
    return files.join(fresh, "id", "left").withColumn(hash_column, F.coalesce(hash_column, "_hash")).select(*files.columns)
