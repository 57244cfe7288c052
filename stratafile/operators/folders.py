"""Duplicate folders: a digest for every folder from what lies in it, from the deepest level up, and the largest subtrees that occur twice.

A folder's digest stands for the bag of its children's digests, a file's being its hash; names don't count, only content and nesting. The bag is hashed by sums: each child's SHA-256 is cut into four
numbers, which are added up (a sum takes any order and any number of children, so a folder of any size is summed where its rows are), and the sums with the number of children are hashed again. A level of the
tree is one aggregation. A folder that holds a file without a hash, at any depth, has no digest and no copy.

Of folders with equal digests those groups are kept that are no mere part of larger ones: a group goes if the parent of each of its members has a copy, too."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..scratch import written

#: Hexadecimal digits of each number that a digest is cut into.
DIGITS, NUMBERS = 15, 4


def parent(path: Column) -> Column:
    """The folder that a path lies in; the empty path is the root, and null is above it."""
    cut = F.regexp_extract(path, "^(.*)/[^/]*$", 1)
    return F.when(path != "", cut)


def depth(path: Column) -> Column:
    return F.when(path == "", 0).otherwise(F.size(F.split(path, "/")))


def folder_digests(files: DataFrame, hash_column: str = "blake3_hash") -> DataFrame:
    """(drive_id, path, digest, files, bytes) of every folder that files (drive_id, path, size_bytes, hash) lie in; digest is null if a file below has no hash."""
    leaves = files.select("drive_id", "path", F.lower(F.col(hash_column)).alias("digest"), F.lit(1).cast("long").alias("files"), F.coalesce("size_bytes", F.lit(0)).cast("long").alias("bytes"), depth(F.col("path")).alias("depth"))
    leaves = written(leaves.where("path is not null and path <> ''"), "folders-files")
    deepest = leaves.agg(F.max("depth")).first()[0] or 0
    every, below = None, None
    for d in range(deepest, 0, -1):
        rows = leaves.where(F.col("depth") == d).drop("depth")
        rows = rows if below is None else rows.unionByName(below)
        child = F.sha2(F.concat(F.lit("child:"), "digest"), 256)
        numbers = [F.sum(F.conv(F.substring(child, 1 + DIGITS * i, DIGITS), 16, 10).cast("decimal(20,0)")).cast("decimal(38,0)") for i in range(NUMBERS)]
        of = rows.withColumn("path", parent(F.col("path"))).groupBy("drive_id", "path").agg(*[n.alias(f"_{i}") for i, n in enumerate(numbers)], F.count("*").alias("_n"), F.count("digest").alias("_known"), F.sum("files").alias("files"), F.sum("bytes").alias("bytes"))
        text = F.concat_ws(",", F.lit("folder"), F.col("_n").cast("string"), *[F.col(f"_{i}").cast("string") for i in range(NUMBERS)])
        below = written(of.select("drive_id", "path", F.when(F.col("_n") == F.col("_known"), F.sha2(text, 256)).alias("digest"), "files", "bytes"), "folders-level")
        every = below if every is None else every.unionByName(below)
    return every if every is not None else files.sparkSession.createDataFrame([], "drive_id long, path string, digest string, files long, bytes long")


def duplicate_folders(files: DataFrame, hash_column: str = "blake3_hash", min_files: int = 1) -> DataFrame:
    """(digest, drive_id, path, files, bytes, copies, nested) of the folders whose content occurs elsewhere, but for groups that are parts of larger ones only; nested: the folder's parent has a copy as well."""
    folders = written(folder_digests(files, hash_column), "folders")
    groups = folders.where(F.col("digest").isNotNull() & (F.col("files") >= min_files)).groupBy("digest").agg(F.count("*").alias("copies")).where("copies > 1")
    twice = written(folders.join(groups, "digest"), "folders-twice")
    above = twice.select("drive_id", F.col("path").alias("_parent"), F.lit(True).alias("_nested"))
    marked = twice.withColumn("_parent", parent(F.col("path"))).join(above, ["drive_id", "_parent"], "left").withColumn("nested", F.coalesce("_nested", F.lit(False)))
    marked = written(marked.select("digest", "drive_id", "path", "files", "bytes", "copies", "nested"), "folders-marked")
    return marked.join(marked.where("not nested").select("digest").distinct(), "digest", "left_semi").select(*marked.columns)


def folder_of_files(files: DataFrame, folders: DataFrame) -> DataFrame:
    """(id, folder, digest) of the files that lie in one of the folders (drive_id, path, digest) at any depth; the topmost folder counts. Each file meets the folders by its own ancestors."""
    up = F.transform(F.sequence(F.lit(1), depth(F.col("path"))), lambda n: F.array_join(F.slice(F.split("path", "/"), F.lit(1), n - 1), "/"))
    ways = files.where("path is not null and path <> ''").select("id", "drive_id", F.explode(up).alias("folder"))
    met = ways.join(folders.select("drive_id", F.col("path").alias("folder"), "digest"), ["drive_id", "folder"])
    return met.groupBy("id").agg(F.min_by(F.struct("folder", "digest"), F.length("folder")).alias("x")).select("id", "x.folder", "x.digest")
