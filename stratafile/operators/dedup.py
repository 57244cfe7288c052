"""Exact duplicates of the catalogue: groups, originals, assignments, statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import conform

ALGORITHMS = {"md5": "md5_hash", "blake3": "blake3_hash"}


def hash_column(algorithm: str) -> str:
    from ..errors import ConfigError

    if algorithm.lower() not in ALGORITHMS:
        raise ConfigError(f"unknown algorithm {algorithm!r}: md5 or blake3")
    return ALGORITHMS[algorithm.lower()]


def duplicate_groups(files: DataFrame, algorithm: str = "blake3", drive: int | None = None, min_size: int = 0) -> DataFrame:
    """Groups of two or more files with one hash. The file with the smallest id is the original and names the group; the others' bytes are wasted.

    One aggregation by hash, partial before the shuffle, so that the hash of many empty files is no hot spot. drive: among the files of one
    drive only; min_size: leave smaller files out."""
    column = hash_column(algorithm)
    rows = files.where(F.col(column).isNotNull() & (F.col("size_bytes") >= min_size))
    if drive is not None:
        rows = rows.where(F.col("drive_id") == drive)
    found = rows.groupBy(F.col(column).alias("hash")).agg(
        F.count("*").cast("int").alias("file_count"), (F.sum("size_bytes") - F.min_by("size_bytes", "id")).cast("long").alias("total_waste_bytes"), F.min("id").alias("original_id"),
        F.sort_array(F.collect_set("drive_id")).alias("drives_involved"),
    )
    found = found.where("file_count >= 2").withColumn("cross_drive", F.size("drives_involved") > 1).withColumn("group_id", F.col("original_id"))
    return conform(found, "duplicate_groups")


def assign_groups(files: DataFrame, groups: DataFrame, algorithm: str = "blake3") -> DataFrame:
    """files with duplicate_group and is_original set from groups, and cleared where there is none."""
    column = hash_column(algorithm)
    by = groups.select(F.col("hash").alias(column), F.col("group_id").alias("_group"), F.col("original_id").alias("_original"))
    out = files.join(by, column, "left")
    out = out.withColumn("duplicate_group", F.col("_group")).withColumn("is_original", F.coalesce(F.col("id") == F.col("_original"), F.lit(False)))
    return out.select(*files.columns)


def refresh(files: DataFrame, algorithm: str = "blake3", **options) -> tuple[DataFrame, DataFrame]:
    """(files with assignments, groups) from hashes that are there."""
    groups = duplicate_groups(files, algorithm, **options)
    return assign_groups(files, groups, algorithm), groups


def set_resolution(groups: DataFrame, group_id: int, resolution: str) -> DataFrame:
    return groups.withColumn("resolution", F.when(F.col("group_id") == group_id, resolution).otherwise(F.col("resolution")))


def clear_assignments(files: DataFrame) -> DataFrame:
    return files.withColumn("duplicate_group", F.lit(None).cast("long")).withColumn("is_original", F.lit(False))


def duplicate_statistics(groups: DataFrame) -> DataFrame:
    """One row: groups, files in them, bytes wasted, groups over several drives."""
    return groups.agg(
        F.count("*").alias("group_count"), F.coalesce(F.sum("file_count"), F.lit(0)).cast("long").alias("total_duplicate_files"), F.coalesce(F.sum("total_waste_bytes"), F.lit(0)).cast("long").alias("total_waste_bytes"),
        F.count_if("cross_drive").alias("cross_drive_groups"),
    )


def by_waste(groups: DataFrame, limit: int | None = None) -> DataFrame:
    out = groups.orderBy(F.desc("total_waste_bytes"), "group_id")
    return out.limit(limit) if limit is not None else out


def cross_drive_groups(groups: DataFrame) -> DataFrame:
    return by_waste(groups.where("cross_drive"))


def same_drive_groups(groups: DataFrame, min_size: int | None = None, limit: int | None = 50) -> DataFrame:
    """Groups within one drive that waste at least min_size bytes."""
    rows = groups.where(~F.col("cross_drive"))
    return by_waste(rows.where(F.col("total_waste_bytes") >= min_size) if min_size is not None else rows, limit)


def groups_touching(groups: DataFrame, drive_id: int, limit: int | None = 50) -> DataFrame:
    """Groups with a file on the drive."""
    return by_waste(groups.where(F.array_contains("drives_involved", F.lit(drive_id).cast("long"))), limit)


def same_drive_copies(groups: DataFrame, files: DataFrame) -> DataFrame:
    """Copies of each group that lies on one drive."""
    rows = groups.where(~F.col("cross_drive")).join(files.select("duplicate_group"), F.col("group_id") == F.col("duplicate_group"))
    return rows.groupBy("group_id", "hash", "total_waste_bytes").agg(F.count("*").alias("copies"))


def original_of(files: DataFrame, group_id: int, original_id: int | None = None) -> DataFrame:
    """The group's original: the named file, or the member that is marked."""
    members = files.where(F.col("duplicate_group") == group_id)
    return files.where(F.col("id") == original_id) if original_id is not None else members.where("is_original").orderBy("id").limit(1)
