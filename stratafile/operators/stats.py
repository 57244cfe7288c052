"""Counts and sums over the catalogue, each in one pass, not one query for each drive or status."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _sum(column, when=None):
    value = F.col(column) if isinstance(column, str) else column
    return F.coalesce(F.sum(F.when(when, value) if when is not None else value), F.lit(0)).cast("long")


def category_statistics(files: DataFrame) -> DataFrame:
    rows = files.where("category is not null").groupBy("category").agg(F.count("*").alias("file_count"), _sum("size_bytes").alias("total_bytes"))
    return rows.orderBy(F.desc("total_bytes"), "category")


def drive_statistics(files: DataFrame) -> DataFrame:
    """For each drive: files, bytes and distinct duplicate groups without the removed, and duplicates that are no originals, with their bytes."""
    live = F.col("status") != "source_removed"
    copy = F.col("duplicate_group").isNotNull() & ~F.col("is_original")
    return files.groupBy("drive_id").agg(
        F.count_if(live).alias("file_count"), _sum("size_bytes", live).alias("total_bytes"), F.count_distinct(F.when(live, F.col("duplicate_group"))).alias("duplicate_groups"),
        F.count_if(copy).alias("duplicate_file_count"), _sum("size_bytes", copy).alias("duplicate_waste_bytes"),
    )


def drive_counts(drives: DataFrame) -> DataFrame:
    return drives.agg(F.count("*").alias("total"), F.count_if("is_online").alias("online"), F.count_if(~F.col("is_online")).alias("offline"))


def file_totals(files: DataFrame) -> DataFrame:
    return files.where("status <> 'source_removed'").agg(F.count("*").alias("total_files"), _sum("size_bytes").alias("total_bytes"))


def classification_summary(files: DataFrame) -> DataFrame:
    """Files with and without a category, and categories, without the removed files."""
    return files.where("status <> 'source_removed'").agg(F.count_if(F.col("category").isNotNull()).alias("classified"), F.count_if(F.col("category").isNull()).alias("unclassified"), F.count_distinct("category").alias("categories"))


def plan_status_counts(plans: DataFrame) -> DataFrame:
    """One row with the plans of each status that is still of interest."""
    return plans.agg(*[F.count_if(F.col("status") == s).alias(s) for s in ("draft", "approved", "in_progress", "completed")])


def status_summary(files: DataFrame, drives: DataFrame, groups: DataFrame, plans: DataFrame) -> DataFrame:
    """One row of everything that a status report shows."""
    from .dedup import duplicate_statistics

    parts = [drive_counts(drives).select(F.col("total").alias("drives"), "online", "offline"), file_totals(files), classification_summary(files), duplicate_statistics(groups), plan_status_counts(plans)]
    out = parts[0]
    for p in parts[1:]:  # one row each
        out = out.crossJoin(p)
    return out


def space_by_drive(drives: DataFrame, files: DataFrame) -> DataFrame:
    """Capacity, used bytes, files and waste of every drive, in the order they were added."""
    s = drive_statistics(files)
    rows = drives.join(s, F.col("id") == F.col("drive_id"), "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return rows.select("id", "label", "role", drives["total_bytes"].alias("capacity_bytes"), F.coalesce(s["total_bytes"], F.lit(0)).alias("used_bytes"), zero("file_count"), zero("duplicate_waste_bytes"))


def files_per_drive(drives: DataFrame, files: DataFrame) -> DataFrame:
    counts = files.groupBy("drive_id").agg(F.count("*").alias("n"))
    return drives.join(counts, F.col("id") == F.col("drive_id"), "left").select("id", "label", F.coalesce("n", F.lit(0)).alias("file_count"))


def migration_summary(plans: DataFrame, moved: str = "completed_bytes") -> DataFrame:
    """Plans, completed plans, and the bytes of the completed: what was done (completed_bytes) or planned (total_bytes)."""
    done = F.col("status") == "completed"
    return plans.agg(F.count("*").alias("total_plans"), F.count_if(done).alias("completed_plans"), _sum(moved, done).alias("migrated_bytes"))


def verified_counts(files: DataFrame, steps: DataFrame | None = None) -> DataFrame:
    """Files that are verified or classified; of given steps those with a hash after the action, and the failed."""
    if steps is not None:
        return steps.agg(F.count_if(F.col("post_hash").isNotNull()).alias("verified"), F.count_if(F.col("status") == "failed").alias("failed"))
    return files.agg(F.count_if(F.col("status").isin("verified", "classified")).alias("verified"))


def verify_outcomes(checked: DataFrame) -> DataFrame:
    """(outcome, files) from (expected, actual, error, exists): verified, mismatch, missing or error."""
    outcome = (
        F.when(~F.col("exists"), "missing").when(F.col("error").isNotNull(), "error").when(F.col("expected").isNull(), "unhashed").when(F.lower("expected") == F.lower("actual"), "verified").otherwise("mismatch")
    )
    return checked.groupBy(outcome.alias("outcome")).agg(F.count("*").alias("files"))


def scan_counts(entries: DataFrame) -> DataFrame:
    """Counters of a scan, from its entries."""
    file = F.col("kind") == "file"
    return entries.agg(
        F.count_if(file).alias("files_scanned"), F.count_if(F.col("kind") == "dir").alias("dirs_scanned"), _sum("size_bytes", file).alias("bytes_scanned"), F.count_if(file & F.col("is_symlink")).alias("symlinks_found"),
        F.count_if(F.col("git_remote_url").isNotNull()).alias("git_repos_found"), F.count_if(F.col("kind") == "error").alias("errors"),
    )


def pending_bytes(files: DataFrame, steps: DataFrame) -> DataFrame:
    """Bytes of files that are trash, and of pending copies and moves."""
    trash = files.agg(_sum("size_bytes", F.col("priority") == "trash").alias("trash_bytes"))
    moves = steps.where("status = 'pending' and action in ('copy', 'move')").join(files.select(F.col("id").alias("file_id"), "size_bytes"), "file_id").agg(_sum("size_bytes").alias("pending_move_bytes"))
    return trash.crossJoin(moves)
