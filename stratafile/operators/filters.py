"""Selections from catalogue tables. Each is a filter that reaches the scan, with a total order where the result has one."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import DriveNotFound
from ..functions.formats import contains_like, ids_from_list

LARGE = 100 * 1024 * 1024


def _all(tests: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, tests, F.lit(True))


def _top(df: DataFrame, limit: int | None) -> DataFrame:
    return df if limit is None else df.limit(limit)


def by_id(df: DataFrame, id_: int) -> DataFrame:
    return df.where(F.col("id") == id_)


def by_abs_path(files: DataFrame, path: str) -> DataFrame:
    return files.where(F.col("abs_path") == path).orderBy("id").limit(1)


def by_hash(files: DataFrame, value: str) -> DataFrame:
    """Files whose MD5 or BLAKE3 is the value."""
    return files.where((F.col("md5_hash") == value) | (F.col("blake3_hash") == value))


def by_drive(files: DataFrame, drive_id: int) -> DataFrame:
    return files.where(F.col("drive_id") == drive_id).orderBy("path", "id")


def by_category(files: DataFrame, category: str, drive_id: int | None = None, limit: int | None = None) -> DataFrame:
    tests = [F.col("category") == category] + ([F.col("drive_id") == drive_id] if drive_id is not None else [])
    rows = files.where(_all(tests))
    return rows.orderBy("id").limit(limit) if limit is not None else rows


def group_members(files: DataFrame, group_id: int) -> DataFrame:
    return files.where(F.col("duplicate_group") == group_id)


def unclassified(files: DataFrame, drive_id: int | None = None, limit: int | None = None) -> DataFrame:
    """Indexed files without a category, largest first."""
    tests = [F.col("category").isNull(), F.col("status") == "indexed"] + ([F.col("drive_id") == drive_id] if drive_id is not None else [])
    return _top(files.where(_all(tests)).orderBy(F.desc("size_bytes"), "id"), limit)


def large_files(files: DataFrame, min_size: int = LARGE, limit: int = 50) -> DataFrame:
    rows = files.where(F.col("size_bytes") >= min_size).select("id", "drive_id", "path", "size_bytes", "category", "priority", "status")
    return rows.orderBy(F.desc("size_bytes"), "id").limit(limit)


def search(files: DataFrame, category: str | None = None, extension: str | None = None, min_size: int | None = None, path_contains: str | None = None, drive_id: int | None = None, limit: int | None = None) -> DataFrame:
    """Files that meet all the given conditions, largest first. The extension's case counts, that of path_contains doesn't."""
    tests = []
    if category is not None:
        tests.append(F.col("category") == category)
    if extension is not None:
        tests.append(F.col("extension") == extension)
    if min_size is not None:
        tests.append(F.col("size_bytes") >= min_size)
    if path_contains is not None:
        tests.append(contains_like(F.col("path"), path_contains))
    if drive_id is not None:
        tests.append(F.col("drive_id") == drive_id)
    return _top(files.where(_all(tests)).orderBy(F.desc("size_bytes"), "id"), limit)


def in_scope(files: DataFrame, include_drives=(), exclude_drives=(), include_paths=(), exclude_paths=()) -> DataFrame:
    """Files of the included drives (all, if none is) that no excluded drive holds, and whose path starts with an included prefix (any, if none is
    given) and no excluded one. Drives by id; prefixes are strings, not folders."""
    tests = []
    starts = lambda paths: reduce(lambda a, b: a | b, [F.coalesce(F.col("abs_path").startswith(p), F.lit(False)) for p in paths])
    if include_drives:
        tests.append(F.col("drive_id").isin(*include_drives))
    if exclude_drives:
        tests.append(~F.col("drive_id").isin(*exclude_drives))
    if include_paths:
        tests.append(starts(include_paths))
    if exclude_paths:
        tests.append(~starts(exclude_paths))
    return files.where(_all(tests))


def plan_candidates(files: DataFrame, drives: DataFrame, category: str, source: str | None = None, include=(), exclude=()) -> DataFrame:
    """Files of a category on the source drive; without one on the included drives but the excluded; without those on all but the excluded. By label."""
    rows = files.where(F.col("category") == category)
    labels = drives.select(F.col("id").alias("drive_id"), "label")
    if source is not None:
        drive_id(drives, source)
        return rows.join(F.broadcast(labels.where(F.col("label") == source)), "drive_id", "left_semi")
    if include:
        wanted = [x for x in include if x not in exclude]
        for label in wanted:
            drive_id(drives, label)
        return rows.join(F.broadcast(labels.where(F.col("label").isin(*wanted))), "drive_id", "left_semi") if wanted else rows.limit(0)
    return rows.join(F.broadcast(labels.where(F.col("label").isin(*exclude))), "drive_id", "left_anti") if exclude else rows


def drive_by_label(drives: DataFrame, label: str) -> DataFrame:
    return drives.where(F.col("label") == label)


def drive_id(drives: DataFrame, label: str) -> int:
    """The id of a label, which a drive must have."""
    row = drive_by_label(drives, label).select("id").first()
    if row is None:
        raise DriveNotFound(label)
    return row["id"]


def without_drive(drives: DataFrame, label: str) -> DataFrame:
    """All drives but that of the label; the files of a drive stay in the catalogue."""
    return drives.where(F.col("label") != label)


def list_drives(drives: DataFrame, online: bool | None = None) -> DataFrame:
    rows = drives if online is None else drives.where(F.col("is_online") == online)
    return rows.orderBy("added_at", "id")


def audit_entries(audit: DataFrame, plan_id: int | None = None, file_id: int | None = None, limit: int | None = None) -> DataFrame:
    """Entries of a plan, a file, both or all, newest first."""
    tests = ([F.col("plan_id") == plan_id] if plan_id is not None else []) + ([F.col("file_id") == file_id] if file_id is not None else [])
    return _top(audit.where(_all(tests)).orderBy(F.desc("timestamp"), F.desc("id")), limit)


def plans_by_status(plans: DataFrame, status: str | None = None) -> DataFrame:
    rows = plans if status is None else plans.where(F.col("status") == status)
    return rows.orderBy(F.desc("created_at"), F.desc("id"))


def steps_of(steps: DataFrame, plan_id: int, pending_only: bool = False) -> DataFrame:
    rows = steps.where(F.col("plan_id") == plan_id)
    return (rows.where(F.col("status") == "pending") if pending_only else rows).orderBy("step_order")


def selected_ids(df: DataFrame, text: str) -> DataFrame:
    """Rows whose id a comma list names; parts that are no number are left out."""
    ids = df.sparkSession.range(1).select(F.explode(ids_from_list(F.lit(text))).alias("id")).distinct()
    return df.join(F.broadcast(ids), "id", "left_semi")
