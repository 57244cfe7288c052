"""Reports: the catalogue's statistics as JSON, CSV or text."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import ConfigError
from ..functions.formats import format_bytes
from . import dedup, stats


def drive_report(drives: DataFrame, files: DataFrame) -> DataFrame:
    """A row for each drive, by label."""
    s = stats.drive_statistics(files)
    rows = drives.join(s, F.col("id") == F.col("drive_id"), "left")
    zero = lambda c: F.coalesce(s[c], F.lit(0)).cast("long")
    return rows.select("label", "role", "is_online", "mount_path", zero("file_count").alias("files"), zero("total_bytes").alias("total_bytes"), zero("duplicate_file_count").alias("duplicate_files"), zero("duplicate_waste_bytes").alias("wasted_bytes")).orderBy("label")


def json_report(drives: DataFrame, files: DataFrame, groups: DataFrame, now: Column) -> DataFrame:
    """One row (report): drives, categories, duplicates and the time as a JSON text."""
    d = drive_report(drives, files)
    dr = d.agg(F.array_sort(F.collect_list(F.struct(*d.columns))).alias("drives"))
    c = stats.category_statistics(files).select("category", F.lit(None).cast("string").alias("subcategory"), "file_count", "total_bytes")
    ca = c.agg(F.collect_list(F.struct(*c.columns)).alias("categories"))
    ca = ca.select(F.array_sort("categories", lambda a, b: F.when(a["total_bytes"] > b["total_bytes"], -1).when(a["total_bytes"] < b["total_bytes"], 1).when(a["category"] < b["category"], -1).otherwise(1)).alias("categories"))
    du = dedup.duplicate_statistics(groups).select(F.struct(F.col("group_count").alias("groups"), F.col("total_duplicate_files").alias("files"), F.col("total_waste_bytes").alias("wasted_bytes"), "cross_drive_groups").alias("duplicates"))
    whole = dr.crossJoin(ca).crossJoin(du).select("drives", "categories", "duplicates", F.date_format(now, "yyyy-MM-dd'T'HH:mm:ssXXX").alias("generated_at"))
    return whole.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("report"))


def csv_report(drives: DataFrame, files: DataFrame) -> DataFrame:
    return drive_report(drives, files).select(F.col("label").alias("Label"), F.col("role").alias("Role"), F.col("files").alias("Files"), F.col("total_bytes").alias("TotalBytes"), F.col("duplicate_files").alias("DuplicateFiles"), F.col("wasted_bytes").alias("WastedBytes"))


def export(kind: str, path: str, drives: DataFrame, files: DataFrame, groups: DataFrame, now: Column) -> None:
    """Writes the report as json (one file) or csv (a folder with one part); the kind's case doesn't count."""
    if kind.lower() == "json":
        Path(path).write_text(json.dumps(json.loads(json_report(drives, files, groups, now).first()["report"]), indent=2, ensure_ascii=False), encoding="utf-8")
    elif kind.lower() == "csv":
        csv_report(drives, files).coalesce(1).write.mode("overwrite").option("header", True).csv(path)
    else:
        raise ConfigError(f"unknown format {kind!r}: json or csv")


def text_report(drives: DataFrame, files: DataFrame, groups: DataFrame, plans: DataFrame) -> str:
    """Drives, categories, duplicates and migrations as text."""
    size = lambda df, c: df.withColumn(c, format_bytes(F.col(c)))
    out = []

    def add(title: str, rows: DataFrame) -> None:
        out.append(f"{title}\n{'-' * len(title)}")
        out.extend(["  ".join(f"{k}: {'-' if v is None else v}" for k, v in r.asDict().items()) for r in rows.collect()] or ["nothing"])
        out.append("")

    add("Drives", size(size(drive_report(drives, files), "total_bytes"), "wasted_bytes"))
    add("Categories", size(stats.category_statistics(files), "total_bytes"))
    add("Duplicates", size(dedup.duplicate_statistics(groups), "total_waste_bytes"))
    add("Migrations", size(stats.migration_summary(plans), "migrated_bytes"))
    return "\n".join(out)
