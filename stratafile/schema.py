"""Tables of a catalogue: schemas, allowed values, and checks in place of key constraints."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

VERSION = 1

TABLES: dict[str, str] = {
    "drives": "id long, label string, device_id string, device_path string, uuid string, mount_path string, fs_type string, total_bytes long, role string, is_online boolean, is_readonly boolean, backend string, rclone_remote string, scanned_at timestamp, added_at timestamp",
    "files": "id long, drive_id long, path string, abs_path string, filename string, extension string, size_bytes long, md5_hash string, blake3_hash string, created_at timestamp, modified_at timestamp, inode long, device_num long, nlinks int, mime_type string, is_symlink boolean, symlink_target string, git_remote_url string, category string, subcategory string, target_path string, target_drive_id long, priority string, duplicate_group long, is_original boolean, rmlint_type string, status string, migrated_to string, migrated_to_drive long, migrated_at timestamp, verified_hash string, error string, indexed_at timestamp",
    "duplicate_groups": "group_id long, hash string, file_count int, total_waste_bytes long, original_id long, drives_involved array<long>, cross_drive boolean, resolution string",
    "migration_plans": "id long, created_at timestamp, description string, source_drive_id long, target_drive_id long, status string, total_files int, total_bytes long, completed_files int, completed_bytes long",
    "migration_steps": "id long, plan_id long, file_id long, action string, source_path string, source_drive_id long, dest_path string, dest_drive_id long, status string, pre_hash string, post_hash string, executed_at timestamp, error string, step_order int",
    "audit_log": "id long, timestamp timestamp, action string, file_id long, plan_id long, drive_id long, details string, agent_mode string",
    "schema_version": "version int",
}

#: Allowed values, the default of a reader first where there is one.
ENUMS: dict[str, tuple[str, ...]] = {
    "role": ("source", "target", "backup", "offload"),
    "backend": ("local", "rclone"),
    "priority": ("normal", "critical", "low", "trash"),
    "file_status": ("indexed", "classified", "planned", "migrating", "verified", "source_removed"),
    "plan_status": ("draft", "approved", "in_progress", "completed", "aborted"),
    "step_action": ("copy", "move", "delete", "hardlink", "symlink"),
    "step_status": ("pending", "in_progress", "completed", "failed", "rolled_back"),
}
ENUM_COLUMNS = {("drives", "role"): "role", ("drives", "backend"): "backend", ("files", "priority"): "priority", ("files", "status"): "file_status", ("migration_plans", "status"): "plan_status", ("migration_steps", "action"): "step_action", ("migration_steps", "status"): "step_status"}
KEYS = {"drives": [["id"], ["label"]], "files": [["id"], ["drive_id", "path"]], "duplicate_groups": [["group_id"]], "migration_plans": [["id"]], "migration_steps": [["id"]], "audit_log": [["id"]]}
REFERENCES = [("files", "drive_id", "drives", "id"), ("files", "duplicate_group", "duplicate_groups", "group_id"), ("duplicate_groups", "original_id", "files", "id"), ("migration_plans", "source_drive_id", "drives", "id"), ("migration_plans", "target_drive_id", "drives", "id"), ("migration_steps", "plan_id", "migration_plans", "id"), ("migration_steps", "file_id", "files", "id")]


def struct(table: str) -> StructType:
    return StructType.fromDDL(TABLES[table])


def empty(spark: SparkSession, table: str) -> DataFrame:
    return spark.createDataFrame([], struct(table))


def conform(df: DataFrame, table: str) -> DataFrame:
    """df with the table's columns in their order and types; columns it lacks are null."""
    have = set(df.columns)
    return df.select(*[(F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in struct(table)])


def known_value(column: Column, enum: str, default: str | None = None) -> Column:
    """The lower-case value if it is allowed, else the default."""
    low = F.lower(column)
    return F.when(low.isin(*ENUMS[enum]), low).otherwise(F.lit(default))


def validate(tables: dict[str, DataFrame]) -> DataFrame:
    """(check, table, columns, violations) of the key, reference and value checks that fail over the given tables."""
    found = []

    def add(df: DataFrame, check: str, table: str, columns: str) -> None:
        found.append(df.agg(F.count("*").alias("violations")).select(F.lit(check).alias("check"), F.lit(table).alias("table"), F.lit(columns).alias("columns"), "violations"))

    for table, keys in KEYS.items():
        for key in keys if table in tables else []:
            add(tables[table].groupBy(*key).count().where("count > 1"), "unique", table, ",".join(key))
    for table, column, other, key in REFERENCES:
        if table in tables and other in tables:
            have = tables[other].select(F.col(key).alias(column)).distinct()
            add(tables[table].where(F.col(column).isNotNull()).join(have, column, "left_anti"), "reference", table, column)
    for (table, column), enum in ENUM_COLUMNS.items():
        if table in tables:
            add(tables[table].where(F.col(column).isNull() | ~F.col(column).isin(*ENUMS[enum])), "value", table, column)
    return reduce(DataFrame.unionByName, found).where("violations > 0")
