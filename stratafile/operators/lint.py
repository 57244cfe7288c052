"""Lint findings against the catalogue: groups, statistics, and the import."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import conform


def lint_groups(lints: DataFrame) -> DataFrame:
    """Duplicate findings with one checksum, two or more: size is that of the first, original the path of the first that is flagged. lints are ordered by `ordinal`."""
    rows = lints.where("type = 'duplicate_file' and checksum is not null").groupBy("checksum").agg(
        F.count("*").alias("file_count"), F.min_by("size", "ordinal").alias("total_size"), F.min_by("path", F.when(F.col("is_original"), F.col("ordinal"))).alias("original"),
        F.count_distinct("disk_id").alias("disks"), F.count_if("is_original").alias("flagged"),
    )
    return rows.where("file_count >= 2").withColumn("original", F.when(F.col("flagged") > 0, F.col("original"))).drop("flagged")


def lint_statistics(lints: DataFrame) -> DataFrame:
    """One row: duplicate files, groups of two or more, bytes of those that are no originals, empty files and folders, others."""
    kind = F.col("type")
    dup = kind == "duplicate_file"
    counts = lints.agg(
        F.count_if(dup).alias("duplicate_files"), F.coalesce(F.sum(F.when(dup & ~F.col("is_original"), F.col("size"))), F.lit(0)).cast("long").alias("duplicate_bytes"), F.count_if(kind == "emptyfile").alias("empty_files"),
        F.count_if(kind == "emptydir").alias("empty_dirs"), F.count_if(~kind.isin("duplicate_file", "emptyfile", "emptydir")).alias("other_lints"),
    )
    return counts.crossJoin(lint_groups(lints).agg(F.count("*").alias("duplicate_groups")))


def has_cross_drive(lints: DataFrame) -> DataFrame:
    """One row: whether any group lies on more than one disk; findings without a disk don't count."""
    return lint_groups(lints).agg(F.coalesce(F.bool_or(F.col("disks") > 1), F.lit(False)).alias("cross_drive"))


def matched(lints: DataFrame, files: DataFrame) -> DataFrame:
    """lints with file_id, drive_id and file_size of the file at their path, null where there is none."""
    at = files.groupBy(F.col("abs_path").alias("path")).agg(F.min_by(F.struct("id", "drive_id", "size_bytes"), "id").alias("f"))
    return lints.join(at, "path", "left").select(*lints.columns, F.col("f.id").alias("file_id"), F.col("f.drive_id").alias("drive_id"), F.col("f.size_bytes").alias("file_size"))


def import_groups(found: DataFrame) -> DataFrame:
    """Duplicate groups from matched lints; of a group at least two members must be in the catalogue. The original is the last that is flagged; without
    one all members' bytes count as wasted. A file counts once, whatever findings name it."""
    dup = found.where("type = 'duplicate_file' and checksum is not null and file_id is not null")
    once = dup.groupBy("checksum", "file_id").agg(F.first("drive_id").alias("drive_id"), F.first("file_size").alias("size"), F.max(F.when(F.col("is_original"), F.col("ordinal"))).alias("flag"))
    rows = once.groupBy(F.col("checksum").alias("hash")).agg(
        F.count("*").cast("int").alias("file_count"), F.max_by("file_id", "flag").alias("original_id"), F.max("flag").alias("flag"), F.sum("size").alias("all_bytes"), F.max_by("size", "flag").alias("own"),
        F.sort_array(F.collect_set("drive_id")).alias("drives_involved"), F.min("file_id").alias("group_id"),
    )
    rows = rows.where("file_count >= 2").withColumn("original_id", F.when(F.col("flag").isNotNull(), F.col("original_id")))
    rows = rows.withColumn("total_waste_bytes", F.when(F.col("flag").isNull(), F.col("all_bytes")).otherwise(F.col("all_bytes") - F.col("own"))).withColumn("cross_drive", F.size("drives_involved") > 1)
    return conform(rows, "duplicate_groups")


TRASH_TYPES = ("emptyfile", "emptydir", "badlink")


def import_lints(lints: DataFrame, files: DataFrame, groups: DataFrame | None = None, apply_trash: bool = False, clear_existing: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(files, groups, counters) after the import. The last finding of a file gives its lint type; apply_trash: files without a category that a
    finding names empty or broken become trash; clear_existing: earlier groups and assignments go first."""
    found = matched(lints, files)
    new = import_groups(found)
    last = found.where("file_id is not null").groupBy("file_id").agg(F.max_by("type", "ordinal").alias("_type"), F.bool_or(F.col("type").isin(*TRASH_TYPES)).alias("_trash"))
    members = found.where("type = 'duplicate_file' and checksum is not null and file_id is not null").join(new.select(F.col("hash").alias("checksum"), "group_id", "original_id"), "checksum")
    members = members.groupBy("file_id").agg(F.max_by(F.struct("group_id", "original_id"), "ordinal").alias("_g"))
    out = files.join(last, F.col("id") == last["file_id"], "left").drop("file_id").join(members, F.col("id") == members["file_id"], "left").drop("file_id")
    trash = F.lit(apply_trash) & F.coalesce("_trash", F.lit(False)) & F.col("category").isNull()
    in_group = F.col("_g").isNotNull()
    old_group, old_flag = (F.lit(None).cast("long"), F.lit(False)) if clear_existing else (F.col("duplicate_group"), F.col("is_original"))
    out = out.withColumns({
        "rmlint_type": F.coalesce("_type", "rmlint_type"), "priority": F.when(trash, "trash").otherwise(F.col("priority")), "status": F.when(trash, "classified").otherwise(F.col("status")), "category": F.when(trash, "trash").otherwise(F.col("category")),
        "duplicate_group": F.when(in_group, F.col("_g.group_id")).otherwise(old_group), "is_original": F.when(in_group, F.coalesce(F.col("_g.original_id") == F.col("id"), F.lit(False))).otherwise(old_flag),
    }).select(*files.columns)
    all_groups = new if groups is None or clear_existing else groups.join(new.select("group_id"), "group_id", "left_anti").select(*new.columns).unionByName(new)
    hit = F.col("file_id").isNotNull()
    marked = lambda t: (F.count_if(hit & (F.col("type") == t)) if apply_trash else F.lit(0).cast("long"))
    counters = found.agg(
        F.count("*").alias("total_lints"), F.count_if(hit).alias("matched_files"), F.count_if(~hit).alias("skipped_lints"), marked("emptyfile").alias("empty_files_marked"), marked("emptydir").alias("empty_dirs_marked"), marked("badlink").alias("bad_links_marked"),
    ).crossJoin(new.agg(F.count("*").alias("duplicate_groups_created"), F.coalesce(F.sum("file_count"), F.lit(0)).alias("duplicate_files_assigned")))
    return out, all_groups, counters


