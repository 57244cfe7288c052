"""Questions across drives. All are equi-joins on hashes or paths; NOT IN is written as an anti join with its null rules made explicit."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import few, written

#: Backups of one path that bit_rot pairs at once: their hashes and ids are about 10 KB, so that Snappy, which looks back 64 KB, finds them again for each source.
BLOCK = 256


def unique_to_drive(files: DataFrame, hash_col: str = "md5_hash", null_is_unique: bool = True) -> DataFrame:
    """Files whose hash is on no other drive; null_is_unique: files without a hash count, too.

    One aggregation finds the hashes that a single drive has, for all drives at once; no list of other drives' hashes is built."""
    known = files.where(F.col(hash_col).isNotNull())
    single = known.groupBy(hash_col).agg(F.min("drive_id").alias("_lo"), F.max("drive_id").alias("_hi")).where("_lo = _hi").select(hash_col)
    out = known.join(single, hash_col, "left_semi")
    return out.select(*files.columns).unionByName(files.where(F.col(hash_col).isNull())) if null_is_unique else out.select(*files.columns)


def backup_unique_counts(files: DataFrame, drives: DataFrame) -> DataFrame:
    """(label, files, bytes) of what is on a backup drive only, for each backup drive; files without MD5 count."""
    backups = drives.where("role = 'backup'").select(F.col("id").alias("drive_id"), "label")
    counts = unique_to_drive(files).groupBy("drive_id").agg(F.count("*").alias("n"), F.sum("size_bytes").alias("b"))
    out = backups.join(counts, "drive_id", "left")
    return out.select("drive_id", "label", F.coalesce("n", F.lit(0)).alias("file_count"), F.coalesce("b", F.lit(0)).alias("total_bytes"))


def backup_unique_files(files: DataFrame, drive_id: int) -> DataFrame:
    """Files of a drive whose BLAKE3 is on no other drive, largest first; files without one are left out."""
    return unique_to_drive(files, "blake3_hash", null_is_unique=False).where(F.col("drive_id") == drive_id).orderBy(F.desc("size_bytes"), "id")


def with_role(files: DataFrame, drives: DataFrame, *roles: str) -> DataFrame:
    """Files on drives of the roles. Drives are few, but their table's size decides how they are joined."""
    return files.join(drives.where(F.col("role").isin(*roles)).select(F.col("id").alias("drive_id")), "drive_id", "left_semi").select(*files.columns)


def expected_backups(files: DataFrame, drives: DataFrame, min_size: int = 0) -> DataFrame:
    """(source_id, backup_id, md5_hash, source_label, backup_label): copies on backup drives of files on source drives.

    All pairs of a hash are asked for; min_size=1 leaves out empty files, which all have one hash."""
    files = files.where(F.col("size_bytes") >= min_size) if min_size else files
    labels = drives.select("id", "label")
    side = lambda role, name: with_role(files, drives, role).where("md5_hash is not null").join(labels.select(F.col("id").alias("drive_id"), F.col("label").alias(f"{name}_label")), "drive_id").select("md5_hash", F.col("id").alias(f"{name}_id"), F.col("path").alias(f"{name}_path"), f"{name}_label")
    return side("source", "source").join(side("backup", "backup"), "md5_hash")


def missing_from_backup(files: DataFrame, drives: DataFrame, null_is_missing: bool = False) -> DataFrame:
    """Files on source drives whose MD5 no backup drive has; null_is_missing: files without MD5 count, too."""
    have = with_role(files, drives, "backup").where("md5_hash is not null").select("md5_hash").distinct()
    rows = with_role(files, drives, "source")
    rows = rows if null_is_missing else rows.where("md5_hash is not null")
    return rows.join(have, "md5_hash", "left_anti").select(*files.columns)


def backup_only(files: DataFrame, drives: DataFrame) -> DataFrame:
    """Files on backup drives whose MD5 no source drive has, largest first."""
    have = with_role(files, drives, "source").where("md5_hash is not null").select("md5_hash").distinct()
    rows = with_role(files, drives, "backup").where("md5_hash is not null").join(have, "md5_hash", "left_anti")
    return rows.select(*files.columns).orderBy(F.desc("size_bytes"), "id")


def trash_on_backup(files: DataFrame, drives: DataFrame) -> DataFrame:
    """Files on backup drives whose MD5 a source drive has as trash."""
    trash = with_role(files, drives, "source").where("md5_hash is not null and priority = 'trash'").select("md5_hash").distinct()
    return with_role(files, drives, "backup").join(trash, "md5_hash", "left_semi").select(*files.columns)


def bit_rot(files: DataFrame, drives: DataFrame) -> DataFrame:
    """(path, source_id, backup_id, source_md5, backup_md5): same path and size on a source and a backup drive, other content.

    All pairs are asked for, which grow with the square of the files of a path. So the backups of a path are dealt into blocks of about BLOCK by their id, and each source meets every block: no task holds more than a
    block of a path at once, and a path of many files is spread over tasks. Pairs of a block come together, for which the merge join is asked for: the columnar file then holds few values at a time, again and again, which
    takes a fraction of the bytes. A broadcast join would return sources in file order, each with other backups than the one before."""
    keys = ["path", "size_bytes"]
    side = lambda role, name: with_role(files, drives, role).select(*keys, F.col("id").alias(f"{name}_id"), F.col("md5_hash").alias(f"{name}_md5"))
    counts = with_role(files, drives, "backup").groupBy(*keys).count().where(F.col("count") > BLOCK)
    blocks = few(written(counts.select(*keys, F.ceil(F.col("count") / BLOCK).alias("_blocks")), "bit-rot-blocks"))  # at most a row for each BLOCK backups
    backups = side("backup", "backup").join(blocks, keys, "left").withColumn("_block", F.coalesce(F.pmod(F.xxhash64("backup_id"), F.col("_blocks")), F.lit(0))).drop("_blocks")
    sources = side("source", "source").join(blocks, keys, "left").withColumn("_block", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("_blocks", F.lit(1)) - 1))).drop("_blocks")
    return sources.hint("merge").join(backups, [*keys, "_block"]).where("source_md5 <> backup_md5").drop("_block")
