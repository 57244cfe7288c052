"""Moved files: what a rescan would take for a removal and a new file is matched one to one, so that ids, classifications and hashes stay with the content.

Old and new rows of the same drive are the same file if path, inode, size and time agree; of the others those with equal device, inode, size and time are matched first (a rename, also a swap of two names),
then those that still have their path (a file that was edited or replaced in place), then those with equal hash and size, then those with equal name and size. Within a key that several rows share they
are matched in the order of their paths, the first with the first; what is left over stays unmatched. Ranks come from a total order of all rows less the first number of their key, so that a key of
any number of rows is spread."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import written
from .order import numbered

#: (name, columns that must be equal), tried in this order; hash stands for the preferred hash.
WAYS = (("inode", ("drive_id", "device_num", "inode", "size_bytes", "modified_at")), ("path", ("drive_id", "path")), ("content", ("drive_id", "hash", "size_bytes")), ("name", ("drive_id", "filename", "size_bytes")))


def _ranked(rows: DataFrame, keys: tuple[str, ...], pieces: int | None) -> DataFrame:
    """rows (id, path, keys...) whose keys are all there, with _rank among those of equal keys by path, then id."""
    there = rows.dropna(subset=[*keys])
    every = numbered(there.select("id", *dict.fromkeys([*keys, "path"])), [F.col(c) for c in (*keys, "path", "id")], "_at", pieces)
    first = every.groupBy(*keys).agg(F.min("_at").alias("_first"))
    return every.join(first, [*keys]).select("id", *keys, (F.col("_at") - F.col("_first")).alias("_rank"))


def matched(old: DataFrame, new: DataFrame, pieces: int | None = None) -> DataFrame:
    """(old_id, new_id, way) of the rows that are one file, way telling by what; rows (id, drive_id, path, filename, device_num, inode, size_bytes, modified_at, hash). Each id occurs once in each table and is matched once at most."""
    columns = ["id", "drive_id", "path", "filename", "device_num", "inode", "size_bytes", "modified_at", "hash"]
    o, n = written(old.select(*columns), "moves-old"), written(new.select(*columns), "moves-new")
    whole = ["drive_id", "path", "inode", "size_bytes", "modified_at"]
    same = F.lit(True)
    for c in whole:
        same = same & (F.col(f"o.{c}").eqNullSafe(F.col(f"n.{c}")))
    # paths are unique within a drive, so that nothing is matched twice here
    found = written(o.alias("o").join(n.alias("n"), (F.col("o.drive_id") == F.col("n.drive_id")) & (F.col("o.path") == F.col("n.path")) & same).select(F.col("o.id").alias("old_id"), F.col("n.id").alias("new_id"), F.lit("same").alias("way")), "moves-same")
    parts = [found]
    for way, keys in WAYS:
        o = written(o.join(found.select(F.col("old_id").alias("id")), "id", "left_anti"), "moves-old")
        n = written(n.join(found.select(F.col("new_id").alias("id")), "id", "left_anti"), "moves-new")
        a, b = (_ranked(x, keys, pieces).withColumnRenamed("id", name) for x, name in ((o, "old_id"), (n, "new_id")))
        found = written(a.join(b, [*keys, "_rank"]).select("old_id", "new_id", F.lit(way).alias("way")), "moves-found")
        parts.append(found)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def follow(old: DataFrame, new: DataFrame, pieces: int | None = None) -> DataFrame:
    """The files table `old` with the paths that its files have in the scan `new`, so that an upsert by path finds them. Only drives that were scanned are looked at. A row whose path was taken by another file, and that went nowhere itself, is gone."""
    scanned = new.select("drive_id").distinct()
    mine = old.join(F.broadcast(scanned), "drive_id", "left_semi")  # a row for each drive
    alive = mine.where("status <> 'source_removed'")
    with_hash = lambda t: t.withColumn("hash", F.coalesce("blake3_hash", "md5_hash"))
    pairs = written(matched(with_hash(alive), with_hash(new), pieces).where("way not in ('same', 'path')"), "moves-pairs")
    at = pairs.join(new.select(F.col("id").alias("new_id"), *[F.col(c).alias(f"_{c}") for c in ("path", "abs_path", "filename", "extension")]), "new_id").drop("new_id", "way").withColumnRenamed("old_id", "id")
    moved = old.join(at, "id", "left")
    for c in ("path", "abs_path", "filename", "extension"):
        moved = moved.withColumn(c, F.when(F.col("_path").isNotNull(), F.col(f"_{c}")).otherwise(F.col(c)))
    moved = written(moved.withColumn("_moved", F.col("_path").isNotNull()).select(*old.columns, "_moved"), "moves-moved")
    taken = moved.where("_moved").select("drive_id", "path")
    return moved.where("_moved").unionByName(moved.where("not _moved").join(taken, ["drive_id", "path"], "left_anti").select(*moved.columns)).select(*old.columns)
