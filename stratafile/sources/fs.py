"""Directory trees as file rows: a data source whose tasks walk a part of the tree each. The parts are found by listing folders from the root down, the next level of all of them at a time, until there
are enough; so a root with a single folder is no single task.

The tree must be reachable by the executors under the same path, as mounted drives are. What can't be read becomes a row of kind `error`, so that one bad
entry ends neither the walk nor the job."""

from __future__ import annotations

import os
import re
import stat
from collections.abc import Iterator
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..errors import DriveNotFound, DriveOffline, FileMissing
from ..functions.formats import GIT_URL
from ..operators.stats import scan_counts
from ..schema import conform

SCHEMA = "kind string, path string, abs_path string, filename string, extension string, size_bytes long, modified_at timestamp, inode long, device_num long, nlinks int, is_symlink boolean, symlink_target string, git_remote_url string, error string"
REMOTE = re.compile(GIT_URL)


#: Parts of a tree that are enough for its tasks.
PARTS = 64


class Part(InputPartition):
    """Paths to walk, each with its depth; those that are not deep stand for themselves only, their entries being in other parts."""

    def __init__(self, paths: list[tuple[str, int, bool]]):
        self.paths = paths


class Reader(DataSourceReader):
    def __init__(self, root: str, options: dict):
        flag = lambda k: str(options.get(k, "false")).lower() == "true"
        self.root, self.hidden, self.follow, self.prune = root, flag("include_hidden"), flag("follow_symlinks"), flag("prune_hidden")
        depth = options.get("max_depth")
        self.depth = int(depth) if depth not in (None, "", "None") else None

    def partitions(self) -> list[Part]:
        shallow, level, depth = [], [(os.path.join(self.root, x), 1, True) for x in sorted(os.listdir(self.root))], 1
        while level and len(shallow) + len(level) < PARTS and (self.depth is None or depth < self.depth):
            deeper, some = [], False
            for path, at, deep in level:
                try:  # links and hidden folders that are pruned stay with their walk
                    if deep and at == depth and os.path.isdir(path) and not os.path.islink(path) and not (self.prune and not self.hidden and os.path.basename(path).startswith(".")):
                        inside = sorted(os.listdir(path))
                        shallow.append((path, at, False))
                        deeper += [(os.path.join(path, x), at + 1, True) for x in inside]
                        some = True
                        continue
                except OSError:
                    pass  # the walk reports it
                deeper.append((path, at, deep))
            level, depth = deeper, depth + 1
            if not some:
                break
        every = shallow + level
        n = max(1, min(len(every), 4 * PARTS))
        return [Part([("", 0, False)])] + [Part(every[i::n]) for i in range(n) if every[i::n]]

    def read(self, part: Part) -> Iterator[tuple]:
        for path, depth, deep in part.paths:
            if not depth:
                yield self._plain("dir", self.root)
            elif not deep:
                if self.hidden or not os.path.basename(path).startswith("."):
                    yield self._plain("dir", path)
            elif self.depth is None or self.depth >= depth:
                yield from self._walk(path, depth)

    def _plain(self, kind: str, path: str, error: str | None = None) -> tuple:
        return (kind, os.path.relpath(path, self.root), path, os.path.basename(path), None, 0, None, None, None, None, False, None, None, error)

    def _walk(self, top: str, at: int) -> Iterator[tuple]:
        todo, seen = [(top, at)], set()
        while todo:
            path, depth = todo.pop()
            name = os.path.basename(path)
            shown = self.hidden or not name.startswith(".")
            if not shown and self.prune:
                continue
            try:
                own = os.lstat(path)
                link = stat.S_ISLNK(own.st_mode)
                info = os.stat(path) if link and self.follow else own
                if stat.S_ISDIR(info.st_mode):
                    if shown:
                        yield self._plain("dir", path)
                    if self.depth is None or depth < self.depth:
                        if link and (info.st_dev, info.st_ino) in seen:
                            continue  # a loop of links
                        seen.add((info.st_dev, info.st_ino))
                        todo += [(os.path.join(path, x), depth + 1) for x in sorted(os.listdir(path), reverse=True)]
                elif shown and (stat.S_ISREG(info.st_mode) or link):
                    yield self._file(path, name, info, link)
            except OSError as e:
                yield self._plain("error", path, str(e))

    def _file(self, path: str, name: str, info: os.stat_result, link: bool) -> tuple:
        stem, dot, ext = name.rpartition(".")
        git = _git_remote(path) if name == "config" and os.path.basename(os.path.dirname(path)) == ".git" else None
        when = datetime.fromtimestamp(int(info.st_mtime), timezone.utc)
        return ("file", os.path.relpath(path, self.root), path, name, ext if dot and stem else None, 0 if link else info.st_size, when, info.st_ino, info.st_dev, info.st_nlink, link, os.readlink(path) if link else None, git, None)


def _git_remote(path: str) -> str | None:
    """The first url of a git configuration."""
    try:
        with open(path, encoding="utf-8", errors="replace") as f:
            return git_remote(f.read())
    except OSError:
        return None


def git_remote(text: str) -> str | None:
    found = REMOTE.search(text)
    return (found.group(1).strip() or None) if found else None


class FileTree(DataSource):
    """spark.read.format("file_tree").option(...).load(root)"""

    @classmethod
    def name(cls) -> str:
        return "file_tree"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> Reader:
        return Reader(self.options["path"], dict(self.options))


def entries(spark: SparkSession, root: str, include_hidden: bool = False, max_depth: int | None = None, follow_symlinks: bool = False, prune_hidden: bool = False) -> DataFrame:
    """A row for each folder, file or unreadable entry below root, and one for root. Hidden means that an entry's own name starts with a dot; what is visible
    below a hidden folder is listed unless prune_hidden."""
    if not os.path.isdir(root):
        raise FileMissing(root)
    spark.dataSource.register(FileTree)
    read = spark.read.format("file_tree").option("include_hidden", include_hidden).option("follow_symlinks", follow_symlinks).option("prune_hidden", prune_hidden)
    return (read.option("max_depth", max_depth) if max_depth is not None else read).load(os.path.abspath(root))


def files_of(tree: DataFrame, drive_id: int, base: str | None = None) -> DataFrame:
    """Files of a scan as rows of the files table, paths relative to base; ids follow from the drive and the path, so a rescan finds the same."""
    rows = tree.where("kind = 'file'")
    if base is not None:
        from ..functions.formats import relative

        rows = rows.withColumn("path", relative(F.col("abs_path"), F.lit(base)))
    rows = rows.withColumns({"id": F.shiftrightunsigned(F.xxhash64(F.lit(drive_id).cast("long"), "path"), 1), "drive_id": F.lit(drive_id), "priority": F.lit("normal"), "status": F.lit("indexed"), "is_original": F.lit(False)})
    return conform(rows, "files")


def unread(tree: DataFrame, base: str) -> DataFrame:
    """(path) of what a scan couldn't read, relative to base."""
    from ..functions.formats import relative

    return tree.where("kind = 'error'").select(relative(F.col("abs_path"), F.lit(base)).alias("path"))


def mounted(drives: DataFrame, label: str):
    """The row of a drive, which must exist, be online and have a mount path."""
    row = drives.where(F.col("label") == label).first()
    if row is None:
        raise DriveNotFound(label)
    if not row["is_online"]:
        raise DriveOffline(label)
    if not row["mount_path"]:
        raise FileMissing(f"drive {label} has no mount path")
    return row


def tree_of(spark: SparkSession, drives: DataFrame, label: str, sub_path: str | None = None, **options) -> tuple[DataFrame, int, str]:
    """(entries, id of the drive, its mount path) of one drive. The tree is walked whenever the entries are read."""
    row = mounted(drives, label)
    tree = entries(spark, os.path.join(row["mount_path"], sub_path) if sub_path else row["mount_path"], **options)
    return tree, row["id"], os.path.abspath(row["mount_path"])


def scan_drive(spark: SparkSession, drives: DataFrame, label: str, sub_path: str | None = None, keep=lambda tree: tree, **options) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(files, counters, unread) of one drive. keep: makes the entries a table first, so that the tree is walked once."""
    tree, id_, base = tree_of(spark, drives, label, sub_path, **options)
    tree = keep(tree)
    return files_of(tree, id_, base), scan_counts(tree), unread(tree, base)


def scan_all(spark: SparkSession, drives: DataFrame, keep=lambda tree: tree, **options) -> tuple[DataFrame, DataFrame]:
    """(files, counters) of every drive that is online and mounted; the counters are sums."""
    labels = [r["label"] for r in drives.where("is_online and mount_path is not null").orderBy("added_at", "id").collect()]
    found = [scan_drive(spark, drives, x, keep=keep, **options)[:2] for x in labels]
    if not found:
        from ..schema import empty

        return empty(spark, "files"), scan_counts(spark.createDataFrame([], SCHEMA))
    files, counters = found[0]
    for f, c in found[1:]:
        files, counters = files.unionByName(f), counters.unionByName(c)
    return files, counters.agg(*[F.sum(c).alias(c) for c in counters.columns])
