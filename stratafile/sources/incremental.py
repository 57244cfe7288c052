"""Scans that list only what changed: a snapshot of a drive's folders says when each was last changed and what its listing was, and a later scan lists a folder anew only if its time, or itself, is another one.

A folder's time changes when an entry comes, goes or is renamed in it, not when a file in it is written in place, nor when anything changes deeper down. So every known folder is looked at (one stat each, by as many tasks as there are parts), only
changed ones are listed, folders that were not known are walked whole, and the files of unchanged folders are looked at one by one (`files=True`) or believed. Times are kept to the nanosecond; a folder
that changed within SETTLED seconds before it was read is listed again next time, as a change in the same tick would leave no trace.

Snapshots are tables (path, mtime_ns, read_at, listing) beside the files they were made with; a scan's result is again the whole tree, so files that are gone follow by difference as after any scan."""

from __future__ import annotations

import hashlib
import os
import stat
import time
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import FileMissing
from ..scratch import written
from .fs import Reader

SNAPSHOT = "path string, mtime_ns long, read_at double, listing string"
FILES = "path string, abs_path string, filename string, extension string, size_bytes long, modified_at timestamp, inode long, device_num long, nlinks int, is_symlink boolean, symlink_target string, git_remote_url string"
#: Seconds after which a folder's time can be trusted.
SETTLED = 2.0
_ROW = "kind string, error string, mtime_ns long, read_at double, listing string, " + FILES


def _names(path: str) -> tuple[list[str], str]:
    """The entries of a folder and a digest of their names and kinds."""
    with os.scandir(path) as it:
        found = sorted((e.name, e.is_dir(follow_symlinks=False)) for e in it)
    return [n for n, _ in found], hashlib.md5("\0".join(f"{n}/{d}" for n, d in found).encode("utf-8", "surrogateescape")).hexdigest()


class _Look:
    """What a task does with its folders and files; paths are relative to root, the root itself is the empty path."""

    def __init__(self, root: str, hidden: bool):
        self.root, self.hidden, self.row = root, hidden, Reader(root, {})._file

    def _out(self, kind: str, path: str, error=None, mtime=None, listing=None, file=None) -> tuple:
        return (kind, error, mtime, time.time() if mtime is not None else None, listing, *(file or (path, *[None] * 11)))

    def file(self, path: str) -> Iterator[tuple]:
        """A file that was known: as it is now; nothing if it is gone."""
        full = os.path.join(self.root, path)
        try:
            info = os.lstat(full)
            if stat.S_ISREG(info.st_mode) or stat.S_ISLNK(info.st_mode):
                yield self._out("file", path, file=self.row(full, os.path.basename(full), info, stat.S_ISLNK(info.st_mode))[1:-1])
        except FileNotFoundError:
            return
        except OSError as e:
            yield self._out("error", path, str(e))

    def listed(self, path: str, known: set[str], deep: bool) -> Iterator[tuple]:
        """A folder's own files; deep, or for folders that are not known: all below, too."""
        todo = [path]
        while todo:
            at = todo.pop()
            full = os.path.join(self.root, at) if at else self.root
            try:
                before = os.stat(full).st_mtime_ns
                names, digest = _names(full)
            except OSError as e:
                yield self._out("error", at, str(e))
                continue
            yield self._out("dir", at, mtime=before, listing=digest)
            for name in names:
                child = f"{at}/{name}" if at else name
                try:
                    info = os.lstat(os.path.join(self.root, child))
                except FileNotFoundError:
                    continue
                except OSError as e:
                    yield self._out("error", child, str(e))
                    continue
                if stat.S_ISDIR(info.st_mode):
                    if deep or child not in known:
                        todo.append(child)
                elif (self.hidden or not name.startswith(".")) and (stat.S_ISREG(info.st_mode) or stat.S_ISLNK(info.st_mode)):
                    yield self._out("file", child, file=self.row(os.path.join(self.root, child), name, info, stat.S_ISLNK(info.st_mode))[1:-1])


def _run(rows: DataFrame, work) -> DataFrame:
    """rows through work, a function from (a row's values) to results."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = [c.split()[0] for c in _ROW.split(", ")]
        for batch in batches:
            out = [x for row in batch.itertuples(index=False) for x in work(*row)]
            yield pd.DataFrame({c: pd.Series([x[i] for x in out], dtype=object) for i, c in enumerate(columns)})

    return rows.mapInPandas(run, _ROW)


def first_scan(spark: SparkSession, root: str, include_hidden: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(files, snapshot, errors) of a tree that has no snapshot: the folders of the first level are walked by a task each."""
    root = os.path.abspath(root)
    if not os.path.isdir(root):
        raise FileMissing(root)
    tops = [x.name for x in os.scandir(root) if x.is_dir(follow_symlinks=False)]
    look = _Look(root, include_hidden)
    parts = spark.createDataFrame([("", False), *((t, True) for t in tops)], "path string, deep boolean").repartition(max(1, len(tops) + 1))
    return _split(written(_run(parts, lambda path, deep: look.listed(path, set(tops), deep)), "scan"))


def rescan(spark: SparkSession, root: str, snapshot: DataFrame, files: DataFrame, include_hidden: bool = False, each_file: bool = True) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(files, snapshot, errors) of the tree as it is now. snapshot and files (path, ...) are those of the scan before; each_file: files of unchanged folders are looked at, else taken as they were."""
    root = os.path.abspath(root)
    if not os.path.isdir(root):
        raise FileMissing(root)
    look = _Look(root, include_hidden)

    def state(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            got = []
            for path, old, read_at in zip(b["path"], b["mtime_ns"], b["read_at"]):
                try:
                    info = os.lstat(os.path.join(root, path) if path else root)
                    same = info.st_mtime_ns == old and read_at - old / 1e9 > SETTLED
                    got.append("gone" if not stat.S_ISDIR(info.st_mode) and path else "same" if same else "changed")
                except FileNotFoundError:
                    got.append("gone")
                except OSError:
                    got.append("changed")  # the listing reports it
            yield b.assign(state=got)

    folders = written(snapshot.repartition(F.col("path")).mapInPandas(state, SNAPSHOT + ", state string"), "scan-folders")
    same = folders.where("state = 'same'").drop("state")
    # a changed folder meets the known folders in it, so that only new ones are walked whole
    parent = F.when(F.col("path") != "", F.regexp_extract("path", "^(.*)/[^/]*$", 1))
    inside = folders.where("state <> 'gone'").select(parent.alias("up"), "path").where("up is not null").groupBy("up").agg(F.collect_list("path").alias("known"))
    changed = folders.where("state = 'changed'").select("path").join(inside, F.col("path") == F.col("up"), "left").select("path", "known")
    fresh = written(_run(changed, lambda path, known: look.listed(path, set(known if known is not None else ()), False)), "scan")
    # what a folder that couldn't be read holds is unknown and stays as it was
    kept = files.withColumn("up", F.regexp_extract("path", "^(.*)/[^/]*$", 1)).join(same.select(F.col("path").alias("up")), "up", "left_semi").select(*[c.split()[0] for c in FILES.split(", ")])
    if each_file:
        looked = written(_run(kept.select("path"), look.file), "scan-files")
        fresh = fresh.unionByName(looked)
        kept = kept.limit(0)
    now, shot, errors = _split(fresh)
    return now.unionByName(kept), shot.unionByName(same), errors


def _split(rows: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    files = rows.where("kind = 'file'").select(*[c.split()[0] for c in FILES.split(", ")])
    return files, rows.where("kind = 'dir'").select("path", "mtime_ns", "read_at", "listing"), rows.where("kind = 'error'").select("path", "error")


__all__ = ["FILES", "SNAPSHOT", "first_scan", "rescan"]
