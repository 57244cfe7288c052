"""The catalogue at rest: each table a folder of Parquet parts, a list of parts for each version, and a pointer to the current one; a single writer.

A change is a function from a table to a table. Its result is written as a new part, and only then does the pointer move, so readers see the old
or the new table, and a writer that is lost leaves the old one. Appended rows are a part of their own beside those that are there; beyond MOST_PARTS the table is written anew as one. Old versions are kept until vacuum."""

from __future__ import annotations

import json

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import schema
from .errors import ConfigError, DriveNotFound, StoreError
from .operators import filters


#: Parts of a table before an append writes it anew.
MOST_PARTS = 64


class Store:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    # tables

    def _path(self, table: str, version: int) -> str:
        return f"{self.root}/{table}/v{version:08d}"

    def _fs(self, path: str):
        jvm = self.spark._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def _get(self, path: str) -> dict | None:
        fs, p = self._fs(path)
        if not fs.exists(p):
            return None
        data = fs.open(p)
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(data, "UTF-8"))
        finally:
            data.close()

    def _put(self, path: str, value: dict) -> None:
        fs, p = self._fs(path)
        out = fs.create(p, True)
        try:
            out.write(bytearray(json.dumps(value).encode()))
        finally:
            out.close()

    def version(self, table: str) -> int:
        """The current version's number, 0 before the first."""
        return (self._get(f"{self.root}/{table}/current.json") or {"version": 0})["version"]

    def parts(self, table: str, version: int) -> list[int] | None:
        """The numbers of the parts that a version consists of."""
        found = self._get(f"{self._path(table, version)}.json")
        return found and found["parts"]

    def initialise(self) -> None:
        """Creates the tables that are not there."""
        for table in schema.TABLES:
            if not self.version(table):
                rows = schema.empty(self.spark, table) if table != "schema_version" else self.spark.createDataFrame([(schema.VERSION,)], schema.struct(table))
                self.write(table, rows)

    def schema_version(self) -> int:
        row = self.read("schema_version").first()
        if row is None:
            raise StoreError("the catalogue has no schema version")
        return row["version"]

    def read(self, table: str, version: int | None = None) -> DataFrame:
        if table not in schema.TABLES:
            raise StoreError(f"unknown table {table}")
        at = version or self.version(table)
        if not at:
            return schema.empty(self.spark, table)
        parts = self.parts(table, at)
        if not parts:
            raise StoreError(f"{table} has no version {at}")
        try:
            return self.spark.read.schema(schema.struct(table)).parquet(*[self._path(table, p) for p in parts])
        except AnalysisException as e:
            raise StoreError(f"{table} has lost a part of version {at}") from e

    def _add(self, table: str, rows: DataFrame, beside: list[int], seen: int | None = None) -> int:
        """rows, beside parts that are there, as a new version. seen: the version that rows were made from, which must still be the current one when the pointer moves."""
        seen = self.version(table) if seen is None else seen
        new = seen + 1
        self._still(table, seen)
        schema.conform(rows, table).write.mode("overwrite").parquet(self._path(table, new))
        self._still(table, seen)
        self._put(f"{self._path(table, new)}.json", {"parts": [*beside, new]})
        self._put(f"{self.root}/{table}/current.json", {"version": new})
        return new

    def _still(self, table: str, seen: int) -> None:
        if self.version(table) != seen:
            raise StoreError(f"{table} was changed by another writer since version {seen}")

    def write(self, table: str, rows: DataFrame) -> int:
        """rows as the table's new version; its number."""
        return self._add(table, rows, [])

    def append(self, table: str, rows: DataFrame) -> int:
        at = self.version(table)
        parts = self.parts(table, at) or [] if at else []
        if len(parts) >= MOST_PARTS:
            return self._add(table, self.read(table, at).unionByName(schema.conform(rows, table)), [], at)
        return self._add(table, rows, parts, at)

    def update(self, table: str, change) -> int:
        """change: a function from the table to the table. If another writer was faster, nothing is changed and the call fails."""
        at = self.version(table)
        return self._add(table, change(self.read(table, at)), [], at)

    def vacuum(self, table: str, keep: int = 2) -> None:
        """Deletes all versions but the last `keep`, and the parts that only they have."""
        last = self.version(table)
        kept = range(max(1, last - keep + 1), last + 1)
        used = {p for v in kept for p in self.parts(table, v) or []}
        for v in range(1, last + 1):
            for path, goes in ((self._path(table, v), v not in used), (f"{self._path(table, v)}.json", v not in kept)):
                fs, p = self._fs(path)
                if goes and fs.exists(p):
                    fs.delete(p, True)

    def validate(self) -> DataFrame:
        return schema.validate({t: self.read(t) for t in schema.TABLES if t != "schema_version"})

    # changes

    def upsert_files(self, rows: DataFrame, tombstones_of: int | None = None, unread: DataFrame | None = None) -> int:
        return self.update("files", lambda old: upsert_files(old, rows, tombstones_of, unread))

    def add_drive(self, **drive) -> int:
        """Adds a drive; the label must be new. The id follows the largest."""
        row = new_drive(self.read("drives"), **drive)
        self.append("drives", row)
        return row.first()["id"]

    def change_drive(self, label: str, **values) -> int:
        """Sets columns of a drive, which must be there: online and offline, its metadata, when it was scanned."""
        if not self.read("drives").where(F.col("label") == label).count():
            raise DriveNotFound(label)
        return self.update("drives", lambda d: set_where(d, F.col("label") == label, **values))

    def remove_drive(self, label: str) -> int:
        if not self.read("drives").where(F.col("label") == label).count():
            raise DriveNotFound(label)
        return self.update("drives", lambda d: filters.without_drive(d, label))

    def log(self, action: str, details: str | None = None, plan_id: int | None = None, file_id: int | None = None, drive_id: int | None = None, mode: str = "automated") -> None:
        self.append("audit_log", new_entry(self.read("audit_log"), action, details, plan_id, file_id, drive_id, mode))


def new_drive(known: DataFrame, **drive) -> DataFrame:
    """A row for a drive beside those that are known: the label must be new, the id follows the largest."""
    if known.where(F.col("label") == drive.get("label")).count():
        raise ConfigError(f"a drive {drive['label']!r} is there already")
    for column, enum in (("role", "role"), ("backend", "backend")):
        if drive.setdefault(column, {"role": "source", "backend": "local"}[column]) not in schema.ENUMS[enum]:
            raise ConfigError(f"{drive[column]!r} is no {column}")
    drive.setdefault("is_online", True)
    if drive.get("is_readonly") is None:
        drive["is_readonly"] = drive["role"] == "backup"
    id_ = known.agg((F.coalesce(F.max("id"), F.lit(0)) + 1).alias("id"))
    columns = {f.name: F.lit(drive.get(f.name)).cast(f.dataType).alias(f.name) for f in schema.struct("drives")}
    columns["id"] = F.col("id")
    columns["added_at"] = F.coalesce(columns["added_at"], F.current_timestamp()).alias("added_at")
    return id_.select(*columns.values())


def new_entry(known: DataFrame, action: str, details: str | None = None, plan_id: int | None = None, file_id: int | None = None, drive_id: int | None = None, mode: str = "automated") -> DataFrame:
    """An audit row of this moment; its id follows the largest."""
    values = {"action": action, "details": details, "plan_id": plan_id, "file_id": file_id, "drive_id": drive_id, "agent_mode": mode}
    row = known.agg((F.coalesce(F.max("id"), F.lit(0)) + 1).alias("id"))
    return schema.conform(row.select("id", F.current_timestamp().alias("timestamp"), *[F.lit(v).alias(k) for k, v in values.items() if v is not None]), "audit_log")


def set_where(df: DataFrame, chosen: Column, **values) -> DataFrame:
    """df with the columns set where chosen holds."""
    chosen = F.coalesce(chosen, F.lit(False))
    types = dict(df.dtypes)
    return df.withColumns({c: F.when(chosen, (v if isinstance(v, Column) else F.lit(v)).cast(types[c])).otherwise(F.col(c)) for c, v in values.items()})


def set_from(df: DataFrame, assignments: DataFrame, key: str = "id") -> DataFrame:
    """df with the columns of assignments, by key, where they are not null there."""
    names = [c for c in assignments.columns if c != key]
    new = assignments.select(key, *[F.col(c).alias(f"_{c}") for c in names])
    return df.join(new, key, "left").select(*[F.coalesce(f"_{c}", c).alias(c) if c in names else F.col(c) for c in df.columns])


def below(files: DataFrame, drive_id: int, folders: DataFrame) -> DataFrame:
    """(id) of the drive's files whose path is one of folders (path) or lies below one. Each path meets the folders by its own ancestors."""
    depth = F.size(F.split("path", "/"))
    ways = files.where(F.col("drive_id") == drive_id).select("id", F.explode(F.transform(F.sequence(F.lit(1), depth), lambda n: F.array_join(F.slice(F.split("path", "/"), F.lit(1), n), "/"))).alias("path"))
    return ways.join(folders, "path", "left_semi").select("id").distinct()


def upsert_files(old: DataFrame, new: DataFrame, tombstones_of: int | None = None, unread: DataFrame | None = None) -> DataFrame:
    """The files table after a scan. A file is known by (drive_id, path): it keeps its id and classification, and its hashes and group as well if size and time are the same.

    tombstones_of: files of that drive that the scan lacks become source_removed, but for those at or below the paths that couldn't be read, unread (path)."""
    key, n = ["drive_id", "path"], schema.struct("files").names
    last = new.withColumn("_r", F.row_number().over(Window.partitionBy(*key).orderBy(F.desc("modified_at"), F.desc("size_bytes"), "id"))).where("_r = 1").drop("_r")
    if unread is not None and tombstones_of is not None:
        old = old.join(below(old, tombstones_of, unread).withColumn("_unread", F.lit(True)), "id", "left")
    else:
        old = old.withColumn("_unread", F.lit(None).cast("boolean"))
    o, s = old.alias("o"), last.alias("s")
    both = o.join(s, [F.col("o.drive_id") == F.col("s.drive_id"), F.col("o.path") == F.col("s.path")], "full_outer")
    seen, known = F.col("s.path").isNotNull(), F.col("o.path").isNotNull()
    same = F.coalesce((F.col("o.size_bytes") == F.col("s.size_bytes")) & F.col("o.modified_at").eqNullSafe(F.col("s.modified_at")), F.lit(False))
    stays = {"id", "category", "subcategory", "target_path", "target_drive_id", "priority", "rmlint_type", "status", "migrated_to", "migrated_to_drive", "migrated_at"}
    by_content = {"md5_hash", "blake3_hash", "duplicate_group", "is_original", "verified_hash", "mime_type"}

    def value(c: str) -> Column:
        fresh, was = F.col(f"s.{c}"), F.col(f"o.{c}")
        if c == "status" and tombstones_of is not None:
            was = F.when(~seen & (F.col("o.drive_id") == tombstones_of) & F.col("o._unread").isNull(), F.lit("source_removed")).otherwise(was)
        if c in stays:
            return F.when(known, was).otherwise(fresh)
        if c in by_content:
            return F.when(known & seen & same, F.coalesce(fresh, was) if c != "is_original" else was).when(seen, fresh).otherwise(was)
        return F.when(seen, fresh).otherwise(was)

    return both.select(*[value(c).alias(c) for c in n])
