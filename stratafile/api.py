"""The catalogue's tools as methods: queries give lazy DataFrames, changes write new versions of tables."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import schema
from .errors import ConfigError, DriveNotFound, MigrationError, PlanNotApproved, PlanNotFound
from .functions.formats import contains_like, ids_from_list
from .functions.hashing import hash_ends, same_as, with_missing_hashes
from .functions.mime import with_mime_types
from .operators import dedup, filters, folders, joins, lint, moves, reports, rules, stats, trigrams
from .operators.staged import with_staged_hashes
from .plans import batches, executor, planner
from .plans import policy as policies
from .scratch import written
from .sources import devices, exif, fs, incremental
from .sources import lint as lint_source
from .store import Store, set_where


class Catalogue:
    def __init__(self, spark: SparkSession, root: str | None = None, now: Column | None = None):
        self.spark, self.store = spark, Store(spark, root or devices.catalogue_path())
        self.store.initialise()
        self._now = now

    @property
    def now(self) -> Column:
        return self._now if self._now is not None else F.current_timestamp()

    def table(self, name: str) -> DataFrame:
        return self.store.read(name)

    files = property(lambda self: self.table("files"))
    drives = property(lambda self: self.table("drives"))
    groups = property(lambda self: self.table("duplicate_groups"))
    plans = property(lambda self: self.table("migration_plans"))
    steps = property(lambda self: self.table("migration_steps"))
    audit = property(lambda self: self.table("audit_log"))

    def _drive(self, label: str | None) -> int | None:
        return None if label is None else filters.drive_id(self.drives, label)

    # state and space

    def status(self) -> DataFrame:
        return stats.status_summary(self.files, self.drives, self.groups, self.plans)

    def space_check(self, drive: str | None = None) -> DataFrame:
        rows = stats.space_by_drive(self.drives, self.files)
        return rows if drive in (None, "all") else rows.where(F.col("id") == self._drive(drive))

    def report(self) -> DataFrame:
        return dedup.duplicate_statistics(self.groups).crossJoin(stats.migration_summary(self.plans, "total_bytes"))

    def text_report(self) -> str:
        return reports.text_report(self.drives, self.files, self.groups, self.plans)

    def export(self, kind: str, path: str) -> None:
        reports.export(kind, path, self.drives, self.files, self.groups, self.now)

    # drives

    def drive_list(self) -> DataFrame:
        return filters.list_drives(self.drives)

    def drive_add(self, label: str, mount_path: str | None = None, role: str = "source", readonly: bool | None = None, backend: str = "local", rclone_remote: str | None = None) -> int:
        found = devices.discover_device(mount_path) if backend == "local" and mount_path else devices.Device(mount_path=mount_path)
        return self.store.add_drive(label=label, mount_path=mount_path, role=role, is_readonly=readonly, backend=backend, rclone_remote=rclone_remote, device_id=found.device_id, device_path=found.device_path, uuid=found.uuid, fs_type=found.fs_type, total_bytes=found.total_bytes)

    def drive_refresh(self, label: str) -> None:
        """Finds out anew what device or remote a known drive is, and how large."""
        row = filters.drive_by_label(self.drives, label).first()
        if row is None:
            raise DriveNotFound(label)
        found = devices.discover_remote(row["rclone_remote"]) if row["backend"] == "rclone" else devices.discover_device(row["mount_path"])
        known = {c: getattr(found, c) for c in ("device_id", "device_path", "uuid", "fs_type", "total_bytes")}
        self.store.change_drive(label, **{c: v for c, v in known.items() if v is not None})

    def drive_remove(self, label: str) -> None:
        self.store.remove_drive(label)

    def drive_online(self, label: str, online: bool = True) -> None:
        self.store.change_drive(label, is_online=online)

    def drive_info(self, label: str) -> DataFrame:
        id_ = self._drive(label)
        return filters.drive_by_label(self.drives, label).join(stats.drive_statistics(self.files.where(F.col("drive_id") == id_)).drop("drive_id", "total_bytes"), how="left", on=F.lit(True))

    def drive_table(self) -> DataFrame:
        return stats.files_per_drive(self.drives, self.files)

    # indexing

    def scan(self, drive_label: str | None = None, sub_path: str | None = None, tombstones: bool = False, follow_moves: bool = False, mime_types: bool = False, **options) -> DataFrame:
        """Scans one drive, or all that are online; the counters. mime_types: the beginning of each file is read to fill that column. follow_moves: files that were renamed or moved within a drive since keep their row; not with a sub_path, beside which files may have gone."""
        path = f"{self.store.root}/scans/{uuid.uuid4().hex}"
        kept = []

        def keep(tree: DataFrame) -> DataFrame:
            kept.append(f"{path}/{len(kept)}")
            tree.write.parquet(kept[-1])
            return self.spark.read.schema(tree.schema).parquet(kept[-1])

        gone = self._drive(drive_label) if tombstones and drive_label and not sub_path else None
        found, counters, *more = fs.scan_drive(self.spark, self.drives, drive_label, sub_path, keep, **options) if drive_label else fs.scan_all(self.spark, self.drives, keep, **options)
        rows = counters.collect()
        if mime_types:
            found = with_mime_types(found)
        if follow_moves and not sub_path:
            self.store.update("files", lambda old: moves.follow(old, found))
        self.store.upsert_files(found, gone, more[0] if more else None)
        hadoop, at = self.store._fs(path)
        hadoop.delete(at, True)
        scanned = [drive_label] if drive_label else [r["label"] for r in self.drives.where("is_online and mount_path is not null").collect()]
        self.store.update("drives", lambda d: set_where(d, F.col("label").isin(*scanned), scanned_at=self.now))
        return self.spark.createDataFrame(rows, counters.schema)

    def rescan(self, drive_label: str, include_hidden: bool = False, each_file: bool = True, follow_moves: bool = False) -> DataFrame:
        """Scans a drive by the snapshot of its folders that the call before left: only folders that changed are listed. The first call walks the whole drive. Files that are gone become source_removed, but for those
        at or below what couldn't be read. (folders_listed, files_found, errors) as one row."""
        row = fs.mounted(self.drives, drive_label)
        at = f"{self.store.root}/snapshots/drive-{row['id']}"
        known = self.store._get(f"{at}/current.json")
        if known is None:
            found, shot, errors = incremental.first_scan(self.spark, row["mount_path"], include_hidden)
            old = self.spark.createDataFrame([], incremental.SNAPSHOT)
        else:
            old = self.spark.read.schema(incremental.SNAPSHOT).parquet(f"{at}/v{known['version']:08d}")
            files = self.files.where((F.col("drive_id") == row["id"]) & (F.col("status") != "source_removed"))
            found, shot, errors = incremental.rescan(self.spark, row["mount_path"], old, files, include_hidden, each_file)
        version = (known or {"version": 0})["version"] + 1
        shot.write.mode("overwrite").parquet(f"{at}/v{version:08d}")
        new = self.spark.read.schema(incremental.SNAPSHOT).parquet(f"{at}/v{version:08d}")
        rows = written(fs.files_of(found.withColumn("kind", F.lit("file")), row["id"]), "rescan")
        if follow_moves:
            self.store.update("files", lambda f: moves.follow(f, rows))
        self.store.upsert_files(rows, row["id"], errors.select("path"))
        self.store._put(f"{at}/current.json", {"version": version})  # the files are there now
        self.store.update("drives", lambda d: set_where(d, F.col("label") == drive_label, scanned_at=self.now))
        listed = new.join(old.select("path", "read_at"), ["path", "read_at"], "left_anti").count()
        return self.spark.createDataFrame([(listed, rows.count(), errors.count())], "folders_listed long, files_found long, errors long")

    def dedup_refresh(self, drive: str | None = None, algorithm: str = "blake3", rehash: bool = False, min_size: int = 0, per_drive: bool = False, scan: bool = True, in_stages: bool = False) -> DataFrame:
        """Scans, hashes what has no hash, and groups anew; per_drive: among the drive's files only. in_stages: only files that may have a copy, by size and by their first and last blocks, are
        hashed; files of all drives are looked at then, unless per_drive. The statistics."""
        dedup.hash_column(algorithm)
        if scan:
            self.scan(drive)
        id_ = self._drive(drive)
        one = F.lit(True) if id_ is None else F.col("drive_id") == id_
        if in_stages:
            scope_ = one if per_drive else F.lit(True)
            column, full = dedup.hash_column(algorithm), lambda f: with_missing_hashes(f, algorithm.lower())
            cleared = lambda f: f.withColumn(column, F.lit(None).cast("string")) if rehash else f
            self.store.update("files", lambda f: with_staged_hashes(cleared(f.where(scope_)), column, hash_ends, full).unionByName(f.where(~scope_)))
        else:
            self.store.update("files", lambda f: with_missing_hashes(f.where(one), algorithm.lower(), rehash).unionByName(f.where(~one)))
        groups = dedup.duplicate_groups(self.files, algorithm, id_ if per_drive else None, min_size)
        self.store.write("duplicate_groups", groups)
        kept = self.groups
        scope = self.files.where(one) if per_drive else self.files
        assigned = dedup.assign_groups(scope, kept, algorithm)
        self.store.write("files", assigned.unionByName(dedup.clear_assignments(self.files.where(~one))) if per_drive else assigned)
        return dedup.duplicate_statistics(kept)

    def duplicates_differing(self) -> DataFrame:
        """(id, duplicate_group, abs_path, original_path, same) of members of duplicate groups that don't agree byte by byte with the group's original, or that can't be read."""
        first = self.files.where("is_original").select("duplicate_group", F.col("abs_path").alias("original_path"))
        pairs = self.files.where("duplicate_group is not null and not is_original").select("id", "duplicate_group", "abs_path").join(first, "duplicate_group")
        return same_as(pairs).where("same is null or not same")

    def duplicate_folders(self, algorithm: str = "blake3", min_files: int = 1) -> DataFrame:
        """The largest folders whose content occurs elsewhere; links don't count."""
        there = self.files.where("status <> 'source_removed' and not coalesce(is_symlink, false)")
        return folders.duplicate_folders(there, dedup.hash_column(algorithm), min_files)

    def rmlint_import(self, path: str, apply_trash: bool = False, clear_existing_duplicates: bool = False) -> DataFrame:
        """Imports lint findings; the counters."""
        found = lint_source.read(self.spark, path)
        files, groups, counters = lint.import_lints(found, self.files, self.groups, apply_trash, clear_existing_duplicates)
        rows = counters.collect()
        self.store.write("files", files)
        self.store.write("duplicate_groups", groups)
        return self.spark.createDataFrame(rows, counters.schema)

    lint_import = rmlint_import

    # queries

    def query_duplicates(self, min_size: int | None = None, drive: str | None = None, same_drive_only: bool = False, limit: int = 50) -> DataFrame:
        if same_drive_only:
            return dedup.same_drive_groups(self.groups, min_size, limit)
        rows = self.groups if drive is None else self.groups.where(F.array_contains("drives_involved", F.lit(self._drive(drive)).cast("long")))
        return dedup.by_waste(rows.where(F.col("total_waste_bytes") >= min_size) if min_size is not None else rows, limit)

    def query_unclassified(self, drive: str | None = None, limit: int | None = None) -> DataFrame:
        return filters.unclassified(self.files, self._drive(drive), limit)

    def _path_index(self) -> str:
        return f"{self.store.root}/index/paths-v{self.store.version('files'):08d}"

    def index_paths(self) -> None:
        """An index of the paths of the files table as it is now, for path_contains; later versions of the table need one of their own."""
        trigrams.build(self.files, "path", self._path_index())

    def query_files(self, category: str | None = None, extension: str | None = None, min_size: int | None = None, path_contains: str | None = None, drive: str | None = None, limit: int | None = None) -> DataFrame:
        fs, at = self.store._fs(f"{self._path_index()}/size")
        if path_contains is not None and fs.exists(at):
            return filters.search(trigrams.search(self.files, "path", self._path_index(), path_contains), category, extension, min_size, path_contains, self._drive(drive), limit)
        return filters.search(self.files, category, extension, min_size, path_contains, self._drive(drive), limit)

    def query_category(self, category: str) -> DataFrame:
        return filters.by_category(self.files, category, limit=100)

    def query_large_files(self, min_size: int = filters.LARGE, limit: int = 50) -> DataFrame:
        return filters.large_files(self.files, min_size, limit)

    def query_backup_unique(self, backup_drive: str | None = None) -> DataFrame:
        """Of one drive the files that are nowhere else; without one a count for each backup drive."""
        return joins.backup_unique_counts(self.files, self.drives) if backup_drive is None else joins.backup_unique_files(self.files, self._drive(backup_drive))

    # classification

    def classify_auto(self, drive: str | None = None, rules_file: str | None = None, rule_set: list[rules.Rule] | None = None, scope: policies.Scope | None = None) -> DataFrame:
        """Classifies unclassified files by rules; the counters."""
        by = rule_set if rule_set is not None else rules.from_file(rules_file) if rules_file else []
        files = self.files
        narrow = F.lit(True) if drive is None else F.col("drive_id") == self._drive(drive)
        if scope is not None:
            chosen = policies.scoped(files, self.drives, scope).select("id", F.lit(True).alias("_in"))
            files = files.join(chosen, "id", "left")
            narrow = narrow & F.coalesce(F.col("_in"), F.lit(False))
        images = exif.read(self.files.where(F.col("category").isNull())) if any(r.subcategory_from_exif for r in by) else None
        new, counters = rules.auto_classify(files, by, self.now, images, narrow)
        rows = counters.collect()
        self.store.write("files", new)
        return self.spark.createDataFrame(rows, counters.schema)

    def classify(self, file_ids: str, category: str, subcategory: str | None = None, priority: str | None = None) -> DataFrame:
        chosen = F.array_contains(ids_from_list(F.lit(file_ids)), F.col("id"))
        self.store.update("files", lambda f: rules.set_classification(f, chosen, category, subcategory, priority))
        return self.files.where(chosen)

    def classify_pattern(self, pattern: str, category: str, priority: str | None = None) -> DataFrame:
        chosen = contains_like(F.col("path"), pattern)
        self.store.update("files", lambda f: rules.set_classification(f, chosen, category, priority=priority, keep_subcategory=True))
        return self.files.where(chosen)

    def review(self, rule_set: list[rules.Rule]) -> DataFrame:
        return rules.review_batches(rules.classify(filters.unclassified(self.files), rule_set, self.now))

    def decide(self, rule_set: list[rules.Rule], decisions: DataFrame) -> None:
        """Writes the decisions of a review; files that no batch holds stay as they are."""
        x = rules.classify(self.files, rule_set, self.now)
        open_ = F.col("category").isNull() & (F.col("status") == "indexed")
        self.store.write("files", rules.apply_review(x.withColumn("match", F.when(open_, F.col("match"))), decisions))

    def decide_files(self, rule_set: list[rules.Rule], decisions: DataFrame) -> None:
        """Writes decisions on single files of a review, (id, action, new_category, new_subcategory); files without one stay as they are."""
        x = rules.classify(self.files, rule_set, self.now)
        open_ = F.col("category").isNull() & (F.col("status") == "indexed")
        self.store.write("files", rules.apply_file_review(x.withColumn("match", F.when(open_, F.col("match"))), decisions))

    # plans

    def _new_plan_id(self) -> int:
        return (self.plans.agg(F.max("id")).first()[0] or 0) + 1

    def _keep(self, made: planner.Plan) -> int:
        id_ = made.plan.first()["id"]
        self.store.append("migration_steps", made.steps)
        self.store.append("migration_plans", made.plan)
        self.store.append("audit_log", made.audit)
        return id_

    def _target(self, label: str | None, check_space: bool = True) -> tuple[int, str, int | None]:
        """(id, mount path, free bytes or null if they are not asked for) of a drive; paths on a remote begin at its root."""
        if label is None:
            raise ConfigError("a target drive is needed")
        row = filters.drive_by_label(self.drives, label).first()
        if row is None:
            raise DriveNotFound(label)
        if row["backend"] == "rclone":
            return row["id"], row["mount_path"] or "", devices.remote_free(row["rclone_remote"]) if check_space else None
        if not row["mount_path"]:
            raise ConfigError(f"drive {label} has no mount path")
        return row["id"], row["mount_path"], devices.free_space(row["mount_path"]).free_bytes if check_space else None

    def plan_create(self, phase: str, source_drive: str | None = None, target_drive: str | None = None, category_filter: str | None = None, duplicate_group: int | None = None, original_file: int | None = None, max_bytes: int | None = None, scope: policies.Scope | None = None, check_space: bool = True) -> int:
        """Makes a plan; its id. max_bytes: only the first files, by id, that stay within it."""
        if phase not in planner.TYPES:
            raise ConfigError(f"{phase!r} is none of {', '.join(planner.TYPES)}")
        id_ = self._new_plan_id()
        if phase == "dedup":
            if duplicate_group is None:
                raise ConfigError("a dedup plan needs a duplicate group")
            return self._keep(planner.dedup(filters.group_members(self.files, duplicate_group), id_, self.now, original_file))
        category = category_filter or ("trash" if phase == "delete-trash" else None)
        if category is None:
            raise ConfigError("a category is needed")
        scope = scope or policies.Scope()
        rows = filters.plan_candidates(self.files, self.drives, category, source_drive, scope.include_drives, scope.exclude_drives)
        if max_bytes is not None:
            rows = planner.batch_prefix(rows, max_bytes).drop("running_bytes")
        if rows.limit(1).count() == 0:
            raise MigrationError(f"no file has the category {category!r} there")
        if phase == "delete-trash":
            return self._keep(planner.delete_trash(rows, id_, self.now))
        target, mount, free = self._target(target_drive, check_space)
        return self._keep((planner.migrate if phase == "migrate" else planner.offload)(rows, id_, self.now, target, mount, free))

    def plan_batches(self, category: str, max_bytes: int, source_drive: str | None = None) -> DataFrame:
        """(batch, files, bytes, first_id, last_id): how the files of a category, by id, fall into runs of at most max_bytes each."""
        rows = batches.all_batches(filters.plan_candidates(self.files, self.drives, category, source_drive).select("id", "size_bytes"), max_bytes)
        return rows.groupBy("batch").agg(F.count("*").alias("files"), F.coalesce(F.sum("size_bytes"), F.lit(0)).alias("bytes"), F.min("id").alias("first_id"), F.max("id").alias("last_id")).orderBy("batch")

    def plan_list(self, status: str | None = None) -> DataFrame:
        return filters.plans_by_status(self.plans, status)

    def plan_show(self, plan_id: int, limit: int = 50) -> DataFrame:
        if not filters.by_id(self.plans, plan_id).count():
            raise PlanNotFound(plan_id)
        return filters.steps_of(self.steps, plan_id).limit(limit)

    def plan_approve(self, plan_id: int) -> None:
        row = filters.by_id(self.plans, plan_id).first()
        if row is None:
            raise PlanNotFound(plan_id)
        if row["status"] != "draft":
            raise MigrationError(f"plan {plan_id} is {row['status']}, no draft")
        self.store.update("migration_plans", lambda p: planner.with_status(p, plan_id, "approved"))
        self.store.log("plan_approved", f"plan {plan_id}", plan_id, mode="manual")

    def migrate_execute(self, plan_id: int, execute: bool = False, **options) -> DataFrame:
        return executor.execute(self.store, plan_id, executor.Options(dry_run=not execute, **options))

    def rollback(self, plan_id: int) -> DataFrame:
        return executor.rollback(self.store, plan_id)

    def verify(self, plan_id: int | None = None, full: bool = False, drive: str | None = None) -> DataFrame:
        """Of a plan the steps with a hash and the failed; full: re-hashes files; else counts verified files."""
        if plan_id is not None:
            return stats.verified_counts(self.files, filters.steps_of(self.steps, plan_id))
        return executor.verify_drive(self.store, self._drive(drive))[1] if full else stats.verified_counts(self.files)

    def audit_entries(self, plan_id: int | None = None, file_id: int | None = None, limit: int | None = None) -> DataFrame:
        return filters.audit_entries(self.audit, plan_id, file_id, limit)

    # policies

    def policy_validate(self, path: str) -> policies.Policy:
        policy = policies.from_file(path)
        policy.validate()
        return policy

    policy_show = policy_validate

    def policy_apply(self, path: str, dry_run: bool = True, execute: bool = False, user_rules: str | None = None, check_space: bool = True) -> list[int]:
        """Classifies by the policy's rules, makes its plans, and carries them out within its limits; the plans' ids."""
        policy, by = policies.effective(path, user_rules)
        policy.validate()
        if execute and policy.safety.dry_run_only:
            raise ConfigError("the policy allows dry runs only")
        if by:
            self.classify_auto(rule_set=by, scope=policy.scope)
        ids = [self.plan_create(p.type, p.source_drive, p.target_drive, p.category_filter, p.duplicate_group, p.original_file, scope=policy.scope, check_space=check_space) for _, p in sorted(policy.plans.items())]
        made = self.plans.where(F.col("id").isin(*ids)) if ids else self.plans.limit(0)
        if policy.safety.max_bytes_per_run is not None:
            row = planner.run_budget(made, policies.size_of(policy.safety.max_bytes_per_run)).first()
            if not row["within_budget"]:
                raise ConfigError(f"the plans take {row['total_bytes']} bytes, more than {policy.safety.max_bytes_per_run}")
        if execute and not dry_run:
            for i in ids:
                if policy.safety.require_approval:
                    raise PlanNotApproved(i)
                self.plan_approve(i)
                self.migrate_execute(i, execute=True)
        return ids

    def validate(self) -> DataFrame:
        return schema.validate({t: self.table(t) for t in schema.TABLES if t != "schema_version"})
