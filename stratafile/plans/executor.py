"""Carrying plans out: file operations on the driver, one step at a time. Nothing here runs in executors, as Spark may run a task twice. Dry runs are the default.

A journal line is on the disk before a step begins and after it ends (plans/journal.py). The tables are written from it when a run ends: steps, files, the audit log, and the plan's state last; writing them again
changes nothing, and the journal goes only then. If the driver is lost, whenever, the next call does that first, and
looks at the one step that had begun: what it left decides whether it is done or carried out again. Rollbacks are journalled alike. A rollback removes a destination only if it still is what the step made.

A deletion needs the hash that the plan was made for; without one it fails, unless the options name `unhashed_deletes`. Where a step goes is told by the destination drive's backend: local folders, or a remote by rclone."""

from __future__ import annotations

import os
import shutil
from collections.abc import Iterable
from dataclasses import dataclass, field
from datetime import datetime, timezone

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import CatalogueError, ConfigError, DestinationVerification, FileMissing, InsufficientSpace, MigrationError, PlanNotApproved, PlanNotFound, SourceChanged
from ..functions.hashing import algorithm_of, hash_file
from ..operators.order import numbered
from ..schema import conform
from ..sources.devices import free_space, run_tool
from ..store import Store, set_from, set_where
from . import planner
from .journal import Journal

RSYNC = ("rsync", "--archive", "--checksum", "--partial", "--sparse")
RCLONE = ("--transfers", "4", "--checkers", "8")


@dataclass
class Options:
    dry_run: bool = True
    verify_hashes: bool = True
    enforce_space: bool = True
    use_rsync: bool = False
    unhashed_deletes: bool = False


@dataclass
class Done:
    step_id: int
    status: str
    post_hash: str | None = None
    error: str | None = None
    bytes: int = 0
    at: datetime = field(default_factory=lambda: datetime.now(timezone.utc).replace(tzinfo=None))


def _check_source(path: str, pre_hash: str | None) -> str | None:
    """The source's hash, which must be the one that the plan was made for."""
    if not os.path.lexists(path):
        raise FileMissing(path)
    if not pre_hash:
        return None
    now = hash_file(path, algorithm_of(pre_hash))
    if now.lower() != pre_hash.lower():
        raise SourceChanged(f"{path}: expected {pre_hash}, found {now}")
    return now


def copy_file(source: str, dest: str, expected: str | None, options: Options) -> str:
    """Copies, then hashes what was written; the hash."""
    if options.enforce_space:
        parent = os.path.dirname(dest)
        while parent and not os.path.isdir(parent):
            parent = os.path.dirname(parent)
        if not free_space(parent or "/").can_safely_write(os.path.getsize(source)):
            raise InsufficientSpace(f"{dest}: {os.path.getsize(source)} bytes needed")
    os.makedirs(os.path.dirname(dest), exist_ok=True)
    if options.use_rsync:
        run_tool(*RSYNC, source, dest)
    else:
        part = f"{dest}.part"
        shutil.copy2(source, part, follow_symlinks=False)
        os.replace(part, dest)
    kind = algorithm_of(expected) if expected else "md5"
    want, got = expected or hash_file(source, kind), hash_file(dest, kind)
    if options.verify_hashes and want.lower() != got.lower():
        raise DestinationVerification(dest)
    return got


def _delete(source: str, pre_hash: str | None, options: Options) -> str | None:
    """Deletes a file that still is what the plan was made for; its hash."""
    if not pre_hash and not options.unhashed_deletes:
        raise MigrationError(f"{source}: no hash to check before it is deleted")
    now = _check_source(source, pre_hash)
    os.remove(source)
    return now


def _was_done(step, options: Options) -> bool:
    """Whether a step that had begun before the driver was lost is done, by what it left."""
    source, dest, action = step["source_path"], step["dest_path"], step["action"]
    if action == "move" and not os.path.lexists(source) and os.path.exists(dest):
        if step["pre_hash"] and options.verify_hashes and hash_file(dest, algorithm_of(step["pre_hash"])).lower() != step["pre_hash"].lower():
            raise DestinationVerification(dest)
        return True
    if action in ("hardlink", "symlink"):
        return os.path.lexists(dest) and os.path.samefile(source, dest)
    return False


def run_step(step, options: Options, remotes: dict[int, str] | None = None, begun: bool = False) -> Done:
    """Carries out one step; the error, if any, is in the result. remotes: the remote of each drive that has one. begun: the step began in an earlier run that was lost."""
    source, dest = step["source_path"], step["dest_path"]
    remote = (remotes or {}).get(step.get("dest_drive_id"))
    try:
        if step["action"] == "delete" and not os.path.lexists(source):
            return Done(step["id"], "completed")  # it is gone already
        if begun and remote is None and _was_done(step, options):
            return Done(step["id"], "completed", step["pre_hash"])
        size = os.path.getsize(source) if os.path.exists(source) else 0
        post = _check_source(source, step["pre_hash"] if options.verify_hashes and step["action"] != "delete" else None)
        if step["action"] in ("copy", "move", "hardlink", "symlink") and not dest:
            raise MigrationError(f"step {step['id']} has no destination")
        if step["action"] in ("copy", "move") and remote is not None:
            copy_remote(source, f"{remote}:{dest.lstrip('/')}", one_file=True)
        elif step["action"] in ("copy", "move"):
            post = copy_file(source, dest, step["pre_hash"], options)
        if step["action"] == "delete" or step["action"] == "move" and remote is not None:
            post = _delete(source, step["pre_hash"], options)
        elif step["action"] == "move":
            os.remove(source)  # the copy was compared with it
        elif step["action"] in ("hardlink", "symlink"):
            os.makedirs(os.path.dirname(dest), exist_ok=True)
            (os.link if step["action"] == "hardlink" else os.symlink)(source, dest)
        elif step["action"] != "copy":
            raise MigrationError(f"unknown action {step['action']!r}")
        return Done(step["id"], "completed", post, None, size)
    except (OSError, CatalogueError, ValueError) as e:
        return Done(step["id"], "failed", None, str(e) or type(e).__name__)


def _results(store: Store, done: Iterable[Done]) -> DataFrame:
    return store.spark.createDataFrame([(d.step_id, d.status, d.post_hash, d.error, d.at) for d in done], "id long, status string, post_hash string, error string, executed_at timestamp")


def step_entries(known: DataFrame, steps: DataFrame, results: DataFrame, done: str, failed: str) -> DataFrame:
    """Audit rows, one for each result of a step, that `known` lacks; results: (id, status, error, executed_at)."""
    x = steps.select("id", "plan_id", "step_order", "file_id", "source_drive_id", "action", "source_path").join(results, "id")
    text = F.concat(F.lit("step "), F.col("id").cast("string"), F.lit(": "), F.coalesce("error", F.concat("action", F.lit(" "), "source_path")))
    rows = x.select("step_order", F.col("executed_at").alias("timestamp"), F.when(F.col("status") == "failed", failed).otherwise(done).alias("action"), "plan_id", "file_id", F.col("source_drive_id").alias("drive_id"), text.alias("details"), F.lit("automated").alias("agent_mode"))
    rows = rows.join(known.select("plan_id", "action", "details", "timestamp"), ["plan_id", "action", "details", "timestamp"], "left_anti")
    last = known.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
    return conform(numbered(rows, [F.col("step_order")], "id").withColumn("id", F.col("id") + last + 1), "audit_log")


def progress(plans: DataFrame, steps: DataFrame, files: DataFrame, plan_id: int) -> DataFrame:
    """The plans table with the state of a plan that was begun, by its steps: aborted if one failed, in progress while some are pending; the completed steps and their files' bytes."""
    own = steps.where(F.col("plan_id") == plan_id).join(files.select(F.col("id").alias("file_id"), F.col("size_bytes").alias("_size")), "file_id", "left")
    good = F.col("status") == "completed"
    state = F.when(F.count_if(F.col("status") == "failed") > 0, "aborted").when(F.count_if(F.col("status") == "pending") > 0, "in_progress").otherwise("completed")
    x = own.agg(state.alias("status"), F.count_if(good).alias("completed_files"), F.coalesce(F.sum(F.when(good, F.col("_size"))), F.lit(0)).alias("completed_bytes"))
    return set_from(plans, x.select(F.lit(plan_id).cast("long").alias("id"), "*"))


def _fold(store: Store, plan_id: int, done: list[Done]) -> None:
    """Writes results into steps, files, the audit log and, last, the plan. Repeating it changes nothing."""
    results = _results(store, done)
    store.update("migration_steps", lambda s: set_from(s, results))
    steps = store.read("migration_steps").where(F.col("plan_id") == plan_id)
    store.update("files", lambda f: files_after(f, steps.join(results.select("id"), "id", "left_semi").where("status = 'completed'")))
    store.append("audit_log", step_entries(store.read("audit_log"), steps, results, "step_completed", "step_failed"))
    store.update("migration_plans", lambda p: progress(p, store.read("migration_steps"), store.read("files"), plan_id))


def recover(store: Store, plan_id: int) -> tuple[int | None, bool]:
    """Writes what the journal of a lost run holds into the tables; (the step that had begun and not ended, if any, whether there was a journal)."""
    journal = Journal(store, plan_id)
    ended, begun = journal.read()
    if ended:
        _fold(store, plan_id, [Done(**d) for d in ended])
        store.log("plan_recovered", f"plan {plan_id}: {len(ended)} steps from the journal", plan_id)
    journal.clear()
    return begun, bool(ended)


def execute(store: Store, plan_id: int, options: Options | None = None) -> DataFrame:
    """Carries out an approved plan's pending steps in order; the first failure aborts the plan. A dry run, of drafts as well, gives what would be done.

    A plan whose run was lost goes on where its journal ends. Steps are streamed to the driver; their results, the plan's progress and the files' new states are written as tables afterwards."""
    options = options or Options()
    plan = store.read("migration_plans").where(F.col("id") == plan_id).first()
    if plan is None:
        raise PlanNotFound(plan_id)
    if options.dry_run:
        return planner.dry_run(store.read("migration_steps").where(F.col("plan_id") == plan_id))
    begun, folded = recover(store, plan_id)
    plan = store.read("migration_plans").where(F.col("id") == plan_id).first()
    if plan["status"] not in ("approved", "in_progress"):
        if folded:  # the lost run had come to its end
            return store.read("migration_steps").where(F.col("plan_id") == plan_id).orderBy("step_order")
        raise PlanNotApproved(plan_id)
    steps = store.read("migration_steps").where(F.col("plan_id") == plan_id)
    remotes = remotes_of(store)
    if plan["status"] == "approved":
        store.update("migration_plans", lambda p: planner.with_status(p, plan_id, "in_progress"))
        store.log("plan_started", f"plan {plan_id}", plan_id)
    done: list[Done] = []
    last = steps.where("status = 'completed'").orderBy(F.desc("step_order")).first()
    copied = (last["file_id"], last["post_hash"]) if last is not None and last["action"] == "copy" else None
    with Journal(store, plan_id) as journal:
        for row in steps.where("status = 'pending'").orderBy("step_order").toLocalIterator():
            step = row.asDict()
            if step["action"] == "delete" and not step["pre_hash"] and copied and copied[0] == step["file_id"]:
                step["pre_hash"] = copied[1]  # the copy that was just made and compared
            journal.begin(step["id"])
            done.append(run_step(step, options, remotes, step["id"] == begun))
            journal.end(vars(done[-1]))
            if done[-1].status == "failed":
                break
            copied = (step["file_id"], done[-1].post_hash) if step["action"] == "copy" else None
    failed = next((d for d in done if d.status == "failed"), None)
    if done:
        _fold(store, plan_id, done)
    else:
        store.update("migration_plans", lambda p: planner.with_status(p, plan_id, "completed"))
    store.log("step_failed" if failed else "plan_completed", failed.error if failed else f"plan {plan_id}: {len(done)} steps", plan_id)
    Journal(store, plan_id).clear()
    return store.read("migration_steps").where(F.col("plan_id") == plan_id).orderBy("step_order")


def remotes_of(store: Store) -> dict[int, str]:
    """The remote of each drive that has one."""
    return {r["id"]: r["rclone_remote"] for r in store.read("drives").where("backend = 'rclone'").collect()}


def _hash_at(path: str, remote: str | None, kind: str) -> str | None:
    """The hash of a file on a local or remote drive; null if it isn't there."""
    if remote is None:
        return hash_file(path, kind).lower() if os.path.lexists(path) else None
    name = path.lstrip("/")
    if not run_tool("rclone", "lsf", "--files-only", f"{remote}:{os.path.dirname(name)}", "--include", f"/{_literal(os.path.basename(name))}").strip():
        return None
    words = run_tool("rclone", "hashsum", kind, f"{remote}:{name}", "--download").split()
    if not words:
        raise FileMissing(f"{remote}:{name} has no {kind}")
    return words[0].lower()


def _literal(name: str) -> str:
    """A file name as a filter that matches nothing else."""
    return "".join("\\" + c if c in "*?[]{}\\" else c for c in name)


def _remove(path: str, remote: str | None) -> None:
    run_tool("rclone", "deletefile", f"{remote}:{path.lstrip('/')}") if remote is not None else os.remove(path)


def roll_step_back(step, options: Options, remotes: dict[int, str] | None = None) -> Done:
    """Takes one completed step back; the error, if any, is in the result. A destination that is gone, or a move that is back already, is no failure; one that was changed since stays and is one."""
    source, dest, action = step["source_path"], step["dest_path"], step["action"]
    remote = (remotes or {}).get(step["dest_drive_id"])
    try:
        if not dest:
            raise MigrationError(f"step {step['id']} has no destination")
        if action in ("hardlink", "symlink"):
            if os.path.lexists(dest):
                if not (os.path.islink(dest) and os.readlink(dest) == source if action == "symlink" else os.path.samefile(source, dest)):
                    raise DestinationVerification(dest)
                os.remove(dest)
            return Done(step["id"], "rolled_back")
        if action not in ("copy", "move"):
            raise MigrationError(f"a {action} can't be taken back")
        expected = step["post_hash"] or step["pre_hash"]
        there = os.path.lexists(source)
        if action == "copy" and not there:
            raise FileMissing(source)  # the copy may be the last one
        if not expected and not there:
            raise MigrationError(f"{dest}: no hash to compare it with")
        expected = (expected or hash_file(source, "md5")).lower()
        kind = algorithm_of(expected)
        found = _hash_at(dest, remote, kind)
        if found is not None and found != expected:
            raise DestinationVerification(dest)
        if action == "move":
            if there and hash_file(source, kind).lower() != expected:
                raise SourceChanged(f"{source} is another file now")
            if found is None and not there:
                raise FileMissing(dest)
            if not there:
                if remote is None:
                    copy_file(dest, source, expected, options)
                else:
                    os.makedirs(os.path.dirname(source), exist_ok=True)
                    copy_remote(f"{remote}:{dest.lstrip('/')}", source, one_file=True)
                    _check_source(source, expected)
        if found is not None:
            _remove(dest, remote)
        return Done(step["id"], "rolled_back")
    except (OSError, CatalogueError, ValueError) as e:
        return Done(step["id"], "failed", None, str(e) or type(e).__name__)


def _fold_back(store: Store, plan_id: int, done: list[Done]) -> None:
    """Writes what a rollback did into steps, files, the audit log and, last, the plan. A step that couldn't be taken back stays completed, with the error. Repeating it changes nothing."""
    results = _results(store, done)
    store.update("migration_steps", lambda x: set_from(x, results.withColumn("status", F.when(F.col("status") != "failed", F.col("status"))).select("id", "status", "error")))
    steps = store.read("migration_steps").where(F.col("plan_id") == plan_id)
    store.update("files", lambda f: files_back(f, steps, results))
    store.append("audit_log", step_entries(store.read("audit_log"), steps, results, "step_rolled_back", "step_rollback_failed"))
    store.update("migration_plans", lambda p: planner.with_status(p, plan_id, "aborted"))


def rollback(store: Store, plan_id: int, options: Options | None = None) -> DataFrame:
    """Takes completed steps back, the last first, until one can't be; (id, status, post_hash, error, executed_at) of each. A plan with a completed deletion can't be taken back.

    A run, or a rollback, of the plan that was lost is written into the tables first; what it had taken back is in the result."""
    options = options or Options(dry_run=False)
    recover(store, plan_id)
    steps = store.read("migration_steps").where(F.col("plan_id") == plan_id)
    row = planner.rollback_feasible(steps).first()
    if row is None:
        raise PlanNotFound(plan_id)
    if not row["can_rollback"]:
        raise MigrationError(f"plan {plan_id} has completed deletions")
    remotes = remotes_of(store)
    before = [d for d in (Done(**d) for d in Journal(store, plan_id, "rollback").read()[0]) if d.status == "rolled_back"]
    known, done = {d.step_id for d in before}, list(before)
    with Journal(store, plan_id, "rollback") as journal:
        for s in planner.rollback_order(steps).toLocalIterator():
            if s["id"] in known:
                continue
            journal.begin(s["id"])
            done.append(roll_step_back(s.asDict(), options, remotes))
            journal.end(vars(done[-1]))
            if done[-1].status == "failed":
                break
    _fold_back(store, plan_id, done)
    failed = next((d for d in done if d.status == "failed"), None)
    store.log("rollback_failed" if failed else "plan_rolled_back", failed.error if failed else f"plan {plan_id}: {len(done)} steps", plan_id)
    Journal(store, plan_id, "rollback").clear()
    return _results(store, done)


def files_back(files: DataFrame, steps: DataFrame, results: DataFrame) -> DataFrame:
    """The files table after a rollback: the files of steps that were taken back are where they were. results: (id, status) of steps."""
    back = steps.join(results.where("status = 'rolled_back'").select("id"), "id", "left_semi").select("file_id").distinct()
    marked = files.join(back.select(F.col("file_id").alias("id"), F.lit(True).alias("_back")), "id", "left")
    return set_where(marked, F.col("_back"), status="classified", migrated_to=None, migrated_to_drive=None).drop("_back").select(*files.columns)


def files_after(files: DataFrame, steps: DataFrame) -> DataFrame:
    """The files table after these completed steps: where copies and moves went, and what is gone."""
    moved = steps.where("action in ('copy', 'move')").groupBy(F.col("file_id").alias("id")).agg(F.max_by("dest_path", "step_order").alias("migrated_to"), F.max_by("dest_drive_id", "step_order").alias("migrated_to_drive"), F.max("executed_at").alias("migrated_at"), F.max_by("post_hash", "step_order").alias("verified_hash"), F.lit("verified").alias("status"))
    gone = steps.where("action in ('delete', 'move')").select(F.col("file_id").alias("id"), F.lit("source_removed").alias("status")).distinct()
    return set_from(set_from(files, moved), gone)


def copy_remote(source: str, dest: str, move: bool = False, one_file: bool = False) -> None:
    """Copies or moves between a local folder and a remote (remote:path), either way; one_file: source and dest name a file."""
    if ":" not in source and ":" not in dest:
        raise ConfigError("neither side is a remote")
    run_tool("rclone", ("move" if move else "copy") + ("to" if one_file else ""), source, dest, *RCLONE)


def verify_drive(store: Store, drive_id: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(files checked, outcomes): re-hashes the files of a drive, or of all, by the hash that they have. Executors read the files."""
    from ..functions.hashing import hash_files
    from ..functions.formats import preferred_hash
    from ..operators.stats import verify_outcomes

    files = store.read("files").where("not coalesce(is_symlink, false) and status <> 'source_removed'")
    files = files.where(F.col("drive_id") == drive_id) if drive_id is not None else files
    rows = files.select("id", "abs_path", preferred_hash(F.col("blake3_hash"), F.col("md5_hash")).alias("expected"))
    parts = [hash_files(rows.where(F.length("expected") == n), kind) for n, kind in ((64, "blake3"), (32, "md5"))]
    checked = parts[0].unionByName(parts[1]).unionByName(rows.where("expected is null").withColumns({"hash": F.lit(None).cast("string"), "error": F.lit(None).cast("string")}))
    checked = checked.withColumnRenamed("hash", "actual").withColumn("exists", ~F.coalesce(F.col("error").contains("No such file"), F.lit(False)))
    return checked, verify_outcomes(checked)


__all__ = ["Options", "copy_file", "copy_remote", "execute", "recover", "roll_step_back", "rollback", "run_step", "verify_drive"]
