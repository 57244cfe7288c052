"""Plans made of queries: a row for the plan, and its steps in order."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import ConfigError, InsufficientSpace, MigrationError
from ..functions.formats import destination, preferred_hash, safe_write_bytes
from ..operators.order import numbered, with_running
from ..schema import conform

TYPES = ("delete-trash", "dedup", "migrate", "offload")


@dataclass
class Plan:
    plan: DataFrame
    steps: DataFrame
    audit: DataFrame


def ordered_steps(rows: DataFrame, key: str, name: str = "step_order") -> DataFrame:
    """rows numbered from 0 by the key, a number."""
    return numbered(rows, [F.col(key)], name).withColumn(name, F.col(name).cast("int"))


def _step(files: DataFrame, plan_id: int, **columns: Column) -> DataFrame:
    base = {"plan_id": F.lit(plan_id), "file_id": F.col("id"), "source_path": F.col("abs_path"), "source_drive_id": F.col("drive_id"), "status": F.lit("pending")}
    return files.select("id", *[c.alias(n) for n, c in (base | columns).items()])


def _finish(steps: DataFrame, plan_id: int) -> DataFrame:
    """Steps by file id, numbered; a step's id is the plan's and its place."""
    x = ordered_steps(steps, "file_id") if "step_order" not in steps.columns else steps
    return conform(x.withColumn("id", F.lit(plan_id * 10_000_000_000) + F.col("step_order")), "migration_steps")


def _plan(files: DataFrame, plan_id: int, now: Column, description: Column, source: Column | None = None, target: int | None = None) -> DataFrame:
    none = F.lit(None).cast("long")
    x = files.agg(F.count("*").alias("n"), F.coalesce(F.sum("size_bytes"), F.lit(0)).alias("total_bytes"), (source if source is not None else F.max(none)).alias("source_drive_id"))
    x = x.select(
        F.lit(plan_id).alias("id"), now.alias("created_at"), F.format_string(description, F.col("n")).alias("description") if isinstance(description, str) else description.alias("description"), "source_drive_id",
        F.lit(target).cast("long").alias("target_drive_id"), F.lit("draft").alias("status"), F.col("n").alias("total_files"), "total_bytes", F.lit(0).alias("completed_files"), F.lit(0).alias("completed_bytes"),
    )
    return conform(x, "migration_plans")


def _audit(plan: DataFrame, now: Column, kind: str) -> DataFrame:
    details = F.format_string(f"{kind}: %d files", F.col("total_files"))
    return conform(plan.select(now.alias("timestamp"), F.lit("plan_created").alias("action"), F.col("id").alias("plan_id"), details.alias("details"), F.lit("automated").alias("agent_mode"), F.xxhash64("id").alias("id")), "audit_log")


def delete_trash(files: DataFrame, plan_id: int, now: Column) -> Plan:
    """A delete step for each file, by id; the hash to check before the deletion goes with it."""
    plan = _plan(files, plan_id, now, "Delete %d trash files")
    steps = _step(files, plan_id, action=F.lit("delete"), pre_hash=preferred_hash(F.col("blake3_hash"), F.col("md5_hash")))
    return Plan(plan, _finish(steps, plan_id), _audit(plan, now, "Delete trash plan"))


def dedup(members: DataFrame, plan_id: int, now: Column, original_id: int | None = None) -> Plan:
    """A delete step for each member of a duplicate group but its original: the named file, else the one that is marked."""
    if original_id is None:
        row = members.where("is_original").select(F.min("id")).first()
        original_id = row[0]
        if original_id is None:
            raise ConfigError("no member of the group is marked as original; name one")
    rest = members.where(F.col("id") != original_id)
    if rest.limit(1).count() == 0:
        raise MigrationError("no duplicates to delete")
    plan = _plan(rest, plan_id, now, f"Deduplicate %d files (keep original: {original_id})")
    steps = _step(rest, plan_id, action=F.lit("delete"), pre_hash=preferred_hash(F.col("blake3_hash"), F.col("md5_hash")))
    return Plan(plan, _finish(steps, plan_id), _audit(plan, now, "Deduplication plan"))


def migrate(files: DataFrame, plan_id: int, now: Column, target_id: int, mount: str, free_bytes: int | None = None) -> Plan:
    """A copy step for each file to its target path, or its own path, below the mount. free_bytes: the plan must fit into the safe part of it."""
    check_space(files, free_bytes)
    plan = _plan(files, plan_id, now, f"Migrate %d files to target drive {target_id}", F.min_by("drive_id", "id"), target_id)
    steps = _step(files, plan_id, action=F.lit("copy"), dest_path=destination(F.lit(mount), F.col("path"), F.col("target_path")), dest_drive_id=F.lit(target_id), pre_hash=preferred_hash(F.col("blake3_hash"), F.col("md5_hash")))
    return Plan(plan, _finish(steps, plan_id), _audit(plan, now, "Migration plan"))


def offload(files: DataFrame, plan_id: int, now: Column, target_id: int, mount: str, free_bytes: int | None = None) -> Plan:
    """A copy step, then a delete step, for each file."""
    check_space(files, free_bytes)
    plan = _plan(files, plan_id, now, f"Offload %d files to drive {target_id}", F.min_by("drive_id", "id"), target_id)
    hash_ = preferred_hash(F.col("blake3_hash"), F.col("md5_hash"))
    rows = ordered_steps(_step(files, plan_id, pre_hash=hash_, to=destination(F.lit(mount), F.col("path"))), "file_id", "i")
    pair = F.array(F.struct(F.lit("copy").alias("action"), F.col("to").alias("dest_path"), F.lit(target_id).cast("long").alias("dest_drive_id")), F.struct(F.lit("delete").alias("action"), F.lit(None).cast("string").alias("dest_path"), F.lit(None).cast("long").alias("dest_drive_id")))
    steps = rows.select("*", F.posexplode(pair).alias("k", "x")).withColumn("step_order", F.col("i") * 2 + F.col("k")).select("*", "x.*")
    return Plan(plan, _finish(steps, plan_id), _audit(plan, now, "Offload plan"))


def totals(files: DataFrame) -> DataFrame:
    return files.agg(F.count("*").alias("total_files"), F.coalesce(F.sum("size_bytes"), F.lit(0)).alias("total_bytes"))


def check_space(files: DataFrame, free_bytes: int | None) -> None:
    if free_bytes is None:
        return
    need, room = totals(files).first()["total_bytes"], free_bytes // 2
    if need > room:
        raise InsufficientSpace(f"{need} bytes needed, {room} may be written")


def fits(free: Column, available: Column, need: Column) -> Column:
    return need <= safe_write_bytes(free, available)


def batch_prefix(files: DataFrame, max_bytes: int, key: str = "id") -> DataFrame:
    """The files, by a numeric key, until the first that would take the sum over max_bytes. Sizes are never negative, so the running sum only grows."""
    return with_running(files, key, {"running_bytes": F.col("size_bytes")}).where(F.col("running_bytes") <= max_bytes)


def run_budget(plans: DataFrame, max_bytes: int) -> DataFrame:
    """One row: the plans' bytes, and whether a run may take them."""
    x = plans.agg(F.coalesce(F.sum("total_bytes"), F.lit(0)).cast("long").alias("total_bytes"))
    return x.select("total_bytes", (F.col("total_bytes") <= max_bytes).alias("within_budget"))


def rollback_feasible(steps: DataFrame) -> DataFrame:
    """(plan_id, can_rollback): a plan with a completed deletion can't be taken back."""
    gone = (F.col("status") == "completed") & (F.col("action") == "delete")
    return steps.groupBy("plan_id").agg((~F.bool_or(gone)).alias("can_rollback"))


def rollback_order(steps: DataFrame, plan_id: int | None = None) -> DataFrame:
    """Completed steps, the last first."""
    rows = steps.where("status = 'completed'")
    return (rows.where(F.col("plan_id") == plan_id) if plan_id is not None else rows).orderBy("plan_id", F.desc("step_order"))


def dry_run(steps: DataFrame) -> DataFrame:
    """What the execution would do, step by step."""
    to = F.when(F.col("dest_path").isNotNull(), F.concat(F.lit(" -> "), "dest_path")).otherwise("")
    return steps.orderBy("plan_id", "step_order").select("plan_id", "step_order", "action", F.concat(F.lit("would "), "action", F.lit(" "), "source_path", to).alias("outcome"))


def with_status(plans: DataFrame, plan_id: int, status: str, when: tuple[str, ...] | None = None) -> DataFrame:
    """The plan set to a status; when: only from one of these."""
    hit = F.col("id") == plan_id
    hit = hit & F.col("status").isin(*when) if when else hit
    return plans.withColumn("status", F.when(hit, F.lit(status)).otherwise(F.col("status")))
