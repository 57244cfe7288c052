"""The catalogue's registered queries over the driver's tables, each with the SQL it is compared with."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import schema, store
from .functions import formats, hashing, mime
from .operators import dedup, filters, folders, joins, lint, moves, reports, rules, staged, stats, trigrams
from .plans import batches, executor, planner
from .plans import policy as policies
from .registry import oracle_sql, queries, query
from .scratch import scratch
from .sources import fixtures as fx
from .sources import fs
from .sources import lint as lint_source

__all__ = ["oracle_sql", "queries"]


def now():
    return F.lit(fx.AS_OF).cast("timestamp")
FILE = ("id", "drive_id", "path", "size_bytes")


def grouped(spark, sf):
    """(files with their groups, groups)"""
    return dedup.refresh(fx.files(spark, sf))


def files_sql(where: str, columns: str = "id, drive_id, path, size_bytes", tail: str = "", source: str = "f") -> str:
    return f"WITH {fx.GROUPS_SQL if source == 'm' else fx.FILES_SQL} SELECT {columns} FROM {source} WHERE {where} {tail}"


GROUP_COLUMNS = ("group_id", "hash", "file_count", "total_waste_bytes", "original_id", "drives", "cross_drive")
GROUP_SQL = "SELECT group_id, hash, file_count, total_waste_bytes, original_id, array_to_string(drives, ',') AS drives, cross_drive FROM g"


def group_rows(groups):
    """Groups with the drives as text, so that engines compare alike."""
    return groups.withColumn("drives", F.array_join(F.col("drives_involved").cast("array<string>"), ",")).select(*GROUP_COLUMNS)


# Duplicates


@query("duplicate_groups", f"WITH {fx.GROUPS_SQL} {GROUP_SQL}")
def _(spark, sf):
    return group_rows(dedup.by_waste(dedup.duplicate_groups(fx.files(spark, sf))))


@query("duplicate_groups_md5_of_drive", f"WITH {fx.FILES_SQL} SELECT min(id) AS group_id, md5_hash AS hash, CAST(count(*) AS INTEGER) AS file_count, CAST(sum(size_bytes) - arg_min(size_bytes, id) AS BIGINT) AS total_waste_bytes FROM f WHERE drive_id = 9 AND md5_hash IS NOT NULL AND size_bytes >= 10 GROUP BY md5_hash HAVING count(*) > 1")
def _(spark, sf):
    return dedup.duplicate_groups(fx.files(spark, sf), "md5", drive=9, min_size=10).select("group_id", "hash", "file_count", "total_waste_bytes")


@query("duplicate_original_assignment", files_sql("true", "id, duplicate_group, is_original", source="m"))
def _(spark, sf):
    return grouped(spark, sf)[0].select("id", "duplicate_group", "is_original")


@query("duplicate_statistics", f"WITH {fx.GROUPS_SQL} SELECT count(*) AS group_count, CAST(coalesce(sum(file_count), 0) AS BIGINT) AS total_duplicate_files, CAST(coalesce(sum(total_waste_bytes), 0) AS BIGINT) AS total_waste_bytes, count(*) FILTER (cross_drive) AS cross_drive_groups FROM g")
def _(spark, sf):
    return dedup.duplicate_statistics(dedup.duplicate_groups(fx.files(spark, sf)))


@query("cross_drive_groups", f"WITH {fx.GROUPS_SQL} {GROUP_SQL} WHERE cross_drive")
def _(spark, sf):
    return group_rows(dedup.cross_drive_groups(dedup.duplicate_groups(fx.files(spark, sf))))


@query("same_drive_groups", f"WITH {fx.GROUPS_SQL} {GROUP_SQL} WHERE NOT cross_drive AND total_waste_bytes >= 100 ORDER BY total_waste_bytes DESC, group_id LIMIT 50")
def _(spark, sf):
    return group_rows(dedup.same_drive_groups(dedup.duplicate_groups(fx.files(spark, sf)), min_size=100))


@query("groups_touching_drive", f"WITH {fx.GROUPS_SQL} {GROUP_SQL} WHERE list_contains(drives, 1) ORDER BY total_waste_bytes DESC, group_id LIMIT 50")
def _(spark, sf):
    return group_rows(dedup.groups_touching(dedup.duplicate_groups(fx.files(spark, sf)), 1))


@query("groups_touching_drive_waste", f"WITH {fx.GROUPS_SQL} SELECT CAST(coalesce(sum(total_waste_bytes), 0) AS BIGINT) AS waste, count(*) AS group_count FROM g WHERE list_contains(drives, 1)")
def _(spark, sf):
    return dedup.groups_touching(dedup.duplicate_groups(fx.files(spark, sf)), 1, limit=None).agg(F.coalesce(F.sum("total_waste_bytes"), F.lit(0)).alias("waste"), F.count("*").alias("group_count"))


@query("group_members", f"WITH {fx.GROUPS_SQL} SELECT id, drive_id, path, size_bytes, is_original FROM m WHERE duplicate_group = (SELECT min(group_id) FROM g)")
def _(spark, sf):
    files, groups = grouped(spark, sf)
    return filters.group_members(files, groups.agg(F.min("group_id")).first()[0]).select(*FILE, "is_original")


@query("group_original", f"WITH {fx.GROUPS_SQL} SELECT id, path FROM m WHERE is_original AND duplicate_group = (SELECT min(group_id) FROM g)")
def _(spark, sf):
    files, groups = grouped(spark, sf)
    return dedup.original_of(files, groups.agg(F.min("group_id")).first()[0]).select("id", "path")


@query("group_by_id", f"WITH {fx.GROUPS_SQL} {GROUP_SQL} WHERE group_id = (SELECT min(group_id) FROM g)")
def _(spark, sf):
    groups = dedup.duplicate_groups(fx.files(spark, sf))
    least = groups.agg(F.min("group_id").alias("group_id"))
    return group_rows(groups.join(least, "group_id", "left_semi"))


@query("same_drive_waste_copies", f"WITH {fx.GROUPS_SQL} SELECT g.group_id, g.hash, g.total_waste_bytes, count(*) AS copies FROM g JOIN m ON m.duplicate_group = g.group_id WHERE NOT g.cross_drive GROUP BY ALL")
def _(spark, sf):
    files, groups = grouped(spark, sf)
    return dedup.same_drive_copies(groups, files)


@query("group_resolution", f"WITH {fx.GROUPS_SQL} SELECT group_id, CASE WHEN group_id = (SELECT min(group_id) FROM g) THEN 'keep' END AS resolution FROM g")
def _(spark, sf):
    groups = dedup.duplicate_groups(fx.files(spark, sf))
    return dedup.set_resolution(groups, groups.agg(F.min("group_id")).first()[0], "keep").select("group_id", "resolution")


# Selections


@query("file_by_id", files_sql("id = 17"))
def _(spark, sf):
    return filters.by_id(fx.files(spark, sf), 17).select(*FILE)


@query("file_by_abs_path", f"WITH {fx.FILES_SQL} SELECT id, drive_id, path, size_bytes FROM f WHERE abs_path = (SELECT abs_path FROM f WHERE id = 17) ORDER BY id LIMIT 1")
def _(spark, sf):
    files = fx.files(spark, sf)
    return filters.by_abs_path(files, files.where("id = 17").select("abs_path").first()[0]).select(*FILE)


@query("files_by_hash", f"WITH {fx.GROUPS_SQL} SELECT id, drive_id, path, size_bytes FROM m WHERE blake3_hash = (SELECT min(hash) FROM g)")
def _(spark, sf):
    files = fx.files(spark, sf)
    return filters.by_hash(files, dedup.duplicate_groups(files).agg(F.min("hash")).first()[0]).select(*FILE)


@query("files_by_drive", files_sql("drive_id = 2", tail="ORDER BY path, id"))
def _(spark, sf):
    return filters.by_drive(fx.files(spark, sf), 2).select(*FILE)


@query("files_by_category", files_sql("category = 'photos'"))
def _(spark, sf):
    return filters.by_category(fx.files(spark, sf), "photos").select(*FILE)


@query("files_by_category_and_drive", files_sql("category = 'photos' AND drive_id = 2"))
def _(spark, sf):
    return filters.by_category(fx.files(spark, sf), "photos", 2).select(*FILE)


@query("category_page", files_sql("category = 'documents'", tail="ORDER BY id LIMIT 100"))
def _(spark, sf):
    return filters.by_category(fx.files(spark, sf), "documents", limit=100).select(*FILE)


@query("unclassified_files", files_sql("category IS NULL AND status = 'indexed'", tail="ORDER BY size_bytes DESC, id LIMIT 100"))
def _(spark, sf):
    return filters.unclassified(fx.files(spark, sf), limit=100).select(*FILE)


@query("unclassified_of_drive", files_sql("category IS NULL AND status = 'indexed' AND drive_id = 0"))
def _(spark, sf):
    return filters.unclassified(fx.files(spark, sf), drive_id=0).select(*FILE)


@query("large_files", files_sql("size_bytes >= 3000", "id, drive_id, path, size_bytes, category, priority, status", "ORDER BY size_bytes DESC, id LIMIT 50"))
def _(spark, sf):
    return filters.large_files(fx.files(spark, sf), 3000, 50)


@query("query_files", files_sql(r"category = 'documents' AND extension = 'txt' AND size_bytes >= 500 AND path ILIKE '%EN/d_cs%' ESCAPE '\' AND drive_id = 1", tail="ORDER BY size_bytes DESC, id"))
def _(spark, sf):
    return filters.search(fx.files(spark, sf), "documents", "txt", 500, "EN/d_cs", 1).select(*FILE)


@query("pages_containing", r"SELECT page_id, url FROM pages WHERE url ILIKE '%EXAMPLE.%/en/%' ESCAPE '\'")
def _(spark, sf):
    return fx.table(spark, sf, "pages").where(formats.contains_like(F.col("url"), "EXAMPLE.%/en/")).select("page_id", "url")


@query("scoped_files", files_sql("drive_id IN (0, 1, 2, 3) AND drive_id NOT IN (3) AND (starts_with(abs_path, '/mnt/drive0/en') OR starts_with(abs_path, '/mnt/drive1')) AND NOT starts_with(abs_path, '/mnt/drive1/de/d')"))
def _(spark, sf):
    return filters.in_scope(fx.files(spark, sf), [0, 1, 2, 3], [3], ["/mnt/drive0/en", "/mnt/drive1"], ["/mnt/drive1/de/d"]).select(*FILE)


@query("plan_candidates", files_sql("category = 'photos' AND drive_id NOT IN (1, 2)"))
def _(spark, sf):
    return filters.plan_candidates(fx.files(spark, sf), fx.drives(spark, sf), "photos", exclude=["src1", "src2"]).select(*FILE)


@query("plan_candidates_included", files_sql("category = 'photos' AND drive_id = 2"))
def _(spark, sf):
    return filters.plan_candidates(fx.files(spark, sf), fx.drives(spark, sf), "photos", include=["src2", "src1"], exclude=["src1"]).select(*FILE)


@query("drive_by_label", f"WITH {fx.DRIVES_SQL} SELECT id, label, role FROM dr WHERE label = 'src1'")
def _(spark, sf):
    return filters.drive_by_label(fx.drives(spark, sf), "src1").select("id", "label", "role")


@query("list_drives_online", f"WITH {fx.DRIVES_SQL} SELECT id, label, role, is_online FROM dr WHERE is_online")
def _(spark, sf):
    return filters.list_drives(fx.drives(spark, sf), online=True).select("id", "label", "role", "is_online")


@query("audit_entries", "SELECT event_id AS id, ts AS timestamp, event_type AS action, user_id AS file_id FROM events ORDER BY ts DESC, event_id DESC LIMIT 500")
def _(spark, sf):
    return filters.audit_entries(fx.audit(spark, sf), limit=500).select("id", "timestamp", "action", "file_id")


@query("audit_entries_of_plan", "SELECT event_id AS id, event_type AS action, props AS details FROM events WHERE event_id % 3 = 0 AND event_id % 50 = 7")
def _(spark, sf):
    return filters.audit_entries(fx.audit(spark, sf), plan_id=7).select("id", "action", "details")


@query("plans_by_status", f"WITH {fx.PLANS_SQL} SELECT id, created_at, total_bytes FROM p WHERE status = 'approved'")
def _(spark, sf):
    return filters.plans_by_status(fx.plans(spark, sf), "approved").select("id", "created_at", "total_bytes")


@query("plan_by_id", f"WITH {fx.PLANS_SQL} SELECT id, created_at, status, total_bytes FROM p WHERE id = 33")
def _(spark, sf):
    return filters.by_id(fx.plans(spark, sf), 33).select("id", "created_at", "status", "total_bytes")


@query("plan_steps", f"WITH {fx.STEPS_SQL} SELECT plan_id, step_order, action, source_path, status FROM s WHERE plan_id = 1046")
def _(spark, sf):
    return filters.steps_of(fx.steps(spark, sf), 1046).select("plan_id", "step_order", "action", "source_path", "status")


@query("pending_steps", f"WITH {fx.STEPS_SQL} SELECT plan_id, step_order, action, source_path FROM s WHERE plan_id = 1046 AND status = 'pending'")
def _(spark, sf):
    return filters.steps_of(fx.steps(spark, sf), 1046, pending_only=True).select("plan_id", "step_order", "action", "source_path")


@query("all_steps_numbered", f"WITH {fx.STEPS_SQL} SELECT plan_id, step_order, file_id, action, status FROM s")
def _(spark, sf):
    return fx.steps(spark, sf).select("plan_id", "step_order", "file_id", "action", "status")


# Across drives


@query("backup_unique_counts", f"WITH {fx.FILES_SQL}, {fx.DRIVES_SQL} SELECT dr.id AS drive_id, dr.label, count(f.id) AS file_count, CAST(coalesce(sum(f.size_bytes), 0) AS BIGINT) AS total_bytes FROM dr LEFT JOIN f ON f.drive_id = dr.id AND (f.md5_hash IS NULL OR NOT EXISTS (SELECT 1 FROM f o WHERE o.md5_hash = f.md5_hash AND o.drive_id <> f.drive_id)) WHERE dr.role = 'backup' GROUP BY dr.id, dr.label")
def _(spark, sf):
    return joins.backup_unique_counts(fx.files(spark, sf), fx.drives(spark, sf))


@query("backup_unique_files", files_sql("drive_id = 2 AND blake3_hash IS NOT NULL AND NOT EXISTS (SELECT 1 FROM f o WHERE o.blake3_hash = f.blake3_hash AND o.drive_id <> f.drive_id)"))
def _(spark, sf):
    return joins.backup_unique_files(fx.files(spark, sf), 2).select(*FILE)


ROLES_SQL = f"WITH {fx.FILES_SQL}, {fx.DRIVES_SQL}, r AS (SELECT f.*, dr.role, dr.label FROM f JOIN dr ON f.drive_id = dr.id)"


@query("expected_backups", f"{ROLES_SQL} SELECT a.md5_hash, a.id AS source_id, a.path AS source_path, a.label AS source_label, b.id AS backup_id, b.path AS backup_path, b.label AS backup_label FROM r a JOIN r b ON a.md5_hash = b.md5_hash WHERE a.role = 'source' AND b.role = 'backup'")
def _(spark, sf):
    return joins.expected_backups(fx.files(spark, sf), fx.drives(spark, sf))


@query("missing_from_backup", f"{ROLES_SQL} SELECT id, drive_id, path, size_bytes FROM r WHERE role = 'source' AND md5_hash IS NOT NULL AND NOT EXISTS (SELECT 1 FROM r o WHERE o.role = 'backup' AND o.md5_hash = r.md5_hash)")
def _(spark, sf):
    return joins.missing_from_backup(fx.files(spark, sf), fx.drives(spark, sf)).select(*FILE)


@query("backup_only", f"{ROLES_SQL} SELECT id, drive_id, path, size_bytes FROM r WHERE role = 'backup' AND md5_hash IS NOT NULL AND NOT EXISTS (SELECT 1 FROM r o WHERE o.role = 'source' AND o.md5_hash = r.md5_hash)")
def _(spark, sf):
    return joins.backup_only(fx.files(spark, sf), fx.drives(spark, sf)).select(*FILE)


@query("trash_on_backup", f"{ROLES_SQL} SELECT id, drive_id, path, size_bytes FROM r WHERE role = 'backup' AND EXISTS (SELECT 1 FROM r o WHERE o.role = 'source' AND o.priority = 'trash' AND o.md5_hash = r.md5_hash)")
def _(spark, sf):
    return joins.trash_on_backup(fx.files(spark, sf), fx.drives(spark, sf)).select(*FILE)


def _paired(files):
    """Files as if drives of the same half shared paths and sizes, so that changed copies occur."""
    return files.withColumn("path", F.concat(F.lit("p"), F.expr("id div 4 % 200").cast("string"))).withColumn("size_bytes", F.lit(1).cast("long"))


@query("bit_rot", f"{ROLES_SQL} SELECT 'p' || a.id // 4 % 200 AS path, CAST(1 AS BIGINT) AS size_bytes, a.id AS source_id, b.id AS backup_id, a.md5_hash AS source_md5, b.md5_hash AS backup_md5 FROM r a JOIN r b ON a.id // 4 % 200 = b.id // 4 % 200 WHERE a.role = 'source' AND b.role = 'backup' AND a.md5_hash <> b.md5_hash")
def _(spark, sf):
    return joins.bit_rot(_paired(fx.files(spark, sf)), fx.drives(spark, sf))


# Statistics


@query("category_statistics", f"WITH {fx.FILES_SQL} SELECT category, count(*) AS file_count, CAST(sum(size_bytes) AS BIGINT) AS total_bytes FROM f WHERE category IS NOT NULL GROUP BY category")
def _(spark, sf):
    return stats.category_statistics(fx.files(spark, sf))


DRIVE_STATS_SQL = """SELECT drive_id, count(*) FILTER (status <> 'source_removed') AS file_count, CAST(coalesce(sum(size_bytes) FILTER (status <> 'source_removed'), 0) AS BIGINT) AS total_bytes,
    count(DISTINCT duplicate_group) FILTER (status <> 'source_removed') AS duplicate_groups, count(*) FILTER (duplicate_group IS NOT NULL AND NOT is_original) AS duplicate_file_count,
    CAST(coalesce(sum(size_bytes) FILTER (duplicate_group IS NOT NULL AND NOT is_original), 0) AS BIGINT) AS duplicate_waste_bytes FROM m GROUP BY drive_id"""


@query("drive_statistics", f"WITH {fx.GROUPS_SQL} {DRIVE_STATS_SQL}")
def _(spark, sf):
    return stats.drive_statistics(grouped(spark, sf)[0])


@query("space_by_drive", f"WITH {fx.GROUPS_SQL}, {fx.DRIVES_SQL}, st AS ({DRIVE_STATS_SQL}) SELECT dr.id, dr.label, dr.role, CAST(dr.total_bytes AS BIGINT) AS capacity_bytes, coalesce(st.total_bytes, 0) AS used_bytes, coalesce(st.file_count, 0) AS file_count, coalesce(st.duplicate_waste_bytes, 0) AS duplicate_waste_bytes FROM dr LEFT JOIN st ON dr.id = st.drive_id")
def _(spark, sf):
    return stats.space_by_drive(fx.drives(spark, sf), grouped(spark, sf)[0])


@query("files_per_drive", f"WITH {fx.FILES_SQL}, {fx.DRIVES_SQL} SELECT dr.id, dr.label, count(f.id) AS file_count FROM dr LEFT JOIN f ON f.drive_id = dr.id GROUP BY dr.id, dr.label")
def _(spark, sf):
    return stats.files_per_drive(fx.drives(spark, sf), fx.files(spark, sf))


@query("drive_counts", f"WITH {fx.DRIVES_SQL} SELECT count(*) AS total, count(*) FILTER (is_online) AS online, count(*) FILTER (NOT is_online) AS offline FROM dr")
def _(spark, sf):
    return stats.drive_counts(fx.drives(spark, sf))


@query("status_summary", f"""WITH {fx.GROUPS_SQL}, {fx.DRIVES_SQL}, {fx.PLANS_SQL}
    SELECT (SELECT count(*) FROM dr) AS drives, (SELECT count(*) FROM dr WHERE is_online) AS online, (SELECT count(*) FROM dr WHERE NOT is_online) AS offline,
           (SELECT count(*) FROM f WHERE status <> 'source_removed') AS total_files, CAST((SELECT coalesce(sum(size_bytes), 0) FROM f WHERE status <> 'source_removed') AS BIGINT) AS total_bytes,
           (SELECT count(category) FROM f WHERE status <> 'source_removed') AS classified, (SELECT count(*) FROM f WHERE status <> 'source_removed' AND category IS NULL) AS unclassified,
           (SELECT count(DISTINCT category) FROM f WHERE status <> 'source_removed') AS categories, (SELECT count(*) FROM g) AS group_count, CAST((SELECT coalesce(sum(file_count), 0) FROM g) AS BIGINT) AS total_duplicate_files,
           CAST((SELECT coalesce(sum(total_waste_bytes), 0) FROM g) AS BIGINT) AS total_waste_bytes, (SELECT count(*) FROM g WHERE cross_drive) AS cross_drive_groups,
           (SELECT count(*) FROM p WHERE status = 'draft') AS draft, (SELECT count(*) FROM p WHERE status = 'approved') AS approved,
           (SELECT count(*) FROM p WHERE status = 'in_progress') AS in_progress, (SELECT count(*) FROM p WHERE status = 'completed') AS completed""")
def _(spark, sf):
    files, groups = grouped(spark, sf)
    return stats.status_summary(files, fx.drives(spark, sf), groups, fx.plans(spark, sf))


@query("file_totals", f"WITH {fx.FILES_SQL} SELECT count(*) AS total_files, CAST(coalesce(sum(size_bytes), 0) AS BIGINT) AS total_bytes FROM f WHERE status <> 'source_removed'")
def _(spark, sf):
    return stats.file_totals(fx.files(spark, sf))


@query("classification_summary", f"WITH {fx.FILES_SQL} SELECT count(category) AS classified, count(*) FILTER (category IS NULL) AS unclassified, count(DISTINCT category) AS categories FROM f WHERE status <> 'source_removed'")
def _(spark, sf):
    return stats.classification_summary(fx.files(spark, sf))


@query("plan_status_counts", f"WITH {fx.PLANS_SQL} SELECT count(*) FILTER (status = 'draft') AS draft, count(*) FILTER (status = 'approved') AS approved, count(*) FILTER (status = 'in_progress') AS in_progress, count(*) FILTER (status = 'completed') AS completed FROM p")
def _(spark, sf):
    return stats.plan_status_counts(fx.plans(spark, sf))


@query("migration_summary", f"WITH {fx.PLANS_SQL} SELECT count(*) AS total_plans, count(*) FILTER (status = 'completed') AS completed_plans, CAST(coalesce(sum(completed_bytes) FILTER (status = 'completed'), 0) AS BIGINT) AS migrated_bytes FROM p")
def _(spark, sf):
    return stats.migration_summary(fx.plans(spark, sf))


@query("verified_steps", f"WITH {fx.STEPS_SQL} SELECT count(post_hash) AS verified, count(*) FILTER (status = 'failed') AS failed FROM s")
def _(spark, sf):
    return stats.verified_counts(fx.files(spark, sf), fx.steps(spark, sf))


@query("verified_files", f"WITH {fx.FILES_SQL} SELECT count(*) FILTER (status IN ('verified', 'classified')) AS verified FROM f")
def _(spark, sf):
    return stats.verified_counts(fx.files(spark, sf))


@query("pending_bytes", f"WITH {fx.FILES_SQL}, {fx.STEPS_SQL} SELECT CAST(coalesce((SELECT sum(size_bytes) FROM f WHERE priority = 'trash'), 0) AS BIGINT) AS trash_bytes, CAST(coalesce((SELECT sum(size_bytes) FROM s JOIN f ON s.file_id = f.id WHERE s.status = 'pending' AND action IN ('copy', 'move')), 0) AS BIGINT) AS pending_move_bytes")
def _(spark, sf):
    return stats.pending_bytes(fx.files(spark, sf), fx.steps(spark, sf))


@query("verify_outcomes", f"WITH {fx.FILES_SQL} SELECT CASE WHEN id % 13 = 0 THEN 'missing' WHEN id % 17 = 0 THEN 'error' WHEN md5_hash IS NULL THEN 'unhashed' WHEN id % 5 = 0 THEN 'mismatch' ELSE 'verified' END AS outcome, count(*) AS files FROM f GROUP BY 1")
def _(spark, sf):
    """Every fifth file's stored hash is altered, some files are gone or can't be read."""
    d = fx.table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.md5(F.col("text").cast("binary")).alias("actual"))
    files = fx.files(spark, sf).select("id", F.when(F.col("id") % 5 == 0, F.reverse(F.concat(F.lit("zz"), "md5_hash"))).otherwise(F.upper("md5_hash")).alias("expected"))
    checked = files.join(d, "id").select("expected", "actual", F.when(F.col("id") % 17 == 0, "io").alias("error"), (F.col("id") % 13 != 0).alias("exists"))
    return stats.verify_outcomes(checked)


# Classification

RULES = rules.from_toml("""
[rules.temporary]
type = "pattern"
patterns = ["**/tmp/**", "**/*.bak"]
category = "trash"
priority = "trash"
rule_priority = 90
[rules.pictures]
type = "extension"
extensions = ["JPG", "png"]
category = "images"
subcategory = "all"
[rules.huge]
type = "size"
min_bytes = 4000
category = "large"
subcategory = "by size"
priority = "low"
[rules.old]
type = "age"
older_than_days = 700
newer_than_days = 950
category = "archive"
rule_priority = 60
[rules.copies]
type = "duplicate"
keep_strategy = "keep_oldest"
category = "duplicate"
priority = "critical"
rule_priority = 70
""")
MATCH_SQL = f"""WITH {fx.GROUPS_SQL}, c AS (SELECT *, CASE WHEN regexp_matches(path, '(^|/)tmp/') OR regexp_matches(abs_path, '(^|/)tmp/') OR path LIKE '%.bak' THEN 'temporary' WHEN duplicate_group IS NOT NULL THEN 'copies'
        WHEN date_diff('day', modified_at, TIMESTAMP '{fx.AS_OF}') BETWEEN 700 AND 950 THEN 'old' WHEN size_bytes >= 4000 THEN 'huge' WHEN lower(extension) IN ('jpg', 'png') THEN 'pictures' END AS rule FROM m),
    x AS (SELECT *, CASE rule WHEN 'temporary' THEN 'trash' WHEN 'pictures' THEN 'images' WHEN 'huge' THEN 'large' WHEN 'old' THEN 'archive' WHEN 'copies' THEN 'duplicate' END AS new_category,
                 CASE rule WHEN 'pictures' THEN 'all' WHEN 'huge' THEN 'by size' END AS new_subcategory, CASE rule WHEN 'temporary' THEN 'trash' WHEN 'huge' THEN 'low' WHEN 'copies' THEN 'critical' ELSE 'normal' END AS new_priority FROM c)"""


def matched(spark, sf):
    return rules.classify(grouped(spark, sf)[0], RULES, now())


@query("classify_rules", f"{MATCH_SQL} SELECT id, rule AS rule_name, new_category AS category, new_subcategory AS subcategory, CASE WHEN rule IS NOT NULL THEN new_priority END AS priority FROM x")
def _(spark, sf):
    return matched(spark, sf).select("id", "match.rule_name", "match.category", "match.subcategory", "match.priority")


@query("auto_classify", f"{MATCH_SQL}, o AS (SELECT *, category IS NULL AND status = 'indexed' AND rule IS NOT NULL AS hit FROM x) SELECT id, CASE WHEN hit THEN new_category ELSE category END AS category, CASE WHEN hit THEN new_subcategory END AS subcategory, CASE WHEN hit THEN new_priority ELSE priority END AS priority, CASE WHEN hit THEN 'classified' ELSE status END AS status FROM o")
def _(spark, sf):
    return rules.auto_classify(grouped(spark, sf)[0], RULES, now())[0].select("id", "category", "subcategory", "priority", "status")


@query("auto_classify_counts", f"{MATCH_SQL} SELECT count(*) FILTER (rule IS NOT NULL) AS classified, count(*) FILTER (rule IS NULL) AS skipped FROM x WHERE category IS NULL AND status = 'indexed'")
def _(spark, sf):
    return rules.auto_classify(grouped(spark, sf)[0], RULES, now())[1]


@query("classify_pages_by_glob", "SELECT page_id, regexp_matches(url, '(^|/)en/') OR url LIKE '%.html' AS matches FROM pages")
def _(spark, sf):
    from .functions.globs import matches_any

    return fx.table(spark, sf, "pages").select("page_id", matches_any(["**/en/**", "**/*.html"], F.col("url")).alias("matches"))


@query("exif_subcategory", "SELECT doc_id AS id, CASE WHEN doc_id % 3 = 0 THEN CAST(2000 + doc_id % 20 AS VARCHAR) || '/' || CASE WHEN doc_id % 2 = 0 THEN '07' ELSE '{exif_month}' END || '/Canon' ELSE 'undated' END AS subcategory FROM documents WHERE doc_id % 7 IN (1, 5)")
def _(spark, sf):
    files = fx.files(spark, sf)
    year, month = F.concat(F.lit("20"), F.lpad((F.col("id") % 20).cast("string"), 2, "0")), F.when(F.col("id") % 2 == 0, "07")
    exif = files.where("id % 3 = 0").select("abs_path", year.alias("year"), month.alias("month"), F.lit("01").alias("day"), F.lit("Canon").alias("make"), F.lit("X").alias("model"))
    by = [rules.Rule("photos", "extension", "photos", extensions=["jpg"], subcategory="undated", subcategory_from_exif="{exif_year}/{exif_month}/{exif_make}")]
    return rules.classify(files, by, now(), exif).where("match is not null").select("id", "match.subcategory")


@query("review_batches", f"{MATCH_SQL} SELECT new_category AS category, new_subcategory AS subcategory, count(*) AS file_count, CAST(sum(size_bytes) AS BIGINT) AS total_bytes FROM x WHERE rule IS NOT NULL GROUP BY ALL")
def _(spark, sf):
    return rules.review_batches(matched(spark, sf))


@query("batch_samples", f"{MATCH_SQL}, n AS (SELECT *, row_number() OVER (PARTITION BY new_category, new_subcategory ORDER BY id) AS place FROM x WHERE rule IS NOT NULL) SELECT new_category AS category, new_subcategory AS subcategory, id, filename, size_bytes, CAST(place AS INTEGER) AS place FROM n WHERE place <= 3")
def _(spark, sf):
    return rules.batch_samples(matched(spark, sf))


@query("apply_review", f"{MATCH_SQL} SELECT id, CASE WHEN new_category = 'archive' THEN 'archive' WHEN new_category = 'images' THEN 'holiday' ELSE category END AS category, CASE WHEN new_category = 'images' THEN 'beach' END AS subcategory, CASE WHEN new_category IN ('archive', 'images') THEN 'classified' ELSE status END AS status FROM x")
def _(spark, sf):
    decisions = spark.createDataFrame([("archive", None, "accept", None, None), ("images", "all", "override", "holiday", "beach"), ("large", "by size", "skip", None, None)], "category string, subcategory string, action string, new_category string, new_subcategory string")
    return rules.apply_review(matched(spark, sf), decisions).select("id", "category", "subcategory", "status")


@query("classify_by_pattern", files_sql("true", r"id, CASE WHEN path ILIKE '%/TMP/%' ESCAPE '\' THEN 'junk' ELSE category END AS category, CASE WHEN path ILIKE '%/TMP/%' ESCAPE '\' THEN 'low' ELSE priority END AS priority"))
def _(spark, sf):
    files = fx.files(spark, sf)
    return rules.set_classification(files, formats.contains_like(F.col("path"), "/TMP/"), "junk", priority="low", keep_subcategory=True).select("id", "category", "priority")


@query("classify_by_ids", files_sql("true", "id, CASE WHEN id IN (3, 5, 40) THEN 'mine' ELSE category END AS category, CASE WHEN id IN (3, 5, 40) THEN 'hand' END AS subcategory, CASE WHEN id IN (3, 5, 40) THEN 'classified' ELSE status END AS status"))
def _(spark, sf):
    chosen = F.array_contains(formats.ids_from_list(F.lit("3, 5,x,40,")), F.col("id"))
    return rules.set_classification(fx.files(spark, sf), chosen, "mine", "hand").select("id", "category", "subcategory", "status")


@query("selected_by_id_list", files_sql("id IN (3, 5, 40)"))
def _(spark, sf):
    return filters.selected_ids(fx.files(spark, sf), "3, 5,x,40,").select(*FILE)


# Plans

STEP_COLUMNS = ("plan_id", "step_order", "file_id", "action", "source_path", "dest_path", "pre_hash", "status")


def step_sql(where: str, action: str, dest: str = "NULL", source: str = "f") -> str:
    return f"WITH {fx.GROUPS_SQL if source == 'm' else fx.FILES_SQL} SELECT CAST(1 AS BIGINT) AS plan_id, CAST(row_number() OVER (ORDER BY id) - 1 AS INTEGER) AS step_order, id AS file_id, '{action}' AS action, abs_path AS source_path, {dest} AS dest_path, blake3_hash AS pre_hash, 'pending' AS status FROM {source} WHERE {where}"


@query("plan_delete_trash", step_sql("category = 'trash'", "delete"))
def _(spark, sf):
    return planner.delete_trash(filters.by_category(fx.files(spark, sf), "trash"), 1, now()).steps.select(*STEP_COLUMNS)


@query("plan_totals", f"WITH {fx.FILES_SQL} SELECT CAST(1 AS BIGINT) AS id, 'Delete ' || count(*) || ' trash files' AS description, 'draft' AS status, CAST(count(*) AS INTEGER) AS total_files, CAST(coalesce(sum(size_bytes), 0) AS BIGINT) AS total_bytes FROM f WHERE category = 'trash'")
def _(spark, sf):
    return planner.delete_trash(filters.by_category(fx.files(spark, sf), "trash"), 1, now()).plan.select("id", "description", "status", "total_files", "total_bytes")


@query("plan_dedup", step_sql("duplicate_group = (SELECT min(group_id) FROM g) AND NOT is_original", "delete", source="m"))
def _(spark, sf):
    files, groups = grouped(spark, sf)
    return planner.dedup(filters.group_members(files, groups.agg(F.min("group_id")).first()[0]), 1, now()).steps.select(*STEP_COLUMNS)


@query("plan_migrate", step_sql("category = 'photos' AND drive_id = 2", "copy", "'/mnt/new/' || path"))
def _(spark, sf):
    return planner.migrate(filters.by_category(fx.files(spark, sf), "photos", 2), 1, now(), 9, "/mnt/new").steps.select(*STEP_COLUMNS)


@query("plan_offload", f"WITH {fx.FILES_SQL}, n AS (SELECT *, row_number() OVER (ORDER BY id) - 1 AS i FROM f WHERE category = 'photos' AND drive_id = 2) SELECT CAST(1 AS BIGINT) AS plan_id, CAST(2 * i + k AS INTEGER) AS step_order, id AS file_id, CASE k WHEN 0 THEN 'copy' ELSE 'delete' END AS action, abs_path AS source_path, CASE k WHEN 0 THEN '/mnt/off/' || path END AS dest_path, blake3_hash AS pre_hash, 'pending' AS status FROM n, (VALUES (0), (1)) v(k)")
def _(spark, sf):
    return planner.offload(filters.by_category(fx.files(spark, sf), "photos", 2), 1, now(), 9, "/mnt/off").steps.select(*STEP_COLUMNS)


@query("plan_dry_run", f"WITH {fx.FILES_SQL} SELECT CAST(1 AS BIGINT) AS plan_id, CAST(row_number() OVER (ORDER BY id) - 1 AS INTEGER) AS step_order, 'copy' AS action, 'would copy ' || abs_path || ' -> /mnt/new/' || path AS outcome FROM f WHERE category = 'photos' AND drive_id = 2")
def _(spark, sf):
    return planner.dry_run(planner.migrate(filters.by_category(fx.files(spark, sf), "photos", 2), 1, now(), 9, "/mnt/new").steps)


@query("plan_approve", f"WITH {fx.PLANS_SQL} SELECT id, CASE WHEN id = (SELECT min(id) FROM p WHERE status = 'draft') THEN 'approved' ELSE status END AS status FROM p")
def _(spark, sf):
    plans = fx.plans(spark, sf)
    first = plans.where("status = 'draft'").agg(F.min("id")).first()[0]
    return planner.with_status(plans, first, "approved", ("draft",)).select("id", "status")


@query("batch_prefix", f"WITH {fx.FILES_SQL}, r AS (SELECT id, size_bytes, CAST(sum(size_bytes) OVER (ORDER BY id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS running_bytes FROM f) SELECT * FROM r WHERE running_bytes <= 100000")
def _(spark, sf):
    return planner.batch_prefix(fx.files(spark, sf), 100_000).select("id", "size_bytes", "running_bytes")


@query("run_budget", f"WITH {fx.PLANS_SQL} SELECT CAST(coalesce(sum(total_bytes), 0) AS BIGINT) AS total_bytes, coalesce(sum(total_bytes), 0) <= 1000000000 AS within_budget FROM p WHERE status = 'approved'")
def _(spark, sf):
    return planner.run_budget(filters.plans_by_status(fx.plans(spark, sf), "approved"), 1_000_000_000)


@query("rollback_feasible", f"WITH {fx.STEPS_SQL} SELECT plan_id, NOT bool_or(status = 'completed' AND action = 'delete') AS can_rollback FROM s GROUP BY plan_id")
def _(spark, sf):
    return planner.rollback_feasible(fx.steps(spark, sf))


@query("rollback_order", f"WITH {fx.STEPS_SQL}, c AS (SELECT *, row_number() OVER (PARTITION BY plan_id ORDER BY step_order DESC) AS turn FROM s WHERE status = 'completed') SELECT plan_id, step_order, CAST(turn AS INTEGER) AS turn FROM c")
def _(spark, sf):
    from pyspark.sql import Window

    rows = planner.rollback_order(fx.steps(spark, sf))
    return rows.withColumn("turn", F.row_number().over(Window.partitionBy("plan_id").orderBy(F.desc("step_order")))).select("plan_id", "step_order", "turn")


@query("safe_write", f"WITH {fx.PLANS_SQL} SELECT id, least(CAST(floor(total_bytes * 0.5) AS BIGINT), total_bytes // 3) AS safe_bytes, 40000 <= least(CAST(floor(total_bytes * 0.5) AS BIGINT), total_bytes // 3) AS fits FROM p")
def _(spark, sf):
    free, available = F.col("total_bytes"), F.expr("total_bytes div 3")
    return fx.plans(spark, sf).select("id", formats.safe_write_bytes(free, available).alias("safe_bytes"), planner.fits(free, available, F.lit(40_000)).alias("fits"))


# Lint


def lints(spark, sf):
    """Parsed lints, numbered by their size and path, as the lines of a table have no order."""
    rows = lint_source.parse(fx.lint_lines(spark, sf))
    number = F.regexp_extract("path", r"/(\d+)\.[^/]*$", 1).cast("long")
    return rows.withColumn("ordinal", number)


@query("lint_parse", f"WITH {fx.LINTS_SQL} SELECT type, path, size, checksum, is_original, disk_id FROM li")
def _(spark, sf):
    return lints(spark, sf).select("type", "path", "size", "checksum", "is_original", "disk_id")


LINT_GROUPS_SQL = "lg AS (SELECT checksum, count(*) AS file_count, arg_min(size, i) AS total_size, arg_min(path, i) FILTER (is_original) AS original, count(DISTINCT disk_id) AS disks FROM li WHERE type = 'duplicate_file' GROUP BY checksum HAVING count(*) > 1)"


@query("lint_groups", f"WITH {fx.LINTS_SQL}, {LINT_GROUPS_SQL} SELECT * FROM lg")
def _(spark, sf):
    return lint.lint_groups(lints(spark, sf))


@query("lint_statistics", f"WITH {fx.LINTS_SQL}, {LINT_GROUPS_SQL} SELECT count(*) FILTER (type = 'duplicate_file') AS duplicate_files, CAST(coalesce(sum(size) FILTER (type = 'duplicate_file' AND NOT is_original), 0) AS BIGINT) AS duplicate_bytes, count(*) FILTER (type = 'emptyfile') AS empty_files, count(*) FILTER (type = 'emptydir') AS empty_dirs, count(*) FILTER (type NOT IN ('duplicate_file', 'emptyfile', 'emptydir')) AS other_lints, (SELECT count(*) FROM lg) AS duplicate_groups FROM li")
def _(spark, sf):
    return lint.lint_statistics(lints(spark, sf))


@query("lint_cross_drive", f"WITH {fx.LINTS_SQL}, {LINT_GROUPS_SQL} SELECT coalesce(bool_or(disks > 1), false) AS cross_drive FROM lg")
def _(spark, sf):
    return lint.has_cross_drive(lints(spark, sf))


@query("lint_matched", f"WITH {fx.LINTS_SQL} SELECT li.type, li.path, f.id AS file_id FROM li LEFT JOIN f ON f.abs_path = li.path")
def _(spark, sf):
    return lint.matched(lints(spark, sf), fx.files(spark, sf)).select("type", "path", "file_id")


IMPORT_SQL = f"""WITH {fx.LINTS_SQL}, fo AS (SELECT li.*, f.id AS file_id, f.drive_id, f.size_bytes FROM li LEFT JOIN f ON f.abs_path = li.path),
    ng AS (SELECT checksum AS hash, min(file_id) AS group_id, CAST(count(*) AS INTEGER) AS file_count, arg_max(file_id, i) FILTER (is_original) AS original_id,
                  CAST(sum(size_bytes) - coalesce(arg_max(size_bytes, i) FILTER (is_original), 0) AS BIGINT) AS total_waste_bytes, array_to_string(list_sort(list_distinct(list(drive_id))), ',') AS drives, count(DISTINCT drive_id) > 1 AS cross_drive
           FROM fo WHERE type = 'duplicate_file' AND file_id IS NOT NULL GROUP BY checksum HAVING count(*) > 1)"""


@query("lint_import_groups", f"{IMPORT_SQL} SELECT group_id, hash, file_count, total_waste_bytes, original_id, drives, cross_drive FROM ng")
def _(spark, sf):
    return group_rows(lint.import_groups(lint.matched(lints(spark, sf), fx.files(spark, sf))))


@query("lint_import_files", f"{IMPORT_SQL} SELECT f.id, fo.type AS rmlint_type, ng.group_id AS duplicate_group, coalesce(ng.original_id = f.id, false) AS is_original, CASE WHEN f.category IS NULL AND fo.type IN ('emptyfile', 'badlink') THEN 'trash' ELSE f.category END AS category, CASE WHEN f.category IS NULL AND fo.type IN ('emptyfile', 'badlink') THEN 'trash' ELSE f.priority END AS priority FROM f LEFT JOIN fo ON fo.file_id = f.id LEFT JOIN ng ON fo.type = 'duplicate_file' AND fo.checksum = ng.hash")
def _(spark, sf):
    return lint.import_lints(lints(spark, sf), fx.files(spark, sf), apply_trash=True)[0].select("id", "rmlint_type", "duplicate_group", "is_original", "category", "priority")


@query("lint_import_counts", f"{IMPORT_SQL} SELECT count(*) AS total_lints, count(file_id) AS matched_files, count(*) FILTER (file_id IS NULL) AS skipped_lints, count(*) FILTER (file_id IS NOT NULL AND type = 'emptyfile') AS empty_files_marked, count(*) FILTER (file_id IS NOT NULL AND type = 'emptydir') AS empty_dirs_marked, count(*) FILTER (file_id IS NOT NULL AND type = 'badlink') AS bad_links_marked, (SELECT count(*) FROM ng) AS duplicate_groups_created, CAST((SELECT coalesce(sum(file_count), 0) FROM ng) AS BIGINT) AS duplicate_files_assigned FROM fo")
def _(spark, sf):
    return lint.import_lints(lints(spark, sf), fx.files(spark, sf), apply_trash=True)[2]


# Texts


@query("format_bytes", f"WITH {fx.PLANS_SQL}, b AS (SELECT id, total_bytes * (CASE id % 5 WHEN 0 THEN 1 WHEN 1 THEN 1000 WHEN 2 THEN 1000000 WHEN 3 THEN 1000000000 ELSE 0 END) + id % 1024 AS n FROM p) SELECT id, CASE WHEN n >= 1099511627776 THEN printf('%.2f TB', n / 1099511627776.0::DOUBLE) WHEN n >= 1073741824 THEN printf('%.2f GB', n / 1073741824.0::DOUBLE) WHEN n >= 1048576 THEN printf('%.2f MB', n / 1048576.0::DOUBLE) WHEN n >= 1024 THEN printf('%.2f KB', n / 1024.0::DOUBLE) ELSE n || ' B' END AS size_text FROM b")
def _(spark, sf):
    k = F.col("id") % 5
    n = F.col("total_bytes") * F.when(k == 0, 1).when(k == 1, 1000).when(k == 2, 1_000_000).when(k == 3, 1_000_000_000).otherwise(0) + F.col("id") % 1024
    return fx.plans(spark, sf).select("id", formats.format_bytes(n).alias("size_text"))


@query("parse_size", f"WITH {fx.PLANS_SQL} SELECT id, CAST(floor((total_bytes / 100.0::DOUBLE) * (CASE id % 4 WHEN 0 THEN 1 WHEN 1 THEN 1024 WHEN 2 THEN 1048576 ELSE 1073741824 END)) AS BIGINT) AS size_bytes FROM p")
def _(spark, sf):
    number = F.format_string("%.2f", F.col("total_bytes") / 100.0)
    unit = F.element_at(F.array(F.lit(""), F.lit(" kb"), F.lit("MB"), F.lit(" GB ")), (F.col("id") % 4 + 1).cast("int"))
    return fx.plans(spark, sf).select("id", formats.parse_size(F.concat(number, unit)).alias("size_bytes"))


@query("format_duration", f"WITH {fx.PLANS_SQL}, t AS (SELECT id, total_bytes % (CASE WHEN id % 3 = 0 THEN 60 WHEN id % 3 = 1 THEN 3600 ELSE 100000 END) AS s FROM p) SELECT id, CASE WHEN s >= 3600 THEN s // 3600 || 'h ' ELSE '' END || CASE WHEN s >= 60 THEN s % 3600 // 60 || 'm ' ELSE '' END || s % 60 || 's' AS duration_text FROM t")
def _(spark, sf):
    s = F.col("total_bytes") % F.when(F.col("id") % 3 == 0, 60).when(F.col("id") % 3 == 1, 3600).otherwise(100_000)
    return fx.plans(spark, sf).select("id", formats.format_duration(s).alias("duration_text"))


@query("format_timestamp", f"WITH {fx.PLANS_SQL} SELECT id, strftime(created_at, '%Y-%m-%d %H:%M:%S') AS created_text FROM p")
def _(spark, sf):
    return fx.plans(spark, sf).select("id", formats.format_timestamp(F.col("created_at")).alias("created_text"))


@query("path_parts", files_sql("true", "id, filename, extension, path AS relative_path"))
def _(spark, sf):
    name = formats.filename(F.col("abs_path"))
    base = F.concat(F.lit("/mnt/drive"), F.col("drive_id").cast("string"))
    return fx.files(spark, sf).select("id", name.alias("filename"), formats.extension(name).alias("extension"), formats.relative(F.col("abs_path"), base).alias("relative_path"))


@query("shortened_texts", files_sql("true", "id, CASE WHEN length(abs_path) > 20 THEN '...' || right(abs_path, 17) ELSE abs_path END AS path_tail, left(blake3_hash, 12) || '...' AS short_hash, coalesce(category, '-') AS shown_category"))
def _(spark, sf):
    return fx.files(spark, sf).select("id", formats.tail(F.col("abs_path"), 20, 17).alias("path_tail"), formats.short_hash(F.col("blake3_hash")).alias("short_hash"), formats.shown(F.col("category")).alias("shown_category"))


@query("drives_as_json", f"WITH {fx.GROUPS_SQL} SELECT group_id, '[' || array_to_string(drives, ',') || ']' AS drives_json FROM g")
def _(spark, sf):
    groups = dedup.duplicate_groups(fx.files(spark, sf))
    back = formats.ids_from_json(formats.ids_to_json(F.col("drives_involved")))
    return groups.select("group_id", formats.ids_to_json(back).alias("drives_json"))


@query("preferred_hash_and_destination", files_sql("true", "id, coalesce(md5_hash, blake3_hash) AS preferred, '/mnt/x/' || path AS dest_path"))
def _(spark, sf):
    return fx.files(spark, sf).select("id", formats.preferred_hash(F.col("md5_hash"), F.col("blake3_hash")).alias("preferred"), formats.destination(F.lit("/mnt/x"), F.col("path"), F.col("target_path")).alias("dest_path"))


# Reports, checks, changes


@query("csv_report", f"WITH {fx.GROUPS_SQL}, {fx.DRIVES_SQL}, st AS ({DRIVE_STATS_SQL}) SELECT dr.label AS \"Label\", dr.role AS \"Role\", coalesce(st.file_count, 0) AS \"Files\", coalesce(st.total_bytes, 0) AS \"TotalBytes\", coalesce(st.duplicate_file_count, 0) AS \"DuplicateFiles\", coalesce(st.duplicate_waste_bytes, 0) AS \"WastedBytes\" FROM dr LEFT JOIN st ON dr.id = st.drive_id")
def _(spark, sf):
    return reports.csv_report(fx.drives(spark, sf), grouped(spark, sf)[0])


@query("json_report", f"""WITH {fx.GROUPS_SQL}, {fx.DRIVES_SQL}, st AS ({DRIVE_STATS_SQL}),
    d AS (SELECT string_agg('{{"label":"' || label || '","role":"' || role || '","is_online":' || is_online || ',"mount_path":"' || mount_path || '","files":' || coalesce(st.file_count, 0) || ',"total_bytes":' || coalesce(st.total_bytes, 0) || ',"duplicate_files":' || coalesce(st.duplicate_file_count, 0) || ',"wasted_bytes":' || coalesce(st.duplicate_waste_bytes, 0) || '}}', ',' ORDER BY label) AS drives FROM dr LEFT JOIN st ON dr.id = st.drive_id),
    c AS (SELECT string_agg('{{"category":"' || category || '","subcategory":null,"file_count":' || n || ',"total_bytes":' || b || '}}', ',' ORDER BY b DESC, category) AS categories FROM (SELECT category, count(*) AS n, CAST(sum(size_bytes) AS BIGINT) AS b FROM f WHERE category IS NOT NULL GROUP BY category)),
    u AS (SELECT '{{"groups":' || count(*) || ',"files":' || CAST(coalesce(sum(file_count), 0) AS BIGINT) || ',"wasted_bytes":' || CAST(coalesce(sum(total_waste_bytes), 0) AS BIGINT) || ',"cross_drive_groups":' || count(*) FILTER (cross_drive) || '}}' AS duplicates FROM g)
    SELECT '{{"drives":[' || drives || '],"categories":[' || categories || '],"duplicates":' || duplicates || ',"generated_at":"2026-01-01T00:00:00Z"}}' AS report FROM d, c, u""")
def _(spark, sf):
    files, groups = grouped(spark, sf)
    return reports.json_report(fx.drives(spark, sf), files, groups, now())


@query("schema_checks", f"WITH {fx.STEPS_SQL}, {fx.PLANS_SQL} SELECT 'reference' AS \"check\", 'migration_steps' AS \"table\", 'file_id' AS columns, count(*) AS violations FROM s WHERE file_id NOT IN (SELECT doc_id FROM documents) HAVING count(*) > 0")
def _(spark, sf):
    return schema.validate({"files": fx.files(spark, sf), "migration_plans": fx.plans(spark, sf), "migration_steps": fx.steps(spark, sf).withColumn("id", F.xxhash64("plan_id", "step_order"))})


@query("upsert_files", f"""WITH {fx.FILES_SQL}, n AS (SELECT id + 1000000 AS id, drive_id, path, CASE WHEN id % 6 = 0 THEN size_bytes + 1 ELSE size_bytes END AS size_bytes FROM f WHERE id % 3 = 0 UNION ALL SELECT id + 2000000, drive_id, 'new/' || path, size_bytes FROM f WHERE id % 10 = 0)
    SELECT coalesce(f.id, n.id) AS id, coalesce(n.drive_id, f.drive_id) AS drive_id, coalesce(n.path, f.path) AS path, coalesce(n.size_bytes, f.size_bytes) AS size_bytes, f.category,
           CASE WHEN n.id IS NULL OR n.size_bytes = f.size_bytes THEN f.md5_hash END AS md5_hash, CASE WHEN n.id IS NULL AND f.drive_id = 2 THEN 'source_removed' ELSE coalesce(f.status, 'indexed') END AS status
    FROM f FULL OUTER JOIN n ON f.drive_id = n.drive_id AND f.path = n.path""")
def _(spark, sf):
    files = fx.files(spark, sf)
    fresh = files.withColumns({"md5_hash": F.lit(None).cast("string"), "blake3_hash": F.lit(None).cast("string"), "status": F.lit("indexed"), "category": F.lit(None).cast("string")})
    seen = fresh.where("id % 3 = 0").withColumns({"id": F.col("id") + 1_000_000, "size_bytes": F.when(F.col("id") % 6 == 0, F.col("size_bytes") + 1).otherwise(F.col("size_bytes"))})
    new = fresh.where("id % 10 = 0").withColumns({"id": F.col("id") + 2_000_000, "path": F.concat(F.lit("new/"), "path")})
    return store.upsert_files(files, seen.unionByName(new), tombstones_of=2).select("id", "drive_id", "path", "size_bytes", "category", "md5_hash", "status")


@query("set_status", files_sql("true", "id, CASE WHEN id = 5 THEN 'planned' ELSE status END AS status"))
def _(spark, sf):
    return store.set_where(fx.files(spark, sf), F.col("id") == 5, status="planned").select("id", "status")


@query("set_hashes", files_sql("true", "id, CASE WHEN id % 11 = 0 THEN 'fresh' ELSE md5_hash END AS md5_hash, blake3_hash"))
def _(spark, sf):
    """New hashes of one algorithm leave the other's."""
    files = fx.files(spark, sf)
    return store.set_from(files, files.where("md5_hash is null").select("id", F.lit("fresh").alias("md5_hash"))).select("id", "md5_hash", "blake3_hash")


# Changes of tables

DRIVE = ("id", "label", "role", "is_online", "total_bytes")
DRIVE_SQL = "id, label, role, is_online, CAST(total_bytes AS BIGINT) AS total_bytes"


@query("drive_added", f"WITH {fx.DRIVES_SQL} SELECT {DRIVE_SQL} FROM dr UNION ALL SELECT max(id) + 1, 'fresh', 'backup', true, CAST(5000 AS BIGINT) FROM dr")
def _(spark, sf):
    known = fx.drives(spark, sf)
    return known.unionByName(store.new_drive(known, label="fresh", role="backup", total_bytes=5000)).select(*DRIVE)


@query("drive_removed", f"WITH {fx.DRIVES_SQL} SELECT {DRIVE_SQL} FROM dr WHERE label <> 'src1'")
def _(spark, sf):
    return filters.without_drive(fx.drives(spark, sf), "src1").select(*DRIVE)


@query("drive_set_offline", f"WITH {fx.DRIVES_SQL} SELECT id, label, CASE WHEN label = 'src2' THEN false ELSE is_online END AS is_online FROM dr")
def _(spark, sf):
    return store.set_where(fx.drives(spark, sf), F.col("label") == "src2", is_online=False).select("id", "label", "is_online")


@query("drive_metadata_refreshed", f"WITH {fx.DRIVES_SQL} SELECT id, label, CASE WHEN label = 'src3' THEN 'btrfs' ELSE 'ext4' END AS fs_type, CAST(CASE WHEN label = 'src3' THEN 1610612736 ELSE total_bytes END AS BIGINT) AS total_bytes FROM dr")
def _(spark, sf):
    return store.set_where(fx.drives(spark, sf), F.col("label") == "src3", fs_type="btrfs", total_bytes=formats.parse_device_size(F.lit("1.5G"))).select("id", "label", "fs_type", "total_bytes")


@query("drives_marked_scanned", f"WITH {fx.DRIVES_SQL} SELECT id, CASE WHEN is_online THEN TIMESTAMP '{fx.AS_OF}' END AS scanned_at FROM dr")
def _(spark, sf):
    return store.set_where(fx.drives(spark, sf), F.col("is_online") & F.col("mount_path").isNotNull(), scanned_at=now()).select("id", "scanned_at")


@query("step_results", f"WITH {fx.STEPS_SQL} SELECT plan_id, step_order, CASE WHEN status = 'pending' AND file_id % 3 = 0 THEN 'completed' WHEN status = 'pending' AND file_id % 3 = 1 THEN 'failed' ELSE status END AS status, CASE WHEN status = 'pending' AND file_id % 3 = 0 THEN 'new' ELSE post_hash END AS post_hash, CASE WHEN status = 'pending' AND file_id % 3 = 1 THEN 'no space' END AS error FROM s")
def _(spark, sf):
    steps = fx.steps(spark, sf)
    ran = steps.where("status = 'pending' and file_id % 3 < 2").select("id", F.when(F.expr("file_id % 3 = 0"), "completed").otherwise("failed").alias("status"), F.when(F.expr("file_id % 3 = 0"), "new").alias("post_hash"), F.when(F.expr("file_id % 3 = 1"), "no space").alias("error"))
    ran = ran.dropDuplicates(["id"])  # lines that repeat are one step
    return store.set_from(steps, ran).select("plan_id", "step_order", "status", "post_hash", "error")


@query("files_after_steps", f"WITH {fx.FILES_SQL}, {fx.STEPS_SQL}, c AS (SELECT file_id, bool_or(action = 'copy') AS copied, bool_or(action = 'delete') AS gone FROM s WHERE status = 'completed' GROUP BY file_id) SELECT id, CASE WHEN gone THEN 'source_removed' WHEN copied THEN 'verified' ELSE status END AS status, CASE WHEN copied THEN 'h' END AS verified_hash FROM f LEFT JOIN c ON f.id = c.file_id")
def _(spark, sf):
    return executor.files_after(fx.files(spark, sf), fx.steps(spark, sf).where("status = 'completed'")).select("id", "status", "verified_hash")


@query("files_after_rollback", f"WITH {fx.FILES_SQL}, {fx.STEPS_SQL} SELECT id, CASE WHEN id IN (SELECT file_id FROM s WHERE status = 'completed' AND action = 'copy') THEN 'classified' ELSE status END AS status FROM f")
def _(spark, sf):
    steps = fx.steps(spark, sf)
    back = steps.where("status = 'completed' and action = 'copy'").select("id", F.lit("rolled_back").alias("status"))
    return executor.files_back(fx.files(spark, sf), steps, back).select("id", "status")


@query("audit_appended", "SELECT event_id AS id, event_type AS action FROM events UNION ALL SELECT max(event_id) + 1, 'plan_approved' FROM events")
def _(spark, sf):
    known = fx.audit(spark, sf)
    return known.unionByName(store.new_entry(known, "plan_approved", plan_id=7)).select("id", "action")


@query("device_sizes", "SELECT p_partkey AS id, CAST(p_size AS BIGINT) * CASE p_partkey % 5 WHEN 0 THEN 1 WHEN 1 THEN 1024 WHEN 2 THEN 1048576 WHEN 3 THEN 1073741824 ELSE 1099511627776 END AS bytes FROM part")
def _(spark, sf):
    unit = F.element_at(F.array(*map(F.lit, ("", "K", "M", "G", "T"))), (F.col("p_partkey") % 5 + 1).cast("int"))
    return fx.table(spark, sf, "part").select(F.col("p_partkey").alias("id"), formats.parse_device_size(F.concat(F.lit(" "), F.col("p_size").cast("string"), unit)).alias("bytes"))


USER_RULES = '[rules.pictures]\ntype = "extension"\nextensions = ["jpg"]\ncategory = "user"\nrule_priority = 5\n[rules.logs]\ntype = "extension"\nextensions = ["log"]\ncategory = "logs"\n'
POLICY = 'version = "1"\nname = "p"\n[scope]\nexclude_drives = ["src2"]\ninclude_paths = ["/mnt/drive1", "/mnt/drive2"]\n[rules.pictures]\ntype = "extension"\nextensions = ["jpg", "mp4"]\ncategory = "policy"\nrule_priority = 5\n'


@query("rules_merged", f"WITH {fx.FILES_SQL} SELECT id, CASE WHEN lower(extension) IN ('jpg', 'mp4') THEN 'policy' WHEN lower(extension) = 'log' THEN 'logs' END AS category FROM f")
def _(spark, sf):
    """The policy's rules over the user's, written as TOML and read again."""
    by = rules.merged(rules.from_toml(USER_RULES), policies.from_toml(POLICY).rules)
    return rules.classify(fx.files(spark, sf), rules.from_toml(rules.to_toml(by)), now()).select("id", "match.category")


@query("policy_scope", files_sql("drive_id <> 2 AND (abs_path LIKE '/mnt/drive1%' OR abs_path LIKE '/mnt/drive2%')"))
def _(spark, sf):
    return policies.scoped(fx.files(spark, sf), fx.drives(spark, sf), policies.from_toml(POLICY).scope).select(*FILE)


@query("file_review", files_sql("true", "id, CASE WHEN category IS NULL AND status = 'indexed' AND lower(extension) = 'log' AND id % 3 = 0 THEN 'logs' WHEN category IS NULL AND status = 'indexed' AND lower(extension) = 'log' AND id % 3 = 1 THEN 'mine' ELSE category END AS category"))
def _(spark, sf):
    files = fx.files(spark, sf)
    open_ = files.where("category is null and status = 'indexed' and lower(extension) = 'log' and id % 3 < 2")
    said = open_.select("id", F.when(F.expr("id % 3 = 0"), "accept").otherwise("override").alias("action"), F.lit("mine").alias("new_category"), F.lit(None).cast("string").alias("new_subcategory"))
    return rules.apply_file_review(rules.classify(files, rules.from_toml(USER_RULES), now()), said).select("id", "category")


@query("tombstones_spare_unread_folders", files_sql("true", "id, CASE WHEN drive_id = 3 AND id % 2 = 1 AND path NOT LIKE 'en/%' THEN 'source_removed' ELSE status END AS status"))
def _(spark, sf):
    """A scan of one drive that finds every other file and can't read one folder."""
    files = fx.files(spark, sf)
    unread = spark.range(1).select(F.lit("en").alias("path"))
    return store.upsert_files(files, files.where("drive_id = 3 and id % 2 = 0"), 3, unread).select("id", "status")


@query("git_remotes", "SELECT event_id AS id, 'https://h/' || event_id || '.git' AS remote FROM events")
def _(spark, sf):
    text = F.concat(F.lit('[remote "origin"]\n\turl = https://h/'), F.col("event_id").cast("string"), F.lit(".git\n\tfetch = +refs\n\turl = no\n"))
    return fx.table(spark, sf, "events").select(F.col("event_id").alias("id"), formats.git_remote(text).alias("remote"))


@query("known_values", "SELECT event_id AS id, CASE WHEN event_id % 3 = 0 THEN 'trash' ELSE 'normal' END AS priority FROM events")
def _(spark, sf):
    value = F.when(F.col("event_id") % 3 == 0, "TRASH").when(F.col("event_id") % 3 == 1, "no such value")
    return fx.table(spark, sf, "events").select(F.col("event_id").alias("id"), schema.known_value(value, "priority", "normal").alias("priority"))


@query("timestamps_parsed", "SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 < 2 THEN o_orderdate END AS created_at FROM orders")
def _(spark, sf):
    o = fx.table(spark, sf, "orders")
    k = F.col("o_orderkey") % 3
    text = F.when(k == 0, F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss")).when(k == 1, F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'")).otherwise("no time")
    return o.select(F.col("o_orderkey").alias("id"), formats.parse_timestamp(text).alias("created_at"))


@query("verify_by_length", f"WITH {fx.FILES_SQL} SELECT id, CASE WHEN id % 2 = 0 THEN md5_hash = md5_hash ELSE id % 5 <> 0 END AS same FROM f")
def _(spark, sf):
    files = fx.files(spark, sf)
    expected = F.when(F.col("id") % 2 == 0, F.upper("md5_hash")).when(F.col("id") % 5 == 0, F.repeat(F.lit("0"), F.lit(64))).otherwise(F.col("blake3_hash"))
    return files.select("id", hashing.verify(expected, F.col("md5_hash"), F.col("blake3_hash")).alias("same"))


@query("blake3_hash")
def _(spark, sf):
    """BLAKE3 has no SQL; tests hold it against published vectors."""
    return fx.table(spark, sf, "documents").select("doc_id", hashing.content_hash(F.col("text"), "blake3").alias("blake3_hash"))


@query("fs_scan")
def _(spark, sf):
    """The tables' own folder as a tree."""
    return fs.files_of(fs.entries(spark, sf), 1).select("id", "path", "filename", "extension", "size_bytes")


@query("fs_scan_counts")
def _(spark, sf):
    return stats.scan_counts(fs.entries(spark, sf))


# Duplicates in stages, folders, moves, batches


def staged_texts(spark, sf):
    """documents hashed in stages, their texts standing for the files' bytes: blocks of 40 characters at both ends."""
    texts = fx.table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.col("n_chars").alias("size_bytes"), F.lit(None).cast("string").alias("hash"), "text")
    ends = lambda f: f.withColumns({"ends": F.when(F.col("size_bytes") <= 80, F.md5("text")).otherwise(F.md5(F.concat(F.left("text", F.lit(40)), F.right("text", F.lit(40))))), "read_bytes": F.least("size_bytes", F.lit(80)).cast("long")})
    return staged.staged(texts, "hash", ends, lambda f: f.withColumn("hash", F.sha2("text", 256)))


STAGED_SQL = """WITH d AS (SELECT doc_id AS id, n_chars AS size_bytes, text, count(*) OVER (PARTITION BY n_chars) AS same_size FROM documents WHERE n_chars IS NOT NULL),
    s AS (SELECT *, md5(CASE WHEN size_bytes <= 80 THEN text ELSE left(text, 40) || right(text, 40) END) AS ends FROM d WHERE same_size > 1),
    e AS (SELECT *, count(*) OVER (PARTITION BY size_bytes, ends) AS same_ends FROM s WHERE ends IS NOT NULL), h AS (SELECT id, size_bytes, sha256(text) AS hash FROM e WHERE same_ends > 1)"""


@query("staged_duplicates", f"{STAGED_SQL} SELECT min(id) AS group_id, hash, count(*) AS files FROM h GROUP BY hash HAVING count(*) > 1")
def _(spark, sf):
    return staged_texts(spark, sf).by_hash.groupBy("hash").agg(F.min("id").alias("group_id"), F.count("*").alias("files")).where("files > 1")


@query("staged_reads", f"""{STAGED_SQL} SELECT 'size' AS stage, count(*) AS files, CAST(0 AS BIGINT) AS read_bytes FROM s UNION ALL SELECT 'ends', count(*), CAST(coalesce(sum(least(size_bytes, 80)), 0) AS BIGINT) FROM s
    UNION ALL SELECT 'hash', count(*), CAST(coalesce(sum(size_bytes), 0) AS BIGINT) FROM h""")
def _(spark, sf):
    return staged_texts(spark, sf).counts()


def _folders_sql(depth: int = 5) -> str:
    """The levels of the tree, the deepest first; its files lie at most that deep."""
    sums = ", ".join(f"sum(CAST('0x' || sha256('child:' || digest)[{1 + 15 * i}:{15 + 15 * i}] AS HUGEINT)) AS n{i}" for i in range(4))
    steps = ["l AS (SELECT path, h AS digest, 1 AS files, size_bytes AS bytes, len(string_split(path, '/')) AS depth FROM tr)"]
    for d in range(depth, 0, -1):
        below = f" UNION ALL SELECT path, digest, files, bytes FROM f{d}" if d < depth else ""
        steps.append(f"""g{d - 1} AS (SELECT coalesce(regexp_extract(path, '^(.*)/[^/]*$', 1), '') AS path, {sums}, count(*) AS n, count(digest) AS known, sum(files) AS files, sum(bytes) AS bytes
            FROM (SELECT path, digest, files, bytes FROM l WHERE depth = {d}{below}) GROUP BY 1),
            f{d - 1} AS MATERIALIZED (SELECT path, CASE WHEN n = known THEN sha256('folder,' || n || ',' || n0 || ',' || n1 || ',' || n2 || ',' || n3) END AS digest, files, bytes FROM g{d - 1})""")
    every = " UNION ALL ".join(f"SELECT * FROM f{d}" for d in range(depth))
    return f"""WITH {fx.TREE_SQL}, {", ".join(steps)}, fo AS ({every}),
        tw AS (SELECT *, count(*) OVER (PARTITION BY digest) AS copies FROM fo WHERE digest IS NOT NULL), du AS (SELECT * FROM tw WHERE copies > 1),
        ma AS (SELECT digest, path, CAST(files AS BIGINT) AS files, CAST(bytes AS BIGINT) AS bytes, copies, path <> '' AND regexp_extract(path, '^(.*)/[^/]*$', 1) IN (SELECT path FROM du) AS nested FROM du)"""


FOLDERS_SQL = f"{_folders_sql()}, res AS (SELECT * FROM ma WHERE digest IN (SELECT digest FROM ma WHERE NOT nested))"


@query("duplicate_folders", f"{FOLDERS_SQL} SELECT * FROM res")
def _(spark, sf):
    return folders.duplicate_folders(fx.tree(spark, sf)).drop("drive_id")


@query("files_in_duplicate_folders", f"""{FOLDERS_SQL}, way AS (SELECT tr.path, res.path AS folder, res.digest, row_number() OVER (PARTITION BY tr.path ORDER BY len(res.path)) AS r FROM tr JOIN res ON res.path = '' OR starts_with(tr.path, res.path || '/'))
    SELECT path, folder, digest FROM way WHERE r = 1""")
def _(spark, sf):
    files = fx.tree(spark, sf)
    return files.select("id", "path").join(folders.folder_of_files(files, folders.duplicate_folders(files)), "id").select("path", "folder", "digest")


@query("moved_files", f"""WITH {fx.FILES_SQL}, o AS (SELECT id, CASE WHEN id % 10 IN (3, 4) THEN 'swap/' || id ELSE path END AS path FROM f)
    SELECT id AS old_id, id + 1000000 AS new_id, CASE WHEN id % 20 = 7 THEN 'content' WHEN id % 10 IN (3, 4, 7) THEN 'inode' WHEN id % 10 = 1 THEN 'path' ELSE 'same' END AS way FROM o WHERE id % 13 <> 0 AND id % 20 <> 7
    UNION ALL SELECT a.id, b.id + 1000000, 'content' FROM
        (SELECT f.id, coalesce(blake3_hash, md5_hash) AS h, size_bytes, row_number() OVER (PARTITION BY coalesce(blake3_hash, md5_hash), size_bytes ORDER BY o.path, f.id) AS r FROM f JOIN o ON f.id = o.id WHERE f.id % 13 = 0 AND NOT (f.id % 13 <> 0) OR f.id % 20 = 7) a JOIN
        (SELECT id, coalesce(blake3_hash, md5_hash) AS h, size_bytes, row_number() OVER (PARTITION BY coalesce(blake3_hash, md5_hash), size_bytes ORDER BY 'moved/' || path, id) AS r FROM f WHERE id % 13 <> 0 AND id % 20 = 7) b
        ON a.h = b.h AND a.size_bytes = b.size_bytes AND a.r = b.r""")
def _(spark, sf):
    old = fx.scanned(fx.files(spark, sf))
    return moves.matched(old, fx.rescan(old))


@query("plan_batches", f"""WITH RECURSIVE {fx.FILES_SQL}, n AS (SELECT id, size_bytes, row_number() OVER (ORDER BY id) AS i FROM f),
    w AS (SELECT i, id, size_bytes AS total, CAST(0 AS BIGINT) AS batch FROM n WHERE i = 1
          UNION ALL SELECT n.i, n.id, CASE WHEN w.total + n.size_bytes > 50000 THEN n.size_bytes ELSE w.total + n.size_bytes END, CASE WHEN w.total + n.size_bytes > 50000 THEN w.batch + 1 ELSE w.batch END FROM w JOIN n ON n.i = w.i + 1)
    SELECT id, batch FROM w""")
def _(spark, sf):
    return batches.all_batches(fx.files(spark, sf).select("id", "size_bytes"), 50_000).select("id", "batch")


@query("blake3_in_parts")
def _(spark, sf):
    """BLAKE3 of whole documents, of which longer ones are hashed in parts of 2 KB."""
    return hashing.blake3_of_texts(fx.table(spark, sf, "documents"), "doc_id", "text", 2).withColumnRenamed("id", "doc_id")


# Searches by trigrams, many rules, media types


@query("path_search_indexed", r"SELECT page_id AS id, url FROM pages WHERE url ILIKE '%EXAMPLE.%/en/%7%' ESCAPE '\'")
def _(spark, sf):
    pages = fx.table(spark, sf, "pages").select(F.col("page_id").alias("id"), "url")
    path = scratch(spark, "trigrams")
    trigrams.build(pages, "url", path)
    return trigrams.search(pages, "url", path, "EXAMPLE.%/en/%7")


#: More rules than one expression may hold: the later ones win, each takes the files whose name ends with its number.
NUMBERED = [rules.Rule(f"r{k:03d}", "pattern", f"c{k}", patterns=[f"**/*{k}.txt"], rule_priority=k) for k in range(150)] + [rules.Rule("pictures", "extension", "images", extensions=["JPG"], rule_priority=-1), rules.Rule("rest", "size", "large", min_bytes=3000, rule_priority=-2)]


@query("classify_by_many_rules", f"""WITH {fx.FILES_SQL}, b AS (SELECT f.id, max(k) AS k FROM f JOIN (SELECT unnest(range(0, 150)) AS k) r ON ends_with(f.path, k || '.txt') GROUP BY f.id)
    SELECT f.id, CASE WHEN b.k IS NOT NULL THEN 'r' || lpad(CAST(b.k AS VARCHAR), 3, '0') WHEN lower(extension) = 'jpg' THEN 'pictures' WHEN size_bytes >= 3000 THEN 'rest' END AS rule_name,
           CASE WHEN b.k IS NOT NULL THEN 'c' || b.k WHEN lower(extension) = 'jpg' THEN 'images' WHEN size_bytes >= 3000 THEN 'large' END AS category FROM f LEFT JOIN b ON f.id = b.id""")
def _(spark, sf):
    return rules.classify(fx.files(spark, sf), NUMBERED, now()).select("id", "match.rule_name", "match.category")


def _type_sql(column: str) -> str:
    return f"CASE WHEN {column} IS NULL THEN NULL WHEN {column} = '' THEN 'inode/x-empty' WHEN regexp_matches({column}, '^\\s*(<!doctype html|<html)', 'i') THEN 'text/html' ELSE 'text/plain' END"


@query("media_types", f"SELECT 'pages' AS source, page_id AS id, {_type_sql('html')} AS mime_type FROM pages UNION ALL SELECT 'documents', doc_id, {_type_sql('text')} FROM documents")
def _(spark, sf):
    pages, docs = fx.table(spark, sf, "pages"), fx.table(spark, sf, "documents")
    of = lambda t, name, key, content: t.select(F.lit(name).alias("source"), F.col(key).alias("id"), mime.mime_type(F.col(content)).alias("mime_type"))
    return of(pages, "pages", "page_id", "html").unionByName(of(docs, "documents", "doc_id", "text"))


# The catalogue itself, on tables of its own


def kept_catalogue(spark, sf):
    """A catalogue in the scratch folder that holds the fixture's files, without groups, and drives."""
    from .api import Catalogue

    c = Catalogue(spark, scratch(spark, "catalogue"), now())
    c.store.write("files", fx.files(spark, sf))
    c.store.write("drives", fx.drives(spark, sf))
    return c


@query("content_md5", "SELECT doc_id, md5(text) AS md5_hash FROM documents")
def _(spark, sf):
    return fx.table(spark, sf, "documents").select("doc_id", hashing.content_hash(F.col("text")).alias("md5_hash"))


@query("catalogue_dedup_refresh", files_sql("true", "id, duplicate_group, is_original", source="m"))
def _(spark, sf):
    c = kept_catalogue(spark, sf)
    c.dedup_refresh(scan=False)
    return c.files.select("id", "duplicate_group", "is_original")


@query("catalogue_plan_create", step_sql("category = 'trash'", "delete"))
def _(spark, sf):
    c = kept_catalogue(spark, sf)
    plan = c.plan_create("delete-trash")
    return c.steps.where(F.col("plan_id") == plan).select(*STEP_COLUMNS)


NIGHTLY = """version = "1"
name = "nightly"
[rules.temporary]
type = "pattern"
patterns = ["**/tmp/**"]
category = "trash"
[plans.clean]
type = "delete-trash"
"""


@query("catalogue_policy_run", step_sql("category = 'trash' OR category IS NULL AND status = 'indexed' AND regexp_matches(path, '(^|/)tmp/')", "delete"))
def _(spark, sf):
    import tempfile

    c = kept_catalogue(spark, sf)
    with tempfile.NamedTemporaryFile("w", suffix=".toml") as f:  # the driver alone reads it
        f.write(NIGHTLY)
        f.flush()
        (plan,) = c.policy_apply(f.name)
    return c.steps.where(F.col("plan_id") == plan).select(*STEP_COLUMNS)


@query("catalogue_plan_batches", f"""WITH RECURSIVE {fx.FILES_SQL}, n AS (SELECT id, size_bytes, row_number() OVER (ORDER BY id) AS i FROM f WHERE category = 'photos'),
    w AS (SELECT i, id, size_bytes AS size, size_bytes AS total, CAST(0 AS BIGINT) AS batch FROM n WHERE i = 1
          UNION ALL SELECT n.i, n.id, n.size_bytes, CASE WHEN w.total + n.size_bytes > 20000 THEN n.size_bytes ELSE w.total + n.size_bytes END, CASE WHEN w.total + n.size_bytes > 20000 THEN w.batch + 1 ELSE w.batch END FROM w JOIN n ON n.i = w.i + 1)
    SELECT batch, count(*) AS files, CAST(sum(size) AS BIGINT) AS bytes, min(id) AS first_id, max(id) AS last_id FROM w GROUP BY batch""")
def _(spark, sf):
    return kept_catalogue(spark, sf).plan_batches("photos", 20_000)
