"""The driver's tables as catalogue tables, so that every operator runs over them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import conform

#: The moment that ages are counted to.
AS_OF = "2026-01-01 00:00:00"
EXTENSIONS = ("txt", "jpg", "pdf", "log", "mp4", "JPG", "bak")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as files, without duplicate groups: a file of every document, its drive the number of the source."""
    d = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"), F.max("toxic").alias("toxic"))
    x = d.join(labels, "doc_id", "left")
    ext = F.element_at(F.array(*map(F.lit, EXTENSIONS)), (F.col("doc_id") % len(EXTENSIONS) + 1).cast("int"))
    name = F.concat(F.col("doc_id").cast("string"), F.lit("."), ext)
    path = F.concat_ws("/", "lang", F.when(F.col("doc_id") % 5 == 0, F.lit("tmp")).otherwise(F.lit("docs")), name)
    drive = F.substring("source", 4, 9).cast("long")
    category = F.when(F.col("doc_id") % 4 == 1, F.lit("documents")).when(F.col("doc_id") % 4 == 2, F.lit("photos")).when(F.col("doc_id") % 12 == 3, F.lit("trash"))
    x = x.select(
        F.col("doc_id").alias("id"), drive.alias("drive_id"), path.alias("path"), F.concat(F.lit("/mnt/drive"), drive.cast("string"), F.lit("/"), path).alias("abs_path"), name.alias("filename"), ext.alias("extension"),
        F.col("n_chars").alias("size_bytes"), F.when(F.col("doc_id") % 11 != 0, F.md5(F.col("text").cast("binary"))).alias("md5_hash"), F.sha2("text", 256).alias("blake3_hash"),
        F.dateadd(F.lit(AS_OF).cast("date"), (-(F.col("doc_id") % 1000)).cast("int")).cast("timestamp").alias("modified_at"), F.lit(False).alias("is_symlink"), category.alias("category"),
        F.when(F.col("toxic") == 1, "trash").when(F.col("quality") == 1, "critical").otherwise("normal").alias("priority"), F.lit(False).alias("is_original"),
        F.when(category.isNotNull(), "classified").when(F.col("doc_id") % 40 == 0, "source_removed").otherwise("indexed").alias("status"),
    )
    return conform(x, "files")


#: files in DuckDB, with the columns that queries compare.
FILES_SQL = """f AS (
    SELECT d.doc_id AS id, CAST(substr(source, 4) AS BIGINT) AS drive_id,
           lang || '/' || CASE WHEN d.doc_id % 5 = 0 THEN 'tmp' ELSE 'docs' END || '/' || d.doc_id || '.' || (['txt', 'jpg', 'pdf', 'log', 'mp4', 'JPG', 'bak'])[d.doc_id % 7 + 1] AS path,
           '/mnt/drive' || CAST(substr(source, 4) AS BIGINT) || '/' || lang || '/' || CASE WHEN d.doc_id % 5 = 0 THEN 'tmp' ELSE 'docs' END || '/' || d.doc_id || '.' || (['txt', 'jpg', 'pdf', 'log', 'mp4', 'JPG', 'bak'])[d.doc_id % 7 + 1] AS abs_path,
           d.doc_id || '.' || (['txt', 'jpg', 'pdf', 'log', 'mp4', 'JPG', 'bak'])[d.doc_id % 7 + 1] AS filename, (['txt', 'jpg', 'pdf', 'log', 'mp4', 'JPG', 'bak'])[d.doc_id % 7 + 1] AS extension,
           n_chars AS size_bytes, CASE WHEN d.doc_id % 11 <> 0 THEN md5(text) END AS md5_hash, sha256(text) AS blake3_hash, TIMESTAMP '2026-01-01' - to_days(CAST(d.doc_id % 1000 AS INTEGER)) AS modified_at,
           CASE WHEN d.doc_id % 4 = 1 THEN 'documents' WHEN d.doc_id % 4 = 2 THEN 'photos' WHEN d.doc_id % 12 = 3 THEN 'trash' END AS category,
           CASE WHEN l.toxic = 1 THEN 'trash' WHEN l.quality = 1 THEN 'critical' ELSE 'normal' END AS priority,
           CASE WHEN d.doc_id % 4 IN (1, 2) OR d.doc_id % 12 = 3 THEN 'classified' WHEN d.doc_id % 40 = 0 THEN 'source_removed' ELSE 'indexed' END AS status
    FROM documents d LEFT JOIN (SELECT doc_id, max(quality) AS quality, max(toxic) AS toxic FROM labels GROUP BY doc_id) l ON d.doc_id = l.doc_id)"""

#: Duplicate groups over f by blake3_hash, and files with their group.
GROUPS_SQL = f"""{FILES_SQL},
    g AS (SELECT min(id) AS group_id, blake3_hash AS hash, CAST(count(*) AS INTEGER) AS file_count, CAST(sum(size_bytes) - arg_min(size_bytes, id) AS BIGINT) AS total_waste_bytes, min(id) AS original_id,
                 list_sort(list_distinct(list(drive_id))) AS drives, count(DISTINCT drive_id) > 1 AS cross_drive FROM f GROUP BY blake3_hash HAVING count(*) > 1),
    m AS (SELECT f.*, g.group_id AS duplicate_group, coalesce(f.id = g.original_id, false) AS is_original FROM f LEFT JOIN g ON f.blake3_hash = g.hash)"""

#: drives in DuckDB.
DRIVES_SQL = """dr AS (
    SELECT DISTINCT CAST(substr(source, 4) AS BIGINT) AS id, source AS label, (['source', 'target', 'backup', 'offload'])[CAST(substr(source, 4) AS BIGINT) % 4 + 1] AS role,
           CAST(substr(source, 4) AS BIGINT) % 5 <> 4 AS is_online, '/mnt/drive' || CAST(substr(source, 4) AS BIGINT) AS mount_path, 1000000000 AS total_bytes FROM documents)"""


def drives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The distinct sources as drives; role and state follow the number."""
    d = table(spark, sf_dir, "documents").select("source").where("source is not null").distinct()
    n = F.substring("source", 4, 9).cast("long")
    x = d.select(
        n.alias("id"), F.col("source").alias("label"), F.concat(F.lit("/dev/"), "source").alias("device_id"), F.concat(F.lit("/mnt/drive"), n.cast("string")).alias("mount_path"), F.lit("ext4").alias("fs_type"),
        F.lit(1_000_000_000).alias("total_bytes"), F.element_at(F.array(*map(F.lit, ("source", "target", "backup", "offload"))), (n % 4 + 1).cast("int")).alias("role"), (n % 5 != 4).alias("is_online"),
        F.lit(False).alias("is_readonly"), F.lit("local").alias("backend"), F.timestamp_seconds(n + 1_700_000_000).alias("added_at"),
    )
    return conform(x, "drives")


def plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders as plans."""
    o = table(spark, sf_dir, "orders")
    status = F.when(F.col("o_orderstatus") == "F", "completed").when(F.col("o_orderstatus") == "P", "approved").otherwise(F.when(F.col("o_orderkey") % 3 == 0, "in_progress").otherwise("draft"))
    total = F.floor("o_totalprice").cast("long")
    x = o.select(
        F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("created_at"), F.col("o_orderpriority").alias("description"), status.alias("status"), F.lit(1).alias("total_files"), total.alias("total_bytes"),
        F.when(status == "completed", 1).otherwise(0).alias("completed_files"), F.when(status == "completed", total).otherwise(F.lit(0)).alias("completed_bytes"),
    )
    return conform(x, "migration_plans")


PLANS_SQL = """p AS (
    SELECT o_orderkey AS id, o_orderdate AS created_at, o_orderpriority AS description,
           CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'P' THEN 'approved' ELSE CASE WHEN o_orderkey % 3 = 0 THEN 'in_progress' ELSE 'draft' END END AS status,
           CAST(floor(o_totalprice) AS BIGINT) AS total_bytes, CASE WHEN o_orderstatus = 'F' THEN CAST(floor(o_totalprice) AS BIGINT) ELSE 0 END AS completed_bytes FROM orders)"""


def steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem as steps, numbered within their order by all columns that tell rows apart."""
    from pyspark.sql import Window

    line = table(spark, sf_dir, "lineitem")
    over = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    x = line.select(
        F.xxhash64("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("id"), F.col("l_orderkey").alias("plan_id"), F.col("l_partkey").alias("file_id"),
        F.when(F.col("l_linestatus") == "F", "copy").otherwise("delete").alias("action"), F.concat(F.lit("/p/"), F.col("l_partkey").cast("string")).alias("source_path"), F.col("l_suppkey").alias("source_drive_id"),
        F.when(F.col("l_returnflag") == "A", "completed").when(F.col("l_returnflag") == "R", "failed").otherwise("pending").alias("status"),
        F.when(F.col("l_returnflag") == "A", "h").alias("post_hash"), F.col("l_shipdate").alias("executed_at"), (F.row_number().over(over) - 1).alias("step_order"),
    )
    return conform(x, "migration_steps")


STEPS_SQL = """s AS (
    SELECT l_orderkey AS plan_id, l_partkey AS file_id, CASE WHEN l_linestatus = 'F' THEN 'copy' ELSE 'delete' END AS action, '/p/' || l_partkey AS source_path,
           CASE l_returnflag WHEN 'A' THEN 'completed' WHEN 'R' THEN 'failed' ELSE 'pending' END AS status, CASE WHEN l_returnflag = 'A' THEN 'h' END AS post_hash,
           CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) - 1 AS INTEGER) AS step_order FROM lineitem)"""


def audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as audit entries; a third of them names a plan."""
    e = table(spark, sf_dir, "events")
    x = e.select(F.col("event_id").alias("id"), F.col("ts").alias("timestamp"), F.col("event_type").alias("action"), F.col("user_id").alias("file_id"), F.when(F.col("event_id") % 3 == 0, F.col("event_id") % 50).alias("plan_id"), F.col("props").alias("details"), F.lit("automated").alias("agent_mode"))
    return conform(x, "audit_log")


def lint_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(value): documents as lint NDJSON, with comments, blanks and broken lines in between."""
    f = files(spark, sf_dir)
    kind = F.when(F.col("id") % 10 == 7, "emptyfile").when(F.col("id") % 10 == 8, "badlink").when(F.col("id") % 10 == 9, "nosuchtype").otherwise("duplicate_file")
    body = F.to_json(F.struct(kind.alias("type"), F.when(F.col("id") % 6 == 5, F.concat(F.lit("/gone"), "abs_path")).otherwise(F.col("abs_path")).alias("path"), F.col("size_bytes").alias("size"), F.col("blake3_hash").alias("checksum"), (F.col("id") % 3 == 0).alias("is_original"), F.col("drive_id").alias("disk_id")))
    line = F.when(F.col("id") % 17 == 0, F.concat(F.lit("// "), body)).when(F.col("id") % 19 == 0, F.lit("   ")).when(F.col("id") % 23 == 0, F.left(body, F.length(body) - 3)).otherwise(F.concat(F.lit("  "), body))
    return f.select(F.explode(F.array(line)).alias("value"))  # made once, whatever is asked of it


#: The lints that are read from lint_lines, in DuckDB; i numbers them.
LINTS_SQL = f"""{FILES_SQL},
    li AS (SELECT id AS i, CASE id % 10 WHEN 7 THEN 'emptyfile' WHEN 8 THEN 'badlink' WHEN 9 THEN 'other' ELSE 'duplicate_file' END AS type, CASE WHEN id % 6 = 5 THEN '/gone' || abs_path ELSE abs_path END AS path,
                  size_bytes AS size, blake3_hash AS checksum, id % 3 = 0 AS is_original, drive_id AS disk_id FROM f WHERE id % 17 <> 0 AND id % 19 <> 0 AND id % 23 <> 0)"""



def tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as the files of two trees, a and b: of each file a copy in b, but for those with a number that is divisible by 29; some lie a level deeper."""
    d = table(spark, sf_dir, "documents")
    bucket = (F.col("doc_id") % 7).cast("string")
    inner = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("deep/"), F.col("doc_id").cast("string"))).otherwise(F.col("doc_id").cast("string"))
    both = F.filter(F.array(F.lit("a"), F.lit("b")), lambda t: (t == "a") | (F.col("doc_id") % 29 != 0))
    return d.select(F.explode(both).alias("t"), "doc_id", "lang", bucket.alias("bucket"), inner.alias("inner"), "text", "n_chars").select(
        F.lit(1).cast("long").alias("drive_id"), F.concat_ws("/", "t", "lang", "bucket", "inner").alias("path"), F.col("n_chars").alias("size_bytes"), F.when(F.col("doc_id") % 41 != 5, F.sha2("text", 256)).alias("blake3_hash"),
        (F.col("doc_id") * 2 + F.when(F.col("t") == "b", 1).otherwise(0)).alias("id"),
    )


TREE_SQL = """tr AS (
    SELECT t || '/' || lang || '/' || doc_id % 7 || '/' || CASE WHEN doc_id % 3 = 0 THEN 'deep/' ELSE '' END || doc_id AS path, n_chars AS size_bytes, CASE WHEN doc_id % 41 <> 5 THEN sha256(text) END AS h
    FROM documents CROSS JOIN (VALUES ('a'), ('b')) v(t) WHERE t = 'a' OR doc_id % 29 <> 0)"""


def rescan(files: DataFrame) -> DataFrame:
    """The files as a later scan might find them: some renamed, some swapped with their neighbour, some edited, some copied anew, some gone, and new ones."""
    n = F.col("id")
    swapped = F.when(n % 10 == 3, n + 1).when(n % 10 == 4, n - 1)
    x = files.where(n % 13 != 0)
    x = x.withColumn("path", F.when(n % 10 == 7, F.concat(F.lit("moved/"), "path")).when(swapped.isNotNull(), F.concat(F.lit("swap/"), swapped.cast("string"))).otherwise(F.col("path")))
    x = x.withColumn("inode", F.when(n % 20 == 7, n + 5_000_000).otherwise(F.col("inode"))).withColumn("modified_at", F.when(n % 10 == 1, F.col("modified_at") + F.expr("interval 1 day")).otherwise(F.col("modified_at")))
    return x.withColumn("id", n + 1_000_000)


def scanned(files: DataFrame) -> DataFrame:
    """The files with inodes, on one drive, and the names that rescan swaps."""
    n = F.col("id")
    return files.withColumns({"drive_id": F.lit(1).cast("long"), "inode": n, "device_num": F.lit(1).cast("long"), "hash": F.coalesce("blake3_hash", "md5_hash"), "path": F.when((n % 10).isin(3, 4), F.concat(F.lit("swap/"), n.cast("string"))).otherwise(F.col("path"))})
