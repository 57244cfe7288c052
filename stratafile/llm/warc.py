"""WARC archives: writing records, and reading them back by boundary-chain verification.

Writing: one record for each row. Of records with equal payloads (SHA-1, SHA-256 and length) of at least MIN_REVISIT bytes the one with the largest id is a
response, the others are revisits that refer to it and hold no payload. Spark's text writer makes the files: records end
with the blank lines that WARC asks for, so the writer's line end is theirs.

Reading (WARC/1.0 and 1.1): Spark's text reader splits files at the version line's first bytes, so large files are read in parts by many tasks. A part that goes on like a version line is a candidate
record: its task reads the head and emits (offset, successor), the successor being where the head and Content-Length say that the next
record starts. Payloads can hold version lines too, even whole archives, so candidates prove nothing; a record is real only if the chain of
successors from the start of its file reaches it. Runs of candidates whose successor is simply the next part are contracted where they
were read; pointer jumping then goes over the runs, doubling its stride each round. What lies between a reached record and its successor is
its payload, version lines included. A file whose chain breaks off before its end, by a wrong length or bytes that are no record, is an error that says where; it is read up to there on demand.

A part that holds its whole record has its payload hashed where it was read. Only files with a record whose payload holds a version line are read
a second time, and then the parts of one record meet in a task.

Defined cases: null html is an empty payload; a null url leaves the target out; rows that repeat an id write a record each, a revisit where that row's own payload is that of a larger id; rows that share the
largest id are responses each, and so are rows without an id; an empty table writes an empty
folder and reads as an empty result; payloads of any length and content come back whole; other columns are not read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import BROADCAST_IDS, few, scratch, written

#: What version lines begin with, and how the versions that are read go on.
MAGIC, VERSIONS = "WARC/1.", ("0\r\n", "1\r\n")
END = "\r\n\r\n"
MIN_REVISIT = 1000
#: Files whose names the driver holds to choose what is read again.
FEW_FILES = 10_000
DATE = "2024-01-01T00:00:00Z"


def _record_id(page_id: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(page_id.cast("string"), F.lit("null")), F.lit(">"))


def records(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(record): the whole text of a WARC record for each row, without the blank lines at its end."""
    body = F.coalesce(F.col(html), F.lit(""))
    rows = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).alias("url"), body.alias("body"))
    size = F.octet_length("body").cast("long")
    raw = F.col("body").cast("binary")
    more = F.when(size >= MIN_REVISIT, F.xxhash64(F.sha2(raw, 256), size))
    digests = written(rows.where(size >= MIN_REVISIT).select("page_id", F.sha1(raw).alias("sha1"), more.alias("more")), "op1-digests")
    first = digests.groupBy("sha1", "more").agg(F.max("page_id").alias("response"), F.count("*").alias("n")).where("n > 1")
    revisits = digests.join(first, ["sha1", "more"]).where("page_id < response").select("page_id", "more", "response").distinct()
    # few pages are revisits, as a rule: their ids and digests are broadcast if they are few, else everything meets by them
    rows = rows.withColumn("more", more).join(few(written(revisits, "op1-revisits"), BROADCAST_IDS // 3), ["page_id", "more"], "left")
    again = F.col("response").isNotNull()
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    head = F.concat(
        F.lit(MAGIC + VERSIONS[-1]), line("WARC-Type", F.when(again, "revisit").otherwise("response")), line("WARC-Record-ID", _record_id(F.col("page_id"))), line("WARC-Date", F.lit(DATE)),
        F.coalesce(line("WARC-Target-URI", F.regexp_replace("url", r"[\r\n]+", " ")), F.lit("")), line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.sha1(raw))),
        F.when(again, F.concat(line("WARC-Refers-To", _record_id(F.col("response"))), F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\n"), line("X-Payload-Length", size.cast("string")))).otherwise(""),
        F.lit("Content-Type: text/html; charset=utf-8\r\n"), line("Content-Length", F.when(again, F.lit("0")).otherwise(size.cast("string"))), F.lit("\r\n"),
    )
    return rows.select(F.concat(head, F.when(again, "").otherwise(F.col("body"))).alias("record"))


def write(pages: DataFrame, path: str, **columns) -> None:
    """Writes the pages as WARC files below path, one for each partition."""
    records(pages, **columns).write.option("lineSep", END).option("compression", "none").text(path)


def _header(head: Column, name: str) -> Column:
    return F.nullif(F.regexp_extract(head, rf"(?m)^{name}: ([^\r\n]*)\r?$", 1), F.lit(""))


def _parts(spark: SparkSession, path: str) -> DataFrame:
    """(file, split, i, raw, len): what lies between version lines, i in the order of a split."""
    parts = spark.read.schema(T.StructType([T.StructField("value", T.StringType())])).option("lineSep", MAGIC).text(path)
    raw = F.col("value").cast("binary")
    return parts.select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("i"), raw.alias("raw"), F.octet_length(raw).cast("long").alias("len")
    )


def candidates(spark: SparkSession, path: str, payload: bool = False) -> DataFrame:
    """A row for each part between version lines: its length, what its head says, and whether its record fills it."""
    version = F.substring("raw", F.lit(1), F.lit(len(VERSIONS[0]))).isin(*[F.lit(v.encode()) for v in VERSIONS])
    parts = _parts(spark, path).withColumn("stop", F.when(version, F.position(F.lit(END.encode()), F.col("raw"))).otherwise(0).cast("long"))
    head = F.decode(F.substring("raw", F.lit(1), F.col("stop") + 1), "ISO-8859-1")
    parts = parts.withColumn("head", F.when(F.col("stop") > 0, head))
    content = _header(F.col("head"), "Content-Length").try_cast("long")
    parts = parts.withColumns({"start": F.col("stop") + 3, "content": F.when(F.col("stop") > 0, content)}).withColumn("content", F.when(F.col("content") >= 0, F.col("content")))
    # a part is whole if its record and the blank lines after it fill it
    whole = F.coalesce(F.col("start") + F.col("content") + 4 == F.col("len"), F.lit(False)) & (F.substring("raw", F.col("len") - 3, F.lit(4)) == F.lit(END.encode()))
    body = F.when(F.col("whole"), F.substring("raw", F.col("start") + 1, F.col("content").cast("int")))
    return parts.withColumn("whole", whole).select(
        "file", "split", "i", "len", "start", "content", "whole", F.sha1(body).alias("sha1"), *([body.alias("payload")] if payload else []),
        *[_header(F.col("head"), n).alias(a) for n, a in (("WARC-Type", "type"), ("WARC-Record-ID", "record_id"), ("WARC-Target-URI", "url"), ("WARC-Payload-Digest", "digest"), ("WARC-Refers-To", "refers_to"), ("X-Payload-Length", "full"))],
    )


def _offsets(parts: DataFrame) -> DataFrame:
    """parts with the offset of their version line: the lengths of a split's parts are summed in the split, those of the splits over the file."""
    m = len(MAGIC)
    splits = parts.groupBy("file", "split").agg(F.sum(F.col("len") + m).alias("n"))
    before = Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    starts = splits.select("file", "split", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("o"))
    inside = Window.partitionBy("file", "split").orderBy("i")
    out = parts.join(starts, ["file", "split"]).withColumn("offset", F.col("o") + F.coalesce(F.sum(F.col("len") + m).over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) - m)
    # the text before a file's first version line is no record
    return out.where("offset >= 0").drop("o", "i")


def reachable(links: DataFrame) -> DataFrame:
    """(file, offset) of the real records. links: (file, split, offset, succ), succ null where the head is none."""
    inside = Window.partitionBy("file", "split").orderBy("offset")
    x = links.withColumns({"prev": F.lag("succ").over(inside), "next": F.lead("offset").over(inside)})
    jump = x.where("succ is not null and (next is null or succ <> next)").select("file", F.col("succ").alias("offset")).distinct().withColumn("aimed", F.lit(True))
    # a run starts where the part before doesn't lead here, or where a link from elsewhere does
    x = x.join(jump, ["file", "offset"], "left").withColumn("head", (~F.col("prev").eqNullSafe(F.col("offset"))) | F.col("aimed").isNotNull())
    x = x.withColumn("run", F.max(F.when(F.col("head"), F.col("offset"))).over(inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    x = written(x.select("file", "offset", "succ", "run"), "op1-runs")
    nodes = x.groupBy("file", "run").agg(F.max_by("succ", "offset").alias("to"))
    heads = nodes.select("file", F.col("run").alias("to")).distinct()
    nodes = nodes.join(heads, ["file", "to"], "left_semi").select("file", "run", "to").unionByName(nodes.join(heads, ["file", "to"], "left_anti").select("file", "run", F.lit(None).cast("long").alias("to")))
    pointers = written(nodes, "op1-pointers")
    longest = pointers.groupBy("file").count().agg(F.coalesce(F.max("count"), F.lit(0))).first()[0]
    real = pointers.where("run = 0").select("file", "run")
    stride = 1
    while stride < longest:
        # real holds what lies less than stride steps from the start, pointers lead stride steps on
        step = pointers.where("to is not null")
        real = written(real.unionByName(real.join(step, ["file", "run"]).select("file", F.col("to").alias("run"))).distinct(), "op1-real")
        pointers = step.alias("p").join(step.select("file", F.col("run").alias("to"), F.col("to").alias("on")), ["file", "to"]).select("file", "run", F.col("on").alias("to"))
        pointers = written(pointers, "op1-pointers")
        stride *= 2
    return x.join(real, ["file", "run"], "left_semi").select("file", "offset", "succ")


def _owner(rows: DataFrame) -> DataFrame:
    """rows with own, the offset of the last real record up to there: the last of the part's split, else of the splits before."""
    real = F.when(F.col("real"), F.col("offset"))
    ends = rows.groupBy("file", "split").agg(F.max(real).alias("last"))
    before = Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.select("file", "split", F.max("last").over(before).alias("carried"))
    inside = Window.partitionBy("file", "split").orderBy("offset").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.join(ends, ["file", "split"]).withColumn("own", F.coalesce(F.max(real).over(inside), "carried")).drop("carried")


def _chained(spark: SparkSession, path: str, payload: bool) -> DataFrame:
    """All candidates with their offset and successor; real says that the chain reaches them."""
    parts = _offsets(written(candidates(spark, path, payload), "op1-parts"))
    parts = parts.withColumn("succ", F.col("offset") + len(MAGIC) + F.col("start") + F.col("content") + 4)
    real = reachable(parts.select("file", "split", "offset", "succ")).select("file", "offset", F.lit(True).alias("real"))
    return parts.join(real, ["file", "offset"], "left")


def breaks(rows: DataFrame) -> DataFrame:
    """(file, reached, bytes) of the files whose chain breaks off before their end. rows: candidates with their chain, of files that have any."""
    files = rows.groupBy("file").agg(F.coalesce(F.max(F.when(F.col("real"), F.coalesce("succ", "offset"))), F.lit(0)).alias("reached"), F.max(F.col("offset") + len(MAGIC) + F.col("len")).alias("bytes"))
    return files.where(f"reached not between bytes and bytes + {len(END)}")  # the blank lines of the last record may be missing


def read(spark: SparkSession, path: str, payload: bool = False, strict: bool = True) -> DataFrame:
    """The real records below path: (file, offset, type, record_id, url, digest, refers_to, full, content, sha1), and the payload if asked for.

    digest is what the head says, sha1 that of the payload as it was read; full is the length of a revisit's payload. A chain that breaks off is an error, or, if not
    strict, the end of its file. Files without any version line hold no records."""
    rows = _chained(spark, path, payload)
    if strict and (bad := breaks(rows).orderBy("file").limit(3).collect()):
        raise ValueError("chains of records break off: " + ", ".join(f"{r['file']} at {r['reached']} of {r['bytes']} bytes" for r in bad))
    fields = ["file", "offset", "type", "record_id", "url", "digest", "refers_to", "full", "content"]
    found = rows.where("real and whole").select(*fields, "sha1", *(["payload"] if payload else []))
    # records whose payload holds version lines: their parts, up to the next real record, are read again and joined
    broken = written(rows.where("real and not whole and content is not null").select(*fields, "start"), "op1-broken")
    files = written(broken.select("file").distinct(), "op1-files")
    n = files.count()
    if not n:
        return found
    # the names of a few files prune what is read; more files meet by a join
    chosen = (lambda x: x.where(F.col("file").isin([r[0] for r in files.collect()]))) if n <= FEW_FILES else (lambda x: x.join(files, "file", "left_semi"))
    owned = _owner(chosen(rows).select("file", "split", "offset", "real")).join(broken.select("file", F.col("offset").alias("own")), ["file", "own"])
    pieces = _offsets(chosen(_parts(spark, path))).select("file", "offset", F.col("raw").cast("string").alias("raw")).join(owned.select("file", "offset", "own"), ["file", "offset"])
    glued = pieces.groupBy("file", "own").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("offset", "raw"))), lambda x: x["raw"]), MAGIC).cast("binary").alias("raw"))
    glued = broken.join(glued.withColumnRenamed("own", "offset"), ["file", "offset"]).withColumn("payload", F.substring("raw", (F.col("start") + 1).cast("int"), F.col("content").cast("int")))
    return found.unionByName(glued.select(*fields, F.sha1("payload").alias("sha1"), *(["payload"] if payload else [])))


def page_of(record_id: Column) -> Column:
    return F.regexp_extract(record_id, r"^<urn:page:(-?\d+)>$", 1).try_cast("long")


def archived(pages: DataFrame, path: str | None = None, **columns) -> DataFrame:
    """Writes the pages, reads the archives back, and gives (page_id, payload_bytes, payload_digest, record_type, refers_to, intact) for each record.

    A response's length and digest are those of the payload as read, intact says that the head's digest is the same; a revisit's come from its head."""
    spark = pages.sparkSession
    path = path or scratch(spark, "op1-warc")
    write(pages, path, **columns)
    rows = read(spark, path)
    again = F.col("type") == "revisit"
    said = F.regexp_replace("digest", "^sha1:", "")
    return rows.select(
        page_of(F.col("record_id")).alias("page_id"), F.when(again, F.col("full").cast("long")).otherwise(F.col("content")).alias("payload_bytes"), F.when(again, said).otherwise(F.col("sha1")).alias("payload_digest"),
        F.col("type").alias("record_type"), page_of(F.col("refers_to")).alias("refers_to"), (again | (said == F.col("sha1"))).alias("intact"),
    )
