"""All batches of a plan: files in order are cut into successive batches of at most so many bytes, each as long as it can be.

Where a batch ends depends on where it began, so a walk would do it row by row. Here every row gets a pointer to the row that would begin the next batch if one began with it, which follows from
running sums: it is the first whose running sum is over that before the row and the limit. Rows and limits are put into one order and each limit takes the next row, by a running minimum from the order's end: Spark
computes a frame that ends with the current row in one pass, but one that begins with it anew for each row. Only rows that a pointer leads to can begin a batch. From the first row the pointers are then followed by doubling: in round k
the known beginnings jump 2^k batches on, and pointers are composed with themselves, so that 2^20 batches take 20 rounds of two joins on row numbers. Pointers beyond the last row are left out, so that no key gathers them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import order
from ..scratch import few, written


def _pointers(rows: DataFrame, n: int, max_bytes: int) -> DataFrame:
    """(place, next): for each row of (place, size, running) the place of the first row that a batch which begins there can't hold; rows whose batch holds all that follow are left out."""
    ends = rows.select(F.col("running").alias("v"), F.lit(0).alias("kind"), "place")
    limits = rows.select((F.col("running") - F.col("size") + max_bytes).alias("v"), F.lit(1).alias("kind"), "place")
    both = ends.unionByName(limits)
    keys = [F.col("v"), F.col("kind"), F.col("place")]
    own = F.when(F.col("kind") == 0, F.col("place"))
    so_far = (Window.unboundedPreceding, Window.currentRow)
    if n <= order.ONE_TASK:
        after = Window.orderBy(*[k.desc() for k in keys]).rowsBetween(*so_far)
        found = both.withColumn("next", F.min(own).over(after))
    else:
        kept = order.in_pieces(both, keys, 2 * n // order.PIECE + 1)
        firsts = kept.groupBy("_piece").agg(F.min(own).alias("_first"))
        later = written(firsts.select("_piece", F.min("_first").over(Window.orderBy(F.desc("_piece")).rowsBetween(Window.unboundedPreceding, -1)).alias("_later")), "batches-pieces")  # a row for each piece
        after = Window.partitionBy("_piece").orderBy(F.desc("_place")).rowsBetween(*so_far)
        found = kept.withColumn("next", F.min(own).over(after)).join(few(later), "_piece").withColumn("next", F.coalesce("next", "_later"))
    # a file beyond the limit is a batch by itself
    return found.where("kind = 1").select("place", F.greatest(F.coalesce("next", F.lit(n)), F.col("place") + 1).alias("next")).where(F.col("next") < n)


def _beginnings(pointers: DataFrame) -> DataFrame:
    """(place) of every row that begins a batch."""
    spark = pointers.sparkSession
    first = spark.range(1).select(F.col("id").alias("place"))
    starts, pointers = written(first, "batches-starts"), written(pointers, "batches-pointers")
    led_to = pointers.select(F.col("next").alias("place")).distinct().unionByName(first)  # no pointer leads to row 0
    jump = written(pointers.join(led_to, "place", "left_semi"), "batches-jumps")
    while not jump.isEmpty():
        ahead = starts.join(jump, "place").select(F.col("next").alias("place"))
        starts = written(starts.unionByName(ahead), "batches-starts")  # each jump leads beyond all that is known
        on = jump.select(F.col("place").alias("next"), F.col("next").alias("_next"))
        jump = written(jump.join(on, "next").select("place", F.col("_next").alias("next")), "batches-jumps")
    return starts


def all_batches(files: DataFrame, max_bytes: int, key: str = "id", ties: list[str] | None = None) -> DataFrame:
    """files with `batch`, numbered from 0: batches in the order of key, then ties, each of as many files as have max_bytes together at most; a larger file is a batch of its own. Null sizes are 0, sizes are never negative."""
    if max_bytes < 0:
        raise ValueError("max_bytes must not be negative")
    size = F.coalesce(F.col("size_bytes"), F.lit(0)).cast("long")
    rows = order.with_running(files, key, {"_running": size, "_at": F.lit(1)}, ties)
    rows = written(rows.withColumn("_at", (F.col("_at") - 1).cast("long")), "batches-rows")
    n = rows.count()
    if not n:
        return files.withColumn("batch", F.lit(0).cast("long"))
    narrow = rows.select(F.col("_at").alias("place"), size.alias("size"), F.col("_running").cast("long").alias("running"))
    starts = _beginnings(_pointers(narrow, n, max_bytes)).select(F.col("place").alias("_at"), F.lit(1).alias("_starts"))
    marked = rows.join(starts, "_at", "left").withColumn("_starts", F.coalesce("_starts", F.lit(0)))
    return order.with_running(marked, "_at", {"batch": F.col("_starts")}).withColumn("batch", (F.col("batch") - 1).cast("long")).select(*files.columns, "batch")
