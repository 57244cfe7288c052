"""Mixing sources to target weights by a low-discrepancy schedule.

Targets: sources in code-point order (null last) weigh 5, 2, 1, repeating, and share all words by weight; a target stops at MAX_EPOCHS times its
source's words and the excess goes to the others by weight until none is above.

Schedule: slot i belongs to the source in whose share of the unit interval, laid out by cumulative targets, the i-th golden-ratio point falls, so that every
stretch of the schedule holds the sources in proportion. Slots are ranked within their source; the r-th takes the r-th block of equally many
words of the source's shuffled documents, which start anew when they end. A slot for each block of all words is drawn; so a source gives as many blocks as
points fall into its share, which differs from its target by the discrepancy of the points, a few blocks of total / SLOTS words. Only where that would pass MAX_EPOCHS
times its words do its blocks end there.

A source of any size is spread: places in the shuffled order, and ranks of slots, come from bucket sums (common.with_before), and blocks meet slots by (source, rank).

Defined cases: a null text has no words and is never taken; a null source is a source of its own; the order within a source is that of an MD5 of doc_id and
text, ties by doc_id, size and text, so reruns agree whatever the order of the input; rows that repeat id, text and source are documents of their own, and which of
them is which does not matter; rows without an id are spread by their text; texts of any length are counted whole and stand in as many slots as they need; an
empty table gives an empty result; other columns are not read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, few, own_prefix, with_before, written

#: Slots of a schedule over all words, at most; a block has total / SLOTS words, rounded up.
SLOTS = 1 << 17
WEIGHTS = (5, 2, 1)
MAX_EPOCHS = 3
#: 2^32 divided by the golden ratio, odd: multiples modulo 2^32 are the golden-ratio points.
GOLDEN = 2_654_435_769
CELL_BITS = 20


def words(text: Column) -> Column:
    """Number of words of a text, 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame) -> DataFrame:
    """(s, source, source_size) -> with target: double, and quota, its whole part."""
    k = len(WEIGHTS)
    all_, rest = Window.partitionBy(F.lit(0)), Window.partitionBy(F.lit(0))
    ranked = sizes.withColumn("rank", F.row_number().over(all_.orderBy(F.col("source").asc_nulls_last())))
    ranked = ranked.withColumn("w", F.element_at(F.array(*map(F.lit, WEIGHTS)), F.pmod(F.col("rank") - 1, F.lit(k)) + 1).cast("long"))
    # those that stop at their limit come first in the order of limit / weight; 10 / 5, 10 / 2 and 10 / 1 are whole
    order = rest.orderBy(F.expr("source_size * (10 div w)"), "rank")
    x = ranked.withColumns({
        "total": F.sum("source_size").over(all_),
        "cap": F.col("source_size") * MAX_EPOCHS,
        "cap_before": F.coalesce(F.sum(F.col("source_size") * MAX_EPOCHS).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
        "w_from": F.sum("w").over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing)),
    })
    wide = lambda a, b: F.col(a).cast("decimal(19,0)") * F.col(b).cast("decimal(19,0)")
    x = x.withColumn("left_", F.col("total") - F.col("cap_before")).withColumn("capped", wide("left_", "w") >= wide("cap", "w_from"))
    x = x.withColumns({
        "r": F.col("total") - F.sum(F.when(F.col("capped"), F.col("cap")).otherwise(0)).over(rest),
        "u": F.sum(F.when(F.col("capped"), 0).otherwise(F.col("w"))).over(rest),
    })
    target = F.when(F.col("capped"), F.col("cap").cast("double")).otherwise((F.col("w") * F.col("r")).cast("double") / F.col("u").cast("double"))
    return x.select("s", "source", "source_size", "rank", "total", target.alias("target")).withColumn("quota", F.floor("target").cast("long"))


def slots(goal: DataFrame, n: int) -> DataFrame:
    """(s, block_no, position): the schedule, n slots. goal: a row per source with s, rank, quota. block_no ranks a source's slots from 0."""
    spark = goal.sparkSession
    every = Window.partitionBy(F.lit(0))
    upto = every.orderBy("rank").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    wide = goal.where("quota > 0").select("s", "rank", F.sum("quota").over(upto).cast("decimal(28,0)").alias("cum"), F.sum("quota").over(every).cast("decimal(28,0)").alias("whole"))
    share = wide.select("s", "rank", F.expr(f"(cum * {2**32}BD) div whole").alias("hi"))
    share = share.withColumn("lo", F.coalesce(F.lag("hi").over(every.orderBy("rank")), F.lit(0)))
    cells = share.where("hi > lo").select("s", "lo", "hi", F.explode(F.sequence(F.shiftright("lo", CELL_BITS), F.shiftright(F.col("hi") - 1, CELL_BITS))).alias("cell"))
    points = spark.range(n).select(F.col("id").alias("position"), F.pmod(F.col("id") * GOLDEN, F.lit(2**32)).alias("u")).withColumn("cell", F.shiftright("u", CELL_BITS))
    owned = points.join(cells, "cell").where("u >= lo and u < hi").select("s", "position", (F.col("position") * ((2**63 - 1) // max(n, 1))).alias("h"))
    return with_before(owned, ["s"], "h", [], {"block_no": F.lit(1)}, n).select("s", F.col("block_no").cast("long"), "position")


def schedule(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", n_slots: int = SLOTS) -> DataFrame:
    """What the mix takes: a row for each slot and stretch of a document in it, and one with null position for each document that it doesn't take.

    (s, place, doc_id, digest, size, source, source_size, target, epoch, position, from_word, to_word): place numbers the documents of a source; words from_word to
    to_word - 1 of the document stand at that slot of the schedule."""
    src, digest = F.col(source), F.md5(F.coalesce(F.col(text), F.lit("")))
    key = F.md5(F.concat(F.coalesce(F.col(doc_id).cast("string"), F.lit("")), F.lit(" "), digest))
    rows = docs.select(
        F.col(doc_id).cast("long").alias("doc_id"), F.when(src.isNull(), "n").otherwise(F.concat(F.lit("s"), src)).alias("s"), src.alias("source"), words(F.col(text)).alias("size"),
        F.unhex(digest).alias("digest"), F.shiftleft(F.conv(F.substring(key, 1, 15), 16, 10).cast("long"), 3).alias("h"),
    )
    rows = written(rows, "op2-sizes")
    n, total = rows.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    block = max(1, -(-total // n_slots))
    goal = written(targets(rows.groupBy("s").agg(F.first("source").alias("source"), F.sum("size").alias("source_size"))), "op2-targets")
    drawn = written(slots(goal, -(-total // block)), "op2-slots")
    gives = drawn.groupBy("s").agg(F.count("*").alias("drawn"))
    gives = goal.join(gives, "s", "left").select("s", "source_size", "target", F.least(F.coalesce("drawn", F.lit(0)) * block, F.col("source_size") * MAX_EPOCHS).alias("gives"))
    gives = few(written(gives, "op2-gives"))
    placed = with_before(rows, ["s"], "h", ["doc_id", "size", "digest"], {"start": F.col("size"), "place": F.lit(1)}, n)
    laid = placed.join(gives, "s")
    none = F.lit(0).cast("long")
    epochs = F.when((F.col("gives") > 0) & (F.col("size") > 0), F.sequence(none, F.expr("(gives - 1) div source_size"))).otherwise(F.array().cast("array<long>"))
    laid = laid.withColumn("epoch", F.explode_outer(epochs))
    laid = laid.withColumn("a", F.col("epoch") * F.col("source_size") + F.col("start")).withColumn("z", F.least(F.col("a") + F.col("size"), F.col("gives")))
    blocks = F.when(F.col("z") > F.col("a"), F.sequence(F.expr(f"a div {block}"), F.expr(f"(z - 1) div {block}"))).otherwise(F.array().cast("array<long>"))
    # documents that give nothing meet no slot; their numbers differ, so that those of a large source don't meet in one task
    laid = laid.withColumn("block_no", F.explode_outer(blocks)).withColumn("block_no", F.coalesce("block_no", -1 - F.pmod(F.col("place"), F.lit(1_000_000))))
    met = laid.join(drawn, ["s", "block_no"], "left")
    first, last = F.greatest("a", F.col("block_no") * block) - F.col("a"), F.least("z", (F.col("block_no") + 1) * block) - F.col("a")
    hit = F.col("position").isNotNull()
    return met.select(
        "s", "place", "doc_id", "digest", "size", "source", "source_size", "target", "epoch", "position", F.when(hit, first).alias("from_word"), F.when(hit, last).alias("to_word")
    )


def mix(docs: DataFrame, **columns) -> DataFrame:
    """(doc_id, size, source_size, target, taken, first_slot, n_slots), a row for each row of docs: taken counts the words that the schedule takes, repeats too,
    first_slot is the first slot that holds some of them, n_slots the number of stretches of the document in slots."""
    took = schedule(docs, **columns).groupBy("s", "place", "doc_id", "size", "source_size", "target")
    return took.agg(F.coalesce(F.sum(F.col("to_word") - F.col("from_word")), F.lit(0)).alias("taken"), F.min("position").alias("first_slot"), F.count("position").alias("n_slots")).drop("s", "place")


def mixed(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", n_slots: int = SLOTS) -> DataFrame:
    """Whole documents in the order of the schedule, all columns of docs: a copy for each slot that holds a document's first word, sorted by slot, and within a slot as
    the source's documents follow each other. A source's words so come within one document of the schedule's.

    Rows that repeat id, text and source stand for each other: their copies are copies of one of them."""
    names, p = docs.columns, own_prefix(docs.columns)
    key, order = [f"{p}{c}" for c in ("id", "digest", "s")], [f"{p}{c}" for c in ("slot", "place")]
    first = schedule(docs, doc_id, text, source, n_slots).where("from_word = 0")
    first = written(first.select(*[F.col(c).alias(a) for c, a in zip(("doc_id", "digest", "s", "position", "place"), key + order)]), "op2-first")
    rows = docs.withColumns(dict(zip(key, (F.col(doc_id).cast("long"), F.unhex(F.md5(F.coalesce(F.col(text), F.lit("")))), F.when(F.col(source).isNull(), "n").otherwise(F.concat(F.lit("s"), F.col(source)))))))
    again = written(first.groupBy(*key).agg(F.countDistinct(order[1]).alias("n")).where("n > 1").drop("n"), "op2-again")

    def meet(x: DataFrame, y: DataFrame, how: str) -> DataFrame:
        return x.join(few(y), [x[c].eqNullSafe(y[c]) for c in key], how)

    if again.limit(1).count():
        rows = meet(rows, again, "left_anti").unionByName(meet(rows, again, "left_semi").dropDuplicates(key))
    out = meet(rows, first, "inner").select(*[rows[c] for c in names], *[first[c] for c in order])
    return out.repartitionByRange(*order).sortWithinPartitions(*order).select(*names)
