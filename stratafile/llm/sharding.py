"""Sharding by a k-d tree over metadata, in DataFrame operations only.

A node that is to give k shards is cut along the dimension in which its rows spread widest, at the weighted quantile that leaves k // 2 of k shards' bytes
on the low side, until every leaf is one shard, of total / shards bytes. Cuts are found by histograms: all nodes of a level share one job, which sums bytes
by node, dimension and bin (about 4 * BINS sums go to the driver, whatever the input), and the bins that hold the quantiles are split again, in one job for all, until they
are lighter than EXACT of a shard. Rows are never moved; a row's shard is an expression over its coordinates.

Dimensions: source and language (places in the order of their values), length (log scale) and doc_id, each from 0 to 2^30 over the whole table; below them, in the low 32 bits, a
hash that tells rows with equal values apart. Equal texts share the coordinates of the one with the smallest doc_id (ties: the smallest source and language), so they have
one place in the tree and share a shard. A group of more than HEAVY of a shard is a unit of its own: a node deals its heavy groups to its sides in the
order of their coordinates, in proportion to the shards there, and the cut leaves the other rows the bytes that are still wanting on each side. There are at most shards / HEAVY such groups,
which is what the driver holds of them. Only a group of more than a whole shard can't stay together: its rows are told apart by a hash of doc_id and may be cut anywhere.

Defined cases: a null text weighs 16 bytes and equals the empty text; null metadata come before all other values; a null doc_id counts as the smallest; repeated rows are rows of
their own, and equal texts; of two sides equally near a cut goes up to the row that holds the quantile; the widest of equally wide dimensions is the first; an empty table gives an
empty result; fewer groups than shards leave shards empty; texts of any length are weighed whole; other columns are not read."""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import few, with_before, written

OVERHEAD = 16
#: Bins of all nodes of a level together, in each dimension, about.
BINS = 8192
#: Parts of a shard's bytes: how exact a cut is, and from where on equal texts are a unit of their own.
EXACT, HEAVY = 0.002, 0.002
DIMS = ("source", "lang", "length", "doc")
SCALE = 2**30
GROUP = ["th", "text_crc32", "size"]


def _local(spark: SparkSession, rows: list[dict], schema: str) -> DataFrame:
    """A few rows of the driver's as a table."""
    return spark.range(1).select(F.inline(F.from_json(F.lit(json.dumps(rows)), f"array<struct<{schema}>>")))


def _rows(docs: DataFrame, doc_id: str, text: str, source: str, lang: str) -> DataFrame:
    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(
        F.col(doc_id).cast("long").alias("doc_id"), (F.octet_length(body) + OVERHEAD).cast("long").alias("size"), F.crc32(F.encode(body, "UTF-8")).alias("text_crc32"), F.xxhash64(body).alias("th"),
        F.col(source).cast("string").alias("source"), F.col(lang).cast("string").alias("lang"),
    )
    return written(rows, "op10-rows")


def _keys(rows: DataFrame, target: float) -> DataFrame:
    """Rows with k0 to k3, a coordinate and hash for each dimension, and whether they belong to a heavy group."""
    first = F.min_by(F.struct("source", "lang", "doc_id"), F.struct(F.coalesce("doc_id", F.lit(2**63 - 1)), "source", "lang"))
    copies = rows.groupBy(*GROUP).agg(F.count("*").alias("n"), first.alias("first")).where("n > 1")
    copies = written(copies.select(*GROUP, (F.col("n") * F.col("size")).cast("double").alias("weight"), *[F.col(f"first.{c}").alias(f"g_{c}") for c in ("source", "lang", "doc_id")]), "op10-copies")
    x = rows.join(few(copies), GROUP, "left")
    shared = F.col("weight").isNotNull()
    x = x.withColumns({c: F.when(shared, F.col(f"g_{c}")).otherwise(F.col(c)) for c in ("source", "lang")} | {"doc": F.coalesce(F.when(shared, F.col("g_doc_id")).otherwise(F.col("doc_id")), F.lit(0)).cast("double")})
    ends = rows.agg(F.min("size"), F.max("size"), F.min(F.coalesce("doc_id", F.lit(0))), F.max(F.coalesce("doc_id", F.lit(0)))).first()

    def scaled(value: Column, lo: Column, hi: Column) -> Column:
        return F.when(hi > lo, F.floor((value - lo) / (hi - lo) * SCALE)).otherwise(0).cast("long")

    for c in ("source", "lang"):
        order = Window.partitionBy(F.lit(0))
        places = rows.select(F.col(c).alias(f"{c}_of")).distinct().withColumn("place", F.row_number().over(order.orderBy(F.col(f"{c}_of").asc_nulls_first())).cast("double"))
        places = written(places.select(f"{c}_of", scaled(F.col("place"), F.lit(1.0), F.max("place").over(order)).alias(f"{c}_at")), "op10-places")
        x = x.join(few(places), F.col(c).eqNullSafe(F.col(f"{c}_of")), "left")
    length = scaled(F.log2(F.col("size").cast("double")), F.log2(F.lit(float(ends[0]))), F.log2(F.lit(float(ends[1]))))
    coordinates = [F.col("source_at"), F.col("lang_at"), length, scaled(F.col("doc"), F.lit(float(ends[2])), F.lit(float(ends[3])))]
    weight = F.coalesce("weight", F.lit(0.0))
    low = F.shiftrightunsigned(F.when(weight > target, F.xxhash64("th", "doc_id")).otherwise(F.xxhash64("th", "text_crc32")), 32)
    keyed = x.select("doc_id", *GROUP, ((weight > HEAVY * target) & (weight <= target)).alias("heavy"), *[F.shiftleft(c, 32).bitwiseOR(low).alias(f"k{i}") for i, c in enumerate(coordinates)])
    return written(keyed, "op10-keys")


@dataclass
class Node:
    """A part of the tree that is still to be cut into k shards: its bounds in each dimension, its heavy groups as (keys, bytes, number)."""

    k: int
    bounds: list[tuple[int, int]]
    heavy: list[tuple[tuple[int, ...], int, int]]
    dim: int = 0
    goal: float = 0.0
    before: int = 0
    lo: int = 0
    hi: int = -1
    sums: list[tuple[int, int, int, int]] = field(default_factory=list)


def _place(tree, leaf=lambda x: F.lit(x)) -> Column:
    """The expression of a node's number: a tree is a number, or (dimension, cut, low, high)."""
    if isinstance(tree, int):
        return leaf(tree)
    d, cut, low, high = tree
    return F.when(F.col(f"k{d}") <= F.lit(cut), _place(low, leaf)).otherwise(_place(high, leaf))


def _sums(rows: DataFrame, node: Column, asked: list[tuple[int, int, int, int, int]], every: bool) -> dict[tuple[int, int], list[tuple[int, int, int, int]]]:
    """For each (node, dimension, low end, high end, bins) asked for, the (bin, bytes, least key, greatest key) that have rows. every: all dimensions of a node, else one."""
    table = [{"node": n, "dim": d, "lo": lo, "hi": hi, "width": -(-(hi - lo + 1) // bins)} for n, d, lo, hi, bins in asked]
    table = F.broadcast(_local(rows.sparkSession, table, "node int, dim int, lo long, hi long, width long"))
    keys = [F.col(f"k{i}") for i in range(len(DIMS))]
    at = rows.select("size", node.cast("int").alias("node"), *(keys if not every else [F.posexplode(F.array(*keys)).alias("dim", "k")]))
    at = at.join(table, ["node", "dim"] if every else "node")
    at = at if every else at.withColumn("k", F.element_at(F.array(*keys), F.col("dim") + 1))
    at = at.where("k >= lo and k <= hi").groupBy("node", "dim", F.expr("(k - lo) div width").alias("bin")).agg(F.sum("size").alias("w"), F.min("k").alias("least"), F.max("k").alias("most"))
    found: dict[tuple[int, int], list[tuple[int, int, int, int]]] = {}
    for r in at.collect():
        found.setdefault((r["node"], r["dim"]), []).append((r["bin"], r["w"], r["least"], r["most"]))
    return found


def _cut(rows: DataFrame, place: Column, open_: dict[int, Node], shards: int, exact: float) -> dict[int, tuple[int, int, int]]:
    """For each open node the dimension, the cut (rows up to it go low) and how many of its heavy groups, in their order, go low."""
    bins = {n: max(64, BINS * x.k // shards) for n, x in open_.items()}
    found = _sums(rows, place, [(n, d, lo, hi, bins[n]) for n, x in open_.items() for d, (lo, hi) in enumerate(x.bounds)], True)
    done, todo = {}, dict(open_)
    for n, x in open_.items():
        spans = [found.get((n, d), []) for d in range(len(DIMS))]
        if spans[0]:
            x.bounds = [(min(s[2] for s in of), max(s[3] for s in of)) for of in spans]
        wide = [(hi >> 32) - (lo >> 32) for lo, hi in x.bounds]
        x.dim = wide.index(max(wide))
        x.lo, x.hi = x.bounds[x.dim]
        x.sums = spans[x.dim]
        x.heavy.sort(key=lambda h: (h[0][x.dim], h[2]))
        bytes_, below = sum(s[1] for s in x.sums), x.k // 2
        part = sum(h[1] for h in x.heavy) * below / x.k
        runs = [0]
        for h in x.heavy:
            runs.append(runs[-1] + h[1])
        low = min(range(len(runs)), key=lambda j: (abs(runs[j] - part), j))
        x.goal = min(max((bytes_ + runs[-1]) * below / x.k - runs[low], 0), bytes_)
        done[n] = (x.dim, x.lo - 1, low)
        if not x.sums:
            del todo[n]
    while todo:
        for n, x in list(todo.items()):
            run = x.before
            for _, w, lo, hi in sorted(x.sums):
                if run + w >= x.goal:
                    break
                run += w
            if w <= exact or lo == hi:
                near = run + w - x.goal <= x.goal - run
                done[n] = (x.dim, hi if near else lo - 1, done[n][2])
                del todo[n]
            else:  # what the bin really spans: empty stretches cost no rounds
                x.lo, x.hi, x.before = lo, hi, run
        if todo:
            found = _sums(rows, place, [(n, x.dim, x.lo, x.hi, bins[n]) for n, x in todo.items()], False)
            for n, x in todo.items():
                x.sums = found[n, x.dim]
    return done


def _tree(rows: DataFrame, heavy: list[tuple[tuple[int, ...], int, int]], shards: int, exact: float):
    """(tree, {number of a heavy group: shard}); a node's number is its first shard, so leaves are numbered from low to high."""
    tree, homes, open_ = 0, {}, {0: Node(shards, [(0, 2**63 - 1)] * len(DIMS), heavy)}
    while open_:
        for n in [n for n, x in open_.items() if x.k == 1]:
            homes |= {h[2]: n for h in open_.pop(n).heavy}
        if not open_:
            break
        cuts = _cut(rows, _place(tree), open_, shards, exact)
        grow = lambda t: (t[0], t[1], grow(t[2]), grow(t[3])) if isinstance(t, tuple) else (*cuts[t][:2], t, t + open_[t].k // 2) if t in cuts else t  # noqa: B023, E731
        tree, new = grow(tree), {}
        for n, x in open_.items():
            d, cut, j = cuts[n]
            sides = [(n, x.k // 2, (x.bounds[d][0], cut), x.heavy[:j]), (n + x.k // 2, x.k - x.k // 2, (cut + 1, x.bounds[d][1]), x.heavy[j:])]
            for m, k, span, groups in sides:
                bounds = [*x.bounds[:d], span if span[0] <= span[1] else (span[0], span[0]), *x.bounds[d + 1 :]]
                new[m] = Node(k, bounds, groups)
        open_ = new
    return tree, homes


def shard(docs: DataFrame, shards: int = 40, doc_id: str = "doc_id", text: str = "text", source: str = "source", lang: str = "lang", exact: float = EXACT) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot), a row for each row of docs: shards of near equal bytes; slots number a shard's rows without gaps.

    exact: the part of a shard's bytes by which a cut may miss the quantile; at 0 every cut is the row that holds it."""
    spark, rows = docs.sparkSession, _rows(docs, doc_id, text, source, lang)
    n, total = rows.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    if not n:
        return rows.select("doc_id", "size", "text_crc32", F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot"))
    keyed = _keys(rows, total / shards)
    keys = [f"k{i}" for i in range(len(DIMS))]
    groups = keyed.where("heavy").groupBy(*GROUP).agg(F.sum("size").alias("bytes"), *[F.min(k).alias(k) for k in keys]).orderBy(*GROUP).collect()
    tree, homes = _tree(keyed.where("not heavy"), [(tuple(r[k] for k in keys), r["bytes"], i) for i, r in enumerate(groups)], shards, exact * total / shards)
    placed = keyed.withColumn("shard", _place(tree).cast("int"))
    if groups:
        own = [{**{c: r[c] for c in GROUP}, "home": homes[i]} for i, r in enumerate(groups)]
        placed = placed.join(F.broadcast(_local(spark, own, "th long, text_crc32 long, size long, home int")), GROUP, "left").withColumn("shard", F.coalesce("home", "shard"))
    placed = placed.select("doc_id", "size", "text_crc32", "shard", F.shiftrightunsigned(F.xxhash64("doc_id", "th"), 1).alias("h"))
    return with_before(placed, ["shard"], "h", ["doc_id", "size", "text_crc32"], {"slot": F.lit(1)}, n).select("doc_id", "size", "text_crc32", "shard", F.col("slot").cast("long"))
