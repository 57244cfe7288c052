"""SimHash near-dedup: fingerprints, linked by a binary trie self-join, and their components.

Fingerprint: lower-case (A-Z) words in shingles of WORDS, repeats included, hashed by XXH64 (seed 42); a bit is set where over half of the hashes have it.

Self-join: two fingerprints that differ in at most BUDGET bits agree in at least one of BUDGET + 1 blocks of bits, or two of BUDGET + 2. So there is a trie for each block, over
the distinct fingerprints rearranged to begin with it, whose first levels allow no error: what hangs below a value of the block is a unit. Where there are so many fingerprints that such units
would be large, there is a trie for each two of BUDGET + 2 blocks. In a
unit pairs of nodes go down together, (node, node) first; a pair adds an error where its branches differ and is dropped when the errors exceed the
budget. A pair whose remaining levels can't exceed the budget is linked as a whole; leaves are compared at once. Units of more than
LARGE fingerprints are split into pairs of deeper nodes first, by the same traversal over counted nodes, so that no task holds a large unit.

A unit gives a spanning forest of its links, not all pairs, which keeps the components and is linear in a dense group; the components of all units' forests follow by
alternating stars. Equal fingerprints are one node; documents take the component of their fingerprint.

Defined cases: a null text or one without words has the fingerprint zero, which is linked like any other; a bit that exactly half of the hashes have is 0; repeated rows share a component; documents without an id get a
component by the others of it; an empty table gives an empty result; texts are read whole; other columns are not read."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, few, values, written

WORDS, SEED, BUDGET = 4, 42, 4
#: Fingerprints of a unit that one task takes, at most, and the levels by which larger ones are split.
LARGE, STEP = 100_000, 4
#: Pairs of nodes that are held at once, and how many comparisons a pair may need to be compared leaf by leaf.
HELD, FEW = 100_000, 16
#: Rows that a task gathers before it traverses their units.
GATHER = 200_000


def arrangements(blocks: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """(width, order) of each trie: the blocks that must agree come first, width bits together; order has (offset, width) of all blocks, offsets from the highest bit."""
    ends = [round(i * 64 / blocks) for i in range(blocks + 1)]
    cut = list(zip(ends, [b - a for a, b in zip(ends, ends[1:])]))
    first = list(combinations(cut, blocks - BUDGET))
    return [(sum(w for _, w in own), [*own, *(b for b in cut if b not in own)]) for own in first]


def blocks_for(n: int) -> int:
    """How many blocks n distinct fingerprints are cut into, so that usual units stay below LARGE."""
    return BUDGET + 1 if n >> (64 // (BUDGET + 1)) <= LARGE else BUDGET + 2


def fingerprint(text: str | None) -> int:
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    whole, n = b" ".join(words), len(words)
    if n < WORDS:
        hashes = [xxhash.xxh64_intdigest(whole, SEED)]
    else:
        sizes = np.fromiter(map(len, words), np.int64, n)
        ends = np.cumsum(sizes + 1) - 1
        digest = xxhash.xxh64_intdigest
        hashes = [digest(whole[a:z], SEED) for a, z in zip((ends - sizes)[: n - WORDS + 1].tolist(), ends[WORDS - 1 :].tolist())]
    bits = np.unpackbits(np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * bits > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fp), fp the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(x) for x in values(batch.column(1))], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps)], names=["doc_id", "fp"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, "doc_id long, fp long")


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each of n elements the smallest one that the links (a, b) reach."""
    root = np.arange(n)
    while len(a):
        low = np.minimum(root[a], root[b])
        np.minimum.at(root, root[a], low)
        np.minimum.at(root, root[b], low)
        while True:
            up = root[root]
            if (up == root).all():
                break
            root = up
        a, b = a[(open_ := root[a] != root[b])], b[open_]
    return root


def _dense(rows: np.ndarray, root: np.ndarray, near: Callable, link: Callable) -> np.ndarray:
    """Links near rows, all pairs of them but those that are connected already: where all are near one of them, that is one comparison each. The new roots."""
    while len(rows) > 1:
        todo, rest = rows[:1], rows[1:]
        while len(todo) and len(rest):
            some = todo[: max(1, HELD // len(rest))]
            todo = todo[len(some) :]
            i, j = np.repeat(some, len(rest)), np.tile(rest, len(some))
            new = root[i] != root[j]
            i, j = i[new], j[new]
            hit = near(i, j)
            root = link(i[hit], j[hit])
            joined = root[rest] == root[some[0]]
            todo, rest = np.concatenate([todo, rest[joined]]), rest[~joined]
        rows = rest
    return root


def traverse(keys: np.ndarray, starts: list[tuple[int, np.ndarray]], budget: int = BUDGET, depth: int = 64, near: Callable[[np.ndarray, np.ndarray], np.ndarray] | None = None) -> np.ndarray:
    """The root of each key under the links that the node pairs lead to.

    keys: unsigned 64-bit, sorted within each node. starts: (level, pairs) with pairs of rows (lo, hi, lo2, hi2, errors): keys[lo:hi] share their
    first `level` bits, so do keys[lo2:hi2], and those differ in `errors` bits; a pair of a node with itself stands for the pairs inside it. depth: only so many bits are a path of the
    trie, and count. near: tells which rows of two lists are linked; by default those within the budget, and then only pairs that are within it on their path are asked."""
    n = len(keys)
    root = np.arange(n)

    def link(a, b):
        nonlocal root
        if len(a):
            a, b = root[a], root[b]
            root = _roots(n, a, b)[root]
        return root

    close = lambda i, j: np.bitwise_count((keys[i] ^ keys[j]) >> np.uint64(64 - depth)) <= budget
    ask = close if near is None else lambda i, j: close(i, j) & near(i, j)

    ones: dict[int, np.ndarray] = {}
    todo = [(level, pairs) for level, pairs in starts if len(pairs)]
    while todo:
        level, pairs = todo.pop()
        if len(pairs) > HELD:
            todo += [(level, pairs[HELD:]), (level, pairs[:HELD])]
            continue
        lo, hi, lo2, hi2, err = pairs.T
        same = lo == lo2
        # no further error can exceed the budget: all are linked
        sure = err + (depth - level) <= budget if near is None else np.zeros(len(err), bool)
        if sure.any():
            for x, y in ((lo, hi), (lo2, hi2)):
                size = (y - x)[sure]
                at = np.repeat(x[sure] - np.cumsum(size) + size, size) + np.arange(size.sum())
                link(np.repeat(lo[sure], size), at)
        small = ~sure & ((hi - lo) * (hi2 - lo2) <= FEW)
        if small.any():
            a, z, b, y = lo[small], hi[small], lo2[small], hi2[small]
            size = (z - a) * (y - b)
            at = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
            width = np.repeat(y - b, size)
            i, j = np.repeat(a, size) + at // width, np.repeat(b, size) + at % width
            hit = (i != j) & (root[i] != root[j])
            i, j = i[hit], j[hit]
            hit = ask(i, j)
            link(i[hit], j[hit])
        go = ~sure & ~small
        if level >= depth:  # the paths end: what hangs there is compared
            for a, z, b, y in zip(lo[go].tolist(), hi[go].tolist(), lo2[go].tolist(), hi2[go].tolist()):
                root = _dense(np.arange(a, z) if a == b else np.concatenate([np.arange(a, z), np.arange(b, y)]), root, ask, link)
            continue
        if not go.any():
            continue
        lo, hi, lo2, hi2, err, same = lo[go], hi[go], lo2[go], hi2[go], err[go], same[go]
        if level not in ones:
            ones[level] = np.concatenate([[0], np.cumsum((keys >> np.uint64(63 - level)) & np.uint64(1), dtype=np.int64)])
        s = ones[level]
        mid, mid2 = hi - (s[hi] - s[lo]), hi2 - (s[hi2] - s[lo2])
        kids = np.concatenate([
            np.stack([lo, mid, lo2, mid2, err], 1), np.stack([mid, hi, mid2, hi2, err], 1), np.stack([lo, mid, mid2, hi2, err + 1], 1),
            np.stack([mid, hi, lo2, mid2, err + 1], 1)[~same],
        ])
        kids = kids[(kids[:, 0] < kids[:, 1]) & (kids[:, 2] < kids[:, 3]) & (kids[:, 4] <= budget)]
        todo.append((level + 1, kids))
    return root


def _links(unit, level, err, side, fp, key):
    """(fp, root fp) of the links in the units, whose rows stand together."""
    order = np.lexsort((key, side, unit))
    unit, level, err, side, fp, key = unit[order], level[order], err[order], side[order], fp[order], key[order]
    cut = np.flatnonzero(np.concatenate([[True], (unit[1:] != unit[:-1]) | (side[1:] != side[:-1])]))
    lo, hi = cut, np.append(cut[1:], len(unit))
    pairs, at = [], []
    first = side[lo] == 0
    alone = first & ~np.append((unit[lo][1:] == unit[lo][:-1]), False) if len(lo) else first
    own = np.flatnonzero(alone & (err[lo] == -1))
    pairs.append(np.stack([lo[own], hi[own], lo[own], hi[own], np.zeros(len(own), np.int64)], 1))
    at.append(level[lo[own]])
    two = np.flatnonzero(np.append(first[:-1] & (unit[lo][1:] == unit[lo][:-1]), False)) if len(lo) else own[:0]
    pairs.append(np.stack([lo[two], hi[two], lo[two + 1] if len(two) else lo[two], hi[two + 1] if len(two) else hi[two], err[lo[two]]], 1))
    at.append(level[lo[two]])
    pairs, at = np.concatenate(pairs).astype(np.int64), np.concatenate(at)
    root = traverse(key, [(int(x), pairs[at == x]) for x in np.unique(at)])
    moved = np.flatnonzero(root != np.arange(len(root)))
    return fp[moved], fp[root[moved]]


def _join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[list[np.ndarray]] = []

    def out(rows):
        a, b = _links(rows[0], rows[1], rows[2], rows[3], rows[4], rows[5].view(np.uint64))
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    for batch in batches:
        held.append([batch.column(i).to_numpy(zero_copy_only=False) for i in range(6)])
        if sum(len(x[0]) for x in held) >= GATHER:
            rows = [np.concatenate([x[i] for x in held]) for i in range(6)]
            last = np.searchsorted(rows[0], rows[0][-1])  # the last unit may go on
            held = [[x[last:] for x in rows]]
            if last:
                yield out([x[:last] for x in rows])
    if held and sum(len(x[0]) for x in held):
        yield out([np.concatenate([x[i] for x in held]) for i in range(6)])


def _prefix(bits: int):
    return F.shiftrightunsigned("key", 64 - bits)


def _split(keys: DataFrame, hot: DataFrame) -> DataFrame:
    """Rows of the units that the hot ones are split into: a pair of deeper nodes is a unit of its own, with a side for each node.

    keys: (r, width, p, key, fp) of hot units; hot: (r, p). Only counted nodes are joined here, by their parents."""
    rows = written(keys.join(hot.select("r", "p"), ["r", "p"]).select("r", "width", "p", "key", "fp"), "op4-hot")
    most = rows.agg(F.max("width")).first()[0]
    pairs = hot.select("r", F.lit(0).alias("down"), F.col("p").alias("a"), F.col("p").alias("b"), F.lit(0).cast("long").alias("err"))
    ready, down = [], 0
    while down + STEP + most <= 64:
        down += STEP
        node = F.expr(f"shiftrightunsigned(key, 64 - width - {down})")
        nodes = rows.groupBy("r", node.alias("c")).agg(F.count("*").alias("n")).withColumn("up", F.shiftrightunsigned("c", STEP))
        x = pairs.join(nodes.select("r", F.col("up").alias("a"), F.col("c").alias("ca"), F.col("n").alias("na")), ["r", "a"]).join(nodes.select("r", F.col("up").alias("b"), F.col("c").alias("cb"), F.col("n").alias("nb")), ["r", "b"])
        x = x.withColumn("err", F.bit_count(F.col("ca").bitwiseXOR(F.col("cb"))).cast("long")).where((F.col("err") <= BUDGET) & ((F.col("a") != F.col("b")) | (F.col("ca") <= F.col("cb"))))
        x = written(x.select("r", F.lit(down).alias("down"), F.col("ca").alias("a"), F.col("cb").alias("b"), "err", (F.col("na") + F.col("nb")).alias("n")), "op4-pairs")
        last = down + STEP + most > 64
        done = x if last else x.where(F.col("n") <= LARGE)
        unit = F.xxhash64("r", F.lit(down), "a", "b")
        part = rows.withColumn("c", node)
        for side, name in ((0, "a"), (1, "b")):
            take = done.where("a <> b") if side else done
            take = take.select("r", F.col(name).alias("c"), unit.alias("unit"), F.when(F.col("a") == F.col("b"), F.lit(-1)).otherwise(F.col("err")).cast("long").alias("err"))
            ready.append(part.join(take, ["r", "c"]).select("unit", (F.col("width") + down).cast("long").alias("level"), "err", F.lit(side).cast("long").alias("side"), "fp", "key"))
        pairs = x.where(F.col("n") > LARGE).drop("n")
        if last or not pairs.limit(1).count():
            break
    out = ready[0]
    for x in ready[1:]:
        out = out.unionByName(x)
    return out


def trie_links(nodes: DataFrame, blocks: int | None = None) -> DataFrame:
    """(a, b): a spanning forest of each unit's links among the distinct fingerprints of nodes (fp)."""

    def key(order: list[tuple[int, int]]):
        out, at = F.lit(0).cast("long"), 0
        for offset, width in order:
            out = out.bitwiseOR(F.shiftleft(F.shiftrightunsigned(F.shiftleft("fp", offset), 64 - width), 64 - width - at))
            at += width
        return out

    tries = arrangements(blocks or blocks_for(nodes.count()))
    turned = nodes.select("fp", F.explode(F.array(*[F.struct(F.lit(i).alias("r"), F.lit(w).alias("width"), key(order).alias("key")) for i, (w, order) in enumerate(tries)])).alias("x")).select("fp", "x.*")
    turned = turned.select("r", "width", F.expr("shiftrightunsigned(key, 64 - width)").alias("p"), "key", "fp")
    hot = written(turned.groupBy("r", "p").count().where(F.col("count") > LARGE).drop("count").repartition(1), "op4-hot-units")
    units = turned
    split = None
    if hot.limit(1).count():
        units = turned.join(hot, ["r", "p"], "left_anti")
        split = _split(turned, hot)
    units = units.select((F.col("r").cast("long") * F.lit(2**32) + F.col("p")).alias("unit"), F.col("width").cast("long").alias("level"), F.lit(-1).cast("long").alias("err"), F.lit(0).cast("long").alias("side"), "fp", "key")
    if split is not None:
        units = units.unionByName(split)
    return units.repartition("unit").sortWithinPartitions("unit").mapInArrow(_join, "a long, b long")


def smallest(named: DataFrame, node: str) -> DataFrame:
    """named (node, root, first) with component_id, the smallest first of the root's nodes. Most roots are their only node: only the others are summed up, and meet the nodes again."""
    low = named.where(F.col("root") != F.col(node)).groupBy("root").agg(F.min("first").alias("low"))
    low = low.join(named.select(F.col(node).alias("root"), F.col("first").alias("own")), "root").select("root", F.least("low", "own").alias("component_id"))
    return named.join(few(written(low, "roots")), "root", "left").withColumn("component_id", F.coalesce("component_id", "first"))


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fingerprint, component_id), a row for each row of docs: component_id is the smallest doc_id that links of fingerprints reach."""
    fps = written(fingerprints(docs, doc_id, text), "op4-fingerprints")
    nodes = written(fps.groupBy("fp").agg(F.min("doc_id").alias("first")), "op4-nodes")
    roots = components(trie_links(nodes.select("fp")), "op4-links")
    named = written(nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp")), "op4-named")
    found = smallest(named, "fp").select("fp", "component_id")
    return fps.join(found, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_first(docs: DataFrame, components_: DataFrame, doc_id: str = "doc_id", name: str = "op4-found") -> DataFrame:
    """The rows of docs, all columns, that stay: of each component (doc_id, component_id) the document with the smallest doc_id, once. Rows without a doc_id stay.

    The texts stay where they are if the ids to drop are few enough to be broadcast; else rows and ids meet by a shuffle."""
    found = written(components_.groupBy("doc_id").agg(F.min("component_id").alias("component_id"), F.count("*").alias("n")), name)
    drop = few(found.where("doc_id <> component_id").select(F.col("doc_id").alias(doc_id)))
    kept = docs.join(drop, doc_id, "left_anti")
    again = found.where("n > 1 and doc_id = component_id").select(F.col("doc_id").alias(doc_id))
    if again.limit(1).count():
        again = few(again)
        kept = kept.join(again, doc_id, "left_anti").unionByName(kept.join(again, doc_id, "left_semi").dropDuplicates([doc_id]))
    return kept.select(*docs.columns)


def deduplicated(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs that stay by op4's fingerprints, see keep_first."""
    return keep_first(docs, near_duplicates(docs, doc_id, text), doc_id)
