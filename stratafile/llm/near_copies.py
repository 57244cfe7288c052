"""Near copies by SimHash: documents whose sets of shingles of WORDS words agree to SIMILAR (Jaccard) or more, and their components.

Two sets that agree to SIMILAR differ in each bit of a SimHash with a chance of at most FAR = acos(2 s / (1 + s)) / pi, 0.15 at 0.8: too many of 64 bits for one trie with a fixed budget. So a set gets
a wide fingerprint, cut into tables of (prefix + PATH) bits of their own. In a table fingerprints with equal prefixes are a unit, and the binary trie of a unit's PATH bits
is joined with itself: node pairs go down together, add an error where their branches differ, and are dropped beyond ERRORS (simhash.traverse). Pairs that are left are candidates if they differ in at most CHECK_ERRORS
of CHECK further bits. There are as many tables as it takes for a pair at SIMILAR to be missed with a chance of MISSED; prefixes grow with the number of documents, so that units don't.

The bits of small sets are coarse: with few shingles two similar sets differ in more of them than the chance above says. So sets of SMALL shingles or fewer are compared exactly as well: in an order of shingles
from the rarest on, two sets that agree to SIMILAR share one of their first n - ceil(SIMILAR n) + 1, so sets that share one of these are a unit, whose pairs whole sets decide. Every pair whose smaller set has at most SIMILAR SMALL shingles is found
so, whatever the number of documents.

Candidates form components; their pairs are then decided by the whole sets of shingles, as 64-bit hashes, so no pair below SIMILAR is linked.
Documents with the same set are one node. A unit of more than LARGE nodes, or a component of more than HELD shingles, is split into blocks, each pair of which is a
unit of its own, so that no task holds a large one. Pairs that are connected already are not compared, which keeps the components and is linear in a dense group; the components of all units follow by alternating stars.

Defined cases: words are lower-cased (A-Z) and parted by ASCII white space; fewer than WORDS of them are one shingle; null texts and those without words are
copies of each other; repeated rows share a component; documents without an id link others and get their component; bits that are set in half of a set's shingles are 0; an empty table gives an empty result; texts are read
whole; other columns are not read."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, few, values, written
from .simhash import GATHER, keep_first, smallest, traverse

WORDS, SIMILAR, SEED = 5, 0.8, 42
#: Bits of a table's trie and errors on the way down; bits beside the tables, and errors in them.
PATH, ERRORS = 16, 2
CHECK, CHECK_ERRORS = 112, 31
#: The chance that a pair at SIMILAR is not found.
MISSED = 0.001
#: Nodes of a unit, on average and at most; shingles that a task compares at once; shingles whose bits are counted at once.
USUAL, LARGE = 32_768, 100_000
HELD, CHUNK = 1_000_000, 255
#: Sets of at most so many shingles are compared by their rarest shingles.
SMALL = 50


@dataclass(frozen=True)
class Layout:
    """prefix bits, tables and the constants that spread a shingle's hash over the words of a fingerprint."""

    prefix: int
    tables: int

    @property
    def bits(self) -> int:
        return self.tables * (self.prefix + PATH) + CHECK

    def mixers(self) -> tuple[np.ndarray, np.ndarray]:
        rnd = np.random.RandomState(SEED)
        x = rnd.randint(0, 2**63, (2, -(-self.bits // 64)), np.uint64)
        return x[0], x[1] | np.uint64(1)


def found_with(prefix: int, similar: float = SIMILAR) -> float:
    """The chance that one table finds a pair."""
    far = math.acos(2 * similar / (1 + similar)) / math.pi
    return (1 - far) ** prefix * sum(math.comb(PATH, e) * far**e * (1 - far) ** (PATH - e) for e in range(ERRORS + 1))


def layout(documents: int, missed: float = MISSED) -> Layout:
    prefix = max(2, math.ceil(math.log2(max(1, documents) / USUAL)))
    return Layout(prefix, math.ceil(math.log(missed) / math.log(1 - found_with(prefix))))


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """The distinct shingles' hashes, sorted."""
    found = (text or "").encode("utf-8", "surrogatepass").lower().split()
    n, whole, digest = len(found), b" ".join(found), xxhash.xxh64_intdigest
    if n < words:
        return np.array([digest(whole, SEED)] if n else [], np.uint64)
    sizes = np.fromiter(map(len, found), np.int64, n)
    ends = np.cumsum(sizes + 1) - 1
    return np.unique(np.array([digest(whole[a:z], SEED) for a, z in zip((ends - sizes)[: n - words + 1].tolist(), ends[words - 1 :].tolist())], np.uint64))


def fingerprint(grams: np.ndarray, of: Layout) -> np.ndarray:
    """The bits of a set's fingerprint: 1 where over half of the shingles' hashes have it."""
    flip, turn = of.mixers()
    counts = np.zeros(64 * len(flip), np.int64)
    for i in range(0, len(grams), CHUNK):
        x = (grams[i : i + CHUNK, None] ^ flip) * turn
        x ^= x >> np.uint64(32)
        x *= turn
        x ^= x >> np.uint64(29)
        counts += np.unpackbits(x.view(np.uint8), axis=1).sum(0, dtype=np.uint8)
    return (2 * counts[: of.bits] > len(grams)).astype(np.uint8)


def tables(bits: np.ndarray, of: Layout) -> tuple[np.ndarray, np.ndarray, int]:
    """(units, keys, check): for each table its unit, and a key of the trie's path and 48 bits of the check; the other bits of the check."""
    width = of.prefix + PATH
    cut = bits[: of.tables * width].reshape(of.tables, width).astype(np.int64)
    units = cut[:, : of.prefix] @ (1 << np.arange(of.prefix)[::-1]) + (np.arange(of.tables) << of.prefix)
    check = np.packbits(bits[of.tables * width :]).tobytes()
    low = int.from_bytes(check[:6], "big")
    keys = ((cut[:, of.prefix :] @ (1 << np.arange(PATH)[::-1])).astype(np.uint64) << np.uint64(48)) | np.uint64(low)
    return units, keys.view(np.int64), int.from_bytes(check[6:], "big", signed=True)


def _node(grams: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(grams.tobytes(), SEED)


def _signed(numbers: list[int]) -> np.ndarray:
    return np.array(numbers, np.uint64).view(np.int64)


def signatures(docs: DataFrame, of: Layout, words: int = WORDS) -> DataFrame:
    """docs (doc_id, text) -> (doc_id, node, n, units, keys, check, few): node stands for the set of shingles, n is its size; an empty set has no units; few: the shingles of a small set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, sizes, units, keys, checks, small = [], [], [], [], [], []
            for x in values(batch.column(1)):
                grams = shingles(x, words)
                nodes.append(_node(grams))
                sizes.append(len(grams))
                if len(grams):
                    u, k, c = tables(fingerprint(grams, of), of)
                    units.append(u)
                    keys.append(k)
                checks.append(c if len(grams) else 0)
                small.append(grams.view(np.int64) if len(grams) <= SMALL else grams[:0].view(np.int64))
            ends = pa.array(np.cumsum([0, *(of.tables if n else 0 for n in sizes)]).astype(np.int32))
            lists = [pa.ListArray.from_arrays(ends, pa.array(np.concatenate([np.zeros(0, np.int64), *x]))) for x in (units, keys)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(_signed(nodes)), pa.array(sizes, pa.int64()), *lists, pa.array(checks, pa.int64()), pa.array(small, pa.list_(pa.int64()))], names=["doc_id", "node", "n", "units", "keys", "check", "few"])

    return docs.mapInArrow(run, "doc_id long, node long, n long, units array<long>, keys array<long>, check long, few array<long>")


def small_units(nodes: DataFrame, similar: float = SIMILAR) -> DataFrame:
    """(unit, node, grams, n) of small sets: a unit for each shingle that is among the rarest of two of them; nodes: (node, n, few)."""
    every = nodes.where((F.col("n") > 0) & (F.col("n") <= SMALL)).select("node", "n", "few")
    one = every.select("node", F.explode("few").alias("g"))
    ranked = one.join(one.groupBy("g").agg(F.count("*").alias("k")), "g").groupBy("node").agg(F.sort_array(F.collect_list(F.struct("k", "g"))).alias("order"))  # SMALL shingles at most
    # a hundredth of a shingle against rounding
    length = (F.col("n") - F.ceil(F.lit(similar) * F.col("n") - 0.01) + 1).cast("int")
    firsts = written(every.join(ranked, "node").select("node", "n", F.explode(F.slice("order", F.lit(1), length)).alias("x")).select("node", "n", F.col("x.g").alias("unit")), "near-rarest")
    shared = firsts.groupBy("unit").agg(F.sum("n").alias("size"), F.count("*").alias("k")).where("k > 1").select("unit", "size")
    shared = written(shared, "near-shared")
    units = _in_blocks(firsts.join(shared.select("unit"), "unit", "left_semi").select("node", "n", "unit"), "unit", shared, HELD)
    return units.join(every.select("node", "few"), "node").select("unit", "node", F.col("few").alias("grams"))


def sets(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """docs (doc_id, text) -> (node, grams), the hashes as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                found = [shingles(x, words) for x in values(batch.column(1).slice(i, 256))]
                yield pa.RecordBatch.from_arrays([pa.array(_signed([_node(x) for x in found])), pa.array([x.tobytes() for x in found], pa.binary())], names=["node", "grams"])

    return docs.mapInArrow(run, "node long, grams binary")


def linked(found: list[np.ndarray], similar: float = SIMILAR) -> np.ndarray:
    """For each of some sets the first one that links of similar sets reach."""
    n = len(found)
    root, sizes = np.arange(n), np.array([len(x) for x in found], np.int64)
    if n == 2:
        if min(sizes) >= similar * max(sizes):
            both = len(np.intersect1d(*found, assume_unique=True))
            root[1] = 0 if both >= similar * (sizes.sum() - both) else 1
        return root
    words, ids = np.unique(np.concatenate(found), return_inverse=True)
    parts, mark = np.split(ids, np.cumsum(sizes)[:-1]), np.zeros(len(words), bool)
    for i in range(n - 1):
        # no smaller set can be similar to one that is so much larger
        rest = i + 1 + np.flatnonzero((root[i + 1 :] != root[i]) & (np.minimum(sizes[i + 1 :], sizes[i]) >= similar * np.maximum(sizes[i + 1 :], sizes[i])))
        if not len(rest):
            continue
        mark[parts[i]] = True
        starts = np.cumsum(sizes[rest]) - sizes[rest]
        both = np.add.reduceat(mark[np.concatenate([parts[j] for j in rest])], starts, dtype=np.int64)
        mark[parts[i]] = False
        near = rest[both >= similar * (sizes[rest] + sizes[i] - both)]
        if len(near):
            old = np.unique(np.append(root[near], root[i]))
            root[np.isin(root, old)] = old[0]
    return root


def _checker(similar: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit, rows = None, {}

        def out():
            nodes = list(rows)
            root = linked([np.frombuffer(x, np.uint64) if isinstance(x, bytes) else np.array(x, np.int64).view(np.uint64) for x in rows.values()], similar)
            return [(nodes[i], nodes[r]) for i, r in enumerate(root) if i != r]

        for batch in batches:
            links = []
            for i in range(0, batch.num_rows, 256):
                for u, node, grams in zip(*(batch.column(c).slice(i, 256).to_pylist() for c in range(3))):
                    if u != unit and rows:
                        links += out()
                        rows.clear()
                    unit = u
                    rows[node] = grams
            yield pa.RecordBatch.from_arrays([pa.array([x[c] for x in links], pa.int64()) for c in (0, 1)], names=["a", "b"])
        if rows:
            links = out()
            yield pa.RecordBatch.from_arrays([pa.array([x[c] for x in links], pa.int64()) for c in (0, 1)], names=["a", "b"])

    return run


def _near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(unit, key, check, node), a unit's rows together -> (a, b): a spanning forest of each unit's candidates."""
    held: list[list[np.ndarray]] = []

    def out(rows):
        order = np.lexsort((rows[1].view(np.uint64), rows[0]))
        unit, key, check, node = (x[order] for x in rows)
        key, check = key.view(np.uint64), check.view(np.uint64)
        cut = np.flatnonzero(np.concatenate([[True], unit[1:] != unit[:-1]]))
        end = np.append(cut[1:], len(unit))
        low = np.uint64(2**48 - 1)
        near = lambda i, j: np.bitwise_count((key[i] ^ key[j]) & low).astype(np.int64) + np.bitwise_count(check[i] ^ check[j]) <= CHECK_ERRORS
        root = traverse(key, [(0, np.stack([cut, end, cut, end, np.zeros(len(cut), np.int64)], 1).astype(np.int64))], ERRORS, PATH, near)
        moved = np.flatnonzero(root != np.arange(len(root)))
        return pa.RecordBatch.from_arrays([pa.array(node[moved]), pa.array(node[root[moved]])], names=["a", "b"])

    for batch in batches:
        held.append([batch.column(i).to_numpy(zero_copy_only=False) for i in range(4)])
        if sum(len(x[0]) for x in held) >= GATHER:
            rows = [np.concatenate([x[i] for x in held]) for i in range(4)]
            last = int(np.flatnonzero(rows[0] == rows[0][-1])[0])  # the last unit may go on
            held = [[x[last:] for x in rows]]
            if last:
                yield out([x[:last] for x in rows])
    if held and sum(len(x[0]) for x in held):
        yield out([np.concatenate([x[i] for x in held]) for i in range(4)])


def _in_blocks(rows: DataFrame, unit: str, sizes: DataFrame, most: int) -> DataFrame:
    """rows (node, ..., unit), with units above `most` split into blocks by node: each pair of blocks is a unit. sizes: (unit, size)."""
    hot = written(sizes.where(F.col("size") > most).select(unit, F.ceil(F.col("size") / F.lit(most / 2)).cast("int").alias("blocks")), "near-hot")
    if not hot.limit(1).count():
        return rows
    x = rows.join(few(hot), unit, "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    x = x.withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
    x = x.where("blocks = 1 or own <> other")
    return x.withColumn(unit, F.when(F.col("blocks") == 1, F.col(unit)).otherwise(F.xxhash64(unit, F.least("own", "other"), F.greatest("own", "other")))).select(*rows.columns)


def candidates(nodes: DataFrame) -> DataFrame:
    """(a, b): links of candidates among nodes (node, units, keys, check)."""
    rows = nodes.select("node", "check", F.explode(F.arrays_zip("units", "keys")).alias("x")).select(F.col("x.units").alias("unit"), F.col("x.keys").alias("key"), "check", "node")
    rows = _in_blocks(rows, "unit", rows.groupBy("unit").agg(F.count("*").alias("size")), LARGE)
    return rows.repartition("unit").sortWithinPartitions("unit").mapInArrow(_near, "a long, b long")


def near_copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = WORDS, similar: float = SIMILAR) -> DataFrame:
    """(doc_id, component_id), a row for each row of docs: component_id is the smallest doc_id that links of similar documents reach.

    The tables are made for similarities of SIMILAR and more; below it candidates would be missed."""
    if similar < SIMILAR:
        raise ValueError(f"similar must be {SIMILAR} at least")
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    signed = written(signatures(docs, layout(docs.count()), words), "near-signatures")
    nodes = signed.groupBy("node").agg(F.min("doc_id").alias("first"), *[F.first(c).alias(c) for c in ("n", "units", "keys", "check", "few")])
    nodes = written(nodes, "near-nodes")
    found = components(candidates(nodes), "near-candidates")
    units = written(found.join(nodes.select("node", "n"), "node").select("node", "n", F.col("root").alias("unit")), "near-units")
    units = _in_blocks(units, "unit", units.groupBy("unit").agg(F.sum("n").alias("size")), HELD).select("node", "unit")
    # the texts of one document for each node are read again
    firsts = written(nodes.join(found.select("node"), "node", "left_semi").select(F.col("first").alias("doc_id")).distinct(), "near-firsts")
    again = docs.join(few(firsts.where("doc_id is not null")), "doc_id", "left_semi")
    if firsts.where("doc_id is null").limit(1).count():
        again = again.unionByName(docs.where("doc_id is null"))
    pairs = sets(again, words).join(units, "node").select("unit", "node", "grams")
    links = pairs.repartition("unit").sortWithinPartitions("unit").mapInArrow(_checker(similar), "a long, b long")
    small = small_units(nodes, similar).repartition("unit").sortWithinPartitions("unit").mapInArrow(_checker(similar), "a long, b long")
    roots = components(links.unionByName(small), "near-links")
    named = written(nodes.select("node", "first").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")), "near-named")
    found = smallest(named, "node").select("node", "component_id")
    return signed.select("doc_id", "node").join(found, "node").select("doc_id", "component_id")


def deduplicated(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = WORDS, similar: float = SIMILAR) -> DataFrame:
    """The rows of docs, all columns, that stay: of each component the document with the smallest doc_id, once. Rows without a doc_id stay."""
    return keep_first(docs, near_copies(docs, doc_id, text, words, similar), doc_id, "near-found")
