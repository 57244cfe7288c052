"""Benchmark decontamination by greedy string tiling.

Words are runs of letters, digits and underscores, lower-cased; each character of a script that is written without spaces is a word. A document joins a benchmark item on shared seeds, SEED
words in a row, or the whole item if it is shorter. The parts of the document that
seeds cover are tiled with the item by running Karp-Rabin: the longest matches of unmarked words are marked, in both texts, until
none of a seed's length is left; the search length starts long and is halved, and windows are found by rolling hashes and checked word by word. The part of the
item's words that tiles cover is the coverage; THRESHOLD or more is contamination, in whatever order the tiles stand in the document. An item of fewer than SEED words so counts only where it stands whole;
such a word or phrase is in many documents by chance, so `contaminated` reports it, but `clean` drops a document only for items of `least_words` words or more (LEAST_WORDS by default).

All of that is done where the document is read. The distinct texts of the benchmark go to the executors in blocks of at most BLOCK_BYTES (a longer item is a block of its own), whatever its size: a larger benchmark
takes more passes over the documents, not more memory; a worker builds the index of a block once. What a document shares with a block is counted by distinct seeds, never more than the block has, and a pair is only tiled if
its seeds cover THRESHOLD of the item, which bounds its coverage.

Defined cases: null and empty texts are clean; null items and those without a word match nothing; repeated items and rows are reported each; of equally long matches the first of the item, then of the
document, is marked first; rows without a doc_id are judged like others; an empty benchmark or table gives an empty result; texts of any length are read whole; other columns are not read."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import few, values, written

#: Scripts written without spaces between words: kana, ideographs, Thai, Lao, Burmese, Khmer.
UNSPACED = "\u3040-\u30ff\u31f0-\u31ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003ffff\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff"
WORD = re.compile(rf"[^\W{UNSPACED}]+|[{UNSPACED}]")
SEED = 5
#: An item of fewer words drops no document.
LEAST_WORDS = 5
THRESHOLD = 0.5
BLOCK_BYTES = 16_000_000
#: The first search length; doubled lengths restart the search.
LONG = 20
BASE, PRIME = 1_000_003, (1 << 61) - 1
FACTOR = np.uint64(0x9E3779B97F4A7C15)


def tokens(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


def _windows(x: list[int], marked: list[bool], n: int):
    """(start, hash) of the windows of n unmarked words; word numbers are positive, 0 breaks a window."""
    top, h, run = pow(BASE, n - 1, PRIME), 0, 0
    for i, w in enumerate(x):
        if marked[i] or not w:
            run = h = 0
            continue
        if run >= n:
            h = (h - x[i - n] * top) % PRIME
        h = (h * BASE + w) % PRIME
        run += 1
        if run >= n:
            yield i - n + 1, h


def tile(item: list[int], doc: list[int], least: int = SEED) -> list[tuple[int, int, int]]:
    """(start in item, start in doc, length) of the tiles, marked from long to short."""
    used_i, used_d, tiles = [False] * len(item), [False] * len(doc), []

    def scan(n):
        """The matches of n words or more; a single one and its length if that is over 2n."""
        at: dict[int, list[int]] = {}
        for p, h in _windows(doc, used_d, n):
            at.setdefault(h, []).append(p)
        found = []
        for q, h in _windows(item, used_i, n):
            for p in at.get(h, ()):
                if q and p and not used_i[q - 1] and not used_d[p - 1] and item[q - 1] == doc[p - 1]:
                    continue  # part of a longer one
                k = 0
                while q + k < len(item) and p + k < len(doc) and item[q + k] == doc[p + k] and not used_i[q + k] and not used_d[p + k]:
                    k += 1
                if k > 2 * n:
                    return [], k
                if k >= n:
                    found.append((k, q, p))
        return found, 0

    n = max(LONG, least)
    while True:
        found, longer = scan(n)
        if longer:
            n = longer
            continue
        made = False
        for k, q, p in sorted(found, key=lambda m: (-m[0], m[1], m[2])):
            if any(used_i[q : q + k]) or any(used_d[p : p + k]):
                break  # what is left of it may still be longer than the next: search again
            used_i[q : q + k] = used_d[p : p + k] = [True] * k
            tiles.append((q, p, k))
            made = True
        if made:
            continue
        if n == least:
            return tiles
        n = max(least, n // 2)


class Seeds:
    """An index of the seeds of n words of some items."""

    def __init__(self, n: int, items: list[tuple[int, list[int]]]):
        """items: (number, words)."""
        self.n = n
        keys = [self.keys(np.array(x, np.uint64)) for _, x in items]
        where = [np.stack([np.full(len(k), i), np.arange(len(k))], 1) for k, (i, _) in zip(keys, items)]
        self.seeds, self.where = np.concatenate(keys), np.concatenate(where)
        order = np.argsort(self.seeds, kind="stable")
        self.seeds, self.where = self.seeds[order], self.where[order]

    def keys(self, x: np.ndarray) -> np.ndarray:
        """A number for each n words in a row."""
        if len(x) < self.n:
            return np.zeros(0, np.uint64)
        with np.errstate(over="ignore"):
            h = np.zeros(len(x) - self.n + 1, np.uint64)
            for i in range(self.n):
                h = (h ^ (h >> np.uint64(29))) * FACTOR + x[i : len(x) - self.n + 1 + i]
        return h

    def shared(self, x: np.ndarray) -> Iterator[tuple[int, np.ndarray, Callable[[], np.ndarray]]]:
        """(item, its seeds' places that the document has, a function for the document's places of them) for each item that shares seeds; x: word numbers, 0 unknown."""
        bad = np.concatenate([[0], np.cumsum(x == 0)])
        at = np.flatnonzero(bad[self.n :] == bad[: -self.n]) if len(x) >= self.n else np.zeros(0, np.int64)  # all words known
        if not len(at):
            return
        own, back = np.unique(self.keys(x)[at], return_inverse=True)
        lo, hi = np.searchsorted(self.seeds, own, "left"), np.searchsorted(self.seeds, own, "right")
        size = hi - lo
        rows = np.repeat(lo - np.cumsum(size) + size, size) + np.arange(size.sum())
        if not len(rows):
            return
        which, (who, start) = np.repeat(np.arange(len(own)), size), self.where[rows].T
        order = np.lexsort((start, who))
        which, who, start = which[order], who[order], start[order]
        cuts = np.flatnonzero(np.concatenate([[True], who[1:] != who[:-1], [True]]))
        for a, z in zip(cuts[:-1].tolist(), cuts[1:].tolist()):

            def places(a=a, z=z):
                mine = np.zeros(len(own), bool)
                mine[which[a:z]] = True
                return at[mine[back]]

            yield int(who[a]), start[a:z], places


class Block:
    """Benchmark items, indexed by seeds: those of SEED words or more together, shorter ones by their length."""

    def __init__(self, items: list[tuple[int, str]], threshold: float = THRESHOLD):
        self.words: dict[str, int] = {}
        self.items, self.threshold, by = [], threshold, {}
        for name, text in items:
            x = [self.words.setdefault(w, len(self.words) + 1) for w in tokens(text)]
            if x:
                by.setdefault(min(len(x), SEED), []).append((len(self.items), x))
                self.items.append((name, x))
        self.seeds = [Seeds(n, own) for n, own in sorted(by.items())]

    def matches(self, text: str | None) -> list[tuple[int, float, int, int, list[tuple[int, int, int]]]]:
        """(item, coverage, words covered, words of the item, tiles as (start in item, start in document, length))."""
        if not self.seeds or not text:
            return []
        get = self.words.get
        x = np.array([get(w, 0) for w in tokens(text)], np.uint64)
        out = []
        for seeds in self.seeds:
            for i, starts, places in seeds.shared(x):
                name, item = self.items[i]
                cover = np.zeros(len(item) + 1, np.int64)
                np.add.at(cover, starts, 1)
                cover = np.convolve(cover, np.ones(seeds.n, np.int64))[: len(item)]
                if (cover > 0).sum() < self.threshold * len(item):
                    continue
                # the document's words that seeds of this item cover, a break between stretches
                inside = np.zeros(len(x) + 1, np.int64)
                np.add.at(inside, places(), 1)
                inside = np.flatnonzero(np.convolve(inside, np.ones(seeds.n, np.int64))[: len(x)])
                gaps = np.flatnonzero(np.diff(inside) > 1) + 1
                own = np.insert(x[inside].astype(np.int64), gaps, 0).tolist()
                back = np.insert(inside, gaps, -1).tolist()
                tiles = [(q, back[p], k) for q, p, k in tile(item, own, seeds.n)]
                n = sum(k for _, _, k in tiles)
                if n >= self.threshold * len(item):
                    out.append((name, n / len(item), n, len(item), tiles))
        return out


def _blocks(texts: DataFrame) -> Iterator[list[tuple[int, str]]]:
    """(key, text), distinct, in blocks of about BLOCK_BYTES."""
    size = texts.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    n = -(-size // BLOCK_BYTES)
    for b in range(n):
        rows = texts.where(F.pmod(F.xxhash64("text"), F.lit(n)) == b) if n > 1 else texts
        if items := sorted((r["key"], r["text"]) for r in rows.collect()):
            yield items


def _texts(benchmark: DataFrame, text: str) -> DataFrame:
    """The distinct texts of the benchmark, each with a number."""
    distinct = benchmark.select(F.col(text).alias("text")).where(F.col("text").isNotNull()).distinct()
    return written(distinct.select(F.monotonically_increasing_id().alias("key"), "text"), "op7-texts")


#: The block that this worker indexed last.
_built: dict[str, Block] = {}


def _index(name: str, items: list[tuple[int, str]], threshold: float) -> Block:
    if name not in _built:
        _built.clear()
        _built[name] = Block(items, threshold)
    return _built[name]


SCHEMA = "doc_id long, item_id long, coverage double, matched_words long, item_words long, tiles array<struct<item_start: long, doc_start: long, length: long>>"
_TILES = pa.list_(pa.struct([("item_start", pa.int64()), ("doc_start", pa.int64()), ("length", pa.int64())]))


def contaminated(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, item_id, coverage, matched_words, item_words, tiles): a row for each document and item of which it holds at least threshold."""
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    texts, found = _texts(benchmark, item_text), None
    for items in _blocks(texts):
        part = rows.mapInArrow(_matcher(items, threshold), SCHEMA)
        found = part if found is None else found.unionByName(part)
    if found is None:
        return docs.sparkSession.createDataFrame([], SCHEMA)
    ids = benchmark.select(F.col(item_id).cast("long").alias("_item"), F.col(item_text).alias("text")).join(texts, "text").select("_item", F.col("key").alias("item_id"))
    return found.join(few(written(ids, "op7-items")), "item_id").select("doc_id", F.col("_item").alias("item_id"), *found.columns[2:])


def _matcher(items, threshold):
    name = uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = _index(name, items, threshold)
        for batch in batches:
            out = [(d, *m) for d, t in zip(values(batch.column(0)), values(batch.column(1))) for m in block.matches(t)]
            tiles = [[{"item_start": q, "doc_start": p, "length": k} for q, p, k in r[5]] for r in out]
            kinds = (pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([*[pa.array([r[i] for r in out], t) for i, t in enumerate(kinds)], pa.array(tiles, _TILES)], names=["doc_id", "item_id", "coverage", "matched_words", "item_words", "tiles"])

    return run


def clean(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_text: str = "text", threshold: float = THRESHOLD, least_words: int = LEAST_WORDS) -> DataFrame:
    """The rows of docs, all columns, that hold no benchmark item of least_words words or more. Each block of the benchmark filters what the one before has left."""
    for items in _blocks(_texts(benchmark, item_text)):
        name = uuid.uuid4().hex

        def run(batches: Iterator[pa.RecordBatch], items=items, name=name) -> Iterator[pa.RecordBatch]:
            block = _index(name, items, threshold)
            for batch in batches:
                at = batch.schema.get_field_index(text)
                yield batch.filter(pa.array([all(m[3] < least_words for m in block.matches(t)) for t in values(batch.column(at))], pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
