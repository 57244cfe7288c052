"""Quality by votes of the nearest labelled documents in a latent-semantic space.

A text's terms are its byte trigrams, present or not, and the shapes of its words, counted: how a word begins and ends (letter, capital, digit, which mark), its length in four steps, whether it holds
more than one capital, and whether it repeats the word before it; and three such repeats in a row. Both are hashed, to TRIGRAMS and SHAPES numbers, weighted by inverse document frequency over the whole table, and scaled
to length 1 by themselves, so that neither drowns the other. The latent space is that of the RANK greatest singular vectors of the labelled sample's terms; there a labelled document
is a vector of length 1.

The sample is bounded: TRAIN labelled documents, those with the smallest hash of doc_id. Its terms are counted on the executors; the driver decomposes a matrix of at most TRAIN rows. What is
broadcast is the term weights, the projection and the labelled vectors, (TRIGRAMS + SHAPES + TRAIN) times RANK numbers at most, 4 MB, whatever the corpus. Every document is compared with
every labelled vector, exact cosines in blocks of BLOCK documents; the NEIGHBOURS nearest (equal cosines, to 9 digits: the first of the sample) vote with the power POWER of their cosine, and the score is the share of the votes for label 1.
Texts are read in two passes, one for the document frequencies and one for the scores, and never shuffled but for the sample.

Defined cases: null texts count as empty; a text that shares no term with the sample gets the sample's share of label 1; nothing to learn from: 0.5 for all; labels other than 0 and 1, and labels
without a doc_id, are left out; of several labels of a document the least counts; of rows that repeat a doc_id the least text is learned from; rows without a doc_id are scored, not learned from, and not held out; repeated rows are scored alike;
an empty table gives an empty result; texts of any length are read whole, CHUNK bytes at a time (a word of more bytes counts as several); other columns are not read."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import values, written

TRIGRAMS, SHAPES = 4096, 1024
TERMS = TRIGRAMS + SHAPES
#: Labelled documents to learn from, at most, and the dimensions of the latent space.
TRAIN, RANK = 3000, 64
NEIGHBOURS, POWER, KEEP = 15, 8, 0.3
BLOCK, CHUNK = 256, 1 << 20
SPACE, LETTER, CAPITAL, DIGIT, MARK = range(5)

#: The class of each byte; what lies beyond ASCII counts as a letter.
CLASSES = np.array([SPACE if c in b" \t\n\x0b\x0c\r" else CAPITAL if 65 <= c <= 90 else DIGIT if 48 <= c <= 57 else LETTER if 97 <= c <= 122 or c >= 128 else MARK for c in range(256)], np.int64)
_ODD = np.uint64(0x9E3779B97F4A7C15)
_BYTES = (np.arange(1, 257, dtype=np.uint64) * _ODD) ^ (np.arange(1, 257, dtype=np.uint64) << np.uint64(23))
_UP, _DOWN = np.uint64(1_000_003), np.uint64(pow(1_000_003, -1, 1 << 64))
_powers: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of a factor and of its inverse, modulo 2^64."""
    if not _powers or len(_powers[0]) < n:
        size = max(n, 1 << 16)
        _powers[:] = [np.cumprod(np.concatenate([[np.uint64(1)], np.full(size - 1, f, np.uint64)]), dtype=np.uint64) for f in (_UP, _DOWN)]
    return _powers[0][:n], _powers[1][:n]


def trigrams(x: np.ndarray) -> np.ndarray:
    """The number of each three bytes in a row."""
    x = x.astype(np.uint32)
    h = (x[:-2] << np.uint32(16)) | (x[1:-1] << np.uint32(8)) | x[2:]
    h *= np.uint32(0x9E3779B1)
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x85EBCA77)
    return h >> np.uint32(32 - 12)


def shape_number(term: np.ndarray) -> np.ndarray:
    u = term.astype(np.uint64) * _ODD
    u ^= u >> np.uint64(29)
    return ((u * _ODD) >> np.uint64(64 - 10)).astype(np.int64)


def shapes(x: np.ndarray, before: tuple[np.uint64, int, int]) -> tuple[np.ndarray, tuple[np.uint64, int, int]]:
    """The numbers of the words' shapes and of the repeats in a row. before, and the second result: the last word's hash, and whether it and the one before it repeat."""
    kind = CLASSES[x]
    word = np.concatenate([[False], kind != SPACE, [False]])
    edge = np.flatnonzero(word[1:] != word[:-1])
    start, end = edge[::2], edge[1::2]
    if not len(start):
        return np.zeros(0, np.int64), before
    up, down = powers(len(x))
    total = np.concatenate([[np.uint64(0)], np.cumsum(_BYTES[x] * up, dtype=np.uint64)])
    hashes = (total[end] - total[start]) * down[start] ^ (end - start).astype(np.uint64)
    same = (hashes == np.concatenate([[before[0]], hashes[:-1]])).astype(np.int64)
    capitals = np.concatenate([[0], np.cumsum(kind == CAPITAL)])
    last = np.where(kind[end - 1] == MARK, x[end - 1].astype(np.int64) + 5, kind[end - 1])
    steps = np.searchsorted([2, 4, 8], end - start, "right")
    term = (((kind[start] * 300 + last) * 2 + (capitals[end] - capitals[start] > 1)) * 2 + same) * 4 + steps
    flags = np.concatenate([[before[2], before[1]], same])
    rows = 1_000_000 + flags[2:] * 4 + flags[1:-1] * 2 + flags[:-2]
    return shape_number(np.concatenate([term, rows])), (hashes[-1], int(same[-1]), int(flags[-2]))


def terms(text: bytes | None) -> np.ndarray:
    """How often each term occurs."""
    text, counts, i, before = text or b"", np.zeros(TERMS, np.int64), 0, (np.uint64(0), 0, 0)
    whole = np.frombuffer(b"\0\0" + text + b"\0\0", np.uint8)
    for j in range(0, len(whole) - 2, CHUNK):
        counts[:TRIGRAMS] += np.bincount(trigrams(whole[j : j + CHUNK + 2]), minlength=TRIGRAMS)
    x = whole[2:-2]
    while i < len(x):
        z = min(len(x), i + CHUNK)
        if z < len(x):
            gaps = np.flatnonzero(CLASSES[x[i:z]] == SPACE)
            z = i + int(gaps[-1]) + 1 if len(gaps) else z
        found, before = shapes(x[i:z], before)
        counts[TRIGRAMS:] += np.bincount(found, minlength=SHAPES)
        i = z
    return counts


def weigh(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """The weighted terms of texts, a row each; both halves of length 1 or 0."""
    w = np.where(np.arange(TERMS) < TRIGRAMS, counts > 0, np.log1p(counts)) * idf
    for half in (w[:, :TRIGRAMS], w[:, TRIGRAMS:]):
        half /= np.maximum(np.sqrt((half * half).sum(1, keepdims=True)), 1e-12)
    return w


def frequencies(texts: DataFrame) -> tuple[int, np.ndarray]:
    """The number of texts and in how many of them each term occurs; texts: (text as binary)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, np.zeros(TERMS, np.int64)
        for batch in batches:
            for x in values(batch.column(0)):
                total += terms(x) > 0
                n += 1
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(some, -1)), pa.array(np.append(total[some], n))], names=["term", "n"])

    found = {r["term"]: r["n"] for r in texts.mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()}
    return found.get(-1, 0), np.array([found.get(t, 0) for t in range(TERMS)], np.float64)


def inverse(n: int, frequency: np.ndarray) -> np.ndarray:
    """Inverse document frequencies; shapes that every text has keep a little weight."""
    return np.log((n + 1) / (frequency + 1)) + np.where(np.arange(TERMS) < TRIGRAMS, 0.0, 0.05)


class Space:
    """The latent space and the labelled vectors in it."""

    def __init__(self, idf: np.ndarray, rows: list[tuple[np.ndarray, np.ndarray]], labels: list[int], rank: int = RANK):
        """rows: (terms, counts) of the labelled texts."""
        self.idf, self.labels = idf, np.array(labels, np.float64)
        self.prior = float(self.labels.mean()) if labels else 0.5
        matrix = np.zeros((len(rows), TERMS), np.float32)
        for i, (at, n) in enumerate(rows):
            counts = np.zeros((1, TERMS))
            counts[0, at] = n
            matrix[i] = weigh(counts, idf)[0]
        self.axes = self._axes(matrix, min(rank, len(rows)))
        self.vectors = self._unit(matrix.astype(np.float64) @ self.axes) if len(rows) else np.zeros((0, 0))

    @staticmethod
    def _axes(matrix: np.ndarray, rank: int) -> np.ndarray:
        """The first right singular vectors, by subspace iteration."""
        if not rank:
            return np.zeros((TERMS, 0))
        q = np.random.RandomState(0).randn(TERMS, min(rank + 16, len(matrix)))
        for _ in range(4):
            q = np.linalg.qr(matrix.T @ (matrix @ q.astype(np.float32)))[0]
        _, _, vt = np.linalg.svd((matrix @ q).astype(np.float64), full_matrices=False)
        return (q.astype(np.float64) @ vt.T)[:, :rank]

    @staticmethod
    def _unit(x: np.ndarray) -> np.ndarray:
        size = np.sqrt((x * x).sum(1, keepdims=True))
        return np.where(size > 1e-9, x / np.maximum(size, 1e-12), 0.0)

    def scores(self, counts: np.ndarray) -> np.ndarray:
        """The score of each of at most BLOCK texts; the block is filled up, so that a text's products don't depend on its neighbours."""
        if not len(self.labels):
            return np.full(len(counts), 0.5)
        block = np.zeros((BLOCK, TERMS), np.int64)
        block[: len(counts)] = counts
        cosine = self._unit(weigh(block, self.idf) @ self.axes) @ self.vectors.T
        # a number for each neighbour, none twice: nearer first, then the first of the sample
        key = np.rint(cosine[: len(counts)] * 1e9).astype(np.int64) * len(self.labels) - np.arange(len(self.labels))
        k = min(NEIGHBOURS, len(self.labels))
        top = np.sort(np.argpartition(-key, k - 1, axis=1)[:, :k], axis=1)
        votes = np.round(np.maximum(np.take_along_axis(cosine[: len(counts)], top, 1), 0), 9) ** POWER
        all_ = votes.sum(1)
        return np.round(np.where(all_ > 0, (votes * self.labels[top]).sum(1) / np.where(all_ > 0, all_, 1), self.prior), 6)


def held_out(doc_id: Column) -> Column:
    """Whether crc32 of the id as text is 0 modulo 5; a null id is not held out."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))


def _plain(text: str) -> Column:
    return F.coalesce(F.col(text), F.lit("")).cast("binary")


def sample(docs: DataFrame, labels: DataFrame, most: int, doc_id: str = "doc_id", text: str = "text", label: str = "quality") -> DataFrame:
    """(h, doc_id, label, text): at most `most` labelled documents that are not held out."""
    usable = labels.where(F.col(doc_id).isNotNull() & F.col(label).isin(0, 1) & ~held_out(F.col(doc_id))).groupBy(F.col(doc_id).alias("doc_id")).agg(F.min(label).alias("label"))
    there = usable.join(docs.select(F.col(doc_id).alias("doc_id")), "doc_id", "left_semi")
    chosen = written(there.withColumn("h", F.xxhash64("doc_id")).orderBy("h", "doc_id").limit(most), "op12-sample")
    texts = docs.select(F.col(doc_id).alias("doc_id"), _plain(text).alias("text")).join(F.broadcast(chosen), "doc_id")
    return texts.groupBy("h", "doc_id", "label").agg(F.min("text").alias("text"))


def learn(docs: DataFrame, labels: DataFrame, train: int = TRAIN, rank: int = RANK, doc_id: str = "doc_id", text: str = "text", label: str = "quality") -> Space:
    """The space of at most `train` labelled documents, terms weighted by all of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            some = []
            for x in values(batch.column(3)):
                counts = terms(x)
                at = np.flatnonzero(counts)
                some.append((at.astype(np.uint16).tobytes(), counts[at].astype(np.uint32).tobytes()))
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(3)), *(pa.array([x[i] for x in some], pa.binary()) for i in (0, 1))], names=["h", "doc_id", "label", "at", "counts"])

    idf = inverse(*frequencies(docs.select(_plain(text).alias("text"))))
    own = sample(docs, labels, train, doc_id, text, label).select("h", F.col("doc_id").cast("long"), F.col("label").cast("int"), "text")
    rows = sorted(own.mapInArrow(run, "h long, doc_id long, label int, at binary, counts binary").collect(), key=lambda r: (r["h"], r["doc_id"]))  # `train` rows at most
    return Space(idf, [(np.frombuffer(r["at"], np.uint16), np.frombuffer(r["counts"], np.uint32)) for r in rows], [r["label"] for r in rows], rank)


def score(docs: DataFrame, space: Space, doc_id: str = "doc_id", text: str = "text", keep: float = KEEP) -> DataFrame:
    """(doc_id, held_out, score, predicted), a row for each row of docs."""
    shared = docs.sparkSession.sparkContext.broadcast(space)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        near = shared.value
        for batch in batches:
            for i in range(0, batch.num_rows, BLOCK):
                part = batch.slice(i, BLOCK)
                found = near.scores(np.array([terms(x) for x in values(part.column(2), 32)]))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(found), pa.array((found >= keep).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), held_out(F.col(doc_id)).alias("held_out"), _plain(text).alias("text"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def quality(docs: DataFrame, labels: DataFrame, train: int = TRAIN, doc_id: str = "doc_id", text: str = "text", label: str = "quality") -> DataFrame:
    """(doc_id, held_out, score, predicted): every document, scored by what was learned from the labelled ones that are not held out."""
    return score(docs, learn(docs, labels, train, RANK, doc_id, text, label), doc_id, text)
