"""Importance resampling towards a target distribution: documents are drawn by how much likelier their features are in the benchmark than in the corpus, with Gumbel noise.

Texts are lower-cased (A-Z only); words are runs of ASCII digits, letters and whatever lies beyond ASCII; features are all runs of 1 to `longest` words, joined by a space, repeats counted, hashed by CRC32
into `buckets` buckets. With S features in the corpus, s of them in a bucket, T and t in the target, the bucket's gain is
floor(1000 ln((t + 1) (S + buckets) / ((s + 1) (T + buckets)))); a document's weight is the sum of its features' gains, and its score the weight and floor(-1000 ln(-ln u)), u from a
hash of the seed and doc_id. Of the documents with at least `least_words` words the share with the highest scores is drawn.

Identical texts are collapsed first, by grouping the full text: features are taken once for each, into a table of (digest, copies, buckets, counts); the corpus's counts are those counts times the copies, and the
weight is computed once. Documents then get the weight of their text back by its SHA-256, and only the noise is their own. Copies of a text are summed where they are read, so that none is too many for a
task. Weights of texts with over a thousandth of all rows, fewer than a thousand texts, are broadcast; the others meet their documents by a shuffle in which no key has more. What reaches the driver is
the two histograms, a number for each bucket. The draw is a total order dealt out by ranges (operators.order).

Defined cases: null texts count as empty, have no features and weigh 0; floors go down; equal scores: the smaller doc_id first, then the smaller digest; repeated rows are documents each, with
the same score; rows without a doc_id count in the corpus and have a weight, but no noise, so score and rank are null and they aren't among the documents to draw from; null target texts hold nothing; an empty target gives
gains for t = 0; an empty table gives an empty result; texts of any length are read whole; other columns are not read."""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.order import numbered
from .common import few, values, written

#: What is no word becomes a space, A-Z become a-z; bytes beyond ASCII are parts of words.
_PLAIN = bytes(c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))
#: Words whose CRC32 a worker remembers.
REMEMBERED = 200_000
#: A text is hot if it has over 1 / HOT of all rows.
HOT = 1000
#: Rows of a task of the final order.
PIECE = 20_000

_FEATURES = "n_words long, n_features long, buckets array<int>, counts array<long>"


def features(text: bytes | None, longest: int, buckets: int, seen: dict[bytes, int] | None = None) -> tuple[int, int, np.ndarray, np.ndarray]:
    """(words, features, buckets that have some, how many each)"""
    words = (text or b"").translate(_PLAIN).split()
    counted = Counter(words)
    for n in range(2, min(longest, len(words)) + 1):
        counted.update(b" ".join(words[i : i + n]) for i in range(len(words) - n + 1))
    seen = {} if seen is None else seen
    at = []
    for w in counted:
        b = seen.get(w)
        if b is None:
            b = zlib.crc32(w) % buckets
            if len(seen) < REMEMBERED and len(w) < 24:
                seen[w] = b
        at.append(b)
    found, back = np.unique(np.array(at, np.int64), return_inverse=True)
    counts = np.zeros(len(found), np.int64)
    np.add.at(counts, back, np.fromiter(counted.values(), np.int64, len(counted)))
    return len(words), int(counts.sum()), found, counts


def featured(texts: DataFrame, longest: int, buckets: int) -> DataFrame:
    """texts (..., text as binary) with its features instead of it; the text is the last column."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[bytes, int] = {}
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                got = [features(x, longest, buckets, seen) for x in values(part.column(part.num_columns - 1))]
                ends = pa.array(np.cumsum([0, *(len(g[2]) for g in got)]), pa.int32())
                lists = [pa.ListArray.from_arrays(ends, pa.array(np.concatenate([np.zeros(0, np.int64), *(g[j] for g in got)]), t)) for j, t in ((2, pa.int32()), (3, pa.int64()))]
                kept = [part.column(j) for j in range(part.num_columns - 1)]
                yield pa.RecordBatch.from_arrays([*kept, pa.array([g[0] for g in got], pa.int64()), pa.array([g[1] for g in got], pa.int64()), *lists], names=[*batch.schema.names[:-1], "n_words", "n_features", "buckets", "counts"])

    kept = "".join(f"{n} {t}, " for n, t in texts.dtypes[:-1])
    return texts.mapInArrow(run, kept + _FEATURES)


def histogram(found: DataFrame, buckets: int) -> np.ndarray:
    """How often each bucket occurs; found: (copies, buckets, counts). A number for each bucket and task is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            copies, at, counts = (batch.column(i) for i in range(3))
            sizes = np.diff(at.offsets.to_numpy())
            np.add.at(total, at.flatten().to_numpy(), counts.flatten().to_numpy() * np.repeat(copies.to_numpy(), sizes))
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    for r in found.select("copies", "buckets", "counts").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r["bucket"]] = r["n"]
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """The gain of each bucket."""
    d, all_s, all_t = len(corpus), int(corpus.sum()), int(target.sum())
    ratio = [float(t + 1) * float(all_s + d) / (float(s + 1) * float(all_t + d)) for s, t in zip(corpus.tolist(), target.tolist())]
    return np.array([math.floor(1000.0 * math.log(x)) for x in ratio], np.int64)


def weighed(found: DataFrame, gain: np.ndarray) -> DataFrame:
    """(digest, copies, n_words, n_features, weight) of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, counts = batch.column(4), batch.column(5)
            sums = np.concatenate([[0], np.cumsum(gain[at.flatten().to_numpy()] * counts.flatten().to_numpy())])
            ends = at.offsets.to_numpy() - at.offsets[0].as_py()
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in range(4)], pa.array(sums[ends[1:]] - sums[ends[:-1]], pa.int64())], names=["digest", "copies", "n_words", "n_features", "weight"])

    return found.select("digest", "copies", "n_words", "n_features", "buckets", "counts").mapInArrow(run, "digest binary, copies long, n_words long, n_features long, weight long")


def noise(doc_id: Column, seed: str) -> Column:
    """floor(-1000 ln(-ln u)), u by the first 8 hex digits of SHA-256 of seed:doc_id."""
    h = F.conv(F.left(F.sha2(F.concat(F.lit(f"{seed}:"), doc_id.cast("string")), 256), F.lit(8)), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("long")


def resample(docs: DataFrame, target: DataFrame, percent: int = 10, longest: int = 1, buckets: int = 10_000, least_words: int = 20, seed: str = "2024", doc_id: str = "doc_id", text: str = "text", target_text: str = "text") -> DataFrame:
    """(doc_id, n_features, weight, score, rank, n_words, copies), a row for each row of docs: rank is the place among the drawn, null if it isn't; copies is how many rows have the text."""
    plain = F.coalesce(F.col(text), F.lit("")).cast("binary")
    texts = docs.select(plain.alias("text")).groupBy("text").agg(F.count("*").alias("copies")).select(F.unhex(F.sha2("text", 256)).alias("digest"), "copies", "text")
    found = written(featured(texts, longest, buckets), "op11-features")
    wanted = featured(target.select(F.lit(1).cast("long").alias("copies"), F.coalesce(F.col(target_text), F.lit("")).cast("binary").alias("text")), longest, buckets)
    weights = written(weighed(found, gains(histogram(found, buckets), histogram(wanted, buckets))), "op11-weights")
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.unhex(F.sha2(plain, 256)).alias("digest"))
    total = weights.agg(F.coalesce(F.sum("copies"), F.lit(0))).first()[0]
    hot = F.col("copies") * HOT > total  # fewer than HOT texts
    named = written(rows.join(F.broadcast(weights.where(hot).select(F.col("digest").alias("hot_digest"))), F.col("digest") == F.col("hot_digest"), "left"), "op11-rows")
    own = named.where("hot_digest is not null").drop("hot_digest").join(F.broadcast(weights.where(hot)), "digest")
    other = named.where("hot_digest is null").drop("hot_digest").join(weights.where(~hot), "digest")
    scored = own.unionByName(other).withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed))
    scored = written(scored, "op11-scores")
    able = F.col("doc_id").isNotNull() & (F.col("n_words") >= least_words)
    n = scored.where(able).count()
    ranked = numbered(scored.where(able), [F.desc("score"), F.col("doc_id"), F.col("digest")], "place", pieces=n // PIECE + 1)
    drawn = ranked.withColumn("rank", F.when(F.col("place") < percent * n // 100, F.col("place") + 1)).drop("place")
    return drawn.unionByName(scored.where(~able).withColumn("rank", F.lit(None).cast("long"))).select("doc_id", "n_features", "weight", "score", "rank", "n_words", "copies")
