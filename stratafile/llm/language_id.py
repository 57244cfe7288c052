"""Language identification by rank-order profiles.

A text's letters are lower-cased, whatever lies between them counts as one space, and its n-grams of 1 to 3 characters are ranked by frequency
(ties by code point). A language's profile is the ranking over its training texts. A text's distance to a profile is the sum, over the text's
PROFILE most frequent n-grams, of how far out of place each is there; one that the profile lacks counts PROFILE. The nearest language is the
prediction, and the score is one minus the distance as a part of the greatest possible.

Profiles are learned from at most TRAIN documents of each language (those with the smallest hash of doc_id), whole texts; which these are is found among those below a bound on the hash that
leaves about SPARE times as many of each language, so that no task sees more of a language, however large. n-grams are counted
on the executors, and only the profiles, PROFILE n-grams a language, reach the driver.

Defined cases: text null or without a letter: language und, score 0; nothing to learn from: und for all; equal distances: the first language
in code-point order; repeated rows are predicted alike; rows without a doc_id are predicted, not learned from; of rows that repeat a doc_id and language the least text is learned from; an empty table gives an empty result; texts of any length are read whole; other columns are not read."""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import few, values, written

PROFILE = 300
#: Documents of a language that it is learned from, at most.
TRAIN, SPARE = 500, 8
BITS = 21
#: Below this score a text fits no learned language; prose scores 0.4 and more, random letters about 0.1.
LEAST = 0.2

_letters: list[np.ndarray] = []


def letters() -> np.ndarray:
    """For each code point the lower-case letter, or 0 if it is no letter."""
    if not _letters:
        table = np.zeros(sys.maxunicode + 1, np.int64)
        for c in map(chr, range(sys.maxunicode + 1)):
            if c.isalpha():
                low = c.lower()
                table[ord(c)] = ord(low) if len(low) == 1 else ord(c)
        _letters.append(table)
    return _letters[0]


def grams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The n-grams of a text as numbers, and how often each occurs; both empty if it has no letter."""
    x = letters()[np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)]
    x = np.concatenate([[0], x, [0]])
    x = x[(x != 0) | np.concatenate([[True], x[:-1] != 0])]  # one space between words
    if len(x) < 2:
        return x[:0], x[:0]
    x = np.where(x == 0, 32, x)
    two = (x[:-1] << BITS) | x[1:]
    every = np.concatenate([x[x != 32], two, (two[:-1] << BITS) | x[2:]])
    every.sort()
    new = np.flatnonzero(np.concatenate([[True], every[1:] != every[:-1]]))
    return every[new], np.diff(np.append(new, len(every)))


def ranked(codes: np.ndarray, counts: np.ndarray, k: int = PROFILE) -> np.ndarray:
    """The k most frequent codes, ties by code."""
    return codes[np.lexsort((codes, -counts))[:k]]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        totals: dict[str, dict[int, int]] = {}
        for lang, text in zip(values(batch.column(0)), values(batch.column(1))):
            own = totals.setdefault(lang, {})
            codes, counts = grams(text)
            for c, n in zip(codes.tolist(), counts.tolist()):
                own[c] = own.get(c, 0) + n
        rows = [(lang, c, n) for lang, own in totals.items() for c, n in own.items()]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.int64(), pa.int64()))], names=["lang", "code", "n"])


def learn(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> dict[str, list[int]]:
    """Profiles by language from the rows of docs that have both."""
    known = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull() & F.col(doc_id).isNotNull()).select(F.col(lang).alias("lang"), F.shiftrightunsigned(F.xxhash64(doc_id), 1).alias("h"), F.col(text).alias("text"))
    # ids are chosen first, so that no texts but those of the sample are moved
    sizes = written(known.groupBy("lang").agg(F.count("*").alias("all_")), "op3-sizes")
    bound = F.lit(float(2**63)) * (F.lit(float(SPARE * TRAIN)) / F.col("all_"))
    below = known.select("lang", "h").join(few(sizes), "lang").where(F.col("h").cast("double") <= bound).select("lang", "h")
    below = written(below.distinct(), "op3-below")
    # ids that repeat may leave too few below the bound
    short = sizes.join(below.groupBy("lang").agg(F.count("*").alias("n")), "lang", "left").where((F.coalesce("n", F.lit(0)) < TRAIN) & (F.col("all_") > SPARE * TRAIN)).select("lang")
    if short.limit(1).count():
        below = below.unionByName(known.select("lang", "h").join(short, "lang", "left_semi")).distinct()
    first = F.row_number().over(Window.partitionBy("lang").orderBy("h"))
    chosen = written(below.withColumn("r", first).where(F.col("r") <= TRAIN).select("lang", "h"), "op3-sample")
    sample = known.join(few(chosen), ["lang", "h"], "left_semi").groupBy("lang", "h").agg(F.min("text").alias("text")).select("lang", "text")
    counts = sample.mapInArrow(_count, "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n"))
    top = counts.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "code"))).where(F.col("r") <= PROFILE)
    found: dict[str, list[int]] = {}
    for r in top.select("lang", "code", "r").orderBy("lang", "r").collect():
        found.setdefault(r["lang"], []).append(r["code"])
    return found


class Ranker:
    """Predicts from profiles."""

    def __init__(self, profiles: dict[str, list[int]]):
        self.langs = sorted(profiles)
        self.codes = np.unique(np.array([c for p in profiles.values() for c in p], np.int64))
        self.ranks = np.full((len(self.codes) + 1, len(self.langs)), -1)  # the last row is that of all other n-grams
        for j, lang in enumerate(self.langs):
            self.ranks[np.searchsorted(self.codes, profiles[lang]), j] = np.arange(len(profiles[lang]))

    def __call__(self, text: str | None) -> tuple[str, float]:
        codes, counts = grams(text or "")
        if not len(codes) or not self.langs:
            return "und", 0.0
        top = ranked(codes, counts)
        at = np.minimum(np.searchsorted(self.codes, top), len(self.codes) - 1)
        rows = self.ranks[np.where(self.codes[at] == top, at, len(self.codes))]
        far = np.where(rows < 0, PROFILE, np.abs(rows - np.arange(len(top))[:, None])).sum(0)
        best = int(far.argmin())
        return self.langs[best], 1.0 - float(far[best]) / (PROFILE * len(top))


def identify(docs: DataFrame, profiles: dict[str, list[int]], text: str = "text") -> DataFrame:
    """docs with lang_pred and score instead of its text; the text must be the last column."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rank = Ranker(profiles)
        for batch in batches:
            said = [rank(x) for x in values(batch.column(batch.num_columns - 1))]
            kept = [batch.column(i) for i in range(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*kept, pa.array([x[0] for x in said], pa.string()), pa.array([x[1] for x in said], pa.float64())], names=[*batch.schema.names[:-1], "lang_pred", "score"])

    schema = ", ".join(f"`{n}` {t}" for n, t in docs.dtypes[:-1]) + ("," if len(docs.columns) > 1 else "") + " lang_pred string, score double"
    assert docs.columns[-1] == text
    return docs.mapInArrow(run, schema)


def held_out(doc_id: Column) -> Column:
    """Whether crc32 of the id as text leaves 1 modulo 3; a null id is not held out."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))


def languages(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """(doc_id, held_out, lang_pred, score), a row for each row of docs; learned from those that are not held out."""
    profiles = learn(docs.where(~held_out(F.col(doc_id))), doc_id, text, lang)
    return identify(docs.select(F.col(doc_id).cast("long").alias("doc_id"), held_out(F.col(doc_id)).alias("held_out"), F.col(text).alias("text")), profiles)


def known(docs: DataFrame, profiles: dict[str, list[int]], text: str = "text", least: float = LEAST) -> DataFrame:
    """The rows of docs, all columns, whose text is in a learned language with a score of at least `least`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rank = Ranker(profiles)
        for batch in batches:
            said = [rank(x) for x in values(batch.column(batch.schema.get_field_index(text)))]
            yield batch.filter(pa.array([lang != "und" and score >= least for lang, score in said], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
