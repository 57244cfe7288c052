"""Importance resampling against a plain walk through all documents."""

import hashlib
import math
import zlib
from collections import Counter

import pytest

from stratafile.llm import importance
from stratafile.llm.importance import resample


def plain(docs, target, percent=10, longest=1, buckets=10_000, least=20):
    """What resample gives, document by document; docs: (doc_id, text)."""
    word = lambda c: c.isdigit() and c < "\x80" or "a" <= c <= "z" or c >= "\x80"

    def grams(text):
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        words = "".join(c if word(c) else " " for c in low).split(" ")
        words = [w for w in words if w]
        return words, [" ".join(words[i : i + n]) for n in range(1, longest + 1) for i in range(len(words) - n + 1)]

    bucket = lambda g: zlib.crc32(g.encode()) % buckets
    s, t = Counter(bucket(g) for _, x in docs for g in grams(x)[1]), Counter(bucket(g) for x in target for g in grams(x)[1])
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (all_s + buckets) / ((s[b] + 1) * (all_t + buckets)))) for b in s}
    rows = []
    for d, x in docs:
        words, features = grams(x)
        weight = sum(gain[bucket(g)] for g in features)
        h = int(hashlib.sha256(f"2024:{d}".encode()).hexdigest()[:8], 16)
        score = None if d is None else weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        rows.append([d, len(features), weight, score, None, len(words), sum(1 for _, y in docs if (y or "") == (x or ""))])
    able = sorted((r for r in rows if r[3] is not None and r[5] >= least), key=lambda r: (-r[3], r[0]))
    for i, r in enumerate(able[: percent * len(able) // 100]):
        r[4] = i + 1
    return Counter(map(tuple, rows))


COLUMNS = ["doc_id", "n_features", "weight", "score", "rank", "n_words", "copies"]
TEXTS = [None, "", "  ", "Äpfel_und BIRNEN 12,5 ünd", "a b c d e f g h i j k l m n o p q r s t u v", "the Quick\tbrown\nfox " * 30, "x" * 5000, "日本語 テキスト " * 15]


@pytest.mark.parametrize("longest, buckets, hot", [(1, 10_000, 1000), (3, 50, 1000), (2, 7, 2)])
def test_against_a_walk(spark, monkeypatch, longest, buckets, hot):
    monkeypatch.setattr(importance, "HOT", hot)
    monkeypatch.setattr(importance, "PIECE", 40)
    docs = [(i, TEXTS[i * i % len(TEXTS)] if i % 3 else f"word{i % 7} of the text {i % 11} " * (i % 9)) for i in range(150)] + [(3, "the same id again " * 9), (3, "the same id again " * 9), (None, "no id at all " * 12), (None, None)]
    target = ["the quick brown fox of the text", None, "word3 12 ünd", ""]
    frame = spark.createDataFrame([(d, t, 1, "x") for d, t in docs], "doc_id long, text string, digest int, copies string").repartition(5)
    got = resample(frame, spark.createDataFrame([(t,) for t in target], "text string"), 30, longest, buckets)
    assert got.columns == COLUMNS
    assert Counter(tuple(r) for r in got.collect()) == plain(docs, target, 30, longest, buckets)


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert resample(none, spark.createDataFrame([("a b",)], "text string")).count() == 0
    docs = [(1, "a b c " * 10), (2, None)]
    got = resample(spark.createDataFrame(docs, "doc_id long, text string"), none.select("text"), 100)
    assert Counter(tuple(r) for r in got.collect()) == plain(docs, [], 100)


def test_features_are_taken_once_for_a_text(spark):
    frame = spark.createDataFrame([(i, "same words in all of them " * 5) for i in range(500)], "doc_id long, text string").repartition(6)
    got = resample(frame, spark.createDataFrame([("same words",)], "text string"))
    assert {r.copies for r in got.collect()} == {500} and sorted(r["rank"] for r in got.collect() if r["rank"]) == list(range(1, 51))
