"""The quality classifier against a plain version of terms, weights and votes, and on documents it didn't learn from."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from stratafile.llm import quality as q

SF = "/root/testdata/sf0.01"


def plain_terms(text):
    """(set of trigrams, counts of word shapes) of a text, word by word."""
    data = (text or "").encode()
    whole = b"\0\0" + data + b"\0\0"
    grams = {whole[i : i + 3] for i in range(len(whole) - 2)}
    kind = lambda c: q.SPACE if c in b" \t\n\x0b\x0c\r" else q.CAPITAL if 65 <= c <= 90 else q.DIGIT if 48 <= c <= 57 else q.LETTER if 97 <= c <= 122 or c >= 128 else q.MARK
    shapes, same, last = Counter(), [0, 0], None
    for word in data.split():
        end = ("mark", word[-1]) if kind(word[-1]) == q.MARK else kind(word[-1])
        same.append(int(word == last))
        shapes["word", kind(word[0]), end, sum(kind(c) == q.CAPITAL for c in word) > 1, same[-1], sum(len(word) >= n for n in (2, 4, 8))] += 1
        shapes[("row", *same[-3:])] += 1
        last = word
    return grams, shapes


def texts(n, seed):
    rnd, words = random.Random(seed), ["alpha", "Beta", "x", "GAMMA!!", "12", "é", "|", "longerword"]
    return ["", None, "  ", *(" ".join(rnd.choice(words[: rnd.randint(1, 8)]) for _ in range(rnd.randint(1, 40))) for _ in range(n - 3))]


def test_terms_against_a_walk(monkeypatch):
    seen = {}
    for chunk in (1 << 20, 16):
        monkeypatch.setattr(q, "CHUNK", chunk)
        for text in texts(80, 1):
            grams, shapes = plain_terms(text)
            counts = q.terms((text or "").encode())
            numbers = Counter()
            for g in grams:
                numbers[int(q.trigrams(np.frombuffer(g, np.uint8))[0])] = 1
            assert set(np.flatnonzero(counts[: q.TRIGRAMS])) == set(numbers)
            assert counts[q.TRIGRAMS :].sum() == sum(shapes.values()) == 2 * len((text or "").split())
            # words with the same shape fall together, by how often each occurs
            assert seen.setdefault(tuple(sorted(counts[q.TRIGRAMS :][counts[q.TRIGRAMS :] > 0])), Counter()) is not None
            one = {s: i for i, s in enumerate(sorted(shapes, key=str))}
            assert np.count_nonzero(counts[q.TRIGRAMS :]) <= len(one)


def test_a_repeat_is_seen_and_long_texts_are_read_whole(monkeypatch):
    shape = lambda x: q.terms(x)[q.TRIGRAMS :]
    assert (shape(b"one two one two") != shape(b"one one two two")).any()
    long = b" ".join(b"w%d" % (i % 997) for i in range(60_000)) + b" the the the END!!"
    whole = q.terms(long)
    monkeypatch.setattr(q, "CHUNK", 5000)
    assert (q.terms(long) == whole).all() and (q.terms(long[:-9]) != whole).any()


def plain_scores(docs, labels, held):
    """The scores by plain loops: exact singular vectors, every cosine, votes."""
    counts = {i: q.terms((t or "").encode()) for i, (_, t) in enumerate(docs)}
    n, df = len(docs), sum((c > 0).astype(float) for c in counts.values())
    idf = [math.log((n + 1) / (df[t] + 1)) + (0.05 if t >= q.TRIGRAMS else 0) for t in range(q.TERMS)]

    def vector(c):
        halves = []
        for lo, hi in ((0, q.TRIGRAMS), (q.TRIGRAMS, q.TERMS)):
            half = [(1.0 if c[t] and lo == 0 else math.log1p(c[t])) * idf[t] for t in range(lo, hi)]
            size = math.sqrt(sum(x * x for x in half))
            halves += [x / size if size else 0.0 for x in half]
        return halves

    sample = [(i, labels[d]) for i, (d, _) in enumerate(docs) if d in labels and not held(d)]
    matrix = np.array([vector(counts[i]) for i, _ in sample])
    axes = np.linalg.svd(matrix, full_matrices=False)[2].T
    own = matrix @ axes
    out = []
    for i in range(n):
        x = np.array(vector(counts[i])) @ axes
        cosines = [float(x @ v / (np.linalg.norm(x) * np.linalg.norm(v))) if np.linalg.norm(x) > 1e-9 else 0.0 for v in own]
        best = sorted(range(len(sample)), key=lambda j: (-round(cosines[j], 6), j))[: q.NEIGHBOURS]
        votes = [max(cosines[j], 0) ** q.POWER for j in best]
        out.append(sum(v for v, j in zip(votes, best) if sample[j][1]) / sum(votes) if sum(votes) else sum(y for _, y in sample) / len(sample))
    return out


def test_against_plain_votes(spark):
    rnd = random.Random(4)
    docs = [(i, " ".join(rnd.choice(["fine", "prose", "here", "is", "Text."] if i % 3 else ["###", "BAD!!", "bad", "|", "%%%"]) + str(rnd.randint(0, 9)) for _ in range(rnd.randint(2, 30)))) for i in range(60)] + [(60, None), (61, "")]
    labels = {i: int(i % 3 > 0) for i in range(0, 62, 2)}
    held = lambda d: zlib.crc32(str(d).encode()) % 5 == 0
    got = q.quality(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame([*labels.items()], "doc_id long, quality int")).collect()
    want = plain_scores(docs, labels, held)
    assert {r.doc_id: r.held_out for r in got} == {d: held(d) for d, _ in docs}
    far = [abs(r.score - want[r.doc_id]) for r in got]
    assert sorted(far)[int(0.9 * len(far))] < 1e-3 and all((r.predicted == 1) == (r.score >= 0.3) for r in got)  # neighbours at equal distance may differ in the order of the sample
    assert np.mean([(r.score >= 0.5) == (r.doc_id % 3 > 0) for r in got if r.doc_id < 60]) > 0.95


def test_held_out_documents(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    rows = q.quality(docs, labels).join(labels, "doc_id").where("held_out").collect()
    assert len(rows) > 50 and np.mean([r.predicted == r.quality for r in rows]) >= 0.97
    assert min(r.score for r in rows if r.quality) > max(r.score for r in rows if not r.quality)


@pytest.mark.parametrize("labels", [[], [(1, 1)], [(None, 0), (2, None), (3, 7)]])
def test_odd_tables(spark, labels):
    docs = spark.createDataFrame([(1, "one text", "x", 1.0), (1, "one text", "y", 2.0), (None, "no id", None, None), (4, None, "z", 0.0), (5, "w" * 100_000, "z", 0.0)], "doc_id long, text string, label string, score double")
    table = spark.createDataFrame(labels, "doc_id long, quality int")
    got = q.quality(docs, table)
    assert got.columns == ["doc_id", "held_out", "score", "predicted"]
    rows = got.collect()
    assert len(rows) == 5 and {r.score for r in rows} == ({1.0} if (1, 1) in labels else {0.5}) and {r.predicted for r in rows} == {1}
    assert q.quality(docs.limit(0), table).count() == 0


def test_the_sample_is_bounded_and_repeats_are_settled(spark):
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(50)] + [(2, "a smaller text")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)] + [(3, 0)], "doc_id long, quality int")
    rows = {r.doc_id: r for r in q.sample(docs, labels, 100).collect()}
    assert rows[2].text == b"a smaller text" and rows[3].label == 0 and max(rows) < 50
    assert len(rows) == sum(zlib.crc32(str(i).encode()) % 5 != 0 for i in range(50)) and q.sample(docs, labels, 10).count() == 10
