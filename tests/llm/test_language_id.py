import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from stratafile.llm import language_id as op


def slow_grams(text):
    s = "".join(op_lower(c) if c.isalpha() else " " for c in text)
    s = " " + s + " "
    while "  " in s:
        s = s.replace("  ", " ")
    if s == " ":
        return Counter()
    grams = Counter(c for c in s if c != " ")
    for n in (2, 3):
        grams.update(s[i : i + n] for i in range(len(s) - n + 1))
    return grams


def op_lower(c):
    return c.lower() if len(c.lower()) == 1 else c


def code(g):
    x = 0
    for c in g:
        x = x << op.BITS | ord(c)
    return x


def test_grams_and_prediction_against_brute_force():
    rnd = random.Random(7)
    texts = ["", "123 !", "a", "Ab, ab!\n\nÉé 漢字 İ x", "z" * 50] + ["".join(rnd.choice("abcABC éß.,1 漢\t") for _ in range(rnd.randint(1, 400))) for _ in range(30)]
    for t in texts:
        codes, counts = op.grams(t)
        assert dict(zip(codes.tolist(), counts.tolist())) == {code(g): n for g, n in slow_grams(t).items()}, t
    langs = {"x": texts[5:15], "y": texts[15:25], "a": ["zz yy zz"]}
    rank = lambda grams: [c for _, c in sorted((-n, code(g)) for g, n in grams.items())][: op.PROFILE]
    profiles = {k: rank(sum((slow_grams(t) for t in v), Counter())) for k, v in langs.items()}
    ranker = op.Ranker(profiles)
    for t in texts:
        own = rank(slow_grams(t))
        far = {k: sum(abs(p.index(c) - i) if c in p else op.PROFILE for i, c in enumerate(own)) for k, p in profiles.items()}
        best = min(sorted(far), key=far.get)
        want = (best, 1 - far[best] / (op.PROFILE * len(own))) if own else ("und", 0.0)
        got = ranker(t)
        assert got[0] == want[0] and abs(got[1] - want[1]) < 1e-12


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    truth = {r.doc_id: r.lang for r in docs.select("doc_id", "lang").collect()}
    got = op.languages(docs).collect()
    assert len(got) == len(truth)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 for r in got)
    held = [r.lang_pred == truth[r.doc_id] for r in got if r.held_out]
    assert np.mean(held) > 0.97


def test_edge_rows(spark):
    rows = [(1, "the cat and the dog", "en"), (2, "le chat et le chien", "fr"), (3, None, "en"), (5, " 12 --", "fr"), (6, "the", None), (None, "le", "fr"), (1, "the cat and the dog", "en"), (8, "the " * 100_000, None)]
    docs = spark.createDataFrame([(*r, "q", 0.5) for r in rows], "doc_id long, text string, lang string, lang_pred string, score double")
    got = op.languages(docs).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    assert by[3].lang_pred == by[5].lang_pred == "und" and by[3].score == 0 and by[8].lang_pred in ("en", "fr")
    assert op.languages(docs.limit(0)).collect() == []
    assert {r.lang_pred for r in op.languages(docs.where("lang is null")).collect()} == {"und"}
    profiles = op.learn(docs)
    kept = op.known(docs, profiles, least=0.0)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {1, 2, 6, None, 8}


@pytest.mark.parametrize("spare", [1, 3, 100])
def test_learned_profiles_against_brute_force(spark, monkeypatch, spare):
    monkeypatch.setattr(op, "TRAIN", 6)
    monkeypatch.setattr(op, "SPARE", spare)
    rnd = random.Random(2)
    rows = [(i, "".join(rnd.choice("abc de") for _ in range(40)), rnd.choice(["x"] * 9 + ["y"])) for i in range(120)]
    rows += [(5, "another text of five", rows[5][2]), (None, "no id", "x"), (200, None, "x"), (201, "no language", None)] + [(7, "many of one id", "z")] * 30 + [(300, "once", "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    hashes = {r.doc_id: r.h for r in docs.select("doc_id", F.shiftrightunsigned(F.xxhash64("doc_id"), 1).alias("h")).collect()}
    want = {}
    for lang in "xyz":
        own = {}
        for i, t, of in rows:
            if of == lang and i is not None and t is not None:
                own[i] = min(t, own.get(i, t))
        sample = [own[i] for i in sorted(own, key=hashes.get)[:6]]
        grams = sum((slow_grams(t) for t in sample), Counter())
        want[lang] = [c for _, c in sorted((-n, code(g)) for g, n in grams.items())][: op.PROFILE]
    assert op.learn(docs) == want
