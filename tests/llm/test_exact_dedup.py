import hashlib
import re
from collections import defaultdict

import numpy as np
from pyspark.sql import functions as F

from stratafile.llm import exact_dedup as op


def expected(rows):
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    groups = defaultdict(list)
    for i, t in rows:
        groups[norm(t)].append(i)
    out, seen = [], set()
    for i, t in rows:
        ids = [x for x in groups[norm(t)] if x is not None]
        keep = min(ids) if ids else None
        out.append((i, keep, len(groups[norm(t)]), i == keep if ids or norm(t) not in seen else False, hashlib.sha256(norm(t).encode()).hexdigest()))
        seen.add(norm(t))
    return sorted(out, key=str)


ROWS = [(1, "a b"), (2, "a\t\n b"), (3, "a  b "), (4, None), (5, ""), (6, " "), (7, "a b"), (8, "x" * 200_000), (9, "x" * 200_000), (None, "a b"), (None, "only null"), (None, "only  null"), (None, "only null"), (7, "a b"), (10, "\xa0"), (11, "é"), (12, "é")]


def test_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(op, "KEYS_PER_BUCKET", 2)
    docs = spark.createDataFrame([(i, t, "k", "d", 1) for i, t in ROWS], "doc_id long, text string, keep_id string, digest string, n int")
    assert sorted((tuple(r) for r in op.exact_dedup(docs).collect()), key=str) == expected(ROWS)


def test_any_history_and_empty_tables(spark):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string")
    everything, nothing = (sorted((tuple(r) for r in op.exact_dedup(docs, history=F.lit(x)).collect()), key=str) for x in (True, False))
    assert everything == nothing == expected(ROWS)
    assert op.exact_dedup(docs.limit(0)).collect() == []
    later = {r.doc_id: r for r in op.exact_dedup(docs.where("doc_id in (1, 2, 7)"), history=F.col("doc_id") == 7).collect()}
    assert later[1].keep_id == 7 and not later[1].kept and later[7].kept  # history wins


def test_buckets_follow_the_larger_side(spark, monkeypatch):
    monkeypatch.setattr(op, "KEYS_PER_BUCKET", 10)
    asked, build_index = [], op.build_index
    monkeypatch.setattr(op, "build_index", lambda history, buckets: asked.append(buckets) or build_index(history, buckets))
    docs = spark.createDataFrame([(i, f"text {i % 190}") for i in range(200)] + [(10**12, "far away")], "doc_id long, text string")
    for history in (F.lit(False), F.lit(True), F.col("doc_id") == 5, None, F.lit(None).cast("boolean")):
        got = op.exact_dedup(docs, history=history).collect()
        assert len(got) == 201 and sum(r.kept for r in got) == 191
    assert asked == [21, 21, 20, 20, 21]  # with the middle of the ids as history all but one row are historical


def test_hash_is_minimal_and_perfect():
    for n in (0, 1, 2, 100, 5000):
        keys = [hashlib.sha256(str(i).encode()).digest() for i in range(n)]
        sizes, bits = op.build(keys)
        assert sorted(op.slots_of(keys, sizes, bits).tolist() if n else []) == list(range(n))
        if n:
            others = [hashlib.sha256(f"no {i}".encode()).digest() for i in range(200)]
            at = op.slots_of(others, sizes, bits)
            assert ((at >= -1) & (at < n)).all() and isinstance(at, np.ndarray)
