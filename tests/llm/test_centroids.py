"""Clustering by annulus search against comparisons with every centroid."""

import hashlib
import math
import random
from collections import Counter

import numpy as np
import pytest

from stratafile.llm import centroids
from stratafile.llm.centroids import Annuli, cluster


def plain(rows, k=16, rounds=3, d=64, scale=64, salt="1"):
    """What cluster gives, vector by vector; rows: (vec_id, components)."""
    kept = [(i, [math.floor(scale * x) for x in v]) for i, v in rows if v is not None and len(v) == d and all(x is not None and math.isfinite(x) for x in v)]
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    c = [v for _, v in sorted((sha(f"{salt}:{i}"), v) for i, v in kept if i is not None)[:k]]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    near = lambda v: min((far(v, m), j) for j, m in enumerate(c))
    if not c:
        return Counter((i, None, None, None, None, None) for i, _ in kept)
    for _ in range(rounds):
        own = {}
        for _, v in kept:
            own.setdefault(near(v)[1], []).append(v)
        c = [[sum(x) // len(own[j]) for x in zip(*own[j])] if j in own else m for j, m in enumerate(c)]
    last = [(i, *near(v)[::-1]) for i, v in kept]
    inertia = Counter()
    for _, j, x in last:
        inertia[j] += x
    return Counter((i, j, x, inertia[j], sum(inertia.values()), sha(",".join(map(str, c[j])))) for i, j, x in last)


COLUMNS = ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]


def clustered(frame, *args):
    got = cluster(frame, *args)
    assert got.columns == COLUMNS
    return Counter(tuple(r) for r in got.collect())


@pytest.mark.parametrize("d, k, scale, spread", [(64, 16, 64, 0.2), (2, 16, 1, 3.0), (3, 5, 2, 1.0), (1, 30, 1, 40.0)])
def test_against_every_centroid(spark, d, k, scale, spread):
    rnd = random.Random(d)
    rows = [(i, [rnd.gauss(0, spread) for _ in range(d)]) for i in range(300)]
    rows += [(400 + i, rows[7][1]) for i in range(120)] + [rows[9]] * 3  # copies and repeated rows
    rows += [(600, None), (601, []), (602, [0.5] * (d + 1)), (603, [None] + [0.1] * (d - 1)), (604, [float("nan")] + [0.1] * (d - 1)), (605, [float("-inf")] + [0.1] * (d - 1)), (None, [0.25] * d), (606, [0.0] * d)]
    frame = spark.createDataFrame([(*r, 1, "x") for r in rows], "vec_id long, embedding array<double>, v int, cluster string").repartition(5)
    assert clustered(frame, k, 3, d, scale) == plain(rows, k, 3, d, scale)


def test_few_and_no_vectors(spark):
    of = lambda rows: spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    rows = [(1, [0.5] * 64), (2, [-0.5] * 64), (3, [0.5] * 64)]
    assert clustered(of(rows)) == plain(rows)
    assert clustered(of([])) == Counter()
    assert clustered(of([(None, [0.5] * 64)])) == plain([(None, [0.5] * 64)])
    with pytest.raises(Exception, match="beyond"):
        cluster(of([(1, [3e7] * 64)])).collect()


def test_annuli_hold_every_nearest_centroid_and_leave_others_out():
    rnd = np.random.RandomState(1)
    c = rnd.randint(-30, 31, (400, 2)).astype(np.int64)  # many equal norms and equal centroids
    x = rnd.randint(-40, 41, (3000, 2)).astype(np.int64)
    search = Annuli(c)
    number, distance = search.nearest(x)
    every = ((x[:, None] - c[None]) ** 2).sum(2)
    assert (distance == every.min(1)).all() and (number == every.argmin(1)).all()
    again, same = search.nearest(x, rnd.randint(0, len(c), len(x)))
    assert (again == number).all() and (same == distance).all()
    lo, hi = search.candidates(x, number)
    assert (hi > lo).all() and (hi - lo).mean() < 0.2 * len(c)


def test_blocks_do_not_change_results(monkeypatch):
    rnd = np.random.RandomState(2)
    c, x = rnd.randint(-5, 6, (16, 4)).astype(np.int64), rnd.randint(-9, 10, (500, 4)).astype(np.int64)
    whole = Annuli(c).nearest(x)
    monkeypatch.setattr(centroids, "PAIRS", 40)
    assert all((a == b).all() for a, b in zip(whole, Annuli(c).nearest(x)))
