import bisect
import hashlib
import random
import re
from collections import Counter, defaultdict

import pytest

from stratafile.llm import mixing as op


def water(sizes):
    """sizes by source in order -> targets, by repeating the resharing."""
    w = [(5, 2, 1)[i % 3] for i in range(len(sizes))]
    capped = set()
    while True:
        rest = sum(sizes) - sum(3 * sizes[i] for i in capped)
        free = sum(w[i] for i in range(len(sizes)) if i not in capped)
        t = [3.0 * sizes[i] if i in capped else w[i] * rest / free for i in range(len(sizes))]
        over = {i for i in range(len(sizes)) if i not in capped and t[i] > 3 * sizes[i]}
        if not over:
            return t
        capped |= over


def brute(rows, slots):
    """What each row gives, (id, size, source size, target, taken, first slot, stretches), by walking the schedule slot by slot and word by word."""
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    md5 = lambda t: hashlib.md5(t.encode()).hexdigest()
    names = sorted({r[2] for r in rows}, key=lambda s: (s is None, (s or "").encode()))
    order = {s: sorted((r for r in rows if r[2] == s), key=lambda r: (md5(f"{'' if r[0] is None else r[0]} {md5(r[1] or '')}")[:15], r[0] or 0)) for s in names}
    words = {s: [k for k, r in enumerate(order[s]) for _ in range(size(r[1]))] for s in names}
    total = sum(map(len, words.values()))
    goal = water([len(words[s]) for s in names])
    block = max(1, -(-total // slots))
    quota, edges, run = [int(g) for g in goal], [], 0
    for q in quota:
        run += q
        edges.append(run * 2**32 // sum(quota))
    taken, first, stretches = ({s: [z] * len(order[s]) for s in names} for z in (0, None, 0))
    rank = dict.fromkeys(names, 0)
    for i in range(-(-total // block)):
        s = names[bisect.bisect_right(edges, i * op.GOLDEN % 2**32)]
        at = range(rank[s] * block, min((rank[s] + 1) * block, 3 * len(words[s])))
        rank[s] += 1
        for k, n in Counter((words[s][w % len(words[s])], w // len(words[s])) for w in at).items():
            taken[s][k[0]] += n
            stretches[s][k[0]] += 1
            first[s][k[0]] = i if first[s][k[0]] is None else first[s][k[0]]
    return [(r[0], size(r[1]), len(words[s]), g, taken[s][k], first[s][k], stretches[s][k]) for s, g in zip(names, goal) for k, r in enumerate(order[s])]


def some(rnd):
    rows = [(i, rnd.choice(["w ", "ab\t", "é\n"]) * rnd.choice([0, 1, 3, 40, 900]), rnd.choice(["b", "a", "Z", None, "é", "src10", "src9"] + ["hot"] * 6)) for i in range(400)]
    rows += [(500, None, "a"), (501, "one two", "tiny"), (502, "", "none"), (3, rows[3][1], rows[3][2]), (4, "another text", rows[4][2]), (4, "and one more text", rows[4][2])]
    return rows + [(None, f"text {i} without id" * (i % 4), "hot") for i in range(40)] + [(7, "long " * 30_000, "b")]


@pytest.mark.parametrize("slots", [op.SLOTS, 5000, 50])
def test_against_the_schedule_walked_by_word(spark, slots):
    rows = some(random.Random(5))
    docs = spark.createDataFrame([(*r, 0, "x", 0, 0) for r in rows], "doc_id long, text string, source string, size int, target string, place int, s int")
    want, got = brute(rows, slots), op.mix(docs, n_slots=slots).collect()
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted(((r.doc_id, r.size, r.source_size, round(r.target, 6), r.taken, r.first_slot, r.n_slots) for r in got), key=key) == sorted(((*r[:3], round(r[3], 6), *r[4:]) for r in want), key=key)
    assert all(r.taken <= 3 * r.size for r in got)
    took, goal = defaultdict(int), {}
    for r in got:
        took[r.source_size] += r.taken
        goal[r.source_size] = r.target
    block = max(1, -(-sum(r.size for r in got) // slots))
    assert all(abs(took[s] - goal[s]) <= 4 * block + 1 for s in goal)


def test_the_result_comes_from_the_points(spark, monkeypatch):
    docs = spark.createDataFrame(some(random.Random(5)), "doc_id long, text string, source string")
    real = sorted(map(str, op.mix(docs, n_slots=500).collect()))
    monkeypatch.setattr(op, "GOLDEN", 0)  # all slots go to one source
    got = op.mix(docs, n_slots=500).collect()
    assert sorted(map(str, got)) != real and len({r.source_size for r in got if r.taken}) == 1


def test_one_result_over_input_orders(spark):
    rows = some(random.Random(9)) + [(7, f"the same id, text {i}", "hot") for i in range(9)]
    results = []
    for seed in range(5):
        random.Random(seed).shuffle(rows)
        docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(seed + 1)
        results.append(sorted(map(str, op.mix(docs, n_slots=700).collect())))
    assert all(r == results[0] for r in results)


def test_whole_documents_in_the_order_of_the_schedule(spark):
    rnd = random.Random(4)
    rows = [(i, f"d{i} " + "w " * rnd.randint(0, 60), rnd.choice("aaab"), i, "t") for i in range(150)] + [(None, "none here", "b", 1, "t"), (3, "other text", "a", 2, "t")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, _own_slot int, S string")
    got = op.mixed(docs, n_slots=600)
    assert got.columns == docs.columns
    firsts = [(r.position, r.place, r.doc_id) for r in op.schedule(docs, n_slots=600).where("from_word = 0").collect()]
    assert [r.doc_id for r in got.collect()] == [i for *_, i in sorted(firsts)]
    twice = docs.unionByName(docs.where("doc_id < 20"))
    want = Counter(r.doc_id for r in op.schedule(twice, n_slots=600).where("from_word = 0").collect())
    assert Counter(r.doc_id for r in op.mixed(twice, n_slots=600).collect()) == want


def test_every_stretch_of_the_schedule_is_in_proportion(spark):
    docs = spark.createDataFrame([(i, "w " * 50, "ab"[i % 2]) for i in range(400)], "doc_id long, text string, source string")
    rows = op.schedule(docs, n_slots=1000).where("position is not null").select("s", "position").distinct().collect()
    for start in range(0, 900, 100):
        a = sum(1 for r in rows if r.s == "sa" and start <= r.position < start + 100)
        assert abs(a - 100 * 5 / 7) <= 4


def test_empty_table_and_texts_without_words(spark):
    docs = spark.createDataFrame([(1, "a b", "x"), (2, "c", "y"), (None, "d", "z"), (3, None, "z")], "doc_id long, text string, source string")
    assert op.mix(docs.limit(0)).collect() == [] and op.mixed(docs.limit(0)).collect() == []
    assert op.mix(docs.where("doc_id = 3")).collect()[0].taken == 0
    assert all(r.text for r in op.mixed(docs).collect())
