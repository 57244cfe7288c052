import random
import time

import pytest

from stratafile.llm import decontaminate as op


def slow_tile(item, doc, least):
    """The longest match of unmarked words, again and again."""
    used_i, used_d, tiles = set(), set(), []
    while True:
        best = None
        for q in range(len(item)):
            for p in range(len(doc)):
                k = 0
                while q + k < len(item) and p + k < len(doc) and item[q + k] == doc[p + k] and item[q + k] and q + k not in used_i and p + k not in used_d:
                    k += 1
                if k >= least and (best is None or k > best[0]):
                    best = (k, q, p)
        if best is None:
            return tiles
        k, q, p = best
        used_i |= set(range(q, q + k))
        used_d |= set(range(p, p + k))
        tiles.append((q, p, k))


@pytest.mark.parametrize("long", [20, 2])
def test_tiling_against_brute_force(monkeypatch, long):
    monkeypatch.setattr(op, "LONG", long)
    rnd = random.Random(8)
    for _ in range(400):
        kinds = rnd.choice([1, 2, 3, 8])
        item = [rnd.randint(1, kinds) for _ in range(rnd.randint(0, 30))]
        doc = [rnd.randint(0, kinds) for _ in range(rnd.randint(0, 30))]
        for _ in range(rnd.randint(0, 3)):
            if item:
                a = rnd.randrange(len(item))
                doc += item[a : a + rnd.randint(1, 12)] + [0] * rnd.randint(0, 1)
        least = rnd.choice([1, 2, 5])
        got, want = op.tile(item, doc, least), slow_tile(item, doc, least)
        assert got == want, (item, doc, least)


def test_reordered_altered_and_clean_passages(spark):
    rnd = random.Random(9)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(3))
    items = [[word() for _ in range(40)] for _ in range(5)]
    noise = lambda n: [word() for _ in range(n)]
    a = items[0]
    altered = [w if i % 8 else "changed" for i, w in enumerate(items[2])]
    docs = {
        1: noise(50) + a + noise(50), 2: a[20:] + noise(30) + a[10:20] + noise(3) + a[:10], 3: noise(100), 4: a[:15] + noise(200), 5: [w.upper() + "!" for w in items[1]], 6: noise(9) + altered,
        7: items[3] + items[4], 8: a * 300, 9: a[:4] + noise(20), 10: noise(3),
    }
    want = {(1, 0), (2, 0), (5, 1), (6, 2), (7, 3), (7, 4), (8, 0)}
    rows = [(i, " ".join(d), "x", 0.1) for i, d in docs.items()] + [(11, None, "x", 0.1), (12, "", "x", 0.1), (1, " ".join(docs[1]), "x", 0.1), (None, " ".join(a), "x", 0.1)]
    table = spark.createDataFrame(rows, "doc_id long, text string, item_id string, coverage double")
    bench = spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(items)] + [(90, None), (91, ""), (92, "too short here")], "item_id long, text string")
    got = op.contaminated(table, bench).collect()
    assert {(r.doc_id, r.item_id) for r in got} == want | {(None, 0)}
    assert sum(r.doc_id == 1 for r in got) == 2
    two = next(r for r in got if r.doc_id == 2)
    assert two.coverage == 1.0 and sorted(t.length for t in two.tiles) == [10, 10, 20]
    assert {r.doc_id for r in op.clean(table, bench).collect()} == {3, 4, 9, 10, 11, 12}
    assert op.clean(table, bench).columns == table.columns
    assert op.contaminated(table, bench.limit(0)).collect() == [] and op.contaminated(table.limit(0), bench).collect() == []


def test_benchmark_in_blocks(spark, monkeypatch):
    docs, bench = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "benchmark"))
    rows = lambda: sorted((r.doc_id, r.item_id, r.coverage) for r in op.contaminated(docs, bench).collect())
    one, left = rows(), op.clean(docs, bench).count()
    monkeypatch.setattr(op, "BLOCK_BYTES", 3000)
    assert rows() == one and one and op.clean(docs, bench).count() == left == 1000 - len({r[0] for r in one})


def test_matches_against_tiling_every_pair():
    rnd = random.Random(12)
    for _ in range(60):
        kinds = rnd.choice([2, 4, 30])
        word = lambda: f"w{rnd.randint(1, kinds)}"  # noqa: B023, E731
        items = [(i, [word() for _ in range(rnd.choice([1, 2, 3, 4, 5, 6, 9, 20]))]) for i in range(8)]
        block = op.Block([(i, " ".join(x)) for i, x in items])
        for _ in range(6):
            doc = [word() if rnd.random() < 0.8 else "other" for _ in range(rnd.randint(0, 40))]
            for _, x in rnd.sample(items, 2):
                doc[rnd.randint(0, len(doc)) :] += x[: rnd.randint(1, len(x))]
            number = {w: n for n, w in enumerate(dict.fromkeys(w for _, x in items for w in x), 1)}
            want = {}
            for i, x in items:
                tiles = slow_tile([number[w] for w in x], [number.get(w, 0) for w in doc], min(op.SEED, len(x)))
                n = sum(t[2] for t in tiles)
                if tiles and n >= op.THRESHOLD * len(x):
                    want[i] = (n / len(x), n, len(x), tiles)
            assert {m[0]: m[1:] for m in block.matches(" ".join(doc))} == want


def test_short_unspaced_and_repeated_items(spark):
    chinese, thai = "中国的首都是哪一个城市", "เมืองหลวงของประเทศไทย"
    items = [(1, "What is two plus"), (2, chinese), (3, thai), (4, "yes"), (5, None), (6, "?!"), (7, "one two three four five six")] + [(100 + i, "a copy of the same seven words") for i in range(500)]
    docs = {1: "so, what is TWO plus two?", 2: f"他问:{chinese}?对", 3: f"x {thai} y", 4: "what is two", 5: "say yes", 6: "?!", 7: "中国的城市", 8: "here: a copy of the same seven words, again", 9: "one two three four " * 20_000 + "five six"}
    table = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in op.contaminated(table, bench).collect()}
    assert got == {(1, 1), (2, 2), (3, 3), (5, 4), (9, 7)} | {(8, 100 + i) for i in range(500)}
    assert {r.doc_id for r in op.clean(table, bench, least_words=1).collect()} == {4, 6, 7}


def test_long_repetitive_documents_take_time_in_proportion():
    block = op.Block([(1, "la " * 40), (2, " ".join(f"w{i}" for i in range(30)))])
    began = time.perf_counter()
    assert [m[0] for m in block.matches("la " * 20_000)] == [1]
    assert [m[0] for m in block.matches(" ".join(f"w{i % 30}" for i in range(100_000)))] == [2]
    assert time.perf_counter() - began < 10


def test_a_short_item_is_reported_but_drops_nothing(spark):
    from stratafile.llm import decontaminate as op

    docs = spark.createDataFrame([(1, "The cat sat on the mat."), (2, "the whole test passage of the benchmark stands here"), (None, "The end"), (4, None)], "doc_id long, text string")
    items = spark.createDataFrame([(1, "The"), (2, "whole test passage of the benchmark"), (3, "the end")], "item_id long, text string")
    assert {r.doc_id for r in op.clean(docs, items).collect()} == {1, None, 4} and op.clean(docs, items).count() == 3
    assert op.clean(docs, items, least_words=1).count() == 1
    assert {(r.doc_id, r.item_id) for r in op.contaminated(docs, items).collect()} == {(1, 1), (2, 1), (2, 2), (None, 1), (None, 3)}
