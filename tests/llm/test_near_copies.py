import random

import numpy as np
import pytest

import corpus_pipeline
from stratafile.llm import near_copies as op
from stratafile.llm.common import table


def slow_set(text, n=5):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").replace("\xa0", "_").split()
    return frozenset(" ".join(words[i : i + n]) for i in range(max(1, len(words) - n + 1))) if words else frozenset()


def slow_components(rows, least=0.8):
    """rows: (id, text) -> the smallest id of each row's component."""
    sets, up = [slow_set(t) for _, t in rows], list(range(len(rows)))

    def find(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a == b or len(a & b) >= least * len(a | b) > 0:
                up[find(i)] = find(j)
    low = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            low[find(i)] = min(d, low.get(find(i), d))
    return [low.get(find(i)) for i in range(len(rows))]


def texts(rnd):
    """Chains and groups of copies with a few words changed, from near to far."""
    out = [None, "", " \n", "one", "One", "a b c d", "A b  c d e", "and " * 300]
    for _ in range(25):
        words = [f"{rnd.choice(['the', 'of', 'und', 'x'])}{rnd.randint(0, 99)}" for _ in range(rnd.choice([8, 60, 200, 3000]))]
        for _ in range(rnd.choice([1, 2, 6])):
            out.append(" ".join(words))
            if rnd.random() < 0.5:
                words = list(words)
            for i in rnd.sample(range(len(words)), rnd.randint(0, max(1, len(words) // 30))):
                words[i] = "new" + str(rnd.randint(0, 99))
    return out


@pytest.mark.parametrize("held", [1_000_000, 400])
def test_components_against_brute_force(spark, monkeypatch, held):
    monkeypatch.setattr(op, "HELD", held)
    found = texts(random.Random(5))
    rows = list(enumerate(found)) + [(9, found[9]), (12, found[30]), (None, found[14]), (None, found[15] + " more")]
    random.Random(6).shuffle(rows)
    got = op.near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(((r.doc_id, r.component_id) for r in got), key=str) == sorted(zip([d for d, _ in rows], slow_components(rows)), key=str)


def test_linked_at_the_limit():
    a, b = np.arange(90, dtype=np.uint64), np.arange(10, 100, dtype=np.uint64)  # 80 of 100
    c = np.arange(11, 101, dtype=np.uint64)  # 79 of 101 with a
    assert op.linked([a, b]).tolist() == [0, 0] and op.linked([a, c]).tolist() == [0, 1]
    assert op.linked([a, c, c + np.uint64(1000)]).tolist() == [0, 1, 2] and op.linked([a, c, b]).tolist() == [0, 0, 0]


def test_the_stage_finds_ordinary_near_copies(spark):
    frame = table(spark, "/root/testdata/sf0.001", "documents")
    rows = [(r.doc_id, r.text) for r in frame.collect()]
    got = {r.doc_id for r in corpus_pipeline.near_dedup(spark, frame, "").collect()}
    assert got == {d for (d, _), c in zip(rows, slow_components(rows)) if c == d}
    assert 1 in got and 177 not in got  # 0.83 of their shingles, 9 bits of their fingerprints


def pairs_at(n, rnd, similar=0.8):
    """Two texts whose sets have n shingles at most and agree to just `similar` or a little more: the first or last words of one are cut off or others."""
    words = [f"w{rnd.randint(0, 10**9)}" for _ in range(n + 4)]
    cut = int(n - similar * n + 1e-9)
    other = words[cut:] if rnd.random() < 0.5 else words[: len(words) - cut]
    return " ".join(words), " ".join(other)


@pytest.mark.parametrize("documents", [10_000, 256_000, 10**9, 10**10])
def test_small_sets_are_found_whatever_the_number_of_documents(spark, monkeypatch, documents):
    """Pairs at exactly 0.8, or as near above as their size allows, under the layouts of small and very large tables; fewer tables stand for those of the large ones, as small sets don't need any."""
    of = op.layout(documents)
    monkeypatch.setattr(op, "layout", lambda n: op.Layout(of.prefix, min(of.tables, 3)))
    rnd = random.Random(documents)
    rows, sizes = [], (5, 6, 8, 10, 13, 15, 20, 25, 30, 40, 50)
    for i, n in enumerate(sizes * 12):
        a, b = pairs_at(n, rnd)
        rows += [(2 * i, a), (2 * i + 1, b)]
    assert all(0.8 <= len(slow_set(a) & slow_set(b)) / len(slow_set(a) | slow_set(b)) < 0.9 for (_, a), (_, b) in zip(rows[::2], rows[1::2]))
    got = {r.doc_id: r.component_id for r in op.near_copies(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    assert got == {d: d // 2 * 2 for d, _ in rows}


@pytest.mark.parametrize("documents, n, least", [(10_000, 60, 0.98), (10_000, 400, 0.995), (10**6, 60, 0.98), (10**9, 400, 0.995)])
def test_recall_of_larger_sets_by_tables(documents, n, least):
    """How many pairs at 0.8 share a unit of some table within its errors and pass the check, by the fingerprints alone."""
    rnd, of, found, trials = random.Random(n), op.layout(documents), 0, 200
    for _ in range(trials):
        a, b = (op.fingerprint(op.shingles(x), of) for x in pairs_at(n, rnd))
        width, ends = of.prefix + op.PATH, of.tables * (of.prefix + op.PATH)
        off = (a != b)[:ends].reshape(of.tables, width)
        near = (off[:, : of.prefix].sum(1) == 0) & (off[:, of.prefix :].sum(1) <= op.ERRORS)
        found += bool(near.any() and (a != b)[ends:].sum() <= op.CHECK_ERRORS)
    print(documents, n, found / trials)
    assert found / trials >= least


def test_a_shingle_that_all_small_sets_share_is_no_unit_of_all(spark):
    rows = [(i, f"this text is licensed to all of you word{i} word{i + 1} word{i + 2} other{i}") for i in range(300)] + [(900, "this text is licensed to all of you"), (901, "this text is licensed to all of you too")]
    signed = op.signatures(spark.createDataFrame(rows, "doc_id long, text string"), op.layout(300))
    units = op.small_units(signed.selectExpr("node", "n", "few")).groupBy("unit").count().collect()
    assert max((r["count"] for r in units), default=0) <= 4
    got = {r.doc_id: r.component_id for r in op.near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [got[d] for d, _ in rows] == slow_components(rows)
