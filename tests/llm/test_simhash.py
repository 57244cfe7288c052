import random

import numpy as np
import pytest
import xxhash

from stratafile.llm import simhash


def slow_fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words, word = [], ""
    for c in low + " ":
        if c in " \t\n\x0b\x0c\r":
            words += [word] if word else []
            word = ""
        else:
            word += c
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def slow_components(rows):
    """rows: (id, fp)"""
    fps = sorted({f for _, f in rows})
    up = {f: f for f in fps}

    def find(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for i, a in enumerate(fps):
        for b in fps[:i]:
            if (a ^ b).bit_count() <= 4:
                up[find(a)] = find(b)
    least = {}
    for d, f in rows:
        if d is not None:
            least[find(f)] = min(d, least.get(find(f), d))
    return {f: least.get(find(f)) for f in fps}


def test_fingerprints():
    rnd = random.Random(1)
    texts = ["", None, " \t\n", "One", "a b", "A b C d", "é É \xa0 x\x1cy z w", "And " * 500] + [" ".join(rnd.choice(["The", "of", "ünd", "a", "x" * 40]) for _ in range(rnd.randint(1, 300))) for _ in range(40)]
    for t in texts:
        assert simhash.fingerprint(t) == slow_fingerprint(t), t


def cloud(rnd, n):
    """Fingerprints with chains and dense groups at and over the budget."""
    out = []
    for _ in range(n):
        base = rnd.getrandbits(64)
        for _ in range(rnd.choice([1, 1, 2, 5, 40])):
            x = base
            for b in rnd.sample(range(64), rnd.randint(0, 7)):
                x ^= 1 << b
            out.append(x)
            base = x if rnd.random() < 0.3 else base
    return sorted(set(out + [0, 1, 2**64 - 1, 2**64 - 2, 2**63]))


@pytest.mark.parametrize("held,few", [(500_000, 16), (7, 1)])
def test_traverse_finds_all_links(monkeypatch, held, few):
    monkeypatch.setattr(simhash, "HELD", held)
    monkeypatch.setattr(simhash, "FEW", few)
    rnd = random.Random(2)
    keys = np.array(cloud(rnd, 60), np.uint64)
    root = simhash.traverse(keys, [(0, np.array([[0, len(keys), 0, len(keys), 0]]))])
    want = slow_components([(i, int(k)) for i, k in enumerate(keys)])
    assert [int(r) for r in root] == [want[int(k)] for k in keys]


def test_arrangements_hold_all_bits_and_blocks_follow_the_number():
    for blocks, tries, width in ((5, 5, 12), (6, 15, 20)):
        found = simhash.arrangements(blocks)
        assert len(found) == tries and all(w >= width and sorted(o + i for o, n in order for i in range(n)) == list(range(64)) for w, order in found)
    assert simhash.blocks_for(10**8) == 5 and simhash.blocks_for(10**9) == 6


@pytest.mark.parametrize("large,blocks", [(100_000, 5), (20, 5), (3, 5), (100_000, 6), (3, 6)])
def test_trie_join_against_brute_force(spark, monkeypatch, large, blocks):
    monkeypatch.setattr(simhash, "LARGE", large)
    rnd = random.Random(3)
    fps = cloud(rnd, 80)
    near = rnd.getrandbits(64)
    fps += [near ^ (i << 20) for i in range(200)]  # one large unit for most blocks
    rows = [(i, f) for i, f in enumerate(rnd.sample(sorted(set(fps)), len(set(fps))))]
    signed = [(f - 2**64 if f >= 2**63 else f,) for _, f in rows]
    links = simhash.trie_links(spark.createDataFrame(signed, "fp long"), blocks)
    found = {r["node"]: r["root"] for r in simhash.components(links, "test-links").collect()}
    want = slow_components(rows)
    groups = lambda of: {tuple(sorted(f for f in (x for _, x in rows) if of(f) == g)) for g in {of(f) for _, f in rows}}
    s = lambda f: f - 2**64 if f >= 2**63 else f
    assert groups(lambda f: found.get(s(f), s(f))) == groups(lambda f: want[f])


def test_query_columns_nulls_and_copies(spark):
    rnd = random.Random(4)
    base = [" ".join(rnd.choice("the of and a to in is it that was".split()) + str(rnd.randint(0, 99)) for _ in range(200)) for _ in range(20)]
    texts = [None, "", " ", "one"] + base + base[:7] + [t.replace(" the", " thee", 1) for t in base[:5]] + ["word " * 20_000]
    rows = [(i, t, "x", "y") for i, t in enumerate(texts)] + [(5, texts[5], "x", "y"), (None, texts[6], "x", "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp string, root string")
    got = simhash.near_duplicates(docs).collect()
    fps = [(r[0], slow_fingerprint(r[1])) for r in rows]
    want = slow_components(fps)
    assert sorted(((r.doc_id, r.fingerprint, r.component_id) for r in got), key=str) == sorted(((d, f"{f:016x}", want[f]) for d, f in fps), key=str)
    assert simhash.near_duplicates(docs.limit(0)).collect() == []
