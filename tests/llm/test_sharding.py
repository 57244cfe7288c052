import math
import random
import zlib
from collections import defaultdict

import pytest

from stratafile.llm import sharding as op


def table(spark, rows):
    return spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, source string, lang string, size int, shard string")


@pytest.mark.parametrize("shards", [1, 3, 40])
def test_law_of_bytes_slots_and_groups(spark, shards):
    rnd = random.Random(6)
    rows = [(i, rnd.choice("abé") * rnd.randint(0, 900) + str(i), rnd.choice(["hot", "hot", "s1", "s2", None]), rnd.choice(["en", "de", None])) for i in range(3000)]
    rows += [(4000 + i, "small copy", f"s{i}", "en") for i in range(5)] + [(5000 + i, "large copy " * 30, f"s{i % 7}", "fr") for i in range(300)] + [(9000, None, None, None), (9001, "", "a", "b"), (None, "n", "a", "b"), (7, rows[7][1], rows[7][2], rows[7][3])]
    got = op.shard(table(spark, rows), shards).collect()
    size = lambda t: len((t or "").encode()) + 16
    assert sorted(((r.doc_id, r.size, r.text_crc32) for r in got), key=str) == sorted(((i, size(t), zlib.crc32((t or "").encode())) for i, t, *_ in rows), key=str)
    bytes_, slots = defaultdict(int), defaultdict(list)
    for r in got:
        bytes_[r.shard] += r.size
        slots[r.shard].append(r.slot)
    mean = sum(bytes_.values()) / shards
    assert set(bytes_) == set(range(shards)) and all(abs(b - mean) <= 0.06 * mean for b in bytes_.values()), bytes_
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    small = {r.shard for r in got if r.doc_id is not None and 4000 <= r.doc_id < 4005}
    assert len(small) == 1 and len({r.shard for r in got if r.doc_id in (9000, 9001)}) == 1


def test_reruns_agree_and_small_tables(spark):
    rows = [(i, "t" * i, "s", "en") for i in range(30)]
    one, two = ({(r.doc_id, r.shard) for r in op.shard(table(spark, rows).repartition(n), 4).collect()} for n in (1, 5))
    assert one == two
    assert op.shard(table(spark, rows).limit(0), 4).collect() == []
    assert len(op.shard(table(spark, rows[:2]), 40).collect()) == 2
    assert len(op.shard(table(spark, [rows[5]] * 20), 4).collect()) == 20


def test_groups_below_a_shard_stay_whole(spark):
    rnd = random.Random(7)
    rows = [(i, "b" * 184 + f"{i:06}", f"s{rnd.randint(0, 9)}", "en") for i in range(4000)]
    # groups of 2 to 90 % of a shard, all over the other rows
    rows += [(10_000 + 200 * g + i, "c" * 184 + f"{g:06}", f"s{g % 10}", "en") for g in range(60) for i in range(rnd.choice([3, 6, 20, 60, 150]))]
    got = op.shard(table(spark, rows), 30).collect()
    bytes_, where = defaultdict(int), defaultdict(set)
    for r in got:
        bytes_[r.shard] += r.size
        if r.doc_id >= 10_000:
            where[r.doc_id // 200].add(r.shard)
    mean = sum(bytes_.values()) / 30
    assert len(where) == 60 and all(len(s) == 1 for s in where.values())
    assert len(bytes_) == 30 and all(abs(b - mean) <= 0.04 * mean for b in bytes_.values()), bytes_


def brute(rows, shards):
    """{(doc_id, text): shard} by cutting sorted lists of rows: the weighted quantile along the widest dimension, equal texts by the coordinates of the first."""
    size = lambda t: len(t.encode()) + 16
    total, members = sum(size(r[1]) for r in rows), defaultdict(list)
    for r in rows:
        members[r[1]].append(r)
    places = [{v: i for i, v in enumerate(sorted({r[c] for r in rows}, key=lambda v: (v is not None, v)))} for c in (2, 3)]
    ids = [r[0] for r in rows]
    spread = lambda v, lo, hi: int((v - lo) / (hi - lo) * 2**30) if hi > lo else 0
    small, large = (math.log2(f(size(r[1]) for r in rows)) for f in (min, max))
    units = []
    for text, own in members.items():
        i, _, s, lang = min(own, key=lambda r: r[0])
        at = (spread(places[0][s], 0, len(places[0]) - 1), spread(places[1][lang], 0, len(places[1]) - 1), spread(math.log2(size(text)), small, large), spread(i, min(ids), max(ids)))
        units.append((text, at, len(own) * size(text), len(own) > 1 and len(own) * size(text) > op.HEAVY * total / shards))
    out = {}

    def cut(first, k, light, heavy):
        if k == 1:
            out.update({u[0]: first for u in light + heavy})
            return
        wide = [max(u[1][d] for u in light) - min(u[1][d] for u in light) for d in range(4)]
        d, half = wide.index(max(wide)), k // 2
        light, heavy = sorted(light, key=lambda u: u[1][d]), sorted(heavy, key=lambda u: u[1][d])
        assert len({u[1][d] for u in light}) == len(light)  # the fixture has no ties here, so that hashes don't matter
        whole = sum(u[2] for u in heavy)
        j = min(range(len(heavy) + 1), key=lambda j: (abs(sum(u[2] for u in heavy[:j]) - whole * half / k), j))
        goal = (sum(u[2] for u in light) + whole) * half / k - sum(u[2] for u in heavy[:j])
        run = m = 0
        while run + light[m][2] < goal:
            run += light[m][2]
            m += 1
        m += run + light[m][2] - goal <= goal - run
        cut(first, half, light[:m], heavy[:j])
        cut(first + half, k - half, light[m:], heavy[j:])

    cut(0, shards, [u for u in units if not u[3]], [u for u in units if u[3]])
    return out


def test_against_cutting_sorted_lists(spark):
    rnd = random.Random(3)
    rows = [(i, "x" * n + f"{i:03}", "only", "en") for i, n in enumerate(rnd.sample(range(10, 4000), 500))]
    rows += [(600 + 10 * g + i, f"copy {g} " * (900 + 7 * g) + "..", "only", "en") for g in range(12) for i in range(2 + g % 4)]
    # no two light rows share a coordinate: ids and lengths differ
    for shards in (2, 5, 16):
        got = {(r.size, r.text_crc32): r.shard for r in op.shard(table(spark, rows), shards, exact=0.0).collect()}
        want = brute(rows, shards)
        assert got == {(len(t.encode()) + 16, zlib.crc32(t.encode())): s for t, s in want.items()}
