"""Duplicates in stages, hashes by many tasks, duplicate folders, moved files, all batches: against plain walks."""

import hashlib
import os
import random
from collections import Counter, defaultdict
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from stratafile.api import Catalogue
from stratafile.functions import hashing
from stratafile.operators import folders, moves, order, staged
from stratafile.plans import batches
from stratafile.sources import fixtures as fx

SF = "/root/testdata/sf0.001"


# duplicates in stages


@pytest.fixture
def drive(spark, tmp_path):
    """A catalogue over files of equal sizes, equal ends, equal contents, and of none of these."""
    rnd = random.Random(1)
    d = tmp_path / "drive"
    d.mkdir()
    head, tail = rnd.randbytes(100_000), rnd.randbytes(100_000)
    (d / "one").write_bytes(head + b"1" * 1000 + tail)
    (d / "two").write_bytes(head + b"1" * 1000 + tail)
    (d / "ends").write_bytes(head + b"2" * 1000 + tail)
    (d / "size").write_bytes(rnd.randbytes(201_000))
    (d / "alone").write_bytes(rnd.randbytes(300_001))
    for name in ("e1", "e2", "e3"):
        (d / name).write_bytes(b"")
    (d / "s1").write_bytes(b"small")
    (d / "s2").write_bytes(b"small")
    (d / "s3").write_bytes(b"other")
    c = Catalogue(spark, str(tmp_path / "catalogue"))
    c.drive_add("d", str(d))
    return c, d


def members(c):
    names = defaultdict(list)
    for r in c.files.where("duplicate_group is not null").collect():
        names[r.duplicate_group].append(r.path)
    return sorted(sorted(v) for v in names.values())


def test_stages_give_the_groups_of_whole_hashing_and_read_less(drive):
    c, d = drive
    c.dedup_refresh()
    whole = members(c)
    assert whole == [["e1", "e2", "e3"], ["one", "two"], ["s1", "s2"]]
    c.dedup_refresh(in_stages=True, rehash=True)
    assert members(c) == whole
    hashed = {r.path for r in c.files.where("blake3_hash is not null").collect()}
    assert hashed == {"one", "two", "ends", "e1", "e2", "e3", "s1", "s2"}
    assert c.duplicates_differing().count() == 0
    # what was read: two blocks of each file that shares a size, whole files only where the ends agree
    files = c.files.withColumn("blake3_hash", F.lit(None).cast("string"))
    got = staged.staged(files, "blake3_hash", hashing.hash_ends, lambda f: hashing.with_missing_hashes(f, "blake3"))
    assert {r.stage: (r.files, r.read_bytes) for r in got.counts().collect()} == {"size": (10, 0), "ends": (10, 4 * 2 * hashing.ENDS + 3 * 5), "hash": (8, 3 * 201_000 + 2 * 5)}


def test_files_that_no_stage_lets_through_are_not_opened(drive, spark):
    c, d = drive
    c.scan()
    os.remove(d / "alone")  # would be an error if it were read
    os.remove(d / "size")  # is read for its ends, and can't be
    files = c.files
    got = staged.staged(files, "blake3_hash", hashing.hash_ends, lambda f: hashing.with_missing_hashes(f, "blake3"))
    assert {r.path: r.ends for r in got.by_ends.collect()}["size"] is None and "alone" not in {r.path for r in got.by_ends.collect()}
    assert {r.path for r in got.by_hash.collect()} == {"one", "two", "ends", "e1", "e2", "e3", "s1", "s2"}


def test_files_with_a_hash_are_not_hashed_again_but_have_copies(drive):
    c, d = drive
    c.scan()
    c.store.update("files", lambda f: f.withColumn("blake3_hash", F.when(F.col("path") == "one", hashing.hash_file(str(d / "one"), "blake3"))))
    c.dedup_refresh(in_stages=True, scan=False)
    assert ["one", "two"] in members(c)
    (d / "two").write_bytes(b"x" * 201_000)
    assert [(r.abs_path, r.same) for r in c.duplicates_differing().collect() if "two" in r.abs_path or "one" in r.abs_path] != []


# BLAKE3 by parts


@pytest.mark.parametrize("part", [1, 2, 8, 64])
def test_parts_give_the_hash_of_the_whole(spark, tmp_path, monkeypatch, part):
    monkeypatch.setattr(hashing, "FAN", 4)
    rnd = random.Random(part)
    sizes = [0, 1, 1023, 1024, 1025, 2048, 2049, 4096, 5000, 16_384, 16_385, 70_001, 200_000, 1_048_577]
    data = {i: rnd.randbytes(n) for i, n in enumerate(sizes)}
    for i, x in data.items():
        (tmp_path / str(i)).write_bytes(x)
    rows = spark.createDataFrame([(i, str(tmp_path / str(i)), len(x)) for i, x in data.items()] + [(90, str(tmp_path / "none"), 5000), (91, str(tmp_path / "6"), 9_999)], "id long, abs_path string, size_bytes long")
    want = {i: hashing.digest(x, "blake3") for i, x in data.items()}
    got = {r.id: r.hash for r in hashing.hash_large(rows, part).collect()}
    assert got == want | {90: None, 91: None}
    texts = spark.createDataFrame([(i, bytearray(x)) for i, x in data.items()] + [(99, None)], "id long, text binary")
    assert {r.id: r.hash for r in hashing.blake3_of_texts(texts, "id", "text", part).collect()} == want | {99: None}


def test_a_large_file_is_many_tasks(spark, tmp_path, monkeypatch):
    n = 100 << 20
    block = random.Random(7).randbytes(1 << 20)
    with open(tmp_path / "big", "wb") as f:
        for i in range(n >> 20):
            f.write(block[i:] + block[:i])
    rows = spark.createDataFrame([(1, str(tmp_path / "big"), n)], "id long, abs_path string, size_bytes long")
    assert hashing.hash_large(rows, 1 << 13).first().hash == hashing.hash_file(str(tmp_path / "big"), "blake3")
    monkeypatch.setattr(hashing, "LARGE", 1 << 20)
    files = rows.selectExpr("id", "abs_path", "size_bytes", "false is_symlink", "cast(null as string) blake3_hash", "cast(null as string) md5_hash")
    assert hashing.with_missing_hashes(files, "blake3").first().blake3_hash == hashing.hash_file(str(tmp_path / "big"), "blake3")


def test_many_inputs_at_once():
    data = [random.Random(n).randbytes(n) for n in (0, 1, 64, 1023, 1024, 1025, 3000, 40_000, (1 << 20) + 5, 3 << 20, 0)]
    assert hashing.blake3_of(data) == [hashing.digest(x, "blake3") for x in data] and hashing.blake3_of([]) == []


# duplicate folders


def plain_folders(files, min_files=1):
    """(folder -> copies, nested) by recursion; files: {path: hash}."""
    below = defaultdict(set)
    for path in files:
        at = path
        while at:
            up = at.rpartition("/")[0]
            below[up].add(at)
            at = up

    def bag(path):
        if path in files:
            return files[path]
        inside = [bag(x) for x in below[path]]
        return None if None in inside else tuple(sorted(map(repr, inside)))

    bags = {p: bag(p) for p in below}
    size = {p: sum(1 for f in files if p == "" or f.startswith(p + "/")) for p in below}
    copies = Counter(b for p, b in bags.items() if b is not None and size[p] >= min_files)
    twice = {p for p, b in bags.items() if b is not None and copies[b] > 1 and size[p] >= min_files}
    nested = {p: p != "" and p.rpartition("/")[0] in twice for p in twice}
    shown = {bags[p] for p in twice if not nested[p]}
    return {(p, copies[bags[p]], nested[p], size[p]) for p in twice if bags[p] in shown}


@pytest.mark.parametrize("seed", range(4))
def test_folders_of_random_trees(spark, seed):
    rnd = random.Random(seed)
    files = {}
    for _ in range(60):
        path = "/".join(rnd.choice("ab") for _ in range(rnd.randint(0, 4))) + f"/f{rnd.randint(0, 5)}"
        files[path.lstrip("/")] = rnd.choice(["h1", "h2", "h3", "H3", None] if seed else ["h1", "h2"])
    files = {p: h for p, h in files.items() if not any(q.startswith(p + "/") for q in files)}
    files = {p: h and h.lower() for p, h in files.items()}
    rows = [(1, p, 3, h) for p, h in files.items()]
    frame = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)] + [(900, 1, None, 1, "x"), (901, 1, "", 1, "x")], "id long, drive_id long, path string, size_bytes long, blake3_hash string")
    for least in (1, 3):
        got = {(r.path, r.copies, r.nested, r.files) for r in folders.duplicate_folders(frame, min_files=least).collect()}
        assert got == plain_folders(files, least)


def test_folders_across_drives_and_their_files(spark):
    rows = [(1, 1, "x/a/f", 5, "h"), (2, 1, "x/b/g", 6, "i"), (3, 2, "y/b/other", 6, "i"), (4, 2, "y/a/name", 5, "h"), (5, 2, "z/f", 5, "h"), (6, 2, "q/f", 1, None)]
    frame = spark.createDataFrame(rows, "id long, drive_id long, path string, size_bytes long, blake3_hash string")
    found = folders.duplicate_folders(frame)
    assert {(r.drive_id, r.path, r.copies, r.nested, r.bytes) for r in found.collect()} == {(1, "x", 2, False, 11), (2, "y", 2, False, 11), (1, "x/a", 3, True, 5), (2, "y/a", 3, True, 5), (2, "z", 3, False, 5)} | {(1, "", 2, False, 11)} - {(1, "", 2, False, 11)}
    assert {(r.id, r.folder) for r in folders.folder_of_files(frame, found).collect()} == {(1, "x"), (2, "x"), (3, "y"), (4, "y"), (5, "z")}
    assert folders.duplicate_folders(frame.limit(0)).count() == 0


# moved files


def plain_moves(old, new):
    """The pairs by loops over dictionaries."""
    out, o, n = {}, {r["id"]: r for r in old}, {r["id"]: r for r in new}
    whole = ("drive_id", "path", "inode", "size_bytes", "modified_at")
    for way, keys in (("same", whole), *moves.WAYS):
        rows = [defaultdict(list), defaultdict(list)]
        for side, table in enumerate((o, n)):
            for r in sorted(table.values(), key=lambda r: (r["path"], r["id"])):
                key = tuple(r[k] for k in keys)
                if None not in key or way == "same":
                    rows[side][key].append(r["id"])
        for key in rows[0]:
            for a, b in zip(rows[0][key], rows[1].get(key, [])):
                out[a] = (b, way)
                del o[a], n[b]
    return {(a, b, way) for a, (b, way) in out.items()}


@pytest.mark.parametrize("seed, pieces", [(0, None), (1, 5), (2, 3)])
def test_moves_against_loops(spark, seed, pieces):
    rnd = random.Random(seed)
    row = lambda i, path: {"id": i, "drive_id": rnd.randint(1, 2), "path": path, "filename": rnd.choice("abc"), "device_num": 1, "inode": rnd.choice([None, *range(30)]), "size_bytes": rnd.randint(0, 2), "modified_at": datetime(2024, 1, rnd.randint(1, 2)), "hash": rnd.choice([None, "h", "i", "h", "h"])}
    old, new = ([row(base + i, f"p{i}") for i in rnd.sample(range(90), 70)] for base in (0, 1000))
    names = "id long, drive_id long, path string, filename string, device_num long, inode long, size_bytes long, modified_at timestamp, hash string"
    frames = [spark.createDataFrame([tuple(r.values()) for r in t], names).repartition(4) for t in (old, new)]
    got = {tuple(r) for r in moves.matched(*frames, pieces).collect()}
    assert got == plain_moves(old, new) and len({x[0] for x in got}) == len({x[1] for x in got}) == len(got)


def test_ids_survive_moves_and_swaps(spark, tmp_path):
    d = tmp_path / "d"
    (d / "sub").mkdir(parents=True)
    for i, name in enumerate(["keep", "rename", "swap1", "swap2", "over", "away", "edit"]):
        (d / name).write_text(name * (i + 1))
        os.utime(d / name, (1_600_000_000 + i, 1_600_000_000 + i))
    c = Catalogue(spark, str(tmp_path / "catalogue"))
    c.drive_add("d", str(d))
    c.scan("d")
    ids = {r.path: r.id for r in c.files.collect()}
    c.classify(",".join(map(str, ids.values())), "docs")
    (d / "rename").rename(d / "sub" / "renamed")
    (d / "swap1").rename(d / "t")
    (d / "swap2").rename(d / "swap1")
    (d / "t").rename(d / "swap2")
    (d / "away").rename(d / "over")  # takes a name that another file had
    (d / "edit").write_text("edited in place")
    (d / "new").write_text("brand new and long enough")
    c.scan("d", tombstones=True, follow_moves=True)
    after = {r.path: r for r in c.files.collect()}
    assert {p: after[p].id for p in ("keep", "sub/renamed", "swap1", "swap2", "over", "edit")} == {"keep": ids["keep"], "sub/renamed": ids["rename"], "swap1": ids["swap2"], "swap2": ids["swap1"], "over": ids["away"], "edit": ids["edit"]}
    assert {after[p].category for p in ("sub/renamed", "swap1", "over")} == {"docs"} and after["new"].category is None and after["sub/renamed"].filename == "renamed"
    assert set(after) == {"keep", "sub/renamed", "swap1", "swap2", "over", "edit", "new"} and len({r.id for r in after.values()}) == 7 and c.validate().count() == 0


# all batches


def plain_batches(sizes, most):
    out, batch, total = [], -1, None
    for s in sizes:
        if total is None or total + s > most:
            batch, total = batch + 1, 0
        total += s
        out.append(batch)
    return out


@pytest.mark.parametrize("most, one_task", [(0, 10**6), (10, 10**6), (37, 50), (1000, 50), (10**9, 50), (25, 60)])
def test_batches_against_a_walk(spark, monkeypatch, most, one_task):
    monkeypatch.setattr(order, "ONE_TASK", one_task)
    monkeypatch.setattr(order, "PIECE", 40)
    rnd = random.Random(most)
    sizes = [rnd.choice([0, 0, 1, 5, 9, 40]) for _ in range(300)]
    frame = spark.createDataFrame([(i, s if i % 50 else None) for i, s in enumerate(sizes)], "id long, size_bytes long").repartition(6)
    want = plain_batches([s if i % 50 else 0 for i, s in enumerate(sizes)], most)
    assert [r.batch for r in batches.all_batches(frame, most).orderBy("id").collect()] == want


def test_batches_of_nothing_and_of_ties(spark):
    none = spark.createDataFrame([], "id long, size_bytes long")
    assert batches.all_batches(none, 5).count() == 0
    ties = spark.createDataFrame([(1, 3, "b"), (1, 4, "a"), (0, 3, "z")], "id long, size_bytes long, name string")
    assert [(r.name, r.batch) for r in batches.all_batches(ties, 7, ties=["name"]).orderBy("id", "name").collect()] == [("z", 0), ("a", 0), ("b", 1)]
    assert hashlib.md5(b"").hexdigest() and fx.tree(spark, SF).count() > 300


@pytest.mark.parametrize("one_task", [10**6, 500])
def test_batches_take_no_frame_for_each_row(spark, monkeypatch, one_task):
    """A frame that begins with the current row is read anew for each row, 2 * n * n rows in all."""
    frames = []
    monkeypatch.setattr(order, "ONE_TASK", one_task)
    monkeypatch.setattr(order, "PIECE", 1000)
    spec = type(batches.Window.orderBy("x"))
    plain = spec.rowsBetween
    monkeypatch.setattr(spec, "rowsBetween", lambda self, start, end: frames.append((start, end)) or plain(self, start, end))
    sizes = [(i * 7919) % 1000 for i in range(2000)]
    frame = spark.range(2000).selectExpr("id", "id * 7919 % 1000 AS size_bytes")
    got = batches.all_batches(frame, 20_000).groupBy("batch").count().orderBy("batch").collect()
    want = plain_batches(sizes, 20_000)
    assert [r["count"] for r in got] == [want.count(k) for k in range(want[-1] + 1)]
    assert frames and all(start <= batches.Window.unboundedPreceding and end <= 0 for start, end in frames)


def test_plan_batches_hands_on_ids_and_sizes_only(spark, monkeypatch):
    """Paths and hashes of the catalogue are not carried through the orders and joins."""
    from stratafile.catalogue_queries import kept_catalogue

    seen, plain = [], batches.all_batches
    monkeypatch.setattr(batches, "all_batches", lambda files, most: seen.append(files.columns) or plain(files, most))
    rows = kept_catalogue(spark, SF).plan_batches("photos", 20_000).collect()
    assert seen == [["id", "size_bytes"]] and [r.batch for r in rows] == list(range(len(rows))) and all(r.bytes <= 20_000 or r.files == 1 for r in rows)


# substring searches by trigrams


def test_index_gives_the_rows_of_a_scan_and_prunes(spark, tmp_path):
    from stratafile.functions.formats import contains_like
    from stratafile.operators import trigrams

    rnd = random.Random(3)
    names = ["Äpfel", "report", "REPORT final", "a_b", "100%", "日本語テキスト", "x", "", "photo", "IMG"]
    rows = [(i, "/".join(rnd.choice(names) for _ in range(rnd.randint(1, 5))) + f"/{i}.txt") for i in range(400)] + [(500, None), (501, "ab"), (501, "rare needle here"), (None, "rare needle too")]
    table = spark.createDataFrame(rows, "id long, path string").repartition(3)
    at = str(tmp_path / "index")
    trigrams.build(table, "path", at)
    for pattern in ("needle", "NEEDLE", "rare%too", "r_re n", "äpfel", "テキスト", "100%", "ab", "", "%", "report/x", "nowhere at all", ".txt", "_7.t", "a_b/x", "/39"):
        scan = sorted(str(tuple(r)) for r in table.where(contains_like(F.col("path"), pattern)).where("id is not null").collect())
        assert sorted(str(tuple(r)) for r in trigrams.search(table, "path", at, pattern).where("id is not null").collect()) == scan, pattern
    assert trigrams.candidates(spark, at, "ab") is None and trigrams.candidates(spark, at, ".txt") is None  # too short, too frequent
    assert {r.id for r in trigrams.candidates(spark, at, "needle").collect()} == {501, None}
    plan = trigrams.candidates(spark, at, "needle")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan.replace("PartitionFilters: [bucket", "PartitionFilters: [isnotnull(bucket") and "In(gram" in plan


def test_catalogue_searches_by_its_index(spark, tmp_path):
    c = Catalogue(spark, str(tmp_path / "c"))
    c.store.write("files", fx.files(spark, SF))
    scan = {r.id for r in c.query_files(path_contains="docs/1").collect()}
    c.index_paths()
    assert {r.id for r in c.query_files(path_contains="docs/1").collect()} == scan and scan


# many rules


def test_many_rules_are_classified_as_few(spark, monkeypatch):
    from stratafile.operators import many_rules, rules

    rnd = random.Random(5)
    globs = ["**/tmp/**", "*.bak", "**/docs/{a,b}*/[0-9]*", "[!a-c]*", "en/**/1?.txt", "a{x,y/z}b*", "*", "lit\\*eral*", "**", "x/**", "de/docs/7.pdf", "**/*1*2*", "{", "**/deep/**/end?.log"]
    made = []
    for i in range(140):
        kind = rnd.choice(rules.TYPES)
        more = {"pattern": lambda: {"patterns": rnd.sample([g for g in globs if g != "{"], rnd.randint(0, 3)) + [f"**/{i}*"]}, "extension": lambda: {"extensions": rnd.sample(["txt", "JPG", "log", "mp4"], 2)}, "size": lambda: {"min_bytes": rnd.choice([None, 100, 2000]), "max_bytes": rnd.choice([None, 900, 5000])},
                "age": lambda: {"older_than_days": rnd.choice([None, 50, 500]), "newer_than_days": rnd.choice([None, 700, 90])}, "duplicate": lambda: {"keep_strategy": rnd.choice(["keep_oldest", "keeporiginal"])}}[kind]()
        made.append(rules.Rule(f"r{i}", kind, f"c{i}", subcategory=rnd.choice([None, "s"]), subcategory_from_exif=rnd.choice([None, "{exif_year}/{exif_make}"]), priority=rnd.choice([None, "low", "odd"]), rule_priority=rnd.randint(0, 9), **more))
    row = lambda i: (i, rnd.choice([None, "en/docs/1", "en/tmp/x.bak", "a/docs/ab/7", "axb", "ay/zbq", "lit*eral", "x/y\nz", "de/docs/7.pdf", "p/deep/q/r/end1.log", f"q/{i}zz"]), rnd.choice([None, "/mnt/tmp/f", "/z/x/1a2"]), rnd.choice([None, "txt", "jpg", "LOG", "zip"]), rnd.choice([None, 0, 100, 950, 3000]), rnd.choice([None, datetime(2025, 11, 1), datetime(2024, 1, 1)]), rnd.choice([None, 4]), rnd.random() < 0.5)
    files = spark.createDataFrame([row(i) for i in range(400)], "id long, path string, abs_path string, extension string, size_bytes long, modified_at timestamp, duplicate_group long, is_original boolean").repartition(4)
    exif = spark.createDataFrame([("/mnt/tmp/f", "2021", None, None, None, None)], "abs_path string, year string, month string, day string, make string, model string")
    as_of = F.lit(fx.AS_OF).cast("timestamp")
    for n, with_exif, copies in ((12, exif, True), (140, None, False), (140, exif, True)):
        some = rnd.sample(made, n)
        monkeypatch.setattr(rules, "MANY", 1000)
        few = sorted(str((r.id, r.match)) for r in rules.classify(files, some, as_of, with_exif, copies).collect())
        monkeypatch.setattr(rules, "MANY", 0)
        assert sorted(str((r.id, r.match)) for r in rules.classify(files, some, as_of, with_exif, copies).collect()) == few
    assert {g: many_rules.literal(g) for g in globs[:8]} == {"**/tmp/**": "tmp", "*.bak": ".bak", "**/docs/{a,b}*/[0-9]*": "docs", "[!a-c]*": "", "en/**/1?.txt": ".txt", "a{x,y/z}b*": "a", "*": "", "lit\\*eral*": "lit*eral"}


def test_a_thousand_rules(spark):
    from stratafile.operators import rules

    many = [rules.Rule(f"r{k}", "pattern", f"c{k}", patterns=[f"**/{k}/*.dat", f"**/*-{k}.txt"]) for k in range(1000)]
    files = spark.createDataFrame([(i, f"a/{i}/x.dat" if i % 2 else f"b/n-{i}.txt", None, "dat", 1, None, None, False) for i in range(1200)], "id long, path string, abs_path string, extension string, size_bytes long, modified_at timestamp, duplicate_group long, is_original boolean")
    got = rules.classify(files, many, F.lit(fx.AS_OF).cast("timestamp"))
    assert {r.id: r.match and r.match.category for r in got.collect()} == {i: f"c{i}" if i < 1000 else None for i in range(1200)}
    assert len(got._jdf.queryExecution().executedPlan().toString()) < 20_000


# media types


def zip_of(*names, body=b"x", streamed=False):
    out = b""
    for n in names:
        data = body if n != "mimetype" else b"application/epub+zip"
        size = 0 if streamed else len(data)
        out += b"PK\x03\x04" + b"\0" * 14 + size.to_bytes(4, "little") * 2 + len(n).to_bytes(2, "little") + b"\0\0" + n.encode() + data
    return out


HEADS = {
    b"": "inode/x-empty", b"\x89PNG\r\n\x1a\nrest": "image/png", b"\xff\xd8\xff\xe0": "image/jpeg", b"RIFF\x01\x02\x03\x04WEBPVP8 ": "image/webp", b"RIFF\x09\x02\x03\x04WAVEfmt ": "audio/x-wav", b"RIFF\x09\x02\x03\x04ODD ": "application/octet-stream",
    b"\0\0\0\x18ftypheic": "image/heic", b"\0\0\0\x18ftypisom": "video/mp4", b"\0\0\0\x18ftypqt  ": "video/quicktime", b"\x1aE\xdf\xa3" + b"webm": "video/webm", b"%PDF-1.7": "application/pdf", b"\0" * 257 + b"ustar\0": "application/x-tar",
    zip_of("mimetype", "META-INF/container.xml"): "application/epub+zip", zip_of("[Content_Types].xml", "word/document.xml"): "application/vnd.openxmlformats-officedocument.wordprocessingml.document", zip_of("a.txt"): "application/zip",
    zip_of("_rels/.rels", "xl/workbook.xml", streamed=True): "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet", b" \n<!DOCTYPE html><p>": "text/html", b"<?xml version='1.0'?><a/>": "text/xml", b"<?xml version='1.0'?><svg/>": "image/svg+xml",
    b"BM is a text": "text/plain", b"MZ\x90\0\x03": "application/x-dosexec", b"plain \xc3\xa9": "text/plain", b"broken \xff\xfd": "application/octet-stream", b"nul\0": "application/octet-stream", b"#!/bin/sh": "text/x-script", b"PK": "text/plain",
}


@pytest.mark.parametrize("head", HEADS, ids=lambda h: HEADS[h])
def test_media_types_by_content(head):
    from stratafile.functions.mime import mime_of

    assert mime_of(head) == HEADS[head]


def test_a_cut_character_is_text_and_the_column_is_filled_by_a_scan(spark, tmp_path):
    from stratafile.functions import mime

    assert mime.mime_of("é".encode()[:1], cut=True) == "text/plain" and mime.mime_of("é".encode()[:1]) == "application/octet-stream"
    assert mime.mime_of(("x" * 4095 + "é").encode()[:4096], cut=True) == "text/plain"
    d = tmp_path / "d"
    d.mkdir()
    (d / "p.bin").write_bytes(b"\x89PNG\r\n\x1a\n" + b"0" * 9000)
    (d / "t").write_text("é" * 5000)
    (d / "l").symlink_to("t")
    c = Catalogue(spark, str(tmp_path / "c"))
    c.drive_add("d", str(d))
    c.scan("d", mime_types=True)
    assert {r.path: r.mime_type for r in c.files.collect()} == {"p.bin": "image/png", "t": "text/plain", "l": None}
    c.scan("d")
    assert {r.path: r.mime_type for r in c.files.collect()}["p.bin"] == "image/png"
    col = spark.createDataFrame([("<html>",), ("",), (None,), ("x" * 10_000,)], "t string").select(mime.mime_type(F.col("t")).alias("m"))
    assert [r.m for r in col.collect()] == ["text/html", "inode/x-empty", None, "text/plain"]


# incremental scans


def walk(root, hidden=False):
    out = {}
    for at, _, names in os.walk(root):
        for n in names:
            full = os.path.join(at, n)
            if hidden or not n.startswith("."):
                out[os.path.relpath(full, root)] = (os.lstat(full).st_size if not os.path.islink(full) else 0, os.path.islink(full))
    return out


def settle(root):
    """Sets the folders' times back, as if the last change was long ago."""
    for at, _, _ in os.walk(root):
        os.utime(at, (1_600_000_000, 1_600_000_000 + os.stat(at).st_ino % 1000))


def change(rnd, root):
    folders = [at for at, _, _ in os.walk(root)]
    files = [os.path.join(at, n) for at, _, names in os.walk(root) for n in names]
    what = rnd.choice(["new", "edit", "delete", "rename", "folder", "rmtree", "movetree", "link"])
    name = f"n{rnd.randint(0, 10**6)}"
    if what == "new" or not files:
        open(os.path.join(rnd.choice(folders), name), "w").write("x" * rnd.randint(0, 9))
    elif what == "edit":
        open(rnd.choice(files), "a").write("more") if not os.path.islink(f := rnd.choice(files)) else os.remove(f)
    elif what == "delete":
        os.remove(rnd.choice(files))
    elif what == "rename":
        os.rename(rnd.choice(files), os.path.join(rnd.choice(folders), name))
    elif what == "folder":
        deep = os.path.join(rnd.choice(folders), name, "deep")
        os.makedirs(deep)
        open(os.path.join(deep, "f"), "w").write("new")
    elif what == "link":
        os.symlink("nowhere", os.path.join(rnd.choice(folders), name))
    elif len(folders) > 3:
        victim = rnd.choice(folders[1:])
        if what == "rmtree":
            import shutil

            shutil.rmtree(victim)
        elif not any(f.startswith(victim) for f in [root]):
            os.rename(victim, os.path.join(root, name))


@pytest.mark.parametrize("seed", range(3))
def test_rescans_give_the_tree_of_a_full_walk(spark, tmp_path, seed):
    from stratafile.scratch import written
    from stratafile.sources import incremental as inc

    rnd, root = random.Random(seed), str(tmp_path / "root")
    for i in range(25):
        d = os.path.join(root, *[rnd.choice("abc") for _ in range(rnd.randint(0, 4))])
        os.makedirs(d, exist_ok=True)
        if not os.path.isdir(os.path.join(d, f"f{i}")):
            open(os.path.join(d, f"f{i}"), "w").write("y" * i)
    tree = lambda files: {r.path: (r.size_bytes, r.is_symlink) for r in files.collect()}
    settle(root)
    files, shot, errors = (written(x, "t") for x in inc.first_scan(spark, root))
    assert tree(files) == walk(root) and errors.count() == 0 and files.count() == len(walk(root))
    for _ in range(3):
        for _ in range(rnd.randint(0, 4)):
            change(rnd, root)
        files, shot, errors = (written(x, "t") for x in inc.rescan(spark, root, shot, files))
        assert tree(files) == walk(root) and files.count() == len(walk(root)) and errors.count() == 0
        assert {r.path for r in shot.collect()} == {"" if at == root else os.path.relpath(at, root) for at, _, _ in os.walk(root)}


def test_an_unchanged_tree_is_not_listed(spark, tmp_path):
    from stratafile.scratch import written
    from stratafile.sources import incremental as inc

    root = tmp_path / "root"
    for d in ("a/b/c", "x"):
        (root / d).mkdir(parents=True)
        (root / d / "f").write_text("1")
    settle(str(root))
    files, shot, _ = (written(x, "t") for x in inc.first_scan(spark, str(root)))
    before = {r.path: r.read_at for r in shot.collect()}
    (root / "a/b/c/f").write_text("written in place")  # no folder's time changes
    files2, shot2, _ = (written(x, "t") for x in inc.rescan(spark, str(root), shot, files))
    assert {r.path: r.read_at for r in shot2.collect()} == before and {r.path: r.size_bytes for r in files2.collect()} == {"a/b/c/f": 16, "x/f": 1}
    files3, _, _ = inc.rescan(spark, str(root), shot, files, each_file=False)
    assert {r.path: r.size_bytes for r in files3.collect()} == {"a/b/c/f": 1, "x/f": 1}
    (root / "a/b/c/g").write_text("new")  # a changed leaf: only its folder is listed
    files4, shot4, _ = (written(x, "t") for x in inc.rescan(spark, str(root), shot2, files2))
    again = {r.path: r.read_at for r in shot4.collect()}
    assert {p for p in again if again[p] != before[p]} == {"a/b/c"} and {r.path for r in files4.collect()} == {"a/b/c/f", "a/b/c/g", "x/f"}


# streams of events


def event(path, at, size=None, deleted=False):
    return {"id": abs(hash(path)) % 10**6, "drive_id": 1, "path": path, "abs_path": f"/m/{path}", "size_bytes": size, "status": "indexed", "priority": "normal", "is_original": False, "event_time": f"2024-01-01T00:00:{at:02d}", "deleted": deleted}


@pytest.mark.parametrize("seed", range(2))
def test_shuffled_events_give_the_table_of_ordered_ones(spark, tmp_path, seed):
    import json

    from stratafile.store import Store
    from stratafile.streaming import events as ev

    rnd, every, newest = random.Random(seed), [], {}
    for at in rnd.sample(range(60), 40):
        e = event(f"p{rnd.randint(0, 7)}", at, rnd.randint(1, 99), rnd.random() < 0.3)
        every.append(e)
        if e["path"] not in newest or newest[e["path"]]["event_time"] < e["event_time"]:
            newest[e["path"]] = e
    tables = []
    for name, order_ in (("ordered", sorted(every, key=lambda e: e["event_time"])), ("shuffled", rnd.sample(every, len(every)))):
        land, store = tmp_path / f"{name}-land", Store(spark, str(tmp_path / name))
        land.mkdir()
        store.initialise()
        for i in range(4):
            (land / f"{i}.json").write_text("\n".join(json.dumps(e) for e in order_[i * 10 : i * 10 + 10]))
            ev.apply_events(ev.events(spark, str(land)), store, str(tmp_path / f"{name}-ck")).awaitTermination()
        tables.append({(r.path, r.size_bytes) for r in store.read("files").where("status <> 'source_removed'").collect()})
    assert tables[0] == tables[1] == {(p, e["size_bytes"]) for p, e in newest.items() if not e["deleted"]}


def test_the_catalogue_rescans_by_snapshots(spark, tmp_path):
    root = tmp_path / "d"
    for p in ("a/b/f1", "a/f2", "x/f3"):
        (root / p).parent.mkdir(parents=True, exist_ok=True)
        (root / p).write_text(p)
    settle(str(root))
    c = Catalogue(spark, str(tmp_path / "c"))
    c.drive_add("d", str(root))
    assert tuple(c.rescan("d").first()) == (4, 3, 0)
    ids = {r.path: r.id for r in c.files.collect()}
    c.classify(str(ids["a/f2"]), "docs")
    assert tuple(c.rescan("d").first()) == (0, 3, 0)
    (root / "a/f2").rename(root / "x/f2moved")
    (root / "x/f3").unlink()
    assert tuple(c.rescan("d", follow_moves=True).first()) == (2, 2, 0)
    got = {r.path: (r.id, r.category, r.status) for r in c.files.collect()}
    assert got == {"a/b/f1": (ids["a/b/f1"], None, "indexed"), "x/f2moved": (ids["a/f2"], "docs", "classified"), "x/f3": (ids["x/f3"], None, "source_removed")} and c.validate().count() == 0
