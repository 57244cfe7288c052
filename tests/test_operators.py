from datetime import datetime

import pytest
from pyspark.sql import functions as F

from stratafile import schema
from stratafile.errors import ConfigError, DriveNotFound, InsufficientSpace, MigrationError
from stratafile.operators import dedup, filters, joins, lint, rules, stats
from stratafile.plans import planner, policy
from stratafile.sources import lint as lint_source


def files(spark, rows):
    """Files from dictionaries, defaults as a scan gives them."""
    base = {"drive_id": 1, "size_bytes": 1024, "priority": "normal", "status": "indexed", "is_original": False, "is_symlink": False}
    names = schema.struct("files").names
    out = []
    for i, r in enumerate(rows, 1):
        r = base | {"id": i, "path": f"p{i}"} | r
        r.setdefault("abs_path", f"/mnt/test/{r['path']}")
        r.setdefault("filename", r["path"].rsplit("/", 1)[-1])
        r.setdefault("extension", r["filename"].rsplit(".", 1)[1] if "." in r["filename"] else None)
        out.append(tuple(r.get(n) for n in names))
    return spark.createDataFrame(out, schema.struct("files"))


def now():
    return F.lit("2024-06-01 12:00:00").cast("timestamp")


def ids(df):
    return sorted(r.id for r in df.collect())


def test_groups_and_assignments(spark):
    f = files(spark, [{"blake3_hash": "a", "size_bytes": 10}, {"blake3_hash": "a", "size_bytes": 10, "drive_id": 2}, {"blake3_hash": "b"}, {"blake3_hash": None}, {"blake3_hash": None}, {"blake3_hash": "z", "size_bytes": 0}, {"blake3_hash": "z", "size_bytes": 0}])
    done, groups = dedup.refresh(f)
    got = {r.hash: r for r in groups.collect()}
    assert got["a"].total_waste_bytes == 10 and got["a"].cross_drive and got["a"].drives_involved == [1, 2] and got["z"].total_waste_bytes == 0
    assert {r.id: (r.duplicate_group, r.is_original) for r in done.collect()} == {1: (1, True), 2: (1, False), 3: (None, False), 4: (None, False), 5: (None, False), 6: (6, True), 7: (6, False)}
    assert dedup.duplicate_groups(f, min_size=1).count() == 1 and dedup.duplicate_groups(f, drive=1).count() == 1
    with pytest.raises(ConfigError):
        dedup.duplicate_groups(f, "sha1")
    stat = dedup.duplicate_statistics(groups).first()
    assert tuple(stat) == (2, 4, 10, 1) and tuple(dedup.duplicate_statistics(groups.limit(0)).first()) == (0, 0, 0, 0)


def test_unique_files_under_each_null_rule(spark):
    f = files(spark, [{"md5_hash": "a", "blake3_hash": "a"}, {"md5_hash": "a", "blake3_hash": "a", "drive_id": 2}, {"md5_hash": "b", "blake3_hash": "b", "drive_id": 2}, {"md5_hash": None, "drive_id": 2}, {"md5_hash": "c", "blake3_hash": "c", "drive_id": 2}, {"md5_hash": "c", "blake3_hash": "c", "drive_id": 2}])
    d = spark.createDataFrame([(1, "one", "source"), (2, "two", "backup"), (3, "three", "backup")], "id long, label string, role string")
    assert ids(joins.unique_to_drive(f).where("drive_id = 2")) == [3, 4, 5, 6]
    assert ids(joins.backup_unique_files(f, 2)) == [3, 5, 6]
    assert {r.label: r.file_count for r in joins.backup_unique_counts(f, d).collect()} == {"two": 4, "three": 0}
    assert ids(joins.backup_only(f, d)) == [3, 5, 6] and ids(joins.missing_from_backup(f, d)) == []
    g = files(spark, [{"path": "x", "md5_hash": "1", "size_bytes": 5}, {"path": "x", "md5_hash": "2", "size_bytes": 5, "drive_id": 2}, {"path": "y", "md5_hash": None}, {"path": "y", "md5_hash": "3", "drive_id": 2}])
    assert [(r.source_id, r.backup_id) for r in joins.bit_rot(g, d).collect()] == [(1, 2)]
    assert ids(joins.missing_from_backup(g, d)) == [1] and ids(joins.missing_from_backup(g, d, null_is_missing=True)) == [1, 3]


@pytest.mark.parametrize("block", [1, 3, 256])
def test_bit_rot_pairs_block_by_block(spark, monkeypatch, block):
    """Every pair once whatever the blocks, and the pairs of a path and block together, not in file order."""
    monkeypatch.setattr(joins, "BLOCK", block)
    rows = [{"path": f"p{i % 7}" if i % 31 else f"alone{i}", "size_bytes": 5, "md5_hash": str(i % 5) if i % 11 else None, "drive_id": 1 + i // 7 % 2} for i in range(280)]
    f = files(spark, rows)
    d = spark.createDataFrame([(1, "one", "source"), (2, "two", "backup")], "id long, label string, role string")
    got = joins.bit_rot(f, d)
    assert got.columns == ["path", "size_bytes", "source_id", "source_md5", "backup_id", "backup_md5"]
    all_ = [r.asDict() for r in f.collect()]
    want = [(a["id"], b["id"]) for a in all_ for b in all_ if a["drive_id"] == 1 and b["drive_id"] == 2 and a["path"] == b["path"] and a["md5_hash"] and b["md5_hash"] and a["md5_hash"] != b["md5_hash"]]
    assert want and sorted((r.source_id, r.backup_id) for r in got.collect()) == sorted(want)
    paths = [r.path for r in got.coalesce(1).collect()]
    assert 1 + sum(a != b for a, b in zip(paths, paths[1:])) <= 7 * max(1, -(-20 // block))


def test_filters(spark):
    f = files(spark, [{"path": "a.txt", "size_bytes": 5, "category": "x"}, {"path": "b.txt", "size_bytes": 9, "drive_id": 2}, {"path": "c_d.TXT", "size_bytes": 7}])
    assert [r.id for r in filters.unclassified(f).collect()] == [2, 3] and ids(filters.unclassified(f, 1)) == [3]
    assert ids(filters.search(f, extension="txt")) == [1, 2] and ids(filters.search(f, path_contains="C_")) == [3] and ids(filters.search(f)) == [1, 2, 3]
    assert ids(filters.in_scope(f, [1], [], ["/mnt/test/a", "/mnt/test/c"], ["/mnt/test/c"])) == [1]
    d = spark.createDataFrame([(1, "one"), (2, "two")], "id long, label string")
    assert ids(filters.plan_candidates(f, d, "x", "one")) == [1] and filters.drive_id(d, "two") == 2
    with pytest.raises(DriveNotFound):
        filters.plan_candidates(f, d, "x", "three")


RULES = """
[rules.modules]
type = "pattern"
patterns = ["**/node_modules/**"]
category = "trash"
priority = "trash"
rule_priority = 100
[rules.photos]
type = "extension"
extensions = ["jpg", "jpeg", "png"]
category = "photos"
[rules.large]
type = "size"
min_bytes = 1073741824
category = "large"
[rules.old]
type = "age"
older_than_days = 7
category = "old"
[rules.duplicates]
type = "duplicate"
keep_strategy = "keepoldest"
category = "duplicate"
"""


def test_rules(spark):
    by = rules.from_toml(RULES)
    f = files(spark, [
        {"path": "project/node_modules/package/index.js"}, {"path": "vacation/photo.JPG"}, {"path": "x", "size_bytes": 2147483648}, {"path": "y", "modified_at": datetime(2024, 5, 22)}, {"path": "z", "duplicate_group": 1},
        {"path": "none"}, {"path": "w", "modified_at": datetime(2024, 5, 25, 13)}, {"path": "node_modules/a.jpg", "modified_at": datetime(2020, 1, 1)},
    ])
    got = {r.id: r.match and (r.match.rule_name, r.match.category, r.match.priority) for r in rules.classify(f, by, now()).collect()}
    assert got == {1: ("modules", "trash", "trash"), 2: ("photos", "photos", "normal"), 3: ("large", "large", "normal"), 4: ("old", "old", "normal"), 5: ("duplicates", "duplicate", "normal"), 6: None, 7: None, 8: ("modules", "trash", "trash")}
    done, counters = rules.auto_classify(f, by, now())
    assert tuple(counters.first()) == (6, 2) and {r.id: r.status for r in done.collect()}[6] == "indexed"
    assert rules.from_toml(rules.to_toml(by)) == by
    ties = rules.from_toml('[rules.b]\ntype="pattern"\npatterns=["*"]\ncategory="b"\n[rules.a]\ntype="pattern"\npatterns=["*"]\ncategory="a"\n')
    assert {r.match.category for r in rules.classify(f, ties, now()).collect()} == {"a"}
    assert {r.match for r in rules.classify(f, [], now()).collect()} == {None}
    for bad in ('[rules.x]\ntype="nope"\ncategory="c"', '[rules.x]\ntype="size"', "[rules", '[rules.x]\ntype="duplicate"\ncategory="c"\nkeep_strategy="all"'):
        with pytest.raises(ConfigError):
            rules.from_toml(bad)
    samples = rules.batch_samples(rules.classify(f, by, now()), 1).collect()
    assert len(samples) == 5


def test_exif_template(spark):
    f = files(spark, [{"path": "a.jpg"}, {"path": "b.jpg"}, {"path": "c.jpg"}])
    exif = spark.createDataFrame([("/mnt/test/a.jpg", "2024", "03", "09", "Canon", "X"), ("/mnt/test/b.jpg", None, None, None, "Nikon", None)], "abs_path string, year string, month string, day string, make string, model string")
    by = [rules.Rule("p", "extension", "photos", extensions=["jpg"], subcategory="plain", subcategory_from_exif="{exif_year}/{exif_month}/{exif_make}/{filename}")]
    assert {r.id: r.match.subcategory for r in rules.classify(f, by, now(), exif).collect()} == {1: "2024/03/Canon/{filename}", 2: "{exif_year}/{exif_month}/Nikon/{filename}", 3: "plain"}


def lints(spark, tmp_path, text, **options):
    path = tmp_path / "lint.json"
    path.write_text(text)
    return lint_source.read(spark, str(path), **options)


def test_lint_parsing_and_statistics(spark, tmp_path):
    line = lambda kind, path, size, extra="": f'{{"type":"{kind}","path":"{path}","size":{size}{extra}}}'
    text = "\n".join(["// comment", "", line("duplicate_file", "/a", 1024, ',"checksum":"abc","is_original":true'), line("duplicate_file", "/b", 1024, ',"checksum":"abc","disk_id":2'), line("emptyfile", "/c", 0), "not json", line("strange", "/d", 1), '{"type":"emptydir"}', "[", line("emptydir", "/e", 0) + ","])
    x = lints(spark, tmp_path, text)
    assert [(r.type, r.path) for r in x.orderBy("ordinal").collect()] == [("duplicate_file", "/a"), ("duplicate_file", "/b"), ("emptyfile", "/c"), ("other", "/d"), ("emptydir", "/e")]
    s = lint.lint_statistics(x).first()
    assert (s.duplicate_files, s.duplicate_groups, s.duplicate_bytes, s.empty_files, s.empty_dirs, s.other_lints) == (2, 1, 1024, 1, 1, 1)
    g = lint.lint_groups(x).first()
    assert (g.checksum, g.file_count, g.total_size, g.original) == ("abc", 2, 1024, "/a")
    assert lint.has_cross_drive(x).first()[0] is False
    assert lints(spark, tmp_path, text, lenient=False).count() == 4
    assert lints(spark, tmp_path, "").count() == 0


def test_lint_import(spark, tmp_path):
    f = files(spark, [{"path": "a", "size_bytes": 100, "duplicate_group": 77}, {"path": "b", "size_bytes": 100}, {"path": "c", "size_bytes": 0}, {"path": "d", "category": "kept"}])
    text = "\n".join(f'{{"type":"{t}","path":"/mnt/test/{p}","size":1,"checksum":"{c}"{o}}}' for t, p, c, o in [("duplicate_file", "a", "x", ""), ("duplicate_file", "b", "x", ',"is_original":true'), ("emptyfile", "c", "", ""), ("badlink", "d", "", ""), ("duplicate_file", "gone", "x", ""), ("duplicate_file", "d", "only", "")])
    out, groups, counters = lint.import_lints(lints(spark, tmp_path, text), f, apply_trash=True)
    got = {r.path: r for r in out.collect()}
    assert (got["a"].duplicate_group, got["b"].is_original, got["a"].is_original) == (1, True, False)
    assert got["c"].category == "trash" and got["c"].priority == "trash" and got["d"].category == "kept" and got["d"].rmlint_type == "duplicate_file"
    g = groups.collect()
    assert len(g) == 1 and g[0].original_id == 2 and g[0].total_waste_bytes == 100
    c = counters.first()
    assert (c.total_lints, c.matched_files, c.skipped_lints, c.empty_files_marked, c.bad_links_marked, c.duplicate_groups_created, c.duplicate_files_assigned) == (6, 5, 1, 1, 1, 1, 2)
    unflagged = "\n".join(f'{{"type":"duplicate_file","path":"/mnt/test/{p}","size":1,"checksum":"x"}}' for p in "ab")
    g = lint.import_lints(lints(spark, tmp_path, unflagged), f)[1].first()
    assert g.original_id is None and g.total_waste_bytes == 200


def test_plans(spark):
    f = files(spark, [{"size_bytes": 1000, "category": "trash"}, {"size_bytes": 2000, "category": "trash", "duplicate_group": 5, "is_original": True}, {"size_bytes": 2000, "duplicate_group": 5, "target_path": "t/x", "md5_hash": "m" * 32}])
    made = planner.delete_trash(f.where("category = 'trash'"), 4, now())
    p = made.plan.first()
    assert (p.id, p.status, p.total_files, p.total_bytes, p.description) == (4, "draft", 2, 3000, "Delete 2 trash files")
    assert [(s.step_order, s.action, s.file_id) for s in made.steps.orderBy("step_order").collect()] == [(0, "delete", 1), (1, "delete", 2)]
    made = planner.dedup(filters.group_members(f, 5), 5, now())
    assert [(s.file_id, s.pre_hash) for s in made.steps.collect()] == [(3, "m" * 32)]
    made = planner.migrate(f, 6, now(), 9, "/new")
    assert [s.dest_path for s in made.steps.orderBy("step_order").collect()] == ["/new/p1", "/new/p2", "/new/t/x"]
    made = planner.offload(f.where("id = 3"), 7, now(), 9, "/off")
    assert [(s.step_order, s.action, s.dest_path) for s in made.steps.orderBy("step_order").collect()] == [(0, "copy", "/off/p3"), (1, "delete", None)]
    with pytest.raises(MigrationError):
        planner.dedup(filters.group_members(f, 5), 8, now(), 3).steps and planner.dedup(f.where("id = 2"), 8, now())
    with pytest.raises(ConfigError):
        planner.dedup(f.where("id = 3"), 8, now())
    with pytest.raises(InsufficientSpace):
        planner.migrate(f, 6, now(), 9, "/new", free_bytes=9000)


@pytest.mark.parametrize("most,want", [(600_000, [1, 2, 3]), (150_000, [1]), (50_000, []), (10**9, [1, 2, 3, 4, 5])])
def test_batch_prefix(spark, most, want):
    f = files(spark, [{"size_bytes": n * 100_000} for n in range(1, 6)])
    assert ids(planner.batch_prefix(f, most)) == want


def test_rollback(spark):
    s = spark.createDataFrame([(1, 0, "copy", "completed"), (1, 1, "copy", "completed"), (1, 2, "copy", "failed"), (2, 0, "delete", "completed"), (3, 0, "delete", "pending")], "plan_id long, step_order int, action string, status string")
    assert {r.plan_id: r.can_rollback for r in planner.rollback_feasible(s).collect()} == {1: True, 2: False, 3: True}
    assert [r.step_order for r in planner.rollback_order(s, 1).collect()] == [1, 0]


POLICY = """
version = "1"
name = "tidy"
[scope]
include_drives = ["one"]
exclude_paths = ["/mnt/test/keep"]
[rules.t]
type = "pattern"
patterns = ["*.tmp"]
category = "trash"
[plans.clean]
type = "delete-trash"
[safety]
max_bytes_per_run = "1 MB"
"""


def test_policy(spark, tmp_path):
    p = policy.from_toml(POLICY)
    p.validate()
    assert p.scope.include_drives == ["one"] and p.rules[0].name == "t" and p.plans["clean"].type == "delete-trash" and policy.size_of("1 MB") == 1024**2
    for bad in (POLICY.replace("delete-trash", "burn"), POLICY.replace('"1 MB"', '"much"'), POLICY.replace('version = "1"', 'version = " "'), POLICY.replace("tidy", "")):
        with pytest.raises(ConfigError):
            policy.from_toml(bad).validate()
    (tmp_path / "p.toml").write_text(POLICY)
    (tmp_path / "u.toml").write_text('[rules.t]\ntype="size"\ncategory="u"\n[rules.v]\ntype="size"\ncategory="v"\n')
    _, by = policy.effective(str(tmp_path / "p.toml"), str(tmp_path / "u.toml"))
    assert {r.name: r.category for r in by} == {"t": "trash", "v": "v"}
    d = spark.createDataFrame([(1, "one"), (2, "two")], "id long, label string")
    f = files(spark, [{"path": "a.tmp"}, {"path": "keep/b.tmp"}, {"path": "c.tmp", "drive_id": 2}])
    assert ids(policy.scoped(f, d, p.scope)) == [1]
    assert ids(policy.scoped(f, d, policy.Scope(include_drives=["none"]))) == []


def test_schema_checks_and_statistics(spark):
    f = files(spark, [{"path": "x"}, {"path": "x", "status": "odd"}, {"drive_id": 9}])
    d = schema.conform(spark.createDataFrame([(1, "a", "source", "local")], "id long, label string, role string, backend string"), "drives")
    got = {(r.check, r.table, r.columns): r.violations for r in schema.validate({"files": f, "drives": d}).collect()}
    assert got == {("unique", "files", "drive_id,path"): 1, ("reference", "files", "drive_id"): 1, ("value", "files", "status"): 1}
    v = spark.createDataFrame([("a", "A", None, True), ("a", "b", None, True), ("a", None, "io", True), ("a", None, None, False), (None, None, None, True)], "expected string, actual string, error string, exists boolean")
    assert {r.outcome: r.files for r in stats.verify_outcomes(v).collect()} == {"verified": 1, "mismatch": 1, "error": 1, "missing": 1, "unhashed": 1}


def test_numbers_and_sums_in_pieces(spark, monkeypatch):
    from stratafile.operators import order

    rows = spark.range(1000).select(F.expr("id * 7919 % 1000").alias("id"), F.expr("id % 13").alias("size_bytes")).repartition(7)
    whole = {tuple(r) for r in order.with_running(rows, "id", {"n": F.lit(1), "b": F.col("size_bytes")}).select("id", "n", "b").collect()}
    monkeypatch.setattr(order, "ONE_TASK", 90)
    pieces = order.with_running(rows, "id", {"n": F.lit(1), "b": F.col("size_bytes")}).select("id", "n", "b")
    assert {tuple(r) for r in pieces.collect()} == whole and {r[0] + 1 == r[1] for r in whole} == {True}
    assert ids(planner.batch_prefix(rows, 600)) == sorted(r[0] for r in whole if r[2] <= 600)


def test_equal_keys_span_pieces(spark):
    from stratafile.operators import order

    rows = spark.range(20_000).select(F.lit(7).alias("key"), F.col("id").alias("other"), F.expr("id % 5").alias("b")).repartition(5)
    pieces = order.in_pieces(rows, [F.col("key")], 8).groupBy("_piece").count().collect()
    assert len(pieces) == 8 and max(r["count"] for r in pieces) < 5_000
    got = order.numbered(rows, [F.col("key"), F.desc("other")], "n", pieces=8).collect()
    assert sorted((r["n"], r["other"]) for r in got) == [(i, 19_999 - i) for i in range(20_000)]
    assert order.numbered(rows.limit(0), [F.col("key")], "n", pieces=3).count() == 0 and order.numbered(rows.select("key", F.lit(None).cast("long").alias("other"), "b"), [F.col("other")], "n", 4).agg(F.countDistinct("n")).first()[0] == 20_000
