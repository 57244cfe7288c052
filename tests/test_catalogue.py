"""Scans, the store and the facade, end to end on real folders."""

import hashlib
import json
import os
import struct

import pytest

from stratafile.api import Catalogue
from stratafile.errors import ConfigError, DriveNotFound, DriveOffline, FileMissing, MigrationError, PlanNotApproved, PlanNotFound, StoreError
from stratafile.operators import rules
from stratafile.operators.stats import scan_counts
from stratafile.plans import executor
from stratafile.sources import devices, exif, fs
from stratafile.store import Store


def grow(root, tree):
    for path, text in tree.items():
        p = root / path
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(text if isinstance(text, bytes) else text.encode())


TREE = {"file1.txt": "duplicate content", "dir1/file2.txt": "duplicate content", "dir2/file4.txt": "duplicate content", "dir1/file3.txt": "unique content 1", "dir2/unique.dat": "unique content 2", ".hidden/hidden.txt": "hidden file"}


def counts(spark, root, **options):
    r = scan_counts(fs.entries(spark, str(root), **options)).first()
    return r.files_scanned, r.dirs_scanned


def test_scan_rules(spark, tmp_path):
    grow(tmp_path / "a", TREE)
    assert counts(spark, tmp_path / "a", include_hidden=True) == (6, 4)
    assert counts(spark, tmp_path / "a") == (6, 3)
    assert counts(spark, tmp_path / "a", prune_hidden=True) == (5, 3)
    (tmp_path / "empty").mkdir()
    assert counts(spark, tmp_path / "empty") == (0, 1)
    grow(tmp_path / "b", {"level1/file1.txt": "x", "level1/level2/file2.txt": "y", "top": "z"})
    assert counts(spark, tmp_path / "b", max_depth=2)[0] == 2 and counts(spark, tmp_path / "b", max_depth=0) == (0, 1)
    with pytest.raises(FileMissing):
        fs.entries(spark, str(tmp_path / "none"))


def test_scan_rows(spark, tmp_path):
    grow(tmp_path, {"repo/.git/config": '[remote]\n\turl = https://github.com/user/repo.git\n', "a.tar.gz": "12345", ".rc": "x"})
    os.symlink("a.tar.gz", tmp_path / "link")
    os.symlink(tmp_path, tmp_path / "loop")
    got = {r.path: r for r in fs.entries(spark, str(tmp_path), include_hidden=True).where("kind = 'file'").collect()}
    assert got["repo/.git/config"].git_remote_url == "https://github.com/user/repo.git"
    assert (got["a.tar.gz"].extension, got["a.tar.gz"].size_bytes, got[".rc"].extension) == ("gz", 5, None)
    assert (got["link"].is_symlink, got["link"].symlink_target, got["link"].size_bytes) == (True, "a.tar.gz", 0)
    followed = fs.entries(spark, str(tmp_path), follow_symlinks=True)
    assert followed.where("kind = 'file'").count() < 100
    assert fs.git_remote("no such line") is None


def image(order="<", date=b"2024:03:09 10:00:00\0", make=b"Canon\0"):
    at = 8 + 2 + 2 * 12 + 4
    head = (b"II*\0" if order == "<" else b"MM\0*") + struct.pack(order + "IH", 8, 2)
    head += struct.pack(order + "HHII", 0x010F, 2, len(make), at) + struct.pack(order + "HHII", 0x0132, 2, len(date), at + len(make)) + struct.pack(order + "I", 0)
    return head + make + date


def test_exif(spark, tmp_path):
    want = {"make": "Canon", "year": "2024", "month": "03", "day": "09"}
    assert exif.parse(image()) == exif.parse(image(">")) == want
    assert exif.parse(b"\xff\xd8\xff\xe1\0\x50Exif\0\0" + image()) == want
    assert exif.parse(image(date=b"2024-03-09 10:00:00\0")) == want
    assert exif.parse(b"\x89PNG\r\n\x1a\n" + struct.pack(">I", len(image())) + b"eXIf" + image()) == want
    assert exif.parse(b"nothing") is None and exif.parse(image()[:20]) is None
    grow(tmp_path, {"a.JPG": image(), "b.jpg": b"no", "c.txt": image()})
    rows = fs.files_of(fs.entries(spark, str(tmp_path)), 1)
    assert [(os.path.basename(r.abs_path), r.year, r.make, r.model) for r in exif.read(rows).collect()] == [("a.JPG", "2024", "Canon", None)]


def test_devices(tmp_path, monkeypatch):
    assert devices.free_space(str(tmp_path)).free_bytes > 0
    s = devices.Space(10**9, 500_000_000, 500_000_000)
    assert s.max_safe_write_bytes() == 250_000_000 and s.can_safely_write(200_000_000) and not s.can_safely_write(300_000_000)
    assert devices.discover_device(str(tmp_path)).mount_path == str(tmp_path)
    with pytest.raises(FileMissing):
        devices.free_space(str(tmp_path / "none"))
    monkeypatch.setenv("STRATAFILE_CATALOGUE", "/x")
    assert devices.catalogue_path() == "/x" and devices.catalogue_path("/y") == "/y"


def test_store_versions(spark, tmp_path):
    s = Store(spark, str(tmp_path / "cat"))
    s.initialise()
    s.initialise()
    assert s.schema_version() == 1 and s.version("files") == 1 and s.read("files").count() == 0
    id_ = s.add_drive(label="a", mount_path="/m", role="backup")
    assert s.read("drives").first().is_readonly and s.add_drive(label="b") == id_ + 1
    for bad in ({"label": "a"}, {"label": "c", "role": "nope"}, {"label": "c", "backend": "tape"}):
        with pytest.raises(ConfigError):
            s.add_drive(**bad)
    s.change_drive("a", is_online=False)
    assert {r.label: r.is_online for r in s.read("drives").collect()} == {"a": False, "b": True}
    s.remove_drive("b")
    with pytest.raises(DriveNotFound):
        s.remove_drive("b")
    now = s.version("drives")
    assert s.read("drives", now - 1).count() == 2 and s.read("drives").count() == 1
    s.vacuum("drives", keep=1)
    assert s.read("drives").count() == 1 and s.version("drives") == now
    s.log("a", "b", plan_id=1)
    s.log("c")
    assert [r.id for r in s.read("audit_log").orderBy("id").collect()] == [1, 2]


@pytest.fixture
def catalogue(spark, tmp_path):
    for name in ("one", "two", "new"):
        (tmp_path / name).mkdir()
    grow(tmp_path / "one", {"a.txt": "shared", "b.txt": "only", "junk.tmp": "xx", "pics/p.jpg": image()})
    grow(tmp_path / "two", {"copy.txt": "shared"})
    c = Catalogue(spark, str(tmp_path / "cat"))
    c.drive_add("one", str(tmp_path / "one"))
    c.drive_add("two", str(tmp_path / "two"), role="backup")
    c.drive_add("new", str(tmp_path / "new"), role="target")
    return c


def test_index_and_query(catalogue, tmp_path):
    c = catalogue
    assert c.dedup_refresh().first().group_count == 1
    group = c.groups.first()
    assert group.cross_drive and group.file_count == 2
    before = {r.path: (r.id, r.blake3_hash) for r in c.files.collect()}
    c.classify_pattern("b.t", "mine")
    (tmp_path / "one" / "b.txt").write_text("grown text")
    (tmp_path / "one" / "junk.tmp").unlink()
    c.scan("one", tombstones=True)
    after = {r.path: r for r in c.files.collect()}
    assert len(after) == len(before) and after["b.txt"].id == before["b.txt"][0] and after["b.txt"].blake3_hash is None and after["b.txt"].category == "mine"
    assert after["a.txt"].blake3_hash == before["a.txt"][1] and after["junk.tmp"].status == "source_removed"
    assert c.query_backup_unique("two").count() == 0 and c.query_duplicates().count() == 1 and c.query_duplicates(drive="two").count() == 1 and c.query_duplicates(same_drive_only=True).count() == 0
    assert c.status().first().drives == 3 and c.space_check().count() == 3 and c.space_check("one").count() == 1 and c.drive_table().count() == 3 and c.drive_info("one").count() == 1
    assert c.query_files(extension="txt").count() == 3 and c.query_unclassified("one", 1).count() == 1 and c.query_large_files(5).count() > 0 and c.query_category("mine").count() == 1
    assert "Drives" in c.text_report() and c.report().first().group_count == 1
    c.export("JSON", str(tmp_path / "r.json"))
    assert {d["label"] for d in json.loads((tmp_path / "r.json").read_text())["drives"]} == {"one", "two", "new"}
    c.export("csv", str(tmp_path / "r.csv"))
    with pytest.raises(ConfigError):
        c.export("xml", "x")
    c.dedup_refresh("one", per_drive=True)
    assert c.groups.count() == 0
    c.drive_online("two", False)
    with pytest.raises(DriveOffline):
        c.scan("two")
    assert c.validate().count() == 0
    with pytest.raises(DriveNotFound):
        c.scan("three")


def test_plan_execute_and_roll_back(catalogue, tmp_path):
    c = catalogue
    c.dedup_refresh()
    c.classify(",".join(str(r.id) for r in c.files.where("path in ('a.txt', 'b.txt')").collect()), "docs", priority="critical")
    plan = c.plan_create("migrate", target_drive="new", category_filter="docs")
    assert c.plan_show(plan).count() == 2 and c.migrate_execute(plan).count() == 2 and not (tmp_path / "new" / "a.txt").exists()
    with pytest.raises(PlanNotApproved):
        c.migrate_execute(plan, execute=True)
    c.plan_approve(plan)
    with pytest.raises(MigrationError):
        c.plan_approve(plan)
    assert {s.status for s in c.migrate_execute(plan, execute=True).collect()} == {"completed"}
    assert (tmp_path / "new" / "a.txt").read_text() == "shared" and c.plan_list("completed").count() == 1
    assert {r.path: r.status for r in c.files.where("category = 'docs'").collect()} == {"a.txt": "verified", "b.txt": "verified"}
    assert c.verify(plan).first().verified == 2
    c.rollback(plan)
    assert not (tmp_path / "new" / "a.txt").exists() and {s.status for s in c.steps.collect()} == {"rolled_back"}
    assert [r.action for r in c.audit_entries(plan).orderBy("id").collect()][-1] == "plan_rolled_back"
    with pytest.raises(PlanNotFound):
        c.plan_show(99)


def test_a_changed_source_stops_the_plan(catalogue, tmp_path):
    c = catalogue
    c.dedup_refresh(algorithm="md5")
    group = c.groups.first()
    plan = c.plan_create("dedup", duplicate_group=group.group_id)
    victim = c.plan_show(plan).first().source_path
    text = open(victim).read()
    open(victim, "w").write("changed since")
    c.plan_approve(plan)
    assert [s.status for s in c.migrate_execute(plan, execute=True).collect()] == ["failed"]
    assert os.path.exists(victim) and c.plan_list("aborted").count() == 1
    assert {r.outcome: r.files for r in c.verify(full=True).collect()}["mismatch"] == 1
    open(victim, "w").write(text)
    again = c.plan_create("dedup", duplicate_group=group.group_id)
    c.plan_approve(again)
    c.migrate_execute(again, execute=True)
    assert not os.path.exists(victim)
    with pytest.raises(MigrationError):
        c.rollback(again)


def test_policy_run(catalogue, tmp_path):
    c = catalogue
    c.scan()
    (tmp_path / "p.toml").write_text('version="1"\nname="n"\n[rules.t]\ntype="pattern"\npatterns=["**/*.tmp"]\ncategory="trash"\n[rules.p]\ntype="extension"\nextensions=["jpg"]\ncategory="photos"\nsubcategory_from_exif="{exif_year}"\n[plans.x]\ntype="delete-trash"\n[safety]\nmax_bytes_per_run="1 KB"\n')
    assert c.policy_validate(str(tmp_path / "p.toml")).name == "n"
    assert len(c.policy_apply(str(tmp_path / "p.toml"))) == 1 and (tmp_path / "one" / "junk.tmp").exists()
    assert c.files.where("subcategory = '2024'").count() == 1
    c.policy_apply(str(tmp_path / "p.toml"), dry_run=False, execute=True)
    assert (tmp_path / "one" / "junk.tmp").exists() and c.plan_list("aborted").count() == 1  # nothing is deleted without a hash
    c.dedup_refresh()
    c.policy_apply(str(tmp_path / "p.toml"), dry_run=False, execute=True)
    assert not (tmp_path / "one" / "junk.tmp").exists()
    (tmp_path / "q.toml").write_text('version="1"\nname="n"\n[plans.x]\ntype="delete-trash"\n[safety]\nmax_bytes_per_run="1 B"\n')
    with pytest.raises((ConfigError, MigrationError)):
        c.policy_apply(str(tmp_path / "q.toml"))


def test_lint_import_and_stream(spark, catalogue, tmp_path):
    c = catalogue
    c.scan()
    rows = [{"type": "duplicate_file", "path": str(tmp_path / d), "size": 6, "checksum": "x", "is_original": d == "one/a.txt"} for d in ("one/a.txt", "two/copy.txt")]
    (tmp_path / "lint.json").write_text("\n".join(map(json.dumps, rows)))
    assert c.rmlint_import(str(tmp_path / "lint.json")).first().duplicate_groups_created == 1
    assert c.files.where("is_original").first().path == "a.txt"
    from stratafile.streaming.ingest import file_rows, upsert_stream

    land = tmp_path / "land"
    land.mkdir()
    (land / "1.json").write_text(json.dumps({"id": 5, "drive_id": 1, "path": "streamed", "size_bytes": 1, "status": "indexed", "priority": "normal"}))
    n = c.files.count()
    upsert_stream(file_rows(spark, str(land)), c.store, str(tmp_path / "ck")).awaitTermination()
    assert c.files.count() == n + 1
    review = c.review([])
    assert review.count() == 0


def step(**over):
    return {"id": 1, "file_id": 1, "action": "delete", "source_path": None, "dest_path": None, "dest_drive_id": None, "pre_hash": None} | over


def test_deletions_need_a_hash(tmp_path):
    f = tmp_path / "f"
    f.write_text("hello world")
    done = executor.run_step(step(source_path=str(f)), executor.Options(dry_run=False))
    assert done.status == "failed" and "hash" in done.error and f.exists()
    assert executor.run_step(step(source_path=str(f)), executor.Options(dry_run=False, verify_hashes=False)).status == "failed" and f.exists()
    assert executor.run_step(step(source_path=str(f), pre_hash="0" * 32), executor.Options(dry_run=False, verify_hashes=False)).status == "failed" and f.exists()
    good = executor.run_step(step(source_path=str(f), pre_hash="5eb63bbbe01eeed093cb22bb8f5acdc3"), executor.Options(dry_run=False))
    assert good.status == "completed" and not f.exists()
    assert executor.run_step(step(source_path=str(f), pre_hash="5eb63bbbe01eeed093cb22bb8f5acdc3"), executor.Options(dry_run=False)).bytes == 0  # it is gone already
    f.write_text("x")
    assert executor.run_step(step(source_path=str(f)), executor.Options(dry_run=False, unhashed_deletes=True)).status == "completed" and not f.exists()


@pytest.mark.parametrize("when", ["before", "after"])
def test_a_lost_run_goes_on_where_its_journal_ends(catalogue, tmp_path, monkeypatch, when):
    c = catalogue
    c.scan()
    c.classify(",".join(str(r.id) for r in c.files.where("filename in ('a.txt', 'b.txt', 'copy.txt')").collect()), "docs")
    plan = c.plan_create("offload", target_drive="new", category_filter="docs")
    c.plan_approve(plan)
    order = [(r.id, r.action, r.source_path) for r in c.steps.orderBy("step_order").collect()]
    real, ran = executor.run_step, []

    def lost(s, *more):
        if len(ran) == 3:  # the second file's deletion, before or after it happens
            if when == "after":
                real(s, *more)
            raise KeyboardInterrupt
        ran.append(s["id"])
        return real(s, *more)

    monkeypatch.setattr(executor, "run_step", lost)
    with pytest.raises(KeyboardInterrupt):
        c.migrate_execute(plan, execute=True)
    assert c.plan_list("in_progress").count() == 1 and {r.status for r in c.steps.collect()} == {"pending"}
    again = []
    monkeypatch.setattr(executor, "run_step", lambda s, *more: again.append(s["id"]) or real(s, *more))
    assert {r.status for r in c.migrate_execute(plan, execute=True).collect()} == {"completed"}
    assert again == [i for i, *_ in order[3:]] and c.plan_list("completed").first().completed_files == len(order)
    assert not any(os.path.exists(p) for *_, p in order) and (tmp_path / "new" / "b.txt").exists()
    assert not os.path.exists(f"{c.store.root}/journal/plan-{plan}") and "plan_recovered" in {r.action for r in c.audit.collect()}


def test_remote_drives_by_their_backend(catalogue, tmp_path, monkeypatch):
    c, said = catalogue, []
    c.dedup_refresh()
    c.drive_add("cloud", role="target", backend="rclone", rclone_remote="box")

    def tool(*command):
        said.append(command)
        return json.dumps({"total": 5000, "free": 4000}) if command[1] == "about" else ""

    monkeypatch.setattr(executor, "run_tool", tool)
    monkeypatch.setattr("stratafile.sources.devices.run_tool", tool)
    c.classify_pattern("b.txt", "docs")
    plan = c.plan_create("offload", target_drive="cloud", category_filter="docs")
    c.plan_approve(plan)
    assert [r.status for r in c.migrate_execute(plan, execute=True).collect()] == ["completed"] * 2
    copy = next(x for x in said if x[1] == "copyto")
    assert copy[2].endswith("one/b.txt") and copy[3] == "box:b.txt" and not (tmp_path / "one" / "b.txt").exists()
    c.drive_refresh("cloud")
    assert c.drives.where("label = 'cloud'").first().total_bytes == 5000
    with pytest.raises(DriveNotFound):
        c.drive_refresh("none")


def migrated(c, drive="new"):
    """An approved plan that copies two files to a drive."""
    c.scan("one")
    c.classify(",".join(str(r.id) for r in c.files.where("path in ('a.txt', 'b.txt')").collect()), "docs")
    plan = c.plan_create("migrate", target_drive=drive, category_filter="docs")
    c.plan_approve(plan)
    return plan


def test_a_remote_rollback_touches_no_local_file(catalogue, tmp_path, monkeypatch):
    c, said, there = catalogue, [], {}
    c.drive_add("cloud", str(tmp_path / "cloudlike"), role="target", backend="rclone", rclone_remote="box")

    def tool(*command):
        said.append(command)
        name = next((x for x in command if x.startswith("box:")), "")
        if command[1] == "copyto" and command[3].startswith("box:"):
            there[command[3]] = hashlib.md5(open(command[2], "rb").read()).hexdigest()
        if command[1] == "lsf":
            return "\n".join(x.rpartition("/")[2] for x in there if x == name + command[-1] or x == name + "/" + command[-1].lstrip("/") or x == name + command[-1].lstrip("/"))
        if command[1] == "hashsum":
            return f"{there[name]}  {name}\n" if name in there else ""
        if command[1] == "deletefile":
            del there[name]
        return json.dumps({"total": 5000, "free": 4000}) if command[1] == "about" else ""

    monkeypatch.setattr(executor, "run_tool", tool)
    monkeypatch.setattr("stratafile.sources.devices.run_tool", tool)
    plan = migrated(c, "cloud")
    assert {s.status for s in c.migrate_execute(plan, execute=True).collect()} == {"completed"} and len(there) == 2
    # local files that happen to have the remote paths
    paths = [s.dest_path for s in c.steps.collect()]
    (tmp_path / "cloudlike").mkdir()
    for path in paths:
        assert path.startswith(str(tmp_path))
        open(path, "w").write("not the copy")
    first = sorted(there)[0]
    kept, there[first] = there[first], "0" * 32  # edited on the remote since
    got = c.rollback(plan).collect()
    assert sorted(r.status for r in got) in (["failed"], ["failed", "rolled_back"]) and first in there
    assert {s.status for s in c.steps.collect()} <= {"completed", "rolled_back"}
    there[first] = kept
    assert {r.status for r in c.rollback(plan).collect()} == {"rolled_back"} and not there
    assert {s.status for s in c.steps.collect()} == {"rolled_back"}
    assert all(open(p).read() == "not the copy" for p in paths)
    assert (tmp_path / "one" / "a.txt").exists() and any(x[1] == "deletefile" for x in said)


def test_an_edited_destination_stays_and_one_that_is_gone_is_no_failure(catalogue, tmp_path):
    c = catalogue
    plan = migrated(c)
    c.migrate_execute(plan, execute=True)
    last = c.steps.orderBy("step_order").collect()
    open(last[0].dest_path, "a").write("edited")
    os.remove(last[1].dest_path)
    got = {r.id: (r.status, r.error) for r in c.rollback(plan).collect()}
    assert got[last[1].id][0] == "rolled_back" and got[last[0].id][0] == "failed" and os.path.exists(last[0].dest_path)
    after = {r.id: r for r in c.steps.collect()}
    assert after[last[0].id].status == "completed" and after[last[0].id].error
    entries = {(r.action, r.file_id) for r in c.audit.collect() if r.file_id is not None}
    assert entries >= {("step_completed", s.file_id) for s in last} | {("step_rolled_back", last[1].file_id), ("step_rollback_failed", last[0].file_id)}
    assert c.audit_entries(file_id=last[1].file_id).count() == 2


def state(c):
    rows = lambda t, *cols: sorted(tuple(r) for r in t.select(*cols).collect())
    return (
        rows(c.files, "path", "status", "migrated_to", "category"), rows(c.steps, "step_order", "status", "action"), rows(c.plans, "status", "completed_files", "completed_bytes"),
        sorted((r.action, r.file_id) for r in c.audit.collect() if r.action.startswith("step_")),
    )


def run_and_roll_back(spark, root, monkeypatch, lost):
    """The states after a run and after its rollback; lost: after how many writes of tables the driver is lost in each, if it is."""
    real, left = Store._add, [None]

    def add(self, *more):
        if left[0] is not None:
            left[0] -= 1
            if left[0] < 0:
                raise KeyboardInterrupt
        return real(self, *more)

    for d in ("one", "new"):
        (root / d).mkdir(parents=True)
    for f in ("a.txt", "b.txt"):
        (root / "one" / f).write_text(f * 3)
    c = Catalogue(spark, str(root / "catalogue"))
    c.drive_add("one", str(root / "one"))
    c.drive_add("new", str(root / "new"), role="target")
    plan, states = migrated(c), []
    monkeypatch.setattr(Store, "_add", add)
    for call, after in zip((lambda: c.migrate_execute(plan, execute=True), lambda: c.rollback(plan)), lost or (None, None)):
        left[0] = after
        try:
            call()
            assert lost is None
        except KeyboardInterrupt:
            left[0] = None
            call()
        left[0] = None
        states.append(tuple(tuple(tuple(str(v).replace(str(root), "") for v in r) for r in part) for part in state(c)))
    monkeypatch.setattr(Store, "_add", real)
    return states


def test_the_driver_is_lost_between_two_table_writes(spark, tmp_path, monkeypatch):
    """Whatever write is the last one, the next call ends with the tables as without the loss."""
    whole = run_and_roll_back(spark, tmp_path / "whole", monkeypatch, None)
    assert whole[0][2] == (("completed", "2", "30"),) and whole[1][1][0][1] == "rolled_back" and [x[0] for x in whole[1][3]] == ["step_completed"] * 2 + ["step_rolled_back"] * 2
    for lost in ((2, 0), (3, 1), (4, 2), (5, 3), (6, 4)):  # steps, files, audit log, plan; the last entry of the log
        assert run_and_roll_back(spark, tmp_path / f"lost{lost[0]}", monkeypatch, lost) == whole, lost


def test_files_reviewed_one_by_one(catalogue, spark):
    c = catalogue
    c.scan()
    by = [rules.Rule("t", "extension", "text", extensions=["txt"])]
    ids = {r.filename: r.id for r in c.files.collect()}
    c.decide_files(by, spark.createDataFrame([(ids["a.txt"], "accept", None, None), (ids["b.txt"], "override", "notes", "own"), (ids["copy.txt"], "skip", None, None), (ids["junk.tmp"], "override", "junk", None)], "id long, action string, new_category string, new_subcategory string"))
    got = {r.filename: (r.category, r.subcategory, r.status) for r in c.files.collect()}
    assert (got["a.txt"], got["b.txt"], got["copy.txt"], got["junk.tmp"]) == (("text", None, "classified"), ("notes", "own", "classified"), (None, None, "indexed"), ("junk", None, "classified"))


def test_unreadable_folders_keep_their_files(spark):
    from stratafile import schema
    from stratafile.store import upsert_files

    row = lambda i, path: {c: None for c in schema.struct("files").names} | {"id": i, "drive_id": 1, "path": path, "status": "indexed", "priority": "normal", "is_original": False}
    frame = lambda rows: spark.createDataFrame([tuple(r.values()) for r in rows], schema.struct("files"))
    old = frame([row(1, "a/x"), row(2, "locked/y"), row(3, "locked/deep/z"), row(4, "lockedout/w"), row(5, "f")])
    got = upsert_files(old, frame([row(9, "a/x")]), 1, spark.createDataFrame([("locked",), ("f",)], "path string"))
    assert {r.path: r.status for r in got.collect()} == {"a/x": "indexed", "locked/y": "indexed", "locked/deep/z": "indexed", "lockedout/w": "source_removed", "f": "indexed"}


def test_appended_parts_versions_and_vacuum(spark, tmp_path, monkeypatch):
    import stratafile.store as store_

    monkeypatch.setattr(store_, "MOST_PARTS", 3)
    s = Store(spark, str(tmp_path / "s"))
    s.initialise()
    for i in range(6):
        s.log(f"act{i}")
    assert [r.action for r in s.read("audit_log").orderBy("id").collect()] == [f"act{i}" for i in range(6)] and s.version("audit_log") == 7
    assert s.read("audit_log", 3).count() == 2 and len(s.parts("audit_log", 7)) <= 3
    s.vacuum("audit_log")
    assert s.read("audit_log").count() == 6 and s.read("audit_log", 6).count() == 5
    with pytest.raises(StoreError):
        s.read("audit_log", 2)


def test_a_tree_with_one_folder_is_many_tasks(spark, tmp_path):
    for i in range(30):
        (tmp_path / "only" / f"d{i}" / "e").mkdir(parents=True)
        (tmp_path / "only" / f"d{i}" / "e" / "f.txt").write_text("x")
    (tmp_path / "only" / ".hidden").mkdir()
    (tmp_path / "only" / ".hidden" / "g.txt").write_text("x")
    (tmp_path / "link").symlink_to(tmp_path / "only")
    reader = fs.Reader(str(tmp_path), {})
    assert len(reader.partitions()) > 30
    tree = fs.entries(spark, str(tmp_path))
    assert tree.where("kind = 'file'").count() == 32 and tree.where("kind = 'dir'").count() == 62 and tree.select("path").distinct().count() == tree.count()
    assert fs.entries(spark, str(tmp_path), max_depth=3).where("kind = 'file'").count() == 2
    assert fs.entries(spark, str(tmp_path), prune_hidden=True).where("kind = 'file'").count() == 31


def test_a_second_writer_does_not_lose_the_first_ones_change(spark, tmp_path):
    one, two = Store(spark, str(tmp_path / "s")), Store(spark, str(tmp_path / "s"))
    one.initialise()
    one.log("first")

    def change(rows):
        two.log("meanwhile")
        return rows.limit(0)

    with pytest.raises(StoreError):
        one.update("audit_log", change)
    assert [r.action for r in two.read("audit_log").orderBy("id").collect()] == ["first", "meanwhile"]
    one.update("audit_log", lambda rows: rows.where("action = 'first'"))
    assert two.read("audit_log").count() == 1
