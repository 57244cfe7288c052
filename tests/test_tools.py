import io
import json

import pytest

from stratafile import __main__ as cli
from stratafile import tools
from stratafile.api import Catalogue
from stratafile.errors import InputError


@pytest.fixture
def folder(tmp_path):
    for name, text in {"one/a.txt": "x", "one/b.tmp": "x", "two/c.txt": "yy"}.items():
        p = tmp_path / name
        p.parent.mkdir(exist_ok=True)
        p.write_text(text)
    return tmp_path


def test_tools_over_standard_input(spark, folder):
    c = Catalogue(spark, str(folder / "cat"))
    asks = [
        {"id": 1, "method": "initialize"}, {"method": "notifications/initialized"}, {"id": 2, "method": "tools/list"},
        {"id": 3, "method": "tools/call", "params": {"name": "drive_add", "arguments": {"label": "one", "mount_path": str(folder / "one")}}},
        {"id": 4, "method": "tools/call", "params": {"name": "dedup_refresh", "arguments": {"drive": "one", "algorithm": "md5"}}},
        {"id": 5, "method": "tools/call", "params": {"name": "query_files", "arguments": {"extension": "txt"}}},
        {"id": 6, "method": "tools/call", "params": {"name": "space_check", "arguments": {"drive": "none"}}}, {"id": 7, "method": "nope"},
        {"id": 8, "method": "tools/call", "params": {"name": "plan_show", "arguments": {}}},
    ]
    out = io.StringIO()
    tools.serve(c, io.StringIO("\n".join(map(json.dumps, asks)) + "\n\nno json\n"), out)
    got = {a["id"]: a for a in map(json.loads, out.getvalue().splitlines())}
    assert len(got[2]["result"]["tools"]) == 24 and got[1]["result"]["serverInfo"]["name"]
    text = lambda i: json.loads(got[i]["result"]["content"][0]["text"])
    assert text(3) == 1 and text(4)[0]["group_count"] == 1 and [r["path"] for r in text(5)] == ["a.txt"]
    assert got[6]["result"]["isError"] and "DriveNotFound" in got[6]["result"]["content"][0]["text"] and got[7]["error"]["code"] == -32601 and got[8]["result"]["isError"] and got[None]["error"]
    assert next(t for t in got[2]["result"]["tools"] if t["name"] == "drive_add")["inputSchema"]["required"] == ["label"]
    with pytest.raises(InputError):
        tools.call(c, "nothing")


def test_command_line(spark, folder, capsys):
    (folder / "rules.toml").write_text('[rules.t]\ntype="pattern"\npatterns=["*.tmp"]\ncategory="trash"\n')
    (folder / "p.toml").write_text('version="1"\nname="n"\n')

    def run(*words):
        code = cli.main(["--catalogue", str(folder / "cat"), *map(str, words)])
        said = capsys.readouterr()
        return code, said.out + said.err

    assert run("drive", "add", "one", folder / "one") == (0, "drive 1\n")
    assert run("drive", "add", "two", folder / "two", "--role", "backup")[0] == 0
    assert "files_scanned" in run("scan", "--all")[1] and run("scan")[0] == 1
    assert "group_count" in run("dedup", "refresh")[1]
    assert "one" in run("drive", "list")[1] and "one" in run("drive", "info", "one")[1] and run("drive", "info", "x") == (1, "DriveNotFound: x\n")
    assert "classified" in run("status")[1] and "used_bytes" in run("status", "--space")[1]
    for words in (["duplicates"], ["unclassified"], ["category", "trash"], ["large-files", "--min-size", "1 B"], ["backup-unique"], ["backup-unique", "two"], ["files", "--extension", "txt"]):
        assert run("query", *words)[0] == 0
    assert "trash" in run("classify", "--config", folder / "rules.toml")[1] and "classified" in run("classify", "--config", folder / "rules.toml", "--auto")[1]
    assert run("plan", "create", "delete-trash") == (0, "plan 1\n") and "delete" in run("plan", "show", 1)[1] and run("plan", "approve", 1)[0] == 0 and "approved" in run("plan", "list")[1]
    assert run("migrate", 1)[0] == 1 and "would delete" in run("migrate", 1, "--dry-run")[1] and "completed" in run("migrate", 1, "--execute")[1]
    assert not (folder / "one" / "b.tmp").exists() and run("rollback", 1, "--execute")[0] == 1 and run("rollback", 1, "--dry-run")[0] == 0
    assert "verified" in run("verify")[1] and "Drives" in run("report")[1] and run("export", "json", folder / "r.json")[0] == 0
    assert "name='n'" in run("policy", "show", folder / "p.toml")[1] and run("run-policy", folder / "p.toml", "--dry-run") == (0, "plans []\n")
    (folder / "lint.json").write_text("")
    assert run("rmlint", "import", folder / "lint.json")[0] == 0 and run("drive", "offline", "two")[0] == 0 and run("drive", "remove", "two")[0] == 0


def test_answers_are_whole_and_in_order(spark):
    class Stub:
        def query_files(self, limit=None):
            rows = spark.range(2500).orderBy("id", ascending=False)
            return rows if limit is None else rows.limit(limit)

    ids = lambda args: [r["id"] for r in json.loads(tools.call(Stub(), "query_files", args))]
    assert ids({}) == list(range(2499, -1, -1))
    assert ids({"limit": 1200}) == list(range(2499, 1299, -1)) and ids({"limit": 3}) == [2499, 2498, 2497]
