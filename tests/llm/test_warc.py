import hashlib
from pathlib import Path

import pytest

from stratafile.llm import warc


def expected(rows):
    last = {}
    for i, _, h in rows:
        b = (h or "").encode()
        if len(b) >= 1000 and i is not None:
            last[b] = max(i, last.get(b, i))
    out = []
    for i, _, h in rows:
        b = (h or "").encode()
        again = len(b) >= 1000 and i is not None and i < last[b]
        out.append((i, len(b), hashlib.sha1(b).hexdigest(), "revisit" if again else "response", last[b] if again else None))
    return sorted(out, key=str)


def record(body):
    n = len(body.encode())
    return f"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:777>\r\nContent-Length: {n}\r\n\r\n{body}\r\n\r\n"


TRAPS = [
    "text WARC/1.1\r\n more",
    "WARC/1.1\r\n",
    record("inner"),
    record("a") + record("b") + "tail",
    "x\r\n\r\n" + record("q" * 50) + record("WARC/1.1\r\n"),
    "WARC/1.1\r\nContent-Length: 5\r\n\r\n",
    "WARC/1.1\r\nContent-Length: -7\r\n\r\nabc",
    "WARC/1.1\r\nContent-Length: 99999999999999999999\r\n\r\nabc",
    "\r\n\r\n\r\n\r\n",
    "WARC/1.1\rWARC/1.1\nWWARC/1.1\r\nWARC/1.",
    "é" * 700 + record("ü"),
    "é" * 700 + record("ü"),
    "",
    None,
    "long " * 30_000,
]


@pytest.mark.parametrize("split", ["128m", "700b", "4k"])
def test_round_trip_with_version_lines_in_payloads(spark, split):
    rows = [(i, f"http://h/{i}" if i % 3 else None, TRAPS[i % len(TRAPS)]) for i in range(60)] + [(7, "http://again/7\r\nWARC-Type: x", TRAPS[7])]
    # ids that repeat with other texts
    rows += [(7, "u", "A" * 1500), (9, "u", "A" * 1500), (7, "u", "B" * 1500), (8, "u", "B" * 1500 + "b"), (9, "u", "B" * 1200), (3, "u", "B" * 1200)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    keys = {"spark.sql.files.maxPartitionBytes": split, "spark.sql.files.openCostInBytes": "0"}
    old = {k: spark.conf.get(k) for k in keys}
    try:
        for k, v in keys.items():
            spark.conf.set(k, v)
        got = warc.archived(pages).collect()
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert all(r.intact for r in got)
    assert sorted((tuple(r)[:5] for r in got), key=str) == expected(rows)


def test_payloads_come_back_whole(spark):
    rows = [(i, "u", t) for i, t in enumerate(TRAPS)]
    path = warc.scratch(spark, "test-warc")
    warc.write(spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1), path)
    got = {r.record_id: (r.type, bytes(r.payload)) for r in warc.read(spark, path, payload=True).collect()}
    for i, (_, _, t) in enumerate(rows):
        kind, body = got[f"<urn:page:{i}>"]
        assert body == (b"" if kind == "revisit" else (t or "").encode())


def test_empty_table_null_id_and_clashing_columns(spark):
    empty = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.archived(empty).collect() == []
    odd = spark.createDataFrame([(None, "u", "x" * 2000, "r", "b"), (1, None, "x" * 2000, "r", "b"), (2, "", "x" * 2000, None, None)], "page_id long, url string, html string, response string, body string")
    assert sorted((tuple(r)[:5] for r in warc.archived(odd).collect()), key=str) == sorted(
        [(None, 2000, hashlib.sha1(b"x" * 2000).hexdigest(), "response", None), (1, 2000, hashlib.sha1(b"x" * 2000).hexdigest(), "revisit", 2), (2, 2000, hashlib.sha1(b"x" * 2000).hexdigest(), "response", None)], key=str
    )


def lay(spark, name, text):
    path = warc.scratch(spark, name)
    folder = Path(path.removeprefix("file://"))
    folder.mkdir(parents=True)
    (folder / "a.warc").write_bytes(text.encode())
    return path


def test_older_version_missing_end_and_broken_chains(spark):
    old = record("one").replace("WARC/1.1", "WARC/1.0") + record("WARC/1.0\r\n and WARC/1.x").replace("WARC/1.1", "WARC/1.0", 1) + record("three")
    for text in (old, old[:-4]):
        got = warc.read(spark, lay(spark, "test-old", text), payload=True).orderBy("offset").collect()
        assert [bytes(r.payload).decode() for r in got] == ["one", "WARC/1.0\r\n and WARC/1.x", "three"]
    four = [record(x) for x in ("one", "two", "three", "four")]
    for wrong in ("Content-Length: 2", "Content-Length: 9", "Content-Length: 4000", "No-Length: 3"):
        path = lay(spark, "test-broken", four[0] + four[1].replace("Content-Length: 3", wrong) + four[2] + four[3])
        with pytest.raises(ValueError, match="break off"):
            warc.read(spark, path)
        assert "one" in [bytes(r.payload).decode() for r in warc.read(spark, path, payload=True, strict=False).collect()]
    with pytest.raises(ValueError, match="break off"):
        warc.read(spark, lay(spark, "test-junk", "junk before" + old))
    assert warc.read(spark, lay(spark, "test-none", "no archive")).collect() == []
