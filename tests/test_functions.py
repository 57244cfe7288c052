import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from stratafile.functions import formats, globs, hashing


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("n,text", [(0, "0 B"), (512, "512 B"), (1024, "1.00 KB"), (1536, "1.50 KB"), (1024**2, "1.00 MB"), (1024**3, "1.00 GB"), (1024**4, "1.00 TB"), (1024**5, "1024.00 TB"), (1152, "1.12 KB"), (None, None)])
def test_format_bytes(spark, n, text):
    assert one(spark, formats.format_bytes(F.lit(n).cast("long"))) == text


@pytest.mark.parametrize("text,n", [("512B", 512), ("1KB", 1024), ("1.5 MB", 1572864), ("2GB", 2147483648), ("100", 100), (" 3 tb ", 3 * 1024**4), ("x", None), ("1.5d", None), ("", None), (None, None), ("-1", None)])
def test_parse_size(spark, text, n):
    assert one(spark, formats.parse_size(F.lit(text).cast("string"))) == n


@pytest.mark.parametrize("text,n", [("1024", 1024), ("1K", 1024), ("1M", 1024**2), ("1G", 1024**3), ("1.5G", 3 * 1024**3 // 2), ("2t", 2 * 1024**4), ("1KB", None)])
def test_device_sizes(spark, text, n):
    from stratafile.sources.devices import device_size

    assert one(spark, formats.parse_device_size(F.lit(text))) == n == device_size(text)


@pytest.mark.parametrize("s,text", [(0, "0s"), (45, "45s"), (90, "1m 30s"), (3665, "1h 1m 5s"), (3600, "1h 0m 0s")])
def test_format_duration(spark, s, text):
    assert one(spark, formats.format_duration(F.lit(s))) == text


def test_names_and_texts(spark):
    cases = {"a/b.txt": ("b.txt", "txt"), ".bashrc": (".bashrc", None), "x/.cfg.json": (".cfg.json", "json"), "noext": ("noext", None), "a.b/c": ("c", None), "dot.": ("dot.", None)}
    for path, (name, ext) in cases.items():
        got = formats.filename(F.lit(path))
        assert (one(spark, got), one(spark, formats.extension(got))) == (name, ext)
    assert one(spark, formats.relative(F.lit("/mnt/a/b"), F.lit("/mnt/"))) == "a/b"
    assert one(spark, formats.relative(F.lit("/mntx/a"), F.lit("/mnt"))) == "/mntx/a"
    assert one(spark, formats.tail(F.lit("x" * 61), 60, 57)) == "..." + "x" * 57
    assert one(spark, formats.short_hash(F.lit("a" * 32))) == "a" * 12 + "..."
    assert one(spark, formats.ids_from_json(F.lit("no"))) == [] and one(spark, formats.ids_from_json(F.lit("[1,2]"))) == [1, 2]
    assert one(spark, formats.ids_from_list(F.lit("1, 2,x,,3"))) == [1, 2, 3]
    assert one(spark, formats.safe_write_bytes(F.lit(500_000_000), F.lit(500_000_000))) == 250_000_000
    for text, hit in (("Dir/File_1", True), ("xx", False)):
        assert one(spark, formats.contains_like(F.lit(text), "ir/f%_1")) is hit
    assert one(spark, formats.contains_like(F.lit(r"a\b"), "\\")) is True


@pytest.mark.parametrize(
    "glob,path,hit",
    [
        ("**/node_modules/**", "project/node_modules/package/index.js", True), ("**/node_modules/**", "node_modules/x", True), ("**/node_modules/**", "/node_modules/x", True), ("**/node_modules/**", "my_node_modules/x", False),
        ("**/*.txt", "readme.txt", True), ("**/*.txt", "a/b/readme.txt", True), ("*.txt", "a/b.txt", True), ("**/*~", "a/b~", True), ("*.{jpg,png}", "x/y.png", True), ("*.{jpg,png}", "x/y.gif", False),
        ("[a-c]?.x", "b1.x", True), ("[!a-c]?.x", "b1.x", False), ("a/**/b", "a/b", True), ("a/**/b", "a/x/y/b", True), ("A.TXT", "a.txt", False), (r"\*", "*", True), (r"\*", "x", False), ("a+b(c)", "a+b(c)", True), ("a/**", "a/b", True), ("a/**", "a", False),
    ],
)
def test_globs(spark, glob, path, hit):
    assert bool(re.search(globs.to_regex(glob).replace("(?s)", ""), path, re.S)) is hit
    assert one(spark, globs.matches_any([glob], F.lit(path))) is hit


@settings(max_examples=200, deadline=None)
@given(st.text("ab/.x", max_size=8), st.lists(st.sampled_from(["a", "b", "/", ".", "x", "*", "?"]), max_size=6))
def test_globs_against_a_slow_matcher(path, parts):
    glob = "".join(parts)
    if "**" in glob:
        return

    def slow(g, p):
        if not g:
            return not p
        if g[0] == "*":
            return any(slow(g[1:], p[i:]) for i in range(len(p) + 1))
        return bool(p) and (g[0] == "?" or g[0] == p[0]) and slow(g[1:], p[1:])

    assert bool(re.search(globs.to_regex(glob).replace("(?s)", ""), path, re.S)) is slow(glob, path)


@settings(max_examples=50, deadline=None)
@given(st.integers(0, 1024**5))
def test_size_texts_round_trip(n):
    from stratafile.plans.policy import size_of

    for unit, factor in (("B", 1), ("KB", 1024), ("GB", 1024**3)):
        assert size_of(f"{n // factor} {unit}") == n // factor * factor


BLAKE3 = {0: "af1349b9f5f9a1a6a0404dea36dcc9499bcb25c9adc112b7cc9a93cae41f3262", 1: "2d3adedff11b61f14c886e35afa036736dcd87a74d27b5c1510225d0f592e213", 1024: "42214739f095a406f3fc83deb889744ac00df831c10daa55189b5d121c855af7", 1025: "d00278ae47eb27b34faecf67b4fe263f82d5412916c1ffd97c8cb7fb814b8444", 2048: "e776b6028c7cd22a4d0ba182a8bf62205d2ef576467e838ed6f2529b85fba24a"}


def test_hash_vectors(tmp_path):
    pattern = bytes(range(251)) * 500
    for n, want in BLAKE3.items():
        assert hashing.digest(pattern[:n], "blake3") == want
    assert hashing.digest(b"hello world", "blake3") == "d74981efa70a0c880b8d8c1985d075dbcbf679b99a5f9914e5aaf96b831a9e24"
    assert hashing.digest(b"hello world", "md5") == "5eb63bbbe01eeed093cb22bb8f5acdc3"
    assert hashing.digest(b"", "md5") == "d41d8cd98f00b204e9800998ecf8427e"
    file = tmp_path / "a"
    file.write_bytes(b"a" * 1024 * 1024)
    told = []
    assert len(hashing.hash_file(str(file), "md5", told.append)) == 32 and told[-1] == 1024 * 1024
    big = pattern * 20
    for step in (1, 700, 65_536, 1_048_577):
        h = hashing.Blake3()
        for i in range(0, min(len(big), step * 900), step):
            h.update(big[i : min(i + step, step * 900)])
        assert h.hexdigest() == hashing.digest(big[: step * 900], "blake3")


def test_verify(spark):
    rows = spark.createDataFrame([("AB" * 16, "ab" * 16, None), ("ab" * 32, None, "AB" * 32), ("0" * 32, "1" * 32, None)], "e string, m string, b string")
    assert [r[0] for r in rows.select(hashing.verify(F.col("e"), F.col("m"), F.col("b"))).collect()] == [True, True, False]
    with pytest.raises(Exception, match="no hash has this length"):
        rows.select(hashing.verify(F.lit("abc"), F.col("m"), F.col("b"))).collect()
    with pytest.raises(ValueError):
        hashing.algorithm_of("abc")
    with pytest.raises(ValueError):
        hashing.hasher("sha1")


def test_files_are_hashed_once(spark, tmp_path):
    (tmp_path / "a").write_bytes(b"hello world")
    rows = spark.createDataFrame([(1, str(tmp_path / "a"), None, "kept", False, None), (2, "/no/such", None, None, False, None), (3, str(tmp_path / "a"), None, None, True, None)], "id long, abs_path string, md5_hash string, blake3_hash string, is_symlink boolean, error string")
    got = {r.id: r for r in hashing.with_missing_hashes(rows, "blake3").collect()}
    assert got[1].blake3_hash == "kept" and got[2].blake3_hash is None and "such" in got[2].error and got[3].blake3_hash is None
    assert {r.id: r.md5_hash for r in hashing.with_missing_hashes(rows, "md5").collect()}[1] == "5eb63bbbe01eeed093cb22bb8f5acdc3"
    assert {r.id: r.blake3_hash for r in hashing.with_missing_hashes(rows, "blake3", rehash=True).collect()}[1].startswith("d74981ef")
