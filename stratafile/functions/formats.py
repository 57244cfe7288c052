"""Texts of sizes, durations, times and paths as columns, and columns from such texts. No Python runs on rows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UNITS = ("KB", "MB", "GB", "TB")


def format_bytes(size: Column) -> Column:
    """512 B, 1.00 KB, ... up to TB; ties round half to even."""
    out = F.concat(size.cast("string"), F.lit(" B"))
    for i, unit in enumerate(UNITS):
        step = 1024 ** (i + 1)
        out = F.when(size >= step, F.format_string(f"%.2f {unit}", F.bround(size / F.lit(float(step)), 2))).otherwise(out)
    return F.when(size.isNotNull(), out)


def parse_size(text: Column) -> Column:
    """Bytes of a text such as 1.5 MB; no unit means bytes; null if it is no size."""
    number = F.regexp_extract(text, r"(?i)^\s*([0-9]+(?:\.[0-9]*)?|\.[0-9]+)\s*([KMGT]?B)?\s*$", 1)
    unit = F.upper(F.regexp_extract(text, r"(?i)^\s*(?:[0-9]+(?:\.[0-9]*)?|\.[0-9]+)\s*([KMGT]?B)?\s*$", 1))
    factor = F.lit(1.0)
    for i, u in enumerate(UNITS):
        factor = F.when(unit == u, float(1024 ** (i + 1))).otherwise(factor)
    return F.floor(number.try_cast("double") * factor).cast("long")


def parse_device_size(text: Column) -> Column:
    """Bytes of a device tool's size: a number with K, M, G, T or nothing behind it."""
    number = F.regexp_extract(text, r"(?i)^\s*([0-9]+(?:\.[0-9]*)?)\s*([KMGT])?\s*$", 1)
    unit = F.upper(F.regexp_extract(text, r"(?i)^\s*[0-9]+(?:\.[0-9]*)?\s*([KMGT])?\s*$", 1))
    factor = F.lit(1.0)
    for i, u in enumerate("KMGT"):
        factor = F.when(unit == u, float(1024 ** (i + 1))).otherwise(factor)
    return F.floor(number.try_cast("double") * factor).cast("long")


def _div(a: Column, n: int) -> Column:
    return F.floor(a / n).cast("long")


def format_duration(seconds: Column) -> Column:
    """1h 1m 5s, 1m 30s or 45s."""
    s = seconds.cast("long")
    hours, minutes, rest = _div(s, 3600), _div(s % 3600, 60), s % 60
    tail = F.concat(minutes.cast("string"), F.lit("m "), rest.cast("string"), F.lit("s"))
    return F.when(hours > 0, F.concat(hours.cast("string"), F.lit("h "), tail)).when(minutes > 0, tail).otherwise(F.concat(rest.cast("string"), F.lit("s")))


def format_timestamp(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd HH:mm:ss")


def parse_timestamp(text: Column) -> Column:
    """RFC 3339 or YYYY-MM-DD HH:MM:SS; null, never the present, if it is neither."""
    return F.try_to_timestamp(text)


#: The first url of a git configuration.
GIT_URL = r"(?m)^[ \t]*url = (.*)$"


def git_remote(text: Column) -> Column:
    """The first url of a git configuration, trimmed; null if there is none."""
    return F.nullif(F.trim(F.regexp_extract(text, GIT_URL, 1)), F.lit(""))


def filename(path: Column) -> Column:
    return F.regexp_extract(path, r"[^/]+$", 0)


def extension(name: Column) -> Column:
    """What follows the last dot of a file name; null for names without one or with nothing before it."""
    return F.nullif(F.regexp_extract(name, r".\.([^.]*)$", 1), F.lit(""))


def relative(path: Column, base: Column) -> Column:
    """path below base; path itself if it isn't."""
    root = F.concat(F.regexp_replace(base, "/+$", ""), F.lit("/"))
    return F.when(F.startswith(path, root), F.substring(path, F.length(root) + 1, F.length(path))).otherwise(path)


def tail(text: Column, longest: int, keep: int) -> Column:
    """The text, or dots and its last `keep` characters if it is longer than `longest`."""
    return F.when(F.length(text) > longest, F.concat(F.lit("..."), F.right(text, F.lit(keep)))).otherwise(text)


def short_hash(value: Column, keep: int = 12) -> Column:
    return F.when(F.length(value) > keep, F.concat(F.left(value, F.lit(keep)), F.lit("..."))).otherwise(value)


def shown(value: Column) -> Column:
    """The value, - for null."""
    return F.coalesce(value.cast("string"), F.lit("-"))


def ids_to_json(ids: Column) -> Column:
    return F.to_json(ids)


def ids_from_json(text: Column) -> Column:
    """A JSON list of ids; an empty list if it is none."""
    return F.coalesce(F.from_json(text, "array<bigint>"), F.array().cast("array<bigint>"))


def ids_from_list(text: Column) -> Column:
    """The ids of a comma list; parts that are no number are left out."""
    parts = F.transform(F.split(text, ","), lambda x: F.trim(x).try_cast("long"))
    return F.filter(parts, lambda x: x.isNotNull())


def preferred_hash(blake3: Column, md5: Column) -> Column:
    return F.coalesce(blake3, md5)


def destination(mount: Column, path: Column, target_path: Column | None = None) -> Column:
    return F.concat(mount, F.lit("/"), F.coalesce(target_path, path) if target_path is not None else path)


def safe_write_bytes(free: Column, available: Column, part: float = 0.5) -> Column:
    """How much may be written: part of the free bytes, and no more than are available."""
    return F.least(F.floor(free * part).cast("long"), available)


def contains_like(column: Column, pattern: str) -> Column:
    """Whether the column holds the pattern, letters in either case; % and _ in it are wildcards, nothing escapes them."""
    escape = next(c for c in "\\!|~^\x01\x02" if c not in pattern)
    return F.ilike(column, F.lit(f"%{pattern}%"), F.lit(escape))
