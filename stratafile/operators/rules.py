"""Classification rules: read from TOML, compiled to one projection, the best match of each file kept.

All rules are conditions in generated code, so one scan classifies all files without a shuffle."""

from __future__ import annotations

import tomllib
from dataclasses import dataclass, field
from functools import reduce
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import ConfigError
from ..functions.globs import matches_any
from ..schema import ENUMS

DEFAULT_PRIORITY = 50
#: Rules that are one expression in generated code, at most.
MANY = 100
TYPES = ("pattern", "extension", "size", "age", "duplicate")
STRATEGIES = ("keepoldest", "keepnewest", "keeporiginal")
EXIF_EXTENSIONS = ("jpg", "jpeg", "png", "heic", "heif", "tiff", "tif")
#: Column of an EXIF table for each placeholder.
PLACEHOLDERS = {"{exif_year}": "year", "{exif_month}": "month", "{exif_day}": "day", "{exif_make}": "make", "{exif_model}": "model"}


@dataclass
class Rule:
    name: str
    type: str
    category: str
    patterns: list[str] = field(default_factory=list)
    extensions: list[str] = field(default_factory=list)
    min_bytes: int | None = None
    max_bytes: int | None = None
    older_than_days: int | None = None
    newer_than_days: int | None = None
    keep_strategy: str | None = None
    subcategory: str | None = None
    subcategory_from_exif: str | None = None
    priority: str | None = None
    rule_priority: int = DEFAULT_PRIORITY

    def __post_init__(self):
        if self.type not in TYPES:
            raise ConfigError(f"rule {self.name!r}: unknown type {self.type!r}")
        if not self.category:
            raise ConfigError(f"rule {self.name!r} has no category")
        if self.type == "pattern" and not isinstance(self.patterns, list) or self.type == "extension" and not isinstance(self.extensions, list):
            raise ConfigError(f"rule {self.name!r}: a list is asked for")
        if self.type == "duplicate":
            self.keep_strategy = (self.keep_strategy or "").replace("_", "").lower()
            if self.keep_strategy not in STRATEGIES:
                raise ConfigError(f"rule {self.name!r}: unknown keep_strategy")

    @property
    def file_priority(self) -> str:
        """The named priority, normal if there is none or it isn't allowed."""
        return self.priority if self.priority in ENUMS["priority"] else "normal"

    def matches(self, as_of: Column, as_duplicate: bool = False) -> Column:
        """Whether a file of the catalogue's files table matches; never null."""
        if self.type == "pattern":
            return matches_any(self.patterns, F.col("path"), F.col("abs_path"))
        if self.type == "extension":
            return F.coalesce(F.lower("extension").isin(*[e.lower() for e in self.extensions]), F.lit(False)) if self.extensions else F.lit(False)
        tests = []
        if self.type == "size":
            tests = [F.col("size_bytes") >= self.min_bytes] * (self.min_bytes is not None) + [F.col("size_bytes") <= self.max_bytes] * (self.max_bytes is not None)
        elif self.type == "age":
            days = F.timestamp_diff("DAY", F.col("modified_at"), as_of)
            tests = [F.col("modified_at").isNotNull()]
            tests += [days >= self.older_than_days] * (self.older_than_days is not None) + [days <= self.newer_than_days] * (self.newer_than_days is not None)
        else:
            tests = [F.col("duplicate_group").isNotNull()] + ([~F.col("is_original")] if as_duplicate and self.keep_strategy == "keeporiginal" else [])
        return F.coalesce(reduce(lambda a, b: a & b, tests, F.lit(True)), F.lit(False))

    def subcategory_column(self, exif: bool) -> Column:
        """The EXIF template filled in where the file has EXIF data, else the fixed subcategory. Parts that are missing stay as they are written."""
        fixed = F.lit(self.subcategory).cast("string")
        if not self.subcategory_from_exif or not exif:
            return fixed
        filled = F.lit(self.subcategory_from_exif)
        for mark, column in PLACEHOLDERS.items():
            filled = F.replace(filled, F.lit(mark), F.coalesce(F.col(f"exif.{column}"), F.lit(mark)))
        return F.when(F.col("exif").isNotNull(), filled).otherwise(fixed)


def from_toml(text: str) -> list[Rule]:
    """Rules of a TOML text, best first; a rule's name is the key of its table."""
    try:
        tables = tomllib.loads(text).get("rules", {})
    except tomllib.TOMLDecodeError as e:
        raise ConfigError(f"rules can't be read: {e}") from e
    return ordered([from_table(name, x) for name, x in tables.items()])


def from_table(name: str, table: dict) -> Rule:
    known = set(Rule.__dataclass_fields__) - {"name"}
    if "type" not in table or "category" not in table:
        raise ConfigError(f"rule {name!r} needs a type and a category")
    return Rule(name=name, **{k: v for k, v in table.items() if k in known})


def from_file(path: str) -> list[Rule]:
    return from_toml(Path(path).read_text(encoding="utf-8"))


def ordered(rules: list[Rule]) -> list[Rule]:
    """By falling rule_priority, then by name."""
    return sorted(rules, key=lambda r: (-r.rule_priority, r.name))


def merged(*sets: list[Rule]) -> list[Rule]:
    """One rule for each name; later sets win."""
    return ordered(list({r.name: r for rules in sets for r in rules}.values()))


def _quoted(text: str) -> str:
    return '"' + "".join({"\\": "\\\\", '"': '\\"', "\n": "\\n", "\t": "\\t", "\r": "\\r"}.get(c, c if c >= " " else f"\\u{ord(c):04x}") for c in text) + '"'


def to_toml(rules: list[Rule]) -> str:
    """A TOML text that from_toml reads as the same rules."""
    value = lambda v: "[" + ", ".join(map(_quoted, v)) + "]" if isinstance(v, list) else _quoted(v) if isinstance(v, str) else str(v)
    keep = {"pattern": ("patterns",), "extension": ("extensions",)}
    out = []
    for r in rules:
        out.append(f"[rules.{_quoted(r.name)}]")
        for k in Rule.__dataclass_fields__:
            v = getattr(r, k)
            if k != "name" and v is not None and not (isinstance(v, list) and k not in keep.get(r.type, ())):
                out.append(f"{k} = {value(v)}")
        out.append("")
    return "\n".join(out)


def to_file(rules: list[Rule], path: str) -> None:
    Path(path).write_text(to_toml(rules), encoding="utf-8")


def best_match(rules: list[Rule], as_of: Column, exif: bool = False, as_duplicate: bool = False) -> Column:
    """A struct (rule_name, category, subcategory, priority, rule_priority) of the best rule that matches, null if none does: the highest rule_priority, then the first name.

    Rules are tried in that order and the first match ends the search."""
    out = F.lit(None)
    for r in reversed(ordered(rules)):
        named = F.struct(F.lit(r.name).alias("rule_name"), F.lit(r.category).alias("category"), r.subcategory_column(exif).alias("subcategory"), F.lit(r.file_priority).alias("priority"), F.lit(r.rule_priority).alias("rule_priority"))
        out = F.when(r.matches(as_of, as_duplicate), named).otherwise(out)
    return out if rules else F.lit(None).cast("struct<rule_name:string,category:string,subcategory:string,priority:string,rule_priority:int>")


def classify(files: DataFrame, rules: list[Rule], as_of: Column, exif: DataFrame | None = None, as_duplicate: bool = False) -> DataFrame:
    """files with a column `match`. exif: (abs_path, year, month, day, make, model) of the images that have any. More than MANY rules go through one automaton (many_rules), fewer are one expression."""
    if len(rules) > MANY:
        from . import many_rules

        return many_rules.classify(files, rules, as_of, exif, as_duplicate)
    if exif is not None:
        parts = exif.select("abs_path", F.struct("year", "month", "day", "make", "model").alias("exif"))
        files = files.join(parts, "abs_path", "left")
    return files.withColumn("match", best_match(rules, as_of, exif is not None, as_duplicate)).drop("exif")


def apply_matches(classified: DataFrame) -> DataFrame:
    """The files table with matches written into it; files without a match stay as they are."""
    hit = F.col("match").isNotNull()
    put = lambda name: F.when(hit, F.col(f"match.{name}")).otherwise(F.col(name)).alias(name)
    new = {"category": put("category"), "subcategory": put("subcategory"), "priority": put("priority"), "status": F.when(hit, F.lit("classified")).otherwise(F.col("status")).alias("status")}
    return classified.select(*[new.get(c, F.col(c)) for c in classified.columns if c != "match"])


def auto_classify(files: DataFrame, rules: list[Rule], as_of: Column, exif: DataFrame | None = None, candidates: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """(files, counters): unclassified files get the category of their best rule; counters: classified and skipped. candidates narrows the choice."""
    open_ = F.col("category").isNull() & (F.col("status") == "indexed")
    open_ = open_ & candidates if candidates is not None else open_
    x = classify(files, rules, as_of, exif).withColumn("_open", F.coalesce(open_, F.lit(False)))
    counters = x.where("_open").agg(F.count_if(F.col("match").isNotNull()).alias("classified"), F.count_if(F.col("match").isNull()).alias("skipped"))
    return apply_matches(x.withColumn("match", F.when(F.col("_open"), F.col("match"))).drop("_open")).select(*files.columns), counters


def review_batches(classified: DataFrame) -> DataFrame:
    """(category, subcategory, file_count, total_bytes) of the suggestions, most files first."""
    rows = classified.where("match is not null").groupBy(F.col("match.category").alias("category"), F.col("match.subcategory").alias("subcategory"))
    return rows.agg(F.count("*").alias("file_count"), F.sum("size_bytes").alias("total_bytes")).orderBy(F.desc("file_count"), "category", "subcategory")


def batch_samples(classified: DataFrame, n: int = 3) -> DataFrame:
    """The first n files of each batch, by id. Each task keeps n a batch before the shuffle."""
    from pyspark.sql import Window

    rows = classified.where("match is not null").select(F.col("match.category").alias("category"), F.col("match.subcategory").alias("subcategory"), "id", "filename", "size_bytes")
    return rows.withColumn("place", F.row_number().over(Window.partitionBy("category", "subcategory").orderBy("id"))).where(F.col("place") <= n)


def apply_review(classified: DataFrame, decisions: DataFrame) -> DataFrame:
    """The files table after a review of its batches. decisions (category, subcategory, action, new_category, new_subcategory): accept, override or skip; batches without one are skipped."""
    d = decisions.select(F.col("category").alias("_c"), F.col("subcategory").alias("_s"), "action", "new_category", "new_subcategory")
    x = classified.join(d, F.col("match.category").eqNullSafe(d["_c"]) & F.col("match.subcategory").eqNullSafe(d["_s"]), "left")
    m = F.col("match")
    over = F.struct(m["rule_name"].alias("rule_name"), F.col("new_category").alias("category"), F.col("new_subcategory").alias("subcategory"), m["priority"].alias("priority"), m["rule_priority"].alias("rule_priority"))
    x = x.withColumn("match", F.when(F.col("action") == "accept", m).when(F.col("action") == "override", over)).drop("_c", "_s", "action", "new_category", "new_subcategory")
    return apply_matches(x)


def apply_file_review(classified: DataFrame, decisions: DataFrame) -> DataFrame:
    """The files table after a review file by file. decisions (id, action, new_category, new_subcategory), one for a file: accept its match, override it, or skip; an override needs no match."""
    x = classified.join(decisions.select("id", "action", "new_category", "new_subcategory"), "id", "left")
    m = F.col("match")
    over = F.struct(m["rule_name"].alias("rule_name"), F.col("new_category").alias("category"), F.col("new_subcategory").alias("subcategory"), F.lit("normal").alias("priority"), m["rule_priority"].alias("rule_priority"))
    x = x.withColumn("match", F.when(F.col("action") == "accept", m).when((F.col("action") == "override") & F.col("new_category").isNotNull(), over))
    return apply_matches(x.select(*classified.columns))


def set_classification(files: DataFrame, chosen: Column, category: str, subcategory: str | None = None, priority: str | None = None, keep_subcategory: bool = False) -> DataFrame:
    """One category for the chosen files, whatever they had."""
    chosen = F.coalesce(chosen, F.lit(False))
    out = files.withColumns({"category": F.when(chosen, F.lit(category)).otherwise(F.col("category")), "priority": F.when(chosen, F.lit(priority if priority in ENUMS["priority"] else "normal")).otherwise(F.col("priority")), "status": F.when(chosen, F.lit("classified")).otherwise(F.col("status"))})
    return out if keep_subcategory else out.withColumn("subcategory", F.when(chosen, F.lit(subcategory)).otherwise(F.col("subcategory")))
