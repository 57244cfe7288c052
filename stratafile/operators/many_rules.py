"""Classification by hundreds of rules and more, where one expression with a regular expression for each pattern would be too large for generated code and would try all of them on every file.

The longest literal of each glob goes into one automaton (Aho-Corasick), which finds in one pass over a path all literals that are there; only globs whose literal is there are tried in full, and of
these only until the best rank that is known. Extensions are looked up in a table, sizes, ages and groups compared by columns. A file's result is the rank of its best rule; names and categories come by a
join with the rules, which are as many rows as there are rules.

Results are those of rules.best_match: the highest rule_priority, then the first name."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.globs import to_regex
from .rules import PLACEHOLDERS, Rule, ordered

NONE = np.iinfo(np.int32).max


def literal(glob: str) -> str:
    """The longest stretch of a glob that every match holds; empty if there is none."""
    pieces, now, i, depth = [], "", 0, 0
    while i < len(glob):
        c = glob[i]
        if c == "\\" and i + 1 < len(glob):
            i += 1
            now += "" if depth else glob[i]
        elif c == "[":
            pieces.append(now)
            now = ""
            i = glob.find("]", i + 2 + (glob[i + 1 : i + 2] in ("!", "^")))
        elif c in "*?{" or depth:
            depth += (c == "{") - (c == "}")
            pieces.append(now)
            now = ""
            # a ** between separators may stand for one of them
            if glob[i : i + 3] == "**/" and (i == 0 or glob[i - 1] == "/"):
                i += 2
        else:
            now += c
        i += 1
    pieces.append(now)
    return max((p.removesuffix("/") if glob.find("**") >= 0 else p for p in pieces), key=len)


class Matcher:
    """All rules, compiled in a worker."""

    def __init__(self, rules: list[Rule], as_duplicate: bool):
        import ahocorasick

        self.extensions: dict[str, int] = {}
        self.sizes, self.ages, self.groups, self.globs, self.always = [], [], [], [], []
        self.find = ahocorasick.Automaton()
        by_literal: dict[str, list[int]] = {}
        for rank, r in enumerate(ordered(rules)):
            if r.type == "pattern":
                for g in r.patterns:
                    self.globs.append((rank, re.compile(to_regex(g).removesuffix("$") + r"\Z")))
                    word = literal(g)
                    (by_literal.setdefault(word, []) if word else self.always).append(len(self.globs) - 1)
            elif r.type == "extension":
                for e in r.extensions:
                    self.extensions.setdefault(e.lower(), rank)
            elif r.type == "size":
                self.sizes.append((rank, r.min_bytes, r.max_bytes))
            elif r.type == "age":
                self.ages.append((rank, r.older_than_days, r.newer_than_days))
            else:
                self.groups.append((rank, as_duplicate and r.keep_strategy == "keeporiginal"))
        for word, some in by_literal.items():
            self.find.add_word(word, some)
        self.any = bool(by_literal)
        if self.any:
            self.find.make_automaton()

    def pattern_rank(self, paths: tuple[str | None, ...], best: int) -> int:
        for path in paths:
            if path is None:
                continue
            tried = set(self.always)
            if self.any:
                for _, some in self.find.iter(path):
                    tried.update(some)
            for g in sorted(tried):  # globs stand in the order of the rules
                rank, full = self.globs[g]
                if rank >= best:
                    break
                if full.match(path):
                    best = rank
                    break
        return best

    def __call__(self, batch: pa.RecordBatch) -> np.ndarray:
        n = batch.num_rows
        best = np.full(n, NONE, np.int64)
        column = lambda name: batch.column(batch.schema.get_field_index(name))

        def between(name, tests):
            x = column(name)
            there, values = ~x.is_null().to_numpy(zero_copy_only=False), x.fill_null(0).to_numpy()
            for rank, low, high in tests:
                # a rule without a bound takes every size, but no file without a time
                hit = np.ones(n, bool) if name == "_size" and low is None and high is None else there.copy()
                hit &= values >= low if low is not None else True
                hit &= values <= high if high is not None else True
                best[hit] = np.minimum(best[hit], rank)

        if self.sizes:
            between("_size", self.sizes)
        if self.ages:
            between("_days", self.ages)
        if self.groups:
            grouped = ~column("_group").is_null().to_numpy(zero_copy_only=False)
            first = column("_first").fill_null(True).to_numpy(zero_copy_only=False)
            for rank, copies_only in self.groups:
                hit = grouped & ~first if copies_only else grouped
                best[hit] = np.minimum(best[hit], rank)
        for i in range(0, n, 1024):
            part = batch.slice(i, 1024)
            get = lambda name: part.column(part.schema.get_field_index(name)).to_pylist()  # noqa: B023, E731
            for k, (ext, path, abs_path) in enumerate(zip(get("_ext"), get("_path"), get("_abs"))):
                at = min(int(best[i + k]), self.extensions.get(ext, NONE)) if ext is not None else int(best[i + k])
                best[i + k] = self.pattern_rank((path, abs_path), at)
        return best


def ranks(files: DataFrame, rules: list[Rule], as_of: Column, as_duplicate: bool = False, key: str = "id") -> DataFrame:
    """(key, rank) of the files that a rule matches; the rank is the place among the ordered rules. Keys are handed through, so they may repeat."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        match = Matcher(rules, as_duplicate)
        for batch in batches:
            best = match(batch)
            hit = pa.array(best < NONE)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(best, pa.int64()).cast(pa.int32(), safe=False)], names=["key", "rank"]).filter(hit)

    days = F.when(F.col("modified_at").isNotNull(), F.timestamp_diff("DAY", F.col("modified_at"), as_of)).cast("long")
    rows = files.select(F.col(key).alias("key"), F.lower("extension").alias("_ext"), F.col("path").alias("_path"), F.col("abs_path").alias("_abs"), F.col("size_bytes").cast("long").alias("_size"), days.alias("_days"), F.col("duplicate_group").alias("_group"), F.col("is_original").alias("_first"))
    return rows.mapInArrow(run, f"key {dict(files.dtypes)[key]}, rank int").withColumnRenamed("key", key)


def classify(files: DataFrame, rules: list[Rule], as_of: Column, exif: DataFrame | None = None, as_duplicate: bool = False) -> DataFrame:
    """files (one row an id) with a column `match`, as rules.classify gives it."""
    spark = files.sparkSession
    told = [(i, r.name, r.category, r.subcategory, r.subcategory_from_exif, r.file_priority, r.rule_priority) for i, r in enumerate(ordered(rules))]
    table = F.broadcast(spark.createDataFrame(told, "rank int, rule_name string, category string, fixed string, template string, priority string, rule_priority int"))  # a row for each rule
    found = ranks(files, rules, as_of, as_duplicate).join(table, "rank")
    if exif is not None:
        images = files.select("id", "abs_path").join(exif.select("abs_path", F.struct("year", "month", "day", "make", "model").alias("exif")), "abs_path").select("id", "exif")
        found = found.join(images, "id", "left")
        filled = F.col("template")
        for mark, column in PLACEHOLDERS.items():
            filled = F.replace(filled, F.lit(mark), F.coalesce(F.col(f"exif.{column}"), F.lit(mark)))
        found = found.withColumn("subcategory", F.when(F.col("template").isNotNull() & (F.col("template") != "") & F.col("exif").isNotNull(), filled).otherwise(F.col("fixed")))
    else:
        found = found.withColumn("subcategory", F.col("fixed"))
    match = found.select("id", F.struct("rule_name", "category", "subcategory", "priority", "rule_priority").alias("match"))
    return files.join(match, "id", "left")
