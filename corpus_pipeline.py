"""The corpus pipeline: stages over documents, each written as Parquet and read again as the next one's input."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratafile.llm import decontaminate, language_id, mixing, near_copies, sharding
from stratafile.llm.common import forget, made, scratch, table, written

SHARDS = 40


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 3. Documents without a letter, or whose letters fit no learned language, go: null and empty texts do, texts of any length are read whole, repeated rows fare
    alike, rows without a doc_id are judged like others but not learned from. Nothing to learn from, or an empty table: no rows. Further columns, whatever their names, stay as they are."""
    profiles = language_id.learn(docs.where(~language_id.held_out(F.col("doc_id"))))
    return language_id.known(docs, profiles)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4, with wide fingerprints. Of each group of near duplicates (shingles of five words, similarity 0.8 or more) the document with the smallest doc_id stays, once if it is
    repeated. Null texts and those without words are copies of each other; rows without a doc_id stay; texts of any length are compared whole; an empty table: no rows. Further columns stay as they are."""
    return near_copies.deduplicated(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7. Documents that hold half of a benchmark item of five words or more go. Null and empty texts are clean and stay; repeated rows fare alike; texts of any length are read whole; an empty benchmark
    drops nothing; an empty table: no rows. Further columns stay as they are."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 2. Documents are repeated or left out so that the sources' words meet their targets, and stand in the order of the schedule's slots: a copy for each slot that holds a
    document's first word. Texts without words hold no slot and go; a null source is a source; rows without a doc_id take part; of rows that repeat doc_id, text and source the
    copies are copies of one; an empty table: no rows. Further columns stay as they are."""
    return mixing.mixed(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10. Each row's shard and its place there: doc_id, size, text_crc32, shard, slot. Repeated rows and other equal texts share a shard unless they fill more than one; null texts count as empty; null metadata
    come first; an empty table: no rows. Further columns are not read."""
    return sharding.shard(docs, SHARDS)


STAGES = [("language", language), ("near_dedup", near_dedup), ("decontamination", decontamination), ("mix", mix), ("shard", shard)]
#: Language profiles, fingerprint components and tilings are beyond SQL; tests/llm compares the stages with brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage. What a stage wrote on its way is deleted once its result is there, and its result once the next one is."""
    docs, since = table(spark, sf_dir, "documents"), len(made)
    for name, stage in STAGES:
        path = scratch(spark, f"pipeline-{name}")
        docs = written(stage(spark, docs, sf_dir), name, path)
        forget(spark, since, path)
    return docs
