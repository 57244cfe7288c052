"""The registered queries of this subpackage, one for each operator, and the SQL they are compared with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .centroids import cluster
from .common import scratch, table
from .decontaminate import contaminated
from .exact_dedup import exact_dedup
from .html_text import extract
from .importance import resample
from .language_id import languages
from .mixing import mix
from .quality import quality
from .sharding import shard
from .simhash import near_duplicates
from .sql import SQL
from .token_counts import token_counts
from .url_filter import filter_urls
from .warc import archived

TOKENIZER = "word_bpe_49k.json"
TOKEN_LIMIT = 2048


#: (verdict, host/path)
URL_RULES = [("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/")]


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archived(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return languages(table(spark, sf_dir, "documents"))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op5_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each document and benchmark item that it holds."""
    found = contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "coverage", "matched_words", "item_words", F.size("tiles").cast("long").alias("n_tiles"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two calls on one cache: the first counts the history, the lower half of the range of doc_id, the second all documents, of which those of the history are found."""
    import public_tokenizers

    docs, path, cache = table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER), scratch(spark, "op8-cache")
    low, high = docs.agg(F.min("doc_id"), F.max("doc_id")).first()
    if low is not None:
        token_counts(docs.where(F.col("doc_id") <= low + (high - low) // 2), path, cache)
    return token_counts(docs, path, cache).withColumn("over_limit", F.col("n_tokens") > TOKEN_LIMIT)


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document is bad if it is toxic or of low quality; a page's document is the number in its path."""
    bad = F.greatest(F.col("toxic"), 1 - F.col("quality"))
    labels = table(spark, sf_dir, "labels").select("doc_id", bad.alias("bad"))
    return filter_urls(table(spark, sf_dir, "pages"), labels, URL_RULES).withColumn("purity", F.round("purity", 6))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = shard(table(spark, sf_dir, "documents"), shards=40)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op11_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster(table(spark, sf_dir, "embeddings"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_warc, op2_mixing, op3_language_id, op4_simhash, op5_html_text, op6_exact_dedup, op7_decontamination, op8_token_counts, op9_url_filter, op10_sharding, op11_importance, op12_quality, op13_centroids)}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
