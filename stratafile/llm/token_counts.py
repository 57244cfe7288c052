"""Token counts through a digest cache.

Each row gets the SHA-256 of its normalised content; the cache is a table (digest, tokenizer, n_tokens), the tokenizer's version being the
SHA-256 of its file. Only distinct digests that the cache lacks are encoded, one row for each, and what they give is appended; every
row then takes its count from the cache by a join on both digests.

The text never goes through a shuffle where few rows need no encoding (or few need it): the smaller of the two id lists is broadcast if
it is within BROADCAST_IDS; beyond that the ids are joined by a shuffle.

Defined cases: a null text is the empty text (0 bytes, 0 tokens); repeated rows each get their count; an empty table gives an empty result; very
long texts are encoded whole; other columns are not read."""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterable, Iterator
from itertools import batched

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_IDS, normal_spaces, scratch, values, written

CACHE_SCHEMA = "digest binary, tokenizer string, n_tokens long"
#: Python splits at these, the tokenizers don't.
NOT_SPACE = re.compile("[\x1c-\x1f]")
#: Pieces of text whose counts a worker remembers, twice: when they are reached they become the old ones, from which those still in use are taken over.
REMEMBERED = 500_000


def tokenizer_version(path: str) -> str:
    with open(path, "rb") as f:
        return hashlib.sha256(f.read()).hexdigest()


def drops_white_space(path: str) -> bool:
    """Whether a text's tokens are those of its pieces between white space, one after the other: the tokenizer's file says that it splits by a
    pattern, keeps only what matches, and that no match holds white space."""
    if not path.endswith(".json"):
        return False
    with open(path, encoding="utf-8") as f:
        conf = json.load(f)
    first = ((conf.get("pre_tokenizer") or {}).get("pretokenizers") or [{}])[0]
    pattern = (first.get("pattern") or {}).get("Regex", "")
    plain = all(not t["lstrip"] and not t["rstrip"] and not t["single_word"] and not any(c.isspace() for c in t["content"]) for t in conf.get("added_tokens", []))
    names = {x.get("type") for x in (conf.get("normalizer") or {}).get("normalizers", [])}
    return plain and names <= {"NFC", "Replace", "Lowercase"} and first.get("type") == "Split" and first.get("behavior") == "Removed" and bool(first.get("invert")) and pattern.endswith(r"[^\s\p{L}\p{N}]+")


class Counter:
    """Token counts of whole texts as the tokenizer's library gives them, without added special tokens."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.pieces, self.seen, self.old = drops_white_space(path), {}, {}
        if path.endswith(".json"):
            from tokenizers import Tokenizer

            tok = Tokenizer.from_file(path)
            tok.no_padding()
            tok.no_truncation()
            self.encode = lambda texts: [len(x.ids) for x in tok.encode_batch_fast(texts, add_special_tokens=False)]
        elif path.endswith(".model"):
            import sentencepiece

            piece = sentencepiece.SentencePieceProcessor(model_file=path)
            self.encode = lambda texts: [len(x) for x in piece.encode(texts, num_threads=1)]
        else:
            raise ValueError(f"no library for {path}: it reads .json and .model")

    def __call__(self, texts: Iterable[str]) -> list[int]:
        if not self.pieces:
            return [n for part in batched(texts, 256) for n in self.encode(list(part))]
        out = []
        for text in texts:
            if NOT_SPACE.search(text):
                out += self.encode([text])
                continue
            pieces = text.split()
            try:
                out.append(sum(map(self.seen.__getitem__, pieces)))
            except KeyError:
                self._learn(set(pieces))
                out.append(sum(map(self.seen.__getitem__, pieces)))
        return out

    def _learn(self, pieces: set[str]) -> None:
        """Counts of the pieces, from the old ones where they are there."""
        if len(self.seen) > REMEMBERED:
            self.old, self.seen = self.seen, {}
        seen, old, new = self.seen, self.old, []
        for x in pieces:
            if x not in seen:
                if x in old:
                    seen[x] = old[x]
                else:
                    new.append(x)
        seen.update(zip(new, self.encode(new)))


_counters: dict[str, Counter] = {}


def counter(path: str) -> Counter:
    """One for each worker and file."""
    if path not in _counters:
        _counters[path] = Counter(path)
    return _counters[path]


def _encoder(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(path)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(count(values(batch.column(1))), pa.int64())], names=["digest", "n_tokens"])

    return run


def read_cache(spark, path: str) -> DataFrame:
    """The stored counts; an empty table where nothing was stored yet."""
    try:
        return spark.read.schema(CACHE_SCHEMA).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], CACHE_SCHEMA)


def token_counts(docs: DataFrame, tokenizer: str, cache: str | None = None, doc_id: str = "doc_id", text: str = "text", normalised: Column | None = None) -> DataFrame:
    """(doc_id, n_bytes, n_tokens), a row for each row of docs.

    tokenizer: a file that every executor can open by this path. cache: where counts are stored, kept from run to run; by default a new
    one in the shared folder. normalised: the content whose digest counts, which must have as many tokens as the text; by default the
    text with runs of ASCII white space as one space where the tokenizer drops white space, else the text itself."""
    spark = docs.sparkSession
    version, cache = tokenizer_version(tokenizer), cache or scratch(spark, "op8-cache")
    whole = F.coalesce(F.col(text), F.lit(""))
    content = normalised if normalised is not None else normal_spaces(F.col(text)) if drops_white_space(tokenizer) else whole
    digest = F.unhex(F.sha2(content, 256))
    rows = written(docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.octet_length(whole).cast("long").alias("n_bytes"), digest.alias("digest")), "op8-digests")
    known = read_cache(spark, cache).where(F.col("tokenizer") == version).select("digest")
    misses = written(rows.groupBy("digest").agg(F.min("doc_id").alias("doc_id")).join(known, "digest", "left_anti"), "op8-misses")
    need = misses.select("doc_id").distinct()
    skip = rows.where("doc_id is not null").select("doc_id").distinct().join(need, "doc_id", "left_anti")
    skip = written(skip, "op8-skip")
    few, some = skip.count(), misses.count()
    todo = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    if few <= BROADCAST_IDS:
        todo = todo.join(F.broadcast(skip), "doc_id", "left_anti")
    elif some <= BROADCAST_IDS:
        todo = todo.join(F.broadcast(need), todo.doc_id.eqNullSafe(need.doc_id), "left_semi")
    else:
        todo = todo.join(skip, "doc_id", "left_anti")
    shape = F.coalesce(F.col("text"), F.lit(""))
    own = normalised if normalised is not None else normal_spaces(F.col("text")) if drops_white_space(tokenizer) else shape
    if some:
        new = todo.select(F.unhex(F.sha2(own, 256)).alias("digest"), shape.alias("text")).mapInArrow(_encoder(tokenizer), "digest binary, n_tokens long")
        new = new.join(known, "digest", "left_anti").groupBy("digest").agg(F.min("n_tokens").alias("n_tokens"))
        new.select("digest", F.lit(version).alias("tokenizer"), "n_tokens").write.mode("append").parquet(cache)
    # two writers that saw the same misses have stored them twice
    stored = read_cache(spark, cache).where(F.col("tokenizer") == version).groupBy("digest").agg(F.min("n_tokens").alias("n_tokens"))
    return rows.join(stored, "digest").select("doc_id", "n_bytes", "n_tokens")
